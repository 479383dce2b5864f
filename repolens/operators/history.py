"""Files of commits, without listing every file of every commit.

``changes`` has a row for each path that a commit of the chain changes against its first
parent: chain_pos, old_mode, old_oid, new_mode, new_oid, path. Whole numbers are summed in
the delta form: each change adds its new value and takes off its old one, and a running
sum along the chain gives the totals. Other numbers are summed afresh over the versions
that are live at each sampled commit, the interval form, as differences would lose digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import add_limbs, limbs, rounded
from .lineage import checkpointed

PLAIN_FILE, TREE = "100644", "040000"


def deltas(changes: DataFrame, modes: tuple[str, ...] = (PLAIN_FILE,)) -> DataFrame:
    """(chain_pos, path, oid, sign): +1 for a version that a commit brings, -1 for one that it takes away."""
    both = F.array(
        F.struct(F.col("old_mode").alias("mode"), F.col("old_oid").alias("oid"), F.lit(-1).alias("sign")),
        F.struct(F.col("new_mode").alias("mode"), F.col("new_oid").alias("oid"), F.lit(1).alias("sign")),
    )
    keep = [c for c in changes.columns if c not in ("old_mode", "old_oid", "new_mode", "new_oid")]
    return changes.select(*keep, F.explode(both).alias("d")).select(*keep, "d.*").filter(F.col("mode").isin(*modes)).drop("mode")


def versions(changes: DataFrame, modes: tuple[str, ...] = (PLAIN_FILE,)) -> DataFrame:
    """(path, oid, from_pos, to_pos): a version is live at pos if to_pos < pos <= from_pos."""
    order = Window.partitionBy("path").orderBy(F.col("chain_pos").desc())
    out = changes.withColumn("to_pos", F.coalesce(F.lead("chain_pos").over(order), F.lit(-1)))
    return out.filter(F.col("new_mode").isin(*modes)).select("path", F.col("new_oid").alias("oid"), F.col("chain_pos").alias("from_pos"), "to_pos")


def live(sampled: DataFrame, files: DataFrame, width: int = 256) -> DataFrame:
    """(chain_pos, path, oid): the files of each sampled commit, with what else a row of ``files`` has.

    The range join goes over buckets of ``width`` positions: a version is sent to the buckets
    that it spans, so rows meet by a key and no pair of a commit and a dead version is made.
    """
    spread = files.withColumn("__b", F.explode(F.sequence(F.floor((F.col("to_pos") + 1) / width), F.floor(F.col("from_pos") / width))))
    at = sampled.select("chain_pos", F.floor(F.col("chain_pos") / width).alias("__b"))
    rest = [F.col(f"`{c}`") for c in files.columns if c not in ("path", "oid", "from_pos", "to_pos")]
    return spread.join(at, "__b").filter("chain_pos <= from_pos and chain_pos > to_pos").select("chain_pos", "path", "oid", *rest)


def ranks(sampled: DataFrame, width: int) -> tuple[DataFrame, int, int]:
    """(block, places, before) and the first and last block: the sampled positions of each block of ``width``, and how many lie in earlier ones.

    Blocks without any have a row too, and so has one before and one after all.
    """
    at = sampled.select("chain_pos").distinct()
    own = at.groupBy(F.floor(F.col("chain_pos") / width).alias("block")).agg(F.array_sort(F.collect_list("chain_pos")).alias("places"))
    own = checkpointed(own)
    ends = own.agg(F.min("block").alias("low"), F.max("block").alias("high")).first()
    low, high = ((ends["low"] if ends["low"] is not None else 0) - 1, (ends["high"] if ends["high"] is not None else 0) + 1)
    every = sampled.sparkSession.range(low, high + 1).withColumnRenamed("id", "block").join(own, "block", "left")
    n = F.coalesce(F.size("places"), F.lit(0))
    # A number for each block goes through one task, no position.
    order = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = every.select("block", n.alias("n")).select("block", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("int").alias("before"))
    none = F.array().cast("array<int>")
    return every.join(before, "block").select("block", F.coalesce(F.col("places").cast("array<int>"), none).alias("places"), "before"), low, high


def sample_spans(sampled: DataFrame, spans: DataFrame, width: int = 4096) -> DataFrame:
    """``spans`` (from_pos, to_pos and others) with ``first`` and ``stop``: the sampled commits in it are those from the first up to before the stop, counted by position.

    Spans without a sampled commit have no row.
    """
    places, low, high = ranks(sampled, width)
    block = lambda c: F.greatest(F.least(F.floor(F.col(c) / width), F.lit(high)), F.lit(low))
    out = spans
    for name, position in (("first", "to_pos"), ("stop", "from_pos")):
        met = out.withColumn("block", block(position)).join(places, "block")
        out = met.withColumn(name, F.col("before") + F.size(F.filter("places", lambda p: p <= F.col(position)))).drop("block", "places", "before")  # noqa: B023
    return out.filter("first < stop")


def live_totals(sampled: DataFrame, valued: DataFrame, width: int = 4096) -> DataFrame:
    """(chain_pos, key, total): values summed over the versions that are live at each sampled commit.

    ``valued`` is (key, value, from_pos, to_pos). Positions are exchanged for the numbers of the sampled commits
    that they lie between, so that versions live over the same sampled commits are one span and are summed before they meet
    commits: what meets them is at most a span for each key and pair of sampled commits, however many versions there are. Sums are exact
    and rounded once, so they are the same in any order.
    """
    spans = sample_spans(sampled, valued.select("key", F.col("value").cast("double").alias("value"), "from_pos", "to_pos"), width)
    # A value of zero has a limb as well, so that its key has a row.
    each = F.when(F.col("value") == 0, F.array(F.struct(F.lit(0).alias("place"), F.lit(0).cast("long").alias("limb")))).otherwise(limbs(F.col("value")))
    cut = spans.select("key", "first", "stop", F.explode(each).alias("l")).select("key", "first", "stop", "l.*")
    summed = add_limbs(cut, "key", "first", "stop")
    met = summed.select("key", F.explode(F.sequence(F.col("first"), F.col("stop") - 1)).alias("number"), "place", "limb")
    totals = rounded(met, "key", "number")
    places, *_ = ranks(sampled, width)
    numbers = places.select(F.posexplode("places").alias("i", "chain_pos"), "before").select((F.col("before") + F.col("i")).alias("number"), "chain_pos")
    return totals.join(numbers, "number").select("chain_pos", "key", "total")


BLOCK = 4096


def block_sums(steps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, block, value, n): the steps (chain_pos, key, value, n) summed over blocks of positions."""
    return steps.groupBy("key", F.floor(F.col("chain_pos") / block).alias("block")).agg(F.sum("value").alias("value"), F.sum("n").alias("n"))


def running_totals(sampled: DataFrame, steps: DataFrame, block: int = BLOCK, blocks: DataFrame | None = None) -> DataFrame:
    """(chain_pos, key, total, n) at each sampled commit, from ``steps`` (chain_pos, key, value, n): what each commit adds.

    ``n`` counts files with a value that isn't zero; rows without any are left out. The steps are summed
    per commit and key before. The chain is cut into blocks of positions: sums run within a block,
    and what all older blocks add is summed apart, over a row for each key and block. ``blocks``, if these sums
    are known, as of ``block_sums``; rows of one key and block add up. Then steps are read in blocks with sampled commits alone.
    """
    summed = steps.groupBy("chain_pos", "key").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    of_block = F.floor(F.col("chain_pos") / block).alias("block")
    asked = sampled.select(of_block).distinct()
    if blocks is None:
        # What the steps come from, such as all contents, is read once; the sums have a row for each key and commit that changes it.
        summed = checkpointed(summed)
        blocks = block_sums(summed, block)
    else:
        summed = steps.join(asked, of_block == asked["block"], "left_semi").groupBy("chain_pos", "key").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    # Every key has a row in each asked block, so that it has one at each sampled commit there: as many as the result has at least.
    grid = blocks.select("key").distinct().crossJoin(asked).select("key", "block", zero.alias("value"), zero.alias("n"))
    older = Window.partitionBy("key").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.unionByName(grid).groupBy("key", "block").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    offsets = offsets.select("key", "block", F.coalesce(F.sum("value").over(older), F.lit(0)).alias("before"), F.coalesce(F.sum("n").over(older), F.lit(0)).alias("n_before"))
    ask = sampled.select("chain_pos", of_block).join(offsets.select("key", "block"), "block").select("chain_pos", "key", zero.alias("value"), zero.alias("n"), F.lit(1).alias("ask"))
    rows = summed.withColumn("ask", F.lit(0)).unionByName(ask).withColumn("block", of_block)
    order = Window.partitionBy("key", "block").orderBy(F.col("chain_pos").desc(), "ask").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.select("chain_pos", "key", "block", "ask", F.sum("value").over(order).alias("value"), F.sum("n").over(order).alias("m")).filter("ask = 1")
    return totals.join(offsets, ["key", "block"]).select("chain_pos", "key", (F.col("value") + F.col("before")).alias("total"), (F.col("m") + F.col("n_before")).alias("n")).filter("n > 0")


def names_of_contents(files: DataFrame) -> DataFrame:
    """(oid, names): the sorted distinct file names of each content, from (path, oid)."""
    return files.groupBy("oid").agg(F.array_sort(F.collect_set(F.element_at(F.split("path", "/"), -1))).alias("names"))


def _walk(start: DataFrame, entries: DataFrame, modes: tuple[str, ...], keep: tuple[str, ...], once: bool) -> DataFrame:
    """(keep, path, oid) of all files below the trees of ``start`` (keep, oid, path), level by level; ``once``: a tree at a path is expanded once."""
    below = entries.select(F.col("tree_oid").alias("oid"), "name", "mode", "child_oid").filter(F.col("mode").isin(*modes, TREE))
    level, files, seen = checkpointed(start.distinct()), None, None
    while not level.isEmpty():
        seen = level if seen is None else seen.unionByName(level)
        path = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws("/", "path", "name"))
        found = checkpointed(level.join(below, "oid").select(*keep, path.alias("path"), F.col("child_oid").alias("oid"), "mode"))
        here = found.filter(F.col("mode") != TREE).drop("mode")
        files = here if files is None else files.unionByName(here)
        level = found.filter(F.col("mode") == TREE).drop("mode").distinct()
        level = checkpointed(level.join(seen, level.columns, "left_anti") if once else level)
    return files if files is not None else start.select(*keep, "path", "oid").limit(0)


def tree_files(roots: DataFrame, entries: DataFrame, modes: tuple[str, ...] = (PLAIN_FILE,)) -> DataFrame:
    """(tree_oid, path, oid) of every file below each root tree.

    ``roots`` has ``tree_oid``; ``entries`` tree_oid, name, mode, child_oid. A tree is expanded once for each root that has it.
    """
    return _walk(roots.select("tree_oid", F.col("tree_oid").alias("oid"), F.lit("").alias("path")), entries, modes, ("tree_oid",), False)


def tree_versions(roots: DataFrame, entries: DataFrame, modes: tuple[str, ...] = (PLAIN_FILE,)) -> DataFrame:
    """(path, oid): the distinct files below any of the root trees; a tree at a path is expanded once, however many roots share it."""
    return _walk(roots.select(F.col("tree_oid").alias("oid"), F.lit("").alias("path")), entries, modes, (), True).distinct()


def reachable_trees(roots: DataFrame, entries: DataFrame) -> DataFrame:
    """(tree_oid): the distinct trees at or below ``roots`` (tree_oid). Each is expanded once, at whatever paths and below whatever roots it lies."""
    below = entries.filter(F.col("mode") == TREE).select("tree_oid", "child_oid")
    level = seen = checkpointed(roots.select("tree_oid").distinct())
    while not level.isEmpty():
        found = level.join(below, "tree_oid").select(F.col("child_oid").alias("tree_oid")).distinct()
        level = checkpointed(found.join(seen, "tree_oid", "left_anti"))
        seen = seen.unionByName(level)
    return seen


def tree_totals(roots: DataFrame, entries: DataFrame, values: DataFrame, modes: tuple[str, ...] = (PLAIN_FILE,)) -> DataFrame:
    """(tree_oid, key, total, n) of every distinct tree at or below ``roots``; ``n`` counts the files with a value.

    ``values`` is (name, oid, key, value): what a file's name and content tell, whatever the directory. A tree is summed
    once, when all trees in it have been, and its sum is what every tree and root above takes: rounds go from the leaves up, as
    many as trees are nested. A tree that lies in another under two names counts twice. Trees without a valued file have no row.
    """
    trees = reachable_trees(roots, entries)
    inside = entries.join(trees, "tree_oid")
    files = inside.filter(F.col("mode").isin(*modes)).select("tree_oid", "name", F.col("child_oid").alias("oid")).join(values, ["name", "oid"])
    own = checkpointed(files.groupBy("tree_oid", "key").agg(F.sum("value").alias("total"), F.count("*").alias("n")))
    waiting = checkpointed(inside.filter(F.col("mode") == TREE).groupBy("tree_oid", "child_oid").agg(F.count("*").alias("times")))
    # A tree without trees is done; one that waits is done a round after the last tree in it.
    ready = checkpointed(trees.join(waiting.select("tree_oid").distinct(), "tree_oid", "left_anti"))
    ready_totals = checkpointed(own.join(ready, "tree_oid", "left_semi"))
    handed, done = None, ready_totals
    while not waiting.isEmpty():
        finished = ready.withColumnRenamed("tree_oid", "child_oid")
        met = waiting.join(ready_totals.withColumnRenamed("tree_oid", "child_oid"), "child_oid")
        up = met.groupBy("tree_oid", "key").agg(F.sum(F.col("total") * F.col("times")).alias("total"), F.sum(F.col("n") * F.col("times")).alias("n"))
        handed = checkpointed(up if handed is None else handed.unionByName(up).groupBy("tree_oid", "key").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
        left = checkpointed(waiting.join(finished, "child_oid", "left_anti"))
        ready = checkpointed(waiting.select("tree_oid").distinct().join(left.select("tree_oid").distinct(), "tree_oid", "left_anti"))
        both = own.unionByName(handed).join(ready, "tree_oid", "left_semi")
        ready_totals = checkpointed(both.groupBy("tree_oid", "key").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
        handed = handed.join(ready, "tree_oid", "left_anti")
        done, waiting = done.unionByName(ready_totals), left
    return done


def directory_rollup(files: DataFrame, value: str, by: tuple[str, ...] = ("chain_pos",)) -> DataFrame:
    """(by, directory, total): ``value`` summed over each directory and all above it; the root is ``.``."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    return files.select(*by, F.explode(above).alias("directory"), value).groupBy(*by, "directory").agg(F.sum(value).alias("total"))

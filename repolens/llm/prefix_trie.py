"""The prefix trie of conversations by partition refinement (operator 13).

At depth 0 all conversations are one class. Classes with several members are active: their next
turns split them, and the parts are the nodes one deeper. A class with a single member is retired:
the rest of its conversation is a unary chain, taken from its turns without further grouping. A
round refines one more run of turns, twice as many as the round before: within it a node is known by its class
and the turns since then, as two 64-bit hashes. So a trie of depth n takes about log n rounds, up
to ``Growth.most`` turns a round. Folding back goes from the last round to the first: what a
node hands up is carried by its least member, so that sums over a subtree are sums over members.

Turns are numbered by a sort in ranges, so one conversation may hold any part of the rows. No class or
conversation is gathered in one place: classes are counts and minima, which add up before they
are shuffled, and the ids that end at a node are hashed as a stream of pieces.

Rows: a null conv_id takes no part; null roles and texts are empty; turns go in order, null first, equal ones by
role, then text. Repeated rows are turns of their own. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Ids of a piece of an end list.
PIECE = 1024
NOTHING = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Growth:
    """Turns of the first round, and of a round at most."""

    first: int = 1
    most: int = 1024


def numbered(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, pos, turn_hash, bytes): turns numbered from 0. ``turn_hash`` tells role and text; ``bytes`` is the text's size in UTF-8."""
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    both = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    ordered = rows.orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    laid = scratch.table(ordered.select("conv_id", F.unhex(F.sha2(both, 256)).alias("turn_hash"), F.octet_length("text").alias("bytes"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "laid")
    runs = laid.groupBy("conv_id", "part").agg(F.min("at").alias("least"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("conv_id", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("least")).alias("shift"))
    out = scratch.table(laid.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "turn_hash", "bytes"), "turns")
    scratch.drop(laid)
    return out


def rebuilt(turns: DataFrame, base: str, head: str, most: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``head`` turns are those of conversation ``base`` (SQL over conv_id; head is ``most`` at most).

    (conv_id, depth, turn_hash, bytes, last), depth from 1; and (conv_id, size) of all, turnless ones too.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", F.expr(base).alias("base"), F.expr(head).alias("head"))
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("head", F.coalesce("n_base", F.lit(0)))
    sizes = scratch.table(own.join(bases, "base", "left").select("conv_id", "base", "head", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("size")), "sizes")
    first = turns.filter(F.col("pos") < most).withColumnRenamed("conv_id", "base").join(sizes, "base").filter("pos < head").select("conv_id", (F.col("pos") + 1).alias("depth"), "turn_hash", "bytes", "size")
    rest = turns.join(sizes, "conv_id").filter("pos >= head").select("conv_id", (F.col("pos") - F.col("head") + F.col("taken") + 1).alias("depth"), "turn_hash", "bytes", "size")
    rows = scratch.table(first.unionAll(rest).select("conv_id", "depth", "turn_hash", "bytes", (F.col("depth") == F.col("size")).alias("last")), "rebuilt")
    return rows, sizes.select("conv_id", "size")


def refine(rows: DataFrame, sizes: DataFrame, scratch: Scratch, growth: Growth = Growth()) -> tuple[list[DataFrame], DataFrame]:
    """Tables (conv_id, depth, rep, n, parent, bytes, last) of the rounds, a row for each member of a node, and (conv_id, since) of the retired.

    A node is known by its depth and ``rep``, its least member; ``n`` counts members, ``parent`` is the rep of the node above.
    """
    root = sizes.agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"))
    null = F.lit(None).cast("long")
    members = scratch.table(sizes.crossJoin(F.broadcast(root)).select("conv_id", F.lit(0).cast("long").alias("depth"), "rep", "n", null.alias("parent"), F.lit(0).alias("bytes"), (F.col("size") == 0).alias("last")), "members")
    rounds, retired, depth, width = [members], None, 0, growth.first
    while True:
        at = members.filter((F.col("depth") == depth) & ~F.col("last"))
        gone = at.filter("n = 1").select("conv_id", F.lit(depth).cast("long").alias("since"))
        retired = gone if retired is None else retired.unionAll(gone)
        active = scratch.table(at.filter("n > 1").select("conv_id", F.col("rep").alias("class")), "active")
        if active.isEmpty():
            scratch.drop(active)
            return rounds, retired
        within = Window.partitionBy("conv_id").orderBy("depth")
        so_far = within.rowsBetween(Window.unboundedPreceding, 0)
        mark = lambda salt: F.bit_xor(F.xxhash64("turn_hash", "depth", F.lit(salt))).over(so_far)
        block = rows.filter((F.col("depth") > depth) & (F.col("depth") <= depth + width)).join(active, "conv_id")
        keyed = scratch.table(block.select("conv_id", "class", "depth", mark(1).alias("x"), mark(2).alias("y"), "bytes", "last"), "keyed")
        key = ["class", "depth", "x", "y"]
        classes = keyed.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"))
        above = F.coalesce(F.lag("rep").over(within), F.col("class"))
        members = scratch.table(keyed.join(classes, key).select("conv_id", "depth", "rep", "n", above.alias("parent"), "bytes", "last"), "members")
        scratch.drop(keyed, active)
        rounds.append(members)
        depth, width = depth + width, min(2 * width, growth.most)


def fold(rounds: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(depth, rep, n_children, n_leaves, saved) of the nodes with several members, from the deepest round up."""
    sums, carried = None, None
    nodes = _union([r.filter("conv_id = rep").select("depth", "rep", "parent", "n", "last") for r in rounds])
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("rep")).agg(F.count("*").alias("n_children"))
    # A node without children is counted by its least member; that of a single one lies in its chain.
    many = nodes.filter("n > 1").join(children, ["depth", "rep"], "left")
    leaves = scratch.table(many.filter("n_children is null").select(F.col("rep").alias("conv_id")).unionAll(nodes.filter("n = 1").select(F.col("rep").alias("conv_id"))).distinct(), "leaves")
    for r in reversed(rounds):
        down = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
        own = F.when(F.col("rep") == F.col("conv_id"), (F.col("n") - 1) * F.col("bytes")).otherwise(F.lit(0)).cast("long")
        rows = r.filter("n > 1").select("conv_id", "depth", "rep", F.sum(own).over(down).alias("saved"))
        if carried is not None:
            rows = rows.join(carried, "conv_id", "left").select("conv_id", "depth", "rep", (F.col("saved") + F.coalesce("below", F.lit(0))).alias("saved"))
        rows = scratch.table(rows, "folded")
        carried = rows.groupBy("conv_id").agg(F.max("saved").alias("below"))
        # What the members hand up: each its part of the saving, and one if the chain or end below is its own.
        one = rows.join(leaves.withColumn("leaf", F.lit(1)), "conv_id", "left").groupBy("depth", "rep").agg(F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum("saved").alias("saved"))
        sums = one if sums is None else sums.unionAll(one)
    return sums.join(many.select("depth", "rep", F.coalesce("n_children", F.lit(0)).alias("n_children")), ["depth", "rep"])


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, rep, ends_sha256) of ``ends`` (depth, rep, conv_id): ids in pieces, ascending, hashed one piece after the other."""
    pieces = ends.groupBy("depth", "rep", F.expr(f"conv_id div {PIECE} - if(conv_id % {PIECE} < 0, 1, 0)").alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(key, state):
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], ["depth", "rep", "ends_sha256"])

        last, state = None, None
        for b in batches:
            out = []
            for depth, rep, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (depth, rep) != last:
                    if last:
                        out.append(made(last, state))
                    last, state = (depth, rep), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if last:
            yield made(last, state)

    laid = pieces.repartition("depth", "rep").sortWithinPartitions("depth", "rep", "piece").select("depth", "rep", "ids")
    return laid.mapInArrow(run, "depth long, rep long, ends_sha256 string")


def trie(conversations: DataFrame, base: str, head: str, most_head: int, growth: Growth = Growth(), scratch: Scratch | None = None) -> DataFrame:
    """A row for each node: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``base``, ``head``: SQL over conv_id, from which conversation the first turns are, and how many, ``most_head`` at most.
    """
    scratch = scratch or Scratch(conversations.sparkSession)
    turns = numbered(conversations, scratch)
    rows, sizes = rebuilt(turns, base, head, most_head, scratch)
    scratch.drop(turns)
    rounds, retired = refine(rows, sizes, scratch, growth)
    nodes = _union([r.filter("conv_id = rep") for r in rounds])
    one = F.lit(1).cast("long")
    ended = F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOTHING))

    def alone(table: DataFrame, parent: Column) -> DataFrame:
        return table.select("conv_id", "depth", parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), ended.alias("ends_sha256"))

    single = alone(nodes.filter("n = 1"), F.col("parent"))
    tails = alone(rows.join(retired, "conv_id").filter("depth > since"), F.col("conv_id"))
    ends = end_hashes(_union([r.filter("last and n > 1").select("depth", "rep", "conv_id") for r in rounds]))
    many = nodes.filter("n > 1").join(fold(rounds, scratch), ["depth", "rep"]).join(ends, ["depth", "rep"], "left")
    shared = many.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    return shared.unionAll(single).unionAll(tails)

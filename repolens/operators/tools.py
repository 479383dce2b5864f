"""Which tools a repository uses: a table of file and directory patterns joined with file listings.

File patterns: with ``*`` a glob over the whole path; with a leading ``/`` the path itself from the root; else the
file's name. Of the hits of a glob the first ``CAP`` of a repository are shown. Directory
patterns: with ``*`` a glob over the file's path; with a leading ``/`` a prefix of the path;
else any component, the file's name included.

All patterns meet files by a key in hash joins. A plain pattern is its own key. Of a glob the key is text that
each of its matches must have: the end, the beginning, or a piece of the inside, whichever is longest, of at most ``KEY`` characters; files have a key for
each length of these that some glob has. Only pairs with equal keys are held against the pattern. A glob without such
text, as ``*``, is held against every file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.patterns import glob_key, glob_to_regex
from .lineage import checkpointed

CAP = 10
#: The most characters of a glob's key: at an end of the path, and inside of it.
KEY, INSIDE = 16, 8
RULE_SCHEMA = "name string, files array<string>, dirs array<string>, language string, category string"


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a file with a JSON object in each line; blank lines are skipped, a bad one is an error that tells its number, counted from 1."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n", -1)).alias("i", "line"))
    bad = text.filter("trim(line) <> ''").filter(~F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False))).orderBy("i").limit(1).collect()
    if bad:
        raise ValueError(f"line {bad[0]['i'] + 1} is not a JSON object: {bad[0]['line'][:200]}")
    return spark.read.schema(RULE_SCHEMA).option("mode", "FAILFAST").json(path)


def explode_rules(rules: DataFrame) -> DataFrame:
    """(rule_pos, name, scope, pattern, kind): a row for each pattern. ``rules`` may carry ``rule_pos``; else rules are counted in their order."""
    if "rule_pos" not in rules.columns:
        rules = rules.withColumn("rule_pos", F.monotonically_increasing_id())

    def side(column: str, scope: str) -> DataFrame:
        return rules.select("rule_pos", "name", F.lit(scope).alias("scope"), F.explode(F.array_distinct(F.coalesce(column, F.array().cast("array<string>")))).alias("pattern"))

    kind = F.when(F.contains("pattern", F.lit("*")), "glob").when(F.startswith("pattern", F.lit("/")), "root").otherwise("plain")
    return side("files", "file").unionAll(side("dirs", "dir")).withColumn("kind", kind)


def lint(rules: DataFrame) -> DataFrame:
    """Patterns that can never match: an inner ``/`` without ``*``, or ``*`` after a leading ``/``."""
    p = F.col("pattern")
    return explode_rules(rules).filter(((F.col("kind") == "plain") & F.contains(p, F.lit("/"))) | ((F.col("kind") == "glob") & F.startswith(p, F.lit("/")))).select("name", "scope", "pattern")


def glob_index(patterns: DataFrame) -> DataFrame:
    """The glob rows of ``patterns``, with ``regex``, ``place`` (end, start, inside or any), ``size`` and ``key`` of the text that each match must have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            globs = b.column(b.schema.get_field_index("pattern")).to_pylist()
            keys = [glob_key(g, KEY, INSIDE) for g in globs]
            more = {"regex": [glob_to_regex(g) for g in globs], "place": [k[0] for k in keys], "size": [len(k[1]) for k in keys], "key": [k[1] for k in keys]}
            arrays = [pa.array(v, pa.int32() if name == "size" else pa.string()) for name, v in more.items()]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], [*b.schema.names, *more])

    rows = patterns.filter("kind = 'glob'").select("rule_pos", "name", "pattern")
    return checkpointed(rows.mapInArrow(run, StructType([*rows.schema.fields]).add("regex", "string").add("place", "string").add("size", "integer").add("key", "string")))


def _globs(patterns: DataFrame, files: DataFrame, matched: str) -> DataFrame:
    """Hits of the glob patterns: files meet globs by the text that these need, and what meets is held against the pattern."""
    index = glob_index(patterns)
    # Lengths are at most KEY at each end and INSIDE within, whatever the number of globs.
    asked = {(r["place"], r["size"]) for r in index.filter("place <> 'any'").select("place", "size").distinct().collect()}
    path = F.col("path")

    def key(place: str, size: int):
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(path) - size + 1, F.lit(1))), lambda i: F.substring(path, i, F.lit(size)))
        keys = F.array_distinct(grams) if place == "inside" else F.array(F.right(path, F.lit(size)) if place == "end" else F.left(path, F.lit(size)))
        return F.transform(F.when(F.char_length(path) >= size, keys).otherwise(F.array().cast("array<string>")), lambda k: F.struct(F.lit(place).alias("place"), F.lit(size).alias("size"), k.alias("key")))

    each = F.flatten(F.array(*[key(*a) for a in sorted(asked)])) if asked else F.array().cast("array<struct<place:string,size:int,key:string>>")
    keyed = files.select("repo_path", "file_pos", "path", F.explode(each).alias("k")).select("repo_path", "file_pos", "path", "k.*")
    met = keyed.join(index, ["place", "size", "key"]).drop("place", "size", "key")
    # Globs without a key are few kinds (``*``, ``?*``, ..); each is a test of every file, as its meaning is.
    free = files.select("repo_path", "file_pos", "path").crossJoin(index.filter("place = 'any'").drop("place", "size", "key"))
    hits = met.unionByName(free).filter(F.regexp_like("path", F.col("regex")))
    return hits.select("repo_path", F.col("rule_pos").cast("long").alias("rule_pos"), "name", "pattern", "file_pos", (path if matched == "path" else F.col("pattern")).alias("hit"))


def glob_hits(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(repo_path, rule_pos, name, pattern, file_pos, hit) of the globs of ``patterns``, all hits of each."""
    return _globs(patterns, files, "path")


def file_hits(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(repo_path, rule_pos, name, pattern, file_pos, hit) of the file patterns of ``patterns`` (as of ``explode_rules``); of a glob the first ``CAP`` of a repository."""
    rules = patterns.filter("scope = 'file'").drop("scope")
    out = ["repo_path", "rule_pos", "name", "pattern", "file_pos", "hit"]
    keyed = files.select("repo_path", "file_pos", "path", F.explode(F.array(F.struct(F.lit("plain").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("key")), F.struct(F.lit("root").alias("kind"), F.concat(F.lit("/"), "path").alias("key")))).alias("k")).select("*", "k.*")
    plain = keyed.join(rules.withColumnRenamed("pattern", "key"), ["kind", "key"]).select("repo_path", "rule_pos", "name", F.col("key").alias("pattern"), "file_pos", F.col("path").alias("hit"))
    first = Window.partitionBy("repo_path", "rule_pos", "pattern").orderBy("file_pos")
    capped = _globs(rules, files, "path").withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= CAP).drop("__n")
    return plain.select(*out).unionAll(capped.select(*out))


def dir_hits(files: DataFrame, patterns: DataFrame, strict_dirs: bool = False) -> DataFrame:
    """Distinct (repo_path, rule_pos, name, hit) of the directory patterns of ``patterns``.

    Components meet patterns by their text. A leading ``/`` is a prefix of the path: each path has a key of the length
    of every such pattern, and as the lengths are few and short, these are hash joins as well.
    """
    rules = patterns.filter("scope = 'dir'").drop("scope")
    out = ["repo_path", "rule_pos", "name", "hit"]
    parts = F.split("path", "/")
    own = F.slice(parts, 1, F.size(parts) - 1) if strict_dirs else parts
    component = files.select("repo_path", F.explode(F.array_distinct(own)).alias("pattern")).distinct().join(rules.filter("kind = 'plain'"), "pattern")
    rooted = rules.filter("kind = 'root'").withColumn("key", F.concat("pattern", F.lit("/" if strict_dirs else "")))
    lengths = [r["n"] for r in rooted.select(F.char_length("key").alias("n")).distinct().collect()]
    whole = F.concat(F.lit("/"), "path")
    prefixes = F.array(*[F.when(F.char_length(whole) >= n, F.left(whole, F.lit(n))) for n in sorted(lengths)]) if lengths else F.array().cast("array<string>")
    prefixed = files.select("repo_path", F.explode(F.array_compact(prefixes)).alias("key")).distinct().join(rooted, "key")
    hits = component.select("repo_path", "rule_pos", "name", F.col("pattern").alias("hit")).unionAll(prefixed.select("repo_path", "rule_pos", "name", F.col("pattern").alias("hit")))
    return hits.unionAll(_globs(rules, files, "pattern").select(*out)).distinct()


def detect(files: DataFrame, rules: DataFrame, strict_dirs: bool = False) -> DataFrame:
    """(repo_path, rule_pos, name, matching_files, matching_dirs): sorted, distinct; rules without a hit have no row.

    ``files`` is (repo_path, file_pos, path). ``strict_dirs``: a leading ``/`` names a directory, not a prefix, and file names are no directories.
    """
    patterns = explode_rules(rules)
    out = ["repo_path", "rule_pos", "name", "scope", "hit"]
    both = file_hits(files, patterns).withColumn("scope", F.lit("file")).select(*out).unionAll(dir_hits(files, patterns, strict_dirs).withColumn("scope", F.lit("dir")).select(*out))
    pick = lambda s: F.array_sort(F.collect_set(F.when(F.col("scope") == s, F.col("hit"))))
    return both.groupBy("repo_path", "rule_pos", "name").agg(pick("file").alias("matching_files"), pick("dir").alias("matching_dirs"))


def as_json_array(found: DataFrame) -> DataFrame:
    """One row, ``json``: the matches of one repository as an array, in the order of the rules."""
    rows = found.select("rule_pos", F.struct("name", "matching_files", "matching_dirs").alias("m"))
    return rows.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rule_pos", "m"))), lambda x: x["m"])).alias("json"))


def as_lines(found: DataFrame, scan: bool = False) -> DataFrame:
    """``json``, a line for each match; a scan of many repositories adds the path and calls the name tool_name."""
    body = F.struct("repo_path", F.col("name").alias("tool_name"), "matching_files", "matching_dirs") if scan else F.struct("name", "matching_files", "matching_dirs")
    return found.orderBy("repo_path", "rule_pos").select(F.to_json(body).alias("json"))

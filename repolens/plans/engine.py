"""Running statistics over repositories, and detecting tools.

Contents are read once for each distinct version, and only if a statistic looks at them. With ``snapshots`` all
statistics of a repository share one reading of its tables; without, each reads its changes again. With
``increments`` what has been read and summed is kept, and only new commits are read.
"""

from __future__ import annotations

import hashlib
import os
import warnings
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import glob_matches
from ..functions.values import loose_datetime, number_text, timestamp_text
from ..operators import history as H
from ..operators import tools
from ..operators.lineage import checkpointed
from ..operators.measures import Measurement, Script, StatConfig
from ..operators.reshape import wide
from ..operators.sampling import Granularity, in_order, sample
from ..sources import config, results
from ..sources.git import contents, find_repositories, git, history
from .rules import bundled_rules


def parse_date(spark: SparkSession, text: str | None) -> datetime | None:
    """A loosely written date; an error if it is none."""
    if text is None:
        return None
    got = spark.range(1).select(F.unix_seconds(loose_datetime(F.lit(text))).alias("t")).first()["t"]
    if got is None:
        raise ValueError(f"not a date: {text!r}")
    return datetime.fromtimestamp(got, UTC)


def measured(files: DataFrame, contents: DataFrame | Callable[[DataFrame], DataFrame], measurement: Measurement, path_glob: str | None = None, watch: Watch | None = None) -> DataFrame:
    """(path, oid, key, value): each distinct (path, oid) of ``files`` once. ``contents`` is (oid, content), or gives it for the ids (oid) that are asked for."""
    once = files.select("path", "oid")
    if path_glob:
        once = once.filter(glob_matches(F.col("path"), path_glob))
    once = once.distinct()
    if watch:
        once = watch.on(checkpointed(once), "versions")
    if measurement.contents:
        if callable(contents):
            contents = contents(once.select("oid").distinct())
        once = once.join(contents.select("oid", "content").dropDuplicates(["oid"]), "oid")
        once = watch.on(once, "read") if watch else once
    values = measurement.measure(once)
    return checkpointed(watch.on(values, "values")) if watch else values


class Watch:
    """Counts of what a run has looked at, taken by the run itself as its rows go by."""

    def __init__(self):
        self.taken: dict[str, Observation] = {}

    def on(self, df: DataFrame, name: str) -> DataFrame:
        self.taken[name] = Observation(name)
        return df.observe(self.taken[name], F.count(F.lit(1)).alias("n"))

    def counts(self) -> dict[str, int]:
        """By name; waits for the actions that take them."""
        return {name: o.get["n"] for name, o in self.taken.items()}


def series(commits: DataFrame, changes: DataFrame, contents: DataFrame, stat: StatConfig, granularity: Granularity | None = None, start: datetime | None = None, end: datetime | None = None, watch: Watch | None = None) -> DataFrame:
    """(commit, date, bucket, chain_pos, key, value): ``value`` is text; a sampled commit without keys has one row whose key is null.

    With ``watch`` the values are worked out at once and counted: ``versions`` of files that are looked at, those ``read`` (as
    far as contents are) and ``values`` found; versions without a value are those that couldn't be measured or come to zero.
    """
    measurement = stat.measurement()
    sampled = sample(commits, granularity or Granularity.parse(stat.granularity), start, end)
    if measurement.whole:
        d = H.deltas(changes)
        values = measured(d, contents, measurement, stat.path_in_repo, watch)
        steps = d.join(values, ["path", "oid"]).select("chain_pos", "key", (F.col("sign") * F.col("value")).cast("long").alias("value"), F.col("sign").cast("long").alias("n"))
        totals = H.running_totals(sampled, steps)
    else:
        versions = H.versions(changes)
        values = measured(versions, contents, measurement, stat.path_in_repo, watch)
        totals = H.live_totals(sampled, versions.join(values, ["path", "oid"]).select("key", "value", "from_pos", "to_pos"))
    return shown(sampled, totals, measurement)


def shown(sampled: DataFrame, totals: DataFrame, measurement: Measurement) -> DataFrame:
    """The rows of ``series``, of totals (chain_pos, key, total) at the sampled commits."""
    totals = measurement.finish(totals.select("chain_pos", "key", "total"))
    if measurement.always:
        every = sampled.select("chain_pos", F.lit(measurement.always).alias("key"))
        totals = every.join(totals, ["chain_pos", "key"], "left").select("chain_pos", "key", F.coalesce("total", F.lit(0)).alias("total"))
    return sampled.join(totals, "chain_pos", "left").select(F.col("sha").alias("commit"), F.col("ts").alias("date"), "bucket", "chain_pos", "key", number_text(F.col("total")).alias("value"))


def script_series(spark: SparkSession, repo: str, commits: DataFrame, stat: StatConfig, granularity: Granularity | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """As ``series``, for a command over whole commits: each sampled commit is checked out by the task that measures it."""
    script: Script = stat.measurement()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(pos, k, v) for pos, sha in zip(*(c.to_pylist() for c in b.columns), strict=True) for k, v in script.at(repo, sha).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], ["chain_pos", "key", "total"])

    sampled = sample(commits, granularity or Granularity.parse(stat.granularity), start, end)
    totals = sampled.select("chain_pos", "sha").repartition("chain_pos").mapInArrow(run, "chain_pos int, key string, total double")
    return sampled.join(totals, "chain_pos", "left").select(F.col("sha").alias("commit"), F.col("ts").alias("date"), "bucket", "chain_pos", "key", number_text(F.col("total")).alias("value"))


def wanted_contents(spark: SparkSession, path: str) -> Callable[[DataFrame], DataFrame]:
    """Gives the contents of a repository's objects for the ids that are asked for, and reads no others."""

    def read(ids: DataFrame) -> DataFrame:
        return contents(history(spark, "objects", path).join(ids, "oid").select("repo", "oid", "place"))

    return read


def publish(rows: DataFrame) -> DataFrame:
    """The wide table: commit, date, a column for each key; by period, or newest first if unsampled."""
    commits = rows.select("commit", "date", "bucket", "chain_pos").distinct()
    table = in_order(wide(commits, rows.filter("key is not null").select("commit", "key", "value")))
    return table.select("commit", timestamp_text(F.col("date")).alias("date"), *[f"`{c}`" for c in table.columns if c not in ("commit", "date", "bucket", "chain_pos")])


#: The most rules that are warned of.
SHOWN = 100

from . import increments  # noqa: E402  it uses the functions above


class Engine:
    """``snapshots``: a folder that keeps each repository's tables as of its tip; ``increments``: one that keeps the sums of each statistic, so that only new commits are read."""

    def __init__(self, spark: SparkSession, root: str = config.ROOT, snapshots: str | None = None, increments: str | None = None):
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        #: Of the last statistic that was worked out from a repository's tables.
        self.counts: dict[str, int] = {}
        self.spark, self.catalog, self.snapshots, self.increments = spark, config.Catalog.load(root), snapshots, increments

    def tables(self, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """commits, changes and contents of a repository; from the snapshot of its tip if there is one."""
        names = ("commits", "raw_changes", "blobs")
        if not self.snapshots:
            return history(self.spark, names[0], path), history(self.spark, names[1], path), wanted_contents(self.spark, path)
        head = git(path, "rev-parse", "HEAD").decode().strip()
        # Each repository has a folder of its own, so that dropping its old tips leaves other repositories' alone.
        folder = f"{self.snapshots.rstrip('/')}/{hashlib.sha256(os.path.realpath(path).encode()).hexdigest()[:16]}"
        if results.read_snapshot(self.spark, folder, head, names[0]) is None:
            results.write_snapshot({t: history(self.spark, t, path) for t in names}, folder, head)
            results.drop_other_snapshots(self.spark, folder, head)
        return tuple(results.read_snapshot(self.spark, folder, head, t) for t in names)

    def table(self, path: str, stat: StatConfig, granularity: str | None = None, since: str | None = None) -> DataFrame:
        """The wide table of one statistic. What is passed goes before the config, the config before the default, daily."""
        if self.increments and stat.measurement().whole and not isinstance(stat.measurement(), Script):
            sums = increments.Sums(self.spark, self.increments, path, stat)
            sums.update()
            g = Granularity.parse(granularity if granularity is not None else stat.granularity)
            return publish(sums.series(g, parse_date(self.spark, since or stat.start), parse_date(self.spark, stat.end)))
        commits, changes, contents = self.tables(path)
        g = Granularity.parse(granularity if granularity is not None else stat.granularity)
        start, end = parse_date(self.spark, since or stat.start), parse_date(self.spark, stat.end)
        if isinstance(stat.measurement(), Script):
            return publish(script_series(self.spark, path, commits, stat, g, start, end))
        watch = Watch()
        out = publish(series(commits, changes, contents, stat, g, start, end, watch))
        self.counts = watch.counts()
        return out

    def run_config(self, config_path: str, repo_path: str, out: str | None = None) -> str:
        stat = config.read_stat(config_path)
        return results.write_csv(self.table(repo_path, stat), out or f"{stat.name}.csv")

    def run(self, repo: str, stat: str, granularity: str | None = None, since: str | None = None) -> str:
        table = self.table(self.catalog.storage_path(repo), self.catalog.stat(repo, stat), granularity, since)
        return results.write_csv(table, self.catalog.stat_path(repo, stat))

    def run_many(self, repo: str | None = None, stats: tuple[str, ...] = (), granularity: str | None = None, since: str | None = None) -> list[str]:
        return [self.run(r, s, granularity, since) for r, s in self.catalog.pairs(repo, stats)]

    def to_run(self, repo: str | None = None, stats: tuple[str, ...] = ()) -> DataFrame:
        return self.spark.createDataFrame(self.catalog.pairs(repo, stats), "repo string, stat string")

    def detect_tools(self, repo: str | None = None, rules_path: str | None = None, scan_root: str | None = None, max_depth: int = 3, strict_dirs: bool = False) -> DataFrame:
        """Matches of one repository, or of all at a depth below a folder, in one job."""
        if (repo is None) == (scan_root is None):
            raise ValueError("either a repository or a folder to scan")
        repos = [repo] if repo else find_repositories(scan_root, max_depth)
        rules = tools.read_rules(self.spark, rules_path) if rules_path else bundled_rules(self.spark)
        for r in tools.lint(rules).limit(SHOWN).collect():
            warnings.warn(f"tool {r['name']}: the {r['scope']} pattern {r['pattern']!r} can never match", stacklevel=2)
        files = history(self.spark, "repo_files", *repos) if repos else self.spark.createDataFrame([], "repo_path string, file_pos int, path string")
        return tools.detect(files, rules, strict_dirs)

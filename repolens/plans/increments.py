"""Sums of a statistic that are kept as its repository grows.

Commits are numbered from the root, so that numbers stay as the tip moves (``chain_pos`` is the negative
number: the tip is the least). A segment holds what the commits from one tip to the next have brought: the commits, the
values of the versions measured, what each commit adds to each key, and sums of that over blocks of commits. Sums of segments add
up. If the old tip is no longer on the chain, history was rewritten, and a new generation of segments is begun.

A segment is written beside the others and counts once its marker is there; an update that was
cut short leaves nothing that is read, and is done again.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import glob_matches
from ..operators import history as H
from ..operators.measures import StatConfig
from ..operators.sampling import Granularity, sample
from ..sources import results
from ..sources.git import follows, git, history


class Sums:
    """The kept sums of one statistic of one repository, in a folder of its own below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, repo: str, stat: StatConfig):
        if not stat.measurement().whole:
            raise ValueError(f"sums of {stat.type} aren't kept: differences of its numbers would lose digits")
        told = json.dumps([os.path.realpath(repo), stat.type, stat.params, stat.path_in_repo], sort_keys=True)
        self.spark, self.repo, self.stat = spark, repo, stat
        self.folder = f"{folder.rstrip('/')}/{hashlib.sha256(told.encode()).hexdigest()[:16]}"

    def segments(self) -> list[str]:
        """The segments of the last generation, in order."""
        names = results.snapshots(self.spark, self.folder)
        last = max((n.split("-")[0] for n in names), default=None)
        return [n for n in names if n.split("-")[0] == last]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{s}/{name}" for s in self.segments()])

    def state(self) -> tuple[str, int] | None:
        """(tip, number of commits) of the last segment."""
        names = self.segments()
        row = self.spark.read.parquet(f"{self.folder}/{names[-1]}/state").first() if names else None
        return (row["head"], row["commits"]) if row else None

    def update(self) -> int:
        """Read and sum what is new; the number of commits read."""
        from .engine import measured, wanted_contents

        head, state, names = git(self.repo, "rev-parse", "HEAD").decode().strip(), self.state(), self.segments()
        if state and state[0] == head:
            return 0
        generation, number = (int(x) for x in names[-1].split("-")) if names else (0, -1)
        if state and not follows(self.repo, state[0]):
            state, generation, number = None, generation + 1, -1
        since, before = state or (None, 0)
        new = int(git(self.repo, "rev-list", "--first-parent", "--count", "HEAD", *([f"^{since}"] if since else [])))
        # From the tip 0, 1, 2, .. to the root: -(before + new - 1), .., 0
        pos = (F.col("chain_pos") - (before + new - 1)).cast("int")
        commits = history(self.spark, "commits", self.repo, since=since).withColumn("chain_pos", pos)
        changes = H.checkpointed(H.deltas(history(self.spark, "raw_changes", self.repo, since=since)).withColumn("chain_pos", pos))
        once = changes.filter("sign = 1").select("path", "oid").distinct()
        if self.stat.path_in_repo:
            once = once.filter(glob_matches(F.col("path"), self.stat.path_in_repo))
        if state:
            once = once.join(self.table("versions"), ["path", "oid"], "left_anti")
        once = H.checkpointed(once)
        values = H.checkpointed(measured(once, wanted_contents(self.spark, self.repo), self.stat.measurement()).select("path", "oid", "key", F.col("value").cast("long").alias("value")))
        known = values.unionByName(self.table("values")) if state else values
        steps = changes.join(known, ["path", "oid"]).groupBy("chain_pos", "key").agg(F.sum(F.col("sign") * F.col("value")).cast("long").alias("value"), F.sum("sign").cast("long").alias("n"))
        steps = H.checkpointed(steps)
        tables = {"commits": commits, "versions": once, "values": values, "steps": steps, "blocks": H.block_sums(steps), "state": self.spark.createDataFrame([(head, before + new)], "head string, commits long")}
        results.write_snapshot(tables, self.folder, f"{generation:06d}-{number + 1:06d}")
        return new

    def series(self, granularity: Granularity | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """As ``engine.series``, of the kept sums."""
        from .engine import shown

        sampled = sample(self.table("commits"), granularity or Granularity.parse(self.stat.granularity), start, end)
        return shown(sampled, H.running_totals(sampled, self.table("steps"), blocks=self.table("blocks")), self.stat.measurement())

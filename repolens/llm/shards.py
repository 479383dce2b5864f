"""Shards with size-tiered compaction and versioned manifests (operator 6).

A store is a folder. Each arrival is appended as small immutable Parquet shards; several that
are known together are staged by one pass over their rows and adopted one after another.
Compaction looks at sizes alone: shards of a tier (sizes within a factor of ``fan_in``)
are merged once there are ``fan_in`` of them, into files of about the target size; larger
shards are left alone. Merging reads and writes without a shuffle. A reader sees what the
latest manifest lists and nothing else. A manifest is written beside its place and renamed
into it, which fails if that version exists: of two writers one wins, the other raises
and may try again. Replaced shards stay, for readers of older versions, until ``vacuum``.

Rows are stored as they come: nulls, repeated rows, extra columns. An empty arrival
commits a version without new shards; an empty store reads as no rows of the given schema.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import filesystem

MB = 1 << 20


class Conflict(RuntimeError):
    """Another writer has committed the version."""


@dataclass(frozen=True)
class Shard:
    file: str  # below the store's folder
    bytes: int
    arrival: int  # the version that first had its rows, or for merged ones the latest of these


@dataclass(frozen=True)
class Policy:
    """``least``: the size of the lowest tier; ``target``: of merged files; ``fan_in``: shards of a tier that make a merge."""

    least: int = 4 * MB
    target: int = 128 * MB
    fan_in: int = 4

    def tier(self, size: int) -> int:
        """0 up to ``least``, then one more for each factor of ``fan_in``; -1 if a shard needs no merging."""
        if size * 2 >= self.target:
            return -1
        tier = 0
        while size > self.least * self.fan_in**tier:
            tier += 1
        return tier


class Store:
    def __init__(self, spark: SparkSession, path: str, policy: Policy = Policy()):
        self.spark, self.path, self.policy = spark, path.rstrip("/"), policy
        self.fs, _ = filesystem(spark, self.path)
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _at(self, *parts: str):
        return self.hadoop.Path("/".join([self.path, *parts]))

    # manifests

    def versions(self) -> list[int]:
        folder = self._at("manifests")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n.split("-")[1].split(".")[0]) for n in names if n.startswith("manifest-"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """(version, shards) of a version, the latest by default; (0, []) before the first."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return 0, []
        stream = self.fs.open(self._at("manifests", f"manifest-{version:010d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, [Shard(**s) for s in json.loads(text)["shards"]]

    def _commit(self, version: int, shards: list[Shard]) -> int:
        beside = self._at("manifests", f".{uuid.uuid4().hex}")
        out = self.fs.create(beside, True)
        out.write(json.dumps({"version": version, "shards": [asdict(s) for s in shards]}).encode())
        out.close()
        place = self._at("manifests", f"manifest-{version:010d}.json")
        context = self.hadoop.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        try:
            context.rename(beside, place, none)
        except Exception as e:
            self.fs.delete(beside, False)
            if self.fs.exists(place):
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    # data

    def _write(self, df: DataFrame, version: int) -> list[Shard]:
        folder = f"data/{version:010d}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return self._listed(folder, version)

    def _listed(self, folder: str, version: int) -> list[Shard]:
        files = [s for s in self.fs.listStatus(self._at(folder)) if s.getPath().getName().startswith("part-")]
        return [Shard(f"{folder}/{s.getPath().getName()}", s.getLen(), version) for s in files]

    def append(self, df: DataFrame) -> int:
        """Append rows as new shards and commit; returns the version."""
        version, shards = self.manifest()
        return self._commit(version + 1, shards + self._write(df, version + 1))

    def stage(self, df: DataFrame, arrival: Column) -> list[str]:
        """Write rows of several arrivals in one pass, a folder for each; returns these in order, for ``adopt``.

        ``arrival`` is a whole number; rows of null are the last arrival. An arrival without rows has no folder.
        """
        name = "__arrival"
        while name.lower() in (c.lower() for c in df.columns):
            name += "_"
        folder = f"staged/{uuid.uuid4().hex}"
        df.withColumn(name, arrival.cast("long")).write.option("compression", "zstd").partitionBy(name).parquet(f"{self.path}/{folder}")
        below = [s.getPath().getName() for s in self.fs.listStatus(self._at(folder)) if s.isDirectory()]
        told = {b: b.split("=", 1)[1] for b in below if b.startswith(f"{name}=")}
        number = {b: int(v) if v.lstrip("-").isdigit() else None for b, v in told.items()}
        return [f"{folder}/{b}" for b in sorted(number, key=lambda b: (number[b] is None, number[b] or 0))]

    def adopt(self, staged: str) -> int:
        """Move a staged arrival to its place as new shards, and commit; returns the version.

        Its folder is renamed, and nothing is read or copied by Spark. If another writer commits first, the shards lie in
        their place unlisted and are put back, so that the arrival can be adopted again.
        """
        version, shards = self.manifest()
        folder = f"data/{version + 1:010d}-{uuid.uuid4().hex}"
        self._move(staged, folder)
        try:
            return self._commit(version + 1, shards + self._listed(folder, version + 1))
        except Conflict:
            self._move(folder, staged)
            raise

    def _move(self, old: str, new: str) -> None:
        self.fs.mkdirs(self._at(new).getParent())
        if not self.fs.rename(self._at(old), self._at(new)):
            raise OSError(f"{old} can't be moved to {new}")

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """The runs of shards to merge: per tier, in order of arrival."""
        tiers: dict[int, list[Shard]] = {}
        for s in sorted(shards, key=lambda s: (s.arrival, s.file)):
            tiers.setdefault(self.policy.tier(s.bytes), []).append(s)
        return [run for tier, run in sorted(tiers.items()) if tier >= 0 and len(run) >= self.policy.fan_in]

    def compact(self, schema: StructType) -> int:
        """Merge each tier that has enough shards, until none has, and commit; returns the version."""
        version, shards = self.manifest()
        start = list(shards)
        while runs := self.plan(shards):
            before = len(shards)
            for run in runs:
                size = sum(s.bytes for s in run)
                merged = self._write(self._read(run, schema).coalesce(max(1, -(-size // self.policy.target))), version + 1)
                merged = [Shard(s.file, s.bytes, max(x.arrival for x in run)) for s in merged]
                gone = {s.file for s in run}
                shards = [s for s in shards if s.file not in gone] + merged
            if len(shards) >= before:
                break
        return version if shards == start else self._commit(version + 1, shards)

    def _read(self, shards: list[Shard], schema: StructType) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{s.file}" for s in shards])

    def read(self, schema: StructType, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version)[1], schema)

    def read_with_shard(self, schema: StructType, version: int | None = None, name: str = "shard") -> DataFrame:
        """As ``read``, with the column ``name``: the file that holds the row. A stored column of that name is an error."""
        if name.lower() in (f.lower() for f in schema.names):
            raise ValueError(f"the rows have a column {name}: give another name")
        shards = self.manifest(version)[1]
        if not shards:
            return self._read(shards, schema).withColumn(name, F.lit(""))
        return self._read(shards, schema).withColumn(name, F.concat_ws("/", F.element_at(F.split("_metadata.file_path", "/"), -2), F.col("_metadata.file_name")))

    def vacuum(self) -> int:
        """Delete the shards that the latest manifest doesn't list; returns how many.

        A folder is named by the version that its writer means to commit. Folders of versions
        after the latest are spared: their writers may still commit. Those of the latest or earlier
        ones can't, as their version exists.
        """
        version, listed = self.manifest()
        live = {s.file for s in listed}
        gone = 0
        if not self.fs.exists(self._at("data")):
            return 0
        for folder in self.fs.listStatus(self._at("data")):
            name, left = folder.getPath().getName(), 0
            if int(name.split("-")[0]) > version:
                continue
            for s in self.fs.listStatus(folder.getPath()):
                if f"data/{name}/{s.getPath().getName()}" in live:
                    left += 1
                else:
                    gone += s.getPath().getName().startswith("part-")
                    self.fs.delete(s.getPath(), False)
            if not left:
                self.fs.delete(folder.getPath(), True)
        return gone

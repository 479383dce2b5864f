"""Running totals of a statistic over a stream of commits.

Each change of the stream brings a version of a file, takes one away, or both. Versions are read and measured where their
change was read, sums are made there of each Arrow batch, and only these sums meet the kept total of their
repository and key, in the stream's state. What a key's task gets is thus a sum of each Arrow batch in which it
occurs, not each change. A version is measured when it comes and again when it goes.

Totals are whole numbers; a measurement of others is refused, as differences would lose digits. A file that can't be measured
has no value, neither when it comes nor when it goes. Keys whose last file has gone are shown once with a total of 0. Only plain files
count. A batch is run again in full if an executor or the driver is lost; its offsets name its commits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.patterns import glob_matches
from ..operators.history import deltas
from ..operators.measures import Measurement
from ..sources.git import BATCH, _Reader

TOTAL = "repo string, key string, total long, n_files long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row (repo, path, oid, side) with its content in place of the id; rows without any are left out."""
    readers: dict[str, _Reader] = {}

    def out(rows: list[tuple]) -> pa.RecordBatch:
        side, path, content = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(path), pa.array(side), pa.array(content, pa.binary())], ["path", "oid", "content"])

    try:
        for b in batches:
            rows, size = [], 0
            for repo, path, oid, side in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if repo not in readers:
                    for r in readers.values():
                        r.close()
                    readers = {repo: _Reader(repo)}
                content = readers[repo].read(oid)
                if content is None:
                    continue
                rows.append((side, path, content))
                size += len(content) + 100
                if size >= BATCH:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)
    finally:
        for r in readers.values():
            r.close()


def _presum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = pa.Table.from_batches([b]).group_by(["repo", "key"]).aggregate([("value", "sum"), ("n", "sum")])
        yield from t.rename_columns(["repo", "key", "value", "n"]).to_batches()


class _Totals(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("total", "total long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, n = self.kept.get() if self.kept.exists() else (0, 0)
        for part in rows:
            total, n = total + int(part["value"].sum()), n + int(part["n"].sum())
        if n:
            self.kept.update((total, n))
        else:
            self.kept.clear()
        yield pd.DataFrame({"repo": [key[0]], "key": [key[1]], "total": [total], "n_files": [n]})

    def close(self) -> None:
        pass


def totals(raw_changes: DataFrame, measurement: Measurement, path_glob: str | None = None) -> DataFrame:
    """(repo, key, total, n_files) in update mode: after each batch, the totals at the tip of the keys that it has changed.

    The state needs a store that keeps several states of a key: ``spark.sql.streaming.stateStore.providerClass`` of RocksDB.
    """
    if not measurement.whole:
        raise ValueError("only whole numbers have running totals")
    files = deltas(raw_changes)
    if path_glob:
        files = files.filter(glob_matches(F.col("path"), path_glob))
    # A measurement hands on the id as it is, so that the repository and the side take its place.
    side = F.concat(F.when(F.col("sign") > 0, "+").otherwise("-"), "repo")
    if measurement.contents:
        files = files.select("repo", "path", "oid", side.alias("side")).mapInArrow(_read, "path string, oid string, content binary")
    else:
        files = files.select("path", side.alias("oid"))
    sign = F.when(F.col("oid").startswith("+"), 1).otherwise(-1)
    steps = measurement.measure(files).select(F.expr("substring(oid, 2)").alias("repo"), "key", (sign * F.col("value").cast("long")).alias("value"), sign.cast("long").alias("n"))
    steps = steps.mapInArrow(_presum, steps.schema)
    return steps.groupBy("repo", "key").transformWithStateInPandas(_Totals(), TOTAL, "Update", "None")


def publish(totals: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write each batch's totals as Parquet into a folder of its number; a batch that is run again replaces its own."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """(repo, key, total, n_files) as of the last batch; keys that have gone have no row."""
    rows = spark.read.schema(f"{TOTAL}, batch long").parquet(path)
    last = rows.groupBy("repo", "key").agg(F.max_by(F.struct("total", "n_files"), "batch").alias("t"))
    return last.select("repo", "key", "t.*").filter("n_files > 0")

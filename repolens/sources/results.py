"""Published series: one CSV file with a header, and Parquet snapshots."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reshape import unpivot


def write_csv(table: DataFrame, path: str) -> str:
    """One CSV file with a header at ``path``, in the table's order; what is there is replaced.

    A published series has a row for each sampled commit, so it is one file. It is written beside its place by
    Spark's file system and renamed, so on a cluster the path must be one that all executors share.
    """
    spark = table.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path if ":" in path.split("/")[0] else os.path.abspath(path))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    try:
        table.coalesce(1).write.option("header", True).csv(beside.toString())
        parts = [s.getPath() for s in fs.listStatus(beside) if s.getPath().getName().startswith("part-")]
        if not parts:
            if not table.isEmpty():
                raise OSError(f"{path}: the executors' files are not here: name a folder that all share")
            out = fs.create(target, True)
            out.write((",".join(table.columns) + "\n").encode())
            out.close()
        else:
            # One step of the file system: whoever reads sees the old file or the new one.
            jvm = spark._jvm.org.apache.hadoop.fs
            replace = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
            replace[0] = jvm.Options.Rename.valueOf("OVERWRITE")
            jvm.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(parts[0], target, replace)
    finally:
        fs.delete(beside, True)
    return path


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A published series in its long form: commit, date, key, value."""
    return unpivot(spark.read.option("header", True).csv(path), ("commit", "date"))


def write_snapshot(tables: dict[str, DataFrame], folder: str, head: str) -> str:
    """Tables of a repository as of a tip, in a folder of its own; a marker written last makes it valid."""
    spark = next(iter(tables.values())).sparkSession
    path = f"{folder.rstrip('/')}/{head}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(head,)], "head string").withColumn("made", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{path}/_complete")
    return path


def read_snapshot(spark: SparkSession, folder: str, head: str, name: str) -> DataFrame | None:
    """A table of a valid snapshot, or None."""
    path = f"{folder.rstrip('/')}/{head}"
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_complete/_SUCCESS")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(f"{path}/{name}") if fs.exists(marker) else None


def snapshots(spark: SparkSession, folder: str) -> list[str]:
    """The names of the valid snapshots of a folder, in order."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(top))
    return [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_complete/_SUCCESS"))]


def drop_other_snapshots(spark: SparkSession, folder: str, head: str) -> None:
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(top):
        for s in fs.listStatus(top):
            if s.getPath().getName() != head:
                fs.delete(s.getPath(), True)

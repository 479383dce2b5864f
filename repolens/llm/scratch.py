"""Intermediate tables in the folder that the whole cluster shares.

``materialize`` cuts lineage by writing Parquet below ``spark.checkpoint.dir`` and
reading it back, so a lost executor only costs the tasks it was running. The folder
is read from the session; where it is unset (tests, a laptop) and the master is local,
a temporary folder is set once for the session.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Shuffle files of a finished query are of no use once its result is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only on a local master."""
    path = spark.conf.get(SETTING, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="repolens-")
        spark.conf.set(SETTING, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/repolens/{name}-{uuid.uuid4().hex}"


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and the path as Hadoop's object."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def drop(spark: SparkSession, path: str) -> None:
    fs, hadoop = filesystem(spark, path)
    fs.delete(hadoop, True)


class Scratch:
    """Tables of one run: written once, read often, and dropped by name when done with."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            drop(self.spark, self.paths.pop(id(t)))

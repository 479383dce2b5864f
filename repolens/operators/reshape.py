"""From a long series (commit, date, key, value) to the wide table that is published."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed

MISSING = "0"


#: The most columns of a published table.
COLUMNS = 10_000


def wide(commits: DataFrame, series: DataFrame, ids: tuple[str, ...] = ("commit",), most: int = COLUMNS) -> DataFrame:
    """One row for each of ``commits``, a column for each key in byte order, missing cells ``0``.

    ``commits`` has ``ids`` and what else is to be shown; ``series`` has ``ids``, ``key`` and ``value`` (text).
    The keys are the columns and are read on the driver: ``most`` of them; if there are more it is an error, and the long series is to be used.
    """
    keys = sorted((r["key"] for r in series.select("key").distinct().limit(most + 1).collect()), key=lambda k: k.encode())
    if len(keys) > most:
        raise ValueError(f"more than {most} keys don't make a table: use the long series")
    if not keys:
        return commits
    cells = series.groupBy(*ids).pivot("key", keys).agg(F.first("value"))
    out = commits.join(cells, [*ids], "left")
    return out.select(*commits.columns, *[F.coalesce(F.col(f"`{k}`"), F.lit(MISSING)).alias(k) for k in keys])


def top_n(rows: DataFrame, n: int, by: tuple[str, ...], value: str, tie: str) -> DataFrame:
    """The n rows of each group with the largest value; ties in the order of ``tie``."""
    order = Window.partitionBy(*by).orderBy(F.col(value).desc(), tie)
    return rows.withColumn("__place", F.row_number().over(order)).filter(F.col("__place") <= n).drop("__place")


def unpivot(table: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """The long form of a wide table: ``ids``, ``key``, ``value``."""
    return table.unpivot([*ids], None, "key", "value")


def dictionary(names: DataFrame, column: str) -> DataFrame:
    """(column, idx): the distinct values, numbered from 0 in their order.

    They are sorted in ranges and numbered within each; a range begins where the sizes of those before it end, a number for each task.
    """
    once = names.select(column).distinct().orderBy(column).select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), column)
    placed = checkpointed(once)
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(sizes.select("part", "least", before.alias("before")), "part").select(column, (F.col("at") - F.col("least") + F.col("before")).alias("idx"))

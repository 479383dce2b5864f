"""Sampling of a stream of commits: the latest commit of each period, once the period is over.

``commits`` has ``seq`` (growing along the chain, from the root) and ``ts``. Commits may
come late by up to ``late``; a later one is dropped, as its period has been published.
Periods are UTC days, hours or weeks from Sunday; months have no fixed length and are
sampled from the published days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Length, and the start of the first period after 1970-01-01, a Thursday.
PERIODS = {"hourly": ("1 hour", "0 seconds"), "daily": ("1 day", "0 seconds"), "weekly": ("7 days", "3 days")}


def latest_per_period(commits: DataFrame, granularity: str, late: str = "1 day") -> DataFrame:
    """(period_start, and the columns of the period's commit of the largest ``seq``), in append mode."""
    length, start = PERIODS[granularity]
    window = F.window("ts", length, startTime=start)
    best = commits.withWatermark("ts", late).groupBy(window).agg(F.max_by(F.struct(*commits.columns), "seq").alias("c"))
    return best.select(F.col("window.start").alias("period_start"), "c.*")


def publish(sampled: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the sampled commits as Parquet, each exactly once; with ``once`` what is there now, then stop."""
    writer = sampled.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

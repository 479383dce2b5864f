"""Range and granularity of a commit chain. All arithmetic is in UTC, the session's zone.

``commits`` has ``chain_pos`` (0 at the tip, growing towards the root) and ``ts``. Dates
need not be monotonic along a chain, so order is always that of ``chain_pos``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = ("infinite", "daily", "hourly", "weekly", "monthly")


@dataclass(frozen=True)
class Granularity:
    """One of UNITS, or every ``hours`` hours within a day."""

    unit: str
    hours: int = 0

    @classmethod
    def parse(cls, value: str | dict | None) -> Granularity:
        """From a name in any case (``all`` is infinite), ``{"EveryXHours": n}`` or ``every-n-hours``; None is daily."""
        if value is None:
            return cls("daily")
        if isinstance(value, dict):
            if [*value] != ["EveryXHours"]:
                raise ValueError(f"unknown granularity: {value}")
            return cls.every(int(value["EveryXHours"]))
        name = value.lower()
        if m := re.fullmatch(r"every-(\d+)-hours", name):
            return cls.every(int(m[1]))
        name = "infinite" if name == "all" else name
        if name not in UNITS:
            raise ValueError(f"unknown granularity: {value}")
        return cls(name)

    @classmethod
    def every(cls, hours: int) -> Granularity:
        if hours < 1:
            raise ValueError("at least one hour")
        return cls("hours", hours)


def bucket(ts: Column, granularity: Granularity) -> Column | None:
    """The period of a timestamp, as sortable text; None if every commit is its own. Weeks start on Sunday."""
    day = F.date_format(ts, "yyyy-MM-dd")
    match granularity.unit:
        case "infinite":
            return None
        case "daily":
            return day
        case "hourly":
            return F.date_format(ts, "yyyy-MM-dd HH")
        case "hours":
            hour = F.floor(F.hour(ts) / granularity.hours) * granularity.hours
            return F.concat(day, F.lit(" "), F.lpad(hour.cast("string"), 2, "0"))
        case "weekly":
            d = ts.cast("date")
            return F.date_format(F.date_sub(d, F.dayofweek(d) - 1), "yyyy-MM-dd")
        case "monthly":
            return F.date_format(ts, "yyyy-MM")
    raise ValueError(granularity)


def in_range(commits: DataFrame, start: datetime | None = None, end: datetime | None = None, strict: bool = False, chain: tuple[str, ...] = ()) -> DataFrame:
    """Commits from the tip until the first that is older than ``start``, of these the ones up to ``end``.

    Deeper commits are not seen even if they are newer again; ``strict`` is a plain filter
    instead. ``chain`` names the columns that tell chains apart (a repository's name).
    """
    out = commits
    if start is not None:
        old = F.col("ts") < F.lit(start)
        if strict:
            out = out.filter(~old)
        else:
            # The walk ends at the least chain_pos of an older commit: an aggregate, so no chain is sorted in one task.
            stop = commits.filter(old).groupBy(*chain).agg(F.min("chain_pos").alias("__stop"))
            if chain:
                out = out.join(stop, [*chain], "left").filter("__stop is null or chain_pos < __stop").drop("__stop")
            else:
                out = out.crossJoin(F.broadcast(stop)).filter("__stop is null or chain_pos < __stop").drop("__stop")
    return out if end is None else out.filter(F.col("ts") <= F.lit(end))


def first_per_bucket(commits: DataFrame, granularity: Granularity, chain: tuple[str, ...] = ()) -> DataFrame:
    """The commit of each period that is nearest to the tip, with ``bucket``; periods without commits have no row."""
    key = bucket(F.col("ts"), granularity)
    if key is None:
        return commits.withColumn("bucket", F.lit(None).cast("string"))
    columns = [c for c in commits.columns if c not in chain]
    best = commits.withColumn("bucket", key).groupBy(*chain, "bucket").agg(F.min_by(F.struct(*columns), "chain_pos").alias("c"))
    return best.select(*chain, "c.*", "bucket").select(*commits.columns, "bucket")


def sample(commits: DataFrame, granularity: Granularity, start: datetime | None = None, end: datetime | None = None, strict: bool = False, chain: tuple[str, ...] = ()) -> DataFrame:
    return first_per_bucket(in_range(commits, start, end, strict, chain), granularity, chain)


def in_order(sampled: DataFrame) -> DataFrame:
    """By period, or if unsampled in the order of the chain, newest first."""
    return sampled.orderBy(F.col("bucket").asc_nulls_first(), "chain_pos")

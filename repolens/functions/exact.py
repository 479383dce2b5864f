"""Sums of doubles that don't depend on the order of their terms.

A double is cut into whole numbers of 32 bits, each at a multiple of 2**32 (a limb); limbs of one place
add up as longs without rounding, in any order and in parts, for up to two thousand million terms. What they
come to is rounded once, to the nearest double. What lies below 2**-1056 is dropped.
"""

from __future__ import annotations

from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jq import let

BITS, LOWEST = 32, -31


def limbs(value: Column) -> Column:
    """An array of (place int, limb long) of a finite double; none for zero, null for null. An infinity or NaN has place null."""
    top = F.greatest(F.floor(F.log2(F.abs(value)) / BITS).cast("int"), F.lit(LOWEST))
    power = lambda place: F.pow(F.lit(2.0), place * BITS)
    # Each step is worked out once and bound, as the next one names it several times.
    cut = lambda rest, place: let(rest / power(place), lambda q: F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q)).cast("long"))
    limb = lambda place, n: F.struct(place.alias("place"), n.alias("limb"))

    def below(rest: Column, place: Column, left: int) -> Column:
        own = lambda n: F.array(limb(place, n)) if left == 1 else F.concat(F.array(limb(place, n)), let(rest - n * power(place), lambda r: below(r, place - 1, left - 1)))
        return let(cut(rest, place), own)

    each = let(top, lambda t: below(value, t, 3))
    odd = F.isnan(value) | (F.abs(value) == float("inf"))
    kind = F.when(F.isnan(value), 0).when(value > 0, 1).otherwise(-1).cast("long")
    none = F.array().cast("array<struct<place:int,limb:bigint>>")
    return F.when(odd, F.array(F.struct(F.lit(None).cast("int").alias("place"), kind.alias("limb")))).when(value != 0, F.filter(each, lambda x: x["limb"] != 0)).when(value == 0, none)


def _rounded(limbs_: list[dict]) -> float:
    odd = {x["limb"] for x in limbs_ if x["place"] is None}
    if odd:
        return float("inf") if odd == {1} else float("-inf") if odd == {-1} else float("nan")
    total = sum((Fraction(x["limb"]) * Fraction(2) ** (BITS * x["place"]) for x in limbs_), Fraction(0))
    try:
        return float(total)
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


def add_limbs(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` (by, place, limb) with the limbs of each place added up. Signs of infinities and NaN are kept apart."""
    odd = F.when(F.col("place").isNull(), F.col("limb"))
    summed = rows.groupBy(*by, "place", odd.alias("odd")).agg(F.sum("limb").alias("limb"))
    return summed.select(*by, "place", F.coalesce("odd", "limb").alias("limb"))


def rounded(rows: DataFrame, *by: str, name: str = "total") -> DataFrame:
    """(by, name): the double that the limbs of each group come to."""

    @F.arrow_udf("double")
    def to_double(column: pa.Array) -> pa.Array:
        return pa.array([_rounded(x) for x in column.to_pylist()], pa.float64())

    # A group has a few limbs: at most 66 places.
    whole = add_limbs(rows, *by).groupBy(*by).agg(F.collect_list(F.struct("place", "limb")).alias("limbs"))
    return whole.select(*by, to_double("limbs").alias(name))

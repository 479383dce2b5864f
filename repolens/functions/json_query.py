"""JSON queries over file contents: a document, the filter's outputs, and the number or counts that they are."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .jq import Unsupported, let, lower

__all__ = ["Unsupported", "document", "number", "object_counts"]
#: Of equal keys of an object the last one counts.
LAST_KEY = "spark.sql.variant.allowDuplicateKeys"


def document(content: Column) -> Column:
    """The JSON document of a file as a variant; null if it is none.

    A second document or any text after the first one is refused, and so is a number beyond the
    doubles. Equal keys are allowed; the session's setting for them is switched on.
    """
    session = SparkSession.active()
    if session.conf.get(LAST_KEY, None) != "true":
        session.conf.set(LAST_KEY, "true")
    return let(F.make_valid_utf8(content.cast("string")), _document)


def _document(text: Column) -> Column:
    # Spark's parser stops after the first document. What closes both an array and an object around it is one whole document.
    held = ~F.contains(text, F.lit("]")) | F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()
    outside = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', '""')
    numbers = F.regexp_extract_all(outside, F.lit(r"\d+\.?\d*(?:[eE][+-]?\d+)?"), F.lit(0))
    infinite = F.when(text.rlike(r"[eE]\+?\d{3}|\d{300}"), F.exists(numbers, lambda n: n.try_cast("double") == float("inf"))).otherwise(F.lit(False))
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return let(listed, lambda one: F.when((F.size(one) == 1) & held & ~infinite, F.get(one, F.lit(0))))


def number(content: Column, query: str) -> Column:
    """The query's only output as a number, 0 if there is no such one. Null if the content isn't JSON; 0 if it is empty."""
    run = lower(query)

    def shown(outputs: Column) -> Column:
        only = F.get(outputs, F.lit(0))
        value = F.when((F.size(outputs) == 1) & F.schema_of_variant(only).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(only, "$", "double"))
        return F.when(F.abs(value) < float("inf"), value).otherwise(F.lit(0.0))

    value = let(document(content), lambda whole: F.when(whole.isNotNull(), let(run(whole), shown)))
    return F.when(F.length(content) == 0, F.lit(0.0)).otherwise(value)


def object_counts(content: Column, query: str) -> Column:
    """The query's only output, an object, as a map of its non-negative whole numbers; other entries, and numbers that no long holds, are left out. Null if there is no object."""
    run = lower(query)
    entries = let(let(document(content), run), lambda outputs: F.when(F.size(outputs) == 1, F.try_variant_get(F.get(outputs, F.lit(0)), "$", "map<string,variant>")))
    # A string of digits is no number.
    numbers = F.map_filter(entries, lambda k, v: F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
    exact = F.transform_values(numbers, lambda k, v: F.coalesce(F.when(F.schema_of_variant(v).rlike("^(DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double").try_cast("decimal(38,10)")).otherwise(F.try_variant_get(v, "$", "decimal(38,10)"))))
    fit = F.map_filter(exact, lambda k, v: v.isNotNull() & (v >= 0) & (v == F.floor(v)) & (v <= F.lit("9223372036854775807").cast("decimal(38,10)")))
    return F.transform_values(fit, lambda k, v: v.cast("long"))

"""Dates and numbers as text, both ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of a loosely written date, in the order in which they are tried.
DATE_FORMS = ("yyyy-MM-dd HH:mm:ss Z", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


#: What a number may be written as: neither a type's suffix nor an underscore.
NUMBER = r"(?i)[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?|[+-]?inf(inity)?|nan"


def loose_datetime(text: Column) -> Column:
    """A timestamp (the session's zone must be UTC) of a date and time, a date, or a time of today; null if it is none of these."""
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMS]
    today = F.when(text.rlike(r"\A\d{2}:\d{2}:\d{2}\z"), F.try_to_timestamp(F.concat(F.current_date().cast("string"), F.lit(" "), text), F.lit(DATE_FORMS[1])))
    return F.coalesce(*tries, today)


def first_number(text: Column) -> Column:
    """The first word of a text as a number; null if there is none or it is no number."""
    word = F.get(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), F.lit(0))
    return F.when(word.rlike(rf"\A(?:{NUMBER})\z"), word.try_cast("double"))


def number_text(x: Column) -> Column:
    """A number as text: whole ones without a point, others in full and without an exponent; zero has no sign."""
    d = x.cast("double")
    short = d.cast("string")
    # The shortest digits that give the number back: the runtime's own may be one too many. Then the point is moved to where the exponent says.
    fewer = [F.format_string(f"%.{n}e", d) for n in (14, 15)]
    best = F.coalesce(*[F.when(f.try_cast("double") == d, F.upper(f)) for f in fewer], F.when(short.contains("E"), short).otherwise(F.upper(F.format_string("%.16e", d))))
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(best, r"([\d.]+)E", 1), r"\.", ""), r"(?<=\d)0+$", "")
    exponent = F.regexp_extract(best, r"E([+-]?\d+)", 1).try_cast("int")
    whole = F.concat(F.substring(digits, F.lit(1), exponent + 1), F.when(F.length(digits) > exponent + 1, F.concat(F.lit("."), F.substring(digits, exponent + 2, F.length(digits)))).otherwise(F.repeat(F.lit("0"), exponent + 1 - F.length(digits))))
    plain = F.concat(F.when(d < 0, "-").otherwise(""), F.when(exponent < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)).otherwise(whole))
    return (
        F.when(F.isnan(d), F.lit("NaN"))
        .when(d == 0, F.lit("0"))
        .when(F.abs(d) == float("inf"), F.when(d > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when((F.abs(d) < 2.0**53) & (d == F.floor(d)), F.floor(d).cast("long").cast("string"))
        .when(~short.contains("E") & (F.length(F.regexp_replace(short, r"\D", "")) < 16), short)
        .otherwise(plain)
    )


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'")

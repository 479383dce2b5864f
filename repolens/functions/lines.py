"""Lines of a text column. A line feed ends a line; a final one adds no line; a carriage return stays in its line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import line_regex


def lines(text: Column) -> Column:
    """The lines of a text: none of an empty one, null of a null."""
    body = F.when(F.endswith(text, F.lit("\n")), F.left(text, F.char_length(text) - 1)).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def matching_lines(text: Column, pattern: str) -> Column:
    """How many lines the pattern is found in: a line counts once."""
    rx = line_regex(pattern)
    return F.size(F.filter(lines(text), lambda x: x.rlike(rx))).cast("long")


def content_matching_lines(content: Column, pattern: str) -> Column:
    """As ``matching_lines``, over bytes: null if a matching line is not UTF-8. Only contents that aren't UTF-8 throughout are looked at byte by byte."""
    rx = line_regex(pattern)
    whole = content.cast("string")
    text = F.decode(content, "ISO-8859-1")  # a byte is a character, so that a bad line harms no other
    each = F.transform(lines(text), lambda x: F.encode(x, "ISO-8859-1"))
    found = F.filter(each, lambda b: F.make_valid_utf8(b.cast("string")).rlike(rx))
    slow = F.when(~F.exists(found, lambda b: ~F.is_valid_utf8(b.cast("string"))), F.size(found).cast("long"))
    return F.when(F.is_valid_utf8(whole), matching_lines(whole, pattern)).otherwise(slow)


def first_matches(text: Column, pattern: str) -> Column:
    """(line number from 1, first match) of each matching line, as an array of structs."""
    rx = line_regex(pattern)
    numbered = F.transform(lines(text), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    return F.transform(F.filter(numbered, lambda s: s["text"].rlike(rx)), lambda s: F.struct(s["line"].alias("line"), F.regexp_extract(s["text"], f"({rx})", 1).alias("match")))

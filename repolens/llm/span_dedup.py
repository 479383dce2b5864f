"""Substring deduplication by sliding sentence spans (operator 8).

A sentence ends at a word that ends in ``.``, ``!`` or ``?``, at a line feed, or after
``SENTENCE_WORDS`` words. From every sentence a span runs over the next ones until it has
``SENTENCES`` sentences and ``SPAN_WORDS`` words; its words, with A-Z in lower case, are
hashed. Spans are joined on their hash over all documents. The first place of a hash, by
(doc_id, sentence), stays; all sentences that any other place covers are removed.

Only counts and first places are grouped by hash, with partial sums in each task, and
written; the places themselves meet them in a join, which Spark splits where a hash is hot.
Texts are read twice: once for all spans and windows, which are written, once for the runs.

A passage within a long sentence, or with few stops, is cut at other places in each
document. So runs of ``RUN`` words are compared as well where no span is sure to lie in
them, whatever stands around. Of each such run the ``WINDOW`` words of the least hash are
its window, which many runs share. Only runs with the windows that have an earlier place and no part in
a span that goes are joined by their own hash, and those that a filter of fixed size lets pass
beside them. The first place of a run stays; the words of others go if no span that goes
has a part of them. So of any repeat of ``RUN`` words with equal line feeds a part goes; beside
sentences that go, a part of another sentence may stay.

Rows: a null or empty text has no spans; nor has one that is too short for a span. Rows of
equal doc_id count as one document, whose equal sentence numbers are one place. Rows
without doc_id stay as they are. Long texts are taken whole. Extra columns are kept by
``clean``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from .scratch import Scratch
from .textnum import LOWER_CODE, mix, runs_hash, signed, slices, utf8, words

SENTENCES, SPAN_WORDS, SENTENCE_WORDS = 3, 20, 12
RUN, WINDOW = 50, 26
U = np.uint64
BASE = U(0xD6E8FEB86659FD93)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
STOPS = np.zeros(256, bool)
STOPS[list(b".!?")] = True


def _cut(data: np.ndarray, offsets: np.ndarray):
    """Words' hashes, first bytes and offsets of rows; of each sentence its first word, and if it follows a stop or line feed."""
    hashes, start, length, row = words(data, offsets, LOWER_CODE)
    n = len(hashes)
    if not n:
        return hashes, start, row, np.zeros(0, np.int64), np.zeros(0, bool)
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    ends = STOPS[data[start + length - 1]]
    ends[:-1] |= feeds[start[1:]] > feeds[(start + length)[:-1]]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ends[:-1]
    first[row[:-1][row[:-1] < n]] = True
    at = np.flatnonzero(first)
    place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    at = np.flatnonzero(place % SENTENCE_WORDS == 0)
    return hashes, start, row, at, first[at]


def _hash_runs(h: np.ndarray, i: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the runs of h from i to stop."""
    n = len(h)
    power, back = np.full(n + 1, BASE, U), np.full(n + 1, INVERSE, U)
    power[0] = back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    prefix = np.concatenate([np.zeros(1, U), np.cumsum(h * power[:n], dtype=U)])
    return mix((prefix[stop] - prefix[i]) * back[i] + (stop - i).astype(U))


def _stops(at: np.ndarray, n: int) -> np.ndarray:
    """The sentence after each sentence's span."""
    total = np.append(at, n)
    return np.maximum(np.arange(len(at)) + SENTENCES, np.searchsorted(total, total[:-1] + SPAN_WORDS))


def spans(data: np.ndarray, offsets: np.ndarray, parts: tuple | None = None):
    """(row, first sentence, last sentence + 1, hash, first byte, end byte) of every span; ``parts`` are what ``_cut`` gives."""
    hashes, start, word_row, at, _ = parts or _cut(data, offsets)
    n, row = len(at), np.searchsorted(at, word_row)
    h, begin = runs_hash(hashes, np.diff(np.append(at, len(hashes)))), start[at]
    i, stop = np.arange(n), _stops(at, len(hashes))
    r = np.repeat(np.arange(len(row) - 1), np.diff(row))
    keep = stop <= row[1:][r]
    i, stop, r = i[keep], stop[keep], r[keep]
    value = _hash_runs(h, i, stop)
    end = np.where(stop == row[1:][r], offsets[1:][r], np.append(begin, 0)[stop])
    return r, i - row[:-1][r], stop - row[:-1][r], value, begin[i], end


def runs(data: np.ndarray, offsets: np.ndarray, parts: tuple | None = None):
    """Runs in which no span is sure to lie, and windows; ``parts`` are what ``_cut`` gives.

    Of each run: its window's number, its hash, first and last sentence, first byte and end
    byte. Of each window: row, hash, first byte and end byte.
    """
    hashes, begin, row, at, natural = parts or _cut(data, offsets)
    n, w = len(hashes), RUN - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n < RUN:
        return (none, np.zeros(0, U), *[none] * 4), (none, np.zeros(0, U), none, none)
    i = np.arange(n - RUN + 1)
    # Where the span of the first sentence that surely starts in the run ends: the next word must be in the run, to show a line feed.
    sure = np.flatnonzero(natural)
    end = np.append(at, n)[np.minimum(_stops(at, n), len(at))]
    end = np.append(end[sure], n + RUN)[np.searchsorted(at[sure], i, side="right")]
    bare = (end >= i + RUN) & (row[np.searchsorted(row, i, side="right").clip(max=len(row) - 1)] >= i + RUN)
    j = np.arange(n - WINDOW + 1)
    value = _hash_runs(hashes, j, j + WINDOW)
    # The least of w places; of equal ones the first.
    low, reach = (value & ~U(0xFFFFFFFF)) | j.astype(U), 1
    while 2 * reach <= w:
        low, reach = np.minimum(low[:-reach], low[reach:]), 2 * reach
    low = np.minimum(low[: len(i)], low[w - reach :][: len(i)])[bare]
    i = i[bare]
    j, number = np.unique((low & U(0xFFFFFFFF)).astype(np.int64), return_inverse=True)
    ends = lambda x, r: np.where(x == row[1:][r], offsets[1:][r], np.append(begin, 0)[x])
    r, rj = (np.searchsorted(row, x, side="right") - 1 for x in (i, j))
    piece = np.searchsorted(at, row[:-1])[r]
    first, last = np.searchsorted(at, i, side="right") - 1 - piece, np.searchsorted(at, i + RUN) - 1 - piece
    return (number, _hash_runs(hashes, i, i + RUN), first, last, begin[i], ends(i + RUN, r)), (rj, value[j], begin[j], ends(j + WINDOW, rj))


PLACES = StructType([StructField("doc_id", LongType()), StructField("window", BooleanType()), StructField("hash", LongType()), *[StructField(c, IntegerType()) for c in ("first", "last", "start", "end")]])


def place_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every span and, with ``window``, every window: hash, first and last sentence (spans alone), and where it starts and ends in characters."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text")).filter("doc_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "__text"):
                data, offsets = utf8(b.column(1))
                parts = _cut(data, offsets)
                r, first, stop, value, start, end = spans(data, offsets, parts)
                _, (rw, value_w, start_w, end_w) = runs(data, offsets, parts)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                both = lambda x, y: np.concatenate([x, y])
                row, start, end = both(r, rw), both(start, start_w), both(end, end_w)
                base = chars[offsets[:-1]][row]
                window = np.arange(len(row)) >= len(r)
                ints = [pa.array(x.astype(np.int32)) for x in (both(first, 0 * rw), both(stop - 1, 0 * rw), chars[start] - base, chars[end] - base)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(window), pa.array(signed(both(value, value_w))), *ints], PLACES.names)

    return rows.mapInArrow(run, PLACES)


RUNS = StructType([StructField("doc_id", LongType()), StructField("hash", LongType()), *[StructField(c, IntegerType()) for c in ("first", "last", "start", "end")]])
FILTER_BITS = 1 << 24


def run_table(docs: DataFrame, hashes: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """RUNS of the runs whose window is in ``hashes``, and of others that a filter of fixed size lets pass."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text")).filter("doc_id is not null")
    # The place is below 2 ** 24, and bit p % 8 of byte p // 8 stands for it.
    of = hashes.select(F.pmod("hash", F.lit(FILTER_BITS)).alias("p")).select(F.floor(F.col("p") / 32768).alias("b"), (F.col("p") % 32768).alias("bit"))
    table = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for x in of.groupBy("b").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        table[x["b"]] = np.frombuffer(bytes(x["bits"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "__text"):
                data, offsets = utf8(b.column(1))
                (number, value, first, last, start, end), (r, window, _, _) = runs(data, offsets)
                p = np.mod(signed(window), FILTER_BITS)
                keep = ((shared.value[p // 8] >> (p % 8).astype(np.uint8)) & 1).astype(bool)[number]
                r, value, first, last, start, end = (x[keep] for x in (r[number], value, first, last, start, end))
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = chars[offsets[:-1]][r]
                i32 = lambda x: pa.array(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array(signed(value)), i32(first), i32(last), i32(chars[start] - base), i32(chars[end] - base)], RUNS.names)

    return rows.mapInArrow(run, RUNS)


HIT = ["doc_id", "first", "last", "start", "end", "first_doc_id"]


def _later(every: DataFrame, place: str, scratch: Scratch, once: bool = True) -> DataFrame:
    """The rows of a written table that are not the first of their hash, by (doc_id, ``place``); with ``once`` a row for each document and place, without its hash.

    First places are written before the join, which then has nothing but the join's own shuffles, so that Spark splits a hot hash.
    Nothing after the join may use its partitions either: rows are told apart without their hash.
    """
    firsts = every.groupBy("hash").agg(F.min(F.struct("doc_id", place)).alias("origin"), F.count("*").alias("n")).filter("n > 1").select("hash", F.col("origin.doc_id").alias("first_doc_id"), F.col(f"origin.{place}").alias("origin"))
    firsts = scratch.table(firsts, "firsts")
    later = every.join(firsts, "hash").filter(f"doc_id <> first_doc_id or {place} <> origin")
    later = scratch.table(later.select(*HIT).dropDuplicates(["doc_id", place]) if once else later.select(*HIT, "hash"), "later")
    scratch.drop(firsts)
    return later


def _apart(hits: DataFrame, found: DataFrame) -> DataFrame:
    """Both tables' rows with a column ``span``, without those of ``found`` of which a hit has a part."""
    every = hits.withColumn("span", F.lit(True)).unionByName(found.withColumn("span", F.lit(False)), allowMissingColumns=True)
    of_doc = Window.partitionBy("doc_id")
    # The last end of the spans that start no later, and the first start of those that start no earlier.
    before = F.max(F.when(F.col("span"), F.col("end"))).over(of_doc.orderBy("start", F.col("span").desc()).rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("span"), F.col("start"))).over(of_doc.orderBy(F.col("start").desc(), F.col("span").desc()).rowsBetween(Window.unboundedPreceding, 0))
    placed = every.withColumn("before", before).withColumn("after", after)
    return placed.filter("span or coalesce(before <= start, true) and coalesce(after >= end, true)").drop("before", "after")


def repeated_ranges(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """What is to be removed: doc_id, start, end (characters), n_sentences, first_doc_id; ranges that touch are one.

    ``n_sentences`` counts those that the range has words of; ``first_doc_id`` is the document that keeps the range's first span or run.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    places = scratch.table(place_table(docs, doc_id, text), "places")
    hits = _later(places.filter("not window"), "first", scratch)
    windows = _later(places.filter("window"), "start", scratch, once=False)
    scratch.drop(places)
    of_windows = _apart(hits.select("doc_id", "start", "end"), windows.select("doc_id", "start", "end", "hash"))
    open_ = scratch.table(of_windows.filter("not span").select("hash").distinct(), "open")
    scratch.drop(windows)
    found = scratch.table(run_table(docs, open_, doc_id, text), "runs")
    scratch.drop(open_)
    every = _apart(hits, _later(found, "start", scratch))
    scratch.drop(found)
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = every.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last") - F.min("first") + 1).alias("n_sentences"), F.min_by("first_doc_id", F.struct("start", "end", "first_doc_id")).alias("first_doc_id")).drop("island")


def cut(text: str, ranges: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, end in sorted(ranges):
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]])


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the repeated sentences; documents of which nothing is left go. Others stay as they are."""
    ranges = repeated_ranges(docs, doc_id, text).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("start", "end")).alias("__ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at, ranges_at = whole.schema.get_field_index(text), whole.num_columns - 1
            for b in slices(whole, text):
                column, ranges = b.column(at), b.column(ranges_at)
                if ranges.null_count < len(ranges):
                    new = [t if r is None or t is None else cut(t, [(x["start"], x["end"]) for x in r]) for t, r in zip(column.to_pylist(), ranges.to_pylist(), strict=True)]
                    column = pa.array(new, column.type)
                arrays = [column if i == at else b.column(i) for i in range(ranges_at)]
                keep = pa.array(_kept(column, ranges))
                yield pa.RecordBatch.from_arrays(arrays, b.schema.names[:-1]).filter(keep)

    joined = docs.join(ranges, F.col(doc_id).cast("long") == F.col("__id"), "left").drop("__id")
    return joined.mapInArrow(run, docs.schema)


def _kept(column: pa.Array, ranges: pa.Array) -> list[bool]:
    """A document goes if something was cut from it and no word is left."""
    return [not cut_ or bool(t and t.strip()) for t, cut_ in zip(column.to_pylist(), ranges.is_valid().to_pylist(), strict=True)]

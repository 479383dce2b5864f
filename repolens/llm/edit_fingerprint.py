"""Document fingerprints by a randomised edit embedding (operator 9).

A text is cut where its characters say so: after a place where a hash of the last three
characters is a multiple of ``MEAN``, and after ``LONGEST`` characters at the latest, so an
edit moves the cuts near it alone. Over each segment runs a shared random walk: at step j
it writes the character under it, and moves on if a random bit of (j, character) is 1.
Strings at a small edit distance are so written at a small Hamming distance. Bits of the
walk are sampled at fixed shares of the segment's walk, in bands; a band's samples make a
feature. The features of all segments vote on the bits of the fingerprint, so its Hamming
distance tells how much of two texts' walks is alike, and every part of a text counts.

Near documents are found by bit-sampled banding: in each of ``TABLES`` tables ``SAMPLED`` bits of a
fingerprint are its key, and fingerprints of one key are candidates, verified by their
likeness. Equal fingerprints are one node. Each node of a key is compared with the key's first;
then only nodes outside of the first one's component are compared with nodes of other
components in their key, whatever the size of the group, and what leaves the join is verified.
So all pairs that share a key and are near have one component. Of pairs at the least
likeness, 0.95 (25 of 256 bits differ at most), 0.948 share a key: 0.0596 in one table, 48 tables; of nearer ones more.

Rows: a null or empty text has the fingerprint of no features (all zeros); its likeness is 1 to
another empty text. Equal texts have equal fingerprints. Repeated rows and ties: documents of equal doc_id
follow each other in the order of their text. Rows without doc_id come after all others. Extra columns are
ignored; an empty table gives an empty result; long texts are walked whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .components import components
from .scratch import Scratch
from .textnum import mix, slices

MEAN, LONGEST = 48, 128
BITS, BANDS, PER_BAND = 256, 4, 3
LANES = 1 << 13
U = np.uint64
_rng = np.random.default_rng(99)
#: Places of the samples, as shares of a segment's walk of two steps a character; in bands.
SAMPLES = np.sort(_rng.random((BANDS, PER_BAND)), axis=1)
_STEP = _rng.integers(0, 1 << 32, 2 * LONGEST + 2, dtype=np.uint32)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and the offsets of texts in them."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, "<u4").astype(np.uint32), offsets


def segments(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first character of each segment and the end, first segment of each text). A segment is in one text."""
    n = len(points)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    h = points * np.uint32(0x9E3779B1)
    h[1:] += points[:-1] * np.uint32(0x85EBCA77)
    h[2:] += points[:-2] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    first = np.zeros(n + 1, bool)
    first[1:] = h % np.uint32(MEAN) == 0
    # a hash that reaches over a text's start is not the text's own
    for k in (1, 2):
        at = offsets[:-1] + k
        first[at[at < n]] = False
    first[offsets] = True
    at = np.flatnonzero(first[:n])
    size = np.diff(np.append(at, n))
    pieces = -(-size // LONGEST)
    k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(at, pieces) + k * LONGEST
    return np.append(start, n), np.searchsorted(start, offsets)


def walk(points: np.ndarray, start: np.ndarray) -> np.ndarray:
    """segments x BANDS features: hashes of the characters that the walk writes at the sampled steps."""
    size = np.diff(start)
    out = np.zeros((len(size), BANDS), U)
    order = np.argsort(size, kind="stable")
    padded = np.append(points, np.uint32(0))
    for b in range(0, len(order), LANES):
        lane = order[b : b + LANES]
        length = size[lane]
        pos, end = start[:-1][lane].copy(), start[1:][lane]
        want = (SAMPLES.ravel() * 2 * length[:, None]).astype(np.int64).ravel()  # the step of each sample
        sample = np.argsort(want, kind="stable")
        due = np.searchsorted(want[sample], np.arange(int(want.max()) + 2))
        written = np.zeros(len(want), np.uint32)
        for j in range(len(due) - 1):
            alive = pos < end
            c = np.where(alive, padded[pos], np.uint32(0))
            if due[j + 1] > due[j]:
                now = sample[due[j] : due[j + 1]]
                written[now] = c[now // (BANDS * PER_BAND)]
            bit = c ^ _STEP[j]
            bit *= np.uint32(0x85EBCA6B)
            bit ^= bit >> np.uint32(15)
            bit *= np.uint32(0xC2B2AE35)
            pos += (bit >> np.uint32(31)).astype(bool) & alive
        step = written.reshape(len(lane), BANDS, PER_BAND).astype(U)
        value = np.broadcast_to((np.arange(BANDS, dtype=U) + U(1)) * U(0xA0761D6478BD642F), (len(lane), BANDS)).copy()
        for i in range(PER_BAND):
            value = mix(value + step[:, :, i] + U(1))
        # segments of very different length don't share a feature by their samples alone
        value ^= np.frexp(length.astype(np.float64))[1].astype(U)[:, None] * U(0xE7037ED1A0B428DB)
        out[lane] = mix(value)
    return out


_LANES64 = np.arange(BITS // 64, dtype=U) * U(0x8EBC6AF09C88C6E3) + U(1)


#: So many bits of 0 or 1 add up in a byte.
_IN_BYTE = 255


def votes(features: np.ndarray, segment_row: np.ndarray, n: int) -> np.ndarray:
    """n x BITS/8 bytes: for each bit whether most features of a text have it."""
    flat = features.reshape(-1, 1)
    at = segment_row * BANDS
    size = np.diff(at)
    full = np.flatnonzero(size)
    if not len(full):
        return np.zeros((n, BITS // 8), np.uint8)
    # Features are summed in groups of one text, of a size that a byte holds, then the groups of a text.
    groups = -(-size[full] // _IN_BYTE)
    first = np.concatenate([[0], np.cumsum(groups)])
    start = np.repeat(at[:-1][full], groups) + (np.arange(first[-1]) - np.repeat(first[:-1], groups)) * _IN_BYTE
    sums = np.zeros((len(start), BITS), np.uint8)
    block = 0
    while block < len(start):  # a bounded number of features at a time
        last = max(block + 1, int(np.searchsorted(start, start[block] + (1 << 13), "right")) - 1)
        stop = start[last] if last < len(start) else len(flat)
        bits = np.unpackbits(mix(flat[start[block] : stop] * _LANES64 + _LANES64).view(np.uint8).reshape(-1, BITS // 8), axis=1)
        sums[block:last] = np.add.reduceat(bits.view(U), start[block:last] - start[block], axis=0).view(np.uint8)
        block = last
    out = np.zeros((n, BITS // 8), np.uint8)
    total = np.add.reduceat(sums, first[:-1], axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * total > size[full, None], axis=1)
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """texts x BITS/8 bytes."""
    points, offsets = code_points(texts)
    start, row = segments(points, offsets)
    return votes(walk(points, start), row, len(texts))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1: 1 for equal fingerprints, 0 for as many equal bits as by chance or fewer.

    Voted bits differ with chance angle / pi, where the angle's cosine is the share of features in common.
    """
    return np.maximum(0.0, np.cos(np.pi * np.bitwise_count(a ^ b).sum(1) / BITS))


SLICE_CHARS = 1 << 20


def _batches(rows: Iterator[tuple], chars: int = SLICE_CHARS) -> Iterator[list[tuple]]:
    out, n = [], 0
    for r in rows:
        out.append(r)
        n += len(r[1])
        if n >= chars:
            yield out
            out, n = [], 0
    if out:
        yield out


def fingerprint(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``fingerprint`` (lowercase hex) of each row."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = StructType([*[f for f in rows.schema.fields if f.name != "__text"], StructField("fingerprint", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "__text", SLICE_CHARS):
                texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([f.tobytes().hex() for f in fingerprints(texts)])], schema.names)

    return rows.mapInArrow(run, schema)


def edited(text: str, other: str) -> str:
    """The text with its last half replaced by as many characters of the other's beginning, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


EDITED = StructType(
    [StructField("doc_id", LongType()), StructField("n_chars", LongType()), StructField("edited_sha256", StringType()), StructField("fingerprint", StringType()), StructField("edited_fingerprint", StringType()), StructField("near_edited", DoubleType()), StructField("near_next", DoubleType())]
)


#: The rows of a task, in order, and its first and last text, whose neighbours other tasks have.
PLACED = StructType([*EDITED.fields, StructField("part", IntegerType()), StructField("edge", StringType()), StructField("text", StringType())])


def _compared(group: list[tuple]) -> list[pa.Array]:
    """The columns of EDITED for (doc_id, text, next text)."""
    changed = [edited(t, nxt) for _, t, nxt in group]
    # the next row's text is mostly the next in the list: only those that are not are walked again
    texts = [t for _, t, _ in group]
    extra = [i for i, (_, _, nxt) in enumerate(group) if i + 1 == len(group) or group[i + 1][1] is not nxt]
    prints = fingerprints(texts + changed + [group[i][2] for i in extra])
    n = len(group)
    own, new = prints[:n], prints[n : 2 * n]
    following = np.concatenate([own[1:], own[:1]])
    following[extra] = prints[2 * n :]
    hexed = lambda p: pa.array([x.tobytes().hex() for x in p], pa.string())
    sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
    return [pa.array([g[0] for g in group], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha, pa.string()), hexed(own), hexed(new), pa.array(likeness(own, new)), pa.array(likeness(own, following))]


def with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """EDITED of each row: its fingerprint, that of its edited text, and how near both and the next document are.

    The next document is the one of the next lower doc_id; after the last comes the first.
    Documents are dealt out once, by ranges of doc_id, and each task compares its rows in
    order. What a task can't tell alone is its last row, whose next one is the first
    of the next task with rows: of these two rows a task, the texts are kept and joined.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.substring("text", 1, 32).desc()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(order[0], F.col("text").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, None

        def pairs() -> Iterator[tuple]:
            nonlocal held, first
            for b in batches:
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if held is not None:
                        yield (*held, t)
                    else:
                        first = (d, t)
                    held = (d, t)

        def out(columns: list[pa.Array], edge: str | None, texts: list[str | None]) -> pa.RecordBatch:
            n = len(texts)
            return pa.RecordBatch.from_arrays([*columns, pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()), pa.array(texts, pa.string())], PLACED.names)

        for group in _batches(pairs()):
            yield out(_compared(group), None, [None] * len(group))
        for edge, row in (("first", first), ("last", held)):
            if row is not None:
                yield out([pa.array([row[0] if f.name == "doc_id" else None], pa.string() if f.dataType == StringType() else pa.float64() if f.dataType == DoubleType() else pa.int64()) for f in EDITED.fields], edge, [row[1]])

    placed = scratch.table(dealt.mapInArrow(run, PLACED), "placed")
    firsts, lasts = placed.filter("edge = 'first'"), placed.filter("edge = 'last'").select("part", "doc_id", "text")
    # Which task with rows comes after each, around the end: two numbers for each task.
    parts = firsts.select("part")
    all_parts = Window.partitionBy(F.lit(0))
    after = parts.select("part", F.coalesce(F.lead("part").over(all_parts.orderBy("part")), F.min("part").over(all_parts)).alias("after"))
    joined = lasts.join(after, "part").join(firsts.select(F.col("part").alias("after"), F.col("text").alias("next")), "after").select("doc_id", "text", "next")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group in _batches(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                yield pa.RecordBatch.from_arrays(_compared(group), EDITED.names)

    return placed.filter("edge is null").select(*EDITED.names).unionByName(joined.mapInArrow(ends, EDITED))


TABLES, SAMPLED, LEAST = 48, 26, 0.95
KEYS = StructType([StructField("node", LongType()), StructField("bits", ArrayType(LongType())), StructField("keys", ArrayType(LongType()))])


def band_keys(nodes: DataFrame, tables: int, sampled: int, seed: int = 3) -> DataFrame:
    """KEYS of (node, fingerprint): the fingerprint as 64-bit integers, and its key in each table."""
    places = np.random.default_rng(seed).permuted(np.tile(np.arange(BITS), (tables, 1)), axis=1)[:, :sampled]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.frombuffer(bytes.fromhex("".join(b.column(1).to_pylist())), np.uint8).reshape(b.num_rows, BITS // 8)
            on = np.unpackbits(raw, axis=1)
            keys = np.stack([on[:, places[t]].astype(np.int64) @ (1 << np.arange(sampled)) + (t << sampled) for t in range(tables)], axis=1)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists(raw.copy().view(np.int64)), lists(keys)], KEYS.names)

    return nodes.select("node", "fingerprint").mapInArrow(run, KEYS)


def _near(x: Column, y: Column, least: float) -> Column:
    """Whether fingerprints (64-bit integers) have at least a likeness."""
    most = int(np.floor(np.arccos(least) / np.pi * BITS + 1e-9))
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(BITS // 64)), F.lit(0)) <= most


def near_groups(prints: DataFrame, doc_id: str = "doc_id", tables: int = TABLES, sampled: int = SAMPLED, least: float = LEAST, scratch: Scratch | None = None) -> DataFrame:
    """(fingerprint, near_id): the least doc_id that near fingerprints reach, for each distinct one of ``prints``. Rows without doc_id or fingerprint take no part.

    Of n fingerprints about n / 2 ** ``sampled`` share a key by chance: for many more than a billion ``sampled`` and ``tables`` should grow.
    """
    scratch = scratch or Scratch(prints.sparkSession)
    known = prints.select(F.col(doc_id).cast("long").alias("doc_id"), "fingerprint").filter("doc_id is not null and fingerprint is not null")
    nodes = scratch.table(known.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = scratch.table(band_keys(nodes, tables, sampled), "bands")
    rows, bits = bands.select("node", F.explode("keys").alias("key")), bands.select("node", "bits")
    pivots = scratch.table(rows.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("high")).filter("pivot < high").drop("high"), "pivots")
    members = scratch.table(rows.join(pivots, "key"), "members")
    of = lambda side: bits.select(F.col("node").alias(side), F.col("bits").alias(f"f{side}"))
    met = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    star = met.join(of("a"), "a").join(of("b"), "b").filter(_near(F.col("fa"), F.col("fb"), least)).select("a", "b")
    labels = components(star, scratch)

    label = lambda node, name: labels.select(F.col("node").alias(node), F.col("label").alias(name))
    placed = members.join(label("node", "l1"), "node", "left").join(label("pivot", "l2"), "pivot", "left").select("key", "node", F.coalesce("l1", "node").alias("comp"), F.coalesce("l2", "pivot").alias("home")).join(bits, "node")
    placed = scratch.table(placed, "placed")
    left = placed.filter("comp <> home").select(F.col("key").alias("k"), F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("bits").alias("fa"))
    right = placed.select("key", F.col("node").alias("b"), F.col("comp").alias("cb"), "home", F.col("bits").alias("fb"))
    again = left.join(right, (F.col("k") == F.col("key")) & (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("home")) | (F.col("a") < F.col("b"))) & _near(F.col("fa"), F.col("fb"), least))
    links = scratch.table(again.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "links")
    upper = components(links, scratch).select(F.col("node").alias("comp"), F.col("label").alias("top"))
    comp = nodes.join(label("node", "l1"), "node", "left").select("fingerprint", "doc_id", F.coalesce("l1", "node").alias("comp")).join(upper, "comp", "left").select("fingerprint", "doc_id", F.coalesce("top", "comp").alias("comp"))
    comp = scratch.table(comp, "comp")
    scratch.drop(bands, pivots, members, placed, links)
    least_id = comp.groupBy("comp").agg(F.min("doc_id").alias("near_id"))
    return scratch.table(comp.join(least_id, "comp").select("fingerprint", "near_id"), "near")

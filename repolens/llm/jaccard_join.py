"""Near duplicates by an exact Jaccard join over word shingles (operator 2).

Parity sketches. A document's set of shingle hashes is XORed into blocks: a shingle
toggles a code in one of some number of blocks, so documents that differ in d shingles
differ in at most d blocks. At Jaccard J or more, sets of n1 and n2 shingles differ in at
most (n1 + n2) (1 - J) / (1 + J) shingles. By the pigeonhole principle, of any d + 1 blocks of
one document at least one equals the other's. Documents are joined within bands of size,
a pair in the band of its larger set; a set near the end of its band takes part in the
next one too. Both sides choose their d + 1 blocks by one order, so that the choices meet.

This is done twice. The first pass takes few, large blocks, those of most shingles first, and
only tells which sets share one with another set; the others are linked with nothing. For
the sets that are left, the second pass counts every block of a finer partition and each
set chooses its rarest blocks, by count and key. A passage that many documents share
gives frequent blocks, which come last and are not chosen as long as a document has
enough others. A set whose own, unshared blocks are d + 1 or more has no partner.

A second sketch has a bit for each shingle's hash, toggled by it. The Hamming distance of
two such sketches is a lower bound of the sets' difference, and most candidates that do
not link fall to it. The others are verified on the full sets.

No pairs within a group are emitted. Equal sets are one node. In each group of nodes with
an equal block, every node is first compared with the group's pivot alone: the node with the
smallest share of unshared blocks, which in a group of edited copies is the least edited
one. The components of these links are contracted. Then only nodes outside of the pivot's
component are compared with nodes of other components in their group, by the sketches
within the join, and only pairs that may link leave it. This is the same for groups of
any size. Every link between different texts is so either found or implied by found ones.

Hot blocks: counts, pivots and components of blocks are sums and minima, taken in part
before the shuffle; rows of a block meet them in joins, which Spark splits where a key is skewed.

Shingles and sets are known by 64-bit hashes. The pigeonhole argument needs more non-empty
blocks than differences; for small sets each shingle is a block, for others the chance of
too few is below 1e-11 a document.

Rows: a null or empty text, or one without words, has no shingles and is linked with
nothing; with fewer words than a shingle has, the whole sequence is one. Rows of equal
doc_id are documents of their own with one id; rows without doc_id are linked with nothing
and their component is null. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .components import components
from .scratch import Scratch
from .textnum import LOWER_CODE, mix, row_of, shingles, signed, slices, utf8, words

WORDS, PERCENT = 5, 80
SEEN = 1 << 20
FILTER_BITS = 1 << 24
#: Sets below this size have a block for each shingle.
TOKEN_BLOCKS_BELOW = 16
U = np.uint64


def shingle_sets(column: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and their offsets."""
    data, offsets = utf8(column)
    hashes, _, _, row = words(data, offsets, LOWER_CODE)
    all_, at = shingles(hashes, row, k)
    parts = [np.unique(all_[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return (np.concatenate(parts) if parts else all_), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def set_ids(sets: np.ndarray, row: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(sets ^ U(0x5851F42D4C957F2D)), dtype=U)])
    return mix(total[row[1:]] - total[row[:-1]] + np.diff(row).astype(U))


def band(n: np.ndarray) -> np.ndarray:
    """The bit length of a size."""
    return np.frexp(n.astype(np.float64))[1].astype(np.int64)


def blocks(b: np.ndarray, fine: bool) -> np.ndarray:
    return np.where(b <= 6, 64, (1 << b) if fine else (1 << b) // 3)


def sketches(sets: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit sketches of the sets, as 64-bit integers and their offsets: of 4 to 8 bits a shingle, a power of two and 128 at least.

    The sketch of a set in band b is folded to half its length where it meets sets of band b - 1.
    """
    size = 1 << (np.maximum(band(np.diff(row)), 5) + 2)
    start = np.concatenate([[0], np.cumsum(size)])
    r = row_of(row)
    at = start[r] + (mix(sets) & (size[r] - 1).astype(U)).astype(np.int64)
    bits = np.packbits((np.bincount(at, minlength=start[-1]) & 1).astype(np.uint8), bitorder="little")
    return bits.view(np.int64), start // 64


def differences(n: np.ndarray, largest: np.ndarray, percent: int) -> np.ndarray:
    """The most by which sets of n and of ``largest`` shingles can differ if they link."""
    return (n + largest) * (100 - percent) // (100 + percent)


def block_keys(sets: np.ndarray, row: np.ndarray, percent: int = PERCENT, every: bool = False):
    """(row, key, band, how many to choose) of the blocks of each set, in each band where it takes part; rows of a set and band follow each other.

    With ``every`` all blocks of the finer partition; else the chosen blocks of the coarser one: those of most shingles.
    """
    n = np.diff(row)
    out = []
    for later in (0, 1):
        b = band(n) + later
        most = np.minimum(n * 100 // percent, (1 << b) - 1)  # the largest partner in this band
        here = np.flatnonzero((n > 0) & (most >= 1 << np.maximum(b - 1, 0)))
        if not len(here):
            continue
        size = n[here]
        r = np.repeat(np.arange(len(here)), size)
        first = np.concatenate([[0], np.cumsum(size)])
        u = sets[np.repeat(row[:-1][here] - first[:-1], size) + np.arange(first[-1])]
        m = blocks(b[here], every)[r]
        own = ((1 << b[here]) <= TOKEN_BLOCKS_BELOW)[r]  # by band, so that both sides agree
        place = np.where(own, np.arange(len(u)) - first[r], ((u >> U(20)) % m.astype(U)).astype(np.int64))
        width = max(int(m.max()), int(size.max())) + 1
        order = np.argsort(r * width + place, kind="stable")
        group = (r * width + place)[order]
        start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        code = np.bitwise_xor.reduceat(mix(u[order] + U(0x632BE59BD9B4E019)), start)
        count = np.diff(np.append(start, len(group)))
        gr = r[order][start]
        named = np.where(own[order][start], 0, place[order][start] + 1)
        key = mix(code ^ mix((named.astype(U) << U(20)) + (count.astype(U) << U(6)) + b[here][gr].astype(U)))
        need = differences(n[here], most[here], percent)[gr] + 1
        if not every:
            order = np.lexsort((key, -count, gr))
            gr, key, need = gr[order], key[order], need[order]
            begin = np.searchsorted(gr, np.arange(len(here)))
            keep = np.arange(len(gr)) - begin[gr] < need
            gr, key, need = gr[keep], key[keep], need[keep]
        out.append((here[gr], key, b[here][gr], need))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


BASE = StructType([StructField("doc_id", LongType()), StructField("n_shingles", LongType()), StructField("sid", LongType()), StructField("keys", ArrayType(LongType()))])


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(signed(values)))


def _fresh(ids: np.ndarray, n: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows have a set that this task has not had before; what is kept to tell is bounded."""
    out = np.zeros(len(ids), bool)
    for i, x in enumerate(ids.tolist()):
        if n[i] and x not in seen:
            out[i] = True
            seen.add(x)
    if len(seen) > SEEN:
        seen.clear()
    return out


def _take(sets: np.ndarray, row: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(row)
    return sets[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(n[keep])])


def _base(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """BASE of every row: ``sid`` is null without shingles; ``keys`` are the chosen coarse blocks of a set, empty if this task has given them before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for b in slices(whole, "__text"):
                sets, row = shingle_sets(b.column(1), k)
                ids, n = set_ids(sets, row), np.diff(row)
                keep = _fresh(ids, np.where(b.column(0).is_valid().to_numpy(zero_copy_only=False), n, 0), seen)
                r, key, _, _ = block_keys(*_take(sets, row, keep), percent)
                r = np.flatnonzero(keep)[r]
                order = np.argsort(r, kind="stable")
                keys = _lists(key[order], np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(n)))]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(signed(ids), pa.int64(), mask=n == 0), keys], BASE.names)

    return docs.mapInArrow(run, BASE)


SETS = StructType([StructField("doc_id", LongType()), StructField("sid", LongType()), StructField("n", IntegerType()), StructField("sketch", ArrayType(LongType())), StructField("shingles", ArrayType(LongType()))])


def _sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """SETS of the nodes, and of others that a filter of fixed size lets pass."""
    pos = F.pmod(F.col("sid"), F.lit(FILTER_BITS))
    bits = nodes.groupBy(F.bitmap_bucket_number(pos).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(pos)).alias("bits"))
    table = np.zeros((FILTER_BITS // 32768 + 2, 4096), np.uint8)
    for r in bits.collect():
        table[r["b"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for whole in batches:
            for b in slices(whole, "__text"):
                sets, row = shingle_sets(b.column(1), k)
                ids = set_ids(sets, row)
                # Spark's buckets count from 1, and a position p is bit (p - 1) % 32768 of bucket 1 + (p - 1) / 32768; 0 is bit 0 of bucket 0.
                p = np.mod(signed(ids), FILTER_BITS)
                at = np.where(p > 0, (p - 1) % 32768, 0)
                bucket = np.where(p > 0, 1 + (p - 1) // 32768, 0)
                keep = ((table[bucket, at // 8] >> (at % 8).astype(np.uint8)) & 1).astype(bool) & (np.diff(row) > 0)
                some, r = _take(sets, row, keep)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), pa.array(signed(ids[keep])), pa.array(np.diff(r), pa.int32()), _lists(*sketches(some, r)), _lists(some, r)], SETS.names)

    return docs.filter("doc_id is not null").mapInArrow(run, SETS)


def _shared(keys: DataFrame) -> DataFrame:
    """(key, n) of the keys that different sets have; ``n`` counts rows."""
    return keys.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high"), F.count("*").alias("n")).filter("low < high").select("key", "n")


BLOCKS = StructType([StructField("sid", LongType()), StructField("band", IntegerType()), StructField("need", IntegerType()), StructField("keys", ArrayType(LongType()))])


def _every_block(sets: DataFrame, percent: int) -> DataFrame:
    """BLOCKS: all fine blocks of each set in each band where it takes part, and how many it must choose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                row = np.concatenate([[0], np.cumsum(b.column(1).value_lengths().to_numpy())]).astype(np.int64)
                flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U)
                r, key, bands, need = block_keys(flat, row, percent, every=True)
                new = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (bands[1:] != bands[:-1]))) if len(r) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r[new])), pa.array(bands[new], pa.int32()), pa.array(need[new], pa.int32()), _lists(key, np.append(new, len(r)))], BLOCKS.names)

    return sets.select("sid", "shingles").mapInArrow(run, BLOCKS)


def _rarest(every: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, band, sid, private): the blocks of each set that are among its ``need`` rarest and are shared, and which part of its blocks aren't.

    Unshared blocks are the rarest; they only count, as nothing meets them.
    """
    of_set = Window.partitionBy("sid", "band")
    rows = every.select("sid", "band", "need", F.size("keys").alias("total"), F.explode("keys").alias("key")).join(shared, "key")
    placed = rows.withColumn("place", F.row_number().over(of_set.orderBy("n", "key"))).withColumn("own", F.col("total") - F.count("*").over(of_set))
    return placed.filter("place + own <= need").select("key", "band", "sid", (F.col("own") / F.col("total")).alias("private"))


def _differ_at_most(n1: Column, n2: Column, percent: int) -> Column:
    return F.floor((n1 + n2) * (100 - percent) / (100 + percent))


def _folded(sketch: Column, width: Column) -> Column:
    """A sketch at the width of a band, of which it has the length or twice that."""
    half = F.zip_with(F.slice(sketch, F.lit(1), width), F.slice(sketch, width + 1, width), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(sketch) > width, half).otherwise(sketch)


def _hamming(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, n: total + n)


def _width() -> Column:
    """The length of sketches in a ``band``, in 64-bit integers."""
    return F.expr("shiftleft(1, greatest(band, 6) - 5)")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets link."""
    one = lambda side: sets.select(F.col("sid").alias(side), F.col("shingles").alias(f"s{side}"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(one("a"), "a").join(one("b"), "b").filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _close(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct (a, b) of ``pairs`` (a, b, band) whose sketches may link."""
    one = lambda side: sets.select(F.col("sid").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
    most, width = _differ_at_most(F.col("na"), F.col("nb"), percent), _width()
    rows = pairs.join(one("a"), "a").join(one("b"), "b")
    return rows.filter((F.abs(F.col("na") - F.col("nb")) <= most) & (_hamming(_folded(F.col("sa"), width), _folded(F.col("sb"), width)) <= most)).select("a", "b").distinct()


def _across(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Distinct pairs of nodes of different components that share a key of ``members`` (key, band, sid, pivot) and whose sketches may link.

    One of a pair is not of its pivot's component. Pairs are compared by their sketches within the join.
    """
    of = lambda node, label: labels.select(F.col("node").alias(node), F.col("label").alias(label))
    placed = members.join(of("sid", "l1"), "sid", "left").join(of("pivot", "l2"), "pivot", "left").select("key", "band", "sid", F.coalesce("l1", "sid").alias("comp"), F.coalesce("l2", "pivot").alias("home"))
    placed = scratch.table(placed, "placed")
    outside = placed.filter("comp <> home")
    mixed = placed.join(outside.select("key").distinct(), "key", "left_semi").join(sets.select("sid", "n", "sketch"), "sid")
    mixed = scratch.table(mixed.select("key", "sid", "comp", "home", "n", _folded(F.col("sketch"), _width()).alias("sketch")), "mixed")
    left = mixed.filter("comp <> home").select("key", F.col("sid").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = mixed.select("key", F.col("sid").alias("b"), F.col("comp").alias("cb"), F.col("home").alias("hb"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    most = _differ_at_most(F.col("na"), F.col("nb"), percent)
    once = (F.col("cb") == F.col("hb")) | (F.col("a") < F.col("b"))  # of two outside, each pair once
    near = (F.col("ca") != F.col("cb")) & once & (F.abs(F.col("na") - F.col("nb")) <= most) & (_hamming(F.col("sa"), F.col("sb")) <= most)
    met = left.alias("x").join(right.alias("y"), (F.col("x.key") == F.col("y.key")) & near)
    out = scratch.table(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "across")
    scratch.drop(placed, mixed)
    return out


def _merge(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` (node, label) with the components that ``links`` (a, b) join; links may name new nodes."""
    if links.isEmpty():
        return labels
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    contracted = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    upper = components(contracted, scratch).select(F.col("node").alias("label"), F.col("label").alias("top"))
    new = upper.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), "label")
    out = labels.unionByName(new).join(upper, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return scratch.table(out, "labels")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) for each row of ``docs``."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    base = scratch.table(_base(rows, k, percent), "base")
    facts, coarse = base.select("doc_id", "n_shingles", "sid"), base.select("sid", F.explode("keys").alias("key"))

    shared = scratch.table(_shared(coarse).select("key"), "shared")
    nodes = scratch.table(coarse.join(shared, "key").select("sid").distinct(), "nodes")
    own = facts.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id")).join(nodes, "sid", "left_semi")
    sets = scratch.table(_sets(rows, nodes, k).join(own, ["sid", "doc_id"], "left_semi").dropDuplicates(["sid"]), "sets")

    # Blocks take as much room as the sets, so they are made again from these rather than kept beside them and their own shuffle.
    every = _every_block(sets, percent)
    counts = scratch.table(_shared(every.select("sid", F.explode("keys").alias("key"))), "counts")
    rarest = scratch.table(_rarest(every, counts), "rarest")
    pivots = rarest.groupBy("key").agg(F.min(F.struct("private", "sid")).alias("least"), F.min("sid").alias("low"), F.max("sid").alias("high")).filter("low < high").select("key", F.col("least.sid").alias("pivot"))
    members = scratch.table(rarest.join(pivots, "key").select("key", "band", "sid", "pivot"), "members")
    scratch.drop(shared, nodes, counts, rarest)

    star = scratch.table(_close(members.filter("sid <> pivot").select(F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b"), "band").distinct(), sets, percent), "star")
    labels = components(_linked(star, sets, percent), scratch)
    across = _across(members, labels, sets, percent, scratch)
    links = scratch.table(_linked(across, sets, percent), "links")
    labels = _merge(labels, links, scratch)
    scratch.drop(sets, members, star, across, links)

    # The least doc_id of each set, then of each component; a hot set or component is a minimum before it is a join's key.
    least = facts.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    placed = labels.join(least.withColumnRenamed("sid", "node"), "node")
    of_label = placed.groupBy("label").agg(F.min("doc_id").alias("least"))
    linked = scratch.table(placed.join(of_label, "label").select(F.col("node").alias("sid"), "least"), "linked")
    found = scratch.table(least.join(linked, "sid", "left").select("sid", F.coalesce("least", "doc_id").alias("component")), "found")
    return facts.join(found, "sid", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))

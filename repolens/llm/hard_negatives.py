"""Hard negatives by exact search over inverted lists of k-means (operator 11).

``Index.build`` fits centroids on a bounded sample, puts every row into the list of its
nearest centroid and stores each list's radius, the largest distance of a row from its
centroid. A list is kept in blocks of bounded size, so one that holds a third of all
rows is many blocks. Of rows equal in label and vector only the first ``most`` + 1 by id
are kept: they tie everywhere, so no others can be among the first ``most`` of an anchor.

``Index.search`` finds the first ``k`` rows in one or several windows of scores, of the anchor's
label or of others. By Cauchy-Schwarz a score in a list lies within |anchor| x radius of the
anchor's score with the centroid. Lists are visited by this upper bound, a growing number in each
round; lists that lie wholly outside of the windows are skipped, and a window is done with when the
next bound is strictly below its k-th score: rows that tie could still have a smaller id. So the
result is exact. Anchors are sent to the lists that they visit in bounded batches; neither they nor
rows are gathered in one place. Joins with anchors are merge joins by request: as compressed Parquet, what anchors
send is so small that Spark would broadcast it, and all of it, unpacked, would pass through the driver.

Rows: null ids, labels and vectors, and vectors with a null or non-finite component, take no
part. Rows of equal id count once, the least by label and vector. Vectors of different lengths
are padded with zeros. Components are held within +-2**22, so that scores and windows fit a long. Ties go
by smaller id. Extra columns are ignored; an empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

LIMIT = 1 << 22
LOW, HIGH = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class Lists:
    """``values``: how many numbers the sample for k-means may have; ``most_lists``: the most centroids; ``block``: rows of a block; ``bunch``: blocks of a list that one copy of an anchor meets; ``batch``: anchors of a batch; ``first`` and ``grow``: lists visited in the first round, and how many times more in each later one."""

    values: int = 1 << 20
    most_lists: int = 1024
    rounds: int = 8
    block: int = 1024
    bunch: int = 8
    batch: int = 128
    first: int = 8
    grow: int = 4
    seed: int = 11


def quantized(embedding: Column, scale: int = 256) -> Column:
    """floor(scale x) of each component; null if the vector or a component is null or not finite."""
    doubles = F.transform(embedding, lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(LIMIT)), F.lit(-LIMIT))
    # A product that leaves the doubles is infinite, and floor makes the largest long of it.
    return F.when(fine, F.transform(doubles, lambda x: held(x).cast("int")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """rows x dim of a list column; shorter rows end in zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centroids of the rows of x; one that loses all its rows moves to the row that lies worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at, far = nearest(x, c)
        n = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        full = np.flatnonzero(n)
        new = c.copy()
        new[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0) / n[full, None]
        lost = np.flatnonzero(n == 0)
        new[lost] = x[np.argsort(-far, kind="stable")[: len(lost)]]
        c = new
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest row of c, distance from it) of each row of x."""
    at, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    for i in range(0, len(x), 1024):
        part = x[i : i + 1024]
        own = ((c * c).sum(1)[None] - 2 * part @ c.T).argmin(1)
        at[i : i + 1024] = own
        far[i : i + 1024] = np.sqrt(((part - c[own]) ** 2).sum(1))
    return at, far


def first_k(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, the first of equal ones; in that order."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
        return at[np.argsort(-score[at], kind="stable")[:k]]
    return np.argsort(-score, kind="stable")[:k]


@dataclass
class Index:
    centroids: np.ndarray
    radius: np.ndarray  # 0 or more; -1 for a list without rows
    rows: DataFrame  # vec_id, label, v: each id once
    bunches: np.ndarray  # of each list
    blocks: DataFrame  # cluster, bunch, ids, labels, matrix
    scratch: Scratch
    most: int
    lists: Lists

    @classmethod
    def build(cls, rows: DataFrame, most: int = 10, lists: Lists = Lists(), scratch: Scratch | None = None) -> Index:
        """``rows``: vec_id long, label long, v array<int>. ``most``: the largest k that will be searched for."""
        scratch = scratch or Scratch(rows.sparkSession)
        spark = rows.sparkSession
        valid = rows.select("vec_id", "label", "v").filter("vec_id is not null and label is not null and v is not null")
        once = scratch.table(valid.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v"), "rows")
        known = once.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
        n, dim = known["n"], max(known["dim"] or 1, 1)
        share = lists.values / dim / max(n, 1)
        sample = once.filter(F.pmod(F.xxhash64("vec_id", F.lit("kmeans")), F.lit(1 << 30)) < share * float(1 << 30)) if share < 1 else once
        x = matrix(sample.sort("vec_id").select("v").toArrow()["v"].combine_chunks(), dim).astype(np.float64)
        k = max(1, min(lists.most_lists, int(n**0.5) // 2, len(np.unique(x, axis=0))))
        c = kmeans(x, k, lists.rounds, lists.seed) if len(x) else np.zeros((1, dim))
        shared = spark.sparkContext.broadcast(c)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, far = nearest(matrix(b.column(2), dim).astype(np.float64), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(far), *b.columns], ["cluster", "far", "vec_id", "label", "v"])

        tied = Window.partitionBy("label", "v").orderBy("vec_id")
        few = once.withColumn("__n", F.row_number().over(tied)).filter(F.col("__n") <= most + 1).drop("__n")
        placed = scratch.table(few.mapInArrow(assign, "cluster long, far double, vec_id long, label long, v array<int>"), "lists")
        found = placed.groupBy("cluster").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()
        radius, bunches = np.full(len(c), -1.0), np.zeros(len(c), np.int64)
        for r in found:
            radius[r["cluster"]] = r["far"] * (1 + 1e-9) + 1e-6  # rounding must not make it smaller
            bunches[r["cluster"]] = -(-r["n"] // (lists.block * lists.bunch))
        parts = spark.createDataFrame([(r["cluster"], -(-r["n"] // lists.block)) for r in found], "cluster long, parts long")

        def pack(table: pa.Table) -> pa.Table:
            table = table.sort_by("vec_id")
            whole = table.column("v").combine_chunks()
            ids, labels = (table.column(x).to_numpy() for x in ("vec_id", "label"))
            row = [table.column("cluster")[0].as_py(), table.column("part")[0].as_py() // lists.bunch, ids.tobytes(), labels.tobytes(), matrix(whole, dim).astype(np.int32).tobytes()]
            return pa.table({name: pa.array([value]) for name, value in zip(("cluster", "bunch", "ids", "labels", "matrix"), row, strict=True)})

        cut = placed.join(F.broadcast(parts), "cluster").withColumn("part", F.expr("pmod(xxhash64(vec_id, 'block'), parts)")).select("cluster", "part", "vec_id", "label", "v")
        blocks = scratch.table(cut.groupBy("cluster", "part").applyInArrow(pack, "cluster long, bunch long, ids binary, labels binary, matrix binary"), "blocks")
        scratch.drop(placed)
        return cls(c, radius, once, bunches, blocks, scratch, most, lists)

    def search(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor_id, slot, rank, vec_id, score): the first k rows of each window.

        ``asked``: anchor_id, label, v, windows (array of slot int, lo long, hi long; both ends belong to the window). ``same``: rows of
        the anchor's label without the anchor itself, else rows of other labels.
        """
        if k > self.most:
            raise ValueError(f"the index keeps ties for {self.most} rows at most")
        spark, scratch, lists = asked.sparkSession, self.scratch, self.lists
        shared, dim = spark.sparkContext.broadcast((self.centroids, self.radius)), self.centroids.shape[1]
        asked = scratch.table(asked, "asked")
        tasks = max(1, -(-asked.count() // lists.batch))
        found = None
        begin, size = 0, lists.first
        while begin < len(self.centroids):
            end = begin + size

            def visits(batches: Iterator[pa.RecordBatch], begin=begin, end=end) -> Iterator[pa.RecordBatch]:
                c, r = shared.value
                for whole in batches:
                    for at in range(0, whole.num_rows, 256):
                        b = whole.slice(at, 256)
                        q = matrix(b.column(2), dim).astype(np.float64)
                        mid, reach = q @ c.T, np.sqrt((q * q).sum(1))[:, None] * r
                        slack = 1e-6 + 1e-9 * (np.abs(mid) + np.abs(reach))
                        up, down = mid + reach + slack, mid - reach - slack
                        rows, clusters = [], []
                        for i, windows in enumerate(b.column(3).to_pylist()):
                            open_ = np.zeros(len(c), bool)
                            need = np.zeros(len(c), bool)
                            for w in windows:
                                inside = (up[i] >= w["lo"]) & (down[i] <= w["hi"]) & (r >= 0)
                                open_ |= inside
                                need |= inside & (up[i] >= (w["lo"] if w["kth"] is None else w["kth"]))
                            order = np.argsort(-up[i], kind="stable")
                            order = order[open_[order]][begin:end]
                            order = order[need[order]]
                            rows += [i] * len(order)
                            clusters += order.tolist()
                        out = b.take(pa.array(rows, pa.int64()))
                        yield pa.RecordBatch.from_arrays([pa.array(clusters, pa.int64()), *out.columns], ["cluster", "anchor_id", "label", "v", "windows"])

            kth = F.lit(None).cast("long")
            dealt = asked.repartition(tasks, "anchor_id")
            state = dealt.withColumn("windows", F.transform("windows", lambda w: F.struct(w["slot"].alias("slot"), w["lo"].alias("lo"), w["hi"].alias("hi"), kth.alias("kth"))))
            if found is not None:
                full = found.repartition(tasks, "anchor_id").groupBy("anchor_id", "slot").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("full"))
                at = F.coalesce(F.col("full"), F.create_map().cast("map<int,long>"))
                state = dealt.join(full.hint("merge"), "anchor_id", "left").select("anchor_id", "label", "v", F.transform("windows", lambda w: F.struct(w["slot"].alias("slot"), w["lo"].alias("lo"), w["hi"].alias("hi"), F.try_element_at(at, w["slot"]).alias("kth"))).alias("windows"))
            window = "array<struct<slot:int,lo:long,hi:long,kth:long>>"
            going = scratch.table(state.select("anchor_id", "label", "v", "windows").mapInArrow(visits, f"cluster long, anchor_id long, label long, v array<int>, windows {window}"), "visits")
            visited = going.groupBy("cluster").count().collect()  # at most most_lists
            if visited:
                sizes = spark.createDataFrame([(r["cluster"], -(-r["count"] // lists.batch), int(self.bunches[r["cluster"]])) for r in visited], "cluster long, batches long, bunches long")
                sent = going.join(F.broadcast(sizes), "cluster").withColumn("bunch", F.explode(F.expr("sequence(0L, bunches - 1)"))).repartition("cluster", "bunch")
                salt = F.expr("pmod(xxhash64(anchor_id, 'batch'), batches)").alias("salt")
                batch = sent.groupBy("cluster", "bunch", salt).agg(F.collect_list(F.struct("anchor_id", "label", "v", "windows")).alias("anchors"))
                hits = batch.join(self.blocks.hint("merge"), ["cluster", "bunch"]).select("anchors", "ids", "labels", "matrix").mapInArrow(_scan(dim, k, same), "anchor_id long, slot int, vec_id long, score long")
                hits = hits if found is None else hits.unionAll(found)
                best = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "vec_id")
                new = scratch.table(hits.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n"), "found")
                if found is not None:
                    scratch.drop(found)
                found = new
            scratch.drop(going)
            # Later lists of an anchor have lower bounds: a round without visits isn't the last one if windows skip lists, so all are offered.
            begin, size = end, size * lists.grow
        out = found if found is not None else spark.createDataFrame([], "anchor_id long, slot int, vec_id long, score long")
        order = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "vec_id")
        return out.select("anchor_id", "slot", F.row_number().over(order).alias("rank"), "vec_id", "score")


def _scan(dim: int, k: int, same: bool):
    """The first k rows of a block for each window of each anchor of a batch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                anchors = b.column(0)[i].values
                ids, labels = (np.frombuffer(b.column(j)[i].as_py(), np.int64) for j in (1, 2))
                x = np.frombuffer(b.column(3)[i].as_py(), np.int32).reshape(-1, dim).astype(np.int64)
                scores = products(matrix(anchors.field("v"), dim), x)
                out = [[], [], [], []]
                own_label = anchors.field("label").to_numpy()
                for a, (anchor, windows) in enumerate(zip(anchors.field("anchor_id").to_pylist(), anchors.field("windows").to_pylist(), strict=True)):
                    fit = (labels == own_label[a]) & (ids != anchor) if same else labels != own_label[a]
                    for w in windows:
                        low = w["lo"] if w["kth"] is None else max(w["lo"], w["kth"])
                        at = np.flatnonzero(fit & (scores[a] >= low) & (scores[a] <= w["hi"]))
                        at = at[first_k(scores[a][at], k)]
                        for column, values in zip(out, ([anchor] * len(at), [w["slot"]] * len(at), ids[at].tolist(), scores[a][at].tolist()), strict=True):
                            column += values
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor_id", "slot", "vec_id", "score"])

    return scan


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, lists: Lists = Lists(), scratch: Scratch | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (vec_id, label, v).

    An anchor's positives are its first rows of its own label. For each, negatives are the first rows of other labels whose
    score is from ``low`` to ``high`` hundredths of the positive's. A positive with a score below 0 has none.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    index = Index.build(rows, max(positives, negatives), lists, scratch)
    anchors = index.rows.filter(is_anchor).select(F.col("vec_id").alias("anchor_id"), "label", "v")
    window = lambda slot, lo, hi: F.struct(slot.cast("int").alias("slot"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    near = scratch.table(index.search(anchors.withColumn("windows", F.array(window(F.lit(0), F.lit(LOW), F.lit(HIGH)))), positives, True), "positives")
    score = F.col("score")
    each = window(F.col("rank"), F.expr(f"({low} * score + 99) div 100"), F.expr(f"({high} * score) div 100"))
    windows = near.filter(score >= 0).groupBy("anchor_id").agg(F.array_sort(F.collect_list(each)).alias("windows"))
    far = index.search(anchors.join(windows.hint("merge"), "anchor_id"), negatives, False)
    given = near.select("anchor_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(given.hint("merge"), ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

"""Quality by a byte-level convolutional network in numpy (operator 5).

A document's bytes are cut into overlapping chunks that cover all of it. Filters of
several bytes slide over each chunk; their responses are max-pooled in the chunk, and the
chunks' pooled responses are averaged and maximised over the document. A linear layer
makes one probability of them. A filter is a table of a weight for each of its places and
each byte, so its response is a sum of looked-up weights.

Training takes a bounded sample: at most about ``Training.per_label`` documents of each
label, chosen by a hash of their id, and of each all chunks. They are written and weighed first: in the order of that hash, a
document is taken where it still fits in its label's half of ``Training.bytes``, so that the driver holds no more chunks than
that, however long documents are. It runs on the driver by gradient descent through the pooled places. The sample is balanced; the share of labels among all labelled rows is put back into the
score. Scoring covers whole texts.

Rows: a null text is empty; an empty text has no chunk and its score is that of the bias.
Repeated rows and ties are scored alike; extra columns are ignored; an empty table gives
an empty result. Without labels of both kinds the score is the share of label 1, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from .scratch import Scratch
from .textnum import slices, utf8

CHUNK, STEP, WIDTH = 512, 448, 8


@dataclass(frozen=True)
class Training:
    per_label: int = 400
    bytes: int = 64 << 20
    filters: int = 12
    epochs: int = 12
    batch: int = 64
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 5


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks x CHUNK bytes, bytes in each chunk, first chunk of each row): chunks overlap and cover every byte."""
    size = np.diff(offsets)
    n = np.where(size == 0, 0, np.maximum(1, -(-(size - (CHUNK - STEP)) // STEP)))
    row = np.concatenate([[0], np.cumsum(n)])
    r = np.repeat(np.arange(len(size)), n)
    begin = (np.arange(row[-1]) - row[r]) * STEP
    length = np.minimum(CHUNK, size[r] - begin)
    padded = np.concatenate([data, np.zeros(CHUNK, np.uint8)])
    out = padded[(offsets[:-1][r] + begin)[:, None] + np.arange(CHUNK)]
    out[np.arange(CHUNK) >= length[:, None]] = 0
    return out, length, row


#: Chunks that are filtered at a time.
BLOCK = 256


def pooled(tables: np.ndarray, block: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """chunks x filters: the largest response in each chunk, not below 0, and its place.

    A filter lies at every place of a chunk at which it fits; in one shorter than a filter at its start, over zeros.
    """
    places = CHUNK - WIDTH + 1
    best, where = [np.zeros((0, tables.shape[2]), np.float32)], [np.zeros((0, tables.shape[2]), np.int64)]
    for i in range(0, len(block), BLOCK):
        b = block[i : i + BLOCK]
        total = tables[0][b[:, :places]]
        for k in range(1, WIDTH):
            total += tables[k][b[:, k : k + places]]
        total[np.arange(places) > np.maximum(length[i : i + BLOCK] - WIDTH, 0)[:, None]] = -np.inf
        at = total.argmax(1)
        best.append(np.maximum(np.take_along_axis(total, at[:, None], 1)[:, 0], 0))
        where.append(at)
    return np.concatenate(best), np.concatenate(where)


@dataclass
class Model:
    tables: np.ndarray  # WIDTH x 256 x filters
    mean: np.ndarray
    most: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        block, length, row = chunks(*utf8(column))
        n = np.diff(row)
        logit = np.full(len(n), self.bias)
        full = np.flatnonzero(n)
        if len(full):
            p, _ = pooled(self.tables, block, length)
            logit[full] += np.add.reduceat(p, row[full]) / n[full, None] @ self.mean + np.maximum.reduceat(p, row[full]) @ self.most
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, training: Training, text: str, doc_id: str, label: str) -> tuple[list, dict[int, int]]:
    """(label, chunk bytes) rows on the driver, of bounded number and bytes; and how many labels there are of each kind.

    The labels are sampled before the join, so their side is small whatever the input, and no text is shuffled.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("y"), F.xxhash64(F.col(doc_id).cast("string"), F.lit("quality")).alias("h"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in sorted(counts.items()):
        share = F.when(F.col("y") == y, F.lit(min(1.0, training.per_label / n))).otherwise(share)
    few = known.filter(F.pmod("h", F.lit(1 << 30)) < share * float(1 << 30))
    taken = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(few), "__id").select("h", "y", "__text")
    half = training.bytes // 2
    taken = taken.filter(F.coalesce(F.octet_length("__text"), F.lit(0)) <= half)
    schema = StructType([StructField("h", taken.schema["h"].dataType), StructField("y", IntegerType()), StructField("chunks", BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "__text"):
                data, offsets = utf8(b.column(2))
                block, length, row = chunks(data, offsets)
                out = []
                for i in range(b.num_rows):
                    out.append(b"".join(int(length[j]).to_bytes(4, "little") + block[j].tobytes() for j in range(row[i], row[i + 1])))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], schema.names)

    scratch = Scratch(docs.sparkSession)
    written = scratch.table(taken.mapInArrow(cut, schema), "quality-sample")
    left, fits = {0: half, 1: half}, {0: [], 1: []}
    # Rows of one id are taken together, or none is.
    for r in written.groupBy("h", "y").agg(F.sum(F.octet_length("chunks").cast("long")).alias("n")).orderBy("h", "y").collect():
        if r["n"] <= left[r["y"]]:
            left[r["y"]] -= r["n"]
            fits[r["y"]].append(r["h"])
    got = written.filter(((F.col("y") == 0) & F.col("h").isin(fits[0])) | ((F.col("y") == 1) & F.col("h").isin(fits[1]))).toArrow()
    got = got.sort_by([("h", "ascending"), ("y", "ascending"), ("chunks", "ascending")])
    scratch.drop(written)
    return list(zip(got["y"].to_pylist(), got["chunks"].to_pylist(), strict=True)), counts


def fit(docs: DataFrame, labels: DataFrame, training: Training = Training(), text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Model:
    """Fit on a bounded sample of the documents that have a label of 0 or 1; deterministic."""
    rows, counts = _sample(docs, labels, training, text, doc_id, label)
    rng = np.random.default_rng(training.seed)
    tables = rng.normal(0, 0.1, (WIDTH, 256, training.filters)).astype(np.float32)
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    prior = float(np.log(share / (1 - share))) if counts else 0.0
    rows = [(y, np.frombuffer(c, np.uint8).reshape(-1, CHUNK + 4)) for y, c in rows if c]
    y = np.array([r[0] for r in rows], np.float64)
    if len(set(y)) < 2:
        return Model(tables, np.zeros(training.filters), np.zeros(training.filters), prior)
    block = np.concatenate([c[:, 4:] for _, c in rows])
    length = np.concatenate([c[:, :4].copy().view("<u4")[:, 0] for _, c in rows]).astype(np.int64)
    row = np.concatenate([[0], np.cumsum([len(c) for _, c in rows])])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    f = training.filters
    state = {"tables": tables, "mean": rng.normal(0, 0.3, f), "most": rng.normal(0, 0.3, f), "bias": np.zeros(1)}
    moments = {k: (np.zeros(v.shape), np.zeros(v.shape)) for k, v in state.items()}
    t = 0
    for epoch in range(training.epochs):
        order = rng.permutation(len(y))
        rate = training.rate * (1 - epoch / training.epochs)
        for b in range(0, len(order), training.batch):
            docs = order[b : b + training.batch]
            n = row[docs + 1] - row[docs]
            start = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(row[docs] - start[:-1], n) + np.arange(start[-1])
            p, place = pooled(state["tables"], block[at], length[at])
            mean = np.add.reduceat(p, start[:-1]) / n[:, None]
            most = np.maximum.reduceat(p, start[:-1])
            logit = mean @ state["mean"] + most @ state["most"] + state["bias"]
            g = (1 / (1 + np.exp(-logit)) - y[docs]) * weight[docs] / len(docs)
            own = np.repeat(np.arange(len(docs)), n)
            back = g[own, None] * (state["mean"] / n[own, None] + state["most"] * (p == most[own]))
            back = np.where(p > 0, back, 0.01 * back)
            grads = {"mean": mean.T @ g, "most": most.T @ g, "bias": np.array([g.sum()]), "tables": np.zeros(tables.shape)}
            for k in range(WIDTH):
                seen = np.take_along_axis(block[at], place + k, 1).astype(np.int64)
                grads["tables"][k] = np.bincount((seen * f + np.arange(f)).ravel(), back.ravel(), 256 * f).reshape(256, f)
            t += 1
            for k, grad in grads.items():
                m, s = moments[k]
                grad = grad + training.decay * state[k]
                m[...] = 0.9 * m + 0.1 * grad
                s[...] = 0.999 * s + 0.001 * grad**2
                state[k] = (state[k] - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-7)).astype(state[k].dtype)
    return Model(state["tables"], state["mean"], state["most"], float(state["bias"][0]) + prior)


def score(docs: DataFrame, model: Model, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``score``, 0 to 1: higher where label 1 is likelier."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = StructType([*[f for f in rows.schema.fields if f.name != "__text"], StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "__text"):
                arrays = [b.column(b.schema.get_field_index(k)) for k in keep]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(shared.value.scores(b.column(b.schema.get_field_index("__text"))))], schema.names)

    return rows.mapInArrow(run, schema)

"""Language identification by error-correcting output codes (operator 1).

Every language has a codeword of bits. For each bit a binary classifier over hashed
byte n-grams (1 to 4 bytes, lower-cased) predicts whether the language's bit is 1. Decoding
adds up the loss of each bit's margin against each codeword and takes the codeword of
least loss. A document whose two best codewords lose almost alike is flagged ambiguous.

The classifiers are fitted on a bounded sample of labelled documents: at most
``Training.per_language`` documents of each language, taken by a hash of their id. Their
n-gram counts, not their texts, reach the driver. Prediction covers whole texts.

Rows: a null text, or one without a letter, is ``und`` with score 0. Rows without a
language aren't learned from. Repeated rows and ties are predicted alike; extra columns
are ignored; an empty table gives an empty result. With no labelled rows every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from .textnum import LOWER, mix, slices, utf8

DIM_BITS = 16
DIM = 1 << DIM_BITS
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"


@dataclass(frozen=True)
class Training:
    """``per_language`` bounds the sample; ``epochs``, ``rate`` and ``decay`` are the optimiser's."""

    per_language: int = 200
    epochs: int = 40
    rate: float = 0.01
    decay: float = 1e-5
    #: Least gap between the two best codewords, as a share of the loss of a coin's toss for each bit.
    ambiguous: float = 0.08


def codewords(n: int, seed: int = 1) -> np.ndarray:
    """n rows of +1 and -1. Up to 6 languages: all distinct splits; beyond: random ones, the set whose closest rows lie farthest apart."""
    if n <= 6:
        splits = [[1 if i == 0 or i in rest else -1 for i in range(n)] for k in range(n - 1) for rest in combinations(range(1, n), k)]
        return np.array(splits, np.int8).T if n > 1 else np.ones((1, 1), np.int8)
    bits, rng, best = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), (-1, None)
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        same = code.astype(np.int32) @ code.T
        np.fill_diagonal(same, -bits)
        best = max(best, (int(code.shape[1] - same.max()), code), key=lambda x: x[0])
    return best[1]


def _positions(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: feature of each position, and offsets of rows; n-grams don't leave their row."""
    low = LOWER[data].astype(np.uint64)
    out = []
    code = np.zeros(len(low), np.uint64)
    inside = np.diff(offsets)
    for k in ORDERS:
        code = (code[: len(low) - k + 1] << np.uint64(8)) | low[k - 1 :] if len(low) >= k else code[:0]
        feature = (mix(code + np.uint64(k << 40)) & np.uint64(DIM - 1)).astype(np.int64)
        n = np.maximum(inside - k + 1, 0)
        row = np.concatenate([[0], np.cumsum(n)])
        keep = np.repeat(offsets[:-1] - row[:-1], n) + np.arange(row[-1])
        out.append((feature[keep], row))
    return out


def _has_letter(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}").to_numpy(zero_copy_only=False)


def _features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of one text, and their shares of its n-grams."""
    idx = np.concatenate([f for f, _ in _positions(data, np.array([0, len(data)]))])
    at, n = np.unique(idx, return_counts=True)
    v = n.astype(np.float64)
    return at, (v / max(v.sum(), 1)).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    ambiguous: float

    def margins(self, column: pa.Array) -> np.ndarray:
        """rows x bits."""
        data, offsets = utf8(column)
        n, bits = len(offsets) - 1, self.code.shape[1]
        total, count = np.zeros((n, bits)), np.zeros(n)
        for feature, row in _positions(data, offsets):
            full = np.flatnonzero(np.diff(row))
            if len(full):
                total[full] += np.add.reduceat(self.weights[feature], row[full], axis=0)
                count += np.diff(row)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, gap to the next as a share)."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(2)
        order = np.argsort(loss, axis=1, kind="stable")
        best = loss[np.arange(len(loss)), order[:, 0]]
        share = np.exp(-(loss - best[:, None]))
        score = 1 / share.sum(1)
        second = loss[np.arange(len(loss)), order[:, 1]] if loss.shape[1] > 1 else best + np.inf
        return order[:, 0], score, (second - best) / (self.code.shape[1] * np.log(2))


def training_sample(labelled: DataFrame, per_language: int, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """(lang, hash of the id, features, weights) of at most about ``per_language`` documents of each language.

    A document is taken if a hash of its id falls below its language's share, so no
    language is gathered in one place, whatever its part of the rows.
    """
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("string"), F.lit("langid")).alias("h")).filter("lang is not null and text rlike '\\\\p{L}'")
    counts = {r["lang"]: r["n"] for r in labelled.filter(F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for name, n in sorted(counts.items()):
        share = F.when(F.col("lang") == name, F.lit(min(1.0, per_language / n))).otherwise(share)
    taken = rows.filter(F.pmod("h", F.lit(1 << 30)) < share * float(1 << 30)).select("lang", "text", "h")
    schema = StructType([StructField("lang", StringType()), StructField("h", LongType()), StructField("at", ArrayType(IntegerType())), StructField("weight", ArrayType(FloatType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang_, t, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, w = _features(np.frombuffer(t.encode(), np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([lang_]), pa.array([h]), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([w], pa.list_(pa.float32()))], schema.names)

    return taken.mapInArrow(count, schema)


def fit(labelled: DataFrame, training: Training = Training(), text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Fit on a bounded sample of ``labelled``; deterministic."""
    table = training_sample(labelled, training.per_language, text, lang, doc_id).toArrow()
    names = table["lang"].to_pylist()
    languages = sorted(set(names))
    if not languages:
        return Model([], np.ones((1, 1), np.int8), np.zeros((DIM, 1), np.float32), np.zeros(1), training.ambiguous)
    order = sorted(range(len(names)), key=lambda i: (names[i], table["h"][i].as_py()))  # whatever the order in which rows came
    table = table.take(pa.array(order))
    names = table["lang"].to_pylist()
    code = codewords(len(languages))
    lists = table["at"].combine_chunks()
    row = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    used, cols = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    v = table["weight"].combine_chunks().flatten().to_numpy()
    doc = np.repeat(np.arange(len(names)), np.diff(row))
    which = np.array([languages.index(x) for x in names])
    target = code[which].astype(np.float32)
    share = (1 / np.bincount(which)[which] / len(languages)).astype(np.float32)[:, None]  # each language weighs alike
    # Shares of n-grams are small: they are scaled by the root mean square of their feature, and to a length of about one.
    scale = (1 / np.sqrt(np.bincount(cols, v.astype(np.float64) ** 2, len(used)) / len(names) + 1e-8)).astype(np.float32)
    scale /= np.sqrt(max(len(v) / len(names), 1), dtype=np.float32)
    v = v * scale[cols]
    w, bias = np.zeros((len(used), code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, training.epochs + 1):
        # one bit at a time, so that what is held is no larger than the sample
        margin = np.stack([np.add.reduceat(v * w[cols, j], row[:-1]) for j in range(code.shape[1])], axis=1) + bias
        g = -target / (1 + np.exp(np.clip(target * margin, -50, 50))) * share
        grad = np.stack([np.bincount(cols, v * g[doc, j], len(used)) for j in range(code.shape[1])], axis=1).astype(np.float32) + training.decay * w
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        w -= training.rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        bias -= training.rate * g.sum(0)
    weights = np.zeros((DIM, code.shape[1]), np.float32)
    weights[used] = w * scale[:, None]
    return Model(languages, code, weights, bias.astype(np.float64), training.ambiguous)


def predict(docs: DataFrame, model: Model, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep``, with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for b in slices(whole, "__text"):
                texts = b.column(b.schema.get_field_index("__text"))
                known = _has_letter(texts) & bool(own.languages)
                best, score, gap = own.decode(own.margins(texts))
                names = [own.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
                arrays = [b.column(b.schema.get_field_index(k)) for k in keep]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(~known | (gap < own.ambiguous))], schema.names)

    return rows.mapInArrow(run, schema)

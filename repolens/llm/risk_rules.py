"""Quality rules whose cutoffs carry a guarantee (operator 10).

Each rule compares one statistic of a document with a cutoff. The cutoffs are not
guessed: for every stratum (a language), labelled holdout documents decide. What is certified is a
configuration, a cutoff or none for each rule, as a document is rejected if any of its rules rejects it: an exact
binomial (Clopper-Pearson) upper bound on the share of good documents that the configuration rejects is
at most ``alpha``. The bounds hold at the same time for all configurations of all
strata: the error ``delta`` is divided by their number (Bonferroni), so any may be chosen by looking at the labels. Beginning without
rules, the cutoff is added or tightened that rejects the most further bad documents, the strictest of equal ones, as long as the whole is
certified and the gain is at least ``power`` of the bad. A stratum with too few labels gets no rules, and rejects none beyond the base rules.

Rows: nulls in text count as no words; rows whose stratum is null are a stratum of their own.
A stratum without a certificate, an unseen one among them, is under the base rules alone. Repeated rows and
ties stay, each with its own verdict. Extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, lgamma, log, log1p, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .textnum import SPACE, lines, row_of, shingles, slices, utf8, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "n_letters")
#: Statistics and the cutoffs that are tried, the strictest first; a document fails above a cutoff.
GRID = {
    "symbol_ratio": [0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3],
    "dup_line_ratio": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5],
    "repeat_ratio": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4],
    "upper_ratio": [0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6],
    "word_length": [8.0, 9.0, 10.0, 11.0, 12.0, 14.0, 16.0],
}


@dataclass(frozen=True)
class Policy:
    """``alpha``: the largest false rejection rate of all rules of a stratum together; ``delta``: the chance that any bound fails; ``power``: the least share of bad documents by which a step must reject more."""

    alpha: float = 0.01
    delta: float = 0.05
    power: float = 0.03


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the rate at which k or fewer of n have chance delta."""
    if k >= n:
        return 1.0
    logs = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) for i in range(k + 1)]

    def tail(p: float) -> float:
        x = [c + i * log(p) + (n - i) * log1p(-p) for i, c in enumerate(logs)]
        top = max(x)
        return exp(top) * sum(exp(v - top) for v in x)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid <= 0 or mid < 1 and tail(mid) > delta:
            low = mid
        else:
            high = mid
    return high


def _repeat_words(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words of each row that lie in a 3-word window found twice or more in the row."""
    n = np.diff(row)
    windows, w_row = shingles(hashes, row, 3)
    keep = np.repeat(n >= 3, np.diff(w_row))
    windows, doc = windows[keep], row_of(w_row)[keep]
    count = np.maximum(n - 2, 0)
    start = np.repeat(row[:-1] - (np.cumsum(count) - count), count) + np.arange(len(windows))
    order = np.lexsort((windows, doc))
    same = (windows[order][1:] == windows[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(hashes) + 3, bool)
    for j in range(3):
        hit[start[twice] + j] = True
    total = np.concatenate([[0], np.cumsum(hit[: len(hashes)])])
    return total[row[1:]] - total[row[:-1]]


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word that equal an earlier line, lines with a word) of each row."""
    hashes, solid, row = lines(data, offsets)
    doc = row_of(row)[solid]
    hashes = hashes[solid]
    order = np.lexsort((hashes, doc))
    same = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    n = len(offsets) - 1
    return np.bincount(doc[order][1:][same], minlength=n), np.bincount(doc, minlength=n)


def _counts(column: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = utf8(column)
    hashes, _, _, row = words(data, offsets)

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offsets[1:]] - total[offsets[:-1]]

    begins = (data & 0xC0) != 0x80
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    duplicate, n_lines = _duplicate_lines(data, offsets)
    return {
        "n_words": np.diff(row),
        "word_chars": per_row(begins & ~SPACE[data]),
        "n_symbols": per_row(SYMBOLS[data]),
        "n_dup_lines": duplicate,
        "n_lines": n_lines,
        "n_repeat_words": _repeat_words(hashes, row),
        "n_upper": per_row(upper),
        "n_letters": per_row(upper | lower),
    }


def text_counts(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` and the counts of each text. One row for each row of ``docs``."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    schema = StructType(fields + [StructField(c, LongType()) for c in COUNTS])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "__text"):
                c = _counts(b.column(b.schema.get_field_index("__text")))
                arrays = [b.column(b.schema.get_field_index(k)) for k in keep]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(c[x].astype(np.int64)) for x in COUNTS], [*keep, *COUNTS])

    return rows.mapInArrow(count, schema)


def counts_of(text: Column) -> Column:
    """The counts of a text as a struct, for rows whose other columns are to stay out of Python."""

    @F.arrow_udf(StructType([StructField(c, LongType()) for c in COUNTS]))
    def count(texts: pa.Array) -> pa.Array:
        parts = [_counts(b.column(0)) for b in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text")]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([p[c] for p in parts] or [np.zeros(0)]).astype(np.int64)) for c in COUNTS], [*COUNTS])

    return count(text)


def statistics() -> dict[str, Column]:
    """The statistics that the rules compare, over the counts."""
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "upper_ratio": ratio("n_upper", "n_letters"),
        "word_length": ratio("word_chars", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def choose(levels: np.ndarray, good: np.ndarray, bad: np.ndarray, most: int, power: float) -> dict[str, float]:
    """Cutoffs by rule that reject ``most`` good documents at most, all rules together.

    ``levels``: kinds of documents x rules, how many of a rule's cutoffs they exceed; ``good`` and ``bad`` count documents of each kind.
    """
    cuts = list(GRID.items())
    chosen = [len(c) for _, c in cuts]  # no rule exceeds as many cutoffs
    rejected = np.zeros(len(levels), bool)
    while True:
        steps = []
        for r in range(len(cuts)):
            for j in range(chosen[r]):
                more = rejected | (levels[:, r] > j)
                if good[more].sum() <= most and bad[more].sum() - bad[rejected].sum() >= max(power * bad.sum(), 1):
                    steps.append((-bad[more].sum(), good[more].sum(), r, j))
        if not steps:
            return {cuts[r][0]: cuts[r][1][j] for r, j in enumerate(chosen) if j < len(cuts[r][1])}
        *_, r, j = min(steps)
        chosen[r] = j
        rejected |= levels[:, r] > j


def calibrate(counts: DataFrame, labels: DataFrame, stratum: str | None, policy: Policy = Policy(), doc_id: str = "doc_id", quality: str = "quality") -> dict[str | None, dict[str, float]]:
    """Cutoffs by stratum and rule, from all labelled documents that pass the base rules; without ``stratum`` all rows are the stratum None.

    What reaches the driver is a count for each stratum and, of those with enough labels, for each
    combination of cutoffs that documents exceed, of which there are as many as configurations at most. Strata of fewer
    good labels than could ever certify a configuration have no cutoffs, and no row there.
    """
    known = labels.filter(F.col(quality).isin(0, 1)).select(F.col(doc_id).alias("__id"), F.col(quality).alias("__good")).distinct()
    own = (F.col(stratum) if stratum else F.lit(None)).cast("string")
    level = [sum((c > cut).cast("int") for cut in GRID[k]).alias(k) for k, c in statistics().items()]
    stats = counts.filter(~base_failed()).select(F.col(doc_id).alias("__id"), own.alias("stratum"), *level).join(known, "__id")
    kinds = stats.groupBy("stratum", *GRID).agg(F.count_if(F.col("__good") == 1).alias("good"), F.count_if(F.col("__good") == 0).alias("bad"))
    tried = prod(len(cuts) + 1 for cuts in GRID.values())
    least = int(log(policy.delta / tried) / log1p(-policy.alpha))
    sizes = stats.filter(F.col("__good") == 1).groupBy("stratum").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    size = {r["stratum"]: r["n"] for r in sizes.collect()}
    share = policy.delta / max(1, len(size) * tried)
    rows = kinds.join(F.broadcast(sizes.select(F.col("stratum").alias("s"))), F.col("stratum").eqNullSafe(F.col("s")), "left_semi").collect() if size else []
    out: dict[str | None, dict[str, float]] = {}
    for name, n in size.items():
        most = -1
        while upper_bound(most + 1, n, share) <= policy.alpha:
            most += 1
        mine = [r for r in rows if r["stratum"] == name]
        levels = np.array([[r[k] for k in GRID] for r in mine])
        out[name] = choose(levels, np.array([r["good"] for r in mine]), np.array([r["bad"] for r in mine]), most, policy.power)
    return out


def verdict(cutoffs: dict[str | None, dict[str, float]], stratum: str | None) -> Column:
    """True if no certified rule of the row's stratum rejects it."""
    stats = statistics()

    def passes(rules: dict[str, float]) -> Column:
        out = F.lit(True)
        for k, cut in rules.items():
            out = out & (stats[k] <= cut)
        return out

    own = F.col(stratum).cast("string") if stratum else F.lit(None).cast("string")
    out = F.lit(True)
    for name, rules in cutoffs.items():
        out = F.when(own.eqNullSafe(F.lit(name)), passes(rules)).otherwise(out)
    return out


def apply_rules(counts: DataFrame, cutoffs: dict[str | None, dict[str, float]], stratum: str | None) -> DataFrame:
    """``counts`` with ``base_failed`` and ``kept``."""
    return counts.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(cutoffs, stratum))

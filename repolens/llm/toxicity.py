"""Toxicity by weak supervision (operator 12).

Many voters look at each text: lexicons (fixed ones by language, and some induced from labelled
documents) and patterns, such as words spelled with digits or with gaps, or an insult after a
second person. A voter says toxic, clean, or nothing.

A generative label model explains the votes of all documents by a hidden label: the label's share, what
each voter says under each label (its accuracy and how often it abstains), and correlations, a
forest of pairs of voters that depend on each other under the same label. It is estimated by expectation
maximisation over the distinct vote patterns, one aggregate of their table for each step; what reaches the driver is a
number for each pair of voters, votes and label. Known labels are given, others are hidden. After ``Training.alone`` steps with
independent voters each step takes the forest of the largest conditional mutual information.

A linear classifier over the words of a text is trained on the model's posterior labels, from a bounded
sample of documents: at most about ``Training.per_class`` that the model calls toxic and as many others, by a hash of
their id. Its words are those whose presence tells the classes apart in that sample. Scoring takes whole texts.

Words are runs of letters (bytes above 127 are letters), A-Z lower-cased. Induced lexicons and the classifier also know beginnings
of words, of ``BEGINNINGS`` bytes, as abuse is inflected. Rows: a null text is empty; one without words has the
score of the bias. Rows with a null doc_id are scored, but not learned from; repeated rows and ties are scored alike; extra
columns are ignored; an empty table gives an empty result. Without labels the fixed lexicons alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .scratch import Scratch
from .textnum import BYTE_CODE, mix, row_of, runs_hash, slices, utf8

# Words of abuse, by language and kind.
LEXICONS = {
    "insults_en": "idiot idiots moron morons stupid dumb dumbass fool imbecile cretin jerk loser losers clown dimwit halfwit nitwit bastard asshole bitch dickhead prick",
    "contempt_en": "trash garbage scum filth worthless pathetic disgusting vermin parasite parasites subhuman degenerate repulsive vile despicable",
    "threats_en": "kill murder strangle slaughter exterminate lynch rape behead",
    "insults_de": "idiot idioten dummkopf trottel arschloch vollidiot depp schwachkopf drecksau abschaum missgeburt hurensohn wichser",
    "insults_fr": "imbécile crétin connard connasse abruti salaud salope ordure débile enculé bouffon",
    "insults_es": "idiota imbécil estúpido estúpida gilipollas cabrón pendejo basura escoria asqueroso asquerosa tarado",
}
SECOND_PERSON = "you your youre ur du dein deine dich ihr tu ton toi vous votre te tú tus usted ustedes eres"
HARMLESS = "license licensed copyright warranty redistribution"
#: Characters that stand for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

BEGINNINGS = (4, 5, 6, 7)
TOXIC, CLEAN = 1, 2
INDUCED = 3
PATTERNS = ("spelled", "gapped", "addressed", "repeated", "shouting", "banging", "harmless", "no_hit", "few_words")
VOTERS = (*LEXICONS, *[f"induced_{i}" for i in range(INDUCED)], *PATTERNS)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256).astype(np.uint8)
_LOWER[65:91] += 32
_STANDS = np.zeros(256, bool)
for _c, _l in STAND_INS.items():
    _STANDS[ord(_c)] = True
    _LOWER[ord(_c)] = ord(_l)


@dataclass(frozen=True)
class Training:
    """``per_label`` and ``per_class`` bound the samples for induced lexicons and for the classifier; ``words``: the most words of the classifier; ``induced``: the most of induced lexicons."""

    per_label: int = 2000
    per_class: int = 2000
    induced: int = 192
    words: int = 4096
    alone: int = 1
    steps: int = 12
    least_information: float = 0.02
    #: Least size of a word's log odds in standard errors, for an induced lexicon and for the classifier.
    least_z: float = 4.0
    word_z: float = 2.5
    #: Least log odds of a word of an induced lexicon.
    least_odds: float = 3.0
    rounds: int = 400
    sparsity: float = 2e-5


def _runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, offsets of rows) of the runs of true places; none leaves its row."""
    before = np.concatenate([[False], mask[:-1]]) if len(mask) else mask
    begin = mask & ~before
    inner = offsets[offsets < len(mask)]
    begin[inner] = mask[inner]
    starts = np.flatnonzero(begin)
    stop = mask & ~np.concatenate([mask[1:], [False]]) if len(mask) else mask
    ends = offsets[(offsets > 0) & (offsets <= len(mask))] - 1
    stop[ends] |= mask[ends]
    return starts, np.flatnonzero(stop) - starts + 1, np.searchsorted(starts, offsets)


def _hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the lower-cased runs."""
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    return runs_hash(BYTE_CODE[_LOWER[data[at]]], lengths)


def word_hashes(words: str) -> np.ndarray:
    """The hash of each of some words, as texts have them."""
    data, offsets = utf8(pa.array(words.split()))
    return _hashes(data, offsets[:-1], np.diff(offsets))


@dataclass
class Words:
    """The words of each row; ``odd``: those spelled with other characters or gaps, as (hash, row)."""

    hashes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    row: np.ndarray
    spelled: tuple[np.ndarray, np.ndarray]
    gapped: tuple[np.ndarray, np.ndarray]
    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        data, offsets = utf8(column)
        letter = _LETTER[data]
        starts, lengths, row = _runs(letter, offsets)
        # single letters with one character between: at least four in a row
        doc = row_of(row)
        single = lengths == 1
        next_ = np.zeros(len(starts), bool)
        if len(starts) > 1:
            next_[1:] = single[1:] & single[:-1] & (np.diff(starts) == 2) & (doc[1:] == doc[:-1])
        head, size, _ = _runs(next_, np.array([0, len(next_)]))
        long = size >= 3
        head, size = head[long] - 1, size[long] + 1
        at = np.repeat(head - (np.cumsum(size) - size), size) + np.arange(size.sum())
        gapped = runs_hash(BYTE_CODE[_LOWER[data[starts[at]]]], size), doc[head]
        stands = _STANDS[data]
        s_starts, s_lengths, s_row = _runs(letter | stands, offsets)
        count = np.concatenate([[0], np.cumsum(stands)])
        mixed = count[s_starts + s_lengths] - count[s_starts]
        own = np.flatnonzero((mixed > 0) & (mixed < s_lengths) & (s_lengths < 40))
        spelled = _hashes(data, s_starts[own], s_lengths[own]), row_of(s_row)[own]
        return cls(_hashes(data, starts, lengths), starts, lengths, row, spelled, gapped, data, offsets)

    def beginnings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place in ``at``) of the beginnings of some words; a whole word is another thing than a beginning."""
        out, of = [], []
        for k in BEGINNINGS:
            long = np.flatnonzero(self.lengths[at] > k)
            out.append(mix(_hashes(self.data, self.starts[at[long]], np.full(len(long), k)) ^ np.uint64(k)))
            of.append(long)
        return np.concatenate(out), np.concatenate(of)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of the distinct words and beginnings of each row, in this order; odd spellings count as the word they stand for."""
        doc = row_of(self.row)
        begun, of = self.beginnings(np.arange(len(doc)))
        rows = np.concatenate([doc, doc[of], self.spelled[1], self.gapped[1]])
        hashes = np.concatenate([self.hashes, begun, self.spelled[0], self.gapped[0]])
        order = np.lexsort((hashes, rows))
        rows, hashes = rows[order], hashes[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        return rows[new], hashes[new]

    def known(self, sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place) of the distinct hashes of each row that are in ``sorted_``, in this order; and which words are, by themselves or a beginning.

        Each distinct word of the rows is looked up once.
        """
        once, first, own = np.unique(self.hashes, return_index=True, return_inverse=True)
        begun, of = self.beginnings(first)
        word = np.concatenate([np.arange(len(once)), of])
        found, at = _member(sorted_, np.concatenate([once, begun]))
        order = np.argsort(word[found], kind="stable")
        word, at = word[found][order], at[found][order]
        n = np.bincount(word, minlength=len(once))
        places = np.flatnonzero(n[own] > 0)
        size = n[own[places]]
        pick = np.repeat((np.cumsum(n) - n)[own[places]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        rows, at = [np.repeat(row_of(self.row)[places], size)], [at[pick]]
        for hashes, doc in (self.spelled, self.gapped):
            found, place = _member(sorted_, hashes)
            rows.append(doc[found])
            at.append(place[found])
        both = np.unique(np.concatenate(rows) * (len(sorted_) + 1) + np.concatenate(at))
        hit = np.zeros(len(self.hashes), bool)
        hit[places] = True
        return both // (len(sorted_) + 1), both % (len(sorted_) + 1), hit


def _member(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each x is there, its place)."""
    if not len(sorted_):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return sorted_[at] == x, at


class Voters:
    """All voters; ``induced``: lexicons by hash, dealt out by it."""

    def __init__(self, induced: np.ndarray):
        lexicons = [word_hashes(w) for w in LEXICONS.values()] + [induced[induced % np.uint64(INDUCED) == i] for i in range(INDUCED)]
        self.words = np.unique(np.concatenate(lexicons))
        self.of = np.zeros((len(self.words), len(lexicons)), bool)
        for i, x in enumerate(lexicons):
            self.of[np.isin(self.words, x), i] = True
        self.learned = np.array([len(x) > 0 for x in lexicons[len(LEXICONS) :]])
        self.second, self.harmless = np.sort(word_hashes(SECOND_PERSON)), np.sort(word_hashes(HARMLESS))

    def votes(self, column: pa.Array) -> np.ndarray:
        """rows x voters: 0 for nothing, TOXIC or CLEAN."""
        w = Words.of(column)
        n, lex = len(w.offsets) - 1, self.of.shape[1]
        out = np.zeros((n, len(VOTERS)), np.uint8)
        vote = lambda name, rows, value: out.__setitem__((rows, VOTERS.index(name)), value)
        doc = row_of(w.row)
        rows, at, mask = w.known(self.words)
        for i in range(lex):
            out[rows[self.of[at, i]], i] = TOXIC
        hit = np.flatnonzero(mask)
        for i in np.flatnonzero(self.learned) + len(LEXICONS):
            out[out[:, i] == 0, i] = CLEAN
        for name, (hashes, rows) in (("spelled", w.spelled), ("gapped", w.gapped)):
            vote(name, rows[_member(self.words, hashes)[0]], TOXIC)
        second = _member(self.second, w.hashes)[0]
        for j in (1, 2, 3):
            back = hit[hit - j >= w.row[doc[hit]]]
            vote("addressed", doc[back[second[back - j]]], TOXIC)
        hits = np.bincount(doc[hit], minlength=n)
        vote("repeated", hits > 1, TOXIC)
        per_row = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.offsets])
        upper = per_row((w.data >= 65) & (w.data <= 90))
        letters = upper + per_row((w.data >= 97) & (w.data <= 122))
        vote("shouting", (letters >= 20) & (2 * upper > letters), TOXIC)
        bang = w.data == 33
        twice = np.zeros(len(bang), bool)
        twice[1:] = bang[1:] & bang[:-1]
        vote("banging", per_row(twice) > 0, TOXIC)
        vote("harmless", doc[_member(self.harmless, w.hashes)[0]], CLEAN)
        vote("no_hit", (hits == 0) & (out[:, VOTERS.index("spelled")] == 0) & (out[:, VOTERS.index("gapped")] == 0), CLEAN)
        vote("few_words", np.diff(w.row) < 5, CLEAN)
        return out


@dataclass
class LabelModel:
    """``share`` of label 1; ``table[i]``: label x parent's vote x own vote (the parent is -1 for a voter alone, whose rows are alike)."""

    share: float
    parent: list[int]
    table: np.ndarray  # voters x 2 x 3 x 3

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row of votes."""
        logit = np.full(len(votes), np.log(self.share) - np.log1p(-self.share))
        logs = np.log(self.table)
        for i, p in enumerate(self.parent):
            above = votes[:, p] if p >= 0 else np.zeros(len(votes), np.int64)
            logit += logs[i, 1, above, votes[:, i]] - logs[i, 0, above, votes[:, i]]
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))

    @classmethod
    def of(cls, pairs: np.ndarray, parent: list[int]) -> LabelModel:
        """From expected counts of pairs: label x voter x vote x voter x vote. A vote that was never seen counts as a tenth of a document."""
        k = pairs.shape[1]
        own = np.stack([np.diagonal(pairs[:, i, :, i, :], axis1=1, axis2=2) for i in range(k)])  # voters x 2 x 3
        total = own[0].sum(1)
        table = np.zeros((k, 2, 3, 3))
        for i in range(k):
            counts = pairs[:, parent[i], :, i, :] + 0.1 if parent[i] >= 0 else np.repeat(own[i][:, None] + 0.1, 3, axis=1)
            table[i] = counts / counts.sum(2, keepdims=True)
        return cls(float((total[1] + 0.5) / (total.sum() + 1)), parent, table)


def forest(pairs: np.ndarray, least: float) -> tuple[list[int], np.ndarray]:
    """(parent of each voter, conditional mutual information of all pairs): the forest of the largest information, of pairs with ``least`` or more."""
    k = pairs.shape[1]
    total = pairs[:, 0, :, 0, :].sum((1, 2))
    info = np.zeros((k, k))
    for y in range(2):
        if total[y] <= 0:
            continue
        p = pairs[y] / total[y]
        own = np.stack([np.diag(p[i, :, i, :]) for i in range(k)])
        expected = np.einsum("ia,jb->iajb", own, own)
        with np.errstate(divide="ignore", invalid="ignore"):
            info += total[y] / total.sum() * np.where(p > 0, p * np.log(p / np.maximum(expected, 1e-300)), 0).sum((1, 3))
    np.fill_diagonal(info, 0)
    near = {i: [] for i in range(k)}
    root = list(range(k))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, j in sorted(((i, j) for i in range(k) for j in range(i)), key=lambda e: -info[e]):
        if info[i, j] >= least and find(i) != find(j):
            root[find(i)] = find(j)
            near[i].append(j)
            near[j].append(i)
    parent, seen = [-1] * k, set()
    for top in range(k):
        stack = [] if top in seen else [top]
        seen.add(top)
        while stack:
            i = stack.pop()
            for j in near[i]:
                if j not in seen:
                    seen.add(j)
                    parent[j] = i
                    stack.append(j)
    return parent, info


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, k)


def expected_pairs(patterns: DataFrame, model: LabelModel | None, k: int) -> np.ndarray:
    """Label x voter x vote x voter x vote, summed over all documents; without a model a majority of the votes stands for the label."""
    shared = patterns.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 3 * k, 3 * k))
        for b in batches:
            votes, known, n = _matrix(b.column(0), k), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            if shared.value:
                p = shared.value.posterior(votes)
            else:
                p = 1 / (1 + np.exp(-2.0 * ((votes == TOXIC).sum(1) - 0.5 * (votes == CLEAN).sum(1) + 0.25)))
            p = np.where(known >= 0, known, p)
            one = (votes[:, :, None] == np.arange(3)).reshape(len(votes), 3 * k).astype(np.float64)
            for y, w in ((0, n * (1 - p)), (1, n * p)):
                total[y] += one.T @ (one * w[:, None])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "value"])

    sums = patterns.select("votes", "known", "n").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(2 * 9 * k * k)
    out[sums["at"].to_numpy()] = sums["value"].to_numpy()
    return out.reshape(2, k, 3, k, 3)


def label_model(patterns: DataFrame, k: int, training: Training = Training()) -> LabelModel:
    """Fitted to ``patterns`` (votes binary, known int: a label or -1, n long)."""
    model, parent = None, [-1] * k
    for step in range(training.steps):
        pairs = expected_pairs(patterns, model, k)
        if step >= training.alone:
            parent, _ = forest(pairs, training.least_information)
        model = LabelModel.of(pairs, parent)
    return model


def _share(h: str, share: Column) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(h)), F.lit(1 << 30)) < share * float(1 << 30)


def _word_counts(texts: DataFrame) -> DataFrame:
    """(word, pos, neg) of ``texts`` (p double, text): in how many a word is, weighed by p and by 1 - p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                rows, hashes = Words.of(b.column(1)).distinct()
                p = b.column(0).to_numpy()[rows]
                words, at = np.unique(hashes, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.bincount(at, p, len(words))), pa.array(np.bincount(at, 1 - p, len(words)))], ["word", "pos", "neg"])

    return texts.select("p", "text").mapInArrow(run, "word long, pos double, neg double").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _telling(counts: DataFrame, pos: float, neg: float, most: int, least_z: float, least_odds: float | None = None) -> np.ndarray:
    """The words whose presence tells the classes apart most surely, ``most`` at most; with ``least_odds`` only those of class 1 with such log odds."""
    odds = lambda c, n: F.log((F.col(c) + 0.5) / F.greatest(F.lit(float(n)) - F.col(c) + 0.5, F.lit(0.5)))
    both = odds("pos", pos) - odds("neg", neg)
    z = both / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    scored = counts.filter(F.col("pos") + F.col("neg") >= 4).withColumn("z", F.abs(z) if least_odds is None else z).withColumn("odds", both).filter(F.col("z") >= least_z)
    if least_odds is not None:
        scored = scored.filter(F.col("odds") >= least_odds)
    got = scored.orderBy(F.col("z").desc(), "word").limit(most).select("word").toArrow()["word"].to_numpy()
    return np.sort(got.astype(np.int64).view(np.uint64))


@dataclass
class Model:
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def scores(self, column: pa.Array) -> np.ndarray:
        w = Words.of(column)
        rows, at, _ = w.known(self.words)
        logit = self.bias + np.bincount(rows, self.weights[at], len(column))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _logistic(row: np.ndarray, col: np.ndarray, k: int, target: np.ndarray, share: float, training: Training) -> tuple[np.ndarray, float]:
    """Weights and bias of a sparse logistic regression on soft targets, by proximal gradient steps with momentum.

    Rows called 1 weigh ``share`` together, others the rest, so that the probabilities are those of all documents.
    """
    n, one = len(target), target >= 0.5
    weight = np.where(one, share / one.sum(), (1 - share) / (~one).sum())
    # The largest curvature by power iteration, over the words and the bias.
    v, v_bias, top = np.ones(k), 1.0, 1.0
    for _ in range(20):
        u = (np.bincount(row, v[col], n) + v_bias) * weight
        v, v_bias = np.bincount(col, u[row], k), u.sum()
        top = np.sqrt((v * v).sum() + v_bias**2)
        v, v_bias = v / top, v_bias / top
    step = 3.5 / max(top, 1e-9)
    w, bias, ahead, b_ahead, t = np.zeros(k), np.log(share / (1 - share)), np.zeros(k), np.log(share / (1 - share)), 1.0
    for _ in range(training.rounds):
        g = (1 / (1 + np.exp(-np.clip(np.bincount(row, ahead[col], n) + b_ahead, -30, 30))) - target) * weight
        new = ahead - step * np.bincount(col, g[row], k)
        new = np.sign(new) * np.maximum(np.abs(new) - step * training.sparsity, 0)
        b_new = b_ahead - step * g.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, b_ahead = new + (t - 1) / t_new * (new - w), b_new + (t - 1) / t_new * (b_new - bias)
        w, bias, t = new, b_new, t_new
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, training: Training = Training(), scratch: Scratch | None = None) -> Model:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic, of the documents whose labels may be learned from. Deterministic."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    docs = docs.select("doc_id", "text")
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("known"))
    n_of = {r["known"]: r["n"] for r in known.groupBy("known").agg(F.count("*").alias("n")).collect()}
    induced = np.zeros(0, np.uint64)
    if len(n_of) == 2:
        share = F.when(F.col("known") == 1, min(1.0, training.per_label / n_of[1])).otherwise(min(1.0, training.per_label / n_of[0]))
        few = known.filter(_share("induced", share))
        texts = scratch.table(docs.join(F.broadcast(few), "doc_id").select(F.col("known").cast("double").alias("p"), "text"), "labelled")
        size = {r["p"]: r["n"] for r in texts.groupBy("p").agg(F.count("*").alias("n")).collect()}
        induced = _telling(_word_counts(texts), size.get(1.0, 0), size.get(0.0, 0), training.induced, training.least_z, training.least_odds)
        scratch.drop(texts)
    shared, k = spark.sparkContext.broadcast(Voters(induced)), len(VOTERS)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                v = shared.value.votes(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v], pa.binary())], ["doc_id", "votes"])

    schema = StructType([docs.schema["doc_id"], *StructType().add("votes", "binary").fields])
    cast = scratch.table(docs.mapInArrow(vote, schema), "votes")
    voted = scratch.table(cast.join(known, "doc_id", "left").select("doc_id", "votes", F.coalesce("known", F.lit(-1)).alias("known")), "known")
    patterns = scratch.table(voted.groupBy("votes", "known").agg(F.count("*").alias("n")), "patterns")
    scratch.drop(cast)
    model = spark.sparkContext.broadcast(label_model(patterns, k, training))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column(1).to_numpy(zero_copy_only=False)
            p = np.where(given >= 0, given, model.value.posterior(_matrix(b.column(0), k))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), b.column(2)], ["votes", "known", "p", "n"])

    judged = scratch.table(patterns.mapInArrow(judge, "votes binary, known int, p double, n long"), "judged")
    of = {r["t"]: r["n"] for r in judged.groupBy((F.col("p") >= 0.5).alias("t")).agg(F.sum("n").alias("n")).collect()}
    if len(of) < 2:
        total = sum(of.values())
        share = (of.get(True, 0) + 0.5) / (total + 1)
        return Model(bias=float(np.log(share / (1 - share))))
    share = F.when(F.col("p") >= 0.5, min(1.0, training.per_class / of[True])).otherwise(min(1.0, training.per_class / of[False]))
    few = voted.filter("doc_id is not null").join(judged.select("votes", "known", "p"), ["votes", "known"]).filter(_share("classes", share)).groupBy("doc_id").agg(F.max("p").alias("p"))
    few = scratch.table(few, "few")
    texts = scratch.table(docs.join(F.broadcast(few), "doc_id").select("doc_id", "p", "text"), "sample")
    size = texts.agg(F.sum("p").alias("pos"), F.count("*").alias("n")).first()
    words = _telling(_word_counts(texts), size["pos"] or 0, size["n"] - (size["pos"] or 0), training.words, training.word_z)
    chosen = spark.sparkContext.broadcast(words)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                rows, at, _ = Words.of(b.column(2)).known(chosen.value)
                cut = np.searchsorted(rows, np.arange(b.num_rows + 1))
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(at.astype(np.int32)))], ["doc_id", "p", "at"])

    got = texts.mapInArrow(lay, "doc_id string, p double, at array<int>").orderBy("doc_id", "p", "at").toArrow()
    scratch.drop(texts, few, voted, patterns, judged)
    target, lists = got["p"].to_numpy(), got["at"].combine_chunks()
    if not len(target) or not (target >= 0.5).any() or (target >= 0.5).all():
        return Model(bias=float(np.log((of[True] + 0.5) / (of[False] + 0.5))))
    row = np.repeat(np.arange(len(target)), lists.value_lengths().to_numpy())
    w, bias = _logistic(row, lists.flatten().to_numpy(), len(words), target, of[True] / (of[True] + of[False]), training)
    kept = w != 0
    return Model(words[kept], w[kept], bias)


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

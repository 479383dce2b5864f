import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repolens.llm import toxicity as X
from repolens.llm.queries import held_out, op12_toxicity
from tests.llm.test_quality_cnn import auc

STANDS = str.maketrans(X.STAND_INS)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTER = "A-Za-z\x80-\U0010ffff"


def features(text):
    """The words and beginnings of a text, by plain loops."""
    text = text or ""
    words = [w.translate(LOWER).encode() for w in re.findall(f"[{LETTER}]+", text)]
    out = {("w", w) for w in words} | {("b", w[:k]) for w in words for k in X.BEGINNINGS if len(w) > k}
    for w in re.findall(f"[{LETTER}{re.escape(''.join(X.STAND_INS))}]+", text):
        if any(c in X.STAND_INS for c in w) and not all(c in X.STAND_INS for c in w) and len(w.encode()) < 40:
            out.add(("w", w.translate(LOWER).translate(STANDS).encode()))
    for m in re.finditer(f"(?s)(?<![{LETTER}])[A-Za-z](?:[^{LETTER}][A-Za-z])+(?![{LETTER}])", text):
        letters = re.findall("[A-Za-z]", m[0])
        # what stands between is one byte
        if len(letters) >= 4 and len(m[0].encode()) == 2 * len(letters) - 1:
            out.add(("w", "".join(letters).translate(LOWER).encode()))
    return out


def code(kind, word):
    h = X.word_hashes(word.decode("utf-8", "surrogateescape")) if kind == "w" else None
    return h[0]


TEXTS = ["", None, "a", "You IDIOT! you, you", "i d i o t", "x i.d.i.o.t, y", "1d10t w0rld $tupid 123 $", "é à ü ö", "Über größe", "a b c d\na b", "don't  a-b-c-d-e", "I a m b é c d", "worthless " * 3 + "trash1", "!!! HELLO WORLD THIS IS LOUD"]


def test_words_equal_plain_loops():
    got = X.Words.of(pa.array(TEXTS))
    rows, hashes = got.distinct()
    for i, t in enumerate(TEXTS):
        own = set(hashes[rows == i].tolist())
        want = features(t)
        assert len(own) == len(want), t
        assert {int(code(k, w)) for k, w in want if k == "w"} <= own
    vocabulary = np.unique(hashes)[::2]
    r, at, hit = got.known(vocabulary)
    keep = np.isin(hashes, vocabulary)
    assert (r == rows[keep]).all() and (vocabulary[at] == hashes[keep]).all() and len(hit) == len(got.hashes)


def test_votes():
    voters = X.Voters(X.word_hashes("chrak blurg"))
    votes = voters.votes(pa.array(["You are an idiot and a moron", "idiot", "1d1ot", "i.d.i.o.t", "a calm text about the sea", "", "SHOUTING ALL OF THE TIME HERE!!", "Licensed under the terms of it", "Blurg it is as they said"]))
    name = lambda i, v: {n for n, x in zip(X.VOTERS, votes[i], strict=True) if x == v}
    assert name(0, X.TOXIC) == {"insults_en", "insults_de", "addressed", "repeated"} and "insults_en" in name(1, X.TOXIC) and "repeated" not in name(1, X.TOXIC)
    assert name(2, X.TOXIC) == {"spelled", "insults_en", "insults_de"} and name(3, X.TOXIC) == {"gapped", "insults_en", "insults_de"}
    assert "no_hit" in name(4, X.CLEAN) and not name(4, X.TOXIC) and {"no_hit", "few_words"} <= name(5, X.CLEAN)
    assert name(6, X.TOXIC) == {"shouting", "banging"} and "harmless" in name(7, X.CLEAN)
    assert len([n for n in name(8, X.TOXIC) if n.startswith("induced")]) == 1


def patterns_of(spark, votes, known):
    rows = {}
    for v, y in zip(votes, known, strict=True):
        rows[v.tobytes(), int(y)] = rows.get((v.tobytes(), int(y)), 0) + 1
    return spark.createDataFrame([(bytearray(v), y, n) for (v, y), n in rows.items()], "votes binary, known int, n long")


def test_label_model_finds_accuracies_and_correlation(spark):
    """Votes drawn from a known model: voters 0 and 1 copy each other, the others are independent given the label."""
    r = np.random.default_rng(8)
    n = 20_000
    y = (r.random(n) < 0.2).astype(int)
    accuracy = [0.85, 0.85, 0.9, 0.75, 0.8, 0.7]
    votes = np.zeros((n, 6), np.uint8)
    for i, a in enumerate(accuracy):
        right = r.random(n) < a
        votes[:, i] = np.where(right == (y == 1), X.TOXIC, X.CLEAN)
        votes[r.random(n) < 0.2, i] = 0
    copied = r.random(n) < 0.8
    votes[copied, 1] = votes[copied, 0]
    training = X.Training(steps=32)
    model = X.label_model(patterns_of(spark, votes, np.full(n, -1)), 6, training)
    assert abs(model.share - 0.2) < 0.04
    assert model.parent.count(-1) == 5 and (model.parent[0] == 1 or model.parent[1] == 0)
    for i in (2, 3, 4, 5):
        t = model.table[i][:, 0]
        assert abs(t[1, X.TOXIC] / (1 - t[1, 0]) - accuracy[i]) < 0.06 and abs(t[0, X.CLEAN] / (1 - t[0, 0]) - accuracy[i]) < 0.04
    p = model.posterior(votes)
    # nothing is much better than the true model's own posterior
    assert ((p >= 0.5) == (y == 1)).mean() > 0.93
    # with labels for a part of the rows, those are taken as they are
    given = np.where(r.random(n) < 0.3, y, -1)
    assert abs(X.label_model(patterns_of(spark, votes, given), 6, training).share - y.mean()) < 0.03


def test_expected_pairs_equal_plain_sums(spark):
    r = np.random.default_rng(2)
    votes, known = r.integers(0, 3, (200, 4)).astype(np.uint8), r.integers(-1, 2, 200)
    model = X.LabelModel(0.3, [-1, 0, 1, -1], r.dirichlet([1, 1, 1], (4, 2, 3)))
    got = X.expected_pairs(patterns_of(spark, votes, known), model, 4)
    want = np.zeros((2, 4, 3, 4, 3))
    for v, k in zip(votes, known, strict=True):
        like = []
        for y, share in ((0, 0.7), (1, 0.3)):
            for i, p in enumerate(model.parent):
                share *= model.table[i, y, v[p] if p >= 0 else 0, v[i]]
            like.append(share)
        p1 = k if k >= 0 else like[1] / sum(like)
        for i in range(4):
            for j in range(4):
                want[0, i, v[i], j, v[j]] += 1 - p1
                want[1, i, v[i], j, v[j]] += p1
    assert np.allclose(got, want)


def test_scores_equal_plain_loops():
    words = X.word_hashes("idiot trash worthless the imbécil abcde")
    order = np.argsort(words)
    weights = np.arange(1.0, 7.0)
    model = X.Model(words[order], weights[order], -2.0)
    texts = TEXTS + ["the trash the trash", "T R A S H", "imbécil imbécile"]
    by = dict(zip("idiot trash worthless the imbécil abcde".split(), weights, strict=True))
    for t, got in zip(texts, model.scores(pa.array(texts)), strict=True):
        logit = -2 + sum(v for w, v in by.items() if ("w", w.encode()) in features(t))
        assert got == pytest.approx(1 / (1 + np.exp(-logit)))


def test_odd_rows(spark):
    rows = [(None, "idiot"), (1, None), (1, None), (2, ""), (3, "You are an idiot"), (3, "You are an idiot"), (4, "good day to all of you here " * 20_000), (5, "Ein Satz ohne Sinn und Ziel")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as votes", "1 as known", "2 as p", "3 as score", "4 as word")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(3, 1), (3, 1), (4, 0), (None, 1), (9, 1), (5, 2), (2, None)], "doc_id long, toxic int")):
        model = X.fit(docs, labels)
        got = X.score(docs, model, "doc_id").collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and got[4].score == got[5].score
    assert X.score(docs.limit(0), X.fit(docs.limit(0), none), "doc_id").count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_query(spark, sf):
    got = op12_toxicity(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("own", held_out())
    rows = got.join(labels, "doc_id").filter(F.col("held_out") & F.col("own")).toPandas()
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert auc(rows.score.to_numpy(), rows.toxic.to_numpy()) > 0.95
    assert (rows.predicted == rows.toxic).mean() > 0.97

import numpy as np
import pytest

from repolens.llm import langid as L
from repolens.llm.queries import op1_langid


@pytest.mark.parametrize("n", [1, 2, 4, 6, 7, 30])
def test_codewords_differ(n):
    code = L.codewords(n)
    assert len({tuple(r) for r in code}) == n
    if n > 2:
        assert all(len(set(c)) == 2 for c in code.T)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op1_langid(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert len(held) > 100
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_rows_and_edges(spark):
    train = spark.createDataFrame([(i, t, l, "x") for i in range(30) for t, l in [(f"the cat and the hat {i}", "en"), (f"der hund und die katze {i}", "de")]] + [(1, None, "en", "x"), (2, "la la", None, "x")], "doc_id long, text string, lang string, score string")
    model = L.fit(train)
    assert model.languages == ["de", "en"]
    texts = [None, "", "12 !?", "the hat and the cat", "und der hund", "the hat " * 50_000, "der hund", "der hund", "é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in L.predict(docs, model, "doc_id").collect()}
    assert [got[i].lang_pred for i in range(8)] == ["und", "und", "und", "en", "de", "en", "de", "de"]
    assert got[0].ambiguous and got[0].score == 0 and not got[3].ambiguous
    assert got[6][1:] == got[7][1:]
    assert L.predict(docs.limit(0), model, "doc_id").count() == 0
    none = L.fit(train.limit(0))
    assert {r.lang_pred for r in L.predict(docs, none, "doc_id").collect()} == {"und"}


def predicted_by_loops(model, text):
    """(language, score) gram by gram: margins of all bits, then the loss of each codeword."""
    import math

    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    grams = [low[i : i + k] for k in (1, 2, 3, 4) for i in range(len(low) - k + 1)]
    mask = (1 << 64) - 1

    def feature(gram):
        x = (int.from_bytes(gram, "big") + (len(gram) << 40)) & mask
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return (x ^ x >> 31) & L.DIM - 1

    bits = model.code.shape[1]
    margin = [sum(float(model.weights[feature(g), j]) for g in grams) / max(len(grams), 1) + float(model.bias[j]) for j in range(bits)]
    loss = [sum(math.log1p(math.exp(-m * int(c))) for m, c in zip(margin, word)) for word in model.code]
    best = min(range(len(loss)), key=loss.__getitem__)
    return model.languages[best], 1 / sum(math.exp(loss[best] - x) for x in loss)


def test_predictions_equal_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.fit(docs.filter("doc_id % 5 <> 0"))
    assert len(model.languages) == 4
    texts = {r.doc_id: r.text for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    got = {r.doc_id: r for r in L.predict(docs, model, "doc_id").collect()}
    for i in sorted(texts, key=lambda i: len(texts[i]))[:120]:
        language, score = predicted_by_loops(model, texts[i])
        assert got[i].lang_pred == language and abs(got[i].score - score) < 1e-6

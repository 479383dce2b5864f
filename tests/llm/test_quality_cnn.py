import numpy as np
import pyarrow as pa

from repolens.llm import quality_cnn as Q
from repolens.llm.queries import op5_quality_cnn


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    p = label == 1
    return (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


def test_chunks_overlap_and_cover():
    for n in (0, 1, 7, 511, 512, 513, 960, 961, 5000):
        data = np.arange(n).astype(np.uint8)
        block, length, row = Q.chunks(data, np.array([0, n]))
        seen = np.zeros(n, bool)
        for j in range(row[-1]):
            seen[j * Q.STEP : j * Q.STEP + length[j]] = True
            assert (block[j, : length[j]] == data[j * Q.STEP : j * Q.STEP + length[j]]).all()
        assert seen.all() and (n > 0 or row[-1] == 0)
        assert all(length > 0)


def test_pooling_equals_brute_force():
    rng = np.random.default_rng(1)
    tables = rng.normal(0, 1, (Q.WIDTH, 256, 3)).astype(np.float32)
    text = bytes(rng.integers(32, 120, 700).astype(np.uint8))
    block, length, _ = Q.chunks(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    got, _ = Q.pooled(tables, block, length)
    for j in range(len(block)):
        for f in range(3):
            places = range(0, max(1, length[j] - Q.WIDTH + 1))
            assert np.isclose(got[j, f], max(0, max(sum(tables[k, block[j, i + k], f] for k in range(Q.WIDTH)) for i in places)), atol=1e-4)


def score_by_loops(model, text):
    """The whole score, place by place: windows of each chunk of 512 bytes, begun every 448, that hold no byte of another."""
    data = text.encode()
    best = []
    for start in range(0, len(data), 448):
        chunk = data[start : start + 512]
        if start and len(chunk) <= 512 - 448:
            break  # the chunk before has it all
        padded = chunk + bytes(max(0, 8 - len(chunk)))
        best.append([max(0.0, max(sum(float(model.tables[k, padded[i + k], f]) for k in range(8)) for i in range(len(padded) - 7))) for f in range(model.tables.shape[2])])
    logit = model.bias
    if best:
        for f in range(model.tables.shape[2]):
            column = [b[f] for b in best]
            logit += sum(column) / len(column) * model.mean[f] + max(column) * model.most[f]
    return 1 / (1 + np.exp(-logit))


def test_scores_equal_plain_loops_and_every_byte_counts():
    rng = np.random.default_rng(6)
    model = Q.Model(rng.normal(0, 0.3, (8, 256, 2)).astype(np.float32), rng.normal(0, 1, 2), rng.normal(0, 1, 2), 0.1)
    texts = ["", "a", "abcdefg", "abcdefgh", "abcdefghi", *["".join(map(chr, rng.integers(32, 126, n))) for n in (509, 511, 512, 513, 575, 576, 577, 960, 961, 1500)], "é" * 300]
    got = model.scores(pa.array(texts))
    assert np.allclose(got, [score_by_loops(model, t) for t in texts], atol=1e-4)
    loud = np.zeros((8, 256, 1), np.float32)
    loud[:, ord("!")] = 1
    heard = Q.Model(loud, np.zeros(1), np.ones(1), 0.0)
    for n in (1, 7, 8, 9, 509, 511, 513, 960, 961, 1023):
        texts = ["a" * i + "!" + "a" * (n - 1 - i) for i in range(n)]
        assert (heard.scores(pa.array(texts)) > 0.7).all()


def test_held_out_auc(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op5_quality_cnn(spark, sf).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert auc(np.array([r.score for r in held]), np.array([labels[r.doc_id] for r in held])) >= 0.95


def test_rows_and_whole_texts(spark):
    train = spark.createDataFrame([(i, "good words here and there " * 4, 1) for i in range(40)] + [(100 + i, "bad$$$ bad### " * 6, 0) for i in range(40)] + [(900, None, 1), (901, "x", None)], "doc_id long, text string, quality int")
    model = Q.fit(train.drop("quality"), train)
    texts = [None, "", "good words here and there " * 4, "bad$$$ bad### " * 6, "good words here and there " * 4 + "bad$$$ bad### " * 6, "g", "good words here " * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as score").repartition(2)
    got = {r.doc_id: r.score for r in Q.score(docs, model, "doc_id").collect()}
    assert got[0] == got[1] and got[2] > 0.7 and got[3] < 0.3
    assert got[4] < got[2]
    assert Q.score(docs.limit(0), model, "doc_id").count() == 0
    one = Q.fit(train, train.filter("quality = 1"))
    assert len({r.score for r in Q.score(docs.filter("doc_id < 2"), one, "doc_id").collect()}) == 1
    assert len(model.scores(pa.array([], pa.string()))) == 0


def test_the_sample_is_bounded_in_bytes(spark):
    rows = [(i, "w" * (3000 if i % 3 else 60_000), i % 2) for i in range(60)] + [(99, "z" * 900_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    sample = lambda bound: Q._sample(df, df, Q.Training(bytes=bound), "text", "doc_id", "quality")[0]
    few, all_ = sample(200_000), sample(64 << 20)
    assert len(all_) == 61
    for y in (0, 1):
        assert 0 < sum(len(c) for k, c in few if k == y) <= 100_000
    whole = {(y, c) for y, c in all_}
    assert all(r in whole for r in few)  # documents are whole or absent
    assert few == sample(200_000)
    assert sample(0) == []

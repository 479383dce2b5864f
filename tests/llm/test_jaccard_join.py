import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolens.llm import jaccard_join as J
from repolens.llm.components import components
from repolens.llm.queries import op2_jaccard_join
from repolens.llm.scratch import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """doc_id -> (size, component) by all pairs; rows of equal doc_id count as one document's texts."""
    sets = []
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def link(a, b, both):
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(rows[a][0]), find(rows[b][0])
            root[max(x, y)] = min(x, y)

    by = {}
    for n, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(n)
    for a, s in enumerate(sets):
        both_of = Counter(b for x in s for b in by[x] if b > a)
        for b, both in both_of.items():
            link(a, b, both)
    return sorted((i, len(s), find(i)) for (i, _), s in zip(rows, sets))


def variants(rng, words, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], [rng.choice("xyzuv") * 3], [w[at], "new"]])
        out.append(" ".join(w))
    return out


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = ["", None, " \n ", "a", "A", "a b", "a b c d e", "A B C D E", "é É", "a b c d e f"]
    passage = [word() for _ in range(40)]
    for size in (6, 9, 14, 20, 33, 60, 130, 400, 1500):
        for _ in range(6):
            base = [word() for _ in range(size)]
            texts += variants(rng, base, 6, max(1, size // 18)) + variants(rng, base, 3, max(1, size // 8))
        for _ in range(12):
            own = [word() for _ in range(size)]
            texts.append(" ".join(own[: size // 2] + passage + own[size // 2 :]))
    base = [word() for _ in range(100)]
    texts += variants(rng, base, 150, 3) + [" ".join(base)] * 40
    rng.shuffle(texts)
    return [*enumerate(texts)]


def test_equals_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as sid").repartition(7)
    assert sorted(map(tuple, J.near_duplicates(df).collect())) == brute(rows)


def test_repeated_rows(spark):
    """Rows of equal doc_id and text are one set, and its rarest blocks are counted once."""
    rows = corpus()
    rows += [r for r in rows if r[0] % 3 == 0] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, J.near_duplicates(df).collect())) == brute(rows)


@pytest.mark.parametrize("n", [200, 800])
def test_a_passage_of_all_documents_makes_no_pairs(spark, n, monkeypatch):
    """Where a third to a half of each document is one passage, no more documents enter the comparison within groups than there are.

    Where the passage is most of each document, comparisons within a group do grow with its square: see the README.
    """
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(rng.randint(60, 120))] + passage)) for i in range(n)]
    held, real = [], J._across
    monkeypatch.setattr(J, "_across", lambda members, *a: held.append(members.count()) or real(members, *a))
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert held[0] <= n


def test_a_large_group_of_far_copies(spark):
    """Copies of one text with up to a fifth of their words changed: some link with the others and some don't."""
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(120)]
    rows = [*enumerate(variants(rng, base, 700, 9))]
    got = sorted(map(tuple, J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()))
    assert got == brute(rows)
    assert len({c for _, _, c in got}) > 20


def test_query(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
        assert sorted(map(tuple, op2_jaccard_join(spark, f"/root/testdata/{sf}").collect())) == brute(rows)


def test_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (3, text), (7, None), (7, "other words")], "doc_id long, text string")
    got = sorted(map(tuple, J.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 26, None), (5, 26, 3), (5, 26, 3), (3, 26, 3), (7, 0, 7), (7, 1, 7)], key=str)
    assert J.near_duplicates(df.limit(0)).count() == 0


def test_sketches_are_lower_bounds():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 100, 127, 128, 900):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(0.9 * n)], rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)]))
        row = np.array([0, len(a), len(a) + len(b)])
        bits, at = J.sketches(np.concatenate([a, b]), row)
        bits = bits.view(np.uint64)
        x, y = bits[at[0] : at[1]], bits[at[1] : at[2]]
        for _ in range(2):
            fold = lambda v, size: v[:size] ^ v[size:] if len(v) > size else v
            size = min(len(x), len(y))
            x, y = fold(x, size), fold(y, size)
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
            x, y = (fold(v, max(1, len(v) // 2)) for v in (x, y))


def test_folding_is_the_same_in_columns(spark):
    rng = np.random.default_rng(4)
    x, y = ([int(v) for v in rng.integers(-(1 << 63), 1 << 63, n)] for n in (8, 4))
    df = spark.createDataFrame([(x, y, 7)], "x array<long>, y array<long>, band int")
    got = df.select(J._hamming(J._folded(F.col("x"), J._width()), J._folded(F.col("y"), J._width())).alias("h")).first()["h"]
    assert got == sum(((a ^ b ^ c) & (1 << 64) - 1).bit_count() for a, b, c in zip(x[:4], x[4:], y))


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(200)] + [(7, 7), (-5, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()
    assert {r.node: r.label for r in got} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0

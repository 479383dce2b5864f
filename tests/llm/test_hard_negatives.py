
import itertools
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from repolens.llm import hard_negatives as N
from repolens.llm.queries import OP11_SQL, op11_hard_negatives
from repolens.llm.scratch import Scratch


def brute(rows, step=100, positives=5, negatives=10):
    """All pairs, in plain Python; ``rows``: id, label, vector of whole numbers."""
    least = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and None not in v:
            least[i] = min(least.get(i, (label, v)), (label, v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (label, v) in least.items():
        if a % step:
            continue
        score = {i: dot(v, w) for i, (_, w) in least.items() if i != a}
        first = lambda ids, n: sorted(ids, key=lambda i: (-score[i], i))[:n]
        for p in first([i for i in score if least[i][0] == label], positives):
            fit = [i for i in score if least[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, n, i, score[p], score[i]) for n, i in enumerate(first(fit, negatives), 1)]
    return sorted(out)


def run(spark, rows, step=100, **more):
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<int>")
    return sorted(map(tuple, N.mine(df, F.col("vec_id") % step == 0, **more).collect()))


def test_equals_all_pairs(spark):
    r = np.random.default_rng(3)
    centre = r.normal(0, 30, (6, 8))
    rows = [(i, int(r.integers(0, 3)), [int(x) for x in centre[i % 6] + r.normal(0, 12, 8)]) for i in range(900)]
    # many rows of one vector, more than an anchor can name, and ties between labels
    rows += [(1000 + i, i % 2, [40] * 8) for i in range(300)]
    want = brute(rows, 10)
    assert len({x[0] for x in want}) > 60
    for lists in (N.Lists(), N.Lists(block=16, batch=4, first=1, grow=2), N.Lists(values=200, most_lists=3), N.Lists(most_lists=1)):
        assert run(spark, rows, 10, lists=lists) == want


def test_odd_rows(spark):
    big = 1 << 22
    rows = [(0, 1, [3, 4]), (0, 2, [9, 9]), (0, 1, [3, 4]), (1, 1, [5, 6, 7]), (2, 1, []), (3, 2, [1, 3]), (4, 2, [2, 2]), (5, None, [1, 1]), (None, 1, [1, 1]), (6, 2, None), (100, 2, [-1, -1]), (200, 3, [big, -big]), (201, 3, [big, -big]), (202, 4, [big // 2, -big // 2])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[3:5]) == [] and run(spark, []) == []
    same = [(i, i % 2, [7, 7]) for i in range(250)]
    assert run(spark, same) == brute(same) == []


def test_search_skips_and_stops(spark):
    """Of well separated lists an anchor visits few, and those outside of its window not at all."""
    rows = [(100 * c + i, c, [1000 * (c == d) + i % 3 for d in range(16)]) for c in range(16) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<int>")
    index = N.Index.build(df, 5, N.Lists(first=16))
    seen = []
    table = index.scratch.table

    def watch(frame, name):
        out = table(frame, name)
        if name == "visits":
            seen.append(out.count())
        return out

    index.scratch.table = watch
    anchor = index.rows.filter("vec_id = 0").select(F.col("vec_id").alias("anchor_id"), "label", "v")
    near = anchor.withColumn("windows", F.expr("array(named_struct('slot', 0, 'lo', 500000L, 'hi', 2000000L))"))
    got = index.search(near, 5, True).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == sorted([i for i in range(1, 50)], key=lambda i: (-1000 * (1000 + i % 3), i))[:5]
    assert sum(seen) < len(index.centroids)


def test_lists_of_many_bunches(spark):
    """Rows of one list lie in many blocks; an anchor is sent to each bunch of them."""
    r = np.random.default_rng(5)
    rows = [(i, int(r.integers(0, 3)), [int(x) for x in r.normal(0, 20, 6)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<int>")
    lists = N.Lists(most_lists=2, block=8, bunch=3, batch=4)
    index = N.Index.build(df, 10, lists)
    assert index.bunches.min() > 2 and index.blocks.select("cluster", "bunch").distinct().count() == index.bunches.sum()
    assert run(spark, rows, 10, lists=lists) == brute(rows, 10)


def test_anchors_are_not_broadcast(spark):
    """What is broadcast has a row for each list at most; anchors and their hits, however small, are not."""
    plans = {}

    class Watched(Scratch):
        def table(self, df, name):
            plans[f"{name} {len(plans)}"] = plan(df)
            return super().table(df, name)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    rows = [(i, i % 3, [i % 7, i % 11, 5]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<int>")
    plans["result"] = plan(N.mine(df, F.col("vec_id") % 10 == 0, scratch=Watched(spark)))
    assert sum(x.startswith("found") for x in plans) >= 2
    for name, text in plans.items():
        lines = text.split("\n")
        for at, line in enumerate(lines):
            if "BroadcastExchange" in line:
                depth = lines[at].index("BroadcastExchange")
                below = [x for x in itertools.takewhile(lambda x: re.search(r"\w", x) and re.search(r"\w", x).start() > depth, lines[at + 1 :])]
                assert below and not [x for x in below if "FileScan" in x], (name, text)


def test_quantized(spark):
    rows = [(0, [0.5, -0.001, 1e300, -1e300]), (1, [float("nan")]), (2, [float("inf"), 0.0]), (3, [None, 0.1]), (4, None), (5, [])]
    got = spark.createDataFrame(rows, "i int, e array<double>").select("i", N.quantized(F.col("e")).alias("v")).collect()
    assert {r.i: r.v for r in got} == {0: [128, -1, 1 << 22, -(1 << 22)], 1: None, 2: None, 3: None, 4: None, 5: []}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_query_equals_sql(spark, sf):
    got = op11_hard_negatives(spark, sf)
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = db.sql(OP11_SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())

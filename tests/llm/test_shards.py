from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from repolens.llm import shards as H
from repolens.llm.queries import op6_shards
from repolens.llm.scratch import new_path


def test_append_compact_read_vacuum(spark):
    df = spark.range(1000).selectExpr("id as doc_id", "repeat('x', 50) as shard", "cast(null as string) as n")
    store = H.Store(spark, new_path(spark, "s"), H.Policy(least=2000, target=20_000, fan_in=3))
    assert store.manifest() == (0, []) and store.read(df.schema).count() == 0
    for i in range(4):
        store.append(df.filter(f"doc_id % 4 = {i}").repartition(2))
    version, before = store.manifest()
    assert version == 4 and len(before) == 8
    assert store.compact(df.schema) == 5
    after = store.manifest()[1]
    assert len(after) < len(before) and not store.plan(after)
    assert sorted(r.doc_id for r in store.read(df.schema).collect()) == list(range(1000))
    assert store.read(df.schema, 2).count() == 500  # older versions read as they were
    assert store.compact(df.schema) == 5
    assert store.vacuum() == 8
    assert store.read(df.schema).count() == 1000
    assert store.append(df.limit(0)) == 6 and store.read(df.schema).count() == 1000


def test_one_of_two_writers_wins(spark):
    store = H.Store(spark, new_path(spark, "s"))
    df = spark.range(3)
    store.append(df)
    with pytest.raises(H.Conflict):
        store._commit(1, [])
    assert store.read(df.schema).count() == 3 and store.versions() == [1]


def test_vacuum_spares_what_a_writer_may_still_commit(spark):
    store, df = H.Store(spark, new_path(spark, "s")), spark.range(3)
    store.append(df)
    version, shards = store.manifest()
    pending = store._write(df, version + 1)  # another writer's, not yet committed
    assert store.vacuum() == 0
    assert store._commit(version + 1, shards + pending) == 2
    assert store.read(df.schema).count() == 6
    late = store._write(df, version + 1)  # of a writer whose version now exists
    assert store.vacuum() == len(late) and store.read(df.schema).count() == 6


def test_rows_as_they_come(spark):
    store = H.Store(spark, new_path(spark, "s"))
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "x" * 300_000, "b")], "doc_id long, text string, shard string")
    store.append(df)
    store.append(df.limit(0))
    with pytest.raises(ValueError, match="shard"):
        store.read_with_shard(df.schema)
    got = store.read_with_shard(df.schema, name="file")
    assert sorted(map(tuple, got.drop("file").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert got.filter("file like 'data%' or file like '0%'").count() == 3


def test_arrivals_are_staged_in_one_pass_and_adopted_in_order(spark, monkeypatch):
    df = spark.sql("select id as doc_id, 'x' as __arrival, if(id % 10 = 9, null, 11 - id % 10) as a from range(100)").repartition(3)
    store = H.Store(spark, new_path(spark, "s"))
    staged = store.stage(df, F.col("a"))
    assert len(staged) == 10 and store.manifest() == (0, [])
    seen = []
    for i, s in enumerate(staged):
        assert store.adopt(s) == i + 1
        now = {r.a for r in store.read(df.schema).collect()}
        seen += now - set(seen)
    assert seen == [3, 4, 5, 6, 7, 8, 9, 10, 11, None]
    key = lambda r: r.doc_id
    assert sorted(store.read(df.schema).collect(), key=key) == sorted(df.collect(), key=key)
    assert store.stage(df.limit(0), F.col("a")) == []
    (again,) = store.stage(df, F.lit(0))
    version = store.manifest()
    monkeypatch.setattr(store, "manifest", lambda: (version[0] - 1, version[1]))  # another writer was first
    with pytest.raises(H.Conflict):
        store.adopt(again)
    monkeypatch.undo()
    assert store.read(df.schema).count() == 100
    store.adopt(again)
    assert store.read(df.schema).count() == 200 and store.vacuum() == 0


def test_tiers():
    p = H.Policy(least=10, target=1000, fan_in=4)
    assert [p.tier(x) for x in (0, 10, 11, 40, 41, 499, 500, 10_000)] == [0, 0, 1, 1, 2, 3, -1, -1]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_shards(spark, sf).collect()
    assert {r.doc_id: r.text_sha256 for r in rows} == {i: sha256(t.encode()).hexdigest() for i, t in docs.items()}
    assert len(rows) == len(docs) and len({r.shard for r in rows}) <= rows[0].n_shards

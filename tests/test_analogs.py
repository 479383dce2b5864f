import math

import duckdb
import pytest

from repolens.plans.analogs import QUERIES, SQL

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return out


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    norm = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, map(tuple, df.collect()))
    rel = db.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == rows(rel.columns, rel.fetchall())
    assert got

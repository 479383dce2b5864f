import hashlib
import zlib

import duckdb
import pytest

from repolens.llm import prefix_trie as T
from repolens.llm.queries import OP13_SQL, op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
BASE, HEAD = "conv_id - conv_id % 5", "crc32(cast(conv_id as string)) % 9"


def brute(rows, rebuild=True):
    """The nodes, by plain dictionaries of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        made[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        child = lambda p: [q for q in members if len(q) == len(p) + 1 and q[:-1] == p]
        ends = ",".join(str(c) for c in sorted(ids) if len(made[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(child(p)), sum(not child(q) for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    return sorted(map(tuple, T.trie(spark.createDataFrame(rows, SCHEMA), BASE, HEAD, 8, **more).collect()), key=str)


def test_random_conversations_equal_brute_force(spark):
    import random

    r = random.Random(4)
    rows = []
    for c in [*range(-12, 60)]:
        for t in range(r.randrange(1, 14)):
            rows.append((c, t, r.choice(["user", "assistant"][: 1 + t % 2]), r.choice(["a", "bé", ""][: 1 + (t > 3) + (t > 6)])))
    # copies of a long conversation, one that goes on, and repeated rows
    long = [("user", f"t{i}") for i in range(70)]
    for c in (105, 110, 115, 120):
        rows += [(c, t, *x) for t, x in enumerate(long[: 70 - (c == 120)])]
    rows += [(115, 70, "user", "more")] + rows[:5]
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, growth=T.Growth(3, 4)) == want


def test_odd_rows(spark):
    rows = [(5, None, None, None), (5, None, "a", "x"), (5, 1, "b", "y"), (5, 1, "a", "z"), (5, 1, "a", "z"), (None, 1, "a", "b"), (6, 1, "a", "x"), (13, 1, "", ""), (8, 2, "ab", "c"), (9, 2, "a", "bc")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, rows[5:6]) == []
    assert run(spark, rows[6:7]) == brute(rows[6:7]) and run(spark, rows[:5]) == brute(rows[:5])
    extra = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "'q' as rep", "2 as n", "3 as pos")
    assert sorted(map(tuple, T.trie(extra, BASE, HEAD, 8).collect()), key=str) == brute(rows)


def test_one_conversation_of_many_turns_and_many_copies(spark):
    rows = [(1, t, "u", "x" * (t % 3)) for t in range(3000)] + [(c, t, "u", "same") for c in range(1000, 6000, 5) for t in range(3)]
    got = T.trie(spark.createDataFrame(rows, SCHEMA).repartition(7), BASE, "0", 0).collect()
    assert len(got) == 1 + 3000 + 3
    by = {(r.conv_id, r.depth): r for r in got}
    root, end = by[1, 0], by[1000, 3]
    assert (root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (1001, 2, 2, 3 * 999 * 4)
    assert end.ends_sha256 == hashlib.sha256(",".join(map(str, range(1000, 6000, 5))).encode()).hexdigest()
    assert all(by[1, d].n_convs == 1 and by[1, d].parent_conv_id == 1 for d in range(1, 3001))


def test_pieces_of_ends_are_in_order(spark):
    ids = [*range(-3000, 3000, 7)]
    rows = spark.createDataFrame([(2, -3000, i) for i in ids] + [(1, 5, 5)], "depth long, rep long, conv_id long").repartition(5)
    want = {(2, -3000): ",".join(map(str, ids)), (1, 5): "5"}
    assert {(r.depth, r.rep): r.ends_sha256 for r in T.end_hashes(rows).collect()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query_equals_sql_and_brute_force(spark, sf):
    got = op13_prefix_trie(spark, sf)
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = db.sql(OP13_SQL)
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str)
    assert rows == brute(db.sql("select * from conversations").fetchall())

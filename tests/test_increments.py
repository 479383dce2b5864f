import os
import subprocess

import pytest

from repolens.operators.measures import StatConfig
from repolens.operators.sampling import Granularity
from repolens.plans.engine import Engine, series, wanted_contents
from repolens.plans.increments import Sums
from repolens.sources.git import contents, follows, history
from tests import history_repo as R


@pytest.fixture
def repo(tmp_path):
    R.build(tmp_path / "repo")
    return str(tmp_path / "repo")


def full(spark, repo, stat, granularity):
    rows = series(history(spark, "commits", repo), history(spark, "raw_changes", repo), wanted_contents(spark, repo), stat, granularity)
    return sorted(map(tuple, rows.select("commit", "bucket", "key", "value").collect()), key=str)


def kept(sums, granularity):
    return sorted(map(tuple, sums.series(granularity).select("commit", "bucket", "key", "value").collect()), key=str)


STATS = [StatConfig("t", "grep", params={"pattern": "todo"}), StatConfig("f", "file_count", params={"pattern": "*.txt"}), StatConfig("g", "grep", params={"pattern": "todo"}, path_in_repo="*.py")]


@pytest.mark.parametrize("stat", STATS[::2], ids=lambda s: s.name)
def test_increments_equal_a_full_reading(spark, repo, tmp_path, stat):
    """The tip moves along the chain; after each step the kept sums are those of all commits, and only new commits are read."""
    chain = [sha for sha, _ in R.chain(repo)][::-1]
    sums = Sums(spark, str(tmp_path / "kept"), repo, stat)
    read = []
    for at in (1, 4, len(chain) - 1):
        R.git(repo, "reset", "-q", "--hard", chain[at])
        read.append(sums.update())
        assert kept(sums, Granularity("infinite")) == full(spark, repo, stat, Granularity("infinite"))
    assert read == [2, 3, len(chain) - 5] and sums.update() == 0
    assert len(sums.segments()) == 3
    # a version that comes back isn't measured again
    versions = [tuple(r) for r in sums.table("versions").collect()]
    assert len(versions) == len(set(versions))


def test_rewritten_history_is_read_afresh(spark, repo, tmp_path):
    stat = STATS[0]
    sums = Sums(spark, str(tmp_path / "kept"), repo, stat)
    n = sums.update()
    old = R.chain(repo)[0][0]
    R.git(repo, "reset", "-q", "--hard", "HEAD~2")
    assert not follows(repo, old)
    with open(os.path.join(repo, "new.txt"), "w") as f:
        f.write("todo\ntodo\n")
    R.git(repo, "add", "-A")
    R.git(repo, "commit", "-q", "-m", "other")
    assert sums.update() == n - 1
    assert sums.segments() == ["000001-000000"]
    assert kept(sums, Granularity("daily")) == full(spark, repo, stat, Granularity("daily"))
    # an update that was cut short has no marker and doesn't count
    os.makedirs(os.path.join(sums.folder, "000001-000001", "steps"))
    assert sums.segments() == ["000001-000000"] and sums.update() == 0


def test_old_tip_as_second_parent_is_no_ancestor_of_the_chain(repo):
    side = R.git(repo, "rev-parse", "side").decode().strip()
    assert not follows(repo, side) and follows(repo, R.chain(repo)[3][0]) and follows(repo, R.chain(repo)[0][0]) and not follows(repo, "0" * 40)


def test_engine_with_increments(spark, repo, tmp_path):
    stat = STATS[0]
    plain, keeping = Engine(spark, str(tmp_path / "c")), Engine(spark, str(tmp_path / "c"), increments=str(tmp_path / "kept"))
    want = [tuple(r) for r in plain.table(repo, stat).collect()]
    assert [tuple(r) for r in keeping.table(repo, stat).collect()] == want == [tuple(r) for r in keeping.table(repo, stat).collect()]
    number = StatConfig("j", "jq", params={"query": ".n"})
    assert [tuple(r) for r in keeping.table(repo, number).collect()] == [tuple(r) for r in plain.table(repo, number).collect()]
    with pytest.raises(ValueError):
        Sums(spark, str(tmp_path / "kept"), repo, number)


def test_only_wanted_objects_are_read(spark, repo, monkeypatch, tmp_path):
    """A wrapper of git writes down what it is asked for."""
    log, real = tmp_path / "log", subprocess.run(["which", "git"], capture_output=True, text=True).stdout.strip()
    objects = [r for r in history(spark, "objects", repo).collect() if r.kind == "blob"]
    places = [r.place for r in objects]
    assert len(set(places)) == len(places) and all(r.size >= 0 for r in objects)
    want = {r.oid for r in objects[::3]}
    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")
    (tmp_path / "git").write_text(f"#!/bin/sh\nif [ \"$4\" = --batch ]; then tee -a {log} | {real} \"$@\"; else exec {real} \"$@\"; fi\n")
    os.chmod(tmp_path / "git", 0o755)
    from repolens.sources.git import _read_batches
    import pyarrow as pa

    ids = sorted(want)
    got = [x for b in _read_batches([pa.RecordBatch.from_arrays([pa.array([repo] * len(ids)), pa.array(ids)], ["repo", "oid"])]) for x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
    assert set(log.read_text().split()) == want
    assert dict(got) == {i: R.git(repo, "cat-file", "blob", i) for i in want}
    monkeypatch.undo()
    rows = contents(spark.createDataFrame([(repo, i) for i in [*ids, "f" * 40]], "repo string, oid string")).collect()
    assert {r.oid: bytes(r.content) for r in rows} == dict(got)


def test_counts_of_a_run(spark, repo, tmp_path):
    engine = Engine(spark, str(tmp_path / "c"))
    engine.table(repo, StatConfig("j", "jq", params={"query": ".n"}, path_in_repo="*.json"))
    # package.json in two versions, broken.json and zero.json; the broken one and the empty one have no value
    assert engine.counts == {"versions": 4, "read": 4, "values": 2}
    engine.table(repo, STATS[1])
    assert set(engine.counts) == {"versions", "values"} and engine.counts["versions"] > engine.counts["values"] > 0


def test_detect_tools_warns_of_patterns_that_never_match(spark, repo, tmp_path):
    rules = tmp_path / "rules.ndjson"
    rules.write_text('{"name": "a", "files": ["x/y", "crlf.txt"], "dirs": []}\n')
    with pytest.warns(UserWarning, match="'x/y' can never match"):
        found = Engine(spark, str(tmp_path / "c")).detect_tools(repo, str(rules)).collect()
    assert [r.matching_files for r in found] == [["crlf.txt"]]


def test_a_write_that_fails_leaves_the_old_series(spark, tmp_path):
    from pyspark.sql import functions as F

    from repolens.operators.reshape import wide
    from repolens.sources.results import write_csv

    path = str(tmp_path / "s.csv")
    write_csv(spark.sql("select 'a' as commit, 1 as n"), path)
    old = open(path).read()
    with pytest.raises(Exception, match="stop here"):
        write_csv(spark.sql("select 'b' as commit").withColumn("n", F.raise_error(F.lit("stop here")).cast("string")), path)
    assert open(path).read() == old == "commit,n\na,1\n"
    write_csv(spark.sql("select 'b' as commit, 2 as n"), path)
    assert open(path).read() == "commit,n\nb,2\n" and [f for f in os.listdir(tmp_path) if "-" in f] == []
    many = spark.range(20).selectExpr("'a' as commit", "cast(id as string) as key", "'1' as value")
    with pytest.raises(ValueError, match="more than 10"):
        wide(many.select("commit").distinct(), many, most=10)

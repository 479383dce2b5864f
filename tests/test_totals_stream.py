import subprocess

import pytest
from pyspark.sql import functions as F

from repolens.operators import history as H
from repolens.operators.measures import StatConfig
from repolens.plans.engine import measured, wanted_contents
from repolens.sources.git import history, stream
from repolens.streaming.totals import current, publish, totals
from tests.history_repo import build, chain, git, snapshot

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(PROVIDER)


def batch_totals(spark, repo, stat):
    """The sums over all changes of the chain, each version measured once."""
    changes = H.deltas(history(spark, "raw_changes", repo))
    values = measured(changes, wanted_contents(spark, repo), stat.measurement())
    rows = changes.join(values, ["path", "oid"]).groupBy("key").agg(F.sum(F.col("sign") * F.col("value")).cast("long").alias("total"), F.sum("sign").alias("n"))
    return {r["key"]: (r["total"], r["n"]) for r in rows.filter("n > 0").collect()}


def advance(spark, repo, stat, out):
    publish(totals(stream(spark, "raw_changes", repo), stat.measurement()), f"{out}/totals", f"{out}/ck").awaitTermination()
    return {r["key"]: (r["total"], r["n_files"]) for r in current(spark, f"{out}/totals").collect()}


@pytest.mark.parametrize("stat", [StatConfig("s", "grep", params={"pattern": "todo"}), StatConfig("s", "tokei", params={}), StatConfig("s", "file_count", params={"pattern": "**/*.txt"})])
def test_stream_equals_batch_after_each_increment(rocks, tmp_path, stat):
    whole, repo = str(tmp_path / "whole"), str(tmp_path / "repo")
    build(whole)
    tips = [sha for sha, _ in chain(whole)][::-1]
    git(tmp_path, "clone", "-q", whole, repo)
    seen = []
    for sha in (tips[0], tips[3], tips[3], tips[-1]):
        git(repo, "reset", "-q", "--hard", sha)
        got = advance(rocks, repo, stat, tmp_path)
        assert got == batch_totals(rocks, repo, stat)
        seen.append(got)
    assert seen[1] == seen[2] and seen[0] != seen[-1] and seen[-1]
    if stat.type == "grep":
        files = snapshot(repo, tips[-1]).values()
        assert seen[-1]["total"][0] == sum(sum("todo" in x.decode() for x in f.split(b"\n")) for f in files if all(_utf8(x) for x in f.split(b"\n") if b"todo" in x))


def _utf8(line):
    try:
        return bool(line.decode()) or True
    except UnicodeDecodeError:
        return False


def test_positions_count_from_the_root(spark, tmp_path):
    repo = str(tmp_path / "repo")
    build(repo)
    stream(spark, "commits", repo, partitions=3).writeStream.format("memory").queryName("streamed_commits").trigger(availableNow=True).start().awaitTermination()
    got = {r.sha: r.chain_pos for r in spark.table("streamed_commits").collect()}
    assert got == {sha: -i for i, (sha, _) in enumerate(chain(repo)[::-1])}


def test_rewritten_history_fails(rocks, tmp_path):
    repo, stat = str(tmp_path / "repo"), StatConfig("s", "grep", params={"pattern": "todo"})
    build(repo)
    advance(rocks, repo, stat, tmp_path)
    git(repo, "reset", "-q", "--hard", chain(repo)[2][0])
    with pytest.raises(Exception, match="rewritten"):
        advance(rocks, repo, stat, tmp_path)


def test_an_empty_repository_has_no_totals(rocks, tmp_path):
    repo = str(tmp_path / "none")
    subprocess.run(["git", "init", "-q", repo], check=True)
    publish(totals(stream(rocks, "raw_changes", repo), StatConfig("s", "grep", params={"pattern": "x"}).measurement()), f"{tmp_path}/t", f"{tmp_path}/ck").awaitTermination()
    assert not (tmp_path / "t").exists() or current(rocks, f"{tmp_path}/t").count() == 0


def test_fractions_are_refused(spark):
    with pytest.raises(ValueError, match="whole"):
        totals(spark.range(0), StatConfig("s", "jq", params={"query": ".n"}).measurement())

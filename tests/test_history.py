import csv
import json
import os
import re
from datetime import UTC, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repolens.operators import history as H
from repolens.operators.measures import Loc, StatConfig
from repolens.operators.sampling import Granularity
from repolens.plans.engine import Engine, parse_date, publish, series
from repolens.sources import config, results
from repolens.sources.git import discover, find_repositories, history
from tests import history_repo as R


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("h") / "repo")
    R.build(path)
    return path


@pytest.fixture(scope="module")
def tables(spark, repo):
    return tuple(history(spark, t, repo, partitions=3).cache() for t in ("commits", "raw_changes", "blobs"))


def cells(table):
    return {r["commit"]: {k: v for k, v in r.asDict().items() if k not in ("commit", "date")} for r in table.collect()}


def run(tables, **stat):
    g = stat.pop("granularity", "infinite")
    return cells(publish(series(*tables, StatConfig(name="s", **stat), Granularity.parse(g))))


def test_source_tables(spark, repo, tables):
    commits = tables[0].orderBy("chain_pos").collect()
    assert [r.sha for r in commits] == [s for s, _ in R.chain(repo)]
    secs = [r.t for r in tables[0].orderBy("chain_pos").select(F.unix_seconds("ts").alias("t")).collect()]
    assert secs == [t for _, t in R.chain(repo)]
    entries = history(spark, "tree_entries", repo)
    roots = tables[0].select("tree_oid")
    got = {(r.tree_oid, r.path) for r in H.tree_files(roots, entries.cache()).collect()}
    want = {(c.tree_oid, p) for c in commits for p in R.snapshot(repo, c.sha)}
    assert got == want
    d = H.live(tables[0], H.versions(tables[1]), 3).join(tables[0], "chain_pos").select("sha", "path").collect()
    assert {(r.sha, r.path) for r in d} == {(c.sha, p) for c in commits for p in R.snapshot(repo, c.sha)} and len(d) == len({tuple(r) for r in d})
    kinds = {r.kind for r in history(spark, "objects", repo).collect()}
    assert kinds == {"tree", "blob"}
    files = history(spark, "repo_files", repo).collect()
    assert sorted((r.file_pos, r.path) for r in files) == [*enumerate(x for x in R.git(repo, "ls-files", "-z").decode().split("\0") if x)]


def grep(content, pattern="todo"):
    hits = [x for x in content.split(b"\n") if re.search(pattern.encode(), x)]
    try:
        return len([h.decode() for h in hits])
    except UnicodeDecodeError:
        return 0


def test_grep_and_count(repo, tables):
    got = run(tables, type="regex_count", params={"pattern": "todo"})
    assert got == {s: {"total": str(sum(map(grep, R.snapshot(repo, s).values())))} for s, _ in R.chain(repo)}
    got = run(tables, type="grep", path_in_repo="*.txt")
    assert got == {s: {"total": str(sum(grep(c) for p, c in R.snapshot(repo, s).items() if p.endswith(".txt")))} for s, _ in R.chain(repo)}
    got = run(tables, type="file_count", params={"pattern": "*.py"})
    assert got == {s: {"total": str(sum(p.endswith(".py") for p in R.snapshot(repo, s)))} for s, _ in R.chain(repo)}


def test_lines_of_code(repo, tables):
    from repolens.operators.loc import classify

    got = run(tables, type="tokei", params={"languages": ["Python", "C", "Rust"]})
    want = {}
    for s, _ in R.chain(repo):
        own = {}
        for p, c in R.snapshot(repo, s).items():
            name = {"py": "Python", "c": "C", "rs": "Rust"}.get(p.rsplit(".", 1)[-1])
            if name:
                own[name] = own.get(name, 0) + classify(c.decode(), name)[1]
        want[s] = own
    keys = {k for w in want.values() for k in w}
    assert got == {s: {k: str(w.get(k, 0)) for k in keys} for s, w in want.items()}
    assert classify("# todo one\nx = 1\n\n'''doc\nstring'''\ny = 2  # todo two\n", "Python") == (1, 2, 3)
    assert classify("// a\nfn main() {} /* b /* in */ */\n", "Rust") == (0, 1, 1)
    assert classify('x = "/* no */";\n/* a\n\n*/\n', "C") == (1, 1, 2)
    assert classify("", "C") == (0, 0, 0)
    top = run(tables, type="tokei", params={"topn": 1})
    assert all(sum(v != "0" for v in r.values()) <= 1 for r in top.values())


def test_json_and_commands(repo, tables):
    got = run(tables, type="jq", params={"query": ".dependencies | length"})
    want = {s: sum(len(json.loads(c)["dependencies"]) for p, c in R.snapshot(repo, s).items() if p == "package.json") for s, _ in R.chain(repo)}
    assert got == {s: {"jq_result": str(n)} for s, n in want.items()}
    got = run(tables, type="jq", params={"query": ".n"})
    assert set(v["jq_result"] for v in got.values()) == {"1.5", "0.25"}
    got = run(tables, type="jq_object", params={"query": ".dependencies"})
    assert {tuple(sorted(v.items())) for v in got.values()} == {(("jq_obj_query_.dependencies_a", "1"), ("jq_obj_query_.dependencies_b", "2"))}
    got = run(tables, type="file_script", params={"command": "wc", "args": ["-l"]}, path_in_repo="*.py")
    assert got == {s: {"result": str(sum(c.count(b"\n") for p, c in R.snapshot(repo, s).items() if p.endswith(".py")))} for s, _ in R.chain(repo)}


def sampled(chain, unit, start=None, end=None):
    """A plain loop over the chain."""
    out = {}
    for sha, t in chain:
        d = datetime.fromtimestamp(t, UTC)
        if start and d < start:
            break
        if end and d > end:
            continue
        out.setdefault({"daily": d.strftime("%Y-%m-%d"), "monthly": d.strftime("%Y-%m"), "infinite": sha}[unit], sha)
    return set(out.values())


@pytest.mark.parametrize("unit", ["daily", "monthly", "infinite"])
@pytest.mark.parametrize("start", [None, datetime(2022, 1, 1, 15, tzinfo=UTC), datetime(2021, 7, 1, tzinfo=UTC), datetime(2099, 1, 1, tzinfo=UTC)])
def test_sampling(repo, tables, unit, start):
    stat = StatConfig(name="s", type="file_count", params={"pattern": "*"})
    end = datetime(2022, 2, 20, tzinfo=UTC) if unit == "daily" else None
    rows = series(*tables, stat, Granularity.parse(unit), start, end).collect()
    assert {r.commit for r in rows} == sampled(R.chain(repo), unit, start, end)
    for r in rows:
        assert r.value == str(len(R.snapshot(repo, r.commit)))


def test_engine_end_to_end(spark, repo, tmp_path):
    cfg = tmp_path / "todo.json"
    cfg.write_text(json.dumps({"name": "todos", "description": "d", "type": "grep", "params": {"pattern": "todo"}, "granularity": "Monthly"}))
    engine = Engine(spark, str(tmp_path / "root"), str(tmp_path / "snap"))
    out = engine.run_config(str(cfg), repo, str(tmp_path / "out.csv"))
    with open(out, newline="") as f:
        table = [*csv.DictReader(f)]
    assert [*table[0]] == ["commit", "date", "total"] and table[0]["date"].endswith(" UTC")
    assert [r["date"] for r in table] == sorted(r["date"] for r in table)
    for r in table:
        assert r["total"] == str(sum(map(grep, R.snapshot(repo, r["commit"]).values())))
    again = results.read_csv(spark, out).collect()
    assert {(r.commit, r.value) for r in again} == {(r["commit"], r["total"]) for r in table}
    engine.catalog.add_repo(config.RepoConfig("r", repo, repo))
    engine.catalog.add_stat("r", config.stat_config({"type": "file_count", "params": {"pattern": "*.py"}}, "pys"))
    engine.catalog.add_stat("r", config.stat_config({"type": "script", "params": {"script": "ls | wc -l"}}, "n"))
    engine = Engine(spark, str(tmp_path / "root"))
    assert engine.catalog.pairs() == [("r", "n"), ("r", "pys")] and engine.to_run("r").count() == 2
    paths = engine.run_many("r", granularity="daily", since="2022-01-01")
    assert all(os.path.exists(p) for p in paths) and paths[1].endswith("r/pys.csv")
    for row in csv.DictReader(open(paths[0], newline="")):
        assert int(row["result"]) == len({x.decode().split("/")[0] for x in R.git(repo, "ls-tree", "--name-only", "-z", row["commit"]).split(b"\0") if x})
    with pytest.raises(ValueError):
        engine.run("r", "pys", granularity="fortnightly")
    with pytest.raises(ValueError):
        parse_date(spark, "nonsense")
    assert parse_date(spark, "2022-01-02 03:04:05 +0200") == datetime(2022, 1, 2, 1, 4, 5, tzinfo=UTC)


def test_repositories(spark, repo, tmp_path):
    assert os.path.realpath(discover(os.path.join(repo, "dir", "sub"))) == os.path.realpath(repo)
    for where in ("a/b/one", "a/two", "a/b/none"):
        os.makedirs(tmp_path / where)
    R.build(str(tmp_path / "a/b/one"))
    R.build(str(tmp_path / "a/two"))
    assert find_repositories(str(tmp_path), 3) == [str(tmp_path / "a/b/one")]
    found = Engine(spark, str(tmp_path / "root")).detect_tools(scan_root=str(tmp_path), max_depth=3).collect()
    assert {(r.repo_path, r.name) for r in found} == {(str(tmp_path / "a/b/one"), "npm")}


def test_clone_urls():
    parse = config.parse_clone_url
    assert (parse("https://example.org/o/r.git").domain, parse("https://example.org/o/r.git").repo) == ("example.org", "r")
    assert (parse("git@example.org:o/r.git").owner, parse("git@example.org:o/r.git").repo) == ("o", "r")
    assert parse("o/r").url == "https://github.com/o/r.git"
    with pytest.raises(ValueError):
        parse("https://example.org")


def test_clone(repo, tmp_path):
    catalog = config.Catalog.load(str(tmp_path / "root"))
    assert config.ensure_cloned(catalog, repo) == ["repo"]
    assert config.ensure_cloned(catalog, repo) == ["repo"] and catalog.repo("repo").default_branch == "main"


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.sampled_from("abcd"), st.one_of(st.none(), st.integers(1, 5)), max_size=3), min_size=1, max_size=7))
def test_delta_interval_and_snapshot_agree(spark, steps):
    """Random edits: a file gets a new version or goes; the root is the first step."""
    state, changes, states = {}, [], []
    for i, step in enumerate(steps):
        pos = len(steps) - 1 - i
        for path, value in step.items():
            old = state.get(path)
            if old == value:
                continue
            changes.append((pos, "100644" if old else "000000", str(old or 0), "100644" if value else "000000", str(value or 0), path))
            state[path] = value
        states.append((pos, {p: v for p, v in state.items() if v}))
    df = spark.createDataFrame(changes, "chain_pos int, old_mode string, old_oid string, new_mode string, new_oid string, path string")
    at = spark.createDataFrame([(p,) for p, _ in states], "chain_pos int")
    live = {(r.chain_pos, r.path, r.oid) for r in H.live(at, H.versions(df), 2).collect()}
    assert live == {(p, k, str(v)) for p, s in states for k, v in s.items()}
    steps_ = H.deltas(df).select("chain_pos", F.lit("k").alias("key"), (F.col("sign") * F.col("oid").cast("int")).cast("long").alias("value"), F.col("sign").cast("long").alias("n"))
    totals = {r.chain_pos: r.total for r in H.running_totals(at, steps_).collect()}
    assert totals == {p: sum(s.values()) for p, s in states if s}


def test_tree_totals_sum_each_tree_once(spark):
    """Random nested trees that share subtrees, against a recursive sum; the rows of the result are the distinct trees."""
    import random

    r = random.Random(5)
    T, P = H.TREE, H.PLAIN_FILE
    entries, trees = [], []
    for i in range(60):
        oid = f"t{i}"
        for j in range(r.randrange(0, 4)):
            entries.append((oid, f"f{j}", r.choice([P, P, "120000"]), f"b{r.randrange(12)}"))
        for j in range(r.randrange(0, 4) if trees else 0):
            entries.append((oid, f"d{j}", T, r.choice(trees)))
        trees.append(oid)
    roots = ["t59", "t58", "t40", "t3"]
    value = {(f"f{j}", f"b{k}"): (k - 3, "ab"[k % 2]) for j in range(4) for k in range(12) if (j + k) % 3}

    def total(oid):
        out = {}
        for t, name, mode, child in entries:
            if t == oid and mode == P and (name, child) in value:
                v, key = value[name, child]
                a, n = out.get(key, (0, 0))
                out[key] = (a + v, n + 1)
            elif t == oid and mode == T:
                for key, (v, m) in total(child).items():
                    a, n = out.get(key, (0, 0))
                    out[key] = (a + v, n + m)
        return out

    reached, stack = set(), list(roots)
    while stack:
        t = stack.pop()
        if t not in reached:
            reached.add(t)
            stack += [c for x, _, m, c in entries if x == t and m == T]
    want = sorted((t, k, v, n) for t in reached for k, (v, n) in total(t).items())
    df = spark.createDataFrame(entries, "tree_oid string, name string, mode string, child_oid string")
    values = spark.createDataFrame([(n, o, k, v) for (n, o), (v, k) in value.items()], "name string, oid string, key string, value long")
    start = spark.createDataFrame([(t,) for t in [*roots, roots[0], "missing"]], "tree_oid string")
    got = H.tree_totals(start, df, values)
    assert sorted(map(tuple, got.select("tree_oid", "key", "total", "n").collect())) == want
    seen = [x.tree_oid for x in H.reachable_trees(start, df).collect()]
    assert sorted(seen) == sorted(reached | {"missing"})
    assert H.tree_totals(start.limit(0), df, values).count() == 0


def test_live_totals_are_exact_and_meet_few_rows(spark):
    """20,000 versions and 100 samples: totals are the correctly rounded sums, and spans are at most pairs of samples."""
    import math
    import random

    r = random.Random(9)
    samples = sorted(r.sample(range(-2000, 30_000), 100))
    rows = []
    for _ in range(20_000):
        a, b = sorted(r.sample(range(-2500, 31_000), 2))
        rows.append((r.choice("ab"), r.choice([r.uniform(-1, 1) * 10.0 ** r.randint(-20, 20), 0.1, -0.1, 1e300, -1e300, 0.0, 5e-324]), b, a))
    sampled = spark.createDataFrame([(p,) for p in samples], "chain_pos int")
    valued = spark.createDataFrame(rows, "key string, value double, from_pos int, to_pos int")
    want = {}
    for p in samples:
        for k in "ab":
            live = [v for key, v, b, a in rows if key == k and a < p <= b]
            if live:
                want[p, k] = math.fsum(v for v in live if v != 5e-324)
    got = {(x.chain_pos, x.key): x.total for x in H.live_totals(sampled, valued, 512).collect()}
    assert got == want
    spans = H.sample_spans(sampled, valued, 512)
    assert spans.select("key", "first", "stop").distinct().count() <= 2 * 100 * 101 / 2
    assert H.live_totals(sampled.limit(0), valued).count() == 0 and H.live_totals(sampled, valued.limit(0)).count() == 0
    odd = spark.createDataFrame([("i", float("inf"), 9, -1), ("i", 1.0, 9, -1), ("n", float("inf"), 9, -1), ("n", float("-inf"), 9, -1), ("z", 0.0, 9, -1)], "key string, value double, from_pos int, to_pos int")
    got = {x.key: x.total for x in H.live_totals(spark.createDataFrame([(5,)], "chain_pos int"), odd).collect()}
    assert got["i"] == float("inf") and math.isnan(got["n"]) and got["z"] == 0.0


def test_contents_are_measured_once_for_a_series(spark):
    """A statistic in the delta form measures its contents once, however many of its sums need the values."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    class Counted(Loc):
        def measure(self, files):
            return super().measure(files.mapInArrow(count, files.schema))

    class Stat(StatConfig):
        def measurement(self):
            return Counted()

    commits = spark.sql("select 'r' as repo, cast(id as int) as chain_pos, concat('c', id) as sha, timestamp_seconds(1709251200 - id * 86400) as ts from range(3)")
    changes = spark.sql("select cast(id % 3 as int) as chain_pos, '000000' as old_mode, '' as old_oid, '100644' as new_mode, cast(id as string) as new_oid, concat(id, '.json') as path from range(12)")
    contents = spark.sql("select cast(id as string) as oid, encode('a\\n\\nb', 'UTF-8') as content from range(12)")
    got = {r.commit: r.value for r in series(commits, changes, contents, Stat("n", "loc"), Granularity("daily")).collect()}
    assert got == {"c0": "24", "c1": "16", "c2": "8"}
    assert seen.value == 12

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from repolens.llm import risk_rules as R
from repolens.llm.queries import op10_risk_rules

TEXTS = ["", None, "a", "x " * 60, "one two three\none two three\n\none two three ", "# * a\tb\x0bc é é\n \n \nq", "same line\nsame line \nsame line", "w " + "abc def ghi " * 3, "\n\n", "é" * 5000, " ".join(f"w{i}" for i in range(5000))]


def brute(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    hit = {i + j for i, x in enumerate(windows) if n[x] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_counts_equal_brute_force(spark):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(0, TEXTS[4], None), (None, TEXTS[4], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(2)
    got = R.text_counts(df.select("doc_id", "text"), "doc_id").collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(((i, *brute(t)) for i, t, _ in rows), key=key)


def test_counts_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in R.text_counts(docs, "doc_id").collect()} == want


def test_upper_bound_is_exact():
    # none of n: 1 - delta ** (1 / n)
    assert R.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert R.upper_bound(5, 5, 0.05) == 1.0
    p = R.upper_bound(3, 50, 0.01)
    from math import comb

    assert sum(comb(50, i) * p**i * (1 - p) ** (50 - i) for i in range(4)) == pytest.approx(0.01, rel=1e-6)


def test_cutoffs_hold_and_few_labels_give_none(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(3000)]
    bad = [(10_000 + i, " ".join(f"w{i}x{j}###" for j in range(60)), "en") for i in range(50)]
    few = [(20_000 + i, " ".join(f"w{i}x{j}" for j in range(60)), "xx") for i in range(5)]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good + few] + [(i, 0) for i, _, _ in bad] + [(None, None)], "doc_id long, quality int")
    counts = R.text_counts(docs, "doc_id", "lang").cache()
    cut = R.calibrate(counts, labels, "lang")
    assert "en" in cut and "xx" not in cut
    kept = {r.doc_id: r.kept for r in R.apply_rules(counts, cut, "lang").collect()}
    assert sum(not kept[i] for i, _, _ in good) <= 30
    assert not any(kept[i] for i, _, _ in bad)
    assert R.calibrate(counts.limit(0), labels, "lang") == {}
    assert all(kept[i] for i, _, _ in few)


def test_a_stratum_without_a_certificate_keeps_what_the_base_rules_keep(spark):
    """Strata of few labels, without labels, and null ones, beside one whose rules reject symbols."""
    text = lambda i, mark: " ".join(f"w{i}x{j}{mark}" for j in range(60))
    rows = [(i, text(i, ""), "en") for i in range(3000)] + [(5000 + i, text(i, "###"), "en") for i in range(60)]
    odd = [(9000 + i, text(i, "###"), s) for i, s in enumerate(["xx", "xx", "yy", None, None, "*"])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "'z' as kept")
    labels = spark.createDataFrame([(i, int(i < 5000)) for i, _, _ in rows] + [(9000, 1), (9001, 1), (9003, 1)], "doc_id long, quality int")
    counts = R.text_counts(docs, "doc_id", "lang")
    cut = R.calibrate(counts, labels, "lang")
    kept = {r.doc_id: r.kept for r in R.apply_rules(counts, cut, "lang").collect()}
    assert set(cut) == {"en"} and not any(kept[5000 + i] for i in range(60)) and all(kept[i] for i, _, _ in odd)


def test_null_is_a_stratum_and_ties_are_kept(spark):
    text = lambda i, mark: " ".join(f"w{i}x{j}{mark}" for j in range(60))
    rows = [(i, text(i, ""), None) for i in range(3000)] + [(5000 + i, text(i, "###"), None) for i in range(60)]
    counts = R.text_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "lang")
    labels = spark.createDataFrame([(i, int(i < 5000)) for i, _, _ in rows], "doc_id long, quality int")
    for stratum in ("lang", None):
        cut = R.calibrate(counts, labels, stratum)
        assert set(cut) == {None} and cut[None]["symbol_ratio"] == 0.01
        kept = {r.doc_id: r.kept for r in R.apply_rules(counts, cut, stratum).collect()}
        assert all(kept[i] for i in range(3000)) and not any(kept[5000 + i] for i in range(60))
    tie = counts.limit(1).selectExpr("doc_id", "lang", *[f"cast({v} as long) as {c}" for c, v in zip(R.COUNTS, (100, 400, 4, 0, 1, 0, 0, 400))])
    assert R.apply_rules(tie, {None: {"symbol_ratio": 0.01}}, None).first().kept


def kept_by_force(docs, labels, alpha=0.01, delta=0.05, power=0.03):
    """doc_id -> kept, by plain loops; bounds are told by the binomial tail at ``alpha``."""
    from math import comb, log

    stats = {}
    for i, t, lang in docs:
        n, chars, symbols, dup, repeat = brute(t)
        t = t or ""
        lines = sum(bool(re.search("[^\x20\x09-\x0d]", x)) for x in t.split("\n"))
        upper, lower = len(re.findall("[A-Z]", t)), len(re.findall("[a-z]", t))
        base = n < 50 or 100 * repeat > 50 * n
        stats[i] = lang, base, {"symbol_ratio": symbols / max(chars, 1), "dup_line_ratio": dup / max(lines, 1), "repeat_ratio": repeat / max(n, 1), "upper_ratio": upper / max(upper + lower, 1), "word_length": chars / max(n, 1)}
    of = lambda lang, q: [stats[i][2] for i, x in labels if x == q and i in stats and stats[i][0] == lang and not stats[i][1]]
    tried = 1
    for cuts in R.GRID.values():
        tried *= len(cuts) + 1
    strata = [x for x in {s[0] for s in stats.values()} if len(of(x, 1)) >= int(log(delta / tried) / log(1 - alpha))]
    share = delta / max(1, len(strata) * tried)
    cutoffs = {}
    for x in strata:
        good, bad, own = of(x, 1), of(x, 0), {}
        n = len(good)
        fails = lambda s, rules: any(s[k] > c for k, c in rules.items())
        while True:
            now, steps = sum(fails(s, own) for s in bad), []
            for r, (k, cuts) in enumerate(R.GRID.items()):
                for j, c in enumerate(cuts):
                    if c < own.get(k, float("inf")):
                        rules = own | {k: c}
                        wrong, right = sum(fails(s, rules) for s in good), sum(fails(s, rules) for s in bad)
                        tail = sum(comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(wrong + 1)) if wrong < 200 else 1
                        if tail <= share and right - now >= max(power * len(bad), 1):
                            steps.append((-right, wrong, r, j, rules))
            if not steps:
                break
            own = min(steps, key=lambda s: s[:4])[4]
        cutoffs[x] = own
    return {i: not base and all(s[k] <= c for k, c in cutoffs.get(lang, {}).items()) for i, (lang, base, s) in stats.items()}, cutoffs


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    want, cutoffs = kept_by_force(docs, labels)
    got = op10_risk_rules(spark, sf).collect()
    assert {r.doc_id: r.kept for r in got} == want and len(got) == len(docs)
    assert any(cutoffs.values())


def test_rules_together_reject_few_of_the_good(spark):
    """Five rules, each of which alone rejects under the limit of the good, but others each: all together keep to it."""
    n = 60_000
    base = {"n_words": 100, "word_chars": 500, "n_symbols": 0, "n_dup_lines": 0, "n_lines": 100, "n_repeat_words": 0, "n_upper": 0, "n_letters": 500}
    odd = [{"n_symbols": 400}, {"n_dup_lines": 90}, {"n_repeat_words": 48}, {"n_upper": 450}, {"word_chars": 3000}]
    rows = []
    for i in range(n):
        rows.append((i, "en", base | (odd[i % 1000 // 8] if i % 1000 < 40 else {})))  # 0.8 % each
    bad = [(n + i, "en", base | odd[i % 5]) for i in range(1000)]
    df = spark.createDataFrame([(i, s, *[c[k] for k in R.COUNTS]) for i, s, c in rows + bad], "doc_id long, lang string, " + ", ".join(f"{c} long" for c in R.COUNTS))
    labels = df.selectExpr("doc_id", f"cast(doc_id < {n} as int) as quality")
    cut = R.calibrate(df, labels, "lang")
    assert len(cut["en"]) == 1
    rejected = R.apply_rules(df, cut, "lang").filter(f"not kept and doc_id < {n}").count()
    assert 0 < rejected <= 0.01 * n
    loose = R.calibrate(df, labels, "lang", R.Policy(alpha=0.05))
    assert len(loose["en"]) == 5


def test_counts_of_equal_text_counts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").selectExpr("*", "1 as n_words")
    got = df.select("doc_id", R.counts_of(F.col("text")).alias("c")).select("doc_id", "c.*").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, R.text_counts(df, "doc_id").collect()))
    assert df.limit(0).select(R.counts_of(F.col("text"))).count() == 0

import random
import re
from collections import defaultdict

from repolens.llm import span_dedup as S
from repolens.llm.queries import op8_span_dedup


def brute_sentences(text):
    """(words, start) lists by the rules, in plain Python."""
    ws = [(m[0], m.start(), m.end()) for m in re.finditer("[^\x20\x09-\x0d]+", text)]
    out, cur = [], []
    for i, (w, a, b) in enumerate(ws):
        cur.append((w, a))
        last = i + 1 == len(ws)
        if last or len(cur) == S.SENTENCE_WORDS or w[-1] in ".!?" or "\n" in text[b : ws[i + 1][1]]:
            out.append(cur)
            cur = []
    return out


def brute(rows):
    places = defaultdict(list)
    for doc, text in rows:
        s = brute_sentences(text or "")
        for i in range(len(s)):
            n, j = 0, i
            while j < len(s) and (j - i < S.SENTENCES or n < S.SPAN_WORDS):
                n += len(s[j])
                j += 1
            if j - i >= S.SENTENCES and n >= S.SPAN_WORDS:
                key = tuple(tuple(w.lower() if w.isascii() else w for w, _ in x) for x in s[i:j])
                end = s[j][0][1] if j < len(s) else len(text)
                places[key].append((doc, i, j, s[i][0][1], end))
    covered = defaultdict(set)
    for group in places.values():
        for doc, _, _, start, end in sorted(group)[1:]:
            covered[doc] |= set(range(start, end))
    return covered


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdé", k=4))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 20))) + rng.choice([". ", "! ", "\n", " \n ", "? "])
    passages = ["".join(sentence() for _ in range(8)) for _ in range(4)]
    rows = [(0, ""), (1, None), (2, "a b c."), (3, "word " * 4000)]
    for i in range(4, 150):
        parts = [sentence() for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        rows.append((i, "".join(parts)))
    return rows + [(200, rows[20][1]), (201, rows[20][1])]


def test_ranges_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as hash").repartition(5)
    got = defaultdict(set)
    for r in S.repeated_ranges(df).collect():
        span = set(range(r.start, r.end))
        assert not span & got[r.doc_id]
        got[r.doc_id] |= span
    want = brute(rows)
    assert {k: v for k, v in want.items() if v} == dict(got)
    texts = dict(rows)
    cleaned = {r.doc_id: r.text for r in S.clean(df).collect()}
    for i, t in texts.items():
        left = None if t is None else "".join(c for j, c in enumerate(t) if j not in want.get(i, ()))
        assert cleaned.get(i) == (left if t is None or not want.get(i) or left.strip() else None)
    assert S.repeated_ranges(S.clean(df)).count() <= len(got) // 4


def test_passage_of_fifty_words_is_caught(spark):
    words = [f"p{i}" for i in range(51)]
    passage = " ".join(words[:25]) + ". " + " ".join(words[25:]) + "."
    rows = [(i, f"own start {i}. " + passage + f" own end {i} and more.") for i in range(5)] + [(9, "clean text here. nothing repeats in it at all. really.")]
    got = S.repeated_ranges(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4} and {r.first_doc_id for r in got} == {0}


def test_long_sentences_equal_windows_of_fifty_words(spark):
    """Passages without stops or with one, at every offset: of each later window of 50 words that repeats a part goes."""
    rng = random.Random(12)
    rows = []
    for n in range(120):
        size, stop = rng.choice([(51, 0), (60, 0), (90, 0), (51, 25), (52, 10), (51, 40)])
        passage = [f"p{n}x{i}" + "." * (i == stop > 0) for i in range(size)]
        for k in range(2):
            own = [f"o{n}y{k}z{i}" for i in range(24 + n % 13 * k)]
            rows.append((2 * n + k, " ".join([*own, *passage, *own])))
    got = defaultdict(set)
    for r in S.repeated_ranges(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got[r.doc_id] |= set(range(r.start, r.end))
    seen, repeats = {}, 0
    for i, text in rows:
        ws = [(m[0], m.start()) for m in re.finditer("[^ ]+", text)]
        for j in range(len(ws) - 49):
            if seen.setdefault(tuple(w for w, _ in ws[j : j + 50]), i) != i:
                repeats += 1
                assert any(a in got[i] for _, a in ws[j : j + 50]), (i, j)
        passage = [a for w, a in ws if w.startswith("p")]
        whole = set(range(passage[0], text.index(" o", passage[-1]) + 1))
        assert got[i] <= whole if i % 2 else not got[i]
        if i % 2 and "." not in text and i // 2 % 13 % 12:  # cut at other places in both
            assert got[i] == whole
    assert repeats > 500


def test_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, long), (1, long), (1, long), (2, None), (3, long.upper())], "doc_id long, text string")
    assert {(r.doc_id, r.start) for r in S.repeated_ranges(df).collect()} == {(3, 0)}
    assert sorted(str(r.doc_id) for r in S.clean(df).collect()) == ["1", "1", "2", "None"]
    assert S.repeated_ranges(df.limit(0)).count() == 0 and S.clean(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = defaultdict(set)
    for r in op8_span_dedup(spark, sf).collect():
        got[r.doc_id] |= set(range(r.start, r.end))
    assert dict(got) == {k: v for k, v in brute(rows).items() if v}

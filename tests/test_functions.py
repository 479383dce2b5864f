import random
import fnmatch
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repolens.functions import json_query as J
from repolens.functions.lines import content_matching_lines, first_matches, lines
from repolens.functions.patterns import glob_to_regex, line_regex
from repolens.functions.values import first_number, number_text, timestamp_text
from repolens.operators.loc import classify, classify_all, count_lines, language_name
from repolens.operators.measures import Loc
from repolens.operators.measures import StatConfig
from repolens.operators.sampling import Granularity


def glob(pattern, path):
    return re.search(glob_to_regex(pattern).replace(r"\z", r"\Z"), path) is not None


def test_globs():
    for pattern, yes, no in [
        ("*.rs", ["a.rs", "x/y.rs"], ["a.rs.txt"]),
        ("src/**/x", ["src/x", "src/a/b/x"], ["src/ax", "asrc/x"]),
        ("a?c", ["abc", "a/c"], ["ac"]),
        ("[a-c]x[!1]", ["axb", "cx2"], ["dx2", "ax1"]),
        ("{a,b}.txt", ["a.txt", "b.txt"], ["c.txt", "{a,b}.txt"]),
        (r"\*", ["*"], ["x"]),
        ("a.b", ["a.b"], ["axb"]),
        ("**/x", ["x", "a/x"], ["ax"]),
        ("dir", ["dir"], ["dir/file"]),
    ]:
        assert all(glob(pattern, y) for y in yes), pattern
        assert not any(glob(pattern, n) for n in no), pattern
    for bad in ("[a", "{a"):
        with pytest.raises(ValueError):
            glob_to_regex(bad)


@settings(max_examples=300, deadline=None)
@given(st.text("ab*?./", max_size=8), st.text("ab./\n", max_size=8))
def test_plain_globs_equal_an_independent_matcher(pattern, path):
    if "**" not in pattern:
        assert glob(pattern, path) == fnmatch.fnmatchcase(path, pattern)


def test_patterns_that_are_refused():
    for bad in ("(?=a)", "(?<!a)", r"(a)\1", "a*+"):
        with pytest.raises(ValueError):
            line_regex(bad)
    assert line_regex(r"\w+\.x") and line_regex(r"\(?=")


def test_lines(spark):
    texts = [b"", b"a", b"a\n", b"a\n\nb", b"\n", b"a\r\nb\r", "é\nü".encode(), b"ok\nbad \xff\n", b"bad \xff\nok\n"]
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "i int, content binary")
    got = {r.i: r.n for r in df.select("i", content_matching_lines(F.col("content"), "").alias("n")).collect()}
    assert [got[i] for i in range(7)] == [0, 1, 1, 3, 1, 2, 2] and got[7] is None
    got = {r.i: r.n for r in df.select("i", content_matching_lines(F.col("content"), "^ok$").alias("n")).collect()}
    assert got[7] == 1 and got[8] == 1
    got = {r.i: r.n for r in df.select("i", content_matching_lines(F.col("content"), r"^\w$").alias("n")).collect()}
    assert got[6] == 2 and got[5] == 0
    t = spark.createDataFrame([("x1\ny\nx2x3\n",)], "t string")
    assert [tuple(m) for m in t.select(first_matches(F.col("t"), r"x(\d)").alias("m")).first().m] == [(1, "x1"), (3, "x2")]
    assert t.select(lines(F.col("t")).alias("l")).first().l == ["x1", "y", "x2x3"]


def test_numbers_and_dates(spark):
    values = [5.0, -3.0, 0.0, -0.0, 0.1, 1.5, 1e10, 1e-7, 123456789.25, 1e15]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select(number_text(F.col("v")).alias("t")).collect()
    assert [r.t for r in rows] == ["5", "-3", "0", "0", "0.1", "1.5", "10000000000", "0.0000001", "123456789.25", "1000000000000000"]
    words = ["5 files", "  7.5\tx", "", "abc", "1e3", "\n8\n"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(first_number(F.col("w")).alias("v")).collect()
    assert [r.v for r in rows] == [5.0, 7.5, None, None, 1000.0, 8.0]
    assert spark.sql("select timestamp '2022-01-02 03:04:05' t").select(timestamp_text(F.col("t")).alias("s")).first().s == "2022-01-02 03:04:05 UTC"


def test_json_queries(spark):
    def run(query, *docs, fn=J.number):
        df = spark.createDataFrame([(i, bytearray(d.encode())) for i, d in enumerate(docs)], "i int, c binary")
        return [r.v for r in df.select("i", fn(F.col("c"), query).alias("v")).orderBy("i").collect()]

    assert run(".a", '{"a": 2}', '{"a": "5"}', '{"a": null}', "{}", "", "{bad", '{"a": 2.5}') == [2, 0, 0, 0, 0, None, 2.5]
    assert run(".a | length", '{"a": [1, 2]}', '{"a": {"x": 1}}', '{"a": "abc"}', '{"a": -4}', "{}", "[]") == [2, 1, 3, 4, 0, 0]
    assert run('.a["b c"][1]', '{"a": {"b c": [1, 7]}}', '{"a": []}') == [7, 0]
    assert run("keys | length", '{"a": 1, "b": 2}') == [2]
    assert run(".", "3", "[3]") == [3, 0]
    assert run(".d", '{"d": {"a": 1, "b": -1, "c": 2.0, "e": 1.5, "f": "x"}}', "{}", fn=J.object_counts) == [{"a": 1, "c": 2}, None]
    for bad in ("..", "def f: 1; f", ".a[1:2]", "reduce .[] as $x (0; .)"):
        with pytest.raises(J.Unsupported):
            run(bad, "{}")


def test_configs():
    assert Granularity.parse("WEEKLY") == Granularity("weekly") and Granularity.parse("all") == Granularity("infinite")
    assert Granularity.parse({"EveryXHours": 6}) == Granularity.parse("every-6-hours") == Granularity("hours", 6)
    for bad in ("x", {"EveryXHours": 0}, {"y": 1}):
        with pytest.raises(ValueError):
            Granularity.parse(bad)
    assert language_name("cpp") == "C++" and language_name("CHeader") == "C Header"
    with pytest.raises(ValueError):
        language_name("nothing")
    assert StatConfig("s", "regex_count").measurement().pattern == "todo"
    assert StatConfig("s", "script", params={"script": "x"}).measurement().command == "x"
    for bad in (StatConfig("s", "nope"), StatConfig("s", "grep", params={"nope": 1}), StatConfig("s", "tokei", params={"languages": [1]})):
        with pytest.raises(ValueError):
            bad.measurement()


def test_numbers_as_text_in_full(spark):
    from repolens.functions.values import number_text

    rng = random.Random(3)
    values = [rng.uniform(-10, 10) * 10.0 ** rng.randint(-30, 30) for _ in range(400)] + [1e21, 1e22, 1.5e16, 9007199254740993.0, 123456789.125, 1e-7, 5e-324]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", number_text(F.col("x")).alias("t")).collect()
    for r in got:
        assert set(r.t) <= set("-.0123456789") and float(r.t) == r.x, r


PAGE = """<!DOCTYPE html>
<!-- <script> -->
<script>
// hidden
var x = "</template>";

</script><style lang="scss">
/* a */
b { c: d }
</style>
<script>one()</script>
<script type="text/unknown">
<!--
kept
-->
</script>
<p>text
"""
COMPONENT = """<template>
  <div>
    <template v-if="a">
      <!-- note -->
      <b/>
    </template>
  </div>
</template>

<script setup lang="ts">
const a = 1; // one
</script>
"""
PROSE = """# Title

~~~python
# ~~~ no end
x = 1
~~~
```
plain
```
````html
<style>
```
p {}
</style>
<i>
````
```nonsense
a
```
end
"""


def test_lines_of_languages_inside_files():
    assert classify_all(PAGE, "HTML") == {None: (0, 8, 4), "JavaScript": (1, 1, 1), "Sass": (0, 1, 1)}
    assert classify_all(COMPONENT, "Vue") == {None: (1, 4, 0), "HTML": (0, 5, 1), "TypeScript": (0, 1, 0)}
    assert classify_all(PROSE, "Markdown") == {None: (1, 0, 12), "Python": (0, 1, 1), "HTML": (0, 3, 0), "CSS": (0, 2, 0)}
    assert classify("a\n\n", "Plain Text") == (1, 0, 1)
    assert classify_all("", "HTML") == {None: (0, 0, 0)}
    # A block that never ends goes to the end of the file; another file begins anew.
    assert classify_all("<script>\na\n<p>", "HTML") == {None: (0, 1, 0), "JavaScript": (0, 2, 0)}
    assert classify_all("```js\n/*\n```\n```js\nx\n```\n", "Markdown") == {None: (0, 0, 4), "JavaScript": (0, 1, 1)}  # each block begins anew


def test_inner_lines_count_for_their_language_when_asked(spark):
    files = spark.createDataFrame([("a.html", "1", PAGE.encode()), ("b.md", "2", PROSE.encode()), ("c.py", "3", b"x = 1\n"), ("d.vue", "4", b""), ("e.html", "5", None)], "path string, oid string, content binary")
    got = {(r.path, r.language): r.host for r in count_lines(files).collect()}
    assert got == {("a.html", "HTML"): None, ("a.html", "JavaScript"): "HTML", ("a.html", "Sass"): "HTML", ("b.md", "Markdown"): None, ("b.md", "Python"): "Markdown", ("b.md", "HTML"): "Markdown", ("b.md", "CSS"): "Markdown", ("c.py", "Python"): None, ("d.vue", "Vue"): None, ("e.html", "HTML"): None}
    measured = lambda loc: {(r.path, r.key): r.value for r in loc.measure(files).collect()}
    assert measured(Loc()) == {("a.html", "HTML"): 8, ("b.md", "Markdown"): 0, ("c.py", "Python"): 1}
    assert measured(Loc(languages=("Python", "HTML"), embedded=True)) == {("a.html", "HTML"): 8, ("b.md", "Python"): 1, ("b.md", "HTML"): 3, ("c.py", "Python"): 1}


def test_lines_are_told_apart_by_their_marks_alone():
    text = "\n".join(["some words of a line, and others", "", " \t", "more"] * 100_000)
    start = time.process_time()
    assert classify(text, "JSON") == classify(text, "Rust") == (200_000, 200_000, 0)
    assert classify_all(text + "\n```json\n" + text + "\n```\n", "Markdown") == {None: (200_000, 0, 200_002), "JSON": (200_000, 200_000, 0)}
    assert time.process_time() - start < 5  # each character alone takes more than 20 s
    # An escaped quote ends no string, so that what follows is no comment; a doc string of a language with nested comments ends.
    assert classify('a = "\\" /* b";\nc\n', "Rust") == (0, 2, 0)
    assert classify('"""\na\n"""\nb\n', "Julia") == (0, 1, 3)
    assert classify("a = '`'\n/* b */ c /*\n\n*/ d", "JavaScript") == (1, 3, 0)

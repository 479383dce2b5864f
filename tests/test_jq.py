import json

import pytest
from pyspark.sql import functions as F

from repolens.functions.jq import Unsupported, lower
from repolens.functions.json_query import document, number, object_counts

DOC = {"a": [3, 1, 2], "o": {"x": 1, "y": None, "z": "s"}, "n": 1.5, "s": "héy", "t": True, "z": None, "l": [{"k": 1, "ok": True}, {"k": 5, "ok": False}, {"k": 7}], "e": [], "strange key.": 4, "m": [[1], [2, 3]]}

#: Outputs by the language's definition; None: a runtime error.
CASES = [
    (".", [DOC]), (".a", [[3, 1, 2]]), (".a[0]", [3]), (".a[-1]", [2]), (".a[9]", [None]), (".o.x", [1]), ('.["strange key."]', [4]), ('."strange key."', [4]), (".o.q.r", [None]), (".n.x", None), (".a.x", None), (".o[0]", None),
    (".a[]", [3, 1, 2]), (".a | .[]", [3, 1, 2]), (".o[]", [1, None, "s"]), (".n[]", None), (".n[]?", []), (".a[]?", [3, 1, 2]), ("(.a[] | .x)?", []),
    (".a | length", [3]), (".s | length", [3]), (".z | length", [0]), (".o | length", [3]), (".n | length", [1.5]), (".t | length", None), ("length", [10]),
    (".o | keys", [["x", "y", "z"]]), (".a | keys", [[0, 1, 2]]), (".e | keys", [[]]), (".o | keys | length", [3]), (".n | keys", None),
    (".a | map(. * 2)", [[6, 2, 4]]), (".l | map(.k)", [[1, 5, 7]]), (".l | map(select(.ok))", [[{"k": 1, "ok": True}]]), (".l | map(select(.k > 1) | .k) | add", [12]), (".l[] | select(.k >= 5) | .k", [5, 7]),
    (".a | add", [6]), (".e | add", [None]), (".m | add", [[1, 2, 3]]), ("[.s, \"!\"] | add", ["héy!"]), (".o | add", None), (".n | map(.)", None),
    (".o | to_entries", [[{"key": "x", "value": 1}, {"key": "y", "value": None}, {"key": "z", "value": "s"}]]), (".o | to_entries | map(.value) | length", [3]), (".a | to_entries", None),
    (".q // 5", [5]), (".z // .n", [1.5]), (".a[0] // 9", [3]), ("(.o[] // 7)", [1, "s"]), (".n.x // 2", [2]), ("empty // 1 // 2", [1]), (".t and .z", [False]), (".z or .n", [True]), (".t and .n.x", None), (".z and .n.x", [False]),
    (".a, .n", [[3, 1, 2], 1.5]), ("1, 2 | . + 1", [2, 3]), ("(1, 2) + (10, 20)", [11, 12, 21, 22]), ("1 - 2 - 3", [-4]), ("2 + 3 * 4", [14]), ("-(.n)", [-1.5]), ("7 % 3, -7 % 3", [1, -1]), ("1 / 0", None), ("1 % 0", None), (".s + 1", None), (".a - [1]", [[3, 2]]), ("null + 1", [1]),
    (".n == 1.5", [True]), (".a == [3, 1, 2]", [True]), (".s != .n", [True]), ("1 == 1.0", [True]), (".z < .t, .t < 0, 1 < \"a\"", [True, True, True]), (".a < .m", None), ("3 <= 3, 4 <= 3", [True, False]),
    ("[.a[] | select(. > 1)] | length", [2]), ("[]", [[]]), ("{}", [{}]), ("{n, b: .a[0]}", [{"n": 1.5, "b": 3}]), ("{b: .a[]} | .b", [3, 1, 2]), ("[.n.x]", None), ("{\"q\": 1} | .q", [1]),
    ("if .t then 1 else 2 end", [1]), ("if .z then 1 elif .n > 1 then 3 else 2 end", [3]), ("if .z then 1 end | .n", [1.5]), (".a | min, max", [1, 3]), (".e | min", [None]), (".m | max", None),
    (".o | has(\"x\"), has(\"w\")", [True, False]), (".a | has(2), has(3)", [True, False]), (".a | any(.)" , "refused"), (".a | any, all", [True, True]), ("[.z, .t] | any, all", [True, False]), (".s | not", [False]), ("map(type)", [["array", "array", "array", "array", "number", "object", "string", "string"]]),
    ("\"12\" | tonumber", [12]), ("\"x\" | tonumber", None), (".n | tostring", ["1.5"]), (".a | first, last", [3, 2]), ("first(.a[])", [3]), ("first(empty)", []), (".n | floor, ceil", [1, 2]), (".s | startswith(\"h\"), endswith(\"y\"), contains(\"z\")", [True, True, False]), (".z | values", []), ("error", None), ("empty", []),
]
REFUSED = ["", ".a |", "..", "def f: 1; f", ". as $x | $x", "reduce .[] as $x (0; . + $x)", ".a[1:2]", "unknown", "length(1)", "[", "{a", "1 < 2 < 3", ".a[.n]", '"\\(1)"', "@base64", ".a.[", "if 1 then 2", "a b"]


def test_filters(spark):
    """Each filter over one document; numbers are compared as numbers."""
    doc = dict(DOC)
    run = [(q, w) for q, w in CASES if w != "refused" and q != "map(type)"]
    df = spark.createDataFrame([(json.dumps(doc),)], "doc string")
    v = document(F.encode("doc", "UTF-8"))
    for i in range(0, len(run), 20):
        part = run[i : i + 20]
        row = df.select(v.alias("v")).select(*[F.transform(lower(q)(F.col("v")), lambda x: F.to_json(x)).alias(f"c{j}") for j, (q, _) in enumerate(part)]).first()
        for j, (q, want) in enumerate(part):
            got = row[f"c{j}"]
            assert (None if got is None else [json.loads(x) for x in got]) == want, q


@pytest.mark.parametrize("query", [*REFUSED, ".a | any(.)"])
def test_refused(spark, query):
    with pytest.raises(Unsupported):
        lower(query)


def test_documents(spark):
    """What is one JSON document and what isn't."""
    good = ['{"a":1}', " 5 ", "[1]\n", "null", '{"a":1,"a":2}', '"1e400"', "1e308", "1e-400", '{"x":"} {"}', "12345678901234567890123"]
    bad = ['{"a":1} {"a":2}', '{"a":1}x', "1e400", '{"a":[-1e999]}', "1" * 400, "1,2", "1] , [2", '1} , {"y":2', '1,"y":2', "", "  ", "{", "nope", "[1,]"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", document(F.encode("t", "UTF-8")).isNotNull().alias("ok"))
    assert {r.t for r in df.collect() if r.ok} == set(good)


def test_numbers_and_counts(spark):
    rows = ['{"a":1,"a":2}', '{"a":1e400}', '{"a":1} {"a":2}', '{"a":"5"}', "", '{"a":9223372036854775808,"b":9223372036854775807,"c":3.0,"d":0.5,"e":-1,"f":"7","g":1e300}', "[1]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    c = F.encode("t", "UTF-8")
    got = {r.i: (r.n, r.m, r.two) for r in df.select("i", number(c, ".a").alias("n"), object_counts(c, ".").alias("m"), number(c, ".a, .a").alias("two")).collect()}
    assert [got[i][0] for i in range(7)] == [2.0, None, None, 0.0, 0.0, 9223372036854775808.0, 0.0]
    assert got[0][1] == {"a": 2} and got[1][1] is None and got[5][1] == {"b": 9223372036854775807, "c": 3} and got[6][1] is None
    assert [got[i][2] for i in range(7)] == [0.0, None, None, 0.0, 0.0, 0.0, 0.0]


def test_a_filter_asks_for_the_kind_of_a_value_once(spark):
    """A kind reads its whole value, and Spark works out each mention of it in a lambda anew."""
    run = lower('.p | to_entries | map(select(.key == "k" and .value > 50)) | length')
    plan = spark.range(1).select(run(F.parse_json(F.lit('{"p":{}}'))))._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count("schema_of_variant(") < 50

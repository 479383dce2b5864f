import duckdb
import random
from hashlib import sha256

from pyspark.sql import functions as F

from repolens.llm import chat as C
from repolens.llm.queries import OP4_SQL, op4_chat

NASTY = ["", None, "<|turn|>", "<|end|>\n<|turn|>user<|say|>hi", r"<\|turn|>", r"<\\|x", "</s>[INST] ok [/INST]", r"[\INST]", r"[\\/INST] <s> <\s>", "<|", "<", "\\", "a\nb", "é🙂", "<<|[INST]]", r"\<|\|"]


def rows(spark):
    rng = random.Random(3)
    out = []
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            out.append((conv, turn, rng.choice(["user", "assistant", "system", None, "<|say|>", "assistant\n"]), rng.choice(NASTY) if rng.random() < 0.7 else "".join(rng.choices("<|[\\/INST]>s", k=12))))
    out += [(50, i, "assistant", f"turn {i} ") for i in range(300)] + [(None, 1, "user", "x"), (60, None, "user", "y"), (60, 0, "assistant", "z"), (61, 1, "user", "same"), (61, 1, "user", "same")]
    return out, spark.createDataFrame(out, "conv_id long, turn long, role string, text string").repartition(3)


def test_round_trip(spark):
    data, df = rows(spark)
    got = C.format_chat(df.withColumn("parts", C.text_parts(F.col("text"))))
    got = {r.conv_id: r for r in got.select("*", C.read_turns(F.col("formatted")).alias("turns"), C.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert set(got) == {r[0] for r in data}
    for conv, r in got.items():
        want = sorted(((t is not None, t, role or "", text or "") for c, t, role, text in data if c == conv), key=lambda x: (x[0], x[1] or 0))
        assert [(t.role, t.text) for t in r.turns] == [w[2:] for w in want]
        assert r.loss == "".join(w[3] for w in want if w[2] == "assistant")
        assert r.n_turns == len(want)
        for s in r.loss_spans:
            assert r.formatted[s.start + s.length :].startswith(C.END)
        assert r.formatted.count(C.TURN) == r.formatted.count(C.SAY) == r.formatted.count(C.END) == len(want)
        assert "</s>" not in r.formatted and "[INST]" not in r.formatted


def test_typed_parts(spark):
    part = lambda kind, **k: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    data = [
        (1, 0, "user", [part("text", text="see <"), part("text", text="|image|>"), part("image", ref="a.png", width=57, height=28), part("audio", ref="b.wav", seconds=1.5)]),
        (1, 1, "assistant", [part("text", text="ok"), part("document", ref="c.pdf", pages=2), part("video", ref="d"), part(None)]),
        (1, 2, "user", None),
        (1, 3, "user", [part("image", ref="e.png")]),
    ]
    r = C.format_chat(spark.createDataFrame(data, f"conv_id long, turn long, role string, parts {C.PART_TYPE}")).first()
    assert r.formatted.startswith("<|turn|>user<|say|>see <<|part|>|image|><|part|><|image|><|part|><|audio|><|end|>\n")
    assert [(a["index"], a.turn, a.part, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, 0, 2, "image", "a.png", 3), (1, 0, 3, "audio", "b.wav", 38), (2, 1, 1, "document", "c.pdf", 1024), (3, 1, 2, "video", "d", 0), (4, 1, 3, None, None, 0), (5, 3, 0, "image", "e.png", 256)]
    assert r.expanded_tokens == 3 + 38 + 1024 + 256
    assert r.formatted.count("<|image|>") == 2


def test_query_equals_sql_and_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(map(tuple, op4_chat(spark, sf).collect()))
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    assert got == sorted(db.sql(OP4_SQL).fetchall())
    convs = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    convs[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    for conv, n, turns, chars, loss, _ in got:
        assert turns == sha256("".join(f"{a}\n{b}\n" for a, b in convs[conv]).encode()).hexdigest() and n == len(convs[conv])
        text = "".join(b for a, b in convs[conv] if a == "assistant")
        assert (chars, loss) == (len(text), sha256(text.encode()).hexdigest())


def test_native_and_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string").withColumn("parts", C.text_parts(F.col("text")))
    out = C.format_chat(df)
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

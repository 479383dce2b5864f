import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from repolens.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, window):
    """Pieces against the library's ids; returns the padding."""
    lib = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for i, docs in want.items():
        if len(docs) == 1:
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(docs[0])
                assert r.ids_crc32 == zlib.crc32(docs[0][at : at + r.length].tobytes())
                at += r.length
            assert at == len(docs[0])
        else:
            assert sum(r.length for r in by_doc[i]) == sum(map(len, docs))
    pad = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        pad += window - at
    return pad


def test_pieces_are_whole_and_full(spark):
    rng = random.Random(5)
    alphabet = "the and of \n  é.,'s1\t日<|endoftext|>"
    texts = [(i, "".join(rng.choices(alphabet, k=rng.randint(0, 300)))) for i in range(300)]
    texts += [(300, None), (301, ""), (302, "long text " * 4000), (None, "no id"), (303, "a<|endoftext|>b"), (304, "x   y  \n  z \n\n\n w  "), (305, "a\0b c"), (306, "twice"), (306, "twice")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumnRenamed("x", "ids").repartition(9)
    for fan_in in (2, 256):
        rows = packing.pack(df, PATH, window=128, most=4, fan_in=fan_in).collect()
        assert check(rows, texts, 128) < 128  # only the last sequence


def test_ids_equal_the_library():
    rng = random.Random(11)
    lib = Tokenizer.from_file(PATH)
    enc = packing.ByteEncoder(open(PATH, encoding="utf-8").read())
    texts = ["".join(rng.choices([*" \n\t ab'sé1.日", "<|endoftext|>", "\u00a0", "\x1c"], k=rng.randint(0, 12))) for _ in range(3000)]
    texts += ['a' * 30_000, ' ' * 30_000, '\n ' * 9_000, '^' * 30_000]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_long_white_space_equals_the_library():
    lib = Tokenizer.from_file(PATH)
    enc = packing.ByteEncoder(open(PATH, encoding="utf-8").read())
    for t in ("a" + " " * 2_000_000 + "b", "\n" * 2_000_000, " " * 1_200_000):
        assert np.array_equal(np.frombuffer(enc.encode(t), "<u4"), lib.encode(t, add_special_tokens=False).ids), (t[:2], len(t))


def test_many_long_runs_are_measured_in_one_pass():
    """Runs just below the limit: a text of 5 million characters is looked through in less than a second."""
    import time

    text = ("a" + " " * 50_000) * 100
    began = time.perf_counter()
    assert not any(m.end() - m.start() >= packing.LONG_SPACE for m in packing.SPACES.finditer(text))
    assert time.perf_counter() - began < 1
    lib = Tokenizer.from_file(PATH)
    enc = packing.ByteEncoder(open(PATH, encoding="utf-8").read())
    for t in (("a" + " " * 50_000) * 4, ("a" + "\n" * 99_999) * 3, "a" + " " * 99_999, " " * 100_000 + "b" + " " * 99_999):
        assert np.array_equal(np.frombuffer(enc.encode(t), "<u4"), lib.encode(t, add_special_tokens=False).ids), len(t)


def test_query_and_empty(spark):
    from repolens.llm.queries import op7_packing

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = op7_packing(spark, "/root/testdata/sf0.001").collect()
    assert check(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048) < 2048
    assert packing.pack(docs.limit(0), PATH).count() == 0

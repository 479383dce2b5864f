import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from repolens.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello the World's end.", " \n\t ", "<|endoftext|>", "a<|startoftext|>B c<|ENDOFTEXT|>d", "naïve ÉÈ é ß İ Σίσυφος ΟΔΟΣ", "12345 3.14 x2y", "日本語 テキスト 🙂🙂", "a\x1cb\x85c d e​f", "don't I'LL we've x'y''s", "q" * 3000, "ﬁ ① Å", "\x00\x01 ퟿"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_the_library(spark, library):
    rng = random.Random(7)
    alphabet = "abcdeE THth'stré.,!12 \n\t<|>éßΣσ日\x1c\x1d　"
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(1, 80))) for _ in range(400)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in bpe.encode(df, PATH, "doc_id").collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want, repr(t)
        assert got[i].n_tokens == len(want)
        assert got[i].decoded == library.decode(want, skip_special_tokens=False), repr(t)
    again = {r.doc_id: r.decoded for r in bpe.decode_ids(bpe.encode(df, PATH, "doc_id"), PATH, "doc_id").collect()}
    assert again == {i: got[i].decoded for i in got}


def test_query_on_documents(spark, library):
    from repolens.llm.queries import op3_bpe

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op3_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_rows(spark):
    df = spark.createDataFrame([(None, "a b", "x"), (1, "a b", None), (1, "a b", None)], "doc_id long, text string, ids string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in bpe.digests(df, PATH, "doc_id").collect()) == [(0, 2), (1, 2), (1, 2)]
    assert bpe.digests(df.limit(0), PATH, "doc_id").count() == 0


@pytest.mark.parametrize("change", [{"normalizer": None}, {"pre_tokenizer": None}, {"decoder": {"type": "ByteLevel"}}, {"dropout": 0.1}, {"lstrip": True}])
def test_files_that_treat_texts_otherwise_are_refused(change):
    import json

    spec = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    bpe.Vocabulary(spec)
    for k, v in change.items():
        if k in spec:
            spec[k] = v
        elif k in spec["model"]:
            spec["model"][k] = v
        else:
            spec["added_tokens"][0][k] = v
    with pytest.raises(ValueError):
        bpe.Vocabulary(spec)

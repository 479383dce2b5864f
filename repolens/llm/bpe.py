"""BPE encoding and decoding (operator 3).

A word's bytes become symbols in a doubly linked list. A priority queue holds the
ranks of the merges of neighbours; the best is taken, entries whose symbols have
meanwhile changed are skipped as stale, and each merge queues its two new neighbours.
Decoding concatenates vocabulary strings.

The vocabulary file is read on the driver from a path (a parameter) and broadcast; its
size is that of the file. Text is split as the file's own pre-tokenizer says. Tasks keep
the encodings of recent words in a table of bounded size; which words are in it never
changes a result.

Rows: a null text is empty; an empty text has no ids. Repeated rows, ties and extra
columns change nothing; an empty table gives an empty result. Very long texts are
encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .textnum import slices

#: A bound of the words and chunks that a task remembers, and of their letters.
CACHE_WORDS, CACHE_LETTERS = 400_000, 1 << 24


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}


class Vocabulary:
    """A vocabulary of words (lower case, end-of-word mark), read from a tokenizer file; files that treat texts in another way are refused."""

    def __init__(self, spec: dict):
        model = spec["model"]
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        plain = [n["type"] for n in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        words = [p["type"] for p in split] == ["Split", "ByteLevel"] and split[0]["behavior"] == "Removed" and split[0]["invert"] and "Regex" in split[0]["pattern"]
        letters = words and not split[1]["add_prefix_space"] and not split[1].get("use_regex", True)
        own = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        added = not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if not (plain and letters and own and added) or spec.get("decoder"):
            raise ValueError("the file does not treat texts as this encoder does")
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        merges = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        #: Pair of ids: (rank, id of the merged symbol).
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(merges)}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.letters = byte_letters()
        self.special_pattern = regex.compile("|".join(sorted(map(regex.escape, self.special), key=len, reverse=True))) if self.special else None

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        letters = [self.letters[b] for b in word.encode()]
        letters[-1] += self.end
        symbols = [self.ids[x] for x in letters]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            if m := self.merges.get((symbols[i], symbols[i + 1])):
                queue.append((m[0], i, symbols[i], symbols[i + 1], m[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merges.get((new, symbols[k])):
                    heapq.heappush(queue, (m[0], i, new, symbols[k], m[1]))
            if (h := before[i]) >= 0 and (m := self.merges.get((symbols[h], new))):
                heapq.heappush(queue, (m[0], h, symbols[h], new, m[1]))
        return [s for s in symbols if s >= 0]


class Encoder:
    """Encodes texts with a table of recent chunks: runs without white space, of one or more pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words: dict[str, list[int]] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.letters_held = [0, 0]  # in words, in chunks

    def _word(self, word: str) -> list[int]:
        out = self.words.get(word)
        if out is None:
            if len(self.words) >= CACHE_WORDS or self.letters_held[0] >= CACHE_LETTERS:
                self.words.clear()
                self.letters_held[0] = 0
            out = self.words[word] = self.v.encode_word(word)
            self.letters_held[0] += len(word)
        return out

    def _ids(self, ids: list[int]) -> tuple[bytes, str]:
        return np.array(ids, "<u4").tobytes(), " ".join(map(self.v.strings.__getitem__, ids))

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        return self._ids([i for w in self.v.pieces.findall(chunk) for i in self._word(w)])

    def _plain(self, text: str) -> list[str]:
        """Chunks of a text without special strings, normalised."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letters are lowered one by one, without Greek's final sigma
        text = text.lower()
        if regex.search(r"[\x1c-\x1f]", text):  # white space to Python, not to the pattern
            return [*filter(None, regex.split(r"\s+", text))]
        return text.split()

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        split: list[list] = []
        for t in texts:
            if self.v.special_pattern and self.v.special_pattern.search(t):
                parts, at = [], 0
                for m in self.v.special_pattern.finditer(t):
                    parts += self._plain(t[at : m.start()]) + [(self.v.special[m[0]],)]
                    at = m.end()
                split.append(parts + self._plain(t[at:]))
            else:
                split.append(self._plain(t))
        if len(self.chunks) > CACHE_WORDS or self.letters_held[1] > CACHE_LETTERS:
            self.chunks.clear()
            self.letters_held[1] = 0
        table = self.chunks
        for c in set(chain.from_iterable(split)).difference(table):
            table[c] = self._ids([*c]) if isinstance(c, tuple) else self._chunk(c)
            self.letters_held[1] += len(c)
        out = []
        for parts in split:
            found = [table[c] for c in parts]
            out.append((b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[0]])))
        return out


def decode(strings: dict[int, str], ids: list[int]) -> str:
    """The text of ids: their vocabulary strings, in order, with a space between (the file names no decoder)."""
    return " ".join(strings[i] for i in ids)


def _mapped(docs: DataFrame, path: str, keep: tuple[str, ...], text: str, fields: list[StructField], make) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = StructType([f for f in rows.schema.fields if f.name != "__text"] + fields)
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(json.loads(spec.value)))
        for whole in batches:
            for b in slices(whole, "__text"):
                texts = [t or "" for t in b.column(b.schema.get_field_index("__text")).to_pylist()]
                arrays = [b.column(b.schema.get_field_index(k)) for k in keep]
                yield pa.RecordBatch.from_arrays(arrays + make(encoder.encode_batch(texts)), [f.name for f in schema.fields])

    return rows.mapInArrow(encode, schema)


def encode(docs: DataFrame, path: str, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep``, with ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers) and ``decoded``."""
    fields = [StructField("n_tokens", LongType()), StructField("ids", BinaryType()), StructField("decoded", StringType())]
    return _mapped(docs, path, keep, text, fields, lambda x: [pa.array([len(i) // 4 for i, _ in x], pa.int64()), pa.array([i for i, _ in x], pa.binary()), pa.array([d for _, d in x], pa.string())])


def digests(docs: DataFrame, path: str, *keep: str, text: str = "text") -> DataFrame:
    """As ``encode``, but with SHA-256 digests in place of ids and text, so that neither leaves its task."""
    hexed = lambda x: hashlib.sha256(x).hexdigest()
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return _mapped(docs, path, keep, text, fields, lambda x: [pa.array([len(i) // 4 for i, _ in x], pa.int64()), pa.array([hexed(i) for i, _ in x]), pa.array([hexed(d.encode()) for _, d in x])])


def decode_ids(rows: DataFrame, path: str, *keep: str, ids: str = "ids") -> DataFrame:
    """The columns ``keep`` and ``decoded``: the text of binary ``ids`` (null: null)."""
    with open(path, encoding="utf-8") as f:
        spec = rows.sparkSession.sparkContext.broadcast(f.read())
    schema = StructType([*rows.select(*keep).schema.fields, StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = Vocabulary(json.loads(spec.value)).strings
        for b in batches:
            text = [None if x is None else decode(strings, np.frombuffer(x, "<u4").tolist()) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string())], schema.names)

    return rows.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, schema)

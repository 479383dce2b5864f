"""Packing token sequences (operator 7).

Bounded-space online packing: a task keeps a fixed number of open windows. A piece goes
to the window that it fills best; if it fits in none, the fullest window is topped up
with the piece's first ids and emitted, and the rest of the piece is placed. Documents
longer than a window are cut into full windows and a rest.

What is left open at the end of a task is merged: the leftover pieces of a task are laid
end to end and cut into full windows, and of each task one partial window remains. These
are merged in the same way, some hundreds to a task and level by level, until one partial
window is left. A level has a bounded number of rows of one window for each task, and
only these leave the task with their ids.

Sequences are of at most ``window`` ids, gapless from 0. Only the very last one may need padding.

Rows: a null text is empty; each document ends with the id ``end``, so an empty one has
one id. Repeated rows are packed each for itself; a null doc_id is kept as it is. Extra
columns are ignored; an empty table gives an empty result. Long texts are cut, never shortened.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .bpe import byte_letters
from .scratch import Scratch
from .textnum import slices

WINDOW, OPEN, FAN_IN, END = 2048, 64, 256, 1
#: Sequences of one task or merging group are numbered from a multiple of this.
SPAN = 1 << 36
#: Levels of merging are numbered apart from the tasks.
LEVEL = 1 << 20
PIECE = [StructField(c, LongType()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
SCHEMA = StructType([*PIECE, StructField("part", LongType()), StructField("ids", BinaryType())])

#: Fixed value: how byte-level vocabularies split a text before their merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts with longer runs of white space are encoded by the tokenizers library.
LONG_SPACE = 100_000
SPACES = re.compile(r"\s+")


class ByteEncoder:
    """Ids of a byte-level vocabulary, as the tokenizers library gives them.

    In these files a token's id is its merge's rank, and so the vocabulary alone tells the
    merges; other files are refused. Special strings in a text become their ids.

    tiktoken gives the ids. It fails on about a million characters of white space in a row;
    texts with a long run are left to the tokenizers library itself.
    """

    def __init__(self, spec: str):
        import tiktoken

        self.text, spec = spec, json.loads(spec)
        self.library = None
        letters = {c: b for b, c in byte_letters().items()}
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(pairs)):
            raise ValueError("ids are not the ranks of merges")
        split = spec["pre_tokenizer"] or {}
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("the file does not split texts as byte-level vocabularies do")
        ranks = {bytes(letters[c] for c in s): i for s, i in vocab.items()}
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(text) >= LONG_SPACE and any(m.end() - m.start() >= LONG_SPACE for m in SPACES.finditer(text)):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.text)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


class Packer:
    """The open windows of one task. Finished pieces gather in ``rows``."""

    def __init__(self, window: int, most: int, base: int):
        self.window, self.most, self.next = window, most, base
        self.open: list[tuple[int, list]] = []  # (ids in it, its pieces)
        self.rows: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, offset))
            offset += n
        self.next += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.window:
            self._emit([(doc, start, ids[4 * start : 4 * (start + self.window)], total)])
            start += self.window
        if start == total:
            return
        need = total - start
        best = min((i for i, (fill, _) in enumerate(self.open) if fill + need <= self.window), key=lambda i: -self.open[i][0], default=None)
        if best is None and len(self.open) == self.most:
            fullest = max(range(len(self.open)), key=lambda i: self.open[i][0])
            fill, pieces = self.open.pop(fullest)
            cut = self.window - fill
            self._emit([*pieces, (doc, start, ids[4 * start : 4 * (start + cut)], total)])
            start, need = start + cut, need - cut
            best = min((i for i, (f, _) in enumerate(self.open) if f + need <= self.window), key=lambda i: -self.open[i][0], default=None)
        piece = (doc, start, ids[4 * start :], total)
        if best is None:
            self.open.append((need, [piece]))
        else:
            fill, pieces = self.open[best]
            pieces.append(piece)
            if fill + need == self.window:
                self._emit(self.open.pop(best)[1])
            else:
                self.open[best] = (fill + need, pieces)

    def lay(self, pieces: Iterator[tuple]) -> list[tuple]:
        """Lay pieces end to end, emit full windows, return the pieces of the rest."""
        rest, fill = [], 0
        for doc, start, ids, total in pieces:
            while ids:
                cut = min(self.window - fill, len(ids) // 4)
                rest.append((doc, start, ids[: 4 * cut], total))
                start, ids, fill = start + cut, ids[4 * cut :], fill + cut
                if fill == self.window:
                    self._emit(rest)
                    rest, fill = [], 0
        return rest

    def close(self) -> list[tuple]:
        left = sorted(self.open, key=lambda w: -w[0])
        self.open = []
        return self.lay(p for _, pieces in left for p in pieces)

    def batch(self, part: int, left: list[tuple] = ()) -> pa.RecordBatch:
        """The finished rows; the left ones as well, with their ids and as yet no sequence."""
        rows = [(*r, part, None) for r in self.rows] + [(doc, start, len(ids) // 4, zlib.crc32(ids), total, None, None, part, ids) for doc, start, ids, total in left]
        self.rows = []
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(SCHEMA)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if f.name == "ids" else pa.int64()) for c, f in zip(columns, SCHEMA, strict=True)], SCHEMA.names)


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, most: int = OPEN, end: int = END, fan_in: int = FAN_IN, scratch: Scratch | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, packer = ByteEncoder(spec.value), Packer(window, most, part * SPAN)
        for whole in batches:
            for b in slices(whole, "__text"):
                texts = [t or "" for t in b.column(1).to_pylist()]
                for doc, text_ in zip(b.column(0).to_pylist(), texts, strict=True):
                    packer.add(doc, encoder.encode(text_) + mark)
                if packer.rows:
                    yield packer.batch(part)
        if packer.open:
            yield packer.batch(part, packer.close())

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    return merge(scratch.table(rows.mapInArrow(run, SCHEMA), "packed"), window, fan_in, scratch)


def _layer(window, first, last):
    """The merging of one group; its sequences are numbered from ``first + group``."""

    def lay(key, table):
        group = key[0].as_py()
        packer = Packer(window, 0, (first + group) * SPAN)
        table = table.sort_by([(c, "ascending") for c in ("part", "doc_id", "start", "length")])
        rest = packer.lay(zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True))
        if last and rest:
            packer._emit(rest)
            rest = []
        return pa.Table.from_batches([packer.batch(group, rest)])

    return lay


def merge(packed: DataFrame, window: int, fan_in: int, scratch: Scratch) -> DataFrame:
    """Merge the partial windows of tasks, ``fan_in`` to a group, until one is left."""
    names = [f.name for f in PIECE]
    done = [packed.filter("ids is null").select(*names)]
    left, level = packed.filter("ids is not null"), 0
    groups = left.agg(F.max("part")).first()[0]
    while groups is not None:
        level, last = level + 1, groups < fan_in
        grouped = left.withColumn("group", F.expr(f"part div {fan_in}"))
        out = scratch.table(grouped.groupBy("group").applyInArrow(_layer(window, (level + 1) * LEVEL, last), SCHEMA), f"merged{level}")
        done.append(out.filter("ids is null").select(*names))
        left, groups = out.filter("ids is not null"), None if last else groups // fan_in
    result = done[0]
    for d in done[1:]:
        result = result.unionAll(d)
    return result

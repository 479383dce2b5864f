"""Words, lines and shingles of Arrow string columns as numpy arrays.

Works on the UTF-8 bytes of a column without making Python strings. White space is
ASCII space and 0x09-0x0D, so words are runs of other bytes. Columns are cut into
slices of bounded size; a document is never cut, so memory is bounded by the slice or
by the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random 64-bit code for each byte, and odd multipliers.
BYTE_CODE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
SHINGLE_BASES = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256)
LOWER[65:91] += 32
LOWER_CODE = BYTE_CODE[LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text."""
    _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
    start, n = 0, batch.num_rows
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def runs_hash(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each run of codes; the runs lie one after the other and none is empty."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(codes * _powers(int(lengths.max()))[place], starts) + lengths.astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, code: np.ndarray = BYTE_CODE):
    """(hash, first byte, length in bytes) of each word, and the first word of each row (n rows + 1)."""
    solid = ~SPACE[data]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, np.uint64), at, at, np.zeros(len(offsets), np.int64)
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = np.diff(at) > 1
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    new |= edge[at]
    first = np.flatnonzero(new)
    lengths = np.diff(np.append(first, len(at)))
    starts = at[first]
    return runs_hash(code[data[at]], lengths), starts, lengths, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of k words, and the offsets of rows in them.

    A row of 1 to k-1 words has one shingle, its whole sequence; one without words has none.
    """
    n = np.diff(row)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_row = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(row[:-1] - out_row[:-1], count) + np.arange(out_row[-1])
    size = np.repeat(np.minimum(n, k), count)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    total = size.astype(np.uint64)
    for j in range(k):
        total = total + np.where(j < size, padded[start + j] * SHINGLE_BASES[j], np.uint64(0))
    return mix(total), out_row


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def lines(data: np.ndarray, offsets: np.ndarray):
    """(hash, has a word, offsets of rows): the lines between line feeds. A row has one line more than line feeds."""
    feeds = np.flatnonzero(data == 10)
    feeds_row = np.searchsorted(feeds, offsets)
    n = np.diff(feeds_row) + 1
    row = np.concatenate([[0], np.cumsum(n)])
    r = row_of(row)
    place = np.arange(row[-1]) - row[r]
    at = feeds_row[r] + place
    ext = np.append(feeds, len(data))
    last = place == n[r] - 1
    stop = np.where(last, offsets[r + 1], ext[np.minimum(at, len(feeds))])
    start = np.where(place == 0, offsets[r], np.append(feeds, 0)[np.maximum(at - 1, 0)] + 1)
    length = stop - start
    hashes = np.zeros(len(r), np.uint64)
    full = np.flatnonzero(length > 0)
    if len(full):
        keep = np.ones(len(data), bool)
        keep[feeds] = False
        hashes[full] = runs_hash(BYTE_CODE[data[keep]], length[full])
    solid = np.concatenate([[0], np.cumsum(~SPACE[data])])
    return hashes, solid[stop] > solid[start], row


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

"""Vectorised words, hashes and n-grams over Arrow string columns.

Everything works on the UTF-8 bytes of an Arrow batch, a few megabytes of text
at a time, so memory does not depend on the batch size Spark chooses.  Nulls
count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once.
PIECE_BYTES = 1 << 20
#: Bytes hashed at once; small enough for the caches.
HASH_BYTES = 256 << 10

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_codes = np.arange(256)
#: Byte -> byte with A-Z lower-cased.
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
SAME = _codes.astype(np.uint8)
#: Bytes of words that white space (space, tab to carriage return) separates.
SPACED = ~((_codes == 0x20) | ((_codes >= 0x09) & (_codes <= 0x0D)))
#: Bytes of words of digits, letters (either case) and anything beyond ASCII.
ALNUM = ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128)
LINE = _codes != 10

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the hash base and of its inverse, modulo 2^64."""
    size = max(HASH_BYTES + 1, 1 << int(n).bit_length())
    for have in _powers:
        if have >= n:
            return _powers[have]
    with np.errstate(over="ignore"):
        out = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
    if size <= 1 << 22:
        _powers[size] = (out[0], out[1])
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; a bijection."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `limit` bytes of text, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    _, off = texts_of(column)
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


class Words:
    """Words of several texts: byte spans, and per text its range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
        n = len(data)
        inside = member[data] if n else np.zeros(0, bool)
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        starts[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        self.data = data
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.inside = inside

    def __len__(self) -> int:
        return len(self.start)

    @property
    def text(self) -> np.ndarray:
        """The text's index, per word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, fold: np.ndarray = SAME) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, fold)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """64-bit hashes of ascending, disjoint byte spans."""
    out = np.empty(len(start), U64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            base = start[i]
            j = max(i + 1, int(np.searchsorted(end, base + HASH_BYTES, "right")))
            stop = end[j - 1]
            up, down = powers(int(stop - base) + 1)
            values = fold[data[base:stop]].astype(U64)
            values += U64(1)
            values *= up[: stop - base]
            acc = np.zeros(stop - base + 1, U64)
            np.cumsum(values, out=acc[1:])
            s, e = start[i:j] - base, end[i:j] - base
            out[i:j] = (acc[e] - acc[s]) * down[s]
            i = j
        out += (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(out)


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word runs inside a text, and the index of each one's first word."""
    total = len(h) - n + 1
    if total <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        if n <= 8:
            g = h[:total].copy()
            for j in range(1, n):
                g *= _BASE
                g += h[j : j + total]
        else:
            up, down = powers(len(h) + 1)
            acc = np.zeros(len(h) + 1, U64)
            np.cumsum(h * up[: len(h)], out=acc[1:])
            g = (acc[n:] - acc[:-n]) * down[:total]
        g += U64(n)
    good = np.ones(total, bool)
    for_cut = first[1:-1]
    for_cut = for_cut[(for_cut > 0) & (for_cut < len(h))]
    if len(for_cut):  # a run may not contain a text's end
        bad = np.zeros(total + 1, np.int32)
        np.add.at(bad, np.clip(for_cut - n + 1, 0, total), 1)
        np.add.at(bad, np.clip(for_cut, 0, total), -1)
        good = np.cumsum(bad)[:total] == 0
    at = np.flatnonzero(good)
    return mix(g[at]), at


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each text's range."""
    acc = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=acc[1:])
    return acc[first[1:]] - acc[first[:-1]]


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of `total` words lie in a run of n words that begins at one of starts."""
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + n, total), -1)
    return np.cumsum(step)[:total] > 0


def in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where each value stands in a sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1, np.int64)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, at, -1)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)

"""Texts of an Arrow batch as one byte buffer: words, their hashes and rolling hashes, all by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

U = np.uint64
_ONE = U(1)


def byte_class(outside: bytes) -> np.ndarray:
    """A table that is true for every byte but those in ``outside``."""
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(outside, dtype=np.uint8)] = False
    return table


#: words between blanks: [^\x20\x09-\x0D]+
BLANK_WORDS = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d")
#: words of letters, digits and all beyond ASCII, after A-Z became a-z
PLAIN_WORDS = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def hidden(docs: DataFrame, *read: str) -> DataFrame:
    """``docs`` with every column but those of ``read`` under a name that meets no operator's own; ``toDF(*docs.columns)`` names them back."""
    return docs.toDF(*[c if c in read else f"carried_{i}_" for i, c in enumerate(docs.columns)])


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as long as asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(n, b, dtype=U)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


BASES = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)


class RollingHash:
    """Hashes of substrings of a buffer, equal for equal substrings wherever they stand."""

    def __init__(self, buf: np.ndarray, which: int = 0):
        self.up, self.down = BASES[which].upto(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, dtype=U)
        np.cumsum((buf.astype(U) + _ONE) * self.up[: len(buf)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


def large(column: pa.Array, null: str = "") -> pa.Array:
    """A string column with 64-bit offsets and no nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.large_string()), null)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows, from 0) of a column that ``large`` made."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 1 << 20, most_rows: int = 4000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in parts of about ``most_bytes`` of text (one row at least), with their bytes and offsets."""
    if not batch.num_rows:
        return
    text = large(batch.column(column))
    buf, offs = buffer_of(text)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, min(lo + most_rows, int(np.searchsorted(offs, offs[lo] + most_bytes, "right")) - 1))
        yield batch.slice(lo, hi - lo), buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the row each stands in. No word spans two rows."""
    inside = table[buf]
    first, last = inside.copy(), inside.copy()
    if len(buf):
        cuts = offs[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(buf))]
        first[1:] &= ~inside[:-1]
        first[cuts] = inside[cuts]
        last[:-1] &= ~inside[1:]
        last[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offs, start, "right") - 1


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int, table: np.ndarray = BLANK_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes (52 bits) of the ``words``-word shingles of each row, sorted: row, hash, and rows' counts.

    A row of fewer words, but not none, has one shingle, its whole sequence. At most 4,095 rows.
    """
    buf = LOWER[buf]
    start, end, row = word_spans(buf, offs, table)
    n_rows = len(offs) - 1
    h = RollingHash(buf).of(start, end)
    n_words = np.bincount(row, minlength=n_rows)
    keys = []
    if len(h) >= words:
        at = np.flatnonzero(row[: len(h) - words + 1] == row[words - 1 :])
        s = np.zeros(len(at), dtype=U)
        for k in range(words):
            s = mix64(s * U(0x9E3779B97F4A7C15) + h[at + k])
        keys.append((row[at].astype(U) << U(52)) | (s >> U(12)))
    firsts = np.zeros(n_rows, dtype=np.int64)
    firsts[1:] = np.cumsum(n_words)[:-1]
    for n in range(1, words):
        few = np.flatnonzero(n_words == n)
        s = np.full(len(few), n, dtype=U)
        for k in range(n):
            s = mix64(s * U(0x9E3779B97F4A7C15) + h[firsts[few] + k])
        keys.append((few.astype(U) << U(52)) | (s >> U(12)))
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, dtype=U)
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    rows = (key >> U(52)).astype(np.int64)
    return rows, key & U((1 << 52) - 1), np.bincount(rows, minlength=n_rows)


def sums_by(row: np.ndarray, values: np.ndarray, n_rows: int) -> np.ndarray:
    """Sum modulo 2**64 of ``values`` for each row; ``row`` is sorted."""
    total = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values, out=total[1:])
    ends = np.searchsorted(row, np.arange(n_rows + 1))
    return total[ends[1:]] - total[ends[:-1]]

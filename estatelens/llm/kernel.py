"""Vectorised text primitives shared by the operators, for use inside Arrow-batch tasks.

Words are ``[^\\x20\\x09-\\x0D]+``. All routines work on the UTF-8 bytes of many documents at once; a
document boundary always ends a word, a line and a window. Hashes are 64-bit and depend on the bytes only,
so that they agree between tasks, executors and runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U64)
#: Words longer than this are hashed one by one.
_LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def odd_constants(n: int, tag: str) -> np.ndarray:
    """``n`` fixed odd multipliers derived from a name."""
    raw = hashlib.blake2b(tag.encode(), digest_size=8).digest()
    seed = np.frombuffer(raw, U64)[0]
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + seed) | U64(1)


class Texts:
    """The documents of one slice: bytes, offsets and word positions."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.buf = LOWER[buf] if lower else buf
        self.offsets = offsets
        self.n = len(offsets) - 1
        inside = ~SPACE[self.buf]
        before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
        if len(buf):
            before[1:], after[:-1] = inside[:-1], inside[1:]
            edges = offsets[(offsets > 0) & (offsets < len(buf))]
            before[edges], after[edges - 1] = False, False
        self.inside = inside
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        #: Word range of each document: words ``first[d]`` to ``first[d + 1]``.
        self.first = np.searchsorted(self.start, offsets)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.first))

    def word_hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        length = (self.end - self.start).astype(np.int64)
        padded = np.zeros(len(self.buf) + 8, np.uint8)
        padded[: len(self.buf)] = self.buf
        view = np.ndarray((len(self.buf) + 1,), "<u8", padded.data, 0, (1,))
        out = mix(length.astype(U64) * U64(0x9E3779B97F4A7C15) ^ (view[self.start] & _MASKS[np.minimum(length, 8)]))
        rest, at = np.flatnonzero((length > 8) & (length <= _LONG)), 8
        while len(rest):
            chunk = view[self.start[rest] + at] & _MASKS[np.minimum(length[rest] - at, 8)]
            out[rest] = mix(out[rest] * U64(0xD6E8FEB86659FD93) ^ chunk)
            at += 8
            rest = rest[length[rest] > at]
        for i in np.flatnonzero(length > _LONG):
            word = self.buf[self.start[i] : self.end[i]].tobytes()
            out[i] = np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), U64)[0]
        return out

    def windows(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``n`` words that starts at a word, and whether it stays in its document."""
        if len(hashes) < n:
            return np.zeros(0, U64), np.zeros(0, bool)
        count = len(hashes) - n + 1
        total = np.zeros(count, U64)
        for k, c in enumerate(odd_constants(n, f"window-{n}")):
            total += hashes[k : k + count] * c
        left = np.repeat(self.first[1:], np.diff(self.first))[:count]
        return mix(total), np.arange(count) + n <= left


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null reads as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def slices(batches: Iterator[pa.RecordBatch], limit: int = 4_000_000, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` text bytes, or one row if that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def texts(batch: pa.RecordBatch, lower: bool = False, text: str = "text") -> Texts:
    return Texts(*column_bytes(batch.column(batch.schema.get_field_index(text))), lower=lower)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each range ``first[d]`` to ``first[d + 1]``."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]

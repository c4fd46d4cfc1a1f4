"""Vectorised tokenising and hashing of Arrow string columns.

Texts stay UTF-8 bytes: the word classes used here are defined on ASCII
characters, and no byte of a multi-byte character is below 0x80, so a byte
table decides what belongs to a word. Word and window hashes are 64-bit
polynomial hashes with a strong finaliser; equal words always have equal
hashes, whatever batch they are in.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multipliers of the byte and word polynomials (any odd constants do).
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1B54A32D192ED03
#: Bytes of text worked on at a time: temporaries are about 40 times as large, in each of an executor's workers.
SLICE_BYTES = 1 << 18


def _class(drop: bytes | range | list[int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(drop)] = False
    return table


#: Words are runs of anything but space, tab, LF, VT, FF, CR.
SPACED = _class([0x20, *range(0x09, 0x0E)])
#: Words are runs of digits, a-z and anything outside ASCII (after lower-casing).
ALNUM = _class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection, so distinct values stay distinct)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        p = np.full(size, base, dtype=U64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if size <= 4 * SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]


def _segment_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    inverse = _powers(pow(base, -1, 1 << 64), int(start.max(initial=0)) + 1)
    return (prefix[end] - prefix[start]) * inverse[start]


@dataclass
class Words:
    """Words of a run of texts: word i of text d is at first[d] + i."""

    first: np.ndarray  # int64, one more than texts
    start: np.ndarray  # byte places in data
    end: np.ndarray
    hash: np.ndarray  # uint64
    data: np.ndarray  # uint8, lower-cased if asked for
    offsets: np.ndarray  # int64 byte places of the texts

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word indexes) and hashes of all k-word windows inside one text."""
        n = len(self.hash)
        if n < k:
            return np.empty(0, np.int64), np.empty(0, U64)
        prefix = np.zeros(n + 1, dtype=U64)
        np.cumsum(self.hash * _powers(WORD_BASE, n), out=prefix[1:])
        last = np.repeat(self.first[1:], np.diff(self.first)) - k
        start = np.flatnonzero(np.arange(n) <= last)
        return start, mix(_segment_hash(prefix, start, start + k, WORD_BASE) + U64(k))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the word runs [start, end)."""
        n = len(self.hash)
        prefix = np.zeros(n + 1, dtype=U64)
        np.cumsum(self.hash * _powers(WORD_BASE, max(n, 1))[:n], out=prefix[1:])
        return mix(_segment_hash(prefix, start, end, WORD_BASE) + (end - start).astype(U64))


def release() -> None:
    """Give freed memory back to the system: a Python worker stays alive beside the JVM when its tasks are over."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(run: Callable) -> Callable:
    """A function over batches that ends with ``release``."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as plain strings, null as empty; called once a batch, it first gives back what the last one left.

    The texts stay in the batch's own memory, unless a null hides bytes.
    """
    release()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if not len(column):
        return pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    size = np.diff(np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1])
    if column.null_count and size[column.is_null().to_numpy(zero_copy_only=False)].any():
        return pc.fill_null(column, "")
    return pa.Array.from_buffers(pa.large_string(), len(column), [None, offsets, data], null_count=0, offset=column.offset)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets (from 0) of a large_string array."""
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return body, off - off[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (one text at least)."""
    _, off = raw(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def tokenize(column: pa.Array, table: np.ndarray = SPACED, lower: bool = False, trim: np.ndarray | None = None) -> Words:
    """Words of a large_string array without nulls (see ``texts``).

    ``trim`` is a table of bytes: one of them at the end of a word, behind an ASCII letter, is left out of it.
    """
    data, off = raw(column)
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = table[data]
    begin = inside[1:-1] & ~inside[:-2]
    stop = inside[1:-1] & ~inside[2:]
    cut = off[(off > 0) & (off < n)]  # a text's border ends a word
    begin[cut] = inside[1:-1][cut]
    stop[cut - 1] = inside[1:-1][cut - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    if trim is not None and len(start):
        end = end - (trim[data[end - 1]] & _LETTER[data[np.maximum(end - 2, start)]])
    prefix = np.zeros(n + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * _powers(BYTE_BASE, max(n, 1))[:n], out=prefix[1:])
    h = mix(_segment_hash(prefix, start, end, BYTE_BASE) + (end - start).astype(U64)) if len(start) else np.empty(0, U64)
    return Words(np.searchsorted(start, off).astype(np.int64), start, end, h, data, off)


def word_hash(word: str) -> int:
    """Hash of one word, as ``tokenize`` gives it."""
    return int(tokenize(pa.array([word], pa.large_string()), np.ones(256, bool)).hash[0])

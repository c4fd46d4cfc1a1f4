"""Compressed integer columns in binary values, for keys that travel between chunks and tables."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as compressed byte planes."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], dtype="<i8").tobytes()
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + planes)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = int(raw[:8].view("<i8")[0])
    head = raw[8 : 8 + 16 * n].view("<i8").reshape(n, 2)
    at, out = 8 + 16 * n, []
    for width, length in head.tolist():
        part = raw[at : at + width * length].reshape(width, length).T
        out.append(np.ascontiguousarray(part).reshape(-1).view(f"<u{width}"))
        at += width * length
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """Unsigned counts in as few bytes as they need."""
    top = int(x.max(initial=0))
    return x.astype("u1" if top < 1 << 8 else "u2" if top < 1 << 16 else "u4" if top < 1 << 32 else "u8")


def deltas(x: np.ndarray) -> np.ndarray:
    return narrow(np.diff(x.astype(np.uint64), prepend=np.uint64(0)))


def undelta(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x.astype(np.uint64), dtype=np.uint64)


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    """Partition of a 64-bit key; ascending with the key."""
    return ((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)

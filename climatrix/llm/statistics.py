"""Per-document statistics of whole texts, computed slice-wise with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

from climatrix.llm import text as T

SYMBOLS = np.zeros(256, dtype=np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[0x41:0x5B] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[0x30:0x3A] = 1
_STOP = np.zeros(256, dtype=np.int64)
_STOP[list(b".!?")] = 1
_POINT = np.zeros(256, dtype=np.int64)
_POINT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 1
_ASCII = np.ones(256, dtype=np.int64)
_ASCII[0x80:] = 0
_POINTS = np.ones(256, dtype=np.int64)  # one per code point: continuation bytes don't count
_POINTS[0x80:0xC0] = 0


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeat_words(words: T.Words, k: int = 5) -> np.ndarray:
    """Words lying in a k-word window found twice or more in the same text, the first one included."""
    start, h = words.windows(k)
    n_docs = len(words.first) - 1
    if not len(start):
        return np.zeros(n_docs, dtype=np.int64)
    keyed = T.mix(h ^ T.mix(words.doc[start].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keyed, kind="stable")
    same = keyed[order][1:] == keyed[order][:-1]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(words.hash) + 1, dtype=np.int64)
    hit = start[order[twice]]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + k, -1)
    return per_text((np.cumsum(edge[:-1]) > 0).astype(np.int64), words.first)


def line_counts(body: str) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [x for x in body.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines), len(lines) - len(set(lines))


def basic(column: pa.Array) -> tuple[dict[str, np.ndarray], T.Words]:
    """Exact counts for each text of a large_string array without nulls."""
    w = T.tokenize(column)
    lines = [line_counts(x.as_py()) for x in column]
    points = np.zeros(len(w.data) + 1, dtype=np.int64)
    np.cumsum(_POINTS[w.data], out=points[1:])
    length = points[w.end] - points[w.start]
    return {
        "n_words": np.diff(w.first),
        "word_chars": per_text(length, w.first),
        "n_symbols": per_text(SYMBOLS[w.data], w.offsets),
        "n_lines": np.array([x[0] for x in lines], dtype=np.int64),
        "n_dup_lines": np.array([x[1] for x in lines], dtype=np.int64),
        "n_repeat_words": repeat_words(w),
        "n_bytes": np.diff(w.offsets),
        "n_points": points[w.offsets[1:]] - points[w.offsets[:-1]],
    }, w


FEATURES = (
    "bytes", "words", "mean_word", "sd_word", "long_words", "short_words", "upper", "digits", "symbols", "stops", "points",
    "ascii", "lines", "words_per_line", "dup_lines", "repeat_words", "distinct_words", "top_word", "words_per_stop", "zstd_ratio", "word_sym", "first_upper",
)


def features(column: pa.Array, compress: zstandard.ZstdCompressor) -> np.ndarray:
    """One row of ``FEATURES`` per text; an empty text gives zeros."""
    c, w = basic(column)
    n = len(column)
    n_words, n_bytes = c["n_words"], c["n_bytes"]
    by_word, by_byte = np.maximum(n_words, 1), np.maximum(n_bytes, 1)
    size = (w.end - w.start).astype(np.int64)
    mean = per_text(size, w.first) / by_word
    square = per_text(size * size, w.first) / by_word
    doc = w.doc
    order = np.lexsort((w.hash, doc))
    hs, ds = w.hash[order], doc[order]
    new = np.ones(len(hs), dtype=bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    distinct = np.bincount(ds[new], minlength=n)
    run = np.diff(np.append(np.flatnonzero(new), len(hs)))
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, ds[new], run)
    stops = per_text(_STOP[w.data], w.offsets)
    body = bytes(w.data)
    ratio = np.zeros(n)
    for i in range(n):
        if n_bytes[i]:
            ratio[i] = len(compress.compress(body[w.offsets[i] : w.offsets[i + 1]])) / n_bytes[i]
    sym = np.zeros(len(w.data) + 1, dtype=np.int64)
    np.cumsum(SYMBOLS[w.data], out=sym[1:])
    out = np.column_stack([
        n_bytes, n_words, mean, np.sqrt(np.maximum(square - mean * mean, 0)),
        per_text((size > 12).astype(np.int64), w.first) / by_word, per_text((size <= 3).astype(np.int64), w.first) / by_word,
        per_text(_UPPER[w.data], w.offsets) / by_byte, per_text(_DIGIT[w.data], w.offsets) / by_byte, c["n_symbols"] / by_byte,
        stops / by_word, per_text(_POINT[w.data], w.offsets) / by_byte, per_text(_ASCII[w.data], w.offsets) / by_byte,
        c["n_lines"], n_words / np.maximum(c["n_lines"], 1), c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / by_word,
        distinct / by_word, top / by_word, n_words / np.maximum(stops, 1), ratio,
        per_text((sym[w.end] > sym[w.start]).astype(np.int64), w.first) / by_word,
        per_text(_UPPER[w.data[w.start]], w.first) / by_word,
    ])
    return np.where((n_bytes == 0)[:, None], 0.0, out)

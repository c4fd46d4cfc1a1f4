"""Quality rules: base counts and compression bands.

A text is compressed with zstandard as a whole and in fixed chunks, the last of which ends with
the text, so every byte of a text of a chunk or more is judged in one; a shorter text is one
chunk, which the limits of its length judge. Repetitive text
compresses too well, noise too badly; what is normal depends on the
length, because short texts have little to refer back to and carry the
frame's overhead. ``BANDS`` states the limits by length.

Defined results: null and empty texts have no words, so the base rules reject
them; lengths without a band limit (texts of at most 64 bytes) pass the
method; every row is judged by itself, so ties and repeated rows don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from climatrix.llm import statistics
from climatrix.llm import text as T

LEVEL = 3
#: Bytes of a chunk; where the last would be shorter it begins earlier.
CHUNK = 4096
#: From this share of chunks outside their band on, the text is rejected.
CHUNK_SHARE = 0.5
#: Fixed limits: texts of at most so many bytes need a ratio (compressed by raw bytes) in [low, high].
BANDS = (
    (64, 0.0, 99.0),
    (200, 0.30, 2.0),
    (500, 0.34, 1.0),
    (2_000, 0.34, 0.88),
    (10_000, 0.30, 0.78),
    (float("inf"), 0.25, 0.72),
)
CHUNK_BAND = (0.30, 0.78)


def verdict(body: bytes, compress: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """Whole ratio, chunks, chunks outside their band, and whether the text is in its bands."""
    if not body:
        return 0.0, 0, 0, True
    ratio = len(compress.compress(body)) / len(body)
    _, low, high = next(b for b in BANDS if len(body) <= b[0])
    starts = [*range(0, len(body) - CHUNK, CHUNK), len(body) - CHUNK] if len(body) >= CHUNK else []
    chunks = len(starts)
    if not low <= ratio <= high:
        return ratio, chunks, 0, False
    out = 0
    for i in starts:
        r = len(compress.compress(body[i : i + CHUNK])) / CHUNK
        out += not CHUNK_BAND[0] <= r <= CHUNK_BAND[1]
    return ratio, chunks, out, not chunks or out < CHUNK_SHARE * chunks


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, zstd_ratio, chunks, chunks_out, base_failed, kept for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            col = T.texts(b.column("text"))
            for i, j in T.slices(col):
                c, w = statistics.basic(col[i:j])
                raw = bytes(T.raw(col[i:j])[0])
                found = [verdict(raw[w.offsets[k] : w.offsets[k + 1]], compress) for k in range(j - i)]
                failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
                fine = np.array([x[3] for x in found], dtype=bool)
                columns = [c[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[i:j], *(pa.array(x, pa.int64()) for x in columns), pa.array([x[0] for x in found], pa.float64()),
                     *(pa.array([x[k] for x in found], pa.int64()) for k in (1, 2)), pa.array(failed), pa.array(~failed & fine)],
                    NAMES,
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        T.releasing(run),
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "zstd_ratio double, chunks long, chunks_out long, base_failed boolean, kept boolean",
    )


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "zstd_ratio", "chunks", "chunks_out", "base_failed", "kept"]

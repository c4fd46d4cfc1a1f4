"""What a Python worker takes beside the batch that it works on."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
import pytest
import zstandard

from climatrix.llm import packing, statistics
from climatrix.llm import text as T


@pytest.fixture(scope="module")
def column():
    """4 MB in texts of 2 kB each, one of them null."""
    rows = [" ".join(f"w{(i * 37 + k * k) % 5000}" for k in range(350)) for i in range(2000)]
    return pa.array([None, *rows], pa.string())


def _peak_mb(work) -> float:
    T._POWERS.clear()
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_texts_of_a_batch_are_not_copied(column):
    before = pa.total_allocated_bytes()
    col = T.texts(column)
    assert pa.total_allocated_bytes() - before < 100_000  # offsets
    assert col.null_count == 0 and col.to_pylist() == ["", *column.to_pylist()[1:]]


def test_texts_of_slices_chunks_nulls_and_none():
    rows = ["a", None, "", "bé", None, "c d"]
    whole = pa.array(rows, pa.string())
    want = [x or "" for x in rows]
    assert T.texts(whole).to_pylist() == want
    assert T.texts(whole[1:5]).to_pylist() == want[1:5]
    assert T.texts(pa.chunked_array([whole[:2], whole[2:]])).to_pylist() == want
    assert T.texts(whole[:0]).to_pylist() == [] and T.texts(pa.array([None, None], pa.string())).to_pylist() == ["", ""]
    assert len(T.tokenize(T.texts(whole[1:])).hash) == 3


def test_bytes_hidden_by_a_null_are_no_text():
    _, offsets, data = pa.array(["ab", "cd", "ef"], pa.string()).buffers()
    hidden = pa.Array.from_buffers(pa.string(), 3, [pa.py_buffer(bytes([0b101])), offsets, data])
    assert hidden.to_pylist() == ["ab", None, "ef"]
    assert T.texts(hidden).to_pylist() == ["ab", "", "ef"]


def test_temporaries_of_a_batch_stay_small(column):
    encoder = packing.Encoder(packing.default_tokenizer())
    compress = zstandard.ZstdCompressor(level=1)
    col = T.texts(column)
    assert _peak_mb(lambda: [encoder.ids(col[i:j])[1][-1] for i, j in T.slices(col)]) < 30
    assert _peak_mb(lambda: [statistics.features(col[i:j], compress) for i, j in T.slices(col)]) < 30


def test_ids_do_not_depend_on_slices(column):
    col = T.texts(column)
    ids = [b"".join(packing.Encoder(packing.default_tokenizer()).ids(col[i:j])[0].tobytes() for i, j in T.slices(col, n)) for n in (1 << 16, 1 << 18, 1 << 20)]
    assert ids[0] == ids[1] == ids[2]


def test_new_words_are_encoded_some_at_a_time():
    encoder = packing.Encoder(packing.default_tokenizer())
    inner, sizes = encoder.tokenizer, []

    class Counting:
        def encode_batch_fast(self, words, **options):
            sizes.append(len(words))
            return inner.encode_batch_fast(words, **options)

    encoder.tokenizer = Counting()
    body = " ".join(f"zq{i}x" for i in range(70_000))
    column = pa.array([body, body], pa.large_string())
    ids, first = encoder.ids(column)
    again, _ = encoder.ids(column)
    assert max(sizes) <= 1000 and sum(sizes) == 70_000  # known the second time
    assert len(encoder.hash) == 70_000 and (ids == again).all()
    assert ids[: first[1]].tolist() == inner.encode(body, add_special_tokens=False).ids

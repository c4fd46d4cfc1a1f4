"""Best-fit packing of token pieces into sequences.

The plan is made on the length histogram alone (at most 2,048 numbers,
whatever the corpus): a configuration linear program, where a configuration is a
multiset of lengths that fits a sequence and the cover of each length must
reach its count. Multiplicative weights solve it approximately: a length covered
less weighs more, and a knapsack dynamic program prices the
configuration of greatest weight. Rounding takes whole copies of the configurations as far as the counts
last and packs what remains by best fit on the histogram. The k-th piece of a length then takes the k-th place
planned for that length; ranks come from hash buckets, so a length that a third
of all pieces share is numbered by many tasks.

Defined results: a null or empty text is the one closing token; rows equal
in all columns are packed one by one; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from climatrix.llm import text as T
from climatrix.llm.tables import numbered, stored

CAPACITY = 2048
END = 0
#: Pricing rounds at most, and how far one step may cover its scarcest length.
ROUNDS = 1200
STEP = 0.5
ETA = 4.0
#: Words whose ids a task keeps; others are encoded again.
KEPT_WORDS = 1_000_000
#: Words whose encodings, about 1 kB each, are held at a time.
ENCODED_WORDS = 1000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of whole texts by way of their words.

    White space ends every token of this kind of tokenizer and has none of its own, so a text's ids
    are those of its words in turn. It lower-cases, and no token holds a letter and a stop behind it;
    so words are looked up in lower case, without one closing stop, whose own id follows. (Texts with
    the marks of special tokens are left as they are.) Known words are kept as sorted
    hashes with their ids in one array: about 35 bytes a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.hash = np.empty(0, dtype=np.uint64)  # sorted
        self.begin = np.empty(0, dtype=np.int32)  # of each word's ids in flat
        self.size = np.empty(0, dtype=np.int32)
        self.flat = np.empty(0, dtype="<u4")
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words (hash, size, ids) to be put in their places, some thousands at a time
        self.stop = np.zeros(256, dtype="<u4")
        self.trim = np.zeros(256, dtype=bool)
        for c in ".,;:!?":
            own, _ = self._encode([c])
            if len(own) == 1:
                self.trim[ord(c)], self.stop[ord(c)] = True, own[0]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in turn, and how many each has."""
        flat, size = [np.empty(0, dtype="<u4")], [np.empty(0, dtype=np.int64)]
        for k in range(0, len(words), ENCODED_WORDS):
            own = [e.ids for e in self.tokenizer.encode_batch_fast(words[k : k + ENCODED_WORDS], add_special_tokens=False)]
            size.append(np.array([len(x) for x in own], dtype=np.int64))
            flat.append(np.fromiter((y for x in own for y in x), dtype="<u4", count=int(size[-1].sum())))
        return np.concatenate(flat), np.concatenate(size)

    def _learn(self, h: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Keep new words, as long as there is room; sorting them in waits until there are enough."""
        room = KEPT_WORDS - len(self.hash)
        if room <= 0:
            return
        size = size[:room]
        self.fresh.append((h[:room], size, ids[: size.sum()]))
        if sum(len(x) for x, _, _ in self.fresh) < min(room, 30_000):
            return
        h, size, ids = (np.concatenate([x[k] for x in self.fresh]) for k in range(3))
        self.fresh = []
        begin = np.cumsum(size) - size
        h, first = np.unique(h, return_index=True)
        begin, size = begin[first], size[first]
        ends = np.cumsum(size)
        own = ids[np.repeat(begin - (ends - size), size) + np.arange(size.sum())]
        begin = (len(self.flat) + ends - size).astype(np.int32)
        self.flat = np.concatenate([self.flat, own])
        at = np.searchsorted(self.hash, h)
        self.hash, self.begin, self.size = np.insert(self.hash, at, h), np.insert(self.begin, at, begin), np.insert(self.size, at, size.astype(np.int32))

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts, and where each text's begin (one more than texts)."""
        plain = b"<|" not in T.raw(column)[0].tobytes()
        w = T.tokenize(column, lower=plain, trim=self.trim if plain else None)
        h, at, which = np.unique(w.hash, return_index=True, return_inverse=True)
        begin, size = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        known = np.zeros(len(h), dtype=bool)
        if len(self.hash):
            place = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            known = self.hash[place] == h
            begin[known], size[known] = self.begin[place[known]], self.size[place[known]]
        new = np.flatnonzero(~known)
        flat, added = self.flat, np.empty(0, dtype="<u4")
        if len(new):
            body = w.data.tobytes()
            added, size[new] = self._encode([body[w.start[k] : w.end[k]].decode() for k in at[new].tolist()])
            begin[new] = len(flat) + np.cumsum(size[new]) - size[new]
            if plain:
                self._learn(h[new], added, size[new])
        trimmed = np.zeros(len(w.hash), dtype=np.int64)
        if plain and len(w.hash):
            behind = w.data[np.minimum(w.end, len(w.data) - 1)]
            trimmed = (w.end < np.append(w.offsets[1:], 0)[w.doc]) & self.trim[behind] & T.SPACED[behind]
            trimmed = trimmed.astype(np.int64)
        count = size[which]
        ends = np.concatenate([[0], np.cumsum(count + trimmed)])
        out = np.empty(ends[-1], dtype="<u4")
        slot = np.ones(ends[-1], dtype=bool)
        last = ends[1:][trimmed > 0] - 1
        slot[last] = False
        word_ends = np.concatenate([[0], np.cumsum(count)])
        place = np.repeat(begin[which] - word_ends[:-1], count) + np.arange(word_ends[-1])
        kept = place < len(flat)
        found = np.empty(len(place), dtype="<u4")
        found[kept], found[~kept] = flat[place[kept]], added[place[~kept] - len(flat)]
        out[slot] = found
        if len(last):
            out[last] = self.stop[behind[trimmed > 0]]
        return out, ends[w.first]


_ENCODERS: dict[str, Encoder] = {}


def shared_encoder(path: str) -> Encoder:
    """The worker process's encoder: its words serve all tasks that the worker runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        closing = np.array([END], dtype="<u4").tobytes()
        for b in batches:
            col = T.texts(b.column("text"))
            for i, j in T.slices(col):
                ids, first = encoder.ids(col[i:j])
                raw, out = ids.tobytes(), []
                for d in range(j - i):
                    own = raw[4 * first[d] : 4 * first[d + 1]] + closing
                    out += [(d, k, s, len(p) // 4, zlib.crc32(p)) for k, s in enumerate(range(0, len(own) // 4, capacity)) for p in [own[4 * s : 4 * (s + capacity)]]]
                table = np.array(out, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[i:j].take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32)), *(pa.array(table[:, k]) for k in (2, 3, 4))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(T.releasing(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def price(value: np.ndarray, capacity: int) -> dict[int, int]:
    """Unbounded knapsack: the multiset of lengths of greatest value that fits. ``value`` is by length, 0 for absent ones."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        with_item = value[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(with_item.argmax())
        if with_item[k] > best[c - 1]:
            best[c], choice[c] = with_item[k], k + 1
        else:
            best[c] = best[c - 1]
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        k = int(choice[c])
        if k and value[k] > 0:
            out[k] = out.get(k, 0) + 1
            c -= k
        else:
            c -= 1
    return out


def fractional(counts: dict[int, int], capacity: int, rounds: int = ROUNDS) -> dict[tuple, float]:
    """Configurations ((length, times), ...) and their amounts by multiplicative weights."""
    if not counts:
        return {}
    lengths = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[x] for x in lengths.tolist()], dtype=float)
    at = {int(x): i for i, x in enumerate(lengths)}
    cover, amount = np.zeros(len(n)), {}
    for _ in range(rounds):
        if cover.min() >= 1:
            break
        value = np.zeros(capacity + 1)
        open_ = cover < 1
        value[lengths[open_]] = np.exp(-ETA * (cover[open_] - cover.min())) / n[open_]
        config = price(value, capacity)
        step = STEP * min(n[at[x]] / k for x, k in config.items())
        key = tuple(sorted(config.items(), reverse=True))
        amount[key] = amount.get(key, 0.0) + step
        for x, k in config.items():
            cover[at[x]] += k * step / n[at[x]]
    return amount


def plan(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple, int]]:
    """Configurations and how many sequences use each; every piece is placed."""
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    if capacity in left:
        out.append((((capacity, 1),), left.pop(capacity)))
    amounts = fractional(left, capacity, rounds)
    for config, amount in sorted(amounts.items(), key=lambda x: (-sum(a * b for a, b in x[0]), x[0])):
        if sum(a * b for a, b in config) < capacity:
            continue  # not full: best fit does no worse
        copies = min(int(amount), *(left[x] // k for x, k in config))
        if copies:
            out.append((config, copies))
            for x, k in config:
                left[x] -= k * copies
    order = sorted(x for x, v in left.items() if v)
    while order:
        config, room, used = [], capacity, {}
        while room:
            i = bisect_right(order, room) - 1
            while i >= 0 and left[order[i]] <= used.get(order[i], 0):
                i -= 1
            if i < 0:
                break
            used[order[i]] = used.get(order[i], 0) + 1
            room -= order[i]
        config = tuple(sorted(used.items(), reverse=True))
        copies = min(left[x] // k for x, k in config)
        out.append((config, copies))
        for x, k in config:
            left[x] -= k * copies
        order = [x for x in order if left[x]]
    return out


def places(planned: list[tuple[tuple, int]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, times in a sequence, offset) in order of rank."""
    out: dict[int, list] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for config, copies in planned:
        offset = 0
        for length, times in config:
            out.setdefault(length, []).append((rank.get(length, 0), sequence, times, offset))
            rank[length] = rank.get(length, 0) + times * copies
            offset += length * times
        sequence += copies
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = stored(pieces(docs, tokenizer or default_tokenizer(), capacity), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    where = places(plan(counts, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "slot"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                own = np.flatnonzero(length == x)
                table = where[x]
                row = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
                over = rank[own] - row[:, 0]
                sequence[own] = row[:, 1] + over // row[:, 2]
                offset[own] = row[:, 3] + over % row[:, 2] * x
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = numbered(cut, "length", ["doc_id", "piece"], ["doc_id", "piece", "ids_crc32"], whole_buckets=True)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "slot")
    return rows.mapInArrow(T.releasing(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

"""Exact substring dedup with prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of one document. Every word in a
window whose words also start earlier (smaller id, or earlier in the same document) is
removed; windows are judged on the input.

A suffix tree of all windows would be many times the corpus, so windows that can't
be repeated are left out first, without loss. The anchor of a window is its smallest
8-word hash, the same wherever the window's words stand; neighbouring
windows with one anchor form a run. Each chunk of documents asks the anchor table, once per distinct
run: was this whole run seen earlier (then its windows are
removed), and does its anchor stand in other runs too? Only windows of first runs whose anchor
does go into trees.

Their suffixes are dealt into groups by their first word; a group too
large for memory is split by longer prefixes (2, 4, 8, all 20 words), and, if
even equal windows are too many, by chunk. Each group's suffixes are sorted, the common prefixes of
neighbours give the tree's internal nodes, and every node as deep as a window holds the
places of one repeated text, all but the first of which are removed. Groups split by chunk hand the first place of
each node on, and the smallest wins. Joined neighbouring windows are the
maximal repeats.

Words are told apart by 64-bit hashes. Defined results: null and empty texts have no words; a
null id sorts first; rows that share an id count as documents of
their own, in an order that is the same for all windows; other columns play
no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climatrix.llm import text as T
from climatrix.llm.blobs import deltas, narrow, pack, part_of, undelta, unpack
from climatrix.llm.tables import bucketed, stored

WINDOW, GRAM = 20, 8
CHUNK_BYTES = 6 << 20
PARTITION_BYTES = 8 << 20
#: Suffixes that one task sorts at a time.
GROUP = 100_000
#: Most names of large groups that are sent to every executor.
BROADCAST_ROWS = 200_000
DEPTHS = (1, 2, 4, 8, WINDOW)
_LOW = np.uint64((1 << 24) - 1)


def _chunks(docs: DataFrame) -> DataFrame:
    """chunk, doc_id (array), ends (array of byte places), body: texts in rows of about ``CHUNK_BYTES``."""

    def emit(rows: list[tuple], chunk: int) -> pa.RecordBatch:
        ids = pa.concat_arrays([x[0] for x in rows])
        ends = np.cumsum(np.concatenate([x[1] for x in rows]))
        body = zstandard.ZstdCompressor(level=1).compress(b"".join(x[2] for x in rows))
        one = pa.array([0, len(ids)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk]), pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, pa.array(ends, pa.int64())), pa.array([body], pa.binary())],
            ["chunk", "doc_id", "ends", "body"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, rows, size = TaskContext.get().partitionId() << 20, [], 0
        for b in batches:
            col = T.texts(b.column("text"))
            for i, j in T.slices(col, CHUNK_BYTES // 4):
                data, off = T.raw(col[i:j])
                rows.append((b.column("doc_id").slice(i, j - i), np.diff(off), data.tobytes()))
                size += len(data)
                if size >= CHUNK_BYTES or sum(len(x[0]) for x in rows) >= 1 << 18:
                    yield emit(rows, chunk)
                    chunk, rows, size = chunk + 1, [], 0
        if rows:
            yield emit(rows, chunk)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(T.releasing(run), "chunk long, doc_id array<long>, ends array<long>, body binary")


class _Chunk:
    """A chunk's words and its anchor runs: gram, seg (hash of a run's words), start, count, doc."""

    def __init__(self, row: pa.Table, window: int):
        self.row, self.window = row, window
        ids = row.column("doc_id").combine_chunks()
        ids = (ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids)[0].values
        self.ids = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        self.raw_ids = ids
        ends = row.column("ends")[0].values.to_numpy(zero_copy_only=False)
        self.offsets = np.concatenate([[0], ends]).astype(np.int64)
        self.body = zstandard.ZstdDecompressor().decompress(row.column("body")[0].as_py())
        column = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(self.offsets.tobytes()), pa.py_buffer(self.body))
        parts = [T.tokenize(column[i:j]) for i, j in T.slices(column)]
        self.hash = np.concatenate([w.hash for w in parts])
        count = np.concatenate([np.diff(w.first) for w in parts])
        del parts
        self.first = np.concatenate([[0], np.cumsum(count)])
        words = T.Words(self.first, None, None, self.hash, None, None)
        start, gram = words.windows(GRAM)
        n = len(self.hash)
        low = np.full(n + window, np.iinfo(np.uint64).max, dtype=np.uint64)
        low[start] = (gram & ~_LOW) | (start.astype(np.uint64) & _LOW)
        by_place = np.zeros(n, dtype=np.uint64)
        by_place[start] = gram
        width, need = 1, window - GRAM + 1
        while 2 * width <= need:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if need > width:
            low = np.minimum(low[: len(low) - (need - width)], low[need - width :])
        last = np.repeat(self.first[1:], count) - window
        at = np.flatnonzero(np.arange(n) <= last)
        anchor = at + (((low[at] & _LOW).astype(np.int64) - at) & int(_LOW))
        new = np.ones(len(at), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(at))
        self.start, self.count, anchor = at[begin], end - begin, anchor[begin]
        self.gram = by_place[anchor]
        self.seg = T.mix(words.spans(self.start, self.start + self.count - 1 + window) ^ (anchor - self.start).astype(np.uint64)) if len(at) else self.gram
        self.doc = np.searchsorted(self.first, self.start, side="right") - 1
        # The first place of each distinct run, by id and then place.
        rank = np.empty(len(self.ids), dtype=np.int64)
        rank[np.argsort(self.ids, kind="stable")] = np.arange(len(self.ids))
        order = np.lexsort((self.start, rank[self.doc], self.seg, self.gram))
        lead = np.ones(len(order), dtype=bool)
        lead[1:] = self.seg[order][1:] != self.seg[order][:-1]
        self.entry = order[lead]  # ascending by gram

    def asks(self, parts: int) -> list[tuple[int, bytes]]:
        """(partition, ask) for the partitions that the chunk has runs of: never more asks than runs."""
        part = part_of(self.gram[self.entry], parts)
        present, begin = np.unique(part, return_index=True)  # only the partitions that it has runs of
        end = np.append(begin, len(part))[1:]
        ids = self.ids.view(np.uint64)
        return [(p, pack(deltas(self.gram[e]), self.seg[e], ids[self.doc[e]])) for p, a, b in zip(present.tolist(), begin, end, strict=True) for e in [self.entry[a:b]]]

    def judged(self, answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Runs whose windows are all removed, and runs whose windows go into trees."""
        flags = np.concatenate([np.empty(0, np.uint8), *(unpack(a)[0] for a in answers)])
        gone = np.ones(len(self.start), dtype=bool)
        gone[self.entry] = (flags & 1) == 0
        tree = np.zeros(len(self.start), dtype=bool)
        tree[self.entry] = flags == 3
        return gone, tree

    def windows_of(self, runs: np.ndarray) -> np.ndarray:
        """Starts of the windows of the marked runs, in order."""
        start, count = self.start[runs], self.count[runs]
        return np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else start, count) + np.arange(count.sum())


def _anchor_table(chunks: DataFrame, parts: int, window: int) -> DataFrame:
    """chunk, part, answer: for each run that the chunk asked for, 1 if it is the run's first place, plus 2 if its anchor has other runs."""

    def ask(body: pa.Table) -> pa.Table:
        out = _Chunk(body, window).asks(parts)
        chunk = [body.column("chunk")[0].as_py()] * len(out)
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "part": pa.array([p for p, _ in out], pa.int32()), "ask": pa.array([a for _, a in out], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        got = [unpack(x) for x in table.column("ask").to_pylist()]
        sizes = np.array([len(g[0]) for g in got])
        gram, seg = np.concatenate([undelta(g[0]) for g in got]), np.concatenate([g[1].astype(np.uint64) for g in got])
        ids = np.concatenate([g[2].astype(np.uint64) for g in got]).view(np.int64)
        chunk = np.repeat(table.column("chunk").to_numpy(), sizes)
        order = np.lexsort((chunk, ids, seg, gram))
        lead = np.ones(len(order), dtype=bool)
        lead[1:] = (seg[order][1:] != seg[order][:-1]) | (gram[order][1:] != gram[order][:-1])
        grams, which, n = np.unique(gram[order[lead]], return_inverse=True, return_counts=True)
        flags = np.zeros(len(order), dtype=np.uint8)
        flags[order[lead]] = 1
        run = np.cumsum(lead) - 1
        flags[order] += np.where(n[which][run] > 1, 2, 0).astype(np.uint8)
        ends = np.cumsum(sizes)
        answers = [pack(flags[e - s : e]) for s, e in zip(sizes, ends, strict=True)]
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "answer": pa.array(answers, pa.binary())})

    asked = chunks.groupBy("chunk").applyInArrow(ask, "chunk long, part int, ask binary")  # one chunk in memory at a time
    return asked.groupBy("part").applyInArrow(total, "chunk long, part int, answer binary")


def _by_part(told: pa.Table) -> list[bytes]:
    return [a for _, a in sorted(zip(told.column("part").to_pylist(), told.column("answer").to_pylist(), strict=True))]


def _packed_suffixes(at: np.ndarray, ids: np.ndarray, words: np.ndarray) -> bytes:
    """Places in the chunk's list, document ids, and the windows' words by a word list of their own."""
    known, which = np.unique(words, return_inverse=True)
    return pack(deltas(at), ids.view(np.uint64), known, narrow(which.reshape(-1)))


def _unpacked_suffixes(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, ids, known, which = unpack(blob)
    return undelta(at).astype(np.int64), ids.view(np.int64), known[which].reshape(len(at), -1)


def _prefix(words: np.ndarray, depth: int) -> np.ndarray:
    h = np.full(len(words), depth, dtype=np.uint64)
    for k in range(min(depth, words.shape[1])):
        h = T.mix(h ^ words[:, k]) + np.uint64(1)
    return T.mix(h)


def _dealt(chunk: int, at: np.ndarray, ids: np.ndarray, words: np.ndarray, group: np.ndarray, depth: int) -> pa.RecordBatch:
    order = np.argsort(group, kind="stable")
    names, begin = np.unique(group[order], return_index=True)
    cut = np.append(begin, len(order))
    own = [order[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk] * len(own), pa.int64()), pa.array(names.astype(np.int64)), pa.array([depth] * len(own), pa.int32()), pa.array([len(o) for o in own], pa.int64()), pa.array([_packed_suffixes(at[o], ids[o], words[o]) for o in own], pa.binary())],
        ["chunk", "grp", "depth", "n", "suffixes"],
    )


_SUFFIXES = "chunk long, grp long, depth int, n long, suffixes binary"


def _suffixes(chunks: DataFrame, answers: DataFrame, parts: int, window: int) -> DataFrame:
    """Suffixes that may be repeated, in groups by their first word."""

    def run(body: pa.Table, told: pa.Table) -> pa.Table:
        if not body.num_rows:
            return pa.Table.from_batches([_dealt(0, *(np.empty(0, np.int64),) * 2, np.empty((0, window), np.uint64), np.empty(0, np.int64), 1)])
        c = _Chunk(body, window)
        _, tree = c.judged(_by_part(told))
        start = c.windows_of(tree)
        words = c.hash[start[:, None] + np.arange(window)[None, :]]
        doc = np.searchsorted(c.first, start, side="right") - 1
        group = part_of(_prefix(words, DEPTHS[0]), parts)
        return pa.Table.from_batches([_dealt(body.column("chunk")[0].as_py(), np.arange(len(start)), c.ids[doc], words, group, DEPTHS[0])])

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, _SUFFIXES)


def _memory_sized(suffixes: DataFrame, limit: int) -> DataFrame:
    """The suffixes with every group of more than ``limit`` split by longer and longer prefixes, at last by chunk."""
    for depth in [*DEPTHS[1:], 0]:
        names = stored(suffixes.groupBy("grp").agg(F.sum("n").alias("n")).where(F.col("n") > limit).select("grp"), "large-groups")
        large = names.count()  # fewer than suffixes / limit
        if not large:
            break
        names = F.broadcast(names) if large <= BROADCAST_ROWS else names

        def split(batches: Iterator[pa.RecordBatch], depth: int = depth) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for chunk, old, blob in zip(b.column("chunk").to_pylist(), b.column("grp").to_pylist(), b.column("suffixes").to_pylist(), strict=True):
                    at, ids, words = _unpacked_suffixes(blob)
                    if depth:  # 64 new groups for each old one at every step, none of them an old one
                        new = T.mix((_prefix(words, depth) >> np.uint64(58)) + np.uint64(old % 2**62) * np.uint64(64)).view(np.int64)
                    else:
                        new = np.full(len(at), hash((old, chunk)), dtype=np.int64)
                    yield _dealt(chunk, at, ids, words, new | np.int64(1 << 62), depth)

        made = stored(suffixes.join(names, "grp", "left_semi").select("chunk", "grp", "suffixes").mapInArrow(T.releasing(split), _SUFFIXES), "split-suffixes")
        suffixes = suffixes.join(names, "grp", "left_anti").select("chunk", "grp", "depth", "n", "suffixes").unionByName(made)
    return suffixes


def _repeats(suffixes: DataFrame) -> DataFrame:
    """chunk, gone: places in the chunk's suffix list whose window has an earlier place."""

    def tree(table: pa.Table) -> pa.Table:
        got = [_unpacked_suffixes(x) for x in table.column("suffixes").to_pylist()]
        sizes = np.array([len(g[0]) for g in got])
        chunk = np.repeat(table.column("chunk").to_numpy(), sizes)
        at, ids = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        words = np.concatenate([g[2] for g in got])
        _, rank = np.unique(words, return_inverse=True)
        rank = rank.reshape(words.shape).astype(np.int32)
        order = np.lexsort((at, chunk, ids, *(rank[:, k] for k in range(words.shape[1] - 1, -1, -1))))
        s = rank[order]
        differ = s[1:] != s[:-1]
        # Length of the common prefix of sorted neighbours: an internal node as deep as the window is a run of full lengths.
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1])
        leads = np.ones(len(order), dtype=bool)
        leads[1:] = common < words.shape[1]
        gone = order[~leads]
        out_chunk, out_at = [], []
        for c in np.unique(chunk[gone]).tolist():
            out_chunk.append(c)
            out_at.append(pack(deltas(np.sort(at[gone[chunk[gone] == c]]))))
        split = table.column("depth")[0].as_py() == 0
        first = order[leads] if split else order[:0]
        n, m = len(out_chunk), len(first)
        both = lambda a, b: pa.concat_arrays([a, b])
        return pa.table({
            "chunk": both(pa.array(out_chunk, pa.int64()), pa.array(chunk[first], pa.int64())),
            "gone": both(pa.array(out_at, pa.binary()), pa.nulls(m, pa.binary())),
            "node": both(pa.nulls(n, pa.int64()), pa.array(_prefix(words[first], words.shape[1]).view(np.int64))),
            "doc_id": both(pa.nulls(n, pa.int64()), pa.array(ids[first], pa.int64())),
            "at": both(pa.nulls(n, pa.int64()), pa.array(at[first], pa.int64())),
        })

    found = stored(suffixes.groupBy("grp").applyInArrow(tree, "chunk long, gone binary, node long, doc_id long, at long"), "tree-repeats")
    nodes = found.where("node IS NOT NULL")
    if nodes.isEmpty():
        return found.select("chunk", "gone")
    first = nodes.groupBy("node").agg(F.min(F.struct("doc_id", "chunk", "at")).alias("first"))
    later = nodes.join(first, "node").where("struct(doc_id, chunk, at) <> first").select("chunk", "at").distinct()

    def packed(table: pa.Table) -> pa.Table:
        at = np.sort(table.column("at").to_numpy())
        return pa.table({"chunk": table.column("chunk")[:1], "gone": pa.array([pack(deltas(at))], pa.binary())})

    return found.where("gone IS NOT NULL").select("chunk", "gone").unionByName(later.groupBy("chunk").applyInArrow(packed, "chunk long, gone binary"))


def deduplicated(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """doc_id (long), n_words, n_removed, removed (word ranges, ends exclusive), kept (remaining words joined by a space) for every row."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(64, -(-size // PARTITION_BYTES))
    chunks = bucketed(_chunks(docs), "substring_chunks", "chunk")
    answers = stored(_anchor_table(chunks, parts, window), "anchor-answers")
    suffixes = stored(_suffixes(chunks, answers, parts, window), "suffixes")
    repeats = _repeats(_memory_sized(suffixes, group))

    def run(body: pa.Table, told: pa.Table) -> pa.Table:
        kind, blob = told.column("kind").to_pylist(), told.column("answer").to_pylist()
        c = _Chunk(body, window)
        gone, tree = c.judged(_by_part(told.filter(pa.array([k == 0 for k in kind], pa.bool_()))))
        edge = np.zeros(len(c.hash) + window + 1, dtype=np.int64)
        np.add.at(edge, c.start[gone], 1)
        np.add.at(edge, (c.start + c.count - 1 + window)[gone], -1)
        start = c.windows_of(tree)
        for k, b in zip(kind, blob, strict=True):
            if k == 1:
                at = start[undelta(unpack(b)[0]).astype(np.int64)]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
        removed = np.cumsum(edge[: len(c.hash)]) > 0
        total = np.concatenate([[0], np.cumsum(removed)])
        n_removed = total[c.first[1:]] - total[c.first[:-1]]
        kept, spans = [], []
        for d in range(len(c.ids)):
            words = c.body[c.offsets[d] : c.offsets[d + 1]].split()
            if n_removed[d]:
                mask = removed[c.first[d] : c.first[d + 1]]
                turn = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
                spans.append([{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)])
                words = [x for x, m in zip(words, mask.tolist(), strict=True) if not m]
            else:
                spans.append([])
            kept.append(b" ".join(words).decode())
        return pa.table({
            "doc_id": c.raw_ids, "n_words": pa.array(np.diff(c.first), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.string()),
        })

    told = answers.select("chunk", F.lit(0).alias("kind"), "part", "answer").unionByName(
        repeats.select("chunk", F.lit(1).alias("kind"), F.lit(0).alias("part"), F.col("gone").alias("answer"))
    )
    schema = "doc_id long, n_words long, n_removed long, removed array<struct<start:bigint,end:bigint>>, kept string"
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, schema)

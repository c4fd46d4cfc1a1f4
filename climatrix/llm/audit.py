"""Filter interaction audit over a sparse document-term matrix.

``document_term_matrix`` tokenises whole texts into CSR shards: each task counts the words of about
``SHARD_BYTES`` of texts against a vocabulary of its own, all vocabularies together make the global
dictionary (every distinct word numbered once, gapless), and a shard's columns are replaced by the
dictionary's numbers. A shard asks each slice of the dictionary once for all of its distinct words there, so a word
that stands in every document is asked for once a shard, and no slice grows with it. Row sums of the matrix are word
counts, its nonzero counts distinct words; they decide filters A and B. C and D are counted in the same pass,
and E compares ids within equal texts.

What removes a document in any order depends only on the set of filters it fails. So documents are
summed per part, failed set and label first (equal texts already in the tasks that read them), and the 120 orders are
evaluated on those sums.

Defined results: a null text counts as empty, a null source as the part ''. A document with a null id is never a
copy of another. Rows equal in id and text count each, and aren't copies of one another. A document's label
is 1 if any label row of its id says so; null ids have none. An empty table gives no rows. Other columns play no part.
A text of any length is cut at white space into pieces of ``PIECE_BYTES``, whose counts are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from climatrix.llm import text as T
from climatrix.llm.blobs import deltas, narrow, pack, part_of, undelta, unpack
from climatrix.llm.tables import stored

FILTERS = "ABCDE"
MIN_WORDS = 200
#: Bytes of texts in a CSR shard (one document at least), and in one step of tokenising.
SHARD_BYTES = 8 << 20
PIECE_BYTES = 2 << 20
#: Bytes of words asked of one slice of the dictionary.
SLICE_BYTES = 16 << 20

_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[0x41:0x5B] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#$%&*|"]] = True


def pieces(data: np.ndarray, off: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``limit`` that cut no word: they end at the border of a text or behind white space."""
    a, n = 0, len(data)
    while a < n:
        b = min(a + limit, n)
        if b < n:
            border = int(off[np.searchsorted(off, b, "right") - 1])
            if border > a:
                b = border
            else:
                gaps = np.flatnonzero(~T.SPACED[data[a:b]])
                if len(gaps):
                    b = a + int(gaps[-1]) + 1
                else:  # one word longer than a piece
                    end = int(off[np.searchsorted(off, a, "right")])
                    gaps = np.flatnonzero(~T.SPACED[data[b:end]])
                    b = b + int(gaps[0]) + 1 if len(gaps) else end
        yield a, b
        a = b


def _counted(data: np.ndarray, off: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Text, term and count of the distinct (text, term) pairs in the bytes [a, b), and the terms."""
    piece = data[a:b]
    inside = np.zeros(b - a + 2, dtype=bool)
    inside[1:-1] = T.SPACED[piece]
    begin, stop = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = off[np.searchsorted(off, a, "right") : np.searchsorted(off, b, "left")] - a  # a text's border ends a word
    begin[cut] = inside[1:-1][cut]
    stop[cut - 1] = inside[1:-1][cut - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    offsets = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=offsets[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(piece[inside[1:-1]])])
    coded = words.dictionary_encode()
    lo, hi = int(np.searchsorted(off, a, "right")) - 1, int(np.searchsorted(off, b, "left"))
    doc = np.repeat(np.arange(lo, hi), np.diff(np.searchsorted(start, np.clip(off[lo : hi + 1] - a, 0, b - a))))
    width = max(len(coded.dictionary), 1)
    pair, n = np.unique(doc * width + coded.indices.to_numpy(), return_counts=True)
    return pair // width, pair % width, n, coded.dictionary


class _Shard:
    """Counts of a run of whole texts."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
        self.bytes = 0

    def rows(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """indptr, column and count of the texts [first, last), and the shard's terms, ascending by hash."""
        if not self.parts:
            return np.zeros(last - first + 1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), pa.array([], pa.large_binary())
        coded = pa.concat_arrays([p[3] for p in self.parts]).dictionary_encode()
        terms = coded.dictionary
        order = np.argsort(_hashes(_joined(terms)), kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        at, base = rank[coded.indices.to_numpy()], np.cumsum([0, *(len(p[3]) for p in self.parts)])
        term = np.concatenate([at[base[i] + p[1]] for i, p in enumerate(self.parts)])
        doc = np.concatenate([p[0] for p in self.parts]) - first
        n = np.concatenate([p[2] for p in self.parts])
        if any(len(x[0]) and len(y[0]) and x[0][-1] == y[0][0] for x, y in zip(self.parts, self.parts[1:], strict=False)):
            # A text was cut into pieces: add up what they have in common.
            pair, back = np.unique(doc * len(terms) + term, return_inverse=True)
            n = np.bincount(back, weights=n, minlength=len(pair)).astype(np.int64)
            doc, term = pair // len(terms), pair % len(terms)
        indptr = np.searchsorted(doc, np.arange(last - first + 1))
        return indptr, term, n, terms.take(pa.array(order))


def _joined(terms: pa.Array) -> bytes:
    """Words as one text; no word holds a space."""
    return b" ".join(terms.to_pylist())


def _split(joined: bytes) -> pa.Array:
    """The words of ``_joined``."""
    data = np.frombuffer(joined, np.uint8)
    gap = np.flatnonzero(data == 0x20)
    offsets = np.zeros(len(gap) + 2 if len(data) else 1, dtype=np.int64)
    if len(data):
        offsets[1:-1] = gap - np.arange(len(gap))
        offsets[-1] = len(data) - len(gap)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.delete(data, gap))])


def _hashes(joined: bytes) -> np.ndarray:
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 1, [None, pa.py_buffer(np.array([0, len(joined)])), pa.py_buffer(joined)])
    return T.tokenize(whole).hash


def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def local_shards(docs: DataFrame) -> DataFrame:
    """CSR shards of ``docs`` (doc_id, part, copy, text) with vocabularies of their own.

    shard, doc_ids, parts, copies, failed (bits of filters C and D), csr (indptr, columns, counts; see
    ``blobs``), terms (joined by spaces, ascending by hash), n_bytes of them.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            data, off = T.raw(T.texts(b.column("text")))
            size = b.num_rows
            capital, symbol, chars = (np.zeros(size, dtype=np.int64) for _ in range(3))

            def made(number: int, first: int, last: int, shard: _Shard) -> pa.RecordBatch:
                indptr, column, n, terms = shard.rows(first, last)
                one, joined = slice(first, last), _joined(terms)
                failed = (100 * capital[one] > 2 * chars[one]) * 4 + (symbol[one] > 0) * 8
                lists = [_list(b.column(c).slice(first, last - first)) for c in ("doc_id", "part", "copy")]
                csr = pack(deltas(indptr), narrow(column), narrow(n))
                return pa.RecordBatch.from_arrays(
                    [pa.array([number]), *lists, _list(pa.array(failed, pa.int32())), pa.array([csr], pa.binary()), pa.array([joined], pa.binary()), pa.array([len(joined)])],
                    ["shard", "doc_ids", "parts", "copies", "failed", "csr", "terms", "n_bytes"],
                )

            first, shard = 0, _Shard()
            for x, y in pieces(data, off):
                lo, hi = int(np.searchsorted(off, x, "right")) - 1, int(np.searchsorted(off, y, "left"))
                if shard.bytes >= SHARD_BYTES and off[lo] == x:
                    yield made(number, first, lo, shard)
                    first, shard, number = lo, _Shard(), number + 1
                shard.parts.append(_counted(data, off, x, y))
                shard.bytes += y - x
                border = np.clip(off[lo : hi + 1], x, y) - x
                piece = data[x:y]
                for total, mask in ((capital, _CAPITAL[piece]), (symbol, _SYMBOL[piece]), (chars, (piece & 0xC0) != 0x80)):
                    total[lo:hi] += np.diff(np.append(0, np.cumsum(mask, dtype=np.int64))[border])
            if size:
                yield made(number, first, size, shard)
                number += 1

    return docs.select("doc_id", "part", "copy", "text").mapInArrow(
        T.releasing(run), f"shard long, doc_ids array<{kind}>, parts array<string>, copies array<binary>, failed array<int>, csr binary, terms binary, n_bytes long"
    )


def dictionary_numbers(shards: DataFrame) -> DataFrame:
    """shard, slice, first, numbers: the dictionary's numbers of each shard's terms, in their order.

    The dictionary is cut into slices of the hash range, each small enough for a task. A shard asks a slice once
    for all of its words there; the slice numbers its distinct words, and ``first`` counts the words of the slices before.
    """
    slices = int((shards.agg(F.sum("n_bytes")).first()[0] or 0) // SLICE_BYTES) + 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, joined in zip(b.column("shard").to_pylist(), b.column("terms").to_pylist(), strict=True):
                if not joined:
                    continue
                terms, at = _split(joined), part_of(_hashes(joined), slices)
                present, cut = np.unique(at, return_index=True)
                ends = np.append(cut[1:], len(at))
                asked = [_joined(terms.slice(i, j - i)) for i, j in zip(cut.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(present), pa.array([shard] * len(present), pa.int64()), pa.array(asked, pa.binary())], ["slice", "shard", "terms"])

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        words = [_split(joined.as_py()) for joined in table.column("terms")]
        coded = pa.concat_arrays(words).dictionary_encode()
        cut = np.cumsum([0, *map(len, words)])
        own = coded.indices.to_numpy().astype(np.uint32)
        blobs = [pack(narrow(own[i:j])) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        distinct = pa.array([len(coded.dictionary)] * len(words), pa.int64())
        return pa.table({"slice": table.column("slice"), "shard": table.column("shard"), "numbers": pa.array(blobs, pa.binary()), "distinct": distinct})

    asked = shards.select("shard", "terms").mapInArrow(T.releasing(ask), "slice long, shard long, terms binary")
    made = stored(asked.groupBy("slice").applyInArrow(number, "slice long, shard long, numbers binary, distinct long"), "audit-numbers")
    sizes = made.groupBy("slice").agg(F.first("distinct").alias("distinct"))  # one row a slice
    before = F.coalesce(F.sum("distinct").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first")
    return made.join(sizes.select("slice", before), "slice").select("shard", "slice", "first", "numbers")


def document_term_matrix(docs: DataFrame) -> DataFrame:
    """CSR shards of ``docs`` (doc_id, part, copy, text) over the global dictionary: shard, doc_ids, parts, copies, failed, csr.

    ``csr`` holds indptr (as differences), the dictionary numbers of the nonzero columns, and their counts.
    """
    local = stored(local_shards(docs), "audit-shards")
    numbers = dictionary_numbers(local).groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("slice", "first", "numbers"))).alias("coded"))
    joined = local.drop("terms", "n_bytes").join(numbers, "shard", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = []
            for csr, coded in zip(b.column("csr").to_pylist(), b.column("coded").to_pylist(), strict=True):
                lengths, column, n = unpack(csr)
                number = np.concatenate([np.empty(0, np.uint64), *(unpack(x["numbers"])[0].astype(np.uint64) + np.uint64(x["first"]) for x in coded or [])])
                blobs.append(pack(lengths, narrow(number[column]), n))
            yield b.drop_columns(["coded", "csr"]).append_column("csr", pa.array(blobs, pa.binary()))

    return joined.mapInArrow(T.releasing(run), joined.drop("coded", "csr").withColumn("csr", F.lit(b"")).schema)


def document_flags(matrix: DataFrame) -> DataFrame:
    """doc_id, part, copy, n_words, n_distinct and failed (bits of A to D) of every row of the matrix."""
    kind = matrix.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c).slice(i, 1).flatten() for c in ("doc_ids", "parts", "copies", "failed")}
                lengths, _, n = unpack(b.column("csr")[i].as_py())
                indptr = undelta(lengths).astype(np.int64)
                before = np.append(0, np.cumsum(n, dtype=np.int64))
                words, distinct = before[indptr[1:]] - before[indptr[:-1]], np.diff(indptr)
                failed = row["failed"].to_numpy() + (words < MIN_WORDS) * 1 + (100 * distinct < 50 * words) * 2
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"], row["parts"], row["copies"], pa.array(words), pa.array(distinct), pa.array(failed.astype(np.int32))],
                    ["doc_id", "part", "copy", "n_words", "n_distinct", "failed"],
                )

    return matrix.select("doc_ids", "parts", "copies", "failed", "csr").mapInArrow(
        T.releasing(run), f"doc_id {kind}, part string, copy binary, n_words long, n_distinct long, failed int"
    )


def failed_sets(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (bits of A to E), good, toxic, n: documents by the set of filters they fail."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = flags.groupBy("part", "copy", "failed", "doc_id").agg(F.count(F.lit(1)).alias("n")).join(marks, "doc_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    texts = rows.groupBy("copy", "part", "failed", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    smallest = F.min("first.doc_id").over(Window.partitionBy("copy"))
    texts = texts.withColumn("smallest", smallest)
    own = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("failed"), own.alias("n")), F.struct(F.col("failed").bitwiseOR(F.lit(16)).alias("failed"), (F.col("n") - own).alias("n"))))
    sets = texts.select("part", "good", "toxic", both.alias("x"))
    return sets.groupBy("part", "x.failed", "good", "toxic").agg(F.sum("x.n").alias("n")).where("n > 0")


def _bits(letters: Column) -> Column:
    """Bits of the filters whose letters stand in a string."""
    return sum((F.when(F.contains(letters, F.lit(c)), 1 << i).otherwise(0) for i, c in enumerate(FILTERS)), F.lit(0))


def interactions(sets: DataFrame) -> DataFrame:
    """What each step of each order of the filters removes in every part, from the counts of failed sets."""
    total = sets.groupBy("part", "failed").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    steps = total.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumn("bit", _bits(F.expr("substring(filter_order, step, 1)"))).withColumn("earlier", _bits(F.expr("substring(filter_order, 1, step - 1)")))
    fails, gone = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("earlier")) != 0
    # A filter is the first to fail a document in as many of the 120 orders as any other that it fails.
    share = F.floor(F.lit(120) / F.greatest(F.bit_count("failed"), F.lit(1)))

    def counted(n: str | Column, where: Column) -> Column:
        return F.sum(F.when(where, n).otherwise(0)).cast("long")

    return steps.groupBy("part", "filter_order", "step").agg(
        counted(F.col("n"), ~fails & ~gone).alias("kept"),
        counted(F.col("n"), fails & ~gone).alias("removed"),
        counted(F.col("n"), fails & gone).alias("redundant"),
        counted(F.col("n"), F.col("failed") == F.col("bit")).alias("unique_fails"),
        counted(F.col("good"), fails & ~gone).alias("good_lost"),
        counted(F.col("toxic"), fails & ~gone).alias("toxic_lost"),
        counted(F.col("n") * share, fails).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of ``interactions`` for all 120 orders of the five filters."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("copy"), text.alias("text"))
    flags = stored(document_flags(document_term_matrix(rows)), "audit-flags")
    return interactions(failed_sets(flags, labels))

"""Katz backoff language model, counted and evaluated in place of the corpus.

A bigram model over lower-cased words and one closing token. Counts up to
five are discounted by Good-Turing, larger ones by ``TRUST`` so that every
history leaves some mass, and the backoff weight of a history is that mass over
the unigram mass of the words it was never followed by: every distribution sums
to one exactly, the class of unknown words included.

The model's tables grow with the corpus, so nothing of them is ever broadcast.
Documents are gathered into chunks of about a million tokens, and a
chunk asks for what it needs once per distinct key:

1. word table, partitioned by word hash: asked for the chunk's words with their
   training counts, it answers with ids and total counts;
2. bigram table, partitioned by history: asked for the chunk's word pairs,
   it answers with total counts and keeps what each history's weight needs;
3. the chunk evaluates its tokens; those whose pair was never seen name their history, whose
   weight is joined in from the history table.

Keys travel as sorted, delta-coded columns. A key takes one place per chunk
however often it occurs; pairs of a history that makes up a large share of
the text are spread over all partitions of the pair table by their word.

Word identity is a 64-bit hash. Defined results: null and empty texts are the closing token
alone; repeated rows are counted and scored one by one; with no training rows
every probability is 1; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climatrix.llm import text as T
from climatrix.llm.blobs import deltas, narrow, pack, part_of, undelta, unpack
from climatrix.llm.tables import fold, stored

FOLDS = 10
CHUNK_TOKENS = 1_200_000
#: Bytes of text for each partition of the word and pair tables.
PARTITION_BYTES = 8 << 20
K = 5
TRUST = 0.001
#: Histories with at least one in so many of all training tokens are sent to the tasks that ask for them.
FREQUENT = 100_000
#: Stands for the closing token among word hashes.
END = np.uint64(0xE5D0F7EF7EE75E0D)
#: Id of the history before a text's first token.
BEGIN = np.int64(1 << 62)


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's d_1..d_K from the counts of counts n_1..n_(K+1); r / (r + 0.5) where they give none in (0, 1)."""
    r = np.arange(1, K + 1)
    n = n.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        star = (r + 1) * n[1:] / n[:-1] / r
        common = (K + 1) * n[K] / n[0]
        d = (star - common) / (1 - common)
    return np.where(np.isfinite(d) & (d > 0) & (d < 1), d, r / (r + 0.5))


class Unigrams:
    """P(w) by count: Good-Turing over N tokens, the mass of singletons for unknown words."""

    def __init__(self, stats: np.ndarray):
        self.n, self.v, counts = int(stats[0]), int(stats[1]), stats[2:].astype(float)
        self.d = discounts(counts)
        r = np.arange(1, K + 1)
        known = self.n - ((1 - self.d) * r * counts[:K]).sum()
        self.unknown = min(max(counts[0] / self.n, 1 / (self.n + 1)), 0.5) if self.n else 1.0
        self.scale = (1 - self.unknown) / known if known > 0 else 0.0

    def p(self, c: np.ndarray) -> np.ndarray:
        d = np.where(c <= K, self.d[np.clip(c, 1, K) - 1], 1.0)
        return np.where(c > 0, d * c * self.scale, self.unknown)


def _cuts(part: np.ndarray) -> tuple[list[int], list[int]]:
    """The partitions that stand in an ascending list, and where each begins (one more than partitions)."""
    present, begin = np.unique(part, return_index=True)
    return present.tolist(), [*begin.tolist(), len(part)]


def _chunks(docs: DataFrame, parts: int) -> DataFrame:
    """A row per chunk: ids, folds and token counts of its texts, tokens as places in its word list, and what to ask of each word partition."""

    def emit(rows: list[tuple], chunk: int) -> pa.RecordBatch:
        h = np.concatenate([x[3] for x in rows])
        n = np.concatenate([x[2] for x in rows])
        held = np.concatenate([x[1] for x in rows])
        words, which = np.unique(h, return_inverse=True)
        count = np.bincount(which, np.repeat(~held, n), len(words)).astype(np.int64)
        present, cut = _cuts(part_of(words, parts))  # never more asks than keys, however many partitions
        asks = [{"part": p, "ask": pack(deltas(words[a:b]), narrow(count[a:b]))} for p, a, b in zip(present, cut[:-1], cut[1:], strict=True)]
        ids = pa.concat_arrays([x[0] for x in rows])
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk]), one(ids), one(pa.array(held)), one(pa.array(n, pa.int64())), pa.array([pack(narrow(which))], pa.binary()), pa.array([asks], pa.list_(pa.struct([("part", pa.int32()), ("ask", pa.binary())])))],
            ["chunk", "doc_id", "held", "n", "tokens", "asks"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, rows, size = TaskContext.get().partitionId() << 20, [], 0
        for b in batches:
            col = T.texts(b.column("text"))
            for i, j in T.slices(col):
                w = T.tokenize(col[i:j], lower=True)
                h = np.insert(w.hash, w.first[1:], END)
                held = b.column("held").slice(i, j - i).to_numpy(zero_copy_only=False).astype(bool)
                rows.append((b.column("doc_id").slice(i, j - i), held, np.diff(w.first) + 1, h))
                size += len(h)
                if size >= CHUNK_TOKENS:
                    yield emit(rows, chunk)
                    chunk, rows, size = chunk + 1, [], 0
        if rows:
            yield emit(rows, chunk)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", (fold("doc_id", FOLDS) == 0).alias("held"))
    return rows.mapInArrow(T.releasing(run), f"chunk long, doc_id array<{kind}>, held array<boolean>, n array<long>, tokens binary, asks array<struct<part:int,ask:binary>>")


def _word_table(chunks: DataFrame) -> DataFrame:
    """Answers (chunk, part, answer: ids and total counts) and, under chunk -1, each partition's statistics."""

    def total(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        asks = [unpack(x) for x in table.column("ask").to_pylist()]
        keys = [undelta(a[0]) for a in asks]
        words, which = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(which, np.concatenate([a[1] for a in asks]).astype(float), len(words)).astype(np.int64)
        cut = np.cumsum([0, *map(len, keys)])
        answers = [pack(deltas(w), narrow(count[w])) for a, b in zip(cut[:-1], cut[1:], strict=True) for w in [which[a:b]]]
        stats = [int(count.sum()), int((count > 0).sum()), *(int((count == r).sum()) for r in range(1, K + 2))]
        chunk = table.column("chunk").to_pylist()
        return pa.table(
            {"chunk": pa.array([*chunk, -1], pa.int64()), "part": pa.array([part] * (len(chunk) + 1), pa.int32()), "answer": pa.array([*answers, None], pa.binary()), "stats": pa.array([None] * len(chunk) + [stats], pa.list_(pa.int64()))}
        )

    asked = chunks.select("chunk", F.inline("asks"))
    return asked.groupBy("part").applyInArrow(total, "chunk long, part int, answer binary, stats array<long>")


def _summed(df: DataFrame, column: str = "stats", width: int = K + 3) -> np.ndarray:
    """Sums of the partitions' statistics: ``width`` numbers."""
    rows = df.where(f"{column} IS NOT NULL").select(F.posexplode(column).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(width, dtype=np.int64)
    for r in rows:
        out[r["k"]] = r["x"]
    return out


class _Chunk:
    """A chunk's tokens with the ids and counts of its words, and its distinct pairs (history, word)."""

    def __init__(self, body: pa.Table, answers: list[tuple[int, bytes]], parts: int, hot: int, trained: int):
        self.n = body.column("n")[0].values.to_numpy()
        self.held = body.column("held")[0].values.to_numpy(zero_copy_only=False).astype(bool)
        token = unpack(body.column("tokens")[0].as_py())[0].astype(np.int64)
        got = [(p, *unpack(a)) for p, a in sorted(answers)]
        ids = [(np.uint64(p) << np.uint64(32)) | undelta(d) for p, d, _ in got]
        self.ids = np.append(np.concatenate(ids).astype(np.int64), BEGIN)
        self.count = np.append(np.concatenate([c.astype(np.int64) for _, _, c in got]), trained)
        self.token = token
        history = np.empty_like(token)
        history[1:] = token[:-1]
        history[np.cumsum(self.n) - self.n] = len(self.ids) - 1
        self.pair, self.which = np.unique(history * len(self.ids) + token, return_inverse=True)
        self.history, self.word = self.pair // len(self.ids), self.pair % len(self.ids)
        spread = T.mix(self.ids[self.history].astype(np.uint64))
        wide = self.count[self.history] >= hot
        spread = np.where(wide, T.mix(spread ^ self.ids[self.word].astype(np.uint64)), spread)
        self.part = part_of(spread, parts)
        self.order = np.argsort(self.part, kind="stable")
        self.present, self.cut = _cuts(self.part[self.order])


def _answers(table: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    rows = zip(table.column("kind").to_pylist(), table.column("part").to_pylist(), table.column("answer").to_pylist(), strict=True)
    return [(p, a) for k, p, a in rows if k == kind]


def _pair_asks(chunks: DataFrame, answers: DataFrame, parts: int, hot: int, trained: int) -> DataFrame:
    """chunk, part, ask: the chunk's distinct pairs with their training counts and their words' totals."""

    def ask(body: pa.Table, told: pa.Table) -> pa.Table:
        chunk = body.column("chunk")[0].as_py()
        c = _Chunk(body, _answers(told, 0), parts, hot, trained)
        train = np.bincount(c.which, np.repeat(~c.held, c.n), len(c.pair)).astype(np.int64)
        at, out = [], []
        for p, a, b in zip(c.present, c.cut[:-1], c.cut[1:], strict=True):
            own = c.order[a:b]
            at.append(p)
            out.append(pack(deltas(c.ids[c.history[own]]), c.ids[c.word[own]].astype(np.uint64), narrow(train[own]), narrow(c.count[c.word[own]]), narrow((c.count[c.history[own]] >= hot).astype(np.int64))))
        return pa.table({"chunk": pa.array([chunk] * len(at), pa.int64()), "part": pa.array(at, pa.int32()), "ask": pa.array(out, pa.binary())})

    body = chunks.select("chunk", "held", "n", "tokens")
    return body.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask, "chunk long, part int, ask binary")


def _pair_table(asks: DataFrame, unigrams: Unigrams) -> DataFrame:
    """Answers (chunk, part, answer: totals), statistics, and per history what its weight needs (ids, flags, then K sums, rest, mass)."""

    def total(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        got = [unpack(x) for x in table.column("ask").to_pylist()]
        history, h = np.unique(np.concatenate([undelta(g[0]) for g in got]), return_inverse=True)
        word, w = np.unique(np.concatenate([g[1] for g in got]), return_inverse=True)
        pair, first, which = np.unique(h * len(word) + w, return_index=True, return_inverse=True)
        count = np.bincount(which, np.concatenate([g[2] for g in got]).astype(float), len(pair)).astype(np.int64)
        in_all = np.concatenate([g[3] for g in got]).astype(np.int64)[first]
        wide = np.concatenate([g[4] for g in got])[first]
        cut = np.cumsum([0, *(len(g[0]) for g in got)])
        answers = [pack(narrow(count[which[a:b]])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        stats = [0, 0, *(int((count == r).sum()) for r in range(1, K + 2))]
        own, seen = pair // len(word), count > 0
        sums = [np.bincount(own, np.where(count == r, r, 0), len(history)).astype(np.int64) for r in range(1, K + 1)]
        sums.append(np.bincount(own, np.where(count > K, count, 0), len(history)).astype(np.int64))
        mass = np.bincount(own, np.where(seen, unigrams.p(in_all), 0.0), len(history))
        hot = np.bincount(own, wide, len(history)) > 0
        rows = len(answers)
        keep = np.flatnonzero(np.sum(sums, axis=0) > 0)
        none = lambda k, kind: pa.nulls(k, kind)
        both = lambda x, kind, k: pa.concat_arrays([x, none(k, kind)])
        return pa.table({
            "chunk": both(pa.array([*table.column("chunk").to_pylist(), -1], pa.int64()), pa.int64(), len(keep)),
            "part": both(pa.array([part] * (rows + 1), pa.int32()), pa.int32(), len(keep)),
            "answer": both(pa.array([*answers, None], pa.binary()), pa.binary(), len(keep)),
            "stats": both(pa.array([None] * rows + [stats], pa.list_(pa.int64())), pa.list_(pa.int64()), len(keep)),
            "history": pa.concat_arrays([none(rows + 1, pa.int64()), pa.array(history[keep].astype(np.int64))]),
            "wide": pa.concat_arrays([none(rows + 1, pa.bool_()), pa.array(hot[keep])]),
            **{f"c{r + 1}": pa.concat_arrays([none(rows + 1, pa.int64()), pa.array(s[keep])]) for r, s in enumerate(sums)},
            "mass": pa.concat_arrays([none(rows + 1, pa.float64()), pa.array(mass[keep])]),
        })

    sums = ", ".join(f"c{r} long" for r in range(1, K + 2))
    return asks.groupBy("part").applyInArrow(total, f"chunk long, part int, answer binary, stats array<long>, history long, wide boolean, {sums}, mass double")


def _weights(pairs: DataFrame, d: np.ndarray) -> DataFrame:
    """history, seen (its training tokens), weight: log10 of the backoff weight of every training history."""
    columns = [f"c{r}" for r in range(1, K + 2)]
    rows = pairs.where("history IS NOT NULL").select("history", "wide", *columns, "mass")
    spread = rows.where("wide").groupBy("history").agg(*(F.sum(c).alias(c) for c in [*columns, "mass"]))
    whole = rows.where("NOT wide").drop("wide").unionByName(spread)
    total = " + ".join(columns)
    kept = " + ".join([f"{float(x)!r} * c{r}" for r, x in enumerate(d, 1)] + [f"{1 - TRUST!r} * c{K + 1}"])
    left = whole.selectExpr("history", f"{total} AS seen", f"1 - ({kept}) / ({total}) AS free", "1 - mass AS rest")
    return left.selectExpr("history", "seen", "log10(free / rest) AS weight")


def _scored(chunks: DataFrame, answers: DataFrame, unigrams: Unigrams, d: np.ndarray, parts: int, hot: int, trained: int) -> DataFrame:
    """Per document: base score, score without backoff weights, and the histories whose weight is still to be added."""
    pair_d = np.append(d, 1 - TRUST)

    def score(body: pa.Table, told: pa.Table) -> pa.Table:
        chunk = body.column("chunk")[0].as_py()
        c = _Chunk(body, _answers(told, 0), parts, hot, trained)
        total = np.zeros(len(c.pair), dtype=np.int64)
        place = {p: k for k, p in enumerate(c.present)}
        for p, a in _answers(told, 1):
            k = place[p]
            total[c.order[c.cut[k] : c.cut[k + 1]]] = unpack(a)[0].astype(np.int64)
        seen = total > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            straight = np.log10(pair_d[np.clip(total, 1, K + 1) - 1] * total / c.count[c.history])
            by_pair = np.where(seen, straight, np.log10(unigrams.p(c.count[c.word])))
        doc = np.repeat(np.arange(len(c.n)), c.n)
        base = np.log10((c.count[:-1] + 0.1) / (unigrams.n + 0.1 * (unigrams.v + 1)))
        back = (~seen & (c.count[c.history] > 0))[c.which]  # an unknown history has weight 1
        ask = c.ids[c.history][c.which[back]]
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc[back], minlength=len(c.n)))])
        return pa.table({
            "key": pa.array((chunk << 22) + np.arange(len(c.n)), pa.int64()),
            "doc_id": body.column("doc_id")[0].values,
            "held_out": pa.array(c.held),
            "n_tokens": pa.array(c.n, pa.int64()),
            "n_known": pa.array(np.bincount(doc, c.count[c.token] > 0, len(c.n)).astype(np.int64)),
            "base_score": pa.array(np.bincount(doc, base[c.token], len(c.n))),
            "direct": pa.array(np.bincount(doc, by_pair[c.which], len(c.n))),
            "histories": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ask)),
        })

    kind = chunks.schema["doc_id"].dataType.elementType.simpleString()
    body = chunks.select("chunk", "doc_id", "held", "n", "tokens")
    schema = f"key long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, direct double, histories array<long>"
    return body.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema)


def language_model_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(64, -(-size // PARTITION_BYTES))
    chunks = stored(_chunks(docs, parts), "lm-chunks")
    words = stored(_word_table(chunks), "lm-words")
    unigrams = Unigrams(_summed(words))
    trained = docs.where(fold("doc_id", FOLDS) != 0).count()
    hot = max(1, unigrams.n // (4 * parts))
    told = words.where("chunk >= 0").select("chunk", F.lit(0).alias("kind"), "part", "answer")
    pairs = stored(_pair_table(_pair_asks(chunks, told, parts, hot, trained), unigrams), "lm-pairs")
    d = discounts(_summed(pairs)[2:])
    both = told.unionByName(pairs.where("chunk >= 0").select("chunk", F.lit(1).alias("kind"), "part", "answer"))
    scores = stored(_scored(chunks, both, unigrams, d, parts, hot, trained), "lm-scores")
    asked = scores.select("key", F.explode("histories").alias("history")).groupBy("key", "history").agg(F.count(F.lit(1)).alias("times"))
    # A frequent history is asked by a large share of all documents: these meet their weights without a shuffle.
    weights = stored(_weights(pairs, d), "lm-weights")
    frequent = F.col("seen") >= max(unigrams.n / FREQUENT, 1)  # by the bar, at most FREQUENT histories
    met = asked.join(F.broadcast(weights.where(frequent).select("history", "weight")), "history", "left")
    rest = met.where("weight IS NULL").drop("weight").join(weights.where(~frequent).select("history", "weight"), "history")
    met = met.where("weight IS NOT NULL").select("key", "times", "weight").unionByName(rest.select("key", "times", "weight"))
    added = met.groupBy("key").agg(F.sum(F.col("times") * F.col("weight")).alias("added"))
    out = scores.drop("histories").join(added, "key", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(unigrams.n).cast("long").alias("train_tokens"), "base_score",
        (F.col("direct") + F.coalesce("added", F.lit(0.0))).alias("score"),
    )

"""Personal data: exact base spans and information-theoretic sanitisation.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Their values are the
protected entities. A term reveals an entity as strongly as their
co-occurrence in the corpus says: with n(e) documents that hold entity e,
n(e, t) of them holding term t as well, n(t) documents with t and N documents,

    disclosure = log(N P(e|t) / n(e)) / log(N / n(e))        P(e|t) = n(e,t) / n(t)

is 1 if t never stands without e and 0 if they are independent. Counts of one or two say
little, so P(e|t) is taken at its lower confidence bound (Wilson, ``Z``). A term discloses e
if its disclosure reaches ``THRESHOLD`` and the bound reaches ``EVIDENCE``, which doesn't move with N: two
documents of two do, one of one doesn't. Every word of a document, of any length, is a term, wherever it stands.
Disclosing terms are generalised to their class (or removed) in the documents that hold e; in documents
without e only where the bound reaches ``STRICT``, so a page that shares a rare word with a few others stays as it
is. Copies of a document with an entity count once, so copying isn't evidence.

Classes: ``name`` (begins with a capital), ``number`` (digits only), ``code`` (digits and letters), ``word``.

Counts cover all documents. Terms are 64-bit hashes of words. Documents per term are summed in
each task before they are shuffled; terms in more documents than any entity
allows are dropped before they are paired with entities. Words of documents with entities are kept with their
places, so their terms are found without the text. In all other documents only words on the list of
strictly disclosing terms become rows: the list itself is sent to the tasks if its counted rows allow it, else
a bit table of ``SLOTS`` bits, whose hits are then joined with the list.

Defined results: null and empty texts have no spans; rows equal in id and
text give equal results, rows that share an id only are searched each on its own; other
columns play no part and are kept by ``sanitised``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from climatrix.llm import text as T
from climatrix.llm.decontaminate import BROADCAST_ROWS
from climatrix.llm.tables import fresh, stored

CLASSES = ("name", "number", "code", "word")
KINDS = ("email", "ip", "card", "phone", *CLASSES)
THRESHOLD = 0.8
#: Least lower bound of P(e|t) for documents with e, and for all others.
EVIDENCE = 0.4
STRICT = 0.75
#: Of the one-sided 95 % bound.
Z = 1.645
#: Bits of the table that picks words before they are joined with a long list of terms (a power of two).
SLOTS = 1 << 26

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A number can only begin where no digit stands before: a start inside a run of digits fails or succeeds with the run's own start.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with a local part before and a domain behind it; time is linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind index, end, value) of all base spans, by start and then kind."""
    out = []
    if "@" in text:
        out += [(s, 0, e, text[s:e].lower()) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        parts = m[0].split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            out.append((m.start(), 1, m.end(), m[0]))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if 9 <= len(digits) <= 15:
                out.append((m.start(), 3, m.end(), digits))
    return sorted(out)


#: No base span without one of these; a cheap test of the whole batch.
_MAYBE = r"@|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9]([ \-]?[0-9]){11}|\+[0-9]"


def _hashes(w: T.Words) -> np.ndarray:
    return w.hash.view(np.int64)


def _places(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 character, within its text, of each word."""
    before = np.zeros(len(w.data) + 1, dtype=np.int64)
    np.cumsum((w.data & 0xC0) != 0x80, out=before[1:])
    base = before[w.offsets[:-1]][w.doc]
    return before[w.start] - base, before[w.end] - base


def _free(start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int, int, str]]) -> np.ndarray:
    """Which of the words of a text lie outside all of its base spans."""
    free = np.ones(len(start), dtype=bool)
    for s, _, e, _ in spans:
        free[np.searchsorted(end, s, "right") : np.searchsorted(start, e, "left")] = False
    return free


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_WORD = pa.struct([("term", pa.int64()), ("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
_WORDS = "array<struct<term:bigint,start:bigint,kind:int,end:bigint>>"


def _classes(col: pa.Array, w: T.Words) -> np.ndarray:
    """Kind index of each word's class, by its bytes before lower-casing."""
    data, _ = T.raw(col)
    digit = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data >= 0x30) & (data <= 0x39), out=digit[1:])
    digits, size = digit[w.end] - digit[w.start], w.end - w.start
    first = data[w.start]
    second = data[np.minimum(w.start + 1, w.end - 1)]
    capital = ((first >= 0x41) & (first <= 0x5A)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    kind = np.where(digits == size, 1, np.where(digits > 0, 2, np.where(capital, 0, 3)))
    return kind + KINDS.index(CLASSES[0])


def _as_words(term: np.ndarray, start: np.ndarray, kind: np.ndarray, end: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(term, pa.int64()), pa.array(start, pa.int64()), pa.array(kind, pa.int32()), pa.array(end, pa.int64())], fields=list(_WORD))


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row, copy (a hash of the text), spans, entities and words (outside of spans; of texts with entities) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = T.texts(b.column("text"))
            maybe = pc.match_substring_regex(col, _MAYBE).to_numpy(zero_copy_only=False)
            spans, entities, words, ends = [], [], [], [0]
            for i in range(len(col)):
                own = base_spans(col[i].as_py()) if maybe[i] else []
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e, _ in own])
                entities.append(sorted({f"{KINDS[k]}:{v}" for _, k, _, v in own}))
                if own:
                    w = T.tokenize(col[i : i + 1], T.ALNUM, lower=True)
                    start, end = _places(w)
                    free = _free(start, end, own)
                    words.append(_as_words(_hashes(w)[free], start[free], _classes(col[i : i + 1], w)[free], end[free]))
                ends.append(ends[-1] + (len(words[-1]) if own else 0))
            held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([_as_words(*[np.empty(0, np.int64)] * 4), *words]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row"), b.column("copy"), pa.array(spans, pa.list_(_SPAN)), pa.array(entities, pa.list_(pa.string())), held],
                ["doc_id", "row", "copy", "spans", "entities", "words"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.xxhash64("text").alias("copy"), "text")
    return keyed.mapInArrow(T.releasing(run), f"doc_id {kind}, row long, copy long, spans {_SPANS}, entities array<string>, words {_WORDS}")


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term, n_all: documents that hold each word, summed in every batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = T.texts(b.column("text"))
            parts = []
            for i, j in T.slices(col):
                w = T.tokenize(col[i:j], T.ALNUM, lower=True)
                h, doc = _hashes(w), w.doc
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.empty(0, bool)
                parts.append(np.unique(h[new], return_counts=True))
            if parts:
                term, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(term)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], ["term", "n_all"])

    return docs.select("text").mapInArrow(T.releasing(run), "term long, n_all long").groupBy("term").agg(F.sum("n_all").alias("n_all"))


def contexts(docs: DataFrame, rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """copy, entity, term, n_t, n_e: terms of the texts that hold an entity, where n_t doesn't rule them out."""
    n = float(docs.count())
    terms = F.array_distinct(F.transform("words", lambda x: x["term"]))
    own = rows.where("size(entities) > 0").select("copy", "entities", terms.alias("terms"))
    own = own.groupBy("copy").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"), (F.count(F.lit(1)) - 1).alias("more"))
    own = stored(own, "entity-documents")
    entity = stored(own.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")), "entities")
    most = entity.agg(F.max("n_e")).first()[0] or 0

    def limit(n_e: Column) -> Column:
        """P(e|t) is n_e / n_t at most: it has to reach the evidence, and (n_e / N) ** (1 - threshold)."""
        return F.least(n_e / EVIDENCE, F.pow(n_e, F.lit(threshold)) * n ** (1 - threshold)) + 1e-6

    top = limit(F.lit(float(most)))
    held = own.select("copy", "more", F.explode("terms").alias("term"))
    known = held.groupBy("term").agg(F.sum("more").alias("more"), F.count(F.lit(1)).alias("least")).where(F.col("least") <= top)
    corpus = docs if most else docs.limit(0)  # nothing to count
    counted = document_frequencies(corpus).join(known, "term").select("term", F.greatest(F.col("n_all") - F.col("more"), "least").alias("n_t"))
    counted = stored(counted.where(F.col("n_t") <= top), "entity-vocabulary")
    wanted = F.broadcast(counted) if counted.count() <= BROADCAST_ROWS else counted
    rare = held.select("copy", "term").join(wanted, "term")
    of = own.select("copy", F.explode("entities").alias("entity")).join(F.broadcast(entity) if entity.count() <= BROADCAST_ROWS else entity, "entity")
    return rare.join(of, "copy").where(F.col("n_t") <= limit(F.col("n_e").cast("double"))).select("copy", "entity", "term", "n_t", "n_e")


def disclosing(met: DataFrame, n: float, threshold: float = THRESHOLD) -> DataFrame:
    """entity, term (its hash), disclosure and bound of the terms among ``contexts`` that reveal an entity too strongly."""
    pairs = met.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"))
    among = F.col("n_t").cast("double")
    p, z2 = F.col("n_et") / among, Z * Z
    bound = (p + z2 / (2 * among) - Z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / among + z2 / (4 * among * among))) / (1 + z2 / among)
    ratio = F.when(F.col("n_e") < n, F.log(F.lit(n) * F.col("bound") / F.col("n_e")) / F.log(F.lit(n) / F.col("n_e")))
    judged = pairs.withColumn("bound", bound).withColumn("disclosure", ratio)
    return judged.where((F.col("disclosure") >= threshold) & (F.col("bound") >= EVIDENCE)).select("entity", "term", "disclosure", "bound")


def _listed(terms: DataFrame):
    """(test of an array of hashes, whether a hit is certain) for a counted list of distinct terms."""
    if terms.count() <= BROADCAST_ROWS:
        known = np.sort(terms.toArrow().column("term").to_numpy())
        return (lambda h: known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)), True
    slot = F.pmod("term", F.lit(SLOTS))
    bits = terms.groupBy(F.floor(slot / 64).cast("long").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))).alias("bits"))
    got = bits.toArrow()  # SLOTS / 64 rows at most
    table = np.zeros(SLOTS // 64, dtype=np.uint64)
    table[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)

    def test(h: np.ndarray) -> np.ndarray:
        at = h.view(np.uint64) & np.uint64(SLOTS - 1)
        return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    return test, False


def term_spans(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """row, terms: the spans of disclosing terms, for the rows that have any."""
    met = stored(contexts(docs, rows), "entity-terms")
    found = stored(disclosing(met, float(docs.count())), "disclosing")
    few = found.count() <= BROADCAST_ROWS
    span = "transform(words, x -> struct(x.start AS start, x.kind AS kind, x.end AS end))"

    # In texts with the entity: its own terms, by the places kept with the entity.
    own = met.join(F.broadcast(found.select("entity", "term")) if few else found.select("entity", "term"), ["entity", "term"])
    own = own.select("copy", "term").distinct().groupBy("copy").agg(F.collect_list("term").alias("listed"))
    held = rows.where("size(entities) > 0").join(own, "copy")
    inside = held.select("row", F.expr("filter(words, w -> array_contains(listed, w.term))").alias("words")).select("row", F.explode(F.expr(span)).alias("x"))

    # In all texts: the terms that hardly ever stand without their entity.
    strict = stored(found.where(F.col("bound") >= STRICT).select("term").distinct(), "strictly-disclosing")
    test, certain = _listed(strict)
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = T.texts(b.column("text"))
            for i, j in T.slices(col):
                part = col[i:j]
                w = T.tokenize(part, T.ALNUM, lower=True)
                h = _hashes(w)
                hit = np.flatnonzero(test(h))
                if not len(hit):
                    continue
                (start, end), kind = _places(w), _classes(part, w)
                out, doc = [], w.doc[hit]
                cut = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    at = hit[x:y]
                    at = at[_free(start[at], end[at], base_spans(part[int(doc[x])].as_py()))]
                    out.append([{"term": t, "start": s, "kind": k, "end": e} for t, s, k, e in zip(h[at].tolist(), start[at].tolist(), kind[at].tolist(), end[at].tolist(), strict=True)])
                which = pa.array(doc[cut[:-1]] + i)
                yield pa.RecordBatch.from_arrays([b.column("row").take(which), pa.array(out, pa.list_(_WORD))], ["row", "words"])

    corpus = keyed if not strict.isEmpty() else keyed.limit(0)
    made = corpus.mapInArrow(T.releasing(run), f"row long, words {_WORDS}")
    if not certain:
        made = made.select("row", F.explode("words").alias("w")).join(strict, F.col("w.term") == strict["term"]).groupBy("row").agg(F.collect_list("w").alias("words"))
    everywhere = made.select("row", F.explode(F.expr(span)).alias("x"))
    return inside.unionByName(everywhere).groupBy("row").agg(F.array_sort(F.collect_set("x")).alias("terms"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans (base) and all_spans, each an array of (start, kind index, end) in order, for every row."""
    rows = stored(found_spans(docs), "personal-spans")
    terms = term_spans(docs, rows)
    out = rows.select("doc_id", "row", "spans").join(terms, "row", "left")
    none = F.expr(f"cast(array() AS {_SPANS})")
    return out.select("doc_id", "spans", F.array_sort(F.concat("spans", F.coalesce("terms", none))).alias("all_spans"))


def sanitised(docs: DataFrame, remove_terms: bool = False) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets (terms dropped if ``remove_terms``); null texts stay null."""
    rows = stored(found_spans(docs), "personal-spans")
    schema, names = docs.schema, docs.columns
    key, found = fresh(docs, "term_row"), fresh(docs, "terms")
    terms = stored(term_spans(docs, rows).toDF(key, found), "term-spans")
    small = F.broadcast(terms) if terms.count() <= BROADCAST_ROWS else terms
    joined = docs.join(small, F.xxhash64(docs["doc_id"], docs["text"]) == F.col(key), "left").select(*docs.columns, found)
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(place)
            plain = T.texts(col)
            maybe = pc.match_substring_regex(plain, _MAYBE).to_numpy(zero_copy_only=False)
            extra = b.column(len(names))
            new = []
            for i in range(b.num_rows):
                if not col[i].is_valid or not (maybe[i] or extra[i].is_valid):
                    new.append(col[i].as_py())
                    continue
                text = plain[i].as_py()
                spans = [(s, k, e) for s, k, e, _ in base_spans(text)] + [(x["start"], x["kind"], x["end"]) for x in extra[i].as_py() or []]
                out, done = [], 0
                for s, k, e in sorted(spans):
                    if s >= done:
                        out += [text[done:s], "" if remove_terms and KINDS[k] in CLASSES else f"<{KINDS[k]}>"]
                    done = max(done, e)
                new.append("".join(out) + text[done:])
            arrays = [b.column(x) for x in range(len(names))]
            arrays[place] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{x}" for x in range(len(names))])

    made = joined.mapInArrow(T.releasing(run), _renamed(schema))
    return made.toDF(*names)


def _renamed(schema):
    """The schema with places as names, so clashing names do no harm inside the task."""
    return S.StructType([S.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(schema.fields)])

"""License scan: exact set-similarity join of text blocks with notice templates.

A block is a line of text, or a run of words over any number of lines, as a set of words; a
template is the set of words of a notice. A pair matches if the block holds at least
``PERCENT`` per cent of the template's words, in a run within ``reach`` words of each other,
so a notice wrapped over lines is found as well. Runs are cut from windows of twice the
longest reach over the whole text; neighbouring windows that could hold a notice are one run.
Tokens are ordered by how many blocks of the corpus hold
them, rarest first, and three filters leave few pairs to verify:

* prefix: with a needed overlap o, one of the template's first ``size - o + 1``
  tokens must be in the block;
* length: the block needs o template tokens;
* positional: what is left in both after the first shared token must still reach o.

Templates are a parameter of bounded size (their words are sent to every
task); blocks never leave their row except as small lists of token ranks.
Every template that a block matches counts, at the shortest range of words that holds its
words. A match is dropped only where a better one (higher containment, then more words)
over the same range rests on all its words as well: the notices of two versions of one
licence don't answer for each other.

Defined results: null and empty texts have no words, no labels and score 0;
rows equal in id and text give equal results, rows that share an id only are
judged each on its own; equal templates over one range all count; other
columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climatrix.llm import text as T
from climatrix.llm.tables import stored

PERCENT = 80
#: Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Usual notices and their labels.
TEMPLATES = (
    ("mit", "licensed under the mit license"),
    ("mit", "released under the terms of the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd 3 clause license"),
    ("bsd", "licensed under the bsd 2 clause license"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl-3", "this work is licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "licensed under cc0 1 0 universal public domain dedication"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("all-rights-reserved", "copyright all rights reserved"),
)


def needed(size: int, percent: int = PERCENT) -> int:
    """Smallest overlap that reaches the threshold."""
    return math.ceil(percent * size / 100)


def reach(template: str, percent: int = PERCENT) -> int:
    """Words of text within which a run has to hold the template's: ``percent`` of them are the template's if it is whole."""
    return len(template.split()) * 100 // percent


def _vocabulary(templates) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of all templates and phrases; their hashes in ascending order with the word each belongs to."""
    words = sorted({w for _, t in templates for w in t.split()} | {w for p in PHRASES for w in p.split()})
    h = np.array([T.word_hash(w) for w in words], dtype=np.uint64)
    return words, np.sort(h), np.argsort(h)


def _ids(hashes: np.ndarray, known: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Vocabulary index of each hash, -1 for other words."""
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, which[at], -1)


def _blocks(w: T.Words) -> np.ndarray:
    """Number of the line, within the slice, that each word is in; lines of different texts differ."""
    newline = np.zeros(len(w.data) + 1, dtype=np.int64)
    np.cumsum(w.data == 0x0A, out=newline[1:])
    return newline[w.start] + w.doc


def block_frequencies(docs: DataFrame, templates) -> dict[int, int]:
    """Blocks of the whole corpus that hold each vocabulary word (by index); at most as many rows as words come to the driver."""
    words, known, which = _vocabulary(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), dtype=np.int64)
        for b in batches:
            col = T.texts(b.column("text"))
            for i, j in T.slices(col):
                w = T.tokenize(col[i:j], T.ALNUM, lower=True)
                ids = _ids(w.hash, known, which)
                held = ids >= 0
                if held.any():
                    pair = np.unique(_blocks(w)[held] * len(words) + ids[held])
                    total += np.bincount(pair % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words), dtype=np.int32)), pa.array(total)], ["word", "blocks"])

    counted = docs.select("text").mapInArrow(T.releasing(run), "word int, blocks long").groupBy("word").agg(F.sum("blocks").alias("blocks"))
    return {r["word"]: r["blocks"] for r in counted.collect()}


#: Windows whose words are counted at a time.
_WINDOWS = 4096
#: A block below 0 is a run, any other a line.
_BLOCK = pa.struct([("block", pa.int32()), ("tokens", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64()))])


def scanned(docs: DataFrame, templates, rank: dict[int, int], percent: int) -> DataFrame:
    """Base columns of every row and its candidate blocks (line or run, ascending token ranks, the places of all its tokens and their ranks)."""
    words, known, which = _vocabulary(templates)
    ranks = np.array([rank[i] for i in range(len(words))] + [0], dtype=np.int64)
    index = {x: i for i, x in enumerate(words)}
    prefix = np.zeros(len(words), dtype=bool)
    least = len(words) + 1
    member, first_of, need = (np.zeros((len(words), len(templates)), dtype=np.float32) for _ in range(3))
    for k, (_, t) in enumerate(templates):
        own = sorted(ranks[index[x]] for x in set(t.split()))
        o = needed(len(own), percent)
        prefix[own[: len(own) - o + 1]] = True
        least = min(least, o)
        member[own, k], first_of[own[: len(own) - o + 1], k], need[:, k] = 1, 1, o
    step = max(reach(t, percent) for _, t in templates)
    phrases = [([index[x] for x in p.split()], label) for p, label in sorted(PHRASES.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = T.texts(b.column("text"))
            for i, j in T.slices(col):
                w = T.tokenize(col[i:j], T.ALNUM, lower=True)
                n, first = j - i, w.first
                ids, doc = _ids(w.hash, known, which), w.doc
                n_base = np.zeros(n, dtype=np.int64)
                low = np.full(n, np.iinfo(np.int64).max)
                high = np.full(n, -1)
                labels: list[set[str]] = [set() for _ in range(n)]
                for p, label in phrases:
                    k = len(p)
                    if len(ids) >= k:
                        at = np.flatnonzero(np.all([ids[x : len(ids) - k + 1 + x] == p[x] for x in range(k)], axis=0))
                        at = at[doc[at] == doc[at + k - 1]]
                        np.add.at(n_base, doc[at], 1)
                        np.minimum.at(low, doc[at], at - first[doc[at]])
                        np.maximum.at(high, doc[at], at - first[doc[at]])
                        for d in np.unique(doc[at]):
                            labels[d].add(label)
                found: list[list[dict]] = [[] for _ in range(n)]
                held = np.flatnonzero(ids >= 0)
                if len(held):
                    block, token = _blocks(w)[held], ranks[ids[held]]
                    every, lines = token, block  # of each place, in order
                    pair, place = np.unique(block * len(words) + token, return_index=True)
                    block, token, place = pair // len(words), pair % len(words), held[place]
                    cut = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
                    useful = np.add.reduceat(prefix[token].astype(np.int64), cut[:-1]) > 0
                    for x in np.flatnonzero(useful & (np.diff(cut) >= least)):
                        own = slice(cut[x], cut[x + 1])
                        d = doc[place[cut[x]]]
                        y, z = np.searchsorted(lines, block[cut[x]], "left"), np.searchsorted(lines, block[cut[x]], "right")
                        found[d].append({"block": len(found[d]), "tokens": token[own].tolist(), "places": (held[y:z] - first[d]).tolist(), "ranks": every[y:z].tolist()})
                    at = held - first[doc[held]]
                    base = np.append(0, np.cumsum(np.diff(first) // step + 3))  # windows of different texts are no neighbours
                    window = base[doc[held]] + at // step
                    both = at >= step  # a word is in the window that begins before it and in the one before that
                    ws, wt = np.append(window, window[both] - 1), np.append(every, every[both])
                    kinds, which_window = np.unique(ws, return_inverse=True)
                    fits = np.zeros(len(kinds), dtype=bool)
                    for c in range(0, len(kinds), _WINDOWS):
                        here = (which_window >= c) & (which_window < c + _WINDOWS)
                        has = np.zeros((min(_WINDOWS, len(kinds) - c), len(words)), dtype=np.float32)
                        has[which_window[here] - c, wt[here]] = 1
                        fits[c : c + _WINDOWS] = ((has @ first_of > 0) & (has @ member >= need[0])).any(axis=1)
                    good = kinds[fits]
                    for run_of in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1) if len(good) else ():
                        y, z = np.searchsorted(window, run_of[0], "left"), np.searchsorted(window, run_of[-1] + 1, "right")
                        d = doc[held[y]]
                        found[d].append({"block": -1 - len(found[d]), "tokens": np.unique(every[y:z]).tolist(), "places": at[y:z].tolist(), "ranks": every[y:z].tolist()})
                part = b.slice(i, n)
                none = n_base == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array(np.diff(first)), pa.array(n_base), pa.array(low, mask=none), pa.array(high, mask=none),
                     pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                     pa.array(found, pa.list_(_BLOCK))],
                    ["doc_id", "row", "n_words", "n_base", "first_word", "last_word", "base", "blocks"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    return keyed.mapInArrow(
        T.releasing(run),
        f"doc_id {kind}, row long, n_words long, n_base long, first_word long, last_word long, base array<string>, "
        "blocks array<struct<block:int,tokens:array<bigint>,places:array<bigint>,ranks:array<bigint>>>",
    )


def _shortest(occurs: list[tuple[int, int]]) -> tuple[int, int, frozenset[int]]:
    """Start, end and ranks of the shortest range of (place, rank) that holds all ranks there are."""
    kinds = frozenset(t for _, t in occurs)
    held: Counter[int] = Counter()
    best, low = None, 0
    for p, t in occurs:
        held[t] += 1
        while held[occurs[low][1]] > 1:
            held[occurs[low][1]] -= 1
            low += 1
        if len(+held) == len(kinds) and (best is None or p + 1 - occurs[low][0] < best[1] - best[0]):
            best = occurs[low][0], p + 1
    return *best, kinds


def _runs(occurs: list[tuple[int, int]], need: int, within: int) -> list[tuple[int, int, frozenset[int]]]:
    """Start, end and ranks of the ranges of at most ``within`` words that hold ``need`` ranks; of those that overlap the best."""
    found = []
    for i, (p, _) in enumerate(occurs):
        kinds, end = set(), p
        for q, t in occurs[i : i + within]:
            if q >= p + within:
                break
            if t not in kinds:
                kinds.add(t)
                end = q + 1
        if len(kinds) >= need:
            found.append((p, end, frozenset(kinds)))
    out, taken = [], set()
    for m in sorted(found, key=lambda m: (-len(m[2]), m[1] - m[0], m[0])):
        if taken.isdisjoint(range(m[0], m[1])):
            taken.update(range(m[0], m[1]))
            out.append(m)
    return out


def _kept(matches: list[tuple]) -> list[tuple]:
    """(rating, start, end, ranks, label) without those that a better match over the same range rests on as well."""
    order, out = sorted(set(matches), key=lambda m: m[0], reverse=True), []
    for m in order:
        if not any(b[0] > m[0] and b[1] <= m[1] and m[2] <= b[2] and m[3] <= b[3] for b in out):
            out.append(m)
    return out


def block_matches(rows: DataFrame, templates, rank: dict[int, int], words: list[str], percent: int) -> DataFrame:
    """row, found (labels), best (containment), spans of all templates that reach the threshold in a block."""
    spark = rows.sparkSession
    index = {x: i for i, x in enumerate(words)}
    sets = [sorted(rank[index[x]] for x in set(t.split())) for _, t in templates]
    tokens = [
        (k, own, needed(len(own), percent), place, token)
        for k, own in enumerate(sets)
        for place, token in enumerate(own[: len(own) - needed(len(own), percent) + 1])
    ]
    prefix = spark.createDataFrame(tokens, "template int, own array<bigint>, need int, t_place int, token bigint")
    held = rows.where("size(blocks) > 0").dropDuplicates(["row"]).select("row", "blocks")
    blocks = held.select("row", F.explode("blocks").alias("b")).select("row", "b.block", "b.tokens")
    place = blocks.select("*", F.posexplode("tokens").alias("b_place", "token"))
    hit = place.join(F.broadcast(prefix), "token")  # as large as the templates' prefixes
    fits = hit.where("size(tokens) >= need AND least(t_place, b_place) + least(size(own) - t_place, size(tokens) - b_place) >= need")
    pairs = fits.dropDuplicates(["row", "block", "template"])
    verified = pairs.where("size(array_intersect(tokens, own)) >= need").groupBy("row").agg(F.collect_list(F.struct("block", "template")).alias("pairs"))
    owns, labels, within = [frozenset(x) for x in sets], [label for label, _ in templates], [reach(t, percent) for _, t in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for own, pairs in zip(b.column("blocks").to_pylist(), b.column("pairs").to_pylist(), strict=True):
                of, matches = {x["block"]: x for x in own}, []
                for p in pairs:
                    x, k = of[p["block"]], p["template"]
                    occurs = [(at, t) for at, t in zip(x["places"], x["ranks"], strict=True) if t in owns[k]]
                    placed = [_shortest(occurs)] if p["block"] >= 0 else _runs(occurs, needed(len(owns[k]), percent), within[k])
                    matches += [((len(shared) / len(owns[k]), len(shared)), start, end, shared, labels[k]) for start, end, shared in placed]
                out.append(_kept(matches))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array([sorted({m[4] for m in x}) for x in out], pa.list_(pa.string())), pa.array([x[0][0][0] if x else 0.0 for x in out], pa.float64()),
                 pa.array([[{"start": s, "end": e, "label": v} for s, e, v in sorted({(m[1], m[2], m[4]) for m in x})] for x in out], pa.list_(_FOUND))],
                ["row", "found", "best", "spans"],
            )

    return verified.join(held, "row").mapInArrow(T.releasing(run), "row long, found array<string>, best double, spans array<struct<start:bigint,end:bigint,label:string>>")


_FOUND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])


def license_scan(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base (labels), found (labels), spans (word ranges), score for every row."""
    words, _, _ = _vocabulary(templates)
    blocks = block_frequencies(docs, templates)
    order = sorted(range(len(words)), key=lambda i: (blocks.get(i, 0), words[i]))
    rank = {w: r for r, w in enumerate(order)}
    rows = stored(scanned(docs, templates, rank, percent), "license-blocks")
    matched = block_matches(rows, templates, rank, words, percent)
    out = rows.drop("blocks").join(matched, "row", "left")
    empty = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base", F.coalesce("found", empty).alias("found"), "spans",
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )

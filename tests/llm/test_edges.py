"""Nulls, empty and very long texts, ties, repeated rows, clashing columns, empty tables."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from llm import brute
from pyspark.sql import functions as F

from climatrix.llm import audit, centroids, compression, decontaminate, hyperminhash, katz, kdtree, licenses, packing, quality, sanitise, simhash, substrings
from climatrix.llm.tables import numbered

OPERATORS = {
    "licenses": licenses.license_scan,
    "substrings": substrings.deduplicated,
    "compression": compression.quality_rules,
    "packing": packing.pack,
    "near": hyperminhash.near_duplicates,
    "personal": sanitise.personal_data,
    "lm": katz.language_model_scores,
    "shards": kdtree.shard,
    "fingerprints": simhash.document_fingerprints,
}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "a"), (2, 0, 0, "a"), (2, 0, 0, "b"), (None, 1, 0, "a"), (8, None, 0, "a"), (6, 0, 1, "a")], "doc_id long, quality int, toxic int, x string")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "Two three four", "a"), (2, None, "b"), (None, "one two", "c"), (3, "", "d"), (4, "two THREE four", "e")], "item_id long, text string, row string")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"packing"}))
def test_one_row_for_each_row(odd, name):
    assert OPERATORS[name](odd).count() == odd.count()


def test_empty_tables_with_a_second_table(empty, odd, labels, benchmark):
    assert quality.quality_scores(empty, labels).count() == 0
    assert quality.keep_good(empty, labels).count() == 0
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert quality.quality_scores(odd, labels.limit(0)).where("score = 0.5").count() == odd.count()
    assert decontaminate.contamination(odd, benchmark.limit(0)).where("n_hit > 0").isEmpty()


def test_stages_keep_columns(odd, empty, labels, benchmark):
    for docs in (odd, empty):
        for out in (quality.keep_good(docs, labels), hyperminhash.keep_one(docs), decontaminate.keep_clean(docs, benchmark), sanitise.sanitised(docs)):
            assert out.columns == docs.columns
            out.collect()


def test_contamination(odd, benchmark):
    rows = {(r.doc_id, r.n_words): r for r in decontaminate.contamination(odd, benchmark).collect()}
    assert rows[1, 30].n_hit == 9 and rows[1, 30].item_ids == ["1", "4"] and rows[1, 30].contaminated
    assert rows[3, 0].n_hit == 0 and not rows[3, 0].contaminated
    kept = {r.doc_id for r in decontaminate.keep_clean(odd, benchmark).collect()}
    assert kept == {3, 4, 5, 6, 7, 8, None}


def test_licence_of_repeated_rows(odd):
    rows = [r for r in licenses.license_scan(odd).collect() if r.doc_id == 7]
    assert [(r.n_base, r.first_word, r.base, r.found, r.score) for r in rows] == [(1, 1, ["mit"], ["mit"], 1.0)] * 2


def test_every_licence_of_a_block(spark):
    texts = [
        "Licensed under the BSD 3 clause license with documentation under CC BY 4.0",
        "Licensed under CC BY-SA 4.0, " + "much other text " * 200 + "licensed under the BSD 2 clause license",
        "This work is licensed under the GNU Lesser General Public License version 3",
        "Licensed under the Apache License, Version 2.0",
    ]
    rows = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: r for r in rows}
    assert [got[i].found for i in range(4)] == [["bsd", "cc-by"], ["bsd", "cc-by-sa"], ["lgpl-3"], ["apache-2"]]
    assert [(s.start, s.end, s.label) for s in got[1].spans] == [(0, 7, "cc-by-sa"), (607, 614, "bsd")]


def test_licences_wrapped_over_lines(spark):
    whole = [
        ("mit", "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the Software)"),
        ("gpl", "you can redistribute it and/or modify\nit under the terms of the GNU General Public License\nas published by the Free Software\nFoundation"),
        ("bsd", "Redistribution and use in source and binary forms,\nwith or without modification, are permitted provided\nthat the following conditions are met"),
        ("isc", "Permission to use, copy, modify, and/or distribute this software\nfor any purpose with or without fee\nis hereby granted"),
    ]
    texts = ["some words\n" * 300 + t for _, t in whole] + ["\n".join(t for _, t in whole), "licensed under the\n" + "other words\n" * 30 + "apache license version 2 0"]
    rows = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: r.found for r in rows}
    assert [got[i] for i in range(6)] == [[label] for label, _ in whole] + [["bsd", "gpl", "isc", "mit"], []]


def test_near_duplicates_of_odd_rows(odd):
    rows = {(r.doc_id, r.n_shingles): r for r in hyperminhash.near_duplicates(odd).collect()}
    assert rows[2, 10].component_id == 1 and not rows[2, 10].kept and rows[1, 10].kept
    assert rows[3, 0].kept and rows[4, 0].component_id == 4 and rows[5, 0].component_id == 5
    assert rows[6, 1].kept
    assert rows[None, 1].component_id is None and not rows[None, 1].kept


def test_rows_sharing_an_id_share_a_component(spark):
    long = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(3)]
    docs = spark.createDataFrame([(1, long[0]), (5, long[0]), (5, long[1]), (9, long[1]), (11, long[2])], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in hyperminhash.near_duplicates(docs).collect()}
    assert got == {(1, 1), (5, 1), (9, 1), (11, 11)}


def test_substrings_of_odd_rows(odd):
    rows = {r.doc_id: r for r in substrings.deduplicated(odd).collect() if r.doc_id not in (None, 7)}
    assert (rows[1].n_removed, rows[2].n_removed, rows[2].kept) == (20, 30, "")
    assert rows[1].kept == "one two three four five six seven eight nine ten"
    assert (rows[6].n_words, rows[6].n_removed, rows[6].kept) == (60_000, 59_999, "word")
    assert [(s.start, s.end) for s in rows[6].removed] == [(1, 60_000)]
    assert (rows[3].n_words, rows[3].kept) == (0, "")


@pytest.mark.parametrize("group", [1, 7])
def test_groups_of_any_size_give_the_same_repeats(spark, group):
    rnd = random.Random(group)
    base = [rnd.choice("abcdefghij") for _ in range(300)]
    rows = []
    for i in range(40):
        a = rnd.randrange(200)
        own = base[a : a + rnd.randrange(100)] if rnd.random() < 0.7 else [rnd.choice("ab") for _ in range(60)]
        rows.append((i, " ".join([f"x{i}", *own, "y"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.deduplicated(docs, group=group).collect())
    assert got == [r[:3] for r in brute.op2(rows)]


def test_compression_of_odd_rows(odd):
    rows = {r.doc_id: r for r in compression.quality_rules(odd).collect() if r.doc_id}
    assert rows[3].base_failed and rows[4].base_failed and rows[6].base_failed
    noise = "".join(chr(0x21 + (i * 7919 + i * i * 104729) % 90) + " " * (i % 9 == 0) for i in range(6000))
    assert not compression.verdict(noise.encode(), zstandard.ZstdCompressor(level=3))[3] or len(noise) < 100


def test_compression_judges_the_tail(documents):
    rnd, compress = random.Random(3), zstandard.ZstdCompressor(level=3)
    prose = next(b for b in (t.encode() for _, t in documents if t) if len(b) >= 9000 and compression.verdict(b, compress)[3] and compression.verdict(b[:4096], compress)[3])
    noise = bytes(rnd.randrange(0x21, 0x7F) for _ in range(4000))
    ratio, chunks, out, fine = compression.verdict(prose[:4096] + noise, compress)
    assert ratio < 0.78 and (chunks, out, fine) == (2, 1, False)
    assert compression.verdict(prose[:8192], compress)[1] == 2 and compression.verdict(prose[:8193], compress)[1] == 3


def test_personal_data_of_odd_rows(odd):
    row = next(r for r in sanitise.personal_data(odd).collect() if r.doc_id == 8)
    assert [s.kind for s in row.spans] == [0, 1, 2, 3]
    text = next(r.text for r in sanitise.sanitised(odd).collect() if r.doc_id == 8)
    assert text == "mail me at <email> or <ip>, card <card>, <phone> é"
    assert {r.text for r in sanitise.sanitised(odd).where("doc_id = 3").collect()} == {None}


def test_terms_that_disclose_an_entity(spark):
    near = [(i, f"filler{i} about agent nightjar at x.y@z.org and more{i} text{i}") for i in range(5)]
    far = [(10 + i, f"the agent went about and at noon had more text number{i}") for i in range(40)]
    docs = spark.createDataFrame(near + far, "doc_id long, text string")
    out = {r.doc_id: r.text for r in sanitise.sanitised(docs).collect()}
    assert out[0] == "filler0 about agent <word> at <email> and more0 text0"
    assert out[10] == far[0][1]
    assert sanitise.sanitised(docs, remove_terms=True).where("doc_id = 1").first().text == "filler1 about agent  at <email> and more1 text1"


@pytest.mark.parametrize("more", [3000, 60_000])
def test_one_document_is_no_evidence_whatever_the_corpus(spark, more):
    near = [(0, "agent nightjar at x.y@z.org"), (1, "agent Whinchat 4711 at v.w@z.org and"), (2, "about agent Whinchat 4711 at v.w@z.org")]
    near += [(3, "whinchat once more without the address"), (4, "a nightjar in a clean page")]
    docs = spark.createDataFrame(near, "doc_id long, text string").union(spark.range(10, 10 + more).selectExpr("id", "'the agent went about and at noon had more text by the clean page once without a'"))
    out = {r.doc_id: r.text for r in sanitise.sanitised(docs).where("doc_id < 11").collect()}
    # Whinchat stands with the address in two of three texts, 4711 in two of two.
    assert [out[i] for i in range(5)] == ["agent nightjar at <email>", "agent Whinchat <number> at <email> and", "about agent Whinchat <number> at <email>", near[3][1], near[4][1]]


def test_terms_everywhere_need_strict_evidence(spark):
    gap = "the agent went about and at noon had more text "
    held = [(i, f"Nightjar x7 {gap} x.y@z.org {i}") for i in range(20)] + [(20 + i, f"{gap} whinchat v.w@z.org {i}") for i in range(4)]
    clean = [(100, f"{gap} NIGHTJAR and x7"), (101, f"{gap} whinchat")]
    docs = spark.createDataFrame(held + clean + [(200 + i, gap) for i in range(4000)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in sanitise.sanitised(docs).where("doc_id < 200").collect()}
    assert out[0] == f"<name> <code> {gap} <email> 0" and out[20] == f"{gap} <word> <email> 0"
    assert out[100] == f"{gap} <name> and <code>" and out[101] == clean[1][1]


@pytest.mark.parametrize("limit", [0, 200_000])
def test_terms_by_brute_force(spark, monkeypatch, limit):
    """All spans, with the terms sent to the tasks and with the bit table and joins."""
    monkeypatch.setattr(sanitise, "BROADCAST_ROWS", limit)
    rnd = random.Random(12)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ann", "Éva", "77", "x9"]
    entities = ["a.b@c.org", "10.0.0.1", "d@e.net"]
    rows = []
    for i in range(400):
        words = [rnd.choice(vocabulary[:50]) for _ in range(12)]
        e = rnd.randrange(40)
        if e < 3:
            words += [entities[e], vocabulary[50 + 4 * e], vocabulary[51 + 4 * e], rnd.choice(vocabulary[50:])]
        elif e == 3:
            words.append(rnd.choice(vocabulary[50:]))
        rows.append((i, " ".join(words)))
    rows += [(500, rows[3][1]), (501, None), (502, "")]
    got = {r.doc_id: [(s.start, sanitise.KINDS[s.kind], s.end) for s in r.all_spans] for r in sanitise.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.op8_terms(rows, sanitise)
    assert got == want and sum(k in sanitise.CLASSES for spans in got.values() for _, k, _ in spans) > 20


def test_terms_anywhere_in_the_corpus(spark):
    gap = "the agent went about and at noon had more text "
    near = [(i, f"Nightjar, é Li {gap * 3}mail x.y@z.org or li@z.org {gap}{i}") for i in (0, 1, 3, 4)] + [(2, f"nightjar {gap} Li, nightjar {gap}")]
    docs = spark.createDataFrame(near + [(10 + i, f"{gap}{i % 7} é") for i in range(3000)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in sanitise.sanitised(docs).collect()}
    assert [out[i] for i in (0, 1, 3, 4)] == [f"<name>, é <name> {gap * 3}<word> <email> <word> <email> {gap}{i}" for i in (0, 1, 3, 4)]
    assert out[2] == near[4][1]  # four of five texts with the terms hold the entity: not enough for texts without it
    assert out[10] == f"{gap}0 é"
    rows = {r.doc_id: r.all_spans for r in sanitise.personal_data(docs).where("doc_id < 20").collect()}
    assert [(s.start, s.kind, s.end) for s in rows[0][:2]] == [(0, 4, 8), (12, 4, 14)] and len(rows[2]) == 0


def test_proximity(spark, benchmark):
    docs = spark.createDataFrame([(1, "two zero three x four"), (2, "two a b c d e f g h i three")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.proximity_matches(docs, benchmark, slop=2).collect()}
    assert got == {(1, "1"), (1, "4")}


@pytest.mark.parametrize("slop", [1, 2, 7])
def test_proximity_by_brute_force(spark, slop):
    """Every shift of the first term with one of the second within the slop, also before the text's start."""
    rnd = random.Random(slop)
    lists = [(row, term, place) for row in (1, 2, 3) for term in "ab" for place in sorted(rnd.sample(range(120), 25))]
    postings = spark.createDataFrame(lists, "row long, term string, place int")
    pairs = spark.createDataFrame([("a z b", "a", 0, "b", 40), ("b a", "b", 30, "a", 31)], "item string, t1 string, o1 int, t2 string, o2 int")
    want = set()
    for item, t1, o1, t2, o2 in map(tuple, pairs.collect()):
        for row, term, place in lists:
            if term == t1 and any(r == row and t == t2 and abs((place - o1) - (p - o2)) <= slop for r, t, p in lists):
                want.add((row, item, place - o1))
    got = [tuple(r) for r in decontaminate.intersect(postings, pairs, slop).collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(shift < 0 for _, _, shift in want)


def test_backoff_on_a_tiny_corpus(spark):
    """Unknown words, unknown histories, histories with every count of counts missing."""
    texts = ["a b a c", "a b b", "c a b", "d", "a b a c a b", "b d", "never seen", "d never a", "", None] * 4
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, f"z{i} a z{i}") for i in range(100, 160)]

    def p(stats):
        model = katz.Unigrams(np.array(stats))
        return lambda c: float(model.p(np.array([c]))[0])

    want = {r[0]: r for r in brute.op9(rows, lambda n: katz.discounts(np.array(n)), p)}
    got = katz.language_model_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and any(r.held_out for r in got)
    for r in got:
        assert tuple(r)[:5] == want[r.doc_id][:5] and abs(r.score - want[r.doc_id][6]) < 1e-9


def test_unigrams_sum_to_one():
    counts = np.array([1, 1, 1, 1, 2, 2, 3, 9, 40])
    stats = [counts.sum(), len(counts), *((counts == r).sum() for r in range(1, 7))]
    model = katz.Unigrams(np.array(stats))
    assert abs(model.p(counts).sum() + model.unknown - 1) < 1e-12


def test_shards_of_one_hot_text(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('hot ', 50) ELSE repeat(chr(97 + CAST(id % 25 AS INT)), CAST(id % 190 AS INT) + 10) END AS text")
    size = [r.s for r in kdtree.shard(docs, 8).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "s").collect()]
    assert len(size) == 8 and max(size) < 1.15 * sum(size) / 8 and min(size) > 0.85 * sum(size) / 8


def test_plan_places_every_piece():
    counts = {1: 1000, 2048: 3, 2047: 5, 1024: 7, 700: 30, 650: 11, 3: 1}
    planned = packing.plan(counts)
    used: dict = {}
    for config, copies in planned:
        assert sum(a * b for a, b in config) <= 2048
        for x, k in config:
            used[x] = used.get(x, 0) + k * copies
    assert used == counts
    # Three of a kind fit only with two of 650: five such, 17 pairs and the eight full ones are the optimum.
    assert sum(c for _, c in planned) == 30


def test_audit_of_odd_rows(odd, empty, labels):
    rows = odd.selectExpr("*", "CASE WHEN doc_id = 6 THEN NULL WHEN doc_id < 3 THEN 'copies' ELSE '' END AS source", "row AS part", "row AS failed", "row AS shard")
    got = {(r.part, r.filter_order, r.step): r for r in audit.filter_audit(rows, labels).collect()}
    assert len(got) == 2 * 120 * 5
    one = got["copies", "EABCD", 1]  # 1 and 2 hold one text
    assert (one.kept, one.removed, one.redundant, one.unique_fails, one.good_lost, one.toxic_lost) == (1, 1, 0, 0, 0, 0)
    # Both fail A and B, the second E as well: 60 orders each begin with A, 40 with A before B and E.
    assert [got["copies", "EABCD", k].shapley for k in (1, 2, 3)] == [40, 100, 100]
    last = got["", "ABCDE", 5]
    assert last.kept == 0 and got["", "BACDE", 1].removed == 1 and got["", "BACDE", 1].toxic_lost == 1
    assert got["", "EABCD", 1].removed == 1  # of the null and the empty text; the white-space one differs, repeated rows aren't copies
    assert audit.filter_audit(empty.withColumn("source", empty["row"]), labels).count() == 0
    assert audit.filter_audit(rows, labels.limit(0)).agg({"good_lost": "max"}).first()[0] == 0


def test_pieces_of_a_long_text_count_like_the_whole(spark, monkeypatch):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("a b c é longerword".split()) for _ in range(rnd.randrange(400))) + "x" * (k % 3 * 150) for k in range(30)] + ["", "   ", "y" * 900]
    docs = spark.createDataFrame([(i, "p", b"%d" % i, t) for i, t in enumerate(texts)], "doc_id long, part string, copy binary, text string").coalesce(1)
    want = [(i, len(w), len(set(w))) for i, w in enumerate(brute.SPACED.findall(t) for t in texts)]
    col = pa.array(texts, pa.large_string())
    data, off = audit.T.raw(col)
    for limit in (7, 64, 1000):
        cuts = list(audit.pieces(data, off, limit))
        assert cuts[0][0] == 0 and cuts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
        shard = audit._Shard()
        shard.parts = [audit._counted(data, off, x, y) for x, y in cuts]
        indptr, column, n, terms = shard.rows(0, len(texts))
        got = [(i, int(n[indptr[i] : indptr[i + 1]].sum()), int(indptr[i + 1] - indptr[i])) for i in range(len(texts))]
        assert got == want
        assert sorted(terms.to_pylist()) == sorted({w.encode() for t in texts for w in brute.SPACED.findall(t)})
    monkeypatch.setattr(audit, "SLICE_BYTES", 8)
    matrix = audit.document_term_matrix(docs).collect()
    assert sum(len(r.doc_ids) for r in matrix) == len(texts)
    numbers = {int(n) for r in matrix for n in audit.unpack(r.csr)[1]}
    assert numbers == set(range(len({w for t in texts for w in brute.SPACED.findall(t)})))


def test_centroids_of_odd_vectors(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([0.0, 0.5, -0.25, 1e30, -3.0]) for _ in range(64)], "x") for i in range(60)]
    rows += [(60, [0.5] * 64, "x")] * 3 + [(None, [0.25] * 64, "x"), (70, None, "x"), (71, [0.5] * 63, "x"), (72, [None] + [0.5] * 63, "x"), (73, [float("nan")] * 64, "x"), (74, [float("inf")] * 64, "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")
    got = sorted((tuple(r)[:5] for r in centroids.clustered(vectors).where("vec_id IS NOT NULL").collect()))
    assert len(got) == 63 and centroids.clustered(vectors).count() == 64
    clipped = [(i, [int(1024 * min(max(x, -centroids.LARGEST), centroids.LARGEST) // 1) for x in v]) for i, v, _ in rows[:63]] + [(None, [256] * 64)]
    top = (1 << 63) - 1  # inertia is kept within a long
    assert got == sorted((i, j, far, min(a, top), min(b, top)) for i, j, far, a, b, _ in brute.op12(clipped) if i is not None)
    assert centroids.clustered(vectors.limit(0)).count() == 0
    assert {r.distance for r in centroids.clustered(vectors.limit(3)).collect()} == {0}


def test_walks_end_at_ties():
    rnd = np.random.default_rng(1)
    for k, dims in ((1, 3), (5, 2), (8, 4)):
        x, c = rnd.integers(-3, 4, (500, dims)), rnd.integers(-3, 4, (k, dims))
        far = ((x[:, None] - c[None]) ** 2).sum(2)
        label, best = centroids.nearest(x, c)
        assert (best == far.min(1)).all() and (label == far.argmin(1)).all()


def test_fingerprints_of_odd_rows(odd):
    rows = simhash.document_fingerprints(odd).collect()
    got = {r.doc_id: r for r in rows}
    assert got[1].fingerprint == got[2].fingerprint and got[3].fingerprint == got[4].fingerprint == "0" * 32
    assert [(r.n_chars, r.near_edited) for r in rows if r.doc_id in (3, 4)] == [(0, 1.0)] * 2
    # Descending ids, the null id last, then the first again: 1 is followed by the text without an id, that by 8.
    nameless = "a text without an id"
    text = "one two three four five six seven eight nine ten " * 3
    half = len(text) // 2
    assert got[1].edited_sha256 == brute.hashlib.sha256((text[: len(text) - half] + nameless[:half]).encode()).hexdigest()
    assert got[None].edited_sha256 == brute.hashlib.sha256((nameless[:10] + "mail me at"[:10]).encode()).hexdigest()
    assert sum(r.doc_id == 7 for r in rows) == 2 and all(r.n_near is None for r in rows)


def test_every_fingerprint_within_the_radius(spark):
    rnd = random.Random(9)
    base = [rnd.getrandbits(128) for _ in range(4)] + [0, (1 << 128) - 1]
    prints = {b ^ sum(1 << i for i in rnd.sample(range(128), rnd.randrange(10))) for b in base for _ in range(80)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(p >> 64), signed(p & (1 << 64) - 1)) for p in prints]
    frame = spark.createDataFrame(rows, "fp_high long, fp_low long")
    got = [tuple(x & (1 << 64) - 1 for x in r) for r in simhash.within_radius(frame.limit(100), frame).collect()]
    asked = [tuple(x & (1 << 64) - 1 for x in r) for r in rows[:100]]
    want = {(a, b, p >> 64, p & (1 << 64) - 1) for a, b in asked for p in prints if ((a << 64 | b) ^ p).bit_count() <= simhash.RADIUS}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("limit", [0, 200_000])
@pytest.mark.parametrize("share", [3, 256])
def test_a_large_cluster_in_shares(spark, monkeypatch, limit, share):
    """Hub, members in shares, and members that are linked to each other only; tables broadcast or joined by shuffle."""
    monkeypatch.setattr(hyperminhash, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(hyperminhash, "SHARE", share)
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rnd.randrange(9)):
            words[rnd.randrange(120)] = f"x{rnd.randrange(40)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"v{i}x{k}" for k in range(30))) for i in range(5)] + [(200, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, hyperminhash.near_duplicates(docs, k=4, percent=80).collect()))
    assert got == sorted(brute.op6(rows, 4, 80))


def test_frequent_histories_meet_their_weights_in_place(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice("a b c d e f g h".split()) for _ in range(20))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.score for r in katz.language_model_scores(docs).collect()}
    monkeypatch.setattr(katz, "FREQUENT", 1)  # none is
    got = {r.doc_id: r.score for r in katz.language_model_scores(docs).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


@pytest.mark.parametrize("limit", [0, 200_000])
def test_large_groups_by_broadcast_or_shuffle(spark, monkeypatch, limit):
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", limit)
    rnd = random.Random(limit)
    base = [rnd.choice("abcdefghij") for _ in range(120)]
    rows = [(i, " ".join([f"x{i}", *base[(a := rnd.randrange(60)) : a + 50]])) for i in range(20)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), group=5).collect())
    assert got == [r[:3] for r in brute.op2(rows)]


def test_every_split_is_a_weighted_median_of_the_widest_dimension(spark):
    """The whole tree against plain Python on the collected units, categories and ties included."""
    rnd = random.Random(11)
    rows = [(float(i), rnd.choice([5.0, 6.0, rnd.uniform(4, 12)]), rnd.uniform(0, 9), rnd.choice([1e14, -3e14, 7e13]), rnd.choice([1e14, 2e14]) if i % 3 else 2e14, rnd.randint(-(2**52), 2**52) * 1.0, rnd.randint(17, 400)) for i in range(700)]
    units = spark.createDataFrame(rows, "id double, size double, n_chars double, lang double, source double, tie double, weight long")
    names = [*kdtree.DIMENSIONS, "tie", "weight"]
    every = [dict(zip(names, r, strict=True)) for r in rows]
    whole = {d: max(u[d] for u in every) - min(u[d] for u in every) for d in kdtree.DIMENSIONS}
    used = set()

    def walk(node, mine):
        if node.dim is None:
            assert node.shards == 1
            return
        width = {d: (max(u[d] for u in mine) - min(u[d] for u in mine)) / whole[d] for d in kdtree.DIMENSIONS}
        assert width[node.dim] == max(width.values())
        used.add(node.dim)
        left = [u for u in mine if (u[node.dim], u["tie"]) <= (node.value, node.tie) or u[node.dim] < node.value]
        total, want = sum(u["weight"] for u in mine), node.shards // 2 / node.shards
        assert abs(sum(u["weight"] for u in left) - want * total) <= max(u["weight"] for u in mine) + 1e-4 * total
        walk(node.left, left)
        walk(node.right, [u for u in mine if not any(u is v for v in left)])

    walk(kdtree.build(units, 24), every)
    assert {"id", "lang", "source"} <= used


def test_metadata_of_any_type_shards(spark):
    """Columns named like the dimensions but of other types, null or unreadable values."""
    docs = spark.range(120).selectExpr("id AS doc_id", "repeat(chr(97 + CAST(id % 25 AS INT)), CAST(id AS INT) + 1) AS text", "CASE id % 3 WHEN 0 THEN 'many' WHEN 1 THEN '-5' END AS n_chars", "array(id % 2) AS lang", "IF(id % 5 = 0, null, id % 4) AS source", "id AS unit", "id AS same")
    got = kdtree.shard(docs, 6)
    assert got.count() == 120 and got.select("shard").distinct().count() == 6


def test_packed_rows_lie_in_whole_buckets(spark):
    """A result of a few thousand rows is one bucket, so one part, however many shuffle partitions there are; no length's rows stand out."""
    docs = spark.range(3000).selectExpr("nullif(id, 7) AS doc_id", "IF(id % 2 = 0, 'word', repeat('word ', CAST(id AS INT) % 500)) AS text")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        for limit in ("-1", "10m"):  # counts by a shuffle, by a broadcast
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            out = packing.pack(docs)
            rows = out.withColumn("part", F.spark_partition_id()).collect()
            assert len(rows) == 3000 and len({r["part"] for r in rows}) == 1
            ends = {}
            for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
                assert r["offset"] == ends.get(r["sequence_id"], 0)
                ends[r["sequence_id"]] = r["offset"] + r["length"]
            assert max(ends.values()) <= packing.CAPACITY
            ranked = numbered(spark.range(4000).selectExpr("id", "id % 7 AS kind"), "kind", ["id"], ["id"], per_bucket=100, whole_buckets=True).withColumn("part", F.spark_partition_id()).collect()
            slots = {k: sorted(r["slot"] for r in ranked if r["kind"] == k) for k in range(7)}
            assert all(v == list(range(len(v))) for v in slots.values()) and sum(map(len, slots.values())) == 4000
            assert 10 < len({r["part"] for r in ranked}) <= 31
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for k, v in keep.items():
            spark.conf.set(k, v)

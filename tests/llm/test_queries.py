"""Registered queries at sf0.01 against plain-Python answers from their contracts."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from llm import brute
from llm.conftest import SF
from oracle_check import compare, duck

from climatrix.llm import katz, licenses, packing, sanitise
from climatrix.llm.queries import QUERIES, SQL


def by_id(rows):
    return sorted(rows, key=lambda r: r[:2])


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), SQL[name]) == []


def test_licenses(run, documents):
    assert run("op1_license_scan") == by_id(brute.op1(documents, licenses.TEMPLATES, licenses.PERCENT))


def test_substrings(run, documents):
    assert run("op2_substring_dedup") == by_id(brute.op2(documents))


def test_quality_rules(run, documents):
    got = run("op3_compression_bands")
    assert [r[:7] for r in got] == by_id(brute.op3(documents))
    assert not any(r[7] for r in got if r[6])


def test_quality_rules_keep_good_documents(spark, run):
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    refused = [r for r in run("op3_compression_bands") if r[0] in good and not r[6] and not r[7]]
    assert refused == []


def test_packing(run, documents):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(packing.default_tokenizer()).encode
    want = {}
    for doc_id, text in documents:
        ids = encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[doc_id, k // 2048] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    got = run("op4_packing")
    assert {r[:2]: r[2:5] for r in got} == want and len(got) == len(want)
    ends: dict = {}
    for _, _, _, length, _, sequence, offset in sorted(got, key=lambda r: (r[5], r[6])):
        assert ends.get(sequence, 0) == offset
        ends[sequence] = offset + length
    assert max(ends.values()) <= 2048
    assert len(ends) <= math.ceil(sum(r[3] for r in got) / 2048) * 1.01 + 1


def test_quality_scores(spark, run):
    got = run("op5_quality_classifier")
    assert all(r[1] == (brute.fold(r[0], 5) == 0) and 0 <= r[2] <= 1 and r[3] == (r[2] >= 0.3) for r in got)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(label[r[0]], r[2]) for r in got if r[1] and r[0] in label]
    good, bad = [s for y, s in held if y], [s for y, s in held if not y]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.95


def test_near_duplicates(run, documents):
    assert run("op6_near_duplicates") == by_id(brute.op6(documents, 4, 80))


def test_personal_data(run, documents):
    assert [r[:6] for r in run("op8_sanitisation")] == [r[:6] for r in by_id(brute.op8(documents))]


def test_disclosing_terms(run, documents):
    want = {i: ",".join(f"{k}:{s}:{e}" for s, k, e in spans) for i, spans in brute.op8_terms(documents, sanitise).items()}
    assert {r[0]: r[6] for r in run("op8_sanitisation")} == want


def test_language_model(run, documents):
    def p(stats):
        model = katz.Unigrams(np.array(stats))
        return lambda c: float(model.p(np.array([c]))[0])

    want = by_id(brute.op9(documents, lambda n: katz.discounts(np.array(n)), p))
    for a, b in zip(run("op9_katz_backoff"), want, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


def test_shards(run, documents):
    text = dict(documents)
    size, slots, shard_of = {}, {}, {}
    for doc_id, n, crc, law, shard, slot, grown in run("op10_kd_shards"):
        body = (text[doc_id] or "").encode()
        assert (n, crc, law, grown) == (len(body) + 16, zlib.crc32(body), "bytes", None)
        size[shard] = size.get(shard, 0) + n
        slots.setdefault(shard, []).append(slot)
        shard_of.setdefault(body, set()).add(shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(size) == set(range(40))
    mean, largest = sum(size.values()) / 40, max(len(b) for b in shard_of) + 16
    assert max(size.values()) - mean <= largest and mean - min(size.values()) <= largest
    assert all(len(s) == 1 for s in shard_of.values())


def test_centroids_without_pruning(spark, run):
    """Every vector against every centroid in plain Python integers."""
    rows = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute.op12(rows)
    assert [tuple(r) for r in run("op12_centroid_clustering")] == sorted(want)


def test_fingerprints(run, documents):
    assert run("op13_fingerprints") == by_id(brute.op13(documents))


def test_fingerprints_tell_edits_from_other_texts(run):
    rows = [r for r in run("op13_fingerprints") if r[1] >= 200]
    assert sum(r[5] > r[6] for r in rows) / len(rows) > 0.97

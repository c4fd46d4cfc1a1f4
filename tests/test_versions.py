"""Landing with repeats, corrections, any order and bad pages against the batch answer."""

from __future__ import annotations

import json
import random
import uuid

import pytest

from climatrix.plans.curate import station_day_from_long
from climatrix.session import scratch_path
from climatrix.streaming import current_observations, dead_letters, keep_current, land_versions, landed_observations, latest_observations, overdue_records


def record(day, station, code, value, attributes=None):
    return {"date": f"2024-01-{day:02}T00:00:00", "datatype": code, "station": station, "attributes": attributes, "value": value}


def pages():
    rnd = random.Random(3)
    first = [[record(d, s, c, round(rnd.uniform(0, 300), 1)) for c in ("TMAX", "TMIN", "PRCP") for d in range(k, k + 3)] for k in (1, 4, 7, 10) for s in ("A", "B")]
    fixed = [[{**r, "value": r["value"] + 50} for r in page if r["datatype"] == "TMAX"] for page in first[::2]]
    twice = [[record(1, "A", "PRCP", 100.0, "x"), record(1, "A", "PRCP", 300.0, "y")]]  # duplicates of one fetch: their mean
    gone = [[{**first[1][0], "value": None}]]
    out = [(p, "2024-02-01") for p in first] + [(p, "2024-03-01") for p in fixed] + [(p, "2024-02-15") for p in twice] + [(p, "2024-03-02") for p in gone]
    return [{"results": p, "fetched": f} for p, f in out]


def stream(spark, tmp_path, docs, late="3650 days", per_batch=3):
    """Land the documents (text as it is) in their order, a few a micro-batch; ``docs`` may come in several runs."""
    pages_dir, landed, dead, current = tmp_path / "pages", *(scratch_path(spark, f"versions-test-{x}") for x in "ldc")
    pages_dir.mkdir()
    checks = [scratch_path(spark, "versions-test-check") for _ in "ab"]
    for run in docs:
        for doc in run:
            (pages_dir / f"{uuid.uuid4().hex}.json").write_text(doc if isinstance(doc, str) else json.dumps(doc))
        land_versions(spark, str(pages_dir), landed, dead, checks[0], max_files_per_trigger=per_batch).awaitTermination()
        keep_current(spark, landed, current, late, checks[1], max_files_per_trigger=per_batch).awaitTermination()
    return landed, dead, current


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def wide(df):
    return rows(station_day_from_long(df, ["TMAX", "TMIN", "PRCP"]))


@pytest.fixture(scope="module")
def answer(spark):
    """The batch pivot of every page once, as plain Python has it."""
    best: dict = {}
    for page in pages():
        for r in page["results"]:
            key, f = (r["date"], r["station"], r["datatype"]), page["fetched"]
            if key not in best or f > best[key][0]:
                best[key] = (f, set())
            if f == best[key][0]:
                best[key][1].add((r["attributes"], r["value"]))
    return {k: (lambda v: sum(v) / len(v) / 10 if v else None)([x for _, x in s if x is not None]) for k, (_, s) in best.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_and_repetition(spark, tmp_path, answer, seed):
    docs = pages() * 2
    random.Random(seed).shuffle(docs)
    landed, dead, current = stream(spark, tmp_path, [docs[:9], docs[9:]])
    got = {(r.date.isoformat(), r.station, r.datatype): r.value for r in current_observations(spark, current).collect()}
    assert set(got) == set(answer) and all(got[k] == pytest.approx(answer[k]) if answer[k] is not None else got[k] is None for k in answer)
    batch = latest_observations(landed_observations(spark, landed))
    for a, b in zip(wide(current_observations(spark, current)), wide(batch), strict=True):
        assert a[:7] == b[:7] and all(x == y or x == pytest.approx(y) for x, y in zip(a[7:], b[7:], strict=True))
    assert overdue_records(spark, landed, current).count() == 0 and dead_letters(spark, dead).count() == 0


def test_a_bad_page_lands_aside_and_the_stream_goes_on(spark, tmp_path):
    good = [{"results": [record(1, "A", "TMAX", 100.0)]}, {"results": [record(2, "A", "TMAX", 200.0)], "fetched": "2024-02-01"}]
    bad = ['{"results": [{"date": "2024-01', "not json", json.dumps({"results": [{**record(3, "A", "TMAX", 1.0), "value": "much"}]})]
    odd = [{"results": [{**record(4, "A", "TMAX", 1.0), "date": "tomorrow"}, {**record(4, None, "TMAX", 1.0)}, record(5, "A", "TMAX", 500.0)]}, {"message": "no results"}, {"results": []}]
    landed, dead, current = stream(spark, tmp_path, [[good[0], *bad[:2]], [bad[2], *odd], [good[1]]], per_batch=1)
    letters = dead_letters(spark, dead).collect()
    assert sorted(r.reason for r in letters) == ["page", "page", "page", "record", "record"]
    assert all(r.file and r.given for r in letters if r.reason == "page") and any("tomorrow" in r.given for r in letters)
    assert [(r.date.day, r.value) for r in current_observations(spark, current).orderBy("date").collect()] == [(1, 10.0), (2, 20.0), (5, 50.0)]


def test_records_behind_the_watermark_are_listed(spark, tmp_path):
    new = {"results": [record(28, "A", "TMAX", 100.0)], "fetched": "2024-02-01"}
    more = {"results": [record(29, "A", "TMAX", 100.0)], "fetched": "2024-02-01"}
    old = {"results": [record(2, "A", "TMAX", 70.0)], "fetched": "2024-02-01"}
    landed, _, current = stream(spark, tmp_path, [[new], [more], [old]], late="5 days")
    assert [r.date.day for r in current_observations(spark, current).orderBy("date").collect()] == [28, 29]
    assert [(r.date.day, r.value) for r in overdue_records(spark, landed, current).collect()] == [(2, 7.0)]
    assert latest_observations(landed_observations(spark, landed)).count() == 3

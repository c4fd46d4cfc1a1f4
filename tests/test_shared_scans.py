"""One scan for many tables, attributes as of a date, smoothed violins."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from climatrix.operators import bins, lattice, prepare, report, rollup

DAY = dt.datetime(2000, 1, 1)


# --------------------------------------------------------------- lattice
@pytest.fixture(scope="module")
def days(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(500):
        t = rnd.choice([None, float("nan"), rnd.gauss(10, 8), rnd.gauss(1e6, 1)])
        rows.append((rnd.choice([2000, 2001, 2003, None]), rnd.choice([1, 2, 12, None]), rnd.choice(["A", "A", "B", "C", None]), t, t, t, rnd.choice([None, 0.0, 2.5])))
    return spark.createDataFrame(rows, "year int, month int, station string, tavg double, tmax double, tmin double, prcp double")


ALONE = {
    "report_yearly": report.report_yearly, "report_monthly": report.report_monthly, "report_station": report.report_station, "report_station_counts": report.report_station_counts,
    "report_header": report.report_header, "report_stability": report.report_stability, "yearly_temperature": rollup.yearly_temperature, "monthly_precipitation": rollup.monthly_precipitation,
    "month_year_matrix": rollup.month_year_matrix, "monthly_stream": rollup.monthly_stream, "seasonal_profile": rollup.seasonal_profile, "yearly_mean": rollup.yearly_mean,
}


def _close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def test_lattice_equals_the_single_tables(spark, days):
    stations = spark.createDataFrame([("A", "Asia", 1.0, 2.0), ("B", None, 1.0, 2.0), ("C", "Europe", None, 3.0)], "station string, continent string, lat double, lon double")
    from climatrix.functions.safe import nan_free

    plain = nan_free(days)
    alone = {**{k: f(plain) for k, f in ALONE.items()}, "continent_year": rollup.continent_year(plain, stations)}
    tables = lattice.all_tables(days, stations)
    assert set(tables) == set(alone)
    for name, df in tables.items():
        want = alone[name].select(*df.columns).collect()
        got = df.collect()
        if "order" not in name:
            got, want = sorted(map(tuple, got), key=str), sorted(map(tuple, want), key=str)
        assert len(got) == len(want) and all(_close(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True)), name


def test_lattice_reads_the_facts_once(spark, days, tmp_path):
    days.write.parquet(str(tmp_path / "days"))
    facts = spark.read.parquet(str(tmp_path / "days"))
    base = lattice.partials(facts)._jdf.queryExecution().executedPlan().toString()
    assert base.count("FileScan parquet") == 1
    for df in lattice.all_tables(facts).values():
        assert "FileScan parquet" not in df._jdf.queryExecution().executedPlan().toString()


def test_lattice_of_no_rows(days):
    tables = lattice.all_tables(days.limit(0))
    assert {k: df.count() for k, df in tables.items() if df.count()} == {"report_stability": 1}
    assert tables["report_stability"].first() == (None, 0)


# ----------------------------------------------------------------- as of
def _as_of(history, station, date):
    best = [(t, lat, name) for s, t, lat, name in history if s == station is not None and t is not None and date is not None and t <= date]
    return max(best)[1:] if best else (None, None)


@pytest.mark.parametrize(("slice_days", "salts"), [(366, 8), (1, 1), (30, 3)])
def test_attributes_as_of(spark, slice_days, salts):
    rnd = random.Random(6)
    history = [(s, DAY + dt.timedelta(days=rnd.randrange(-400, 900), hours=rnd.choice([0, 12])), float(rnd.randrange(90)), rnd.choice("xyz")) for s in "ABC" for _ in range(4)]
    history += [("A", DAY, 1.0, "a"), ("A", DAY, 2.0, "a"), ("B", None, 5.0, "b"), (None, DAY, 6.0, "n")]
    rows = [(i, rnd.choice(["A", "A", "A", "B", "C", "D", None]), None if rnd.random() < 0.05 else DAY + dt.timedelta(days=rnd.randrange(-500, 1000)), 1.0) for i in range(400)]
    rows += [(i, "A", DAY, 2.0) for i in (1, 1, 400)]
    obs = spark.createDataFrame(rows, "id long, station string, date timestamp_ntz, lon double")
    moved = spark.createDataFrame(history, "station string, valid_from timestamp_ntz, lat double, name string")
    out = prepare.attach_attributes_as_of(obs, moved, slice_days=slice_days, salt_buckets=salts)
    assert out.columns == ["id", "station", "date", "lon", "lat", "name"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((*r, *_as_of(history, r[1], r[2])) for r in rows), key=str)
    assert prepare.attach_attributes_as_of(obs.limit(0), moved).count() == 0
    assert prepare.attach_attributes_as_of(obs, moved.limit(0)).where("lat IS NULL").count() == len(rows)


def test_a_hot_station_is_spread(spark):
    """A station with all of a day's rows: its rows go through many shares of the sorted stream."""
    obs = spark.range(8000).selectExpr("id", "'A' AS station", "timestamp_ntz'2000-06-01' AS date")
    moved = spark.createDataFrame([("A", DAY, 1.0)], "station string, valid_from timestamp_ntz, lat double")
    out = prepare.attach_attributes_as_of(obs, moved, salt_buckets=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan and out.where("lat = 1.0").count() == 8000
    shares = obs.groupBy(F.pmod(F.xxhash64(*obs.columns), F.lit(16))).count().collect()
    assert len(shares) == 16 and max(r["count"] for r in shares) < 8000 / 16 * 1.3


# ---------------------------------------------------------------- violin
def test_violin_is_the_kernel_estimate(spark):
    rnd = np.random.default_rng(3)
    values = {"a": np.concatenate([rnd.normal(0, 1, 400), rnd.normal(8, 0.5, 200)]), "b": rnd.exponential(3, 300)}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("flat", 2.0)] * 5 + [("one", 1.0), ("a", None), ("b", float("nan")), ("b", float("inf")), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = bins.violin_kernel(df, "v", "g", 256).orderBy("g", "point").collect()
    assert {r.g for r in out} == {"a", "b"}
    for g, vs in values.items():
        own = [r for r in out if r.g == g]
        x, d, bw = np.array([r.x for r in own]), np.array([r.density for r in own]), own[0].bandwidth
        assert own[0].n == len(vs) and math.isclose(bw, bins.SILVERMAN * vs.std(ddof=1) * len(vs) ** -0.2, rel_tol=1e-9)
        assert math.isclose(d.sum() * (x[1] - x[0]), 1.0, rel_tol=1e-9)
        exact = np.exp(-0.5 * ((x[:, None] - vs[None]) / bw) ** 2).sum(1) / (len(vs) * bw * math.sqrt(2 * math.pi))
        assert np.abs(d - exact).max() < 0.01 * exact.max()
    assert bins.violin_kernel(df.limit(0), "v", "g").count() == 0


def test_violin_by_the_station_table_equals_the_column(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ABC"), rnd.choice([1, 2]), rnd.gauss(0, 3)) for _ in range(600)]
    df = spark.createDataFrame(rows, "station string, month int, v double")
    stations = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "x")], "station string, continent string")
    for by in ("continent", ["month", "continent"]):
        got = bins.violin_kernel(df, "v", by, 32, stations=stations).collect()
        want = bins.violin_kernel(df.join(stations, "station"), "v", by, 32).collect()
        a, b = (sorted(map(tuple, rows), key=lambda r: r[: len(r) - 4]) for rows in (got, want))
        assert len(a) == len(b) > 0 and all(_close(x, y) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))

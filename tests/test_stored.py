"""Sketch tables, pyramids and maintained states: merges equal one scan, and reads are pruned."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from climatrix.operators import kpi, pyramid, rollup, sketch, state
from climatrix.session import scratch_path

SCHEMA = "year int, station string, tavg double, tmax double, tmin double, prcp double, humidity double, solar_radiation double, wind_speed double"


def _days(spark, n=600, seed=1):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        t = None if rnd.random() < 0.1 else rnd.gauss(15, 10)
        rows.append((rnd.choice([2000, 2001, 2002, None]), rnd.choice(["A", "A", "A", "B", "C", None]), t, t and t + 5, t and t - 5, rnd.choice([0.0, 3.0, 40.0, None]), 60.0, None, rnd.random()))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def stations(spark):
    return spark.createDataFrame([("A", "Asia", 10.0, 20.0), ("B", "Europe", -10.0, 5.0), ("C", None, None, 0.0)], "station string, continent string, lat double, lon double")


# ---------------------------------------------------------------- states
def _same(got, want):
    a, b = (sorted((tuple(r) for r in df.collect()), key=str) for df in (got, want))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-9)) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 1, 0, 2, 1, 3]])
def test_state_equals_one_scan(spark, stations, order):
    days = _days(spark).withColumn("batch", F.pmod(F.xxhash64("tavg", "prcp", "wind_speed"), F.lit(4))).checkpoint()
    path = scratch_path(spark, "state-test")
    for i, b in enumerate(order):
        state.append_batch(days.where(F.col("batch") == b).drop("batch"), path, b)
        if i == 1 and order[0] == 0:
            assert state.compact(spark, path) == 1
    whole = days.drop("batch")
    _same(state.dashboard(state.read_state(spark, path), stations), kpi.kpi_dashboard(whole, stations))
    _same(state.continent_year(state.read_state(spark, path), stations), rollup.continent_year(whole, stations))


def test_half_written_folders_do_not_count(spark, stations):
    path = scratch_path(spark, "state-test")
    days = _days(spark, 50)
    state.append_batch(days, path, 0)
    before = state.dashboard(state.read_state(spark, path), stations).first()
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    days.limit(3).write.parquet(f"{path}/merged/upto=7")
    fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/merged/upto=7/_SUCCESS"), False)
    assert state.dashboard(state.read_state(spark, path), stations).first() == before
    with pytest.raises(ValueError, match="no batch"):
        state.read_state(spark, path + "-none")


def test_state_of_a_stream(spark, stations):
    days, source, path = _days(spark, 200), scratch_path(spark, "days"), scratch_path(spark, "state-test")
    days.repartition(5).write.parquet(source)
    stream = spark.readStream.schema(days.schema).option("maxFilesPerTrigger", 2).parquet(source)
    state.maintain(stream, path).awaitTermination()
    assert len(state._folders(spark, path, "batch=")) >= 3
    _same(state.dashboard(state.read_state(spark, path), stations), kpi.kpi_dashboard(days, stations))


# -------------------------------------------------------------- sketches
def test_sketch_ranks(spark):
    rnd = random.Random(5)
    rows = [(2000 + i % 4, f"S{i % 7}", rnd.lognormvariate(0, 4)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "year int, station string, v double")
    table = sketch.write_sketches(sketch.quantile_sketches(df, ["v"]), scratch_path(spark, "sketch-test"))
    some = table.where("year IN (2001, 2002)")
    assert "PartitionFilters: [" in some._jdf.queryExecution().toString() and "lineitem" not in some._jdf.queryExecution().toString()
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    own = np.sort([v for y, _, v in rows if y in (2001, 2002)])
    r = sketch.sketch_quantiles(some, probs, names=list("abcde")).first()
    assert (r.n, r.lo, r.hi) == (len(own), own[0], own[-1])
    for name, p in zip("abcde", probs, strict=True):
        assert abs(np.searchsorted(own, r[name]) / len(own) - p) <= 2 * sketch.rank_error()
    exact = sketch.exact_quantiles(df.where("year IN (2001, 2002)"), some, probs, names=list("abcde")).first()
    assert np.allclose(list(exact)[-5:], np.quantile(own, probs), rtol=1e-12)
    by = {x.station: x for x in sketch.exact_quantiles(df, table, by=["station"]).collect()}
    assert all(math.isclose(by[s].median, np.median([v for _, t, v in rows if t == s])) for s in by) and len(by) == 7


def test_sketches_of_missing_values(spark):
    df = spark.createDataFrame([(2000, "A", float("nan"), None), (2000, "A", 3.0, None), (None, "A", 4.0, None)], "year int, station string, v double, w double")
    table = sketch.quantile_sketches(df, ["v", "w"])
    assert [(r.measure, r.n) for r in table.collect()] == [("v", 1)]
    assert sketch.exact_quantiles(df.where("year = 2000"), table).collect() == [("v", 1, 3.0, 3.0, 3.0)]
    assert sketch.exact_quantiles(df, table.limit(0)).count() == 0


def test_distinct_stations_within_the_error(spark):
    df = spark.range(60_000).selectExpr("cast(2000 + id % 2 AS int) AS year", "concat('S', id div 3) AS station")
    table = sketch.station_sketches(df, lg=10).checkpoint()
    got = sketch.distinct_stations(table, lg=10).first().stations
    assert abs(got / 20_000 - 1) < 0.15
    both = sketch.stations_in_all(table).first().stations
    assert abs(both / 20_000 - 1) < 0.15


# -------------------------------------------------------------- pyramids
def test_window_ranges_cover_the_window():
    rnd = random.Random(2)
    for _ in range(100):
        level = rnd.randrange(8)
        i0, i1 = sorted(rnd.randrange(1 << level) for _ in "ab")
        j0, j1 = sorted(rnd.randrange(1 << level) for _ in "ab")
        wanted = {sum((i >> b & 1) << 2 * b | (j >> b & 1) << 2 * b + 1 for b in range(level)) for i in range(i0, i1 + 1) for j in range(j0, j1 + 1)}
        for most in (4, 32, 4000):
            ranges = pyramid.window_ranges(i0, i1, j0, j1, level, most)
            assert len(ranges) <= most and all(any(a <= c <= b for a, b in ranges) for c in wanted)
            if most == 4000:
                assert sum(b - a + 1 for a, b in ranges) == len(wanted)


@pytest.fixture(scope="module")
def points(spark):
    rnd = random.Random(8)
    rows = [(rnd.uniform(-180, 180), rnd.uniform(-90, 90), rnd.gauss(0, 5) if rnd.random() < 0.9 else None, 2000 + i % 2) for i in range(3000)]
    rows += [(180.0, 90.0, 1.0, 2000), (-180.0, -90.0, 2.0, 2000), (181.0, 0.0, 9.0, 2000), (float("inf"), 0.0, 9.0, 2000), (None, 1.0, 9.0, 2000), (0.0, float("nan"), 9.0, 2001)]
    return spark.createDataFrame(rows, "lon double, lat double, v double, year int")


def test_views_equal_binning(spark, points):
    table = pyramid.build(pyramid.cells(points, "lon", "lat", "v", depth=9, by=["year"]), scratch_path(spark, "pyramid-test"), 9, ["year"])
    pts = [tuple(r) for r in points.collect() if r.lon is not None and -180 <= r.lon <= 180 and -90 <= r.lat <= 90]
    for level, window in ((0, pyramid.WORLD), (3, (-20, 60, -30, 89)), (6, (100, 180, 0, 90)), (9, (-1.5, 2.5, -1, 1)), (9, pyramid.WORLD)):
        n = 1 << level
        want: dict = {}
        for lon, lat, v, _ in pts:
            at = tuple(min(int((c - lo) / (hi - lo) * n), n - 1) for c, lo, hi in ((lon, -180, 180), (lat, -90, 90)))
            ends = [[min(int((c - lo) / (hi - lo) * n), n - 1) for c in pair] for pair, lo, hi in ((window[:2], -180, 180), (window[2:], -90, 90))]
            if all(a <= c <= b for c, (a, b) in zip(at, ends, strict=True)):
                want.setdefault(at, []).append(v)
        got = {(r.x_bin, r.y_bin): r for r in pyramid.view(table, window, level).collect()}
        assert set(got) == set(want)
        for at, vs in want.items():
            real = [v for v in vs if v is not None]
            assert got[at].n == len(vs) and (got[at].low, got[at].high) == (min(real, default=None), max(real, default=None))
            assert (got[at].mean is None) == (not real) and (not real or math.isclose(got[at].mean, sum(real) / len(real), abs_tol=1e-9))
    years = {r.year: r.n for r in pyramid.view(table, pyramid.WORLD, 0, by=["year"]).collect()}
    assert years == {y: sum(p[3] == y for p in pts) for y in (2000, 2001)}


def test_a_view_reads_its_level_and_ranges_only(spark, points):
    path = scratch_path(spark, "pyramid-test")
    table = pyramid.build(pyramid.cells(points, "lon", "lat", "v", depth=9), path, 9)
    plan = pyramid.view(table, (10, 30, 40, 60), 9)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan and "GreaterThanOrEqual(cell" in plan and "LessThanOrEqual(cell" in plan
    # Files are sorted ranges of cells: those of the finest level that can hold a wanted cell are few.
    n = 1 << 9
    at = [int((c - lo) / (hi - lo) * n) for c, lo, hi in ((10, -180, 180), (30, -180, 180), (40, -90, 90), (60, -90, 90))]
    ranges = pyramid.window_ranges(*at, 9)
    files = table.where("level = 9").groupBy(F.input_file_name()).agg(F.min("cell").alias("a"), F.max("cell").alias("b")).collect()
    hit = [f for f in files if any(a <= f.b and f.a <= b for a, b in ranges)]
    assert len(files) < 3 or len(hit) < len(files)


def test_stations_are_reduced_before_they_are_placed(spark, stations):
    days = _days(spark)
    got = pyramid.station_cells(days, stations, depth=3).collect()
    rows = [r for r in days.collect() if r.station in ("A", "B")]
    assert sum(r.n for r in got) == len(rows)
    assert {(r.year, r.cell) for r in got if r.cell is not None} and len({r.cell for r in got}) == 2

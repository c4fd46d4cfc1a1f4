"""Frames the fixtures don't have: constants, huge means, NaN, nulls, missing columns, bad pages, repeated keys."""

from __future__ import annotations

import json
import statistics

import numpy as np
import pandas as pd
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climatrix.operators import bins, feeds, kpi, prepare, report, rollup, sample, select, stats
from climatrix.operators.quantile import exact_quantiles
from climatrix.session import shared_dir
from climatrix.sources import feed, fixtures, sinks
from climatrix.sources import select as src

NAN = float("nan")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def parts(df, stations=None):
    """A2-A7 one by one, as the dashboard names them."""
    return {**one(kpi.kpi_summary(df)), **one(kpi.kpi_distinct(df, stations)), **one(kpi.kpi_trend(df)), **one(kpi.kpi_variability(df)), **one(kpi.kpi_heatwave(df)), **one(kpi.kpi_drought(df))}


FRAMES = {
    "constant": [(y, "a" if i % 3 else "b", 0.1, 31.0, 1.0, 2.0) for y in (1999, 2000) for i in range(30)],
    "huge mean": [(y, f"s{i % 4}", 1e8 + 0.1 * (i % 10), 31.0, 1.0, 2.0) for y in (1999, 2000) for i in range(40)],
    "nan and null": [(2000, "a", NAN, NAN, None, NAN), (2000, None, 3.5, 40.0, 1.0, 2.0), (2001, "b", 4.5, None, NAN, 9.0), (None, "b", 7.0, 1.0, 2.0, None)],
    "one year": [(2000, "a", 1.0, 2.0, 3.0, 4.0), (2000, "a", 2.0, 2.0, 3.0, 4.0)],
}


@pytest.mark.parametrize("name", sorted(FRAMES))
def test_dashboard_equals_single_indicators(spark, name):
    df = spark.createDataFrame(FRAMES[name], "year int, station string, tavg double, tmax double, tmin double, prcp double")
    got, want = one(kpi.kpi_dashboard(df)), parts(df)
    assert set(got) == set(want)
    for k in got:
        assert (got[k] is None and want[k] is None) or got[k] == pytest.approx(want[k], rel=1e-6 if name == "huge mean" else 1e-9, abs=1e-9), k


def test_variability_of_a_huge_mean(spark):
    df = spark.createDataFrame(FRAMES["huge mean"], "year int, station string, tavg double, tmax double, tmin double, prcp double")
    year = [r[2] for r in FRAMES["huge mean"] if r[0] == 2000]
    assert one(kpi.kpi_dashboard(df))["variability"] == pytest.approx(statistics.stdev(year), rel=1e-6)


def test_dashboard_without_stations_or_measures(spark):
    df = spark.createDataFrame([(2000, 1.0), (2001, 2.0)], "year int, tavg double")
    got = one(kpi.kpi_dashboard(df))
    assert (got["stations"], got["years"], got["rows"], got["tmax_max"]) == (0, 2, 2, 0.0)
    assert got["trend_decade"] == pytest.approx(10.0)
    assert one(kpi.kpi_dashboard(df, stations=fixtures.stations(spark, SF_SMALL)))["stations"] == 0


def test_nan_is_missing_in_rollups_and_reports(spark):
    df = spark.createDataFrame([(2000, 1, "a", NAN, 1.0), (2000, 1, "a", 3.0, NAN)], "year int, month int, station string, tavg double, prcp double")
    df = df.withColumns({"tmax": F.col("tavg"), "tmin": F.col("tavg")})
    assert one(rollup.yearly_temperature(df))["tavg_mean"] == 3.0
    assert one(rollup.monthly_precipitation(df))["prcp_sum"] == 1.0
    assert one(report.report_yearly(df))["temp_mean"] == 3.0
    assert one(report.report_station(df))["prcp_sum"] == 1.0
    assert one(kpi.kpi_heatwave(df.withColumn("tmax", F.lit(NAN))))["heatwave_pct"] == 0.0


def test_prepare_feed_derives_tavg_only_without_any_record(spark):
    rows = [("2020-01-01T00:00:00", c, "s", "", v) for c, v in (("TMAX", 200.0), ("TMIN", 100.0))]
    obs = spark.createDataFrame(rows, "date string, datatype string, station string, attributes string, value double")
    assert one(prepare.prepare_feed(obs))["tavg"] == 15.0
    more = obs.unionByName(spark.createDataFrame([("2020-01-02T00:00:00", "TAVG", "s", "", 70.0)], obs.schema))
    got = {r["date"].day: r["tavg"] for r in prepare.prepare_feed(more).collect()}
    assert got == {1: None, 2: 7.0}
    stations = spark.createDataFrame([("s", "EUROPE", 1.5)], "station string, continent string, lat double")
    full = one(prepare.prepare_feed(obs, stations=stations, warming=True))
    assert (full["continent"], round(full["tavg_trend"], 6)) == ("EUROPE", 15.2)


def test_numeric_text(spark):
    text = ["12", " -1.5 ", "1e3", ".5", "5.", "12d", "5F", "NaN", "", "abc", "0x10", "inf", None]
    got = [r["v"] for r in prepare.coerce_numeric(spark.createDataFrame([(x,) for x in text], "v string"), ["v"]).collect()]
    want = [12.0, -1.5, 1000.0, 0.5, 5.0, None, None, None, None, None, None, float("inf"), None]
    assert got == want


def test_bad_pages_are_reported(spark, tmp_path):
    good = {"results": [{"date": "2020-01-01T00:00:00", "datatype": "TMAX", "station": "s", "attributes": "", "value": 1.0}]}
    wrong = {"results": [{**good["results"][0], "value": "12.5"}]}
    lines = [json.dumps(good), json.dumps(good)[:40], json.dumps(wrong)]
    (tmp_path / "pages.json").write_text("\n".join(lines) + "\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        feed.unnest_results(spark, str(tmp_path), multi_line=False).collect()
    assert feed.read_feed(spark, str(tmp_path), multi_line=False, mode="DROPMALFORMED").count() == 1
    assert sorted(r["page"] for r in feed.bad_pages(spark, str(tmp_path), multi_line=False).collect()) == sorted(lines[1:])


def test_dataset_needs_its_column(spark):
    obs = fixtures.observations_from_measures(spark, SF_SMALL)
    with pytest.raises(ValueError, match="dataset"):
        src.select_observations(obs, "1995-01-01", "2001-12-31", dataset="MONTHLY")


def test_sample_fraction_near_one(spark):
    df = spark.range(100_000).withColumnRenamed("id", "k")
    assert sample.sample_fraction(df, 1 - 1e-11, key="k").count() == 100_000
    assert sample.sample_fraction(df, 0.0, key="k").count() == 0
    assert abs(sample.sample_fraction(df, 0.25, key="k").count() - 25_000) < 700


@pytest.mark.parametrize("n", [1, 99, 100, 2_500, 5_000, 5_999, 6_000, 9_000])
def test_sample_n_with_repeated_and_null_keys(spark, n):
    rows = [(None if i < 500 else i % 7, i % 3000) for i in range(6_000)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = sample.sample_n(df, n, "k")
    assert got.count() == min(n, 6_000)
    again = sample.sample_n(df.repartition(7), n, "k")
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def test_sample_n_of_identical_rows(spark):
    df = spark.createDataFrame([(1, "x")] * 50 + [(2, "y")] * 3, "k long, v string")
    assert [sample.sample_n(df, n, "k").count() for n in (1, 20, 51, 53)] == [1, 20, 51, 53]


def test_feeds_are_complete_by_default(spark):
    m = fixtures.measures(spark, SF_SMALL)
    n = m.count()
    assert feeds.parallel_coordinates(m).count() == n
    assert feeds.scatter_3d(m, stations=fixtures.stations(spark, SF_SMALL)).count() == n
    assert feeds.scatter_sample(m).count() == n
    assert feeds.parallel_coordinates(m, n=10).count() == 10
    assert bins.grid_series(m.limit(5)).columns == ["x_bin", "y_bin", "n"]
    assert bins.series_points(m.limit(5)).columns == ["date", "tavg"]


@pytest.mark.parametrize("digits", [1, 2])
def test_histogram_of_rounded_values(spark, digits):
    values = np.round(np.random.default_rng(digits).normal(12, 9, 4_000), digits)
    df = spark.createDataFrame([(float(x),) for x in values], "tavg double")
    got = sorted((r["bin"], r["n"], r["lo"]) for r in bins.histogram(df, "tavg", 100).collect())
    want, edges = np.histogram(values, 100)
    assert [g[1] for g in got] == want.tolist() and [g[2] for g in got] == edges[:-1].tolist()


def test_histogram_with_many_bins(spark):
    df = spark.range(1_000).selectExpr("CAST(id AS DOUBLE) AS tavg")
    assert bins.histogram(df, "tavg", 200_000).agg(F.count("bin"), F.sum("n")).first()[:] == (200_000, 1_000)


def test_correlation_of_epoch_scale_columns(spark):
    rows = [(1.6e15 + i, float(i), 7.0, 1e-12 * (i % 5)) for i in range(200)]
    got = {(r.a, r.b): r.r for r in stats.correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double, d double")).collect()}
    want = pd.DataFrame(rows, columns=list("abcd")).corr()
    assert got["a", "b"] == pytest.approx(1.0) and got["c", "a"] is None and got["c", "c"] is None
    assert got["b", "d"] == pytest.approx(want.loc["b", "d"], abs=1e-9)


def test_quantiles_of_odd_values(spark):
    for values in ([5.0], [1.0, 1.0, 2.0], [-1.7e308, 0.0, 1.7e308], [5e-324, 1e-323, 0.0], list(np.random.default_rng(0).normal(size=999)), [0.1] * 40 + [0.3] * 2, [float("-inf"), 1.0, 2.0, float("inf")]):
        rows = [("g", float(v)) for v in values] + [("g", NAN), ("g", None), (None, 1.0)]
        df = spark.createDataFrame(rows, "g string, v double")
        probs = [0.0, 0.25, 0.5, 1.0]
        got = one(exact_quantiles(df, "v", probs, ["g"], ["a", "b", "c", "d"]))
        assert got["n"] == len(values)
        if np.isfinite(values).all() and max(map(abs, values)) < 1e300:
            assert [got[k] for k in "abcd"] == pytest.approx([float(np.quantile(values, p)) for p in probs], rel=1e-12, abs=0)


def test_describe_covers_every_numeric_column(spark):
    m = fixtures.measures(spark, SF_SMALL)
    got = {r["column"] for r in stats.describe(m.select("obs_id", "year", "tavg", "prcp")).collect()}
    assert got == {"year", "tavg", "prcp"}


def test_year_filters_prune(spark, tmp_path):
    m = fixtures.measures(spark, SF_SMALL)
    path = sinks.sink_parquet(m.select("obs_id", "date", "year", "tavg"), str(tmp_path / "t"))
    t = sinks.read_parquet(spark, path)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    for df in (select.filter_year_range(t, 1996, 1997), select.filter_year_set(t, [1996, 1998]), select.filter_single_year(t, 1997), select.filter_single_year(t)):
        assert "PartitionFilters: [isnotnull(year" in plan(df) and "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date" in plan(df)
    assert "GreaterThanOrEqual(l_shipdate" in plan(select.filter_year_set(m, [1996, 1998]))
    with pytest.raises(Exception, match="already exists"):
        sinks.sink_parquet(m.select("obs_id", "year"), path)


def test_columns_by_type(spark):
    df = spark.createDataFrame([(1, "x", None)], "a int, b string, c timestamp_ntz")
    assert [tuple(r) for r in prepare.columns_by_type(df).collect()] == [("a", "number"), ("b", "text"), ("c", "time")]


def test_time_columns_stay_typed(spark):
    m = fixtures.measures(spark, SF_SMALL)
    assert isinstance(rollup.resample_mean(m).schema["period"].dataType, T.TimestampNTZType)
    span = rollup.date_span(m).schema
    assert isinstance(span["first_date"].dataType, T.TimestampNTZType)
    text = spark.createDataFrame([("2020-01-01 00:00:00",)], "date string")
    assert isinstance(prepare.parse_dates(text).schema["date"].dataType, T.TimestampNTZType)


def test_shared_folder_is_needed_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())

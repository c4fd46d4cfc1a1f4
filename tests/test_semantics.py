"""Small in-memory frames for the rules where pandas and Spark differ
cases are built here."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from climatrix.operators import bins, kpi, prepare, profile, rollup, stats


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_pivot_drops_null_keys_and_all_null_rows(spark):
    # (k, dt, v): (1,A,1) (1,B,2) (2,A,null) (3,A,5) (null,A,7) (4,C,null)
    df = spark.createDataFrame(
        [(1, "A", 1.0), (1, "B", 2.0), (2, "A", None), (3, "A", 5.0), (None, "A", 7.0), (4, "C", None)],
        "k int, datatype string, value double",
    )
    out = prepare.pivot_observations(df, codes=["A", "B", "C"], keys=["k"])
    got = {r["k"]: (r["A"], r["B"], r["C"]) for r in rows(out)}
    assert got == {1: (1.0, 2.0, None), 3: (5.0, None, None)}


def test_sum_of_all_null_group_is_zero(spark):
    df = spark.createDataFrame(
        [(1, 1, 1.0), (1, 1, 2.0), (2, 1, None), (3, 1, 5.0), (None, 1, 7.0), (4, 1, None)],
        "year int, month int, prcp double",
    )
    got = {r["year"]: r["prcp_sum"] for r in rows(rollup.monthly_precipitation(df))}
    assert got == {1: 3.0, 2: 0.0, 3: 5.0, 4: 0.0}


def test_pairwise_correlation_and_constant_column(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 1.0), (2.0, 1.0, 1.0), (3.0, None, 1.0), (None, 4.0, 1.0), (5.0, 7.0, 1.0)],
        "a double, b double, c double",
    )
    got = {(r["a"], r["b"]): r["r"] for r in rows(stats.correlation_matrix(df, ["a", "b", "c"]))}
    assert got[("a", "b")] == pytest.approx(0.921550640565428, abs=1e-12)
    assert got[("b", "a")] == got[("a", "b")]
    assert got[("a", "c")] is None and got[("c", "c")] is None
    assert got[("a", "a")] == 1.0
    assert len(got) == 9


def test_correlation_matches_pandas(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    y = 0.3 * x + rng.normal(size=500)
    z = rng.normal(size=500) * 1e3 + 5e6  # large offset: centring matters
    data = [(float(a), None if i % 7 == 0 else float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, z))]
    df = spark.createDataFrame(data, "x double, y double, z double")
    got = {(r["a"], r["b"]): r["r"] for r in rows(stats.correlation_matrix(df))}
    import pandas as pd

    ref = pd.DataFrame(data, columns=["x", "y", "z"]).corr()
    for a in "xyz":
        for b in "xyz":
            assert got[(a, b)] == pytest.approx(ref.loc[a, b], abs=1e-10)


def test_min_max_scaling_constant_gives_null_and_one_bin(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "tavg double")
    h = sorted(rows(bins.histogram(df, "tavg", 10)), key=lambda r: r["bin"])
    assert sum(r["n"] for r in h) == 2 and [r["n"] for r in h if r["n"]] == [2]
    assert [r["bin"] for r in h if r["n"]] == [5] and (h[0]["lo"], h[9]["hi"]) == (2.5, 3.5)
    prof = profile.reference_profile(df.withColumn("year", F.lit(2000)))
    assert all(r["normalised"] is None for r in rows(prof))


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "tavg double")
    d = rows(stats.describe(df, ["tavg"]))[0]
    assert d["mean"] == 1.5 and d["count"] == 2


def test_lenient_parse_and_numeric_coercion(spark):
    df = spark.createDataFrame([("2020-01-01", "1.5"), ("zz", "x")], "date string, v string")
    got = rows(prepare.coerce_numeric(prepare.parse_dates(df, "date", strict=False), ["v"]))
    assert got[0]["date"] == dt.datetime(2020, 1, 1) and got[0]["v"] == 1.5
    assert got[1]["date"] is None and got[1]["v"] is None


def test_one_year_and_empty_input(spark):
    one = spark.createDataFrame([(2000, "S1", 1.0), (2000, "S1", 3.0)], "year int, station string, tavg double")
    assert rows(kpi.kpi_trend(one)) == [{"trend_century": 0.0, "trend_decade": 0.0}]
    assert rows(kpi.kpi_variability(one)) == [{"variability": 0.0}]
    empty = one.limit(0)
    for fn in (kpi.kpi_summary, kpi.kpi_trend, kpi.kpi_variability, kpi.kpi_heatwave, kpi.kpi_dashboard):
        assert rows(fn(empty)) == []


def test_dashboard_absent_columns_take_defaults(spark):
    df = spark.createDataFrame([(2000, "S1", 1.0), (2001, "S2", 3.0)], "year int, station string, tavg double")
    r = rows(kpi.kpi_dashboard(df))[0]
    assert r["humidity_mean"] == 65.0 and r["continents"] == 1 and r["prcp_total"] == 0.0
    assert r["trend_century"] == pytest.approx(200.0)


@pytest.mark.parametrize("freq", ["D", "W", "M", "Q", "Y"])
def test_resample_keeps_gaps_and_matches_pandas(spark, freq):
    import pandas as pd

    days = [dt.datetime(2020, 1, 1) + dt.timedelta(days=i) for i in range(0, 400, 3)]
    days = [d for d in days if not (dt.datetime(2020, 3, 1) <= d < dt.datetime(2020, 5, 1))]  # hole
    vals = [float(i % 11) for i in range(len(days))]
    df = spark.createDataFrame(list(zip(days, vals)), "date timestamp_ntz, tavg double")
    got = [(r["period"], r["tavg_mean"]) for r in rollup.resample_mean(df, freq).collect()]
    rule = {"D": "D", "W": "W", "M": "ME", "Q": "QE", "Y": "YE"}[freq]
    ref = pd.Series(vals, index=pd.DatetimeIndex(days)).resample(rule).mean()
    assert [p for p, _ in got] == [t.to_pydatetime() for t in ref.index]
    for (_, a), b in zip(got, ref.values):
        assert (a is None and math.isnan(b)) or a == pytest.approx(b)
    if freq == "M":
        assert any(v is None for _, v in got)


def test_iso_week_and_day_of_year(spark):
    days = []
    for y in range(1999, 2028):
        days += [dt.datetime(y, 12, 31), dt.datetime(y, 1, 1), dt.datetime(y, 12, 28)]
    df = spark.createDataFrame([(d,) for d in days], "date timestamp_ntz")
    for r in prepare.calendar_parts(df).collect():
        d = r["date"]
        assert r["week"] == d.isocalendar()[1]
        assert r["day_of_year"] == d.timetuple().tm_yday


def test_derive_tavg_and_missing_columns(spark):
    df = spark.createDataFrame([(10.0, 2.0)], "tmax double, tmin double")
    assert rows(prepare.derive_tavg(df))[0]["tavg"] == 6.0
    with pytest.raises(ValueError, match="tmin"):
        prepare.derive_tavg(df.drop("tmin"))


def _skewed(spark, n=3000):
    rng = np.random.default_rng(7)
    hot = [("h", 1.25)] * n  # a third of all rows: one hot value in one group
    spread = [("h", float(v)) for v in rng.normal(size=n)] + [("c", float(v)) for v in rng.exponential(size=n)]
    return spark.createDataFrame(hot + spread, "g string, v double"), hot + spread


def test_exact_quantiles_match_numpy(spark):
    from climatrix.operators.quantile import exact_quantiles

    df, data = _skewed(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["g"]: r for r in exact_quantiles(df, "v", probs, by=["g"]).collect()}
    for g in ("h", "c"):
        vals = np.array([v for k, v in data if k == g])
        assert got[g]["n"] == len(vals)
        for p in probs:
            name = f"q{int(round(p * 100)):02d}"
            assert got[g][name] == pytest.approx(float(np.quantile(vals, p)), abs=1e-12)


def test_box_stats_whiskers_and_outliers(spark):
    df, data = _skewed(spark)
    got = {r["g"]: r for r in bins.box_stats(df, "v", ["g"]).collect()}
    vals = np.array([v for k, v in data if k == "c"])
    q1, q3 = np.quantile(vals, [0.25, 0.75])
    lf, uf = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert got["c"]["outliers"] == int(((vals < lf) | (vals > uf)).sum())
    assert got["c"]["whisker_high"] == pytest.approx(vals[vals <= uf].max())
    assert got["c"]["whisker_low"] == pytest.approx(vals[vals >= lf].min())


def test_profile_values_in_unit_interval(spark):
    from conftest import SF_SMALL

    from climatrix.sources import fixtures

    m = fixtures.measures(spark, SF_SMALL)
    for r in profile.compare_years(m, [1996, 1999]).collect():
        assert 0.0 <= r["normalised"] <= 1.0


def test_describe_match_pandas(spark):
    import pandas as pd

    df, data = _skewed(spark)
    d = rows(stats.describe(df, ["v"]))[0]
    ref = pd.Series([v for _, v in data]).describe()
    for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                         ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
        assert d[ours] == pytest.approx(ref[theirs], abs=1e-9), ours


def test_options_dataset_approx_and_bins(spark):
    from climatrix.sources.select import select_observations

    obs = spark.createDataFrame(
        [(dt.datetime(2020, 1, 1), "TMAX", "S1", None, 1.0, "daily"), (dt.datetime(2020, 1, 1), "TMAX", "S1", None, 2.0, "monthly")],
        "date timestamp_ntz, datatype string, station string, attributes string, value double, dataset string",
    )
    assert select_observations(obs, "2020-01-01", "2020-01-01", dataset="daily").count() == 1
    df = spark.createDataFrame([(2000, "S1"), (2001, "S2"), (2001, "S2")], "year int, station string")
    assert rows(kpi.kpi_distinct(df, approx=True)) == [{"years": 2, "stations": 2, "continents": 1}]
    with pytest.raises(ValueError):
        bins.histogram(df.selectExpr("cast(year as double) as tavg"), "tavg", 0)


def test_month_year_matrix_auto_years(spark):
    df = spark.createDataFrame(
        [(1, 2000, 1.0), (1, 2000, 3.0), (2, 2001, 5.0)], "month int, year int, tavg double"
    )
    wide = rollup.month_year_matrix(df, years="auto")
    assert wide.columns == ["month", "2000", "2001"]
    got = {r["month"]: (r["2000"], r["2001"]) for r in wide.collect()}
    assert got == {1: (2.0, None), 2: (None, 5.0)}


def test_grid_forms_differ_only_in_extent(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0, 1.0), (10.0, 10.0, 3.0), (20.0, 20.0, None)], "lon double, lat double, tavg double"
    )
    spatial = {(r["x_bin"], r["y_bin"]): r["tavg_mean"] for r in bins.grid_mean(df, width=2, height=2).collect()}
    mapview = {(r["x_bin"], r["y_bin"]): r["tavg_mean"] for r in bins.grid_map(df).collect()}
    assert spatial == {(0, 0): 1.0, (1, 1): 3.0}  # extent 0..10
    assert mapview == {(0, 0): 1.0, (400, 300): 3.0}  # extent 0..20 on 800 x 600


def test_ungrouped_quantiles(spark):
    from climatrix.operators.quantile import exact_quantiles

    df, data = _skewed(spark)
    vals = np.array([v for _, v in data])
    got = exact_quantiles(df, "v", [0.05, 0.5, 0.95]).collect()
    assert len(got) == 1 and got[0]["n"] == len(vals) and "_all" not in got[0].asDict()
    for p, name in ((0.05, "q05"), (0.5, "q50"), (0.95, "q95")):
        assert got[0][name] == pytest.approx(float(np.quantile(vals, p)), abs=1e-12)


def test_resample_lenient_text_input_matches_pandas(spark):
    import pandas as pd

    rows_in = [
        ("2021-01-03", "1.5"), ("2021-01-20", "x"), ("not a date", "4.0"), ("2021-03-02", "2.5"),
        ("2021-03-30 12:00:00", "3.5"), (None, "9.0"), ("2021-05-01", None),
    ]
    df = spark.createDataFrame(rows_in, "date string, tavg string")
    got = [(r["period"], r["tavg_mean"]) for r in rollup.resample_mean(df, "M").collect()]
    pdf = pd.DataFrame(rows_in, columns=["date", "tavg"])
    pdf["datetime"] = pd.to_datetime(pdf["date"], errors="coerce", format="mixed")
    pdf["tavg"] = pd.to_numeric(pdf["tavg"], errors="coerce")
    ref = pdf.dropna(subset=["datetime", "tavg"]).set_index("datetime")["tavg"].resample("ME").mean()
    assert [p for p, _ in got] == [t.to_pydatetime() for t in ref.index]
    for (_, a), b in zip(got, ref.values):
        assert (a is None and math.isnan(b)) or a == pytest.approx(b)


def test_threshold_shares_keep_nulls_in_denominator_and_defaults(spark):
    df = spark.createDataFrame([(31.0, 1.0), (None, None), (10.0, 7.0)], "tmax double, prcp double")
    assert rows(kpi.kpi_heatwave(df))[0]["heatwave_pct"] == pytest.approx(100 / 3)
    assert rows(kpi.kpi_drought(df))[0]["drought_pct"] == pytest.approx(100 / 3)
    s = rows(kpi.kpi_summary(df))[0]
    assert s["humidity_mean"] == 65.0 and s["tavg_mean"] == 0.0 and s["rows"] == 3


def test_numeric_columns_excludes_timestamps(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2020, 1, 1), "1.5", "abc", 3)], "ts timestamp_ntz, t1 string, t2 string, n int"
    )
    got = {r["column"]: (r["kind"], r["n_parsable"]) for r in prepare.numeric_columns(df).collect()}
    assert got == {"n": ("numeric", 1), "t1": ("text", 1)}


def test_profile_shown_divisors(spark):
    df = spark.createDataFrame(
        [(2000, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (2001, 10.0, 10.0, 10.0, 10.0, 10.0, 10.0)],
        "year int, tavg double, tmax double, tmin double, prcp double, humidity double, wind_speed double",
    )
    got = {r["measure"]: (r["normalised"], r["shown"]) for r in profile.year_profile(df).collect()}
    assert got["tavg"] == (1.0, 1.0)
    assert got["prcp"] == (1.0, 0.01) and got["humidity"] == (1.0, 0.01) and got["wind_speed"] == (1.0, 0.05)


def test_linear_trend_and_line_match_polyfit(spark):
    from conftest import SF_SMALL

    from climatrix.sources import fixtures

    m = fixtures.measures(spark, SF_SMALL)
    yearly = m.groupBy("year").agg(F.avg("tavg").alias("t")).toPandas().sort_values("year")
    slope, intercept = np.polyfit(yearly["year"], yearly["t"], 1)
    r = np.corrcoef(yearly["year"], yearly["t"])[0, 1]
    fit = rows(stats.linear_trend(m))[0]
    assert fit["slope"] == pytest.approx(slope, rel=1e-9)
    assert fit["intercept"] == pytest.approx(intercept, rel=1e-9)
    assert fit["r"] == pytest.approx(r, rel=1e-9) and fit["r2"] == pytest.approx(r * r, rel=1e-9)
    line = {x["year"]: x["fitted"] for x in stats.trend_line(m).collect()}
    poly = np.poly1d([slope, intercept])
    for y in yearly["year"]:
        assert line[int(y)] == pytest.approx(poly(y), rel=1e-9)


def test_histogram_matches_numpy_on_continuous_data(spark):
    vals = np.random.default_rng(3).normal(size=2000)
    df = spark.createDataFrame([(float(v),) for v in vals], "tavg double")
    got = [r["n"] for r in bins.histogram(df, "tavg", 25).orderBy("bin").collect()]
    want, edges = np.histogram(vals, bins=25, range=(vals.min(), vals.max()))
    assert got == list(want)
    lo = [r["lo"] for r in bins.histogram(df, "tavg", 25).orderBy("bin").collect()]
    assert lo == pytest.approx(list(edges[:-1]))


def test_approx_describe_is_close_to_exact(spark):
    vals = np.random.default_rng(5).normal(size=3000)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    exact = rows(stats.describe(df, ["v"]))[0]
    approx = rows(stats.describe(df, ["v"], method="approx"))[0]
    assert approx["count"] == exact["count"] == 3000
    for c in ("mean", "std", "min", "max"):
        assert approx[c] == pytest.approx(exact[c], rel=1e-9)
    for c in ("p25", "p50", "p75"):
        assert abs(approx[c] - exact[c]) < 0.02

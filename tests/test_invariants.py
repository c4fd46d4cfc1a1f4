"""Invariants and plan checks on the driver's tables."""

from __future__ import annotations

import hashlib

import pytest

from conftest import SF_SMALL
from pyspark.sql import functions as F

from climatrix.operators import bins, feeds, sample, select, stats
from climatrix.sources import fixtures


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


def test_histogram_and_grids_count_every_row(spark):
    m = fixtures.measures(spark, SF_SMALL)
    n = m.count()
    assert bins.histogram(m, "tavg", 100).agg(F.sum("n")).first()[0] == n
    assert bins.density_2d(m, "tavg", "humidity", 20, 20).agg(F.sum("n")).first()[0] == n
    assert bins.grid_xy(m, "tavg", "prcp", None).agg(F.sum("n")).first()[0] == n


def test_grid_mean_eager_aggregation_equals_row_level(spark):
    m = fixtures.measures(spark, SF_SMALL)
    st = fixtures.stations(spark, SF_SMALL)
    eager = {(r["x_bin"], r["y_bin"]): r["tavg_mean"] for r in bins.grid_mean(m, stations=st).collect()}
    direct = {(r["x_bin"], r["y_bin"]): r["tavg_mean"] for r in bins.grid_mean(fixtures.station_day(spark, SF_SMALL)).collect()}
    assert eager.keys() == direct.keys()
    assert all(abs(eager[k] - direct[k]) < 1e-9 for k in eager)


def test_sample_n_is_exact_subset_and_matches_brute_force(spark):
    orders = fixtures.table(spark, SF_SMALL, "orders")
    keys = [r[0] for r in orders.select("o_orderkey").collect()]
    s = sample.sample_n(orders, 300, "o_orderkey", seed=42)
    got = sorted(r[0] for r in s.select("o_orderkey").collect())
    want = sorted(sorted(keys, key=lambda k: (hashlib.md5(f"{k}:42".encode()).hexdigest(), k))[:300])
    assert got == want
    assert sample.sample_n(orders, 10**9, "o_orderkey").count() == len(keys)


def test_correlation_symmetric_with_unit_diagonal(spark):
    m = fixtures.measures(spark, SF_SMALL)
    r = {(x["a"], x["b"]): x["r"] for x in stats.correlation_matrix(m, ["tavg", "prcp", "humidity"]).collect()}
    for (a, b), v in r.items():
        assert r[(b, a)] == v
        if a == b:
            assert v == 1.0


def test_year_range_is_pushed_to_parquet(spark):
    m = fixtures.measures(spark, SF_SMALL)
    plan = plan_text(select.filter_year_range(m, 1996, 1998))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "LessThan(l_shipdate" in plan


def test_projection_reads_only_used_columns(spark):
    m = fixtures.measures(spark, SF_SMALL)
    plan = plan_text(m.groupBy("year").agg(F.avg("tavg")))
    assert "ReadSchema: struct<l_quantity:double,l_discount:double,l_shipdate:timestamp_ntz>" in plan


def test_no_row_at_a_time_python_in_plans(spark):
    from climatrix.plans.catalog import REGISTRY

    for name in ("kpi_dashboard", "grid_mean", "describe", "resample_mean", "continent_year"):
        plan = plan_text(REGISTRY[name](spark, SF_SMALL))
        assert "BatchEvalPython" not in plan and "PythonUDF" not in plan, name


def test_chart_feeds_respect_caps(spark):
    m = fixtures.measures(spark, SF_SMALL)
    assert feeds.parallel_coordinates(m, None, 50).count() == 50
    assert feeds.parallel_coordinates(m, [1996]).count() == m.filter("year = 1996").count()
    assert feeds.log_axis(m).filter("log10_prcp is null").count() == 0


def test_streaming_landing_is_exactly_once_and_incremental(spark):
    from climatrix.session import scratch_path
    from climatrix.sources.feed import write_feed_pages
    from climatrix.streaming import land_observations

    obs = fixtures.observations_from_events(spark, SF_SMALL)
    landing, table, ckpt = (scratch_path(spark, n) for n in ("landing", "table", "ckpt"))
    first = obs.filter("event_id < 100")
    write_feed_pages(first, f"{landing}/batch1", "event_id")
    land_observations(spark, f"{landing}/*", table, ckpt, multi_line=False).awaitTermination()
    assert spark.read.parquet(table).count() == first.count()
    # Re-running with the same checkpoint lands nothing twice.
    land_observations(spark, f"{landing}/*", table, ckpt, multi_line=False).awaitTermination()
    assert spark.read.parquet(table).count() == first.count()
    # New pages are picked up incrementally.
    write_feed_pages(obs.filter("event_id >= 100"), f"{landing}/batch2", "event_id")
    land_observations(spark, f"{landing}/*", table, ckpt, multi_line=False).awaitTermination()
    landed = spark.read.parquet(table)
    assert landed.count() == obs.count()
    scaled = landed.filter("datatype = 'TMAX'").agg(F.sum("value")).first()[0]
    raw = obs.filter("datatype = 'TMAX'").agg(F.sum("value")).first()[0]
    assert abs(scaled * 10 - raw) < 1e-6


def test_feed_pages_multiline_and_missing_results(spark):
    import json
    import os

    from climatrix.session import scratch_path
    from climatrix.sources.feed import unnest_results

    from urllib.parse import urlparse

    folder = scratch_path(spark, "api-pages")
    local = urlparse(folder).path  # the shared folder is a local file: URI in tests
    os.makedirs(local)
    page = {
        "metadata": {"resultset": {"count": 2}},
        "results": [
            {"date": "2020-01-01T00:00:00", "datatype": "TMAX", "station": "GHCND:X", "attributes": ",,S,", "value": 125},
            {"date": "2020-01-02T00:00:00", "datatype": "PRCP", "station": "GHCND:X", "attributes": ",,S,", "value": 3},
        ],
    }
    with open(f"{local}/page1.json", "w") as fh:
        json.dump(page, fh, indent=2)  # one pretty-printed document per file
    with open(f"{local}/page2.json", "w") as fh:
        json.dump({"metadata": {}}, fh, indent=2)  # no results -> no rows
    got = unnest_results(spark, folder, multi_line=True)
    assert [f.dataType.simpleString() for f in got.schema.fields] == [
        "timestamp_ntz", "string", "string", "string", "double"
    ]
    rows = sorted(got.collect(), key=lambda r: r["date"])
    assert len(rows) == 2 and rows[0]["value"] == 125.0 and rows[1]["datatype"] == "PRCP"


def _same(a, b, tol=1e-9):
    def norm(df):
        out = []
        for r in df.collect():
            out.append(tuple(round(v, 6) if isinstance(v, float) else v for v in r))
        return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))

    ra, rb = norm(a), norm(b)
    assert len(ra) == len(rb)
    for x, y in zip(ra, rb):
        for u, v in zip(x, y):
            assert (u == v) or (isinstance(u, float) and abs(u - v) <= 1e-6), (x, y)


def test_eager_aggregation_equals_row_level_join(spark):
    from climatrix.operators import kpi, rollup

    m = fixtures.measures(spark, SF_SMALL)
    st = fixtures.stations(spark, SF_SMALL)
    sd = fixtures.station_day(spark, SF_SMALL)
    _same(rollup.continent_year(m, st), rollup.continent_year(sd))
    _same(rollup.stacked_totals(m, stations=st), rollup.stacked_totals(sd))
    _same(feeds.frames(m, stations=st), feeds.frames(sd))
    _same(bins.violin_density(m, stations=st), bins.violin_density(sd))
    _same(select.distinct_sorted(m, "continent", st), select.distinct_sorted(sd, "continent"))
    _same(kpi.kpi_distinct(m, st), kpi.kpi_distinct(sd))
    _same(kpi.kpi_dashboard(m, st), kpi.kpi_dashboard(sd))
    _same(select.filter_continent(m, "ASIA", st).select("obs_id", "continent"),
          select.filter_continent(sd, "ASIA").select("obs_id", "continent"))


def test_results_do_not_depend_on_session_time_zone(spark):
    from climatrix.plans.catalog import REGISTRY

    names = ["calendar_parts", "resample_mean_w", "date_span", "grid_series", "unnest_results", "parse_dates"]
    before = {n: sorted(map(tuple, REGISTRY[n](spark, SF_SMALL).collect())) for n in names}
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        after = {n: sorted(map(tuple, REGISTRY[n](spark, SF_SMALL).collect())) for n in names}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    for n in names:
        assert before[n] == after[n], n


def test_sample_n_matches_brute_force(spark):
    orders = fixtures.table(spark, SF_SMALL, "orders")
    keys = [r[0] for r in orders.select("o_orderkey").collect()]
    order = sorted(keys, key=lambda k: (hashlib.md5(f"{k}:7".encode()).hexdigest(), k))
    for n in (1, 777, len(keys) - 1):
        got = sorted(r[0] for r in sample.sample_n(orders, n, "o_orderkey", seed=7).select("o_orderkey").collect())
        assert got == sorted(order[:n]), n


def test_salted_station_join_returns_the_same_rows(spark):
    from climatrix.operators.prepare import attach_station_attributes

    m = fixtures.measures(spark, SF_SMALL)
    st = fixtures.stations(spark, SF_SMALL)
    plain = attach_station_attributes(m, st).select("obs_id", "continent", "lat")
    salted = attach_station_attributes(m, st, salt_buckets=8).select("obs_id", "continent", "lat")
    assert sorted(plain.collect()) == sorted(salted.collect())
    assert salted.count() == m.count()


def test_hot_station_holding_a_third_of_rows(spark):
    """One station holds a third of all rows: per-station pre-aggregation and
    the rollup still give the row-level answers (checked with pandas)."""
    from climatrix.operators import kpi, rollup

    m = fixtures.measures(spark, SF_SMALL)
    st = fixtures.stations(spark, SF_SMALL)
    n = m.count()
    hot = m.limit(n // 2).withColumns({"station": F.lit("ST0001"), "station_key": F.lit(1).cast("bigint")})
    skewed = m.unionByName(hot)  # 1.5 n rows, a third of them on ST0001
    dash = kpi.kpi_dashboard(skewed, st).first()
    pdf = skewed.select("year", "station", "tavg", "prcp", "tmax").toPandas()
    assert dash["rows"] == len(pdf)
    assert dash["tavg_mean"] == pytest.approx(pdf["tavg"].mean())
    assert dash["prcp_total"] == pytest.approx(pdf["prcp"].sum())
    assert dash["heatwave_pct"] == pytest.approx((pdf["tmax"] > 30).mean() * 100)
    assert dash["stations"] == pdf["station"].nunique()
    yearly = pdf.groupby("year")["tavg"]
    assert dash["variability"] == pytest.approx(yearly.std().mean())
    import numpy as np

    ym = yearly.mean().reset_index()
    assert dash["trend_century"] == pytest.approx(np.polyfit(ym["year"], ym["tavg"], 1)[0] * 100)
    cy = {(r["year"], r["continent"]): r["tavg_mean"] for r in rollup.continent_year(skewed, st).collect()}
    joined = skewed.join(st.select("station_key", "continent"), "station_key").select("year", "continent", "tavg").toPandas()
    want = joined.groupby(["year", "continent"])["tavg"].mean()
    assert len(cy) == len(want)
    for (y, c), v in want.items():
        assert cy[(y, c)] == pytest.approx(v)

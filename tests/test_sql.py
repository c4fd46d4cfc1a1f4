"""Table functions of ``spark.sql``: equal to the operators, planned with the query around them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from climatrix.operators import kpi, rollup, select
from climatrix.session import scratch_path
from climatrix.sql import FUNCTIONS, register_functions


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(y, m, 15, f"S{s}", f"{y}-{m:02}-15", t, t and t + 5, t and t - 5, 3.0 * m) for y in (2000, 2001, 2002) for m in (1, 4, 8) for s, t in ((1, 20.0 + m), (2, -3.0), (3, None), (9, 31.0))]
    days = spark.createDataFrame(rows, "year int, month int, day int, station string, d string, tavg double, tmax double, tmin double, prcp double").withColumn("date", F.col("d").cast("timestamp_ntz")).drop("d")
    path = scratch_path(spark, "sql-days")
    days.write.parquet(path)
    stations = spark.createDataFrame([("S1", "Asia", 1.0, 2.0), ("S2", "Europe", 3.0, 4.0), ("S3", "Asia", 5.0, 6.0)], "station string, continent string, lat double, lon double")
    days = spark.read.parquet(path)
    assert register_functions(spark, days, stations, "t_") == [f"t_{name}" for name in FUNCTIONS]
    return days, stations


def _same(got, want):
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_functions_equal_operators(spark, tables):
    days, stations = tables
    some = select.filter_year_range(days, 2001, 2002)
    _same(spark.sql("SELECT * FROM t_yearly_temperature(2001, 2002)"), rollup.yearly_temperature(some))
    _same(spark.sql("SELECT * FROM t_yearly_mean(2001, 2002)"), rollup.yearly_mean(some))
    _same(spark.sql("SELECT * FROM t_continent_year(2001, 2002)"), rollup.continent_year(some, stations))
    _same(spark.sql("SELECT * FROM t_dashboard()"), kpi.kpi_dashboard(days, stations))
    _same(spark.sql("SELECT * FROM t_summary()"), kpi.kpi_summary(days))
    _same(spark.sql("SELECT * FROM t_warm_days(25, 2001, 2002)"), select.filter_threshold(some, "tavg", 25.0))


def test_null_arguments(spark, tables):
    days, _ = tables
    assert spark.sql("SELECT * FROM t_days(NULL, 2002)").count() == 0
    assert spark.sql("SELECT * FROM t_days_at(2000, 2002, NULL)").count() == days.count()
    assert spark.sql("SELECT * FROM t_days_at(2000, 2000, 'Europe')").count() == 3


def test_the_choice_of_years_reaches_the_scan(spark, tables):
    plan = spark.sql("SELECT * FROM t_yearly_temperature(2001, 2002)")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(year,2001)" in plan and "LessThanOrEqual(year,2002)" in plan
    assert "prcp" not in plan


def test_functions_take_columns_as_arguments(spark, tables):
    got = spark.sql("SELECT v.y, count(*) AS n FROM VALUES (2000), (2002) v(y), LATERAL t_days(v.y, v.y) GROUP BY v.y")
    assert sorted(map(tuple, got.collect())) == [(2000, 12), (2002, 12)]


def test_registering_reads_nothing(spark, tables):
    sc = spark.sparkContext
    sc.setJobGroup("registering", "")
    register_functions(spark, *tables, "t_")
    jobs = sc.statusTracker().getJobIdsForGroup("registering")
    sc.setJobGroup("", "")
    assert not jobs

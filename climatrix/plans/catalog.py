"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables through the fixture adapter, so its
work grows with them. Doubles are rounded to 6 decimals at the very end
(sums of doubles depend on order); the DuckDB twin of each query is in
``climatrix.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climatrix.functions.safe import DIGITS
from climatrix.operators import bins, feeds, kpi, prepare, profile, report, rollup, sample, select, stats
from climatrix.session import scratch_path
from climatrix.sources import feed, fixtures, sinks
from climatrix.sources import select as src_select

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


TIME_TYPES = (T.TimestampNTZType, T.TimestampType, T.DateType)


def finish(df: DataFrame) -> DataFrame:
    """Final projection of a registered query, for comparison with its twin.

    Doubles are rounded to 6 decimals (sums of doubles depend on order).
    Timestamps and dates are rendered as ISO text ('YYYY-MM-DD HH:MM:SS'),
    which both engines print the same way, so a comparison never depends on
    how each client converts time units.
    """
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(f"round(`{f.name}`, {DIGITS}) AS `{f.name}`")
        elif isinstance(f.dataType, TIME_TYPES):
            exprs.append(f"CAST(`{f.name}` AS STRING) AS `{f.name}`")
        else:
            exprs.append(f"`{f.name}`")
    return df.selectExpr(*exprs)


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = lambda spark, sf_dir: finish(fn(spark, sf_dir))
        REGISTRY[name].__doc__ = fn.__doc__
        return fn

    return deco


def _m(spark, sf):
    return fixtures.measures(spark, sf)


def _st(spark, sf):
    return fixtures.stations(spark, sf)


def _sd(spark, sf):
    return fixtures.station_day(spark, sf)


def _ev(spark, sf):
    return fixtures.table(spark, sf, "events")


def _obs_prepared(spark, sf, codes=None):
    obs = fixtures.observations_from_events(spark, sf).drop("event_id")
    codes = prepare.codes_present(obs) if codes == "present" else codes
    return (
        obs.transform(prepare.calendar_parts)
        .transform(prepare.scale_units)
        .transform(lambda d: prepare.pivot_observations(d, codes))
    )


# ---------------------------------------------------------------- sources
@register("unnest_results")
def q_unnest_results(spark, sf):
    """Events -> landed API pages (JSON) -> read back and unnest."""
    path = scratch_path(spark, "feed-pages")
    feed.write_feed_pages(fixtures.observations_from_events(spark, sf), path, "event_id")
    return feed.unnest_results(spark, path, multi_line=False)


@register("stream_ingest")
def q_stream_ingest(spark, sf):
    """S1 as a stream: pages land as files, a file stream appends typed and
    scaled records to a year-partitioned table, which is then read back."""
    from climatrix.streaming import land_observations

    pages = scratch_path(spark, "landing")
    feed.write_feed_pages(fixtures.observations_from_events(spark, sf), pages, "event_id")
    table = scratch_path(spark, "observations")
    land_observations(spark, pages, table, multi_line=False).awaitTermination()
    return spark.read.parquet(table).select("date", "datatype", "station", "attributes", "value", "year")


@register("curate_station_day")
def q_curate_station_day(spark, sf):
    """Landing stream -> long table -> pivot -> year-partitioned, clustered
    station-day table, read back."""
    from climatrix.plans.curate import curate_station_day
    from climatrix.streaming import land_observations

    pages = scratch_path(spark, "landing")
    feed.write_feed_pages(fixtures.observations_from_events(spark, sf), pages, "event_id")
    landed = scratch_path(spark, "observations")
    land_observations(spark, pages, landed, multi_line=False).awaitTermination()
    out = curate_station_day(spark, landed, scratch_path(spark, "station-day"), ["TMAX", "TMIN", "PRCP", "AWND", "SNOW"])
    return out.select(
        "date", "year", "month", "day", "day_of_year", "week", "station", "tmax", "tmin", "prcp", "wind_avg", "snow", "tavg"
    )


@register("prepare_feed")
def q_prepare_feed(spark, sf):
    """Landed pages -> unnest -> parse, calendar, scale, pivot, rename, tavg."""
    path = scratch_path(spark, "feed-pages")
    feed.write_feed_pages(fixtures.observations_from_events(spark, sf), path, "event_id")
    obs = feed.unnest_results(spark, path, multi_line=False)
    return prepare.prepare_feed(obs, ["TMAX", "TMIN", "PRCP", "AWND", "SNOW"])


@register("select_observations")
def q_select_observations(spark, sf):
    obs = fixtures.observations_from_measures(spark, sf)
    europe = _st(spark, sf).filter(F.col("continent") == "EUROPE")
    return src_select.select_observations(obs, "1996-03-01", "1997-02-28", ["TMAX", "PRCP"], location=europe)


@register("select_observations_limit")
def q_select_observations_limit(spark, sf):
    """S2 with the request's own limit."""
    obs = fixtures.observations_from_measures(spark, sf)
    return src_select.select_observations(obs, "1996-03-01", "1997-02-28", ["TMAX", "PRCP"], limit=1_000)


@register("select_observations_dataset")
def q_select_observations_dataset(spark, sf):
    """S2 by dataset: daily records are temperatures, monthly ones precipitation here."""
    obs = fixtures.observations_from_measures(spark, sf)
    kind = F.when(F.col("datatype") == "PRCP", F.lit("MONTHLY")).otherwise(F.lit("DAILY"))
    return src_select.select_observations(obs.withColumn("dataset", kind), "1995-01-01", "2001-12-31", dataset="MONTHLY")


@register("union_batches")
def q_union_batches(spark, sf):
    m = _m(spark, sf)
    a = m.select("obs_id", "date", "station", "tavg", "prcp")
    b = m.select("obs_id", "date", "station", "tavg", "humidity")
    return src_select.union_batches(a, b)


EXPORT_SCHEMA = T.StructType(
    [
        T.StructField("obs_id", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("station", T.StringType()),
        T.StructField("tavg", T.DoubleType()),
        T.StructField("prcp", T.DoubleType()),
        T.StructField("humidity", T.DoubleType()),
    ]
)


@register("sink_csv")
def q_sink_csv(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.sink_csv(_m(spark, sf).select(*EXPORT_SCHEMA.names), path)
    return sinks.read_csv(spark, path, EXPORT_SCHEMA)


@register("sink_json")
def q_sink_json(spark, sf):
    path = scratch_path(spark, "json")
    sinks.sink_json(_m(spark, sf).select(*EXPORT_SCHEMA.names), path)
    return sinks.read_json(spark, path, EXPORT_SCHEMA)


@register("sink_parquet")
def q_sink_parquet(spark, sf):
    path = scratch_path(spark, "parquet")
    rows = _m(spark, sf).select("obs_id", "date", "year", "station", "tavg", "prcp")
    sinks.sink_parquet(rows, path, partition_by=("year",), cluster_by=("station", "date"))
    return sinks.read_parquet(spark, path).select("obs_id", "date", "year", "station", "tavg", "prcp")


@register("preview")
def q_preview(spark, sf):
    return select.preview(_m(spark, sf), 10, order_by=["date", "obs_id"])


# ------------------------------------------------------------ preparation
@register("parse_dates")
def q_parse_dates(spark, sf):
    """Lenient parse: 'error' events carry their JSON props instead of a date."""
    ev = _ev(spark, sf)
    text = F.when(F.col("event_type") == "error", F.col("props")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    return prepare.parse_dates(ev.select("event_id", text.alias("date")), "date", strict=False)


@register("calendar_parts")
def q_calendar_parts(spark, sf):
    ev = _ev(spark, sf).select("event_id", F.col("ts").alias("date"))
    return prepare.calendar_parts(ev).drop("date")


@register("scale_units")
def q_scale_units(spark, sf):
    obs = fixtures.observations_from_events(spark, sf)
    return prepare.scale_units(obs).select("event_id", "datatype", "value")


@register("pivot_observations")
def q_pivot_observations(spark, sf):
    return _obs_prepared(spark, sf)


@register("rename_codes")
def q_rename_codes(spark, sf):
    return prepare.rename_codes(_obs_prepared(spark, sf))


@register("derive_tavg")
def q_derive_tavg(spark, sf):
    """The codes that have records: no TAVG among them, so it is derived."""
    return prepare.derive_tavg(prepare.rename_codes(_obs_prepared(spark, sf, "present")))


@register("attach_station_attributes")
def q_attach(spark, sf):
    return _sd(spark, sf).select("obs_id", "station", "continent", "country", "lat", "lon", "elevation")


@register("warming_adjustment")
def q_warming(spark, sf):
    return prepare.warming_adjustment(_m(spark, sf)).select(
        "obs_id", "year", "tavg", "warming_trend", "tavg_trend"
    )


@register("coerce_numeric")
def q_coerce_numeric(spark, sf):
    """Values as feed text; 'error' events carry JSON instead of a number."""
    ev = _ev(spark, sf)
    text = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.col("value").cast("string"))
    return prepare.coerce_numeric(ev.select("event_id", text.alias("v")), ["v"])


@register("drop_incomplete")
def q_drop_incomplete(spark, sf):
    wide = prepare.rename_codes(_obs_prepared(spark, sf, "present"))
    return prepare.drop_incomplete(wide, ["tmax", "tmin"])


@register("prepare_feed_default")
def q_prepare_feed_default(spark, sf):
    """The whole chain with default codes, station attributes and warming; the feed has no TAVG, so it is derived."""
    path = scratch_path(spark, "feed-pages")
    feed.write_feed_pages(fixtures.observations_from_events(spark, sf), path, "event_id")
    obs = feed.unnest_results(spark, path, multi_line=False)
    stations = _st(spark, sf).select(F.col("station_key").cast("string").alias("station"), "continent", "lat")
    return prepare.prepare_feed(obs, stations=stations, warming=True)


@register("columns_by_type")
def q_columns_by_type(spark, sf):
    """P11, listing form, with the number of rows beside it (one row per column)."""
    ev = _ev(spark, sf)
    return prepare.columns_by_type(ev).crossJoin(F.broadcast(ev.agg(F.count(F.lit(1)).alias("rows"))))


@register("numeric_columns")
def q_numeric_columns(spark, sf):
    ev = _ev(spark, sf).select(
        "event_id",
        "ts",
        "event_type",
        F.col("user_id").cast("string").alias("station"),
        "props",
        F.col("value").cast("string").alias("value_text"),
    )
    return prepare.numeric_columns(ev)


@register("fill_missing_measures")
def q_fill_missing(spark, sf):
    return prepare.fill_missing_measures(_m(spark, sf).select("obs_id", "year", "tavg", "prcp"))


@register("project_columns")
def q_project(spark, sf):
    return prepare.project_columns(_m(spark, sf), ["obs_id", "date", "station", "tavg", "prcp", "snow"])


# ------------------------------------------------------- filters, sampling
@register("filter_year_range")
def q_filter_year_range(spark, sf):
    return select.filter_year_range(_m(spark, sf), 1996, 1998).select("obs_id", "date", "year", "tavg")


@register("filter_continent")
def q_filter_continent(spark, sf):
    return select.filter_continent(_m(spark, sf), "EUROPE", stations=_st(spark, sf)).select(
        "obs_id", "station", "continent", "tavg"
    )


@register("filter_year_set")
def q_filter_year_set(spark, sf):
    return select.filter_year_set(_m(spark, sf), [1995, 1999, 2001]).select("obs_id", "year", "prcp")


@register("filter_single_year")
def q_filter_single_year(spark, sf):
    return select.filter_single_year(_m(spark, sf)).select("obs_id", "year", "tavg")


@register("filter_threshold")
def q_filter_threshold(spark, sf):
    return select.filter_threshold(_m(spark, sf), "tavg", 20.0).select("obs_id", "tavg")


@register("distinct_sorted")
def q_distinct_sorted(spark, sf):
    return select.distinct_sorted(_m(spark, sf), "continent", stations=_st(spark, sf))


@register("latest_years")
def q_latest_years(spark, sf):
    return select.latest_years(_m(spark, sf), 3)


@register("keep_latest_years")
def q_keep_latest_years(spark, sf):
    """F7 used as a left-semi key: the rows of the last two years."""
    return select.keep_latest_years(_m(spark, sf), 2).select("obs_id", "year", "tavg")


@register("sample_fraction")
def q_sample_fraction(spark, sf):
    orders = fixtures.table(spark, sf, "orders")
    return sample.sample_fraction(orders, 0.1, seed=42, key="o_orderkey").select("o_orderkey", "o_totalprice")


@register("sample_n")
def q_sample_n(spark, sf):
    orders = fixtures.table(spark, sf, "orders")
    return sample.sample_n(orders, 500, "o_orderkey", seed=42).select("o_orderkey", "o_totalprice")


@register("cap_rows")
def q_cap_rows(spark, sf):
    return sample.cap_rows(_m(spark, sf), 5_000, "obs_id", seed=42).select("obs_id", "tavg", "prcp")


@register("cap_rows_massive")
def q_cap_rows_massive(spark, sf):
    """M3 with the massive path's cap of 500,000 rows (the same method; the table may be smaller)."""
    return sample.cap_rows(_m(spark, sf), 500_000, "obs_id", seed=42).select("obs_id", "tavg", "prcp")


# ----------------------------------------------------------- indicators
@register("row_count")
def q_row_count(spark, sf):
    return kpi.row_count(_m(spark, sf))


@register("kpi_summary")
def q_kpi_summary(spark, sf):
    return kpi.kpi_summary(_m(spark, sf))


@register("kpi_distinct")
def q_kpi_distinct(spark, sf):
    return kpi.kpi_distinct(_m(spark, sf), stations=_st(spark, sf))


@register("kpi_heatwave")
def q_kpi_heatwave(spark, sf):
    return kpi.kpi_heatwave(_m(spark, sf))


@register("kpi_drought")
def q_kpi_drought(spark, sf):
    return kpi.kpi_drought(_m(spark, sf))


@register("kpi_trend")
def q_kpi_trend(spark, sf):
    return kpi.kpi_trend(_m(spark, sf))


@register("kpi_variability")
def q_kpi_variability(spark, sf):
    return kpi.kpi_variability(_m(spark, sf))


@register("kpi_dashboard")
def q_kpi_dashboard(spark, sf):
    """Flagship: every headline indicator from one scan."""
    return kpi.kpi_dashboard(_m(spark, sf), stations=_st(spark, sf))


# -------------------------------------------------------------- roll-ups
@register("yearly_temperature")
def q_yearly_temperature(spark, sf):
    return rollup.yearly_temperature(_m(spark, sf))


@register("monthly_precipitation")
def q_monthly_precipitation(spark, sf):
    return rollup.monthly_precipitation(_m(spark, sf))


@register("continent_year")
def q_continent_year(spark, sf):
    return rollup.continent_year(_m(spark, sf), stations=_st(spark, sf))


@register("month_year_matrix")
def q_month_year_matrix(spark, sf):
    return rollup.month_year_matrix(_m(spark, sf))


@register("month_year_matrix_wide")
def q_month_year_matrix_wide(spark, sf):
    """A11 wide form: one column per year present."""
    return rollup.month_year_matrix(_m(spark, sf), years="auto")


@register("monthly_stream")
def q_monthly_stream(spark, sf):
    return rollup.monthly_stream(_m(spark, sf))


@register("seasonal_profile")
def q_seasonal_profile(spark, sf):
    return rollup.seasonal_profile(_m(spark, sf))


@register("yearly_mean")
def q_yearly_mean(spark, sf):
    return rollup.yearly_mean(_m(spark, sf), "tavg")


def _resample(freq):
    def q(spark, sf):
        return rollup.resample_mean(_m(spark, sf), freq, "date", "tavg")

    return q


register("resample_mean")(_resample("M"))
register("resample_mean_d")(_resample("D"))
register("resample_mean_w")(_resample("W"))
register("resample_mean_q")(_resample("Q"))
register("resample_mean_y")(_resample("Y"))


@register("date_span")
def q_date_span(spark, sf):
    return rollup.date_span(_m(spark, sf))


@register("stacked_totals")
def q_stacked_totals(spark, sf):
    return rollup.stacked_totals(_m(spark, sf), "year", "continent", "prcp", stations=_st(spark, sf))


# ------------------------------------------------------ bins and grids
@register("histogram")
def q_histogram(spark, sf):
    return bins.histogram(_m(spark, sf), "tavg", 100)


def _with_infinite(spark, sf):
    """The measures with tavg infinite on humid or dry days."""
    return _m(spark, sf).withColumn("tavg", F.expr("CASE humidity WHEN 30 THEN double('-Infinity') WHEN 31 THEN double('Infinity') ELSE tavg END"))


@register("histogram_infinite")
def q_histogram_infinite(spark, sf):
    """A17 over a column with infinite values: the bins hold the finite ones."""
    return bins.histogram(_with_infinite(spark, sf), "tavg", 10)


@register("infinite_values")
def q_infinite_values(spark, sf):
    """The values that no bin holds."""
    return bins.infinite_values(_with_infinite(spark, sf), "tavg")


@register("density_2d_infinite")
def q_density_2d_infinite(spark, sf):
    """A25 over a column with infinite values."""
    return bins.density_2d(_with_infinite(spark, sf), "tavg", "humidity", 20, 20)


@register("grid_mean")
def q_grid_mean(spark, sf):
    return bins.grid_mean(_m(spark, sf), stations=_st(spark, sf))


@register("grid_map")
def q_grid_map(spark, sf):
    return bins.grid_map(_m(spark, sf), stations=_st(spark, sf))


@register("grid_xy")
def q_grid_xy(spark, sf):
    return bins.grid_xy(_m(spark, sf), "tavg", "prcp", "year")


@register("grid_series")
def q_grid_series(spark, sf):
    return bins.grid_series(_m(spark, sf), "date", "tavg")


@register("density_2d")
def q_density_2d(spark, sf):
    return bins.density_2d(_m(spark, sf), "tavg", "humidity", 20, 20)


@register("box_stats")
def q_box_stats(spark, sf):
    return bins.box_stats(_ev(spark, sf), "value", ["event_type"])


@register("violin_density")
def q_violin_density(spark, sf):
    return bins.violin_density(_m(spark, sf), "tavg", "continent", 50, stations=_st(spark, sf))


# ---------------------------------------------------------- statistics
@register("describe")
def q_describe(spark, sf):
    return stats.describe(_m(spark, sf), ["tavg", "prcp", "tmax"])


@register("violin_density_by_month")
def q_violin_density_by_month(spark, sf):
    """A27 with two keys: month and continent."""
    return bins.violin_density(_m(spark, sf), "tavg", ["month", "continent"], 20, stations=_st(spark, sf))


@register("describe_all")
def q_describe_all(spark, sf):
    """A18 over every numeric column (surrogate keys aside)."""
    return stats.describe(_m(spark, sf).drop("station_key"))


@register("box_stats_by_station")
def q_box_stats_by_station(spark, sf):
    """A26 with many groups."""
    return bins.box_stats(_m(spark, sf), "tavg", ["station"])


CORR_COLUMNS = ["tmax", "tmin", "tavg", "prcp", "humidity", "wind_speed", "solar_radiation", "year", "month"]


@register("correlation_matrix")
def q_correlation_matrix(spark, sf):
    return stats.correlation_matrix(_m(spark, sf), CORR_COLUMNS)


@register("linear_trend")
def q_linear_trend(spark, sf):
    return stats.linear_trend(_m(spark, sf))


@register("trend_line")
def q_trend_line(spark, sf):
    return stats.trend_line(_m(spark, sf))


# ------------------------------------------------------------ profiles
@register("year_profile")
def q_year_profile(spark, sf):
    return profile.year_profile(_m(spark, sf))


@register("reference_profile")
def q_reference_profile(spark, sf):
    return profile.reference_profile(_m(spark, sf))


@register("compare_years")
def q_compare_years(spark, sf):
    return profile.compare_years(_m(spark, sf), [1996, 2000])


# ---------------------------------------------------------- chart feeds
@register("parallel_coordinates")
def q_parallel(spark, sf):
    return feeds.parallel_coordinates(_m(spark, sf))


@register("parallel_coordinates_sample")
def q_parallel_sample(spark, sf):
    """C1 with an explicit sample of 500 rows."""
    return feeds.parallel_coordinates(_m(spark, sf), None, 500, "obs_id", 42)


@register("parallel_coordinates_years")
def q_parallel_years(spark, sf):
    return feeds.parallel_coordinates(_m(spark, sf), [1997, 2000])


@register("grid_xy_category")
def q_grid_xy_category(spark, sf):
    """A23 with a text colour: point count per (cell, station)."""
    return bins.grid_xy(_m(spark, sf), "tavg", "prcp", "station")


@register("scatter_3d")
def q_scatter_3d(spark, sf):
    return feeds.scatter_3d(_m(spark, sf), stations=_st(spark, sf))


@register("scatter_3d_sample")
def q_scatter_3d_sample(spark, sf):
    """C2 with an explicit sample of 5,000 rows."""
    return feeds.scatter_3d(_m(spark, sf), 5_000, "obs_id", 42, stations=_st(spark, sf))


@register("frames")
def q_frames(spark, sf):
    return feeds.frames(_m(spark, sf), "continent", "month", "tavg", stations=_st(spark, sf))


@register("log_axis")
def q_log_axis(spark, sf):
    return feeds.log_axis(_m(spark, sf), "prcp", "humidity")


@register("scatter_sample")
def q_scatter_sample(spark, sf):
    return feeds.scatter_sample(_m(spark, sf), "tavg", "prcp", "year", 10_000, "obs_id", 42)


@register("scatter_points")
def q_scatter_points(spark, sf):
    """C5 over all rows."""
    return feeds.scatter_sample(_m(spark, sf), "tavg", "prcp", "year")


@register("frame_rows")
def q_frame_rows(spark, sf):
    """C3, row form."""
    return feeds.frame_rows(_m(spark, sf), "continent", "month", "tavg", stations=_st(spark, sf))


# -------------------------------------------------------------- report
@register("report_yearly")
def q_report_yearly(spark, sf):
    return report.report_yearly(_m(spark, sf))


@register("report_monthly")
def q_report_monthly(spark, sf):
    return report.report_monthly(_m(spark, sf))


@register("report_station")
def q_report_station(spark, sf):
    return report.report_station(_m(spark, sf))


@register("report_station_counts")
def q_report_station_counts(spark, sf):
    return report.report_station_counts(_m(spark, sf))


@register("report_header")
def q_report_header(spark, sf):
    return report.report_header(_m(spark, sf))


@register("report_stability")
def q_report_stability(spark, sf):
    return report.report_stability(_m(spark, sf))


@register("flag_extremes")
def q_flag_extremes(spark, sf):
    yearly = report.report_yearly(_m(spark, sf)).select("year", "temp_mean")
    return report.flag_extremes(yearly, "temp_mean")

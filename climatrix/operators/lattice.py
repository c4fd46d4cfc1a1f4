"""Report tables and roll-ups from one scan.

``lattice`` reduces the facts once to mergeable partials per (year, month, station) and sums these over every set of keys
that a table needs, in one aggregation with grouping sets. Each table is then a
filter of that small result. Joins with the station table happen on (year, station) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from climatrix.functions.safe import nan_free
from climatrix.operators import rollup
from climatrix.session import materialize

#: Sets of keys, by the name of their level.
LEVELS = {
    "all": (),
    "year": ("year",),
    "month": ("month",),
    "year_month": ("year", "month"),
    "station": ("station",),
    "year_station": ("year", "station"),
}
_KEYS = ("year", "month", "station")
_SUMS = ("n", "t_sum", "t_cnt", "t_m2", "tx_sum", "tx_cnt", "tn_sum", "tn_cnt", "p_sum", "p_cnt", "rainy")


def partials(df: DataFrame) -> DataFrame:
    """year, month, station with partials that merge by sums and extremes; ``t_m2`` is about the row's own mean of tavg."""
    return nan_free(df).groupBy(*_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("tavg").alias("t_sum"), F.count("tavg").alias("t_cnt"), (F.var_pop("tavg") * F.count("tavg")).alias("t_m2"),
        F.sum("tmax").alias("tx_sum"), F.count("tmax").alias("tx_cnt"), F.max("tmax").alias("tx_max"),
        F.sum("tmin").alias("tn_sum"), F.count("tmin").alias("tn_cnt"), F.min("tmin").alias("tn_min"),
        F.sum("prcp").alias("p_sum"), F.count("prcp").alias("p_cnt"), F.count_if(F.col("prcp") > 0).alias("rainy"),
    )


def lattice(df: DataFrame) -> DataFrame:
    """level, year, month, station and the merged partials of every key of every level; written once, so the facts are read once.

    ``t_m2`` is about the overall mean of tavg (the parallel variance update).
    """
    per = materialize(partials(df))
    mean = per.agg(F.try_divide(F.sum("t_sum"), F.sum("t_cnt")).alias("m")).select("m").scalar()
    off = F.try_divide(F.col("t_sum"), F.col("t_cnt")) - mean
    per = per.withColumn("t_m2", F.col("t_m2") + F.coalesce(F.col("t_cnt") * off * off, F.lit(0.0)))
    merged = [F.sum(c).alias(c) for c in _SUMS] + [F.max("tx_max").alias("tx_max"), F.min("tn_min").alias("tn_min")]
    sets = per.groupingSets([[F.col(c) for c in keys] for keys in LEVELS.values()], *_KEYS).agg(F.grouping_id(*_KEYS).alias("_g"), *merged)
    level = F.lit(None).cast("string")
    for name, keys in LEVELS.items():
        number = sum((k not in keys) << (len(_KEYS) - 1 - i) for i, k in enumerate(_KEYS))
        level = F.when(F.col("_g") == number, F.lit(name)).otherwise(level)
    return materialize(sets.withColumn("level", level).drop("_g").select("level", *_KEYS, *_SUMS, "tx_max", "tn_min"))


def _at(table: DataFrame, level: str) -> DataFrame:
    """The rows of a level whose keys are all there."""
    return table.where(F.col("level") == level).dropna(subset=list(LEVELS[level]))


def _mean(c: str) -> Column:
    return F.try_divide(F.col(f"{c}_sum"), F.col(f"{c}_cnt"))


def yearly(table: DataFrame) -> DataFrame:
    """R1."""
    return _at(table, "year").select(
        "year", F.col("n").alias("rows"), _mean("t").alias("temp_mean"), _prcp().alias("prcp_sum"), _mean("tx").alias("temp_max"), _mean("tn").alias("temp_min")
    ).orderBy("year")


def _prcp() -> Column:
    return F.coalesce(F.col("p_sum"), F.lit(0.0))


def monthly(table: DataFrame) -> DataFrame:
    """R2."""
    return _at(table, "month").select(
        "month", F.col("n").alias("rows"), _mean("t").alias("temp_mean"), _mean("p").alias("prcp_mean"), _prcp().alias("prcp_sum"),
        _mean("tx").alias("temp_max"), _mean("tn").alias("temp_min"),
    ).orderBy("month")


def station(table: DataFrame) -> DataFrame:
    """R3."""
    years = _at(table, "year_station").groupBy("station").agg(F.count(F.lit(1)).alias("years"))
    rows = _at(table, "station").join(years, "station", "left")
    return rows.select(
        "station", F.col("n").alias("rows"), F.coalesce("years", F.lit(0)).cast("bigint").alias("years"), _mean("t").alias("temp_mean"), _prcp().alias("prcp_sum"), _mean("p").alias("prcp_mean")
    ).orderBy("station")


def station_counts(table: DataFrame) -> DataFrame:
    """R4."""
    return _at(table, "station").select("station", F.col("n").alias("rows")).orderBy(F.desc("rows"), "station")


def header(table: DataFrame) -> DataFrame:
    """R5."""
    years = _at(table, "year").withColumn("m", _mean("t")).agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("_years"), F.regr_slope("m", "year").alias("_slope")
    )
    places = _at(table, "station").agg(F.count(F.lit(1)).alias("stations"))
    whole = table.where("level = 'all' AND n > 0").select(_mean("t").alias("temp_mean"), _prcp().alias("prcp_sum"), F.col("rainy").alias("rainy_days"), F.col("n").alias("rows"))
    slope = F.when(F.col("_years") > 1, F.coalesce(F.col("_slope"), F.lit(0.0))).otherwise(0.0)
    one = whole.join(years, F.lit(True)).join(places, F.lit(True))  # a row each
    return one.select("first_year", "last_year", "temp_mean", "prcp_sum", "rainy_days", "rows", "stations", (slope * F.lit(100.0)).alias("trend_century"))


def stability(table: DataFrame) -> DataFrame:
    """R6."""
    years = _at(table, "year").agg(F.count(F.lit(1)).alias("years"))
    std = F.when(F.col("t_cnt") > 1, F.sqrt(F.col("t_m2") / (F.col("t_cnt") - 1)))
    return table.where("level = 'all'").agg(F.max(std).alias("temp_std")).join(years, F.lit(True))


def yearly_temperature(table: DataFrame) -> DataFrame:
    """A8."""
    return _at(table, "year").select("year", _mean("t").alias("tavg_mean"), F.col("tx_max").alias("tmax_max"), F.col("tn_min").alias("tmin_min"))


def monthly_precipitation(table: DataFrame) -> DataFrame:
    """A9."""
    rows = _at(table, "year_month").select("year", "month", _prcp().alias("prcp_sum"))
    return rows.withColumn("axis_top", F.max("prcp_sum").over(Window.partitionBy()) * F.lit(1.1))  # years x 12 rows


def continent_year(table: DataFrame, stations: DataFrame) -> DataFrame:
    """A10: (year, station) rows meet the station table."""
    return rollup.continent_year_of(_at(table, "year_station"), stations, "station")


def month_year_matrix(table: DataFrame) -> DataFrame:
    """A11, long form."""
    return _at(table, "year_month").select("month", "year", _mean("t").alias("tavg_mean")).where("tavg_mean IS NOT NULL")


def monthly_stream(table: DataFrame) -> DataFrame:
    """A12."""
    rows = _at(table, "year_month").select("year", "month", _mean("t").alias("tavg_mean"), _prcp().alias("prcp_sum"))
    return rows.withColumn("tavg_stack", F.sum("tavg_mean").over(Window.partitionBy("month").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))


def seasonal_profile(table: DataFrame) -> DataFrame:
    """A13."""
    return _at(table, "month").select("month", _mean("t").alias("tavg_mean"))


def yearly_mean(table: DataFrame) -> DataFrame:
    """A14."""
    return _at(table, "year").select("year", _mean("t").alias("tavg_mean"))


#: Every table of the lattice by the name of the operator that computes it alone.
TABLES = {
    "report_yearly": yearly,
    "report_monthly": monthly,
    "report_station": station,
    "report_station_counts": station_counts,
    "report_header": header,
    "report_stability": stability,
    "yearly_temperature": yearly_temperature,
    "monthly_precipitation": monthly_precipitation,
    "month_year_matrix": month_year_matrix,
    "monthly_stream": monthly_stream,
    "seasonal_profile": seasonal_profile,
    "yearly_mean": yearly_mean,
}


def all_tables(df: DataFrame, stations: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every table by name, from one scan of ``df``; ``continent_year`` where the stations are given."""
    table = lattice(df)
    out = {name: make(table) for name, make in TABLES.items()}
    return out if stations is None else {**out, "continent_year": continent_year(table, stations)}

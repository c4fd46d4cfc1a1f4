"""Tables of the climate report.

In the sample report the yearly and monthly "max" and "min" columns are
means of tmax and tmin, not extremes; they are computed that way here.
A rainy day is a day with prcp > 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climatrix.functions.safe import nan_free, sum0
from climatrix.operators.kpi import total, year_station_rollup, yearly_mean_and_std


def report_yearly(df: DataFrame) -> DataFrame:
    """Per year rows, mean temp, total prcp, mean tmax, mean tmin (every year)."""
    df = nan_free(df)
    return (
        df.filter(F.col("year").isNotNull())
        .groupBy("year")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg("tavg").alias("temp_mean"),
            sum0("prcp").alias("prcp_sum"),
            F.avg("tmax").alias("temp_max"),
            F.avg("tmin").alias("temp_min"),
        )
        .orderBy("year")
    )


def report_monthly(df: DataFrame) -> DataFrame:
    """R2: per month over all years: rows, mean temp, mean and total prcp,
    mean tmax, mean tmin."""
    df = nan_free(df)
    return (
        df.filter(F.col("month").isNotNull())
        .groupBy("month")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg("tavg").alias("temp_mean"),
            F.avg("prcp").alias("prcp_mean"),
            sum0("prcp").alias("prcp_sum"),
            F.avg("tmax").alias("temp_max"),
            F.avg("tmin").alias("temp_min"),
        )
        .orderBy("month")
    )


def report_station(df: DataFrame) -> DataFrame:
    """Per station rows, distinct years, mean temp, total and mean prcp (every station)."""
    df = nan_free(df)
    return (
        df.filter(F.col("station").isNotNull())
        .groupBy("station")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct("year").cast("bigint").alias("years"),
            F.avg("tavg").alias("temp_mean"),
            sum0("prcp").alias("prcp_sum"),
            F.avg("prcp").alias("prcp_mean"),
        )
        .orderBy("station")
    )


def report_station_counts(df: DataFrame) -> DataFrame:
    """Rows per station, most rows first (ties by station id); ``preview`` shows the first n."""
    return (
        df.filter(F.col("station").isNotNull())
        .groupBy("station")
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), "station")
    )


def report_header(df: DataFrame) -> DataFrame:
    """First and last year, mean temp, trend per century, total prcp,
    rainy days, rows and stations - from the one-scan (year, station)
    rollup shared with the dashboard."""
    rolled = year_station_rollup(df)
    is_year, ymean, _ = yearly_mean_and_std(rolled)
    out = rolled.agg(
        F.min(F.when(is_year, F.col("year"))).alias("first_year"),
        F.max(F.when(is_year, F.col("year"))).alias("last_year"),
        total(F.try_divide(F.col("t_sum"), F.col("t_cnt"))).alias("temp_mean"),
        total(F.coalesce(F.col("p_sum"), F.lit(0.0))).alias("prcp_sum"),
        total(F.col("rainy")).alias("rainy_days"),
        total(F.col("n")).alias("rows"),
        total(F.col("stations")).cast("bigint").alias("stations"),
        F.count(F.when(is_year, F.lit(1))).alias("_years"),
        F.regr_slope(F.when(is_year, ymean), F.when(is_year, F.col("year"))).alias("_slope"),
    )
    slope = F.when(F.col("_years") > 1, F.coalesce(F.col("_slope"), F.lit(0.0))).otherwise(0.0)
    return out.filter(F.col("rows") > 0).select(
        "first_year", "last_year", "temp_mean", "prcp_sum", "rainy_days", "rows", "stations",
        (slope * F.lit(100.0)).alias("trend_century"),
    )


def report_stability(df: DataFrame) -> DataFrame:
    """Sample std of temperature over all rows and the number of years."""
    return nan_free(df).agg(
        F.stddev_samp("tavg").alias("temp_std"),
        F.count_distinct("year").cast("bigint").alias("years"),
    )


def flag_extremes(table: DataFrame, col: str) -> DataFrame:
    """Mark the rows holding the max and the min of ``col``.

    The extremes are one aggregate used as a scalar subquery (run once), so
    the table is never gathered into one task whatever its size.
    """
    ext = table.agg(F.struct(F.max(col).alias("hi"), F.min(col).alias("lo")).alias("e")).select("e").scalar()
    return table.select(
        *table.columns,
        (F.col(col) == ext.getField("hi")).alias(f"{col}_is_max"),
        (F.col(col) == ext.getField("lo")).alias(f"{col}_is_min"),
    )

"""Calendar and categorical roll-ups.

Group keys are filtered to non-null first: pandas ``groupby`` drops the
null group, Spark keeps it. Sums use ``sum0`` (an all-null group sums to 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climatrix.functions.calendar import period_calendar, period_label
from climatrix.functions.safe import nan_free, nan_to_null, sum0, to_number
from climatrix.operators.keys import station_key
from climatrix.schema import FREQUENCIES


def _keyed(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with all keys, NaN as null (pandas skips both)."""
    df = nan_free(df)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.filter(cond)


def yearly_temperature(df: DataFrame) -> DataFrame:
    """Per year mean tavg, max tmax, min tmin."""
    return _keyed(df, "year").groupBy("year").agg(
        F.avg("tavg").alias("tavg_mean"),
        F.max("tmax").alias("tmax_max"),
        F.min("tmin").alias("tmin_min"),
    )


def monthly_precipitation(df: DataFrame) -> DataFrame:
    """Per (year, month) total prcp, with the chart's axis top (1.1 x max).

    The axis top is a window over the aggregated table (years x 12 rows).
    """
    agg = _keyed(df, "year", "month").groupBy("year", "month").agg(sum0("prcp").alias("prcp_sum"))
    return agg.withColumn("axis_top", F.max("prcp_sum").over(Window.partitionBy()) * F.lit(1.1))


def continent_year(df: DataFrame, stations: DataFrame | None = None) -> DataFrame:
    """A10: per (year, continent) mean tavg, max tmax, min tmin, total prcp,
    mean lat and lon.

    With a separate station table the observations are first reduced to one
    row per (year, station) - sums, counts, extremes - and only that small
    table is joined to the stations (eager aggregation): the fact table is
    never shuffled for the join. Means are re-formed as sum / count.
    """
    if stations is None or "continent" in df.columns:
        return _keyed(df, "year", "continent").groupBy("year", "continent").agg(
            F.avg("tavg").alias("tavg_mean"),
            F.max("tmax").alias("tmax_max"),
            F.min("tmin").alias("tmin_min"),
            sum0("prcp").alias("prcp_sum"),
            F.avg("lat").alias("lat_mean"),
            F.avg("lon").alias("lon_mean"),
        )
    k = station_key(df, stations)
    per = _keyed(df, "year").groupBy("year", k).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("tavg").alias("t_sum"),
        F.count("tavg").alias("t_cnt"),
        F.max("tmax").alias("tx_max"),
        F.min("tmin").alias("tn_min"),
        F.sum("prcp").alias("p_sum"),
    )
    return continent_year_of(per, stations, k)


def continent_year_of(per: DataFrame, stations: DataFrame, k: str) -> DataFrame:
    """A10 from (year, station) partials."""
    st = stations.select(k, "continent", "lat", "lon")
    j = _keyed(per.join(st, k), "year", "continent")
    return j.groupBy("year", "continent").agg(
        F.try_divide(F.sum("t_sum"), F.sum("t_cnt")).alias("tavg_mean"),
        F.max("tx_max").alias("tmax_max"),
        F.min("tn_min").alias("tmin_min"),
        F.coalesce(F.sum("p_sum"), F.lit(0.0)).alias("prcp_sum"),
        F.try_divide(
            F.sum(F.when(F.col("lat").isNotNull(), F.col("n") * F.col("lat"))),
            F.sum(F.when(F.col("lat").isNotNull(), F.col("n"))),
        ).alias("lat_mean"),
        F.try_divide(
            F.sum(F.when(F.col("lon").isNotNull(), F.col("n") * F.col("lon"))),
            F.sum(F.when(F.col("lon").isNotNull(), F.col("n"))),
        ).alias("lon_mean"),
    )


def month_year_matrix(df: DataFrame, years: list[int] | str | None = None) -> DataFrame:
    """Mean tavg for month x year.

    Long form ``(month, year, tavg_mean)`` by default (empty cells absent).
    With a ``years`` list the wide form is returned: one row per month and
    one column per year, from a single conditional aggregation. ``"auto"``
    takes the years present (one small job; the list is bounded by the span
    of years, not by the rows).
    """
    base = _keyed(df, "month", "year")
    if years == "auto":
        years = [r[0] for r in base.select("year").distinct().orderBy("year").collect()]
    if years is None:
        return (
            base.groupBy("month", "year")
            .agg(F.avg("tavg").alias("tavg_mean"))
            .filter(F.col("tavg_mean").isNotNull())
        )
    return base.groupBy("month").agg(
        *[F.avg(F.when(F.col("year") == int(y), F.col("tavg"))).alias(str(y)) for y in years]
    )


def monthly_stream(df: DataFrame) -> DataFrame:
    """Per (year, month) mean tavg and total prcp, plus the stacked
    tavg (running sum over years within each month, as the stream chart
    stacks its yearly traces). The window runs on the aggregated table,
    partitioned by month (at most 12 partitions of one row per year)."""
    agg = _keyed(df, "year", "month").groupBy("year", "month").agg(
        F.avg("tavg").alias("tavg_mean"), sum0("prcp").alias("prcp_sum")
    )
    w = Window.partitionBy("month").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return agg.withColumn("tavg_stack", F.sum("tavg_mean").over(w))


def seasonal_profile(df: DataFrame) -> DataFrame:
    """Per month mean tavg."""
    return _keyed(df, "month").groupBy("month").agg(F.avg("tavg").alias("tavg_mean"))


def yearly_mean(df: DataFrame, col: str = "tavg") -> DataFrame:
    """Per year mean of one column (the timing page's group-by)."""
    return _keyed(df, "year").groupBy("year").agg(F.avg(col).alias(f"{col}_mean"))


def resample_mean(
    df: DataFrame, freq: str = "M", time_col: str = "date", value_col: str = "tavg"
) -> DataFrame:
    """Mean of ``value_col`` per D / W / M / Q / Y bucket, gaps kept.

    Bad dates and non-numeric values become null and are dropped first.
    Every bucket from the first to the last is listed; empty buckets show
    as null. One pass over the rows: the gaps are generated from each
    occupied bucket to the next.
    Output: ``(period timestamp_ntz, <value>_mean double)`` ordered by period.
    """
    if freq not in FREQUENCIES:
        raise ValueError(f"frequency must be one of {FREQUENCIES}, got {freq!r}")
    t = F.col(time_col)
    kind = df.schema[time_col].dataType
    if isinstance(kind, T.StringType):
        t = t.try_cast(T.TimestampNTZType())
    v = F.col(value_col)
    if not isinstance(df.schema[value_col].dataType, T.NumericType):
        v = to_number(v)
    clean = df.select(t.alias("_t"), nan_to_null(v.cast("double")).alias("_v")).dropna()
    means = clean.groupBy(period_label(F.col("_t"), freq).alias("_p")).agg(F.avg("_v").alias("_m"))
    # Each bucket expands to itself plus the empty buckets up to the next one.
    # The window runs over the bucket table, whose size is bounded by the
    # time span (e.g. 36,525 rows for a century of days), not by the data.
    nxt = F.lead("_p").over(Window.orderBy("_p"))
    span = period_calendar(F.col("_p"), F.coalesce(F.col("_n"), F.col("_p")), freq)
    gap = F.filter(span, lambda x: F.col("_n").isNull() | (x < F.col("_n")))
    name = f"{value_col}_mean"
    return (
        means.withColumn("_n", nxt)
        .select(F.explode(gap).alias("_x"), "_p", "_m")
        .select(
            F.col("_x").cast("timestamp_ntz").alias("period"),
            F.when(F.col("_x") == F.col("_p"), F.col("_m")).alias(name),
        )
        .orderBy("period")
    )


def date_span(df: DataFrame, col: str = "date") -> DataFrame:
    """First date, last date and whole days between them."""
    return df.agg(F.min(col).alias("first_date"), F.max(col).alias("last_date")).select(
        "first_date",
        "last_date",
        F.timestamp_diff("DAY", F.col("first_date"), F.col("last_date")).cast("bigint").alias("days"),
    )


def stacked_totals(
    df: DataFrame,
    x: str = "year",
    colour: str = "continent",
    y: str = "prcp",
    stations: DataFrame | None = None,
) -> DataFrame:
    """Total of ``y`` per x and colour group (what a stacked bar shows).

    When ``colour`` is a station attribute held in ``stations``, rows are
    first summed per (x, station) and only that table is joined.
    """
    if colour in df.columns or stations is None:
        return _keyed(df, x, colour).groupBy(x, colour).agg(sum0(y).alias(f"{y}_sum"))
    k = station_key(df, stations)
    per = _keyed(df, x, k).groupBy(x, k).agg(F.sum(y).alias("_s"))
    j = _keyed(per.join(stations.select(k, colour), k), colour)
    return j.groupBy(x, colour).agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias(f"{y}_sum"))

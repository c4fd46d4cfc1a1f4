"""Headline indicators (A1-A7) and the one-scan dashboard.

Every indicator is a global aggregate, so each function returns a one-row
DataFrame (zero rows for an empty input, as the reference returns no
indicators then). Columns that are absent take the reference's defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from climatrix.functions.safe import nan_free, share_pct, sum0
from climatrix.operators.keys import station_key
from climatrix.schema import DRY_THRESHOLD, HEAT_THRESHOLD, KPI_ABSENT_DEFAULTS


def _has(df: DataFrame, c: str) -> bool:
    return c in df.columns


def _or_default(df: DataFrame, c: str, agg: Column, default: float) -> Column:
    return agg if _has(df, c) else F.lit(default)


def row_count(df: DataFrame) -> DataFrame:
    """A1: number of rows (one row, column ``rows``)."""
    return df.agg(F.count(F.lit(1)).alias("rows"))


def kpi_summary(df: DataFrame) -> DataFrame:
    """A2: mean tavg, total prcp, max tmax, min tmin, means of humidity,
    solar radiation and wind, and the row count - one partial+final agg."""
    df = nan_free(df)
    out = df.agg(
        _or_default(df, "tavg", F.avg("tavg"), 0.0).alias("tavg_mean"),
        _or_default(df, "prcp", sum0("prcp"), 0.0).alias("prcp_total"),
        _or_default(df, "tmax", F.max("tmax"), 0.0).alias("tmax_max"),
        _or_default(df, "tmin", F.min("tmin"), 0.0).alias("tmin_min"),
        _or_default(df, "humidity", F.avg("humidity"), KPI_ABSENT_DEFAULTS["humidity_mean"]).alias(
            "humidity_mean"
        ),
        _or_default(df, "solar_radiation", F.avg("solar_radiation"), 0.0).alias("solar_mean"),
        _or_default(df, "wind_speed", F.avg("wind_speed"), 0.0).alias("wind_mean"),
        F.count(F.lit(1)).alias("rows"),
    )
    return out.filter(F.col("rows") > 0)


def kpi_distinct(
    df: DataFrame, stations: DataFrame | None = None, approx: bool = False
) -> DataFrame:
    """A3: distinct years, stations and continents.

    ``approx=True`` uses ``approx_count_distinct`` (HyperLogLog++): one scan
    with fixed-size sketches and no grouping by station; continents that only
    the station table knows are then those of the stations present.

    Without a continent column, continents are counted over the distinct
    stations present joined to the station table, so the join sees one row
    per station instead of one per observation.
    """
    st = station_key(df, stations) if (_has(df, "station") or _has(df, "station_key")) else None
    if approx and (_has(df, "continent") or stations is None or not st):
        return df.agg(
            F.approx_count_distinct("year").alias("years"),
            (F.approx_count_distinct(st) if st else F.lit(0)).cast("bigint").alias("stations"),
            (F.approx_count_distinct("continent") if _has(df, "continent") else F.lit(KPI_ABSENT_DEFAULTS["continents"])).cast("bigint").alias("continents"),
            F.count(F.lit(1)).alias("_rows"),
        ).filter(F.col("_rows") > 0).drop("_rows")
    if approx:
        seen = df.select(st).distinct().join(stations.select(st, "continent"), st, "left")
        there = seen.agg(F.count_distinct(st).alias("stations"), F.count_distinct("continent").alias("continents"))
        years = df.agg(F.approx_count_distinct("year").alias("years"), F.count(F.lit(1)).alias("_rows"))
        return years.filter(F.col("_rows") > 0).select(
            "years", there.select("stations").scalar().alias("stations"), there.select("continents").scalar().alias("continents")
        )
    keys = ["year"] + ([st] if st else []) + (["continent"] if _has(df, "continent") else [])
    pairs = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))  # one scan, combined map-side
    distinct = F.count_distinct
    if _has(df, "continent"):
        cont = distinct("continent")
    elif stations is not None and st:
        pairs = pairs.join(stations.select(st, "continent"), st, "left")
        cont = distinct("continent")
    else:
        cont = F.lit(KPI_ABSENT_DEFAULTS["continents"])
    base = pairs.agg(
        distinct("year").alias("years"),
        (distinct(st) if st else F.lit(0)).alias("stations"),
        cont.alias("_cont"),
        F.sum("_n").alias("_rows"),
    )
    cont = F.col("_cont")
    return base.filter(F.col("_rows") > 0).select(
        F.col("years").cast("bigint").alias("years"),
        F.col("stations").cast("bigint").alias("stations"),
        cont.cast("bigint").alias("continents"),
    )


def kpi_heatwave(df: DataFrame) -> DataFrame:
    """A4: % of all rows with tmax > 30 (null tmax counts in the denominator)."""
    df = nan_free(df)
    pct = share_pct(F.col("tmax") > F.lit(HEAT_THRESHOLD)) if _has(df, "tmax") else F.lit(0.0)
    return df.agg(pct.alias("heatwave_pct"), F.count(F.lit(1)).alias("_rows")).filter(
        F.col("_rows") > 0
    ).drop("_rows")


def kpi_drought(df: DataFrame) -> DataFrame:
    """A5: % of all rows with prcp < 5."""
    df = nan_free(df)
    pct = share_pct(F.col("prcp") < F.lit(DRY_THRESHOLD)) if _has(df, "prcp") else F.lit(0.0)
    return df.agg(pct.alias("drought_pct"), F.count(F.lit(1)).alias("_rows")).filter(
        F.col("_rows") > 0
    ).drop("_rows")


def _yearly_tavg(df: DataFrame) -> DataFrame:
    """Per year (null year kept apart): rows, mean and sample std of tavg."""
    return nan_free(df).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("tavg").alias("m"),
        F.stddev_samp("tavg").alias("s"),
    )


def kpi_trend(df: DataFrame) -> DataFrame:
    """Slope of yearly mean tavg on year, per century and per decade.

    Fitted on unweighted yearly means (two-level aggregation); 0 when there
    is at most one year or no tavg column.
    """
    if not _has(df, "tavg"):
        return df.agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > 0).select(
            F.lit(0.0).alias("trend_century"), F.lit(0.0).alias("trend_decade")
        )
    y = _yearly_tavg(df).agg(
        F.sum("n").alias("_rows"),
        F.count("year").alias("_years"),
        F.regr_slope("m", "year").alias("_slope"),
    )
    slope = F.when(F.col("_years") > 1, F.coalesce(F.col("_slope"), F.lit(0.0))).otherwise(0.0)
    return y.filter(F.col("_rows") > 0).select(
        (slope * F.lit(100.0)).alias("trend_century"), (slope * F.lit(10.0)).alias("trend_decade")
    )


def kpi_variability(df: DataFrame) -> DataFrame:
    """Mean over years of the sample std of tavg; 0 for at most one year."""
    if not _has(df, "tavg"):
        return df.agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > 0).select(
            F.lit(0.0).alias("variability")
        )
    y = _yearly_tavg(df).agg(
        F.sum("n").alias("_rows"),
        F.count("year").alias("_years"),
        F.avg(F.when(F.col("year").isNotNull(), F.col("s"))).alias("_v"),
    )
    return y.filter(F.col("_rows") > 0).select(
        F.when(F.col("_years") > 1, F.col("_v")).otherwise(F.lit(0.0)).alias("variability")
    )


def year_station_partials(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` (year, station and perhaps more) with partials of every measure that merge by sums and extremes.

    ``t_m2`` is the sum of squared deviations of tavg from the row's own mean. Absent measures give nulls.
    The aggregate list is SQL text: one expression per aggregate keeps the plan-building round trips
    to the JVM few.
    """
    df = nan_free(df)
    cols = set(df.columns)

    def m(c: str) -> str:
        return f"`{c}`" if c in cols else "CAST(NULL AS DOUBLE)"

    partials = {
        "n": "count(1)",
        "t_sum": f"sum({m('tavg')})",
        "t_cnt": f"count({m('tavg')})",
        "t_m2": f"var_pop({m('tavg')}) * count({m('tavg')})",
        "p_sum": f"sum({m('prcp')})",
        "tx_max": f"max({m('tmax')})",
        "tn_min": f"min({m('tmin')})",
        "h_sum": f"sum({m('humidity')})",
        "h_cnt": f"count({m('humidity')})",
        "s_sum": f"sum({m('solar_radiation')})",
        "s_cnt": f"count({m('solar_radiation')})",
        "w_sum": f"sum({m('wind_speed')})",
        "w_cnt": f"count({m('wind_speed')})",
        "heat": f"count_if({m('tmax')} > {HEAT_THRESHOLD})",
        "dry": f"count_if({m('prcp')} < {DRY_THRESHOLD})",
        "rainy": f"count_if({m('prcp')} > 0)",
    }
    return df.groupBy(*keys).agg(*[F.expr(e).alias(n) for n, e in partials.items()])


#: Partials that merge by addition (``t_m2`` once it is about a common mean).
SUMMED = ("n", "t_sum", "t_cnt", "t_m2", "p_sum", "h_sum", "h_cnt", "s_sum", "s_cnt", "w_sum", "w_cnt", "heat", "dry", "rainy")


def about_common_mean(per: DataFrame, keys: list[str]) -> DataFrame:
    """``t_m2`` about the mean of all rows of equal ``keys``: the parallel variance update.

    A window over partials, never a difference of large squares.
    """
    group = Window.partitionBy(*keys)
    mean = F.try_divide(F.sum("t_sum").over(group), F.sum("t_cnt").over(group))
    off = F.try_divide(F.col("t_sum"), F.col("t_cnt")) - mean
    return per.withColumn("t_m2", F.col("t_m2") + F.coalesce(F.col("t_cnt") * off * off, F.lit(0.0)))


def merged_partials() -> list[Column]:
    """Aggregates that merge rows of ``year_station_partials``."""
    return [F.sum(c).alias(c) for c in SUMMED] + [F.max("tx_max").alias("tx_max"), F.min("tn_min").alias("tn_min")]


def roll_up(per: DataFrame, k: str, stations: DataFrame | None = None) -> DataFrame:
    """One row per year plus a grand-total row (``gid`` = 1) from (year, station) partials.

    Only that small table meets the station table (for continents); ``rollup('year')`` aggregates
    it once into the yearly rows and the total row, distinct stations and continents included.
    """
    per = about_common_mean(per, ["year"])
    if k not in per.columns:  # a frame without stations has none to count
        per = per.withColumn(k, F.lit(None).cast("string"))
        if "continent" not in per.columns:
            per = per.withColumn("continent", F.lit(None).cast("string"))
    elif "continent" not in per.columns and stations is not None:
        per = per.join(stations.select(k, "continent"), k, "left")
    elif "continent" not in per.columns:
        per = per.withColumn("continent", F.lit(None).cast("string"))
    counted = [F.count_distinct(k).alias("stations"), F.count_distinct("continent").alias("continents"), F.grouping_id().alias("gid")]
    return per.rollup("year").agg(*merged_partials(), *counted)


def year_station_rollup(df: DataFrame, stations: DataFrame | None = None) -> DataFrame:
    """``roll_up`` of the partials of ``df``, which is scanned once."""
    cols = set(df.columns)
    k = station_key(df, stations)
    keys = ["year"] + ([k] if k in cols else []) + (["continent"] if "continent" in cols else [])
    return roll_up(year_station_partials(df, keys), k, stations)


def yearly_mean_and_std(rolled: DataFrame) -> tuple[Column, Column, Column]:
    """(is a year row, yearly mean of tavg, yearly sample std) over a rollup."""
    is_year = (F.col("gid") == 0) & F.col("year").isNotNull()
    ymean = F.try_divide(F.col("t_sum"), F.col("t_cnt"))
    ystd = F.sqrt(F.try_divide(F.col("t_m2"), F.col("t_cnt") - F.lit(1)))
    return is_year, ymean, ystd


def total(c: Column) -> Column:
    """The value of ``c`` on the rollup's grand-total row."""
    return F.max(F.when(F.col("gid") == 1, c))


def kpi_dashboard(df: DataFrame, stations: DataFrame | None = None) -> DataFrame:
    """All headline indicators in one row from a single scan of ``df``.

    Built on ``year_station_rollup``. Nothing is computed twice, so the fact
    table is read once.
    """
    cols = set(df.columns)
    known = "continent" in cols or (stations is not None and station_key(df, stations) in cols)
    return indicators(year_station_rollup(df, stations), cols, known)


def indicators(rolled: DataFrame, cols: set[str], continents_known: bool) -> DataFrame:
    """The headline indicators from the (years + 1) rows of a rollup; ``cols`` are the measures that exist.

    One aggregation fits the trend on the yearly means, averages the yearly deviations and picks the totals.
    """
    is_year, ymean, ystd = yearly_mean_and_std(rolled)
    out = rolled.agg(
        total(F.try_divide(F.col("t_sum"), F.col("t_cnt"))).alias("tavg_mean"),
        total(F.coalesce(F.col("p_sum"), F.lit(0.0))).alias("prcp_total"),
        total(F.col("tx_max")).alias("tmax_max"),
        total(F.col("tn_min")).alias("tmin_min"),
        total(F.try_divide(F.col("h_sum"), F.col("h_cnt"))).alias("humidity_mean"),
        total(F.try_divide(F.col("s_sum"), F.col("s_cnt"))).alias("solar_mean"),
        total(F.try_divide(F.col("w_sum"), F.col("w_cnt"))).alias("wind_mean"),
        total(F.col("n")).alias("rows"),
        F.count(F.when(is_year, F.lit(1))).alias("years"),
        total(F.col("stations")).alias("stations"),
        total(F.col("continents")).alias("_cont"),
        F.regr_slope(F.when(is_year, ymean), F.when(is_year, F.col("year"))).alias("_slope"),
        F.avg(F.when(is_year, ystd)).alias("_var"),
        total(F.try_divide(F.col("heat") * F.lit(100.0), F.col("n"))).alias("heatwave_pct"),
        total(F.try_divide(F.col("dry") * F.lit(100.0), F.col("n"))).alias("drought_pct"),
    )
    multi = F.col("years") > 1
    slope = F.when(multi, F.coalesce(F.col("_slope"), F.lit(0.0))).otherwise(0.0)

    def pick(name: str, source: str, default: float | None) -> Column:
        return (F.lit(default) if default is not None else F.col(source)).alias(name)

    def absent(c: str) -> bool:
        return c not in cols

    return out.filter(F.col("rows") > 0).select(
        pick("tavg_mean", "tavg_mean", 0.0 if absent("tavg") else None),
        pick("prcp_total", "prcp_total", 0.0 if absent("prcp") else None),
        pick("tmax_max", "tmax_max", 0.0 if absent("tmax") else None),
        pick("tmin_min", "tmin_min", 0.0 if absent("tmin") else None),
        pick("humidity_mean", "humidity_mean", KPI_ABSENT_DEFAULTS["humidity_mean"] if absent("humidity") else None),
        pick("solar_mean", "solar_mean", 0.0 if absent("solar_radiation") else None),
        pick("wind_mean", "wind_mean", 0.0 if absent("wind_speed") else None),
        F.col("rows"),
        F.col("years").cast("bigint").alias("years"),
        F.col("stations").cast("bigint").alias("stations"),
        (F.col("_cont") if continents_known else F.lit(KPI_ABSENT_DEFAULTS["continents"])).cast("bigint").alias("continents"),
        (slope * F.lit(100.0)).alias("trend_century"),
        (slope * F.lit(10.0)).alias("trend_decade"),
        F.when(multi, F.col("_var")).otherwise(F.lit(0.0)).alias("variability"),
        pick("heatwave_pct", "heatwave_pct", 0.0 if absent("tmax") else None),
        pick("drought_pct", "drought_pct", 0.0 if absent("prcp") else None),
    )

"""Filters, distinct values, ordered previews."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climatrix.schema import WARM_DAY_THRESHOLD
from climatrix.operators.keys import station_key
from climatrix.sources.select import date_literal

ALL = ("all", "All", "Tous", "*")


def _years_between(df: DataFrame, lo: int, hi: int, date_col: str):
    """Rows dated in [lo, hi]: a range on the raw date (a pushed Parquet filter) and, where there is
    a year column, the same range on it (directory pruning on a table partitioned by year)."""
    import datetime as dt

    cond = F.lit(True)
    if "year" in df.columns:
        cond = F.col("year").between(int(lo), int(hi))
    if date_col in df.columns:
        lo_d, hi_d = dt.date(int(lo), 1, 1), dt.date(int(hi) + 1, 1, 1)
        cond = cond & (F.col(date_col) >= date_literal(df, date_col, lo_d)) & (F.col(date_col) < date_literal(df, date_col, hi_d))
    return cond


def filter_year_range(df: DataFrame, lo: int, hi: int, date_col: str = "date") -> DataFrame:
    """inclusive year range, as ranges on the raw date and on the year column."""
    return df.filter(_years_between(df, lo, hi, date_col))


def filter_continent(
    df: DataFrame, continent: str | None, stations: DataFrame | None = None
) -> DataFrame:
    """equality on continent; None or an 'all' choice means no filter.

    Without a continent column, the station table is filtered first and the
    observations keep the rows of those stations (inner join on the station
    id, which also brings the continent column).
    """
    if continent is None or continent in ALL:
        return df
    if "continent" in df.columns or stations is None:
        return df.filter(F.col("continent") == F.lit(continent))
    k = station_key(df, stations)
    keys = stations.filter(F.col("continent") == F.lit(continent)).select(k, "continent")
    return df.join(keys, k)


def filter_year_set(df: DataFrame, years: Iterable[int], date_col: str = "date") -> DataFrame:
    """year in the given list; the span of the list also prunes the scan by date."""
    years = [int(y) for y in years]
    if not years:
        return df.limit(0)
    return df.filter(F.col("year").isin(years) & _years_between(df, min(years), max(years), date_col))


def filter_single_year(df: DataFrame, year: int | None = None, date_col: str = "date") -> DataFrame:
    """one year; by default the latest year present (one number, read first so that the scan is pruned by it)."""
    if year is None:
        year = df.agg(F.max("year")).first()[0]
        if year is None:
            return df.limit(0)
    return df.filter(_years_between(df, year, year, date_col))


def filter_threshold(
    df: DataFrame, col: str = "tavg", threshold: float = WARM_DAY_THRESHOLD
) -> DataFrame:
    """strict ``col > threshold`` (nulls drop out)."""
    return df.filter(F.col(col) > F.lit(float(threshold)))


def distinct_sorted(df: DataFrame, col: str, stations: DataFrame | None = None) -> DataFrame:
    """sorted distinct non-null values of one column.

    For a station attribute held in ``stations``, the distinct stations
    present are joined (one row per station, not per observation).
    """
    if col not in df.columns and stations is not None:
        k = station_key(df, stations)
        present = df.select(k).dropna().distinct()
        df = present.join(stations.select(k, col), k)
    return df.select(col).dropna().distinct().orderBy(col)


def latest_years(df: DataFrame, n: int = 1) -> DataFrame:
    """the last ``n`` distinct years (at most n rows)."""
    return df.select("year").dropna().distinct().orderBy(F.desc("year")).limit(int(n))


def keep_latest_years(df: DataFrame, n: int = 1) -> DataFrame:
    """Rows of the last ``n`` years: F7 as a left-semi key.

    The key side has at most ``n`` rows, so broadcasting it is bounded.
    """
    return df.join(F.broadcast(latest_years(df, n)), "year", "left_semi")


def preview(df: DataFrame, n: int = 10, order_by: Iterable[str] | None = None) -> DataFrame:
    """First ``n`` rows in a stated order (TakeOrderedAndProject).

    Each task keeps its own first ``n``; only ``n`` x tasks rows meet in the
    final merge, never the table.
    """
    keys = list(order_by) if order_by else list(df.columns)
    return df.orderBy(*keys).limit(int(n))

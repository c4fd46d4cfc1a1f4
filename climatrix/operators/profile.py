"""Normalised year profiles.

For six measures: (mean over the chosen slice - min over all rows) /
(max - min over all rows). The shown value is further divided for prcp,
humidity (100) and wind (20). Absent measures are first added as constants
on the whole frame (P12), so their profile value is null (0 / 0).

One pass over the rows: a per-year table of sums, counts, minima and maxima
(one row per year); slices, extremes (windows over that table) and the
all-years mean come from it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from climatrix.functions.safe import nan_free
from climatrix.operators.prepare import fill_missing_measures
from climatrix.schema import PROFILE_MEASURES, PROFILE_SHOWN_DIVISOR

M = PROFILE_MEASURES


def _per_year(df: DataFrame) -> DataFrame:
    d = nan_free(fill_missing_measures(df))
    aggs = []
    for i, m in enumerate(M):
        c = F.col(m).cast("double")
        aggs += [
            F.sum(c).alias(f"s{i}"),
            F.count(c).alias(f"c{i}"),
            F.min(c).alias(f"lo{i}"),
            F.max(c).alias(f"hi{i}"),
        ]
    return d.groupBy("year").agg(*aggs)  # null-year rows kept for the extremes


def _extremes(per: DataFrame) -> DataFrame:
    aggs = []
    for i in range(len(M)):
        aggs += [
            F.min(f"lo{i}").alias(f"gl{i}"),
            F.max(f"hi{i}").alias(f"gh{i}"),
            F.try_divide(F.sum(f"s{i}"), F.sum(f"c{i}")).alias(f"gm{i}"),
        ]
    return per.agg(*aggs)


def _with_extremes(per: DataFrame) -> DataFrame:
    """Each per-year row with the all-rows extremes, as windows over the
    per-year table (one row per year), so the rows are aggregated once."""
    w = Window.partitionBy()
    cols = [F.max("year").over(w).alias("_latest")]
    for i in range(len(M)):
        cols += [F.min(f"lo{i}").over(w).alias(f"gl{i}"), F.max(f"hi{i}").over(w).alias(f"gh{i}")]
    return per.select("*", *cols)


def _long(wide: DataFrame, mean_prefix: str, keys: list[str]) -> DataFrame:
    stacked = F.stack(
        F.lit(len(M)),
        *[
            x
            for i, m in enumerate(M)
            for x in (F.lit(m), F.col(f"{mean_prefix}{i}"), F.col(f"gl{i}"), F.col(f"gh{i}"))
        ],
    ).alias("measure", "mean", "min", "max")
    out = wide.select(*keys, stacked)
    norm = F.try_divide(F.col("mean") - F.col("min"), F.col("max") - F.col("min"))
    div = F.lit(1.0)
    for m, d in PROFILE_SHOWN_DIVISOR.items():
        div = F.when(F.col("measure") == m, F.lit(d)).otherwise(div)
    return out.withColumn("normalised", norm).withColumn("shown", F.col("normalised") / div)


def _slice_means(per: DataFrame) -> DataFrame:
    keep = [c for i in range(len(M)) for c in (f"gl{i}", f"gh{i}")]
    return per.select(
        "year",
        *[F.try_divide(F.col(f"s{i}"), F.col(f"c{i}")).alias(f"ym{i}") for i in range(len(M))],
        *keep,
    )


def compare_years(df: DataFrame, years: Iterable[int]) -> DataFrame:
    """The year profile of each year in ``years`` - one job for all."""
    per = _with_extremes(_per_year(df))
    sel = per.filter(F.col("year").isin([int(y) for y in years]))
    return _long(_slice_means(sel), "ym", ["year"])


def year_profile(df: DataFrame, year: int | None = None) -> DataFrame:
    """Profile of one year (default: the latest year present)."""
    per = _with_extremes(_per_year(df))
    target = F.col("_latest") if year is None else F.lit(int(year))
    return _long(_slice_means(per.filter(F.col("year") == target)), "ym", ["year"])


def reference_profile(df: DataFrame) -> DataFrame:
    """Profile of the all-years mean."""
    per = _per_year(df)
    return _long(_extremes(per), "gm", [])

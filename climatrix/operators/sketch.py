"""Stored sketches: quartiles and distinct stations of any slice of years without scanning the facts.

``quantile_sketches`` reduces the facts once to one row per (year, station, measure) with count, extremes and a
mergeable quantile sketch (KLL). Written as a table partitioned by year, any range of years and any grouping of
stations is a merge of its rows:

* ``sketch_quantiles`` reads estimates off the merged sketch (rank error within ``rank_error``);
* ``exact_quantiles`` gives the exact ones: the merged rows hold the counts, the extremes and the first intervals of
  the counting passes, so the facts are read only to count inside these.

``station_sketches`` does the same for distinct stations (theta sketches): union and intersection over slices.
Below 2**``THETA_LG`` distinct values a theta sketch is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climatrix.functions.safe import nan_to_null
from climatrix.operators.quantile import SKETCH_K, quantiles_from_stats
from climatrix.session import materialize
from climatrix.sources.sinks import sink_parquet

THETA_LG = 14


def rank_error(k: int = SKETCH_K) -> float:
    """Share of the rows that an estimate's rank may be off (99 % of the time) for sketches of size ``k``."""
    return 2.296 / k**0.9021


def _stacked(df: DataFrame, measures: Sequence[str], by: Sequence[str]) -> DataFrame:
    pairs = [x for c in measures for x in (F.lit(c), nan_to_null(F.col(c).cast("double")))]
    return df.select(*by, F.stack(F.lit(len(measures)), *pairs).alias("measure", "_v")).dropna()


def quantile_sketches(df: DataFrame, measures: Sequence[str], by: Sequence[str] = ("year", "station"), k: int = SKETCH_K) -> DataFrame:
    """by..., measure, n, lo, hi, sketch: one scan, partial + final aggregate; NaN and null are left out."""
    return _stacked(df, measures, by).groupBy(*by, "measure").agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"),
        F.call_function("kll_sketch_agg_double", F.col("_v"), F.lit(k)).alias("sketch"),
    )


def write_sketches(sketches: DataFrame, path: str) -> DataFrame:
    """The table, partitioned by year and clustered by measure; read back."""
    keys = [c for c in sketches.columns if c not in ("year", "measure", "n", "lo", "hi", "sketch")]
    sink_parquet(sketches, path, partition_by=("year",), cluster_by=("measure", *keys))
    return sketches.sparkSession.read.parquet(path)


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., measure, n, _lo, _hi, _sketch: the sketches of all years and stations given, merged per group."""
    return sketches.groupBy(*by, "measure").agg(
        F.sum("n").alias("n"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi"), F.call_function("kll_merge_agg_double", F.col("sketch")).alias("_sketch")
    )


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75), by: Sequence[str] = (), names: Sequence[str] = ("q1", "median", "q3")) -> DataFrame:
    """by..., measure, n, lo, hi and estimated quantiles: only the sketch table is read."""
    at = F.call_function("kll_sketch_get_quantile_double", F.col("_sketch"), F.array(*[F.lit(float(p)) for p in probs]))
    out = merged(sketches, by).withColumn("_q", at)
    return out.select(*by, "measure", "n", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)])


def exact_quantiles(
    facts: DataFrame, sketches: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75), by: Sequence[str] = (), names: Sequence[str] = ("q1", "median", "q3")
) -> DataFrame:
    """The exact quantiles of the facts that ``sketches`` summarises (the same years and stations on both sides)."""
    keys = [*by, "measure"]
    stats = materialize(merged(sketches, by))
    measures = [r.measure for r in stats.select("measure").distinct().collect()]  # one a column
    if not measures:
        return stats.select(*keys, "n", *[F.lit(None).cast("double").alias(n) for n in names])
    values = _stacked(facts, sorted(measures), by)
    return quantiles_from_stats(values, stats, list(probs), keys, list(names)).select(*keys, "n", *names)


def station_sketches(df: DataFrame, station: str = "station", by: Sequence[str] = ("year",), lg: int = THETA_LG) -> DataFrame:
    """by..., stations: a theta sketch of the distinct stations of every slice."""
    return df.dropna(subset=[station]).groupBy(*by).agg(F.call_function("theta_sketch_agg", F.col(station), F.lit(lg)).alias("stations"))


def distinct_stations(sketches: DataFrame, by: Sequence[str] = (), lg: int = THETA_LG) -> DataFrame:
    """by..., stations: distinct stations in the union of the given slices (A3)."""
    union = F.call_function("theta_union_agg", F.col("stations"), F.lit(lg))
    return sketches.groupBy(*by).agg(F.call_function("theta_sketch_estimate", union).alias("stations"))


def stations_in_all(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., stations: distinct stations that every one of the given slices has."""
    common = F.call_function("theta_intersection_agg", F.col("stations"))
    return sketches.groupBy(*by).agg(F.call_function("theta_sketch_estimate", common).alias("stations"))



"""The production flow: landed feed -> curated station-day table.

1. ``climatrix.streaming.land_observations`` appends typed, scaled feed
   records to a long table partitioned by year (incremental, exactly once).
2. ``curate_station_day`` pivots that table into station-day rows (P2, P4,
   P5, P6) and writes them partitioned by year and range-clustered by
   station and date, so later queries prune years by directory and
   stations by Parquet statistics.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from climatrix.operators.prepare import calendar_parts, derive_tavg, pivot_observations, rename_codes
from climatrix.sources.sinks import sink_parquet


def station_day_from_long(long_obs: DataFrame, codes: Iterable[str] | None = None) -> DataFrame:
    """Typed, scaled long rows -> wide station-day rows."""
    return (
        long_obs.transform(calendar_parts)
        .transform(lambda d: pivot_observations(d, codes))
        .transform(rename_codes)
        .transform(derive_tavg)
    )


def curate_station_day(
    spark: SparkSession, landed_path: str, out_path: str, codes: Iterable[str] | None = None
) -> DataFrame:
    """Pivot the landed long table and write the curated table; return it."""
    long_obs = spark.read.parquet(landed_path).drop("year")
    wide = station_day_from_long(long_obs, codes)
    sink_parquet(wide, out_path, partition_by=("year",), cluster_by=("station", "date"))
    return spark.read.parquet(out_path)

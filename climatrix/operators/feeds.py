"""Data behind the interactive charts (C1-C5): projections of exact samples,
per-frame aggregates and log-axis transforms. Drawing is not done here."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climatrix.operators.keys import station_key

from climatrix.operators.sample import sample_n
from climatrix.operators.select import filter_year_set

PARALLEL_COLUMNS = ("tavg", "tmax", "tmin", "prcp", "humidity", "wind_speed", "year")


def _sampled(df: DataFrame, n: int | None, key: str, seed: int) -> DataFrame:
    return df if n is None else sample_n(df, n, key, seed)


def parallel_coordinates(
    df: DataFrame,
    years: Iterable[int] | None = None,
    n: int | None = None,
    key: str = "obs_id",
    seed: int = 42,
) -> DataFrame:
    """The six measures and year, for the chosen years; all rows, or an exact sample of ``n``."""
    rows = _sampled(filter_year_set(df, years) if years else df, n, key, seed)
    return rows.select(*[c for c in PARALLEL_COLUMNS if c in df.columns])


def scatter_3d(
    df: DataFrame,
    n: int | None = None,
    key: str = "obs_id",
    seed: int = 42,
    stations: DataFrame | None = None,
) -> DataFrame:
    """Tavg, prcp, humidity, continent, station and a
    size column (solar_radiation, else wind_speed); all rows, or an exact sample of ``n``.

    With a separate station table the sample is drawn first and only its
    n rows are joined to the stations (the sample is the preserved side of
    the left join, so it cannot be the broadcast side; AQE picks the join
    from the measured sizes).
    """
    size = "solar_radiation" if "solar_radiation" in df.columns else "wind_speed"
    rows = _sampled(df, n, key, seed)
    if "continent" not in df.columns and stations is not None:
        k = station_key(df, stations)
        rows = rows.join(stations.select(k, "continent"), k, "left")
    return rows.select("tavg", "prcp", "humidity", "continent", "station", F.col(size).alias("size"))


def frames(
    df: DataFrame,
    frame: str = "continent",
    x: str = "month",
    y: str = "tavg",
    stations: DataFrame | None = None,
) -> DataFrame:
    """Per animation frame and x, the mean of y, ordered by frame then x.

    A frame key held in ``stations`` is reached by summing per (x, station)
    first and joining that small table (mean = sum / count).
    """
    if frame in df.columns or stations is None:
        return (
            df.filter(F.col(frame).isNotNull() & F.col(x).isNotNull())
            .groupBy(frame, x)
            .agg(F.avg(y).alias(f"{y}_mean"))
            .orderBy(frame, x)
        )
    k = station_key(df, stations)
    per = (
        df.filter(F.col(x).isNotNull())
        .groupBy(x, k)
        .agg(F.sum(y).alias("_s"), F.count(y).alias("_c"))
    )
    j = per.join(stations.select(k, frame), k).filter(F.col(frame).isNotNull())
    return (
        j.groupBy(frame, x)
        .agg(F.try_divide(F.sum("_s"), F.sum("_c")).alias(f"{y}_mean"))
        .orderBy(frame, x)
    )


def frame_rows(
    df: DataFrame,
    frame: str = "continent",
    x: str = "month",
    y: str = "tavg",
    stations: DataFrame | None = None,
) -> DataFrame:
    """C3, row form: every (frame, x, y) row, ordered by frame then x (then y)."""
    if frame not in df.columns and stations is not None:
        k = station_key(df, stations)
        df = df.join(stations.select(k, frame), k)
    return df.select(frame, x, y).dropna(subset=[frame, x]).orderBy(frame, x, y)


def log_axis(
    df: DataFrame, x: str = "prcp", y: str = "humidity", log_x: bool = True, log_y: bool = True
) -> DataFrame:
    """C4: log10 of x and/or y; rows with a non-positive value are not shown."""
    out = df
    cols = []
    for c, on in ((x, log_x), (y, log_y)):
        if on:
            out = out.filter(F.col(c) > 0)
            cols.append(F.log10(c).alias(f"log10_{c}"))
        else:
            cols.append(F.col(c))
    return out.select(*cols)


def scatter_sample(
    df: DataFrame,
    x: str = "tavg",
    y: str = "prcp",
    colour: str = "year",
    n: int | None = None,
    key: str = "obs_id",
    seed: int = 42,
) -> DataFrame:
    """X, y, colour, date and station; all rows, or an exact sample of ``n``."""
    return _sampled(df, n, key, seed).select(x, y, colour, "date", "station")

"""Request-style selection of observations (S2) and batch stacking (S3)."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def date_literal(df: DataFrame, col: str, day: dt.date | str) -> Column:
    """A literal of the column's own type for ``day`` at midnight.

    A literal of the same type keeps the comparison a plain range on the
    raw column, which the Parquet scan receives as a pushed filter.
    """
    d = day if isinstance(day, dt.date) else dt.date.fromisoformat(str(day))
    kind = df.schema[col].dataType
    if isinstance(kind, T.DateType):
        return F.expr(f"DATE'{d.isoformat()}'")
    if isinstance(kind, T.TimestampType):
        return F.expr(f"TIMESTAMP'{d.isoformat()} 00:00:00'")
    return F.expr(f"TIMESTAMP_NTZ'{d.isoformat()} 00:00:00'")


def date_between(df: DataFrame, col: str, start, end) -> Column:
    """Inclusive calendar-day range as ``col >= start and col < end + 1 day``."""
    s = start if isinstance(start, dt.date) else dt.date.fromisoformat(str(start))
    e = end if isinstance(end, dt.date) else dt.date.fromisoformat(str(end))
    return (F.col(col) >= date_literal(df, col, s)) & (
        F.col(col) < date_literal(df, col, e + dt.timedelta(days=1))
    )


def select_observations(
    obs: DataFrame,
    start,
    end,
    datatypes: list[str] | None = None,
    location: DataFrame | None = None,
    limit: int | None = None,
    date_col: str = "date",
    dataset: str | None = None,
) -> DataFrame:
    """The API request as a query over landed observations.

    ``dataset`` (e.g. a daily or monthly summary) selects rows of that
    dataset; a table without a ``dataset`` column raises ValueError. On a
    table written partitioned by dataset this is directory pruning.
    ``location`` is a frame of station ids (for instance the stations of one
    country); it is applied as a left-semi join, which the planner broadcasts
    only when its estimated size is under the session threshold.
    ``limit`` keeps the first rows in (date, station, datatype, value) order.
    """
    out = obs.filter(date_between(obs, date_col, start, end))
    if dataset is not None and "dataset" not in obs.columns:
        raise ValueError("a dataset was asked for, but the table has no dataset column")
    if dataset is not None:
        out = out.filter(F.col("dataset") == F.lit(dataset))
    if datatypes:
        out = out.filter(F.col("datatype").isin(list(datatypes)))
    if location is not None:
        out = out.join(location.select("station").distinct(), "station", "left_semi")
    if limit is not None:
        out = out.orderBy(date_col, "station", "datatype", "value").limit(int(limit))
    return out


def union_batches(*batches: DataFrame) -> DataFrame:
    """S3: stack batches by column name; absent columns become null."""
    if not batches:
        raise ValueError("union_batches needs at least one frame")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)

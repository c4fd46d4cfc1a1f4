"""Preparation: parse, calendar parts, unit scaling, long -> wide, enrichment.

All functions are DataFrame -> DataFrame and chain with ``.transform``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climatrix.functions.calendar import calendar_columns, epoch_micros
from climatrix.functions.safe import nan_to_null, to_number
from climatrix.operators.keys import station_key
from climatrix.schema import (
    CALENDAR_COLUMNS,
    CODE_TO_COLUMN,
    MEASURE_DEFAULTS,
    TENTHS_CODES,
    TENTHS_DIVISOR,
    WARMING_BASE_YEAR,
    WARMING_PER_YEAR,
)

PIVOT_KEYS = ("date", *CALENDAR_COLUMNS, "station")


def parse_dates(df: DataFrame, col: str = "date", strict: bool = True) -> DataFrame:
    """Text -> timestamp_ntz. Strict raises on bad text; lenient gives null."""
    c = F.col(col)
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        return df
    typed = c.cast(T.TimestampNTZType()) if strict else c.try_cast(T.TimestampNTZType())
    return df.withColumn(col, typed)


def calendar_parts(df: DataFrame, col: str = "date") -> DataFrame:
    """Year, month, day, day_of_year and ISO week."""
    return df.withColumns(calendar_columns(F.col(col)))


def scale_units(
    df: DataFrame,
    divisors: Mapping[str, float] | None = None,
    value: str = "value",
    datatype: str = "datatype",
) -> DataFrame:
    """Tenths -> units for the given datatype codes; others untouched."""
    divisors = divisors if divisors is not None else {c: TENTHS_DIVISOR for c in TENTHS_CODES}
    out = F.col(value)
    for code, div in divisors.items():
        out = F.when(F.col(datatype) == code, F.col(value) / F.lit(float(div))).otherwise(out)
    return df.withColumn(value, out)


def pivot_observations(
    df: DataFrame,
    codes: Iterable[str] | None = None,
    keys: Iterable[str] = PIVOT_KEYS,
    value: str = "value",
    datatype: str = "datatype",
) -> DataFrame:
    """Long -> wide, mean of duplicates, one column per requested code.

    Written as one conditional average per code, so the plan is a single
    partial + final hash aggregation (one shuffle, on the row keys). Rows with
    a null key and rows whose measures are all null are dropped, as pandas
    ``pivot_table`` does. The column list is the requested code list, so the
    schema is known before any data is read.
    """
    codes = list(codes) if codes is not None else list(CODE_TO_COLUMN)
    keys = list(keys)
    not_null = F.lit(True)
    for k in keys:
        not_null = not_null & F.col(k).isNotNull()
    v = nan_to_null(value)
    aggs = [F.avg(F.when(F.col(datatype) == code, v)).alias(code) for code in codes]
    # Calendar parts are functions of the date: shuffle on (date, station)
    # only and derive them after the aggregation (narrower shuffle keys).
    derived = [k for k in keys if k in CALENDAR_COLUMNS] if "date" in keys else []
    group = [k for k in keys if k not in derived]
    out = df.filter(not_null).groupBy(*group).agg(*aggs).dropna(how="all", subset=codes)
    if derived:
        parts = calendar_columns(F.col("date"))
        out = out.withColumns({k: parts[k] for k in derived}).select(*keys, *codes)
    return out


def rename_codes(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """P5: datatype codes -> readable names, only for columns present."""
    mapping = mapping if mapping is not None else CODE_TO_COLUMN
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present)


def derive_tavg(df: DataFrame) -> DataFrame:
    """Add tavg = (tmax + tmin) / 2 when the frame has no tavg column."""
    if "tavg" in df.columns:
        return df
    missing = [c for c in ("tmax", "tmin") if c not in df.columns]
    if missing:
        raise ValueError(f"cannot derive tavg: missing column(s) {missing}")
    return df.withColumn("tavg", (F.col("tmax") + F.col("tmin")) / F.lit(2))


def attach_station_attributes(
    df: DataFrame, stations: DataFrame, salt_buckets: int | None = None
) -> DataFrame:
    """Give each row its station's continent, country, lat, lon, elevation.

    A left join on the station key. No broadcast hint: the planner broadcasts
    the station table only when its estimated size is under
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sort-merge joins
    (AQE may still switch at run time, and splits a hot station's partition
    in a sort-merge join).

    ``salt_buckets=n`` salts the join explicitly for a hot station: each row
    gets a salt from a hash of its own values, the station table is repeated
    once per salt, and the join key becomes (station, salt). A station's rows
    spread over n tasks; the result is the same rows.
    """
    k = station_key(df, stations)
    attrs = [c for c in stations.columns if c != k and c not in df.columns]
    right = stations.select(k, *attrs)
    if not salt_buckets or salt_buckets <= 1:
        return df.join(right, k, "left")
    n = int(salt_buckets)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(n)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    return salted.join(copies, [k, "_salt"], "left").drop("_salt")


def attach_attributes_as_of(
    df: DataFrame, history: DataFrame, valid_from: str = "valid_from", date: str = "date", slice_days: int = 366, salt_buckets: int = 8
) -> DataFrame:
    """P7 in time: give each row the attributes its station had on its date.

    ``history`` holds a station's attributes from ``valid_from`` on, until its next row. Rows before a station's first
    one, or without a date or station, get nulls; of several rows of one instant the greatest counts.

    Observations and history meet in one sorted stream in which attributes are carried forward. The stream is cut, so a station
    with a third of all rows is not one task's: by ``slice_days`` of the date and, within a slice, into ``salt_buckets`` shares of
    the observations. Every share begins with the attributes valid at its slice's start, for which
    the history (not the observations) is repeated over the slices that a row's validity reaches.
    """
    k = station_key(df, history)
    attrs = [c for c in history.columns if c not in (k, valid_from) and c not in df.columns]
    span = F.lit(slice_days * 86_400_000_000)

    def slice_of(c: Column) -> Column:
        return F.floor(epoch_micros(c) / span).cast("bigint")

    known = history.dropna(subset=[k, valid_from]).groupBy(k, valid_from).agg(F.max(F.struct(*attrs)).alias("_h"))
    until = F.lead(valid_from).over(Window.partitionBy(k).orderBy(valid_from))  # a station's own few changes
    ext = df.agg(F.struct(F.min(date).alias("lo"), F.max(date).alias("hi")).alias("e")).select("e").scalar()
    first = F.greatest(slice_of(F.col(valid_from)), slice_of(ext.getField("lo")))
    last = F.least(F.coalesce(slice_of(F.col("_until")), slice_of(ext.getField("hi"))), slice_of(ext.getField("hi")))
    slices = known.withColumn("_until", until).withColumns({"_first": first, "_last": last}).where("_first <= _last")
    slices = slices.withColumn("_slice", F.explode(F.sequence("_first", "_last")))
    slices = slices.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(1, salt_buckets) - 1).cast("bigint"))))
    right = slices.select(F.col(k).alias("_k"), "_slice", "_salt", F.col(valid_from).alias("_t"), "_h")

    salt = F.pmod(F.xxhash64(*df.columns), F.lit(max(1, salt_buckets)))
    left = df.select(F.col(k).alias("_k"), slice_of(F.col(date)).alias("_slice"), salt.alias("_salt"), F.col(date).alias("_t"), F.struct(*df.columns).alias("_row"))
    stream = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy("_k", "_slice", "_salt").orderBy("_t", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    carried = stream.withColumn("_a", F.last("_h", ignorenulls=True).over(order)).where("_row IS NOT NULL")
    return carried.select("_row.*", *[F.col("_a")[c].alias(c) for c in attrs])


def warming_adjustment(df: DataFrame) -> DataFrame:
    """warming_trend = 0.01 * (year - 2000); tavg_trend = tavg + it."""
    trend = F.lit(WARMING_PER_YEAR) * (F.col("year") - F.lit(WARMING_BASE_YEAR))
    return df.withColumn("warming_trend", trend).withColumn(
        "tavg_trend", F.col("tavg") + F.col("warming_trend")
    )


def coerce_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Non-numeric text and NaN -> null; numbers as double."""
    out = {}
    for c in cols:
        kind = df.schema[c].dataType
        if isinstance(kind, T.NumericType):
            out[c] = nan_to_null(F.col(c).cast("double"))
        else:
            out[c] = to_number(c)
    return df.withColumns(out)


def drop_incomplete(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """P10: drop rows with a null in any of ``cols``."""
    return df.dropna(how="any", subset=list(cols))


def numeric_columns(df: DataFrame) -> DataFrame:
    """Columns usable as numbers -> (column, kind, n_parsable).

    Numeric-typed columns are listed from the schema (kind 'numeric'); text
    columns are listed when at least one value parses as a double (kind
    'text'). Timestamps are excluded. One aggregation pass over all columns.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    names = numeric + text
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column string, kind string, n_parsable bigint"
        )
    aggs = [F.count(F.col(c)).alias(f"_{i}") for i, c in enumerate(numeric)]
    aggs += [
        F.count(to_number(c)).alias(f"_{len(numeric) + i}")
        for i, c in enumerate(text)
    ]
    stacked = F.stack(
        F.lit(len(names)),
        *[
            x
            for i, c in enumerate(names)
            for x in (
                F.lit(c),
                F.lit("numeric" if i < len(numeric) else "text"),
                F.col(f"_{i}"),
            )
        ],
    ).alias("column", "kind", "n_parsable")
    return (
        df.agg(*aggs)
        .select(stacked)
        .filter((F.col("kind") == "numeric") | (F.col("n_parsable") > 0))
    )


def columns_by_type(df: DataFrame) -> DataFrame:
    """P11, listing form: every column with its kind (number, text, time, other), from the schema alone."""
    kinds = {T.StringType: "text", T.DateType: "time", T.TimestampType: "time", T.TimestampNTZType: "time"}

    def kind(t: T.DataType) -> str:
        return "number" if isinstance(t, T.NumericType) else kinds.get(type(t), "other")

    rows = [(f.name, kind(f.dataType)) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, kind string")


def fill_missing_measures(
    df: DataFrame, defaults: Mapping[str, float] | None = None
) -> DataFrame:
    """Add absent measure columns with a constant."""
    defaults = defaults if defaults is not None else MEASURE_DEFAULTS
    add = {c: F.lit(float(v)) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(add) if add else df


def project_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Keep only the columns in use (those present)."""
    keep = [c for c in cols if c in df.columns]
    return df.select(*keep)


def codes_present(obs: DataFrame, datatype: str = "datatype") -> list[str]:
    """The known datatype codes that have a record (a handful of rows reach the driver)."""
    known = obs.filter(F.col(datatype).isin(list(CODE_TO_COLUMN))).select(datatype).distinct()
    found = {r[0] for r in known.collect()}
    return [c for c in CODE_TO_COLUMN if c in found]


def prepare_feed(
    obs: DataFrame, codes: Iterable[str] | None = None, stations: DataFrame | None = None, warming: bool = False
) -> DataFrame:
    """Whole preparation chain: long feed rows -> wide station-day rows.

    Without ``codes`` only codes that have a record get a column, so tavg is
    derived where the feed has no TAVG at all and kept as it is where it has
    some. ``stations`` adds the station attributes (P7), ``warming`` the
    warming columns (P8).
    """
    codes = list(codes) if codes is not None else codes_present(obs)
    wide = (
        obs.transform(lambda d: parse_dates(d, "date", strict=True))
        .transform(calendar_parts)
        .transform(scale_units)
        .transform(lambda d: pivot_observations(d, codes))
        .transform(rename_codes)
    )
    if "tavg" in wide.columns or {"tmax", "tmin"} <= set(wide.columns):
        wide = derive_tavg(wide)
    if stations is not None:
        wide = attach_station_attributes(wide, stations)
    if warming and "tavg" in wide.columns:
        wide = warming_adjustment(wide)
    return wide

"""Adapter from the driver's tables to the climate data model.

A supplier plays a weather station and a line item plays one station-day
observation. The mapping (documented in FIXTURES.md) is a fixed set of
arithmetic expressions, so every column grows with the input tables.

* ``measures``      -> wide station-day rows without station attributes
                       (``obs_id`` is a unique row id, used as sampling key)
* ``stations``      -> station dimension (supplier x nation x region)
* ``station_day``   -> measures with attributes joined in (P7)
* ``observations_from_events`` / ``observations_from_measures`` -> long feed rows
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Fixed values of the adapter: event type -> feed datatype code.
EVENT_DATATYPE = {
    "view": "TMAX",
    "click": "TMIN",
    "purchase": "PRCP",
    "signup": "AWND",
    "error": "SNOW",
}
# Station id format of the station generators.
STATION_FORMAT = "ST%04d"


# Column types of the driver's tables (FIXTURES.md section 2).
# Declaring them skips schema inference (a footer read per table and query).
TABLE_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def station_id(key: str) -> F.Column:
    """'ST' + the key zero-padded to 4 digits, as ``format_string('ST%04d')``."""
    return F.expr(station_id_sql(key))


def station_id_sql(key: str) -> str:
    # lpad alone would truncate keys of 5+ digits, so those keep all digits;
    # this avoids a per-row String.format (about 3x slower, measured).
    return (
        f"CASE WHEN {key} < 0 THEN format_string('{STATION_FORMAT}', {key}) "
        f"WHEN {key} < 10000 THEN concat('ST', lpad(CAST({key} AS STRING), 4, '0')) "
        f"ELSE concat('ST', CAST({key} AS STRING)) END"
    )


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station-day measures from lineitem (no join), one projection.

    ``obs_id`` (order, line, part, supplier, ship day) is unique per row;
    ``station_key`` is the integer key behind the text ``station`` id.
    """
    tmin = "(l_quantity - 100 * l_discount)"
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), "
        "CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), "
        "CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + dayofmonth(l_shipdate) AS STRING)) AS obs_id",
        "l_shipdate AS date",
        "year(l_shipdate) AS year",
        "month(l_shipdate) AS month",
        "dayofmonth(l_shipdate) AS day",
        "dayofyear(l_shipdate) AS day_of_year",
        "weekofyear(l_shipdate) AS week",
        f"{station_id_sql('l_suppkey')} AS station",
        "l_suppkey AS station_key",
        "l_quantity AS tmax",
        f"{tmin} AS tmin",
        f"(l_quantity + {tmin}) / 2 AS tavg",
        "100 * l_tax AS prcp",
        "CAST(30 + l_partkey % 61 AS DOUBLE) AS humidity",
        "200 * l_discount AS wind_speed",
        "CAST(100 + l_partkey % 701 AS DOUBLE) AS solar_radiation",
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station dimension: one row per supplier.

    nation (25 rows) and region (5 rows) have a fixed size by definition of
    the schema, so broadcasting them is bounded. The supplier side is not
    hinted: it grows with the data and the planner sizes it.
    """
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    reg = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = F.broadcast(nat.join(F.broadcast(reg), nat.n_regionkey == reg.r_regionkey))
    return sup.join(geo, sup.s_nationkey == geo.n_nationkey, "left").selectExpr(
        f"{station_id_sql('s_suppkey')} AS station",
        "s_suppkey AS station_key",
        "r_name AS continent",
        "n_name AS country",
        "CAST((s_suppkey * 37) % 181 - 90 AS DOUBLE) AS lat",
        "CAST((s_suppkey * 73) % 361 - 180 AS DOUBLE) AS lon",
        "CAST((s_suppkey * 29) % 3000 AS DOUBLE) AS elevation",
    )


def station_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures with station attributes (left join, as P7)."""
    from climatrix.operators.prepare import attach_station_attributes

    return attach_station_attributes(measures(spark, sf_dir), stations(spark, sf_dir))


def observations_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long feed rows from ``events``: one row per event, user = station."""
    ev = table(spark, sf_dir, "events")
    code = F.lit(None).cast("string")
    for etype, dt in EVENT_DATATYPE.items():
        code = F.when(F.col("event_type") == etype, F.lit(dt)).otherwise(code)
    return ev.select(
        F.to_date("ts").cast("timestamp_ntz").alias("date"),
        code.alias("datatype"),
        F.col("user_id").cast("string").alias("station"),
        F.col("props").alias("attributes"),
        F.col("value"),
        F.col("event_id"),
    )


def observations_from_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long feed rows (tenths) unstacked from the station-day measures."""
    m = measures(spark, sf_dir)
    return m.select(
        "date",
        "station",
        F.lit(None).cast("string").alias("attributes"),
        F.stack(
            F.lit(3),
            F.lit("TMAX"), F.col("tmax") * F.lit(10),
            F.lit("TMIN"), F.col("tmin") * F.lit(10),
            F.lit("PRCP"), F.col("prcp") * F.lit(10),
        ).alias("datatype", "value"),
    ).select("date", "datatype", "station", "attributes", "value")

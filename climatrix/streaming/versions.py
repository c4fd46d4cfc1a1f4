"""Landing that goes on: bad pages aside, and one current value per (date, station, datatype).

Pages may arrive late, twice, in any order, and corrected. A page may say when it was ``fetched`` (any text
that sorts by time; none counts as the oldest); the records of a key are then those of its latest fetch, equal
records count once, and the value is their mean. ``latest_observations`` states that as a batch query;
the stream below gives the same answer:

1. ``land_versions`` reads pages permissively. A page that isn't valid JSON, and a record without a date, station or
   datatype, go to the dead letters with the reason; all other records are appended to the landed table. Both
   folders are written per micro-batch under its number, so a retried batch replaces itself.
2. ``keep_current`` follows the landed table with keyed state: per key, the distinct records by fetch time. A micro-batch
   writes the keys that changed under its number. State of dates further back than ``late`` behind the newest
   date is given up by the watermark.
3. ``current_observations`` reads the last written value of every key. ``overdue_records`` lists landed records that came after
   their state was given up; ``latest_observations`` over the landed table is the answer with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from climatrix.functions.calendar import epoch_micros
from climatrix.functions.safe import nan_to_null
from climatrix.operators.prepare import parse_dates, scale_units
from climatrix.schema import FEED_PAGE
from climatrix.session import scratch_path

KEY = ["date", "station", "datatype"]
PAGE = T.StructType([*FEED_PAGE.fields, T.StructField("fetched", T.StringType())])
LANDED = "date timestamp_ntz, datatype string, station string, attributes string, value double, fetched string"


def _records(pages: DataFrame) -> DataFrame:
    """Typed and scaled records of readable pages; a date that can't be read is null."""
    rows = pages.select(F.coalesce("fetched", F.lit("")).alias("fetched"), F.inline("results"))
    raw = rows.withColumn("given", F.to_json(F.struct("date", "datatype", "station", "attributes", "value")))
    return scale_units(parse_dates(raw, "date", strict=False)).withColumn("value", nan_to_null("value"))


def _land(pages: DataFrame, batch: int, landed: str, dead: str) -> None:
    """One micro-batch: landed records and dead letters, each replacing what an earlier try wrote."""
    pages = pages.persist()  # Spark refuses to read the corrupt column alone; both writes use the parsed pages
    try:
        records = _records(pages.where("_corrupt IS NULL"))
        complete = " AND ".join(f"{c} IS NOT NULL" for c in KEY)
        records.where(complete).select("date", "datatype", "station", "attributes", "value", "fetched").write.mode("overwrite").parquet(f"{landed}/batch={batch}")
        bad = pages.where("_corrupt IS NOT NULL").select(F.lit("page").alias("reason"), "file", F.col("_corrupt").alias("given"))
        bad = bad.unionByName(records.where(f"NOT ({complete})").select(F.lit("record").alias("reason"), F.lit(None).cast("string").alias("file"), "given"))
        bad.write.mode("overwrite").parquet(f"{dead}/batch={batch}")
    finally:
        pages.unpersist()


def _started(writer, once: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def land_versions(
    spark: SparkSession, landing_dir: str, landed: str, dead: str, checkpoint_path: str | None = None, multi_line: bool = True, once: bool = True, max_files_per_trigger: int = 1000
) -> StreamingQuery:
    """Land the pages of a folder: records below ``landed``, dead letters (reason, file, given) below ``dead``."""
    schema = T.StructType([*PAGE.fields, T.StructField("_corrupt", T.StringType())])
    reader = spark.readStream.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    pages = reader.option("multiLine", multi_line).option("maxFilesPerTrigger", max_files_per_trigger).json(landing_dir)
    pages = pages.withColumn("file", F.input_file_name())
    ckpt = checkpoint_path or scratch_path(spark, "landing-checkpoint")
    writer = pages.writeStream.option("checkpointLocation", ckpt).foreachBatch(lambda df, batch: _land(df, batch, landed, dead))
    return _started(writer, once)


def landed_observations(spark: SparkSession, landed: str) -> DataFrame:
    """All landed records, repeats and old versions included."""
    return spark.read.schema(LANDED).parquet(f"{landed}/batch=*")


def dead_letters(spark: SparkSession, dead: str) -> DataFrame:
    """reason (page or record), file and what was given, for everything that could not be landed."""
    return spark.read.schema("reason string, file string, given string").parquet(f"{dead}/batch=*")


def latest_observations(records: DataFrame) -> DataFrame:
    """date, datatype, station, value, fetched: the mean of the distinct records of every key's latest fetch.

    Repeats are dropped in the task that reads them and once more after the shuffle; a key's versions are then few.
    """
    distinct = records.dropna(subset=KEY).select(*KEY, "attributes", "value", F.coalesce("fetched", F.lit("")).alias("fetched")).distinct()
    last = distinct.withColumn("_last", F.max("fetched").over(Window.partitionBy(*KEY))).where("fetched = _last")
    return last.groupBy(*KEY).agg(F.avg("value").alias("value"), F.max("fetched").alias("fetched")).select("date", "datatype", "station", "value", "fetched")


def keep_current(
    spark: SparkSession, landed: str, current: str, late: str = "3650 days", checkpoint_path: str | None = None, once: bool = True, max_files_per_trigger: int = 1000
) -> StreamingQuery:
    """Follow the landed records with keyed state and write the value of every key that changes below ``current``."""
    source = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", max_files_per_trigger).parquet(f"{landed}/batch=*")
    records = source.withColumn("day", F.timestamp_micros(epoch_micros(F.col("date")))).withWatermark("day", late)
    state = records.groupBy("day", *KEY).agg(F.collect_set(F.struct(F.coalesce("fetched", F.lit("")).alias("fetched"), "attributes", "value")).alias("versions"))
    last = F.array_max(F.transform("versions", lambda v: v["fetched"]))
    valid = F.filter("versions", lambda v: (v["fetched"] == F.col("fetched")) & v["value"].isNotNull())
    total = F.aggregate("valid", F.lit(0.0), lambda a, v: a + v["value"])
    rows = state.withColumn("fetched", last).withColumn("valid", valid).withColumn("value", F.try_divide(total, F.size("valid")))
    rows = rows.select("date", "datatype", "station", "value", "fetched")
    ckpt = checkpoint_path or scratch_path(spark, "current-checkpoint")
    writer = rows.writeStream.outputMode("update").option("checkpointLocation", ckpt)
    writer = writer.foreachBatch(lambda df, batch: df.withColumn("changed", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{current}/batch={batch}"))
    return _started(writer, once)


def current_observations(spark: SparkSession, current: str) -> DataFrame:
    """date, datatype, station, value, fetched: what ``keep_current`` wrote last for every key."""
    rows = spark.read.schema("date timestamp_ntz, datatype string, station string, value double, fetched string, changed bigint").parquet(f"{current}/batch=*")
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct("value", "fetched"), "changed").alias("x"))
    return last.select("date", "datatype", "station", "x.value", "x.fetched")


def overdue_records(spark: SparkSession, landed: str, current: str) -> DataFrame:
    """Landed keys whose latest value the state didn't take up, with the value they should have: records behind the watermark."""
    want, have = latest_observations(landed_observations(spark, landed)), current_observations(spark, current)
    have = have.select(*KEY, F.col("value").alias("_v"), F.col("fetched").alias("_f"))
    joined = want.join(have, KEY, "left")
    same = F.col("fetched").eqNullSafe(F.col("_f")) & (F.col("value").eqNullSafe(F.col("_v")) | (F.abs(F.col("value") - F.col("_v")) <= 1e-9 * F.abs("value")))
    return joined.where(~same).drop("_v", "_f")

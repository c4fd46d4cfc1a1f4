"""Incremental landing of API pages with Structured Streaming.

The reference fetches a page per request and caches it for an hour. Here
pages land as JSON files in shared storage; a file stream picks up new
files, unnests and types the records (S1, P1, P2 year, P3) and appends them
to a Parquet table partitioned by year. The file sink plus the checkpoint
make each file land exactly once, and a restarted query (or one whose
executors were lost) resumes from the checkpoint.

The long table is then pivoted by the batch operators (P4-P6): the mean of
duplicates for a (date, station) can span several landing batches, so the
pivot is not done per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from climatrix.operators.prepare import parse_dates, scale_units
from climatrix.schema import FEED_PAGE
from climatrix.session import scratch_path


def feed_stream(
    spark: SparkSession, landing_dir: str, multi_line: bool = True, max_files_per_trigger: int = 1000
) -> DataFrame:
    """Streaming long observations from landed pages (typed and scaled)."""
    pages = (
        spark.readStream.schema(FEED_PAGE)
        .option("mode", "FAILFAST")
        .option("multiLine", multi_line)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .json(landing_dir)
    )
    obs = pages.select(F.inline("results"))
    return (
        parse_dates(obs, "date", strict=True)
        .transform(scale_units)
        .withColumn("year", F.year("date"))
    )


def land_observations(
    spark: SparkSession,
    landing_dir: str,
    table_path: str,
    checkpoint_path: str | None = None,
    multi_line: bool = True,
    once: bool = True,
) -> StreamingQuery:
    """Start the landing stream; ``once`` processes what is there and stops.

    The checkpoint defaults to a fresh folder under the session's shared
    checkpoint directory (never a machine-local path).
    """
    ckpt = checkpoint_path or scratch_path(spark, "landing-checkpoint")
    writer = (
        feed_stream(spark, landing_dir, multi_line)
        .writeStream.format("parquet")
        .option("path", table_path)
        .option("checkpointLocation", ckpt)
        .partitionBy("year")
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    return writer.start()

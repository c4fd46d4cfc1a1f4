"""Landed API pages: ``{"results": [ {date, datatype, station, attributes, value}, ... ]}``.

The HTTP fetch of the reference is replaced by files landed in shared
storage; reading them is a plain distributed JSON scan with a fixed schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climatrix.schema import FEED_PAGE


def read_feed(spark: SparkSession, path: str, multi_line: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """Feed records as text-dated long rows (S1). No ``results`` -> no rows.

    A page that isn't valid JSON, or a value of the wrong type, fails the job. To go on
    without such pages pass ``mode="DROPMALFORMED"`` and keep ``bad_pages`` of
    the same path, so nothing is lost unseen.

    ``multi_line=True`` reads one JSON document per file (an API response);
    ``False`` reads one page per line (JSON Lines).
    """
    pages = spark.read.schema(FEED_PAGE).option("mode", mode).option("multiLine", multi_line).json(path)
    return pages.select(F.inline("results"))


def bad_pages(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Quarantine: file, text and readable records of every page that ``read_feed`` would refuse."""
    schema = T.StructType([*FEED_PAGE.fields, T.StructField("_corrupt", T.StringType())])
    pages = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", multi_line).json(path)
    # The records must be read as well: Spark refuses queries on the corrupt column alone.
    return pages.filter("_corrupt IS NOT NULL").select(F.input_file_name().alias("file"), F.col("_corrupt").alias("page"), "results")


def unnest_results(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Landed pages -> typed long observations (strict date parse)."""
    from climatrix.operators.prepare import parse_dates

    return parse_dates(read_feed(spark, path, multi_line), "date", strict=True)


def write_feed_pages(
    obs: DataFrame, path: str, page_key: str, page_size: int = 1000, fetched: str | None = None, mode: str = "overwrite"
) -> None:
    """Write long observations as API pages of at most ``page_size`` records.

    ``page_key`` must be a unique integer column; a page holds the rows whose
    key falls in one block of ``page_size`` consecutive values, so no page
    (and no group in the shuffle) exceeds ``page_size`` records. ``fetched`` says when, in every page.
    """
    record = F.struct(
        F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        "datatype",
        "station",
        "attributes",
        "value",
    )
    (
        obs.groupBy(F.floor(F.col(page_key) / F.lit(page_size)).alias("page"))
        .agg(F.collect_list(record).alias("results"))
        .select("results", *([F.lit(fetched).alias("fetched")] if fetched else []))
        .write.mode(mode)
        .json(path)
    )

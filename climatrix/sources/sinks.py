"""Exports (S4-S6): executors write in parallel to shared storage.

The reference builds one in-memory text or Arrow buffer; here every task
writes its own files. JSON is written as JSON Lines (one record per line)
rather than one array, so no single writer holds the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DEFAULT_MAX_RECORDS_PER_FILE = 5_000_000


def sink_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """CSV with a header line, UTF-8, no index column."""
    df.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)
    return path


def sink_json(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """JSON records, one per line."""
    df.write.mode(mode).option("encoding", "UTF-8").json(path)
    return path


def sink_parquet(
    df: DataFrame,
    path: str,
    partition_by: tuple[str, ...] | list[str] = ("year",),
    mode: str = "errorifexists",
    max_records_per_file: int = DEFAULT_MAX_RECORDS_PER_FILE,
    cluster_by: tuple[str, ...] | list[str] | None = None,
) -> str:
    """Parquet, partitioned (by year by default) for partition pruning.

    Without ``cluster_by`` there is no shuffle: each task sorts its rows by
    the partition columns (Spark does this) and rolls files at
    ``max_records_per_file``; every task may then write one file per year.
    With ``cluster_by`` the rows are first range-partitioned on
    (partition columns, cluster columns): a hot year is split across many
    tasks by the cluster key, each task writes about one file, and the files
    are sorted, so Parquet min/max statistics prune on the cluster key too.
    Never ``repartition('year')`` alone: one task would get a whole year.
    """
    cols = [c for c in partition_by if c in df.columns]
    if cluster_by:
        keys = cols + [c for c in cluster_by if c in df.columns and c not in cols]
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    w = df.write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
    if cols:
        w = w.partitionBy(*cols)
    w.parquet(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

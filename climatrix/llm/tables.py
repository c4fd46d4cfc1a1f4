"""Reading the corpus tables and cutting lineage in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from climatrix.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Several jobs read it: a lost executor's share is read again, not made again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def fold(doc_id: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def numbered(rows: DataFrame, by: str, deal: list[str], order: list[str], per_bucket: int = 20_000, whole_buckets: bool = False) -> DataFrame:
    """Stored ``rows`` with ``slot``, gapless from 0 in each value of ``by``; no task sorts one value's rows alone.

    Rows are dealt into buckets by the hash of ``deal``; the buckets' counts give the first slot of each.
    With ``whole_buckets`` a bucket's rows stay in one task: as many tasks as the rows need, and even ones
    where ``by`` has many values with few rows and some with many.
    """
    buckets = max(1, -(-rows.count() // per_bucket))
    keys = F.xxhash64(*deal, F.lit(7))
    dealt = rows.withColumn("bucket", F.pmod(keys, F.lit(buckets).cast("long")))
    counts = dealt.groupBy(by, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(by, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    if whole_buckets:  # a join would deal by both keys; so the first slot comes as a row of its own, ahead of those that it counts for
        both = dealt.unionByName(first, allowMissingColumns=True).repartition("bucket")
        inside = Window.partitionBy(by, "bucket").orderBy(F.col("first").isNull(), *order)
        out = both.withColumns({"place": F.row_number().over(inside), "base": F.first("first").over(inside)}).where(F.col("first").isNull())
        return out.withColumn("slot", (F.col("base") + F.col("place") - 2).cast("long")).drop("bucket", "place", "base", "first")
    place = F.row_number().over(Window.partitionBy(by, "bucket").orderBy(*order))
    out = dealt.withColumn("place", place).join(first, [by, "bucket"])
    return out.withColumn("slot", (F.col("first") + F.col("place") - 1).cast("long")).drop("bucket", "place", "first")


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` written once to the shared folder in hash buckets of ``key``: grouping by ``key`` needs no shuffle of it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table_name = path.rsplit("/", 1)[-1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).option("path", path).saveAsTable(table_name)
    return spark.table(table_name)

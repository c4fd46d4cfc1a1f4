"""Corpus pipeline: classify, deduplicate, decontaminate, sanitise, pack.

Each stage works on all rows that the stage before it kept; ``run`` writes
every stage's result as Parquet in the shared folder and reads it again, so
lineage never spans stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from climatrix.llm import decontaminate as benchmark_filter
from climatrix.llm import hyperminhash, packing, quality, sanitise
from climatrix.llm.tables import stored, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8)."""
    return hyperminhash.keep_one(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of any benchmark item to be contaminated."""
    return benchmark_filter.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and the terms that disclose it generalised; n_chars follows the text."""
    clean = sanitise.sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of 2,048."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", classify),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("personal_data", hide_personal_data),
    ("packing", pack),
]

#: Models and tokenizers take part, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

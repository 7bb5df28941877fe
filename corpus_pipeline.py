"""A training-corpus pipeline over ``documents``; a part of subpackage llm.

Stages, each on all that the one before kept, written as Parquet in between:
quality classifier (rejected documents go), n-gram Jaccard join (one document of each group
stays), suffix-array deduplication (repeated passages go), mixing to target weights, packing.

Edge cases: an empty table, and rows whose text is null or empty, pass every stage; without labels nothing
is rejected; rows that share doc_id and text are one group, of which one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlake.llm import jaccard_join, mixing, packing, quality_classifier, suffix_dedup
from dyadlake.llm.common import materialize, table


def small_batches(spark: SparkSession) -> None:
    """From here on an Arrow batch of the session holds 1,000 rows: whole texts, so some MB.

    The stages' results are written by the caller, where the operators can't set this.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade reaches the threshold."""
    small_batches(spark)
    return quality_classifier.select_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of linked documents."""
    small_batches(spark)
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the bytes that repeat an earlier 100-byte string.

    A character that loses some of its bytes loses the others too.
    """
    small_batches(spark)
    d = suffix_dedup.deduplicate(docs, keep=("lang", "source"), whole_characters=True)
    d = d.select("doc_id", F.col("kept").cast("string").alias("text"), F.col("rest.lang").alias("lang"), F.col("rest.source").alias("source"))
    return d.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, one row per document and round in which it is drawn."""
    small_batches(spark)
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the packed windows."""
    small_batches(spark)
    return packing.pack(docs.select("doc_id", "text"), release=True)


STAGES = [
    ("quality_classifier", classify),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL can't express the classifier; tests hold each operator against a plain version of its own, and the
#: pipeline's decisions against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

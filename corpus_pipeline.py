"""From raw documents to a training mix: five stages, each a filter or change over all its predecessor kept.

Rows with null in any column, empty texts and repeated rows go through every stage by the rules of its operator; a null or
empty text is no copy and no leak, and the mix takes it at the rate of its source. Rows that
repeat doc_id and text share their fate, but for near duplicates, of which one row stays. An empty table gives an empty one.
Extra columns are kept, whatever their names; the mix renames an own ``copy`` to ``copy_in``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolspark.llm import line_spread, mix_sources, shingle_join, template_leaks, toxic_spans
from poolspark.llm.joins import free_name, join_narrow, shared_table

#: Documents that score this or more are toxic.
TOXIC = 0.7


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id and text hash are in ``gone`` (doc_id, body). Columns stay as they are."""
    body, mark = (free_name(name, docs) for name in ("_body", "_gone"))
    found = shared_table(gone.select("doc_id", F.col("body").alias(body)).distinct().withColumn(mark, F.lit(1)), "gone")
    named = docs.withColumn(body, F.xxhash64("text"))
    return join_narrow(named, found, ["doc_id", body], F.col("doc_id"), "left").where(F.col(mark).isNull()).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field of words does not find toxic. It learns from the labels of documents that are left."""
    model = toxic_spans.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, toxic_spans.score(docs, model).where(F.col("score") >= TOXIC))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay in one place only. ``n_chars`` follows the text; a document that is left empty stays."""
    removed = free_name("_removed", docs)
    kept = line_spread.drop_boilerplate(docs, removed=removed)
    size = F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", size).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 over five-word shingles: the smallest doc_id."""
    return shingle_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark, verbatim, in other case, or with other numbers, names and units."""
    return _without(docs, template_leaks.every_leak(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is taken, numbered in ``copy``."""
    return mix_sources.emit(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained field of words decides the first stage, which SQL cannot express; the stages are tested one by one.
ORACLE_SQL = None

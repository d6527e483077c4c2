"""A corpus through quality rules, near-duplicate removal, repeated passages, decontamination and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, jaccard_join, packing, quality_rules, substring_dedup
from marlstone.llm.cluster import cut, fresh, with_row_ids


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; each row is judged by its own text, and null or empty texts go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle Jaccard similarity of 0.8 or more: the least of its ids.

    A text is a document: of an id with several texts each is judged by itself, and so are texts without an id, which go
    before any with one.  Rows that repeat an id and its text stay or go together.  Null, empty and blank texts are
    linked with nothing and stay; an empty table gives no rows.
    """
    rows, row = with_row_ids(docs)
    found, gone = jaccard_join.jaccard_join(rows.select(F.col(row).alias("doc_id"), "text")), fresh(rows, "gone")
    drop = found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone))
    return rows.join(drop, F.col(row) == F.col(gone), "left_anti").drop(row)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word windows that smaller ids hold; a document that loses all its words goes.

    Rows of one id are not compared with each other, rows without an id with none; null and empty texts stay as they are.
    """
    gone = fresh(docs, "n_removed")
    out = substring_dedup.remove_repeats(docs, count=gone).where((F.col(gone) == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop(gone)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, judged row by row; no items remove nothing."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, of every row; a null or empty text is its end id."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("benchmark decontamination", benchmark_items), ("packing", packed)]

#: Tokenization can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's rows written before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs

"""From raw documents to packed training sequences, in five stages.

Every stage takes the documents that the one before kept and returns the columns of ``documents``; the
last returns the packing. Tables that a stage needs beside the documents are read from the same folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm import decontaminate, jaccard, packing, perplexity, simhash, substrings
from vectorloom.llm.rows import with_row_key, without_rows
from vectorloom.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROW = "_row_key"


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """Documents with a new text and its length."""
    new = F.col(text)
    return docs.withColumns({"text": new, "n_chars": F.length(new).cast("bigint")}).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text does not reject, each row judged by itself."""
    rows = with_row_key(docs, ROW)
    labels = perplexity.labels_by_row(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), ROW)
    verdicts = perplexity.classify(rows.withColumn("doc_id", F.col(ROW)), labels)
    return without_rows(rows, verdicts.where("rejected").select("doc_id"), ROW).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group of texts that share 0.8 or more of their five-word
    shingles."""
    rows = with_row_key(docs, ROW)
    return simhash.keep_one(rows, jaccard.similar_groups(rows, ROW), ROW).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere."""
    return _with_text(substrings.mark_repeats(docs.select(*COLUMNS), layout=True), "_kept")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that lie in windows of test items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _with_text(decontaminate.mark_hits(docs.select(*COLUMNS), items, cut=True), "text")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents packed into training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("substring dedup", repeated_passages),
    ("decontamination", benchmark_passages),
    ("packing", sequences),
]

# The language model and the similar groups cannot be stated in SQL; tests compare the operators of the stages
# with brute force, not the whole run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of the ``documents`` table after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)

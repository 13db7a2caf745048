"""The corpus pipeline: documents that pass the quality rules, one of each group of near-duplicates, without
benchmark passages, mixed to target weights, as token ids in binary files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontaminate, mixing, quality_rules, similar, tokens
from strata.llm.common import free_name, new_path, table
from strata.llm.queries import tokenizer_path

#: The last stage returns where each document's ids lie; its order is iterative hashing and a tokenizer, beyond SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that they reject go."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: one document of each group stays."""
    return similar.kept_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: documents are repeated by source, shuffled globally."""
    copy, key = free_name(docs, "copy"), free_name(docs, "shuffle_key")
    return mixing.mix(docs, copy=copy, shuffle_key=key).drop(copy, key)


def place(docs: DataFrame) -> Column:
    """Where a row lies in its table's files, by file name and row; the order of Spark's reading for other frames."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return F.monotonically_increasing_id()
    return F.concat_ws(":", F.col("_metadata.file_name"), F.lpad(F.col("_metadata.row_index").cast("string"), 20, "0"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary files, in the order in which the mixture was shuffled and written."""
    key = free_name(docs, "order_key")
    found = tokens.tokens(docs.select("*", place(docs).alias(key)), tokenizer_path(), order=F.col(key))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "start", "n_tokens", "ids_crc32")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

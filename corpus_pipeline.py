"""The training-data pipeline: five stages over `documents`, each written as Parquet and read again as the next one's docs.

All stages but the last return the columns of documents. ORACLE_SQL is None: language identification and tokenisation
can't be put in SQL. tests/llm/test_corpus_pipeline.py runs the stages in order over a small corpus and compares the rows of
each with a plain version of it. What a stage materialises on its way is deleted once its output is written, and
its input too; the last one's goes with the block (`session.scratch`) that the caller is in, since the result is lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from strandloom.session import bound_batches, delete, discard_later, new_path, scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told."""
    bound_batches(spark)
    return language_id.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines from the texts, short ones where they are equal; every document stays, n_chars follows its text."""
    return line_dedup.clean(docs, exact=1).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def join_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of similar ones."""
    bound_batches(spark)
    return jaccard_join.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    bound_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's tokens in sequences."""
    bound_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_similar),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    discard_later(before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Documents to training sequences: language, lines, near copies, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir), works on all the documents that the stage before kept, and returns
a DataFrame; ``run`` writes each one as Parquet to the shared folder and reads it again for the next.  All
but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm.decontaminate import decontaminate
from trackloom.llm.language import keep_known
from trackloom.llm.line_dedup import MIN_CHARS, dedup_lines
from trackloom.llm.ngram_join import keep_one
from trackloom.llm.packing import pack
from trackloom.llm.queries import tokenizer_path, wide_rows
from trackloom.plans.stages import stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter go."""
    wide_rows(spark)
    return keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of similar lines; documents whose last line goes are left out."""
    wide_rows(spark)
    return dedup_lines(docs, min_chars=MIN_CHARS, drop_empty=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group connected by word n-grams."""
    wide_rows(spark)
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    wide_rows(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    wide_rows(spark)
    return pack(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("line_dedup", lines),
    ("ngram_join", near_copies),
    ("decontaminate", benchmark),
    ("packing", packing),
]

#: Lines and near copies are components of similarities, and the tokenizer is no SQL function.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, BPE encoding.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes
as Parquet in the shared folder and reads again as the next one's docs. All but the last return the columns of
documents, so that a stage's decisions take effect: rejected rows are gone, lines are cut from the texts.
Nulls, empty and long texts, ties, repeated rows and empty tables are handled as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reportlake.llm import bpe, common, decontaminate, entries, lines, ngram_join, toxicity
from reportlake.session import ship


def ready(spark: SparkSession) -> None:
    """The package on the executors, and Arrow batches that suit long texts."""
    ship(spark)
    common.few_rows_a_batch(spark)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    ready(spark)
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines within one word edit the earliest stays; documents left without words go."""
    ready(spark)
    return lines.keep_new(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that n-gram links join, the smallest doc_id stays."""
    ready(spark)
    return ngram_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    ready(spark)
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: their number, digests of the ids and of the decoded text."""
    ready(spark)
    return bpe.round_trip(docs, entries.vocabulary(spark))


STAGES = [
    ("toxicity", toxic),
    ("line_dedup", repeated_lines),
    ("ngram_join", near_copies),
    ("decontamination", benchmark_leaks),
    ("bpe", encoded),
]

#: No stage of the five can be said in SQL; tests/llm compares each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, f"pipeline-{name}")
            common.release(spark)
    return docs

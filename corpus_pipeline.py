"""A corpus pipeline: language ID, line dedup, near-copy removal, benchmark decontamination, packing."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.llm import decontamination, language, line_dedup, ngram_join
from isotherm.llm.queries import pack_documents
from isotherm.llm.tables import staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.5  # of the predicted language
# Texts are long, so what a task holds of them is bounded in bytes or in few rows: what travels to a Python worker at
# once, what is buffered before a row group is written (and read again), what is decoded at once.
BOUNDS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 20,
    "parquet.block.size": 4 << 20,
    "spark.sql.parquet.columnarReaderBatchSize": 512,
}


def small_batches(stage):
    """Texts are long: without BOUNDS a task holds ten thousand of them on both sides."""

    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, bound in BOUNDS.items():
            spark.conf.set(name, str(bound))
        return stage(spark, docs, sf_dir)

    return bounded


@small_batches
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: not ``und`` and with a score of LEAST_SCORE. Learned from the rows with a lang."""
    keep = language.keep_known(docs, LEAST_SCORE)
    return keep.select(*COLUMNS)


@small_batches
def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents rid of their site's boilerplate lines; n_chars is that of the new text.

    Equal texts of a site count as one page, so copies keep their text until the join leaves one of them.
    """
    clean = line_dedup.drop_boilerplate(docs.select(*COLUMNS), "source", copies_once=True)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@small_batches
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more)."""
    return ngram_join.keep_one(docs.select(*COLUMNS), k=5, percent=80)


@small_batches
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_boilerplate),
    ("ngram_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


# The model, the tokenizer and the LSH cannot be said in SQL: tested stage by stage against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES = {}

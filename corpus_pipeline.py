"""From raw documents to packed sequences: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; run() writes each
stage's rows as Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, language, lines, minhash, packing
from lodestar.llm._shared import stored
from lodestar.shipping import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are like no language learnt from those with a lang."""
    ship(spark)
    return language.keep_known(docs, language.fit(docs))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the lines that occur before; every document stays, n_chars follows its text."""
    ship(spark)
    return lines.deduplicate(docs).select(*docs.columns).withColumn("n_chars", F.length("text").cast("long"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8 stays."""
    ship(spark)
    return minhash.keep_one(docs, 80)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold ten words in a row of a benchmark item, or a whole shorter item."""
    ship(spark)
    return decontaminate.drop_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids."""
    ship(spark)
    return packing.pack(docs, with_ids=True, remembered=50_000)  # beside what earlier stages left in the executors


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("line_dedup", distinct_lines),
    ("minhash_near_dedup", distinct_documents),
    ("benchmark_decontamination", clean_of_benchmark),
    ("packing", packed),
]
#: Centroids, SimHash, and tokenizer ids are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

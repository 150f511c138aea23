"""The supplied tables as patents, for the catalog's queries; PATENTS_SQL is the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A country for each language of the table.
COUNTRY = {"en": "US", "de": "DE", "fr": "FR", "es": "ES"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, country, doc_key, title, specification, assignee, priority_date, filing_date, effective, cpc."""
    docs = table(spark, sf_dir, "documents")
    country = F.create_map(*[F.lit(x) for pair in COUNTRY.items() for x in pair])[F.col("lang")]
    day = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("doc_id") * 37 % 12000).cast("int"))
    dated = F.col("doc_id") % 17 != 0
    return docs.select(
        "doc_id",
        country.alias("country"),
        F.concat(country, (F.col("doc_id") + 7000000).cast("string")).alias("doc_key"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("specification"),
        F.col("source").alias("assignee"),
        F.when(dated, day).alias("priority_date"),
        F.when(dated, F.date_add(day, 200)).alias("filing_date"),
        F.when(dated, day).alias("effective"),
        F.array(F.concat(F.lit("G06F"), (F.col("doc_id") % 7).cast("string")), F.concat(F.lit("H04L"), (F.col("doc_id") % 5).cast("string"))).alias("cpc"),
    )


PATENTS_SQL = """
pb AS (SELECT *, CASE lang WHEN 'en' THEN 'US' WHEN 'de' THEN 'DE' WHEN 'fr' THEN 'FR' WHEN 'es' THEN 'ES' END AS country,
       CASE WHEN doc_id % 17 <> 0 THEN DATE '1990-01-01' + CAST(doc_id * 37 % 12000 AS INTEGER) END AS d FROM documents),
patents AS (SELECT doc_id, country, country || CAST(doc_id + 7000000 AS VARCHAR) AS doc_key, split_part(text, chr(10), 1) AS title,
       text AS specification, source AS assignee, d AS priority_date, d + 200 AS filing_date, d AS effective,
       ['G06F' || (doc_id % 7), 'H04L' || (doc_id % 5)] AS cpc FROM pb)
"""

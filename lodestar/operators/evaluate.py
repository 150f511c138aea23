"""Retrieval metrics over all queries at once.

predictions: query_id, rank from 1, ref; references: query_id, ref. Both refs are compared as they are: make them
keys before (functions.text.reference_key). A queryset without references has 0 in every metric.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTS = (10, 25, 50, 100)


def hits(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """query_id, rank and ref of the first appearance of each reference found."""
    found = predictions.join(references.distinct(), ["query_id", "ref"], "left_semi")
    return found.groupBy("query_id", "ref").agg(F.min("rank").alias("rank"))


def metrics(predictions: DataFrame, references: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """A row for each query with references: n_references, recall at each cut, reciprocal rank, average precision."""
    total = references.groupBy("query_id").agg(F.countDistinct("ref").alias("n_references"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "ref"))
    found = hits(predictions, references).withColumn("nth", nth)
    recall = [F.sum((F.col("rank") <= c).cast("int")).alias(f"_hits_{c}") for c in cuts]
    each = found.groupBy("query_id").agg(*recall, F.min("rank").alias("_first"), F.sum(F.col("nth") / F.col("rank")).alias("_precision"))
    rows = total.join(each, "query_id", "left")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return rows.select(
        "query_id",
        F.col("n_references").cast("long").alias("n_references"),
        *[F.round(zero(F.col(f"_hits_{c}") / F.col("n_references")), 6).alias(f"recall_{c}") for c in cuts],
        F.round(zero(1 / F.col("_first")), 6).alias("mrr"),
        F.round(zero(F.col("_precision") / F.col("n_references")), 6).alias("map"),
    )


def aggregates(per_query: DataFrame) -> DataFrame:
    """The mean of each metric over all queries, a row a metric."""
    names = [c for c in per_query.columns if c not in ("query_id", "n_references")]
    means = per_query.agg(*[F.avg(n).alias(n) for n in names])
    return means.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.round(n, 6).alias("value")) for n in names])).alias("m")).select("m.*")


def curve(predictions: DataFrame, references: DataFrame, max_k: int) -> DataFrame:
    """k from 1 to max_k and the mean recall at k over all queries with references; a short ranking keeps its last value."""
    total = references.groupBy("query_id").agg(F.countDistinct("ref").alias("n"))
    found = hits(predictions, references).where(F.col("rank") <= max_k)
    steps = found.groupBy("query_id", F.col("rank").alias("k")).agg(F.count("*").alias("new"))
    grid = total.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(max_k))))
    run = Window.partitionBy("query_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = grid.join(steps, ["query_id", "k"], "left").withColumn("recall", F.sum(F.coalesce("new", F.lit(0))).over(run) / F.col("n"))
    return rows.groupBy("k").agg(F.round(F.avg("recall"), 6).alias("recall"))


def querysets(judgments: DataFrame) -> DataFrame:
    """query_id, references and rejected, sorted, from judgments(query_id, ref, relevant, seq); the last judgment
    of a pair holds, and a query without any reference is left out."""
    last = Window.partitionBy("query_id", "ref").orderBy(F.desc("seq"))
    rows = judgments.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    pick = lambda flag: F.sort_array(F.collect_list(F.when(F.col("relevant") == flag, F.col("ref"))))
    return rows.groupBy("query_id").agg(pick(True).alias("references"), pick(False).alias("rejected")).where(F.size("references") > 0)


def run(search: Callable[[DataFrame], DataFrame], queries: DataFrame, references: DataFrame, max_k: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per-query metrics, their means and the mean curve, for search(queries) -> predictions: one job for all queries."""
    predictions = search(queries).where(F.col("rank") <= max_k)
    per_query = metrics(predictions, references)
    return per_query, aggregates(per_query), curve(predictions, references, max_k)

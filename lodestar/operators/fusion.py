"""Fusion of rankings: reciprocal ranks and z-scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60


def reciprocal(rankings: list[DataFrame], k: int = K, key: str = "doc_id") -> DataFrame:
    """query_id, key and score over rankings(query_id, key, rank from 1): the sum of 1 / (k + rank) of all appearances.

    A key that stands twice in one ranking counts twice.
    """
    rows = rankings[0].select("query_id", key, "rank")
    for more in rankings[1:]:
        rows = rows.unionByName(more.select("query_id", key, "rank"))
    return rows.groupBy("query_id", key).agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("score"))


def standard(scores: DataFrame, system: str = "system", score: str = "score") -> Column:
    """(x - mean) / population deviation within each system; 0 where a system's scores are all equal."""
    own = Window.partitionBy(system)
    deviation = F.stddev_pop(score).over(own)
    return F.when(deviation > 0, (F.col(score) - F.avg(score).over(own)) / deviation).otherwise(F.lit(0.0))


def combined(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """key and the weighted sum of its standard scores over rows (system, key, score)."""
    weight = F.lit(1.0)
    if weights:
        weight = F.coalesce(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("system")], F.lit(1.0))
    return scores.withColumn("_z", standard(scores) * weight).groupBy("key").agg(F.sum("_z").alias("score"))


def hybrid(keyword: DataFrame, vector: DataFrame | None, limit: int, k: int = K) -> DataFrame:
    """The limit best of both rankings for each query; of the keyword ranking alone without the other."""
    fused = reciprocal([keyword, vector] if vector is not None else [keyword], k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)

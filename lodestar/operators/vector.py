"""Exact cosine search over dense vectors, and hashed embeddings of chunks.

Queries are a stated set: they are collected in blocks of a bounded size and broadcast, each block against all rows;
a batch of rows is scored by one matrix product, of which only each query's k best go to the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import chunks, tokens

#: Queries broadcast at a time.
BLOCK = 4096
DIMS = 64


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.array(rows, np.float64).reshape(len(rows), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, itself: bool = False) -> DataFrame:
    """query_id, vec_id, score (rounded cosine) and rank from 1, of the k nearest vectors of each query.

    Both have vec_id and embedding. A vector of length zero has cosine 0; null embeddings are left out. Ties go by
    vec_id. With itself false, a query's own vec_id is left out.
    """
    spark = vectors.sparkSession
    vectors, queries = (x.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding") for x in (vectors, queries))
    best: DataFrame | None = None
    for ids, matrix in _blocks(queries):
        held = spark.sparkContext.broadcast((ids, _unit(matrix)))
        part = vectors.mapInArrow(_scorer(held, k + (not itself), itself), "query_id long, vec_id long, score double")
        best = part if best is None else best.unionByName(part)
    if best is None:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows = [], []
    for row in queries.toLocalIterator():
        ids.append(row[0]), rows.append(row[1])
        if len(ids) == BLOCK:
            yield np.array(ids), np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids), np.array(rows, np.float64)


def _scorer(held, k: int, itself: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(rows, kind="stable")
            score = np.round(_unit(_matrix(batch.column(1)))[order] @ unit.T, 6)
            if not itself:
                score[rows[order][:, None] == ids[None, :]] = -np.inf
            top = np.argsort(-score, axis=0, kind="stable")[:k]
            columns = np.broadcast_to(np.arange(len(ids)), top.shape)
            value = score[top, columns].ravel()
            keep = np.isfinite(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids[columns.ravel()][keep], pa.int64()), pa.array(rows[order][top.ravel()][keep], pa.int64()), pa.array(value[keep] + 0.0, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def dot(a: Column, b: Column) -> Column:
    """The product of two arrays as doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either has length zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def bucket(token: Column, dims: int = DIMS) -> Column:
    """The dimension of a token: the first eight digits of its MD5, so that other engines agree."""
    return (F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long") % dims).cast("int")


def chunk_table(docs: DataFrame, text: str = "specification") -> DataFrame:
    """doc_id, chunk_number from 0 and chunk, for each chunk of the text."""
    return docs.select("doc_id", F.posexplode(chunks(F.col(text))).alias("chunk_number", "chunk"))


def hashed(rows: DataFrame, keys: list[str], text: str, dims: int = DIMS) -> DataFrame:
    """keys, dim and weight: the sparse hashed embedding of a text, at unit length."""
    counts = rows.select(*keys, F.explode(F.transform(tokens(F.col(text)), lambda t: bucket(t, dims))).alias("dim")).groupBy(*keys, "dim").agg(F.count("*").cast("double").alias("n"))
    size = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(*keys)))
    return counts.select(*keys, "dim", (F.col("n") / size).alias("weight"))


def best_chunk(docs: DataFrame, queries: DataFrame, dims: int = DIMS) -> DataFrame:
    """query_id, doc_id, chunk_number and score of the best chunk of each document for queries(query_id, text).

    Equal scores go to the first chunk. Chunks without a dimension in common with a query have no row.
    """
    chunk = hashed(chunk_table(docs), ["doc_id", "chunk_number"], "chunk", dims)
    asked = hashed(queries, ["query_id"], "text", dims).withColumnRenamed("weight", "q_weight")
    score = chunk.join(F.broadcast(asked), "dim").groupBy("query_id", "doc_id", "chunk_number").agg(F.round(F.sum(F.col("weight") * F.col("q_weight")), 6).alias("score"))
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "chunk_number")
    return score.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")

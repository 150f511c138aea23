"""Topics: TF-IDF names, k-means, DBSCAN over cosine distance, representatives, silhouette."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import topic_tokens

from .vector import dot

SEED, STARTS, NAMES, NEAREST = 42, 3, 4, 3
#: Rows of a block that dbscan() compares, products held at a time, and tasks that pairs of blocks are dealt to at most.
BLOCK, CELLS, TASKS = 16_384, 1 << 22, 10_000


def top_terms(docs: DataFrame, label: str, text: str, most: int = NAMES) -> DataFrame:
    """label, term, score and n from 0: share of the cluster's tokens times ln(1 + clusters / clusters with the term)."""
    counts = docs.select(label, F.explode(topic_tokens(F.col(text))).alias("term")).groupBy(label, "term").agg(F.count("*").alias("n"))
    total = counts.groupBy(label).agg(F.sum("n").alias("total"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    clusters = docs.select(label).distinct().agg(F.count("*").alias("clusters"))
    score = F.round(F.col("n") / F.col("total") * F.log(1 + F.col("clusters") / F.col("df")), 9)
    rows = counts.join(total, label).join(df, "term").crossJoin(F.broadcast(clusters)).select(label, "term", score.alias("score"))
    order = Window.partitionBy(label).orderBy(F.desc("score"), "term")
    return rows.withColumn("n", F.row_number().over(order) - 1).where(F.col("n") < most)


def _prepared(rows: DataFrame, vector: str) -> DataFrame:
    return rows.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


def kmeans(rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and label of the best of several starts."""
    frame = _prepared(rows.select(key, vector), vector)
    models = [KMeans(featuresCol="_v", predictionCol="label", k=k, seed=SEED + s, maxIter=30).fit(frame) for s in range(STARTS)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(frame).select(key, "label")


def choose_k(rows: DataFrame, most: int = 12, key: str = "vec_id", vector: str = "embedding") -> tuple[int, DataFrame]:
    """The number of clusters from 2 on with the best simplified silhouette, and its labels."""
    n = rows.count()
    tried = [(k, kmeans(rows, k, key, vector)) for k in range(2, max(2, min(most, n // 2)) + 1)]
    scored = [(silhouette(rows.select(key, vector).join(labels, key), vector), -k, labels) for k, labels in tried]
    best = max(scored, key=lambda s: (s[0], s[1]))
    return -best[1], best[2]


def centroids(rows: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label and the mean vector of each cluster."""
    dims = rows.select(label, F.posexplode(vector).alias("dim", "x")).groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return dims.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda d: d["x"]).alias("centroid"))


def _distance(a: str, b: str):
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(dot(gap, gap))


def representatives(rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", most: int = NEAREST) -> DataFrame:
    """label, key, distance and n of the rows nearest to each cluster's mean."""
    near = rows.join(F.broadcast(centroids(rows, label, vector)), label).withColumn("distance", F.round(_distance(vector, "centroid"), 6))
    order = Window.partitionBy(label).orderBy("distance", key)
    return near.withColumn("n", F.row_number().over(order) - 1).where(F.col("n") < most).select(label, key, "distance", "n")


def silhouette(rows: DataFrame, vector: str = "embedding", label: str = "label") -> float:
    """The simplified silhouette: distances to the means of the own and the nearest other cluster."""
    means = centroids(rows, label, vector).select(F.col(label).alias("_c"), "centroid")
    own = F.min(F.when(F.col(label) == F.col("_c"), F.col("_d")))
    other = F.min(F.when(F.col(label) != F.col("_c"), F.col("_d")))
    each = rows.withColumn("_id", F.monotonically_increasing_id()).join(F.broadcast(means)).withColumn("_d", _distance(vector, "centroid"))
    each = each.groupBy("_id").agg(own.alias("a"), other.alias("b"))
    value = each.agg(F.avg(F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0))).first()[0]
    return float(value if value is not None else 0.0)


def dbscan(rows: DataFrame, eps: float, least: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and label (the smallest key of the cluster's core, or -1 for noise) by cosine distance.

    All rows are compared, in pairs of blocks by matrix products, once for the numbers of neighbours and, those that have
    some, once for links. Of a pair of blocks only what connects its core rows is kept, never all pairs within eps.
    The time grows with the square of the rows.
    """
    units = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("a"), F.col(vector).alias("v"), F.size(vector).alias("dims"), F.lit(False).alias("core"))
    counts = _cut(_block_pairs(units, _counted(eps), "a long, b long").groupBy("a").agg(F.sum("b").alias("n")))
    some = units.drop("core").join(counts.where((F.col("n") > 1) | (F.col("n") >= least)), "a").select("a", "v", "dims", (F.col("n") >= least).alias("core"))
    found = _cut(_block_pairs(some, _connected(eps), "a long, b long, core boolean"))
    links = found.where("core").select("a", "b")
    links = _cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = _cut(counts.where(F.col("n") >= least).select("a", F.col("a").alias("label")))
    while True:
        lower = links.join(label.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("_low"))
        new = label.join(lower, "a", "left").select("a", F.least("label", F.coalesce("_low", "label")).alias("label"))
        up = new.select(F.col("a").alias("label"), F.col("label").alias("_up"))
        new = _cut(new.join(up, "label", "left").select("a", F.coalesce("_up", "label").alias("label")))
        if new.join(label.withColumnRenamed("label", "_old"), "a").where("label <> _old").isEmpty():
            break
        label = new
    border = found.where("not core").join(label.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("label"))
    own = label.select("a", F.col("label").alias("_own"))
    result = rows.select(F.col(key).alias("a")).join(own, "a", "left").join(border, "a", "left")
    return result.select(F.col("a").alias(key), F.coalesce("_own", "label", F.lit(-1)).alias("label"))


class _Block(NamedTuple):
    """Rows of a block: keys, whether they are core, unit vectors, and these in single precision."""

    key: np.ndarray
    core: np.ndarray
    unit: np.ndarray
    short: np.ndarray


def _block(rows: list[tuple]) -> _Block:
    raw = np.array([v for _, v, _ in rows], np.float64)
    with np.errstate(all="ignore"):
        size = np.sqrt(_dots(raw, raw))
        unit = np.where(((size > 0) | np.isnan(size))[:, None], raw / size[:, None], raw)
    return _Block(np.array([k for k, _, _ in rows], np.int64), np.array([c for _, _, c in rows], bool), unit, unit.astype(np.float32))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of rows, added up in the order of the dimensions, as dot() does."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _within(one: _Block, other: _Block, eps: float) -> Iterator[tuple[int, np.ndarray]]:
    """First row of one, and for some rows from it on whether they and each row of other are within eps.

    A product in single precision decides but for what is near the bound, which is taken again in double precision.
    """
    slack = 4e-7 * (one.unit.shape[1] + 8)
    step = max(1, CELLS // max(1, len(other.key)))
    for lo in range(0, len(one.key), step):
        with np.errstate(all="ignore"):
            product = one.short[lo : lo + step] @ other.short.T
            near = product >= 1 - eps + slack
            i, j = np.nonzero((product >= 1 - eps - slack) & ~near)
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                near[p, q] = 1 - _dots(one.unit[lo + p], other.unit[q]) <= eps
        yield lo, near


def _counted(eps: float):
    """Keys of two blocks, or of one with itself, and how many rows of the other are within eps."""

    def run(one: _Block, other: _Block | None) -> list[np.ndarray]:
        if other is None:
            return [one.key, np.concatenate([near.sum(axis=1) for _, near in _within(one, one, eps)]).astype(np.int64)]
        own, others = [], np.zeros(len(other.key), np.int64)
        for _, near in _within(one, other, eps):
            own.append(near.sum(axis=1))
            others += near.sum(axis=0)
        return [np.concatenate([one.key, other.key]), np.concatenate([*own, others]).astype(np.int64)]

    return run


def _connected(eps: float):
    """Keys a, b of two blocks, or of one with itself: edges that connect the core rows within eps, and other rows within eps of
    a core row, once for each group of connected ones."""

    def run(one: _Block, other: _Block | None) -> list[np.ndarray]:
        own = other is None
        other = one if own else other
        key, core = (one.key, one.core) if own else (np.concatenate([one.key, other.key]), np.concatenate([one.core, other.core]))
        shift = 0 if own else len(one.key)
        root, borders = np.arange(len(key)), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for lo, near in _within(one, other, eps):
            at = slice(lo, lo + len(near))
            apart = near & one.core[at, None] & other.core & (root[at, None] != root[shift : shift + len(other.key)])
            i, j = np.nonzero(apart)
            root = _merged(root, i + lo, j + shift)
            for rows, columns in ((one.core[at], ~other.core), (~one.core[at], other.core)):
                i, j = np.nonzero(near & rows[:, None] & columns)
                borders.append((j + shift, i + lo) if columns is not other.core else (i + lo, j + shift))
        child = np.flatnonzero(core & (root != np.arange(len(key))))
        edge, to = (np.concatenate(x) for x in zip(*borders))
        edge, to = np.unique(np.stack([edge, root[to]]), axis=1)
        return [np.concatenate([key[child], key[edge]]), np.concatenate([key[root[child]], key[to]]), np.repeat([True, False], [len(child), len(edge)])]

    return run


def _merged(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The roots, of which each is its own, with those of i and j joined to the smaller ones."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _block_pairs(units: DataFrame, run: Callable[[_Block, _Block | None], list[np.ndarray]], schema: str) -> DataFrame:
    """What run makes of each pair of blocks of rows a, v, dims, core; vectors are compared with those of as many dimensions."""
    n = units.count()
    blocks = max(1, -(-n // BLOCK), min(4, n // 1000))
    pairs = blocks * (blocks + 1) // 2
    low, high = F.least("block", "with"), F.greatest("block", "with")
    dealt = units.where(~F.exists("v", lambda x: x.isNull())).withColumn("block", F.pmod(F.xxhash64("a", "v"), F.lit(blocks)))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    dealt = dealt.select((high * (high + 1) / 2 + low).cast("long").alias("pair"), "dims", "block", "a", "v", "core")
    dealt = dealt.repartitionById(min(pairs, TASKS), F.pmod("pair", F.lit(min(pairs, TASKS))).cast("int")).sortWithinPartitions("pair", "dims", "block")
    names = [field.split()[0] for field in schema.split(", ")]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def close() -> Iterator[pa.RecordBatch]:
            if at is None:
                return
            pair, _ = at
            high = int((math.isqrt(8 * pair + 1) - 1) // 2)
            found = [_block(part) for part in held.values()]
            if high * (high + 1) // 2 + high == pair:
                out = run(found[0], None)
            elif len(found) == 2:
                out = run(*found)
            else:
                return
            for lo in range(0, len(out[0]), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 10_000]) for x in out], names)

        for batch in batches:
            for pair, dims, block, a, v, core in zip(*(c.to_pylist() for c in batch.columns)):
                if (pair, dims) != at:
                    yield from close()
                    at, held = (pair, dims), {}
                held.setdefault(block, []).append((a, v, core))
        yield from close()

    return dealt.mapInArrow(compared, schema)


def _cut(frame: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a checkpoint in the folder that the session names."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = frame.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestar-"))
    return frame.checkpoint()

"""Connected components of a graph too large for one machine.

Every round deals the edges by their larger node, joins what meets in a partition with a union-find,
lets each node keep its smallest root, and carries on with the edges between roots that disagree.
Leaves of a hub are settled at once and never dealt by the hub's key, so that a component with most of
the nodes does not meet in one task. The state of each round is a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import kept, scratch, stored
from ._text import tidy


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that are not the smallest of their component, with that smallest node."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            break
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
        size += batch.num_rows
        if size > 400_000 and len(held) > 1:  # keep what is held near one edge a node
            held = [forest(*(np.concatenate(x) for x in zip(*held)))]
            size = len(held[0][0]) // 2
    if held:
        nodes, roots = forest(*(np.concatenate(x) for x in zip(*held)))
        for at in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 100_000], pa.int64()), pa.array(roots[at : at + 100_000], pa.int64())], ["node", "root"])


_STARS = "node long, root long"


def contracted(edges: DataFrame) -> DataFrame:
    """node, root: within each partition a star for each component of its edges; no shuffle."""
    return edges.mapInArrow(tidy(_local), _STARS)


def components(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node it is linked with, for each node that is not itself the smallest.

    edges has two long columns; nulls are not allowed, loops and repeats are. An empty frame has no components.
    """
    with scratch():
        return kept(_components(edges))


def _components(edges: DataFrame) -> DataFrame:
    left, right = edges.columns
    edges = contracted(edges.select(F.greatest(left, right).alias("node"), F.least(left, right).alias("root")))
    found: DataFrame | None = None
    while True:
        stars = stored(contracted(edges.repartition("node")), "stars")
        low = stars.groupBy("node").agg(F.min("root").alias("component"), F.max("root").alias("top"))
        split = stored(low, "roots")
        torn = split.where("component <> top").select("node", "component")
        parents = _flattened(split)
        rest = stars.join(torn, "node").where("root <> component").select(F.col("root").alias("a"), F.col("component").alias("b"))
        if found is None:
            found = parents
        else:
            moved = found.join(parents.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left")
            found = stored(moved.select("node", F.coalesce("_to", "component").alias("component")).unionByName(parents), "components")
        if torn.isEmpty():
            return found
        for end in ("a", "b"):
            rest = rest.join(parents.select(F.col("node").alias(end), F.col("component").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        rest = rest.where("a <> b")
        if rest.isEmpty():
            return found
        edges = contracted(rest.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")))


def _flattened(roots: DataFrame) -> DataFrame:
    """Follows the stored roots until each node points to one that has none itself; a stored frame."""
    parents = roots.select("node", "component")
    parents._stored_at = roots._stored_at
    while True:
        deeper = parents.join(parents.select(F.col("node").alias("component"), F.col("component").alias("_up")), "component", "left")
        if deeper.where("_up is not null").isEmpty():
            return parents
        parents = stored(deeper.select("node", F.coalesce("_up", "component").alias("component")), "parents")

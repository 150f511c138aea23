"""Exact links within regions of candidates, however large a region is.

A region is a group of nodes outside which its nodes have no link. Its nodes are dealt into chunks of a
bounded weight. In a chunk a node is compared with the nodes not yet joined to it, so that a region
whose nodes are mostly linked takes few comparisons and gives one edge a node, never all pairs. Some
nodes of a large region, its pivots, go into all its chunks and join them. Nodes that are then outside
the region's largest component are compared with all nodes that they may be linked with, in blocks: with those of
the other chunks, or, where the caller can part a large region into smaller groups outside which there are no links
(a node may be in several), with those of their groups. So no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import kept, scratch, stored
from ._text import tidy
from .components import components

PIVOTS = 4
#: Candidates that are held at a time; how many times the weight of a chunk a task may hold of a part of a region, since
#: rows are repeated with the square of the chunks.
HELD, WIDE = 200_000, 4
#: Members below which a group is small, and characters or bytes of payloads of small groups that are compared together.
SMALL, BUNCH = 64, 1 << 20
_EDGES = "a long, b long"


class Pairs(NamedTuple):
    """The links of a group's objects, found among pairs. near: for whether each is active, all pairs i, j that may be linked, i
    active, each pair of active ones once, the likeliest of each i first; test: which pairs i, j are linked."""

    near: Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]
    test: Callable[[np.ndarray, np.ndarray], np.ndarray]


#: What a batch of payloads becomes, an object a row; for the objects of a group, the link test of one with others, or Pairs.
Load = Callable[[pa.Array], list]
Linked = Callable[[list], Callable[[int, np.ndarray], np.ndarray] | Pairs]
#: For the objects of many small groups, and the number of the group of each, in order: their Pairs, none of different groups.
Bunched = Callable[[list, np.ndarray], Pairs]
#: For a frame with the column id: id and group (long), a row for each group that a node is in.
Regroup = Callable[[DataFrame], DataFrame]


def _joins(items: list, active: np.ndarray, label: np.ndarray, linked: Linked) -> Iterator[tuple[int, int]]:
    """Links that join what has different labels, until all active items have been compared with all that is not joined to them.

    An item is compared with a few others first, then with more: what those are joined to need not be compared any more.
    """
    test = linked(items)
    if isinstance(test, Pairs):
        yield from _pair_joins(test, active, label)
        return
    for i in np.flatnonzero(active):
        other = np.flatnonzero(label != label[i])
        if not len(other):
            return
        other = other[(other > i) | ~active[other]]
        step = 4
        while len(other):
            part, other = other[:step], other[step:]
            for j in part[test(i, part)]:
                if label[j] != label[i]:
                    yield i, j
                    label[label == label[j]] = label[i]
            other = other[label[other] != label[i]]
            step *= 4


def _pair_joins(pairs: Pairs, active: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, int]]:
    """_joins() by pairs: of each item the likeliest first, then more of what is not joined yet."""

    def joined(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
        i, j = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(i, kind="stable")
        i, j, most = i[order], j[order], 1
        while True:
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            if not len(i):
                return
            first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            now = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < most
            yes = np.flatnonzero(now)[pairs.test(i[now], j[now])]
            for a, b in zip(i[yes].tolist(), j[yes].tolist()):
                if label[a] != label[b]:
                    yield a, b
                    label[label == label[b]] = label[a]
            i, j, most = i[~now], j[~now], most * 4

    held, size = [], 0
    for i, j in pairs.near(active):
        apart = label[i] != label[j]
        held.append((i[apart], j[apart]))
        size += len(held[-1][0])
        if size > HELD:
            yield from joined(held)
            held, size = [], 0
    if size:
        yield from joined(held)


def _compare(load: Load, linked: Linked, bunched: Bunched | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (region, chunk, block, active, known, id, payload) in the order of the first three. bunched: small groups are compared
    many at a time; a label that several of them have is of one component, so that what joins it in one does in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, bool, int, object]] = []
        at = None
        out: list[tuple[int, int]] = []
        bunch: list[tuple[int, bool, int, object]] = []
        sizes: list[int] = []
        held = weight = 0

        def close() -> None:
            nonlocal held, weight
            if bunched is not None and 1 < len(group) < SMALL:
                bunch.extend(group)
                sizes.append(len(group))
                held += weight
                if held > BUNCH:
                    together()
            elif len(group) > 1:
                ids, active, known, items = zip(*group)
                for i, j in _joins(list(items), np.array(active), np.array(known), linked):
                    out.append((ids[i], ids[j]))
            group.clear()
            weight = 0

        def together() -> None:
            nonlocal held
            if bunch:
                ids, active, known, items = zip(*bunch)
                pairs = bunched(list(items), np.repeat(np.arange(len(sizes)), sizes))
                for i, j in _pair_joins(pairs, np.array(active), np.array(known)):
                    out.append((ids[i], ids[j]))
            bunch.clear(), sizes.clear()
            held = 0

        def edges() -> pa.RecordBatch:
            a, b = zip(*out) if out else ((), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                keys = list(zip(*(part.column(k).to_pylist() for k in range(3))))
                size = pc.binary_length(part.column(6)).to_pylist() if bunched is not None else [0] * len(keys)
                rows = zip(part.column(5).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), load(part.column(6)), size)
                for key, (node, active, known, item, n) in zip(keys, rows):
                    if key != at:
                        close()
                        at = key
                    group.append((node, active, known, item))
                    weight += n + 256
            if len(out) > 10_000:
                yield edges()
        close()
        together()
        yield edges()

    return run


def _run(deal: DataFrame, attach: Callable[[DataFrame], DataFrame], load: Load, linked: Linked, bunched: Bunched | None) -> DataFrame:
    rows = attach(deal).select("region", "chunk", "block", "active", "known", "id", "payload")
    keys = ["region", "chunk", "block"]
    return stored(rows.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(tidy(_compare(load, linked, bunched)), _EDGES), "links")


def links(members: DataFrame, attach: Callable[[DataFrame], DataFrame], load: Load, linked: Linked, chunk: int, regroup: Regroup | None = None, bunched: Bunched | None = None) -> DataFrame:
    """Edges a, b that connect what the links connect.

    members: region, id, weight (long), none of them null; stored, and so may be empty. attach adds the column payload
    to a frame with the column id. chunk: the weight that a task may hold of a region; one node may weigh more.
    """
    with scratch():
        return _links(members, attach, load, linked, chunk, regroup, bunched)


def _links(members: DataFrame, attach: Callable[[DataFrame], DataFrame], load: Load, linked: Linked, chunk: int, regroup: Regroup | None, bunched: Bunched | None) -> DataFrame:
    large = stored(members.groupBy("region").agg(F.sum("weight").alias("_w")).where(F.col("_w") > chunk).select("region", F.ceil(F.col("_w") / chunk).alias("chunks")), "large")
    deal = members.join(large, "region", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    deal = deal.withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks")).withColumn("block", F.lit(0).cast("long")).withColumn("active", F.lit(True)).withColumn("known", F.col("id"))
    if large.isEmpty():
        return kept(_run(deal, attach, load, linked, bunched))
    deal = stored(deal, "deal")
    nth = Window.partitionBy("region").orderBy("id")
    pivots = deal.where("chunks > 1").withColumn("_n", F.row_number().over(nth)).where(F.col("_n") <= PIVOTS).drop("_n")
    pivots = pivots.withColumn("_to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).where("_to <> chunk").withColumn("chunk", F.col("_to")).drop("_to")
    first = kept(_run(deal.unionByName(pivots), attach, load, linked, bunched))

    joined = components(first)
    nodes = deal.where("chunks > 1").drop("known").join(joined.select(F.col("node").alias("id"), F.col("component").alias("known")), "id", "left").withColumn("known", F.coalesce("known", "id"))
    nodes = stored(nodes, "joined")
    main = nodes.groupBy("region", "known").agg(F.count("*").alias("_n")).groupBy("region").agg(F.max_by("known", F.struct("_n", "known")).alias("_main"))
    nodes = nodes.join(main, "region").select("region", "id", "weight", "known", (F.col("known") != F.col("_main")).alias("active"))
    if regroup is not None:
        ids = stored(nodes.select("id"), "ids")
        nodes = nodes.drop("region").join(regroup(ids).select("id", F.col("group").alias("region")), "id")
        chunk *= WIDE
    nodes = stored(nodes, "groups")
    total = nodes.groupBy("region").agg(F.sum("weight").alias("_all"), F.sum(F.when(F.col("active"), F.col("weight"))).alias("_some"), F.min("known").alias("_low"), F.max("known").alias("_high"))
    total = stored(total.where("_some is not null and _low <> _high").select("region", F.ceil(F.col("_all") / chunk).alias("chunks"), F.ceil(F.col("_some") / chunk).alias("blocks")), "sizes")
    if total.isEmpty():
        return first
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    nodes = nodes.join(total, "region")
    asked = nodes.where("active").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), "blocks")).withColumn("chunk", each("chunks"))
    held = nodes.where("not active or chunks > 1").withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks")).withColumn("block", each("blocks")).withColumn("active", F.lit(False))
    columns = ["region", "chunk", "block", "active", "known", "id"]
    return first.unionByName(kept(_run(asked.select(columns).unionByName(held.select(columns)), attach, load, linked, bunched)))

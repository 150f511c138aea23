"""MinHash near-duplicates by an LSH forest, with links confirmed on the full shingle sets.

A-Z become lower case; words are runs of anything but space, tab and the line ends \\x0A-\\x0D. A document's
set holds its distinct runs of five words, or its whole sequence if it has fewer; without words the set is
empty and linked with nothing. Two sets are linked if 100 * intersection >= percent * union.

Documents with equal sets are one node. A node's signature is a byte of each of ORDERS * STRIDE minimum hashes. The
forest has ORDERS orders; in each, nodes are sorted by a label of DEPTH[1] hashes of the signature, which begins
STRIDE hashes later than in the order before. Neighbours in an order are candidates if their longest common prefix has
the depth of their region, which is DEPTH[0] where few nodes share a prefix of that length; a region of more
than DENSE nodes is parted at one hash more, and so on down to DEPTH[1]. A pair at the threshold of 0.85 is no
candidate with a chance below 1e-9 in a sparse region and 1e-8 in a dense one (at 0.80: 1e-8 and 2e-5), if the orders
were independent. What the candidates connect goes to regions.links(), which first compares the whole signatures and
leaves apart what is five standard deviations below the threshold, then compares the full sets within what stays
connected.

Rows with a null doc_id come back with a null component_id, as kept. Rows that share a doc_id are one
document: they have one component. Null text is empty text. Ids must be of an integer type. Very long texts are taken
whole; ties do not occur, as links are a threshold on whole sets. An empty table has no rows. Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared
from ._shared import kept, long_id, scratch, stored
from ._text import LOWER, NONSPACE, mix, pieces, rows_of, run_hashes, tidy, whole_hash, word_bounds, word_hashes
from .components import components
from .neighbours import neighbour_edges
from .regions import links

ORDERS, STRIDE, DEPTH, SHINGLE = 48, 4, (5, 7), 5
HASHES = ORDERS * STRIDE
#: Nodes with a common prefix beyond which the next hash parts them.
DENSE = 16
#: Shingles, and signatures, that a task may hold of a region.
CHUNK, CHUNK_NODES = 500_000, 2_000
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of rows: hashes of all shingles, repeats included, and each row's bounds in them."""
    for _, _, data, offsets in pieces(column):
        data = LOWER[data]
        starts, ends = word_bounds(data, offsets, NONSPACE)
        words = word_hashes(data, starts, ends)
        bounds = np.searchsorted(starts, offsets)
        count = np.diff(bounds)
        runs = run_hashes(words, SHINGLE)
        fits = np.arange(len(runs)) + SHINGLE <= bounds[rows_of(offsets, starts) + 1][: len(runs)]
        short = np.flatnonzero((count > 0) & (count < SHINGLE))
        size = np.where(count >= SHINGLE, count - SHINGLE + 1, (count > 0).astype(count.dtype))
        out_bounds = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(out_bounds[-1], np.uint64)
        is_short = np.zeros(len(out), bool)
        is_short[out_bounds[short]] = True
        out[~is_short] = runs[fits]
        for r in short:
            out[out_bounds[r]] = whole_hash(words[bounds[r] : bounds[r + 1]])
        yield out, out_bounds


def sets(column: pa.Array) -> list[np.ndarray]:
    """The set of each row, as sorted hashes."""
    out = []
    for hashes, bounds in shingles(column):
        out += [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """rows x HASHES: a byte of each minimum hash of the rows, none of which is empty."""
    out = np.empty((len(bounds) - 1, HASHES), np.uint8)
    for k in range(HASHES):
        least = np.minimum.reduceat((hashes ^ _XOR[k]) * _ODD[k], bounds[:-1])
        out[:, k] = (least >> np.uint64(56)) ^ (least & np.uint64(255))
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, two sums over the set, and the signature."""
    for batch in batches:
        row = 0
        for hashes, bounds in shingles(batch.column(1)):
            rows = len(bounds) - 1
            distinct, size = [], np.zeros(rows, np.int64)
            for r in range(rows):
                s = np.sort(hashes[bounds[r] : bounds[r + 1]])
                s = s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s
                size[r] = len(s)
                distinct.append(s)
            flat = np.concatenate(distinct)
            full = np.flatnonzero(size)
            at = np.concatenate([[0], np.cumsum(size[full])])
            sums = np.zeros((2, rows), np.uint64)
            bytes_ = np.zeros((rows, HASHES), np.uint8)
            if len(full):
                sums[0, full] = np.add.reduceat(flat, at[:-1])
                sums[1, full] = np.add.reduceat(mix(flat), at[:-1])
                bytes_[full] = signatures(flat, at)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, rows), pa.array(size), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array([x.tobytes() for x in bytes_], pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "sketch"])
            row += rows


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node and order: the order's number and DEPTH[1] bytes of the signature as one number, and the node."""
    first = np.arange(ORDERS) * STRIDE
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            rows = np.stack(sketches(part.column(1)))
            label = np.broadcast_to(np.arange(ORDERS, dtype=np.int64), (len(rows), ORDERS))
            for k in range(DEPTH[1]):
                label = label << 8 | rows[:, (first + k) % HASHES]
            yield pa.RecordBatch.from_arrays([pa.array(label.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), ORDERS))], ["label", "id"])


def forest_neighbours(labels: np.ndarray) -> np.ndarray:
    """For sorted labels: whether each, but the first, shares with the one before a prefix of its region's depth."""
    differ = (labels[1:] ^ labels[:-1]).view(np.uint64)
    common = np.full(len(differ), -1)  # bytes in common after the order's number; -1 if that differs
    for k in range(DEPTH[1] + 1):
        common += differ < np.uint64(1) << np.uint64(8 * (DEPTH[1] - k))
    need = np.full(len(differ), DEPTH[0])
    for depth in range(DEPTH[0], DEPTH[1]):
        region = np.concatenate([[0], np.cumsum(common < depth)])
        dense = np.bincount(region)[region[1:]] > DENSE
        need[(need == depth) & (common >= depth) & dense] = depth + 1
    return common >= need


def sketches(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8) for x in column.to_pylist()]


def alike(percent: int):
    """The link test for signatures of a byte a hash: not far below the threshold."""
    p, k = percent / 100, HASHES
    least = int(k * (p - 5 * (p * (1 - p) / k) ** 0.5))

    def group(items: list[np.ndarray]):
        rows = np.stack(items)
        return lambda i, others: (rows[others] == rows[i]).sum(axis=1) >= least

    return group


def linked(percent: int):
    """The link test for sets as sorted hashes."""

    def group(items: list[np.ndarray]):
        sizes = np.array([len(x) for x in items])

        def test(i: int, others: np.ndarray) -> np.ndarray:
            one, size = items[i], sizes[others]
            out = np.zeros(len(others), bool)
            near = np.flatnonzero((size > 0) & (100 * np.minimum(size, len(one)) >= percent * np.maximum(size, len(one))))
            for lo in range(0, len(near), 1024):
                part = near[lo : lo + 1024]
                flat = np.concatenate([items[k] for k in others[part]])
                found = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
                common = np.add.reduceat(found, np.concatenate([[0], np.cumsum(size[part])[:-1]]), dtype=np.int64)
                out[part] = 100 * common >= percent * (len(one) + size[part] - common)
            return out

        return test

    return group


def _regions(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """region, id and weight of what the edges connect."""
    found = components(edges).select(F.col("node").alias("id"), F.col("component").alias("region"))
    return found.unionByName(found.select(F.col("region").alias("id"), "region").distinct()).join(weights, "id")


def near_duplicates(docs: DataFrame, percent: int = 85, chunk: int = CHUNK, chunk_nodes: int = CHUNK_NODES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document."""
    with scratch():
        return _near_duplicates(docs.select(long_id(docs), "text"), percent, chunk, chunk_nodes)


def _near_duplicates(docs: DataFrame, percent: int, chunk: int, chunk_nodes: int) -> DataFrame:
    table = kept(stored(docs.mapInArrow(tidy(_signed), "doc_id long, n_shingles long, h1 long, h2 long, sketch binary"), "signatures"))
    named = table.where("doc_id is not null and n_shingles > 0")
    same = ["n_shingles", "h1", "h2"]
    nodes = kept(stored(named.groupBy(*same).agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch"), (F.min("doc_id") < F.max("doc_id")).alias("many")), "nodes"))

    candidates = neighbour_edges(nodes.select("id", "sketch").mapInArrow(tidy(_labels), "label long, id long"), forest_neighbours)
    near = stored(_regions(candidates, nodes.select("id", F.lit(1).cast("long").alias("weight"))), "near")
    tight = links(near, lambda deal: nodes.select("id", F.col("sketch").alias("payload")).join(deal, "id"), sketches, alike(percent), chunk_nodes)
    members = stored(_regions(tight, nodes.select("id", F.col("n_shingles").alias("weight"))), "members")
    one_text = docs.where("doc_id is not null").withColumnRenamed("doc_id", "id").withColumnRenamed("text", "payload")

    def attach(deal: DataFrame) -> DataFrame:
        return one_text.join(F.broadcast(deal) if deal.count() * 64 <= _shared.BROADCAST_BYTES else deal, "id")

    edges = links(members, attach, sets, linked(percent), chunk)
    # rows that share a doc_id are one document
    ids = named.groupBy("doc_id").agg(F.min(F.struct(*same)).alias("a"), F.max(F.struct(*same)).alias("b")).where("a <> b").select("doc_id")
    shared = named.join(ids, "doc_id").join(nodes.select(*same, "id"), same).where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    found = kept(components(edges.unionByName(shared)))

    rep = named.select("doc_id", *same).join(nodes.where("many").select(*same, "id"), same).where("doc_id <> id").select("doc_id", "id")
    joined = found.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    through = rep.join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("doc_id", F.coalesce("component", "id").alias("component_id"))
    class_of = joined.unionByName(through).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = table.select("doc_id", "n_shingles").join(class_of, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents kept, with their own columns; a null doc_id is kept. Of rows that share a doc_id all or none stay."""
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)

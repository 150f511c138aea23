"""Edges between neighbours of one sorted order, however many rows share a label.

Rows are dealt by ranges of (label, id), so rows of one label may lie in several tasks. The rows on both
sides of a border between tasks, two a task, are linked by the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._shared import kept, scratch, stored
from ._text import tidy

#: Rows that are held at a time.
SLAB = 1_000_000
#: For sorted labels: whether each of them, but the first, is linked with the one before it.
Linked = Callable[[np.ndarray], np.ndarray]


def neighbour_edges(rows: DataFrame, linked: Linked, slab: int = SLAB, labelled: bool = False) -> DataFrame:
    """a, b: the ids of neighbours by (label, id) that are linked; labelled: and the label of a. rows: label long, id long; no nulls."""
    names = ["a", "b", "part", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, begun = 0, False

        def border(label: int, node: int, last: bool) -> pa.RecordBatch:
            """Of a border row: its id as a if it is the task's first, as b if it is the last."""
            return pa.RecordBatch.from_arrays([pa.array([None if last else node], pa.int64()), pa.array([node if last else None], pa.int64()), pa.array([part], pa.int32()), pa.array([label], pa.int64())], names)

        def edges() -> Iterator[pa.RecordBatch]:
            nonlocal size
            label, node = (np.concatenate(x) for x in zip(*held))
            held[:] = [(label[-1:], node[-1:])]  # the next slab goes on from it
            size = 1
            at = np.flatnonzero(linked(label) & (node[1:] != node[:-1]))
            a, b = pa.array(node[at + 1]), pa.array(node[at])
            yield pa.RecordBatch.from_arrays([a, b, pa.nulls(len(at), pa.int32()), pa.array(label[at + 1]) if labelled else pa.nulls(len(at), pa.int64())], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            label, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not begun:
                yield border(int(label[0]), int(node[0]), False)
                begun = True
            held.append((label, node))
            size += len(label)
            if size >= slab:
                yield from edges()
        if begun:
            yield from edges()
            yield border(int(held[0][0][0]), int(held[0][1][0]), True)

    with scratch():
        dealt = rows.select("label", "id").repartitionByRange("label", "id").sortWithinPartitions("label", "id")
        found = kept(stored(dealt.mapInArrow(tidy(run), "a long, b long, part int, label long"), "neighbours"))
    ends = found.where("part is not null").collect()
    firsts, lasts = {r["part"]: r for r in ends if r["a"] is not None}, {r["part"]: r for r in ends if r["b"] is not None}
    order = sorted(firsts)
    across = [(firsts[q]["a"], lasts[p]["b"], firsts[q]["label"]) for p, q in zip(order, order[1:]) if firsts[q]["a"] != lasts[p]["b"] and linked(np.array([lasts[p]["label"], firsts[q]["label"]]))[0]]
    edges_ = found.where("part is null").select("a", "b", "label")
    edges_ = edges_.unionByName(rows.sparkSession.createDataFrame(across, "a long, b long, label long")) if across else edges_
    return edges_ if labelled else edges_.drop("label")


def equal(labels: np.ndarray) -> np.ndarray:
    """Linked if the labels are the same."""
    return labels[1:] == labels[:-1]

"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

A-Z become lower case; words are runs of digits, letters a-z and code points beyond ASCII. Every run
of n words of a benchmark item is a window (an item with fewer words is one window). The windows'
hashes are broadcast, the token windows of every document are looked up in them, hits are confirmed
on the words themselves, and the spans or the documents are removed.

The benchmark is taken in blocks of max_windows windows at most, so what is broadcast has a bound
whatever the benchmark's size; every block is held against all documents.

Null or empty text has no words and no hits. An item without words has no window. Repeated items are
separate items; equal item_ids count once. Items with a null item_id never occur. Very long texts are scanned whole, in
pieces. Repeated documents get equal results. An empty table has no rows, and without a benchmark nothing is hit. Columns
other than text are passed through; scan() names its own with underscores if the name is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import stored, unused
from ._text import ALNUM, LOWER, pieces, rows_of, run_hashes, tidy, word_bounds, word_hashes

_BITS = 20
#: What scan() adds.
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.LongType())),
        T.StructField("hit_bytes", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _words(text: str | None) -> tuple[np.ndarray, list[bytes]]:
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends = word_bounds(data, np.array([0, len(data)]), ALNUM)
    return word_hashes(data, starts, ends), [data[s:e].tobytes() for s, e in zip(starts, ends)]


def windows(items: list[tuple[object, str | None]], n: int) -> dict[int, dict[int, list[tuple[bytes, str]]]]:
    """length -> hash -> the windows of that length and hash, with the item of each."""
    out: dict[int, dict[int, list[tuple[bytes, str]]]] = {}
    for item, text in items:
        hashes, words = _words(text)
        if not words or item is None:
            continue
        length = min(n, len(words))
        for i, h in enumerate(run_hashes(hashes, length).tolist()):
            entry = (b" ".join(words[i : i + length]), str(item))
            held = out.setdefault(length, {}).setdefault(h, [])
            if entry not in held:
                held.append(entry)
    return out


def _blocks(benchmark: DataFrame, n: int, max_windows: int) -> Iterator[dict]:
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "") // 2 + 1  # as many words at most
        if size >= max_windows:
            yield windows(block, n)
            block, size = [], 0
    if block:
        yield windows(block, n)


class _Lookup:
    def __init__(self, table: dict[int, dict[int, list[tuple[bytes, str]]]]) -> None:
        self.lengths = []
        for length, entries in sorted(table.items()):
            keys = np.array(sorted(entries), np.uint64)
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[keys >> np.uint64(64 - _BITS)] = True
            self.lengths.append((length, keys, bitmap, entries))

    def hits(self, hashes: np.ndarray, room: np.ndarray, spell) -> Iterator[tuple[int, int, list[str]]]:
        """Position, length and items of each occurrence; room: words from a position to its text's end."""
        for length, keys, bitmap, entries in self.lengths:
            runs = run_hashes(hashes, length)
            near = np.flatnonzero(bitmap[runs >> np.uint64(64 - _BITS)] & (room[: len(runs)] >= length))
            at = np.searchsorted(keys, runs[near])
            for i in near[keys[np.minimum(at, len(keys) - 1)] == runs[near]].tolist():
                said = spell(i, length)
                if items := [item for text, item in entries[int(runs[i])] if text == said]:
                    yield i, length, items


def _scan_batch(column: pa.Array, lookup: _Lookup) -> tuple[list, list, list, list]:
    n_words, hit_words, hit_bytes, items = [], [], [], []
    for _, _, data, offsets in pieces(column):
        data = LOWER[data]
        starts, ends = word_bounds(data, offsets, ALNUM)
        bounds = np.searchsorted(starts, offsets)
        row = rows_of(offsets, starts)
        room = bounds[row + 1] - np.arange(len(starts))
        found: dict[int, tuple[set, set]] = {}
        spell = lambda i, length: b" ".join(data[s:e].tobytes() for s, e in zip(starts[i : i + length], ends[i : i + length]))  # noqa: B023, E731
        for i, length, who in lookup.hits(word_hashes(data, starts, ends), room, spell):
            words, named = found.setdefault(int(row[i]), (set(), set()))
            words.update(range(i, i + length))
            named.update(who)
        for r, count in enumerate(np.diff(bounds).tolist()):
            words, named = found.get(r, ((), ()))
            at = sorted(words)
            n_words.append(count)
            hit_words.append([i - int(bounds[r]) for i in at])
            hit_bytes.append([int(x - offsets[r]) for i in at for x in (starts[i], ends[i])])
            items.append(sorted(named))
    return n_words, hit_words, hit_bytes, items


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = 1_000_000, text: str = "text", found: str = "_found") -> DataFrame:
    """docs with a struct column of the words hit: their numbers, their bytes (start, end by turns), the items."""
    spark, found = docs.sparkSession, unused(docs, found)
    out, blocks = docs, 0
    for table in _blocks(benchmark, n, max_windows):
        held = spark.sparkContext.broadcast(table)
        if blocks:
            out = stored(out, "decontaminate")
        out = _scan_block(out, held, text, found, blocks > 0)
        blocks += 1
    return out if blocks else _scan_block(docs, spark.sparkContext.broadcast({}), text, found, False)


def _scan_block(docs: DataFrame, held, text: str, found: str, again: bool) -> DataFrame:
    schema = T.StructType([*(f for f in docs.schema.fields if not again or f.name != found), T.StructField(found, FOUND)])
    at = [f.name for f in docs.schema.fields].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(held.value)
        for batch in batches:
            n_words, hit_words, hit_bytes, items = _scan_batch(batch.column(at), lookup)
            columns, names = list(batch.columns), list(batch.schema.names)
            if again:
                for r, old in enumerate(columns.pop().to_pylist()):
                    both = {**dict(zip(old["hit_words"], zip(old["hit_bytes"][::2], old["hit_bytes"][1::2]))), **dict(zip(hit_words[r], zip(hit_bytes[r][::2], hit_bytes[r][1::2])))}
                    hit_words[r] = sorted(both)
                    hit_bytes[r] = [x for k in hit_words[r] for x in both[k]]
                    items[r] = sorted({*items[r], *old["items"]})
                names.pop()
            longs = pa.list_(pa.int64())
            added = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(hit_words, longs), pa.array(hit_bytes, longs), pa.array(items, pa.list_(pa.string()))], ["n_words", "hit_words", "hit_bytes", "items"])
            yield pa.RecordBatch.from_arrays([*columns, added], [*names, found])

    return docs.mapInArrow(tidy(run), schema)


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, for every document."""
    seen = scan(docs.select("doc_id", "text"), benchmark, n)
    return seen.select(
        "doc_id",
        F.col("_found.n_words").alias("n_words"),
        F.size("_found.hit_words").cast("long").alias("n_hit"),
        F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_found.hit_words") > 0).alias("contaminated"),
    )


def drop_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents without a hit, with their own columns."""
    found = unused(docs, "_found")
    return scan(docs, benchmark, n, found=found).where(F.size(f"{found}.hit_words") == 0).drop(found)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """All documents, with every run of hit words cut out of text; the rest stays as it was."""
    names = docs.columns
    schema, at = docs.schema, names.index("text")

    def cut(text: str | None, spans: list[int]) -> str | None:
        if text is None or not spans:
            return text
        raw, out, last = text.encode(), [], 0
        for s, e in zip(spans[::2], spans[1::2]):
            if s > last or not out:
                gap = raw[last:s]
                if not out or any(ALNUM[b] for b in gap):
                    out.append(gap)
            last = e
        return b"".join([*out, raw[last:]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            spans = pc.struct_field(columns.pop(), "hit_bytes").to_pylist()
            columns[at] = pa.array([cut(t, s) for t, s in zip(columns[at].to_pylist(), spans)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return scan(docs, benchmark, n, found=unused(docs, "_found")).mapInArrow(run, schema)


def digest(items: list[str]) -> str:
    """The items_sha256 of these item ids."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()

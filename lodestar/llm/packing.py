"""Lexical retrieval packing: unused BM25 neighbours of a seed document fill its window.

A document is its token ids and an end id. Documents are put in the order of several minimum hashes of
their ids, so that those with ids in common come together, and dealt by ranges of that order; a range is
cut into shards of about SHARD ids, or PIECES documents. Each shard has an inverted index of BM25 weights, whose document frequencies and
mean length are those of all documents. A seed, the rest of the document cut last or else the first unused
one, asks the index; unused documents fill the window by falling score, and the last is cut where the
window ends. A document longer than a window first gives windows of its own. What a shard leaves open goes on
into the next; what a range leaves at its end is cut into sequences of powers of two. So nothing is padded.

A null or empty text is its end id alone. Null and repeated doc_ids are kept as they are; each row is packed. Equal scores
are taken in the order of the shard. An empty table has no sequences. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import stored
from ._text import tidy
from .tokens import REMEMBERED, encoder

WINDOW, END = 4096, 2
#: Ids and documents of a shard, ids of a range, and ranges at most.
SHARD, PIECES, RANGE, RANGES = 600_000, 5_000, 8_000_000, 20_000
K1, B = 1.2, 0.75
_rng = np.random.default_rng(7)
_ORDERS = [_rng.permutation(1 << 16).astype(np.uint16) for _ in range(3)]
Piece = tuple[int, int, int]  # document, start, length


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenized(docs: DataFrame, path: str, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, ids (16-bit, with the end id), n of them, key; for each row of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, remembered).encode, np.array([END], "<u2").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = [encode(text or "") + end for text in part.column(1).to_pylist()]
                keys = []
                for x in ids:
                    row = np.frombuffer(x, "<u2")
                    keys.append(int(_ORDERS[0][row].min()) << 47 | int(_ORDERS[1][row].min()) << 31 | int(_ORDERS[2][row].min()) << 15)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(keys, pa.int64())], ["doc_id", "ids", "n", "key"])

    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 15))  # copies need not meet
    return docs.select("doc_id", "text").mapInArrow(tidy(run, lambda: None), f"doc_id {kind}, ids binary, n long, key long").withColumn("key", F.col("key") + spread)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, last, places = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.arange(1 << 12)
    for batch in batches:
        for x in batch.column(0):
            ids = np.frombuffer(x.as_buffer(), "<u2")
            if len(ids) > len(places):
                places = np.arange(2 * len(ids))
            own = places[: len(ids)]
            last[ids] = own  # of equal ids one place is left
            df[ids[last[ids] == own]] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], ["term", "df"])


class Shard:
    """Pieces with a BM25 index over them."""

    def __init__(self, pieces: list[Piece], ids: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.pieces, self.unused = list(pieces), np.ones(len(pieces), bool)
        self.terms, terms, tf = [], [], []
        for doc, start, length in pieces:
            run = np.sort(ids[doc][start : start + length], kind="stable")
            new = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            self.terms.append(run[new])
            terms.append(run[new])
            tf.append(np.diff(np.append(new, length)))
        count = np.array([len(t) for t in terms])
        size = np.array([length for _, _, length in pieces])
        self._term = np.concatenate(terms)
        tf_all = np.concatenate(tf).astype(np.float32)
        norm = np.repeat(K1 * (1 - B + B * size / mean), count).astype(np.float32)
        self._weight = idf[self._term] * tf_all * np.float32(K1 + 1) / (tf_all + norm)
        self._piece = np.repeat(np.arange(len(pieces), dtype=np.int32), count)
        self._sort()

    def _sort(self) -> None:
        order = np.argsort(self._term, kind="stable")
        self._term, self._weight, self._piece = self._term[order], self._weight[order], self._piece[order]
        self._first = np.searchsorted(self._term, np.arange((1 << 16) + 1))
        self._free = self._live = int(self.unused.sum())

    def use(self, at: int) -> None:
        self.unused[at] = False
        self._free -= 1
        if self._free * 2 < self._live:
            keep = self.unused[self._piece]
            self._term, self._weight, self._piece = self._term[keep], self._weight[keep], self._piece[keep]
            self._sort()

    def neighbours(self, terms: np.ndarray) -> np.ndarray:
        """Unused pieces by falling score, then place."""
        first = self._first[terms]
        count = self._first[terms.astype(np.int64) + 1] - first
        total = np.cumsum(count)
        at = np.arange(total[-1]) + np.repeat(first - (total - count), count)
        score = np.bincount(self._piece[at], self._weight[at], minlength=len(self.pieces))
        free = np.flatnonzero(self.unused)
        return free[np.argsort(-score[free], kind="stable")]


def pack_shard(pieces: list[Piece], ids: list[np.ndarray], idf: np.ndarray, mean: float) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows, and the pieces of the window left open."""
    full: list[list[Piece]] = []
    pool: list[Piece] = []
    for doc, start, length in pieces:
        while length >= WINDOW:
            full.append([(doc, start, WINDOW)])
            start, length = start + WINDOW, length - WINDOW
        if length:
            pool.append((doc, start, length))
    if not pool:
        return full, []
    shard = Shard(pool, ids, idf, mean)
    rest: tuple[Piece, np.ndarray] | None = None
    left = sum(length for _, _, length in pool)
    at = 0
    while left >= WINDOW:
        if rest is None:
            while not shard.unused[at]:
                at += 1
            shard.use(at)
            rest = (shard.pieces[at], shard.terms[at])
        window, terms = [rest[0]], rest[1]
        room, rest = WINDOW - rest[0][2], None
        while room:
            for k in shard.neighbours(terms).tolist():
                doc, start, length = shard.pieces[k]
                shard.use(k)
                window.append((doc, start, min(length, room)))
                if length > room:
                    rest = ((doc, start + room, length - room), shard.terms[k])
                room -= min(length, room)
                if not room:
                    break
        full.append(window)
        left -= WINDOW
    return full, [*([rest[0]] if rest else []), *(shard.pieces[k] for k in np.flatnonzero(shard.unused).tolist())]


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Sequences of falling powers of two, of less than WINDOW ids in all."""
    left = sum(length for _, _, length in pieces)
    out, pieces = [], list(pieces)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        sequence: list[Piece] = []
        while room:
            doc, start, length = pieces.pop(0)
            take = min(length, room)
            sequence.append((doc, start, take))
            room -= take
            if take < length:
                pieces.insert(0, (doc, start + take, length - take))
        out.append(sequence)
    return out


def pack(docs: DataFrame, path: str | None = None, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the ids.

    remembered: chunks of text whose ids a worker keeps; fewer take less memory and more time.
    """
    path = path or default_tokenizer()
    table = stored(tokenized(docs, path, remembered), "tokens")
    rows, total = table.agg(F.count("*"), F.sum("n")).first()
    df = table.select("ids").mapInArrow(tidy(_frequencies), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    idf = np.zeros(1 << 16, np.float32)
    idf[[r[0] for r in df]] = np.log(1 + (rows - np.array([r[1] for r in df]) + 0.5) / (np.array([r[1] for r in df]) + 0.5)) if df else 0
    mean = (total or 1) / max(rows, 1)
    held = docs.sparkSession.sparkContext.broadcast(idf)
    kind = docs.schema["doc_id"].dataType
    fields = [("doc_id", kind), *((n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    schema = T.StructType([T.StructField(n, t) for n, t in fields] + [T.StructField("ids", T.BinaryType())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, number = held.value, TaskContext.get().partitionId() << 32
        names: list = []
        ids: list[np.ndarray] = []
        pool: list[Piece] = []
        held_ids = 0

        def rows_of(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            out: list[tuple] = []
            for sequence in sequences:
                offset = 0
                for doc, start, length in sequence:
                    raw = ids[doc][start : start + length].astype("<u4").tobytes()
                    out.append((names[doc], start, length, zlib.crc32(raw), len(ids[doc]), number, offset, *([raw] if with_ids else [])))
                    offset += length
                number += 1
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], to_arrow)

        def shard() -> Iterator[pa.RecordBatch]:
            nonlocal names, ids, pool, held_ids
            full, open_ = pack_shard(pool, ids, idf, mean)
            for lo in range(0, len(full), 2000):
                yield rows_of(full[lo : lo + 2000])
            old_names, old_ids, names, ids, pool = names, ids, [], [], []
            at: dict[int, int] = {}
            for doc, start, length in open_:
                if doc not in at:
                    at[doc] = len(names)
                    names.append(old_names[doc]), ids.append(old_ids[doc])
                pool.append((at[doc], start, length))
            held_ids = 0

        to_arrow = None
        for batch in batches:
            if to_arrow is None:
                to_arrow = pa.schema([pa.field(n, batch.schema.field("doc_id").type if n == "doc_id" else pa.binary() if n == "ids" else pa.int64()) for n in schema.names])
            for name, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(name)
                ids.append(np.frombuffer(row.as_py(), "<u2"))
                pool.append((len(ids) - 1, 0, len(ids[-1])))
                held_ids += len(ids[-1])
                if held_ids >= SHARD or len(pool) >= PIECES:
                    yield from shard()
        if pool:
            yield from shard()
            if pool:
                yield rows_of(powers(pool))

    parts = max(1, min(RANGES, -(-(total or 0) // RANGE)))
    dealt = table.repartitionByRange(parts, "key").sortWithinPartitions("key", "doc_id", "n", F.crc32("ids"))
    return dealt.select("doc_id", "ids").mapInArrow(tidy(run), schema)

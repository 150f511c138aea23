"""Document fingerprints by a randomised edit embedding.

A text is read by a random walk: at step j the character under the pointer is put out, and the pointer moves on if a
random bit of (j, character) is set. All texts share the bits, so two walks that part at an edit meet again
after a few steps, and the Hamming distance of the outputs follows the edit distance of the texts. There are WALKS
walks with bits of their own. A fingerprint keeps a hash of each walk's output at sampled steps. The steps of scale s
are spread over what a text of 2**s characters takes; a fingerprint has those of the text's own scale and the next, so
that any two texts of which one is at most twice as long share a scale. The whole text is walked.

likeness is the share of equal samples of the walk in which it is largest, less what chance gives; texts without a
common scale have 0. near_groups() bands the samples, and verifies candidates on the whole fingerprints.

A null text counts as empty; two empty texts are alike. Equal texts have equal fingerprints. The next document of a
row is the one after it by doc_id, then a hash of its text; nulls come first; after the last comes the first; a single
document follows itself. Repeated rows follow one another. Ids must be of an integer type. Very long texts are walked whole. An empty table
has no rows. fingerprint() passes all other columns through and names its own with underscores if the name is taken;
report() looks at no other column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import kept, long_id, scratch, small, stored, unused
from ._text import tidy
from .components import components
from .neighbours import equal, neighbour_edges
from .regions import links

SAMPLES, WALKS, SYMBOLS, LOWEST = 32, 3, 64, 4
#: Near pairs are alike by this, and have a band in common: of BANDS for each walk and scale, with WIDTH samples each,
#: drawn from those steps that any text of the scale reaches.
LEAST, BANDS, WIDTH = 0.5, 8, 11
#: Texts walked at a time; characters of them at most, unless one has more.
TEXTS, CHARACTERS = 20_000, 12_000_000
#: Rows that a range of ids should have, and ranges at most.
ROWS, RANGES = 4000, 50_000
#: Fingerprints that a task may hold of a region.
NODES = 2_000
#: What two letters of prose have in common by chance: they are the same class, or hash alike, about so often.
CHANCE = 1 / 12
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
_PERIOD = 256
_rng = np.random.default_rng(19)
_NIBBLE = np.tile(_rng.integers(0, 16, (SAMPLES, SYMBOLS), dtype=np.uint8), (2, 1))  # a scale's samples are hashed alike in either half


def _wait_table() -> np.ndarray:
    """By symbol + 256 * step: how many steps until the first set bit, itself included."""
    bits = _rng.integers(0, 2, (_PERIOD, SYMBOLS), dtype=np.uint8)
    bits[-1] = 1
    out = np.ones((_PERIOD, 256), np.uint8)
    for j in range(2 * _PERIOD - 1, -1, -1):
        out[j % _PERIOD, :SYMBOLS] = np.where(bits[j % _PERIOD] == 1, 1, out[(j + 1) % _PERIOD, :SYMBOLS] + 1)
    return out.ravel()


_WAIT = [_wait_table() for _ in range(WALKS)]
_steps: dict[tuple[int, int], np.ndarray] = {}
_PICKS = np.stack([np.sort(_rng.choice(SAMPLES // 2, WIDTH, replace=False)) for _ in range(BANDS)])


def scale_of(n: int) -> int:
    return max(LOWEST, (n - 1).bit_length() if n > 1 else 0)


def steps_of(scale: int, walk: int) -> np.ndarray:
    """The sampled steps of a scale, rising."""
    reach = 2 * (1 << scale)
    return np.sort(np.random.default_rng([1000, scale, walk]).choice(reach, SAMPLES, replace=reach < SAMPLES))


def symbols(text: str) -> np.ndarray:
    """A class from 0 of each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((points * np.uint32(2654435761)) >> np.uint32(26)).astype(np.uint8)


def _waits(rows: list[np.ndarray], start: list[int], walk: int) -> list[np.ndarray]:
    """For each character of each row of symbols, the steps that the walk, begun at step start, spends on it.

    All walks take their i-th character at once. Rows stand by falling length, so that those not yet at
    their end are the first ones.
    """
    size = np.array([len(r) for r in rows], np.int64)
    order = np.argsort(-size, kind="stable")
    longest = int(size[order[0]]) if len(rows) else 0
    live = len(rows) - np.searchsorted(size[order[::-1]], np.arange(longest), "right")  # rows longer than i
    first = np.concatenate([[0], np.cumsum(live)])
    by_turn = np.empty(first[-1], np.uint8)
    for place, r in enumerate(order.tolist()):
        by_turn[first[: size[r]] + place] = rows[r]
    pair = np.zeros((len(rows), 2), np.uint8)
    pair[:, 1] = np.array(start, np.int64)[order] % _PERIOD
    state, symbol, step = pair.view(np.uint16).ravel(), pair[:, 0], pair[:, 1]
    at, table = 0, _WAIT[walk]
    for n in live.tolist():
        symbol[:n] = by_turn[at : at + n]
        wait = table.take(state[:n])
        step[:n] += wait
        by_turn[at : at + n] = wait
        at += n
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(rows)
    for place, r in enumerate(order.tolist()):
        out[r] = by_turn[first[: size[r]] + place]
    return out


def _sampled(signs: np.ndarray, waits: np.ndarray, walk: int) -> str:
    scale = scale_of(len(signs))
    if (scale, walk) not in _steps:
        _steps[scale, walk] = np.concatenate([steps_of(scale, walk), steps_of(scale + 1, walk)])
    at = np.searchsorted(np.cumsum(waits, dtype=np.int64), _steps[scale, walk], "right")
    got = np.full(2 * SAMPLES, ord("."), np.uint8)
    inside = np.flatnonzero(at < len(signs))
    got[inside] = _HEX[_NIBBLE[inside, signs[at[inside]]]]
    return got.tobytes().decode()


def _named(rows: list[np.ndarray], walks: list[list[str]]) -> list[str]:
    return [f"{scale_of(len(r)):02x}" + "".join(parts) for r, *parts in zip(rows, *walks)]


def fingerprints(texts: list[str]) -> list[str]:
    """Two hex digits for the scale; then for each walk, for the scale and the next, a digit a sample, `.` where the text has ended."""
    rows = [symbols(t) for t in texts]
    return _named(rows, [[_sampled(r, w, k) for r, w in zip(rows, _waits(rows, [0] * len(rows), k))] for k in range(WALKS)])


def with_edits(texts: list[str], nexts: list[str]) -> tuple[list[str], list[str]]:
    """Fingerprints of the texts, and of edited(text, next): its walk is the text's own up to the edit."""
    rows = [symbols(t) for t in texts]
    half = [len(r) // 2 for r in rows]
    tails = [symbols(n[:h]) for n, h in zip(nexts, half)]
    changed = [np.concatenate([r[: len(r) - h], t]) for r, h, t in zip(rows, half, tails)]
    own, new = [], []
    for k in range(WALKS):
        waits = _waits(rows, [0] * len(rows), k)
        kept_ = [w[: len(w) - h] for w, h in zip(waits, half)]
        more = _waits(tails, [int(w.sum(dtype=np.int64)) for w in kept_], k)
        own.append([_sampled(r, w, k) for r, w in zip(rows, waits)])
        new.append([_sampled(c, np.concatenate([w, m]), k) for c, w, m in zip(changed, kept_, more)])
    return _named(rows, own), _named(changed, new)


def _parsed(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Scales, and the samples: rows x walks x scale, next x samples."""
    raw = np.frombuffer("".join(prints).encode(), np.uint8).reshape(len(prints), -1)
    digits = raw[:, :2].astype(np.int64)
    digits = np.where(digits < 58, digits - 48, digits - 87)
    return digits[:, 0] * 16 + digits[:, 1], raw[:, 2:].reshape(len(prints), WALKS, 2, SAMPLES)


def likenesses(a: list[str], b: list[str]) -> np.ndarray:
    """0 to 1, for each pair of fingerprints: how much of the two texts is alike."""
    return _alike(*_parsed(a), *_parsed(b)) if len(a) else np.zeros(0)


def _alike(scale_a: np.ndarray, x: np.ndarray, scale_b: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = scale_a - scale_b
    out = np.zeros(len(x))
    # of one scale: both halves; else the longer text's own scale is the shorter one's next
    for step, p, q in ((0, slice(0, 2), slice(0, 2)), (1, slice(0, 1), slice(1, 2)), (-1, slice(1, 2), slice(0, 1))):
        rows = np.flatnonzero(gap == step)
        if len(rows):
            u, v = x[rows, :, p], y[rows, :, q]
            there = (u != ord(".")) | (v != ord("."))
            count = there.sum(axis=(2, 3))
            share = np.where(count, ((u == v) & there).sum(axis=(2, 3)) / np.maximum(count, 1), 1).max(axis=1)
            out[rows] = np.clip((share - CHANCE) / (1 - CHANCE), 0, 1)
    out[(x == y).all(axis=(1, 2, 3)) & (gap == 0)] = 1
    return out


def likeness(a: str, b: str) -> float:
    return float(likenesses([a], [b])[0])


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint(docs: DataFrame, to: str = "fingerprint") -> DataFrame:
    """docs with a column of fingerprints."""
    at, to = docs.columns.index("text"), unused(docs, to)
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], schema.names)

    return docs.mapInArrow(tidy(run), schema)


def bands_of(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and labels: a hash of the scale, the walk, the band and its samples. Bands mostly beyond the text's end are left out."""
    scale, samples = _parsed(prints)
    picked = samples[:, :, :, _PICKS].astype(np.uint64)  # rows, walks, scale or next, bands, samples
    label = (scale[:, None] + np.arange(2)).astype(np.uint64)[:, None, :, None] * np.uint64(64)
    label = (label + np.arange(WALKS, dtype=np.uint64)[None, :, None, None]) * np.uint64(64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(WIDTH):
        label = label * np.uint64(0x9FB21C651E98DF25) + picked[..., k]
        label ^= label >> np.uint64(29)
    rows, *_ = inside = np.nonzero((picked != ord(".")).sum(axis=4) * 2 > WIDTH)
    return rows, label[inside].view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            rows, labels = bands_of(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(labels), part.column(0).take(pa.array(rows))], ["label", "id"])


def near_groups(prints: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id and near_group, a smaller doc_id that likeness of at least least links it with through others, for stored
    rows (doc_id long, fingerprint).

    Documents that share a band are candidates, whatever their number; equal fingerprints are one node. Connected
    candidates are a region for regions.links(); what is in different chunks of a large one is compared where it shares a band. Documents linked with none smaller are left out.
    """
    with scratch():
        return _near_groups(prints.where("doc_id is not null").select("doc_id", "fingerprint", F.xxhash64("fingerprint").alias("id")), least)


def _near_groups(prints: DataFrame, least: float) -> DataFrame:
    nodes = kept(stored(prints.groupBy("id").agg(F.min("doc_id").alias("low"), F.first("fingerprint").alias("fingerprint"), (F.min("doc_id") < F.max("doc_id")).alias("many")), "fingerprints"))
    chain = neighbour_edges(nodes.select("id", "fingerprint").mapInArrow(tidy(_bands), "label long, id long"), equal, labelled=True)
    near = components(chain.select("a", "b")).select(F.col("node").alias("id"), F.col("component").alias("region"))
    near = stored(near.unionByName(near.select(F.col("region").alias("id"), "region").distinct()).withColumn("weight", F.lit(1).cast("long")), "near")

    def linked(items: list[tuple[int, np.ndarray]]):
        scale, samples = np.array([k for k, _ in items]), np.stack([x for _, x in items])
        return lambda i, others: _alike(np.full(len(others), scale[i]), np.broadcast_to(samples[i], (len(others), *samples[i].shape)), scale[others], samples[others]) >= least

    def regroup(ids: DataFrame) -> DataFrame:
        """Documents that share a band: by chance ever more bands meet, and regions of candidates grow together."""
        some = chain.select(F.col("label").alias("group"), F.explode(F.array("a", "b")).alias("id"))  # whatever shares a band is in it
        return some.join(F.broadcast(ids) if small(ids, 16) else ids, "id", "left_semi").select("group", "id").distinct()

    edges = links(near, lambda deal: nodes.select("id", F.col("fingerprint").alias("payload")).join(deal, "id"), lambda column: list(zip(*_parsed(column.to_pylist()))), linked, NODES, regroup)
    found = components(edges)
    found = kept(stored(found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()), "groups"))
    lows = nodes.join(found, nodes["id"] == found["node"]).groupBy("component").agg(F.min("low").alias("low"))
    joined = found.join(lows, "component").select(F.col("node").alias("id"), F.col("low").alias("near_group"))
    alone = nodes.where("many").join(found, nodes["id"] == found["node"], "left_anti").select("id", F.col("low").alias("near_group"))
    out = prints.join(joined.unionByName(alone), "id").where("near_group < doc_id")
    return out.groupBy("doc_id").agg(F.min("near_group").alias("near_group"))


def report(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document, and
    near_group: the smallest doc_id of the near_groups() that it is in, or else its own.

    Documents are dealt by ranges of doc_id. Each range gets a copy of the first document of the next
    one, so that one pass finds each row's next document. Texts are compressed for the way.
    """
    out = stored(_followed(docs.select(long_id(docs), F.coalesce("text", F.lit("")).alias("text")), rows), "fingerprints")
    with scratch():
        groups = kept(stored(near_groups(out.select("doc_id", "fingerprint")), "near"))
    joined = out.join(F.broadcast(groups) if small(groups, 32) else groups, "doc_id", "left")
    return joined.select(*out.columns, F.coalesce("near_group", "doc_id").alias("near_group"))


_FOLLOWED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text, the first column, compressed, and its bytes."""
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        raw = [t.as_buffer() for t in batch.column(0)]
        packed = [codec.compress(t, asbytes=True) for t in raw]
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), pa.array([t.size for t in raw], pa.int64()), *batch.columns[1:]], ["packed", "size", *batch.schema.names[1:]])


def _followed(docs: DataFrame, rows: int) -> DataFrame:
    """report() without the groups. docs: doc_id long, text not null."""
    docs = docs.withColumn("tie", F.xxhash64("text"))
    parts = max(1, min(RANGES, docs.count() // rows))
    cuts = docs.where("doc_id is not null").stat.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    dealt = docs.withColumn("part", _part(sorted({int(c) for c in cuts})).cast("int")).withColumn("ghost", F.lit(False))
    used = sorted(r[0] for r in dealt.select("part").distinct().collect())  # of parts that have rows
    place = {p: i for i, p in enumerate(used)}
    turn = F.create_map(*[F.lit(x) for p, i in place.items() for x in (p, i)]) if used else F.create_map(F.lit(0), F.lit(0))
    dealt = dealt.withColumn("part", turn[F.col("part")])
    firsts = dealt.groupBy("part").agg(F.min_by(F.struct("doc_id", "text", "tie"), F.struct("doc_id", "tie")).alias("s"))
    ghosts = firsts.select("s.doc_id", "s.text", "s.tie", F.pmod(F.col("part") - 1, F.lit(max(1, len(used)))).cast("int").alias("part"), F.lit(True).alias("ghost"))
    packed = dealt.unionByName(ghosts).select("text", "doc_id", "tie", "part", "ghost").mapInArrow(tidy(_packed), "packed binary, size long, doc_id long, tie long, part int, ghost boolean")
    rows_ = packed.repartitionById(max(1, len(used)), F.col("part")).sortWithinPartitions("part", "ghost", "doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        held: tuple | None = None
        todo: list[tuple[int | None, str, str]] = []

        def flush() -> pa.RecordBatch:
            ids, texts, nexts = zip(*todo) if todo else ((), (), ())
            changed = [edited(t, n) for t, n in zip(texts, nexts)]
            own, new = with_edits(list(texts), list(nexts))
            prints = dict(zip(texts, own))  # a next text is most often that of the row that follows here
            other = list({n for n in nexts if n not in prints})
            prints |= zip(other, fingerprints(other))
            todo.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                    pa.array(own, pa.string()),
                    pa.array(new, pa.string()),
                    pa.array(likenesses(own, new), pa.float64()),
                    pa.array(likenesses(own, [prints[n] for n in nexts]), pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for packed, length, id_, part, ghost in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)):
                    text = codec.decompress(packed, length, asbytes=True).decode()
                    if held is not None and held[2] == part:
                        todo.append((held[0], held[1], text))
                        size += len(held[1])
                    held = None if ghost else (id_, text, part)
                    if len(todo) >= TEXTS or size >= CHARACTERS:
                        yield flush()
                        size = 0
        yield flush()

    return rows_.select("packed", "size", "doc_id", "part", "ghost").mapInArrow(tidy(run), _FOLLOWED)


def _part(cuts: list[int]) -> Column:
    """The number of cuts at or below doc_id, and one more, found by halving; none for null, which has a part of its own."""

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo + 1)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") < cuts[mid], between(lo, mid)).otherwise(between(mid + 1, hi))

    return F.when(F.col("doc_id").isNull(), 0).otherwise(between(0, len(cuts)))

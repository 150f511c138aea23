"""Language identification by the nearest centroid.

A text's vector holds the counts c of its hashed byte 2- and 3-grams as (1 + ln c) * idf, at unit length; A-Z are
lower-cased, every digit is 0, and all else that is neither a letter nor beyond ASCII is a blank. Each language has
several centroids, found by spherical k-means, and a text gets the language of the centroid with the largest cosine
(of equal ones the first language by name). It is rejected if that cosine is below FAR of the median that pieces of
training texts with as many distinct grams have with their own language: short texts are far from any centroid
even if they are clean.

Learning uses the rows with a text, a lang and a letter. The idf covers all of them. The centroids
are fitted on a sample of at most SAMPLE rows a language and SAMPLE_ALL in all, drawn by a hash of
doc_id, and the medians on whole texts and pieces of the same rows; nothing else is sampled. Of more than SAMPLE_ALL
languages the most frequent ones are learnt. With nothing to learn from, every text is `und`.

A null text or one without any letter gets `und`, score 0 and is rejected. Very long texts are counted whole, in pieces.
Repeated rows get equal results. An empty table has no rows. Other columns are passed through; classify() adds
underscores to its own if a name is taken.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import scratch, stored, unused
from ._text import pieces, tidy

DIMS, CENTROIDS, ROUNDS = 4096, 4, 12
SAMPLE, SAMPLE_ALL = 500, 4000
#: Rows counted at a time.
ROWS = 128
#: Of the median cosine of a language's own texts; a learnt language's short texts with a passage of another keep about
#: 0.4 of it, other languages and encoded data have 0.2.
FAR = 0.35
#: Lengths in characters of the pieces of a sampled text by which the medians of short texts are known.
PIECES = tuple(1 << k for k in range(2, 13))
#: Numbers of distinct grams are compared by their power of two, of which there are so many; medians need so many pieces.
SIZES, ENOUGH = 13, 20
UNKNOWN = "und"
_BLANK = np.full(256, 32, np.uint8)
_BLANK[97:123] = np.arange(97, 123)
_BLANK[65:91] = np.arange(97, 123)
_BLANK[48:58] = 48
_BLANK[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x DIMS counts of the hashed grams."""
    rows = len(offsets) - 1
    total = np.zeros(rows * DIMS, np.int64)
    plain = _BLANK[data].astype(np.uint32)
    word = plain > 57  # neither a blank nor a digit; one at least in a gram
    row = np.repeat(np.arange(rows, dtype=np.int64) * DIMS, np.diff(offsets))
    for n in (2, 3):
        m = len(plain) - n + 1
        if m <= 0:
            continue
        code = np.zeros(m, np.uint32)
        for k in range(n):
            code = code * np.uint32(257) + plain[k : k + m]
        code = (code * np.uint32(2654435761)) >> np.uint32(20)
        letters = np.logical_or.reduce([word[k : k + m] for k in range(n)])
        keep = letters & (row[:m] == row[n - 1 : n - 1 + m]) & ((plain[:m] != 32) | (plain[1 : m + 1] != 32))
        total += np.bincount((row[:m] + code)[keep], minlength=rows * DIMS)
    return total.reshape(rows, DIMS)


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter."""
    total = np.concatenate([[0], np.cumsum(_LETTER[data])])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for r in np.flatnonzero(~out):
        out[r] = any(c.isalpha() for c in data[offsets[r] : offsets[r + 1]].tobytes().decode())
    return out


def _scaled(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(counts.shape, np.float32)
    at = counts > 0
    out[at] = 1 + np.log(counts[at].astype(np.float32))
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _size(counts: np.ndarray) -> np.ndarray:
    """The power of two of the distinct grams of each row."""
    return np.minimum(np.log2((counts > 0).sum(axis=1) + 1).astype(np.int64), SIZES - 1)


@dataclass(frozen=True)
class Model:
    """idf: DIMS; centroids: c x DIMS at unit length; langs: of each centroid; floor: c x SIZES, the least cosine of
    its language by the power of two of a text's distinct grams."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: tuple[str, ...]
    floor: np.ndarray

    def cosines(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_scaled(counts) * self.idf) @ self.centroids.T

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, of each row."""
        rows = len(offsets) - 1
        if not self.langs:
            return [UNKNOWN] * rows, np.zeros(rows), np.ones(rows, bool)
        counts = _counts(data, offsets)
        cosine = self.cosines(counts)
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(rows), best], 0, 1).astype(float)
        letters = _letters(data, offsets)
        score[~letters] = 0
        return [self.langs[b] if has else UNKNOWN for b, has in zip(best, letters)], score, ~letters | (score < self.floor[best, _size(counts)])


def kmeans(rows: np.ndarray, k: int) -> np.ndarray:
    """At most k centroids of unit rows by cosine, started from rows far from each other, though not from the farthest,
    which are often hardly in the language."""
    chosen = [int((rows @ rows.mean(axis=0)).argmax())]
    near = rows @ rows[chosen[0]]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(np.argsort(near, kind="stable")[len(rows) // 8]))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    centroids = rows[chosen]
    for _ in range(ROUNDS):
        label = (rows @ centroids.T).argmax(axis=1)
        centroids = _unit(np.stack([rows[label == c].mean(axis=0) if (label == c).any() else centroids[c] for c in range(len(centroids))]))
    return centroids


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of the sampled rows (lang, vector) and, at the end, in how many rows each gram is (dim, df)."""
    df, rows = np.zeros(DIMS, np.int64), 0
    names = ["lang", "vector", "dim", "df"]
    for batch in batches:
        lang, picked = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for first, end, data, offsets in pieces(batch.column(0), most=ROWS):
            counts = _counts(data, offsets)
            has = _letters(data, offsets)
            df += (counts[has] > 0).sum(axis=0)
            rows += int(has.sum())
            at = [r for r in range(end - first) if picked[first + r] and has[r]]
            if at:
                vectors = [x.tobytes() for x in _scaled(counts[at])]
                yield pa.RecordBatch.from_arrays([pa.array([lang[first + r] for r in at]), pa.array(vectors, pa.binary()), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.int64())], names)
    if rows:
        dims = np.append(np.flatnonzero(df), DIMS)  # the last is the number of rows
        yield pa.RecordBatch.from_arrays([pa.nulls(len(dims), pa.string()), pa.nulls(len(dims), pa.binary()), pa.array(dims, pa.int32()), pa.array(np.append(df[dims[:-1]], rows), pa.int64())], names)


def parts_of(text: str) -> list[str]:
    """The text, and a piece of each length of PIECES from a place of it that a hash chooses."""
    seed = zlib.crc32(text.encode())
    return [text, *(text[at : at + n] for n in PIECES if n < len(text) for at in [(seed * 2654435761 + n * 40503) % (len(text) - n)])]


def _median_cosines(sample: DataFrame, model: Model) -> dict[tuple[str, int], float]:
    """The median cosine of texts and pieces of them with their own language, by it and the power of two of distinct grams."""
    held = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {lang: np.array([k == lang for k in held.value.langs]) for lang in set(held.value.langs)}
        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                if lang not in own:
                    continue
                size, cosine = [], []
                for _, _, data, offsets in pieces(pa.array(parts_of(text)), most=ROWS):
                    counts = _counts(data, offsets)
                    size += _size(counts).tolist()
                    cosine += held.value.cosines(counts)[:, own[lang]].max(axis=1).astype(float).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(size)), pa.array(size, pa.int32()), pa.array(cosine, pa.float64())], ["lang", "size", "cosine"])

    got = sample.mapInArrow(tidy(run), "lang string, size int, cosine double").groupBy("lang", "size").agg(F.count("*").alias("n"), F.median("cosine").alias("median"))
    return {(r["lang"], r["size"]): r["median"] for r in got.where(F.col("n") >= ENOUGH).collect()}  # languages times SIZES at most


def fit(docs: DataFrame) -> Model:
    """Learns from the columns doc_id, text and lang of docs."""
    docs = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    count = {row[0]: row[1] for row in docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_ALL).collect()}
    none = Model(np.zeros(DIMS), np.zeros((0, DIMS)), (), np.zeros((0, SIZES)))
    if not count:
        return none
    quota = max(1, min(SAMPLE, SAMPLE_ALL // len(count)))
    share = F.create_map(*[F.lit(x) for lang, n in count.items() for x in (lang, min(1.0, quota / n))])
    picked = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < F.coalesce(share[F.col("lang")], F.lit(0.0)) * (1 << 30)
    with scratch():
        seen = stored(docs.select("text", "lang", picked.alias("picked")).mapInArrow(tidy(_gather), "lang string, vector binary, dim int, df long"), "grams")
        df = {row[0]: row[1] for row in seen.where("dim is not null").groupBy("dim").agg(F.sum("df")).collect()}
        if not df:
            return none
        sample: dict[str, list[np.ndarray]] = {}
        for lang, vector in seen.where("vector is not null").select("lang", "vector").orderBy("lang", F.xxhash64("vector")).toLocalIterator():
            held = sample.setdefault(lang, [])
            if len(held) < 2 * quota:
                held.append(np.frombuffer(vector, np.float32))
    total = df.pop(DIMS)
    idf = np.zeros(DIMS, np.float32)
    idf[list(df)] = np.log((1 + total) / (1 + np.array(list(df.values())))) + 1
    centroids, langs = [], []
    for lang in sorted(sample):
        own = kmeans(_unit(np.stack(sorted(sample[lang], key=lambda v: v.tobytes())) * idf), CENTROIDS)
        centroids.append(own)
        langs += [lang] * len(own)
    model = Model(idf, np.concatenate(centroids), tuple(langs), np.zeros((len(langs), SIZES)))
    median = _median_cosines(docs.where(picked).select("text", "lang"), model)
    floor = {lang: np.maximum.accumulate([FAR * median.get((lang, size), 0.0) for size in range(SIZES)]) for lang in sample}
    return Model(idf, model.centroids, model.langs, np.stack([floor[lang] for lang in langs]))


def classify(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """docs with its predicted language, a score from 0 to 1, and whether it is rejected. Reads text alone.

    A name that docs has already gets underscores.
    """
    lang, score, rejected = (unused(docs, name) for name in (lang, score, rejected))
    at = docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(rejected, T.BooleanType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, out = [], [], []
            for _, _, data, offsets in pieces(batch.column(at), most=ROWS):
                found = held.value.predict(data, offsets)
                for to, new in zip((langs, scores, out), found):
                    to.extend(new)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], names)

    return docs.mapInArrow(tidy(run), schema)


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    added = [unused(docs, name) for name in ("_lang", "_score", "_rejected")]
    return classify(docs, model, *added).where(~F.col(added[2])).drop(*added)


def held_out() -> Column:
    """crc32 of doc_id as text is a multiple of five; so are null ids."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every document; learns from those not held out."""
    model = fit(docs.where(~held_out()))
    return classify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")

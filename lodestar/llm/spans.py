"""Spans of several kinds in a text, and the digest columns made of them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import unused
from ._text import tidy

#: kind, start, end, in code points, end exclusive.
Span = tuple[str, int, int]
TYPE = "array<struct<kind:string,start:long,end:long,base:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def ordered(spans: Sequence[Span], kinds: Sequence[str]) -> list[Span]:
    """By start, then kind as listed."""
    return sorted(set(spans), key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def found(docs: DataFrame, find: Callable[[list[str]], list[tuple[list[Span], list[Span]]]], spans: str, batch: int = 256) -> DataFrame:
    """docs with a column of the spans that find gives for its texts, base ones and further ones."""
    at, spans = docs.columns.index("text"), unused(docs, spans)
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(f"`{spans}` {TYPE}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                rows = []
                for base, more in find([t or "" for t in part.column(at).to_pylist()]):
                    rows.append([{"kind": k, "start": s, "end": e, "base": True} for k, s, e in base] + [{"kind": k, "start": s, "end": e, "base": False} for k, s, e in more])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, _ARROW)], schema.names)

    return docs.mapInArrow(tidy(run), schema)


def digest(docs: DataFrame, base_kinds: Sequence[str], kinds: Sequence[str], spans: str = "_spans") -> DataFrame:
    """doc_id, a count of each base kind, base_sha256 and spans, from the column of spans; and n_spans, how many there are in all."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"))))
    text = lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("_ordered", lambda s: s["base"])
    of = lambda kind: F.filter("_base", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base_kinds]
    out = docs.select("doc_id", by_start.alias("_ordered")).select("doc_id", "_ordered", base.alias("_base"))
    return out.select("doc_id", *counts, F.sha2(text("_base").cast("binary"), 256).alias("base_sha256"), text("_ordered").alias("spans"), F.size("_ordered").cast("long").alias("n_spans"))


def redact(text: str | None, spans: Sequence[tuple[str, int, int]]) -> str | None:
    """text with each span as its kind in angle brackets; overlapping spans are cut as one, by the first's kind."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sha256(spans: Sequence[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()

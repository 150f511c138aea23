"""Search parameters as predicates over patents.

A Query is compiled to Column conditions, so that Catalyst pushes what it can to the scan. The meaning of
each filter is that of the in-memory store: substring tests without case, strict date bounds that drop a
missing date, numbers compared without kind codes and leading zeros.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import tokens

#: Lists longer than this are joined, not put into the plan.
INLINE = 500


@dataclass(frozen=True)
class Query:
    """What a search asks for; empty fields ask for nothing."""

    keywords: Sequence[str] = ()
    required: Sequence[str] = ()
    excluded: Sequence[str] = ()
    text: str = ""
    minimum_match: int | None = None
    fields: Sequence[str] = ("title", "specification")
    classes: Sequence[str] = ()
    inventors: Sequence[str] = ()
    assignees: Sequence[str] = ()
    before: date | None = None
    after: date | None = None
    countries: Sequence[str] = ()
    deny: Sequence[str] = ()
    allow: Sequence[str] = ()
    limit: int = 25

    def least_match(self) -> int:
        """A third of the keywords unless set, one at least; none without keywords."""
        if not self.keywords:
            return 0
        return self.minimum_match if self.minimum_match is not None else max(1, len(self.keywords) // 3)


def any_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def holds(text: Column, part: str) -> Column:
    """Substring without case."""
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(part.lower()))


def condition(query: Query, whole_text: Column, cpc: str = "cpc", effective: str = "effective", country: str = "country", assignees: Column | None = None, inventors: Column | None = None) -> Column:
    """All of the query's row conditions but for its lists of numbers."""
    parts: list[Column] = []
    if query.countries:
        parts.append(F.col(country).isin(list(query.countries)))
    if query.before is not None:
        parts.append(F.col(effective) < F.lit(query.before))
    if query.after is not None:
        parts.append(F.col(effective) > F.lit(query.after))
    if query.classes:
        parts.append(any_of([_prefix(cpc, p) for p in query.classes]))
    for names, wanted in ((assignees, query.assignees), (inventors, query.inventors)):
        if wanted:
            parts.append(any_of([_name(names, w) for w in wanted]) if names is not None else F.lit(False))
    parts += [~holds(whole_text, part) for part in query.excluded]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _prefix(codes: str, prefix: str) -> Column:
    return F.exists(codes, lambda c: c.startswith(prefix))


def _name(names: Column, wanted: str) -> Column:
    return F.exists(names, lambda n: F.contains(F.lower(n), F.lit(wanted.lower())))


def with_numbers(rows: DataFrame, query: Query, key: str = "doc_key") -> DataFrame:
    """Without the numbers denied and, if any are allowed, with those alone. The lists hold keys."""
    spark = rows.sparkSession
    for keys, how in ((query.deny, "left_anti"), (query.allow, "left_semi")):
        if not keys:
            continue
        if len(keys) <= INLINE:
            inside = F.col(key).isin(list(keys))
            rows = rows.where(inside if how == "left_semi" else ~F.coalesce(inside, F.lit(False)))
        else:
            rows = rows.join(spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], f"{key} string"), key, how)
    return rows


def required_groups(query: Query, terms: Column) -> Column:
    """Every token of every required keyword is among the document's terms."""
    wanted = sorted({t for kw in query.required for t in _tokens(kw)})
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), terms)) == 0 if wanted else F.lit(True)


def matched_keywords(query: Query, terms: Column) -> Column:
    """How many keywords have all their tokens among the terms; repeats count, one without tokens matches."""
    total = F.lit(0)
    for kw in query.keywords:
        wanted = _tokens(kw)
        total = total + (F.size(F.array_except(F.array(*map(F.lit, wanted)), terms)) == 0).cast("int") if wanted else total + 1
    return total


def _tokens(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def document_terms(*fields: Column) -> Column:
    """The distinct tokens of all fields."""
    return F.array_distinct(F.flatten(F.array(*[tokens(f) for f in fields])))

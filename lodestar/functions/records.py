"""Parts of a patent record as column expressions: claims, citations, classes, compact forms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The lengths of compact forms.
TITLE, ABSTRACT, CLAIM, CLAIMS, CODES, PASSAGE, PASSAGES = 220, 1000, 1200, 6, 10, 220, 2


def independent(claims: Column) -> Column:
    """The claims that depend on none."""
    return F.filter(claims, lambda c: c["depends_on"].isNull())


def claim(claims: Column, number: int) -> Column:
    """The claim of a number, or null."""
    return F.try_element_at(F.filter(claims, lambda c: c["number"] == number), F.lit(1))


def selected(claims: Column, numbers: Sequence[int] = ()) -> Column:
    """The claims of these numbers; without any of them the independent ones; without those all."""
    picked = F.filter(claims, lambda c: c["number"].isin(list(numbers))) if numbers else F.filter(claims, lambda _: F.lit(False))
    first = independent(claims)
    return F.when(F.size(picked) > 0, picked).when(F.size(first) > 0, first).otherwise(claims)


def examiner_cited(citations: Column) -> Column:
    """Keys of what the examiner cited, sorted and each once."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(citations, lambda c: c["is_examiner"]), lambda c: c["doc_key"])))


def cpc_codes(classifications: Column) -> Column:
    return F.transform(F.filter(classifications, lambda c: c["scheme"] == "CPC"), lambda c: c["code"])


def cpc_code(section: Column, parts: Sequence[Column], subgroup: Column) -> Column:
    """A class from its parts, with a slash before the subgroup if there is one."""
    return F.concat(section, *parts, F.when(F.coalesce(subgroup, F.lit("")) != "", F.concat(F.lit("/"), subgroup)).otherwise(F.lit("")))


def equal(**values) -> Column:
    """All of these columns have these values; null equals null."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in values.items()], F.lit(True))


def cut(text: Column, longest: int) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("..."))).otherwise(text)


def compact(title: Column, abstract: Column, claims: Column, codes: Column) -> Column:
    """A record short enough to show: cut texts, a few claims and codes."""
    few = F.transform(F.slice(claims, 1, CLAIMS), lambda c: F.struct(c["number"].alias("number"), cut(c["text"], CLAIM).alias("text")))
    return F.struct(cut(title, TITLE).alias("title"), cut(abstract, ABSTRACT).alias("abstract"), few.alias("claims"), F.slice(codes, 1, CODES).alias("cpc"))


def clamped(limit: Column, most: int = 25) -> Column:
    """A tool call's limit, from 1 to most."""
    return F.greatest(F.lit(1), F.least(limit, F.lit(most)))


def earlier(asked: Column, cutoff: Column) -> Column:
    """The date asked for, but never after the cutoff."""
    return F.least(asked, cutoff)


def last_event(events: Column, kind: str) -> Column:
    """The date of the last event whose title holds kind, or null."""
    return F.try_element_at(F.filter(events, lambda e: F.contains(F.lower(e["title"]), F.lit(kind))), F.lit(-1))["date"]


def merged_map(primary: Column, secondary: Column) -> Column:
    """Both maps' entries; where both have a key, the primary's."""
    rest = F.map_filter(F.coalesce(secondary, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(primary, k))
    return F.map_concat(primary, rest)

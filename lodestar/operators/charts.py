"""Claim charts as facts: a row for each limitation and reference, and what is computed from them."""

from __future__ import annotations

from collections.abc import Sequence
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RISKS = ("high", "medium", "low")
#: How each status is written in a chart's cell.
MARKS = {"disclosed": "Disclosed", "partially_disclosed": "Partially disclosed", "not_disclosed": "Not disclosed"}


def status(raw: Column) -> Column:
    """disclosed, partially_disclosed or not_disclosed; what is none of them is not_disclosed."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), "[ -]+", "_")
    return F.when(s.isin("disclosed", "yes", "true"), "disclosed").when(s.contains("partial"), "partially_disclosed").otherwise("not_disclosed")


def risk(raw: Column) -> Column:
    """high, medium or low; medium for anything else."""
    s = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(s.isin(*RISKS), s).otherwise("medium")


def confidence(raw: Column) -> Column:
    """1 to 3; 2 for what is no number."""
    n = raw.try_cast("int")
    return F.coalesce(F.least(F.lit(3), F.greatest(F.lit(1), n)), F.lit(2))


def coverage(findings: DataFrame, query: str = "query_key", ref: str = "ref_key") -> DataFrame:
    """query, ref, n and the share of its limitations that each reference discloses."""
    return findings.groupBy(query, ref).agg(F.count("*").alias("n"), F.avg((F.col("status") == "disclosed").cast("double")).alias("coverage"))


def combined_coverage(findings: DataFrame, query: str = "query_key", limitation: str = "limitation") -> DataFrame:
    """query and the share of its limitations that any reference discloses."""
    any_ = findings.groupBy(query, limitation).agg(F.bool_or(F.col("status") == "disclosed").alias("_any"))
    return any_.groupBy(query).agg(F.avg(F.col("_any").cast("double")).alias("coverage"))


def risk_summary(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, and how many findings have each risk; zero where none has."""
    counts = [F.sum((F.col("risk") == r).cast("long")).alias(r) for r in RISKS]
    return findings.groupBy(*by).agg(*counts)


def infringement_counts(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, and how many limitations are met, likely met and in all."""
    count = lambda name: F.sum((F.col("status") == name).cast("long")).alias(name)
    return findings.groupBy(*by).agg(count("met"), count("likely"), F.count("*").alias("total"))


def filtered(findings: DataFrame, parts: Sequence[str], limitation: str = "limitation") -> DataFrame:
    """The findings on limitations with any of the parts in them, without case; all without parts."""
    if not parts:
        return findings
    return findings.where(F.exists(F.array(*[F.lit(p.lower()) for p in parts]), lambda p: F.contains(F.lower(F.col(limitation)), p)))


def missing(limitations: DataFrame, references: DataFrame, held: DataFrame, keys: Sequence[str] = ("limitation", "ref_key")) -> DataFrame:
    """The pairs of a limitation and a reference that have not been charted yet; both are short lists."""
    return limitations.crossJoin(F.broadcast(references)).join(held.select(*keys).distinct(), list(keys), "left_anti")


def refreshed(held: DataFrame, new: DataFrame, keys: Sequence[str] = ("limitation", "ref_key")) -> DataFrame:
    """held with the findings of new in place of those of the same pair."""
    return held.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def escaped(text: str | None) -> str:
    return (text or "").replace("|", "\\|").replace("\n", " ")


def markdown(findings: DataFrame, query: str) -> str:
    """The chart of one query as a table with a row a limitation and a column a reference."""
    rows = findings.where(F.col("query_key") == query).orderBy("limitation", "ref_key").select("limitation", "ref_key", "status", "reasoning").collect()
    refs = sorted({r["ref_key"] for r in rows})
    cell = {(r["limitation"], r["ref_key"]): f"**{MARKS.get(r['status'], r['status'])}** {escaped(r['reasoning'])}".strip() for r in rows}
    share = {ref: [r["status"] == "disclosed" for r in rows if r["ref_key"] == ref] for ref in refs}
    out = [f"# Claim chart: {query}", "", "| Limitation | " + " | ".join(map(escaped, refs)) + " |", "|" + "---|" * (len(refs) + 1)]
    for limitation in dict.fromkeys(r["limitation"] for r in rows):
        out.append(f"| {escaped(limitation)} | " + " | ".join(cell.get((limitation, ref), "-") for ref in refs) + " |")
    out += ["", *(f"- {ref}: {sum(s)}/{len(s)} disclosed ({100 * sum(s) / len(s):.0f}%)" for ref, s in share.items())]
    return "\n".join(out)


def html(findings: DataFrame, query: str) -> str:
    """The chart as an HTML table."""
    lines = [line for line in markdown(findings, query).split("\n") if line.startswith("|") and "---" not in line]
    rows = [[c.strip().replace("\\|", "|") for c in line.strip("|").split(" | ")] for line in lines]
    cells = lambda row, tag: "".join(f"<{tag}>{escape(c)}</{tag}>" for c in row)
    body = "".join(f"<tr>{cells(r, 'td')}</tr>" for r in rows[1:])
    return f"<table><thead><tr>{cells(rows[0], 'th')}</tr></thead><tbody>{body}</tbody></table>"

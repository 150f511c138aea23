"""The three searches without a language model: prior art, freedom to operate, infringement."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import overlap, planner_tokens, tokens
from lodestar.operators import bulk, keyword

from .planner import keywords

#: Fixed value: years that a patent may be in force.
IN_FORCE_YEARS = 21
WHY = "keyword relevance only"


def window_start(today: date) -> date:
    """Patents that count from a later day may be in force."""
    return today - timedelta(days=int(IN_FORCE_YEARS * 365.25))


def exclusions(targets: DataFrame, citations: DataFrame | None = None, family: DataFrame | None = None, custom: Sequence[str] = ()) -> DataFrame:
    """query_id, doc_key and reason that each target's search leaves out: itself, art its examiner cited, its family,
    and what is asked for. targets: query_id, doc_key; citations: src_key, dst_key, is_examiner; family: src_key, dst_key."""
    out = targets.select("query_id", "doc_key", F.lit("self").alias("reason"))
    for edges, reason in ((citations.where("is_examiner") if citations is not None else None, "examiner_cited"), (family, "family")):
        if edges is not None:
            joined = targets.join(edges.select(F.col("src_key").alias("doc_key"), "dst_key"), "doc_key")
            out = out.unionByName(joined.select("query_id", F.col("dst_key").alias("doc_key"), F.lit(reason).alias("reason")))
    if custom:
        out = out.unionByName(targets.select("query_id", F.explode(F.array(*map(F.lit, custom))).alias("doc_key"), F.lit("custom").alias("reason")))
    return out.distinct()


def _normalised(scores: DataFrame, k: int) -> DataFrame:
    best = keyword.ranked(scores, k)
    top = F.max("score").over(Window.partitionBy("query_id"))
    share = F.round(F.col("score") / F.when(top > 0, top).otherwise(F.lit(1.0)), 4)
    return best.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), share.alias("score"), F.lit(WHY).alias("why"))


def prior_art(docs: DataFrame, targets: DataFrame, excluded: DataFrame, k: int = 25) -> DataFrame:
    """The k best documents before each target's date, scored from 0 to 1, for targets (query_id, doc_key, title,
    specification, effective) in one job. A target without a date has no limit."""
    words = keywords(targets, "query_id", F.col("title"), F.col("specification"))  # a keyword is one token
    asked = words.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "keyword"))), lambda x: x["keyword"]).alias("terms"))
    left_out = excluded.groupBy("query_id").agg(F.collect_set("doc_key").alias("excluded"))
    asked = asked.join(targets.select("query_id", F.col("effective").alias("before")), "query_id").join(left_out, "query_id", "left")
    asked = asked.withColumn("need", F.greatest(F.lit(1), F.floor(F.size("terms") / 3)))
    scores = bulk.best(docs, asked, k)
    return _normalised(scores, k)


def _least(scores: DataFrame, words: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the scored pairs those in which a third of the keywords, one at least, occur."""
    terms = docs.select("doc_id", F.explode(F.array_distinct(F.concat(tokens(F.col("title")), tokens(F.col("specification"))))).alias("keyword"))
    need = words.groupBy("query_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 3)).alias("_need"))
    wanted = words.select("query_id", "keyword")
    held = terms.join(wanted.select("keyword").distinct(), "keyword", "left_semi").join(wanted, "keyword").groupBy("query_id", "doc_id").agg(F.count("*").alias("_held"))
    return scores.join(held.join(need, "query_id").where("_held >= _need").select("query_id", "doc_id"), ["query_id", "doc_id"])


def freedom_to_operate(docs: DataFrame, products: DataFrame, today: date, jurisdiction: str | None = "US", in_force: bool = True, k: int = 25, excluded: DataFrame | None = None) -> DataFrame:
    """The k best patents in force of a jurisdiction for each of products(query_id, text)."""
    index = keyword.build(docs)
    words = keywords(products, "query_id", None, F.col("text"))
    asked = words.select("query_id", F.explode(tokens(F.col("keyword"))).alias("term")).unionByName(keyword.terms(products, F.col("text"))).distinct()
    rows = docs
    if jurisdiction:
        rows = rows.where(F.col("country") == jurisdiction)
    if in_force:
        rows = rows.where(F.col("effective") > F.lit(window_start(today)))
    scores = keyword.scored(index, asked, rows).where("score > 0")
    if excluded is not None:
        scores = scores.join(docs.select("doc_id", "doc_key"), "doc_id").join(excluded.select("query_id", "doc_key"), ["query_id", "doc_key"], "left_anti")
    return _normalised(_least(scores, words, docs), k)


def limitation_tokens(limitations: Column) -> Column:
    """The distinct telling tokens of an array of limitations."""
    return F.array_distinct(planner_tokens(F.concat_ws("\n", limitations), digits=True))


def infringement(limitations: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    """The k products of each query that hold the most of its limitations' tokens, as a share to four places.

    limitations: query_id, limitations (array); products: query_id, pos, name, description, evidence (may be null). Products
    with neither name nor description are left out. Equal shares keep the order of pos.
    """
    wanted = limitations.select("query_id", limitation_tokens(F.col("limitations")).alias("_wanted"))
    rows = products.where((F.coalesce("name", F.lit("")) != "") | (F.coalesce("description", F.lit("")) != "")).join(wanted, "query_id")
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")), "evidence")
    rows = rows.withColumn("score", F.round(overlap(F.array_distinct(tokens(text)), F.col("_wanted")), 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "pos", "name", "score", "rank")

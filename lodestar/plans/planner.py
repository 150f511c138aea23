"""Search plans without a language model: keywords, starting angles, time estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import planner_tokens

#: Fixed values of the time model: seconds a step, steps beside the angles, seconds a claim, the corpus assumed.
STEP_SECONDS, BASE_STEPS, CLAIM_SECONDS, CORPUS = 5.0, 4, 45.0, 100_000
MOST_KEYWORDS, MOST_ANGLES = 8, 3


def keywords(docs: DataFrame, key: str, title: Column | None, body: Column, most: int = MOST_KEYWORDS) -> DataFrame:
    """key, n from 0 and keyword: title tokens in order, then body tokens by falling count and first place."""
    first = planner_tokens(title) if title is not None else F.array().cast("array<string>")
    tokens = docs.select(F.col(key), F.posexplode(F.concat(F.transform(first, lambda t: _word(t, True)), F.transform(planner_tokens(body), lambda t: _word(t, False)))).alias("pos", "w"))
    rows = tokens.groupBy(key, F.col("w.t").alias("keyword")).agg(
        F.min(F.when(F.col("w.title"), F.col("pos"))).alias("_title"),
        F.sum(F.when(~F.col("w.title"), 1).otherwise(0)).alias("_count"),
        F.min("pos").alias("_first"),
    )
    order = Window.partitionBy(key).orderBy(F.col("_title").asc_nulls_last(), F.desc("_count"), "_first")
    return rows.withColumn("n", F.row_number().over(order) - 1).where(F.col("n") < most).select(key, "n", "keyword")


def _word(token: Column, title: bool) -> Column:
    return F.struct(token.alias("t"), F.lit(title).alias("title"))


def class_prefixes(cpc: Column, most: int = 4) -> Column:
    """The first distinct four-character prefixes of the codes, sorted."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(cpc, lambda c: F.substring(c, 1, 4)))), 1, most)


def angles(docs: DataFrame, most: int = MOST_ANGLES) -> DataFrame:
    """doc_id, n, purpose, keywords, required, classes and before of the starting angles of docs(doc_id, title,
    specification, cpc, effective): broad; with the first title terms required; within the classes."""
    words = keywords(docs, "doc_id", F.col("title"), F.col("specification")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "keyword"))), lambda x: x["keyword"]).alias("keywords"))
    rows = docs.select("doc_id", F.slice(planner_tokens(F.col("title"), digits=True), 1, 3).alias("required"), class_prefixes(F.col("cpc")).alias("classes"), F.col("effective").alias("before")).join(words, "doc_id", "left")
    none = F.array().cast("array<string>")
    angle = lambda purpose, required, classes: F.struct(F.lit(purpose).alias("purpose"), required.alias("required"), classes.alias("classes"))
    found = F.filter(
        F.array(angle("broad", none, none), F.when(F.size("required") > 0, angle("tight", F.col("required"), none)), F.when(F.size("classes") > 0, angle("classification", none, F.col("classes")))),
        lambda a: a.isNotNull(),
    )
    rows = rows.select("doc_id", F.coalesce("keywords", none).alias("keywords"), "before", F.posexplode(F.slice(found, 1, most)).alias("n", "a"))
    return rows.select("doc_id", "n", "a.purpose", "keywords", "a.required", "a.classes", "before")


def seconds(queries: Column, corpus: Column, with_model: Column, claims: Column) -> Column:
    """The estimated seconds of a run, to one place, half to even."""
    n = F.greatest(F.lit(1), queries)
    scan = F.lit(0.3) * F.log10(corpus + 10)
    agent = (BASE_STEPS + 2 * n) * (STEP_SECONDS + scan)
    return F.bround(F.when(with_model, agent).otherwise(2.0 + n * (0.5 + scan)) + CLAIM_SECONDS * F.greatest(F.lit(0), claims), 1)


def revised(plan: DataFrame, feedback: DataFrame) -> DataFrame:
    """plan rows (n, ...) after feedback(n, verdict): those found irrelevant go; a row without feedback stays."""
    return plan.join(feedback.where(F.lower("verdict") == "irrelevant").select("n"), "n", "left_anti")


def voted(votes: DataFrame, top: int = 15) -> DataFrame:
    """keyword, votes and n over rows (vote, seq, keyword): by how many lists name it, then first place."""
    rows = votes.select("vote", "seq", F.lower(F.trim("keyword")).alias("keyword")).where("keyword <> ''")
    rows = rows.groupBy("keyword").agg(F.countDistinct("vote").alias("votes"), F.min("seq").alias("_first"))
    return rows.orderBy(F.desc("votes"), "_first").limit(top).drop("_first")

"""BM25 over fields with boosts, for a whole table of queries in one job.

The index is two tables: postings (doc_id, term, tf), where tf is the sum of the fields' counts times their boosts,
and the documents' lengths in tokens of all fields. A search joins the postings with the queries' terms,
which are broadcast if few, so that only terms somebody asks for are shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import tokens

from .filters import Query, condition, document_terms, matched_keywords, required_groups, with_numbers

K1, B = 1.5, 0.75
#: Weights of a term in a title, an abstract, the claims, a specification.
BOOSTS = {"title": 2.0, "abstract": 1.2, "claims": 1.5, "specification": 1.0}
WINDOW, PASSAGES = 240, 3
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Index:
    """postings: doc_id, term, tf (boosted), hits; lengths: doc_id, length."""

    postings: DataFrame
    lengths: DataFrame

    def save(self, folder: str, buckets: int = 64) -> None:
        """Writes both tables; postings by a hash of the term, so that a search reads the buckets of its terms."""
        self.postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets))).write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{folder}/lengths")

    @staticmethod
    def load(spark, folder: str) -> Index:
        return Index(spark.read.parquet(f"{folder}/postings").drop("bucket"), spark.read.parquet(f"{folder}/lengths"))


def build(docs: DataFrame, fields: tuple[str, ...] = ("title", "specification")) -> Index:
    """An index of docs(doc_id, the fields); a later row of a doc_id must replace the earlier before."""
    weighted = [F.transform(tokens(F.col(f)), _weighted(BOOSTS[f])) for f in fields]
    rows = docs.select("doc_id", F.explode(F.concat(*weighted)).alias("t"))
    postings = rows.groupBy("doc_id", F.col("t.term").alias("term")).agg(F.sum("t.boost").alias("tf"))
    length = sum((F.size(tokens(F.col(f))) for f in fields[1:]), F.size(tokens(F.col(fields[0]))))
    return Index(postings, docs.select("doc_id", length.cast("long").alias("length")))


def _weighted(boost: float):
    return lambda t: F.struct(t.alias("term"), F.lit(boost).alias("boost"))


def upsert(docs: DataFrame, newer: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with the rows of newer in place of those of the same key."""
    return docs.join(newer.select(key).distinct(), key, "left_anti").unionByName(newer)


def scored(index: Index, queries: DataFrame, candidates: DataFrame | None = None, held: bool = False) -> DataFrame:
    """query_id, doc_id and score over queries(query_id, term, distinct), for documents with any term; held: and how many terms.

    Queries of BROADCAST_ROWS or less are broadcast: terms that nobody asks for and what each term adds to a pair are not shuffled.
    Frequencies and the mean length are those of all documents; candidates (doc_id) only says which are scored.
    """
    stats = index.lengths.agg(F.count("*").alias("n"), F.greatest(F.avg("length"), F.lit(1.0)).alias("mean"))
    few = queries.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    spread = F.broadcast if few else lambda frame: frame
    wanted = spread(queries.select("term").distinct())
    postings = index.postings.join(wanted, "term", "left_semi")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    if candidates is not None:
        postings = postings.join(candidates.select("doc_id"), "doc_id", "left_semi")
    rows = postings.join(spread(df), "term").join(index.lengths, "doc_id").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("length") / F.col("mean"))
    rows = rows.select("term", "doc_id", (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("part"))
    more = [F.count("*").alias("_held")] if held else []
    return rows.join(spread(queries), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"), *more)


def ranked(scores: DataFrame, k: int, tie: str = "doc_id") -> DataFrame:
    """The k best rows of each query with a rank from 1; equal scores by tie."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), tie)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def terms(queries: DataFrame, text: Column) -> DataFrame:
    """query_id and each distinct term of the text."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(text))).alias("term"))


def search(docs: DataFrame, query: Query, index: Index | None = None) -> DataFrame:
    """One query with all its filters over docs(doc_id, doc_key, title, specification, assignee, cpc, effective, country):
    doc_id, score, matched, in order; at most its limit. Of further columns, abstract and claims (structs with a text) are
    searched for what is excluded, and inventors, an array of names, for those.

    Without any term every document that passes the filters is returned, with score 0.
    """
    spark = docs.sparkSession
    index = index or build(docs)
    held = document_terms(F.col("title"), F.col("specification"))
    parts = [F.col(c) for c in ("title", "abstract", "specification") if c in docs.columns]
    if "claims" in docs.columns:
        parts.append(F.array_join(F.col("claims.text"), "\n"))
    inventors = F.col("inventors") if "inventors" in docs.columns else None
    rows = with_numbers(docs, query).where(condition(query, F.concat_ws("\n", *parts), assignees=F.array("assignee"), inventors=inventors))
    rows = rows.withColumn("_terms", held).where(required_groups(query, F.col("_terms"))).withColumn("matched", matched_keywords(query, F.col("_terms")).cast("long"))
    rows = rows.where(F.col("matched") >= query.least_match()).select("doc_id", "matched")
    asked = spark.createDataFrame([(0, t) for t in dict.fromkeys(_words(query))], "query_id long, term string")
    if not _words(query):
        return rows.withColumn("score", F.lit(0.0)).orderBy("doc_id").limit(query.limit)
    scores = scored(index, asked, rows).where("score > 0")
    return rows.join(scores.drop("query_id"), "doc_id").orderBy(F.desc("score"), "doc_id").limit(query.limit)


def _words(query: Query) -> list[str]:
    return [t for part in (*query.keywords, query.text) for t in re.findall("[a-z0-9]+", part.lower())]


def highlights(rows: DataFrame, text: Column, wanted: Column, window: int = WINDOW, most: int = PASSAGES) -> DataFrame:
    """rows with passages: the windows of the text with the most wanted tokens, best first, then in order."""
    count = F.ceil(F.length(text) / window).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    def passage(i: Column) -> Column:
        part = F.substring(text, i * window + 1, F.lit(window))
        hits = F.size(F.filter(tokens(part), lambda t: F.array_contains(wanted, t)))
        return F.struct((-hits).alias("order"), (i * window).alias("start"), F.trim(part).alias("text"))

    found = F.filter(F.transform(starts, passage), lambda p: p["order"] < 0)
    return rows.withColumn("passages", F.slice(F.array_sort(found), 1, most))

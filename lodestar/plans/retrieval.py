"""Catalog: identity, filters, retrieval, fusion, evaluation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import evaluate, fusion, keyword, vector
from lodestar.operators.filters import Query

from .domain import PATENTS_SQL, patents, table

CUTOFF, SINCE = date(2020, 1, 1), date(1995, 6, 1)
COUNTRIES = ("US", "DE", "FR")


# ---- identity

_FORMS = ["'US' || n || 'B2'", "'us ' || n", "substr(n,1,1) || ',' || substr(n,2,3) || ',' || substr(n,5,3)", "'EP' || n || 'A1'", "'RE' || n", "'US00' || n", "'not a patent ' || n", "'US 2020/' || n || ' A1'", "'USD' || n"]


def identity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in several written forms, taken apart and compared."""
    n = F.col("n")
    forms = [F.concat(F.lit("US"), n, F.lit("B2")), F.concat(F.lit("us "), n), F.concat(F.substring(n, 1, 1), F.lit(","), F.substring(n, 2, 3), F.lit(","), F.substring(n, 5, 3)), F.concat(F.lit("EP"), n, F.lit("A1")), F.concat(F.lit("RE"), n), F.concat(F.lit("US00"), n), F.concat(F.lit("not a patent "), n), F.concat(F.lit("US 2020/"), n, F.lit(" A1")), F.concat(F.lit("USD"), n)]
    raw = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") + 7000000).cast("string").alias("n")).select("doc_id", F.explode(F.array(*forms)).alias("raw"))
    p = raw.withColumn("p", T.number_parts(F.col("raw")))
    return p.select("doc_id", "raw", "p.country_code", "p.number", "p.kind_code", T.number_display(F.col("p")).alias("display"), T.number_key(F.col("p")).alias("doc_key"), T.reference_key(F.col("raw")).alias("ref_key"))


_PATTERN = r"^([A-Z]{2})?[- ]?([A-Z]?[0-9][0-9,./]*[0-9]|[0-9])[- ]?([A-Z][0-9]?)?$"
IDENTITY_SQL = rf"""
WITH b AS (SELECT doc_id, CAST(doc_id + 7000000 AS VARCHAR) AS n FROM documents),
r AS (SELECT doc_id, unnest([{", ".join(_FORMS)}]) AS raw FROM b),
q AS (SELECT *, translate(upper(regexp_replace(raw, '^\s+|\s+$', '', 'g')), ',/ ', '') AS t FROM r),
m AS (SELECT *, regexp_matches(t, '{_PATTERN}') AS ok, nullif(regexp_extract(t, '{_PATTERN}', 1), '') AS g1,
      nullif(regexp_extract(t, '{_PATTERN}', 2), '') AS g2, nullif(regexp_extract(t, '{_PATTERN}', 3), '') AS g3 FROM q),
p AS (SELECT doc_id, raw, CASE WHEN ok THEN coalesce(g1, 'US') END AS country_code, CASE WHEN ok THEN regexp_replace(g2, '[,./]', '', 'g') END AS number,
      CASE WHEN ok THEN g3 END AS kind_code FROM m),
k AS (SELECT *, country_code || coalesce(nullif(ltrim(number, '0'), ''), '0') AS doc_key FROM p)
SELECT doc_id, raw, country_code, number, kind_code, country_code || number || coalesce(kind_code, '') AS display, doc_key,
       coalesce(doc_key, upper(trim(raw))) AS ref_key FROM k
"""


def effective_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date a patent counts from, and lenient parsing of compact dates."""
    p = patents(spark, sf_dir)
    compact = F.when(F.col("doc_id") % 5 == 0, F.lit("20161399")).otherwise(F.date_format("filing_date", "yyyyMMdd"))
    return p.select("doc_id", T.effective_date(F.col("priority_date"), F.col("filing_date"), F.lit("2001-02-03").cast("date")).alias("effective"), T.compact_date(compact).alias("parsed"))


EFFECTIVE_SQL = f"""
WITH {PATENTS_SQL}
SELECT doc_id, coalesce(least(priority_date, filing_date), DATE '2001-02-03') AS effective,
       CASE WHEN doc_id % 5 <> 0 THEN filing_date END AS parsed FROM patents
"""


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector.chunk_table(patents(spark, sf_dir))
    return rows.select("doc_id", F.col("chunk_number").cast("long").alias("chunk_number"), F.size(F.split("chunk", " ")).cast("long").alias("words"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


CHUNK_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) + 1, 560)) AS pos FROM w)
SELECT doc_id, CAST((pos - 1) / 560 AS BIGINT) AS chunk_number, CAST(len(w[pos:pos + 699]) AS BIGINT) AS words, md5(array_to_string(w[pos:pos + 699], ' ')) AS digest FROM s
"""


# ---- BM25

_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_INDEX_SQL = f"""
tok AS (SELECT doc_id, {_TOK.format("coalesce(title, '')")} AS t, {_TOK.format("coalesce(specification, '')")} AS s FROM patents),
post AS (SELECT doc_id, term, sum(boost) AS tf FROM (SELECT doc_id, unnest(t) AS term, 2.0::DOUBLE AS boost FROM tok UNION ALL SELECT doc_id, unnest(s), 1.0::DOUBLE FROM tok) GROUP BY ALL),
lens AS (SELECT doc_id, CAST(len(t) + len(s) AS BIGINT) AS length FROM tok),
stats AS (SELECT count(*) AS n, greatest(avg(length), 1.0) AS mean FROM lens),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
parts AS (SELECT term, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean)) AS part
          FROM post JOIN df USING (term) JOIN lens USING (doc_id) CROSS JOIN stats)
"""


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs = patents(spark, sf_dir)
    index = keyword.build(docs)
    candidates = docs.where(F.col("country").isin(*COUNTRIES) & (F.col("effective") < F.lit(CUTOFF)))
    return keyword.ranked(keyword.scored(index, keyword.terms(_benchmark(spark, sf_dir), F.col("text")), candidates), k)


def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item, of three countries and before a date."""
    return _bm25(spark, sf_dir, 10).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), "score")


_BM25_SQL = f"""
{PATENTS_SQL}, {_INDEX_SQL},
q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK.format("text")}) AS term FROM benchmark),
sc AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM parts JOIN q USING (term)
       WHERE doc_id IN (SELECT doc_id FROM patents WHERE country IN ('US', 'DE', 'FR') AND effective < DATE '2020-01-01') GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)
"""
BM25_SQL = f"WITH {_BM25_SQL} SELECT query_id, doc_id, rank, score FROM bm WHERE rank <= 10"

FILTERED = Query(keywords=("the", "edthe thion", "of", "ing", "erst", "and"), required=("the",), excluded=("trash",), text="thin ered of", classes=("G06F1", "G06F2", "H04L3"), assignees=("SRC1",), before=CUTOFF, after=SINCE, countries=("US", "DE"), deny=("US7000010", "US7000011"), limit=40)


def search_with_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search that uses every filter."""
    return keyword.search(patents(spark, sf_dir), FILTERED)


FILTERED_SQL = f"""
WITH {PATENTS_SQL}, {_INDEX_SQL},
f AS (SELECT p.doc_id, list_distinct(list_concat(t, s)) AS terms FROM patents p JOIN tok USING (doc_id)
      WHERE country IN ('US', 'DE') AND effective < DATE '2020-01-01' AND effective > DATE '1995-06-01'
        AND len(list_filter(cpc, lambda c: starts_with(c, 'G06F1') OR starts_with(c, 'G06F2') OR starts_with(c, 'H04L3'))) > 0
        AND contains(lower(assignee), 'src1') AND NOT contains(lower(concat_ws(chr(10), title, specification)), 'trash')
        AND doc_key NOT IN ('US7000010', 'US7000011')),
g AS (SELECT doc_id, CAST((list_contains(terms, 'the'))::INT + (list_contains(terms, 'edthe') AND list_contains(terms, 'thion'))::INT + list_contains(terms, 'of')::INT
        + list_contains(terms, 'ing')::INT + list_contains(terms, 'erst')::INT + list_contains(terms, 'and')::INT AS BIGINT) AS matched
      FROM f WHERE list_contains(terms, 'the')),
q AS (SELECT unnest(['the', 'edthe', 'thion', 'of', 'ing', 'erst', 'and', 'thin', 'ered']) AS term),
sc AS (SELECT doc_id, round(sum(part), 6) AS score FROM parts JOIN q USING (term) GROUP BY doc_id)
SELECT doc_id, matched, score FROM g JOIN sc USING (doc_id) WHERE matched >= 2 AND score > 0 ORDER BY score DESC, doc_id LIMIT 40
"""


def highlight_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the three windows with the most tokens of a term list."""
    wanted = F.array(*map(F.lit, ("the", "of", "and", "der", "les", "que")))
    rows = keyword.highlights(patents(spark, sf_dir).select("doc_id", "specification"), F.col("specification"), wanted)
    return rows.select("doc_id", F.posexplode("passages").alias("n", "p")).select("doc_id", F.col("n").cast("long").alias("n"), (-F.col("p.order")).cast("long").alias("hits"), F.col("p.start").cast("long").alias("start"))


HIGHLIGHT_SQL = """
WITH w AS (SELECT doc_id, text, unnest(range(0, length(text), 240)) AS start FROM documents),
h AS (SELECT doc_id, start, len(list_filter(regexp_extract_all(lower(substr(text, CAST(start + 1 AS BIGINT), 240)), '[a-z0-9]+'), lambda t: t IN ('the', 'of', 'and', 'der', 'les', 'que'))) AS hits FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, start) - 1 AS n FROM h WHERE hits > 0)
SELECT doc_id, n, CAST(hits AS BIGINT) AS hits, CAST(start AS BIGINT) AS start FROM r WHERE n < 3
"""


# ---- vectors and fusion


def vector_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors by cosine of every vector whose id is a multiple of 50, among all."""
    rows = table(spark, sf_dir, "embeddings")
    return vector.nearest(rows, rows.where("vec_id % 50 = 0"), 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), "score")


_COSINE = """
v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM v),
c AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.e, b.e) / (a.s * b.s), 6) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
vn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM c)
"""
VECTOR_SQL = f"WITH {_COSINE} SELECT query_id, vec_id, rank, score + 0.0 AS score FROM vn WHERE rank <= 10"


def best_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents whose best chunk is nearest to each benchmark item, by hashed embeddings."""
    best = vector.best_chunk(patents(spark, sf_dir), _benchmark(spark, sf_dir))
    return keyword.ranked(best, 10).select("query_id", "doc_id", F.col("chunk_number").cast("long").alias("chunk_number"), "score", F.col("rank").cast("long").alias("rank"))


_BUCKET = "CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS INTEGER)"
_BEST = rf"""
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
ch AS (SELECT doc_id, CAST((pos - 1) / 560 AS BIGINT) AS chunk_number, array_to_string(w[pos:pos + 699], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1, 560)) AS pos FROM w)),
ct AS (SELECT doc_id, chunk_number, {_BUCKET} AS dim, count(*) AS n FROM (SELECT doc_id, chunk_number, unnest({_TOK.format("chunk")}) AS t FROM ch) GROUP BY ALL),
cv AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, chunk_number)) AS weight FROM ct),
qt AS (SELECT query_id, {_BUCKET} AS dim, count(*) AS n FROM (SELECT item_id AS query_id, unnest({_TOK.format("text")}) AS t FROM benchmark) GROUP BY ALL),
qv AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS q_weight FROM qt),
cs AS (SELECT query_id, doc_id, chunk_number, round(sum(weight * q_weight), 6) AS score FROM cv JOIN qv USING (dim) GROUP BY ALL),
bc AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_number) AS k FROM cs),
br AS (SELECT query_id, doc_id, chunk_number, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bc WHERE k = 1)
"""
BEST_SQL = f"WITH {_BEST} SELECT query_id, doc_id, chunk_number, score, rank FROM br WHERE rank <= 10"


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and best-chunk rankings of 50 fused by reciprocal ranks."""
    vectors = keyword.ranked(vector.best_chunk(patents(spark, sf_dir), _benchmark(spark, sf_dir)), 50)
    return fusion.hybrid(_bm25(spark, sf_dir, 50), vectors, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


HYBRID_SQL = f"""
WITH {_BM25_SQL}, {_BEST},
al AS (SELECT query_id, doc_id, rank FROM bm WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, rank FROM br WHERE rank <= 50),
fu AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS s FROM al GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM fu)
SELECT query_id, doc_id, round(s, 6) AS score, rank FROM fr WHERE rank <= 10
"""


def zscore_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores of each order, made standard and added with weights."""
    orders = table(spark, sf_dir, "orders")
    one = orders.select(F.lit("price").alias("system"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("score"))
    two = orders.select(F.lit("customer"), "o_orderkey", F.col("o_custkey").cast("double"))
    same = orders.select(F.lit("same"), "o_orderkey", F.lit(1.0))
    return fusion.combined(one.union(two).union(same), {"customer": 3.0}).select("key", F.round("score", 6).alias("score"))


ZSCORE_SQL = """
SELECT o_orderkey AS key, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER ()
       + 3.0 * (o_custkey - avg(o_custkey) OVER ()) / stddev_pop(o_custkey) OVER (), 6) AS score FROM orders
"""


# ---- evaluation


def _qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item's whole text; the items are a small stated set."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    return docs.join(F.broadcast(_benchmark(spark, sf_dir)), F.contains("body", "text")).select("query_id", F.col("doc_id").alias("ref"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 100).select("query_id", "rank", F.col("doc_id").alias("ref"))


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(_predictions(spark, sf_dir), _qrels(spark, sf_dir))


_EVAL = f"""
{_BM25_SQL},
rel AS (SELECT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
nr AS (SELECT query_id, count(DISTINCT doc_id) AS n FROM rel GROUP BY query_id),
hit AS (SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM bm JOIN rel USING (query_id, doc_id) WHERE rank <= 100),
pq AS (SELECT query_id, n AS n_references, round(coalesce(count(rank) FILTER (rank <= 10), 0) / n, 6) AS recall_10, round(coalesce(count(rank) FILTER (rank <= 25), 0) / n, 6) AS recall_25,
       round(coalesce(count(rank) FILTER (rank <= 50), 0) / n, 6) AS recall_50, round(coalesce(count(rank) FILTER (rank <= 100), 0) / n, 6) AS recall_100,
       round(coalesce(1 / min(rank), 0), 6) AS mrr, round(coalesce(sum(nth / rank), 0) / n, 6) AS map FROM nr LEFT JOIN hit USING (query_id) GROUP BY query_id, n)
"""
METRICS_SQL = f"WITH {_EVAL} SELECT * FROM pq"


def eval_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.aggregates(evaluate.metrics(_predictions(spark, sf_dir), _qrels(spark, sf_dir)))


AGGREGATES_SQL = f"""
WITH {_EVAL}, a AS (SELECT avg(recall_10) r10, avg(recall_25) r25, avg(recall_50) r50, avg(recall_100) r100, avg(mrr) mrr, avg(map) map FROM pq)
SELECT 'recall_10' AS metric, round(r10, 6) AS value FROM a UNION ALL SELECT 'recall_25', round(r25, 6) FROM a UNION ALL SELECT 'recall_50', round(r50, 6) FROM a
UNION ALL SELECT 'recall_100', round(r100, 6) FROM a UNION ALL SELECT 'mrr', round(mrr, 6) FROM a UNION ALL SELECT 'map', round(map, 6) FROM a
"""


def recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean recall at 1 to 50."""
    return evaluate.curve(_predictions(spark, sf_dir), _qrels(spark, sf_dir), 50)


CURVE_SQL = f"""
WITH {_EVAL}, g AS (SELECT query_id, n, k FROM nr CROSS JOIN (SELECT unnest(range(1, 51)) AS k)),
rc AS (SELECT g.query_id, k, n, count(rank) AS h FROM g LEFT JOIN hit ON hit.query_id = g.query_id AND rank <= k GROUP BY ALL)
SELECT CAST(k AS INTEGER) AS k, round(avg(h / n), 6) AS recall FROM rc GROUP BY k
"""


def judgment_querysets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event types as references, the last event of a type deciding whether it is relevant."""
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("ref"), (F.col("value") >= 50).alias("relevant"), F.col("event_id").alias("seq"))
    return evaluate.querysets(rows).select("query_id", F.array_join("references", ",").alias("references"), F.array_join("rejected", ",").alias("rejected"))


JUDGMENT_SQL = """
WITH l AS (SELECT user_id, event_type, value >= 50 AS relevant, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events)
SELECT user_id AS query_id, string_agg(event_type, ',' ORDER BY event_type) FILTER (relevant) AS references,
       coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (NOT relevant), '') AS rejected
FROM l WHERE k = 1 GROUP BY user_id HAVING count(*) FILTER (relevant) > 0
"""

QUERIES = {f.__name__: f for f in (identity_parse, effective_dates, chunk_texts, bm25_top10, search_with_filters, highlight_passages, vector_top10, best_chunks, hybrid_rrf, zscore_fusion, eval_metrics, eval_aggregates, recall_curve, judgment_querysets)}
ORACLES = {
    "identity_parse": IDENTITY_SQL,
    "effective_dates": EFFECTIVE_SQL,
    "chunk_texts": CHUNK_SQL,
    "bm25_top10": BM25_SQL,
    "search_with_filters": FILTERED_SQL,
    "highlight_passages": HIGHLIGHT_SQL,
    "vector_top10": VECTOR_SQL,
    "best_chunks": BEST_SQL,
    "hybrid_rrf": HYBRID_SQL,
    "zscore_fusion": ZSCORE_SQL,
    "eval_metrics": METRICS_SQL,
    "eval_aggregates": AGGREGATES_SQL,
    "recall_curve": CURVE_SQL,
    "judgment_querysets": JUDGMENT_SQL,
}

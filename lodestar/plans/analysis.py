"""Catalog: planning, searches, reconciling, charts, graph, topics, page lines."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import charts, cluster, graph, keyword, locate, reconcile

from . import planner, searches
from .domain import PATENTS_SQL, patents, table

_PLAN_STOP = ", ".join(f"'{w}'" for w in T.PLANNER_STOPWORDS)
_TOPIC_STOP = ", ".join(f"'{w}'" for w in T.TOPIC_STOPWORDS)


def _keep(text: str, digits: bool = False) -> str:
    number = "" if digits else " AND NOT regexp_matches(t, '^[0-9]+$')"
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({_PLAN_STOP}){number})"


# ---- planning


def planner_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight keywords of each document, title terms first."""
    rows = planner.keywords(patents(spark, sf_dir), "doc_id", F.col("title"), F.col("specification"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), "keyword")


_KEYWORDS = f"""
kt AS (SELECT doc_id, {_keep("title")} AS a, {_keep("specification")} AS b FROM patents),
kw AS (SELECT doc_id, unnest(list_concat(list_transform(a, lambda x: {{'t': x, 'title': true}}), list_transform(b, lambda x: {{'t': x, 'title': false}}))) AS w,
       unnest(range(len(a) + len(b))) AS pos FROM kt),
kc AS (SELECT doc_id, w.t AS keyword, min(pos) FILTER (w.title) AS ft, count(*) FILTER (NOT w.title) AS c, min(pos) AS fp FROM kw GROUP BY ALL),
kr AS (SELECT doc_id, keyword, row_number() OVER (PARTITION BY doc_id ORDER BY ft ASC NULLS LAST, c DESC, fp) - 1 AS n FROM kc)
"""
KEYWORDS_SQL = f"WITH {PATENTS_SQL}, {_KEYWORDS} SELECT doc_id, n, keyword FROM kr WHERE n < 8"


def plan_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The starting angles of a prior-art search for every document."""
    rows = planner.angles(patents(spark, sf_dir))
    list_ = lambda c: F.array_join(c, ",").alias(c)
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), "purpose", list_("keywords"), list_("required"), list_("classes"), "before")


ANGLES_SQL = f"""
WITH {PATENTS_SQL}, {_KEYWORDS},
k AS (SELECT doc_id, string_agg(keyword, ',' ORDER BY n) AS keywords FROM kr WHERE n < 8 GROUP BY doc_id),
t AS (SELECT p.doc_id, coalesce(keywords, '') AS keywords, effective AS before, ({_keep("title", True)})[1:3] AS req,
      array_to_string(list_sort(list_distinct(list_transform(cpc, lambda c: substr(c, 1, 4))))[1:4], ',') AS cls FROM patents p LEFT JOIN k USING (doc_id)),
a AS (SELECT doc_id, 0 AS o, 'broad' AS purpose, keywords, '' AS required, '' AS classes, before FROM t
      UNION ALL SELECT doc_id, 1, 'tight', keywords, array_to_string(req, ','), '', before FROM t WHERE len(req) > 0
      UNION ALL SELECT doc_id, 2, 'classification', keywords, '', cls, before FROM t WHERE cls <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS n, purpose, keywords, required, classes, before FROM a
"""


def time_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time model over many plans."""
    o = table(spark, sf_dir, "orders")
    n, claims, model = F.col("o_orderkey") % 4, F.col("o_custkey") % 3, F.col("o_orderstatus") == "O"
    s = planner.seconds(n, F.col("o_orderkey") * 10, model, claims)
    return o.select("o_orderkey", s.alias("seconds"), T.duration(s).alias("words"))


ESTIMATES_SQL = """
WITH p AS (SELECT o_orderkey, greatest(1, o_orderkey % 4) AS n, o_custkey % 3 AS c, o_orderstatus = 'O' AS m, 0.3::DOUBLE * log10(o_orderkey * 10 + 10) AS f FROM orders),
s AS (SELECT o_orderkey, round_even(CASE WHEN m THEN (4 + 2 * n) * (5.0::DOUBLE + f) ELSE 2.0::DOUBLE + n * (0.5::DOUBLE + f) END + 45.0::DOUBLE * c, 1) AS s FROM p)
SELECT o_orderkey, s AS seconds, CASE WHEN s < 90 THEN CAST(CAST(round_even(s, 0) AS BIGINT) AS VARCHAR) || ' seconds' WHEN s < 5400 THEN printf('%.1f', round(s / 60, 1)) || ' minutes' ELSE printf('%.1f', round(s / 3600, 1)) || ' hours' END AS words FROM s
"""


def keyword_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversation turns, each turn a list that votes."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("vote"), F.posexplode(F.split("text", " ")).alias("p", "keyword"))
    rows = rows.select("vote", (F.col("vote") * 100000 + F.col("p")).alias("seq"), "keyword")
    return planner.voted(rows, 25).select("keyword", F.col("votes").cast("long").alias("votes"))


VOTES_SQL = """
WITH s AS (SELECT conv_id * 1000 + turn AS vote, string_split(text, ' ') AS w FROM conversations),
k AS (SELECT vote, unnest(w) AS keyword, unnest(range(len(w))) AS p FROM s),
g AS (SELECT lower(trim(keyword)) AS keyword, count(DISTINCT vote) AS votes, min(vote * 100000 + p) AS first FROM k WHERE keyword <> '' GROUP BY 1)
SELECT keyword, votes FROM g ORDER BY votes DESC, first LIMIT 25
"""


# ---- searches


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is a multiple of 50 asks, as a stated query set."""
    return patents(spark, sf_dir).where("doc_id % 50 = 0").withColumn("query_id", F.col("doc_id"))


def _citations(docs: DataFrame) -> DataFrame:
    near = F.explode(F.array(F.col("doc_id") + 1, F.col("doc_id") + 2, F.col("doc_id") + 3))
    rows = docs.select("doc_id", F.col("doc_key").alias("src_key"), near.alias("to"))
    to = docs.select(F.col("doc_id").alias("to"), F.col("doc_key").alias("dst_key"))
    return rows.join(to, "to").select("src_key", "dst_key", (F.col("to") % 2 == 0).alias("is_examiner"))


def prior_art(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = patents(spark, sf_dir), _targets(spark, sf_dir)
    edges = _citations(docs)
    excluded = searches.exclusions(targets, edges, edges.where("not is_examiner"), ["US7000002"])
    return searches.prior_art(docs, targets, excluded, 10).drop("why")


_TOK = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
_SCORES = f"""
tok AS (SELECT doc_id, {_TOK.format("title")} AS t, {_TOK.format("specification")} AS s FROM patents),
post AS (SELECT doc_id, term, sum(boost) AS tf FROM (SELECT doc_id, unnest(t) AS term, 2.0::DOUBLE AS boost FROM tok UNION ALL SELECT doc_id, unnest(s), 1.0::DOUBLE FROM tok) GROUP BY ALL),
stats AS (SELECT count(*) AS n, greatest(avg(len(t) + len(s)), 1.0) AS mean FROM tok),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
parts AS (SELECT term, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * (len(t) + len(s)) / mean)) AS part
          FROM post JOIN df USING (term) JOIN tok USING (doc_id) CROSS JOIN stats)
"""
_HELD = "hl AS (SELECT query_id, doc_id, count(*) AS held FROM post JOIN ws ON ws.keyword = post.term GROUP BY ALL), nd AS (SELECT query_id, greatest(1, count(*) // 3) AS need FROM ws GROUP BY query_id)"
PRIOR_SQL = f"""
WITH {PATENTS_SQL}, {_KEYWORDS}, {_SCORES},
ws AS (SELECT doc_id AS query_id, keyword FROM kr WHERE n < 8 AND doc_id % 50 = 0), {_HELD},
ed AS (SELECT p.doc_id AS query_id, o.doc_key FROM patents p JOIN patents o ON o.doc_id BETWEEN p.doc_id + 1 AND p.doc_id + 3 WHERE p.doc_id % 50 = 0),
ex AS (SELECT doc_id AS query_id, doc_key FROM patents WHERE doc_id % 50 = 0 UNION SELECT * FROM ed UNION SELECT doc_id, 'US7000002' FROM patents WHERE doc_id % 50 = 0),
sc AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM parts JOIN ws ON ws.keyword = parts.term GROUP BY ALL),
ok AS (SELECT sc.* FROM sc JOIN hl USING (query_id, doc_id) JOIN nd USING (query_id) JOIN patents d USING (doc_id) JOIN patents q ON q.doc_id = query_id
       WHERE held >= need AND score > 0 AND (q.effective IS NULL OR d.effective < q.effective) AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.query_id = sc.query_id AND ex.doc_key = d.doc_key)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ok)
SELECT query_id, doc_id, rank, round(score / max(score) OVER (PARTITION BY query_id), 4) AS score FROM r WHERE rank <= 10
"""


def freedom_to_operate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patents of one country in force on a day, for each benchmark item as a product."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return searches.freedom_to_operate(patents(spark, sf_dir), items, date(2026, 1, 1), "US", True, 10).drop("why")


FTO_SQL = f"""
WITH {PATENTS_SQL}, {_SCORES},
kx AS (SELECT item_id AS query_id, {_keep("text")} AS a FROM benchmark),
kp AS (SELECT query_id, unnest(a) AS keyword, unnest(range(len(a))) AS pos FROM kx),
kn AS (SELECT query_id, keyword, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(pos)) AS n FROM kp GROUP BY query_id, keyword),
ws AS (SELECT query_id, keyword FROM kn WHERE n <= 8), {_HELD},
qt AS (SELECT query_id, keyword AS term FROM ws UNION SELECT item_id, unnest({_TOK.format("text")}) FROM benchmark),
sc AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM parts JOIN qt USING (term) GROUP BY ALL),
ok AS (SELECT sc.* FROM sc JOIN hl USING (query_id, doc_id) JOIN nd USING (query_id) JOIN patents d USING (doc_id) WHERE held >= need AND score > 0 AND country = 'US' AND effective > DATE '2026-01-01' - 7670),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ok)
SELECT query_id, doc_id, rank, round(score / max(score) OVER (PARTITION BY query_id), 4) AS score FROM r WHERE rank <= 10
"""


def infringement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ranked against a limitation made of each benchmark item's text; the item's number picks its candidates."""
    items = table(spark, sf_dir, "benchmark")
    limits = items.select(F.col("item_id").alias("query_id"), F.array(F.col("text"), F.lit("a steel valve of red copper wherein brass is polished")).alias("limitations"))
    parts = table(spark, sf_dir, "part")
    n = items.count()
    products = parts.select((F.col("p_partkey") % n).alias("query_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.when(F.col("p_size") > 25, F.lit("polished valve")).alias("evidence"))
    return searches.infringement(limits, products, 10)


INFRINGEMENT_SQL = f"""
WITH l AS (SELECT item_id AS query_id, list_distinct({_keep("text || chr(10) || 'a steel valve of red copper wherein brass is polished'", True)}) AS w FROM benchmark),
p AS (SELECT p_partkey % (SELECT count(*) FROM benchmark) AS query_id, p_partkey AS pos, p_name AS name,
      list_distinct({_TOK.format("concat_ws(' ', p_name, p_type, CASE WHEN p_size > 25 THEN 'polished valve' END)")}) AS t FROM part WHERE coalesce(p_name, '') <> '' OR coalesce(p_type, '') <> ''),
s AS (SELECT query_id, pos, name, CASE WHEN len(w) > 0 THEN round(len(list_intersect(t, w)) / len(w), 4) ELSE 0.0 END AS score FROM p JOIN l USING (query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM s)
SELECT query_id, pos, name, CAST(score AS DOUBLE) AS score, rank FROM r WHERE rank <= 10
"""


def citation_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers within three hops of every part whose key is a multiple of 50."""
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst"))
    seeds = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("key"))
    return graph.neighbours(edges, seeds, 3).select("key", F.col("hop").cast("long").alias("hop"))


NEIGHBOURS_SQL = """
WITH e AS (SELECT DISTINCT l_partkey AS a, -l_suppkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
h0 AS (SELECT p_partkey AS key FROM part WHERE p_partkey % 50 = 0),
h1 AS (SELECT DISTINCT b AS key FROM u JOIN h0 ON h0.key = a WHERE b NOT IN (SELECT key FROM h0)),
h2 AS (SELECT DISTINCT b AS key FROM u JOIN h1 ON h1.key = a WHERE b NOT IN (SELECT key FROM h0 UNION SELECT key FROM h1)),
h3 AS (SELECT DISTINCT b AS key FROM u JOIN h2 ON h2.key = a WHERE b NOT IN (SELECT key FROM h0 UNION SELECT key FROM h1 UNION SELECT key FROM h2))
SELECT key, 0::BIGINT AS hop FROM h0 UNION ALL SELECT key, 1 FROM h1 UNION ALL SELECT key, 2 FROM h2 UNION ALL SELECT key, 3 FROM h3
"""


# ---- reconciling


def _seq() -> Column:
    """A place for each line; those with equal places are equal."""
    return F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey") * 10**6 + F.col("l_quantity").cast("long") * 1000 + F.col("l_suppkey") % 1000


_SEQ = "(l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_quantity::BIGINT * 1000 + l_suppkey % 1000)"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as records of the order: the return flag is the source, the ship mode of its date the title."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("doc_key"),
        (F.col("l_suppkey") % 4).cast("int").alias("fidelity"),
        _seq().alias("ingest_seq"),
        F.when(F.col("l_quantity") > 20, F.concat(F.lit("t"), F.col("l_partkey").cast("string"))).alias("title"),
        F.when(F.col("l_tax") > 0.03, F.col("l_linestatus")).alias("status"),
        F.when(F.col("l_quantity") > 30, F.array(F.concat(F.lit("c"), F.col("l_partkey").cast("string")))).otherwise(F.array().cast("array<string>")).alias("claims"),
        F.array(F.concat(F.lit("Inv"), (F.col("l_suppkey") % 5).cast("string")), F.concat(F.lit("inv"), (F.col("l_partkey") % 5).cast("string"))).alias("inventors"),
    )


def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reconcile.merged(_records(spark, sf_dir), "doc_key", ("title", "status"), ("claims",), {"inventors": None})
    join = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return rows.select("doc_key", F.col("n_records").cast("long").alias("n_records"), F.col("fidelity").cast("long").alias("fidelity"), "title", "status", join("claims"), join("inventors"))


MERGED_SQL = f"""
WITH r AS (SELECT l_orderkey AS doc_key, l_suppkey % 4 AS fidelity, CASE WHEN l_quantity > 20 THEN 't' || l_partkey END AS title, CASE WHEN l_tax > 0.03 THEN l_linestatus END AS status,
           CASE WHEN l_quantity > 30 THEN 'c' || l_partkey END AS claim, ['Inv' || (l_suppkey % 5), 'inv' || (l_partkey % 5)] AS inv,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 4 DESC, {_SEQ}) AS n FROM lineitem),
e AS (SELECT doc_key, n, unnest(inv) AS i, unnest([0, 1]) AS p FROM r),
f AS (SELECT doc_key, lower(i) AS k, arg_min(i, n * 10 + p) AS i, min(n * 10 + p) AS o FROM e GROUP BY ALL),
j AS (SELECT doc_key, string_agg(i, ',' ORDER BY o) AS inventors FROM f GROUP BY doc_key)
SELECT r.doc_key, count(*) AS n_records, CAST(max(fidelity) AS BIGINT) AS fidelity, arg_min(title, n) FILTER (title IS NOT NULL) AS title, arg_min(status, n) FILTER (status IS NOT NULL) AS status,
       coalesce(arg_min(claim, n) FILTER (claim IS NOT NULL), '') AS claims, any_value(inventors) AS inventors FROM r JOIN j USING (doc_key) GROUP BY r.doc_key
"""


def merged_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of an order's parts modulo seven, flags or-ed."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("src_key"), (F.col("l_partkey") % 7).alias("display"), (F.col("l_returnflag") == "R").alias("is_examiner"), (F.col("l_linestatus") == "O").alias("is_applicant"), (F.col("l_quantity") > 40).alias("is_third_party"), (F.col("l_discount") > 0.05).alias("is_family_to_family"), F.lit(0).alias("n"), _seq().alias("pos"))
    return reconcile.citations(rows).withColumn("n", F.col("n").cast("long"))


CITATIONS_SQL = f"""
SELECT l_orderkey AS src_key, l_partkey % 7 AS display, bool_or(l_returnflag = 'R') AS is_examiner, bool_or(l_linestatus = 'O') AS is_applicant, bool_or(l_quantity > 40) AS is_third_party,
       bool_or(l_discount > 0.05) AS is_family_to_family, row_number() OVER (PARTITION BY l_orderkey ORDER BY min({_SEQ})) - 1 AS n FROM lineitem GROUP BY l_orderkey, l_partkey % 7
"""


# ---- charts


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as limitations, suppliers modulo three as references."""
    li = table(spark, sf_dir, "lineitem")
    raw = F.when(F.col("l_returnflag") == "R", "Disclosed").when(F.col("l_returnflag") == "A", "partially disclosed").otherwise("no")
    return li.select(F.col("l_orderkey").alias("query_key"), (F.col("l_suppkey") % 3).alias("ref_key"), F.concat(F.lit("limitation "), F.col("l_linenumber").cast("string")).alias("limitation"), charts.status(raw).alias("status"), charts.risk(F.upper(F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high"), F.lit("odd")), (F.col("l_partkey") % 4 + 1).cast("int")))).alias("risk"), charts.confidence(F.col("l_tax").cast("string")).alias("confidence"))


def chart_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.coverage(_findings(spark, sf_dir)).select("query_key", "ref_key", F.col("n").cast("long").alias("n"), F.round("coverage", 6).alias("coverage"))


COVERAGE_SQL = "SELECT l_orderkey AS query_key, l_suppkey % 3 AS ref_key, count(*) AS n, round(avg((l_returnflag = 'R')::INT), 6) AS coverage FROM lineitem GROUP BY ALL"


def chart_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined coverage of the limitations with a 1 or a 3 in them."""
    return charts.combined_coverage(charts.filtered(_findings(spark, sf_dir), ["TION 1", "tion 3"])).select("query_key", F.round("coverage", 6).alias("coverage"))


COMBINED_SQL = """
WITH a AS (SELECT l_orderkey AS query_key, l_linenumber, bool_or(l_returnflag = 'R') AS d FROM lineitem WHERE CAST(l_linenumber AS VARCHAR) LIKE '1%' OR CAST(l_linenumber AS VARCHAR) LIKE '3%' GROUP BY ALL)
SELECT query_key, round(avg(d::INT), 6) AS coverage FROM a GROUP BY query_key
"""


def risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.risk_summary(_findings(spark, sf_dir), ["ref_key", "status"])


RISK_SQL = """
WITH f AS (SELECT l_suppkey % 3 AS ref_key, CASE l_returnflag WHEN 'R' THEN 'disclosed' WHEN 'A' THEN 'partially_disclosed' ELSE 'not_disclosed' END AS status, CASE l_partkey % 4 WHEN 0 THEN 'low' WHEN 2 THEN 'high' ELSE 'medium' END AS risk FROM lineitem)
SELECT ref_key, status, count(*) FILTER (risk = 'high') AS high, count(*) FILTER (risk = 'medium') AS medium, count(*) FILTER (risk = 'low') AS low FROM f GROUP BY ALL
"""


def chart_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by region that no order line of a supplier there has covered: pairs not yet charted."""
    limits = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("limitation"))
    refs = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ref_key"))
    held = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("limitation"), F.col("n_regionkey").alias("ref_key"))
    return charts.missing(limits, refs, held)


MISSING_SQL = "SELECT n_nationkey AS limitation, r_regionkey AS ref_key FROM nation, region WHERE n_regionkey <> r_regionkey"


# ---- graph


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type").isin("purchase", "signup", "click"), "accepted").when(F.col("event_type") == "error", "rejected").otherwise("unreviewed")
    return e.select(F.col("event_id").alias("seq"), (F.col("user_id") % 23).alias("cluster"), outcome.alias("outcome"), F.concat(F.lit("Phrase no. "), (F.col("user_id") % 3).cast("string")).alias("query_limitation"), F.when(F.col("user_id") % 4 > 0, F.col("user_id").cast("string")).alias("search_id"), F.col("event_type").alias("patent_id"))


def evidence_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence and stage of clusters of match pairs made of the events."""
    rows = graph.evidence(_pairs(spark, sf_dir))
    return rows.select("cluster", *[F.col(c).cast("long").alias(c) for c in ("accepted", "searches", "patents", "rejected", "aliases", "stage")])


EVIDENCE_SQL = """
WITH p AS (SELECT user_id % 23 AS cluster, CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN 'accepted' WHEN event_type = 'error' THEN 'rejected' ELSE 'unreviewed' END AS o, user_id % 3 AS a, CASE WHEN user_id % 4 > 0 THEN user_id END AS s, event_type AS t FROM events),
g AS (SELECT cluster, count(*) FILTER (o = 'accepted') AS accepted, count(DISTINCT s) FILTER (o = 'accepted') AS s, count(DISTINCT t) FILTER (o = 'accepted') AS patents, count(*) FILTER (o = 'rejected') AS rejected, count(DISTINCT a) FILTER (o = 'accepted') AS aliases FROM p GROUP BY cluster HAVING accepted > 0),
h AS (SELECT *, CASE WHEN s > 0 THEN s ELSE accepted END AS searches FROM g)
SELECT cluster, accepted, searches, patents, rejected, aliases, CAST(CASE WHEN searches >= 5 AND accepted >= 3 AND patents >= 3 AND rejected / greatest(accepted + rejected, 1) <= 0.2 THEN 3 WHEN accepted >= 3 AND searches >= 2 THEN 2 WHEN aliases >= 2 OR accepted >= 2 THEN 1 ELSE 0 END AS BIGINT) AS stage FROM h
"""


def concept_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as concepts whose aliases are the names of their brands' parts; part names as limitations."""
    parts = table(spark, sf_dir, "part")
    nodes = parts.groupBy("p_type").agg(F.min("p_partkey").alias("seq"), F.array_sort(F.collect_set("p_brand")).alias("aliases")).select("seq", F.upper(F.regexp_replace("p_type", " ", "_")).alias("canonical_name"), "aliases", F.lit(3).alias("stage"))
    limits = parts.select(F.concat(F.lit("made of "), F.lower("p_type"), F.lit(" or")).alias("limitation")).unionByName(parts.select(F.lower("p_brand").alias("limitation"))).distinct()
    rows = graph.expand(nodes, limits, threshold=None)
    return rows.select("limitation", "alias")


EXPANSION_SQL = """
WITH n AS (SELECT min(p_partkey) AS seq, p_type, list_sort(list(DISTINCT p_brand)) AS aliases FROM part GROUP BY p_type),
norm AS (SELECT seq, aliases, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS a FROM (SELECT seq, aliases, unnest(list_concat([p_type], aliases)) AS x FROM n)),
l AS (SELECT DISTINCT limitation, trim(regexp_replace(lower(limitation), '[^a-z0-9]+', ' ', 'g')) AS k FROM (SELECT 'made of ' || lower(p_type) || ' or' AS limitation FROM part UNION ALL SELECT lower(p_brand) FROM part)),
h AS (SELECT DISTINCT limitation, k, seq, aliases FROM l JOIN norm ON a <> '' AND (a = k OR (contains(a, ' ') AND contains(k, a)))),
e AS (SELECT limitation, k, seq, unnest(aliases) AS alias, unnest(range(len(aliases))) AS i FROM h),
f AS (SELECT limitation, trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')) AS ak, arg_min(alias, seq * 1000 + i) AS alias FROM e WHERE trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')) NOT IN ('', k) GROUP BY ALL)
SELECT limitation, alias FROM f
"""


def phrase_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each part's name with its type: the Jaccard part by columns, the whole by the UDF."""
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", F.round(graph.phrase_similarity("p_name", "p_type"), 6).alias("similarity"))


def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    a, b = (F.array_distinct(T.tokens(F.col(c))) for c in ("p_name", "p_type"))
    return parts.select("p_partkey", F.round(T.jaccard(a, b), 6).alias("jaccard"), T.phrase(F.col("p_brand")).alias("phrase"), T.concept_name(F.col("p_type")).alias("name"))


JACCARD_SQL = r"""
WITH t AS (SELECT *, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS b FROM part)
SELECT p_partkey, round(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6)::DOUBLE AS jaccard,
       trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS phrase, regexp_replace(regexp_replace(upper(p_type), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM t
"""


def promoted_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy promotion of the pairs whose phrases are part types."""
    e, p = table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    parts = p.select(F.col("p_partkey").alias("user_id"), F.col("p_type"))
    rows = _pairs(spark, sf_dir).join(e.select(F.col("event_id").alias("seq"), "user_id"), "seq").join(parts, "user_id", "left")
    rows = rows.select("seq", F.coalesce("p_type", "query_limitation").alias("query_limitation"), "outcome", "search_id", "patent_id")
    return graph.promote(rows).withColumn("aliases", F.array_join("aliases", "; "))


# ---- topics, lines, rounds


def topic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the sources' topics."""
    rows = cluster.top_terms(table(spark, sf_dir, "documents"), "source", "text")
    return rows.select("source", "term", F.round("score", 6).alias("score"), F.col("n").cast("long").alias("n"))


TOPIC_SQL = f"""
WITH t AS (SELECT source, unnest(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({_TOPIC_STOP}))) AS term FROM documents),
c AS (SELECT source, term, count(*) AS k FROM t GROUP BY ALL), tot AS (SELECT source, sum(k) AS total FROM c GROUP BY source), df AS (SELECT term, count(*) AS df FROM c GROUP BY term),
s AS (SELECT source, term, round(k / total * ln(1 + (SELECT count(DISTINCT source) FROM documents) / df), 9) AS s FROM c JOIN tot USING (source) JOIN df USING (term)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s DESC, term) - 1 AS n FROM s)
SELECT source, term, round(s, 6) AS score, n FROM r WHERE n < 4
"""


def topic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means over the embeddings: the sizes and purity of the clusters against the labels given."""
    rows = table(spark, sf_dir, "embeddings")
    found = cluster.kmeans(rows, 10).withColumnRenamed("label", "found")
    both = rows.join(found, "vec_id").groupBy("found", "label").count()
    own = Window.partitionBy("found").orderBy(F.desc("count"), "label")
    return both.withColumn("size", F.sum("count").over(Window.partitionBy("found"))).withColumn("_n", F.row_number().over(own)).where("_n = 1").select("found", "size", F.col("label").alias("main"), F.round(F.col("count") / F.col("size"), 4).alias("purity"))


def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.dbscan(table(spark, sf_dir, "embeddings"), 0.25, 4)


def label_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three vectors nearest to the mean of each label."""
    return cluster.representatives(table(spark, sf_dir, "embeddings")).withColumn("n", F.col("n").cast("long"))


REPRESENTATIVES_SQL = """
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS d FROM embeddings), m AS (SELECT label, d, avg(x) AS m FROM e GROUP BY ALL),
s AS (SELECT e.label, vec_id, round(sqrt(sum((x - m) * (x - m))), 6) AS distance FROM e JOIN m ON m.label = e.label AND m.d = e.d GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) - 1 AS n FROM s)
SELECT label, vec_id, distance, n FROM r WHERE n < 3
"""


def line_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robust line through quantity and price of each part's order lines."""
    rows = locate.fitted(table(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity", "l_extendedprice")
    return rows.select("l_partkey", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 4).alias("r2"), F.col("n").cast("long").alias("n"), F.col("dropped").cast("long").alias("dropped"))


def _ols(n: int) -> str:
    prev = f"f{n - 1}"
    return f"""k{n} AS (SELECT *, live AND abs(r) <= greatest(2 * stddev_pop(r) FILTER (live) OVER (PARTITION BY p), 0.5) AS keep FROM {prev}),
d{n} AS (SELECT *, done OR count(*) FILTER (keep) OVER (PARTITION BY p) IN (0, 1) OR count(*) FILTER (keep) OVER (PARTITION BY p) = count(*) FILTER (live) OVER (PARTITION BY p) AS dn FROM k{n}),
l{n} AS (SELECT p, y, v, CASE WHEN dn THEN live ELSE keep END AS live, dn AS done FROM d{n}),
m{n} AS (SELECT *, avg(y) FILTER (live) OVER (PARTITION BY p) AS my, avg(v) FILTER (live) OVER (PARTITION BY p) AS mv FROM l{n}),
s{n} AS (SELECT *, sum((y - my) * (v - mv)) FILTER (live) OVER (PARTITION BY p) AS cov, sum((y - my) * (y - my)) FILTER (live) OVER (PARTITION BY p) AS va FROM m{n}),
f{n} AS (SELECT p, y, v, live, done, mv, CASE WHEN va > 0 THEN cov / va END AS b, mv - CASE WHEN va > 0 THEN cov / va END * my AS a, v - (CASE WHEN va > 0 THEN cov / va END * y + mv - CASE WHEN va > 0 THEN cov / va END * my) AS r FROM s{n})"""


LINES_SQL = f"""
WITH l0 AS (SELECT l_partkey AS p, l_quantity AS y, l_extendedprice AS v, true AS live, false AS done FROM lineitem),
m0 AS (SELECT *, avg(y) OVER (PARTITION BY p) AS my, avg(v) OVER (PARTITION BY p) AS mv FROM l0),
s0 AS (SELECT *, sum((y - my) * (v - mv)) OVER (PARTITION BY p) AS cov, sum((y - my) * (y - my)) OVER (PARTITION BY p) AS va FROM m0),
f0 AS (SELECT p, y, v, live, done, mv, CASE WHEN va > 0 THEN cov / va END AS b, mv - CASE WHEN va > 0 THEN cov / va END * my AS a, v - (CASE WHEN va > 0 THEN cov / va END * y + mv - CASE WHEN va > 0 THEN cov / va END * my) AS r FROM s0),
{_ols(1)}, {_ols(2)}, {_ols(3)}
SELECT p AS l_partkey, round(any_value(b), 4) AS slope, round(any_value(a), 2) AS intercept,
       round(CASE WHEN sum((v - mv) * (v - mv)) FILTER (live) > 0 THEN 1 - sum(r * r) FILTER (live) / sum((v - mv) * (v - mv)) FILTER (live) ELSE 1.0 END, 4) AS r2,
       count(*) FILTER (live) AS n, count(*) - count(*) FILTER (live) AS dropped FROM f3 GROUP BY p HAVING any_value(b) IS NOT NULL AND count(*) FILTER (live) >= 2
"""


def gutter_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers in the gutter among quantities scattered over pages, an order a page."""
    li = table(spark, sf_dir, "lineitem")
    words = li.select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 600).cast("double").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").cast("int").cast("string").alias("text"), F.lit(600.0).alias("width"))
    return locate.markers(words)


MARKERS_SQL = """
WITH c AS (SELECT l_orderkey AS page, (l_partkey % 600)::DOUBLE AS x, l_extendedprice AS y, l_quantity::INT AS line FROM lineitem WHERE l_quantity::INT % 5 = 0 AND l_quantity::INT BETWEEN 5 AND 100),
b AS (SELECT page, list_sort(list(x) FILTER (abs(x - 300) <= 72)) AS near, list_sort(list(x)) AS every FROM c GROUP BY page),
m AS (SELECT page, CASE WHEN len(near) > 0 THEN near[len(near) // 2 + 1] ELSE every[len(every) // 2 + 1] END AS band FROM b)
SELECT page, y, line::BIGINT AS line FROM c JOIN m USING (page) WHERE abs(x - 300) <= 72 OR abs(x - band) <= 18
"""


def citation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the form of patent citations."""
    li = table(spark, sf_dir, "lineitem")
    c1, l1 = F.col("l_linenumber"), (F.col("l_partkey") % 60 + 1)
    c2, l2 = c1 + (F.col("l_suppkey") % 2), F.when(F.col("l_suppkey") % 3 == 0, l1).otherwise(l1 + 5)
    number = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("US"), F.col("l_orderkey").cast("string")))
    return li.select("l_orderkey", "l_linenumber", locate.citation(c1, l1, c2, l2, number).alias("citation"))


CITE_SQL = """
WITH c AS (SELECT l_orderkey, l_linenumber, l_linenumber AS c1, l_partkey % 60 + 1 AS l1, l_linenumber + l_suppkey % 2 AS c2, CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 60 + 1 ELSE l_partkey % 60 + 6 END AS l2 FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN 'US' || l_orderkey || ', ' ELSE '' END || CASE WHEN c1 <> c2 THEN 'col. ' || c1 || ', l. ' || l1 || ' to col. ' || c2 || ', l. ' || l2
       WHEN l1 = l2 THEN 'col. ' || c1 || ', l. ' || l1 ELSE 'col. ' || c1 || ', ll. ' || l1 || '-' || l2 END AS citation FROM c
"""


def message_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of each conversation: each turn of the assistant begins one; with the characters of each round."""
    c = table(spark, sf_dir, "conversations")
    run = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = c.withColumn("round", F.sum((F.col("role") == "assistant").cast("long")).over(run))
    return rows.groupBy("conv_id", "round").agg(F.count("*").alias("turns"), F.sum(F.length("text").cast("long")).alias("chars"))


ROUNDS_SQL = """
WITH r AS (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS round FROM conversations)
SELECT conv_id, CAST(round AS BIGINT) AS round, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM r GROUP BY ALL
"""


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and tokens by role, as usage is counted by model."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("calls"), F.sum(F.size(T.tokens(F.col("text"))).cast("long")).alias("tokens"))


USAGE_SQL = "SELECT role, count(*) AS calls, CAST(sum(len(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS BIGINT) AS tokens FROM conversations GROUP BY role"


def text_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of the turns of a conversation in its whole text."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), F.lit(0).alias("column"), F.lit(0).alias("y"), "text")
    return locate.offsets(c, "conv_id").select("conv_id", F.col("page").alias("turn"), F.col("offset").cast("long").alias("offset"))


OFFSETS_SQL = "SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM conversations"


def harvested_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match pairs of the passages of each document with two limitations."""
    wanted = F.array(*map(F.lit, ("the", "der", "les", "que")))
    rows = keyword.highlights(patents(spark, sf_dir), F.col("specification"), wanted)
    passages = F.transform("passages", lambda p: F.struct(p["text"].alias("text"), F.lit("specification").alias("field")))
    results = rows.select(F.col("doc_id").alias("query_id"), F.col("doc_key").alias("patent_id"), passages.alias("passages"), F.lit("no passage").alias("why"))
    limits = rows.select(F.col("doc_id").alias("query_id"), F.explode(F.array(F.lit(" a part "), F.concat(F.lit("limitation "), (F.col("doc_id") % 3).cast("string")))).alias("limitation"))
    found = graph.harvest(results, limits)
    return found.groupBy("query_id", "query_limitation", "section", "outcome").agg(F.count("*").alias("n"))


HARVEST_SQL = """
WITH w AS (SELECT doc_id, substr(text, CAST(s + 1 AS BIGINT), 240) AS c FROM (SELECT doc_id, text, unnest(range(0, length(text), 240)) AS s FROM documents)),
h AS (SELECT doc_id, count(*) FILTER (len(list_filter(regexp_extract_all(lower(c), '[a-z0-9]+'), lambda t: t IN ('the', 'der', 'les', 'que'))) > 0) AS k FROM w GROUP BY doc_id),
l AS (SELECT doc_id, unnest(['a part', 'limitation ' || (doc_id % 3)]) AS query_limitation FROM documents)
SELECT doc_id AS query_id, query_limitation, CASE WHEN k > 0 THEN 'specification' ELSE 'agent_rationale' END AS section, 'unreviewed' AS outcome, CASE WHEN k > 0 THEN least(k, 3) ELSE 1 END AS n FROM l JOIN h USING (doc_id)
"""


QUERIES = {
    f.__name__: f
    for f in (planner_keywords, plan_angles, time_estimates, keyword_votes, prior_art, freedom_to_operate, infringement, citation_neighbours, merged_records, merged_citations, chart_coverage, chart_combined, risk_summary, chart_missing, evidence_gates, concept_expansion, phrase_pairs, token_jaccard, promoted_concepts, topic_terms, topic_clusters, density_clusters, label_representatives, line_models, gutter_markers, citation_texts, message_rounds, token_usage, text_offsets, harvested_pairs)
}
ORACLES = {
    "planner_keywords": KEYWORDS_SQL,
    "plan_angles": ANGLES_SQL,
    "time_estimates": ESTIMATES_SQL,
    "keyword_votes": VOTES_SQL,
    "prior_art": PRIOR_SQL,
    "freedom_to_operate": FTO_SQL,
    "infringement": INFRINGEMENT_SQL,
    "citation_neighbours": NEIGHBOURS_SQL,
    "merged_records": MERGED_SQL,
    "merged_citations": CITATIONS_SQL,
    "chart_coverage": COVERAGE_SQL,
    "chart_combined": COMBINED_SQL,
    "risk_summary": RISK_SQL,
    "chart_missing": MISSING_SQL,
    "evidence_gates": EVIDENCE_SQL,
    "concept_expansion": EXPANSION_SQL,
    "token_jaccard": JACCARD_SQL,
    "topic_terms": TOPIC_SQL,
    "label_representatives": REPRESENTATIVES_SQL,
    "line_models": LINES_SQL,
    "gutter_markers": MARKERS_SQL,
    "citation_texts": CITE_SQL,
    "message_rounds": ROUNDS_SQL,
    "token_usage": USAGE_SQL,
    "text_offsets": OFFSETS_SQL,
    "harvested_pairs": HARVEST_SQL,
}

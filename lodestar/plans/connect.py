"""Catalog: records of offices, standards and logs, claims and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import claims, html
from lodestar.functions import text as T
from lodestar.operators import keyword, reconcile
from lodestar.sources import files, offices

from .domain import table


def sep_by_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' declarations of patents for a standard, here market segments with odd spacing."""
    c = table(spark, sf_dir, "customer")
    standard = F.concat(F.lit("EN 301 "), F.lower("c_mktsegment"), F.lit(" v1"))
    rows = c.select(F.concat(F.lit("US"), (F.col("c_custkey") % 900).cast("string")).alias("patent_number"), standard.alias("standard"), F.col("c_custkey").alias("seq"))
    return files.for_standard(rows, "en301 BUILDING")


SEP_SQL = "SELECT 'US' || (c_custkey % 900) AS patent_number, min(c_custkey) AS seq FROM customer WHERE contains(lower(regexp_replace('EN 301 ' || lower(c_mktsegment) || ' v1', '\\s+', '', 'g')), 'en301building') GROUP BY 1"


def proceedings_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of proceedings, of which those with a final decision."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "FWD Entered").when(F.col("o_orderstatus") == "P", "Final Written Decision").otherwise("Instituted")
    record = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("proceedingNumber"), F.concat(F.lit("US"), F.col("o_custkey").cast("string")).alias("respondentPatentNumber"), status.alias("proceedingStatusCategory"), F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("proceedingFilingDate"), F.lit("2020-01-01").alias("accordedFilingDate"), F.when(F.col("o_custkey") % 2 == 0, F.lit("A")).alias("respondentPartyName"), F.lit("B").alias("patentOwnerName")))
    return offices.decided(offices.proceedings(o.select(record.alias("record")))).drop("petitioner")


PROCEEDINGS_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS proceeding_number, 'US' || o_custkey AS patent_number, CASE o_orderstatus WHEN 'F' THEN 'FWD Entered' ELSE 'Final Written Decision' END AS status,
       CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '2020-01-01' END AS filing_date, CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS patent_owner
FROM orders WHERE o_orderstatus IN ('F', 'P')
"""


def final_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: how many of each priority are final decisions."""
    o = table(spark, sf_dir, "orders")
    title = F.when(F.col("o_custkey") % 5 == 0, "A Final Written Decision of the board").when(F.col("o_custkey") % 5 == 1, "Termination Decision Document").otherwise("Paper")
    final = offices.is_final(F.when(F.col("o_orderkey") % 7 == 0, "FINAL"), F.col("o_orderpriority"), title)
    return o.groupBy("o_orderpriority").agg(F.sum(final.cast("long")).alias("final"))


FINAL_SQL = "SELECT o_orderpriority, count(*) FILTER (o_custkey % 5 IN (0, 1) OR o_orderkey % 7 = 0) AS final FROM orders GROUP BY 1"


def cited_art(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as entries of three citation bags of an application."""
    li = table(spark, sf_dir, "lineitem")
    entry = F.struct(F.when(F.col("l_linenumber") == 2, F.lit("no number")).otherwise(F.concat(F.lit("US00"), (F.col("l_partkey") + 7000000).cast("string"), F.lit("B1"))).alias("citedPatentNumber"), F.when(F.col("l_returnflag") == "R", "cited by examiner").otherwise("cited by applicant").alias("citationCategoryCode"), F.when(F.col("l_quantity") > 45, "Y").alias("examinerCitedReferenceIndicator"))
    bags = li.groupBy(F.col("l_orderkey").alias("app_number")).agg(F.collect_list(F.when(F.col("l_linenumber") < 3, entry)).alias("citationBag"), F.collect_list(F.when(F.col("l_linenumber") >= 3, entry)).alias("patentCitationBag"))
    return offices.cited_art(bags.select("app_number", F.to_json(F.struct("citationBag", "patentCitationBag")).alias("record")))


CITED_SQL = """
SELECT l_orderkey AS app_number, 'US' || (l_partkey + 7000000) AS doc_key, 'US00' || (l_partkey + 7000000) || 'B1' AS display,
       l_returnflag = 'R' OR l_quantity > 45 AS is_examiner, l_returnflag <> 'R' AS is_applicant FROM lineitem WHERE l_linenumber <> 2
"""


def wrapper_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as documents of a file wrapper, of two codes."""
    li = table(spark, sf_dir, "lineitem")
    option = lambda kind: F.struct(F.lit(kind).alias("mimeTypeIdentifier"), F.concat(F.lit(f"{kind}/"), F.col("l_partkey").cast("string")).alias("downloadUrl"))
    doc = F.struct(F.element_at(F.array(F.lit("CTNF"), F.lit("CTFR"), F.lit("ABC")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("documentCode"), F.col("l_returnflag").alias("documentDescription"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("officialDate"), F.when(F.col("l_quantity") > 10, F.array(option("XML"), option("PDF"))).alias("downloadOptionBag"))
    raw = li.groupBy(F.col("l_orderkey").alias("app_number")).agg(F.collect_list(doc).alias("documentBag")).select("app_number", F.to_json(F.struct("documentBag")).alias("record"))
    return offices.wrapper_documents(raw, ("CTNF", "CTFR")).withColumn("pdf_urls", F.array_join("pdf_urls", ","))


WRAPPER_SQL = """
SELECT l_orderkey AS app_number, CASE l_suppkey % 3 WHEN 0 THEN 'CTNF' ELSE 'CTFR' END AS code, l_returnflag AS description, strftime(l_shipdate, '%Y-%m-%d') AS date,
       CASE WHEN l_quantity > 10 THEN 'PDF/' || l_partkey ELSE '' END AS pdf_urls FROM lineitem WHERE l_suppkey % 3 < 2
"""


def wrapper_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of an order's lines under their headers, oldest first."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("app_number"), F.col("l_returnflag").alias("code"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.concat(F.lit(" part "), F.col("l_partkey").cast("string"), F.lit("\n")).alias("text"))
    return offices.wrapper_text(rows)


WRAPPER_TEXT_SQL = """
SELECT l_orderkey AS app_number, string_agg('=== ' || l_returnflag || ' ' || strftime(l_shipdate, '%Y-%m-%d') || ' ===' || chr(10) || 'part ' || l_partkey, chr(10) || chr(10)
       ORDER BY strftime(l_shipdate, '%Y-%m-%d'), '=== ' || l_returnflag || ' ' || strftime(l_shipdate, '%Y-%m-%d') || ' ===' || chr(10) || 'part ' || l_partkey) AS text FROM lineitem GROUP BY 1
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    lines = [F.concat(F.lit('L1 4,23 ("'), F.col("p_name"), F.lit('" and coupler).clm. USPAT 2020/01/01')), F.concat(F.lit("S3 | "), F.col("p_type"), F.lit(".ab,ti.")), F.concat(F.lit("plain prose about part "), key), F.concat(F.lit('l1 4,23 ("'), F.upper("p_name"), F.lit('" AND coupler).CLM.')), F.concat(F.lit("  (steel near3 "), key, F.lit(")  ")), F.concat(F.lit("U.S. Patent No. 7,"), F.substring(F.lpad(key, 6, "0"), 1, 3), F.lit(","), F.substring(F.lpad(key, 6, "0"), 4, 3), F.lit(" and US8123456, again US 8123456"))]
    return p.select("p_partkey", F.concat_ws("\n", *lines).alias("text"))


def log_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search queries of logs made of parts."""
    return _log(spark, sf_dir).select("p_partkey", F.posexplode(T.log_queries(F.col("text"))).alias("n", "query")).withColumn("n", F.col("n").cast("long"))


LOG_SQL = """
WITH r AS (SELECT p_partkey, unnest(['("' || p_name || '" and coupler).clm.', p_type || '.ab,ti.', 'l1 4,23 ("' || upper(p_name) || '" AND coupler).CLM.', '(steel near3 ' || p_partkey || ')']) AS query, unnest(range(4)) AS n FROM part)
SELECT p_partkey, n, query FROM r
"""


def us_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """US patent numbers named in those logs."""
    return _log(spark, sf_dir).select("p_partkey", F.array_join(T.us_numbers(F.col("text")), ",").alias("numbers"))


NUMBERS_SQL = "SELECT p_partkey, 'US7' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || ',US8123456' AS numbers FROM part"


def latest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, as an index keeps the last record of a number; upserting the rest changes nothing."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    last = reconcile.latest(e, "user_id", "event_id")
    return keyword.upsert(last.where("event_type <> 'view'"), last, "user_id")


LATEST_SQL = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page: its lines and characters, and whether markup is left."""
    rows = table(spark, sf_dir, "pages").withColumn("text", html.html_to_text("html"))
    return rows.select("page_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), F.length("text").cast("long").alias("chars"), F.contains("text", F.lit("</")).alias("markup"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as claims: a claim a line."""
    docs = table(spark, sf_dir, "documents")
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda line, i: F.concat((i + 1).cast("string"), F.lit(". "), F.when(i % 3 == 1, F.concat(F.lit("The system of claim "), i.cast("string"), F.lit(" comprising: "))).otherwise(F.lit("A system comprising: a part; and ")), line)), "\n")
    return claims.claim_table(docs.select("doc_id", numbered.alias("claims")), "doc_id", "claims")


def claim_limitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limitations of those claims; verbatim says whether every span gives its text."""
    rows = _claims(spark, sf_dir)
    return rows.select("doc_id", "number", "depends_on", F.size("limitations").cast("long").alias("n"), F.size("elements").cast("long").alias("elements"), F.forall("limitations", lambda x: F.length(x["text"]) == x["end"] - x["start"]).alias("verbatim"))


def antecedent_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many references of each document's claims lack an antecedent."""
    return claims.antecedent_issues(_claims(spark, sf_dir), "doc_id").groupBy("doc_id").agg(F.count("*").alias("issues"))


QUERIES = {f.__name__: f for f in (sep_by_standard, proceedings_decided, final_documents, cited_art, wrapper_documents, wrapper_texts, log_queries, us_numbers, latest_records, page_texts, claim_limitations, antecedent_issues)}
ORACLES = {
    "sep_by_standard": SEP_SQL,
    "proceedings_decided": PROCEEDINGS_SQL,
    "final_documents": FINAL_SQL,
    "cited_art": CITED_SQL,
    "wrapper_documents": WRAPPER_SQL,
    "wrapper_texts": WRAPPER_TEXT_SQL,
    "log_queries": LOG_SQL,
    "us_numbers": NUMBERS_SQL,
    "latest_records": LATEST_SQL,
}

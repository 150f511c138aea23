"""Hand-computed cases of the engine's own operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestar.functions import claims, html
from lodestar.functions import text as T
from lodestar.operators import charts, cluster, evaluate, fusion, graph, keyword, locate, reconcile, vector
from lodestar.operators.filters import Query
from lodestar.plans import planner, searches, session


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, want",
    [("US10123456B2", ("US", "10123456", "B2")), ("10,123,456", ("US", "10123456", None)), ("EP1234567A1", ("EP", "1234567", "A1")), ("US 2020/0123456 A1", ("US", "20200123456", "A1")), ("us9000000", ("US", "9000000", None)), ("RE46789", ("RE", "46789", None)), ("USD812345", ("US", "D812345", None)), ("USRE46789", None), ("not a patent", None)],
)
def test_numbers(spark, raw, want):
    got = one(spark, T.number_parts(F.lit(raw)))
    assert (tuple(got) if got else None) == want


def test_keys_ignore_kinds_and_zeros(spark):
    assert one(spark, T.reference_key(F.lit("US07654321B2"))) == one(spark, T.reference_key(F.lit("7654321"))) == "US7654321"
    assert one(spark, T.reference_key(F.lit(" odd one "))) == "ODD ONE"


def test_dates_and_durations(spark):
    assert one(spark, T.compact_date(F.lit("20161399"))) is None
    assert one(spark, T.compact_date(F.lit("20160229"))) == dt.date(2016, 2, 29)
    assert one(spark, T.duration(F.lit(45.0))) == "45 seconds" and one(spark, T.duration(F.lit(210.0))) == "3.5 minutes"


def test_chunks(spark):
    assert one(spark, F.size(T.chunks(F.lit("")))) == 0
    assert one(spark, F.size(T.chunks(F.lit(" ".join("w" * 1 for _ in range(700)))))) == 2


def docs(spark):
    rows = [
        (1, "US1", "coil", "wireless power coil " * 20, "Acme Power", ["H02J50"], dt.date(2015, 1, 1), "US"),
        (2, "US2", "solar mount", "solar panel mount " * 20, "Ada Lovelace", ["H02S20"], dt.date(2018, 6, 1), "US"),
        (3, "US3", "router", "network packet router " * 20, None, ["H04L45"], None, "US"),
    ]
    return spark.createDataFrame(rows, "doc_id long, doc_key string, title string, specification string, assignee string, cpc array<string>, effective date, country string")


def ids(frame):
    return [r["doc_id"] for r in frame.collect()]


def test_search_and_filters(spark):
    d = docs(spark)
    assert ids(keyword.search(d, Query(keywords=("coil",)))) == [1]
    assert ids(keyword.search(d, Query())) == [1, 2, 3]
    assert ids(keyword.search(d, Query(before=dt.date(2016, 1, 1)))) == [1]
    assert ids(keyword.search(d, Query(after=dt.date(2015, 1, 1)))) == [2]
    assert ids(keyword.search(d, Query(classes=("H02",)))) == [1, 2]
    assert ids(keyword.search(d, Query(excluded=("PANEL",)))) == [1, 3]
    assert ids(keyword.search(d, Query(assignees=("lovelace",)))) == [2]
    assert ids(keyword.search(d, Query(deny=("US1",)))) == [2, 3]
    assert ids(keyword.search(d, Query(allow=("US3",)))) == [3]
    assert ids(keyword.search(d, Query(required=("packet",)))) == [3]
    assert ids(keyword.search(d, Query(keywords=("coil", "solar"), minimum_match=2))) == []
    assert Query(keywords=tuple("abcdef")).least_match() == 2


def test_rrf_and_zscores(spark):
    lists = [spark.createDataFrame([(0, d, r) for r, d in enumerate(x, 1)], "query_id long, doc_id string, rank int") for x in (["US1", "US2"], ["US2", "US3"])]
    got = {r["doc_id"]: r["score"] for r in fusion.reciprocal(lists).collect()}
    assert got == {"US2": pytest.approx(1 / 62 + 1 / 61, abs=1e-8), "US1": pytest.approx(1 / 61, abs=1e-8), "US3": pytest.approx(1 / 62, abs=1e-8)}
    rows = [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("b", 1, 30.0), ("b", 2, 20.0), ("b", 3, 10.0)]
    scores = spark.createDataFrame(rows, "system string, key int, score double")
    assert [round(r["score"], 9) for r in fusion.combined(scores).collect()] == [0, 0, 0]
    weighted = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 1.0), ("b", 1, 0.0), ("b", 2, 1.0)], "system string, key int, score double")
    assert {r["key"]: r["score"] for r in fusion.combined(weighted, {"b": 3.0}).collect()}[2] == 4.0


def test_metrics(spark):
    p = spark.createDataFrame([(0, 1, "US1"), (0, 2, "US2"), (0, 3, "US3"), (1, 1, "m"), (1, 2, "US5"), (1, 3, "US6")], "query_id long, rank int, ref string")
    r = spark.createDataFrame([(0, "US2"), (0, "US9"), (1, "US6"), (1, "US5")], "query_id long, ref string")
    got = {x["query_id"]: x for x in evaluate.metrics(p, r, (1, 2, 10)).collect()}
    assert (got[0]["recall_1"], got[0]["recall_2"], got[0]["recall_10"]) == (0, 0.5, 0.5)
    assert got[1]["mrr"] == 0.5 and got[1]["map"] == pytest.approx((1 / 2 + 2 / 3) / 2, abs=1e-6)
    curve = [x["recall"] for x in evaluate.curve(p.where("query_id = 0"), r.where("query_id = 0"), 4).orderBy("k").collect()]
    assert curve == [0, 0.5, 0.5, 0.5]


def test_judgments(spark):
    rows = spark.createDataFrame([("US100", "US200", True, 1), ("US100", "US201", True, 2), ("US100", "US201", False, 3), ("US100", "US202", True, 4), ("US999", "US300", False, 5)], "query_id string, ref string, relevant boolean, seq int")
    got = evaluate.querysets(rows).collect()
    assert [(r["query_id"], r["references"], r["rejected"]) for r in got] == [("US100", ["US200", "US202"], ["US201"])]


def test_merge(spark):
    rows = spark.createDataFrame([("k", 1, 0, "low", "x", ["a", "b"]), ("k", 3, 1, "high", None, ["B", "c"]), ("k", 2, 2, None, "y", [])], "doc_key string, fidelity int, ingest_seq int, title string, status string, inventors array<string>")
    r = reconcile.merged(rows, scalars=("title", "status"), joined={"inventors": None}).first()
    assert (r["title"], r["status"], r["inventors"]) == ("high", "y", ["B", "c", "a"])


def test_charts(spark):
    rows = [("q", "l1", "r1", "disclosed"), ("q", "l2", "r1", "not_disclosed"), ("q", "l1", "r2", "partially_disclosed"), ("q", "l2", "r2", "disclosed")]
    f = spark.createDataFrame(rows, "query_key string, limitation string, ref_key string, status string").withColumn("reasoning", F.lit("a|b"))
    assert {r["ref_key"]: r["coverage"] for r in charts.coverage(f).collect()} == {"r1": 0.5, "r2": 0.5}
    assert charts.combined_coverage(f).first()["coverage"] == 1.0
    assert "a\\|b" in charts.markdown(f, "q") and "50%" in charts.markdown(f, "q") and "<table>" in charts.html(f, "q")
    assert charts.filtered(f, ["L1"]).count() == 2 and charts.filtered(f, []).count() == 4


def test_promotion_gates(spark):
    texts = ["rank documents by embedding similarity", "ranking documents by embedding similarity", "rank the documents by embedding similarity"]
    rows = [(i, texts[i % 3], "accepted", f"s{i % 5}", f"p{i % 3}") for i in range(6)]
    schema = "seq long, query_limitation string, outcome string, search_id string, patent_id string"
    r = graph.promote(spark.createDataFrame(rows, schema)).first()
    assert (r["stage"], len(r["aliases"]), r["searches"], r["accepted"], r["rejected"]) == (3, 3, 5, 6, 0)
    two = [(*x[:4], f"p{x[0] % 2}") for x in rows]
    assert graph.promote(spark.createDataFrame(two, schema)).first()["stage"] == 2
    more = rows + [(10 + i, texts[0], "rejected", "", "") for i in range(2)]
    r = graph.promote(spark.createDataFrame(more, schema)).first()
    assert (r["stage"], r["rejected"]) == (2, 2)


def test_expansion(spark):
    c = spark.createDataFrame([(0, "RANK_DOCUMENTS", ["rank documents", "order files", "sort records"], 3), (1, "OTHER", ["rank documents", "x"], 2)], "seq int, canonical_name string, aliases array<string>, stage int")
    got = graph.expand(c, spark.createDataFrame([("a step to rank documents",)], "limitation string"), threshold=None)
    assert sorted(r["alias"] for r in got.collect()) == ["order files", "rank documents", "sort records"]


def test_lines(spark):
    pts = [("p", float(40 + k), float(k)) for k in range(5, 65, 5)]
    exact = spark.createDataFrame([("p", 40 + 3.0 * v, v) for _, _, v in pts], "page string, y double, line double")
    r = locate.fitted(exact).first()
    assert r["slope"] == pytest.approx(1 / 3) and r["r2"] == pytest.approx(1) and r["dropped"] == 0 and r["n"] == 12
    bad = exact.union(spark.createDataFrame([("p", 50.0, 90.0), ("p", 200.0, 5.0)], exact.schema))
    r = locate.fitted(bad).first()
    assert r["dropped"] == 2 and r["slope"] == pytest.approx(1 / 3, abs=1e-6)
    assert locate.fitted(spark.createDataFrame([("p", 1.0, 5.0)], exact.schema)).count() == 0


def test_markers(spark):
    rows = [("p", 300.0, 100.0, "5"), ("p", 305.0, 160.0, "10"), ("p", 298.0, 220.0, "15"), ("p", 50.0, 100.0, "20"), ("p", 300.0, 90.0, "7"), ("p", 300.0, 90.0, "word"), ("p", 300.0, 90.0, "1000")]
    got = locate.markers(spark.createDataFrame(rows, "page string, x double, y double, text string").withColumn("width", F.lit(600.0)))
    assert sorted((r["y"], r["line"]) for r in got.collect()) == [(100, 5), (160, 10), (220, 15)]


CLAIMS = "1. A widget comprising: a gear; and a lever, wherein the lever turns.\n2 . The widget of claim 1, with 3. items.\n3. The widget of claim 2.\n 2. stray\n4. A method.\n5. The method of claim 4, wherein said step ends."


def test_claims():
    got = claims.parse(CLAIMS)
    assert [c["number"] for c in got] == [1, 2, 3, 4, 5]
    assert [c["depends_on"] for c in got] == [None, 1, 2, None, 4]
    for c in got:
        ends = 0
        for x in c["limitations"]:
            assert c["text"][x["start"] : x["end"]] == x["text"] and x["start"] >= ends
            ends = x["end"]
    assert [x["label"] for x in got[0]["limitations"]] == ["1[pre]", "1[a]", "1[b]"]
    assert claims.label(3, 26) == "3[aa]" and claims.label(1, 25) == "1[z]"
    assert [e["depth"] for e in got[0]["elements"]] == [0, 1, 1, 2]
    assert claims.section("text\nWhat is claimed is: 1. A thing.") == "1. A thing."
    assert claims.verbatim("a  gear\nand", "gear and") == (3, 11)


def test_antecedents():
    rows = [(1, "A gear comprising a shaft. The lever moves.", None), (2, "The gear of claim 1, wherein the shaft turns the wheel.", 1)]
    assert claims.antecedents(rows) == ["Claim 1: 'the lever moves' may lack antecedent basis", "Claim 2: 'the wheel' may lack antecedent basis"]
    assert claims.antecedents([(1, "the x", 2), (2, "the y", 1)])  # a cycle ends


def test_html():
    page = "<html><head><title>t</title></head><body><script>x</script><p>One <b>two</b>&amp;three</p><div>four<br>five</div></body></html>"
    assert html.text_of(page).replace("\n\n", "\n").split("\n") == ["One two&three", "four", "five"]
    assert html.text_of(None) == ""


def test_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<double>")
    got = vector.nearest(rows, rows.where("vec_id = 0"), 2).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2] and got[1]["score"] == 0.0
    assert one(spark, vector.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_clusters(spark):
    rows = [(i, [float(i % 2) + 0.01 * i / 12, 1 - float(i % 2)]) for i in range(12)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for found in (cluster.kmeans(v, 2), cluster.dbscan(v, 0.1, 3)):
        got = {r["vec_id"]: r["label"] for r in found.collect()}
        assert len({got[i] for i in range(0, 12, 2)}) == 1 and got[0] != got[1]


def _plain_dbscan(rows, eps, least):
    """Labels of (key, vector) by plain loops; keys are distinct."""
    import math

    near = {a: set() for a, _ in rows}
    for a, v in rows:
        for b, w in rows:
            if v is None or w is None or len(v) != len(w) or None in v or None in w:
                continue
            p, q = (math.sqrt(sum(x * x for x in u)) or 1.0 for u in (v, w))
            total = 0.0
            for x, y in zip(v, w):
                total += (x / p) * (y / q)
            if 1 - total <= eps:
                near[a].add(b)
    core = {a for a in near if len(near[a]) >= least}
    label = {a: a for a in core}
    while True:
        new = {a: min(label[b] for b in near[a] & core) for a in core}
        if new == label:
            break
        label = new
    return {a: label.get(a, min((label[b] for b in near[a] & core), default=-1)) for a in near}


@pytest.mark.parametrize("block", [16_384, 40])
def test_dbscan_equals_plain_loops(spark, block, monkeypatch):
    import random

    monkeypatch.setattr(cluster, "BLOCK", block)
    monkeypatch.setattr(cluster, "CELLS", 500)
    rng = random.Random(5)
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(3 * i + 1, [x + rng.gauss(0, 0.35) for x in rng.choice(middles)]) for i in range(220)]
    rows += [(1000, [0.0] * 8), (1001, [0.0] * 8), (1002, None), (1003, [1.0, None] * 4), (1004, []), (1005, [1.0, 0.0]), (1006, [2.0, 0.0]), (1007, [3.0, 0.0]), (1008, [4.0, 0.0])]
    rows += [(1100 + i, [1.0, 3.0**0.5, 0.0]) for i in range(5)] + [(1200, [1.0, 0.0, 0.0])] + [(1300 + i, [0.6, 0.8, 0.0, 0.0, 0.0]) for i in range(30)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for eps, least in ((0.25, 4), (0.1, 3), (0.5, 6), (0.25, 1)):
        found = cluster.dbscan(v, eps, least).collect()
        assert len(found) == len(rows)
        assert {r["vec_id"]: r["label"] for r in found} == _plain_dbscan(rows, eps, least)


def test_dbscan_compares_thousands_of_rows_by_products(spark):
    v = spark.range(12_000).selectExpr("id AS vec_id", "transform(sequence(1, 64), k -> CAST(xxhash64(IF(id < 3000, 0, id), k) / 9.3e18 AS float)) AS embedding")
    plan = cluster.dbscan(v, 0.25, 4)
    assert "NestedLoop" not in plan._jdf.queryExecution().toString() and "CartesianProduct" not in plan._jdf.queryExecution().toString()
    assert {(r["label"], r["count"]) for r in plan.groupBy("label").count().collect()} == {(0, 3000), (-1, 9000)}


def test_planner(spark):
    d = spark.createDataFrame([(0, "Neural gear 42", "the gear turns gear wheel wheel wheel 1234")], "doc_id int, title string, body string")
    got = [r["keyword"] for r in planner.keywords(d, "doc_id", F.col("title"), F.col("body")).orderBy("n").collect()]
    assert got == ["neural", "gear", "wheel", "turns"]
    more = planner.seconds(F.lit(3), F.lit(100_000), F.lit(True), F.lit(0))
    assert one(spark, more) == 65.0 and one(spark, planner.seconds(F.lit(0), F.lit(0), F.lit(False), F.lit(-1))) == 2.8


def test_infringement(spark):
    limits = spark.createDataFrame([(0, ["a steel gear", "wherein the lever turns"])], "query_id int, limitations array<string>")
    products = spark.createDataFrame([(0, 0, "gear", "of steel", None), (0, 1, "lever", "", "turns the steel gear"), (0, 2, "", "", None)], "query_id int, pos int, name string, description string, evidence string")
    got = searches.infringement(limits, products).orderBy("rank").collect()
    assert [(r["name"], r["score"]) for r in got] == [("lever", 1.0), ("gear", 0.5)]
    assert searches.window_start(dt.date(2026, 1, 1)) == dt.date(2026, 1, 1) - dt.timedelta(days=7670)


class Script:
    """A model that says what it is given."""

    def __init__(self, *rounds):
        self.rounds = list(rounds)

    def run_tools(self, messages, *, system, tools, max_tokens):
        return self.rounds.pop(0) if self.rounds else session.Round("done")


def test_loop():
    calls = []
    tools = [session.Tool("look", "", {}, lambda a: calls.append(a) or {"ok": 1}), session.Tool("finish", "", {}, lambda a: {"error": "empty"} if not a else {"ok": 1})]
    call = lambda name, **a: session.Round("t", [session.Call("1", name, a)], 2, 1)
    out = session.Loop(Script(call("look", q=1), call("nothing"), call("finish", x=1)), tools, "finish").run("", [session.message("go")])
    assert out.stop == "finish_tool" and calls == [{"q": 1}] and out.usage["input_tokens"] == 6 and len(session.rounds(out.steps)) == 3
    assert session.Loop(Script(session.Round("bye")), tools).run("", []).stop == "end_turn"
    out = session.Loop(Script(*[call("look")] * 2, call("finish"), call("finish", x=1)), tools, "finish", max_steps=2).run("", [])
    assert out.stop == "max_steps" and out.steps[-1].content == '{"ok": 1}'
    assert session.Loop(Script(*[call("look")] * 9), tools, max_steps=2).run("", []).stop == "max_steps"


def test_sessions(tmp_path):
    s = session.Session("invalidity", "US1", [{"n": 0}, {"n": 1}])
    s.plan_feedback({1: "irrelevant"}, "more")
    assert s.execute(lambda x: [{"patent_number": "US2"}]) and s.state == "awaiting_result_feedback"
    s.result_feedback({"US2": "irrelevant"})
    store = session.Sessions(tmp_path)
    store.save(s)
    assert store.get(s.id).excluded == ["US2"] and store.ids() == [s.id]
    s.finish()
    with pytest.raises(ValueError):
        s.execute(lambda x: [])
    assert session.json_of('text ```json\n{"a": "x\ny"}\n``` end') == {"a": "x\ny"} and session.json_of("so [1, 2] it is") == [1, 2]
    assert session.serialised("x" * 30_000).endswith("chars]")


def test_records(spark):
    from lodestar.functions import records as R

    claim = "struct<number:int,text:string,depends_on:int>"
    rows = spark.createDataFrame(
        [([(1, "a", None), (2, "b" * 2000, 1)], [("US2", True), ("US1", True), ("US3", False)], {"a": "1"}, {"a": "2", "b": "3"}, [("Application granted", dt.date(2020, 1, 1)), ("Expiration", dt.date(2030, 1, 1)), ("Adjusted expiration", dt.date(2031, 1, 1))])],
        f"claims array<{claim}>, citations array<struct<doc_key:string,is_examiner:boolean>>, p map<string,string>, s map<string,string>, events array<struct<title:string,date:date>>",
    )
    c = F.col("claims")
    r = rows.select(
        F.size(R.independent(c)).alias("independent"), R.claim(c, 2)["depends_on"].alias("of"), R.claim(c, 9).alias("none"), F.size(R.selected(c, [2])).alias("picked"), F.size(R.selected(c, [7])).alias("else_"),
        R.examiner_cited(F.col("citations")).alias("cited"), R.merged_map(F.col("p"), F.col("s")).alias("m"), R.last_event(F.col("events"), "expiration").alias("ends"), R.cpc_code(F.lit("H"), [F.lit("04"), F.lit("L"), F.lit("65")], F.lit("403")).alias("code"),
        F.length(R.compact(F.lit("t"), F.lit("a" * 1500), c, F.array(F.lit("x")))["abstract"]).alias("abstract"), R.clamped(F.lit(99)).alias("limit"), R.earlier(F.lit(dt.date(2021, 1, 1)), F.lit(dt.date(2020, 1, 1))).alias("cutoff"),
    ).first()
    assert (r["independent"], r["of"], r["none"], r["picked"], r["else_"], r["cited"]) == (1, 1, None, 1, 1, ["US1", "US2"])
    assert r["m"] == {"a": "1", "b": "3"} and r["ends"] == dt.date(2031, 1, 1) and r["code"] == "H04L65/403" and r["abstract"] == 1003
    assert r["limit"] == 25 and r["cutoff"] == dt.date(2020, 1, 1)
    assert rows.withColumn("x", F.lit(None).cast("int")).where(R.equal(x=None)).count() == 1


def test_search_by_inventor_and_whole_text(spark):
    """Inventors are asked for, and excluded words are looked for in abstracts and claims too."""
    kind = "doc_id long, doc_key string, title string, specification string, assignee string, cpc array<string>, effective date, country string, inventors array<string>, abstract string, claims array<struct<text:string>>"
    rows = [(1, "US1", "gear", "a gear", "x", [], None, "US", ["Ann Lee"], "plain", [("a gear",)]), (2, "US2", "gear", "a gear", "x", [], None, "US", ["Bo Roy"], "plain", []), (3, "US3", "gear", "a gear", "x", [], None, "US", ["Ann Lee"], "of trash", None), (4, "US4", "gear", "a gear", "x", [], None, "US", ["Ann Lee", "C"], None, [("trash",)])]
    found = keyword.search(spark.createDataFrame(rows, kind), Query(keywords=("gear",), inventors=("ann",), excluded=("trash",)))
    assert [r["doc_id"] for r in found.collect()] == [1]


def test_few_queries_are_broadcast_to_the_postings(spark):
    """All tokens, and a row for each term of each pair of query and document, were shuffled."""
    docs = spark.createDataFrame([(1, "gear", "lever gear"), (2, "lever", "shaft"), (3, "", "gear shaft lever")], "doc_id long, title string, specification string")
    asked = spark.createDataFrame([(7, "gear"), (7, "lever"), (8, "shaft")], "query_id long, term string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = keyword.scored(keyword.build(docs), asked, held=True)
        assert scores._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 3
        assert {(r.query_id, r.doc_id): r._held for r in scores.collect()} == {(7, 1): 2, (7, 2): 1, (7, 3): 2, (8, 2): 1, (8, 3): 1}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_prior_art_hands_on_only_the_best_of_each_task(spark, monkeypatch):
    """A row for each pair of target and document went through the shuffle, which grows with the square of the documents."""
    day = lambda i: None if i % 17 == 0 else dt.date(2000, 1, 1) + dt.timedelta(days=i * 37 % 300)
    words = ["gear", "lever", "shaft", "valve", "pump", "rotor"]
    text = lambda i: " ".join(words[(i + j) % 6] for j in range(i % 5 + 1)) + (" Gear" * (i % 3))
    rows = [(i, None if i % 50 == 3 else f"US{i // 2}", text(i) + "\n" + text(i * 7), None if i % 40 == 1 else text(i // 3) * (1 + i % 4), day(i)) for i in range(400)] + [(None, "US9", "gear", "gear lever", None)]
    kind = "doc_id long, doc_key string, title string, specification string, effective date"
    docs = spark.createDataFrame(rows, kind).repartition(3).persist()
    targets = docs.where("doc_id % 20 = 0 or doc_id in (17, 34)").withColumn("query_id", F.col("doc_id").cast("string"))
    left_out = searches.exclusions(targets, custom=["US3", "US4", "US3"]).unionByName(spark.createDataFrame([("40", None, "x"), ("60", "US7", "x")], "query_id string, doc_key string, reason string"))
    handed = []
    ranked = searches.keyword.ranked
    monkeypatch.setattr(searches.keyword, "ranked", lambda scores, *a: (handed.append(scores), ranked(scores, *a))[1])
    got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in searches.prior_art(docs, targets, left_out, 5).collect()}
    asked = planner.keywords(targets, "query_id", F.col("title"), F.col("specification")).select("query_id", F.col("keyword").alias("term"))
    n = asked.select("query_id").distinct().count()
    assert handed[0].count() <= 3 * 5 * n
    keep = {(r.query_id, r.doc_key) for r in left_out.collect()}
    need = {r.query_id: max(1, r["count"] // 3) for r in asked.groupBy("query_id").count().collect()}
    limit, known = {r.query_id: r.effective for r in targets.collect()}, {r[0]: r for r in rows}
    pairs = [r for r in keyword.scored(keyword.build(docs), asked, held=True).collect() if r.score > 0 and r._held >= need[r.query_id]]
    pairs = [r for r in pairs if (known[r.doc_id][1] is None or (r.query_id, known[r.doc_id][1]) not in keep) and (limit[r.query_id] is None or known[r.doc_id][4] is not None and known[r.doc_id][4] < limit[r.query_id])]
    want = {}
    for q in need:
        best = sorted(((-r.score, r.doc_id) for r in pairs if r.query_id == q))[:5]
        want |= {(q, i): (doc, round(score / best[0][0], 4)) for i, (score, doc) in enumerate(best, 1)}
    assert len(pairs) > 3 * 5 * n and got == want
    assert searches.prior_art(docs, targets.limit(0), left_out, 5).count() == 0
    monkeypatch.setattr(searches.bulk, "BLOCK", 15)
    monkeypatch.setattr(searches.bulk, "PART", 2)  # bounds from one document in two
    again = {(r.query_id, r.rank): (r.doc_id, r.score) for r in searches.prior_art(docs, targets, left_out, 5).collect()}
    assert again == want and handed[-1].count() < handed[0].count()

"""Readers, writers and streams on small files."""

import datetime as dt
import io
import json
import zipfile

from lodestar.sources import files, offices, remote, sinks
from lodestar.streaming import ingest

GRANT = """<?xml version="1.0"?><!DOCTYPE us-patent-grant SYSTEM "x.dtd"><us-patent-grant><us-bibliographic-data-grant>
<publication-reference><document-id><country>US</country><doc-number>{n}</doc-number><kind>B2</kind><date>20200102</date></document-id></publication-reference>
<application-reference><document-id><doc-number>16111222</doc-number><date>20180304</date></document-id></application-reference>
<priority-claims><priority-claim><date>20170203</date></priority-claim><priority-claim><date>20160203</date></priority-claim></priority-claims>
<invention-title>A thing</invention-title>
<inventors><inventor><addressbook><last-name>Doe</last-name><first-name>Jo</first-name></addressbook></inventor></inventors>
<assignees><assignee><orgname>Acme</orgname></assignee></assignees>
<classification-cpc><section>H</section><class>04</class><subclass>L</subclass><main-group>65</main-group><subgroup>403</subgroup></classification-cpc>
</us-bibliographic-data-grant><abstract><p>Short.</p></abstract><description><p>Long.</p></description>
<claims><claim num="00001"><claim-text>A thing comprising: a part.</claim-text></claim><claim num="00002"><claim-text>The thing of <claim-ref idref="CLM-00001">claim 1</claim-ref>.</claim-text></claim></claims></us-patent-grant>"""


def test_grants(spark, tmp_path):
    p = offices.grant(GRANT.format(n="010123456"))
    assert p["doc_key"] == "US10123456" and p["priority_date"] == dt.date(2016, 2, 3) and p["grant_date"] == dt.date(2020, 1, 2)
    assert p["inventors"] == ["Doe, Jo"] and p["classifications"][0]["code"] == "H04L65/403"
    assert [c["depends_on"] for c in p["claims"]] == [None, 1]
    assert offices.grant(GRANT.format(n="D0812345")) is None and offices.grant(GRANT.format(n="RE046789")) is None and offices.grant("<x") is None
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("week.xml", GRANT.format(n="7") + "\n" + GRANT.format(n="8") + GRANT.format(n="D9"))
    (tmp_path / "ipg.zip").write_bytes(data.getvalue())
    rows = offices.archives(spark, str(tmp_path)).orderBy("doc_key").collect()
    assert [r["doc_key"] for r in rows] == ["US7", "US8"] and rows[0]["claims"][0]["limitations"][0]["label"] == "1[pre]"
    assert offices.weeks(2024)[0] == "ipg240102.zip" and len(offices.weeks(2024, "applications")) == 52


PAGE = """<html><span itemprop="title">Thing </span><div class="abstract">Abs</div><dd itemprop="inventor">Jo Doe</dd><dd itemprop="assigneeOriginal">Acme</dd>
<time itemprop="priorityDate">2016-02-03</time><section itemprop="claims"><div class="claim" num="00002"><div>The thing of <claim-ref>claim 1</claim-ref></div></div><div class="claim" num="00001">A thing</div></section>
<table><tr itemprop="backwardReferences"><td><span itemprop="publicationNumber">US7654321B2</span><span itemprop="examinerCited">*</span></td></tr>
<tr itemprop="backwardReferences"><td><span itemprop="publicationNumber">US7654322B2</span></td></tr></table>
<dd itemprop="events"><time itemprop="date" datetime="2020-01-02">x</time><span itemprop="title">Application granted</span></dd>
<ul itemprop="classifications"><li><span itemprop="Code">H04L</span></li><li><span itemprop="Code">H04L65/403</span><meta itemprop="Leaf" content="true"></li></ul></html>"""


def test_pages(spark):
    p = offices.page(PAGE, "US10123456B2")
    assert p["title"] == "Thing" and [c["number"] for c in p["claims"]] == [1, 2] and p["claims"][1]["depends_on"] == 1
    assert [(c["doc_key"], c["is_examiner"]) for c in p["citations"]] == [("US7654321", True), ("US7654322", False)]
    assert p["assignees"] == ["Acme"] and p["grant_date"] == dt.date(2020, 1, 2) and [c["code"] for c in p["classifications"]] == ["H04L65/403"]
    rows = offices.parsed_pages(spark.createDataFrame([("US10123456B2", PAGE), ("x", None)], "number string, html string")).collect()
    assert {r["doc_key"] for r in rows} == {"US10123456", "X"}


REGISTER = """<ops:x xmlns:ops="http://ops.epo.org" xmlns="http://www.epo.org/exchange"><ops:family-member><publication-reference><document-id document-id-type="docdb"><country>EP</country><doc-number>1</doc-number><kind>A1</kind></document-id></publication-reference></ops:family-member>
<exchange-document><invention-title lang="de">Ding</invention-title><invention-title lang="en">Thing</invention-title><inventors><inventor data-format="epodoc"><inventor-name><name>DOE JO [US]</name></inventor-name></inventor><inventor data-format="original"><inventor-name><name>Doe, Jo,</name></inventor-name></inventor></inventors></exchange-document></ops:x>"""


def test_register():
    assert offices.family(REGISTER) == ["EP1A1"]
    b = offices.biblio(REGISTER)
    assert b["title"] == "Thing" and b["inventors"] == ["Doe, Jo"] and b["abstract"] is None


def test_declarations(spark, tmp_path):
    path = tmp_path / "sep.csv"
    path.write_text("﻿Company,Patent,Standard\nA,US1,EN 301 908\nB,,EN 301 908\nC,US2,en301908-1\nD,US3,TS 1\n", encoding="utf-8")
    rows = files.declarations(spark, str(path))
    from pyspark.sql import functions as F

    got = files.for_standard(rows.withColumn("seq", F.monotonically_increasing_id()), "EN 301 908").orderBy("seq").collect()
    assert [r["patent_number"] for r in got] == ["US1", "US2"]
    assert rows.first()["raw"]["Patent"] == "US1" and len(files.declaration_rows(path.read_text(encoding="utf-8"))) == 4
    head = files.mapped_headers(["Declaring Company", "Application Number", "Standard"])
    assert head == {"declaring_company": "Declaring Company", "patent_number": "Application Number", "standard": "Standard"}


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\nno json\n{"a": 2}\n')
    good, bad = files.permissive(spark, str(path), "a INT")
    assert good.count() == 2 and [r["bad"] for r in bad.collect()] == ["no json"]
    assert sorted(r["a"] for r in files.lenient(spark, str(path), "a INT").collect() if r["a"]) == [1, 2]
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"n": "x"}, {"n": "y"}]}))
    assert [r["n"] for r in files.document(spark, str(tmp_path / "g.json"), "nodes ARRAY<STRUCT<n:STRING>>", "nodes").collect()] == ["x", "y"]


def test_documents(spark, tmp_path):
    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "a.txt").write_text("plain")
    (folder / "b.html").write_text("<p>x</p>")
    with zipfile.ZipFile(folder / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>word</w:t></w:r></w:p></w:d>')
    got = sorted(r["text"] for r in files.documents(spark, str(folder)).collect())
    assert got == ["plain", "word", "x"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    path = str(tmp_path / "out")
    assert sinks.append_new(rows, path, "k") == 2 and sinks.append_new(rows, path, "k") == 0
    sinks.updated(spark, path, "k string, v long", lambda t: t.withColumn("v", t["v"] + 1))
    assert sorted(r["v"] for r in spark.read.schema("k string, v long").json(path).collect()) == [2, 3]
    progress = sinks.Progress(tmp_path / "p.json", every=1)
    progress.succeeded("a")
    progress.broke("b")
    assert list(sinks.Progress(tmp_path / "p.json").remaining(["a", "b", "c"])) == ["b", "c"]
    (tmp_path / "p.json").write_text("{")
    assert list(sinks.Progress(tmp_path / "p.json").remaining(["a"])) == ["a"]


def test_client():
    answers, pauses = [(503, b""), (200, b'{"r": [1, 2]}'), (200, b'{"r": [3]}')], []
    client = remote.Client(lambda *a: answers.pop(0), sleep=pauses.append)
    assert list(client.paged("u", "r", size=2)) == [1, 2, 3] and pauses == [1.0]
    now = [0.0]
    pace = remote.Pace(2.0, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    pace.wait(), pace.wait()
    assert now[0] == 2.0


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    run = lambda: ingest.ingest(ingest.arriving(spark, str(folder), "k STRING, v LONG"), str(tmp_path / "t"), str(tmp_path / "bad"), str(tmp_path / "cp"), "k").awaitTermination(120)
    (folder / "1.json").write_text('{"k": "a", "v": 1}\nnot json\n')
    run()
    (folder / "2.json").write_text('{"k": "a", "v": 2}\n{"k": "b", "v": 3}\n')
    run()
    run()  # nothing new
    got = {r["k"]: r["v"] for r in ingest.current(spark, str(tmp_path / "t"), "k").collect()}
    assert got == {"a": 2, "b": 3} and spark.read.parquet(str(tmp_path / "bad")).count() == 1

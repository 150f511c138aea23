"""Records of patent offices: grant XML in archives, register XML, patent pages, proceedings, file wrappers.

Parsers are plain functions of one document, tried on what is downloaded before; the DataFrame functions run them
over files. A document that cannot be parsed gives no row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date
from html.parser import HTMLParser
from typing import Any
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.claims import dependency, limitations
from lodestar.functions.text import number_display, number_key, number_parts, stripped

from .files import PATENT

DECLARATION = b"<?xml"
#: Names of the register's XML, statuses and marks of a final decision, default document codes.
REGISTER = {"ops": "http://ops.epo.org", "ex": "http://www.epo.org/exchange"}
FINAL_STATUSES = ("FWD Entered", "Final Written Decision")
WRAPPER_CODES = ("CTNF", "CTFR", "REM", "NOA")


def day(value: str | None) -> date | None:
    """A date of YYYYMMDD or ISO form, or none."""
    digits = re.sub("[^0-9]", "", (value or "").strip()[:10])[:8]
    try:
        return date(int(digits[:4]), int(digits[4:6]), int(digits[6:8]))
    except ValueError:
        return None


def _text(node: ET.Element | None) -> str | None:
    if node is None:
        return None
    return re.sub(r"\n{3,}", "\n\n", "".join(node.itertext())).strip() or None


def _find(node: ET.Element | None, path: str) -> str:
    return ((node.findtext(path) if node is not None else None) or "").strip()


def claim(number: int, text: str, depends_on: int | None) -> dict:
    limits = [dict(zip(("label", "text", "start", "end"), x)) for x in limitations(text, number)]
    return {"number": number, "text": text, "depends_on": depends_on if depends_on != number else None, "limitations": limits}


def code(section: str, parts: list[str], subgroup: str) -> str:
    return section + "".join(parts) + (f"/{subgroup}" if subgroup else "")


def grant(xml: str) -> dict | None:
    """A patent of one grant document; none for designs, reissues, and what has no number."""
    try:
        root = ET.fromstring(re.sub(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", "", xml))
    except ET.ParseError:
        return None
    about = root.find(".//publication-reference/document-id")
    number = _find(about, "doc-number")
    if not number or number.startswith(("D", "RE")):
        return None
    application = root.find(".//application-reference/document-id")
    claims = []
    for node in root.iter("claim"):
        n = (node.get("num") or "").split("-")[0].lstrip("0")
        if n.isdigit():
            reference = node.find(".//claim-ref")
            other = re.sub(r"\D", "", reference.get("idref") or "") if reference is not None else ""
            parent = int(other) if other else dependency("".join(reference.itertext())) if reference is not None else None
            claims.append(claim(int(n), " ".join("".join(node.itertext()).split()), parent))
    codes = {}
    for node in root.iter("classification-cpc"):
        if section := _find(node, "section"):
            codes[code(section, [_find(node, x) for x in ("class", "subclass", "main-group")], _find(node, "subgroup"))] = None
    names = [(_find(i, ".//last-name"), _find(i, ".//first-name")) for i in root.iter("inventor")]
    published = day(_find(about, "date"))
    granted = root.tag == "us-patent-grant" or root.find(".//us-bibliographic-data-grant") is not None
    country, kind = _find(about, "country") or "US", _find(about, "kind") or None
    plain = number.lstrip("0")
    return {
        "patent_number": {"country_code": country, "number": plain, "kind_code": kind},
        "doc_key": country + (plain or "0"),
        "title": _text(root.find(".//invention-title")),
        "abstract": _text(root.find(".//abstract")),
        "specification": _text(root.find(".//description")),
        "claims": claims,
        "inventors": [", ".join(x for x in n if x) for n in names if any(n)],
        "assignees": [x for x in (_find(a, ".//orgname") for a in root.iter("assignee")) if x],
        "classifications": [{"scheme": "CPC", "code": c, "description": None} for c in codes],
        "priority_date": min((d for d in (day(_find(p, "date")) for p in root.iter("priority-claim")) if d), default=None),
        "filing_date": day(_find(application, "date")),
        "publication_date": published,
        "grant_date": published if granted else None,
        "application_number": _find(application, "doc-number") or None,
        "source": "uspto_bulk",
        "fidelity": 2,
    }


def grants_of(archive: bytes) -> Iterator[dict]:
    """The patents of a weekly archive, whose files hold many documents one after the other."""
    with zipfile.ZipFile(io.BytesIO(archive)) as files:
        for name in files.namelist():
            if name.lower().endswith(".xml"):
                for part in files.read(name).split(DECLARATION):
                    if part.strip() and (record := grant((DECLARATION + part).decode("utf-8", "replace"))):
                        yield record


def _columns(schema: str) -> list[str]:
    return [f.strip().split(" ")[0].strip("`") for f in re.sub(r"<[^<>]*(?:<[^<>]*(?:<[^<>]*>[^<>]*)*>[^<>]*)*>", "", schema).split(",")]


def archives(spark: SparkSession, path: str) -> DataFrame:
    """The patents of the archives of a folder. An archive cannot be split: it is one task's."""
    names = _columns(PATENT)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for where, content in zip(frame["path"], frame["content"]):
                rows: list[dict] = []
                for record in grants_of(bytes(content)):
                    rows.append({n: record.get(n) for n in names} | {"url": where})
                    if len(rows) == 500:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(lambda batches: read(batches), PATENT)


def weeks(year: int, kind: str = "grants") -> list[str]:
    """File names of a year's weekly archives: grants come out on Tuesdays, applications on Thursdays."""
    weekday = {"grants": 1, "applications": 3}[kind]
    first = date(year, 1, 1).toordinal()
    days = [date.fromordinal(d) for d in range(first, date(year, 12, 31).toordinal() + 1) if date.fromordinal(d).weekday() == weekday]
    return [f"{'ipg' if kind == 'grants' else 'ipa'}{d:%y%m%d}.zip" for d in days]


def family(xml: str) -> list[str]:
    """Display numbers of a register's family response, each once."""
    out: dict[str, None] = {}
    for member in ET.fromstring(xml).findall(".//ops:family-member", REGISTER):
        about = member.find(".//ex:publication-reference/ex:document-id[@document-id-type='docdb']", REGISTER)
        part = lambda name: (about.findtext(f"ex:{name}", "", REGISTER) or "").strip() if about is not None else ""  # noqa: B023, E731
        if part("doc-number"):
            out[(part("country") or "US") + part("doc-number") + part("kind")] = None
    return list(out)


def biblio(xml: str) -> dict | None:
    """Title and abstract (English if there is any), parties, dates and classes of a register's response."""
    doc = ET.fromstring(xml).find(".//ex:exchange-document", REGISTER)
    if doc is None:
        return None

    def language(path: str) -> str | None:
        nodes = doc.findall(path, REGISTER)
        best = next((n for n in nodes if n.get("lang", "").lower() == "en"), nodes[0] if nodes else None)
        return " ".join("".join(best.itertext()).split()) or None if best is not None else None

    def parties(path: str, name: str) -> list[str]:
        nodes = doc.findall(path, REGISTER)
        nodes = [n for n in nodes if n.get("data-format") == "original"] or nodes
        names = [" ".join((n.findtext(f"{name}/ex:name", "", REGISTER) or "").split()).rstrip(",") for n in nodes]
        return list({n.lower(): n for n in reversed(names) if n}.values())[::-1]

    def first(path: str) -> date | None:
        return day(doc.findtext(path, "", REGISTER))

    codes: dict[tuple[str, str], None] = {("IPC", " ".join((n.text or "").split())): None for n in doc.findall(".//ex:classification-ipcr/ex:text", REGISTER) if (n.text or "").strip()}
    for node in doc.findall(".//ex:patent-classification", REGISTER):
        scheme = node.find("ex:classification-scheme", REGISTER)
        name = (scheme.get("scheme", "") if scheme is not None else "").upper()
        part = lambda tag: (node.findtext(f"ex:{tag}", "", REGISTER) or "").strip()  # noqa: B023, E731
        if part("section"):
            codes["CPC" if not name or name.startswith("CPC") else name, code(part("section"), [part("class"), part("subclass"), part("main-group")], part("subgroup"))] = None
    prior = [d for d in (day(n.text) for n in doc.findall(".//ex:priority-claim//ex:date", REGISTER)) if d]
    return {
        "title": language(".//ex:invention-title"),
        "abstract": language(".//ex:abstract"),
        "inventors": parties(".//ex:inventors/ex:inventor", "ex:inventor-name"),
        "assignees": parties(".//ex:applicants/ex:applicant", "ex:applicant-name"),
        "classifications": [{"scheme": s, "code": c, "description": None} for s, c in codes],
        "priority_date": min(prior, default=None),
        "filing_date": first(".//ex:application-reference/ex:document-id/ex:date"),
        "publication_date": first(".//ex:publication-reference/ex:document-id[@document-id-type='docdb']/ex:date"),
        "source": "epo_ops",
        "fidelity": 1,
    }


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[_Node | str] = []

    def walk(self) -> Iterator[_Node]:
        for child in self.children:
            if isinstance(child, _Node):
                yield child
                yield from child.walk()

    def all(self, tag: str | None = None, prop: str | None = None, css: str | None = None) -> list[_Node]:
        return [n for n in self.walk() if tag in (None, n.tag) and (prop is None or n.attrs.get("itemprop") == prop) and (css is None or css in n.attrs.get("class", "").split())]

    def one(self, tag: str | None = None, prop: str | None = None, css: str | None = None) -> _Node | None:
        return next(iter(self.all(tag, prop, css)), None)

    def text(self, between: str = "") -> str:
        return between.join(c if isinstance(c, str) else c.text(between) for c in self.children)


class _Tree(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self._at = _Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, {k: v or "" for k, v in attrs}, self._at)
        self._at.children.append(node)
        if tag not in self.VOID:
            self._at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._at.children.append(_Node(tag, {k: v or "" for k, v in attrs}, self._at))

    def handle_endtag(self, tag: str) -> None:
        node: _Node | None = self._at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self._at = node.parent

    def handle_data(self, data: str) -> None:
        self._at.children.append(data)


def page(html: str, number: str) -> dict:
    """A patent of its public page, whose parts are marked with itemprop."""
    tree = _Tree()
    tree.feed(html)
    root = tree.root
    text = lambda tag, prop: (n.text().strip() or None) if (n := root.one(tag, prop)) else None
    names = lambda prop: [t for n in root.all("dd", prop) if (t := n.text().strip())]

    claims: dict[int, dict] = {}
    section = root.one("section", "claims")
    for node in section.all("div", css="claim") if section else []:
        digits = node.attrs.get("num", "").split("-")[0].lstrip("0")
        if digits.isdigit() and int(digits) not in claims:
            body = " ".join(node.text(" ").split())
            reference = node.one("claim-ref")
            claims[int(digits)] = claim(int(digits), body, dependency(reference.text() if reference else body))

    citations = []
    for prop, kin in (("backwardReferences", False), ("backwardReferencesFamily", True)):
        for row in root.all("tr", prop):
            cited = row.one("span", "publicationNumber")
            raw = cited.text().strip() if cited else ""
            if m := re.fullmatch(r"([A-Z]{2})([A-Z]?[0-9]+)([A-Z][0-9]?)?", raw.rstrip("*").strip()):
                citations.append({"doc_key": m[1] + (m[2].lstrip("0") or "0"), "display": m[0], "is_examiner": raw.endswith("*") or row.one("span", "examinerCited") is not None, "is_applicant": False, "is_third_party": row.one("span", "thirdPartyCited") is not None, "is_family_to_family": kin})

    codes: dict[str, tuple[bool, str | None]] = {}
    for item in (li for ul in root.all("ul", "classifications") for li in ul.all("li")):
        if (node := item.one("span", "Code")) and (name := node.text().strip()) and name not in codes:
            about, leaf = item.one("span", "Description"), item.one("meta", "Leaf")
            codes[name] = (leaf is not None and leaf.attrs.get("content") == "true", about.text().strip() if about else None)
    leaves = any(leaf for leaf, _ in codes.values())

    granted = expires = None
    for event in root.all("dd", "events"):
        when, title, kind = event.one("time", "date"), event.one("span", "title"), event.one("span", "type")
        at = day(when.attrs.get("datetime") or when.text()) if when else None
        said = title.text().strip().lower() if title else ""
        if at and ((kind is not None and kind.text().strip().lower() == "granted") or "application granted" in said):
            granted = at
        if at and "expiration" in said:
            expires = at

    m = re.fullmatch(r"([A-Z]{2})([A-Z]?[0-9]+)([A-Z][0-9]?)?", number)
    about = root.one("section", "description")
    abstract = root.one("div", css="abstract") or root.one("section", "abstract")
    return {
        "patent_number": {"country_code": m[1], "number": m[2], "kind_code": m[3]} if m else None,
        "doc_key": m[1] + (m[2].lstrip("0") or "0") if m else number.upper().strip(),
        "title": text("span", "title"),
        "abstract": abstract.text().strip() or None if abstract else None,
        "specification": re.sub(r"\n{3,}", "\n\n", about.text("\n")).strip() or None if about else None,
        "claims": [claims[n] for n in sorted(claims)],
        "citations": citations,
        "inventors": names("inventor"),
        "assignees": names("assigneeCurrent") or names("assigneeOriginal"),
        "classifications": [{"scheme": "CPC", "code": c, "description": d} for c, (leaf, d) in codes.items() if leaf or not leaves],
        "priority_date": day(text("time", "priorityDate")),
        "filing_date": day(text("time", "filingDate")),
        "publication_date": day(text("time", "publicationDate")),
        "grant_date": granted,
        "expiration_date": expires,
        "status": text("dd", "legalStatusIfi"),
        "application_number": text("dd", "applicationNumber"),
        "source": "google_patents",
        "fidelity": 3,
    }


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Patents of pages(number, html)."""
    names = _columns(PATENT)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [{n: record.get(n) for n in names} for number, html in zip(frame["number"], frame["html"]) for record in [page(html or "", number or "")]]
            yield pd.DataFrame(rows, columns=names)

    return pages.select("number", "html").mapInPandas(lambda batches: read(batches), PATENT)


# ---- proceedings and file wrappers, as JSON that has been downloaded


def proceedings(raw: DataFrame) -> DataFrame:
    """proceeding_number, patent_number, status, filing_date, petitioner, patent_owner of API records (column record, JSON)."""
    get = lambda name: F.get_json_object("record", f"$.{name}")
    return raw.select(
        F.coalesce(get("proceedingNumber"), F.lit("")).alias("proceeding_number"),
        get("respondentPatentNumber").alias("patent_number"),
        get("proceedingStatusCategory").alias("status"),
        F.coalesce(get("proceedingFilingDate"), get("accordedFilingDate")).alias("filing_date"),
        get("petitionerPartyName").alias("petitioner"),
        F.coalesce(get("respondentPartyName"), get("patentOwnerName")).alias("patent_owner"),
    )


def decided(rows: DataFrame) -> DataFrame:
    """The proceedings in which a final decision was entered."""
    return rows.where(F.col("status").isin(*FINAL_STATUSES))


def is_final(category: Column, kind: Column, title: Column) -> Column:
    """Whether a document is a final written decision."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return (low(category) == "final") | (low(kind) == "final decision") | F.contains(low(title), F.lit("final written decision")) | (low(title) == "termination decision document")


WRAPPER = "documentBag ARRAY<STRUCT<documentCode:STRING,documentCodeDescriptionText:STRING,documentDescription:STRING,officialDate:STRING,downloadOptionBag:ARRAY<STRUCT<mimeTypeIdentifier:STRING,downloadUrl:STRING>>>>"
_ENTRY = "citedPatentNumber:STRING,patentNumber:STRING,publicationNumber:STRING,citationDocumentIdentifier:STRING,citationCategoryCode:STRING,citedBy:STRING,category:STRING,examinerCitedReferenceIndicator:STRING"
CITED = ", ".join(f"{bag} ARRAY<STRUCT<{_ENTRY}>>" for bag in ("citationBag", "referenceCitationBag", "patentCitationBag"))


def wrapper_documents(raw: DataFrame, codes: tuple[str, ...] = ()) -> DataFrame:
    """app_number, code, description, date and PDF addresses of raw(app_number, record), oldest first within an application."""
    rows = raw.select("app_number", F.explode(F.from_json("record", WRAPPER)["documentBag"]).alias("d"))
    pdfs = F.transform(F.filter("d.downloadOptionBag", lambda o: (o["mimeTypeIdentifier"] == "PDF") & (F.coalesce(o["downloadUrl"], F.lit("")) != "")), lambda o: o["downloadUrl"])
    rows = rows.select("app_number", F.coalesce("d.documentCode", F.lit("")).alias("code"), F.coalesce("d.documentCodeDescriptionText", "d.documentDescription").alias("description"), F.col("d.officialDate").alias("date"), F.coalesce(pdfs, F.array().cast("array<string>")).alias("pdf_urls"))
    return rows.where(F.col("code").isin(*codes)) if codes else rows


def wrapper_text(texts: DataFrame) -> DataFrame:
    """app_number and the text of its documents(app_number, code, date, text), oldest first, each under its header."""
    header = F.concat(F.lit("=== "), F.trim(F.concat_ws(" ", "code", F.coalesce("date", F.lit("")))), F.lit(" ==="))
    part = F.struct(F.coalesce("date", F.lit("")).alias("date"), F.concat(header, F.lit("\n"), stripped(F.col("text"))).alias("part"))
    return texts.groupBy("app_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["part"]), "\n\n").alias("text"))


def cited_art(raw: DataFrame) -> DataFrame:
    """app_number, doc_key, display and flags of what the citation bags of raw(app_number, record) name."""
    bags = F.from_json("record", CITED)
    every = F.concat(*[F.coalesce(bags[b], F.array().cast(f"array<struct<{_ENTRY}>>")) for b in ("citationBag", "referenceCitationBag", "patentCitationBag")])
    rows = raw.select("app_number", F.explode(every).alias("c"))
    number = number_parts(F.coalesce("c.citedPatentNumber", "c.patentNumber", "c.publicationNumber", "c.citationDocumentIdentifier"))
    kind = F.lower(F.coalesce("c.citationCategoryCode", "c.citedBy", "c.category", F.lit("")))
    flagged = F.coalesce(F.col("c.examinerCitedReferenceIndicator").isin("true", "Y", "YES"), F.lit(False))
    rows = rows.select("app_number", number.alias("p"), (kind.contains("examiner") | flagged).alias("is_examiner"), kind.contains("applicant").alias("is_applicant")).where("p is not null")
    return rows.select("app_number", number_key(F.col("p")).alias("doc_key"), number_display(F.col("p")).alias("display"), "is_examiner", "is_applicant")


def enriched(citations: DataFrame, found: DataFrame) -> DataFrame:
    """citations(src_key, display, ...) with those found(src_key, display, ...) that are not among them yet."""
    return citations.unionByName(found.join(citations.select("src_key", "display"), ["src_key", "display"], "left_anti"), allowMissingColumns=True)


def record_of(value: dict[str, Any]) -> dict[str, Any]:
    """A driver-side record with all the columns of a patent."""
    return {n: value.get(n) for n in _columns(PATENT)}

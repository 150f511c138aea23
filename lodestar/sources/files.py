"""Files: JSON lines in three degrees of strictness, JSON documents, declaration tables, documents as text."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.html import text_of

#: DDL of a patent record.
PATENT = """
patent_number STRUCT<country_code:STRING,number:STRING,kind_code:STRING>, doc_key STRING, title STRING, abstract STRING, specification STRING,
claims ARRAY<STRUCT<number:INT,text:STRING,depends_on:INT,limitations:ARRAY<STRUCT<label:STRING,text:STRING,start:INT,`end`:INT>>>>,
citations ARRAY<STRUCT<doc_key:STRING,display:STRING,is_examiner:BOOLEAN,is_applicant:BOOLEAN,is_third_party:BOOLEAN,is_family_to_family:BOOLEAN>>,
inventors ARRAY<STRING>, assignees ARRAY<STRING>, classifications ARRAY<STRUCT<scheme:STRING,code:STRING,description:STRING>>,
priority_date DATE, filing_date DATE, publication_date DATE, grant_date DATE, expiration_date DATE, status STRING, application_number STRING,
source STRING, fidelity INT, url STRING
"""
#: How the columns of a table of declarations are named, by the words of its headers.
DECLARATION_HEADERS = {
    "declaring_company": ["declaring company", "company name", "declarant", "company"],
    "patent_number": ["publication number", "patent number", "application number", "granted patent", "patent", "publication", "application"],
    "standard": ["specification number", "standard number", "specification", "standard", "spec"],
    "project": ["project", "technology", "committee"],
    "declaration_date": ["declaration date", "signature date", "date"],
}


def lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; what is no JSON is left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def permissive(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of JSON lines, and the lines (column bad) that are none. Blank lines are neither."""
    rows = spark.read.schema(f"{schema}, _bad STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).cache()
    return rows.where("_bad is null").drop("_bad"), rows.where("_bad is not null").select(F.col("_bad").alias("bad"))


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; reading fails at a line that is none."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def document(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """The entries of an array field of a JSON document, in order of seq."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.posexplode(field).alias("seq", "_e")).select("seq", "_e.*")


def mapped_headers(headers: Iterable[str]) -> dict[str, str]:
    """field -> header: each field takes the first header, not yet taken, that holds its best words."""
    words = {h: re.sub("[^a-z0-9]+", " ", h.lower()).strip() for h in headers if h}
    out: dict[str, str] = {}
    for field, wanted in DECLARATION_HEADERS.items():
        hit = next((h for w in wanted for h, text in words.items() if w in text and h not in out.values()), None)
        if hit is not None:
            out[field] = hit
    return out


def declarations(spark: SparkSession, path: str) -> DataFrame:
    """A table of standard-essential patents: the fields of DECLARATION_HEADERS, null if missing, and the row as a map."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    names = [c.lstrip("﻿") for c in rows.columns]
    rows = rows.toDF(*names)
    field_of = mapped_headers(names)
    value = lambda f: F.nullif(F.trim(F.col(f"`{field_of[f]}`")), F.lit("")) if f in field_of else F.lit(None).cast("string")
    raw = F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"`{n}`"))]) if names else F.create_map()
    return rows.select(*[value(f).alias(f) for f in DECLARATION_HEADERS], raw.alias("raw"))


def for_standard(rows: DataFrame, standard: str, seq: str = "seq") -> DataFrame:
    """patent_number of the declarations whose standard holds the given one, white space and case apart, each once, in order."""
    squeezed = re.sub(r"\s+", "", standard).lower()
    hit = F.contains(F.lower(F.regexp_replace(F.coalesce("standard", F.lit("")), r"\s+", "")), F.lit(squeezed))
    found = rows.where(hit & (F.coalesce("patent_number", F.lit("")) != ""))
    return found.groupBy("patent_number").agg(F.min(seq).alias(seq))


def declaration_rows(text: str) -> list[dict]:
    """The same for a small table on the driver."""
    reader = csv.DictReader(io.StringIO(text.lstrip("﻿")))
    field_of = mapped_headers(reader.fieldnames or [])
    return [{f: (row.get(field_of.get(f, "")) or "").strip() or None for f in DECLARATION_HEADERS} | {"raw": dict(row)} for row in reader]


def kind_of(data: bytes, name: str = "") -> str:
    """pdf, docx, html, md or txt, by the name's ending, else by the first bytes."""
    ending = name.lower().rpartition(".")[2]
    if ending in ("pdf", "docx", "html", "htm", "md", "txt"):
        return "html" if ending == "htm" else ending
    head = data[:512].lstrip().lower()
    if head.startswith(b"%pdf"):
        return "pdf"
    if data[:2] == b"PK":
        return "docx"
    return "html" if head.startswith((b"<!doctype html", b"<html")) else "txt"


def _docx(data: bytes) -> str:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))


def extracted(data: bytes, name: str = "") -> str:
    """The text of a document. PDF needs a library that may be missing."""
    kind = kind_of(data, name)
    if kind == "docx":
        return _docx(data)
    if kind == "pdf":
        try:
            import fitz
        except ImportError as error:
            raise ImportError("reading PDF needs PyMuPDF") from error
        with fitz.open(stream=data, filetype="pdf") as pages:
            return "\n".join(page.get_text() for page in pages)
    text = data.decode("utf-8", "replace")
    return text_of(text) if kind == "html" else text


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path and text of the files of a folder; null where a file cannot be read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for name, data in zip(frame["path"], frame["content"]):
                try:
                    out.append((name, extracted(bytes(data), name)))
                except (ImportError, ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                    out.append((name, None))
            yield pd.DataFrame(out, columns=["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(lambda batches: read(batches), "path string, text string")


class Catalogs:
    """Named product tables, which fill in for candidates that a search is not given."""

    def __init__(self) -> None:
        self._tables: dict[str, DataFrame] = {}

    def register(self, name: str, products: DataFrame) -> None:
        self._tables[name] = products

    def get(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise KeyError(f"no catalog {name!r}; there are {self.names()}")
        return self._tables[name]

    def names(self) -> list[str]:
        return sorted(self._tables)

    def candidates(self, given: DataFrame | None = None) -> DataFrame | None:
        """The products given, or else those of all catalogs; without those that have neither name nor description."""
        rows = given
        for name in self.names() if given is None else ():
            rows = self._tables[name] if rows is None else rows.unionByName(self._tables[name], allowMissingColumns=True)
        return rows if rows is None else rows.where((F.coalesce("name", F.lit("")) != "") | (F.coalesce("description", F.lit("")) != ""))


def corpus(edges: DataFrame, seeds: DataFrame, size: int, seed: int = 7) -> DataFrame:
    """size keys at most: the seeds (key) and, in a seeded order, their neighbours over edges(src, dst)."""
    near = edges.select("src", "dst").union(edges.select("dst", "src")).join(seeds, F.col("src") == F.col("key")).select(F.col("dst").alias("key")).distinct()
    rows = seeds.select("key", F.lit(0).alias("_o")).unionByName(near.join(seeds, "key", "left_anti").withColumn("_o", F.lit(1)))
    return rows.orderBy("_o", F.xxhash64("key", F.lit(seed)), "key").limit(size).select("key")

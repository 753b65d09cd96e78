"""Article records from XML documents and back.

A document is one string: blank or malformed ones give nothing, malformed records within one are skipped.
Documents are parsed in Arrow batches in Python, as mixed content (<i> within a title) and the rule that
one fault drops the whole document are beyond Spark's XML functions; large files of many records go
through Spark's own reader, which splits them, in ``read_xml_records``.
"""

from __future__ import annotations

import datetime
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from litloom.schemas import ARTICLE

RECORD = "PubmedArticle"
_PMID = re.compile(r"\d{1,8}").fullmatch


def _inner(e: ET.Element | None) -> str:
    return "" if e is None else "".join(e.itertext()).strip()


def _inners(e: ET.Element, path: str) -> list[str]:
    return [t for t in map(_inner, e.iterfind(path)) if t]


def _year(value: str, limit: int) -> int | None:
    try:
        y = int(value)
    except ValueError:
        return None
    return y if 1900 <= y <= limit else None


def _resolve_year(citation: ET.Element, limit: int) -> int | None:
    """The issue's year; else the first four-digit number of its free date, valid or not; else the article's."""
    at = "Article/Journal/JournalIssue/PubDate/"
    direct = _year(_inner(citation.find(at + "Year")), limit)
    if direct is not None:
        return direct
    free = re.search(r"\b(\d{4})\b", _inner(citation.find(at + "MedlineDate")))
    return _year(free[1] if free else _inner(citation.find("Article/ArticleDate/Year")), limit)


def _author(e: ET.Element) -> str:
    group, last, first = (_inner(e.find(n)) for n in ("CollectiveName", "LastName", "ForeName"))
    return group or ", ".join(x for x in (last, first) if x)


def _headings(citation: ET.Element) -> list[str]:
    out = []
    for h in citation.iterfind(".//MeshHeadingList/MeshHeading"):
        name = _inner(h.find("DescriptorName"))
        if name:
            out += [f"{name} / {q}" for q in _inners(h, "QualifierName")] or [name]
    return out


def _abstract(article: ET.Element) -> str:
    parts = ((_inner(e), (e.get("Label") or "").strip()) for e in article.iterfind("Abstract/AbstractText"))
    return "\n".join(f"{label}: {t}" if label else t for t, label in parts if t)


def _doi(record: ET.Element) -> str | None:
    """The first article id that is a doi decides, even if it is blank; else the first such location id."""
    for path, attribute in ((".//PubmedData/ArticleIdList/ArticleId", "IdType"), (".//ELocationID", "EIdType")):
        for e in record.iterfind(path):
            if (e.get(attribute) or "").lower() == "doi":
                return _inner(e) or None
    return None


def parse_record(record: ET.Element, limit: int) -> tuple | None:
    citation, article = record.find("MedlineCitation"), record.find("MedlineCitation/Article")
    if citation is None or article is None:
        return None
    pmid = _inner(citation.find("PMID"))
    if not _PMID(pmid):
        return None
    journal = _inner(article.find("Journal/Title")) or _inner(citation.find("MedlineJournalInfo/MedlineTA"))
    authors = [a for a in map(_author, citation.iterfind(".//AuthorList/Author")) if a]
    return pmid, _inner(article.find("ArticleTitle")), _abstract(article), authors, journal, _resolve_year(citation, limit), _headings(citation), _inners(citation, ".//KeywordList/Keyword"), _doi(record)


def parse_document(doc: str | None, limit: int | None = None) -> list[tuple]:
    limit = limit or datetime.datetime.now(datetime.UTC).year + 1
    if not doc or not doc.strip():
        return []
    try:
        root = ET.fromstring(doc)
    except ET.ParseError:
        return []
    return [r for r in (parse_record(e, limit) for e in root.iterfind(f".//{RECORD}")) if r is not None]


def parse_xml(docs: DataFrame, column: str = "xml", limit: int | None = None) -> DataFrame:
    """One row an article, of every document in the column."""
    schema = to_arrow_schema(ARTICLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for d in b.column(0).to_pylist() for r in parse_document(d, limit)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return docs.select(docs[column].cast("string")).mapInArrow(run, ARTICLE)


def read_xml(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Files that are whole documents of moderate size, one a row."""
    return parse_xml(spark.read.text(path, wholetext=True).withColumnRenamed("value", "xml"), limit=limit)


def read_xml_records(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Large files of many records: lines are cut at record ends, so files split over tasks."""
    parts = spark.read.option("lineSep", f"</{RECORD}>").text(path)
    from pyspark.sql import functions as F

    start = F.regexp_instr("value", F.lit(rf"<{RECORD}[\s>]"))
    doc = F.concat(F.lit("<set>"), F.substring("value", start, F.length("value")), F.lit(f"</{RECORD}></set>"))
    return parse_xml(parts.where(start > 0).select(doc.alias("xml")), limit=limit)


def to_xml(articles: DataFrame) -> DataFrame:
    """(pmid, xml): each article as a document of the same format with one record."""

    def record(a: dict) -> str:
        top = ET.Element(RECORD)

        def put(parent: ET.Element, path: str, value: str | None, **attributes: str) -> ET.Element:
            for name in path.split("/")[:-1]:
                parent = parent.find(name) if parent.find(name) is not None else ET.SubElement(parent, name)
            e = ET.SubElement(parent, path.rsplit("/", 1)[-1], attributes)
            e.text = value
            return e

        c = put(top, "MedlineCitation", None)
        put(c, "PMID", a["pmid"])
        put(c, "Article/ArticleTitle", a["title"])
        put(c, "Article/Abstract/AbstractText", a["abstract"])
        put(c, "Article/Journal/Title", a["journal"])
        if a["year"] is not None:
            put(c, "Article/Journal/JournalIssue/PubDate/Year", str(a["year"]))
        for name in a["authors"] or []:
            e = put(c, "Article/AuthorList/Author", None)
            last, comma, first = name.partition(",")
            for tag, value in (("LastName", last), ("ForeName", first)) if comma else (("CollectiveName", name),):
                put(e, tag, value.strip())
        for term in a["mesh_terms"] or []:
            e = put(c, "MeshHeadingList/MeshHeading", None)
            name, slash, qualifier = term.partition(" / ")
            put(e, "DescriptorName", name.strip() if slash else term)
            if slash:
                put(e, "QualifierName", qualifier.strip())
        for word in a["keywords"] or []:
            put(c, "KeywordList/Keyword", word)
        put(top, "PubmedData/ArticleIdList/ArticleId", a["pmid"], IdType="pubmed")
        if a["doi"]:
            put(top, "PubmedData/ArticleIdList/ArticleId", a["doi"], IdType="doi")
        return f"<{RECORD}Set>{ET.tostring(top, encoding='unicode')}</{RECORD}Set>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([record(a) for a in b.to_pylist()], pa.string())], names=["pmid", "xml"])

    return articles.select(*ARTICLE.names).mapInArrow(run, "pmid string, xml string")

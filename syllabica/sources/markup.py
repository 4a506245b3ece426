"""Paragraphs and readable text out of XML and HTML."""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import norm_heading, reading_text, strip

# Fixed values of the two bulletin formats.
_PARAGRAPH = r"(?s)<p\b([^>]*?)(?:/>|>(.*?)</p\s*>)"
_CLASS = r"\bclass\s*=\s*[\"']([^\"']*)[\"']"
_BODY = r"(?s)<texto\b[^>]*>(.*)</texto>"
_HEADING = r"(?s)<(?:\w+:)?heading\b[^>]*>(.*?)</(?:\w+:)?heading>"
_CONTAINER = r"(?s)<(?:\w+:)?hcontainer\b.*?(?=<(?:\w+:)?hcontainer\b|\z)"
_PERIOD = r"(?s)<(?:\w+:)?content\b[^>]*?\bperiod\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
HEADING_CLASS, TEXT_CLASS = "akn_heading", "akn_p"


@F.pandas_udf(StringType())
def decode_entities(texts: pd.Series) -> pd.Series:
    """Character references of HTML decoded."""
    return texts.map(unescape, na_action="ignore")


# Not random, but marked so: a filter on the text must not call it again.
decode_entities = decode_entities.asNondeterministic()


def _plain(c: Column) -> Column:
    """Tags to spaces, references decoded."""
    return decode_entities(F.regexp_replace(c, "<[^>]+>", " "))


def read_documents(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """(doc_id, raw): one row per file; a bulletin is one file."""
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("raw"))


def paragraphs_from_xml(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, cls, text) of the ``<p class>`` elements of the text body.

    Blank paragraphs drop out; ``seq`` keeps the order of the document.
    """
    body = F.regexp_extract("raw", _BODY, 1)
    attrs = F.regexp_extract_all(body, F.lit(_PARAGRAPH), F.lit(1))
    inner = F.regexp_extract_all(body, F.lit(_PARAGRAPH), F.lit(2))
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip(attrs.alias("a"), inner.alias("t"))).alias("seq", "p"))
    return rows.select(
        "doc_id", F.col("seq").cast("bigint").alias("seq"),
        decode_entities(F.regexp_extract("p.a", _CLASS, 1)).alias("cls"), strip(_plain(F.col("p.t"))).alias("text"),
    ).where(F.col("text") != "")


def split_escaped_html(c: Column) -> Column:
    """Array of plain paragraphs of HTML kept escaped in an attribute.

    Paragraph ends and line breaks both separate.
    """
    pieces = F.split(c, r"(?i)</p\s*>|<br\s*/?>")
    clean = F.transform(pieces, lambda t: norm_heading(F.regexp_replace(t, "<[^>]+>", " ")))
    return F.filter(clean, lambda t: t != "")


def paragraphs_from_escaped_html(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, cls, text) where the text sits escaped in an attribute.

    The attribute is decoded twice: once as XML, once as the HTML it holds.
    """
    parts = docs.select(
        "doc_id", F.posexplode(F.regexp_extract_all("raw", F.lit(_CONTAINER), F.lit(0))).alias("n", "bloque")
    )
    period = F.concat(F.regexp_extract("bloque", _PERIOD, 1), F.regexp_extract("bloque", _PERIOD, 2))
    opened = parts.select(
        "doc_id", "n",
        norm_heading(_plain(F.regexp_extract("bloque", _HEADING, 1))).alias("titulo"),
        decode_entities(decode_entities(period)).alias("html"),
    )
    heading = F.when(F.col("titulo") != "", F.array(F.struct(F.lit(HEADING_CLASS).alias("cls"), F.col("titulo").alias("text"))))
    texts = F.transform(split_escaped_html(F.col("html")), lambda t: F.struct(F.lit(TEXT_CLASS).alias("cls"), t.alias("text")))
    none = F.array().cast("array<struct<cls:string,text:string>>")
    rows = opened.select("doc_id", "n", F.posexplode(F.concat(F.coalesce(heading, none), F.coalesce(texts, none))).alias("i", "p"))
    # A place is the paragraphs of the containers before, and the place in its own.
    counts = opened.select("doc_id", "n", (F.size(F.coalesce(heading, none)) + F.size(F.coalesce(texts, none))).alias("c"))
    before = counts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("antes"))
    total = F.aggregate(F.filter("antes", lambda e: e["n"] < F.col("n")), F.lit(0).cast("bigint"), lambda a, e: a + e["c"])
    return rows.join(before, "doc_id").select("doc_id", (total + F.col("i")).alias("seq"), "p.cls", "p.text")


# What is not read aloud, and the tags that break a line.
_SILENT = {"button", "script", "style"}
_SILENT_CLASS = "seccion-gen__acciones"
_BREAKS = set(
    "p div section article header footer h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr br hr".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())


class _Reader(HTMLParser):
    """Text of one page as it would be read aloud."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent: list[str] = []
        self.table: dict | None = None

    def _hidden(self, tag: str, attrs: dict) -> bool:
        return (
            tag in _SILENT
            or attrs.get("aria-hidden") == "true"
            or "hidden" in attrs
            or _SILENT_CLASS in (attrs.get("class") or "").split()
        )

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent:
            if tag == self.silent[-1] and tag not in _VOID:
                self.silent.append(tag)
            return
        if self._hidden(tag, dict(attrs)) and self.table is None:
            if tag not in _VOID:
                self.silent.append(tag)
            return
        if self.table is not None:
            self._table_tag(tag)
        elif tag == "table":
            self.table = {"part": None, "heads": [], "rows": [], "cell": None, "depth": 1}
        elif tag in _BREAKS:
            self.parts.append("\n")

    def _table_tag(self, tag: str) -> None:
        table = self.table
        if tag == "table":
            table["depth"] += 1
        elif tag in ("thead", "tbody", "tfoot"):
            table["part"], table["cell"] = tag, None
        elif tag == "tr":
            # Rows outside any section belong to an implied body.
            table["part"] = table["part"] or "tbody"
            table["cell"] = None
            if table["part"] == "tbody":
                table["rows"].append([])
        elif tag in ("td", "th"):
            table["cell"] = []
            if table["part"] == "thead" and tag == "th":
                table["heads"].append(table["cell"])
            elif table["part"] == "tbody" and table["rows"]:
                table["rows"][-1].append(table["cell"])

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.pop()
            return
        if self.table is not None:
            if tag == "table":
                self.table["depth"] -= 1
                if self.table["depth"] == 0:
                    self._close_table()
            elif tag in ("td", "th", "tr"):
                self.table["cell"] = None
        elif tag in _BREAKS and tag not in _VOID:
            self.parts.append("\n")

    def _close_table(self) -> None:
        heads = ["".join(h).strip() for h in self.table["heads"]]
        lines = []
        for row in self.table["rows"]:
            said = []
            for i, cell in enumerate(row):
                value = "".join(cell).strip()
                if value:
                    head = heads[i] if i < len(heads) else ""
                    said.append(f"{head}: {value}" if head else value)
            if said:
                lines.append(". ".join(said))
        self.table = None
        self.parts.append("\n" + "\n".join(lines) + "\n")

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.table is None:
            self.parts.append(data)
        elif self.table["cell"] is not None:
            self.table["cell"].append(data)

    def text(self) -> str:
        if self.table is not None:
            self._close_table()
        return "".join(self.parts)


def _read_page(html: str) -> str:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.text()


@F.pandas_udf(StringType())
def spoken_parts(pages: pd.Series) -> pd.Series:
    """Text of HTML pages, line breaks where ideas separate."""
    return pages.map(_read_page, na_action="ignore")


def readable_text(pages: DataFrame, html: str = "html", out: str = "lectura") -> DataFrame:
    """Pages with their readable text; tables read as ``header: value``."""
    return pages.withColumn(out, reading_text(spoken_parts(F.col(html))))

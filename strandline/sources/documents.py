"""Text from documents held as bytes or markup: HTML, XML, DOCX, ODT, e-mail, plain text; members of zips."""

from __future__ import annotations

import email
import email.message
import email.policy
import io
import os
import re
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatch
from html.parser import HTMLParser
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements whose text isn't shown, and those that end a line.
_HIDDEN = {"script", "style", "head", "title", "meta", "noscript", "template"}
_BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "section", "article", "nav", "header", "footer", "pre", "blockquote"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN and tag != "meta":
            self.hidden.append(tag)
        if tag in _BLOCKS:
            self.pieces.append("\n")

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        if tag in _BLOCKS:
            self.pieces.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.pieces.append(data)


def visible_text(html: str) -> str:
    """What a reader sees of a page: lines of text with single spaces, none empty."""
    parser = _Visible()
    parser.feed(html)
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.pieces).split("\n"))
    return "\n".join(line for line in lines if line)


def html_to_text():
    """Arrow UDF: ``visible_text`` of a column; null stays."""

    def work(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: None if x is None else visible_text(x))

    return F.pandas_udf(work, "string")


def _docx(raw: bytes) -> str:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    body = root.find(f"{_W}body")
    out: list[str] = []

    def paragraph(p) -> str:
        marks = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n", f"{_W}cr": lambda e: "\n"}
        return "".join(marks[e.tag](e) for e in p.iter() if e.tag in marks)

    for child in body if body is not None else ():
        if child.tag == f"{_W}p":
            out.append(paragraph(child))
        elif child.tag == f"{_W}tbl":
            for row in child.iter(f"{_W}tr"):
                out.append(" | ".join(" ".join(paragraph(p) for p in cell.iter(f"{_W}p")) for cell in row.findall(f"{_W}tc")))
    return "\n".join(out)


def _odt(raw: bytes) -> str:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("content.xml"))
    return "\n".join("".join(e.itertext()) for e in root.iter() if e.tag.endswith(("}p", "}h")))


def _xml(raw: bytes) -> str:
    return " ".join(x.strip() for x in ElementTree.fromstring(raw).itertext() if x.strip())


def _eml(raw: bytes) -> str:
    message = email.message_from_bytes(raw, policy=email.policy.default)
    body = message.get_body(("html", "plain"))
    out = []
    if body is not None:
        out.append(visible_text(body.get_content()) if body.get_content_subtype() == "html" else body.get_content())
    for part in message.iter_attachments():
        payload = part.get_payload(decode=True)
        if payload:
            out.append(to_text(payload, os.path.splitext(part.get_filename() or "")[1]))
    return "\n".join(out)


def _plain(raw: bytes) -> str:
    for encoding in ("utf-8", "cp1252"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            pass
    return raw.decode("latin-1")


def _printable(raw: bytes) -> str:
    """Runs of four printable characters or more."""
    return "\n".join(x.decode() for x in re.findall(rb"[\x20-\x7e]{4,}", raw))


READERS = {".docx": _docx, ".odt": _odt, ".html": lambda b: visible_text(_plain(b)), ".htm": lambda b: visible_text(_plain(b)), ".xml": _xml, ".eml": _eml, ".txt": _plain, ".log": _plain, ".csv": _plain, ".tsv": _plain}


def _zipped(member: str, content: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(member, content)
    return out.getvalue()


def _as_docx(text: str) -> bytes:
    lines = "".join(f"<w:p><w:r><w:t xml:space='preserve'>{escape(x)}</w:t></w:r></w:p>" for x in text.split("\n"))
    return _zipped("word/document.xml", f"<w:document xmlns:w='{_W[1:-1]}'><w:body>{lines}</w:body></w:document>")


def _as_odt(text: str) -> bytes:
    lines = "".join(f"<text:p>{escape(x)}</text:p>" for x in text.split("\n"))
    return _zipped("content.xml", f"<office:document-content xmlns:office='urn:oasis:names:tc:opendocument:xmlns:office:1.0' xmlns:text='urn:oasis:names:tc:opendocument:xmlns:text:1.0'>{lines}</office:document-content>")


def _as_eml(text: str) -> bytes:
    message = email.message.EmailMessage()
    message.set_content(text)
    return message.as_bytes()


WRITERS = {
    "docx": _as_docx, "odt": _as_odt, "eml": _as_eml, "html": lambda t: "".join(f"<p>{escape(x)}</p>" for x in t.split("\n")).encode(),
    "xml": lambda t: ("<d>" + "".join(f"<l>{escape(x)}</l>" for x in t.split("\n")) + "</d>").encode(),
}


def written(text: Column, kind: Column) -> Column:
    """The bytes of a document of a kind (docx, odt, eml, html, xml; else plain UTF-8) with a paragraph for each line."""
    work = lambda texts, kinds: pd.Series([None if t is None else WRITERS.get(k, str.encode)(t) for t, k in zip(texts, kinds)])
    work.__annotations__ = {"texts": pd.Series, "kinds": pd.Series, "return": pd.Series}
    return F.pandas_udf(work, "binary")(text, kind)


def can_read(extension: str) -> bool:
    return extension.lower() in READERS


def to_text(raw: bytes, extension: str) -> str:
    """Text of a document by its extension; of an unknown kind its printable runs."""
    return READERS.get(extension.lower(), _printable)(raw)


def read_documents(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True, strip: bool = False) -> DataFrame:
    """Rows (path, text, error) of the files under a path that any of Spark's file systems reaches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    text, error = to_text(content.as_py(), os.path.splitext(where)[1]), None
                    text = "\n".join(x.rstrip() for x in text.split("\n")) if strip else text
                except Exception as e:  # a broken file is a row with its error
                    text, error = None, f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])

    return files.select("path", "content").mapInArrow(work, "path string, text string, error string")


def zip_members(spark: SparkSession, path: str, pattern: str = "*", zips: str = "*.zip") -> DataFrame:
    """Rows (path, member, content) of the members of zips whose names fit a pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", zips).load(path).select("path", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        if not name.endswith("/") and fnmatch(name, pattern):
                            yield pa.RecordBatch.from_arrays([pa.array([where]), pa.array([name]), pa.array([z.read(name)], pa.binary())], names=["path", "member", "content"])

    return files.mapInArrow(work, "path string, member string, content binary")


def openxml_kind(members: DataFrame) -> DataFrame:
    """Rows (path, kind): docx, pptx or xlsx by the folders inside, else null. ``members`` as from ``zip_members``."""
    kind = F.when(F.bool_or(F.col("member").startswith("word/")), "docx").when(F.bool_or(F.col("member").startswith("ppt/")), "pptx").when(F.bool_or(F.col("member").startswith("xl/")), "xlsx")
    return members.groupBy("path").agg(kind.alias("kind"))


def grep_members(members: DataFrame, pattern: str, miss: bool = False) -> DataFrame:
    """Rows (path, matches) for files with (or without) a match of the pattern in any member."""
    found = F.bool_or(F.col("content").cast("string").rlike(pattern))
    return members.groupBy("path").agg(found.alias("matches")).filter(~F.col("matches") if miss else F.col("matches"))


def good_zip():
    """Arrow UDF: whether bytes are a zip without damage."""

    def good(raw: bytes) -> bool:
        try:
            return zipfile.ZipFile(io.BytesIO(raw)).testzip() is None
        except (zipfile.BadZipFile, OSError, EOFError):
            return False

    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else good(x)), "boolean")


def extension(path: Column) -> Column:
    """Extension of a path in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))

"""Readers of document files: each turns rows of (doc_id, path, content) into ordered blocks.

Blocks: doc_id, block_idx, text, page, heading_level, is_table, cells. A file that cannot be
read gives one row with ``error_code`` and no text; no file stops a job. Decoding is per-file
Python; all that follows is relational. PDF pages and images need decoders that are plugged in
as callables; old binary Word files are reported as unsupported."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html
from ..functions import text as T
from ..operators import intake
from . import mime

# Limits on files, and the namespace of word-processing documents.
MAX_BYTES = 50 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

RAW = "doc_id {0}, kind string, idx int, page int, text string, style string, cells array<string>, error_code string"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """doc_id, path, length and content of the files under a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(F.sha2("path", 256).alias("doc_id"), "path", "length", "content")


def zip_entries(content: bytes) -> list[str]:
    try:
        return zipfile.ZipFile(io.BytesIO(content)).namelist()
    except zipfile.BadZipFile:
        return []


def docx_rows(content: bytes) -> Iterator[tuple[str, str, list[str]]]:
    """(text, style, cells) of paragraphs and table rows in the order of the body."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
    for child in body:
        if child.tag == f"{_W}p":
            yield _paragraph(child), _style(child, names), []
        elif child.tag == f"{_W}tbl":
            rows = [[["\n".join(_paragraph(p) for p in c.iter(f"{_W}p"))] for c in r.findall(f"{_W}tc")] for r in child.findall(f"{_W}tr")]
            if max(map(len, rows), default=0) <= 1:  # a table of one column only lays paragraphs out
                for p in child.iter(f"{_W}p"):
                    yield _paragraph(p), _style(p, names), []
            else:
                for r in rows:
                    cells = [c[0].strip() for c in r if c[0].strip()]
                    yield " ".join(cells), "", cells


def _paragraph(p: ElementTree.Element) -> str:
    parts = {f"{_W}t": lambda e: e.text or "", f"{_W}br": lambda e: "\n", f"{_W}cr": lambda e: "\n", f"{_W}tab": lambda e: "\t"}
    return "".join(parts[e.tag](e) for e in p.iter() if e.tag in parts)


def _style(p: ElementTree.Element, names: dict[str, str]) -> str:
    s = p.find(f"{_W}pPr/{_W}pStyle")
    key = s.get(f"{_W}val") if s is not None else ""
    return names.get(key) or key


def mhtml_text(content: bytes) -> tuple[str, str]:
    """(kind, text) of the first HTML part of an archive, else of the first plain part; ValueError without any or beyond the limits of ``mime``."""
    plain = None
    for _, kind, text in mime.parts(iter(content.splitlines(keepends=True))):
        if kind == "text/html":
            return "html", text
        plain = text if plain is None else plain
    if plain is None:
        raise ValueError("no text")
    return "plain", plain


def decode_files(docs: DataFrame, pdf_pages: Callable[[bytes], list[str]] | None = None, ocr: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Raw rows of (doc_id, content): kind docx, html, plain, page or error.

    ``pdf_pages`` gives the text of each page of a PDF; ``ocr`` the lines of an image or of a
    PDF without usable text. Where one is missing its files get UNSUPPORTED_DOCUMENT_TYPE."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    typed = docs.withColumn("entries", F.lit(""))

    def one(content: bytes) -> list[tuple]:
        if len(content) > MAX_BYTES:
            return [("error", 0, 1, None, None, [], "DOCUMENT_TOO_LARGE")]
        if not content:
            return [("error", 0, 1, None, None, [], "EMPTY_FILE")]
        head = content[:8192].lower()
        try:
            if content[:4] == b"%PDF":
                if pdf_pages is None:
                    raise NotImplementedError
                pages = pdf_pages(content)
                if len(pages) > intake.MAX_PAGES:
                    return [("error", 0, 1, None, None, [], "PDF_PAGE_LIMIT_EXCEEDED")]
                return [("page", k, k + 1, t, None, [], None) for k, t in enumerate(pages)]
            if content[:2] == b"PK" and {"[Content_Types].xml", "word/document.xml"} <= set(zip_entries(content)):
                return [("docx", k, 1, t, s, c, None) for k, (t, s, c) in enumerate(docx_rows(content))]
            if b"mime-version:" in head or b"multipart/related" in head:
                kind, text = mhtml_text(content)
                return [(kind, 0, 1, text, None, [], None)]
            if content[:3] == b"\xff\xd8\xff" or content[:4] == b"\x89PNG":
                if ocr is None:
                    raise NotImplementedError
                return [("plain", 0, 1, "\n".join(ocr(content)), None, [], None)]
            raise NotImplementedError
        except NotImplementedError:
            return [("error", 0, 1, None, None, [], "UNSUPPORTED_DOCUMENT_TYPE")]
        except Exception:  # noqa: BLE001  a broken file is a row, not a failed job
            return [("error", 0, 1, None, None, [], "DOCUMENT_PARSE_FAILED")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"].to_pylist(), batch["content"], strict=True):
                rows = [(doc_id, *r) for r in one(content.as_py() or b"")]
                cols = list(zip(*rows, strict=True)) or [[] for _ in range(8)]
                types = [batch["doc_id"].type, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "kind", "idx", "page", "text", "style", "cells", "error_code"])

    return typed.select("doc_id", "content").mapInArrow(run, RAW.format(id_type))


def blocks(raw: DataFrame, infer: bool = True) -> DataFrame:
    """Blocks of raw rows: HTML by its line elements, everything else by its lines. infer: whether numbering makes headings in HTML too, beside its own marks."""
    lines = (
        F.when(F.col("kind") == "html", html.html_lines(F.col("text"), True))
        .when(F.size("cells") > 0, F.array(T.clean(F.col("text"))))
        .otherwise(T.split_lines(F.col("text")))
    )
    rows = raw.where("error_code is null").select("*", F.posexplode(lines).alias("k", "line"))
    tag = F.regexp_extract("line", r"^([1-6])\t", 1)
    text = F.regexp_replace("line", r"^[1-6]\t", "")
    rows = rows.withColumn("tag", tag).withColumn("line", text)
    level = F.when(F.size("cells") > 0, 0).when(F.col("tag") != "", F.col("tag").cast("int")).when((F.col("kind") == "html") & (not infer), 0).otherwise(T.style_level(F.col("style"), F.col("line")))
    at = F.row_number().over(_by_document())
    return rows.select("doc_id", (at - 1).alias("block_idx"), F.col("line").alias("text"), "page", level.alias("heading_level"), (F.size("cells") > 0).alias("is_table"), "cells")


def _by_document():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy("idx", "k")

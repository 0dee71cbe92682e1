"""Readers of document files, on files made here."""

import base64
import io
import zipfile

from pyspark.sql import functions as F

from strataloom.operators import levels, response, sections
from strataloom.sources import documents

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {NS}><w:style w:styleId="h2"><w:name w:val="Heading 2"/></w:style></w:styles>')
    return out.getvalue()


def para(text: str, style: str = "") -> str:
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def cell(text: str) -> str:
    return f"<w:tc>{para(text)}</w:tc>"


MHTML = (
    "MIME-Version: 1.0\r\nContent-Type: multipart/related;\r\n boundary=\"b\"\r\n\r\n--b\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"
    + base64.b64encode("<style>x{}</style><script>var a='<p>';</script><h2>标题</h2><p>一行<br>二行</p>".encode()).decode()
    + "\r\n--b--\r\n"
).encode()

FILES = {
    "word": docx(para("１．２ 总则") + para("样式标题", "h2") + para("正文﻿") + f"<w:tbl><w:tr>{cell('级别')}{cell('条件')}</w:tr><w:tr>{cell('一级')}{cell('特别重大')}</w:tr></w:tbl>" + f"<w:tbl><w:tr>{cell('布局表')}</w:tr></w:tbl>"),
    "mht": MHTML,
    "pdf": b"%PDF-1.7 two pages",
    "fake": b"plain text named .pdf",
    "broken": b"PK\x03\x04 not a zip",
    "empty": b"",
}


def blocks_of(spark, **plug):
    raw = documents.decode_files(spark.createDataFrame(list(FILES.items()), "doc_id string, content binary"), **plug)
    rows = documents.blocks(raw).orderBy("doc_id", "block_idx").collect()
    errors = {r["doc_id"]: r["error_code"] for r in raw.where("error_code is not null").collect()}
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append((r["text"], r["heading_level"], r["is_table"]))
    return out, errors


def test_word_html_and_errors(spark):
    found, errors = blocks_of(spark)
    assert found["word"] == [("1.2 总则", 2, False), ("样式标题", 2, False), ("正文", 0, False), ("级别 条件", 0, True), ("一级 特别重大", 0, True), ("布局表", 0, False)]
    assert found["mht"] == [("标题", 2, False), ("一行", 0, False), ("二行", 0, False)]
    assert errors == {"pdf": "UNSUPPORTED_DOCUMENT_TYPE", "fake": "UNSUPPORTED_DOCUMENT_TYPE", "broken": "UNSUPPORTED_DOCUMENT_TYPE", "empty": "EMPTY_FILE"}


def test_pages_come_from_a_plugged_reader(spark):
    found, errors = blocks_of(spark, pdf_pages=lambda content: ["第一章 总则\n正文", "第二页"])
    assert found["pdf"] == [("第一章 总则", 1, False), ("正文", 0, False), ("第二页", 0, False)]
    assert "pdf" not in errors


def test_levels_of_a_document(spark):
    texts = ["1 总则", "一级响应", "启动条件", "发生特别重大事故", "响应措施", "组织开展救援", "二级响应", "预计达到橙色标准", "后期处置", "总结评估"]
    blocks = spark.createDataFrame([(1, k, t, 1, 2 if t in ("一级响应", "二级响应", "后期处置") else 0, False) for k, t in enumerate(texts)], "doc_id long, block_idx int, text string, page int, heading_level int, is_table boolean")
    rows = response.segments(blocks, ["后期处置"]).where("category = 'EMERGENCY'")
    got = {r["key"]: (r["conditions"], r["measures"], r["status"]) for r in rows.collect()}
    assert got == {"level_1": ("启动条件\n发生特别重大事故", "组织开展救援", "EXTRACTED"), "level_2": (None, "预计达到橙色标准", "PARTIAL"), "level_3": (None, None, "MISSING"), "level_4": (None, None, "MISSING")}


def test_groups_merge_by_name(spark):
    texts = [(0, 4, "综合协调组：由应急局牵头，主要负责信息汇总。"), (1, 9, "指挥部下设抢险救援、医疗救护等工作组"), (2, 9, "综合协调组：负责对外联络。")]
    rows = spark.createDataFrame([(1, i, p, t) for i, p, t in texts], "doc_id long, block_idx int, page int, text string")
    got = {r["name"]: r for r in levels.action_groups(rows).collect()}
    assert set(got) == {"综合协调组", "抢险救援组", "医疗救护组", "医疗救护等工作组"}
    assert got["综合协调组"]["pages"] == "4,9" and len(got["综合协调组"]["group_key"]) == 29


def test_empty_tables(spark):
    blocks = spark.createDataFrame([], "doc_id long, block_idx int, text string, page int, heading_level int, is_table boolean")
    assert sections.nearest_heading(blocks).count() == 0
    assert levels.action_groups(blocks).count() == 0 and response.segments(blocks, []).count() == 0


def test_field_extraction_of_nothing(spark):
    from strataloom.operators import layout

    lines = spark.createDataFrame([], "image_id long, line_idx int, text string, confidence double, x_min double, y_min double, x_max double, y_max double")
    labels = spark.createDataFrame([("a", 0, "b")], "field string, label_order int, label string")
    assert layout.label_hits(lines, labels).select(F.count("*")).first()[0] == 0

"""Queries over text functions, blocks and document sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Pattern
from ..functions import html, text as T
from ..operators import intake
from .register import Register, table

REGISTER = Register()
query = REGISTER.query

LINES = Pattern(
    "id long, page int, line string",
    [
        (1, 1, "１．２　总则"), (2, 1, "l.2 概述"), (3, 1, "第一章 总则"), (4, 1, "一、编制目的 ◇"), (5, 1, "1.2.3 适用范围 ◇"), (6, 1, "2 组织指挥体系"),
        (7, 1, "目录"), (8, 1, "总则◇........3"), (9, 2, "附则 12"), (10, 9, "附则 12"), (11, 1, "应急响应流程图"), (12, 1, "普通正文，没有编号，◇。"),
        (13, 1, "发生◇重大事故时，启动二级应急响应"), (14, 1, "预计达到红色标准"), (15, 1, "组织开展◇救援，发生险情"), (16, 1, "响应终止"), (17, 1, "结束后评估"),
        (18, 1, "响应分为Ⅰ级响应、Ⅱ级响应"), (19, 1, "响应措施："), (20, 1, "启动条件"), (21, 1, "视情调整为三级"), (22, 1, " \t "), (23, 1, None),
        (24, 1, "出现下列情况之一时，启动一级响应：死亡三十人以上"), (25, 1, "应急反应（Ⅳ级）"), (26, 1, "1.1.1.1.1.1 深层标题"), (27, 1, "I.3 读错的编号"),
    ],
)

_CLEAN = r"""CASE WHEN regexp_matches(c0, '^[0-9lLI]+(?:\.[0-9lLI]+)+')
  THEN translate(regexp_extract(c0, '^[0-9lLI]+(?:\.[0-9lLI]+)+'), 'lLI', '111') || regexp_replace(c0, '^[0-9lLI]+(?:\.[0-9lLI]+)+', '') ELSE c0 END"""


def _sql_clean(column: str, source: str, keep: str) -> str:
    return rf"""(SELECT {keep}, {_CLEAN} AS c FROM (SELECT *, regexp_replace(regexp_replace(
      replace(replace(translate(coalesce({column}, ''), '０１２３４５６７８９．', '0123456789.'), chr(160), ' '), chr(65279), ''), '[\t\n\x0B\f\r ]+', ' ', 'g'),
      '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS c0 FROM {source}))"""


def _sql_normalize(column: str) -> str:
    x = f"translate(coalesce({column}, ''), '０１２３４５６７８９．', '0123456789.')"
    pre = r"'^[0-9]+(?:\.[0-9lLI]+)+'"
    x = f"(CASE WHEN regexp_matches({x}, {pre}) THEN translate(regexp_extract({x}, {pre}), 'lL', '11') || regexp_replace({x}, {pre}, '') ELSE {x} END)"
    for old, new in (("应急反应", "应急响应"), ("反应行动", "响应行动"), ("反应措施", "响应措施"), ("反应程序", "响应程序")):
        x = f"replace({x}, '{old}', '{new}')"
    x = rf"regexp_replace({x}, '[\t\n\x0B\f\r 　:：；;（）()\[\]【】]', '', 'g')"
    for old, new in (("Ｉ", "I"), ("Ⅰ", "I"), ("Ⅱ", "II"), ("Ⅲ", "III"), ("Ⅳ", "IV")):
        x = f"replace({x}, '{old}', '{new}')"
    return f"upper({x})"


@query(_sql_clean("line", LINES.sql(), "id"))
def text_clean(spark, sf_dir):
    return LINES.frame(spark, sf_dir).select("id", T.clean(F.col("line")).alias("c"))


@query(f"SELECT id, {_sql_normalize('line')} AS norm FROM {LINES.sql()}")
def text_normalize(spark, sf_dir):
    return LINES.frame(spark, sf_dir).select("id", T.normalize(F.col("line")).alias("norm"))


@query(rf"SELECT id, regexp_replace(coalesce(line, ''), '[\s　:：]', '', 'g') AS field_form, lower(regexp_replace(coalesce(line, ''), '\s+', '', 'g')) AS trace_form FROM {LINES.sql()}")
def text_normalize_variants(spark, sf_dir):
    return LINES.frame(spark, sf_dir).select("id", T.normalize_field(F.col("line")).alias("field_form"), T.normalize_trace(F.col("line")).alias("trace_form"))


@query(
    rf"""SELECT id, CAST(CASE WHEN c = '' OR length(c) > 80 THEN 0
      WHEN regexp_matches(c, '^第[〇零一二三四五六七八九十百千万0-9]+[章节篇条].{{0,80}}$') THEN 1
      WHEN regexp_matches(c, '^\d+(\.\d+){{1,5}}([、.\s　]+|\p{{Han}}).{{0,80}}$') THEN least(6, 1 + length(regexp_extract(c, '^\d+(\.\d+){{1,5}}')) - length(replace(regexp_extract(c, '^\d+(\.\d+){{1,5}}'), '.', '')))
      WHEN regexp_matches(c, '^\d+[、.\s　]+.{{0,80}}$') THEN 1
      WHEN regexp_matches(c, '^[〇零一二三四五六七八九十百千万]+[、.].{{0,80}}$') THEN 2 ELSE 0 END AS INTEGER) AS level
    FROM {_sql_clean("line", LINES.sql(), "id")}"""
)
def heading_infer(spark, sf_dir):
    return LINES.frame(spark, sf_dir).select("id", T.heading_level(F.col("line")).alias("level"))


@query(
    rf"""SELECT id, n LIKE '%目录%' OR regexp_matches(line, '\.{{3,}}\d*$') OR (regexp_matches(line, '.+\s+\d{{1,3}}$') AND page <= 3) AS is_toc,
      regexp_matches(n, '流程图|示意图|框架图|组织图') AS is_diagram, regexp_matches(n, '响应(结束|终止|调整|解除)|^(结束|终止)') AS is_lifecycle
    FROM (SELECT *, {_sql_normalize("line")} AS n FROM {LINES.sql()}) WHERE line IS NOT NULL"""
)
def line_filters(spark, sf_dir):
    c = F.col("line")
    return LINES.frame(spark, sf_dir).where("line is not null").select("id", T.is_contents(c, F.col("page")).alias("is_toc"), T.is_diagram(c).alias("is_diagram"), T.is_lifecycle(c).alias("is_lifecycle"))


_TRIGGER, _VERBS = T.TRIGGER_WORDS, T.ACTION_VERBS


@query(
    rf"""SELECT id, regexp_matches(line, '{_TRIGGER}') AND NOT regexp_matches(line, '{_VERBS}') AS is_condition,
      regexp_matches(line, '{_TRIGGER}') AND regexp_matches(line, '(启动|实施|进入|发布).{{0,30}}(响应|预警)') AS is_activation,
      regexp_matches(n, '^(出现|符合|达到).{{0,30}}(情况|情形|条件|标准).{{0,20}}(时|之一).{{0,20}}(启动|实施|进入).{{0,20}}(响应|预警).{{2,}}$') AS is_definition,
      NOT (regexp_matches(n, '{_TRIGGER}') AND regexp_matches(n, '(启动|实施|进入|发布).{{0,30}}(响应|预警)'))
        AND len(regexp_extract_all(n, '(IV|III|II|I|[一二三四1-4])级(应急)?响应')) >= 2 AND regexp_matches(n, '{T.OVERVIEW_PHRASES}') AS is_overview,
      regexp_matches(line, '{T.RESPONSE_ACTIONS}') AS is_action, regexp_matches(n, '{T.ADJUSTMENTS}|视情') AS is_adjustment,
      regexp_matches(n, '^((启动|响应|发布)?条件|响应措施|应急措施|处置措施|协调措施)$') AS is_marker
    FROM (SELECT *, {_sql_normalize("line")} AS n FROM {LINES.sql()}) WHERE line IS NOT NULL"""
)
def line_roles(spark, sf_dir):
    c = F.col("line")
    roles = {"is_condition": T.is_condition, "is_activation": T.is_activation, "is_definition": T.is_direct_definition, "is_overview": T.is_overview, "is_action": T.is_action, "is_adjustment": T.is_adjustment, "is_marker": T.is_standalone_marker}
    return LINES.frame(spark, sf_dir).where("line is not null").select("id", *[f(c).alias(n) for n, f in roles.items()])


@query(
    rf"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS block_idx, c AS text FROM
      {_sql_clean("line", "(SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, regexp_split_to_array(translate(text, chr(11) || chr(12), chr(10) || chr(10)), '[\\r\\n]+') AS l FROM documents))", "doc_id, pos")}
      WHERE c <> ''"""
)
def block_split(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.split_lines(F.col("text"))).alias("block_idx", "text"))
    return lines.select("doc_id", F.col("block_idx").cast("bigint").alias("block_idx"), "text")


def _sql_lines(mark: bool) -> str:
    x = r"regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g')"
    x = rf"regexp_replace({x}, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', '', 'g')"
    x = rf"regexp_replace({x}, '[\r\n\t]+', ' ', 'g')"
    if mark:
        x = rf"regexp_replace({x}, '(?is)<h([1-6])(\s[^>]*)?>', chr(10) || '\1' || chr(9), 'g')"
    x = rf"regexp_replace({x}, '(?is)</?({html.LINE_ELEMENTS})(\s[^>]*)?/?>', chr(10), 'g')"
    x = rf"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')"
    for old, new in html.REFERENCES:
        x = f"replace({x}, '{old}', '{new}')"
    return f"(SELECT page_id, unnest(range(len(l))) AS pos, trim(regexp_replace(unnest(l), ' +', ' ', 'g')) AS line FROM (SELECT page_id, string_split({x}, chr(10)) AS l FROM pages))"


SQL_BLOCKS = rf"""(SELECT page_id AS doc_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS block_idx, trim(regexp_replace(line, '^[1-6]\t', '')) AS text,
   CAST(CASE WHEN regexp_matches(line, '^[1-6]\t') THEN substr(line, 1, 1) ELSE '0' END AS INTEGER) AS heading_level, line LIKE '%|%' AS is_table
   FROM {_sql_lines(True)} WHERE line <> '' AND NOT regexp_matches(line, '^[1-6]\t?$'))"""


@query(f"SELECT * FROM {SQL_BLOCKS}")
def html_blocks(spark, sf_dir):
    return html.html_blocks(table(spark, sf_dir, "pages")).select("doc_id", "block_idx", "text", "heading_level", "is_table")


@query(f"SELECT doc_id, count(*) AS n_cells, min(len(list_filter(list_transform(string_split(text, '|'), lambda x: trim(x)), lambda x: x <> ''))) AS fewest FROM {SQL_BLOCKS} WHERE is_table GROUP BY doc_id")
def table_cells(spark, sf_dir):
    return html.html_blocks(table(spark, sf_dir, "pages")).where("is_table").groupBy("doc_id").agg(F.count("*").alias("n_cells"), F.min(F.size("cells")).cast("bigint").alias("fewest"))


@query(
    f"""SELECT doc_id, block_idx FROM (SELECT *, max(CASE WHEN lower(text) LIKE '%the%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING) AS seen FROM {SQL_BLOCKS})
    WHERE seen = 0 OR is_table"""
)
def flowchart_suppression(spark, sf_dir):
    """Body blocks after the first marked one of a page run are left out; the shipped pages have no charts, so a common word marks."""
    blocks = html.html_blocks(table(spark, sf_dir, "pages"))
    return intake.drop_after_mark(blocks, F.lower("text").contains("the")).select("doc_id", "block_idx")


FILES = Pattern(
    "path string, head string, entries string",
    [
        ("a.pdf", "%PDF-1.7", None), ("fake.pdf", "plain text", None), ("real.bin", "%PDF-1.4 x", None), ("w.docx", "PK", "[Content_Types].xml word/document.xml"), ("z.zip", "PK", "a.txt"),
        ("m.doc", "MIME-Version: 1.0\nContent-Type: multipart/related; boundary=x", None), ("empty", "", None),
    ],
)


@query(
    f"""SELECT path, CASE WHEN head LIKE '%PDF%' AND head LIKE '\\%PDF%' ESCAPE '\\' THEN 'PDF'
      WHEN starts_with(head, 'PK') AND entries LIKE '%[Content_Types].xml%' AND entries LIKE '%word/document.xml%' THEN 'DOCX'
      WHEN lower(head) LIKE '%mime-version:%' OR lower(head) LIKE '%content-type: multipart/related%' THEN 'MHTML' ELSE 'UNSUPPORTED_DOCUMENT_TYPE' END AS kind FROM {FILES.sql()}"""
)
def file_sniff(spark, sf_dir):
    return FILES.frame(spark, sf_dir).select("path", intake.sniff(F.col("head").cast("binary"), F.col("entries")).alias("kind"))


URLS = Pattern(
    "url string",
    [("http://docs.example.com/◇/b%20c.pdf?x=1",), ("https://files.example.org:8443/x.docx",), ("ftp://docs.example.com/a",), ("http://user@docs.example.com/a",), ("https://docs.example.com.evil.net/a",), ("https://sub.files.example.org/q/",), ("not a url",)],
)


@query(
    rf"""SELECT url, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'INVALID_DOCUMENT_URL' WHEN regexp_matches(url, '^https?://[^/]*@') THEN 'INVALID_DOCUMENT_URL'
      WHEN port NOT IN ('', '80', '443') THEN 'DOCUMENT_TARGET_BLOCKED' WHEN host = 'docs.example.com' OR host LIKE '%.files.example.org' THEN 'OK' ELSE 'DOCUMENT_TARGET_BLOCKED' END AS verdict,
      replace(regexp_extract(url, '^https?://[^/]+/(?:[^?#]*/)?([^/?#]*)', 1), '%20', ' ') AS file_name
    FROM (SELECT url, lower(regexp_extract(url, '^https?://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/:]+:(\d+)', 1) AS port FROM {URLS.sql()})"""
)
def url_safety(spark, sf_dir):
    c = F.col("url")
    return URLS.frame(spark, sf_dir).select("url", intake.url_verdict(c, ["docs.example.com", "*.files.example.org"], [80, 443]).alias("verdict"), intake.url_file_name(c).alias("file_name"))


ADDRESSES = Pattern("ip string", keys=(), rows=[(x,) for x in ("127.0.0.◆", "10.◆.2.3", "172.16.0.9", "172.◆.0.1", "192.168.1.1", "169.254.169.254", "100.◆.0.1", "0.0.0.0", "224.0.0.1", "◆.8.8.8", "198.18.0.5", "203.0.114.1", "255.255.255.255", "::1", "::", "0:0:0:0:0:0:0:1", "1::", "fe80::◆", "febf::2", "fec0::1", "fc00::1", "fdff:1::2", "ff02::1", "2001:db8::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8")])


@query(
    f"""SELECT ip, CASE WHEN contains(p, ':') THEN regexp_matches(p, '^[0:]*:0*1?$') OR (h & 65024) = 64512 OR (h & 65472) IN (65152, 65216) OR (h & 65280) = 65280
      ELSE a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) END AS blocked
    FROM (SELECT ip, p, coalesce(TRY_CAST('0x' || nullif(split_part(p, ':', 1), '') AS INT), 0) AS h, TRY_CAST(split_part(p, '.', 1) AS INT) AS a, TRY_CAST(split_part(p, '.', 2) AS INT) AS b
      FROM (SELECT ip, regexp_replace(ip, '^::ffff:([0-9]+[.])', '\\1') AS p FROM {ADDRESSES.sql()}))"""
)
def ip_blocked(spark, sf_dir):
    return ADDRESSES.frame(spark, sf_dir).select("ip", intake.ip_blocked(F.col("ip")).alias("blocked"))


@query(
    """SELECT doc_id, page, CASE WHEN n_chars >= 80 THEN 'PDF_TEXT' ELSE 'OCR' END AS page_mode,
      CASE WHEN min(n_chars >= 80) OVER (PARTITION BY doc_id) THEN 'PDF_TEXT' WHEN max(n_chars >= 80) OVER (PARTITION BY doc_id) THEN 'HYBRID' ELSE 'OCR' END AS parse_mode
    FROM (SELECT conv_id AS doc_id, turn AS page, CAST(sum(length(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+', '', 'g'))) AS BIGINT) AS n_chars FROM conversations GROUP BY ALL)"""
)
def page_modes(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return intake.page_modes(pages)


@query("SELECT doc_id, length(text) > 20000 AS too_large, regexp_replace(source || '/' || lang || '?', '[\\\\/:*?\"<>|]', '_', 'g') AS file_name FROM documents")
def upload_checks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", (F.length("text") > 20000).alias("too_large"), intake.safe_name(F.concat("source", F.lit("/"), "lang", F.lit("?"))).alias("file_name"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\":\\s*(-?\\d+)', 1) AS BIGINT) AS k FROM events")
def json_props_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))

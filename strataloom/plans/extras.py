"""Queries over choices between sources and over shapes of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Pattern
from ..functions.html import html_blocks
from ..operators import extras as X
from .blocks import SQL_BLOCKS, _sql_normalize
from .register import Register, table

REGISTER = Register()
query = REGISTER.query

PRIMARY = Pattern("image_id long, text string, confidence double, failed boolean", [(1, "good ◇", 0.9, False), (2, "weak", 0.4, False), (3, " ", 0.9, False), (4, None, None, True), (5, "weak", 0.2, False)])
BACKUP = Pattern("image_id long, text string", [(1, "b1"), (2, "b2 ◇"), (3, "b3"), (4, "b4")])


@query(
    f"""SELECT image_id, CASE WHEN w AND b IS NOT NULL THEN b ELSE p END AS text, CASE WHEN w AND b IS NOT NULL THEN 'backup' ELSE 'primary' END AS engine FROM (
      SELECT p.image_id, p.text AS p, q.text AS b, failed OR trim(coalesce(p.text, '')) = '' OR coalesce(confidence, 0) < 0.55 AS w FROM {PRIMARY.sql()} p LEFT JOIN {BACKUP.sql()} q USING (image_id))"""
)
def engine_fallback(spark, sf_dir):
    return X.engine_choice(PRIMARY.frame(spark, sf_dir), BACKUP.frame(spark, sf_dir))


@query("SELECT user_id AS batch_id, count(*) AS total, count(*) FILTER (WHERE value >= 1) AS succeeded, count(*) FILTER (WHERE value < 1 OR value IS NULL) AS failed FROM events GROUP BY user_id")
def batch_isolation(spark, sf_dir):
    items = table(spark, sf_dir, "events").select(F.col("user_id").alias("batch_id"), F.when(F.coalesce(F.col("value"), F.lit(0.0)) < 1, "INVALID_IMAGE").alias("error_code"))
    return X.batch_totals(items)


CONFIDENCES = Pattern("image_id long, confidence double", [(1, 0.5), (1, None), (1, 1.0), (2, None)])


@query(f"SELECT image_id, round(avg(confidence), 6) AS confidence, coalesce(round(avg(confidence), 6), 0.0) AS or_zero FROM {CONFIDENCES.sql()} GROUP BY image_id")
def confidence_avg(spark, sf_dir):
    return X.mean_confidence(CONFIDENCES.frame(spark, sf_dir))


OWN = Pattern("image_id long, value string", [(1, "(苏)WH安许证字[2019]◆号"), (2, "模糊"), (3, None), (4, None)])
AROUND = Pattern("image_id long, line_idx int, text string", [(1, 0, "(浙)AB安许证字[2020]2号"), (2, 0, "标题"), (2, 1, "编号(浙)AB安许证字[2020]2号"), (3, 0, "(皖)安许证"), (3, 1, "字[2021]"), (3, 2, "33号"), (4, 0, "无")])
_LIC = "[（(〔\\[]?[一-龥A-Za-z]{1,4}[）)〕\\]]?[A-Z]{0,4}安[许許午][証证][字学]?[（(〔\\[]?\\d{4}[）)〕\\]]?[A-Za-z0-9-]{1,12}[号號]"


@query(
    f"""SELECT o.image_id, coalesce(nullif(regexp_extract(o.value, '{_LIC}'), ''), a.single, nullif(regexp_extract(a.whole, '{_LIC}'), '')) AS licence FROM {OWN.sql()} o LEFT JOIN (
      SELECT image_id, arg_min(f, line_idx) FILTER (WHERE f IS NOT NULL) AS single, string_agg(text, '' ORDER BY line_idx) AS whole FROM (SELECT *, nullif(regexp_extract(text, '{_LIC}'), '') AS f FROM {AROUND.sql()}) GROUP BY image_id) a USING (image_id)"""
)
def license_ladder(spark, sf_dir):
    return X.licence_ladder(OWN.frame(spark, sf_dir), AROUND.frame(spark, sf_dir))


CATEGORIES = Pattern(
    "doc_id long, block_idx int, heading_level int, text string",
    [(1, 0, 1, "3 预警"), (1, 1, 0, "发布条件"), (1, 2, 0, "红色标准"), (1, 3, 1, "4 应急响应"), (1, 4, 0, "一级"), (1, 5, 0, "预警与应急响应衔接"), (1, 6, 0, "后续"), (1, 7, 2, "其他"), (1, 8, 0, "正文"), (2, 0, 0, "◇预警信息"), (2, 1, 0, "应急响应启动"), (2, 2, 0, "甲"), (3, 0, 0, "无关")],
)


@query(
    f"""WITH t AS (SELECT *, contains(n, '预警') AS warn, regexp_matches(n, '应急响应|应急反应|响应行动|反应行动') AS act FROM (SELECT *, {_sql_normalize("text")} AS n FROM {CATEGORIES.sql()})),
      w AS (SELECT *, list({{'i': block_idx, 'h': heading_level, 'w': warn, 'a': act}}) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS seen FROM t),
      s AS (SELECT *, coalesce(list_max(list_transform(list_filter(seen, lambda x: ((x.w OR x.a) AND (x.h > 0 OR x.i = block_idx)) OR (x.i < block_idx AND x.h BETWEEN 1 AND 2)), lambda x: x.i)), -1) AS stop FROM w)
    SELECT doc_id, block_idx, list_filter(list_transform(list_filter(seen, lambda x: x.i >= stop), lambda x: CASE WHEN x.w AND (x.h > 0 OR x.i = block_idx OR NOT x.a) THEN 'WARNING' WHEN x.a THEN 'EMERGENCY' END), lambda v: v IS NOT NULL)[1] AS nearest FROM s"""
)
def category_context(spark, sf_dir):
    return X.category(CATEGORIES.frame(spark, sf_dir)).select("doc_id", "block_idx", "nearest")


@query(f"SELECT doc_id, 'k' || (doc_id % 4) AS level_key, CAST(doc_id % 3 + 1 AS VARCHAR) || CASE WHEN doc_id % 3 + 1 <> 2 THEN ',2' ELSE '' END AS pages FROM (SELECT DISTINCT doc_id FROM {SQL_BLOCKS}) WHERE doc_id % 2 = 0")
def response_shape(spark, sf_dir):
    docs = html_blocks(table(spark, sf_dir, "pages")).select("doc_id").distinct()
    levels = docs.select("doc_id", F.concat(F.lit("k"), F.col("doc_id") % 4).alias("level_key"), F.lit("EMERGENCY").alias("category"), F.when(F.col("doc_id") % 2 == 0, "EXTRACTED").otherwise("MISSING").alias("status"), F.array(F.col("doc_id") % 3 + 1).alias("condition_pages"), F.array(F.lit(2).cast("bigint")).alias("measure_pages"))
    return X.legacy_levels(levels)


@query("SELECT o_orderkey AS sample_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders")
def active_first_order(spark, sf_dir):
    samples = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("sample_id"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("ARCHIVED").alias("status"), F.col("o_orderdate").alias("created_at"))
    return X.active_first(samples).select("sample_id", "place")


HEADERS = Pattern("id long, header string", [(1, 'attachment; filename="a ◇.pdf"'), (2, "attachment; filename*=UTF-8''x%20y.docx; filename=z"), (3, "inline"), (4, "attachment; filename=plain.doc")])


@query(f"SELECT id, coalesce(nullif(replace(regexp_extract(header, '(?i)filename\\*=(?:UTF-8'''')?\"?([^\";]+)', 1), '%20', ' '), ''), nullif(regexp_extract(header, '(?i)filename=\"?([^\";]+)', 1), '')) AS name FROM {HEADERS.sql()}")
def disposition_name(spark, sf_dir):
    return HEADERS.frame(spark, sf_dir).select("id", X.disposition_name(F.col("header")).alias("name"))


TABLES = Pattern(
    "table_id long, row int, column int, text string",
    [(1, 0, 0, "a"), (1, 1, 0, "b"), (2, 0, 0, "a"), (2, 0, 1, "b\n◇\nd"), (3, 0, 0, "x" * 120), (3, 0, 1, "y"), (4, 0, 0, "a\n \nb"), (5, 0, 0, "a\n\n"), (6, 0, 0, "a"), (6, 1, 0, "b\nc"), (7, 0, 0, None)],
)


@query(
    """SELECT table_id, (max("column") <= 0 AND sum(n) >= 3) OR (count(*) = 1 AND sum(n) >= 2) AS is_layout FROM (SELECT *, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS n FROM """
    + TABLES.sql().replace("v(table_id, row, column, text)", 'v(table_id, "row", "column", text)')
    + ") GROUP BY table_id"
)
def layout_tables(spark, sf_dir):
    return X.layout_table(TABLES.frame(spark, sf_dir))


CODES = Pattern("code string", [("◇_NOT_FOUND",), ("FILE_TOO_LARGE",), ("UNSUPPORTED_◇",), ("EMPTY_◇",), ("DOCUMENT_TOO_LARGE",)], of="events", keys=())


@query(f"SELECT code, CASE WHEN ends_with(code, '_NOT_FOUND') THEN 404 WHEN code LIKE '%TOO_LARGE' THEN 413 WHEN code LIKE 'UNSUPPORTED%' THEN 415 ELSE 400 END AS status FROM {CODES.sql()}")
def error_statuses(spark, sf_dir):
    codes = CODES.frame(spark, sf_dir)
    body = X.error_body(F.col("code"), F.lit("/x"), F.lit("t"))
    return codes.select("code", F.get_json_object(body, "$.status").cast("int").alias("status"))

"""Queries over positioned lines and certificate texts, on inline rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Fixture, Pattern
from ..operators import layout as L
from .register import Register

REGISTER = Register()
query = REGISTER.query

LINES = Pattern(
    "image_id long, line_idx int, text string, confidence double, x_min double, y_min double, x_max double, y_max double",
    [
        (1, 0, "企业名称：", 0.95, 100.0, 100.0, 220.0, 130.0), (1, 1, "某某化工◇", 0.9, 230.0, 102.0, 400.0, 131.0), (1, 2, "有限公", 0.7, 410.0, 99.0, 520.0, 129.0), (1, 3, "印章", 0.5, 900.0, 101.0, 960.0, 130.0),
        (1, 4, "有效期：2020年1月2日", 0.92, 100.0, 200.0, 420.0, 230.0), (1, 5, "至2023年1月1日", 0.88, 430.0, 203.0, 700.0, 232.0), (1, 6, "许可范围", 0.9, 100.0, 300.0, 220.0, 330.0), (1, 7, "甲醇", 0.6, 110.0, 345.0, 200.0, 370.0), (1, 8, "乙醇", 0.8, 110.0, 380.0, 200.0, 405.0), (1, 9, "远处", 0.8, 110.0, 490.0, 200.0, 730.0),
        (2, 0, "◇公司", 0.99, 300.0, 50.0, 400.0, 80.0), (2, 1, "企业名称", 0.99, 100.0, 50.0, 220.0, 80.0), (2, 2, "有效期", 0.9, 405.0, 52.0, 500.0, 81.0), (2, 3, None, None, None, None, None, None),
    ],
)
LABELS = Fixture("field string, label_order int, label string", [("name", 0, "单位名称"), ("name", 1, "企业名称"), ("period", 0, "有效期"), ("scope", 0, "许可范围")])
STOPS = Fixture("field string, stop string", [("name", "有效期"), ("name", "许可范围"), ("period", "许可范围")])

_NORM = "regexp_replace(coalesce({0}, ''), '[\\s　:：]', '', 'g')"
_ORDERED = f"(SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y_min NULLS LAST, x_min NULLS LAST, line_idx) - 1 AS pos FROM {LINES.sql()})"
_HITS = f"""(SELECT * FROM (SELECT l.*, field, label, substr({_NORM.format("text")}, instr({_NORM.format("text")}, label) + length(label)) AS inline, row_number() OVER (PARTITION BY image_id, field ORDER BY pos, label_order) AS k
    FROM {_ORDERED} l JOIN {LABELS.sql()} b ON contains({_NORM.format("text")}, label)) WHERE k = 1)"""


@query(f"SELECT image_id, line_idx, CAST(pos AS INTEGER) AS pos FROM {_ORDERED}")
def ocr_reading_order(spark, sf_dir):
    return L.reading_order(LINES.frame(spark, sf_dir)).select("image_id", "line_idx", "pos")


@query(f"SELECT image_id, field, line_idx, label, inline FROM {_HITS}")
def label_hit(spark, sf_dir):
    return L.label_hits(LINES.frame(spark, sf_dir), LABELS.frame(spark)).select("image_id", "field", "line_idx", "label", "inline")


@query(
    f"""SELECT image_id, field, regexp_replace(regexp_replace(inline || string_agg(text2, '' ORDER BY x2, line2), '\\s+', '', 'g'), '^[:：]+', '') AS value, round(avg(conf), 6) AS confidence FROM (
      SELECT *, sum(CASE WHEN ends OR x2 - edge > 320 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, field ORDER BY x2, line2) AS broken FROM (
        SELECT h.image_id, h.field, h.inline, o.line_idx AS line2, o.text AS text2, o.confidence AS conf, o.x_min AS x2, EXISTS (SELECT 1 FROM {STOPS.sql()} s WHERE s.field = h.field AND starts_with(regexp_replace(o.text, '[ :：]', '', 'g'), s.stop)) AS ends,
          coalesce(max(o.x_max) OVER (PARTITION BY h.image_id, h.field ORDER BY o.x_min, o.line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), h.x_max) AS edge
        FROM {_HITS} h JOIN {LINES.sql()} o ON o.image_id = h.image_id AND o.line_idx <> h.line_idx AND abs((h.y_min + h.y_max) / 2 - (o.y_min + o.y_max) / 2) <= 0.75 * greatest(h.y_max - h.y_min, o.y_max - o.y_min, 1) AND o.x_min >= h.x_max - 20))
    WHERE broken = 0 GROUP BY image_id, field, inline"""
)
def collect_right(spark, sf_dir):
    lines = LINES.frame(spark, sf_dir)
    return L.collect_right(L.label_hits(lines, LABELS.frame(spark)), lines, STOPS.frame(spark))


@query(
    f"""SELECT image_id, field, string_agg(text2, '' ORDER BY top2, left2, line2) AS value FROM (
      SELECT *, sum(CASE WHEN ends OR top2 - edge > greatest(2.5 * height, 80) THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, field ORDER BY top2, left2, line2) AS broken FROM (
        SELECT h.image_id, h.field, h.y_max - h.y_min AS height, o.line_idx AS line2, o.text AS text2, o.y_min AS top2, o.x_min AS left2, EXISTS (SELECT 1 FROM {LABELS.sql()} s WHERE contains({_NORM.format("o.text")}, s.label)) AS ends,
          greatest(h.y_max, coalesce(max(o.y_max) OVER (PARTITION BY h.image_id, h.field ORDER BY o.y_min, o.x_min, o.line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), h.y_max)) AS edge
        FROM {_HITS} h JOIN {LINES.sql()} o ON o.image_id = h.image_id AND o.line_idx <> h.line_idx AND o.y_min > h.y_min)) WHERE broken = 0 GROUP BY image_id, field"""
)
def collect_below(spark, sf_dir):
    lines = LINES.frame(spark, sf_dir)
    return L.collect_below(L.label_hits(lines, LABELS.frame(spark)), lines, LABELS.frame(spark))


VALUES = Pattern(
    "id long, value string, confidence double, pattern string, least double",
    [(1, None, 0.9, None, 0.8), (2, "  ", 0.9, None, 0.8), (3, "◆a", 0.9, "\\d+", 0.8), (4, "◆", 0.7, "\\d+", 0.8), (5, "123", None, "\\d+", 0.8), (6, "123", 0.9, "\\d+", 0.8), (7, "x", 0.8, None, 0.8)],
)


@query(f"SELECT id, CASE WHEN trim(coalesce(value, '')) = '' THEN 'MISSING' WHEN pattern IS NOT NULL AND NOT regexp_full_match(value, pattern) THEN 'INVALID' WHEN confidence IS NULL OR confidence < least THEN 'LOW_CONFIDENCE' ELSE 'EXTRACTED' END AS status FROM {VALUES.sql()}")
def field_status(spark, sf_dir):
    return VALUES.frame(spark, sf_dir).select("id", L.field_status(F.col("value"), F.col("confidence"), F.col("pattern"), F.col("least")).alias("status"))


CERTIFICATES = Pattern(
    "id long, value string",
    [(1, "20201月2日至2023年12月31日"), (2, "2020年1月2日至2023年1月1日"), (3, "2020年第2月3日"), (4, "无日期"), (5, "(苏)WH安许证字[2019]1234号 其他"), (6, "编号 粤 A 安 许 证 字 2020-77号"), (7, "某某◇化工有限公许可范围甲醇"), (8, "乙有限公")],
)
_REPAIR = "CASE WHEN value LIKE '%月%' AND value LIKE '%日%' THEN regexp_replace(regexp_replace(regexp_replace(replace(value, '第2', '02'), '(\\d{4})(\\d{1,2}月)', '\\1年\\2', 'g'), '年(\\d月)', '年0\\1', 'g'), '月(\\d日)', '月0\\1', 'g') ELSE value END"


@query(
    f"""SELECT id, r AS repaired, CASE WHEN len(d) >= 2 THEN d[1] || '至' || d[2] ELSE r END AS period FROM (SELECT id, r, list_transform(regexp_extract_all(r, '\\d{{4}}年\\d{{1,2}}月\\d{{1,2}}日'), lambda x: regexp_replace(regexp_replace(x, '年(\\d月)', '年0\\1'), '月(\\d日)', '月0\\1')) AS d FROM (SELECT id, {_REPAIR} AS r FROM {CERTIFICATES.sql()}))"""
)
def date_repair(spark, sf_dir):
    c = F.col("value")
    return CERTIFICATES.frame(spark, sf_dir).select("id", L.repair_date(c).alias("repaired"), L.date_range(c).alias("period"))


@query(
    f"""SELECT id, nullif(regexp_extract(regexp_replace(value, '\\s+', '', 'g'), '[（(〔\\[]?[一-龥A-Za-z]{{1,4}}[）)〕\\]]?[A-Z]{{0,4}}安[许許午][証证][字学]?[（(〔\\[]?\\d{{4}}[）)〕\\]]?[A-Za-z0-9-]{{1,12}}[号號]'), '') AS licence,
      replace(regexp_replace(value, '(许可范围|可范围|经营范围).*$', ''), '有限公', '有限公司') AS company FROM {CERTIFICATES.sql()}"""
)
def license_number(spark, sf_dir):
    c = F.col("value")
    return CERTIFICATES.frame(spark, sf_dir).select("id", L.licence_number(c).alias("licence"), L.company_name(c).alias("company"))


PASSES = Pattern(
    "image_id long, pass_no int, line_idx int, text string, confidence double",
    [(1, 1, 0, "总则 ◇ 一", 0.9), (1, 1, 1, "目的", 0.8), (1, 2, 0, "总则一", 0.7), (1, 2, 1, "范围", 0.6), (2, 1, 0, "a", 0.4), (2, 2, 0, "应急响应 程序", 0.9), (2, 2, 1, "a", 0.9), (3, 1, 0, "没有置信度的一行文字", None)],
)
_QUALITY = f"(SELECT image_id, pass_no, count(*) AS n_lines, CAST(sum(length(regexp_replace(text, '\\s+', '', 'g'))) AS BIGINT) AS n_chars, round(avg(confidence), 6) AS confidence, CAST(count(*) * 20 + sum(length(regexp_replace(text, '\\s+', '', 'g'))) AS BIGINT) AS score FROM {PASSES.sql()} GROUP BY image_id, pass_no)"


@query(f"SELECT * FROM {_QUALITY}")
def quality_score(spark, sf_dir):
    return L.quality(PASSES.frame(spark, sf_dir))


@query(f"SELECT image_id FROM {_QUALITY} WHERE pass_no = 1 AND (n_chars < 8 OR confidence IS NULL OR confidence < 0.75)")
def second_pass_needed(spark, sf_dir):
    return L.needs_second_pass(L.quality(PASSES.frame(spark, sf_dir)))


@query(
    f"""SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY second, line_idx) - 1 AS INTEGER) AS pos, text, second = 0 AS has_box FROM (
      SELECT *, row_number() OVER (PARTITION BY image_id, regexp_replace(text, '\\s+', '', 'g') ORDER BY second, line_idx) AS k FROM (
        SELECT p.*, CASE WHEN p.pass_no = b.best THEN 0 ELSE 1 END AS second FROM {PASSES.sql()} p JOIN (SELECT image_id, pass_no AS best FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pass_no) AS r FROM {_QUALITY}) WHERE r = 1) b USING (image_id))) WHERE k = 1"""
)
def two_pass_merge(spark, sf_dir):
    return L.merge_passes(PASSES.frame(spark, sf_dir))


ANGLES = Pattern("image_id long, angle double", [(1, 2.0), (1, 3.0), (1, 40.0), (1, 1.0), (1, 5.0), (2, 0.2), (3, 50.0)])


@query(f"SELECT image_id, CASE WHEN n = 0 THEN 0.0 WHEN abs(a[n // 2 + 1]) > 0.3 THEN -a[n // 2 + 1] ELSE 0.0 END AS rotate FROM (SELECT image_id, coalesce(list(angle ORDER BY angle) FILTER (WHERE abs(angle) <= 12), []) AS a, count(*) FILTER (WHERE abs(angle) <= 12) AS n FROM {ANGLES.sql()} GROUP BY image_id)")
def deskew_median(spark, sf_dir):
    return L.median_angle(ANGLES.frame(spark, sf_dir))


@query(
    f"""SELECT image_id, CAST(row_number() OVER w AS INTEGER) AS "column", coalesce((lag(mid) OVER w + mid) / 2, 0.0) AS left_edge, coalesce((lead(mid) OVER w + mid) / 2, 1000.0) AS right_edge FROM (SELECT *, (x_min + x_max) / 2 AS mid FROM {LINES.sql()} WHERE y_min < 140)
    WINDOW w AS (PARTITION BY image_id ORDER BY x_min, line_idx)"""
)
def sideways_columns(spark, sf_dir):
    return L.column_edges(LINES.frame(spark, sf_dir).where("y_min < 140"), F.lit(1000.0))

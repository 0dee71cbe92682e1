"""Queries over templates and the fields they extract."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Fixture, Pattern
from ..operators import fields as X
from ..operators import templates
from .register import Register

REGISTER = Register()
query = REGISTER.query

_MEMBER = '{"processor":"plain","fields":{"name":{"labels":["姓名","名字"],"stopLabels":["编号"],"mergeWrappedLines":true},"remark":{"labels":["备注"],"direction":"below","maxLines":2,"minConfidence":0.5,"pattern":"^.+$"}}}'
_LICENSE = '{"processor":"safety-license","fields":{"enterpriseName":{"labels":["企业名称"],"stopLabels":["有效期"]}}}'
TEMPLATES = Fixture("id long, template_code string, status string, definition string", [(1, "member", "PUBLISHED", _MEMBER), (4, "trade", "PUBLISHED", _LICENSE)])
REVISIONS = Pattern(
    "id long, template_code string, status string, definition string", of="customer", keys=("id", "template_code"),
    rows=[(1, "member", "PUBLISHED", _MEMBER), (2, "member", "ARCHIVED", _LICENSE), (3, "draft", "DRAFT", _LICENSE), (4, "trade", "PUBLISHED", _LICENSE)],
)
_CONFIG = " UNION ALL ".join(
    f"SELECT 'safety_license', '{f}', '{'|'.join(labels)}', '{'|'.join(stops)}', 'right', {wrapped}, {most}, 0.8, {'NULL' if pattern is None else repr(pattern).replace(chr(92) * 2, chr(92))}" for f, labels, stops, wrapped, most, pattern in templates.SAFETY_LICENSE
)
_FIELDS = "fields.\"' || field || '\""


@query(
    f"""WITH d AS (SELECT template_code, definition, unnest(json_keys(definition, '$.fields')) AS field FROM {REVISIONS.sql()} WHERE status = 'PUBLISHED'),
      f AS (SELECT template_code, field, json_extract(definition, '$.{_FIELDS}') AS f FROM d),
      p AS (SELECT template_code, field, array_to_string(json_extract_string(f, '$.labels[*]'), '|') AS labels, coalesce(array_to_string(json_extract_string(f, '$.stopLabels[*]'), '|'), '') AS stops, coalesce(json_extract_string(f, '$.direction'), 'right') AS direction,
        coalesce(CAST(json_extract_string(f, '$.mergeWrappedLines') AS BOOLEAN), FALSE) AS merge_wrapped, coalesce(CAST(json_extract_string(f, '$.maxLines') AS INT), 0) AS max_lines, coalesce(CAST(json_extract_string(f, '$.minConfidence') AS DOUBLE), 0.8) AS min_confidence, json_extract_string(f, '$.pattern') AS pattern FROM f)
      SELECT * FROM p UNION ALL SELECT * FROM ({_CONFIG}) AS c(template_code, field, labels, stops, direction, merge_wrapped, max_lines, min_confidence, pattern) WHERE template_code NOT IN (SELECT template_code FROM p)"""
)
def template_source(spark, sf_dir):
    found = templates.effective(REVISIONS.frame(spark, sf_dir), templates.configured(spark))
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    return found.select("template_code", "field", joined("labels").alias("labels"), joined("stop_labels").alias("stops"), "direction", "merge_wrapped", "max_lines", "min_confidence", "pattern")


@query(f"SELECT template_code, max(p) AS published FROM (SELECT 'safety_license' AS template_code, FALSE AS p UNION ALL SELECT template_code, TRUE FROM {REVISIONS.sql()} WHERE status = 'PUBLISHED') GROUP BY template_code")
def template_codes(spark, sf_dir):
    return templates.codes(REVISIONS.frame(spark, sf_dir), templates.configured(spark))


DEFINITIONS = Pattern(
    "id long, definition string",
    [
        (1, _MEMBER), (2, "{}"), (3, '{"fields":{}}'), (4, "not json"), (5, '{"fields":{"a":{"labels":[" "],"direction":"LEFT","minConfidence":1.5,"pattern":"[a-"},"b":{"labels":["x"],"direction":"BELOW","minConfidence":0,"pattern":"^x$"}}}'),
        (6, '{"fields":{"c":{"direction":"right","minConfidence":-0.1}}}'), (7, '{"fields":{"d":{"labels":["", "x"],"pattern":"(a"},"e":{"labels":["y"],"pattern":" "}}}'), (8, '["fields"]'),
    ],
)


@query(
    f"""WITH d AS (SELECT id, definition, json_valid(definition) AND starts_with(ltrim(definition), '{{') AS ok FROM {DEFINITIONS.sql()}),
      k AS (SELECT id, definition, unnest(json_keys(definition, '$.fields')) AS field FROM d WHERE ok),
      f AS (SELECT id, field, json_extract(definition, '$.{_FIELDS}') AS f FROM k),
      e AS (SELECT id, field || ':LABELS' AS error FROM f WHERE len(list_filter(coalesce(json_extract_string(f, '$.labels[*]'), []), lambda x: trim(x) <> '')) = 0
        UNION ALL SELECT id, field || ':DIRECTION' FROM f WHERE lower(coalesce(json_extract_string(f, '$.direction'), 'right')) NOT IN ('right', 'below')
        UNION ALL SELECT id, field || ':CONFIDENCE' FROM f WHERE NOT coalesce(CAST(json_extract_string(f, '$.minConfidence') AS DOUBLE), 0.8) BETWEEN 0 AND 1
        UNION ALL SELECT id, field || ':PATTERN' FROM f WHERE trim(coalesce(json_extract_string(f, '$.pattern'), '')) <> '' AND TRY(regexp_matches('', json_extract_string(f, '$.pattern'))) IS NULL)
      SELECT id, CASE WHEN NOT ok THEN 'STRUCTURE' WHEN NOT EXISTS (SELECT 1 FROM k WHERE k.id = d.id) THEN 'FIELDS' ELSE coalesce((SELECT string_agg(error, ',' ORDER BY error) FROM e WHERE e.id = d.id), '') END AS errors FROM d"""
)
def template_validate(spark, sf_dir):
    return templates.validate(DEFINITIONS.frame(spark, sf_dir)).select("id", F.array_join("errors", ",").alias("errors"))


IMAGES = Pattern("image_id long, template_code string", [(1, "safety_license"), (2, "safety_license"), (3, "member"), (4, "trade"), (5, "member")])
LINES = Pattern(
    "image_id long, line_idx int, text string, confidence double, x_min double, y_min double, x_max double, y_max double",
    [
        (1, 0, "企业名称：", 0.95, 100.0, 100.0, 220.0, 130.0), (1, 1, "某某化工◇", 0.9, 230.0, 102.0, 400.0, 131.0), (1, 2, "有限公", 0.7, 240.0, 140.0, 360.0, 169.0), (1, 3, "有效期 2020年1月2日", 0.92, 100.0, 200.0, 420.0, 230.0), (1, 4, "至2023年1月1日 发证机关", 0.88, 430.0, 203.0, 700.0, 232.0),
        (1, 5, "许可范围", 0.9, 100.0, 300.0, 220.0, 330.0), (1, 6, "甲醇、", 0.6, 240.0, 301.0, 400.0, 330.0), (1, 7, "乙醇", 0.8, 250.0, 340.0, 400.0, 365.0), (1, 8, "远处", 0.8, 250.0, 700.0, 300.0, 730.0), (1, 9, "编号：(苏)WH安许证字", 0.9, 600.0, 20.0, 800.0, 50.0), (1, 10, "[2019]1234号", 0.8, 810.0, 22.0, 950.0, 50.0),
        (1, 11, "发证日期", 0.9, 600.0, 800.0, 700.0, 830.0), (1, 12, "2020年第2月3日", 0.9, 710.0, 802.0, 900.0, 830.0), (1, 13, "类型 国有 主要负责人 张三", 0.9, 100.0, 500.0, 600.0, 530.0),
        (2, 0, "编号", 0.9, 100.0, 50.0, 160.0, 80.0), (2, 1, "(浙)AB安许证", 0.9, 170.0, 75.0, 300.0, 100.0), (2, 2, "字[2020]2号", 0.7, 320.0, 60.0, 500.0, 90.0), (2, 3, "无标签公司", 0.8, 200.0, 160.0, 400.0, 190.0), (2, 4, "主要负责人", 0.9, 100.0, 220.0, 200.0, 250.0), (2, 5, None, None, None, None, None, None),
        (3, 0, "姓名◇", 0.9, None, None, None, None), (3, 1, "备 注：", 0.9, 10.0, 100.0, 60.0, 130.0), (3, 2, "第一行", 0.6, 10.0, 140.0, 90.0, 160.0), (3, 3, "第二行", None, 10.0, 170.0, 90.0, 190.0), (3, 4, "第三行", 0.9, 10.0, 200.0, 90.0, 220.0), (3, 5, "名字 李 编号 7", 0.9, 300.0, 300.0, 500.0, 330.0),
        (4, 0, "企业名称丙公司有效期三年", 0.5, 10.0, 10.0, 300.0, 40.0),
    ],
)


@query()
def field_extract(spark, sf_dir):
    """Every field of every image's template; a fold over lines, tested against a plain version."""
    asked = templates.effective(TEMPLATES.frame(spark), templates.configured(spark))
    return X.finish(X.extract(IMAGES.frame(spark, sf_dir), LINES.frame(spark, sf_dir), asked))

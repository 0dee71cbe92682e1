"""Templates of certificates as tables: published revisions before configured ones, and what is wrong with a definition."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

SCHEMA = "template_code string, processor string, field string, labels array<string>, stop_labels array<string>, direction string, merge_wrapped boolean, max_lines int, min_confidence double, pattern string"
#: What a definition holds, as JSON; names as published. Fixed values.
DEFINITION = "struct<processor:string,fields:map<string,struct<labels:array<string>,stopLabels:array<string>,direction:string,mergeWrappedLines:boolean,maxLines:int,minConfidence:double,pattern:string>>>"
DIRECTIONS = ("right", "below")
LEAST_CONFIDENCE = 0.8

# The configured template, as (field, labels, stop labels, wrapped lines, rows at most, pattern).
SAFETY_LICENSE = (
    ("enterpriseName", ("企业名称", "单位名称", "公司名称"), ("许可范围", "可范围", "经营范围", "营范围", "主要负责人", "负责人", "单位地址", "经济类型", "有效期"), True, 0, None),
    ("creditCode", ("统一社会信用代码",), ("安全生产许可证", "企业名称"), False, 1, "^[0-9A-Z]{18}$"),
    ("licenseNumber", ("编号", "许可证编号", "证书编号"), ("企业名称", "许可范围", "经营范围", "主要负责人", "负责人", "单位地址", "经济类型", "有效期"), False, 1, None),
    ("principal", ("主要负责人", "法定代表人", "负责人"), ("单位地址", "经济类型", "有效期"), False, 1, None),
    ("address", ("单位地址", "住所", "地址"), ("经济类型", "有效期", "许可范围", "经营范围"), True, 0, None),
    ("economicType", ("经济类型", "类型"), ("有效期", "许可范围", "经营范围"), False, 1, None),
    ("validPeriod", ("有效期",), ("发证机关", "发证日期", "MEM", "许可范围", "经营范围"), False, 2, None),
    ("scope", ("许可范围", "可范围", "经营范围", "营范围"), ("主要负责人", "单位地址", "经济类型", "有效期", "发证机关", "发证日期"), True, 0, None),
    ("issueDate", ("发证日期", "签发日期"), ("MEM",), False, 1, r"^\d{4}年\d{2}月\d{2}日$"),
)


def configured(spark: SparkSession) -> DataFrame:
    """The fields of the templates that come with the configuration."""
    rows = [("safety_license", "safety-license", f, list(labels), list(stops), "right", wrapped, most, LEAST_CONFIDENCE, pattern) for f, labels, stops, wrapped, most, pattern in SAFETY_LICENSE]
    return spark.createDataFrame(rows, SCHEMA)


def published(revisions: DataFrame) -> DataFrame:
    """The fields of published definitions. revisions: template_code, status, definition (JSON)."""
    parsed = revisions.where("status = 'PUBLISHED'").select("template_code", F.from_json("definition", DEFINITION).alias("d"))
    fields = parsed.select("template_code", F.col("d.processor").alias("processor"), F.explode("d.fields").alias("field", "f"))
    return fields.select(
        "template_code", "processor", "field", "f.labels", F.col("f.stopLabels").alias("stop_labels"), F.coalesce("f.direction", F.lit("right")).alias("direction"), F.coalesce("f.mergeWrappedLines", F.lit(False)).alias("merge_wrapped"),
        F.coalesce("f.maxLines", F.lit(0)).alias("max_lines"), F.coalesce("f.minConfidence", F.lit(LEAST_CONFIDENCE)).alias("min_confidence"), "f.pattern",
    )


def effective(revisions: DataFrame, config: DataFrame) -> DataFrame:
    """The fields of every template: the published definition of a code before the configured one."""
    codes = revisions.where("status = 'PUBLISHED'").select("template_code").distinct()
    return published(revisions).unionByName(config.join(codes, "template_code", "left_anti"))


def codes(revisions: DataFrame, config: DataFrame) -> DataFrame:
    """template_code of all templates, once each, and whether the code is published, in order."""
    named = config.select("template_code", F.lit(False).alias("published")).union(revisions.where("status = 'PUBLISHED'").select("template_code", F.lit(True)))
    return named.groupBy("template_code").agg(F.max("published").alias("published")).orderBy("template_code")


@F.pandas_udf(BooleanType())
def compiles(patterns: pd.Series) -> pd.Series:
    """Whether each pattern is a regular expression; nothing in SQL tells without failing."""

    def good(p) -> bool:
        try:
            re.compile(p or "")
        except re.error:
            return False
        return True

    return patterns.map({p: good(p) for p in patterns.unique()})


def validate(definitions: DataFrame) -> DataFrame:
    """id and ``errors``, the codes of all that is wrong with a definition: STRUCTURE, FIELDS, or field:LABELS, field:DIRECTION, field:CONFIDENCE, field:PATTERN, in order."""
    parsed = definitions.withColumn("d", F.from_json("definition", DEFINITION, {"mode": "PERMISSIVE"}))
    broken = F.get_json_object("definition", "$").isNull() | ~F.startswith(F.ltrim("definition"), F.lit("{"))
    fields = parsed.select("id", F.explode("d.fields").alias("field", "f")).select("id", "field", "f.*").withColumn("compiles", compiles(F.col("pattern")))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    code = lambda bad, name: F.when(bad, F.concat("field", F.lit(":" + name)))

    def checks() -> list[Column]:
        return [
            code(F.col("labels").isNull() | ~F.exists("labels", lambda x: ~blank(x)), "LABELS"),
            code(~F.lower(F.coalesce("direction", F.lit("right"))).isin(*DIRECTIONS), "DIRECTION"),
            code(~F.coalesce("minConfidence", F.lit(LEAST_CONFIDENCE)).between(0, 1), "CONFIDENCE"),
            code(~blank(F.col("pattern")) & ~F.col("compiles"), "PATTERN"),
        ]

    found = fields.select("id", F.explode(F.filter(F.array(*checks()), lambda e: e.isNotNull())).alias("error")).groupBy("id").agg(F.array_sort(F.collect_list("error")).alias("errors"))
    top = F.when(broken, F.array(F.lit("STRUCTURE"))).when(F.coalesce(F.size("d.fields"), F.lit(0)) <= 0, F.array(F.lit("FIELDS")))
    return parsed.join(found, "id", "left").select("id", F.coalesce(top, "errors", F.array().cast("array<string>")).alias("errors"))

"""Choices between sources of a value, and shapes of pages and plans: engine fallback, batches,
certificate ladders, categories, responses to callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import layout as L

# When a primary engine's result is not good enough.
ENGINE_LEAST = 0.55


def engine_choice(primary: DataFrame, backup: DataFrame) -> DataFrame:
    """image_id, text and engine: the primary result unless it failed, is empty or has a mean confidence below ENGINE_LEAST and a backup exists."""
    p = primary.select("image_id", F.col("text").alias("p_text"), F.col("confidence").alias("p_confidence"), F.col("failed").alias("p_failed"))
    b = backup.select("image_id", F.col("text").alias("b_text"), F.lit(True).alias("has_backup"))
    weak = F.col("p_failed") | (F.coalesce(F.trim("p_text"), F.lit("")) == "") | (F.coalesce("p_confidence", F.lit(0.0)) < ENGINE_LEAST)
    use = weak & F.coalesce("has_backup", F.lit(False))
    return p.join(b, "image_id", "left").select("image_id", F.when(use, F.col("b_text")).otherwise(F.col("p_text")).alias("text"), F.when(use, "backup").otherwise("primary").alias("engine"))


def batch_totals(items: DataFrame) -> DataFrame:
    """batch_id, total, succeeded, failed: an item with an error code does not touch the others."""
    return items.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(F.col("error_code").isNull()).alias("succeeded"), F.count_if(F.col("error_code").isNotNull()).alias("failed"))


def mean_confidence(lines: DataFrame) -> DataFrame:
    """image_id, the mean confidence (null without any) and that with 0 for none."""
    mean = F.round(F.avg("confidence"), 6)
    return lines.groupBy("image_id").agg(mean.alias("confidence"), F.coalesce(mean, F.lit(0.0)).alias("or_zero"))


def licence_ladder(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """image_id and licence: from the field's own value, else from single lines in order, else from all text of the image run together."""
    ordered = lines.withColumn("found", L.licence_number(F.col("text")))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_idx", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "")
    by_image = ordered.groupBy("image_id").agg(F.min_by("found", F.when(F.col("found").isNotNull(), F.col("line_idx"))).alias("single"), parts.alias("whole"))
    own = fields.select("image_id", L.licence_number(F.col("value")).alias("own"))
    return own.join(by_image, "image_id", "left").select("image_id", F.coalesce("own", "single", L.licence_number(F.col("whole"))).alias("licence"))


def _kinds(norm: Column) -> dict[str, Column]:
    return {"_warn": norm.contains("预警"), "_act": norm.rlike("应急响应|应急反应|响应行动|反应行动")}


def kinds(norm: Column) -> dict[str, Column]:
    """What ``category`` asks of a normal text: whether it is evidence of warnings, and of responses."""
    return {f"x{c}": e for c, e in _kinds(norm).items()}


def category(blocks: DataFrame, back: int = 20) -> DataFrame:
    """Blocks with ``nearest``: WARNING or EMERGENCY, the kind of the farthest evidence at most ``back`` blocks before them and not before a stop.

    A stop is evidence in a heading or in the block itself, or a heading of level 1 or 2 before it. A heading or the block itself that shows both kinds is WARNING, another block EMERGENCY."""
    w = Window.partitionBy("doc_id").orderBy("block_idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    if "x_warn" in blocks.columns:
        b = blocks.withColumns({"_warn": F.col("x_warn"), "_act": F.col("x_act")})
    else:
        b = blocks.withColumns(_kinds(F.col("norm") if "norm" in blocks.columns else T.normalize(F.col("text"))))
    head, warn, act = F.col("heading_level") > 0, F.col("_warn"), F.col("_act")
    # What a block is to itself and to those after it, and whether it is a stop to them.
    own = F.when(warn, "WARNING").when(act, "EMERGENCY")
    b = b.withColumns({"_n": F.row_number().over(w), "_own": own, "_kind": F.when(warn & (head | ~act), "WARNING").when(act, "EMERGENCY"), "_stops": F.coalesce(((warn | act) & head) | F.col("heading_level").between(1, 2), F.lit(False))})
    shown = F.col("_kind").isNotNull()
    b = b.withColumns({"_stop": F.last(F.when(F.col("_stops"), F.col("_n")), ignorenulls=True).over(before), "_seen": F.last(F.when(shown, F.col("_n")), ignorenulls=True).over(before)})
    # The first evidence at or after each stop, so no block needs the list of those before it.
    opens = shown & (F.col("_stops") | F.col("_seen").isNull() | F.coalesce(F.col("_seen") < F.col("_stop"), F.lit(False)))
    b = b.withColumn("_first", F.last(F.when(opens, F.struct("_n", "_kind")), ignorenulls=True).over(before))
    far = F.first("_kind", ignorenulls=True).over(w.rowsBetween(-back, -1))
    since = F.when(F.col("_stop") >= F.col("_n") - back, F.when(F.col("_first._n") >= F.col("_stop"), F.col("_first._kind"))).otherwise(F.col("_far"))
    return b.withColumn("_far", far).withColumn("nearest", F.coalesce("_own", since)).drop("_warn", "_act", "_n", "_own", "_kind", "_stops", "_stop", "_seen", "_first", "_far")


def legacy_levels(levels: DataFrame) -> DataFrame:
    """Emergency levels that were found, with the pages of their conditions and measures merged in order."""
    return levels.where("category = 'EMERGENCY' and status <> 'MISSING'").select("doc_id", "level_key", F.array_join(F.array_union("condition_pages", "measure_pages").cast("array<string>"), ",").alias("pages"))


def layout_table(cells: DataFrame) -> DataFrame:
    """table_id and whether the table only lays paragraphs out: at most one column with three paragraphs or more, or one cell with two or more. A cell's paragraphs are its lines that are not blank."""
    paragraphs = F.sum(F.size(T.split_lines(F.col("text"))))
    return cells.groupBy("table_id").agg((((F.max("column") <= 0) & (paragraphs >= 3)) | ((F.count("*") == 1) & (paragraphs >= 2))).alias("is_layout"))


def active_first(samples: DataFrame) -> DataFrame:
    """Samples with their place in a list that shows active ones first, then the newest."""
    w = Window.partitionBy("task_id").orderBy((F.col("status") == "ACTIVE").desc(), F.col("created_at").desc(), "sample_id")
    return samples.withColumn("place", F.row_number().over(w))


def disposition_name(header: Column) -> Column:
    """The file name of a content-disposition header, the encoded form first."""
    star = F.regexp_extract(header, r"(?i)filename\*=(?:UTF-8'')?\"?([^\";]+)", 1)
    plain = F.regexp_extract(header, r"(?i)filename=\"?([^\";]+)", 1)
    return F.coalesce(F.nullif(F.url_decode(star), F.lit("")), F.nullif(plain, F.lit("")))


# The phrases of statuses.
REASONS = {200: "OK", 400: "Bad Request", 404: "Not Found", 409: "Conflict", 413: "Payload Too Large", 415: "Unsupported Media Type", 500: "Internal Server Error"}
MESSAGES = {"FILE_TOO_LARGE": "上传文件大小超过限制。", "INVALID_REQUEST": "请求参数不完整。", "INTERNAL_ERROR": "服务处理失败。"}


def error_body(code: Column, path: Column, at: Column, message: Column | None = None) -> Column:
    """One record for every failure: time, status and its phrase, code, message and path, as JSON. Without a message that of the code, if it has one."""
    status = (
        F.when(code.isNull(), 200).when(code.endswith("_NOT_FOUND"), 404).when(code.endswith("_ALREADY_EXISTS"), 409)
        .when(code.isin("FILE_TOO_LARGE", "DOCUMENT_TOO_LARGE"), 413).when(code.startswith("UNSUPPORTED"), 415).when(code == "INTERNAL_ERROR", 500).otherwise(400)
    )
    words = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    told = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])[code]
    said = F.coalesce(message, told) if message is not None else told
    return F.to_json(F.struct(at.alias("time"), status.alias("status"), words[status].alias("error"), code.alias("code"), said.alias("message"), path.alias("path")))

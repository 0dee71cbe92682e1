"""Fields from positioned text lines.

Lines have image_id, line_idx, text, confidence and a box (x_min, y_min, x_max, y_max). Template
fields are a broadcast side: a template is configuration of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import small

# Gaps in pixels that end a value to the right, and how far left of an anchor's end a value may begin; the
# gap that ends a value below: so many heights of its label, and pixels at least.
RIGHT_GAP = 320
OVERLAP = 20
LINE_GAP_HEIGHTS, LINE_GAP = 2.5, 80.0


def line_gap() -> Column:
    """The widest gap between lines of a value, by the height of its label's line."""
    return F.greatest((F.col("y_max") - F.col("y_min")) * LINE_GAP_HEIGHTS, F.lit(LINE_GAP))


def reading_order(lines: DataFrame) -> DataFrame:
    """Lines with ``pos``: by top, then left edge; lines without a box last."""
    w = Window.partitionBy("image_id").orderBy(F.col("y_min").asc_nulls_last(), F.col("x_min").asc_nulls_last(), "line_idx")
    return lines.withColumn("pos", F.row_number().over(w) - 1)


def label_hits(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """For each image and field the first line in reading order that holds a label (labels in order within a line), and what follows the label in it."""
    ordered = reading_order(lines).withColumn("norm", T.normalize_field(F.col("text")))
    label = labels.select("field", "label_order", "label", T.normalize_field(F.col("label")).alias("_label"))
    hits = ordered.join(small(label), F.expr("contains(norm, _label)"))
    w = Window.partitionBy("image_id", "field").orderBy("pos", "label_order")
    best = hits.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    rest = F.substring("norm", F.instr(F.col("norm"), F.col("_label")) + F.length("_label"), F.length("norm"))
    return best.select("image_id", "field", "line_idx", "pos", "label", rest.alias("inline"), "x_min", "y_min", "x_max", "y_max")


def collect_right(anchors: DataFrame, lines: DataFrame, stops: DataFrame) -> DataFrame:
    """(image_id, field, value, confidence): texts on the anchor's row to its right, up to a wide gap or a line that begins with a stop label."""
    other = lines.select(F.col("image_id").alias("_image"), F.col("line_idx").alias("_line"), F.col("text").alias("_text"), "confidence", *[F.col(c).alias("_" + c) for c in ("x_min", "y_min", "x_max", "y_max")])
    height = F.greatest(F.col("y_max") - F.col("y_min"), F.col("_y_max") - F.col("_y_min"), F.lit(1.0))
    same_row = F.abs((F.col("y_min") + F.col("y_max")) / 2 - (F.col("_y_min") + F.col("_y_max")) / 2) <= height * 0.75
    near = anchors.join(other, (F.col("image_id") == F.col("_image")) & (F.col("line_idx") != F.col("_line")) & same_row & (F.col("_x_min") >= F.col("x_max") - OVERLAP))
    s = stops.select(F.col("field").alias("_field"), T.normalize_field(F.col("stop")).alias("_stop"))
    near = near.join(small(s), F.expr("field = _field and startswith(regexp_replace(_text, '[ :：]', ''), _stop)"), "left").groupBy("image_id", "field", "x_max", "inline", "_line", "_text", "confidence", "_x_min", "_x_max").agg(F.max(F.col("_stop").isNotNull()).alias("_ends"))
    w = Window.partitionBy("image_id", "field").orderBy("_x_min", "_line")
    edge = F.coalesce(F.max("_x_max").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("x_max"))
    near = near.withColumn("_break", (F.col("_ends") | (F.col("_x_min") - edge > RIGHT_GAP)).cast("int")).withColumn("_broken", F.sum("_break").over(w)).where("_broken = 0")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("_x_min", "_line", "_text"))), lambda x: x["_text"])
    return near.groupBy("image_id", "field", "inline").agg(parts.alias("parts"), F.round(F.avg("confidence"), 6).alias("confidence")).select(
        "image_id", "field", F.regexp_replace(F.regexp_replace(F.concat(F.col("inline"), F.array_join("parts", "")), r"\s+", ""), "^[:：]+", "").alias("value"), "confidence"
    )


def collect_below(anchors: DataFrame, lines: DataFrame, labels: DataFrame) -> DataFrame:
    """(image_id, field, value): texts that begin lower than the anchor, in reading order, up to one that holds any label or a gap of more than ``line_gap``."""
    known = labels.select(T.normalize_field(F.col("label")).alias("_label")).distinct()
    other = lines.select(F.col("image_id").alias("_image"), F.col("line_idx").alias("_line"), F.col("text").alias("_text"), F.col("y_min").alias("_top"), F.col("y_max").alias("_bottom"), F.col("x_min").alias("_left"))
    marked = other.join(small(known), F.contains(T.normalize_field(F.col("_text")), F.col("_label")), "left").groupBy(*other.columns).agg(F.max(F.col("_label").isNotNull()).alias("_ends"))
    near = anchors.join(marked, (F.col("image_id") == F.col("_image")) & (F.col("_top") > F.col("y_min")) & (F.col("line_idx") != F.col("_line")))
    w = Window.partitionBy("image_id", "field").orderBy("_top", "_left", "_line")
    edge = F.greatest(F.coalesce(F.max("_bottom").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("y_max")), F.col("y_max"))
    near = near.withColumn("_broken", F.sum((F.col("_ends") | (F.col("_top") - edge > line_gap())).cast("int")).over(w)).where("_broken = 0")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("_top", "_left", "_line", "_text"))), lambda x: x["_text"])
    return near.groupBy("image_id", "field").agg(F.regexp_replace(F.array_join(parts, ""), r"\s+", "").alias("value"))


def field_status(value: Column, confidence: Column, pattern: Column, least: Column) -> Column:
    """MISSING, INVALID, LOW_CONFIDENCE or EXTRACTED, the first that applies."""
    return (
        F.when(F.coalesce(F.trim(value), F.lit("")) == "", "MISSING")
        .when(pattern.isNotNull() & ~F.coalesce(F.regexp(value, F.concat(F.lit("^(?:"), pattern, F.lit(")$"))), F.lit(False)), "INVALID")
        .when(confidence.isNull() | (confidence < least), "LOW_CONFIDENCE")
        .otherwise("EXTRACTED")
    )


# --- certificates -------------------------------------------------------------------------

# Dates, licence numbers and misread forms on certificates.
DATE = r"(\d{4}年\d{1,2}月\d{1,2}日)"
LICENCE = r"[（(〔\[]?[一-龥A-Za-z]{1,4}[）)〕\]]?[A-Z]{0,4}安[许許午][証证][字学]?[（(〔\[]?\d{4}[）)〕\]]?[A-Za-z0-9-]{1,12}[号號]"
SCOPE_WORDS = "许可范围|可范围|经营范围"


def repair_date(c: Column) -> Column:
    """Dates with a missing year sign or single digits written out; a text without month and day signs is left alone."""
    v = F.regexp_replace(F.replace(c, F.lit("第2"), F.lit("02")), r"(\d{4})(\d{1,2}月)", "$1年$2")
    v = F.regexp_replace(F.regexp_replace(v, r"年(\d月)", "年0$1"), r"月(\d日)", "月0$1")
    return F.when(c.contains("月") & c.contains("日"), v).otherwise(c)


def dates(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(DATE), 1), lambda d: F.regexp_replace(F.regexp_replace(d, r"年(\d月)", "年0$1"), r"月(\d日)", "月0$1"))


def date_range(c: Column) -> Column:
    """The first two dates as a range, else the repaired text."""
    return T.let(repair_date(c), lambda v: F.when(F.size(dates(v)) >= 2, F.concat(dates(v)[0], F.lit("至"), dates(v)[1])).otherwise(v))


# Misread months, and a date of which the month may be missing, with the month that then holds.
MISREAD_MONTHS = (("每月", "02月"), ("第2月", "02月"), ("第2", "02"))
PARTIAL_DATE = r"(\d{4}).*?(\d{1,2})?月(\d{1,2})日"
DEFAULT_MONTH = "02"


def single_date(c: Column) -> Column:
    """The first date of the repaired text; of a partial one the year and day with its month or the default; else the text."""
    for old, new in MISREAD_MONTHS:
        c = F.replace(c, F.lit(old), F.lit(new))
    part = lambda v, k: F.regexp_extract(v, PARTIAL_DATE, k)
    whole = lambda v: F.concat(part(v, 1), F.lit("年"), F.lpad(F.coalesce(F.nullif(part(v, 2), F.lit("")), F.lit(DEFAULT_MONTH)), 2, "0"), F.lit("月"), F.lpad(part(v, 3), 2, "0"), F.lit("日"))
    return T.let(c, lambda v: F.coalesce(F.get(dates(v), F.lit(0)), F.when(v.rlike(PARTIAL_DATE), whole(v)), v))


def licence_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_replace(c, r"\s+", ""), LICENCE, 0), F.lit(""))


def company_name(c: Column) -> Column:
    """A company's name before any scope heading, its cut suffix completed."""
    return F.replace(F.regexp_replace(c, f"(?s)({SCOPE_WORDS}).*$", ""), F.lit("有限公"), F.lit("有限公司"))


# --- recognition passes -------------------------------------------------------------------


def quality(lines: DataFrame) -> DataFrame:
    """image_id, pass_no, n_lines, chars without white space, score = 20 a line + chars, mean confidence."""
    chars = F.sum(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")))
    return lines.groupBy("image_id", "pass_no").agg(F.count("*").alias("n_lines"), chars.alias("n_chars"), F.round(F.avg("confidence"), 6).alias("confidence")).withColumn("score", F.col("n_lines") * 20 + F.col("n_chars"))


def needs_second_pass(scored: DataFrame) -> DataFrame:
    """Images whose first pass has under 8 characters, or no or a low mean confidence."""
    return scored.where("pass_no = 1 and (n_chars < 8 or confidence is null or confidence < 0.75)").select("image_id")


def merge_passes(lines: DataFrame) -> DataFrame:
    """The lines of both passes, each text (white space aside) once, the better pass first; boxes of the better pass only."""
    best = quality(lines).groupBy("image_id").agg(F.max_by("pass_no", F.struct("score", -F.col("pass_no"))).alias("primary"))
    key = F.regexp_replace("text", r"\s+", "")
    rows = lines.join(best, "image_id").withColumn("_second", (F.col("pass_no") != F.col("primary")).cast("int")).withColumn("_key", key).where("_key <> ''")
    first = Window.partitionBy("image_id", "_key").orderBy("_second", "line_idx")
    kept = rows.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    pos = F.row_number().over(Window.partitionBy("image_id").orderBy("_second", "line_idx")) - 1
    return kept.select("image_id", pos.alias("pos"), "text", (F.col("_second") == 0).alias("has_box"))


def median_angle(angles: DataFrame) -> DataFrame:
    """For each image minus the upper median of its angles within 12 degrees; 0 where it is at most 0.3 or there are none."""
    kept = F.array_sort(F.filter(F.collect_list("angle"), lambda a: F.abs(a) <= 12))
    mid = F.element_at(kept, (F.floor(F.size(kept) / 2) + 1).cast("int"))
    return angles.groupBy("image_id").agg(F.when(F.size(kept) == 0, 0.0).when(F.abs(mid) > 0.3, -mid).otherwise(0.0).alias("rotate"))


def column_edges(anchors: DataFrame, width: Column) -> DataFrame:
    """image_id, column, left and right edge of a sideways table's columns: midpoints between neighbouring anchors, the page's edges outside."""
    w = Window.partitionBy("image_id").orderBy("x_min", "line_idx")
    mid = lambda c: (F.col("x_min") + F.col("x_max")) / 2 if c is None else c
    a = anchors.withColumn("_mid", mid(None))
    left = F.coalesce((F.lag("_mid").over(w) + F.col("_mid")) / 2, F.lit(0.0))
    right = F.coalesce((F.lead("_mid").over(w) + F.col("_mid")) / 2, width)
    return a.select("image_id", F.row_number().over(w).alias("column"), left.alias("left_edge"), right.alias("right_edge"))

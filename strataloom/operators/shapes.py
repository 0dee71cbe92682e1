"""Small shapes that other operators are made of: ordered batches, boxes, frames ahead, sideways tables, traces, typed JSON, measured stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import large, small

# How wide apart a sideways table's columns stand at least, together and one by one, and how far its heads may be out of line, as shares of the page.
SPREAD, GAP, OUT_OF_LINE = 0.45, 0.08, 0.12
#: Anchors that stand upright at least, and how much higher than wide they are. Fixed values.
UPRIGHT, UPRIGHT_SHAPE = 3, 1.5


def batch_items(batches: DataFrame, items: str) -> DataFrame:
    """The items of each batch in rows, with the place that gives the batch its order again."""
    return batches.select(*[c for c in batches.columns if c != items], F.posexplode(items).alias("item_idx", "item"))


def char_confidence(scores: Column, box_score: Column) -> Column:
    """The mean score of a line's characters; without any that of its box."""
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, s: a + s.cast("double")) / F.size(scores)).otherwise(box_score)


def bounds(points: Column) -> Column:
    """x_min, y_min, x_max, y_max of a box's points (structs of x and y); null for none."""
    of = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return F.struct(of(F.array_min, "x").alias("x_min"), of(F.array_min, "y").alias("y_min"), of(F.array_max, "x").alias("x_max"), of(F.array_max, "y").alias("y_max"))


def next_within(rows: DataFrame, key: str, order: str, test: Column, within: int, name: str) -> DataFrame:
    """The rows with ``name``: the place of the next row, at most ``within`` ahead, for which ``test`` holds."""
    ahead = Window.partitionBy(key).orderBy(order).rowsBetween(1, within)
    return rows.withColumn(name, F.min(F.when(test, F.col(order))).over(ahead))


def level_anchors(lines: DataFrame) -> DataFrame:
    """For each image and level the shortest line that names it, the first of equals."""
    best = F.min_by(F.struct("line_idx", "text", "x_min", "y_min", "x_max", "y_max"), F.struct(F.length(T.normalize_field(F.col("text"))), "line_idx"))
    return lines.groupBy("image_id", "level").agg(best.alias("a")).select("image_id", "level", "a.*")


def sideways(anchors: DataFrame, pages: DataFrame) -> DataFrame:
    """image_id, whether a page is a sideways table of the four levels, and whether it turns clockwise: all levels have an anchor, most of them upright, spread over the page, none too close to the next, in line.

    pages: image_id, width, height."""
    a = anchors.join(pages, "image_id").withColumns({"mid_x": (F.col("x_min") + F.col("x_max")) / 2, "mid_y": (F.col("y_min") + F.col("y_max")) / 2})
    upright = (F.col("y_max") - F.col("y_min")) > (F.col("x_max") - F.col("x_min")) * UPRIGHT_SHAPE
    w = Window.partitionBy("image_id")
    a = a.withColumn("clockwise", F.avg("mid_x").over(w) <= F.col("width") / 2)
    a = a.withColumns({"along": F.when(F.col("clockwise"), F.col("height") - F.col("mid_y")).otherwise(F.col("mid_y")), "across": F.when(F.col("clockwise"), F.col("mid_x")).otherwise(F.col("width") - F.col("mid_x"))})
    a = a.withColumn("gap", F.col("along") - F.lag("along").over(w.orderBy("along")))
    spread = lambda c: F.max(c) - F.min(c)
    fits = (F.count("*") == 4) & (F.count_if(upright) >= UPRIGHT) & (spread("along") >= F.first("height") * SPREAD) & (F.min("gap") >= F.first("height") * GAP) & (spread("across") <= F.first("width") * OUT_OF_LINE)
    return pages.select("image_id").join(a.groupBy("image_id").agg(fits.alias("is_table"), F.first("clockwise").alias("clockwise")), "image_id", "left").select("image_id", F.coalesce("is_table", F.lit(False)).alias("is_table"), "clockwise")


def numbered_rules(rules: DataFrame) -> DataFrame:
    """All rules, disabled ones too, with their place in the order in which traces show them."""
    w = Window.partitionBy("rule_type").orderBy("group_order", "rule_code", "alias_order", "alias")
    return rules.withColumn("place", F.row_number().over(w))


def rule_outcomes(rules: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, rule_code and disposition of each level rule in each document: MISSING, FALLBACK or MATCHED by the result with its key. found: doc_id, key, status, matched_by."""
    codes = rules.where("enabled and rule_type in ('RESPONSE', 'WARNING')").select("rule_code").distinct()
    grid = found.select("doc_id").distinct().join(small(codes))
    rows = grid.join(large(found.withColumnRenamed("key", "rule_code")), ["doc_id", "rule_code"], "left")
    missing = F.coalesce(F.col("status"), F.lit("MISSING")) == "MISSING"
    return rows.select("doc_id", "rule_code", F.when(missing, "MISSING").when(F.col("matched_by") == "CONTEXT_FALLBACK", "FALLBACK").otherwise("MATCHED").alias("disposition"))


def all_keys(a: Column, b: Column) -> Column:
    """The keys of two maps, once each, in order."""
    keys = lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    return F.array_sort(F.array_union(keys(a), keys(b)))


def typed(c: Column, schema: str) -> Column:
    """JSON text read by a schema and written again: fields that it does not name go, absent ones are left out."""
    return F.to_json(F.from_json(c, schema))


def pdf_clean(c: Column) -> Column:
    """A line of a PDF without line ends, tabs and runs of spaces; digits as they are."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit(" ")), r"\s+", " "))


def pdf_heading_level(c: Column) -> Column:
    """0 for body text, 1 for a chapter or a numbered line, 2 for one with a dotted number."""
    numbered = c.rlike(r"^([一二三四五六七八九十]+[、.]|\d+(?:\.\d+){0,3}[、.\s]).{1,80}$")
    return F.when((F.trim(F.coalesce(c, F.lit(""))) == "") | (F.length(c) > 80), 0).when(c.rlike("^第[一二三四五六七八九十]+[章节篇]"), 1).when(numbered, F.when(c.rlike(r"^\d+\.\d+"), 2).otherwise(1)).otherwise(0)


def measured(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The rows, and figures that are gathered while they are first computed: ``observation.get`` waits for that."""
    seen = Observation(name)
    return df.observe(seen, *[m.alias(k) for k, m in metrics.items()]), seen

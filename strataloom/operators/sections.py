"""Sections of documents: which block opens the section of a rule, and how far it reaches.

Blocks have doc_id, block_idx, text, page, heading_level, is_table. Rules are joined as a
broadcast side: a rule set is configuration of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import large, small

MAX_FIELD = 8000


def _order() -> Window:
    return Window.partitionBy("doc_id").orderBy("block_idx")


def candidates(blocks: DataFrame, rules: DataFrame, infer: bool = True) -> DataFrame:
    """Blocks that hold an alias of a rule: rule_code, alias (the first in order), matched_by, score, and the heading level that its numbering implies.

    infer: whether numbering makes headings; not so where all headings are marked, as in HTML, and a number may open any line."""
    rule = rules.where("enabled").select("rule_type", "rule_code", "group_order", "alias_order", T.normalize(F.col("alias")).alias("alias"))
    first = Window.partitionBy("rule_code").orderBy("alias_order")
    rule = rule.withColumn("first_alias", F.first("alias").over(first))
    body = blocks.withColumn("norm", T.normalize(F.col("text")))
    hits = body.join(small(rule), F.expr("contains(norm, alias)")).where(T.fits_alias(F.col("norm"), F.col("alias")))
    hits = hits.groupBy("doc_id", "block_idx", "rule_type", "rule_code").agg(
        F.min_by("alias", "alias_order").alias("alias"), F.first("first_alias").alias("first_alias"), F.first("text").alias("text"), F.first("norm").alias("norm"),
        F.first("heading_level").alias("heading_level"), F.first("is_table").alias("is_table"),
    )
    hits = hits.withColumn("inferred", T.heading_level(F.col("text")) if infer else F.lit(0))
    matched = (
        F.when(F.col("is_table"), "TABLE_ROW")
        .when((F.col("heading_level") == 0) & (F.col("inferred") == 0), "CONTEXT_FALLBACK")
        .when(F.expr("contains(norm, first_alias)"), "HEADING")
        .when(T.starts_with_number(F.col("text")) & infer, "NUMBERED_SECTION")
        .otherwise("HEADING_ALIAS")
    )
    hits = hits.withColumn("matched_by", matched)
    base = F.when(F.col("matched_by").isin("HEADING", "HEADING_ALIAS"), 1).when(F.col("matched_by") == "TABLE_ROW", 2).when(F.col("matched_by") == "NUMBERED_SECTION", 3).otherwise(10)
    return hits.withColumn("score", (base + F.least(F.floor(F.length("text") / 20), F.lit(5))).cast("int"))


def best_candidates(found: DataFrame) -> DataFrame:
    """The candidate with the lowest score for each document and rule, the earliest of equals; and whether several were no fallback."""
    w = Window.partitionBy("doc_id", "rule_code")
    clear = F.sum((F.col("matched_by") != "CONTEXT_FALLBACK").cast("int")).over(w) > 1
    ranked = found.withColumn("ambiguous", clear).withColumn("_k", F.row_number().over(w.orderBy("score", "block_idx")))
    return ranked.where("_k = 1").drop("_k")


def section_ends(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Anchors with ``end_idx``: the first later block whose heading level is at most the anchor's (its own, or 2), else the end of the document."""
    depth = F.when(F.col("heading_level") > 0, F.col("heading_level")).when(F.col("inferred") > 0, F.col("inferred")).otherwise(2)
    # read backwards, the heading seen last at each depth is the next one
    after = Window.partitionBy("doc_id").orderBy(F.col("block_idx").desc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = F.array(*[F.last(F.when(F.col("heading_level").between(1, k), F.col("block_idx")), ignorenulls=True).over(after) for k in range(1, 7)])
    size = F.max("block_idx").over(Window.partitionBy("doc_id")) + 1
    ahead = blocks.select("doc_id", "block_idx", heads.alias("_heads"), size.alias("_size"))
    ends = anchors.withColumn("_depth", F.least(depth, F.lit(6))).join(large(ahead), ["doc_id", "block_idx"])
    return ends.withColumn("end_idx", F.coalesce(F.get("_heads", F.col("_depth") - 1), "_size")).select(*anchors.columns, "end_idx")


def section_texts(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, rule_code, n_blocks and content: the blocks between an anchor and its end, repeated lines once, joined by line ends, cut at MAX_FIELD; the anchor's own text where there are none."""
    inner = blocks.select(F.col("doc_id").alias("_doc"), F.col("block_idx").alias("_i"), F.col("text").alias("_t"))
    joined = anchors.select("doc_id", "rule_code", "block_idx", "end_idx", "text").join(large(inner), F.expr("doc_id = _doc and _i > block_idx and _i < end_idx"), "left")
    parts = F.transform(F.sort_array(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", "_t")))), lambda x: x["_t"])
    out = joined.groupBy("doc_id", "rule_code", "text").agg(F.count("_i").alias("n_blocks"), parts.alias("parts"))
    content = F.when(F.size("parts") == 0, F.col("text")).otherwise(F.array_join(F.array_distinct("parts"), "\n"))
    return out.select("doc_id", "rule_code", "n_blocks", F.substring(content, 1, MAX_FIELD).alias("content"))


def nearest_heading(blocks: DataFrame, within: int = 80) -> DataFrame:
    """Blocks with the text and level of the nearest heading at or before them, at most ``within`` blocks back."""
    w = _order().rowsBetween(-within, 0)
    near = lambda c: F.last(F.when(F.col("heading_level") > 0, F.col(c)), ignorenulls=True).over(w)
    return blocks.withColumn("heading", near("text")).withColumn("under_level", near("heading_level"))


def scope(blocks: DataFrame, hit: Column) -> DataFrame:
    """Each document from its only hit to the next heading of the same or a higher level; documents with no hit or several stay whole."""
    w = Window.partitionBy("doc_id")
    b = blocks.withColumn("_hit", hit)
    b = b.withColumn("_n", F.sum(F.col("_hit").cast("int")).over(w)).withColumn("_at", F.min(F.when(F.col("_hit"), F.col("block_idx"))).over(w)).withColumn("_level", F.min(F.when(F.col("_hit"), F.greatest("heading_level", F.lit(1)))).over(w))
    stop = F.min(F.when((F.col("block_idx") > F.col("_at")) & (F.col("heading_level") > 0) & (F.col("heading_level") <= F.col("_level")), F.col("block_idx"))).over(w)
    b = b.withColumn("_stop", stop)
    return b.where("_n <> 1 or (block_idx >= _at and (_stop is null or block_idx < _stop))").select(*blocks.columns)


def char_budget(blocks: DataFrame, most: int = MAX_FIELD) -> DataFrame:
    """Blocks while the characters of a document up to and with them are at most ``most``."""
    total = F.sum(F.length("text")).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("running_chars", total).where(F.col("running_chars") <= most)


def pages_seen(blocks: DataFrame) -> DataFrame:
    """doc_id and the distinct pages of its blocks in order of first sight, joined by commas."""
    seen = F.transform(F.sort_array(F.collect_list(F.struct("block_idx", "page"))), lambda x: x["page"])
    return blocks.groupBy("doc_id").agg(F.array_join(F.array_distinct(F.filter(seen, lambda p: p > 0)).cast("array<string>"), ",").alias("pages"))


def trace(blocks: DataFrame, rules: DataFrame, most: int = 10, snippet: int = 200) -> DataFrame:
    """How each rule fared in each document: candidates (at most ``most`` numbered by position), text cut to ``snippet``, and its disposition."""
    rule = rules.where("enabled").select("rule_code", "alias", "group_order", "alias_order", T.normalize_trace(F.col("alias")).alias("_alias"))
    body = blocks.select("doc_id", "block_idx", "text", "heading_level", T.normalize_trace(F.col("text")).alias("_norm"))
    hits = body.join(small(rule), F.expr("contains(_norm, _alias)")).groupBy("doc_id", "rule_code", "block_idx").agg(F.first("text").alias("text"), F.max("heading_level").alias("heading_level"))
    ranked = hits.withColumn("candidate", F.row_number().over(Window.partitionBy("doc_id", "rule_code").orderBy("block_idx")))
    disposition = F.when(F.max((F.col("heading_level") > 0).cast("int")).over(Window.partitionBy("doc_id", "rule_code")) == 1, "MATCHED").otherwise("FALLBACK")
    return ranked.withColumn("disposition", disposition).where(F.col("candidate") <= most).select("doc_id", "rule_code", "candidate", "block_idx", T.clip(F.col("text"), snippet + 1, "…").alias("snippet"), "disposition")

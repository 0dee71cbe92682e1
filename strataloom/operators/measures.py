"""What levels do beyond their own measures: measures common to all levels of a plan, and those of the levels they build on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..tables import large

MAX_FIELD = 8000
# Blocks that a section of common measures spans at most, its heading's level where it has none, how its heading reads.
COMMON_BLOCKS, COMMON_LEVEL, TITLE_CHARS = 30, 3, 30
COMMON_TITLE = "(?:共同|共性)(?:响应|应急|处置)?(?:措施|行动|程序)$|一般程序|基本程序|响应程序|应急处置"
TOP_TITLE = "(?:响应|处置)措施$"
TOP_ACTIONS = "响应行动|反应行动"
# Fixed value: white space at a line's ends, as Python strips it.
BLANK_EDGES = r"\A[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+|[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+\z"
SENTENCE_SIGNS = "[，,。！？!?]"


def paragraphs(texts: Column) -> Column:
    """The lines of some texts, each once, trimmed, without blank ones; MAX_FIELD characters at most, line ends counted."""
    lines = F.filter(F.transform(F.flatten(F.transform(texts, lambda t: F.split(t, "\r\n|[\r\n]"))), F.trim), lambda x: x != "")
    return F.regexp_replace(F.substring(F.array_join(F.array_distinct(lines), "\n"), 1, MAX_FIELD), "\n$", "")


def opens_common(category: str) -> Column:
    """Whether a block is the heading of measures that all levels of a category share; the first test that applies decides."""
    norm, level = F.col("norm"), F.col("heading_level")
    title = T.normalize(T.strip_section_number(F.trim(F.col("text"))))
    like = (F.length(title) <= TITLE_CHARS) & ~title.rlike(SENTENCE_SIGNS)
    top = level.between(1, 2)
    shared = (like & (title.rlike(COMMON_TITLE) | (top & title.rlike(TOP_TITLE)))) | (top & norm.rlike(TOP_ACTIONS))
    if category == "WARNING":
        shared = (norm.contains("预警") & norm.contains("响应") & norm.contains("发布")) | shared
    else:
        shared = ~(norm.contains("预警") & ~norm.contains("应急响应")) & shared
    return (F.col("heading") | T.is_standalone_marker(F.col("text"))) & shared


def common_blocks(b: DataFrame, responses: tuple[str, ...], compatible: dict[str, Column]) -> DataFrame:
    """(doc_id, category, start, block_idx, text): the blocks of each section of common measures.

    A section opens with a heading that names no level of its category, and runs to the first block that does, to a tail
    or the bare name of a response level, to a heading no deeper than its own, or to its bound of blocks or characters. It
    counts only if something in it is an action. ``b``: blocks of ``response.described``; ``compatible``: which blocks a category may use."""
    opens = lambda c: F.col(f"c_{c}") if f"c_{c}" in b.columns else opens_common(c)
    names = lambda c: F.exists("keys", lambda k: F.startswith(k, F.lit("warning_")) == (c == "WARNING"))
    flags = F.filter(F.array(*[F.when(compatible[c] & ~names(c) & opens(c), F.lit(c)) for c in compatible]), lambda c: c.isNotNull())
    starts = b.select("doc_id", F.col("block_idx").alias("start"), F.when(F.col("heading"), F.col("heading_level")).otherwise(COMMON_LEVEL).alias("depth"), F.explode(flags).alias("category"))
    spread = starts.withColumn("block_idx", F.explode(F.sequence(F.col("start") + 1, F.col("start") + COMMON_BLOCKS - 1)))
    boundary = F.col("tail") | ((F.length("norm") <= 16) & F.col("norm").isin(*responses))
    inner = b.select("doc_id", "block_idx", "text", "heading", "heading_level", boundary.alias("boundary"), names("WARNING").alias("warns"), names("EMERGENCY").alias("acts"))
    w = Window.partitionBy("doc_id", "category", "start").orderBy("block_idx")
    named = F.when(F.col("category") == "WARNING", F.col("warns")).otherwise(F.col("acts"))
    ends = named | F.col("boundary") | (F.col("heading") & (F.col("heading_level") <= F.col("depth"))) | (F.sum(F.length("text")).over(w) > MAX_FIELD)
    rows = large(spread).join(inner, ["doc_id", "block_idx"]).withColumn("over", F.max(ends.cast("int")).over(w)).where("over = 0")
    whole = Window.partitionBy("doc_id", "category", "start")
    return rows.withColumn("active", F.max(T.is_action(F.col("text")).cast("int")).over(whole)).where("active = 1").select("doc_id", "category", "start", "block_idx", "text")


def common_texts(rows: DataFrame) -> DataFrame:
    """doc_id, category and ``common``: the common measures of a plan, in order."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("start", "block_idx", "text"))), lambda x: x["text"])
    return rows.groupBy("doc_id", "category").agg(paragraphs(lines).alias("common"))


# --- measures that build on those of other levels -----------------------------------------


def _joined(lines: list[str]) -> list[str]:
    out, size = [], -1
    for line in dict.fromkeys(x.strip() for x in lines):
        room = MAX_FIELD - size - 1
        if line and room > 0:
            out.append(line[:room])
            size += 1 + len(out[-1])
    return out


def expand(levels: list[dict]) -> list[str | None]:
    """The effective measures of a plan's levels, given in order with ``ordinal``, ``sources`` (ordinals, in order), ``measures`` and ``common``.

    A level has the measures of its sources, expanded likewise, then its own and the common ones. Levels are expanded in
    order and each only once. Where sources lead back to a level that is being expanded, that level counts with its own
    and common measures alone; so in a circle the first level of it has them all, and what is finished meanwhile stays as it is."""
    own = {v["ordinal"]: _joined([x for part in (v["measures"], v["common"]) for x in (part or "").split("\n")]) for v in levels}
    sources = {v["ordinal"]: [s for s in (v["sources"] if v["sources"] is not None else []) if s in own] for v in levels}
    done: dict[int, list[str]] = {}

    def visit(k: int, entered: tuple[int, ...]) -> list[str]:
        if k in entered:
            return own[k]
        if k not in done:
            lines = [x for s in sources[k] for x in visit(s, (*entered, k))]
            done[k] = _joined(lines + own[k])
        return done[k]

    return ["\n".join(visit(v["ordinal"], ())) or None for v in levels]


def own_lines() -> Column:
    """The effective measures of a level that builds on no other and has fewer than MAX_FIELD characters: its own lines and the common ones."""
    lines = F.filter(F.transform(F.split(F.concat_ws("\n", "measures", "common"), "\n"), lambda x: F.regexp_replace(x, BLANK_EDGES, "")), lambda x: x != "")
    return F.when(F.col("measures").isNotNull() | F.col("common").isNotNull(), T.let(F.array_join(F.array_distinct(lines), "\n"), lambda c: F.when(c != "", c)))


def with_effective(levels: DataFrame) -> DataFrame:
    """Levels (doc_id, category, ordinal, sources, measures, common, ...) with ``effective``; the levels of one category of a plan, four at most, are one row of the expansion."""
    @F.pandas_udf(ArrayType(StringType()))
    def expanded(plans: pd.Series) -> pd.Series:
        return plans.map(lambda plan: expand([x if isinstance(x, dict) else x.asDict() for x in plan]))

    kept = [c for c in levels.columns if c not in ("doc_id", "category", "ordinal")]
    one = levels.groupBy("doc_id", "category").agg(F.sort_array(F.collect_list(F.struct("ordinal", F.struct(*kept).alias("of")))).alias("levels"))
    asked = F.transform("levels", lambda x: F.struct(x["ordinal"].alias("ordinal"), x["of"]["sources"].alias("sources"), x["of"]["measures"].alias("measures"), x["of"]["common"].alias("common")))
    one = one.withColumn("texts", expanded(asked)).select("doc_id", "category", F.explode(F.arrays_zip("levels", "texts")).alias("x"))
    return one.select("doc_id", "category", "x.levels.ordinal", "x.levels.of.*", F.col("x.texts").alias("effective"))

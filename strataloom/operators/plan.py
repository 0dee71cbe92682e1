"""A plan's results as a whole: the chapters that rules name, the eight levels, the action groups, and what a reader should look at."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import large, spread, written
from . import levels as L
from . import response as R
from . import sections as S

# Characters by which a chapter's heading may be longer than its name, and the level of one that is no heading.
LONGER, PLAIN_LEVEL = 20, 2


def _holds(norm: Column, aliases: list[str]) -> Column:
    """Whether a normal text holds a name; that of the second severity does not count inside the first's."""
    found = F.lit(False)
    for alias in aliases:
        found = found | T.fits_alias(norm, T.normalize(F.lit(alias)))
    return found


def chapter_words(code: str, sections: dict[str, list[str]]) -> Column:
    """Whether a block may open the chapter of a section by its own words, lines of contents aside."""
    norm, fits = F.col("norm"), F.lit(False)
    for k, alias in enumerate(sections[code]):
        fits = fits | (~_holds(norm, sections[code][:k]) & _holds(norm, [alias]) & (F.length(norm) <= F.length(T.normalize(F.lit(alias))) + LONGER))
    return _titled() & fits & ~norm.rlike(T.DIAGRAM_WORDS)


def _titled() -> Column:
    return (F.col("heading_level") > 0) | F.col("is_table")


def any_chapter(sections: dict[str, list[str]]) -> Column:
    """Whether a block is a heading or a table row that holds a name of any section."""
    return _titled() & _holds(F.col("norm"), [a for group in sections.values() for a in group])


def scoped(blocks: DataFrame, code: str, sections: dict[str, list[str]]) -> DataFrame:
    """The blocks of each document in the chapter that a configured section names, or all its blocks.

    A chapter opens at the only heading or table row that holds a name of the section and is little longer than it, lines
    of contents and diagrams apart. It ends at the next heading or row that holds a name of any section, or at a heading no
    deeper than its own. A document with no such heading, several, or nothing below it stays whole: sections narrow a
    search where they are sure and never lose text."""
    if not sections.get(code, []):
        return blocks
    b = blocks if "norm" in blocks.columns else blocks.withColumn("norm", T.normalize(F.col("text")))
    opens = (F.col(f"s_{code}") if f"s_{code}" in b.columns else chapter_words(code, sections)) & ~R.listed(b)
    named = F.col("s_any") if "s_any" in b.columns else any_chapter(sections)
    whole = Window.partitionBy("doc_id")
    at, level = F.col("block_idx"), F.when(F.col("heading_level") > 0, F.col("heading_level")).otherwise(PLAIN_LEVEL)
    b = b.withColumn("_opens", opens)
    first = F.min(F.when(F.col("_opens"), F.struct("block_idx", level.alias("level")))).over(whole)
    b = b.withColumns({"_n": F.sum(F.col("_opens").cast("int")).over(whole), "_from": first})
    ends = (at > F.col("_from.block_idx")) & (named | F.col("heading_level").between(1, F.col("_from.level")))
    b = b.withColumns({"_to": F.min(F.when(ends, at)).over(whole), "_last": F.max(at).over(whole)})
    alone = (F.col("_n") != 1) | (F.coalesce("_to", F.col("_last") + 1) <= F.col("_from.block_idx") + 1)
    inside = (at >= F.col("_from.block_idx")) & (at < F.coalesce("_to", F.col("_last") + 1))
    return b.where(alone | inside).select(*blocks.columns)


LINE = ("text", "heading_level", "is_table")


@dataclass(frozen=True)
class Lines:
    """Blocks (``said``) and the distinct lines that they are (``of``), told apart by ``line``."""

    said: DataFrame
    of: DataFrame


def lines(blocks: DataFrame, known: tuple[R.Level, ...], tails: list[str], markers: dict[str, tuple[str, ...]], sections: dict[str, list[str]], rules: DataFrame, more: Callable[[DataFrame], DataFrame] | None = None) -> Lines:
    """All that operators ask of a line by itself, worked out once for each distinct line, however many plans hold it. Blocks have what windows over documents need; ``ruled`` are a line's candidates for each rule.

    more: makes of the distinct lines (line, text, heading_level, is_table) further columns by ``line``, which blocks get too.
    Joins by lines sort; a line that very many plans hold makes a large partition, which adaptive execution splits."""
    d = spread(blocks.select(*LINE).distinct()).withColumn("line", F.monotonically_increasing_id())
    d = spread(written(R.said(d, tails, known, markers), "lines"))
    plain, parts, last = R.line_words(known, markers)
    plain |= {f"s_{code}": chapter_words(code, sections) for code, names in sections.items() if names} | ({"s_any": any_chapter(sections)} if sections else {})
    d = spread(written(d.withColumns(plain | parts).withColumns(last), "line-words"))
    every = d.select("line", *LINE)
    found = S.candidates(d.where("NOT m_diagram").select(F.col("line").alias("doc_id"), F.lit(0).alias("block_idx"), *LINE), rules)
    ruled = found.groupBy(F.col("doc_id").alias("line")).agg(F.collect_list(F.struct(*[c for c in found.columns if c not in ("doc_id", "block_idx", "norm", *LINE)])).alias("ruled"))
    own = d.withColumns({c: F.struct(*[e.alias(k) for k, e in R.category_words(c).items()]) for c in ("WARNING", "EMERGENCY")}).join(large(ruled), "line", "left")
    further = more(every) if more is not None else every.select("line")
    own = written(own.join(large(further), "line", "left"), "ruled-lines")
    asked = ["line", "heading", "condition", "contents", "numbered_end", "ruled", *[c for c in own.columns if c[:2] in ("s_", "x_") or c in further.columns and c != "line"]]
    placing = [F.struct(*[F.col(f"{c}.{k}").alias(k) for k in own.schema[c].dataType.names if k.startswith("p_") or k == "speaks"]).alias(c) for c in ("WARNING", "EMERGENCY")]
    named = own.select(*asked, *placing, *[F.col(c).alias(f"l_{c}") for c in LINE])
    same = [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in LINE]
    said = written(blocks.join(large(named), reduce(and_, same)).drop(*[f"l_{c}" for c in LINE]), "said")
    return Lines(said, own)


def in_category(found: Lines, category: str, code: str, sections: dict[str, list[str]]) -> DataFrame:
    """The blocks of ``lines`` as ``response.described`` has them for one category, in the chapter that a section names; documents that say nothing of the category's levels have none of them, whatever else they say, and are left out.

    Windows over documents have only what they need; the rest of what a line says joins them afterwards."""
    spoken = F.bool_or(F.col(f"{category}.speaks"))
    if category == "WARNING":
        spoken = spoken & F.bool_or("x_warn")  # no block is of the kind of warnings without the word
    docs = written(found.said.groupBy("doc_id").agg(spoken.alias("spoken")).where("spoken").select("doc_id"), "asked")
    b = scoped(found.said.join(docs, "doc_id", "left_semi"), code, sections)
    heights = ("heading", "condition", "heading_level", "is_table")
    b = R.placed(b.select("doc_id", "block_idx", "page", "line", *heights, "x_warn", "x_act", f"{category}.*"), (category,))
    own = [c for c in found.of.columns if c in ("text", "norm", "explicit", "overview", "lifecycle", "unit", "tail", "numbered_item", "is_condition_mark", "is_measure_mark", "opens_condition", "grades", "contents", "numbered_end") or c[:2] in ("m_", "w_", "e_") or c == f"c_{category}"]
    rest = found.of.select("line", *own, *[f"{category}.{c}" for c in ("keys", "alone", "asks", "head_keys")])
    b = b.drop(*[c for c in b.columns if c[:2] in ("p_", "x_") or c in ("speaks", "near")])
    return written(b.join(large(rest), "line").drop("line"), "described")


def section_candidates(said: DataFrame) -> DataFrame:
    """``sections.candidates`` of the blocks of ``lines``, with ``listed``: whether it is a line of contents."""
    return said.where("ruled IS NOT NULL").select("doc_id", "block_idx", *LINE, R.listed(said).alias("listed"), F.explode("ruled").alias("r")).select("doc_id", "block_idx", *LINE, "listed", "r.*")


def chapters(said: DataFrame) -> DataFrame:
    """doc_id and ``ruled``: for each rule that a document's blocks name matched_by of its best candidate and whether it is ambiguous, and whether lines of contents name it."""
    found = section_candidates(said).select("doc_id", "block_idx", "rule_code", "matched_by", "score", F.coalesce("listed", F.lit(True)).alias("left_out"), F.coalesce("listed", F.lit(False)).alias("listed"))
    clear = F.count_if(~F.col("left_out") & (F.col("matched_by") != "CONTEXT_FALLBACK")) > 1
    best = F.min(F.when(~F.col("left_out"), F.struct("score", "block_idx", "matched_by")))["matched_by"]
    rows = found.repartition("doc_id").groupBy("doc_id", "rule_code").agg(best.alias("matched_by"), clear.alias("ambiguous"), F.bool_or("listed").alias("listed"))
    return rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("rule_code", F.struct("matched_by", "ambiguous", "listed")))).alias("ruled"))


def unclear(docs: DataFrame, found: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, code, subject) by the ``chapters`` of documents.

    Lines of contents name no section; a rule that is only found in them, one with several clear candidates, and one of the
    type RESPONSE that is not found at all are warned of."""
    codes = rules.where("enabled").groupBy("rule_type", "rule_code").agg(F.min("canonical_name").alias("subject"))
    kinds = [(r["rule_type"], r["rule_code"], r["subject"]) for r in codes.collect()]  # configuration
    each = F.array(*[F.struct(F.lit(t).alias("rule_type"), F.lit(c).alias("rule_code"), F.lit(n).alias("subject")) for t, c, n in kinds])
    state = docs.join(large(found), "doc_id", "left").select("doc_id", "ruled", F.explode(each).alias("r")).select("doc_id", "r.*", F.col("ruled")[F.col("r.rule_code")].alias("at"))
    none = F.col("at.matched_by").isNull()
    said = F.when(none & F.col("at.listed"), F.lit("SECTION_ONLY_IN_CONTENTS")), F.when(none & (F.col("rule_type") == "RESPONSE"), F.lit("SECTION_MISSING"))
    codes_ = F.filter(F.array(F.when(~none & F.col("at.ambiguous"), F.lit("SECTION_AMBIGUOUS")), *said), lambda c: c.isNotNull())
    return state.select("doc_id", F.explode(codes_).alias("code"), "subject")


@dataclass(frozen=True)
class Results:
    """What is found in plans, a table each. Sections and groups are worked out where they are read."""

    sections: DataFrame
    levels: DataFrame
    groups: DataFrame
    warnings: DataFrame
    chapters: DataFrame
    docs: DataFrame
    said: DataFrame


def analyse(blocks: DataFrame, rules: DataFrame, more: Callable[[DataFrame], DataFrame] | None = None) -> Results:
    """All that a rule set finds in documents given by their blocks (doc_id, block_idx, page, text, heading_level, is_table).

    Levels of each category and action groups are looked for in the chapters that the rule set's sections name. Every
    document has eight levels; sections are the best for each document and rule (doc_id, rule_code, matched_by, block_idx,
    n_blocks, content); warnings tell which sections are unclear, missing or only listed, which levels are missing or found
    in part, and which documents have no response structure at all. chapters, docs and said (the blocks of ``lines``) are what traces need.
    more: further columns of distinct lines; see ``lines``."""
    named: dict[str, dict[str, list[str]]] = {}
    for r in rules.where("enabled").orderBy("rule_type", "group_order", "alias_order").collect():  # configuration
        named.setdefault(r["rule_type"], {}).setdefault(r["rule_code"], []).append(r["alias"])
    own = {code: tuple(v) for kind in ("RESPONSE", "WARNING") for code, v in named.get(kind, {}).items()}
    markers = {code: tuple(v) for code, v in named.get("MARKER", {}).items()}
    tails = [a for v in named.get("TAIL", {}).values() for a in v]
    known, sections = R.levels(own), named.get("SECTION", {})
    titled = rules.where("rule_type IN ('COMMAND', 'RESPONSE')")
    blocks = written(blocks.select("doc_id", "block_idx", "page", "text", "heading_level", "is_table"), "blocks")
    docs = written(blocks.select("doc_id").distinct(), "documents")
    found = lines(blocks, known, tails, markers, sections, titled, more)
    parts = []
    for category, code in (("WARNING", "warning_scope"), ("EMERGENCY", "emergency_scope")):
        b = in_category(found, category, code, sections)
        parts.append(R.found_levels(b, docs, tuple(v for v in known if v.category == category), markers))
    levels = written(parts[0].unionByName(parts[1]), "all-levels")
    groups = L.action_groups(scoped(blocks, "action_group_scope", sections), markers)
    said = found.said
    best = S.section_ends(S.best_candidates(section_candidates(said).where(~F.col("listed"))), blocks)
    chosen = best.select("doc_id", "rule_code", "matched_by", "block_idx").join(large(S.section_texts(best, blocks)), ["doc_id", "rule_code"])
    places = written(chapters(said), "chapters")
    unsure = R.complaints(levels).select("doc_id", "code", F.col("key").alias("subject"))
    return Results(chosen, levels, groups, unclear(docs, places, titled).unionByName(unsure), places, docs, said)

"""Text functions of the document engine, each from Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and word lists that results depend on.
FULL_WIDTH_DIGITS = "０１２３４５６７８９"
CJK_NUMERALS = "〇零一二三四五六七八九十百千万"
TRIGGER_WORDS = "发生|预计|达到|符合|出现|超过|低于|造成|可能发生|不能控|无法控"
ACTION_VERBS = "组织|开展|调度|派出|加强|负责|协调"
RESPONSE_ACTIONS = "组织|开展|调度|派出|加强|负责|协调|处置|救援|保障|报告|启动|实施|发布|通知|通报"
DIAGRAM_WORDS = "流程图|示意图|框架图|组织图"
LIFECYCLE = "响应(结束|终止|调整|解除)|^(结束|终止)"
ADJUSTMENTS = "必要时|可启动|建议启动|升级|降级|调整为|调整至|提升至|提高至|降为|降低至|转为"
OVERVIEW_PHRASES = "响应一般分为|响应分为|响应划分为|响应级别为|组织实施|负责实施"
LEVEL_TOKEN = "(?:IV|III|II|(?<!I)I(?!I)|[一二三四1-4])"
# An l or L in a leading section number with all of the number before it that no other l or L is in; a bare mark of what follows.
MISREAD = r"(^[0-9]+\.(?:[0-9I]|(?<=[0-9lLI])\.(?=[0-9lLI]))*|(?!^)\G(?:[0-9I]|(?<=[0-9lLI])\.(?=[0-9lLI]))*)[lL]"
STANDALONE = "^((启动|响应|发布)?条件|响应措施|应急措施|处置措施|协调措施)$"
NUMBERED_END = r".+\s+\d{1,3}$"
SEVERITIES = ("特别重大", "重大", "较大", "一般")


def _digits(c: Column) -> Column:
    return F.translate(c, FULL_WIDTH_DIGITS + "．", "0123456789.")


def _prefix(c: Column, pattern: str, frm: str, to: str) -> Column:
    """The leading match of ``pattern`` with characters exchanged, the rest as it is."""
    head = F.regexp_extract(c, pattern, 0)
    return F.concat(F.translate(head, frm, to), F.substring(c, F.length(head) + 1, F.length(c)))


def let(c: Column, f) -> Column:
    """``f`` of ``c``, which is evaluated once however often ``f`` uses it."""
    return F.transform(F.array(c), f)[0]


def clean(c: Column) -> Column:
    """Plain digits and spaces, white space collapsed, misread ones in a leading section number repaired; null is empty."""
    c = _digits(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(F.translate(c, " ﻿", " "), r"[\t\n\x0B\f\r ]+", " ")
    c = F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return let(c, lambda v: _prefix(v, r"^[0-9lLI]+(?:\.[0-9lLI]+)+", "lLI", "111"))


def split_lines(c: Column) -> Column:
    """The cleaned lines that are not blank."""
    lines = F.split(F.translate(F.coalesce(c, F.lit("")), "\u000b\f", "\n\n"), r"[\r\n]+")
    return F.filter(F.transform(lines, clean), lambda x: x != "")


def normalize(c: Column) -> Column:
    """The form in which rules are matched: no white space, colons, semicolons or brackets; one spelling of synonyms and numerals; upper case."""
    c = F.regexp_replace(_digits(F.coalesce(c, F.lit(""))), MISREAD, "$11")  # group 1, then the digit
    for old, new in (("应急反应", "应急响应"), ("反应行动", "响应行动"), ("反应措施", "响应措施"), ("反应程序", "响应程序")):
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.regexp_replace(c, r"[\t\n\x0B\f\r 　:：；;（）()\[\]【】]", "")
    for old, new in (("Ｉ", "I"), ("Ⅰ", "I"), ("Ⅱ", "II"), ("Ⅲ", "III"), ("Ⅳ", "IV")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.upper(c)


def normalize_field(c: Column) -> Column:
    """The form in which labels of an image are matched: without white space and colons."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s  -  -    　:：]", "")


def normalize_trace(c: Column) -> Column:
    """The form in which explain traces match: without white space, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))


def heading_level(c: Column) -> Column:
    """0 for body text, else 1 to 6, from the numbering of a line of at most 80 characters."""
    return let(clean(c), _numbered)


def _numbered(v: Column) -> Column:
    dotted = F.regexp_extract(v, r"^(\d+(?:\.\d+){1,5})(?:[、.\s　]+|(?=\p{IsHan})).{0,80}$", 1)
    single = v.rlike(r"^\d+[、.\s　]+.{0,80}$")
    return (
        F.when((v == "") | (F.length(v) > 80), 0)
        .when(v.rlike(rf"^第[{CJK_NUMERALS}0-9]+[章节篇条].{{0,80}}$"), 1)
        .when(dotted != "", F.least(F.lit(6), 1 + F.length(dotted) - F.length(F.replace(dotted, F.lit("."), F.lit("")))))
        .when(single, 1)
        .when(v.rlike(rf"^[{CJK_NUMERALS}]+[、.].{{0,80}}$"), 2)
        .otherwise(0)
    )


def style_level(style: Column, text: Column) -> Column:
    """Heading level of a styled paragraph: numbering in the text wins over the style's name."""
    own = heading_level(text)
    named = F.regexp_extract(F.coalesce(style, F.lit("")), r"(?i)(?:Heading|标题)\s*(\d+)", 1)
    return F.when(own > 0, own).when(named != "", F.greatest(F.lit(1), F.least(F.lit(6), named.cast("int")))).otherwise(0)


def starts_with_number(c: Column) -> Column:
    return c.rlike(rf"^(第[{CJK_NUMERALS}0-9]+[章节篇条]|[{CJK_NUMERALS}]+[、.]|\d+(?:\.\d+){{0,5}}[、.\s])")


def strip_section_number(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^\d+(?:\.\d+){0,4}[、.]?", ""), r"^[一二三四五六七八九十]+[、.]", "")


def is_contents(text: Column, page: Column, norm: Column | None = None) -> Column:
    """A line of a table of contents. norm: the text's normal form, where it is at hand."""
    return (normalize(text) if norm is None else norm).contains("目录") | text.rlike(r"\.{3,}\d*$") | (text.rlike(NUMBERED_END) & (page <= 3))


def is_diagram(c: Column) -> Column:
    return normalize(c).rlike(DIAGRAM_WORDS)


def is_lifecycle(c: Column) -> Column:
    return normalize(c).rlike(LIFECYCLE)


def is_condition(c: Column) -> Column:
    return c.rlike(TRIGGER_WORDS) & ~c.rlike(ACTION_VERBS)


def is_activation(c: Column) -> Column:
    return c.rlike(TRIGGER_WORDS) & c.rlike("(启动|实施|进入|发布).{0,30}(响应|预警)")


def is_direct_definition(c: Column) -> Column:
    return normalize(c).rlike("^(?:出现|符合|达到).{0,30}(?:情况|情形|条件|标准).{0,20}(?:时|之一).{0,20}(?:启动|实施|进入).{0,20}(?:响应|预警).{2,}$")


def is_overview(c: Column) -> Column:
    """A statement about several levels that is no activation condition."""
    return let(normalize(c), is_overview_form)


def is_overview_form(v: Column) -> Column:
    """``is_overview`` of a normal text."""
    return ~is_activation(v) & (F.regexp_count(v, F.lit(LEVEL_TOKEN + "级(?:应急)?响应")) >= 2) & v.rlike(OVERVIEW_PHRASES)


def is_action(c: Column) -> Column:
    return c.rlike(RESPONSE_ACTIONS)


def is_adjustment(c: Column, descriptive: bool = False) -> Column:
    return normalize(c).rlike(ADJUSTMENTS if descriptive else ADJUSTMENTS + "|视情")


def is_standalone_marker(c: Column) -> Column:
    return normalize(c).rlike(STANDALONE)


def level_ordinal(c: Column) -> Column:
    """1 to 4 for a level token in any script, else 0."""
    v = F.upper(F.trim(F.replace(c, F.lit("级"), F.lit(""))))
    return F.when(v.isin("一", "1", "I", "Ⅰ"), 1).when(v.isin("二", "2", "II", "Ⅱ"), 2).when(v.isin("三", "3", "III", "Ⅲ"), 3).when(v.isin("四", "4", "IV", "Ⅳ"), 4).otherwise(0)


def activation_targets(c: Column) -> Column:
    """The levels (ordinals, ascending) that a text says are activated."""
    spans = F.regexp_extract_all(normalize(c), F.lit("((?:启动|实施|进入|发布).{0,40}?(?:响应|预警))"), 1)
    tokens = F.flatten(F.transform(spans, lambda s: F.regexp_extract_all(s, F.lit("(" + LEVEL_TOKEN + ")级"), 1)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(tokens, level_ordinal), lambda x: x > 0)))


def mentions_severity(c: Column, ordinal: int) -> Column:
    """Whether a severity word of that rank occurs; the second rank's word inside the first's does not count."""
    v = c if ordinal == 1 else F.replace(c, F.lit(SEVERITIES[0]), F.lit(""))
    return v.contains(SEVERITIES[ordinal - 1])


def group_key(name: Column) -> Column:
    """A stable key of an action group's name."""
    return F.concat(F.lit("action_group_"), F.substring(F.sha2(F.regexp_replace(name, r"[\s:：。；;（）()、，,]", "").cast("binary"), 256), 1, 16))


def clip(c: Column, most: int, tail: str = "") -> Column:
    """At most ``most`` characters, ending in ``tail`` where something was cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - len(tail)), F.lit(tail))).otherwise(c)


def or_default(c: Column, default: Column) -> Column:
    """``default`` for null and blank."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), default)


def fits_alias(norm: Column, alias: Column) -> Column:
    """Whether a normal text holds a normal name: names of Roman levels only between other signs, that of the second severity not inside the first's."""
    roman = alias.rlike("^(?:I{1,3}|IV)级(?:应急)?响应$")
    inside = (alias == SEVERITIES[1] + "响应") & F.contains(norm, F.lit(SEVERITIES[0] + "响应"))
    alone = F.regexp_like(norm, F.concat(F.lit("(^|[^IV])"), alias, F.lit("($|[^IV])")))
    return ~inside & F.when(roman, alone).otherwise(F.contains(norm, alias))


def segment_heading_level(c: Column, responses: tuple[str, ...], tails: tuple[str, ...]) -> Column:
    """The level that a line has as a heading where nothing marks it as one: 3 for a bare name of a response level, 2 for a tail, 1 to 3 by its numbering, else 0."""

    def level(n: Column) -> Column:
        tail = F.lit(False)
        for t in tails:
            tail = tail | n.contains(t)
        return (
            F.when((F.trim(F.coalesce(c, F.lit(""))) == "") | (F.length(c) > 80), 0)
            .when((F.length(n) <= 16) & n.isin(*responses), 3)
            .when(tail, 2)
            .when(c.rlike(rf"^第[{CJK_NUMERALS}0-9]+[章节篇条]"), 1)
            .when(c.rlike("^[一二三四五六七八九十]+[、.]"), 2)
            .when(c.rlike(r"^\d+(?:\.\d+){0,3}[、.\s]"), F.when(c.contains("."), 3).otherwise(2))
            .otherwise(0)
        )

    return let(normalize(c), level)


def is_page_note(c: Column) -> Column:
    """A note of a table's page: on what "above" and "below" include, or one that says it is a note."""
    v = F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""), F.lit("应急"), F.lit(""))
    return v.rlike("^注[：:]") | (v.contains("以上") & v.contains("包括本数")) | (v.contains("以下") & v.contains("不包括本数"))

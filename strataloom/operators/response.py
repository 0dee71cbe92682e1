"""Warning and response levels of plans: four and four rows a document, with what activates each and what it calls for.

Blocks are doc_id, block_idx, page, text, heading_level, is_table. Levels are a closed list of eight, so what
depends on one is a column expression; a level's window is a join of its first block with the blocks after it; and
what a block of a window is, condition or measure, is the last decision before it, a window function."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import large, written
from . import events as E
from . import extras as X
from . import levels as L
from . import measures as M

# The levels with their colours and the names that always hold, configured ones aside.
WARNINGS = (("red", "红色", "一", "I"), ("orange", "橙色", "二", "II"), ("yellow", "黄色", "三", "III"), ("blue", "蓝色", "四", "IV"))
SEVERITY_TOKENS = ("特别重大(?:级)?", "(?<!特别)重大(?:级)?", "较大(?:级)?", "一般(?:级)?")
# Blocks and characters of a window at most; blocks back that context reaches; heads that are short lines.
WINDOW_BLOCKS, WINDOW_CHARS = 80, 8000
CONTEXT_BLOCKS = 12
SHORT_LINE, NEAR_LINE, CONTINUED, ACTIVATION_LINE = 30, 30, 24, 32
# How levels are listed, and what is said of activation.
LISTED = "([一二三四](?:级)?(?:[、,，/和及与或][一二三四](?:级)?)+)(?:应急)?响应"
ROMAN_LISTED = "(?i)((?:Ⅰ|Ⅱ|Ⅲ|Ⅳ|IV|III|II|I|[一二三四1-4])(?:级)?(?:[、,，/和及与](?:Ⅰ|Ⅱ|Ⅲ|Ⅳ|IV|III|II|I|[一二三四1-4])(?:级)?)+)(?:共[一二三四1-4]级)?(?:应急)?(?:响应|反应)"
# How the four levels are written, and what stands between them in a list.
TOKENS, SIGN = ("Ⅰ|I|1|一", "Ⅱ|II|2|二", "Ⅲ|III|3|三", "Ⅳ|IV|4|四"), "[、,，/和及与]"
TARGETS = "((?:启动|实施|进入|发布).{0,40}?(?:响应|预警))"
WARNING_UNIT = r"^(?:当)?发布.{1,40}预警(?:信息)?(?:后|时).+|预警响应(?:措施|行动|程序).+"
WARNING_HEAD = "^((?:当)?发布.{1,80}?预警(?:信息)?(?:后|时))"
WARNING_SPLIT = "(?s)^((?:当)?发布.{1,80}?预警(?:信息)?(?:后|时))[，,：:](.+)$"
WARNING_INTRODUCTION = "^(?:当)?符合(?:下列)?(?:条件|情况|情形)(?:之一)?时?可?发布.{0,20}预警"
INLINE_SPLIT = "(?s)^(.{1,600}?(?:启动|实施|进入|发布).{0,30}(?:响应|预警))[，,。；;](.+)$"
REFERENCE = "符合.{0,20}(?:响应|预警)条件时"
STARTUP = "(?:按照|按|履行|执行).{0,20}(?:程序|流程).{0,20}(?:启动|实施|进入).{0,20}(?:响应|预警)|(?:启动|响应)(?:程序|流程)$"
REFERENCE_PROCEDURE = "符合.{0,30}(?:响应|预警)条件时.*(?:启动|实施|进入|发布).{0,30}(?:响应|预警)"
NUMBERED_ITEM = r"^(?:[（(]?\d{1,2}[）)、]|\d{1,2}[.．]\s+).+"
CONDITION_MARKERS = ("启动条件", "响应条件", "发布条件")
MEASURE_MARKERS = ("响应措施", "应急措施", "处置措施", "协调措施", "响应行动", "响应程序")
MORE_CONDITION_MARKERS = ("灾害损失情况",)
GRADE_MARKERS = ("响应分级", "预警分级")
COLON_MEASURES = "(?:以下)?(?:响应|应急|处置|协调)?措施[:：]$"
BASIS = "基础上"


def _plain(alias: str) -> str:
    """A configured name in the form in which texts are matched (``T.normalize``)."""
    for old, new in (("应急反应", "应急响应"), ("反应行动", "响应行动"), ("反应措施", "响应措施"), ("Ⅰ", "I"), ("Ⅱ", "II"), ("Ⅲ", "III"), ("Ⅳ", "IV")):
        alias = alias.replace(old, new)
    return "".join(c for c in alias if c not in " 　:：；;（）()[]【】").upper()


@dataclass(frozen=True)
class Level:
    key: str
    category: str
    ordinal: int
    title: str
    color: str | None
    aliases: tuple[str, ...]

    @property
    def numeral(self) -> str:
        return self.title[0]


def levels(configured: dict[str, tuple[str, ...]] | None = None) -> tuple[Level, ...]:
    """The eight levels. configured: further names by key."""
    out = []
    for k, (color, name, numeral, roman) in enumerate(WARNINGS, 1):
        own = (f"{numeral}级预警", f"{roman}级预警", f"{name}预警", name)
        out.append(Level(f"warning_level_{k}", "WARNING", k, f"{numeral}级预警", color, own))
    for k, (_, _, numeral, roman) in enumerate(WARNINGS, 1):
        own = (f"{numeral}级响应", f"{numeral}级应急响应", f"{roman}级响应", f"{T.SEVERITIES[k - 1]}响应")
        out.append(Level(f"level_{k}", "EMERGENCY", k, f"{numeral}级响应", None, own))
    more = configured or {}
    return tuple(Level(v.key, v.category, v.ordinal, v.title, v.color, tuple(dict.fromkeys([*v.aliases, *map(_plain, more.get(v.key, ()))]))) for v in out)


LEVELS = levels()


def _name_pattern(level: Level) -> str:
    """What names a level in a normal text by itself: a name, or its grade beside the word for a response or warning. No match crosses a line end."""
    parts = []
    for a in level.aliases:
        if a == f"{T.SEVERITIES[1]}响应":
            parts.append(rf"(?<![^\n])(?![^\n]*\Q{T.SEVERITIES[0]}响应\E)[^\n]*\Q{a}\E")
        elif a.startswith("I") and a.endswith("响应"):
            parts.append(f"(?:^|[^IV]){a}(?:$|[^IV])")
        else:
            parts.append(_quoted(a))
    roman = ("(?<!I)I", "(?<!I)II", "(?<!I)III", "IV")[level.ordinal - 1]
    token = f"(?:{level.numeral}级|{level.ordinal}级|{roman}级|{SEVERITY_TOKENS[level.ordinal - 1]})"
    response = "(?:预警响应|预警)" if level.category == "WARNING" else "(?:应急)?(?:响应|反应)"
    return "|".join([*parts, rf"{token}\p{{IsHan}}{{0,12}}{response}|{response}(?:行动|的?启动)?{token}"])


def _name_words(level: Level) -> tuple[str, ...]:
    """Words of which each match of the level's pattern holds one."""
    tokens = (f"{level.numeral}级", f"{level.ordinal}级", "IV级" if level.ordinal == 4 else f"{'I' * level.ordinal}级", T.SEVERITIES[level.ordinal - 1])
    return tokens + tuple(a for a in level.aliases if not any(t in a for t in tokens))


def _ordinal_keys(tokens: Column, of: tuple[Level, ...]) -> list[tuple[str, Column]]:
    """For each level whether a list of level tokens, joined by a list's signs, holds its own."""
    return [(v.key, tokens.rlike(f"(?i)(?:^|{SIGN})(?:{TOKENS[v.ordinal - 1]})级?(?:{SIGN}|$)")) for v in of]


def names(norm: Column, raw: Column, of: tuple[Level, ...]) -> Column:
    """Keys of the levels that a text names: by a name, in a list of levels, as a grade of response, or as the response's grade.

    One pattern a level, over what all of them need once. Texts may be several, joined by line ends: no pattern crosses one."""
    words = "|".join(["响应|反应|预警", *dict.fromkeys(_quoted(a) for v in of for a in v.aliases if not any(w in a for w in ("响应", "反应", "预警")))])
    joined = lambda c, pattern, k: F.array_join(F.regexp_extract_all(c, F.lit(pattern), F.lit(k)), "、")
    tokens = F.concat_ws("、", joined(raw, ROMAN_LISTED, 1), joined(norm, L.INVERSE_BRIDGE, 2))
    parts = F.struct(norm.alias("norm"), tokens.alias("tokens"), joined(norm, LISTED, 1).alias("listed"))

    def found(x: Column) -> Column:
        graded = dict(_ordinal_keys(x["tokens"], of))
        listed = lambda v: x["listed"].contains(v.numeral) if v.category == "EMERGENCY" else F.lit(False)
        return _keys([(v.key, (E.holds(x["norm"], _name_words(v)) & x["norm"].rlike(_name_pattern(v))) | listed(v) | graded[v.key]) for v in of])

    return F.when(norm.rlike(words), T.let(parts, found)).otherwise(F.array().cast("array<string>"))


def targets(text: Column, of: tuple[Level, ...]) -> Column:
    """Keys of the levels that a normal text, or several joined by line ends, says are activated."""
    return T.let(F.array_join(F.regexp_extract_all(text, F.lit(TARGETS), F.lit(1)), "\n"), lambda t: names(t, t, of))


def _any(flags: list[Column]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def _keys(flags: list[tuple[str, Column]]) -> Column:
    return F.filter(F.array(*[F.when(f, F.lit(k)) for k, f in flags]), lambda k: k.isNotNull())


def _together(raw: Column, level: Level, others: list[Level]) -> Column:
    """Whether the text names the level next to another one, joined by a list's sign."""
    own, rest = "|".join(map(_quoted, level.aliases)), "|".join(_quoted(a) for o in others for a in o.aliases)
    sign = ".{0,4}[、及和与/].{0,4}"
    return raw.rlike(f"(?:{own}){sign}(?:{rest})|(?:{rest}){sign}(?:{own})")


def _quoted(alias: str) -> str:
    return rf"\Q{alias}\E"


def _whole(text: Column, level: Level, before: str) -> Column:
    """Whether a text is a name of the level, after one of the words ``before``, and nothing else."""
    return text.rlike(rf"\A(?:{before})(?:{'|'.join(map(_quoted, level.aliases))})\z")


def _marked(norm: Column, raw: Column, heading: Column, markers: tuple[str, ...]) -> Column:
    """Whether a block is a mark of what follows: it holds a marker and is one alone, a heading, ends in "measures:", or begins with it."""
    held = "|".join(map(_quoted, markers))
    return norm.rlike(held) & (norm.rlike(T.STANDALONE) | heading | F.trim(raw).rlike(COLON_MEASURES) | T.strip_section_number(norm).rlike(f"^(?:{held})"))


def said(blocks: DataFrame, tails: list[str], known: tuple[Level, ...] = LEVELS, markers: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The blocks with what each says by itself: the levels it names, whether it is a condition, an activation, a heading and so on."""
    markers = markers or {}
    conditions, measures = (own + tuple(map(_plain, markers.get(code, ()))) for own, code in ((CONDITION_MARKERS, "activation_condition"), (MEASURE_MARKERS, "response_measure")))
    raw, norm, heading = F.col("text"), F.col("norm"), F.col("heading_level") > 0
    b = blocks.withColumn("norm", T.normalize(raw)).withColumn("keys", names(norm, raw, known))
    head = F.regexp_extract(F.trim(raw), WARNING_HEAD, 1)
    b = b.withColumns({
        "heading": heading, "condition": T.is_condition(raw), "explicit": T.is_activation(raw), "overview": T.is_overview_form(norm), "lifecycle": norm.rlike(T.LIFECYCLE), "head_norm": T.normalize(head),
        "alone": T.let(T.strip_section_number(norm), lambda n: _keys([(v.key, _whole(n, v, "|启动|实施|进入")) for v in known])),
        "asks": F.when(T.is_activation(raw), targets(norm, known)).otherwise(F.array().cast("array<string>")),
        "unit": norm.rlike(WARNING_UNIT), "tail": norm.rlike("|".join(map(_quoted, tails))) if tails else F.lit(False),
        "numbered_item": F.trim(raw).rlike(NUMBERED_ITEM) & (T.is_condition(raw) | T.is_action(raw) | F.trim(raw).rlike("[。；;]$")),
        "is_condition_mark": _marked(norm, raw, heading, conditions), "is_measure_mark": _marked(norm, raw, heading, measures), "opens_condition": _marked(norm, raw, heading, conditions + MORE_CONDITION_MARKERS), "grades": _marked(norm, raw, heading, conditions + GRADE_MARKERS),
    })
    return b.withColumn("head_keys", F.when(head != "", names(F.col("head_norm"), head, tuple(v for v in known if v.category == "WARNING"))).otherwise(F.array().cast("array<string>"))).drop("head_norm")


def placed(b: DataFrame, categories: tuple[str, ...] = ("WARNING", "EMERGENCY")) -> DataFrame:
    """Blocks of ``said`` with what the blocks around them make of them; of what a block says only ``place_words`` are asked, if they are there. Windows of other categories than ``categories`` have no stops."""
    have, heading, none = _have(b), F.col("heading"), F.array().cast("array<string>")
    own = place_words()
    b = X.category(b)
    w = Window.partitionBy("doc_id").orderBy("block_idx")
    before = lambda c, k=1: F.lag(c, k).over(w)
    continued = F.coalesce(before("condition"), F.lit(False)) & have("p_continues", own["p_continues"])
    b = b.withColumns({"continued": continued, "near": have("p_near", own["p_near"]), "own_level": F.when(heading, F.col("heading_level")).otherwise(F.coalesce(F.last(F.when(heading, F.col("heading_level")), ignorenulls=True).over(w.rowsBetween(-WINDOW_BLOCKS, -1)), F.lit(0)))})
    near_keys = F.array_union(F.coalesce(before("near"), none), F.when(~F.coalesce(before("heading"), F.lit(False)), F.coalesce(before("near", 2), none)).otherwise(none))
    # The context of a block: the nearest mark among the blocks before it that is of one kind only.
    b = b.withColumn("near_keys", near_keys).withColumn("context", F.last(have("p_mark", own["p_mark"]), ignorenulls=True).over(w.rowsBetween(-CONTEXT_BLOCKS, 0)))
    # The next block that ends a window of either category, whatever its anchor is; behind the document's last one without any.
    later = Window.partitionBy("doc_id").orderBy(F.desc("block_idx")).rowsBetween(Window.unboundedPreceding, -1)
    stops = lambda c: have(f"p_ends_{c}", own[f"p_ends_{c}"]) | (have(f"p_heads_{c}", own[f"p_heads_{c}"]) & ~F.col("continued"))
    stop = lambda c: F.coalesce(F.last(F.when(stops(c), F.col("block_idx")), ignorenulls=True).over(later), F.max("block_idx").over(later) + 1, F.col("block_idx") + 1)
    return b.withColumns({f"{c.lower()}_stop": stop(c) if c in categories else F.lit(None).cast("int") for c in ("WARNING", "EMERGENCY")})


def place_words(keys: Column | None = None, alone: Column | None = None) -> dict[str, Column]:
    """What ``placed`` asks of a block of ``said``: whether it may continue a condition, the levels it names as a short line, the mark it is of what follows, and whether it ends the window of a level that began before it, by its heading (if it continues no condition) or otherwise, whatever the window's anchor is."""
    norm, heading, keys, alone = F.col("norm"), F.col("heading"), F.col("keys") if keys is None else keys, F.col("alone") if alone is None else alone
    ends = F.col("tail") | _of_category(alone, "EMERGENCY") | F.col("lifecycle")
    unit = F.col("unit") & ((F.size("head_keys") > 0) | (F.size(F.filter(keys, lambda k: F.startswith(k, F.lit("warning_")))) > 1))
    return {
        "p_continues": ~F.col("explicit") & (F.length("norm") <= CONTINUED) & norm.contains("响应") & (norm.contains("启动") | F.startswith(norm, F.lit("动"))),
        "p_near": F.when(heading | F.col("is_table") | (F.length("text") <= NEAR_LINE), keys).otherwise(F.array().cast("array<string>")),
        "p_mark": F.when(F.col("grades") != F.col("is_measure_mark"), F.when(F.col("grades"), "CONDITION").otherwise("MEASURE")),
        **{f"p_heads_{c}": _of_category(keys, c) & ~F.col("condition") & (heading | F.col("is_table") | _of_category(alone, c)) for c in ("WARNING", "EMERGENCY")},
        "p_ends_WARNING": ends | unit, "p_ends_EMERGENCY": ends,
    }


def described(blocks: DataFrame, tails: list[str], known: tuple[Level, ...] = LEVELS, markers: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The blocks with what each says by itself and by the blocks around it: the levels it names, whether it is a condition, an activation, a heading and so on."""
    return placed(said(blocks, tails, known, markers))


def _of_category(keys: Column, category: str) -> Column:
    return F.exists(keys, lambda k: F.startswith(k, F.lit("warning_")) == (category == "WARNING"))


def _compatible(category: str) -> Column:
    warn, act = F.col("norm").contains("预警"), E.holds(F.col("norm"), ("应急响应", "应急反应"))
    nearest = F.coalesce(F.col("nearest"), F.lit(""))
    if category == "WARNING":
        return warn | (nearest == "WARNING")
    return ~(warn & ~F.col("norm").contains("应急响应")) & ((nearest != "WARNING") | act)


def mentions(known: DataFrame, of: tuple[Level, ...] = LEVELS) -> DataFrame:
    """(doc_id, block_idx, key, category, ordinal, role): blocks that speak of a level, which either give its condition at once (EXPLICIT) or open its window (ANCHOR)."""
    fits = F.when(F.col("category") == "WARNING", _compatible("WARNING")).otherwise(_compatible("EMERGENCY"))
    asked = F.when((F.col("category") == "WARNING") & (F.size("head_keys") > 0), F.col("head_keys")).otherwise(F.col("asks"))
    own, have = mention_words(of), _have(known)
    rows = known.where(~listed(known) & ~have("m_diagram", own["m_diagram"]) & ~F.col("continued"))
    # a block that maps several events to levels is read sentence by sentence, as bridges
    rows = rows.withColumns({c: have(c, own[c]) for c in ("m_mapped", "m_bridged")}).withColumn("key", F.explode("keys"))
    rows = rows.withColumns({"category": F.when(F.startswith("key", F.lit("warning_")), "WARNING").otherwise("EMERGENCY"), "ordinal": F.substring("key", -1, 1).cast("int")}).where("NOT m_mapped OR category = 'WARNING'").where(fits).where((F.size(asked) == 0) | F.array_contains(asked, F.col("key")))
    several = F.size(F.filter("keys", lambda k: F.startswith(k, F.lit("warning_")) == (F.col("category") == "WARNING"))) > 1
    direct = F.col("explicit") & (have("m_direct", own["m_direct"]) | (F.coalesce(F.col("context"), F.lit("")) == "CONDITION") | several) & ~F.array_contains("near_keys", F.col("key")) & ~F.col("lifecycle")
    role = F.when(direct, "EXPLICIT").when(_primary(of, rows), "ANCHOR")
    return rows.withColumn("role", role).where("role is not null").drop(*(c for c in rows.columns if c[:2] in ("m_", "w_", "e_", "c_", "x_")))


def _have(df: DataFrame):
    """A column that ``df`` has already, else an expression for it."""
    return lambda name, other: F.col(name) if name in df.columns else other


def listed(blocks: DataFrame) -> Column:
    """Whether a block is a line of contents, by what its line says (``line_words``), if that is known."""
    if "contents" in blocks.columns:
        return F.col("contents") | (F.col("numbered_end") & (F.col("page") <= 3))
    return T.is_contents(F.col("text"), F.col("page"), *[F.col(c) for c in ("norm",) if c in blocks.columns])


def mention_words(of: tuple[Level, ...]) -> dict[str, Column]:
    """What a block's own words say of levels: whether it is a diagram's, maps several events to levels, or defines a condition, and the levels its bridges lead to."""
    norm, text = F.col("norm"), F.col("text")
    mapped = norm.rlike(E.DESCRIBED) & (F.size(E.described_bridges(text, tuple(v for v in of if v.category == "EMERGENCY"), targets)) > 1)
    return {"m_diagram": norm.rlike(T.DIAGRAM_WORDS), "m_mapped": mapped, "m_bridged": _bridged(of), "m_direct": T.is_direct_definition(text)}


def opening_words(of: tuple[Level, ...]) -> dict[str, Column]:
    """Keys of the levels that a block activates in a few words, lists beside others, or names and says no more."""
    return {name: _keys([(v.key, test(v)) for v in of]) for name, test in _openings(of).items()}


def line_words(of: tuple[Level, ...], markers: dict[str, tuple[str, ...]] | None = None) -> list[dict[str, Column]]:
    """What the operators ask of a line of ``said`` wherever it stands, by steps of which each may use those before it. Columns go by who asks: ``mentions`` (m_), ``classified`` (w_), ``events`` (e_), ``measures`` (c_), ``extras`` (x_)."""
    norm, text, none = F.col("norm"), F.col("text"), F.array().cast("array<string>")
    spoken = F.size("keys") > 0  # of other blocks no mention is asked
    own, opening = mention_words(of), opening_words(of)
    plain = {"contents": T.is_contents(text, F.lit(4), norm), "numbered_end": text.rlike(T.NUMBERED_END), "m_diagram": own.pop("m_diagram"), **X.kinds(norm), **{f"c_{c}": M.opens_common(c) for c in ("WARNING", "EMERGENCY")}}
    mentioned = {c: F.when(spoken, e).otherwise(none if c == "m_bridged" or c in opening else F.lit(False)) for c, e in (own | opening).items()}
    grades = E.grade_words(of, tuple(map(_plain, (markers or {}).get("activation_condition", ()))))
    return [plain | mentioned, window_parts() | E.sign_words() | {f"e_{c}": e for c, e in grades.items()}, window_words() | {"e_bridges": E.all_bridges(of, targets, F.col("e_told"), F.col("e_mapped"))}]


def category_words(category: str) -> dict[str, Column]:
    """What lines of ``said`` say of one category alone, for ``placed`` and ``mentions`` of its levels only: keys, and ``speaks``, whether a line may be evidence of a level."""
    own = {c: F.filter(c, lambda k: F.startswith(k, F.lit("warning_")) == (category == "WARNING")) for c in ("keys", "alone", "asks", "head_keys")}
    speaks = F.size(own["keys"]) > 0
    words = own | {c: e for c, e in place_words(own["keys"], own["alone"]).items() if not c.startswith(("p_heads", "p_ends")) or c.endswith(category)}
    return words | {"speaks": speaks | (F.size("e_bridges") > 0) if category == "EMERGENCY" else speaks}


def _bridged(of: tuple[Level, ...]) -> Column:
    """Keys of the levels to which a block's bridges lead, forwards or inverted; adjustments of a running response do not count."""
    norm = F.col("norm")
    spans = lambda pattern: F.array_join(F.filter(F.regexp_extract_all(norm, F.lit(f"({pattern})"), F.lit(1)), lambda s: ~s.rlike(T.ADJUSTMENTS + "|视情")), "\n")
    back = F.array_join(F.regexp_extract_all(spans(L.INVERSE_BRIDGE), F.lit(L.INVERSE_BRIDGE), F.lit(2)), "、")
    return F.when(norm.rlike("响应|反应"), F.array_union(targets(spans(L.BRIDGE), of), T.let(back, lambda t: _keys(_ordinal_keys(t, of))))).otherwise(F.array().cast("array<string>"))


def _openings(of: tuple[Level, ...]) -> dict:
    """Tests of a block's own words by level; see ``_primary``."""
    norm, raw = F.col("norm"), F.col("text")

    def activates(v: Level) -> Column:
        value = T.strip_section_number(norm)
        return (F.length(value) <= ACTIVATION_LINE) & _whole(value, v, "启动|实施|进入|执行")

    def beside(v: Level) -> Column:
        others = [o for o in of if o.category == v.category and o.key != v.key]
        in_list = F.exists(F.regexp_extract_all(norm, F.lit(LISTED), 1), lambda s: s.contains(v.numeral)) if v.category == "EMERGENCY" else F.lit(False)
        return in_list | _together(raw, v, others)

    return {"m_activated": activates, "m_beside": beside, "m_bare": lambda v: _whole(T.strip_section_number(norm), v, "")}


def _primary(of: tuple[Level, ...], rows: DataFrame) -> Column:
    """Whether a block that names the level of ``key`` opens its window; the first test that applies decides."""
    key, tests = F.col("key"), _openings(of)
    holds = lambda name: F.array_contains(name, key) if name in rows.columns else F.coalesce(*[F.when(key == v.key, tests[name](v)) for v in of])
    return (
        F.when(F.col("lifecycle") | F.col("overview"), False)
        .when(F.array_contains("m_bridged", key) | holds("m_activated"), True)
        .when(F.col("condition"), False)
        .when(F.col("heading") | F.col("is_table"), True)
        .when(holds("m_beside"), (F.col("category") == "EMERGENCY") | F.col("unit"))
        .otherwise(holds("m_bare"))
    )


def _decision(kind: str | None, structured: bool) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(structured).alias("structured"))


def _begins() -> Column:
    """What the blocks of an anchor's window are before any of them decides."""
    warning = F.col("category") == "WARNING"
    condition, measure, loose = _decision("CONDITION", True), _decision("MEASURE", True), _decision("MEASURE", False)
    plain_heading = ~F.col("anchor_table") & (F.col("anchor_heading") > 0) & ~F.col("anchor_text").contains("条件") & F.col("anchor_norm").rlike(r"^\d+(?:\.\d+){1,4}.*响应")
    return (
        F.when(F.col("anchor_condition"), condition)
        .when(F.col("anchor_measure"), measure)
        .when(plain_heading, F.lit(None))
        .when(F.col("anchor_context") == "CONDITION", condition)
        .when(F.col("anchor_context") == "MEASURE", measure)
        .when(warning & F.col("anchor_text").contains("预警") & ~F.col("anchor_text").contains("响应"), _decision("CONDITION", False))
        .when(F.col("anchor_text").rlike("(启动|实施).{0,12}(响应|预警响应)"), loose)
    )


def spread_anchors(anchors: DataFrame) -> DataFrame:
    """A row for each anchor and each place its window may hold: WINDOW_BLOCKS at most, up to the next block that ends any window of its category."""
    a = anchors.select("doc_id", "key", "category", "ordinal", F.col("block_idx").alias("start"), F.col("own_level").alias("anchor_level"), F.col("heading_level").alias("anchor_heading"), F.col("is_table").alias("anchor_table"), F.col("text").alias("anchor_text"), F.col("norm").alias("anchor_norm"), F.col("context").alias("anchor_context"), F.col("is_condition_mark").alias("anchor_condition"), F.col("is_measure_mark").alias("anchor_measure"), F.when(F.col("category") == "WARNING", F.col("warning_stop")).otherwise(F.col("emergency_stop")).alias("stop"))
    a = a.withColumn("begins", _begins()).drop("anchor_condition", "anchor_measure", "anchor_context", "anchor_text")
    last = F.col("start") + WINDOW_BLOCKS - 1
    return a.withColumn("block_idx", F.explode(F.sequence(F.col("start"), F.least(last, F.col("stop") - 1)))).drop("stop")


def windows(known: DataFrame, anchors: DataFrame) -> DataFrame:
    """The blocks of each anchor's window, the anchor's own included: to the next level's heading, a tail, a heading no deeper than the anchor's, the end of its table, or the bound of blocks or characters."""
    rows = large(spread_anchors(anchors)).join(known.drop("warning_stop", "emergency_stop"), ["doc_id", "block_idx"])
    w = Window.partitionBy("doc_id", "key", "start").orderBy("block_idx")
    later = F.col("block_idx") > F.col("start")
    outer = (F.col("anchor_level") > 0) & F.col("heading") & (F.col("heading_level") <= F.col("anchor_level")) & (F.col("block_idx") > F.col("start") + 1) & ~F.col("numbered_item")
    chars = F.sum(F.when(later, F.length("text")).otherwise(0)).over(w)
    ends = later & ((chars > WINDOW_CHARS) | (F.col("anchor_table") & ~F.col("is_table")) | outer)
    return rows.withColumn("over", F.max(ends.cast("int")).over(w)).where("over = 0")


def _part(kind: str, structured: bool, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(structured).alias("structured"), F.trim(text).alias("text"))


def window_parts() -> dict[str, Column]:
    """The parts into which a block of a window may be split; texts that hold no word that a split needs are not split."""
    raw = F.trim(F.col("text"))
    split = lambda words, pattern, k: F.when(raw.rlike(words), F.regexp_extract(raw, pattern, k)).otherwise("")
    return {
        "w_warned": split("预警", WARNING_SPLIT, 1), "w_told": F.trim(split("预警", WARNING_SPLIT, 2)), "w_done": split("发生", L.TRIGGER_SPLIT, 2),
        "w_starts": split("启动|实施|进入|发布", INLINE_SPLIT, 1), "w_goes_on": split("启动|实施|进入|发布", INLINE_SPLIT, 2),
    }


def window_words() -> dict[str, Column]:
    """What a block of a window says by itself, split by ``window_parts``."""
    raw, norm, starts = F.trim(F.col("text")), F.col("norm"), F.col("w_starts")
    return {
        "w_short": (F.length(raw) <= SHORT_LINE) & ~raw.rlike("[。；;]"), "w_numbered": T.starts_with_number(raw), "w_inner": T.normalize(T.strip_section_number(raw)), "w_inline": (F.col("w_goes_on") != "") & T.is_activation(starts) & ~starts.rlike(REFERENCE),
        "w_introduces": norm.rlike(WARNING_INTRODUCTION), "w_startup": norm.rlike(STARTUP), "w_reference": norm.rlike(REFERENCE_PROCEDURE), "w_standalone": norm.rlike(T.STANDALONE),
    }


def classified(rows: DataFrame) -> DataFrame:
    """(doc_id, key, ordinal, category, start, block_idx, page, kind, structured, text): the parts of every window. The decision of the last block that decides holds for those after it; before any, the anchor's context; without one, the first block's own words."""
    raw, heading = F.trim(F.col("text")), F.col("heading")
    emergency, warning = F.col("category") == "EMERGENCY", F.col("category") == "WARNING"
    first = F.col("block_idx") == F.col("start")
    rows = rows.withColumns({c: e for c, e in window_parts().items() if c not in rows.columns})
    own = window_words()
    have = lambda c: _have(rows)(c, own[c])
    skipped = first & (heading | have("w_short"))
    nested = (heading | have("w_numbered")) & ((F.col("anchor_heading") <= 0) | (F.col("heading_level") <= 0) | (F.col("heading_level") > F.col("anchor_heading")))
    if "w_inner" not in rows.columns:
        rows = rows.withColumn("w_inner", F.when(emergency & nested, own["w_inner"]))
    inner, told, done, starts = (F.col(c) for c in ("w_inner", "w_told", "w_done", "w_starts"))
    acted = emergency & (done != "") & F.col("anchor_norm").rlike(L.INVERSE_BRIDGE) & T.is_action(done)
    inline = have("w_inline")
    condition, measure = _decision("CONDITION", True), _decision("MEASURE", True)
    loose = _decision("MEASURE", False)
    none = F.array().cast("array<struct<kind:string,structured:boolean,text:string>>")
    # (test, decision, what is said): the first that applies. Few branches for each, as one a step makes code that is too large to be compiled.
    steps = [
        (skipped, None, "nothing"),
        (emergency & nested & (inner == "灾害损失情况"), "condition", "nothing"),
        (emergency & nested & inner.isin("响应启动程序", "响应启动流程", "启动程序", "启动流程"), "loose", "nothing"),
        (emergency & nested & inner.isin("应急响应", "响应", "响应措施"), "measure", "nothing"),
        (warning & have("w_introduces"), "condition", "all"),
        (warning & (told != ""), "measure", "warned"),
        (acted, "measure", "done"),
        (inline, "measure", "split"),
        (have("w_startup"), "measure", "all"),
        (have("w_reference"), "loose", "all"),
        (F.col("is_measure_mark") & have("w_standalone"), "measure", "nothing"),
        (F.col("is_measure_mark"), "measure", "all"),
        (F.col("opens_condition"), "condition", "all"),
    ]
    step = None
    for k, (test, _, _) in enumerate(steps):
        step = F.when(test, k) if step is None else step.when(test, k)
    at = lambda k, v: F.col("step").isin([i for i, s in enumerate(steps) if s[k] == v])
    event = F.when(at(1, "condition"), condition).when(at(1, "measure"), measure).when(at(1, "loose"), loose)
    pair = lambda c, m: F.array(_part("CONDITION", True, c), _part("MEASURE", True, m))
    said = (
        F.when(at(2, "nothing"), none)
        .when(at(2, "all"), F.array(F.struct(event["kind"].alias("kind"), event["structured"].alias("structured"), F.trim(raw).alias("text"))))
        .when(at(2, "warned"), pair(F.col("w_warned"), told))
        .when(at(2, "done"), F.array(_part("MEASURE", True, done)))
        .when(at(2, "split"), pair(starts, F.col("w_goes_on")))
    )
    rows = rows.withColumn("step", step)
    w = Window.partitionBy("doc_id", "key", "start").orderBy("block_idx")
    rows = rows.withColumns({"event": event, "said": said, "skipped": skipped})
    rows = rows.withColumn("held", F.coalesce(F.last("event", ignorenulls=True).over(w), F.col("begins")))
    undecided = F.col("held").isNull() & ~F.col("skipped")
    own = F.when(F.col("condition"), _decision("CONDITION", False)).otherwise(loose)
    rows = rows.withColumn("turn", F.sum(undecided.cast("int")).over(w)).withColumn("event", F.when(undecided & (F.col("turn") == 1), own).otherwise(F.col("event")))
    held = F.coalesce(F.last("event", ignorenulls=True).over(w), F.col("begins"))
    parts = F.coalesce(F.col("said"), F.array(F.struct(held["kind"].alias("kind"), held["structured"].alias("structured"), raw.alias("text"))))
    return rows.withColumn("parts", parts).select("doc_id", "key", "ordinal", "category", "start", "block_idx", "page", F.explode("parts").alias("part")).select("doc_id", "key", "ordinal", "category", "start", "block_idx", "page", "part.*")


def evidence(known: DataFrame, named: DataFrame, of: tuple[Level, ...] = LEVELS, markers: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(doc_id, key, tier, start, block_idx, page, text): all that may be a level's condition or measure, by how sure it is. Tiers of conditions go from 1 to 8, of measures from 11 to 12.

    Grades of events (8) only add to levels for which there is other evidence."""
    parts = written(classified(windows(known, named.where("role = 'ANCHOR'"))), "parts")  # a table each, so no plan holds them all
    shown = F.when(F.col("text").contains("为") | F.col("text").contains("施"), T.is_overview(F.col("text"))).otherwise(False)  # signs that its phrases need
    tier = F.when(F.col("kind") == "CONDITION", F.when(F.col("structured"), F.when(shown, 6).otherwise(1)).otherwise(F.when(shown, 7).otherwise(2))).otherwise(F.when(F.col("structured"), 11).otherwise(12))
    rows = parts.select("doc_id", "key", tier.alias("tier"), "start", "block_idx", "page", "text")
    explicit = named.where("role = 'EXPLICIT'").select("doc_id", "key", F.lit(1).alias("tier"), F.col("block_idx").alias("start"), "block_idx", "page", "text")
    said = tuple(map(_plain, (markers or {}).get("activation_condition", ())))
    found = rows.unionByName(explicit)
    if any(v.category == "EMERGENCY" for v in of):
        found = found.unionByName(written(E.conditions(known, of, targets, _compatible("EMERGENCY"), said), "conditions"))
    # an anchor is evidence even if its window holds nothing
    anchored = named.where("role = 'ANCHOR'").select("doc_id", "key", F.lit(99).alias("tier"), F.col("block_idx").alias("start"), "block_idx", "page", F.lit("").alias("text"))
    sure = F.min(F.when(F.col("tier") != 8, F.col("tier"))).over(Window.partitionBy("doc_id", "key"))
    return found.unionByName(anchored).withColumn("sure", sure).where("sure IS NOT NULL AND tier <> 99").drop("sure")


def segments(blocks: DataFrame, tails: list[str], known: tuple[Level, ...] = LEVELS, markers: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Eight rows a document, four warning and four response levels: key, category, title, color, conditions and direct measures (each of the surest tier there is), measures with those inherited, the levels they come from, status."""
    return found_levels(written(described(blocks, tails, known, markers), "described"), blocks.select("doc_id").distinct(), known, markers)


def found_levels(b: DataFrame, docs: DataFrame, known: tuple[Level, ...] = LEVELS, markers: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``segments`` of the documents ``docs``, those without any block in ``b`` included. What is found in a document is one row until the end, so all is shuffled by documents and joined once."""
    found = written(evidence(b, written(mentions(b, known), "mentions"), known, markers), "evidence")
    kind = F.when(F.col("tier") < 10, "c").otherwise("m")
    # the surest tier of each kind; conditions of windows and explicit ones are of the same
    best = F.min("tier").over(Window.partitionBy("doc_id", "key", kind))
    kept = found.where("text <> ''").repartition("doc_id").withColumn("kind", kind).withColumn("best", best).where("tier = best")
    lines = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("start", "block_idx", "text")))), lambda x: x["text"])
    text = kept.groupBy("doc_id", "key").agg(M.paragraphs(lines("c")).alias("c"), M.paragraphs(lines("m")).alias("m")).withColumns({x: F.when(F.col(x) != "", F.col(x)) for x in ("c", "m")})
    length = F.coalesce(F.length("m"), F.lit(0))
    text = text.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("c", "m")))).alias("texts"), F.max(length).alias("longest"), F.coalesce(F.bool_or(F.col("m").contains(BASIS[0])), F.lit(False)).alias("builds"))
    responses = tuple(a for v in known if v.category == "EMERGENCY" for a in v.aliases)
    kinds = tuple(dict.fromkeys(v.category for v in known))
    common = M.common_texts(written(M.common_blocks(b, responses, {c: _compatible(c) for c in kinds}), "common").repartition("doc_id"))
    common = common.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "common"))).alias("shared"), F.max(F.length("common")).alias("most"))
    texts = written(text.join(large(common), "doc_id", "left"), "level-texts")
    every = F.array(*[F.struct(F.lit(v.key).alias("key"), F.lit(v.category).alias("category"), F.lit(v.ordinal).alias("ordinal"), F.lit(v.title).alias("title"), F.lit(v.color).cast("string").alias("color")) for v in known])
    rows = texts.withColumn("hard", F.col("builds") | (F.col("longest") + F.coalesce("most", F.lit(0)) + 1 >= M.MAX_FIELD)).withColumn("level", F.explode(every)).select("doc_id", "hard", "level.*", F.col("texts")[F.col("level.key")].alias("own"), F.col("shared")[F.col("level.category")].alias("common"))
    rows = rows.withColumns({"conditions": F.col("own.c"), "measures": F.col("own.m")}).drop("own")
    rows = rows.withColumn("common", F.when(F.col("conditions").isNotNull() | F.col("measures").isNotNull(), F.col("common")))
    none = F.array().cast("array<string>")
    plain = rows.where("NOT hard").withColumns({"inherits": none, "effective": M.own_lines()})
    # What a level builds on: other levels of its category that it names shortly before the marker.
    sources = T.let(T.normalize(F.col("measures")), lambda m: _keys([(v.key, (F.col("key") != v.key) & (F.col("category") == v.category) & m.rlike(f"(?:{'|'.join(map(_quoted, v.aliases))}).{{0,20}}{BASIS}")) for v in known]))
    hard = rows.where("hard").withColumn("inherits", F.when(F.col("measures").isNull(), none).otherwise(sources))
    hard = M.with_effective(hard.withColumn("sources", F.transform("inherits", lambda k: F.substring(k, -1, 1).cast("int")))).drop("sources")
    bare = docs.join(texts.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.explode(every).alias("level")).select("doc_id", "level.*", *[F.lit(None).cast("string").alias(c) for c in ("conditions", "measures", "common", "effective")], none.alias("inherits"))
    rows = bare.unionByName(plain.drop("hard")).unionByName(hard.drop("hard"))
    status = F.when(F.col("conditions").isNull() & F.col("effective").isNull(), "MISSING").when(F.col("conditions").isNull() | F.col("effective").isNull(), "PARTIAL").otherwise("EXTRACTED")
    return rows.select("doc_id", "key", "category", "ordinal", "title", "color", "conditions", "measures", "common", "effective", "inherits", status.alias("status"))


def complaints(rows: DataFrame) -> DataFrame:
    """(doc_id, code, key): what a reader should look at: warning levels that are missing, levels found in part, documents without any level."""
    levels_ = rows.select("doc_id", F.when((F.col("status") == "MISSING") & (F.col("category") == "WARNING"), "LEVEL_MISSING").when(F.col("status") == "PARTIAL", "LEVEL_PARTIAL").alias("code"), "key").where("code is not null")
    bare = rows.groupBy("doc_id").agg(F.max((F.col("status") != "MISSING").cast("int")).alias("some")).where("some = 0").select("doc_id", F.lit("NO_RESPONSE_STRUCTURE").alias("code"), F.lit(None).cast("string").alias("key"))
    return levels_.unionByName(bare)

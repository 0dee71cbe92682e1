"""Response levels: which levels a text names, what activates them, what they call for.

Sentences come from blocks (doc_id, block_idx, text, heading_level). Everything is a Column
expression, a window over a document or a join on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MAX_FIELD = 8000
# The closed list of levels, as (key, category, ordinal, title, colour).
LEVELS = tuple((f"level_{k}", "EMERGENCY", k, f"{n}级响应", None) for k, n in enumerate("一二三四", 1)) + tuple(
    (f"warning_level_{k}", "WARNING", k, f"{n}级预警", c) for k, (n, c) in enumerate(zip("一二三四", ("red", "orange", "yellow", "blue"), strict=True), 1)
)
LEVEL_SCHEMA = "level_key string, category string, ordinal int, title string, color string"
# How a bridge from an event to a level reads, forwards and inverted, and a classification.
BRIDGE = r"(?:应对|针对|处置)(.{2,80}?)(?:时)?[，,]?(?:启动|实施|进入)(.{0,40}?)(?:应急)?(?:响应|反应)"
INVERSE_BRIDGE = rf"(.{{2,80}}?)(?:应急)?(?:响应|反应)(?:等级)?为(?:第)?({T.LEVEL_TOKEN})级"
CLASSIFICATION = rf"^(.{{2,80}}?)(?:划分为|确定为|为)({T.LEVEL_TOKEN})级(?:，|,)?(?:主要指|是指|包括|指)?(.*)$"
CLAUSE = "([^。；;\r\n]+[。；;]?)"
TRIGGER_SPLIT = "^((?:当)?发生.{1,80}?(?:时|后))[，,](.+)$"
GROUPED = rf"({T.LEVEL_TOKEN}(?:级)?(?:[、,，/和及与]{T.LEVEL_TOKEN}(?:级)?)+)(?:共[一二三四1-4]级)?(?:应急)?(?:响应|反应)"


def mentions(c: Column) -> Column:
    """The ordinals of the response levels that a text names, one by one or in a list, ascending."""

    def of(v: Column) -> Column:
        single = F.regexp_extract_all(v, F.lit(rf"({T.LEVEL_TOKEN})级\p{{IsHan}}{{0,12}}(?:响应|反应)"), 1)
        listed = F.flatten(F.transform(F.regexp_extract_all(v, F.lit(GROUPED), 1), lambda s: F.split(s, "[、,，/和及与]")))
        return F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(single, listed), T.level_ordinal), lambda x: x > 0)))

    return T.let(T.normalize(c), of)


def clauses(blocks: DataFrame) -> DataFrame:
    """doc_id, block_idx, clause_idx, clause."""
    return blocks.select("doc_id", "block_idx", F.posexplode(F.transform(F.regexp_extract_all("text", F.lit(CLAUSE), 1), F.trim)).alias("clause_idx", "clause"))


def bridges(blocks: DataFrame) -> DataFrame:
    """doc_id, block_idx, subject and ordinal: events that a clause ties to a level; adjustments of a running response do not count."""
    c = clauses(blocks).withColumn("norm", T.normalize(F.col("clause"))).where(~T.is_adjustment(F.col("clause")))
    edge = "^[，,。；;]+|[，,。；;]+$"
    forward = c.where(F.col("norm").rlike(BRIDGE)).select("doc_id", "block_idx", F.regexp_replace(F.regexp_extract("norm", BRIDGE, 1), edge, "").alias("subject"), F.explode(T.activation_targets(F.regexp_extract("norm", BRIDGE, 0))).alias("ordinal"))
    inverse = c.where(F.col("norm").rlike(INVERSE_BRIDGE)).select("doc_id", "block_idx", F.regexp_replace(T.strip_section_number(F.regexp_extract("norm", INVERSE_BRIDGE, 1)), edge, "").alias("subject"), T.level_ordinal(F.regexp_extract("norm", INVERSE_BRIDGE, 2)).alias("ordinal"))
    return forward.unionByName(inverse).where("length(subject) >= 2 and ordinal > 0")


def classifications(blocks: DataFrame) -> DataFrame:
    """doc_id, block_idx, label, ordinal and threshold of clauses that define a grade of an event."""
    c = clauses(blocks).withColumn("norm", T.normalize(F.col("clause")))
    got = lambda k: F.regexp_extract("norm", CLASSIFICATION, k)
    return c.where(F.col("norm").rlike(CLASSIFICATION) & ~F.col("norm").contains("响应")).select("doc_id", "block_idx", got(1).alias("label"), T.level_ordinal(got(2)).alias("ordinal"), got(3).alias("threshold"))


def match_score(subject: Column, label: Column, ordinal: Column) -> Column:
    """How well a classification's label fits a bridge's subject; above 0 if at all."""
    joiners = "[、,，/和及与或]"
    plain = F.regexp_replace(T.normalize(subject), joiners, "")
    top, second = T.SEVERITIES[:2]
    domain = plain
    for s in T.SEVERITIES:
        domain = F.replace(domain, F.lit(s), F.lit(""))
    false_hit = ~plain.contains(top) & plain.contains(second) & label.contains(top)
    agree = F.lit(False)
    for k in range(1, 5):
        agree = agree | ((ordinal == k) & T.mentions_severity(plain, k) & T.mentions_severity(label, k))
    fits = agree & ((F.length(domain) < 2) | F.expr("true") & label.contains(domain))
    return F.when(label.contains(plain), F.when(false_hit, -1).otherwise(200 + F.length(plain))).when(fits, 100 + F.length(domain)).otherwise(-1)


def best_classification(bridge: DataFrame, found: DataFrame) -> DataFrame:
    """Each bridge with the label and threshold of its best classification (the first of equals), else null."""
    f = found.select(F.col("doc_id").alias("_doc"), F.col("block_idx").alias("_at"), "label", "threshold")
    joined = bridge.join(f, F.col("doc_id") == F.col("_doc"), "left").withColumn("score", match_score(F.col("subject"), F.col("label"), F.col("ordinal")))
    best = F.max(F.when(F.col("score") > 0, F.struct("score", (-F.col("_at")).alias("near"), "label", "threshold")))
    return joined.groupBy("doc_id", "block_idx", "subject", "ordinal").agg(best.alias("best")).select("doc_id", "block_idx", "subject", "ordinal", F.col("best.label").alias("label"), F.col("best.threshold").alias("threshold"), F.col("best.score").cast("int").alias("score"))


def inheritance(levels: DataFrame, marker: str = "基础上") -> DataFrame:
    """(doc_id, ordinal, source): levels whose measures build on those of another, named at most 20 characters before ``marker``."""
    hits = F.regexp_extract_all(T.normalize(F.col("measures")), F.lit(rf"({T.LEVEL_TOKEN})级(?:应急)?响应.{{0,20}}{marker}"), 1)
    return levels.select("doc_id", "ordinal", F.explode(F.array_distinct(F.transform(hits, T.level_ordinal))).alias("source")).where("source <> ordinal and source > 0")


def effective_measures(levels: DataFrame, links: DataFrame) -> DataFrame:
    """Measures with those inherited, sources first, each line once. Chains are followed over three steps, all there can be among four levels; a level met again adds nothing."""
    reach = links.select("doc_id", "ordinal", "source", F.lit(1).alias("depth"))
    far = reach
    for k in (2, 3):
        nxt = links.select("doc_id", F.col("ordinal").alias("source"), F.col("source").alias("next"))
        far = far.join(nxt, ["doc_id", "source"]).where("next <> ordinal").select("doc_id", "ordinal", F.col("next").alias("source"), F.lit(k).alias("depth"))
        reach = reach.unionByName(far)
    reach = reach.groupBy("doc_id", "ordinal", "source").agg(F.max("depth").alias("depth"))
    own = levels.select("doc_id", "ordinal", F.col("ordinal").alias("source"), F.lit(0).alias("depth"))
    text = levels.select("doc_id", F.col("ordinal").alias("source"), "measures")
    parts = reach.unionByName(own).join(text, ["doc_id", "source"]).where("measures is not null")
    lines = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), "source", "measures"))), lambda x: F.split(x["measures"], "\n")))
    return parts.groupBy("doc_id", "ordinal").agg(F.array_join(F.array_distinct(lines), "\n").alias("effective"))


def common_measures(levels: DataFrame, common: DataFrame) -> DataFrame:
    """Measures shared by all levels, added to every level that has content of its own."""
    c = common.select("doc_id", "common")
    has = F.col("conditions").isNotNull() | F.col("measures").isNotNull()
    return levels.join(c, "doc_id", "left").withColumn("effective", F.when(has, F.concat_ws("\n", "measures", "common"))).drop("common")


# --- action groups ------------------------------------------------------------------------

# How groups are named, listed, led, made up and described.
GROUP = r"(?:[（(]?\d+[）)]\s*)?([\p{IsHan}A-Za-z0-9]{2,24}(?:工作组|保障组|指挥组|协调组|处置组|救援组|专家组|行动组|组))(?=[:：。\s]|$)"
INLINE_GROUPS = "下设(.{2,120}?)等(?:专项)?工作组"
NOT_GROUPS = ("各工作组", "工作组", "领导小组", "指挥部工作组")
GROUP_NUMBER = r"^(?:[（(]?[一二三四五六七八九十0-9]+[）)]|\d+(?:\.\d+)+)[、.．]?"
TWO_GROUPS = "^(.+?组)[和及、](.+?组)$"
COUNTED_GROUPS = "[0-9一二三四五六七八九十]+个(?:专项)?工作组|^个工作组|^设立工作组"
LEADS, MEMBERS, DUTIES = ("牵头", "负责"), ("组成", "参加", "为成员"), ("主要负责", "负责")
LEAD_OPENS, MEMBER_OPENS = "由(.{1,100}?)", "(?:联合|会同|成员包括|牵头[，,])(.{1,160}?)"
DUTY_WORDS = "组织|承担|协调|指导|调配|搜救|保障|开展|监测|发布|维护|恢复|制定|实施|收集|汇总|处置|抢修|安置|供应"
ONLY_UNITS = "^(由|牵头单位|成员单位).{0,200}(牵头|组成|参加|为成员)[。；;]?$"
MOST_UNIT = 60


def _units(text: Column, opens: str, marks: tuple[str, ...]) -> Column:
    """The units named between an opening and one of the marks, in order, each once."""
    spans = F.regexp_extract_all(text, F.lit(f"{opens}(?:{'|'.join(marks)})"), 1)
    names = F.transform(F.flatten(F.transform(spans, lambda s: F.split(s, "[、，,及和]"))), lambda u: F.trim(F.regexp_replace(u, "^(由|联合|会同)", "")))
    return F.array_distinct(F.filter(names, lambda u: (u != "") & (F.length(u) <= MOST_UNIT)))


def _last_of(text: Column, marks: tuple[str, ...]) -> Column:
    """Place (from 1) of the last of any mark in a text, 0 without any."""
    back = F.reverse(text)
    places = [F.when(F.instr(back, m[::-1]) > 0, F.length(text) - F.instr(back, m[::-1]) - len(m) + 2).otherwise(0) for m in marks]
    return F.greatest(*places) if len(places) > 1 else places[0]


def _duty(text: Column, name: Column, marks: tuple[str, ...]) -> Column:
    """A group's duty: from the last mark on; without any what follows its name, if that tells of actions and not only of who belongs to it."""
    at = _last_of(text, marks)
    place = F.call_function("instr", text, name)
    after = F.trim(F.regexp_replace(F.when(place > 0, F.substring(text, place + F.length(name), F.length(text))), r"^[\s:：。；;、，,]+", ""))
    fallback = F.when(after.rlike(f"^.*(?:{DUTY_WORDS}).*$") & ~after.rlike(ONLY_UNITS), after)
    return F.nullif(F.trim(F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(fallback)), F.lit(""))


def action_groups(blocks: DataFrame, markers: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, group_key, name, leads, members, responsibility, raw and pages of every group that a document names, one row for each.

    Groups are headed by their names, two of them joined by "and" as well, or listed in a sentence. A block that is
    little more than the name is read with the next one. Units and duties keep the order of the blocks, each once.
    markers: configured words by code (group_lead, group_member, group_responsibility); lines of contents name no group."""
    given = markers or {}
    leads, members = given.get("group_lead", LEADS), given.get("group_member", MEMBERS)
    duties = tuple(dict.fromkeys([*given.get("group_responsibility", DUTIES), "负责"]))
    order = Window.partitionBy("doc_id").orderBy("block_idx")
    b = blocks.select("doc_id", "block_idx", "page", F.trim("text").alias("text"), F.lead("text").over(order).alias("next")).where(~T.is_contents(F.col("text"), F.col("page")))
    clean = lambda c: F.trim(F.regexp_replace(c, GROUP_NUMBER, ""))

    def split(name: Column) -> Column:
        pair = lambda k: clean(F.regexp_extract(name, TWO_GROUPS, k))
        return F.when(name.rlike(TWO_GROUPS), F.array(pair(1), pair(2))).otherwise(F.array(name))

    headed = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(GROUP), 1), lambda n: split(clean(n))))
    items = F.transform(F.filter(F.split(F.regexp_extract("text", INLINE_GROUPS, 1), "[、，,及和]"), lambda i: F.trim(i) != ""), clean)
    listed = F.transform(items, lambda i: F.when(F.endswith(i, F.lit("组")), i).otherwise(F.concat(i, F.lit("组"))))
    both = F.concat(F.transform(headed, lambda n: F.struct(n.alias("name"), F.lit(True).alias("headed"))), F.transform(listed, lambda n: F.struct(n.alias("name"), F.lit(False).alias("headed"))))
    named = b.select("doc_id", "block_idx", "page", "text", "next", F.posexplode(both).alias("at", "group")).select("doc_id", "block_idx", "page", "text", "next", "at", "group.*")
    named = named.where((F.length("name") >= 3) & ~F.col("name").isin(*NOT_GROUPS) & ~F.col("name").rlike(COUNTED_GROUPS))
    with_next = F.col("headed") & (F.length("text") <= F.length("name") + 8) & F.col("next").isNotNull()
    named = named.withColumn("detail", F.when(with_next, F.concat_ws("\n", "text", "next")).otherwise(F.col("text")))
    detail = F.col("detail")
    named = named.withColumn("duty", _duty(detail, F.col("name"), duties))
    named = named.withColumn("leads", _units(detail, LEAD_OPENS, leads)).withColumn("members", _units(detail, MEMBER_OPENS, members))
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("block_idx", "at", c)))), lambda x: x[c])
    merged = lambda c: F.array_join(F.array_distinct(F.flatten(ordered(c))), ",")
    return named.groupBy("doc_id", T.group_key(F.col("name")).alias("group_key")).agg(
        F.min_by("name", F.struct("block_idx", "at")).alias("name"), merged("leads").alias("leads"), merged("members").alias("members"),
        F.array_join(F.array_distinct(ordered("duty")), "\n").alias("responsibility"), F.substring(F.array_join(F.array_distinct(F.flatten(F.transform(ordered("detail"), lambda d: F.split(d, "\n")))), "\n"), 1, MAX_FIELD).alias("raw"),
        F.array_join(F.filter(F.array_distinct(ordered("page")), lambda p: p > 0).cast("array<string>"), ",").alias("pages"),
    )

"""Rule sets as tables: seeds, scans, snapshots, validation, and the lifecycle of revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RULE_SCHEMA = "rule_type string, rule_code string, canonical_name string, alias string, group_order int, alias_order int, enabled boolean"
RULE_TYPES = ("COMMAND", "RESPONSE", "WARNING", "SECTION", "MARKER", "TAIL")

# The seed rules, as (type, code, canonical name, group order, aliases in order).
SEED = (
    ("COMMAND", "command_system", "指挥体系", 10, ("指挥体系", "组织指挥体系", "应急指挥体系", "指挥机构及职责", "组织机构及职责")),
    ("RESPONSE", "level_1", "一级响应", 10, ("一级响应", "一级应急响应", "Ⅰ级响应", "I级响应", "特别重大响应")),
    ("RESPONSE", "level_2", "二级响应", 20, ("二级响应", "二级应急响应", "Ⅱ级响应", "II级响应", "重大响应")),
    ("RESPONSE", "level_3", "三级响应", 30, ("三级响应", "三级应急响应", "Ⅲ级响应", "III级响应", "较大响应")),
    ("RESPONSE", "level_4", "四级响应", 40, ("四级响应", "四级应急响应", "Ⅳ级响应", "IV级响应", "一般响应")),
    ("WARNING", "warning_level_1", "一级预警", 10, ("一级预警", "Ⅰ级预警", "红色预警")),
    ("WARNING", "warning_level_2", "二级预警", 20, ("二级预警", "Ⅱ级预警", "橙色预警")),
    ("WARNING", "warning_level_3", "三级预警", 30, ("三级预警", "Ⅲ级预警", "黄色预警")),
    ("WARNING", "warning_level_4", "四级预警", 40, ("四级预警", "Ⅳ级预警", "蓝色预警")),
    ("SECTION", "warning_scope", "预警章节", 10, ("监测预警", "预警响应")),
    ("SECTION", "emergency_scope", "应急响应章节", 20, ("应急响应", "分级响应")),
    ("SECTION", "action_group_scope", "行动组章节", 30, ("工作组", "现场指挥部工作组")),
    ("MARKER", "activation_condition", "启动条件标记", 10, ("启动条件", "响应条件", "发布条件")),
    ("MARKER", "response_measure", "响应措施标记", 20, ("响应措施", "应急措施", "处置措施")),
    ("MARKER", "inheritance", "措施继承标记", 30, ("基础上",)),
    ("MARKER", "group_lead", "牵头单位标记", 40, ("牵头",)),
    ("MARKER", "group_member", "成员单位标记", 50, ("组成",)),
    ("MARKER", "group_responsibility", "职责标记", 60, ("主要负责",)),
    ("TAIL", "response_tail", "响应结束标题", 10, ("启动条件调整", "响应终止", "综合保障", "后期处置", "附则", "附件")),
)

#: A rule set for the shipped Latin-script tables.
LATIN = (
    ("SECTION", "lead", "Lead", 10, ("the", "and")),
    ("SECTION", "german", "German", 20, ("der", "und")),
    ("SECTION", "french", "French", 30, ("les", "que")),
    ("TAIL", "end", "End", 10, ("licensed",)),
)


# Rules added later, as (type, code, canonical name, group order, aliases with their orders).
LATER = (
    ("RESPONSE", "level_1", "一级响应", 10, (("Ⅰ级应急响应", 35), ("应急响应（Ⅰ级）", 60), ("Ⅰ级响应行动", 70), ("Ⅰ级响应的启动", 80), ("特别重大级应急响应", 90))),
    ("RESPONSE", "level_2", "二级响应", 20, (("Ⅱ级应急响应", 35), ("应急响应（Ⅱ级）", 60), ("Ⅱ级响应行动", 70), ("Ⅱ级响应的启动", 80), ("重大级应急响应", 90))),
    ("RESPONSE", "level_3", "三级响应", 30, (("Ⅲ级应急响应", 35), ("应急响应（Ⅲ级）", 60), ("Ⅲ级响应行动", 70), ("Ⅲ级响应的启动", 80), ("较大级应急响应", 90))),
    ("RESPONSE", "level_4", "四级响应", 40, (("Ⅳ级应急响应", 35), ("应急响应（Ⅳ级）", 60), ("Ⅳ级响应行动", 70), ("Ⅳ级响应的启动", 80), ("一般级应急响应", 90))),
    ("WARNING", "warning_level_1", "一级预警", 10, (("Ⅰ级预警响应", 40),)),
    ("WARNING", "warning_level_2", "二级预警", 20, (("Ⅱ级预警响应", 40),)),
    ("WARNING", "warning_level_3", "三级预警", 30, (("Ⅲ级预警响应", 40),)),
    ("WARNING", "warning_level_4", "四级预警", 40, (("Ⅳ级预警响应", 40),)),
    ("SECTION", "emergency_scope", "应急响应章节", 20, (("应急反应", 30), ("响应行动", 40), ("响应程序", 50), ("应急响应分级和启动条件", 60))),
    ("SECTION", "action_group_scope", "行动组章节", 30, (("应急工作组", 30), ("现场工作组", 40))),
    ("MARKER", "activation_condition", "启动条件标记", 10, (("响应的启动", 40), ("启动标准", 50), ("响应标准", 60), ("事件分级", 70), ("事故分级", 80), ("灾害分级", 90), ("险情与灾情分级", 100), ("灾情分级", 110), ("灾害损失情况", 120))),
    ("MARKER", "response_measure", "响应措施标记", 20, (("响应行动", 40), ("响应程序", 50), ("反应行动", 60), ("反应措施", 70))),
    ("TAIL", "response_tail", "响应结束标题", 10, (("响应结束", 70), ("应急响应终止", 80), ("保障措施", 90), ("恢复重建", 100))),
)


def rule_rows(groups=SEED, later=None) -> list[tuple]:
    """The rows of rule groups; of the seed, with the rules added later."""
    first = [(t, code, name, alias, order, 10 * (k + 1), True) for t, code, name, order, aliases in groups for k, alias in enumerate(aliases)]
    later = later if later is not None else LATER if groups is SEED else ()
    return first + [(t, code, name, alias, order, at, True) for t, code, name, order, aliases in later for alias, at in aliases]


def aliases(*types: str) -> dict[str, tuple[str, ...]]:
    """The aliases of the seed's rules of some types by code, in order."""
    out: dict[str, list] = {}
    for t, code, _, alias, _, at, _ in rule_rows():
        if t in types:
            out.setdefault(code, []).append((at, alias))
    return {code: tuple(a for _, a in sorted(found)) for code, found in out.items()}


def rules_table(spark: SparkSession, groups=SEED) -> DataFrame:
    return spark.createDataFrame(rule_rows(groups), RULE_SCHEMA)


def version(rules: DataFrame) -> DataFrame:
    """One row: version, the first 24 hex digits of the SHA-256 of the active rules in order, and how many there are. A rule set is configuration of bounded size."""
    line = F.concat_ws("|", "rule_type", "rule_code", "canonical_name", "alias")
    order = F.struct("rule_type", "group_order", "rule_code", "alias_order", line.alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(order)), lambda x: x["line"])
    return rules.where("enabled").agg(F.substring(F.sha2(F.array_join(lines, "\n").cast("binary"), 256), 1, 24).alias("version"), F.count("*").alias("n_rules"))


def violations(rules: DataFrame) -> DataFrame:
    """(rule_index, problem) of a rule set with ``rule_index``; no row if it is valid. Problems of the whole set have index -1."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    names = ["rule_type", "rule_code", "canonical_name", "alias"]
    missing = blank("rule_type")
    for n in names[1:]:
        missing = missing | blank(n)
    rows = rules.withColumn("_missing", missing)
    whole = rows.where("not _missing")
    w = Window.partitionBy("rule_type", "rule_code", "alias").orderBy("rule_index")
    again = whole.withColumn("_k", F.row_number().over(w)).where("_k > 1")
    types = whole.where("enabled").agg(*[F.coalesce(F.bool_or(F.col("rule_type") == t), F.lit(False)).alias(t) for t in ("COMMAND", "RESPONSE", "TAIL")])
    said = lambda df, what: df.select(F.col("rule_index").cast("bigint").alias("rule_index"), F.lit(what).alias("problem"))
    return (
        said(rows.where("_missing"), "FIELD_MISSING")
        .unionAll(said(whole.where(~F.col("rule_type").isin(*RULE_TYPES)), "TYPE_UNSUPPORTED"))
        .unionAll(said(again, "ALIAS_REPEATED"))
        .unionAll(said(types.where("not (COMMAND and RESPONSE and TAIL)").withColumn("rule_index", F.lit(-1)), "GROUP_REQUIRED"))
    )


def snapshot(rules: DataFrame) -> DataFrame:
    """Active rules by code: canonical name and aliases in order, and whether the code has one name only."""
    aliases = F.transform(F.sort_array(F.collect_list(F.struct("alias_order", "alias"))), lambda x: x["alias"])
    return rules.where("enabled").groupBy("rule_type", "rule_code").agg(F.min("group_order").alias("group_order"), F.min("canonical_name").alias("canonical_name"), F.array_join(aliases, ",").alias("aliases"), (F.count_distinct("canonical_name") == 1).alias("one_name"))


def publish(revisions: DataFrame, revision_id: str) -> DataFrame:
    """Revisions after publishing a draft: it is PUBLISHED, what was PUBLISHED is ARCHIVED; anything but a draft changes nothing."""
    w = Window.partitionBy("code")
    chosen = (F.col("revision_id") == revision_id) & (F.col("status") == "DRAFT")
    valid = F.max(chosen.cast("int")).over(w) == 1
    status = F.when(valid & chosen, "PUBLISHED").when(valid & (F.col("status") == "PUBLISHED"), "ARCHIVED").otherwise(F.col("status"))
    return revisions.withColumn("status", status)


def rollback(revisions: DataFrame, revision_id: str, new_id: str) -> DataFrame:
    """Revisions after copying an old one as a new draft with the next number and publishing it."""
    top = revisions.groupBy("code").agg((F.max("revision_number") + 1).alias("_next"))
    copy = revisions.where(F.col("revision_id") == revision_id).join(top, "code").select(*[(F.lit(new_id) if c == "revision_id" else F.lit("DRAFT") if c == "status" else F.col("_next") if c == "revision_number" else F.col(c)).alias(c) for c in revisions.columns])
    return publish(revisions.unionByName(copy), new_id)


def snapshot_problems(rules: DataFrame) -> DataFrame:
    """(problem, subject): why the active rules make no snapshot. COMMAND_CODES: more than one command code; CODE_NAMES: a code with several names;
    NAME_CODES: a name of levels under several codes; GROUP_REQUIRED: no rule of a type that must be there."""
    on = rules.where("enabled")
    commands = on.where("rule_type = 'COMMAND'").select("rule_code").distinct()
    several = commands.agg(F.count("*").alias("n")).where("n > 1").select(F.lit("COMMAND_CODES").alias("problem"), F.lit(None).cast("string").alias("subject"))
    grouped = on.where("rule_type IN ('RESPONSE', 'WARNING', 'SECTION', 'MARKER')")
    named = grouped.groupBy("rule_type", "rule_code").agg(F.count_distinct("canonical_name").alias("n")).where("n > 1").select(F.lit("CODE_NAMES").alias("problem"), F.concat_ws("/", "rule_type", "rule_code").alias("subject"))
    coded = grouped.where("rule_type IN ('RESPONSE', 'WARNING')").groupBy("rule_type", "canonical_name").agg(F.count_distinct("rule_code").alias("n")).where("n > 1").select(F.lit("NAME_CODES").alias("problem"), F.concat_ws("/", "rule_type", "canonical_name").alias("subject"))
    there = on.agg(*[F.coalesce(F.bool_or(F.col("rule_type") == t), F.lit(False)).alias(t) for t in ("COMMAND", "RESPONSE", "TAIL")])
    lacking = F.filter(F.array(*[F.when(~F.col(t), F.lit(t)) for t in ("COMMAND", "RESPONSE", "TAIL")]), lambda t: t.isNotNull())
    return several.unionByName(named).unionByName(coded).unionByName(there.select(F.lit("GROUP_REQUIRED").alias("problem"), F.explode(lacking).alias("subject")))

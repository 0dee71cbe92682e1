"""Conditions of events are found in one pass over the blocks, and words stand before patterns without changing what these find."""

import random
import re

from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.operators import events as E
from strataloom.operators import levels as L
from strataloom.operators import response as R
from strataloom.plans import results as Q

SF = "/root/testdata/sf0.001"
WORDS = ["应对", "针对", "处置", "启动", "实施", "进入", "响应", "反应", "应急", "为", "级", "一级", "Ⅱ级", "III级", "发生", "时", "后", "，", "。", "分级", "等级", "事件", "灾害", "险情", "重大", "特别重大", "划分为", "组织", "救援", "预警", "等级为", "甲", "乙乙", "1.2 ", "一、", "发生事件时，组织", "处置险情时启动响应", "灾害响应为第二级", "重大灾害划分为一级"]


def test_blocks_are_described_once_and_only_as_needed(spark, monkeypatch):
    made = []

    def written(df, name):
        made.append((name, df._jdf.queryExecution()))
        return df

    for module in (E, Q):
        monkeypatch.setattr(module, "written", written)
    Q.event_conditions(spark, SF)
    assert [name for name, _ in made] == ["graded", "bridges"]
    columns = made[0][1].analyzed().output().mkString(" ")
    assert "keys#" not in columns and "asks#" not in columns
    shown = made[0][1].sparkPlan().toString()
    assert "预警响应" not in shown  # no names of levels are looked for
    assert len(re.findall("Exchange hashpartitioning", made[0][1].executedPlan().toString())) == 1


def test_words_leave_what_patterns_find(spark):
    pick = random.Random(12)
    texts = ["".join(pick.choice(WORDS) for _ in range(pick.randint(1, 10))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("norm", T.normalize(F.col("text")))
    text, norm = F.col("text"), F.col("norm")
    pairs = [
        (E.holds(norm, *E.BRIDGE_WORDS), norm.rlike(L.BRIDGE)), (E.holds(text, *E.BRIDGE_WORDS), text.rlike(E.SOURCE_BRIDGE)), (E.holds(norm, *E.INVERSE_WORDS), norm.rlike(L.INVERSE_BRIDGE)),
        (E.holds(text, *E.INVERSE_WORDS), text.rlike(E.SOURCE_INVERSE)), (E.holds(norm, *E.DESCRIBED_WORDS), norm.rlike(E.DESCRIBED)), (E.holds(norm, E.GRADES), norm.rlike(E.SCOPE_PATTERN)),
        (E.holds(norm, ("为",), ("级",)), T.strip_section_number(norm).rlike(E.INLINE_GRADE)), (norm.contains("级"), norm.rlike(E.GRADE_END) | norm.rlike(E.GRADE_START)), (text.contains("发生"), F.trim(text).rlike(L.TRIGGER_SPLIT)),
    ]
    row = df.agg(*[F.count_if(p).alias(f"p{i}") for i, (_, p) in enumerate(pairs)], *[F.count_if(p & ~w).alias(f"lost{i}") for i, (w, p) in enumerate(pairs)]).first()
    assert [row[f"lost{i}"] for i in range(len(pairs))] == [0] * len(pairs) and all(row[f"p{i}"] > 0 for i in range(len(pairs)))


def test_words_leave_the_names_of_levels(spark):
    pick = random.Random(13)
    of = R.levels({v.key: (f"甲{v.ordinal}", f"{v.title}乙") for v in R.LEVELS})
    words = ["一级", "二级", "3级", "IV级", "II级", "I级", "III级", "I", "V", "特别重大", "重大", "较大", "一般", "级", "响应", "应急响应", "反应", "预警", "红色", "蓝色预警", "行动", "的启动", "丙", "\n", *[a for v in of for a in v.aliases]]
    df = spark.createDataFrame([("".join(pick.choice(words) for _ in range(pick.randint(1, 5))),) for _ in range(4000)], "norm string")
    found = [(E.holds(F.col("norm"), R._name_words(v)), F.col("norm").rlike(R._name_pattern(v))) for v in of]
    row = df.agg(*[F.count_if(p).alias(f"p{i}") for i, (_, p) in enumerate(found)], *[F.count_if(p & ~w).alias(f"lost{i}") for i, (w, p) in enumerate(found)], *[F.count_if(~w).alias(f"spared{i}") for i, (w, _) in enumerate(found)]).first()
    assert [row[f"lost{i}"] for i in range(len(of))] == [0] * len(of)
    assert all(row[f"p{i}"] > 0 and row[f"spared{i}"] > 0 for i in range(len(of)))

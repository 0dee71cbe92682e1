"""Whole plans are read by their distinct lines and joined by documents, with the results of reading every block by itself."""

import pytest

from strataloom.operators import plan as P
from strataloom.operators import response as R
from strataloom.operators import rules, traces
from strataloom.plans import levels as Q

from . import test_plans as plans
from .test_response import rows

WARNED = [("监测预警", 1), ("一级预警", 2), "预计发生特别重大险情。", "发布红色预警后，组织巡查。", ("二级预警", 2), "启动条件", "达到橙色标准。", "响应措施", "加强值守。", ("应急响应", 1), ("一级响应", 2), "启动条件", "出现特别重大事件。", "响应措施", "组织救援。", ("二级响应", 2), "响应措施", "在一级响应的基础上调度。", ("附则", 1)]
LONG = [("应急响应", 1), ("一级响应", 2), "响应措施", "组织救援" + "甲" * 5000, "组织抢修" + "乙" * 5000, ("附则", 1)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rules.rule_rows(), rules.RULE_SCHEMA)


def test_levels_are_those_of_blocks_read_one_by_one(spark, frame):
    blocks = rows(spark, plans.COMMON, plans.SECTIONS, plans.TRIGGER, plans.GRADES, plans.DESCRIBED, plans.INLINE, WARNED, LONG, ["无。"])
    named, got = rules.aliases("SECTION"), P.analyse(blocks, frame).levels
    want = None
    for category, code in (("WARNING", "warning_scope"), ("EMERGENCY", "emergency_scope")):
        part = R.segments(P.scoped(blocks, code, named), Q.TAILS, tuple(v for v in Q.KNOWN if v.category == category), Q.MARKERS)
        want = part if want is None else want.unionByName(part)
    got, want = sorted(got.collect(), key=str), sorted(want.collect(), key=str)
    assert len(got) == 72 and got == want
    assert {r["status"] for r in got if r["category"] == "WARNING"} >= {"MISSING", "EXTRACTED"} and any(r["inherits"] for r in got)


def test_tables_that_warnings_do_not_read_are_not_written(spark, frame, monkeypatch):
    names = []
    for module in (P, R):
        monkeypatch.setattr(module, "written", lambda df, name, f=module.written: names.append(name) or f(df, name))
    P.analyse(rows(spark, WARNED), frame)
    assert "all-levels" in names and "groups" not in names and "sections" not in names


def test_traces_join_by_documents(spark, frame):
    none = spark.createDataFrame([], "doc_id long, rule_code string, matched_by string, key string, status string")
    found = traces.trace(rows(spark, WARNED), frame, none, none)
    shown = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in shown.splitlines() if "SortMergeJoin" in line]
    assert joins and not any("rule_code" in line or "rule_type" in line for line in joins)

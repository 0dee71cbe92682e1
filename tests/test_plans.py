"""Golden cases of events, grades, common measures, circles of inheritance, groups, chapters and warnings."""

import pytest

from strataloom.operators import levels as L
from strataloom.operators import measures as M
from strataloom.operators import plan as P
from strataloom.operators import rules, traces

from .test_response import levels, rows

COMMON = [("应急响应", 1), ("5.1 一级响应", 2), "启动条件", "发生特别重大险情。", "响应措施", "调度救援队伍。", ("5.2 二级响应", 2), "响应措施", "派出工作人员。", ("5.3 共同响应措施", 2), "及时发布信息。", "开展损失评估。", ("6 附则", 1), "解释。"]
SECTIONS = [("4 事件分级", 1), ("4.1 甲区林火", 2), "过火面积达到五百公顷。", "烟雾影响两个县。", ("4.2 乙类停电", 2), "停电用户超过十万户。", ("5 应急响应", 1), ("应对甲区林火，启动三级响应。", 2), "组织扑救。", ("处置乙类停电，启动一级响应。", 2), "组织抢修。", ("响应终止", 1)]
TRIGGER = [("5 应急响应", 1), ("片区断水事件应急响应为二级", 2), "发生片区断水事件时，立即启动供水预案并部署抢修。", ("公共通信事件响应等级为Ⅳ级", 2), "队伍开展线路抢修。", "必要时调整为Ⅰ级响应。", ("响应终止", 1)]
STOPPED = [("5 应急响应", 1), ("甲类事件应急响应为二级", 2), ("乙类事件应急响应为三级", 2), "发生甲类事件时，开展救援。", ("响应终止", 1)]
GRADES = [("2 灾害分级", 1), ("（一）特大型险情（I级）", 2), "死亡三十人以上。", ("（二）大型险情（Ⅱ级）", 2), "死亡十人以上。", ("5 应急响应", 1), ("一级响应", 2), "响应措施", "组织救援。", ("响应终止", 1)]
DESCRIBED = [("5 应急响应", 1), "初判发生甲类地震灾害时，由市里启动一级响应。初判发生乙类地震灾害时，由市里启动二级响应。", ("响应终止", 1)]
INLINE = [("六、事件与灾害分级", 1), "1．红区火灾为一级，主要指过火五百公顷以上。", "2．黄区火灾为二级，主要指过火百公顷以上。", ("（二）分级响应程序", 2), ("红区火灾应急响应为I级", 2), "发生红区火灾时，立即启动预案并部署扑救。", ("响应终止", 2)]
FAR = [("4 事件分级", 1), *["说明。"] * 45, ("4.9 丙类停水", 2), "停水三天。", ("5 应急响应", 1), ("应对丙类停水，启动一级响应。", 2), "组织送水。", ("响应终止", 1)]


@pytest.fixture(scope="module")
def found(spark):
    return levels(spark, COMMON, SECTIONS, TRIGGER, STOPPED, GRADES, DESCRIBED, INLINE, FAR)


def test_common_measures_reach_levels_with_content(found):
    shared = "及时发布信息。\n开展损失评估。"
    assert found[0, "level_1"]["common"] == shared and found[0, "level_1"]["effective"] == "调度救援队伍。\n" + shared
    assert found[0, "level_2"]["effective"] == "派出工作人员。\n" + shared and found[0, "level_2"]["measures"] == "派出工作人员。"
    assert found[0, "level_3"]["effective"] is None and found[0, "level_3"]["common"] is None and found[0, "warning_level_1"]["effective"] is None


def test_events_take_their_whole_section(found):
    three, one = found[1, "level_3"], found[1, "level_1"]
    assert three["conditions"].endswith("过火面积达到五百公顷。\n烟雾影响两个县。") and "停电" not in three["conditions"] and three["measures"] == "组织扑救。"
    assert "停电用户超过十万户。" in one["conditions"] and "公顷" not in one["conditions"]


def test_a_trigger_comes_before_the_bridge_sentence(found):
    two, four = found[2, "level_2"], found[2, "level_4"]
    assert two["conditions"] == "发生片区断水事件时" and "部署抢修" in two["measures"] and "发生" not in two["measures"]
    assert four["conditions"] == "公共通信事件响应等级为Ⅳ级" and found[2, "level_1"]["status"] == "MISSING"


def test_another_bridge_stops_the_search_for_a_trigger(found):
    assert found[3, "level_2"]["conditions"] == "甲类事件应急响应为二级"


def test_grades_add_to_levels_that_exist(found):
    assert "死亡三十人以上。" in found[4, "level_1"]["conditions"] and "十人以上。\n" not in found[4, "level_1"]["conditions"]
    assert found[4, "level_2"]["status"] == "MISSING"


def test_sentences_map_events_one_by_one(found):
    assert "甲类" in found[5, "level_1"]["conditions"] and "乙类" not in found[5, "level_1"]["conditions"]
    assert "乙类" in found[5, "level_2"]["conditions"] and "甲类" not in found[5, "level_2"]["conditions"]


def test_a_sentence_can_define_a_grade(found):
    one = found[6, "level_1"]
    assert "五百公顷" in one["conditions"] and "黄区" not in one["conditions"] and "部署扑救" in one["measures"]


def test_a_grading_chapter_reaches_forty_blocks(found):
    assert found[7, "level_1"]["conditions"] == "应对丙类停水，启动一级响应"


def _level(k, sources, text, common=None):
    return {"ordinal": k, "sources": sources, "measures": text, "common": common}


def test_circles_of_inheritance():
    assert M.expand([_level(1, [2], "甲"), _level(2, [3], "乙"), _level(3, [1], "丙")]) == ["甲\n丙\n乙", "甲\n丙\n乙", "甲\n丙"]
    four = M.expand([_level(1, [4], "甲"), _level(2, [1], "乙"), _level(3, [2], "丙"), _level(4, [3], "丁")])
    assert four == ["甲\n乙\n丙\n丁", "甲\n乙", "甲\n乙\n丙", "甲\n乙\n丙\n丁"]
    assert M.expand([_level(1, [], "甲\n乙", "乙\n丙"), _level(2, [1], None, "丁"), _level(3, None, None)]) == ["甲\n乙\n丙", "甲\n乙\n丙\n丁", None]


def test_effective_measures_are_cut_together():
    one = M.expand([_level(1, [2], "甲" * 5000), _level(2, [], "乙" * 5000)])
    assert len(one[0]) == 8000 and one[0].startswith("乙" * 5000 + "\n甲")


def test_groups_have_members_and_duties(spark):
    plan = ["综合协调组：由应急局牵头，公安局、交通局组成，主要负责信息汇总，负责对外联络。", "（1）抢险组和保障组", "组织抢修道路。", "指挥部下设医疗、宣传等工作组", "综合协调组：会同气象局、水利局参加，负责研判。", "宣传组。由宣传部牵头。", "三个工作组"]
    got = {r["name"]: r for r in L.action_groups(rows(spark, plan)).collect()}
    assert set(got) == {"综合协调组", "抢险组", "保障组", "医疗组", "宣传组", "宣传等工作组"}
    one = got["综合协调组"]
    assert (one["leads"], one["members"], one["responsibility"]) == ("应急局", "公安局,交通局,气象局,水利局", "负责对外联络。\n负责研判。")
    assert got["保障组"]["responsibility"] == "组织抢修道路。" and got["宣传组"]["leads"] == "宣传部" and got["宣传组"]["responsibility"] == ""


def test_chapters_narrow_only_where_they_are_sure(spark):
    one = [("总则", 1), ("应急响应", 1), ("一级响应", 2), "救援。", ("善后", 1), "总结。"]
    two = [("应急响应", 1), "甲。", ("应急响应保障", 1), "乙。"]
    bare = [("应急响应", 1), ("善后", 1), "总结。"]
    row = [("应急响应", 1), "甲。", ("监测预警", 3), "乙。"]
    got = P.scoped(rows(spark, one, two, bare, row), "s", {"s": ["应急响应"], "t": ["监测预警"]}).groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in got} == {0: 3, 1: 4, 2: 3, 3: 2}
    assert P.scoped(rows(spark, one), "none", {}).count() == 6


def test_results_of_a_plan(spark):
    plan = [("指挥体系........3", 0, 1), ("应急响应", 1), ("一级响应", 2), "启动条件", "出现特别重大事件。", "响应措施", "成立指挥部组织救援。", ("二级响应", 2), "响应措施", "开展救援。", ("后期处置", 1), "善后。", ("现场工作组", 1), "医疗组：由医院牵头，负责救治。"]
    frame = spark.createDataFrame(rules.rule_rows(), rules.RULE_SCHEMA)
    got = P.analyse(rows(spark, plan), frame)
    seen = {(r["code"], r["subject"]) for r in got.warnings.collect()}
    assert ("SECTION_ONLY_IN_CONTENTS", "指挥体系") in seen and ("SECTION_MISSING", "四级响应") in seen and ("LEVEL_PARTIAL", "level_2") in seen
    assert {s for c, s in seen if c == "LEVEL_MISSING"} == {f"warning_level_{k}" for k in range(1, 5)} and "NO_RESPONSE_STRUCTURE" not in {c for c, _ in seen}
    assert {r["key"]: r["status"] for r in got.levels.collect() if r["category"] == "EMERGENCY"} == {"level_1": "EXTRACTED", "level_2": "PARTIAL", "level_3": "MISSING", "level_4": "MISSING"}
    assert {(r["name"], r["leads"]) for r in got.groups.collect()} == {("现场工作组", "医院"), ("医疗组", "医院")}
    assert {r["rule_code"] for r in got.sections.collect()} == {"level_1", "level_2"}


def test_traces_are_tied_to_results(spark):
    plan = [("指挥体系........3", 0, 1), ("应急响应", 1), ("一级响应", 2), "启动条件", "出现特别重大事件。", "响应措施", "成立指挥部组织救援。", ("后期处置", 1), "善后。"] + ["响应措施之一。"] * 14
    frame = spark.createDataFrame([*rules.rule_rows(), ("TAIL", "off", "Off", "善后", 99, 1, False)], rules.RULE_SCHEMA)
    blocks = rows(spark, plan)
    got = traces.of_plan(blocks, frame)
    by = {(r["rule_code"], r["alias"]): r for r in got.collect()}
    assert len(by) == 107 and sorted(r["place"] for r in by.values()) == list(range(107))
    assert by["level_1", "一级响应"]["status"] == "MATCHED" and by["level_1", "一级响应"]["selected"] == "一级响应" and by["level_1", "I级响应"]["selected"] is None
    assert by["level_2", "二级响应"]["status"] == "MISSING" and by["off", "善后"]["status"] == "DISABLED" and by["command_system", "指挥体系"]["status"] == "MISSING"
    assert (by["emergency_scope", "应急响应"]["status"], by["emergency_scope", "应急响应"]["matched_by"]) == ("MATCHED", "SECTION_SCOPE")
    assert (by["warning_scope", "预警响应"]["status"], by["warning_scope", "预警响应"]["matched_by"]) == ("FALLBACK", "FULL_DOCUMENT")
    marker = by["response_measure", "响应措施"]
    assert marker["status"] == "MATCHED" and len(marker["candidates"]) == 10 and [c["block_idx"] for c in marker["candidates"]][:2] == [5, 9]
    assert by["response_tail", "后期处置"]["candidates"][0]["disposition"] == "HEADING"
    total = traces.summary(got, blocks).first()
    assert (total["n_rules"], total["n_blocks"]) == (107, 23) and total["matched"] + total["fallback"] + total["missing"] == 106

"""Golden cases of the eight levels: what each shape of a plan must give."""

import pytest

from strataloom.operators import response as R

SCHEMA = "doc_id long, block_idx int, page int, text string, heading_level int, is_table boolean"
TAILS = ["后期处置", "附则", "启动条件调整"]


def rows(spark, *plans):
    """Plans as lists of text, (text, heading level) or (text, heading level, page)."""
    out = []
    for doc, plan in enumerate(plans):
        for k, b in enumerate(plan):
            text, level, page = (b, 0, 5) if isinstance(b, str) else (*b, 5)[:3]
            out.append((doc, k, page, text, level, False))
    return spark.createDataFrame(out, SCHEMA)


def levels(spark, *plans):
    got = R.segments(rows(spark, *plans), TAILS).collect()
    assert len(got) == 8 * len(plans)
    return {(r["doc_id"], r["key"]): r for r in got}


WARNING = [("蓝色预警", 2), "发布条件", "预计可能发生一般事件。", "响应措施", "通知有关单位做好准备。", ("黄色预警", 2), "发布条件", "预计可能发生较大事件。", "响应措施", "在蓝色预警响应措施基础上，加强监测预报。"]
HEADINGS = [("目录", 1), ("Ⅰ级响应 8", 0, 1), ("三、应急响应", 1), ("Ⅰ级响应", 2), "启动条件", "出现特别重大事件。", "响应措施", "成立指挥部组织救援。", ("重大响应", 2), "启动条件", "出现重大事件。", ("后期处置", 1), "善后工作。"]
INLINE = [("应急响应", 1), ("三级响应", 2), "出现较大险情时启动三级响应，指挥部立即组织抢险。", "调度队伍待命。"]
BRIDGE = [("事件分级", 1), "造成十人以上死亡的为一级。", ("应急响应", 1), "应对重大洪水时启动二级响应。"]
TRIGGERS = [("预警响应", 1), "当发布蓝色、黄色预警信息后，加强值守。", "当发布橙色、红色预警信息后，在蓝色预警基础上，转移群众。"]
PLAIN = [("总则", 1), "本法自公布之日起施行。", "任何单位不得瞒报。"]


@pytest.fixture(scope="module")
def found(spark):
    return levels(spark, WARNING, HEADINGS, INLINE, BRIDGE, TRIGGERS, PLAIN)


def test_four_warning_levels_and_inherited_measures(found):
    yellow, blue = found[0, "warning_level_3"], found[0, "warning_level_4"]
    assert (blue["status"], blue["measures"]) == ("EXTRACTED", "通知有关单位做好准备。") and "一般事件" in blue["conditions"]
    assert yellow["inherits"] == ["warning_level_4"] and "较大事件" in yellow["conditions"] and "一般事件" not in yellow["conditions"]
    assert yellow["effective"].split("\n") == ["通知有关单位做好准备。", "在蓝色预警响应措施基础上，加强监测预报。"]
    assert found[0, "warning_level_1"]["status"] == "MISSING" and found[0, "warning_level_1"]["color"] == "red"
    assert all(found[0, f"level_{k}"]["status"] == "MISSING" for k in range(1, 5))


def test_windows_stop_at_the_next_level_and_at_tails(found):
    one, two = found[1, "level_1"], found[1, "level_2"]
    assert one["status"] == "EXTRACTED" and "特别重大事件" in one["conditions"] and one["measures"] == "成立指挥部组织救援。"
    assert two["status"] == "PARTIAL" and "出现重大事件" in two["conditions"] and two["measures"] is None and "善后" not in two["conditions"]


def test_a_sentence_splits_into_condition_and_measure(found):
    three = found[2, "level_3"]
    assert three["conditions"] == "出现较大险情时启动三级响应" and three["measures"] == "指挥部立即组织抢险。\n调度队伍待命。"


def test_a_bridge_gives_the_condition(found):
    assert "重大洪水" in found[3, "level_2"]["conditions"] and found[3, "level_1"]["measures"] is None


def test_one_sentence_names_two_colours(found):
    assert "加强值守" in found[4, "warning_level_4"]["measures"] and "加强值守" in found[4, "warning_level_3"]["measures"]
    red = found[4, "warning_level_1"]
    assert red["inherits"] == ["warning_level_4"] and "加强值守" in red["effective"] and "转移群众" in red["effective"]
    assert "转移群众" not in (found[4, "warning_level_4"]["measures"] or "")


def test_ordinary_text_has_no_levels(spark, found):
    assert all(found[5, k]["status"] == "MISSING" for _, k in found if _ == 5)
    segs = R.segments(rows(spark, PLAIN), TAILS)
    got = {(r["code"], r["key"]) for r in R.complaints(segs).collect()}
    assert ("NO_RESPONSE_STRUCTURE", None) in got and {k for c, k in got if c == "LEVEL_MISSING"} == {f"warning_level_{k}" for k in range(1, 5)}


def test_severity_names_are_told_apart(spark):
    b = R.described(rows(spark, ["启动特别重大响应", "启动重大响应", "启动Ⅱ级响应", "一、二级响应", "洪水响应等级为第三级", "黄色预警"]), TAILS)
    keys = {r["text"]: set(r["keys"]) for r in b.collect()}
    assert keys["启动特别重大响应"] == {"level_1"} and keys["启动重大响应"] == {"level_2"} == keys["启动Ⅱ级响应"]
    assert {"level_1", "level_2"} <= keys["一、二级响应"] and "level_3" in keys["洪水响应等级为第三级"] and keys["黄色预警"] == {"warning_level_3"}

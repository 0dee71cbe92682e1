"""Joins of the level queries whose sides grow with the input go through no driver, and blocks need no list of those before them."""

import random

import pytest

from strataloom.operators import events as E
from strataloom.operators import extras as X
from strataloom.operators import measures as M
from strataloom.operators import response as R
from strataloom.operators import sections as S
from strataloom.operators import shapes
from strataloom.plans import levels as P
from strataloom.plans import results as Q
from strataloom.tables import written

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def known(spark):
    blocks = P._plan(spark, SF).where("doc_id < 20 * 64")
    return written(R.described(blocks, P.TAILS, P.KNOWN, P.MARKERS), "described")


@pytest.fixture(scope="module")
def anchors(known):
    return written(R.mentions(known, P.KNOWN).where("role = 'ANCHOR'"), "anchors")


def test_no_window_is_broadcast(known, anchors):
    assert "Broadcast" not in plan(R.windows(known, anchors))


def test_windows_are_no_longer_than_to_the_next_level(known, anchors):
    spread = R.spread_anchors(anchors)
    assert spread.count() < 20 * anchors.count()
    assert spread.count() >= R.windows(known, anchors).count() > 0


def test_no_section_is_broadcast(known):
    b = known.select("doc_id", "block_idx", "page", "text", "norm", "heading", "heading_level", "tail")
    g = written(E.graded(b, P.KNOWN), "graded")
    assert "Broadcast" not in plan(E.grade_sections(g, P.KNOWN)) and "Broadcast" not in plan(E.event_sections(g))
    responses = tuple(a for v in P.KNOWN if v.category == "EMERGENCY" for a in v.aliases)
    assert "Broadcast" not in plan(M.common_blocks(known, responses, {c: R._compatible(c) for c in ("WARNING", "EMERGENCY")}))


def test_no_outcome_is_broadcast(spark):
    found = written(spark.createDataFrame([(1, "level_1", "MISSING", "HEADING")], "doc_id long, key string, status string, matched_by string"), "found")
    shown = plan(shapes.rule_outcomes(Q.rules.rules_table(spark), found))
    assert "SortMergeJoin" in shown and "BroadcastHashJoin" not in shown


def test_no_chapter_is_broadcast(spark, known):
    found = written(S.candidates(known, Q.rules.rules_table(spark).where("rule_type = 'RESPONSE'")), "candidates")
    ends = S.section_ends(S.best_candidates(found), known)
    assert "Broadcast" not in plan(S.section_texts(ends, known))


def _nearest(blocks, i, back=20):
    """The category of block i, by the lists of blocks that ``category`` does without."""
    seen = blocks[max(0, i - back) : i + 1]
    firm = lambda b: b[1] > 0 or b is blocks[i]
    warn, act = (lambda b: "预警" in b[2]), (lambda b: "应急响应" in b[2])
    stops = [b[0] for b in seen if ((warn(b) or act(b)) and firm(b)) or (b is not blocks[i] and 1 <= b[1] <= 2)]
    for b in seen:
        if not stops or b[0] >= stops[-1]:
            if warn(b) and (firm(b) or not act(b)):
                return "WARNING"
            if act(b):
                return "EMERGENCY"
    return None


def test_category_of_random_blocks(spark):
    pick = random.Random(5)
    docs = {d: [(k, pick.choice([0, 0, 0, 0, 1, 3]), pick.choice(["一", "二", "三", "四", "预警", "应急响应", "预警应急响应"][: pick.choice([4, 7, 7])])) for k in range(pick.choice([1, 30, 60]))] for d in range(60)}
    rows = [(d, *b) for d, blocks in docs.items() for b in blocks]
    df = X.category(spark.createDataFrame(rows, "doc_id long, block_idx int, heading_level int, text string"))
    assert "collect_list" not in plan(df)
    assert {(r["doc_id"], r["block_idx"]): r["nearest"] for r in df.collect()} == {(d, i): _nearest(blocks, i) for d, blocks in docs.items() for i in range(len(blocks))}

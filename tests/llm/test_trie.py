"""The trie of conversations against a plain version: nulls, ties, long conversations, copies, missing bases."""

import hashlib
import random
import zlib

from strataloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, na int"


def plain(convs):
    """Rows of the trie of {conv_id: [(role, text), ...]}."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids, out = {}, []
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    totals = {}
    for p in sorted(nodes, key=len, reverse=True):
        under = [totals[k] for k in kids.get(p, [])]
        saved = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        totals[p] = (sum(u[0] for u in under) or 1, saved + sum(u[1] for u in under))
        ends = sorted(c for c in nodes[p] if len(convs[c]) == len(p))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(kids.get(p, [])), *totals[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def grouped(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((t is not None, t or 0), (role or "", text or "")))
    return {c: [x for _, x in sorted(v, key=lambda x: x[0])] for c, v in convs.items()}


def rebuilt(convs):
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
    base = lambda c: c - (abs(c) % 5) * (1 if c >= 0 else -1)
    return {c: convs.get(base(c), [])[: h[c]] + v[h[c] :] for c, v in convs.items()}


def check(spark, rows, how=None):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = trie.trie(*(how or trie.rebuilt)(trie.turns_of(frame)))
    found = sorted([tuple(r)[:8] for r in got.collect()], key=str)
    convs = grouped(rows)
    assert found == plain(convs if how else rebuilt(convs))
    return got


def test_shared_beginnings_nulls_and_missing_bases(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "bot", None]), r.choice(["a", "bb", "ü", "", None])) for c in [*range(0, 40), 52, 53, 71, -3, -7] for t in range(r.randint(1, 9))]
    rows += [(90, None, "user", "first"), (90, 1, "bot", "x"), (None, 1, "user", "nowhere"), (None, None, None, None)]
    check(spark, rows)


def test_copies_and_repeated_rows(spark):
    copies = [(c, t, "user", f"t{t}") for c in range(100, 160) for t in range(4)]
    twice = [(7, 1, "user", "same"), (7, 1, "user", "same"), (8, 1, "user", "same")]
    got = check(spark, copies + twice, trie.sequences)
    root = got.where("depth = 0").first()
    assert (root["opens"], root["closes"]) == (0, got.count()) and got.select("opens").distinct().count() == got.count()


def test_one_long_conversation(spark):
    rows = [(1, t, "user", f"turn {t % 7}") for t in range(600)] + [(2, t, "user", f"turn {t % 7}") for t in range(300)] + [(3, t, "bot", "x") for t in range(3)]
    check(spark, rows, trie.sequences)


def test_spans_nest(spark):
    r = random.Random(5)
    rows = [(c, t, "u", r.choice("ab")) for c in range(60) for t in range(r.randint(1, 6))]
    got = check(spark, rows, trie.sequences).collect()
    by = {(x["conv_id"], x["depth"]): x for x in got}
    for x in got:
        assert x["closes"] - x["opens"] >= 1 and (x["n_children"] > 0) == (x["closes"] - x["opens"] > 1)
        if x["depth"]:
            up = next(y for y in got if y["conv_id"] == x["parent_conv_id"] and y["depth"] == x["depth"] - 1)
            assert up["opens"] < x["opens"] and x["closes"] <= up["closes"]
    assert by


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.trie(*trie.rebuilt(trie.turns_of(empty))).collect() == []

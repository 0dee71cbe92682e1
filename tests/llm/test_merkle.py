"""Merkle manifests against a plain version: sizes around powers of the fan, nulls, ties, repeated rows, odd columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from strataloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(leaves):
    """The root of a tree, and each leaf's siblings as (left, right) a level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for p, i in zip(paths, at, strict=True):
            low = i - i % 3
            p.append((level[low:i], level[i + 1 : low + 3]))
        level, at = [h(*level[i : i + 3]) for i in range(0, len(level), 3)], [i // 3 for i in at]
    return level[0], paths


def plain(rows):
    leaf = lambda r, t: h(*map(field, r[:4]), field(t))
    groups = {}
    for r in rows:
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        tampered = r[4].replace("\n", "") if even and r[4] is not None else r[4]
        groups.setdefault(r[1], []).append((r[0], leaf(r, r[4]), leaf(r, tampered)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    low = [sorted(groups[n], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for n in names]
    subs = [climb([x[1] for x in g]) for g in low]
    if not subs:
        return []
    root, tops = climb([s[0] for s in subs])
    out = []
    for g, (sub, paths), top in zip(low, subs, tops, strict=True):
        for (doc, kept, found), path in zip(g, paths, strict=True):
            folded = found
            for left, right in path + top:
                folded = h(*left, folded, *right)
            out.append((doc, kept, sub, root, h(*[x for left, right in path + top for x in left + right]), folded, folded == root))
    return sorted(out, key=str)


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    got = [tuple(r) for r in merkle.tamper_check(frame).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_trees_of_many_sizes(spark):
    rows = [(1000 * s + i, f"s{s}", "de", i, f"text {i}\nof {s}") for s, n in enumerate((1, 2, 3, 4, 9, 10, 27, 28, 81, 82, 244)) for i in range(n)]
    check(spark, rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (5, None, "a", 1, ""), (5, "b", None, 2, "x\ny"), (5, "b", None, 2, "x\ny"), (5, "b", "c", 2, "z\n"), (-3, "", "", 0, "\n\n"), (7, "-", "-", 5, "ü-\n"), (9, "ä", "b", 1, "p" * 50_000 + "\n"), (8, "=", "b", 1, "q")]
    check(spark, rows)


def test_one_document_and_none(spark):
    check(spark, [(3, "a", "b", 1, "t\n")])
    assert merkle.tamper_check(spark.createDataFrame([], SCHEMA)).collect() == []


def test_manifest_of_any_rows(spark):
    rows = spark.createDataFrame([(f"k{i}", i % 2, float(i)) for i in range(40)], "name string, part int, value double").withColumn("leaf", merkle.leaf(F.col("name"), F.col("value")))
    kept = merkle.manifest(rows, "part", ["value"])
    assert set(kept.columns) == {"name", "part", "value", "leaf", "subroot", "root", "path"}
    assert merkle.verified(kept, "leaf").where("verified").count() == 40
    assert merkle.verified(kept.withColumn("other", merkle.leaf(F.col("name"), F.col("value") + 1)), "other").where("verified").count() == 0


@pytest.mark.parametrize("value", [b"ab", 1.5, True])
def test_fields_of_other_types_are_their_text(spark, value):
    got = spark.createDataFrame([(value,)], "v " + {bytes: "binary", float: "double", bool: "boolean"}[type(value)]).select(merkle.leaf(F.col("v"))).first()[0]
    assert got == h(field({b"ab": "ab", 1.5: "1.5", True: "true"}[value]))

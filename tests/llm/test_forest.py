"""The forest of projection trees: recall against brute force, equal vectors, values that take no part, chunks."""

import numpy as np
import pytest

from strataloom.llm import forest

SCHEMA = "vec_id long, embedding array<float>, label int, h1 string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x") for i, v in rows], SCHEMA)


def brute(rows, query_ids, k):
    """{query_id: [(vec_id, score), ...]} of vectors that take part."""
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in query_ids:
        score = u @ u[ids == q][0]
        order = [j for j in np.lexsort((ids, -score.round(13))) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def run(spark, rows, k=5):
    valid = forest.valid(frame(spark, rows))
    got = {}
    for r in forest.nearest(valid, valid.where("vec_id % 50 = 0"), k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 24)) * 4
    return [(i, centres[i % 12] + rng.normal(size=24)) for i in range(3000)]


def test_recall_where_vectors_cluster(spark, clusters, monkeypatch):
    monkeypatch.setattr(forest, "SAMPLE_ROWS", 800)
    monkeypatch.setattr(forest, "LEAF_ROWS", 100)
    monkeypatch.setattr(forest, "CHUNK_ROWS", 64)  # leaves of several chunks of rows and queries
    got, want = run(spark, clusters), brute(clusters, range(0, 3000, 50), 5)
    assert set(got) == set(want) and all([r for r, _, _ in v] == [1, 2, 3, 4, 5] for v in got.values())
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    exact = {(q, v): s for q in want for v, s in want[q]}
    assert all(abs(s - exact[q, v]) < 1e-12 for q in got for _, v, s in got[q] if (q, v) in exact)


def test_a_search_opens_few_leaves_where_vectors_cluster(clusters):
    points = forest.unit(np.stack([v for _, v in clusters]))
    found = forest.fit(points, len(points), 5)
    assert len(found.trees) == forest.TREES and found.opened < sum(found.leaves)
    cells = forest.leaf_of(found.trees[0], points)
    assert cells.min() == 0 and cells.max() == found.leaves[0] - 1
    first = forest.open_leaves(found.trees, points[0], 10_000)
    assert len(first) == len(set(first)) == sum(found.leaves) and (0, int(cells[0])) in first[: forest.TREES]


def test_equal_vectors_ties_and_scaled_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400, 0, -1)] + [(500, [1.0, 2.0, 3.0]), (501, [2.0, 4.0, 6.0]), (600, [0.0, 1.0, 0.0]), (601, [0.0, 1.0, 0.0])]
    got = run(spark, rows + rows[:3])
    assert [v for _, v, _ in got[500]] == [1, 2, 3, 4, 5] and [v for _, v, _ in got[50]] == [1, 2, 3, 4, 5]
    assert [v for _, v, _ in got[600]] == [601, 1, 2, 3, 4] and abs(got[600][0][2] - 1) < 1e-15


def test_values_that_take_no_part(spark):
    rows = [(0, [1, 0]), (1, [1, 1]), (2, None), (3, [0, 0]), (4, [None, 1]), (5, [float("nan"), 1]), (6, [float("inf"), 1]), (7, [1, 2, 3]), (8, []), (None, [1, 0]), (50, None), (100, [0, 0])]
    got = run(spark, rows)
    assert {q: [v for _, v, _ in x] for q, x in got.items()} == {0: [1]}


def test_few_or_no_rows(spark):
    assert run(spark, [(0, [1.0, 2.0])]) == {} and run(spark, []) == {} and run(spark, [(3, [1.0, 2.0]), (4, [1.0, 2.0])]) == {}
    assert [v for _, v, _ in run(spark, [(0, [1.0, 2.0]), (0, [2.0, 1.0]), (9, [1.0, 2.1])])[0]] == [9]

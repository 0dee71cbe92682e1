"""Nearest neighbours by cosine: a forest of random-projection trees, searched through one priority queue that all
trees share, and exact scores of all rows in the leaves that are found.

The trees are fitted on a bounded sample and index every row. How many leaves a search opens is measured on the sample
against brute force, so it follows the data: a few leaves where vectors cluster, most of them where they have no
structure at all (then nothing but reading on finds neighbours). Equal vectors are one entry with the smallest ids that
any answer can need, so a vector that a third of all rows share is one entry. Rows and queries of a leaf meet in chunks
of bounded size. Every query is also scored against a few of the sampled vectors: what the nearest of these score is a
lower bound below which leaves need not report, and they complete the answer where leaves report too few."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, only

#: The sample: rows at most, and bytes of their vectors at most.
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 16 << 20
TREES = 8
#: Rows that a leaf should hold, sampled rows that it must be fitted on, and rows or queries of a leaf that meet in one chunk.
LEAF_ROWS, LEAF_SAMPLE, CHUNK_ROWS = 1024, 32, 8192
#: Sampled vectors that give each query its lower bound, at most, and which part of the sample at most.
BOUND_ROWS, BOUND_PART = 2048, 8
#: Sampled queries that measure how many leaves to open, and the recall they have to reach.
PROBES, TARGET = 128, 0.985
KEY = ["h1", "h2"]


@dataclass
class Tree:
    """Nodes of one tree: a plane (normal, offset) and two children each; children below zero are leaves."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray


@dataclass
class Forest:
    trees: list[Tree]
    sample: np.ndarray  # unit vectors
    bounds: np.ndarray  # rows of the sample that bound queries
    opened: int  # leaves that a search opens
    leaves: list[int] = field(default_factory=list)

    @property
    def dim(self) -> int:
        return self.sample.shape[1]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _grow(points: np.ndarray, least: int, rng: np.random.Generator) -> tuple[Tree, int]:
    """A tree that halves the points by the plane between two of them until leaves have ``least`` to twice as many."""
    normals, offsets, children, leaves = [], [], [], 0
    todo = [(np.arange(len(points)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        name, placed = None, None
        for _ in range(8 if len(rows) >= 2 * least else 0):
            a, b = points[rng.choice(rows, 2, replace=False)]
            normal = (a - b) / (np.linalg.norm(a - b) or 1.0)
            placed = points[rows] @ normal
            offset = float(np.median(placed))
            above = placed > offset
            if least <= above.sum() <= len(rows) - least:
                name = len(normals)
                normals.append(normal)
                offsets.append(offset)
                children.append([0, 0])
                todo += [(rows[~above], name, 0), (rows[above], name, 1)]
                break
        if name is None:
            leaves += 1
            name = -leaves
        if parent >= 0:
            children[parent][side] = name
    dim = points.shape[1]
    return Tree(np.array(normals, np.float64).reshape(-1, dim), np.array(offsets), np.array(children, np.int64).reshape(-1, 2)), leaves


def leaf_of(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    """The leaf (from 0) of each unit vector."""
    at = np.zeros(len(vectors), np.int64) if len(tree.children) else np.full(len(vectors), -1)
    live = np.flatnonzero(at >= 0)
    while len(live):
        node = at[live]
        side = np.einsum("ij,ij->i", vectors[live], tree.normals[node]) > tree.offsets[node]
        at[live] = tree.children[node, side.astype(np.int64)]
        live = live[at[live] >= 0]
    return -at - 1


def open_leaves(trees: list[Tree], vector: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The (tree, leaf) pairs that a search for a unit vector opens, best first: one queue holds the nodes of all trees by
    how far on the wrong side of a plane their regions lie at worst."""
    queue = [(-np.inf, t, 0 if len(tree.children) else -1) for t, tree in enumerate(trees)]
    sides = [(tree.normals @ vector - tree.offsets).tolist() for tree in trees]
    kids = [tree.children.tolist() for tree in trees]
    found: list[tuple[int, int]] = []
    while queue and len(found) < most:
        worst, t, node = heapq.heappop(queue)
        while node >= 0:
            margin = sides[t][node]
            heapq.heappush(queue, (max(worst, abs(margin)), t, kids[t][node][margin <= 0]))
            node = kids[t][node][margin > 0]
        found.append((t, -node - 1))
    return found


def fit(sample: np.ndarray, rows: int, k: int, seed: int = 11) -> Forest:
    """A forest for ``rows`` rows of which ``sample`` (unit vectors) is a sample."""
    rng = np.random.default_rng(seed)
    least = max(LEAF_SAMPLE, LEAF_ROWS * len(sample) // max(rows, 1)) // 2
    grown = [_grow(sample, least, rng) for _ in range(TREES)]
    bounds = np.sort(rng.permutation(len(sample))[: min(BOUND_ROWS, len(sample) // BOUND_PART)])
    forest = Forest([t for t, _ in grown], sample, bounds, 0, [n for _, n in grown])
    probes = np.sort(rng.choice(len(sample), min(PROBES, len(sample)), replace=False)) if len(sample) else np.zeros(0, np.int64)
    cells = [leaf_of(t, sample) for t in forest.trees]
    total, needed = sum(forest.leaves), []
    scores = sample[probes] @ sample.T
    scores[np.arange(len(probes)), probes] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, max(len(sample) - 1, 0))]
    for p, neighbours in zip(probes.tolist(), near, strict=True):
        order = {cell: i + 1 for i, cell in enumerate(open_leaves(forest.trees, sample[p], total))}
        needed += [min(order[t, int(cells[t][x])] for t in range(TREES)) for x in neighbours.tolist()]
    # the number of leaves within which the target share of all neighbours was found
    forest.opened = int(np.quantile(needed, TARGET, method="higher")) if needed else total
    return forest


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    return df.select(name).limit(0).toArrow().schema.field(0).type


def valid(embeddings: DataFrame) -> DataFrame:
    """vec_id, h1, h2 and embedding of the rows that take part."""
    rows = only(embeddings, "vec_id", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda x: x != 0.0))
    sizes = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    rows = rows.where(F.size("embedding") == (sizes["dim"] if sizes else 0))
    return rows.withColumns({"h1": F.xxhash64(F.lit(1), "embedding"), "h2": F.xxhash64(F.lit(2), "embedding")})


def entries_of(rows: DataFrame, k: int) -> DataFrame:
    """One row for each distinct vector: its hash, the k + 1 smallest ids that have it (no answer needs more), and it.

    Spark limits the ranks of a group before the shuffle, so a vector that many rows share is no hot key."""
    ranked = rows.withColumn("rank", F.dense_rank().over(Window.partitionBy(*KEY).orderBy("vec_id"))).where(F.col("rank") <= k + 1)
    return ranked.groupBy(*KEY).agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("embedding").alias("embedding"))


def sampled(entries: DataFrame, n: int) -> tuple[np.ndarray, list[list[int]]]:
    """Unit vectors and ids of about SAMPLE_ROWS entries (all, if no more), those whose hashes are smallest."""
    first = entries.select(F.size("embedding").alias("dim")).first()
    if not first:
        return np.zeros((0, 1)), []
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (4 * first["dim"])))
    parts = 1 << 40
    kept = entries if n <= most else entries.where(F.pmod("h1", F.lit(parts)) < most * parts // n)
    got = kept.orderBy(*KEY).select("ids", "embedding").toArrow()
    return unit(_matrix(got["embedding"], first["dim"])), got["ids"].to_pylist()


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a with that of b; a pair's score does not depend on which other pairs are scored."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def best_pairs(queries: np.ndarray, vectors: np.ndarray, floor: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and exact cosine of each pair that is among the query's ``most`` best (ties included) and not below its floor."""
    if not len(vectors):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    rough = unit(queries) @ unit(vectors).T
    least = floor - 1e-9
    if len(vectors) > most:
        least = np.maximum(least, np.partition(rough, len(vectors) - most, axis=1)[:, len(vectors) - most] - 1e-9)
    q, v = np.nonzero(rough >= least[:, None])
    return q, v, _cosines(queries[q], vectors[v])


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows nearest to each query that the search finds (all other rows, if there are fewer): query_id, rank,
    vec_id, score. ``rows`` and ``queries`` are results of ``valid``; a query's own id is no candidate.

    Ties go to the smaller vec_id. Repeated rows count once. An id with several vectors is as near as its nearest one,
    as a query too. No rows or no queries: no result."""
    spark = rows.sparkSession
    entries = materialise(entries_of(rows, k), "entries")
    n = entries.count()
    sample, sample_ids = sampled(entries, n)
    forest = fit(sample, n, k)
    bases = np.concatenate([[0], np.cumsum(forest.leaves)]).astype(np.int64)
    share = n / max(len(sample), 1)
    # rows of a leaf are estimated from the sample, queries of a leaf are counted
    sizes = np.concatenate([np.bincount(leaf_of(t, sample), minlength=m) for t, m in zip(forest.trees, forest.leaves, strict=True)]) * share
    row_chunks = np.maximum(1, np.ceil(sizes / CHUNK_ROWS)).astype(np.int64)
    forest.sample = sample[forest.bounds]
    shared = spark.sparkContext.broadcast((forest, [sample_ids[i] for i in forest.bounds.tolist()]))
    kind = entries.schema["embedding"].dataType.simpleString()
    id_kind = rows.schema["vec_id"].dataType.simpleString()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, ids = shared.value
        for batch in batches:
            vectors = _matrix(batch.column("embedding"), forest.dim)
            for low in range(0, len(vectors), 256):
                part = vectors[low : low + 256]
                q, v, score = best_pairs(part, forest.sample, np.full(len(part), -np.inf), k + 1)  # nothing, if nothing bounds
                known, floor = [[] for _ in part], np.full(len(part), -np.inf)
                for i in range(len(part)):
                    mine = np.flatnonzero(q == i)
                    known[i] = [{"score": float(score[m]), "ids": ids[v[m]]} for m in mine]
                    if len(mine) > k:
                        floor[i] = np.sort(score[mine])[-(k + 1)]
                cells = [[int(bases[t] + leaf) for t, leaf in open_leaves(forest.trees, u, forest.opened)] for u in unit(part)]
                here = batch.slice(low, len(part))
                columns = [here.column("h1"), here.column("h2"), here.column("embedding"), pa.array(floor), pa.array(cells, pa.list_(pa.int64())), pa.array(known, pa.list_(pa.struct([("score", pa.float64()), ("ids", here_ids)])))]
                yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "embedding", "floor", "cells", "known"])

    here_ids = pa.list_(_arrow(entries, "ids").value_type)
    asked = queries.groupBy(*KEY).agg(F.first("embedding").alias("embedding"))
    asked = asked.mapInArrow(route, f"h1 bigint, h2 bigint, embedding {kind}, floor double, cells array<bigint>, known array<struct<score:double,ids:array<{id_kind}>>>")
    asked = materialise(asked, "queries")
    counted = {r["cell"]: r["count"] for r in asked.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()}  # a row for each leaf of the forest
    query_chunks = np.array([-(-counted.get(c, 0) // CHUNK_ROWS) for c in range(int(bases[-1]))], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, _ = shared.value
        for batch in batches:
            vectors, chunk = unit(_matrix(batch.column("embedding"), forest.dim)), batch.column("h1").to_numpy() % (1 << 40)
            for t, tree in enumerate(forest.trees):
                cell = bases[t] + leaf_of(tree, vectors)
                at = np.repeat(np.arange(len(cell)), query_chunks[cell])
                of = np.concatenate([np.arange(m) for m in query_chunks[cell]]) if len(at) else at
                taken = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(cell[at]), pa.array(chunk[at] % row_chunks[cell[at]]), pa.array(of), taken.column("ids"), taken.column("embedding")], ["cell", "row_chunk", "query_chunk", "ids", "embedding"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = not left.num_rows or not right.num_rows
        dim = shared.value[0].dim
        q, v, found = best_pairs(*(np.zeros((0, dim)),) * 2, np.zeros(0), k + 1) if empty else best_pairs(_matrix(left["embedding"], dim), _matrix(right["embedding"], dim), left["floor"].to_numpy(), k + 1)
        a, b = left.select(["h1", "h2"]).take(pa.array(q)), right.select(["ids"]).take(pa.array(v))
        return pa.table({"h1": a["h1"], "h2": a["h2"], "score": pa.array(found, pa.float64()), "ids": b["ids"]})

    sizes = [(c, int(query_chunks[c]), int(row_chunks[c])) for c in range(int(bases[-1]))]  # a row for each leaf of the forest
    chunks = F.broadcast(spark.createDataFrame(sizes, "cell bigint, query_chunks bigint, row_chunks bigint"))
    left = asked.select(*KEY, "embedding", "floor", F.explode("cells").alias("cell")).join(chunks, "cell")
    left = left.withColumn("query_chunk", F.pmod("h2", "query_chunks")).withColumn("row_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("row_chunks") - 1))).drop("query_chunks", "row_chunks")
    right = entries.mapInArrow(place, f"cell bigint, row_chunk bigint, query_chunk bigint, ids array<{id_kind}>, embedding {kind}")
    meet = ["cell", "row_chunk", "query_chunk"]
    hits = left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInArrow(score, f"h1 bigint, h2 bigint, score double, ids array<{id_kind}>")
    hits = hits.unionByName(asked.select(*KEY, F.explode("known").alias("s")).select(*KEY, "s.score", "s.ids"))

    best = hits.select(*KEY, "score", F.explode("ids").alias("vec_id")).groupBy(*KEY, "vec_id").agg(F.max("score").alias("score"))
    order = [F.desc("score"), "vec_id"]
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).where(F.col("rank") <= k + 1)
    answers = best.groupBy(*KEY).agg(F.collect_list(F.struct("vec_id", "score")).alias("found"))
    own = queries.select(F.col("vec_id").alias("query_id"), *KEY).distinct().join(answers, KEY)
    pairs = own.select("query_id", F.explode("found").alias("f")).where(F.col("f.vec_id") != F.col("query_id"))
    pairs = pairs.groupBy("query_id", "f.vec_id").agg(F.max("f.score").alias("score"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

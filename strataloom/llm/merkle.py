"""Merkle manifests of datasets: a tree of digests for each group of rows, a tree over the groups' roots, and for every
row the siblings that lead from its leaf to the root.

Trees have a fan of three. Nodes are built four levels at a time from runs of 81, so a tree of any size is built by many
tasks. A leaf's proof is looked up by coordinates: index and group size tell which siblings it needs in the next four
levels; these are exploded, joined with the table of nodes, ordered and concatenated. The node four levels up looks up
the rest for all its 81 leaves, so no node is asked for more than 54 times, however large its tree is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, only
from .ordered import in_order, numbered

FAN = 3
#: Levels that one round builds or looks up.
STEP = 4
RUN = FAN**STEP
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return digest(*[field(c) for c in columns])


def _depth(total: str) -> Column:
    """Levels above the leaves of a tree: powers of the fan below the number of leaves."""
    powers = F.array(*[F.lit(FAN**k).cast("bigint") for k in range(40)])
    return F.size(F.filter(powers, lambda p: p < F.col(total))).alias("depth")


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("bigint"))


def _above(level: str) -> Column:
    """The digests of the runs of a level."""
    runs = F.sequence(F.lit(0), _div(F.size(level).cast("bigint") - 1, FAN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * FAN + 1, FAN), "").cast("binary"), 256))


@dataclass
class Forest:
    """Trees whose leaves are numbered. ``rounds``: for every STEP levels the nodes that they start from and those that they make."""

    rounds: list[tuple[DataFrame, DataFrame]]

    def roots(self) -> DataFrame:
        """tree, depth and digest of the root of each tree."""
        lone = self.rounds[0][0].where("depth = 0").select("tree", "depth", "digest")
        for _, made in self.rounds:
            lone = lone.unionByName(made.where("level = depth").select("tree", "depth", "digest"))
        return lone


def build(leaves: DataFrame, name: str) -> Forest:
    """Trees over leaves of ``tree, index, total, digest``; indexes run from 0 to total - 1 in every tree."""
    base = leaves.select("tree", "index", "total", _depth("total"), "digest")
    top = base.agg(F.max("depth")).first()[0] or 0
    rounds = []
    for low in range(0, max(top, 1), STEP):
        rows = base.withColumn("block", _div(F.col("index"), RUN)).groupBy("tree", "block", "total", "depth")
        rows = rows.agg(F.sort_array(F.collect_list(F.struct("index", "digest"))).alias("run"))
        rows = rows.withColumn("l0", F.col("run.digest"))
        for k in range(STEP):
            rows = rows.withColumn(f"l{k + 1}", F.when(F.col("depth") > low + k, _above(f"l{k}")))
        made = None
        for k in range(1, STEP + 1):
            at = rows.select("tree", "total", "depth", F.lit(low + k).alias("level"), "block", F.posexplode(f"l{k}").alias("i", "digest"))
            at = at.select("tree", (F.col("block") * FAN ** (STEP - k) + F.col("i")).alias("index"), "total", "depth", "digest", "level")
            made = at if made is None else made.unionByName(at)
        made = materialise(made, f"{name}-nodes")
        rounds.append((base, made))
        base = made.where(f"level = {low + STEP} AND depth > {low + STEP}").drop("level")
    return Forest(rounds)


def paths(forest: Forest, tops: DataFrame, name: str, own: DataFrame) -> DataFrame:
    """For each leaf its siblings on the way up, left and right of it, a pair for each level, and the columns of ``tops``.

    ``tops``: tree, depth, path (of what the tree's root is a leaf of, or empty) and any other columns.
    ``own``: tree, index, total and columns to carry along of all leaves."""
    more = [c for c in tops.columns if c not in ("tree", "depth", "path")]
    up, out = None, None
    for low, (base, made) in reversed([(STEP * i, r) for i, r in enumerate(forest.rounds)]):
        index, wanted = F.col("index"), []
        for k in range(STEP):
            at, count = _div(index, FAN**k), _div(F.col("total") + (FAN ** (low + k) - 1), FAN ** (low + k))
            for j in range(FAN):
                sibling = at - at % FAN + j
                needed = (F.col("depth") > low + k) & (sibling != at) & (sibling < count)
                wanted.append(F.struct(needed.alias("needed"), F.lit(low + k).alias("level"), sibling.alias("at"), (sibling < at).alias("left")))
        asked = base.select("tree", "index", F.explode(F.filter(F.array(*wanted), lambda w: w["needed"])).alias("w")).select("tree", "index", "w.level", "w.at", "w.left")
        nodes = base.select("tree", F.lit(low).alias("level"), F.col("index").alias("at"), "digest").unionByName(made.where(F.col("level") < low + STEP).select("tree", "level", F.col("index").alias("at"), "digest"))
        found = asked.join(nodes, ["tree", "level", "at"]).select("tree", "index", F.struct("level", "at", "left", "digest").alias("s"))
        itself = base.select("tree", "index", "depth") if low else own.withColumn("depth", _depth("total")).drop("total")
        carried = [c for c in itself.columns if c not in ("tree", "index", "depth")]
        rows = itself.unionByName(found, allowMissingColumns=True).withColumn("block", _div(index, RUN)).repartition("tree", "block")
        rows = rows.groupBy("tree", "block", "index").agg(F.max("depth").alias("depth"), F.sort_array(F.collect_list("s")).alias("s"), *[F.max(c).alias(c) for c in carried])
        side = lambda k, left: F.array_join(F.transform(F.filter("s", lambda s: (s["level"] == k) & (s["left"] == left)), lambda s: s["digest"]), "")
        levels = F.filter(F.sequence(F.lit(low), F.lit(low + STEP - 1)), lambda k: k < F.col("depth"))
        rows = rows.withColumn("path", F.transform(levels, lambda k: F.struct(side(k, True).alias("left"), side(k, False).alias("right"))))
        here = tops.where((F.col("depth") <= low + STEP) & (F.col("depth") > (low if low else -1))).select("tree", F.lit(0).cast("bigint").alias("block"), F.col("path").alias("rest"), *more)
        up = here if up is None else up.select("tree", F.col("index").alias("block"), F.col("path").alias("rest"), *more).unionByName(here)
        out = rows.join(up, ["tree", "block"]).select("tree", "index", F.concat("path", "rest").alias("path"), *more, *carried)
        up = materialise(out, f"{name}-paths") if low else None
    return out


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda at, s: digest(s["left"], at, s["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def manifest(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` (with a column ``leaf``) with ``subroot`` and ``root``, and the ``path`` of siblings from leaf to root.

    Leaves of a group stand in the order of the named columns (nulls first), rows that tie by leaf; groups stand in
    the order of their names, null first, bytes compared. A null group is a group. Repeated rows are leaves of
    their own. An empty table has no leaf, no root and no row."""
    keys = {f"o{i}": c for i, c in enumerate(order)}
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("tree")
    table = rows.select(F.struct(*rows.columns).alias("own"), tree, F.col(group).alias("group"), *[F.col(c).alias(k) for k, c in keys.items()], "leaf")
    table = in_order(materialise(table, "leaves"), ["group", *keys, "leaf"], "ordered-leaves")
    leaves = materialise(numbered(table, ["tree"], "leaves"), "numbered-leaves")
    trees = build(leaves.withColumn("digest", F.col("leaf")), "groups")
    named = leaves.where("index = 0").select("tree", F.col("group").alias("name"))
    roots = materialise(trees.roots().join(named, "tree").withColumnRenamed("tree", "of"), "subroots")
    ranked = numbered(in_order(roots.withColumn("tree", F.lit("root")), ["name"], "ordered-subroots"), ["tree"], "subroots")
    ranked = materialise(ranked, "numbered-subroots")
    above = build(ranked.select("tree", "index", "total", "digest"), "root")
    first = above.roots().first()
    root = F.lit(first["digest"] if first else None).cast("string").alias("root")
    start = ranked.limit(1).select(F.lit("root").alias("tree"), F.lit(first["depth"] if first else 0).alias("depth"), F.array().cast(_PATH).alias("path"))
    carried = ranked.select("tree", "index", "total", F.struct(F.col("of"), F.col("depth"), F.col("digest")).alias("group"))
    tops = paths(above, start, "root", carried).select(F.col("group.of").alias("tree"), F.col("group.depth").alias("depth"), "path", F.col("group.digest").alias("subroot"))
    own = leaves.select("tree", "index", "total", "own")
    out = paths(trees, materialise(tops, "tops"), "groups", own)
    return out.select("own.*", "subroot", root, "path")


def verified(rows: DataFrame, leaf: str, kept: str = "path") -> DataFrame:
    """``rows`` of a manifest with what ``leaf`` and the kept siblings fold to, and whether that is the root."""
    folded = rows.withColumn("folded_root", fold(F.col(leaf), F.col(kept)))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def tamper_check(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and which documents it still vouches for after the new-line characters have gone
    from the texts of those whose id has an even CRC-32.

    Leaves take doc_id, source, lang, n_chars and text, null or not; other columns take no part, whatever their names.
    A null doc_id is never tampered with. A null or empty text, and one without new lines, stays as it is, so its
    document verifies. Repeated rows are leaves of their own and each gets a row."""
    rows = only(docs, *COLUMNS)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.translate(F.col("text").cast("string"), "\n", "")).otherwise(F.col("text").cast("string"))
    others = [F.col(c) for c in COLUMNS[:-1]]
    rows = rows.select("doc_id", "source", leaf(*others, F.col("text")).alias("leaf"), leaf(*others, text).alias("found_leaf"))
    found = verified(manifest(rows, "source", ["doc_id"]), "found_leaf")
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")

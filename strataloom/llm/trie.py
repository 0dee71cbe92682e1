"""A trie of conversations: its nodes are the distinct sequences of first turns, its edges turns.

A node is named by its depth and 128 bits of its turns: each turn is hashed with its depth, and the hashes of a prefix
combine by exclusive or, so the names of all prefixes are running sums over conversations of any length. Nodes get the
interval encoding of a preorder: their sort keys order them lexicographically, with the child that most conversations
pass through first. A key then only names the turns at which a path leaves such first children, at most log2 of the
number of conversations, however deep the node is. Every node opens and closes an interval; what its subtree holds is
the difference of two prefix sums over the sorted ends of intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, only
from .ordered import groups, in_order, running

NODE = ["depth", "na", "nb"]
#: Deeper turns than this have no place in a sort key.
MOST_DEPTH = 0x7FFFFFFF
#: Ids that one row of a node's list of members holds.
LIST_ROWS = 1024
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """The turns in the order of their conversations (null turn first, turns of one number by a hash of role and text),
    written: conv_id, two hashes of role and text (``a``, ``b``), ``bytes`` of text, ``part`` and ``place``.

    Null roles and texts are empty; rows without conv_id belong to no conversation; repeated rows are turns of their own."""
    rows = only(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    rows = rows.select("conv_id", "turn", F.xxhash64(F.lit(1), *said).alias("a"), F.xxhash64(F.lit(2), *said).alias("b"), F.octet_length(said[1]).cast("bigint").alias("bytes"))
    return in_order(materialise(rows, "turns"), ["conv_id", "turn", "a", "b"], "ordered-turns")


def _root() -> list[Column]:
    return [F.lit(0).cast("bigint").alias(n) for n in NODE]


def _shared(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % 9


def sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: their turns (conv_id, depth from 1, a, b, bytes) and lengths (conv_id, len)."""
    at = materialise(groups(turns, ["conv_id"]), "conversations")
    rows = turns.join(at, ["part", "conv_id"]).select("conv_id", (F.col("place") - F.col("first") + F.col("before") + 1).alias("depth"), "a", "b", "bytes")
    return rows, at.groupBy("conv_id").agg(F.max("total").alias("len"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: conversation c is the first h turns of conversation c - c % 5, as far as it
    has them, then its own turns but its first h, where h is the CRC-32 of c's decimal digits modulo 9."""
    at = materialise(groups(turns, ["conv_id"]), "conversations")
    h, of = _shared(F.col("conv_id")), F.col("conv_id") - F.col("conv_id") % 5
    convs = at.groupBy("conv_id").agg(F.max("total").alias("total")).select("conv_id", "total", h.alias("h"), of.alias("of"))
    convs = convs.join(convs.select(F.col("conv_id").alias("of"), F.col("total").alias("has")), "of", "left")
    convs = materialise(convs.withColumn("taken", F.least("h", F.coalesce("has", F.lit(0)))), "shares")
    placed = turns.join(at.join(convs.select("conv_id", "h", "taken", "of"), "conv_id"), ["part", "conv_id"])
    placed = placed.withColumn("at", F.col("place") - F.col("first") + F.col("before"))
    own = placed.where(F.col("at") >= F.col("h")).select("conv_id", (F.col("at") - F.col("h") + F.col("taken") + 1).alias("depth"), "a", "b", "bytes")
    lent = placed.where((F.col("of") == F.col("conv_id")) & (F.col("at") < 9)).select("of", "at", "a", "b", "bytes")
    lent = lent.join(convs, "of").where(F.col("at") < F.col("taken")).select("conv_id", (F.col("at") + 1).alias("depth"), "a", "b", "bytes")
    return own.unionByName(lent), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("len"))


def _members(rows: DataFrame) -> DataFrame:
    """Each turn of each conversation with the node that it leads to (NODE) and the node before it (ua, ub)."""
    hashed = rows.select("conv_id", "depth", "bytes", F.xxhash64(F.lit(3), "depth", "a", "b").alias("ga"), F.xxhash64(F.lit(4), "depth", "b", "a").alias("gb"))
    table = in_order(materialise(hashed, "steps"), ["conv_id", "depth"], "ordered-steps")
    summed = running(table, ["conv_id"], {"na": F.col("ga"), "nb": F.col("gb")}, "prefixes", F.bit_xor)
    return summed.select("conv_id", *NODE, F.col("na").bitwiseXOR(F.col("ga")).alias("ua"), F.col("nb").bitwiseXOR(F.col("gb")).alias("ub"), "bytes")


def _hex(x: Column, digits: int) -> Column:
    return F.lpad(F.hex(x), digits, "0")


def _list_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of the pieces of each node's list; pieces come in order, nodes one after the other."""
    node, found, done = None, None, {k: [] for k in (*NODE, "ends_sha256")}

    def close() -> None:
        for k, v in zip(NODE, node, strict=True):
            done[k].append(v)
        done["ends_sha256"].append(found.hexdigest())

    schema = pa.schema([*[(k, pa.int64()) for k in NODE], ("ends_sha256", pa.string())])
    for batch in batches:
        for *this, text in zip(*[batch.column(k).to_pylist() for k in (*NODE, "ids")], strict=True):
            if this == node:
                found.update(b",")
            else:
                if node is not None:
                    close()
                node, found = this, hashlib.sha256()
            found.update(text.encode())
        if done["depth"]:
            yield pa.RecordBatch.from_pydict(done, schema)
            done = {k: [] for k in done}
    if node is not None:
        close()
        yield pa.RecordBatch.from_pydict(done, schema)


def _ends(members: DataFrame, convs: DataFrame) -> DataFrame:
    """For each node that is a whole conversation, the SHA-256 of these conversations' ids, ascending and comma-joined.
    Lists are made in pieces by many tasks; hashing one, which nothing can split, streams its pieces."""
    last = members.join(convs.where("len > 0").withColumnRenamed("len", "depth"), ["conv_id", "depth"]).select(*NODE, "conv_id")
    none = convs.where("len = 0").select(*_root(), "conv_id")
    rows = in_order(last.unionByName(none), [*NODE, "conv_id"], "ends")
    pieces = rows.groupBy(*NODE, "part", F.call_function("div", F.col("place"), F.lit(LIST_ROWS).cast("bigint")).alias("piece"))
    pieces = pieces.agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "part", "piece").select(*NODE, "ids")
    return dealt.mapInArrow(_list_hashes, "depth bigint, na bigint, nb bigint, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of conversations given by their turns (conv_id, depth, a, b, bytes; depths from 1
    without gaps) and lengths (conv_id, len; 0 for conversations without turns).

    conv_id (smallest member) and depth name the node and its last turn; parent_conv_id (null for the root), n_convs
    (members), n_children, n_leaves (childless nodes of the subtree, the top included), saved_tokens (over the
    subtree, members but one times bytes of the last text), ends_sha256 (ids of members that end here), and the places
    ``opens`` and ``closes`` that the subtree has in preorder. No conversations have no trie, not even a root."""
    members = materialise(_members(rows), "members")
    nodes = members.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("ua").alias("ua"), F.first("ub").alias("ub"), F.first("bytes").alias("bytes"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*_root(), "conv_id", "n_convs", F.lit(None).cast("bigint").alias("ua"), F.lit(None).cast("bigint").alias("ub"), F.lit(0).cast("bigint").alias("bytes"))
    nodes = materialise(nodes.unionByName(root), "nodes")

    parents = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("ua").alias("na"), F.col("ub").alias("nb"))
    parents = materialise(parents.agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", "na", "nb")).alias("heavy")), "parents")
    above = parents.join(nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id")), NODE)
    above = above.select((F.col("depth") + 1).alias("depth"), F.col("na").alias("ua"), F.col("nb").alias("ub"), "parent_conv_id", F.col("heavy.na").alias("ha"), F.col("heavy.nb").alias("hb"))
    known = nodes.join(above, ["depth", "ua", "ub"], "left").join(parents.drop("heavy"), NODE, "left")
    light = (F.col("na") != F.col("ha")) | (F.col("nb") != F.col("hb"))
    known = materialise(known.select(*NODE, "conv_id", "parent_conv_id", "n_convs", "bytes", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce(light, F.lit(False)).alias("light")), "known-nodes")

    leaves = members.join(known.where("light").select(*NODE), NODE).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*NODE))).alias("turns"))
    keyed = known.join(leaves, "conv_id", "left")
    left = F.filter(F.coalesce("turns", F.array().cast("array<struct<depth:bigint,na:bigint,nb:bigint>>")), lambda t: t["depth"] <= F.col("depth"))
    stem = F.array_join(F.transform(left, lambda t: F.concat(F.lit("1"), _hex(MOST_DEPTH + 1 - t["depth"], 8), _hex(t["na"], 16), _hex(t["nb"], 16))), "")
    ends = F.array(
        F.struct(F.concat("stem", F.lit("0"), _hex(F.col("depth"), 8)).alias("key"), F.lit(1).alias("node"), (F.col("n_children") == 0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")),
        F.struct(F.concat("stem", F.lit("1"), _hex(MOST_DEPTH - F.col("depth"), 8), F.lit("G")).alias("key"), F.lit(0).alias("node"), F.lit(0).cast("bigint").alias("leaf"), F.lit(0).cast("bigint").alias("saved")),
    )
    ends = keyed.select(*NODE, "n_children", "n_convs", "bytes", stem.alias("stem")).select(*NODE, F.explode(ends).alias("e")).select(*NODE, "e.*")
    table = in_order(materialise(ends, "interval-ends"), ["key"], "preorder").drop("key")
    summed = running(table, [], {"nodes": F.col("node"), "leaves": F.col("leaf"), "savings": F.col("saved")}, "preorder")
    opened = F.col("node") == 1
    gained = lambda total, own: F.sum(F.when(opened, F.col(own) - F.col(total)).otherwise(F.col(total)))
    spans = summed.groupBy(*NODE).agg(gained("leaves", "leaf").alias("n_leaves"), gained("savings", "saved").alias("saved_tokens"), (F.min("nodes") - 1).alias("opens"), F.max("nodes").alias("closes"))
    out = known.join(spans, NODE).join(_ends(members, convs), NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "opens", "closes")

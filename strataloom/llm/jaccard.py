"""N-gram Jaccard join by rare-first prefix filtering, and the classes of linked documents.

A document's set holds the hashes of its distinct 5-word shingles (all its words as one when
they are fewer). Two documents link when 100 * |A and B| >= 80 * |A or B|.

1. Documents with equal sets fall into one class before anything is joined.
2. Shingles are ordered rare first: by a fixed-size table of counts over all documents, then
   by hash. Documents that link share a shingle among the first |A| - ceil(0.8 |A|) + 1.
3. Prefix shingles that two classes or more share are kept; a bitmap of them, also of fixed
   size, lets most others go before rows are made. A group of two is one pair; in a larger one
   each class pairs with the smallest class of its groups that the length and positional
   filters admit. Pairs pass the suffix filter, and each is verified once on the full sets.
   Connected components follow.
4. Groups of three and more that still hold several components are joined across components
   only, by classes of length and position first, so every candidate pair that could still add
   a link between components is verified, once.

Pairs inside a component are never formed: copies cost what a chain of links costs.

Defined cases: null, empty or wordless texts have empty sets and link with nothing; a null
doc_id is no id: its row links like any other, but a component takes the smallest id that is not
null (null if there is none); ids may be of any type with an order; rows with one doc_id and
different texts are documents of their own; rows that repeat doc_id and text give a row each,
and ``drop_near_copies`` keeps one of them; equal smallest ids are told apart by a hash of the
text; an empty table gives none; extra columns, also those named like the operator's own, are
kept by ``drop_near_copies`` and else ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WORDS = 5
PERCENT = 80
#: Counters of the table that orders shingles (one byte each when broadcast), bits of the bitmap of shared
#: shingles, and parts in which both are made. Their sizes are fixed, so they may be broadcast.
COUNTERS = 1 << 24
BITS = 1 << 27
TABLE_PARTS = 64
#: Bits of a key that hold a hash of the text; those before them hold the id.
ID_SHIFT = 20
#: Parts of the hash range in which the suffix filter compares counts.
PARTS = 48


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, by row and hash."""
    _, _, row, hashes = C.words_of(data, off, C.NOT_SPACE, lower=True)
    n = len(off) - 1
    at, value = C.grams(hashes, row, WORDS)
    owner = row[at]
    count = np.bincount(row, minlength=n)
    few = np.flatnonzero((count > 0) & (count < WORDS))
    if len(few):
        first = np.searchsorted(row, few)
        whole = np.zeros(len(few), np.uint64)
        for j in range(WORDS - 1):
            has = count[few] > j
            whole[has] = whole[has] * np.uint64(0xD6E8FEB86659FD93) + hashes[first[has] + j]
        owner = np.concatenate([owner, few])
        value = np.concatenate([value, C.mix(whole + count[few].astype(np.uint64))])
    order = C.by_row_and_value(owner, value)
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def prefix_size(n):
    """How many of the first of n shingles are enough."""
    return n - -(-PERCENT * n // 100) + 1


def _describe(keyed: DataFrame) -> DataFrame:
    """part -1: (key, doc_id, n, high, low, blob: counts by part of the hash range) of a document; part 0 and above: (blob) counters of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        counts = np.zeros(COUNTERS, np.uint32)
        names = ["part", "key", "doc_id", "n", "high", "low", "blob"]
        id_kind = None
        for whole in batches:
            for batch in C.slices(whole):
                row, value = shingle_sets(*C.bytes_view(batch["text"]))
                rows, id_kind = batch.num_rows, batch["doc_id"].type
                place, times = np.unique(_counter(value), return_counts=True)
                counts[place] += times.astype(np.uint32)
                n = np.bincount(row, minlength=rows)
                edge = np.concatenate([[0], np.cumsum(n)])
                sums = []
                for salt in (1, 2):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(value + np.uint64(salt)), dtype=np.uint64)])
                    sums.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
                part = ((value & np.uint64(0xFFFFFFFF)) * np.uint64(PARTS) >> np.uint64(32)).astype(np.int64)
                parts = np.bincount(row * PARTS + part, minlength=rows * PARTS).astype("<u4").reshape(rows, PARTS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, -1, np.int32)), batch["key"], batch["doc_id"], pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)
        if id_kind is None:  # a partition without rows has nothing to count
            return
        press = zstandard.ZstdCompressor(level=1)
        blobs = [press.compress(c.tobytes()) for c in np.split(counts, TABLE_PARTS)]
        none = pa.nulls(TABLE_PARTS, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TABLE_PARTS, dtype=np.int32)), none, pa.nulls(TABLE_PARTS, id_kind), none, none, none, pa.array(blobs, pa.binary())], names=names)

    id_type = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.select("key", "doc_id", "text").mapInArrow(run, f"part int, key bigint, doc_id {id_type}, n bigint, high bigint, low bigint, blob binary")


def _counter(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(40)).astype(np.int64)


def _bit(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(37)).astype(np.int64)


def _rarity(described: DataFrame) -> np.ndarray:
    """For each counter the logarithm of its count in eighths: COUNTERS bytes in all, whatever the corpus."""
    import zstandard

    def total(table: pa.Table) -> np.ndarray:
        out = np.zeros(COUNTERS // TABLE_PARTS, np.uint64)
        for blob in table["blob"]:
            out += np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), np.uint32)
        return np.minimum(out, (1 << 32) - 1).astype(np.uint32)

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"part": table["part"][:1], "blob": pa.array([zstandard.ZstdCompressor(level=1).compress(total(table).tobytes())], pa.binary())})

    def finish(table: pa.Table) -> pa.Table:
        level = np.minimum(8 * np.log2(1.0 + total(table)), 255).astype(np.uint8)
        return pa.table({"part": table["part"][:1], "blob": pa.array([level.tobytes()], pa.binary())})

    counters = described.where("part >= 0").select("part", "blob", F.pmod(F.xxhash64("blob"), F.lit(32)).alias("some"))
    some = counters.groupBy("part", "some").applyInArrow(add, "part int, blob binary")
    parts = some.groupBy("part").applyInArrow(finish, "part int, blob binary").collect()
    return _joined(parts, COUNTERS)


def _joined(parts: list, size: int) -> np.ndarray:
    """A table from its parts; a table without documents has none and is all zero."""
    return np.concatenate([np.frombuffer(r["blob"], np.uint8) for r in sorted(parts, key=lambda r: r["part"])]) if parts else np.zeros(size, np.uint8)


def _bitmap(prints: DataFrame) -> np.ndarray:
    """BITS bits, as bytes, with those of the given prints set."""
    size = BITS // TABLE_PARTS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packed = np.zeros(BITS // 8, np.uint8)
        for batch in batches:
            at = _bit(batch["print"].to_numpy().view(np.uint64))
            np.bitwise_or.at(packed, at >> 3, (1 << (at & 7)).astype(np.uint8))
        press = zstandard.ZstdCompressor(level=1)
        yield pa.RecordBatch.from_pydict({"part": pa.array(np.arange(TABLE_PARTS), pa.int32()), "blob": pa.array([press.compress(p.tobytes()) for p in np.split(packed, TABLE_PARTS)], pa.binary())})

    def join(table: pa.Table) -> pa.Table:
        import zstandard

        out = np.zeros(size // 8, np.uint8)
        for blob in table["blob"]:
            out |= np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), np.uint8)
        return pa.table({"part": table["part"][:1], "blob": pa.array([out.tobytes()], pa.binary())})

    marked = prints.select("print").mapInArrow(mark, "part int, blob binary")
    parts = marked.groupBy("part").applyInArrow(join, "part int, blob binary").collect()
    return _joined(parts, BITS // 8)


def _prefixes(keyed: DataFrame, rank, bitmap=None) -> DataFrame:
    """(print, key, n, pos): the rare-first prefix of each document's set. rank: broadcast of _rarity; bitmap: of _bitmap, then only prints in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value if bitmap is not None else None
        for whole in batches:
            for batch in C.slices(whole):
                row, value = shingle_sets(*C.bytes_view(batch["text"]))
                n = np.bincount(row, minlength=batch.num_rows)
                weight = rank.value[_counter(value)].astype(np.uint64)
                order = C.by_row_and_value(row, (weight << np.uint64(56)) | (C.mix(value) >> np.uint64(8)))
                row, value = row[order], value[order]
                pos = np.arange(len(row)) - np.concatenate([[0], np.cumsum(n)])[row]
                keep = pos < prefix_size(n)[row]
                if bits is not None:
                    at = _bit(value)
                    keep &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                owner = row[keep]
                yield pa.RecordBatch.from_arrays([pa.array(value[keep].view(np.int64)), batch["key"].take(pa.array(owner)), pa.array(n[owner].astype(np.int32)), pa.array(pos[keep].astype(np.int32))], names=["print", "key", "n", "pos"])

    return keyed.select("key", "text").mapInArrow(run, "print bigint, key bigint, n int, pos int")


def _may_link(n: Column, m: Column, common: Column) -> Column:
    """Whether sets of n and m shingles with at most ``common`` in common can link."""
    return common * (100 + PERCENT) >= (n + m) * PERCENT


def _verify(pairs: DataFrame, keyed: DataFrame, described: DataFrame) -> DataFrame:
    """The distinct (a, b) of ``pairs`` that link. Suffix filter first, on counts by part of the hash range; texts, which are smaller than their sets, then travel to the pairs."""
    parts = described.groupBy("key").agg(F.first("blob").alias("blob"), F.first("n").alias("n"))
    some = pairs.join(parts.toDF("a", "parts_a", "n_a"), "a").join(parts.toDF("b", "parts_b", "n_b"), "b")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(C.bytes_view(batch[c])[0].tobytes(), "<u4").reshape(-1, PARTS) for c in ("parts_a", "parts_b"))
                common = np.minimum(x, y).sum(axis=1, dtype=np.int64)
                total = batch["n_a"].to_numpy() + batch["n_b"].to_numpy()
                yield batch.filter(pa.array(common * (100 + PERCENT) >= total * PERCENT)).select(["a", "b"])

    some = C.materialise(some.mapInArrow(close, "a bigint, b bigint"), "pairs")
    wanted = C.checked_broadcast(some.select("a").union(some.select("b")).distinct().toDF("key"))
    texts = keyed.select("key", "text").join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))  # repeated rows once

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.slices(whole, "text_a"):
                (row_a, a), (row_b, b) = (shingle_sets(*C.bytes_view(batch[c])) for c in ("text_a", "text_b"))
                row, value = np.concatenate([row_a, row_b]), np.concatenate([a, b])
                order = C.by_row_and_value(row, value)
                row, value = row[order], value[order]
                common = np.bincount(row[1:][(row[1:] == row[:-1]) & (value[1:] == value[:-1])], minlength=batch.num_rows)
                total = np.bincount(row, minlength=batch.num_rows)
                yield batch.filter(pa.array(100 * common >= PERCENT * (total - common))).select(["a", "b"])

    both = some.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.mapInArrow(link, "a bigint, b bigint")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(key, label): for each vertex of ``edges`` (a, b) the smallest vertex it is connected with.

    Each round gives a vertex the smallest label among its neighbours and then that label's
    own label; rounds end when no label changes. Labels are tables, never on the driver."""
    both = C.materialise(edges.union(edges.select("b", "a")).distinct(), name)
    labels = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("key"), F.least("a", "low").alias("label"))
    labels = C.materialise(labels, name)
    while True:
        near = both.join(labels.toDF("b", "near"), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "key"), "key").select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = C.materialise(step, name)
        jump = step.join(step.select(F.col("key").alias("label"), F.col("label").alias("further")), "label", "left")
        new = C.materialise(jump.select("key", "old", F.coalesce("further", "label").alias("label")), name)
        if new.where("old <> label").isEmpty():
            return new.select("key", "label")
        labels = new.select("key", "label")


def _keyed(documents: DataFrame, name: str = "key", clashes: Sequence[DataFrame] = ()) -> DataFrame:
    """The documents with a number by which rows are told apart, a function of doc_id and text. Whole ids that are not negative come in their own order (originals
    mostly before copies, so that the smallest member of a group links with most) with a hash of the text in the last bits; all others are hashes, after them.

    ``clashes``: numbers that turned out to stand for several texts, a table for each time; rows that have one get another hash."""

    def other(hashed: Column) -> Column:
        return hashed.bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))

    hashed = F.xxhash64("doc_id", "text")
    key = other(hashed)
    if documents.schema["doc_id"].dataType.typeName() in ("long", "integer", "short", "byte"):
        own = F.shiftleft(F.col("doc_id").cast("bigint"), ID_SHIFT).bitwiseOR(hashed.bitwiseAND(F.lit((1 << ID_SHIFT) - 1)))
        key = F.when(F.col("doc_id").between(0, (1 << (62 - ID_SHIFT)) - 1), own).otherwise(key)
    keyed = documents.withColumn(name, key)
    for seed, clash in enumerate(clashes, 1):
        hit = f"{name}_clash"
        marked = keyed.join(C.checked_broadcast(clash.select(F.col("key").alias(name), F.lit(True).alias(hit))), name, "left")
        keyed = marked.withColumn(name, F.when(F.col(hit), other(F.xxhash64(F.lit(seed), "doc_id", "text"))).otherwise(F.col(name))).drop(hit)
    return keyed


def _told_apart(documents: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Keyed and described documents, whose keys stand for one set of shingles each, and the clashes that this took: where many texts share an id, two of them
    may share the bits that hold a hash of the text."""
    clashes: list[DataFrame] = []
    while True:
        keyed = _keyed(documents, clashes=clashes)
        described = C.materialise(_describe(keyed), "described")
        own = F.struct("n", "high", "low")
        twice = described.where("part < 0").groupBy("key").agg(F.min(own).alias("least"), F.max(own).alias("most")).where("least <> most").select("key")
        twice = C.materialise(twice, "clashes")
        if twice.isEmpty():
            return keyed, described, clashes
        clashes.append(twice)


def _ahead(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Length and positional filter for a common shingle at positions i and j."""
    n, m = n.cast("bigint"), m.cast("bigint")
    return (n * 100 >= m * PERCENT) & (m * 100 >= n * PERCENT) & _may_link(n, m, 1 + F.least(n - i - 1, m - j - 1))


def _labelled(documents: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(key, doc_id, n, label) of every row, and the clashes of keys; rows whose texts link, directly or over others, share a label; it is null for rows that link with none."""
    spark = documents.sparkSession
    keyed, described, clashes = _told_apart(C.only(documents, "doc_id", "text"))
    rank = spark.sparkContext.broadcast(_rarity(described))

    docs = described.where("part < 0").drop("part")
    filled = docs.where("n > 0")
    same = C.materialise(filled.groupBy("n", "high", "low").agg(F.min("key").alias("class"), F.count(F.lit(1)).alias("copies")), "classes")
    copied = same.where("copies > 1").select("n", "high", "low", "class")
    member = filled.select("key", "n", "high", "low").join(C.checked_broadcast(copied), ["n", "high", "low"]).groupBy("key").agg(F.min("class").alias("class"))
    member = C.materialise(member, "members")
    single = keyed.join(C.checked_broadcast(member.where("key <> class").select("key")), "key", "left_anti")

    times = _prefixes(single, rank).groupBy("print").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("print")
    shared = C.materialise(times, "shared")
    bitmap = spark.sparkContext.broadcast(_bitmap(shared))
    groups = C.materialise(_prefixes(single, rank, bitmap).join(shared, "print"), "groups")
    # The smallest and largest class of each group. Of two classes they are the pair; larger groups keep their rows.
    place = F.struct("key", "n", "pos")
    hubs = groups.groupBy("print").agg(F.min(place).alias("hub"), F.max(place).alias("last"), F.count(F.lit(1)).alias("size"))
    able = _ahead(F.col("hub.n"), F.col("hub.pos"), F.col("last.n"), F.col("last.pos")) & (F.col("hub.key") < F.col("last.key"))
    hubs = C.materialise(hubs.where((F.col("size") > 2) | able), "hubs")
    twins = hubs.where("size = 2").select(F.col("hub.key").alias("a"), F.col("last.key").alias("b"))
    groups = C.materialise(groups.join(hubs.where("size > 2").select("print", "hub"), "print"), "large")
    stars = groups.where(F.col("key") != F.col("hub.key")).where(_ahead(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos")))
    # One pair for each class comes first, with the smallest of all its hubs; what this leaves apart is paired below.
    stars = stars.groupBy(F.col("key").alias("b")).agg(F.min("hub.key").alias("a")).select("a", "b")
    stars = C.materialise(stars.union(twins).distinct(), "stars")
    links = C.materialise(_verify(stars, keyed, filled), "links")
    labels = C.materialise(components(links), "labels")

    # What is left: groups whose members are in several components, and pairs between these.
    placed = groups.drop("hub").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed = placed.groupBy("print").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("print")
    placed = C.materialise(placed.join(mixed, "print"), "mixed")
    # Classes of alike rows meet first: members of one component are never compared, however
    # many they are, and those whose lengths or positions rule each other out are not either.
    placed = placed.withColumn("kind", F.concat_ws(":", "label", F.floor(F.log("n") * 12), F.floor(F.col("pos") * 24 / F.col("n"))))
    kinds = placed.groupBy("print", "kind").agg(F.min("label").alias("label"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    kinds = C.materialise(kinds, "kinds")
    one, two = (kinds.select("print", *[F.col(c).alias(f"{c}_{s}") for c in ("kind", "label", "low", "high", "rest")]) for s in ("a", "b"))
    meet = one.join(two, "print").where("label_a < label_b").where((F.col("high_a") * 100 >= F.col("low_b") * PERCENT) & (F.col("high_b") * 100 >= F.col("low_a") * PERCENT))
    meet = meet.where(_may_link(F.col("low_a").cast("bigint"), F.col("low_b").cast("bigint"), F.least("rest_a", "rest_b").cast("bigint"))).select("print", "kind_a", "kind_b")
    left, right = (placed.select("print", *[F.col(c).alias(f"{c}_{s}") for c in ("key", "n", "pos", "kind")]) for s in ("a", "b"))
    across = left.join(meet, ["print", "kind_a"]).join(right, ["print", "kind_b"]).where(_ahead(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b")))
    across = across.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct().join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = C.materialise(_verify(across, keyed, filled), "links")
    if not more.isEmpty():
        labels = components(links.union(more).union(labels.where("key <> label").toDF("a", "b")))
    found = docs.select("key", "doc_id", "n").join(member, "key", "left").withColumn("class", F.coalesce("class", F.when(F.col("n") > 0, F.col("key"))))
    found = found.join(labels.toDF("class", "label"), "class", "left").join(copied.select("class", F.lit(True).alias("copied")), "class", "left")
    return C.materialise(found.select("key", "doc_id", "n", F.coalesce("label", F.when(F.col("copied"), F.col("class"))).alias("label")), "labelled"), clashes


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    found, _ = _labelled(documents)
    least = found.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    both = found.join(least, "label", "left")
    return both.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def drop_near_copies(documents: DataFrame) -> DataFrame:
    """Of each class of linked documents the row with the smallest doc_id (null last); rows without words all stay."""
    found, clashes = _labelled(documents)
    linked = found.where("label is not null")
    stays = linked.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("stays"))
    gone = C.materialise(linked.join(stays, "label").where(F.col("key") != F.col("stays.key")).select("key").distinct(), "copies")
    again = C.materialise(linked.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key"), "again")
    name = "key_of_row"
    while name in documents.columns:
        name += "_"
    keyed = _keyed(documents, name, clashes)
    kept = keyed.join(C.checked_broadcast(gone.toDF(name)), name, "left_anti")
    if not again.isEmpty():
        again = C.checked_broadcast(again.toDF(name))
        kept = kept.join(again, name, "left_anti").unionByName(kept.join(again, name, "left_semi").dropDuplicates([name]))
    return kept.select(*documents.columns)

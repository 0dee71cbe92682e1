"""Benchmark decontamination by winnowing.

Texts become sequences of word hashes. Of every window of ``WINDOW`` consecutive k-gram hashes
the smallest is kept as a fingerprint, so any span of ``SPAN`` = k + WINDOW - 1 words that a
document and a benchmark item share has a fingerprint in common. Fingerprints of both sides
are joined; each carries the words around it, and a hit is extended word by word, compared as
text. As every shared span of SPAN words holds a fingerprint, words further off than SPAN - k
are found from another one. A run of SPAN words marks its words. An item of fewer words is one
window: all runs of exactly its length are fingerprints on both sides, so it is found as surely.

No text is shuffled: a document is read once for its fingerprints and once to count its words.

Defined cases: null, empty or wordless texts have no words and are not contaminated; an item
without words never occurs; repeated items count as separate items, also under one or no id;
rows are told apart by doc_id and text together, so a null doc_id is an id like any other,
documents that share one are judged apart, and repeated documents give repeated rows; an empty
benchmark leaves every document clean; texts of any length are read whole; extra columns, also
those named like the operator's own, are kept by ``drop_contaminated`` and else ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .jaccard import _bit, _bitmap
from .runindex import _span_lists, merge_spans

K = 5
SPAN = 10
WINDOW = SPAN - K + 1
#: Words before and from a fingerprint's first one that are kept with it.
BEFORE, HERE = SPAN - K, SPAN

#: Up to so many distinct benchmark fingerprints, a sorted copy is broadcast to drop other document fingerprints
#: before the join; a bitmap of fixed size beyond. What passes either is joined all the same.
FILTER_FINGERPRINTS = 1 << 20
#: Words of a text as the operator sees them, for Spark's regular expressions.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def winnow(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (of the first word) and hashes of the fingerprints of all rows: the smallest
    hash of each window of k-grams. A row with fewer k-grams than a window is one window."""
    at, gram = C.grams(hashes, row, K)
    n = len(at)
    if not n:
        return at, gram
    owner = row[at]
    low = gram.copy()
    far = np.arange(n)
    # Smallest of the next WINDOW grams, by doubling; windows that leave the row are cut at its end.
    last = np.searchsorted(owner, owner, "right") - 1
    for j in range(1, WINDOW):
        other = np.minimum(far + j, last)
        low = np.minimum(low, gram[other])
    begins = np.searchsorted(owner, owner, "left")
    whole = (far + WINDOW - 1 <= last) | (far == begins)  # full windows, and the only one of a short row
    picked = np.zeros(n, bool)
    for j in range(WINDOW):
        back = far - j
        ok = back >= begins
        ok[ok] &= whole[back[ok]]
        ok[ok] &= gram[far[ok]] == low[back[ok]]
        picked |= ok
    return at[picked], gram[picked]


def fingerprints(texts: DataFrame, key: str, lengths: list[int], wanted=None) -> DataFrame:
    """(key, n, pos, size, print, before, here): winnowed k-grams (size 0) and every run of ``lengths`` words (size
    that length), with the words around each and the number of words of its text. ``wanted``: a broadcast function that tells of hashes whether they are needed."""
    key_type = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.slices(whole):
                data, off = C.bytes_view(batch["text"])
                start, end, row, hashes = C.words_of(data, off, C.WORD_BYTES, lower=True)
                raw = data.tobytes().translate(_LOWER)
                join = lambda a, b: b" ".join([raw[start[i] : end[i]] for i in range(a, b)]).decode()  # noqa: B023, E731
                for at, value, size in [(*winnow(row, hashes), 0)] + [(*C.grams(hashes, row, n), n) for n in lengths]:
                    if wanted is not None:
                        ok = wanted.value(value)
                        at, value = at[ok], value[ok]
                    owner = row[at]
                    first, last = np.searchsorted(row, owner, "left"), np.searchsorted(row, owner, "right")
                    begin, stop = (at, at + size) if size else (np.maximum(first, at - BEFORE), np.minimum(last, at + HERE))
                    for a in range(0, len(at), 1 << 14):
                        some = slice(a, a + (1 << 14))
                        yield pa.RecordBatch.from_arrays(
                            [batch[key].take(pa.array(owner[some])), pa.array((last - first)[some]), pa.array((at - first)[some]), pa.array(np.full(len(at[some]), size)), pa.array(value[some].view(np.int64)),
                             pa.array(list(map(join, begin[some].tolist(), at[some].tolist())), pa.string()), pa.array(list(map(join, at[some].tolist(), stop[some].tolist())), pa.string())],
                            names=[key, "n", "pos", "size", "print", "before", "here"],
                        )

    return texts.select(key, "text").mapInArrow(run, f"{key} {key_type}, n bigint, pos bigint, size bigint, print bigint, before string, here string")


class Among:
    """Tells of hashes which are among the given ones, which are sorted."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes

    def __call__(self, value: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(value), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)] == value


class InBitmap:
    """Tells of hashes which may be among those of a bitmap."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, value: np.ndarray) -> np.ndarray:
        at = _bit(value)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def shared_run(before: list[str], here: list[str], other_before: list[str], other_here: list[str]) -> tuple[int, int]:
    """How many words next to each other are equal before and from a common place."""
    a = b = 0
    while a < min(len(before), len(other_before)) and before[-1 - a] == other_before[-1 - a]:
        a += 1
    while b < min(len(here), len(other_here)) and here[b] == other_here[b]:
        b += 1
    return a, b


def _verified(hits: DataFrame) -> DataFrame:
    """(key, item, start, end): the words of each document that a window of the item covers. hits: (key, pos, size, before, here, item, item_before, item_here)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch[c].to_pylist() for c in ("key", "item", "pos", "size", "before", "here", "item_before", "item_here")]
            for key, item, pos, size, *texts in zip(*columns, strict=True):
                a, b = shared_run(*[t.split(" ") if t else [] for t in texts])
                if (b == size) if size else (a + b >= SPAN):
                    out.append((key, item, pos - a, pos + b))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "item", "start", "end"])

    return hits.mapInArrow(run, "key bigint, item bigint, start bigint, end bigint")


def _keyed(documents: DataFrame, name: str = "key") -> DataFrame:
    return documents.withColumn(name, F.xxhash64("doc_id", "text"))


def occurrences(keyed: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item, item_id, start, end): the runs of words of each document (key, text) that windows of items cover."""
    spark = keyed.sparkSession
    items = C.only(benchmark, "item_id", "text").withColumn("item", F.monotonically_increasing_id())
    items = C.materialise(items, "items")  # the number of an item must not change between uses
    n_words = F.size(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))
    lengths = sorted(r[0] for r in items.select(n_words.alias("n")).where(f"n between 1 and {SPAN - 1}").distinct().collect())
    # A short item counts only as a whole; a long one only by its winnowed prints.
    theirs = C.materialise(fingerprints(items, "item", lengths).where(f"(n >= {SPAN} and size = 0) or size = n"), "prints")
    distinct = theirs.select("print").distinct()
    if distinct.limit(FILTER_FINGERPRINTS + 1).count() <= FILTER_FINGERPRINTS:
        test = Among(np.sort(distinct.toPandas()["print"].to_numpy(np.int64).view(np.uint64)))
    else:
        test = InBitmap(_bitmap(distinct))
    ours = fingerprints(keyed, "key", lengths, spark.sparkContext.broadcast(test))
    theirs = theirs.select("size", "print", "item", F.col("before").alias("item_before"), F.col("here").alias("item_here")).distinct()
    found = _verified(ours.distinct().join(theirs, ["size", "print"])).distinct()
    return C.materialise(found.join(items.select("item", F.col("item_id").cast("string").alias("item_id")), "item"), "hits")


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (array of item ids as strings, sorted) and ``hits`` (word spans) per document."""
    keyed = _keyed(C.only(documents, "doc_id", "text"))
    found = occurrences(keyed, benchmark)
    named = found.groupBy("key").agg(F.array_sort(F.transform(F.collect_set(F.struct("item", "item_id")), lambda x: x["item_id"])).alias("items"))
    spans = found.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # runs of one document

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch["spans"].flatten()
            owner = np.repeat(np.arange(batch.num_rows), batch["spans"].value_lengths().to_numpy())
            row, start, end = merge_spans(owner, flat.field("start").to_numpy(), flat.field("end").to_numpy())
            n_hit = np.bincount(row, (end - start), minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(n_hit), _span_lists(row, start, end, batch.num_rows)], names=["key", "n_hit", "hits"])

    kind = "array<struct<start:bigint,end:bigint>>"
    marked = spans.mapInArrow(merge, f"key bigint, n_hit bigint, hits {kind}").join(named, "key")
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.slices(whole):
                data, off = C.bytes_view(batch["text"])
                n = np.bincount(C.runs(C.WORD_BYTES[data], off)[2], minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch["key"], batch["doc_id"], pa.array(n, pa.int64())], names=["key", "doc_id", "n_words"])

    counted = keyed.select("key", "doc_id", "text").mapInArrow(count, f"key bigint, doc_id {id_type}, n_words bigint")
    both = counted.join(marked, "key", "left")
    return both.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("hits", F.array().cast(kind)).alias("hits"))


def digest(found: DataFrame) -> DataFrame:
    """The columns that describe the result: counts, and a hash of the sorted item ids."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns."""
    bad = occurrences(_keyed(C.only(documents, "doc_id", "text")), benchmark).select("key").distinct()
    name = "key_of_row"
    while name in documents.columns:
        name += "_"
    clean = _keyed(documents, name).join(C.checked_broadcast(bad.withColumnRenamed("key", name)), name, "left_anti")
    return clean.select(*documents.columns)

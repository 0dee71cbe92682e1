"""Removal of long repeats with run-compressed Burrows-Wheeler indexes.

Which bytes does a string of ``LEAST`` bytes cover that also starts elsewhere? No index of all
texts is built in one place. Each window of LEAST bytes is keyed by the smallest hash of the
k-grams in it, a function of its content; maximal runs of windows with one key are *pieces*,
so equal windows always meet under one key, whatever document they are in.

* A piece that occurs twice is repeated as a whole; counting tells, no text is moved.
* Keys with several distinct pieces, or one that holds its key twice, are dealt into buckets. Of the pieces of a bucket
  those stretches stay whose grams of SEED bytes all occur more than once, as they must in a repeat. Over these one
  run-compressed transform is built: the suffix order, the runs of equal preceding bytes, and
  at the head and end of each run a sample, its text position with the length it shares with
  the neighbour beyond the run. Between samples these lengths fall by one a byte, so one
  pass over the text streams the matching statistics of every position against all others;
  windows whose longest match has LEAST bytes are marked.
* A key with more than ``HOT`` pieces is cut again with longer k-grams, up to whole windows,
  where equal windows are equal pieces and counting decides. So no bucket is unbounded.
* The spans found in a piece are merged to maximal runs there, moved to each occurrence in one
  row, and merged again per document.

Defined cases: a null or empty text has no bytes; texts shorter than LEAST lose nothing; a null
doc_id is an id like any other; repeated rows (same doc_id and text) repeat each other, so all
their windows are removed, and each gives a row; documents that share a doc_id are judged apart;
texts of any length are cut into bounded pieces; an empty table gives none; extra columns, also
those named like the operator's own, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LEAST = 400
#: Gram lengths of the successive cuts; the last is a whole window.
GRAMS = (32, 256, 368, LEAST)
#: Windows in a piece at most, so a long periodic stretch is many bounded pieces.
PIECE_WINDOWS = 512
#: Distinct pieces under one key beyond which it is cut again.
HOT = 800
#: Bytes in a bucket, on average.
BUCKET_BYTES = 1 << 20
#: Length of the grams that must repeat all along a stretch before it enters an index.
SEED = 64
#: Bytes of text that are cut at a time, so that their hashes stay in the processor's cache.
CUT_BYTES = 1 << 16
_MULT = np.uint64(0x9E3779B97F4A7C15)


# --- cutting ------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every run of ``gram`` bytes (8 at least), by doubling; it depends on these bytes alone."""
    have = 8
    out = np.ndarray(len(data) - have + 1, "<u8", np.ascontiguousarray(data), 0, (1,)) * _MULT
    while True:
        out ^= out >> np.uint64(32)
        if have == gram:
            return out * _MULT
        step = min(have, gram - have)
        out = out[:-step] * _MULT + out[step:]
        have += step


def cut(data: np.ndarray, off: np.ndarray, gram: int) -> tuple[np.ndarray, ...]:
    """row, start, length, key and hash of every piece, and whether its key occurs in it more than once
    (else no window of it equals another window of it)."""
    z = np.zeros(0, np.int64)
    n = len(data)
    if n < LEAST:
        return z, z, z, z, z, z.astype(bool)
    low = grams = gram_hashes(data, gram).view(np.int64)
    width, have = LEAST - gram + 1, 1
    # What is least in a window is least in the half of the window before it or in the half after it.
    half, reach = low, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
        if have * 2 <= width + 1:
            half, reach = low, have
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    new = np.ones(n - LEAST + 1, bool)
    new[1:] = low[1:] != low[:-1]
    edge = off[1:-1]
    for at in (np.maximum(edge - LEAST + 1, 0), edge):  # between these, windows lie in two rows
        new[at[at < len(new)]] = True
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(new)))
    row = np.searchsorted(off, start, "right") - 1
    inside = start + LEAST <= off[row + 1]
    row, start, count = row[inside], start[inside], count[inside]
    parts = -(-count // PIECE_WINDOWS)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    row, start, count = np.repeat(row, parts), np.repeat(start, parts) + PIECE_WINDOWS * nth, np.repeat(count, parts) - PIECE_WINDOWS * nth
    end = start + np.minimum(count, PIECE_WINDOWS) + LEAST - 1
    key = low[start]
    value = C.Sums(data, C.byte_codes(False)).hashes(start, end, (end - start).astype(np.uint64))
    least = np.ones(len(grams), bool)
    tail = len(grams) - len(half)
    least[: len(half)] = grams[: len(half)] == half
    least[tail:] |= grams[tail:] == half
    least[:tail] = least[len(half) :] = True
    spot = np.flatnonzero(least)
    first, last = np.searchsorted(spot, start), np.searchsorted(spot, end - gram, "right")
    spread = last - first
    to = np.cumsum(spread)
    inner = spot[np.arange(to[-1] if len(to) else 0) + np.repeat(first - to + spread, spread)]
    same = np.concatenate([[0], np.cumsum(grams[inner] == np.repeat(key, spread))])
    twice = same[to] - same[to - spread] > 1
    return row, start - off[row], end - start, key, value.view(np.int64), twice


# --- the index of one bucket --------------------------------------------------------------


def stable_order(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of unsigned keys up to ``most``, and the keys in it; where key and place fit one word, words are sorted."""
    bits = len(key).bit_length()
    if most.bit_length() + bits > 64:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    word = np.sort((key << np.uint64(bits)) | np.arange(len(key), dtype=np.uint64))
    return (word & np.uint64((1 << bits) - 1)).view(np.int64), word >> np.uint64(bits)


def suffix_order(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions in the order of the suffixes that run from them to the end of their piece
    (``end`` for each position); equal suffixes stay in text order. By doubling, sorting only
    what is still undecided."""
    n = len(data)
    seen = np.flatnonzero(np.bincount(data, minlength=256))
    code = np.zeros(256, np.uint64)
    code[seen] = np.arange(1, len(seen) + 1)
    base = len(seen) + 1
    left = end - np.arange(n)
    step = max(1, int((63 - n.bit_length()) / np.log2(base)))
    padded = np.concatenate([code[data], np.zeros(step, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(step):
        key = key * np.uint64(base) + np.where(left > j, padded[j : j + n], np.uint64(0))
    order, ordered = stable_order(key, base**step)
    rank = np.zeros(n + 1, np.int32)
    fresh = np.ones(n, bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    slot = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(fresh, slot, 0)) + 1
    alone = fresh & np.append(fresh[1:], True)
    while True:
        slot = slot[~alone]
        i = order[slot]
        more = left[i] >= step  # else a group of suffixes that are equal to their ends
        slot, i = slot[more], i[more]
        if not len(slot):
            return order
        group = np.cumsum(fresh[slot]).astype(np.uint64)
        after = np.where(left[i] > step, rank[np.minimum(i + step, n)], 0).astype(np.uint64)
        o, pair = stable_order(group * np.uint64(n + 1) + after, (int(group[-1]) + 1) * (n + 1))
        i = i[o]
        head = np.ones(len(slot), bool)
        head[1:] = pair[1:] != pair[:-1]
        order[slot] = i
        fresh[slot] = head
        rank[i] = np.maximum.accumulate(np.where(head, slot, 0)) + 1
        alone = head & np.append(head[1:], True)
        step *= 2


def stretches(data: np.ndarray, off: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the stretches all of whose runs of ``gram`` bytes occur more than once, LEAST bytes long at
    least: a string of LEAST bytes that starts twice lies in these both times, so an index of them finds it."""
    z = np.zeros(0, np.int64)
    n = len(data) - gram + 1
    if n <= 0:
        return z, z, z
    bits = np.uint64(n.bit_length())
    word = np.sort((gram_hashes(data, gram) >> bits << bits) | np.arange(n, dtype=np.uint64))
    same = np.zeros(n + 1, bool)
    same[1:-1] = word[1:] >> bits == word[:-1] >> bits
    often = np.zeros(len(data), bool)
    often[(word[same[1:] | same[:-1]] & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)] = True
    for e in off[1:].tolist():
        often[max(0, e - gram + 1) : e] = False
    start, end, row = C.runs(often, off)
    end += gram - 1
    long = end - start >= LEAST
    return start[long], end[long], row[long]


def shared_lengths(data: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at each a and b have in common, within their pieces."""
    most = np.minimum(end[a] - a, end[b] - b)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x = np.ascontiguousarray(eight[a[live] + out[live]]).view(">u8").ravel()
        y = np.ascontiguousarray(eight[b[live] + out[live]]).view(">u8").ravel()
        differ = x ^ y
        same = np.full(len(live), 8)
        some = differ != 0
        d = differ[some].astype(np.uint64)
        same[some] = 7 - np.searchsorted(np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64), d, "right")
        out[live] += same
        done = some | (out[live] >= most[live])
        live = live[~done]
    return np.minimum(out, most)


class RunIndex:
    """A run-compressed transform of pieces, with samples at the heads and ends of runs."""

    def __init__(self, pieces: list[bytes]):
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.off = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.end = np.repeat(self.off[1:], np.diff(self.off))
        n = len(self.data)
        order = suffix_order(self.data, self.end)
        before = np.where(np.isin(order, self.off[:-1]), np.arange(n) + 256, self.data[order - 1].astype(np.int64))
        head = np.ones(n, bool)
        head[1:] = before[1:] != before[:-1]  # what precedes the start of a piece equals nothing
        heads = np.flatnonzero(head)
        ends = np.append(heads[1:], n) - 1
        #: The byte of each run (256 and above: the start of a piece) and the length of each run.
        self.run_byte, self.run_length = before[heads], ends - heads + 1
        self.head_at, self.end_at = order[heads], order[ends]
        up = heads[heads > 0]
        down = ends[ends < n - 1]
        self.head_shared = np.zeros(len(heads), np.int64)
        self.end_shared = np.zeros(len(ends), np.int64)
        self.head_shared[heads > 0] = shared_lengths(self.data, self.end, order[up], order[up - 1])
        self.end_shared[ends < n - 1] = shared_lengths(self.data, self.end, order[down], order[down + 1])

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of its longest match that starts anywhere else."""
        n = len(self.data)
        best = np.zeros(n, np.int64)
        for at, shared in ((self.head_at, self.head_shared), (self.end_at, self.end_shared)):
            reach = np.full(n, -1, np.int64)
            reach[at] = at + shared  # between samples the match shrinks by the byte that is left behind
            sampled = np.zeros(n, np.int64)
            sampled[at] = at
            last = np.maximum.accumulate(sampled)
            best = np.maximum(best, reach[last] - np.arange(n))
        return best

    def repeats(self, least: int = LEAST) -> list[list[tuple[int, int]]]:
        """For each piece the maximal stretches covered by strings of ``least`` bytes that start elsewhere too."""
        n = len(self.data)
        starts = np.flatnonzero(self.matching_statistics() >= least)
        edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + least, minlength=n + 1)
        begin, to, row = C.runs(np.cumsum(edge[:-1]) > 0, self.off)
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(self.off) - 1)]
        for b, e, r in zip(begin.tolist(), to.tolist(), row.tolist(), strict=True):
            out[r].append((b - int(self.off[r]), e - int(self.off[r])))
        return out


# --- over tables --------------------------------------------------------------------------

_ID = ["key", "hash", "length"]
_SPANS = "array<struct<start:bigint,end:bigint>>"


def _cut_table(texts: DataFrame, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.slices(whole, "data"):
                at, parts = 0, []
                for part in C.slices(batch, "data", CUT_BYTES):
                    row, *rest = cut(*C.bytes_view(part["data"]), gram)
                    parts.append((row + at, *rest))
                    at += part.num_rows
                row, *rest = map(np.concatenate, zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([batch["row"].take(pa.array(row)), *map(pa.array, rest)], names=["row", "start", "length", "key", "hash", "twice"])

    return texts.mapInArrow(run, "row bigint, start bigint, length bigint, key bigint, hash bigint, twice boolean")


def merge_spans(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs that the spans of each row cover, by row and start; spans that touch are one run."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    base = row * (int(end.max()) + 1)  # so that the furthest end never carries over to the next row
    far = np.maximum.accumulate(base + end) - base
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > far[:-1])
    head = np.flatnonzero(new)
    return row[head], start[head], far[np.append(head[1:], len(row)) - 1]


def _span_lists(row: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> pa.Array:
    """The spans of rows 0 to n - 1, which come by row, as a list for each."""
    off = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"]))


def _merged(spans: DataFrame) -> DataFrame:
    """(row, spans): what all the lists of spans of a row cover, as maximal runs. A list is gathered once however often a row repeats, so a row holds no more than its own pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["lists"]
            inner = pc.list_flatten(lists)
            owner = pc.list_parent_indices(lists).to_numpy().astype(np.int64)[pc.list_parent_indices(inner).to_numpy().astype(np.int64)]
            flat = pc.list_flatten(inner)
            row, start, end = merge_spans(owner, flat.field("start").to_numpy(), flat.field("end").to_numpy())
            yield pa.RecordBatch.from_arrays([batch["row"], _span_lists(row, start, end, batch.num_rows)], names=["row", "spans"])

    return spans.groupBy("row").agg(F.collect_set("spans").alias("lists")).mapInArrow(run, f"row bigint, spans {_SPANS}")


def _fetch(texts: DataFrame, pieces: DataFrame) -> DataFrame:
    """The bytes of each piece (key, hash, length, hot; row and start of one occurrence), from one pass over the texts."""
    wanted = pieces.groupBy("row").agg(F.collect_list(F.struct(*_ID, "hot", "start")).alias("wanted"))
    joined = texts.groupBy("row").agg(F.first("data").alias("data")).join(wanted, "row")  # repeated rows give each piece once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.slices(whole, "data"):
                out: list[tuple] = []
                for data, some in zip(batch["data"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
                    out += [(w["key"], w["hash"], w["hot"], data[w["start"] : w["start"] + w["length"]]) for w in some]
                key, value, hot, raw = zip(*out, strict=True) if out else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(value, pa.int64()), pa.array(hot, pa.bool_()), pa.array(raw, pa.binary())], names=["key", "hash", "hot", "data"])

    return joined.mapInArrow(run, "key bigint, hash bigint, hot boolean, data binary")


def _index_buckets(pieces: DataFrame, buckets: int) -> DataFrame:
    """(key, hash, spans) of every piece with repeats, from one index for each bucket of keys."""

    def run(table: pa.Table) -> pa.Table:
        data, off = C.bytes_view(table["data"])
        begin, to, owner = stretches(data, off, SEED)
        found = RunIndex([data[a:b].tobytes() for a, b in zip(begin.tolist(), to.tolist(), strict=True)]).repeats() if len(begin) else []
        flat = [(r, a + at, b + at) for r, at, some in zip(owner.tolist(), (begin - off[owner]).tolist(), found, strict=True) for a, b in some]
        spans = _span_lists(*merge_spans(*np.array(flat, np.int64).reshape(-1, 3).T), table.num_rows)
        out = table.select(["key", "hash"]).append_column("spans", spans)
        return out.filter(pc.greater(pc.list_value_length(spans), 0))

    dealt = pieces.select("key", "hash", "data").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(run, f"key bigint, hash bigint, spans {_SPANS}")


def repeats(texts: DataFrame, level: int = 0) -> DataFrame:
    """(row, spans): the stretches of ``data`` covered by windows that occur elsewhere, as maximal runs; texts has ``row`` and ``data``."""
    last = level == len(GRAMS) - 1
    occurrences = C.materialise(_cut_table(texts, GRAMS[level]), "pieces")
    pieces = occurrences.groupBy(*_ID).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "start")).alias("at"), F.max("twice").alias("twice"))
    kinds = C.materialise(pieces.select(*_ID, "times", "at.row", "at.start", "twice"), "kinds")
    several = C.materialise(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max("twice").alias("twice")).where("kinds > 1 or twice").drop("twice"), "several")
    mixed = kinds.join(C.checked_broadcast(several), "key").withColumn("hot", F.lit(not last) & (F.col("kinds") > HOT))
    mixed = C.materialise(_fetch(texts, mixed.select(*_ID, "hot", "row", "start")), "mixed")
    found = kinds.where("times > 1").select("key", "hash", F.lit(None).cast(_SPANS).alias("spans"))  # as wholes
    size = mixed.where("not hot").agg(F.sum(F.octet_length("data"))).first()[0] or 0
    if size:
        found = found.union(C.materialise(_index_buckets(mixed.where("not hot"), max(1, size // BUCKET_BYTES)), "marked"))
    hot = mixed.where("hot")
    if not last and not hot.isEmpty():
        named = hot.select(F.xxhash64("key", "hash").alias("row"), "key", "hash", "data")
        inner = C.materialise(repeats(named.select("row", "data"), level + 1), "inner")
        found = found.union(named.drop("data").join(inner, "row").select("key", "hash", "spans"))
    # One row for each occurrence of a piece, whatever its spans.
    own = F.coalesce("spans", F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("length").alias("end"))))
    moved = F.transform(own, lambda s: F.struct((s["start"] + F.col("base")).alias("start"), (s["end"] + F.col("base")).alias("end")))
    placed = occurrences.withColumnRenamed("start", "base").join(found, ["key", "hash"])
    return _merged(placed.select("row", moved.alias("spans")))


def remove_repeats(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, ``kept`` (the remaining bytes) per document."""
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("binary").alias("data"))
    spans = C.materialise(repeats(texts.select("row", "data").where(F.octet_length("data") >= LEAST)), "spans")
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.slices(whole, "data"):
                out = []
                for doc_id, data, marks in zip(batch["doc_id"].to_pylist(), batch["data"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                    kept, at, removed = [], 0, 0
                    for m in marks or ():
                        kept.append(data[at : m["start"]])
                        removed += m["end"] - m["start"]
                        at = m["end"]
                    rest = b"".join([*kept, data[at:]])
                    out.append((doc_id, len(data), removed, len(kept), hashlib.sha256(rest).hexdigest(), rest))
                cols = list(zip(*out, strict=True))
                types = [batch["doc_id"].type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 + with_text]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text]
    return texts.join(spans, "row", "left").select("doc_id", "data", "spans").mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)

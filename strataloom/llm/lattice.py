"""SentencePiece encoding and decoding over a relational lattice.

A text with its dummy space falls into words at every place that no piece of the vocabulary can
cross: the classes of two neighbouring characters (space, letter, digit, other) never stand side
by side in a piece. All substrings of a word up to the longest piece are exploded and equi-joined
to the piece table; the edges that match are grouped by word, and a fold over them in order of
their end keeps the best path to each of the last positions (Viterbi), in SQL functions only. So
the path is the best one of the whole text, and words may have any length. A character that no
piece covers becomes the byte pieces of its UTF-8 form.

Each distinct word is segmented once for a stretch of the corpus, not once for each place. The
most frequent words of a bounded sample are segmented first and broadcast (which words these
are never changes a result); for the others each chunk of documents names its distinct words,
these are segmented, and sent back to the chunks that named them. Chunks are written once and
read by every later step, so names fit however often a task runs.

Scores. Those of a unigram model are used as stored: the ids are the library's. A BPE model
stores merge ranks, which are no log probabilities: the path has the fewest pieces, and of such
paths the smallest sum of ranks. It agrees with the library's merges on 93 % of the words of the
test documents (84 % of the distinct ones). Equal scores take the longer last piece.

Defined cases: a null or empty text has no ids; the literal character that stands for a space
in pieces is encoded as bytes, so decoding gives every text back exactly; a null doc_id is an id
like any other; repeated rows give repeated rows; an empty table gives none; extra columns, also
those named like the operator's own, are ignored. A text needs some twelve times its bytes in a
task; the fold of one word of n characters copies its path, so a word without a space, digit or
sign takes time in n * n (10,000 characters: about a second).
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Chunks of the sample, and words broadcast, at most.
SAMPLE_CHUNKS = 16
FREQUENT = 1 << 18
#: Bytes of text in a chunk of documents; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 22
#: Partitions of chunks whose words are solved together: the list of a word's places has a bound.
TOGETHER = 256
#: Words up to this length are grouped by themselves, longer ones by their SHA-256.
SHORT = 64
#: Buckets of the table of chunks at most; Spark's own bound is 100,000.
MOST_BUCKETS = 1 << 16
#: Characters of a word that are exploded at a time.
BLOCK = 256
#: Cost of a piece, and of a character that no piece covers, in a model that stores ranks. Fixed values, beyond any rank.
PIECE_COST, UNCOVERED_COST = 1 << 20, 1 << 23

SPACE, LETTER, DIGIT, OTHER = range(4)


# --- the model ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Ordinary pieces with plain spaces, their ids and costs; the id of byte 0; the cost of an uncovered character; which classes of characters stand side by side in a piece."""

    pieces: tuple[str, ...]
    ids: tuple[int, ...]
    costs: tuple[int, ...]
    first_byte: int
    size: int
    uncovered: int
    joined: np.ndarray

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a serialized message: integers, four or eight bytes, or nested bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = raw[at : at + n], at + n
        yield key >> 3, value


def is_unigram(serialized: bytes) -> bool:
    """Whether a model was made as a unigram one (in the trainer's part, field 3 is 1 or absent)."""
    trainer = next((v for k, v in _fields(serialized) if k == 2), b"")
    return next((v for k, v in _fields(trainer) if k == 3), 1) == 1


def load_model(path: str) -> Model:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    if n > 1 << 16:
        raise ValueError("ids of more than two bytes")
    ids = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = [model.id_to_piece(i).replace("▁", " ") for i in ids]
    scores = [model.get_score(i) for i in ids]
    if is_unigram(model.serialized_model_proto()):
        costs = [round(-1e6 * s) for s in scores]
        uncovered = round(1e6 * (10 - min(scores, default=0)))
    else:  # scores are negative ranks; characters are not merged, and a score below all ranks marks pieces put in by hand
        costs = [PIECE_COST + (0 if len(p) == 1 else round(min(-s, n))) for p, s in zip(pieces, scores, strict=True)]
        uncovered = UNCOVERED_COST
    joined = np.zeros((4, 4), bool)
    for p in pieces:
        c = classes()[[ord(x) for x in p]]
        joined[c[:-1], c[1:]] = True
    return Model(tuple(pieces), tuple(ids), tuple(costs), next((i for i in range(n) if model.is_byte(i)), n), n, uncovered, joined)


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for base in range(0, len(out), 4096):
        some = [chr(c) for c in range(base, base + 4096)]
        out[base : base + 4096][[c.isalpha() for c in some]] = LETTER
        out[base : base + 4096][[c.isdecimal() for c in some]] = DIGIT
    out[32] = SPACE
    return out


def cut_words(texts: pa.Array, joined: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and the n + 1 offsets of each text's words. Joined, the words give the texts back, each with its dummy space."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    texts = pc.if_else(pc.equal(texts, none), none, pc.binary_join_element_wise(space, texts, none))
    data, off = C.bytes_view(texts)
    if len(data) and data.max() >= 128:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        at = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32 if len(data) < 1 << 31 else np.int64)
    else:
        points, at = data, np.arange(len(data), dtype=np.int32)
    kind = classes()[points]
    head = np.ones(len(points), bool)
    head[1:] = ~joined.ravel()[kind[:-1] * np.uint8(4) + kind[1:]]
    head[np.searchsorted(at, off[:-1][off[:-1] < len(data)])] = True
    begin = at[head]
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data)).astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
    return words, np.searchsorted(begin, off)


# --- the lattice --------------------------------------------------------------------------


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(piece, code, cost). Its size is that of the vocabulary file. Code: the id as four hex digits."""
    rows = pa.table({"piece": pa.array(model.pieces, pa.string()), "code": [f"{i:04X}" for i in model.ids], "cost": pa.array(model.costs, pa.int64())})
    return spark.createDataFrame(rows)


def segment(words: DataFrame, model: Model) -> DataFrame:
    """set, tag, spots, word and ids (two bytes each): the best path through each word's lattice. words: one row for each (set, tag), the tag naming the word; ``spots`` is carried, and short words are given back."""
    pieces = piece_table(words.sparkSession, model)
    longest, n = model.longest, F.length("word")
    # What is carried goes with the first substring only.
    whole = F.struct("spots", F.when(n <= SHORT, F.col("word")).alias("word"))
    blocks = words.select("set", "tag", whole.alias("whole"), "word", F.explode(F.sequence(F.lit(0), n - 1, F.lit(BLOCK))).alias("base"))
    blocks = blocks.select("set", "tag", F.when(F.col("base") == 0, F.col("whole")).alias("whole"), "base", F.least(n - F.col("base"), F.lit(BLOCK)).alias("here"), F.substring("word", F.col("base") + 1, F.lit(BLOCK + longest - 1)).alias("part"))
    starts = blocks.select("set", "tag", "whole", "base", "part", F.explode(F.sequence(F.lit(0), F.col("here") - 1)).alias("start"))
    starts = starts.withColumn("whole", F.when(F.col("start") == 0, F.col("whole")))
    spans = starts.select("set", "tag", "whole", "base", "part", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + longest, F.length("part")))).alias("end"))
    one = F.col("end") == F.col("start") + 1
    parts = spans.select("set", "tag", F.when(one, F.col("whole")).alias("whole"), one.alias("one"), (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"), F.substring("part", F.col("start") + 1, F.col("end") - F.col("start")).alias("piece"))
    edges = parts.join(F.broadcast(pieces), "piece", "left").where(F.col("code").isNotNull() | F.col("one"))
    # What no piece covers: the byte pieces of one character.
    raw = F.hex(F.col("piece").cast("binary"))
    as_bytes = F.array_join(F.transform(F.sequence(F.lit(0), (F.length(raw) / 2 - 1).cast("int")), lambda i: F.lpad(F.hex(F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("int") + model.first_byte), 4, "0")), "")
    edge = F.struct("end", "start", F.coalesce("cost", F.lit(model.uncovered).cast("bigint")).alias("cost"), F.when(F.col("code").isNull(), as_bytes).otherwise(F.col("code")).alias("code"))
    lattice = edges.groupBy("set", "tag").agg(F.sort_array(F.collect_list(edge)).alias("edges"), F.first("whole", ignorenulls=True).alias("whole"))
    # best holds the best paths to position ``at`` and up to ``longest`` before it; edges come by end, so it grows at its tail only.
    first = F.struct(F.lit(0).alias("at"), F.array(F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("code"))).alias("best"))

    def step(state: Column, e: Column) -> Column:
        best, size = state["best"], F.size(state["best"])
        before = F.get(best, size - 1 - (state["at"] - e["start"]))
        cost = before["cost"] + e["cost"]
        to = F.array(F.struct(cost.alias("cost"), F.concat(before["code"], e["code"]).alias("code")))
        longer = F.when(size > longest, F.concat(F.slice(best, F.lit(2), F.lit(longest)), to)).otherwise(F.concat(best, to))
        better = F.struct(state["at"].alias("at"), F.concat(F.slice(best, F.lit(1), size - 1), to).alias("best"))
        return F.when(e["end"] > state["at"], F.struct(e["end"].alias("at"), longer.alias("best"))).when(F.element_at(best, -1)["cost"] > cost, better).otherwise(state)

    path = F.aggregate("edges", first, step, lambda s: F.element_at(s["best"], -1)["code"])
    return lattice.select("set", "tag", "whole.spots", "whole.word", F.unhex(path).alias("ids"))


# --- chunks of documents ------------------------------------------------------------------


def _chunk_table(documents: DataFrame) -> tuple[DataFrame, int]:
    """(chunk, texts): runs of whole documents of about CHUNK_BYTES, as a compressed Arrow stream of doc_id and text; and the number of buckets. A table bucketed by chunk, so that what is solved travels to the texts and no text is shuffled."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, part, k = zstandard.ZstdCompressor(level=5), TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def packed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                for batch in held:
                    out.write_batch(batch)
            return pa.RecordBatch.from_pydict({"chunk": pa.array([part + k]), "texts": pa.array([press.compress(sink.getvalue())], pa.binary())})

        for whole in batches:
            for batch in C.slices(whole):
                held.append(batch)
                size += len(C.bytes_view(batch["text"])[0])
                if size >= CHUNK_BYTES:
                    yield packed()
                    k, held, size = k + 1, [], 0
        if held:
            yield packed()

    spark = documents.sparkSession
    buckets = min(MOST_BUCKETS, 4 * max(1, documents.rdd.getNumPartitions()))
    name = f"strataloom_chunks_{uuid.uuid4().hex}"
    made = documents.mapInArrow(run, "chunk bigint, texts binary")
    made.write.format("parquet").bucketBy(buckets, "chunk").option("path", C.scratch_path(spark, "chunks")).saveAsTable(name)
    return spark.table(name), buckets


def _unpack(texts: bytes) -> Iterator[pa.RecordBatch]:
    import zstandard

    return iter(pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(texts)))


class Segmented:
    """Distinct words and their ids, as arrays: those of word k are ``ids[off[k]:off[k + 1]]``."""

    def __init__(self, words: pa.Array, ids: pa.Array):
        self.words = words
        raw, off = C.bytes_view(ids)
        self.ids, self.off = raw.view(">u2").astype("<u2"), off // 2


def _words_of_chunk(texts: bytes, frequent: Segmented, joined: np.ndarray):
    """The doc_ids of a chunk, the place of each word among its distinct words, these words' places among the frequent ones (-1: none), the offsets of documents, and the distinct words. Texts are cut a slice at a time, so that arrays stay small."""
    doc_ids, parts, ends = [], [], [np.zeros(1, np.int64)]
    for batch in _unpack(texts):
        words, off = cut_words(batch["text"], joined)
        doc_ids.append(batch["doc_id"])
        parts.append(words)
        ends.append(off[1:] + ends[-1][-1])
    coded = pa.concat_arrays(parts).dictionary_encode()
    known = pc.fill_null(pc.index_in(coded.dictionary, value_set=frequent.words), -1).to_numpy()
    return pa.concat_arrays(doc_ids), coded.indices.to_numpy(), known, np.concatenate(ends), coded.dictionary


def _frequent_words(chunks: DataFrame, model: Model) -> Segmented:
    """The FREQUENT most frequent words of SAMPLE_CHUNKS chunks at most, and their ids."""
    some = [r[0] for r in chunks.select("chunk").orderBy(F.xxhash64("chunk")).limit(SAMPLE_CHUNKS).collect()]
    none = Segmented(pa.array([], pa.large_string()), pa.array([], pa.binary()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in batch["texts"]:
                _, place, _, _, words = _words_of_chunk(texts.as_py(), none, model.joined)
                n = np.bincount(place, minlength=len(words))
                for at in range(0, len(words), 1 << 16):
                    yield pa.RecordBatch.from_pydict({"word": words.slice(at, 1 << 16).cast(pa.string()), "n": pa.array(n[at : at + (1 << 16)], pa.int64())})
                C.release()

    counts = chunks.where(F.col("chunk").isin(some or [0])).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = C.materialise(counts, "counts")
    least, total = 1, 0
    for n, words in sorted(((r["n"], r["count"]) for r in counts.groupBy("n").count().collect()), reverse=True):  # as many rows as a sample has different counts
        total += words
        if total > FREQUENT:
            least = n + 1
            break
    # ``set`` is zero, but no literal: Spark would drop that from the grouping, and deal the edges out anew.
    top = counts.where(F.col("n") >= least).where(F.length("word") <= SHORT).select("word", F.col("word").alias("tag"), F.pmod(F.length("word"), F.lit(1)).alias("set"), F.lit(None).cast("array<bigint>").alias("spots"))
    solved = segment(top.repartition(64, "set", "tag"), model).select("word", "ids").toArrow()  # FREQUENT rows at most
    return Segmented(solved["word"].combine_chunks().cast(pa.large_string()), solved["ids"].combine_chunks()) if solved.num_rows else none


def encode(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every document."""
    import zstandard

    spark = documents.sparkSession
    model = load_model(model_path)
    joined = model.joined
    documents = C.only(documents, "doc_id", "text")
    id_type = documents.schema["doc_id"].dataType.simpleString()
    chunks, buckets = _chunk_table(documents)
    shared = spark.sparkContext.broadcast(_frequent_words(chunks, model))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of each chunk that are not frequent. A spot holds the chunk (its partition within the set, and its number) and the word's place among these."""
        for batch in batches:
            for chunk, texts in zip(batch["chunk"].to_pylist(), batch["texts"], strict=True):
                _, _, known, _, words = _words_of_chunk(texts.as_py(), shared.value, joined)
                new = words.filter(pa.array(known < 0)).cast(pa.string())
                part = chunk >> 32
                base = (part % TOGETHER) << 55 | (chunk & 0xFFFFFFFF) << 32
                for at in range(0, len(new), 1 << 15):
                    some = new.slice(at, 1 << 15)
                    spot = (np.arange(at, at + len(some), dtype=np.uint64) + np.uint64(base)).view(np.int64)
                    yield pa.RecordBatch.from_pydict({"word": some, "spot": pa.array(spot), "set": pa.array(np.full(len(some), part // TOGETHER, np.int32))})
                C.release()

    # Each word becomes some fifty substrings, so words are dealt over partitions of one chunk's words each.
    tag = F.when(F.length("word") <= SHORT, F.col("word")).otherwise(F.concat(F.lit("\0"), F.sha2(F.col("word").cast("binary"), 256)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chunks.count())
    dealt = chunks.mapInArrow(rare, "word string, spot bigint, set int").withColumn("tag", tag).repartition(parts, "set", "tag")
    named = dealt.groupBy("set", "tag").agg(F.first("word").alias("word"), F.collect_list("spot").alias("spots"))
    solved = segment(named, model).select("set", F.explode("spots").alias("spot"), "ids")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The places and ids of words, 2^18 at a time, as one compressed blob for each chunk: (chunk, words)."""
        press = zstandard.ZstdCompressor(level=5)

        def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            spot = table["spot"].to_numpy().view(np.uint64)
            part = table["set"].to_numpy().astype(np.int64) * TOGETHER + (spot >> np.uint64(55)).astype(np.int64)
            chunk = part << 32 | (spot >> np.uint64(32) & np.uint64((1 << 23) - 1)).astype(np.int64)
            place = (spot & np.uint64(0xFFFFFFFF)).astype("<u4")
            order = np.lexsort((place, chunk))
            chunk, place = chunk[order], place[order]
            ids, off = C.bytes_view(table["ids"].take(pa.array(order)))
            size = np.diff(off).astype("<u4")
            head = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
            for a, b in zip(head.tolist(), [*head[1:].tolist(), len(chunk)], strict=True):
                raw = struct.pack("<I", b - a) + np.diff(place[a:b], prepend=np.uint32(0)).tobytes() + size[a:b].tobytes() + ids[off[a] : off[b]].tobytes()
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([int(chunk[a])]), "words": pa.array([press.compress(raw)], pa.binary())})

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= 1 << 18:
                yield from packed(held)
                held = []
        if sum(x.num_rows for x in held):
            yield from packed(held)

    # Dealt as the texts are, so only these blobs move.
    blobs = solved.mapInArrow(bundle, "chunk bigint, words binary").repartition(buckets, "chunk").groupBy("chunk").agg(F.collect_list("words").alias("words"))

    def join(texts: bytes, words: list[bytes]) -> pa.RecordBatch:
        """The documents of a chunk with their ids."""
        undo = zstandard.ZstdDecompressor()
        frequent = shared.value
        docs, place, known, off, distinct = _words_of_chunk(texts, frequent, joined)
        new = np.flatnonzero(known < 0)
        parts, size = [frequent.ids], np.zeros(len(distinct), np.int64)
        begin = np.zeros(len(distinct), np.int64)
        size[known >= 0] = np.diff(frequent.off)[known[known >= 0]]
        begin[known >= 0] = frequent.off[known[known >= 0]]
        at, seen = len(frequent.ids), 0
        for blob in words:
            raw = undo.decompress(blob)
            (n,) = struct.unpack_from("<I", raw)
            which = new[np.cumsum(np.frombuffer(raw, "<u4", n, 4))]
            size[which] = np.frombuffer(raw, "<u4", n, 4 + 4 * n) // 2
            begin[which] = at + np.cumsum(size[which]) - size[which]
            parts.append(np.frombuffer(raw, ">u2", -1, 4 + 8 * n).astype("<u2"))
            at, seen = at + len(parts[-1]), seen + n
        if seen != len(new):
            raise ValueError(f"{len(new) - seen} words of a chunk are not solved")
        flat, out, ends = np.concatenate(parts), [], [np.zeros(1, np.int64)]
        for a in range(0, len(docs), 1 << 10):  # a thousand documents at a time
            b = min(a + (1 << 10), len(docs))
            here = place[off[a] : off[b]]
            n = size[here]
            before = np.cumsum(n) - n
            out.append(flat[np.repeat(begin[here] - before, n) + np.arange(int(n.sum()))].astype("<i4"))
            ends.append(np.append(before, n.sum())[off[a + 1 : b + 1] - off[a]] + ends[-1][-1])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(out) if out else np.zeros(0, "<i4")))
        return pa.RecordBatch.from_arrays([docs, lists], names=["doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, words in zip(batch["texts"], batch["words"], strict=True):
                yield join(texts.as_py(), words.as_py() or [])
                C.release()

    return chunks.join(blobs, "chunk", "left").select("texts", "words").mapInArrow(run, f"doc_id {id_type}, ids array<int>")


# --- decoding -----------------------------------------------------------------------------


class Decoder:
    """Ids back to text."""

    def __init__(self, model_path: str):
        model = load_model(model_path)
        raw = dict(zip(model.ids, (p.encode() for p in model.pieces), strict=True)) | {model.first_byte + b: bytes([b]) for b in range(256)}
        self.pieces = pa.array([raw.get(i, b"") for i in range(max(model.size, model.first_byte + 256))], pa.large_binary())

    def texts(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids, without its dummy space; a null list is an empty text."""
        off = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
        pieces = self.pieces.take(pc.list_flatten(ids))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(off, pa.int64()), pieces), pa.scalar(b"", pa.large_binary()))
        return pa.array([t[1:].decode() for t in joined.to_pylist()], pa.string())


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit words) and text of every row."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = [np.asarray(i.values if i.is_valid else [], "<i4") for i in batch["ids"]]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()), decoder.texts(batch["ids"])],
                    names=["doc_id", "n_pieces", "ids_crc32", "text"],
                )
            C.release()

    return C.only(encoded, "doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, n_pieces bigint, ids_crc32 bigint, text string")

"""Token ids in a binary format of compressed planes.

Documents are sorted by id over range partitions; each partition encodes its texts and writes
one file. A file is a run of chunks, each of ``BLOCK`` ids (the last one shorter): the ids as
little-endian words are transposed, so that plane k holds byte k (or bit k) of every id, and
each plane is a zstandard frame of its own. After the chunks come the document index (ids and
lengths), the chunk index (offset, number of ids and plane sizes of every chunk) and a footer
with their places, so that any chunk can be read alone.

Files have names of their own for each attempt; the manifest table that Spark commits names
those that count, so a lost executor or a second attempt leaves nothing that is read.

Defined cases: a null or empty text is just the end id; repeated rows are written each time;
a null doc_id sorts first; an empty table gives an empty manifest; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Ids in a chunk.
BLOCK = 1 << 16
#: Id put after each document.
END = 0
#: Words whose ids an encoder remembers; when full it starts anew.
REMEMBERED = 1_000_000
MAGIC = b"PLANES01"


# --- planes -------------------------------------------------------------------------------


def split_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of a block, without those above the highest one in use."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == "bit":
        raw = np.packbits(np.unpackbits(raw, axis=1, bitorder="little"), axis=0, bitorder="little")
    used = [k for k in range(raw.shape[1]) if raw[:, k].any()]
    return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(max(used, default=0) + 1)]


def join_planes(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    raw = np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1)
    if planes == "bit":
        raw = np.packbits(np.unpackbits(raw, axis=0, bitorder="little")[:n], axis=1, bitorder="little")
    full = np.zeros((n, 4), np.uint8)
    full[:, : raw.shape[1]] = raw
    return full.reshape(-1).view("<u4")


class Writer:
    """Takes the ids of one document after another and writes chunks as they fill."""

    def __init__(self, out, planes: str, block: int, level: int = 3):
        import zstandard

        self.out, self.planes, self.block = out, planes, block
        self.press = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.chunks: list[list] = []
        self.doc_ids: list = []
        self.lengths: list[int] = []
        self.at = out.write(MAGIC)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            self._flush(self.block)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        while len(ids) >= least and len(ids):
            frames = [self.press.compress(p) for p in split_planes(ids[: self.block], self.planes)]
            self.chunks.append([self.at, len(ids[: self.block]), [len(f) for f in frames]])
            self.at += self.out.write(b"".join(frames))
            ids = ids[self.block :]
        self.held, self.n_held = [ids], len(ids)

    def close(self) -> tuple[int, int]:
        self._flush(1)
        docs = self.press.compress(json.dumps([self.doc_ids, self.lengths]).encode())
        index = self.press.compress(json.dumps({"planes": self.planes, "block": self.block, "chunks": self.chunks}).encode())
        self.out.write(docs + index + struct.pack("<QQQ", self.at, len(docs), len(index)) + MAGIC)
        return len(self.lengths), sum(self.lengths)


class Reader:
    """Random access to the chunks of a file, and its documents in order."""

    def __init__(self, file):
        import zstandard

        self.file, self.open = file, zstandard.ZstdDecompressor()
        size = file.size()
        file.seek(size - 24 - len(MAGIC))
        at, n_docs, n_index = struct.unpack("<QQQ", file.read(24))
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a file of planes")
        file.seek(at)
        self.doc_ids, self.lengths = json.loads(self.open.decompress(file.read(n_docs)))
        self.index = json.loads(self.open.decompress(file.read(n_index)))

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.index["chunks"][k]
        self.file.seek(at)
        raw, parts, pos = self.file.read(sum(sizes)), [], 0
        for s in sizes:
            parts.append(self.open.decompress(raw[pos : pos + s]))
            pos += s
        return join_planes(parts, n, self.index["planes"])

    def documents(self) -> Iterator[tuple[object, int, np.ndarray]]:
        """(doc_id, ids before it in the file, its ids)."""
        k, held, start = 0, np.zeros(0, "<u4"), 0
        for doc_id, n in zip(self.doc_ids, self.lengths, strict=True):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.chunk(k))
                have += len(parts[-1])
                k += 1
            ids = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, start, ids[:n]
            held, start = ids[n:], start + n


# --- encoding -----------------------------------------------------------------------------

#: Bytes of which no two may follow one another in a text that is cut into words, and bytes such a text may not hold. Fixed values.
_SPACES = C.table(lambda b: b in (10, 32))
_NEVER = C.table(lambda b: b < 32 and b != 10)
#: Lead bytes under which white space outside ASCII is encoded, and that white space; such texts are encoded whole. Fixed values.
_LEADS = C.table(lambda b: b in (0xC2, 0xE1, 0xE2, 0xE3, 0xEF))
_ODD = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_LETTERS = C.table(lambda b: 65 <= b <= 90 or 97 <= b <= 122)
_STOPS = C.table(lambda b: b in b",.")


class Encoder:
    """The tokenizer file's ids of whole texts.

    The tokenizer never joins what stands before white space with it, nor a letter with a
    comma or full stop, so a text is the concatenation of its words with the one space or line
    end before them, single stops apart. Each distinct word is encoded by the tokenizer once
    and remembered under its bytes; texts with other white space are encoded whole."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self.known: dict[bytes, bytes] = {}
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_bytes(*C.bytes_view(pa.array(texts, pa.large_string())))

    def encode_bytes(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """The ids of each text and the end id."""
        n = len(off) - 1
        simple = self._simple(data, off)
        mark = _SPACES[data]
        mark[1:-1] |= _STOPS[data[1:-1]] & _LETTERS[data[:-2]] & _SPACES[data[2:]]
        filled = np.flatnonzero(off[1:] > off[:-1])
        mark[off[filled]] = True
        begin = np.flatnonzero(mark)
        end = np.append(begin[1:], len(data))[: len(begin)]
        row = np.searchsorted(off, begin, "right") - 1
        keep = simple[row]
        begin, end, row = begin[keep], end[keep], row[keep]
        first, place = C.distinct_spans(data, begin, end)
        raw = data.tobytes()
        found = self._look_up([raw[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)])
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        length = size[place]
        before = np.cumsum(length) - length
        ids = flat[np.repeat((np.cumsum(size) - size)[place] - before, length) + np.arange(int(length.sum()))]
        edge = np.concatenate([[0], np.cumsum(np.bincount(row, weights=length, minlength=n).astype(np.int64))])
        out = [np.append(ids[a:b], np.uint32(END)).astype("<u4") for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        whole = np.flatnonzero(~simple).tolist()
        texts = [data[off[i] : off[i + 1]].tobytes().decode() for i in whole]
        for i, e in zip(whole, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            out[i] = np.array([*e.ids, END], "<u4")
        return out

    def _simple(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Which texts have single spaces and line ends as their only white space."""
        bad = _NEVER[data]
        space = _SPACES[data]
        bad[1:] |= space[1:] & space[:-1]
        odd = _LEADS[data]
        count = lambda m: np.diff(np.concatenate([[0], np.cumsum(m, dtype=np.int64)])[off])
        simple = count(bad) == 0
        for i in np.flatnonzero(simple & (count(odd) > 0)).tolist():
            simple[i] = not _ODD.search(data[off[i] : off[i + 1]].tobytes().decode())
        return simple

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words, those not known encoded first."""
        if len(self.known) > self.remembered:
            self.known = {}
        known = self.known
        new = [w for w in words if w not in known]
        known.update(zip(new, self._encode_words([w.decode() for w in new]), strict=True))
        return [known[w] for w in words]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words, many in one call: parted by line ends, each a token of its own. A word's own line end is put back before it."""
        out: list[bytes] = []
        lead = struct.pack("<I", self.line_end)
        for at in range(0, len(words), 1024):
            part = words[at : at + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(w.lstrip("\n") for w in part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(ids == self.line_end) * 4).tolist() + [len(ids) * 4]
            raw = ids.tobytes()
            if len(ends) == len(part) and all(w not in ("\n", " ") for w in part):
                out += [lead + raw[a:b] if w[0] == "\n" else raw[a:b] for w, a, b in zip(part, [0, *[e + 4 for e in ends[:-1]]], ends, strict=True)]
            else:
                out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out


#: Encoders of this process by file, so that tasks that follow one another share what was learned.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def store(path: str):
    """The file system of a path and the path in it. Tasks open files of the shared folder by it; s3a and s3n are s3 here."""
    return pa.fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))


def write_ids(documents: DataFrame, tokenizer_path: str, path: str, planes: str = "byte", block: int = BLOCK) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; returns the manifest: part, file, n_docs, n_ids."""
    spark = documents.sparkSession
    ordered = C.only(documents, "doc_id", "text").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        coder = writer = None
        fs, root = store(path)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.planes"
        for whole in batches:
            for batch in C.slices(whole):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    coder, out = encoder(tokenizer_path), fs.open_output_stream(f"{root}/{name}")
                    writer = Writer(out, planes, block)
                encoded = coder.encode_bytes(*C.bytes_view(batch["text"]))
                for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoded, strict=True):
                    writer.add(doc_id, ids)
        if writer is not None:
            n_docs, n_ids = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": [name], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    manifest = f"{path}/manifest"
    schema = "part bigint, file string, n_docs bigint, n_ids bigint"
    ordered.mapInArrow(run, schema).write.parquet(manifest)
    return spark.read.schema(schema).parquet(manifest)


def read_ids(spark: SparkSession, path: str, id_type: str = "bigint", with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document in the files."""
    files = spark.read.parquet(f"{path}/manifest")
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.withColumn("before", before).repartition(max(1, files.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(path)
        for batch in batches:
            for name, base in zip(batch["file"].to_pylist(), batch["before"].to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as file:
                    rows: list[tuple] = []
                    held = 0
                    for doc_id, start, ids in Reader(file).documents():
                        rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist() if with_ids else None))
                        held += len(ids) if with_ids else 1
                        if held >= 1 << 17:
                            yield table(rows)
                            rows, held = [], 0
                    yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        out = {"doc_id": pa.array(cols[0], pa.int64() if id_type == "bigint" else None), "start": pa.array(cols[1], pa.int64()), "n_tokens": pa.array(cols[2], pa.int64()), "ids_crc32": pa.array(cols[3], pa.int64())}
        return pa.RecordBatch.from_pydict(out | ({"ids": pa.array(cols[4], pa.list_(pa.int64()))} if with_ids else {}))

    return files.mapInArrow(run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)

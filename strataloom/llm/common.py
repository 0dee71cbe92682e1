"""Helpers shared by the training-data operators: the shared scratch folder, size-checked
broadcast joins, and NumPy views of Arrow text columns."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Bytes of text that are turned into arrays at a time; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); only where it is unset and the master is local, as in tests, one of this machine."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="strataloom-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir() or path
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (the join then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns: extra columns of an input, clashing or not, never reach an operator."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def release() -> None:
    """Give freed memory back to the system: between large pieces of work, so that a worker that lives on holds no more than it needs."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)


def bytes_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the n + 1 offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of about ``most`` bytes of text at most, so arrays stay small."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


# --- words as 64-bit hashes ---------------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd: multiplies word hashes of short windows
#: Spans of bytes are hashed by a polynomial modulo this prime; its base is a fixed value without any structure.
_PRIME = (1 << 61) - 1
_POINT = 0x0B5F4F3C2D96A1E7
_P, _LOW30, _LOW31 = np.uint64(_PRIME), np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)
#: Longer spans would overflow the sums and are hashed one by one.
_LONG_SPAN = 1 << 23


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reduce(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo the prime."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of values below it."""
    ah, al, bh, bl = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    mid = ah * bl + al * bh
    return _reduce(((ah * bh) << np.uint64(1)) + (mid >> _30) + ((mid & _LOW30) << _31) + al * bl)


class Powers:
    """Powers of the point and of its inverse modulo the prime, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SLICE_BYTES + (1 << 16))
            for name, factor in (("up", _POINT), ("down", pow(_POINT, -1, _PRIME))):
                have = getattr(self, name)
                while len(have) < n:
                    have = np.concatenate([have, mulmod(have[: n - len(have)], np.uint64(pow(factor, len(have), _PRIME)))])
                setattr(self, name, have)
        return self.up, self.down


POWERS = Powers()


def byte_codes(lower: bool) -> np.ndarray:
    """A number for each byte, none zero; with ``lower`` A-Z share those of a-z."""
    codes = np.arange(1, 257, dtype=np.uint64)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


def table(inside) -> np.ndarray:
    """256 booleans: for which bytes ``inside`` holds."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Words are runs of bytes that are not ASCII white space.
NOT_SPACE = table(lambda b: not (b == 32 or 9 <= b <= 13))
#: Words are runs of digits, letters and bytes of non-ASCII characters.
WORD_BYTES = table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of true bytes; runs never cross rows."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = off[:-1][off[:-1] < n]
    tails = off[1:][off[1:] > 0] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


class Sums:
    """Prefix sums of a polynomial over bytes, from which the hash of any span follows."""

    def __init__(self, data: np.ndarray, codes: np.ndarray):
        n = len(data)
        up, self.down = POWERS.to(n + 1)
        code = codes[data]
        self.low, self.high = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(code * (up[:n] & _LOW31), out=self.low[1:])
        np.cumsum(code * (up[:n] >> _31), out=self.high[1:])

    def hashes(self, start, end, length) -> np.ndarray:
        """Of the spans from each start to each end (arrays or slices), which depend on their bytes and length alone."""
        high = _reduce(self.high[end] - self.high[start])
        total = _reduce(_reduce(self.low[end] - self.low[start]) + (high >> _30) + ((high & _LOW30) << _31))
        return mix(mulmod(total, self.down[start]) + length * _MULT)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    out = Sums(data, codes).hashes(start, end, length.astype(np.uint64))
    for i in np.flatnonzero(length > _LONG_SPAN).tolist():
        raw = codes[data[start[i] : end[i]]].astype("<u2").tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` bytes from each a and b are equal."""
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    same, at, live = np.ones(len(a), bool), 0, np.flatnonzero((length > 0) & (a != b))
    while len(live):
        x, y = (np.ascontiguousarray(eight[p[live] + at]).view("<u8").ravel() for p in (a, b))
        left = np.minimum(length[live] - at, 8).astype(np.uint64)
        differ = (x ^ y) << ((np.uint64(8) - left) << np.uint64(3))
        same[live[differ != 0]] = False
        at += 8
        live = live[(differ == 0) & (length[live] > at)]
    return same


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of equal spans of bytes, and for each span its place among these. Equality is that of the bytes; hashes only sort."""
    _, first, place = np.unique(span_hashes(data, start, end, byte_codes(False)), return_index=True, return_inverse=True)
    length, of = end - start, first[place]
    if len(start) and not ((length == length[of]).all() and same_bytes(data, start, start[of], length).all()):
        seen: dict[bytes, int] = {}
        place = np.array([seen.setdefault(data[a:b].tobytes(), len(seen)) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        first = np.unique(place, return_index=True)[1]
    return first, place


def words_of(data: np.ndarray, off: np.ndarray, inside: np.ndarray, lower: bool):
    """Start, end, row and hash of every word."""
    start, end, row = runs(inside[data], off)
    return start, end, row, span_hashes(data, start, end, byte_codes(lower))


def grams(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every run of ``k`` words within a row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + hashes[j : j + n]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return at, mix(out[at])


def by_row_and_value(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Order by row, then value; rows must be few (a slice), so that the second sort is a radix sort."""
    first = np.argsort(value, kind="stable")
    kind = np.uint16 if not len(row) or row.max() < 65536 else np.int64
    return first[np.argsort(row[first].astype(kind), kind="stable")]

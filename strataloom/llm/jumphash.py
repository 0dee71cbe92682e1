"""Sharding by jump consistent hashing, in DataFrame functions only.

A stable key goes to one of n shards without a ring table: the key seeds a linear
congruential generator whose draws give the growing sequence of shard counts at which the
key would move; the last jump below n is its shard. With one shard more, about 1 / (n + 1) of
the keys move, all of them into the new shard.

Defined cases: a null key hashes like any other value (all null keys share a shard); a null
text has size 16 and the checksum of the empty text; repeated rows each get a slot of their
own; an empty table gives no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one shard that are ranked together, on average; the number of groups grows with the table.
ROWS_PER_RUN = 4000

# Multiplier of the generator, and the modulus 2**64.
_MULTIPLIER = "2862933555777941757"
_MODULUS = "18446744073709551616"


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a 64-bit integer key.

    The state of the generator is an unsigned 64-bit value held as a decimal, because
    products wrap modulo 2**64; its top 31 bits are the draw."""
    if shards < 1:
        raise ValueError("shards must be positive")
    wide = lambda text: F.lit(text).cast("decimal(20,0)")
    seed = key.cast("decimal(20,0)")
    seed = F.when(seed < 0, (seed + wide(_MODULUS)).cast("decimal(20,0)")).otherwise(seed)
    start = F.struct(seed.alias("state"), F.lit(-1).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("jump"))

    def step(acc: Column, _: Column) -> Column:
        product = (acc["state"] * F.lit(_MULTIPLIER).cast("decimal(19,0)")).cast("decimal(38,0)") + F.lit(1).cast("decimal(1,0)")
        state = (product % F.lit(_MODULUS).cast("decimal(20,0)")).cast("decimal(20,0)")
        draw = F.floor(state / F.lit("8589934592").cast("decimal(10,0)")).cast("bigint")
        jump = F.floor((acc["jump"] + 1).cast("double") * (F.lit(2147483648.0) / (draw + 1).cast("double"))).cast("bigint")
        return F.when(acc["jump"] < shards, F.struct(state.alias("state"), acc["jump"].alias("shard"), jump.alias("jump"))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda acc: acc["shard"].cast("int"))


def assign_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Add ``shard`` (under ``shards`` shards) and ``grown_shard`` (under one more) to ``df``."""
    hashed = F.xxhash64(F.col(f"`{key}`"))
    return df.withColumn("shard", jump_shard(hashed, shards)).withColumn("grown_shard", jump_shard(hashed, shards + 1))


def number_slots(df: DataFrame, shard: str, order: list[str], rows: int) -> DataFrame:
    """Add ``slot``: gapless from 0 within each shard.

    Rows of a shard are dealt by hash into runs whose number grows with ``rows`` (the size of
    the table), each run is ranked on its own, and the counts of the runs before it are added.
    No task holds a whole shard. Rows equal in ``order`` are told apart by nothing and keep
    any order among themselves."""
    n_runs = max(1, rows // ROWS_PER_RUN)
    dealt = df.withColumn("_run", F.pmod(F.xxhash64(*[F.col(c) for c in order], F.lit("run")), F.lit(n_runs)))
    counts = dealt.groupBy(shard, "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(shard, "_run", (F.sum("_n").over(Window.partitionBy(shard).orderBy("_run")) - F.col("_n")).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(shard, "_run").orderBy(*order)) - 1)
    return ranked.join(before, [shard, "_run"]).withColumn("slot", (F.col("_before") + F.col("_rank")).cast("bigint")).drop("_run", "_rank", "_before")


def shard_documents(documents: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = documents.select(F.col("doc_id"), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = number_slots(assign_shards(sized, "doc_id", shards), "shard", ["doc_id", "text_crc32", "size"], documents.count())
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, path: str, key: str, shards: int) -> None:
    """Write ``df`` as one folder per shard."""
    df.withColumn("shard", jump_shard(F.xxhash64(F.col(f"`{key}`")), shards)).write.partitionBy("shard").parquet(path)

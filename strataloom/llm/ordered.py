"""Places in an order over whole tables: rows are dealt out by ranges of the order and sorted where they are, so a group
of any size is numbered and summed by many tasks; what tasks owe to earlier ones is one row for each part and group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: monotonically_increasing_id() keeps the number of the partition above this bit and the place in it below.
PART_BIT = 33


def in_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` written in the order of the named columns (nulls first), with its part and its place in the part."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return materialise(dealt.withColumn("part", F.shiftright("place", PART_BIT)), name)


def groups(table: DataFrame, by: list[str], sums: dict[str, Column] | None = None, combine: Callable = F.sum) -> DataFrame:
    """For each part and group of a table in order: ``first`` place, ``before`` (rows of the group in earlier parts),
    ``total`` rows of the group, and for each of ``sums`` what those of earlier parts combine to."""
    sums = sums or {}
    parts = table.groupBy("part", *by).agg(F.min("place").alias("first"), F.count("*").alias("n"), *[c.alias(k) for k, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    count = [F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(*by)).alias("total")]
    return parts.select("part", *by, "first", *count, *[F.coalesce(combine(k).over(earlier), F.lit(0)).alias(k) for k in sums])


def running(table: DataFrame, by: list[str], sums: dict[str, Column], name: str, combine: Callable = F.sum) -> DataFrame:
    """A table in order whose groups are runs of it, with the running sum of each column of ``sums``, its own row included."""
    at = materialise(groups(table, by, {f"{k}_before": combine(c) for k, c in sums.items()}, combine), f"{name}-sums").drop("first", "before", "total")
    here = Window.partitionBy("part", *by).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    both = lambda k, c: F.col(f"{k}_before").bitwiseXOR(combine(c).over(here)) if combine is F.bit_xor else F.col(f"{k}_before") + combine(c).over(here)
    return table.join(at, ["part", *by]).select(*table.columns, *[both(k, c).alias(k) for k, c in sums.items()])


def numbered(table: DataFrame, by: list[str], name: str) -> DataFrame:
    """A table in order whose groups are runs of it, with ``index`` (from 0 in the group) and ``total``. ``by`` holds no nulls."""
    at = materialise(groups(table, by), f"{name}-groups")
    index = (F.col("place") - F.col("first") + F.col("before")).alias("index")
    return table.join(at, ["part", *by]).select(*[c for c in table.columns if c not in ("place", "part")], index, "total")

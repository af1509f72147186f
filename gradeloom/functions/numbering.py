"""Positions, running values and shares without putting a whole group into one task.

A plain window sends every row of its partition key to one task. When one key holds a third of the
rows, that task never ends, so the operators use the helpers below: they pre-aggregate, or split a
group into blocks of bounded size and carry only one summary row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.session import cut

BLOCK = 65_536


def with_group_values(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Adds per-group aggregates: partial aggregation, then an equi-join AQE can split."""
    totals = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])
    return df.join(totals, keys, "left")


# Sub-groups that the rows of one key are merged in before they meet.
GROUPS = 64


def _head(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per key.

    Two steps for every n: the rows of a key are cut to n in sub-groups of input partitions first, so the
    last task of a hot key gets at most n rows from each sub-group. Spark applies the limit of each step
    before its exchange as well where n is small.
    """
    salted = df.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    return _head(_head(salted, [*keys, "__salt"], order, n).drop("__salt"), keys, order, n)


def number_rows(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Consecutive numbers from 1 in the given order, over the whole table. The order should be unique
    per row, so that ranges can split anywhere.

    Range-partitions and sorts once, keeps the result, counts rows per partition (one row per
    partition, so the running offset is bounded by the partition count), and adds the offset.
    """
    placed = cut(
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("__m", F.monotonically_increasing_id())
    )
    part = F.shiftright("__m", 33)
    counts = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("__c"))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__p", F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__off"))
    inside = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("__p", part)
        .join(F.broadcast(offsets), "__p")
        .withColumn(name, inside + F.col("__off") + 1)
        .drop("__p", "__m", "__off")
    )


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows of the whole table in the given order, which must be unique per row and without nulls.

    Only the order's columns are sorted, by ranges; the n-th of them is the bar that the rows are filtered by. So the
    result of any n stays spread out, and the rows themselves are not moved.
    """
    if n <= 0:
        return df.limit(0)
    bar = number_rows(df.select(*order), order, "__id").where(F.col("__id") == n).select(*order).first()
    if bar is None:
        return df
    return df.where(F.struct(*[F.col(c) for c in order]) <= F.struct(*[F.lit(bar[c]).alias(c) for c in order]))


def last_before(df: DataFrame, keys: list[str], pos: str, value: Column, name: str) -> DataFrame:
    """Largest `value` among strictly earlier rows of the same key (null if there is none).

    `pos` is a whole number, unique per key. Rows are cut into blocks of BLOCK positions: the first
    window sees at most BLOCK rows, the second only one row per block.
    """
    blocked = df.withColumn("__b", F.floor(F.col(pos) / BLOCK)).withColumn("__v", value)
    inner = Window.partitionBy(*keys, "__b").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocked.groupBy(*keys, "__b").agg(F.max("__v").alias("__bv"))
        .withColumn("__carry", F.max("__bv").over(outer))
        .select(*keys, "__b", "__carry")
    )
    return (
        blocked.withColumn("__in", F.max("__v").over(inner))
        .join(carried, [*keys, "__b"], "left")
        .withColumn(name, F.coalesce("__in", "__carry"))
        .drop("__b", "__v", "__in", "__carry")
    )

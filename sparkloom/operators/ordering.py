"""Places, ranks and running sums over whole tables without a one-task window.

Rows are range-partitioned by their order and sorted; each partition's first place (or sum) is what the partitions before it
hold, a table of one row a partition. The sorted table is checkpointed, so that both steps see the same partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.graph import checkpointed


def _laid(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """Rows in order with ``_part``, and ``_nth`` rising within it. ``order`` should tell rows apart: rows that it does not
    may come in any order, and all lie in one partition."""
    return checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id()))


def _before(parts: DataFrame, value: str) -> DataFrame:
    """(_part, _before): the sum of ``value`` of the partitions before; the window has a row for each partition."""
    return parts.withColumn("_before", F.coalesce(F.sum(value).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def numbered(df: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """``df`` with dense numbers from ``start`` in the order of ``order``."""
    laid = _laid(df, order)
    first = _before(laid.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_nth").alias("_least")), "_n")
    out = laid.join(F.broadcast(first.select("_part", "_least", "_before")), "_part")  # a row a partition
    return out.withColumn(name, (F.col("_before") + F.col("_nth") - F.col("_least") + start).cast("long")).drop("_part", "_nth", "_least", "_before")


def running_sum(df: DataFrame, order: list[str | Column], value: str, name: str, inclusive: bool = True) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each one, or before it."""
    laid = _laid(df, order)
    first = _before(laid.groupBy("_part").agg(F.sum(value).alias("_n")), "_n")
    within = Window.partitionBy("_part").orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = laid.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return own.join(F.broadcast(first.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_nth", "_own", "_before")


def mean_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the mean rank of each value among all, from 1. Distinct values are counted first; nulls get none."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    ranks = running_sum(counts, [value], "_c", "_b", inclusive=False)
    return df.join(ranks.select(value, (F.col("_b") + (F.col("_c") + 1) / 2.0).alias(name)), value, "left")


def least_by_hash(df: DataFrame, key: str, n: int, ties: list[str], bits: int = 60, step: int = 15, few: int = 100_000) -> DataFrame:
    """The ``n`` rows with the least ``key``, a number of ``bits`` bits, ties by ``ties``: a sample of exactly ``n`` rows
    without a sort of all. Histograms of ``step`` bits find the range in which the n-th row lies; only that is sorted."""
    low, left, width = 0, n, bits
    while width > 0:
        here = df.where((F.col(key) >= low) & (F.col(key) < low + (1 << width)))
        width -= min(step, width)
        b = F.shiftright(F.col(key) - low, width)
        counts = {r.b: r.n for r in here.groupBy(b.alias("b")).agg(F.count("*").alias("n")).collect()}  # 2^step rows at most
        for b in sorted(counts):
            if counts[b] >= left:
                low += b << width
                break
            left -= counts[b]
        else:
            return df  # there are no more than n
        if counts[b] <= few:
            break
    rest = df.where((F.col(key) >= low) & (F.col(key) < low + (1 << width))).orderBy(key, *ties).limit(left)
    return df.where(F.col(key) < low).unionByName(rest)

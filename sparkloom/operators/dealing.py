"""Joins whose left side has keys with very many rows, each of which meets many rows of the right side.

Adaptive execution sizes tasks by what they read, so a join that makes hundreds of rows from one gets too few of them, and a
few common keys make one task do most of the work. Here tasks are sized by rows of the left side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.graph import checkpointed


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], rows: int, how: str = "inner", counted: DataFrame | None = None, arrived=None) -> DataFrame:
    """The join of both on ``keys``, inner or left, in tasks of about ``rows`` rows of ``left``.

    A key with more rows than that is cut into parts, and its rows of ``right`` are copied to each: one copy for ``rows``
    rows, so copies are a small share of what the join gives. ``left`` is read twice before, to count it, or instead a
    narrower ``counted`` with as many rows for each of the ``keys`` that it has. ``arrived`` is applied to ``right`` once its
    rows are where they are joined.
    """
    counted = left if counted is None else counted
    by = [k for k in keys if k in counted.columns]
    counts = counted.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    parts = F.broadcast(checkpointed(counts.select(*by, F.ceil(F.col("_n") / rows).cast("int").alias("_parts"))))  # a row for ``rows`` rows at most
    tasks = max(1, -(-counted.count() // rows))
    own = left.withColumn("_h", F.xxhash64(*left.columns)).join(parts, by, "left").withColumn("_part", F.pmod("_h", F.coalesce("_parts", F.lit(1))).cast("int")).drop("_h", "_parts")
    other = right.join(parts, by, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    other = other.repartition(tasks, *keys, "_part")
    return own.repartition(tasks, *keys, "_part").join(other if arrived is None else arrived(other), [*keys, "_part"], how).drop("_part")

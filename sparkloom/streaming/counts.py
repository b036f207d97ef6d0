"""Counts kept up to date from a stream: beyond batch queries, as all counts are sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def item_counts(steps: DataFrame, time: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, item, cnt) of a stream of (item, ``time``) by tumbling windows; rows later than ``late`` are left out."""
    return steps.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "item").agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), "item", "cnt")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """The long table (source, key, iid, cnt) with the counts of ``new`` added."""
    return old.unionByName(new).groupBy("source", "key", "iid").agg(F.sum("cnt").alias("cnt"))


def maintain(batches: DataFrame, counts_of, path: str, checkpoint: str) -> StreamingQuery:
    """Add ``counts_of(micro-batch)`` to versioned tables under ``path``: each batch writes its own counts once.

    A batch that is retried writes the same folder again, so nothing is counted twice.
    """

    def add(df: DataFrame, batch: int) -> None:
        counts_of(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return batches.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, path: str) -> DataFrame:
    """The sum of all batches."""
    return spark.read.parquet(path).groupBy("source", "key", "iid").agg(F.sum("cnt").alias("cnt"))

"""Queries on an experiment log (task_id, iteration, metrics MAP, decision): best so far, trend, stop rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRIMARY = ("acc", "ndcg", "mrr", "f1", "auc", "val_acc", "val_ndcg", "val_mrr")


def primary(metrics):
    """The first known metric, else the mean of all."""
    known = F.coalesce(*(F.try_element_at(metrics, F.lit(k)) for k in PRIMARY))
    values = F.map_values(metrics)
    return F.coalesce(known, F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values)))


def _by_task():
    return Window.partitionBy("task_id").orderBy("iteration")


def best_so_far(log: DataFrame) -> DataFrame:
    w = _by_task()
    s = log.withColumn("score", primary(F.col("metrics")))
    s = s.withColumn("before", F.max("score").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return s.withColumn("improved", F.col("before").isNull() | (F.col("score") > F.col("before"))).withColumn("best", F.greatest("score", F.coalesce("before", F.col("score"))))


def best_per_task(log: DataFrame) -> DataFrame:
    s = log.withColumn("score", primary(F.col("metrics")))
    return s.groupBy("task_id").agg(F.min_by("iteration", F.struct(-F.col("score"), "iteration")).alias("iteration"), F.max("score").alias("score"))


def trend(log: DataFrame, window: int = 3, flat: float = 0.01) -> DataFrame:
    """improving: the mean of the last ``window`` scores beats that of the window before it; plateau: their range is
    below ``flat``; falling: three falling scores."""
    w = _by_task()
    s = log.withColumn("score", primary(F.col("metrics")))
    s = s.withColumn("mean", F.avg("score").over(w.rowsBetween(1 - window, 0)))
    span = w.rowsBetween(1 - window, 0)
    enough = F.count("*").over(span) == window
    one, two = F.lag("score", 1).over(w), F.lag("score", 2).over(w)
    return s.withColumns({"improving": F.coalesce(F.col("mean") > F.lag("mean", 1).over(w), F.lit(False)), "plateau": enough & (F.max("score").over(span) - F.min("score").over(span) < flat), "falling": F.coalesce((F.col("score") < one) & (one < two), F.lit(False))})


def stops(log: DataFrame, patience: int = 3, pivots: int = 3, budget: int = 20) -> DataFrame:
    """Each task's first iteration at which a rule stops it, and the rule: stop, patience, pivots or budget."""
    w = _by_task()
    s = best_so_far(log)
    s = s.withColumn("island", F.sum(F.col("improved").cast("int")).over(w))
    s = s.withColumn("stale", F.row_number().over(Window.partitionBy("task_id", "island").orderBy("iteration")) - 1)
    s = s.withColumn("n_pivots", F.sum((F.col("decision") == "PIVOT").cast("int")).over(w)).withColumn("nth", F.row_number().over(w))
    rule = F.when(F.col("decision") == "STOP", "stop").when(F.col("stale") >= patience, "patience").when(F.col("n_pivots") >= pivots, "pivots").when(F.col("nth") >= budget, "budget")
    return s.withColumn("rule", rule).where("rule is not null").groupBy("task_id").agg(F.min("iteration").alias("iteration"), F.min_by("rule", "iteration").alias("rule"))


def decided(log: DataFrame) -> DataFrame:
    """CONTINUE while a score is at least 0.95 of the best before it, PIVOT below; STOP after three stale rounds."""
    s = best_so_far(log)
    w = _by_task()
    s = s.withColumn("island", F.sum(F.col("improved").cast("int")).over(w))
    stale = F.row_number().over(Window.partitionBy("task_id", "island").orderBy("iteration")) - 1
    return s.withColumn("verdict", F.when(stale >= 3, "STOP").when(F.col("score") >= 0.95 * F.coalesce("before", F.col("score")), "CONTINUE").otherwise("PIVOT"))


def exported(log: DataFrame) -> DataFrame:
    """(task_id, trajectory): the log of each task as JSON, in order."""
    row = F.struct("iteration", "decision", F.round(primary(F.col("metrics")), 6).alias("score"))
    return log.groupBy("task_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("trajectory"))

"""Folds and samples by hashes of keys, so that they don't depend on order or partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.scalars import hash_bucket
from sparkloom.operators.ordering import numbered


def group_folds(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    return df.withColumn("fold", hash_bucket(F.col(key), k))


def holdout(df: DataFrame, key: str, per_mille: int = 120) -> DataFrame:
    return df.withColumn("held_out", hash_bucket(F.col(key), 1000) < per_mille)


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5) -> DataFrame:
    """Folds that deal out each label's rows in the order of their hashes."""
    order = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("fold", F.pmod(F.row_number().over(order) - 1, F.lit(k)).cast("long"))


def fold_count(df: DataFrame, label: str, most: int = 5) -> DataFrame:
    """One row: min(most, max(2, rows of the rarest label))."""
    return df.groupBy(label).count().agg(F.least(F.lit(most), F.greatest(F.lit(2), F.min("count"))).cast("long").alias("folds"))


def top_share(df: DataFrame, score: str, tie: str, share: float = 0.2) -> DataFrame:
    """Marks the round(share * n) rows with the highest score, ties to the highest ``tie``."""
    placed = numbered(df, [F.desc(score), F.desc(tie)], "_place", 1)
    return placed.withColumn("selected", F.col("_place") <= F.round(F.lit(share) * df.count())).drop("_place")


def negatives(h: DataFrame, items: DataFrame, n: int = 3, salt: str = "neg") -> DataFrame:
    """(uid, iid): ``n`` items a user never saw, drawn by hash: draws of twice the number, less what was seen."""
    vocab = numbered(items.select(F.col("iid").alias("item")).distinct(), ["item"], "idx")
    size = vocab.agg(F.count("*").alias("size"))
    draws = h.select("uid", F.array_append("dedup", F.col("target")).alias("seen"), F.posexplode(F.sequence(F.lit(1), F.size("dedup") + 2 * n)).alias("j", "_x")).join(F.broadcast(size))
    draws = draws.withColumn("idx", hash_bucket(F.concat_ws(":", "uid", F.lit(salt), "j"), F.col("size"))).join(vocab, "idx").where(~F.array_contains("seen", F.col("item")))
    first = draws.groupBy("uid", "item").agg(F.min("j").alias("j"))
    return first.withColumn("r", F.row_number().over(Window.partitionBy("uid").orderBy("j"))).where(F.col("r") <= n).select("uid", F.col("item").alias("iid"))


def tail_split(df: DataFrame, order: str, share: float = 0.2) -> DataFrame:
    """Marks the last ``share`` of the rows in the order of ``order``."""
    n = df.count()
    return numbered(df, [order], "_place", 1).withColumn("is_tail", F.col("_place") > F.lit(n) - F.floor(F.lit(share) * n)).drop("_place")


def label_mask(seeds: DataFrame, key: str, per_mille: int = 500, salt: str = "mask") -> DataFrame:
    """role: query for labels to be predicted, context for labels that may be seen; no row is both."""
    return seeds.withColumn("role", F.when(hash_bucket(F.concat(F.col(key).cast("string"), F.lit(f":{salt}")), 1000) < per_mille, "query").otherwise("context"))


def ranking_pairs(rows: DataFrame, n: int = 20) -> DataFrame:
    """(qid, pos, neg): each query's positive with its ``n`` negatives of least hash; rows have label 0 or 1."""
    order = Window.partitionBy("qid").orderBy(F.md5(F.concat("qid", F.lit(":"), "iid")), "iid")
    neg = rows.where("label = 0").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).select("qid", F.col("iid").alias("neg"))
    return rows.where("label = 1").select("qid", F.col("iid").alias("pos")).join(neg, "qid")

"""Query-wise normalisation of scores, blends of models, and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _query():
    return Window.partitionBy("qid")


def pct_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    """Mean rank of ties over the number of values, ascending; missing values 0.5."""
    ties = Window.partitionBy("qid", col)
    low = F.rank().over(_query().orderBy(F.col(col).asc_nulls_last()))
    value = (low + (F.count(col).over(ties) - 1) / 2.0) / F.count(col).over(_query())
    return df.withColumn(out, F.when(F.col(col).isNull(), 0.5).otherwise(value))


def rank_first(df: DataFrame, col: str, out: str, tie: str = "iid") -> DataFrame:
    """(n - rank) / max(n - 1, 1), best 1; ties by ``tie``; missing values 0."""
    n = F.count(col).over(_query())
    r = F.row_number().over(_query().orderBy(F.col(col).desc_nulls_last(), tie))
    return df.withColumn(out, F.when(F.col(col).isNull(), 0.0).otherwise((n - r) / F.greatest(n - 1, F.lit(1))))


def zscore(df: DataFrame, col: str, out: str, fill: bool = False) -> DataFrame:
    """(x - mean) / max(sample deviation, 1e-6); with ``fill`` missing values get half below the query's least."""
    std = F.greatest(F.coalesce(F.stddev_samp(col).over(_query()), F.lit(0.0)), F.lit(1e-6))
    df = df.withColumn(out, (F.col(col) - F.avg(col).over(_query())) / std)
    return df.withColumn(out, F.coalesce(F.col(out), F.coalesce(F.min(out).over(_query()), F.lit(-1.0)) - 0.5)) if fill else df


def outer_union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of both models; an error if a model scores one twice."""
    from sparkloom.sources.tables import unique_keys

    return unique_keys(a, keys).join(unique_keys(b, keys), keys, "full_outer")


def places(df: DataFrame, score: str, tie: str = "iid") -> DataFrame:
    return df.withColumn("place", F.row_number().over(_query().orderBy(F.desc(F.round(score, 9)), tie)).cast("long"))


def metrics(placed: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """One row: NDCG@k, Hit@k and MRR of one relevant item a query; queries without it count as misses."""
    hit = placed.where("label = 1").groupBy("qid").agg(F.min("place").alias("place"))
    rows = queries.select("qid").join(hit, "qid", "left")
    inside = F.col("place") <= k
    return rows.agg(F.count("*").alias("n_queries"), F.avg(F.when(inside, 1 / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("ndcg"), F.avg(inside.cast("double")).alias("_h"), F.avg(F.coalesce(inside, F.lit(False)).cast("double")).alias("hit"), F.avg(F.when(inside, 1 / F.col("place")).otherwise(0.0)).alias("mrr")).drop("_h")


def pct_blend(df: DataFrame, weights: dict[str, float], out: str = "blend") -> DataFrame:
    """Weighted sum of the query-wise mean ranks of several scores."""
    total = F.lit(0.0)
    for col, w in weights.items():
        df = pct_rank(df, col, f"_p_{col}")
        total += w * F.col(f"_p_{col}")
    return df.withColumn(out, total).drop(*(f"_p_{c}" for c in weights))


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: candidates of each model, of both, and of either."""
    both = outer_union(a.select(*keys).withColumn("_a", F.lit(1)), b.select(*keys).withColumn("_b", F.lit(1)), keys)
    return both.agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.sum((F.col("_a").isNotNull() & F.col("_b").isNotNull()).cast("long")).alias("shared"), F.count("*").alias("either"))

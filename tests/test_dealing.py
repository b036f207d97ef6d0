"""Joins in tasks of a stated number of rows."""

from pyspark.sql import functions as F

from sparkloom.operators import heuristics as H
from sparkloom.operators import retrieval as R
from sparkloom.operators import stats as C
from sparkloom.operators.dealing import dealt_join


def test_common_keys_are_dealt_to_many_tasks(spark):
    left = spark.range(4000).select("id", F.when(F.col("id") < 3900, "common").otherwise(F.col("id").cast("string")).alias("key"))
    right = spark.createDataFrame([("common", i) for i in range(7)] + [("3950", 1), ("none", 2)], "key string, iid long")
    out = dealt_join(left, right, ["key"], 100)
    assert sorted(map(tuple, out.select("id", "iid").collect())) == sorted([(i, k) for i in range(3900) for k in range(7)] + [(3950, 1)])
    sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*")).collect()]
    assert len(sizes) > 20 and max(sizes) < 7 * 700


def test_no_rows(spark):
    left, right = spark.range(0).select("id", F.lit("a").alias("key")), spark.createDataFrame([("a", 1)], "key string, iid long")
    assert dealt_join(left, right, ["key"], 100).count() == 0


def test_warm_scores_are_exact(spark):
    """0.3 * 3 and 0.9 tie only if shares are summed as whole numbers, whatever their order."""
    rows = [(f"u{i}", ["a", "b"], "c") for i in range(3)] + [("v", ["d", "a"], "b")]
    h = spark.createDataFrame(rows, "uid string, raw array<string>, target string").withColumn("dedup", F.array_distinct("raw"))
    got = {(r.uid, r.iid): r.score for r in H.warm_scores(h, H.Weights(0.1, 0.3, 0.9, 0.3, 0.1)).collect()}
    # a: 3 histories with b, own once, occurs 4 times; c: target of b 3 times, occurs 3 times
    assert got["u0", "a"] == 1.4 and got["u0", "c"] == 3.0
    assert got["v", "b"] == (3 * 0.3 * 10 + 3 * 0.3 * 10 + 0.9 * 10 + 4) / 10


def test_order_of_sums_does_not_rank_items(spark):
    """The same three weights, summed in two orders, are no reason to place one item before another."""
    low, high = sorted([0.1 + 0.2 + 0.3, 0.3 + 0.2 + 0.1])
    assert low < high
    stats = spark.createDataFrame([("recent", "k", "a", low), ("recent", "k", "b", high)], "source string, key string, iid string, cnt double")
    assert [r.iid for r in C.top_n(stats, {"recent": 2}).orderBy("rank").collect()] == ["a", "b"]


def test_hits_of_a_user_move_once(spark):
    """Keys' lists meet at their user; adding up and ranking the items needs no exchange by user and item."""
    rows = [(f"u{i}", ["a", "b", "a"], "c", "x") for i in range(3)] + [("v", ["d", "a"], "b", "y")]
    h = spark.createDataFrame(rows, "uid string, raw array<string>, target string, cat string").withColumn("dedup", F.array_distinct("raw"))
    found = R.hits(h, C.build_stats(h, ["cat"]), ["cat"])
    got = {(r.uid, r.iid, r.source): (r.rank, r.weight) for r in found.collect()}
    assert got["v", "b", "global"] == (2, 0.8) and got["u0", "c", "last1"] == (1, 6.0)
    # a: twice and first from the end; b: once and second
    assert got["u1", "a", "history"] == (1, 7.0) and got["u1", "b", "history"] == (2, 7.0)
    plan = R.cut(R.fused(found), 100)._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("Generate posexplode(items")]
    assert "Window" in after and "Exchange" not in after

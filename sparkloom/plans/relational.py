"""Joins, set operations, profiling and experiment-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import runlog as N
from sparkloom.operators import splits as SP
from sparkloom.plans import fixtures as T
from sparkloom.plans.fixtures import HIST_SQL
from sparkloom.plans.registry import query
from sparkloom.sources import tables as A


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark, d):
    o = A.parquet(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return A.parquet(spark, d, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark, d):
    o = A.parquet(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return A.parquet(spark, d, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey", "left_anti")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def validated_join(spark, d):
    """Many-to-one joins that fail if a dimension's key repeats."""
    n = A.unique_keys(A.parquet(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])
    r = A.unique_keys(A.parquet(spark, d, "region").select("r_regionkey", "r_name"), ["r_regionkey"])
    c = A.parquet(spark, d, "customer").select("c_custkey", "c_nationkey")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("c_custkey", "n_name", "r_name")


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS n_supplied, b.n AS n_urgent FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) b ON a.k = b.k")
def full_outer_join(spark, d):
    a = A.parquet(spark, d, "lineitem").where("l_quantity > 49").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n_supplied"))
    b = A.parquet(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_urgent"))
    return A.unique_keys(a, ["k"]).join(A.unique_keys(b, ["k"]), "k", "full_outer")


SETS = HIST_SQL + ", h AS (SELECT DISTINCT item FROM hist), t AS (SELECT DISTINCT target AS item FROM tgt)"


@query("SELECT (SELECT count(*) FROM (SELECT item FROM h EXCEPT SELECT item FROM t)) AS only_history, (SELECT count(*) FROM (SELECT item FROM h INTERSECT SELECT item FROM t)) AS both_sets, (SELECT count(*) FROM (SELECT item FROM h UNION SELECT item FROM t)) AS either, (SELECT count(*) FROM (SELECT item FROM t EXCEPT SELECT item FROM h)) = 0 AS targets_known", SETS)
def set_operations(spark, d):
    x = T.h(spark, d)
    h, t = x.select(F.explode("raw").alias("item")).distinct(), x.select(F.col("target").alias("item")).distinct()
    mark = h.withColumn("h", F.lit(1)).join(t.withColumn("t", F.lit(1)), "item", "full_outer")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a, b = F.col("h").isNotNull(), F.col("t").isNotNull()
    return mark.agg(n(a & ~b).alias("only_history"), n(a & b).alias("both_sets"), F.count("*").alias("either"), (n(~a & b) == 0).alias("targets_known"))


@query("SELECT uid, first_item FROM (SELECT uid, item AS first_item FROM hist WHERE pos = 0)", HIST_SQL)
def first_in_group(spark, d):
    e = T.events(spark, d)
    n = e.groupBy("user_id").agg(F.count("*").alias("n"), F.min_by("item", F.struct("ts", "event_id")).alias("first_item"))
    return n.where("n > 1").select(F.col("user_id").cast("string").alias("uid"), "first_item")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, sum((value IS NULL)::INT)::BIGINT AS n_null, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY event_type")
def profile_report(spark, d):
    e = A.parquet(spark, d, "events").select("event_type", "user_id", "value")
    r = lambda c: F.round(c, 6)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.sum(F.col("value").isNull().cast("long")).alias("n_null"), r(F.avg("value")).alias("mean"), r(F.percentile("value", F.lit(0.5))).alias("median"), r(F.stddev_samp("value")).alias("std"), r(F.min("value")).alias("low"), r(F.max("value")).alias("high"))


@query("SELECT count(*) AS n_users, count(DISTINCT n) AS n_lengths, min(n) AS shortest, max(n) AS longest, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std FROM tgt", HIST_SQL)
def sequence_statistics(spark, d):
    n = T.h(spark, d).select(F.size("raw").cast("long").alias("n"))
    return n.agg(F.count("*").alias("n_users"), F.count_distinct("n").alias("n_lengths"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("std"))


@query("SELECT uid, " + ", ".join(f"coalesce(max(CASE WHEN n - 1 - pos = {i} THEN item END), '0') AS top{i + 1}" for i in range(10)) + " FROM hist GROUP BY uid", HIST_SQL)
def wide_list_sink(spark, d):
    h = T.h(spark, d).where(F.size("raw") > 0)
    return A.wide_lists(h.select("uid", F.reverse("raw").alias("items")))


@query("SELECT CAST(c_custkey AS VARCHAR) AS uid, coalesce(p, 'none') AS prediction FROM customer LEFT JOIN (SELECT uid, string_agg(item, ',' ORDER BY dpos) AS p FROM dd WHERE dpos < 10 GROUP BY uid) ON uid = CAST(c_custkey AS VARCHAR)", HIST_SQL)
def list_sink(spark, d):
    """A template's users with their lists, or the default list."""
    t = A.parquet(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("uid"))
    return A.list_sheet(t, T.h(spark, d).where(F.size("raw") > 0).select("uid", F.slice("dedup", 1, 10).alias("items")), ["none"])


LOG_SQL = """lg AS (SELECT o_orderpriority AS task_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY m) AS iteration, round(a / 1000, 4) AS score, CASE WHEN m % 7 = 0 THEN 'PIVOT' ELSE 'CONTINUE' END AS decision
  FROM (SELECT o_orderpriority, year(o_orderdate) * 12 + month(o_orderdate) AS m, avg(o_totalprice) AS a FROM orders GROUP BY 1, 2)),
bs AS (SELECT *, max(score) OVER (PARTITION BY task_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lg),
im AS (SELECT *, before IS NULL OR score > before AS improved FROM bs),
isl AS (SELECT *, sum(improved::INT) OVER (PARTITION BY task_id ORDER BY iteration) AS island FROM im),
st AS (SELECT *, row_number() OVER (PARTITION BY task_id, island ORDER BY iteration) - 1 AS stale, sum((decision = 'PIVOT')::INT) OVER (PARTITION BY task_id ORDER BY iteration) AS piv FROM isl)"""


def run_log(spark, d):
    """One record a priority and month: the mean order value as the metric."""
    from pyspark.sql import Window

    o = A.parquet(spark, d, "orders").select("o_orderpriority", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m"), "o_totalprice")
    g = o.groupBy(F.col("o_orderpriority").alias("task_id"), "m").agg(F.round(F.avg("o_totalprice") / 1000, 4).alias("a"))
    it = F.row_number().over(Window.partitionBy("task_id").orderBy("m")).cast("long")
    return g.select("task_id", it.alias("iteration"), F.create_map(F.lit("acc"), "a").alias("metrics"), F.when(F.col("m") % 7 == 0, "PIVOT").otherwise("CONTINUE").alias("decision"))


@query("SELECT task_id, iteration, score, greatest(score, coalesce(before, score)) AS best, improved FROM im", LOG_SQL)
def runlog_best(spark, d):
    return N.best_so_far(run_log(spark, d)).select("task_id", "iteration", "score", "best", "improved")


@query("SELECT task_id, arg_min(iteration, iteration) FILTER (WHERE score = mx) AS iteration, max(score) AS score FROM (SELECT *, max(score) OVER (PARTITION BY task_id) AS mx FROM lg) GROUP BY task_id", LOG_SQL)
def runlog_best_per_task(spark, d):
    return N.best_per_task(run_log(spark, d))


W3 = "OVER (PARTITION BY task_id ORDER BY iteration ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
WT = "OVER (PARTITION BY task_id ORDER BY iteration)"


@query(f"SELECT task_id, iteration, coalesce(round(m, 9) > round(lag(m) {WT}, 9), false) AS improving, c = 3 AND r < 5 AS plateau, coalesce(score < lag(score) {WT} AND lag(score) {WT} < lag(score, 2) {WT}, false) AS falling FROM (SELECT *, avg(score) {W3} AS m, count(*) {W3} AS c, max(score) {W3} - min(score) {W3} AS r FROM lg)", LOG_SQL)
def runlog_trend(spark, d):
    return N.trend(run_log(spark, d), flat=5.0).select("task_id", "iteration", "improving", "plateau", "falling")


@query("SELECT task_id, min(iteration) AS iteration, arg_min(rule, iteration) AS rule FROM (SELECT *, CASE WHEN decision = 'STOP' THEN 'stop' WHEN stale >= 6 THEN 'patience' WHEN piv >= 3 THEN 'pivots' WHEN iteration >= 20 THEN 'budget' END AS rule FROM st) WHERE rule IS NOT NULL GROUP BY task_id", LOG_SQL)
def runlog_stop(spark, d):
    return N.stops(run_log(spark, d), patience=6)


@query("SELECT task_id, iteration, CASE WHEN stale >= 3 THEN 'STOP' WHEN score >= 0.95 * coalesce(before, score) THEN 'CONTINUE' ELSE 'PIVOT' END AS verdict FROM st", LOG_SQL)
def runlog_decision(spark, d):
    return N.decided(run_log(spark, d)).select("task_id", "iteration", "verdict")


@query("SELECT task_id, CAST(to_json(list({'iteration': iteration, 'decision': decision, 'score': round(score, 6)} ORDER BY iteration)) AS VARCHAR) AS trajectory FROM lg GROUP BY task_id", LOG_SQL)
def runlog_export(spark, d):
    return N.exported(run_log(spark, d))


NEGATIVES = HIST_SQL + """,
vocab AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS idx FROM (SELECT DISTINCT item FROM seq)), sized AS (SELECT count(*) AS size FROM vocab),
lens AS (SELECT t.uid, t.target, coalesce(max(dn), 0) AS dn FROM tgt t LEFT JOIN dd ON t.uid = dd.uid GROUP BY t.uid, t.target),
places AS (SELECT uid, target, unnest(range(0, dn + 6)) AS j FROM lens),
draws AS (SELECT uid, target, j, CAST(concat('0x', substr(md5(uid || ':neg:' || CAST(j AS VARCHAR)), 1, 8)) AS BIGINT) % size AS idx FROM places, sized),
firsts AS (SELECT d.uid, v.item, min(j) AS j FROM draws d JOIN vocab v ON d.idx = v.idx LEFT JOIN dd s ON s.uid = d.uid AND s.item = v.item WHERE s.uid IS NULL AND v.item <> d.target GROUP BY d.uid, v.item)"""


@query("SELECT uid, item AS iid FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY j) AS r FROM firsts) WHERE r <= 3", NEGATIVES)
def sampled_negatives(spark, d):
    return SP.negatives(T.h(spark, d), T.items(spark, d).select("iid"))


@query("SELECT count(*) AS n_rows, CAST(sum(CAST(concat('0x', substr(sha256(concat_ws('|', o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT))), 1, 15)) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM orders")
def table_fingerprint(spark, d):
    return A.fingerprint(A.parquet(spark, d, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")))

"""The logical tables over the driver's parquet tables, in Spark and as SQL that queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators.sequences import histories
from sparkloom.sources.tables import parquet

CATS = [f"u_cat_0{i}" for i in range(1, 7)]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parquet(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    return e.withColumn("item", F.concat("event_type", F.lit("#"), F.get_json_object("props", "$.k")))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = parquet(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = parquet(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    o = parquet(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    out = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(o, "c_custkey", "left")
    bal = F.when(F.col("c_acctbal") < 0, "neg").when(F.col("c_acctbal") < 5000, "low").otherwise("high")
    orders = F.least(F.expr("coalesce(n_orders, 0) div 5"), F.lit(4)).cast("string")
    return out.select(F.col("c_custkey").cast("string").alias("uid"), F.col("c_mktsegment").alias("u_cat_01"), F.col("n_regionkey").cast("string").alias("u_cat_02"), F.col("c_nationkey").cast("string").alias("u_cat_03"), bal.alias("u_cat_04"), orders.alias("u_cat_05"), (F.col("c_custkey") % 7).cast("string").alias("u_cat_06"))


def h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, raw, dedup, target) of all users."""
    return histories(events(spark, sf_dir), "user_id", "item", ["ts", "event_id"])


def hu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories with the users' categories."""
    out = h(spark, sf_dir).join(users(spark, sf_dir), "uid", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("__NA__")) for c in CATS})


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(iid, i_cat_01, i_cat_02, i_cat_03, i_bucket_01)."""
    e = events(spark, sf_dir).select("item", "event_type").distinct()
    kinds = e.select("event_type").distinct().withColumn("i_cat_01", F.row_number().over(Window.orderBy("event_type")).cast("long"))  # five kinds
    k = F.split("item", "#")[1].cast("long")
    return e.join(F.broadcast(kinds), "event_type").select(F.col("item").alias("iid"), "i_cat_01", F.floor(k / 10).alias("i_cat_02"), (k % 10).alias("i_cat_03"), F.floor(k / 25).alias("i_bucket_01"))


HIST_SQL = """
seq AS (SELECT CAST(user_id AS VARCHAR) AS uid, event_type || '#' || json_extract_string(props, '$.k') AS item,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) - 1 AS n FROM events),
hist AS (SELECT uid, item, pos, n FROM seq WHERE pos < n),
tgt AS (SELECT uid, item AS target, n FROM seq WHERE pos = n),
dd AS (SELECT uid, item, row_number() OVER (PARTITION BY uid ORDER BY min(pos)) - 1 AS dpos, count(*) OVER (PARTITION BY uid) AS dn FROM hist GROUP BY uid, item),
suf AS (SELECT uid, k, string_agg(item, '|' ORDER BY dpos) AS key FROM dd, (VALUES (1), (2), (3)) t(k) WHERE dpos >= dn - k AND dn >= k GROUP BY uid, k),
bucket AS (SELECT uid, target, CASE WHEN n <= 2 THEN CAST(n AS VARCHAR) WHEN n <= 4 THEN '3-4' WHEN n <= 7 THEN '5-7' WHEN n <= 15 THEN '8-15'
  WHEN n <= 30 THEN '16-30' ELSE '31+' END AS bucket, n FROM tgt)"""

USER_SQL = """,
uc AS (SELECT t.uid, target, coalesce(c_mktsegment, '__NA__') AS u_cat_01, coalesce(CAST(n_regionkey AS VARCHAR), '__NA__') AS u_cat_02,
  coalesce(CAST(c_nationkey AS VARCHAR), '__NA__') AS u_cat_03, CASE WHEN c_custkey IS NULL THEN '__NA__' WHEN c_acctbal < 0 THEN 'neg' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS u_cat_04,
  CASE WHEN c_custkey IS NULL THEN '__NA__' ELSE CAST(least(coalesce(n_orders, 0) // 5, 4) AS VARCHAR) END AS u_cat_05, coalesce(CAST(c_custkey % 7 AS VARCHAR), '__NA__') AS u_cat_06
  FROM tgt t LEFT JOIN customer ON t.uid = CAST(c_custkey AS VARCHAR) LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) o ON o_custkey = c_custkey),
ukeys AS (""" + " UNION ALL ".join(
    [f"SELECT uid, target, 'segment' AS source, '{c}=' || {c} AS key FROM uc" for c in CATS]
    + [f"SELECT uid, target, 'pair', '{a}=' || {a} || '&{b}=' || {b} FROM uc" for i, a in enumerate(CATS) for b in CATS[i + 1 :]]
    + [f"SELECT uid, target, '{s}', concat_ws('|', {', '.join(CATS[:n])}) FROM uc" for s, n in (("profile", 6), ("group_fine", 4), ("group_mid", 2), ("group_coarse", 1))]
) + ")"

STATS_SQL = USER_SQL + """,
rec AS (SELECT d.uid, target, dn - 1 - dpos AS d, item FROM dd d JOIN tgt USING (uid) WHERE dn - 1 - dpos < 6),
nxt AS (SELECT uid, item AS a, lead(item) OVER (PARTITION BY uid ORDER BY pos) AS b, lead(item, 2) OVER (PARTITION BY uid ORDER BY pos) AS c FROM hist),
stats AS (SELECT 'global' AS source, '' AS key, target AS iid, count(*)::DOUBLE AS cnt FROM tgt GROUP BY target
  UNION ALL SELECT 'last' || k, key, target, count(*) FROM suf JOIN tgt USING (uid) GROUP BY k, key, target
  UNION ALL SELECT 'recent', item, target, sum(pow(0.82, d)) FROM rec GROUP BY item, target
  UNION ALL SELECT 'transition', a, b, count(*) FROM nxt WHERE b IS NOT NULL GROUP BY a, b
  UNION ALL SELECT source, key, target, count(*) FROM ukeys GROUP BY source, key, target
  UNION ALL SELECT 'length', bucket, target, count(*) FROM bucket GROUP BY bucket, target),
totals AS (SELECT source, key, sum(cnt) AS total FROM stats GROUP BY source, key)"""

PAIR_SQL = """,
occ AS (SELECT item, count(*) AS occ FROM dd GROUP BY item),
co AS (SELECT x.item AS a, y.item AS b, count(*) AS cooc FROM dd x JOIN dd y ON x.uid = y.uid AND x.item < y.item GROUP BY 1, 2),
pairs AS (SELECT a, b, cooc, p.occ AS occ_a, q.occ AS occ_b, (SELECT count(*) FROM tgt) AS nu FROM co JOIN occ p ON a = p.item JOIN occ q ON b = q.item)"""

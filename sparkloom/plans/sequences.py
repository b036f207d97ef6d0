"""Sequence and count queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import scalars as X
from sparkloom.operators import sequences as S
from sparkloom.operators import stats as C
from sparkloom.plans import fixtures as T
from sparkloom.plans.fixtures import HIST_SQL, PAIR_SQL, STATS_SQL
from sparkloom.plans.registry import query

FULL = HIST_SQL + STATS_SQL


@query("SELECT h.uid, any_value(h.n)::BIGINT AS n_raw, any_value(dn)::BIGINT AS n_dedup, string_agg(DISTINCT raw_csv) AS raw_csv, any_value(dedup_csv) AS dedup_csv, any_value(target) AS target FROM (SELECT uid, any_value(n) AS n, string_agg(item, ',' ORDER BY pos) AS raw_csv FROM hist GROUP BY uid) h JOIN (SELECT uid, any_value(dn) AS dn, string_agg(item, ',' ORDER BY dpos) AS dedup_csv FROM dd GROUP BY uid) d ON h.uid = d.uid JOIN tgt ON h.uid = tgt.uid GROUP BY h.uid", HIST_SQL)
def seq_histories(spark, d):
    return T.h(spark, d).where(F.size("raw") > 0).select("uid", F.size("raw").cast("long").alias("n_raw"), F.size("dedup").cast("long").alias("n_dedup"), F.concat_ws(",", "raw").alias("raw_csv"), F.concat_ws(",", "dedup").alias("dedup_csv"), "target")


@query("SELECT uid, k::BIGINT AS k, key FROM suf", HIST_SQL)
def seq_suffix_keys(spark, d):
    keys = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), S.suffix(F.col("dedup"), k).alias("key")) for k in (1, 2, 3)))
    return T.h(spark, d).select("uid", F.explode(keys).alias("s")).select("uid", "s.*").where("key is not null")


@query("SELECT bucket, count(*) AS n_users, sum(n)::BIGINT AS n_items FROM bucket GROUP BY bucket", HIST_SQL)
def length_buckets(spark, d):
    return S.with_bucket(T.h(spark, d)).groupBy("bucket").agg(F.count("*").alias("n_users"), F.sum(F.size("raw")).alias("n_items"))


@query("SELECT s_suppkey, CASE k WHEN 0 THEN n || '.0' WHEN 1 THEN '  ' || s_name || ' ' WHEN 2 THEN 'nan' WHEN 3 THEN '' WHEN 4 THEN ' NaN' ELSE n END AS raw, CASE k WHEN 1 THEN trim(s_name) WHEN 0 THEN n WHEN 5 THEN n ELSE '' END AS id, CASE k WHEN 0 THEN n || '.0' WHEN 1 THEN trim(s_name) WHEN 5 THEN n ELSE '__NA__' END AS scalar FROM (SELECT *, s_suppkey % 6 AS k, s_nationkey::VARCHAR AS n FROM supplier)")
def clean_values(spark, d):
    """Suppliers' nations and names as a careless file has them: whole numbers with a fraction, blanks, nan, nothing."""
    s, n = T.parquet(spark, d, "supplier"), F.col("s_nationkey").cast("string")
    raw = F.when(F.col("k") == 0, F.concat(n, F.lit(".0"))).when(F.col("k") == 1, F.concat(F.lit("  "), "s_name", F.lit(" "))).when(F.col("k") == 2, "nan").when(F.col("k") == 3, "").when(F.col("k") == 4, " NaN").otherwise(n)
    rows, c = s.withColumn("k", F.col("s_suppkey") % 6).withColumn("raw", raw), F.col("raw")
    return rows.select("s_suppkey", "raw", X.clean_id(c, numeric=True).alias("id"), X.clean_scalar(c).alias("scalar"))


@query("SELECT uid, repeat('0,', 64 - len(x)) || list_aggregate(list_transform(x, lambda v: CAST(v AS VARCHAR)), 'string_agg', ',') AS padded FROM (SELECT uid, list(idx ORDER BY pos) AS x FROM (SELECT uid, pos, n, dense_rank() OVER (ORDER BY item) AS idx FROM hist) WHERE pos >= n - 64 GROUP BY uid)", HIST_SQL)
def padded_ids(spark, d):
    """Dictionary-encoded histories, the last 64 ids, zeros before those of shorter ones."""
    steps = T.h(spark, d).select("uid", F.posexplode("raw").alias("pos", "item"))
    ids = steps.join(S.vocabulary(steps, "item"), "item").groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx"))), lambda s: s["idx"]).alias("ids"))
    return ids.select("uid", F.array_join(X.left_padded(F.col("ids"), 64).cast("array<string>"), ",").alias("padded"))


@query("SELECT l_orderkey, l_linenumber, regexp_replace(CAST(l_quantity AS VARCHAR), '\\.0+$', '') AS quantity_id, CASE WHEN l_returnflag = 'N' THEN '__NA__' ELSE l_returnflag END AS flag FROM lineitem")
def clean_columns(spark, d):
    """Whole numbers of a numeric column as ids, and a category in which N is blank, so missing."""
    r = T.parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.concat(F.lit(" "), F.translate("l_returnflag", "N", " "), F.lit(" ")).alias("f"))
    return r.select("l_orderkey", "l_linenumber", X.clean_id(F.col("l_quantity"), numeric=True).alias("quantity_id"), X.clean_scalar(F.col("f")).alias("flag"))


def _counts(source: str, name: str, where: str = ""):
    extra = f" AND {where}" if where else ""

    def run(spark, d):
        stats = C.build_stats(T.hu(spark, d), T.CATS).where(F.col("source") == source)
        return stats.select("key", "iid", F.round("cnt", 6).alias("cnt"))

    run.__name__ = name
    return query(f"SELECT key, iid, round(cnt, 6) AS cnt FROM stats WHERE source = '{source}'{extra}", FULL)(run)


last1_to_target = _counts("last1", "last1_to_target")
last2_to_target = _counts("last2", "last2_to_target")
last3_to_target = _counts("last3", "last3_to_target")
recent_decayed = _counts("recent", "recent_decayed")
bigram_transition = _counts("transition", "bigram_transition")
segment_counts = _counts("segment", "segment_counts")
segment_pair_grouping_sets = _counts("pair", "segment_pair_grouping_sets")
profile_counts = _counts("profile", "profile_counts")
length_bucket_counts = _counts("length", "length_bucket_counts")


@query("SELECT source, key, iid, cnt FROM stats WHERE source LIKE 'group%'", FULL)
def group_rollup_counts(spark, d):
    return C.category_counts(T.hu(spark, d), T.CATS).where(F.col("source").startswith("group")).select("source", "key", "iid", "cnt")


@query("SELECT target AS iid, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, target) AS rank FROM tgt GROUP BY target", HIST_SQL)
def target_counts(spark, d):
    from sparkloom.operators.ordering import numbered

    c = T.h(spark, d).groupBy(F.col("target").alias("iid")).agg(F.count("*").alias("cnt"))
    return numbered(c, [F.desc("cnt"), "iid"], "rank", 1)


@query("SELECT item AS iid, count(*) AS cnt, count(DISTINCT uid) AS n_users FROM hist GROUP BY item", HIST_SQL)
def history_item_counts(spark, d):
    return T.h(spark, d).select("uid", F.explode("raw").alias("iid")).groupBy("iid").agg(F.count("*").alias("cnt"), F.count_distinct("uid").alias("n_users"))


@query("SELECT a, b, c, count(*) AS cnt FROM nxt WHERE c IS NOT NULL GROUP BY a, b, c", FULL)
def trigram_transition(spark, d):
    return S.trigrams(T.h(spark, d)).groupBy("a", "b", "c").agg(F.count("*").alias("cnt"))


@query("SELECT a, b, cooc FROM co", HIST_SQL + PAIR_SQL)
def i2i_cooccurrence(spark, d):
    return C.cooccurrences(T.h(spark, d))


@query("SELECT a, b, round(cooc / (occ_a + occ_b - cooc), 6) AS jaccard FROM pairs", HIST_SQL + PAIR_SQL)
def i2i_jaccard(spark, d):
    return C.pair_stats(T.h(spark, d)).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("SELECT a, b, round(least(greatest(ln(cooc * nu / (occ_a * occ_b)), -10), 10), 6) AS pmi FROM pairs", HIST_SQL + PAIR_SQL)
def i2i_pmi(spark, d):
    return C.pair_stats(T.h(spark, d)).select("a", "b", F.round("pmi", 6).alias("pmi"))


@query("SELECT a, b, round(least(greatest(CASE WHEN cooc < nu THEN ln(cooc * nu / (occ_a * occ_b)) / -ln(cooc / nu) ELSE 1 END, -1), 1), 6) AS npmi, round(ln(1 + cooc), 6) AS log_support FROM pairs", HIST_SQL + PAIR_SQL)
def i2i_npmi(spark, d):
    return C.pair_stats(T.h(spark, d)).select("a", "b", F.round("npmi", 6).alias("npmi"), F.round("log_support", 6).alias("log_support"))


@query("SELECT x.item AS a, y.item AS b, count(*) AS cnt FROM hist x JOIN hist y ON x.uid = y.uid AND x.pos <> y.pos AND abs(x.pos - y.pos) <= 4 WHERE x.pos >= x.n - 80 AND y.pos >= y.n - 80 GROUP BY 1, 2", HIST_SQL)
def skipgram_pairs(spark, d):
    return S.skipgrams(T.h(spark, d)).groupBy("a", "b").agg(F.count("*").alias("cnt"))


@query("SELECT iid, round((coalesce(t, 0) + 0.5) / ((SELECT count(*) FROM tgt) + 0.5 * (SELECT count(DISTINCT target) FROM tgt)), 9) AS target_prior, round((coalesce(s, 0) + 0.5) / ((SELECT count(*) FROM hist) + 0.5 * (SELECT count(DISTINCT item) FROM hist)), 9) AS seq_prior FROM (SELECT item AS iid, count(*) AS s FROM hist GROUP BY 1) FULL JOIN (SELECT target AS iid, count(*) AS t FROM tgt GROUP BY 1) USING (iid)", HIST_SQL)
def smoothed_priors(spark, d):
    from sparkloom.operators.features import priors

    p = priors(T.h(spark, d))
    return p.select("iid", F.round("target_prior", 9).alias("target_prior"), F.round("seq_prior", 9).alias("seq_prior"))


@query("SELECT uid, least(CASE WHEN b < 3515 THEN 0 WHEN b < 4518 THEN 1 WHEN b < 8992 THEN 3 WHEN b < 9006 THEN 5 WHEN b < 9053 THEN 10 WHEN b < 9202 THEN 30 ELSE n END, n)::BIGINT AS n_kept FROM (SELECT uid, n, CAST(concat('0x', substr(md5(uid || ':testmix'), 1, 8)) AS BIGINT) % 10000 AS b FROM tgt)", HIST_SQL)
def truncated_views(spark, d):
    return S.shortened(T.h(spark, d)).select("uid", F.size("raw").cast("long").alias("n_kept"))


@query("SELECT uid, pos, item AS next FROM hist WHERE pos >= 1 AND pos >= n - 48", HIST_SQL)
def next_item_prefixes(spark, d):
    return S.prefixes(T.h(spark, d)).select("uid", "pos", "next")

"""Retrieval, feature, fusion, list and metric queries."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions.scalars import hash_bucket
from sparkloom.operators import features as FE
from sparkloom.operators import fusion as FU
from sparkloom.operators import heuristics as H
from sparkloom.operators import lists as L
from sparkloom.operators import retrieval as R
from sparkloom.operators import sequences as S
from sparkloom.operators import stats as C
from sparkloom.operators.graph import checkpointed
from sparkloom.operators.ordering import numbered, running_sum
from sparkloom.plans import fixtures as T
from sparkloom.plans.fixtures import HIST_SQL, PAIR_SQL, STATS_SQL
from sparkloom.plans.registry import query

FULL = HIST_SQL + STATS_SQL


def _when(values: dict, column: str = "source") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def _retrieval_sql(s: R.Sources) -> str:
    named = [k for k in s.weight if k not in ("history", "recent")]
    return f""",
topn AS (SELECT * FROM (SELECT source, key, iid, cnt, row_number() OVER (PARTITION BY source, key ORDER BY cnt DESC, iid) AS rank FROM stats) WHERE rank <= {_when(s.limit)}),
lookup AS (SELECT uid, source, key, {_when({k: s.weight[k] for k in named})}::DOUBLE AS weight FROM (
    SELECT uid, 'last' || k AS source, key FROM suf UNION ALL SELECT uid, 'transition', item FROM dd WHERE dpos = dn - 1
    UNION ALL SELECT uid, source, key FROM ukeys UNION ALL SELECT uid, 'length', bucket FROM bucket UNION ALL SELECT uid, 'global', '' FROM tgt) WHERE source IN ({", ".join(f"'{k}'" for k in named)})
  UNION ALL SELECT uid, 'recent', item, {s.weight["recent"]} * pow(0.82, d) FROM rec),
hscore AS (SELECT uid, item AS iid, 2 * ln(1 + count(*)) + sum(3.0 / (n - pos)) AS score FROM hist GROUP BY uid, item),
hits AS (SELECT uid, iid, source, weight, rank FROM lookup JOIN topn USING (source, key)
  UNION ALL SELECT * FROM (SELECT uid, iid, 'history', {s.weight["history"]}::DOUBLE, row_number() OVER (PARTITION BY uid ORDER BY round(score, 9) DESC, iid) AS rank FROM hscore) WHERE rank <= {s.history})"""


RETRIEVAL = _retrieval_sql(R.Sources())
FUSED = """,
rrf AS (SELECT uid, iid, sum(weight / (10.0 + rank)) AS rrf, count(*) AS source_count, min(rank) AS best_rank FROM hits GROUP BY uid, iid),
cands AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY round(rrf, 9) DESC, source_count DESC, best_rank, iid) AS pos FROM rrf) WHERE pos <= 100)"""
CANDS = FULL + RETRIEVAL + FUSED
LIMIT = 100


def candidates(spark, d, limit: int = LIMIT):
    h = checkpointed(T.hu(spark, d))
    return R.cut(R.fused(R.hits(h, C.build_stats(h, T.CATS), T.CATS)), limit)




@query("""SELECT uid, iid, pos, round(rrf, 6) AS rrf, (iid = target)::BIGINT AS label FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY round(rrf, 9) DESC, source_count DESC, best_rank, iid) AS pos FROM (
  SELECT uid, iid, sum(weight / (10.0 + rank)) AS rrf, count(*) AS source_count, min(rank) AS best_rank FROM hits WHERE source IN ('last1', 'transition', 'global') GROUP BY uid, iid)) JOIN tgt USING (uid) WHERE pos <= 10""", FULL + RETRIEVAL)
def top10_rrf_basic(spark, d):
    """Sequences, three sources, reciprocal-rank fusion, ten items a user and whether each is the target."""
    h = checkpointed(T.hu(spark, d))
    stats = C.build_stats(h, T.CATS, ("last1", "transition", "global"))
    found = R.hits(h, stats, T.CATS, R.Sources()).where(F.col("source").isin("last1", "transition", "global"))
    top = R.cut(R.fused(found), 10).join(h.select("uid", "target"), "uid")
    return top.select("uid", "iid", "pos", F.round("rrf", 6).alias("rrf"), (F.col("iid") == F.col("target")).cast("long").alias("label"))


@query("SELECT source, key, iid, round(cnt, 6) AS cnt, rank FROM topn", FULL + RETRIEVAL)
def source_topn(spark, d):
    top = C.top_n(C.build_stats(T.hu(spark, d), T.CATS), R.Sources().limit)
    return top.select("source", "key", "iid", F.round("cnt", 6).alias("cnt"), "rank")


@query("SELECT uid, iid, round(score, 6) AS score FROM hscore", FULL + RETRIEVAL)
def history_scores(spark, d):
    return R.history_scores(T.h(spark, d)).select("uid", "iid", F.round("score", 6).alias("score"))


@query("SELECT uid, iid, pos, round(rrf, 6) AS rrf, source_count, best_rank FROM cands", CANDS)
def rrf_candidates(spark, d):
    return candidates(spark, d).select("uid", "iid", "pos", F.round("rrf", 6).alias("rrf"), "source_count", "best_rank")


@query("""SELECT uid, iid, round(rrf, 6) AS rrf, source_count FROM (SELECT uid, hits.iid, sum(weight * CASE WHEN source = 'history' THEN 1 ELSE pow(ln(3) / ln(1 + coalesce(c, 0) + 2), 0.08) END / (10.0 + rank)) AS rrf, count(*) AS source_count
  FROM hits LEFT JOIN (SELECT target, count(*) AS c FROM tgt GROUP BY 1) t ON hits.iid = t.target GROUP BY 1, 2)""", FULL + _retrieval_sql(R.PENALISED))
def rrf_antipop(spark, d):
    h = T.hu(spark, d)
    found = R.hits(h, C.build_stats(h, T.CATS), T.CATS, R.PENALISED)
    counts = h.groupBy(F.col("target").alias("iid")).agg(F.count("*").alias("cnt"))
    return R.fused(R.penalised(found, counts)).select("uid", "iid", F.round("rrf", 6).alias("rrf"), "source_count")


@query("SELECT k::BIGINT AS k, count(*) AS n_users, round(avg((pos <= k AND pos IS NOT NULL)::INT), 6) AS recall FROM (VALUES (10), (55), (100)) v(k), tgt LEFT JOIN cands ON tgt.uid = cands.uid AND iid = target GROUP BY k", CANDS)
def candidate_recall(spark, d):
    h = T.h(spark, d).select("uid", F.col("target").alias("iid"))
    hit = h.join(candidates(spark, d).select("uid", "iid", "pos"), ["uid", "iid"], "left")
    ks = F.explode(F.array(*(F.lit(k).cast("long") for k in (10, 55, 100)))).alias("k")
    return hit.select("pos", ks).groupBy("k").agg(F.count("*").alias("n_users"), F.round(F.avg(F.coalesce(F.col("pos") <= F.col("k"), F.lit(False)).cast("double")), 6).alias("recall"))


@query("""SELECT c.uid, iid, pos, (iid = target)::BIGINT AS label, r::BIGINT AS positive_retrieved FROM cands c JOIN tgt USING (uid) JOIN has USING (uid) WHERE r = 1 OR pos < 100
  UNION ALL SELECT uid, target, least(m + 1, 100), 1, 0 FROM tgt JOIN has USING (uid) JOIN (SELECT uid, max(pos) AS m FROM cands GROUP BY 1) USING (uid) WHERE r = 0""", CANDS + ", has AS (SELECT tgt.uid, max((iid IS NOT NULL)::INT) AS r FROM tgt LEFT JOIN cands ON tgt.uid = cands.uid AND iid = target GROUP BY 1)")
def forced_positive(spark, d):
    return R.forced_positive(candidates(spark, d), T.h(spark, d).select("uid", "target"), LIMIT)


def _warm_sql(w: H.Weights) -> str:
    return f""",
lastd AS (SELECT uid, item AS a FROM dd WHERE dpos = dn - 1),
l2t AS (SELECT a, target AS iid, count(*) AS c FROM lastd JOIN tgt USING (uid) GROUP BY 1, 2),
pop AS (SELECT item AS iid, count(*) AS c FROM seq GROUP BY 1),
links AS (SELECT uid, b AS iid, {w.transition} * c AS s, 0 AS t, 0 AS o FROM lastd JOIN (SELECT a, b, count(*) AS c FROM nxt WHERE b IS NOT NULL GROUP BY 1, 2) USING (a)
  UNION ALL SELECT uid, iid, {w.last} * c, 1, 0 FROM lastd JOIN l2t USING (a)
  UNION ALL SELECT uid, b, {w.cooccurrence} * cooc, 0, 0 FROM (SELECT uid, item AS a FROM dd WHERE dpos >= dn - 3) JOIN (SELECT a, b, cooc FROM co UNION ALL SELECT b, a, cooc FROM co) USING (a)
  UNION ALL SELECT uid, item, {w.own} * count(*), 0, 1 FROM hist GROUP BY uid, item),
warm AS (SELECT uid, p.iid, round((coalesce(s, 0) + {w.popularity} * c) * CASE WHEN t = 1 THEN {w.boost} * CASE WHEN o = 1 THEN {w.boost_seen} ELSE 1 END ELSE 1 END, 9) AS score
  FROM (SELECT DISTINCT uid FROM dd) CROSS JOIN pop p LEFT JOIN (SELECT uid, iid, sum(s) AS s, max(t) AS t, max(o) AS o FROM links GROUP BY uid, iid) l USING (uid, iid)),
best AS (SELECT * FROM (SELECT uid, iid, score, row_number() OVER (PARTITION BY uid ORDER BY score DESC, iid) AS pos FROM warm) WHERE pos <= 10)"""


def _warm(name: str, w: H.Weights):
    def run(spark, d):
        return H.warm(T.h(spark, d), w).select("uid", "iid", "pos", F.round("score", 4).alias("score"))

    run.__name__ = name
    return query("SELECT uid, iid, pos, round(score, 4)::DOUBLE AS score FROM best", FULL + PAIR_SQL + _warm_sql(w))(run)


heur_warm_v4 = _warm("heur_warm_v4", H.V4)
heur_warm_v6 = _warm("heur_warm_v6", H.V6)
heur_warm_final = _warm("heur_warm_final", H.FINAL)
heur_warm_ndcg = _warm("heur_warm_ndcg", H.NDCG)

SIM_SQL = f""",
sims AS (SELECT * FROM (SELECT x.uid, y.uid AS other, sim, row_number() OVER (PARTITION BY x.uid ORDER BY sim DESC, y.uid) AS r FROM (SELECT x.uid AS u1, y.uid AS u2, ({" + ".join(f"(x.{c} = y.{c})::INT" for c in T.CATS)}) / 6 AS sim FROM uc x JOIN uc y ON x.uid <> y.uid) z
  JOIN uc x ON x.uid = u1 JOIN uc y ON y.uid = u2 WHERE sim > 0) WHERE r <= 20),
coldscore AS (SELECT s.uid, t.target AS iid, sum(sim) AS s FROM sims s JOIN tgt t ON s.other = t.uid GROUP BY 1, 2)"""


@query("SELECT uid, iid, round(s, 6) AS score FROM coldscore", FULL + SIM_SQL)
def cold_cosine(spark, d):
    h = checkpointed(T.hu(spark, d))
    sims = H.similar_users(h.select("uid", *T.CATS), T.CATS)
    return sims.join(h.select(F.col("uid").alias("other"), F.col("target").alias("iid")), "other").groupBy("uid", "iid").agg(F.round(F.sum("sim"), 6).alias("score"))


@query("SELECT CASE WHEN n < 60 THEN 'cold' ELSE 'warm' END AS route, count(*) AS n_users FROM tgt GROUP BY 1", HIST_SQL)
def hybrid_route(spark, d):
    return T.h(spark, d).select(F.when(F.size("raw") < 60, "cold").otherwise("warm").alias("route")).groupBy("route").agg(F.count("*").alias("n_users"))


# Features of all candidates of each user.
ALPHA_SQL = _when({k: v for k, v in FE.ALPHA.items()})
COND_SQL = CANDS + f""",
tp AS (SELECT target AS iid, count(*) AS t FROM tgt GROUP BY 1), sp AS (SELECT item AS iid, count(*) AS s FROM hist GROUP BY 1),
pri AS (SELECT iid, (coalesce(t, 0) + 0.5) / ((SELECT sum(t) FROM tp) + 0.5 * (SELECT count(*) FROM tp)) AS tprior, (coalesce(s, 0) + 0.5) / ((SELECT sum(s) FROM sp) + 0.5 * (SELECT count(*) FROM sp)) AS sprior FROM tp FULL JOIN sp USING (iid)),
cond AS (SELECT *, ln((prob + 1e-12) / (prior + 1e-12)) AS lift FROM (SELECT *, (cnt + alpha * prior) / (total + alpha) AS prob FROM (
  SELECT l.uid, c.iid, l.source, l.key, l.weight, coalesce(s.cnt, 0) AS cnt, coalesce(t.total, 0) AS total, CASE WHEN l.source = 'transition' THEN sprior ELSE tprior END AS prior, {ALPHA_SQL.replace("CASE source", "CASE l.source")} AS alpha
  FROM lookup l JOIN cands c ON l.uid = c.uid LEFT JOIN stats s ON s.source = l.source AND s.key = l.key AND s.iid = c.iid LEFT JOIN totals t ON t.source = l.source AND t.key = l.key LEFT JOIN pri ON pri.iid = c.iid)))"""

# Each of these is read several times: without MATERIALIZED DuckDB works them out anew for every reader.
COND_SQL = re.sub(r"\b(hist|tgt|stats|totals|lookup|cands|tp|sp|pri|cond) AS \(", r"\1 AS MATERIALIZED (", COND_SQL)


def conditional(spark, d, gathered: bool = True):
    h = checkpointed(T.hu(spark, d))
    stats = checkpointed(C.build_stats(h, T.CATS))
    top = R.cut(R.fused(R.hits(h, stats, T.CATS)), LIMIT).select("uid", "iid")
    return FE.looked_up(R.user_keys(h, T.CATS), top, stats, C.totals(stats), FE.priors(h), gathered)


@query("SELECT uid, iid, source, key, round(cnt, 6) AS cnt, round(total, 6) AS total, round(prob, 6) AS prob, round(lift, 6) AS lift FROM cond", COND_SQL)
def cond_features(spark, d):
    return conditional(spark, d, gathered=False).select("uid", "iid", "source", "key", *(F.round(c, 6).alias(c) for c in ("cnt", "total", "prob", "lift")))


@query("SELECT uid, iid, round(sum(weight / 4.0 * prob), 6) AS recent_prob_sum, round(max(weight / 4.0 * prob), 6) AS recent_prob_max, round(sum(weight / 4.0 * lift), 6) AS recent_lift_sum, round(max(lift), 6) AS recent_lift_max, sum((cnt > 0)::INT)::BIGINT AS recent_hits FROM cond WHERE source = 'recent' GROUP BY uid, iid", COND_SQL)
def recent_aggregates(spark, d):
    c = conditional(spark, d).where("source = 'recent'").withColumn("w", F.col("weight") / 4.0)
    return c.groupBy("uid", "iid").agg(F.round(F.sum(F.col("w") * F.col("prob")), 6).alias("recent_prob_sum"), F.round(F.max(F.col("w") * F.col("prob")), 6).alias("recent_prob_max"), F.round(F.sum(F.col("w") * F.col("lift")), 6).alias("recent_lift_sum"), F.round(F.max("lift"), 6).alias("recent_lift_max"), F.sum((F.col("cnt") > 0).cast("long")).alias("recent_hits"))


@query("SELECT uid, iid, source, round(max(prob), 6) AS prob_max, round(avg(prob), 6) AS prob_mean, round(max(lift), 6) AS lift_max, round(avg(lift), 6) AS lift_mean, round(sum(cnt), 6) AS cnt_sum FROM cond WHERE source IN ('segment', 'pair') GROUP BY uid, iid, source", COND_SQL)
def segment_aggregates(spark, d):
    c = conditional(spark, d).where(F.col("source").isin("segment", "pair"))
    return c.groupBy("uid", "iid", "source").agg(F.round(F.max("prob"), 6).alias("prob_max"), F.round(F.avg("prob"), 6).alias("prob_mean"), F.round(F.max("lift"), 6).alias("lift_max"), F.round(F.avg("lift"), 6).alias("lift_mean"), F.round(F.sum("cnt"), 6).alias("cnt_sum"))


WIDE = ("last1", "last2", "last3", "transition", "profile", "group_fine", "group_mid", "group_coarse", "length")


@query("SELECT uid, iid, " + ", ".join(f"round(max(CASE WHEN source = '{s}' THEN {e} END), 6) AS {s}_{n}" for s in WIDE for n, e in (("log_cnt", "ln(1 + cnt)"), ("log_total", "ln(1 + total)"), ("prob", "prob"), ("lift", "lift"), ("mle", "cnt / (total + 1e-12)"))) + " FROM cond GROUP BY uid, iid", COND_SQL)
def pair_features_wide(spark, d):
    w = FE.widened(conditional(spark, d), WIDE)
    return w.select("uid", "iid", *(F.round(c, 6).alias(c) for c in w.columns[2:]))


KINDS = {"suffix": "'last1','last2','last3'", "recent": "'recent'", "transition": "'transition'", "profile": "'profile'", "segment": "'segment'", "pair": "'pair'", "group": "'group_fine','group_mid','group_coarse'", "length": "'length'"}


@query("SELECT *, (" + " + ".join(f"hit_{k}" for k in KINDS) + ")::BIGINT AS n_hits FROM (SELECT uid, iid, " + ", ".join(f"max(CASE WHEN source IN ({v}) AND cnt > 0 THEN 1 ELSE 0 END)::BIGINT AS hit_{k}, round(sum(CASE WHEN source IN ({v}) THEN ln(1 + cnt) ELSE 0 END), 6) AS strength_{k}" for k, v in KINDS.items()) + " FROM cond GROUP BY uid, iid)", COND_SQL)
def source_hits(spark, d):
    s = FE.source_hits(conditional(spark, d))
    return s.select(*(F.round(c, 6).alias(c) if c.startswith("strength") else c for c in s.columns))


@query("""SELECT c.uid, c.iid, round(max(j), 6) AS jac_max, round(sum(j), 6) AS jac_sum, round(avg(j), 6) AS jac_mean, round(avg((j > 0)::INT), 6) AS jac_pos FROM cands c JOIN dd ON c.uid = dd.uid AND dpos >= dn - 10
  LEFT JOIN LATERAL (SELECT 1) ON true LEFT JOIN (SELECT a, b, cooc / (occ_a + occ_b - cooc) AS jj FROM pairs) p ON p.a = least(c.iid, dd.item) AND p.b = greatest(c.iid, dd.item) CROSS JOIN LATERAL (SELECT CASE WHEN c.iid = dd.item THEN 1 ELSE coalesce(jj, 0) END AS j) z GROUP BY 1, 2""".replace("LEFT JOIN LATERAL (SELECT 1) ON true ", ""), CANDS + PAIR_SQL)
def i2i_aggregates(spark, d):
    """Similarity of each candidate to the user's last ten new items."""
    h = T.h(spark, d)
    last = h.select("uid", F.explode(F.slice("dedup", F.greatest(F.size("dedup") - 10, F.lit(0)) + 1, 10)).alias("item"))
    both = candidates(spark, d).select("uid", "iid").join(last, "uid").withColumns({"a": F.least("iid", "item"), "b": F.greatest("iid", "item")})
    both = both.join(C.pair_stats(h).select("a", "b", "jaccard"), ["a", "b"], "left").withColumn("j", F.when(F.col("iid") == F.col("item"), 1.0).otherwise(F.coalesce("jaccard", F.lit(0.0))))
    return both.groupBy("uid", "iid").agg(F.round(F.max("j"), 6).alias("jac_max"), F.round(F.sum("j"), 6).alias("jac_sum"), F.round(F.avg("j"), 6).alias("jac_mean"), F.round(F.avg((F.col("j") > 0).cast("double")), 6).alias("jac_pos"))


# Scores of two models over the candidates: rrf, and a value of the pair's hash that a tenth of the pairs lacks.
SCORES_SQL = CANDS + """,
scores AS (SELECT uid AS qid, iid, round(rrf, 9) AS s1, CASE WHEN b % 10 = 0 THEN NULL ELSE (b % 1000) / 1000 END AS s2, (iid = target)::BIGINT AS label
  FROM (SELECT *, CAST(concat('0x', substr(md5(uid || ':' || iid), 1, 8)) AS BIGINT) % 100000 AS b FROM cands) JOIN tgt USING (uid))"""


def scores(spark, d):
    c = candidates(spark, d).join(T.h(spark, d).select("uid", "target"), "uid")
    b = hash_bucket(F.concat("uid", F.lit(":"), "iid"), 100_000)
    return c.select(F.col("uid").alias("qid"), "iid", F.round("rrf", 9).alias("s1"), F.when(b % 10 == 0, None).otherwise((b % 1000) / 1000).alias("s2"), (F.col("iid") == F.col("target")).cast("long").alias("label"))


@query("SELECT qid, iid, round(CASE WHEN s2 IS NULL THEN 0.5 ELSE (r + (t - 1) / 2) / n END, 6) AS p FROM (SELECT *, rank() OVER (PARTITION BY qid ORDER BY s2 NULLS LAST) AS r, count(s2) OVER (PARTITION BY qid, s2) AS t, count(s2) OVER (PARTITION BY qid) AS n FROM scores)", SCORES_SQL)
def query_pct_rank(spark, d):
    return FU.pct_rank(scores(spark, d), "s2", "p").select("qid", "iid", F.round("p", 6).alias("p"))


RANKF = "CASE WHEN {0} IS NULL THEN 0 ELSE (count({0}) OVER (PARTITION BY qid) - row_number() OVER (PARTITION BY qid ORDER BY {0} DESC NULLS LAST, iid)) / greatest(count({0}) OVER (PARTITION BY qid) - 1, 1) END"
ZS = "({0} - avg({0}) OVER (PARTITION BY qid)) / greatest(coalesce(stddev_samp({0}) OVER (PARTITION BY qid), 0), 1e-6)"


@query(f"SELECT qid, iid, round({RANKF.format('s2')}, 6) AS r FROM scores", SCORES_SQL)
def query_rank_first(spark, d):
    return FU.rank_first(scores(spark, d), "s2", "r").select("qid", "iid", F.round("r", 6).alias("r"))


@query(f"SELECT qid, iid, round({ZS.format('s1')}, 6) AS z FROM scores", SCORES_SQL)
def query_zscore(spark, d):
    return FU.zscore(scores(spark, d), "s1", "z").select("qid", "iid", F.round("z", 6).alias("z"))


@query(f"SELECT qid, iid, round(coalesce(z, coalesce(min(z) OVER (PARTITION BY qid), -1) - 0.5), 6) AS z FROM (SELECT qid, iid, {ZS.format('s2')} AS z FROM scores)", SCORES_SQL)
def zscore_outer_fill(spark, d):
    a = scores(spark, d)
    both = FU.outer_union(a.select("qid", "iid", "s1"), a.where("s2 is not null").select("qid", "iid", "s2"), ["qid", "iid"])
    return FU.zscore(both, "s2", "z", fill=True).select("qid", "iid", F.round("z", 6).alias("z"))


BLEND_SQL = SCORES_SQL + f""",
norm AS (SELECT qid, iid, label, {RANKF.format('s1')} AS r1, {RANKF.format('s2')} AS r2 FROM scores),
grid AS (SELECT w, qid, label, row_number() OVER (PARTITION BY w, qid ORDER BY round((w * r1 + (10 - w) * r2) / 10.0, 9) DESC, iid) AS place FROM norm, range(0, 11) t(w))"""


@query("SELECT w::BIGINT AS w, round(sum(CASE WHEN label = 1 AND place <= 10 THEN 1 / log2(place + 1) ELSE 0 END) / count(DISTINCT qid), 6) AS ndcg, round(sum(CASE WHEN label = 1 AND place <= 10 THEN 1 ELSE 0 END) / count(DISTINCT qid), 6) AS hit FROM grid GROUP BY w", BLEND_SQL)
def blend_grid(spark, d):
    """Eleven blends of two models' query ranks and what each scores."""
    n = FU.rank_first(FU.rank_first(scores(spark, d), "s1", "r1"), "s2", "r2")
    rows = n.select("qid", "iid", "label", "r1", "r2", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("w"))
    rows = rows.withColumn("s", F.round((F.col("w") * F.col("r1") + (10 - F.col("w")) * F.col("r2")) / 10.0, 9))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("w", "qid").orderBy(F.desc("s"), "iid")))
    hit = (F.col("label") == 1) & (F.col("place") <= 10)
    out = rows.groupBy("w", "qid").agg(F.sum(F.when(hit, 1 / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("g"), F.sum(hit.cast("double")).alias("h")).groupBy("w")
    return out.agg(F.round(F.sum("g") / F.count("*"), 6).alias("ndcg"), F.round(F.sum("h") / F.count("*"), 6).alias("hit")).withColumn("w", F.col("w").cast("long"))


@query("SELECT count(*) AS n_queries, round(avg(CASE WHEN pos <= 10 THEN 1 / log2(pos + 1) ELSE 0 END), 6) AS ndcg, round(avg(CASE WHEN pos <= 10 THEN 1 ELSE 0 END), 6) AS hit, round(avg(CASE WHEN pos <= 10 THEN 1 / pos ELSE 0 END), 6) AS mrr FROM tgt LEFT JOIN cands ON tgt.uid = cands.uid AND iid = target", CANDS)
def ndcg_hit_mrr(spark, d):
    t = T.h(spark, d).select(F.col("uid").alias("qid"), "target")
    placed = candidates(spark, d).withColumnRenamed("uid", "qid").join(t, "qid").select("qid", F.col("pos").alias("place"), (F.col("iid") == F.col("target")).cast("int").alias("label"))
    return FU.metrics(placed, t).select("n_queries", *(F.round(c, 6).alias(c) for c in ("ndcg", "hit", "mrr")))


# Lists: the first ten candidates, the warm heuristic's, and all users' favourites.
LIST_SQL = FULL + PAIR_SQL + RETRIEVAL + FUSED + _warm_sql(H.V6) + """,
la AS (SELECT uid, iid, pos FROM cands WHERE pos <= 10), lb AS (SELECT uid, iid, pos FROM best),
popular AS (SELECT iid, row_number() OVER (ORDER BY c DESC, iid) AS g FROM pop ORDER BY c DESC, iid LIMIT 30),
seen AS (SELECT DISTINCT uid, item AS iid FROM hist),
grp AS (SELECT key, target AS iid, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, target) AS g FROM ukeys WHERE source = 'group_mid' GROUP BY key, target),
ug AS (SELECT u.uid, iid, g FROM ukeys u JOIN grp USING (key) WHERE u.source = 'group_mid')"""


def list_a(spark, d):
    return candidates(spark, d, 10).groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "iid"))), lambda s: s["iid"]).alias("items"))


def list_b(spark, d):
    return H.warm(T.h(spark, d), H.V6).groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "iid"))), lambda s: s["iid"]).alias("items"))


def with_context(spark, d, lists, cats: int = 2, most: int = 1000):
    """Lists with the user's history, the first ``most`` of the ranking of the group (users of the same first ``cats``
    categories), and all users' ranking."""
    h = T.hu(spark, d)
    key = C.profile_key(T.CATS[:cats])
    grp = L.ranked(h.groupBy(key.alias("uid"), F.col("target").alias("iid")).agg(F.count("*").alias("c")), "c", most).select(F.col("uid").alias("key"), F.col("items").alias("grp"))
    top = H.popular(h).orderBy(F.desc("cnt"), "iid").limit(30).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("c"), "iid"))), lambda s: s["iid"]).alias("everyone"))
    return lists.join(h.select("uid", "dedup", key.alias("key")), "uid").join(grp, "key", "left").join(F.broadcast(top))


def _csv(df):
    return df.select("uid", F.concat_ws(",", "items").alias("items"))


def _ordered_sql(rows: str) -> str:
    """First place of each item among ``rows`` (uid, iid, band, p), the first ten."""
    return f"SELECT uid, string_agg(iid, ',' ORDER BY r) AS items FROM (SELECT uid, iid, row_number() OVER (PARTITION BY uid ORDER BY min(band * 10000 + p)) AS r FROM ({rows}) GROUP BY uid, iid) WHERE r <= 10 GROUP BY uid"


GLOB = "SELECT uid, iid, 9 AS band, g AS p FROM (SELECT DISTINCT uid FROM la) CROSS JOIN popular"


@query(_ordered_sql("SELECT uid, iid, 0 AS band, pos AS p FROM la a WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.uid = a.uid AND s.iid = a.iid) UNION ALL SELECT * FROM (" + GLOB + ") g WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.uid = g.uid AND s.iid = g.iid)"), LIST_SQL)
def fill_unique(spark, d):
    c = with_context(spark, d, list_a(spark, d))
    return _csv(c.withColumn("items", L.filled(L.without(F.col("items"), F.col("dedup")), L.without(F.col("everyone"), F.col("dedup")))))


FINE_SQL = """,
fine AS (SELECT u.uid, iid, g FROM ukeys u JOIN (SELECT key, target AS iid, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, target) AS g FROM ukeys WHERE source = 'group_fine' GROUP BY key, target) USING (key) WHERE u.source = 'group_fine')"""


@query(_ordered_sql("SELECT uid, iid, 0 AS band, pos AS p FROM (SELECT a.*, s.iid AS hit, sum((s.iid IS NOT NULL)::INT) OVER (PARTITION BY a.uid ORDER BY pos) AS n FROM la a LEFT JOIN seen s ON s.uid = a.uid AND s.iid = a.iid) WHERE hit IS NULL OR n <= 3 UNION ALL SELECT uid, iid, 1, g FROM fine UNION ALL " + GLOB), LIST_SQL + FINE_SQL)
def cap_history(spark, d):
    """Three items of the history at most, refilled by the user's group of four categories, then by all users' favourites.
    A list of ten takes no more than the first ten of its group."""
    c = with_context(spark, d, list_a(spark, d), cats=4, most=10)
    kept = L.history_capped(F.col("items"), F.col("dedup"), 3)
    return _csv(c.withColumn("items", L.filled(F.concat(kept, F.coalesce("grp", F.array().cast("array<string>"))), F.col("everyone"))))


@query(_ordered_sql("SELECT uid, iid, CASE WHEN hit IS NULL THEN CASE WHEN n <= 5 THEN 0 ELSE 2 END ELSE CASE WHEN n <= 3 THEN 1 ELSE 3 END END AS band, pos AS p FROM (SELECT a.*, s.iid AS hit, row_number() OVER (PARTITION BY a.uid, s.iid IS NULL ORDER BY pos) AS n FROM la a LEFT JOIN seen s ON s.uid = a.uid AND s.iid = a.iid) UNION ALL " + GLOB), LIST_SQL)
def balanced_cap(spark, d):
    c = with_context(spark, d, list_a(spark, d))
    return _csv(c.withColumn("items", L.filled(L.balanced(F.col("items"), F.col("dedup")), F.col("everyone"))))


@query(_ordered_sql("SELECT uid, iid, CASE WHEN n <= 62 THEN 10 ELSE 0 END AS band, pos AS p FROM la JOIN tgt USING (uid) UNION ALL SELECT uid, iid, 1, g FROM ug JOIN tgt USING (uid) WHERE n <= 62 UNION ALL " + GLOB), LIST_SQL)
def cold_fallback(spark, d):
    """Histories of up to 62 items count as short here, as the events hold no shorter ones."""
    c = with_context(spark, d, list_a(spark, d)).join(T.h(spark, d).select("uid", F.size("raw").alias("n")), "uid")
    return _csv(c.withColumn("items", L.filled(L.cold(F.col("items"), F.col("n"), F.col("grp"), F.col("everyone"), 62), F.col("everyone"))))


@query(_ordered_sql("SELECT uid, iid, CASE WHEN pos <= 5 THEN 0 ELSE 3 END AS band, pos AS p FROM la UNION ALL SELECT uid, iid, 1, g FROM ug WHERE g <= 5 UNION ALL SELECT uid, iid, 2, p FROM (" + GLOB + ") WHERE p <= 10 UNION ALL " + GLOB), LIST_SQL)
def group_rank_boost(spark, d):
    c = with_context(spark, d, list_a(spark, d))
    return _csv(c.withColumn("items", L.filled(L.boosted(F.col("items"), F.col("grp"), F.col("everyone")), F.col("everyone"))))


def _fuse_sql(score: str) -> str:
    return f"SELECT uid, string_agg(iid, ',' ORDER BY r) AS items FROM (SELECT uid, iid, row_number() OVER (PARTITION BY uid ORDER BY round(sum(w * {score}), 9) DESC, iid) AS r FROM (SELECT *, 1.0 AS w, 10 AS n FROM la UNION ALL SELECT *, 0.65, 10 FROM lb) GROUP BY uid, iid) WHERE r <= 10 GROUP BY uid"


def _fuse(name: str, sql: str, score):
    def run(spark, d):
        return _csv(L.fused([(list_a(spark, d), 1.0), (list_b(spark, d), 0.65)], score))

    run.__name__ = name
    return query(_fuse_sql(sql), LIST_SQL)(run)


list_fuse_recip = _fuse("list_fuse_recip", "1.0 / pos", L.RECIPROCAL)
list_fuse_linear = _fuse("list_fuse_linear", "(11.0 - pos) / 10", L.LINEAR)
list_fuse_percentile = _fuse("list_fuse_percentile", "(1 - (pos - 1) / (n - 1))", L.PERCENTILE)


@query("SELECT count(*) AS n_users, round(avg(o), 6) AS mean_overlap, round(avg(f), 6) AS same_first FROM (SELECT la.uid, count(lb.iid) AS o, max((la.pos = 1 AND lb.pos = 1)::INT) AS f FROM la LEFT JOIN lb ON la.uid = lb.uid AND la.iid = lb.iid GROUP BY la.uid)", LIST_SQL)
def list_overlap(spark, d):
    both = list_a(spark, d).join(list_b(spark, d).withColumnRenamed("items", "other"), "uid")
    return both.agg(F.count("*").alias("n_users"), F.round(F.avg(F.size(F.array_intersect("items", "other"))), 6).alias("mean_overlap"), F.round(F.avg((F.get("items", F.lit(0)) == F.get("other", F.lit(0))).cast("double")), 6).alias("same_first"))


def _greedy_sql(k: int) -> str:
    """Each step marks, for each user, the best of the items left."""
    out = ", t0 AS MATERIALIZED (SELECT uid, iid, pos, split_part(iid, '#', 1) AS cat, NULL::INT AS step FROM cands WHERE pos <= 20)"
    for i in range(k):
        out += f""", t{i + 1} AS MATERIALIZED (SELECT uid, iid, pos, cat, CASE WHEN step IS NULL AND r = 1 THEN {i + 1} ELSE step END AS step FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY step IS NOT NULL, round(place + 0.3 * used, 9), pos) AS r
  FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY step IS NOT NULL, pos) AS place, count(step) OVER (PARTITION BY uid, cat) AS used FROM t{i})))"""
    return out


@query("SELECT uid, string_agg(iid, ',' ORDER BY step) AS items FROM t10 WHERE step IS NOT NULL GROUP BY uid", CANDS + _greedy_sql(10))
def diversity_rerank(spark, d):
    """Users' first 20 candidates, ten of which are chosen."""
    lists = candidates(spark, d, 20).groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "iid"))), lambda s: s["iid"]).alias("items"))
    return _csv(L.diversified(lists, T.items(spark, d).select("iid", F.col("i_cat_01").alias("cat"))))


@query("SELECT s AS share, min(r) AS n_items FROM (SELECT row_number() OVER (ORDER BY c DESC, item) AS r, sum(c) OVER (ORDER BY c DESC, item) / sum(c) OVER () AS share FROM (SELECT item, count(*) AS c FROM hist GROUP BY 1)) x, (VALUES (0.5::DOUBLE), (0.8), (0.9)) v(s) WHERE share >= s GROUP BY s", HIST_SQL)
def long_tail_coverage(spark, d):
    """Items that make up 50, 80 and 90 percent of all interactions."""
    c = T.h(spark, d).select(F.explode("raw").alias("item")).groupBy("item").agg(F.count("*").alias("c"))
    total = F.broadcast(c.agg(F.sum("c").alias("total")))  # one row
    s = running_sum(c, [F.desc("c"), "item"], "c", "upto").select("item", "c", "upto")
    s = numbered(s, [F.desc("c"), "item"], "r", 1).join(total).select("r", (F.col("upto") / F.col("total")).alias("got"))
    return s.select("r", "got", F.explode(F.array(F.lit(0.5), F.lit(0.8), F.lit(0.9))).alias("share")).where("got >= share").groupBy("share").agg(F.min("r").alias("n_items"))


PCT = "(CASE WHEN {0} IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY qid ORDER BY {0} NULLS LAST) + (count({0}) OVER (PARTITION BY qid, {0}) - 1) / 2) / count({0}) OVER (PARTITION BY qid) END)"


@query(f"SELECT qid, iid, round(0.7 * {PCT.format('s1')} + 0.3 * {PCT.format("s2")}, 9) AS blend FROM scores", SCORES_SQL)
def blend_scores(spark, d):
    return FU.pct_blend(scores(spark, d), {"s1": 0.7, "s2": 0.3}).select("qid", "iid", F.round("blend", 9).alias("blend"))


@query("SELECT count(*) AS n_a, count(s2) AS n_b, count(s2) AS shared, count(*) AS either FROM scores", SCORES_SQL)
def candidate_overlap(spark, d):
    s = scores(spark, d)
    return FU.overlap(s, s.where("s2 is not null"), ["qid", "iid"])


@query("SELECT p.qid, p.iid AS pos, n.iid AS neg FROM scores p JOIN (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY md5(qid || ':' || iid), iid) AS r FROM scores WHERE label = 0) n ON p.qid = n.qid AND r <= 20 WHERE p.label = 1", SCORES_SQL)
def ranking_pairs(spark, d):
    from sparkloom.operators.splits import ranking_pairs as pairs

    return pairs(scores(spark, d).select("qid", "iid", "label"))


@query("SELECT t.uid, target || coalesce(',' || top, '') AS items FROM tgt t LEFT JOIN (SELECT uid, string_agg(item, ',' ORDER BY r) AS top FROM (SELECT uid, item, row_number() OVER (PARTITION BY uid ORDER BY count(*) DESC, item) AS r FROM hist GROUP BY uid, item) WHERE r <= 5 GROUP BY uid) USING (uid)", HIST_SQL)
def user_preferences(spark, d):
    return _csv(H.preferences(T.h(spark, d)))


@query("""SELECT uid, iid FROM tgt CROSS JOIN (SELECT item AS iid FROM seq GROUP BY item ORDER BY count(*) DESC, item LIMIT 20)
  UNION SELECT uid, iid FROM lastd JOIN (SELECT a, iid, row_number() OVER (PARTITION BY a ORDER BY c DESC, iid) AS r FROM l2t) USING (a) WHERE r <= 30
  UNION SELECT uid, b FROM lastd JOIN (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, b) AS r FROM nxt WHERE b IS NOT NULL GROUP BY a, b) USING (a) WHERE r <= 15
  UNION SELECT uid, item FROM hist""", FULL + PAIR_SQL + _warm_sql(H.V4))
def ranker_candidates(spark, d):
    return H.ranker_candidates(T.h(spark, d))

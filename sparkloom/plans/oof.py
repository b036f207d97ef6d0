"""The out-of-fold training table of the ranker and what is read off it."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sparkloom.operators import oof as O
from sparkloom.operators import retrieval as R
from sparkloom.plans import fixtures as T
from sparkloom.plans.fixtures import HIST_SQL, STATS_SQL, USER_SQL
from sparkloom.plans.ranking import ALPHA_SQL, KINDS, WIDE, _when
from sparkloom.plans.registry import query

FOLD = "CAST(concat('0x', substr(md5({}), 1, 8)) AS BIGINT) % 5"
_LIMITS = R.Sources()
_NAMED = [k for k in _LIMITS.weight if k not in ("history", "recent")]


def _viewed(sql: str) -> str:
    """The shared expressions, read from the views' histories instead of the whole ones."""
    out = re.sub(r"\b(hist|tgt|dd|suf|uc|ukeys|rec)\b", r"v\1", sql).replace("t.uid = CAST(c_custkey AS VARCHAR)", "split_part(t.uid, ':', 1) = CAST(c_custkey AS VARCHAR)")
    return re.sub(r"\bbucket AS \(", "vbucket AS (", out)


VIEW_SQL = """,
lens AS (SELECT uid, target, n, 'orig' AS view, n AS len FROM tgt UNION ALL SELECT uid, target, n, 'last3', least(n, 3) FROM tgt UNION ALL SELECT uid, target, n, 'empty', 0 FROM tgt
  UNION ALL SELECT uid, target, n, 'testmix', least(n, CASE WHEN b < 3515 THEN 0 WHEN b < 4518 THEN 1 WHEN b < 8992 THEN 3 WHEN b < 9006 THEN 5 WHEN b < 9053 THEN 10 WHEN b < 9202 THEN 30 ELSE n END) FROM (SELECT *, CAST(concat('0x', substr(md5(uid || ':testmix'), 1, 8)) AS BIGINT) % 10000 AS b FROM tgt)),
vtgt AS (SELECT uid || ':' || view AS uid, target, len AS n FROM lens),
vhist AS (SELECT h.uid || ':' || view AS uid, item, pos - (l.n - len) AS pos, len AS n FROM hist h JOIN lens l ON h.uid = l.uid AND pos >= l.n - len),
""" + _viewed(HIST_SQL[HIST_SQL.index("dd AS ("):] + USER_SQL + STATS_SQL[len(USER_SQL):STATS_SQL.index("nxt AS (")]).rstrip().rstrip(",")

OOF_SQL = HIST_SQL + STATS_SQL + VIEW_SQL + f""",
entries AS (SELECT uid, 'global' AS source, '' AS key, target AS iid, 1.0::DOUBLE AS w FROM tgt UNION ALL SELECT uid, 'last' || k, key, target, 1 FROM suf JOIN tgt USING (uid) UNION ALL SELECT uid, 'recent', item, target, pow(0.82, d) FROM rec
  UNION ALL SELECT uid, 'transition', a, b, 1 FROM nxt WHERE b IS NOT NULL UNION ALL SELECT uid, source, key, target, 1 FROM ukeys UNION ALL SELECT uid, 'length', bucket, target, 1 FROM bucket),
fstats AS (SELECT f, source, key, iid, round(sum(w), 9) AS cnt FROM entries, range(0, 5) t(f) WHERE {FOLD.format('uid')} <> f GROUP BY 1, 2, 3, 4),
ftotals AS (SELECT f, source, key, sum(cnt) AS total FROM fstats GROUP BY 1, 2, 3),
ftop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY f, source, key ORDER BY cnt DESC, iid) AS rank FROM fstats) WHERE rank <= {_when(_LIMITS.limit)}),
flookup AS (SELECT *, {FOLD.format("split_part(uid, ':', 1)")} AS f FROM (SELECT uid, source, key, {_when({k: _LIMITS.weight[k] for k in _NAMED})}::DOUBLE AS weight FROM (
    SELECT uid, 'last' || k AS source, key FROM vsuf UNION ALL SELECT uid, 'transition', item FROM vdd WHERE dpos = dn - 1 UNION ALL SELECT uid, source, key FROM vukeys UNION ALL SELECT uid, 'length', bucket FROM vbucket UNION ALL SELECT uid, 'global', '' FROM vtgt)
  UNION ALL SELECT uid, 'recent', item, {_LIMITS.weight["recent"]} * pow(0.82, d) FROM vrec)),
fhits AS (SELECT uid, iid, weight, rank FROM flookup JOIN ftop USING (f, source, key)
  UNION ALL SELECT * FROM (SELECT uid, iid, {_LIMITS.weight["history"]}::DOUBLE, row_number() OVER (PARTITION BY uid ORDER BY round(score, 9) DESC, iid) AS rank FROM (SELECT uid, item AS iid, 2 * ln(1 + count(*)) + sum(3.0 / (n - pos)) AS score FROM vhist GROUP BY uid, item)) WHERE rank <= {_LIMITS.history}),
fcands AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY round(rrf, 9) DESC, source_count DESC, best_rank, iid) AS pos FROM (SELECT uid, iid, sum(weight / (10.0 + rank)) AS rrf, count(*) AS source_count, min(rank) AS best_rank FROM fhits GROUP BY uid, iid)) WHERE pos <= 100),
fhas AS (SELECT t.uid, target, max((iid IS NOT NULL)::INT) AS r, (SELECT coalesce(max(pos), 0) FROM fcands c WHERE c.uid = t.uid) AS m FROM vtgt t LEFT JOIN fcands c ON t.uid = c.uid AND iid = target GROUP BY t.uid, target),
oc AS (SELECT c.uid, iid, pos, (iid = target)::BIGINT AS label, r::BIGINT AS positive_retrieved, rrf, source_count, best_rank FROM fcands c JOIN fhas USING (uid) WHERE r = 1 OR pos < 100 UNION ALL SELECT uid, target, least(m + 1, 100), 1, 0, 0, 0, 0 FROM fhas WHERE r = 0),
fn AS (SELECT f, iid, sum(t) AS t, sum(s) AS s FROM (SELECT uid, target AS iid, 1 AS t, 0 AS s FROM tgt UNION ALL SELECT uid, item, 0, 1 FROM hist), range(0, 5) t(f) WHERE {FOLD.format('uid')} <> f GROUP BY 1, 2),
fpri AS (SELECT f, iid, (t + 0.5) / (sum(t) OVER w + 0.5 * sum((t > 0)::INT) OVER w) AS tprior, (s + 0.5) / (sum(s) OVER w + 0.5 * sum((s > 0)::INT) OVER w) AS sprior FROM fn WINDOW w AS (PARTITION BY f)),
fcond AS (SELECT *, ln((prob + 1e-12) / (prior + 1e-12)) AS lift FROM (SELECT *, (cnt + alpha * prior) / (total + alpha) AS prob FROM (
  SELECT l.uid, c.iid, l.source, l.weight, coalesce(s.cnt, 0) AS cnt, coalesce(t.total, 0) AS total, coalesce(CASE WHEN l.source = 'transition' THEN sprior ELSE tprior END, 0) AS prior, {ALPHA_SQL.replace("CASE source", "CASE l.source")} AS alpha
  FROM flookup l JOIN oc c ON l.uid = c.uid LEFT JOIN fstats s ON s.f = l.f AND s.source = l.source AND s.key = l.key AND s.iid = c.iid LEFT JOIN ftotals t ON t.f = l.f AND t.source = l.source AND t.key = l.key LEFT JOIN fpri ON fpri.f = l.f AND fpri.iid = c.iid)))"""
OOF_SQL = re.sub(r"\b(hist|tgt|dd|suf|rec|nxt|ukeys|vhist|vtgt|vdd|entries|fstats|ftotals|flookup|fhits|fcands|oc|fpri|fcond) AS \(", r"\1 AS MATERIALIZED (", OOF_SQL)

_FEATURES = [f"max(CASE WHEN source = '{s}' THEN {e} END) AS {s}_{n}" for s in WIDE for n, e in (("log_cnt", "ln(1 + cnt)"), ("log_total", "ln(1 + total)"), ("prob", "prob"), ("lift", "lift"), ("mle", "cnt / (total + 1e-12)"))]
_FEATURES += ["coalesce(sum(CASE WHEN source = 'recent' THEN weight / 4 * prob END), 0) AS recent_prob_sum", "coalesce(max(CASE WHEN source = 'recent' THEN weight / 4 * prob END), 0) AS recent_prob_max", "coalesce(sum(CASE WHEN source = 'recent' THEN weight / 4 * lift END), 0) AS recent_lift_sum"]
for _s in ("segment", "pair"):
    _FEATURES += [f"{g}(CASE WHEN source = '{_s}' THEN {c} END) AS {_s}_{c}_{n}" for c in ("prob", "lift") for g, n in (("max", "max"), ("avg", "mean"))] + [f"sum(CASE WHEN source = '{_s}' THEN cnt END) AS {_s}_cnt_sum"]
_FEATURES += [x for k, v in KINDS.items() for x in (f"max(CASE WHEN source IN ({v}) AND cnt > 0 THEN 1 ELSE 0 END)::BIGINT AS hit_{k}", f"sum(CASE WHEN source IN ({v}) THEN ln(1 + cnt) ELSE 0 END) AS strength_{k}")]
_NAMES = [x.rsplit(" AS ", 1)[1] for x in _FEATURES]
_KEYS = ["pos", "label", "positive_retrieved", "source_count", "best_rank"]


@query("SELECT split_part(c.uid, ':', 1) AS user, split_part(c.uid, ':', 2) AS view, (split_part(c.uid, ':', 2) <> 'orig')::BIGINT AS augmented, t.n::BIGINT AS history_len, " + FOLD.format("split_part(c.uid, ':', 1)") + " AS fold, c.iid, " + ", ".join(f"c.{k}::BIGINT AS {k}" for k in _KEYS) + ", round(rrf, 6) AS rrf, " + ", ".join(f"{n}" if n.startswith("hit_") else f"round({n}, 6) AS {n}" for n in _NAMES) + ", (" + " + ".join(f"hit_{k}" for k in KINDS) + ")::BIGINT AS n_hits FROM oc c JOIN vtgt t ON c.uid = t.uid JOIN (SELECT uid, iid, " + ", ".join(_FEATURES) + " FROM fcond GROUP BY uid, iid) x ON x.uid = c.uid AND x.iid = c.iid", OOF_SQL)
def oof_frame(spark, d):
    """Four views of every user, 100 candidates each with the target among them, features of the other folds' counts."""
    f = O.frame(T.hu(spark, d), T.CATS, WIDE)
    return f.select("user", "view", "augmented", "history_len", "fold", "iid", *(F.col(k).cast("long").alias(k) for k in _KEYS), F.round("rrf", 6).alias("rrf"), *(n if n.startswith("hit_") else F.round(n, 6).alias(n) for n in _NAMES), "n_hits")


@query("SELECT view, fold, count(*) AS n_queries, sum(r)::BIGINT AS n_retrieved, round(avg(m), 6) AS mean_candidates FROM (SELECT split_part(uid, ':', 2) AS view, " + FOLD.format("split_part(uid, ':', 1)") + " AS fold, r, m FROM fhas) GROUP BY 1, 2", OOF_SQL)
def oof_recall(spark, d):
    """By view and fold: queries, targets that out-of-fold counts retrieve, and candidates before the target is forced."""
    h = T.hu(spark, d)
    v = O.views(h)
    top = R.cut(R.fused(R.hits(v, O.fold_stats(h, T.CATS), T.CATS, lead=O.lead())), 100)
    hit = top.join(v.select("uid", "target"), "uid").groupBy("uid").agg(F.count("*").alias("m"), F.max((F.col("iid") == F.col("target")).cast("long")).alias("r"))
    rows = v.select("uid", "view", O.fold_of(F.col("uid")).alias("fold")).join(hit, "uid", "left").na.fill(0, ["m", "r"])
    return rows.groupBy("view", "fold").agg(F.count("*").alias("n_queries"), F.sum("r").alias("n_retrieved"), F.round(F.avg("m"), 6).alias("mean_candidates"))


@query("SELECT split_part(uid, ':', 1) AS user, n::BIGINT AS history_len FROM vtgt WHERE split_part(uid, ':', 2) = 'orig'", OOF_SQL)
def original_views(spark, d):
    """What is left of the views without the augmented ones."""
    return O.views(T.hu(spark, d)).where("augmented = 0").select("user", F.size("raw").cast("long").alias("history_len"))

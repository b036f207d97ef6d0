"""The whole feature table of (user, candidate) pairs, and co-occurrence of long histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import features as FE
from sparkloom.operators import pairfeatures as PF
from sparkloom.operators import retrieval as R
from sparkloom.operators import stats as C
from sparkloom.operators.graph import checkpointed
from sparkloom.plans import fixtures as T
from sparkloom.plans.fixtures import CATS, HIST_SQL, PAIR_SQL
from sparkloom.plans.ranking import COND_SQL, LIMIT
from sparkloom.plans.registry import query

_E = {"logcnt": "ln(1 + cnt)", "logsupport": "ln(1 + total)", "prob": "prob", "lift": "lift", "mle": "cnt / (total + 1e-12)"}
_OWN = "CASE WHEN source = '{}' THEN {} END"


def _counted() -> list[str]:
    out = [f"max({_OWN.format(s, e)}) AS {p}_{n}" for s, p in PF.FIVE.items() for n, e in _E.items()]
    w = "weight / 4.0 * "
    out += [f"coalesce({f}({_OWN.format('recent', e)}), 0) AS recent_{n}" for n, f, e in (("prob_sum", "sum", w + "prob"), ("prob_max", "max", w + "prob"), ("lift_sum", "sum", w + "lift"), ("lift_max", "max", "lift"), ("logcount_sum", "sum", w + "ln(1 + cnt)"), ("hit_sources", "sum", "(cnt > 0)::INT"))]
    out += [f"max(CASE WHEN source = 'segment' AND starts_with(key, '{c}=') THEN {_E[n]} END) AS seg_{c}_{n}" for c in CATS for n in ("logcnt", "prob", "lift")]
    for s, p in (("segment", "seg"), ("pair", "pair")):
        out += [f"{f}({_OWN.format(s, x)}) AS {p}_{x}_{n}" for x in ("prob", "lift") for n, f in (("max", "max"), ("mean", "avg"))]
        out += [f"sum({_OWN.format(s, 'ln(1 + cnt)')}) AS {p}_logcnt_sum", f"sum({_OWN.format(s, '(cnt > 0)::INT')}) AS src_{s}_hit_sum"]
    return out


def _values() -> dict[str, str]:
    """Each column's expression over the joined tables."""
    v = {n: f"coalesce(w.{n}, 0)" for n in PF.names(CATS)}
    v |= {f"{p}_prob": f"coalesce(w.{p}_prob, {'sprior' if p == 'trans' else 'tprior'})" for p in PF.FIVE.values()}
    v |= {f"{p}_prob_{n}": f"coalesce(w.{p}_prob_{n}, tprior)" for p in ("seg", "pair") for n in ("max", "mean")} | {f"seg_{c}_prob": f"coalesce(w.seg_{c}_prob, tprior)" for c in CATS}
    v |= {"rrf": "c.rrf", "source_count": "c.source_count", "best_rank_recip": "1 / c.best_rank", "seq_len": "e.n", "log_seq_len": "ln(1 + e.n)", "dedup_len": "e.dn", "unique_ratio": "e.dn / greatest(e.n, 1)", "is_cold_0": "(e.n = 0)::INT", "is_cold_le2": "(e.n <= 2)::INT"}
    v |= {"global_target_logcnt": "ln(1 + coalesce(tr.t, 0))", "global_target_prior": "tprior", "global_target_logprior": "ln(tprior + 1e-12)", "global_target_rank_recip": "1 / coalesce(tr.rk, (SELECT count(*) FROM tr) + 1)", "seq_item_logcnt": "ln(1 + coalesce(sp.s, 0))", "seq_item_prior": "sprior"}
    c = "coalesce(hs.c, 0)"
    v |= {"history_present": f"({c} > 0)::INT", "history_count": c, "history_logcount": f"ln(1 + {c})", "history_freq_ratio": f"{c} / greatest(e.n, 1)", "history_recency": "coalesce(hs.r, 0)", "is_last_raw": "coalesce(c.iid = e.l1, false)::INT"}
    v |= {n: f"coalesce(c.iid = e.d{k}, false)::INT" for k, n in ((1, "is_last_dedup"), (2, "is_second_last"), (3, "is_third_last"))}
    v |= {f"i2i_jaccard_{n}": f"coalesce(jj.j{n}, 0)" for n in ("max", "sum", "last1")}
    v |= {"repeat_x_recent": f"({v['history_present']}) * {v['history_recency']}", "last1_x_history": f"{v['last1_prob']} * (1 + {v['history_logcount']})"}
    v |= {f"suffix_best_{n}": "greatest(" + ", ".join(v[f"last{k}_{n}"] for k in (1, 2, 3)) + ")" for n in ("prob", "lift")}
    hit = {n: f"({v[x]} > 0)::INT" for n, x in (("last1", "last1_logcnt"), ("last2", "last2_logcnt"), ("last3", "last3_logcnt"), ("recent", "recent_hit_sources"), ("transition", "trans_logcnt"), ("profile", "prof_logcnt"), ("length", "len_logcnt"))}
    v |= {f"src_{n}_hit": x for n, x in hit.items()} | {"src_supervised_hit_sum": " + ".join(hit[n] for n in ("last1", "last2", "last3", "recent", "transition"))}
    return v | {"src_profile_pair_strength": f"{v['prof_prob']} + {v['pair_prob_max']}", "src_suffix_recent_strength": f"{v['suffix_best_prob']} + {v['recent_prob_max']}", "src_rrf_x_best_rank": "c.rrf / c.best_rank + 1e-10"}


_SQL = f"""SELECT c.uid, c.iid, {", ".join(f"round(({e})::DOUBLE, 6) AS {n}" for n, e in _values().items())} FROM cands c JOIN ends e ON e.uid = c.uid LEFT JOIN wide w ON w.uid = c.uid AND w.iid = c.iid
  LEFT JOIN hs ON hs.uid = c.uid AND hs.iid = c.iid LEFT JOIN jj ON jj.uid = c.uid AND jj.iid = c.iid LEFT JOIN tr ON tr.iid = c.iid LEFT JOIN sp ON sp.iid = c.iid LEFT JOIN pri2 ON pri2.iid = c.iid"""
_BASE = COND_SQL + PAIR_SQL + f""",
wide AS MATERIALIZED (SELECT uid, iid, {", ".join(_counted())} FROM cond GROUP BY uid, iid),
pri2 AS (SELECT iid, coalesce(tprior, 0) AS tprior, coalesce(sprior, 0) AS sprior FROM pri),
hs AS MATERIALIZED (SELECT uid, item AS iid, count(*) AS c, max(1.0 / (n - pos)) AS r FROM hist GROUP BY 1, 2),
dl AS (SELECT uid, max(dn) AS dn, {", ".join(f"max(CASE WHEN dpos = dn - {k} THEN item END) AS d{k}" for k in (1, 2, 3))} FROM dd GROUP BY 1),
ends AS MATERIALIZED (SELECT t.uid, t.n, coalesce(dn, 0) AS dn, d1, d2, d3, (SELECT item FROM hist h WHERE h.uid = t.uid AND h.pos = t.n - 1) AS l1 FROM tgt t LEFT JOIN dl ON dl.uid = t.uid),
tr AS MATERIALIZED (SELECT target AS iid, count(*) AS t, row_number() OVER (ORDER BY count(*) DESC, target) AS rk FROM tgt GROUP BY 1),
jj AS MATERIALIZED (SELECT uid, iid, max(j) AS jmax, sum(j) AS jsum, max(CASE WHEN dpos = dn - 1 THEN j END) AS jlast1 FROM (SELECT c.uid, c.iid, dpos, dn, CASE WHEN c.iid = dd.item THEN 1 ELSE cooc / (occ_a + occ_b - cooc) END AS j
  FROM cands c JOIN dd ON c.uid = dd.uid LEFT JOIN pairs p ON p.a = least(c.iid, dd.item) AND p.b = greatest(c.iid, dd.item)) WHERE j > 0 GROUP BY 1, 2)"""


@query(_SQL, _BASE)
def pair_features_all(spark, d):
    """All features of each user's first 100 candidates, with six categories: 123 columns."""
    h = checkpointed(T.hu(spark, d))
    stats = checkpointed(C.build_stats(h, CATS))
    cands = checkpointed(R.cut(R.fused(R.hits(h, stats, CATS)), LIMIT))
    prior = FE.priors(h)
    wide = PF.counted(h, CATS, cands, stats, C.totals(stats), prior)
    out = PF.all_features(h, CATS, cands, wide, prior, C.pair_stats(h))
    out = out.withColumn("src_rrf_x_best_rank", F.col("src_rrf_x_best_rank") + 1e-10)  # some lie in the middle of two roundings
    return out.select("uid", "iid", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in PF.names(CATS)))


@query("SELECT a, b, cooc FROM co", HIST_SQL + PAIR_SQL)
def chunked_cooccurrence(spark, d):
    """Pairs of long histories chunk against chunk: here every history over 16 items counts as long."""
    return C.cooccurrences(T.h(spark, d), part=16)

"""All features of (user, candidate) pairs for a ranker: 105 columns and three for each category (129 with eight).

Everything that counts know comes from conditional aggregations over the rows of ``features.conditional``, one for each family
of sources; the rest are equi-joins by user, by item or by both. Nothing is gathered for each user but the user's own history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.features import looked_up
from sparkloom.operators.graph import checkpointed
from sparkloom.operators.ordering import numbered
from sparkloom.operators.retrieval import user_keys

#: Sources with five columns each, by the names that their columns bear.
FIVE = {"last1": "last1", "last2": "last2", "last3": "last3", "transition": "trans", "profile": "prof", "group_fine": "grp_fine", "group_mid": "grp_mid", "group_coarse": "grp_coarse", "length": "len"}
#: Pairs of items up to which they go to every task; they grow with items and not with users.
MOST_PAIRS = 500_000
PARTS = {"logcnt": "log_cnt", "logsupport": "log_total", "prob": "prob", "lift": "lift", "mle": "mle"}


def counted_columns(cats: list[str], recent_weight: float = 4.0) -> dict[str, tuple[tuple[str, ...], Column]]:
    """Aggregates over the conditional rows of a pair by name, each with the sources that it reads."""
    here = lambda s, x: F.when(F.col("source") == s, x)
    out = {f"{p}_{n}": ((s,), F.max(here(s, F.col(c)))) for s, p in FIVE.items() for n, c in PARTS.items()}
    w, recent = F.col("weight") / recent_weight, ("recent",)
    out |= {n: (recent, F.coalesce(F.sum(here("recent", w * F.col(c))), F.lit(0.0))) for n, c in (("recent_prob_sum", "prob"), ("recent_lift_sum", "lift"), ("recent_logcount_sum", "log_cnt"))}
    out |= {n: (recent, F.coalesce(F.max(here("recent", F.col(c) if c == "lift" else w * F.col(c))), F.lit(0.0))) for n, c in (("recent_prob_max", "prob"), ("recent_lift_max", "lift"))}
    out["recent_hit_sources"] = (recent, F.sum(here("recent", (F.col("cnt") > 0).cast("double"))))
    for c in cats:
        own = (F.col("source") == "segment") & F.startswith("bare", F.lit(f"{c}="))
        out |= {f"seg_{c}_{n}": (("segment",), F.max(F.when(own, F.col(x)))) for n, x in (("logcnt", "log_cnt"), ("prob", "prob"), ("lift", "lift"))}
    for s, p in (("segment", "seg"), ("pair", "pair")):
        out |= {f"{p}_{x}_{n}": ((s,), f(here(s, F.col(x)))) for x in ("prob", "lift") for n, f in (("max", F.max), ("mean", F.avg))}
        out |= {f"{p}_logcnt_sum": ((s,), F.sum(here(s, F.col("log_cnt")))), f"src_{s}_hit_sum": ((s,), F.sum(here(s, (F.col("cnt") > 0).cast("double"))))}
    return out


def families(cats: list[str]) -> list[tuple[tuple[str, ...], list[Column]]]:
    """The sources that features read; the keys of each line are the same for all users that agree on the columns beside."""
    return [
        (("segment", "pair", "profile", "group_fine", "group_mid", "group_coarse"), [F.col(c) for c in cats]),
        (("length",), [F.col("bucket")]),
        (("last1", "transition"), [F.try_element_at("dedup", F.lit(-1))]),
        (("last2", "last3", "recent"), [F.col("uid")]),
    ]


def counted(h: DataFrame, cats: list[str], cands: DataFrame, stats: DataFrame, totals: DataFrame, prior: DataFrame) -> DataFrame:
    """(uid, iid, ``counted_columns``) of every candidate. Candidates meet counts as lists, and all columns come from one
    aggregation where a user's lists lie: no row of a key and a candidate is shuffled."""
    columns = [c.alias(n) for n, (_, c) in counted_columns(cats).items()]
    keys = user_keys(h, cats).where(F.col("source").isin(*(s for sources, _ in families(cats) for s in sources)))
    every = prior.join(cands.select("iid").distinct(), "iid", "full_outer")
    return looked_up(keys, cands, stats, totals, every, gathered=True).withColumn("bare", F.col("key")).groupBy("uid", "iid").agg(*columns)


def item_columns(h: DataFrame, prior: DataFrame) -> DataFrame:
    """(iid, target_prior, seq_prior, target_cnt, seq_cnt, target_rank): of all items; targets rank by count, ties by id."""
    t = h.groupBy(F.col("target").alias("iid")).agg(F.count("*").alias("target_cnt"))
    t = numbered(t, [F.desc("target_cnt"), "iid"], "target_rank", 1)
    s = h.select(F.explode("raw").alias("iid")).groupBy("iid").agg(F.count("*").alias("seq_cnt"))
    return prior.join(t, "iid", "left").join(s, "iid", "left")


def history_columns(h: DataFrame, cands: DataFrame) -> DataFrame:
    """``cands`` (uid, iid, rrf, source_count, best_rank) with what the user's history says of the candidate."""
    seen = h.select("uid", F.size("raw").alias("_n"), F.posexplode("raw").alias("_p", "iid")).groupBy("uid", "iid").agg(F.count("*").alias("_c"), F.max(1.0 / (F.col("_n") - F.col("_p"))).alias("_r"))
    end = lambda c, k: F.try_element_at(c, F.lit(-k))
    ends = h.select("uid", F.size("raw").alias("_raw"), F.size("dedup").alias("_ded"), end("raw", 1).alias("_last"), *(end("dedup", k).alias(f"_d{k}") for k in (1, 2, 3)))
    out = cands.join(ends, "uid").join(seen, ["uid", "iid"], "left").na.fill(0, ["_c", "_r"])
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    n, c = F.greatest(F.col("_raw"), F.lit(1)), F.col("_c")
    return out.select(
        "uid", "iid", "rrf", "source_count",
        F.when(F.col("best_rank") > 0, 1.0 / F.col("best_rank")).otherwise(0.0).alias("best_rank_recip"),
        F.col("_raw").cast("long").alias("seq_len"), F.log1p("_raw").alias("log_seq_len"), F.col("_ded").cast("long").alias("dedup_len"), (F.col("_ded") / n).alias("unique_ratio"),
        flag(F.col("_raw") == 0).alias("is_cold_0"), flag(F.col("_raw") <= 2).alias("is_cold_le2"),
        flag(c > 0).alias("history_present"), c.alias("history_count"), F.log1p(c).alias("history_logcount"), (c / n).alias("history_freq_ratio"), F.col("_r").alias("history_recency"),
        flag(F.col("iid") == F.col("_last")).alias("is_last_raw"), *(flag(F.col("iid") == F.col(f"_d{k}")).alias(x) for k, x in ((1, "is_last_dedup"), (2, "is_second_last"), (3, "is_third_last"))),
    )


def similarity_columns(h: DataFrame, cands: DataFrame, pairs: DataFrame) -> DataFrame:
    """(uid, iid, i2i_jaccard_max, _sum, _last1): over all items of the history, an item and itself counting 1; only
    candidates that are like some item have a row. ``pairs`` (a, b, jaccard) has a < b."""
    items = h.select("uid", F.posexplode("dedup").alias("_p", "item"), (F.size("dedup") - 1).alias("_end"))
    both = items.join(cands.select("uid", "iid"), "uid").withColumns({"a": F.least("item", "iid"), "b": F.greatest("item", "iid")})
    pairs = checkpointed(pairs.select("a", "b", "jaccard"))
    pairs = F.broadcast(pairs) if pairs.count() <= MOST_PAIRS else pairs  # rows of users x items x candidates stay where they are
    both = both.join(pairs, ["a", "b"], "left").withColumn("j", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.col("jaccard"))).where("j > 0")
    last = F.max(F.when(F.col("_p") == F.col("_end"), F.col("j"))).alias("i2i_jaccard_last1")
    return both.groupBy("uid", "iid").agg(F.max("j").alias("i2i_jaccard_max"), F.sum("j").alias("i2i_jaccard_sum"), last)


def derived(df: DataFrame) -> DataFrame:
    """Interactions of columns, and which sources know the candidate."""
    c, flag = F.col, lambda x: (x > 0).cast("double")
    best = lambda n: F.greatest(*(c(f"last{k}_{n}") for k in (1, 2, 3)))
    hits = {f"src_{n}_hit": flag(c(x)) for n, x in (("last1", "last1_logcnt"), ("last2", "last2_logcnt"), ("last3", "last3_logcnt"), ("recent", "recent_hit_sources"), ("transition", "trans_logcnt"), ("profile", "prof_logcnt"), ("length", "len_logcnt"))}
    out = df.withColumns({"repeat_x_recent": c("history_present") * c("history_recency"), "last1_x_history": c("last1_prob") * (1 + c("history_logcount")), "suffix_best_prob": best("prob"), "suffix_best_lift": best("lift"), **hits})
    known = sum((c(f"src_{n}_hit") for n in ("last1", "last2", "last3", "recent", "transition")), F.lit(0.0))
    return out.withColumns({"src_supervised_hit_sum": known, "src_profile_pair_strength": c("prof_prob") + c("pair_prob_max"), "src_suffix_recent_strength": c("suffix_best_prob") + c("recent_prob_max"), "src_rrf_x_best_rank": c("rrf") * c("best_rank_recip")})


def names(cats: list[str]) -> list[str]:
    """The columns in their usual order."""
    base = "rrf source_count best_rank_recip seq_len log_seq_len dedup_len unique_ratio is_cold_0 is_cold_le2 global_target_logcnt global_target_prior global_target_logprior global_target_rank_recip seq_item_logcnt seq_item_prior history_present history_count history_logcount history_freq_ratio history_recency is_last_raw is_last_dedup is_second_last is_third_last".split()
    five = lambda *ps: [f"{p}_{n}" for p in ps for n in PARTS]
    recent = [f"recent_{n}" for n in ("prob_sum", "prob_max", "lift_sum", "lift_max", "logcount_sum", "hit_sources")]
    both = [f"{p}_{n}" for p in ("seg", "pair") for n in ("prob_max", "prob_mean", "lift_max", "lift_mean", "logcnt_sum")]
    cross = ["repeat_x_recent", "last1_x_history", "suffix_best_prob", "suffix_best_lift"]
    src = [f"src_{n}" for n in "last1_hit last2_hit last3_hit recent_hit transition_hit profile_hit length_hit segment_hit_sum pair_hit_sum supervised_hit_sum profile_pair_strength suffix_recent_strength rrf_x_best_rank".split()]
    return [*base, *five("last1", "last2", "last3"), *recent, *five("trans", "prof", "grp_fine", "grp_mid", "grp_coarse", "len"), *(f"seg_{c}_{n}" for c in cats for n in ("logcnt", "prob", "lift")), *both, *cross, *src, *(f"i2i_jaccard_{n}" for n in ("max", "sum", "last1"))]


def all_features(h: DataFrame, cats: list[str], cands: DataFrame, wide: DataFrame, prior: DataFrame, pairs: DataFrame) -> DataFrame:
    """(uid, iid, ``names``) of every candidate: ``wide`` has its ``counted`` columns, and a source under which the user has no
    key counts as one that never saw the item. Columns of items come first, while rows are narrow."""
    out = history_columns(h, cands).join(item_columns(h, prior), "iid", "left")
    out = out.join(wide, ["uid", "iid"], "left").join(similarity_columns(h, cands, pairs), ["uid", "iid"], "left")
    t, s = F.coalesce("target_prior", F.lit(0.0)), F.coalesce("seq_prior", F.lit(0.0))
    n_targets = h.agg(F.count_distinct("target").alias("_targets"))
    out = out.join(F.broadcast(n_targets))  # one row
    fill = {"global_target_logcnt": F.log1p(F.coalesce("target_cnt", F.lit(0))), "global_target_prior": t, "global_target_logprior": F.ln(t + 1e-12), "global_target_rank_recip": 1.0 / F.coalesce(F.col("target_rank"), F.col("_targets") + 1), "seq_item_logcnt": F.log1p(F.coalesce("seq_cnt", F.lit(0))), "seq_item_prior": s}
    fill |= {f"{p}_prob": F.coalesce(f"{p}_prob", s if p == "trans" else t) for p in FIVE.values()}
    fill |= {f"{p}_prob_{n}": F.coalesce(f"{p}_prob_{n}", t) for p in ("seg", "pair") for n in ("max", "mean")} | {f"seg_{c}_prob": F.coalesce(f"seg_{c}_prob", t) for c in cats}
    out = out.withColumns(fill)
    return derived(out.na.fill(0.0, [c for c in out.columns if c not in ("uid", "iid")])).select("uid", "iid", *names(cats))

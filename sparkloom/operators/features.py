"""Smoothed priors and conditional features of (user, candidate) pairs from the long count table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.dealing import dealt_join
from sparkloom.operators.graph import checkpointed
from sparkloom.operators.ordering import numbered

#: Numbers of items in a vector of counts; a key has a vector for each range of numbers in which it has counts.
RANGE = 1024
#: Rows of (user, key) a task when candidates meet counts, and when keys meet their totals; users a task afterwards.
KEY_ROWS, TOTAL_ROWS, USERS = 16_384, 250_000, 1024
#: Items up to which their table goes to every task.
MOST_ITEMS = 500_000

#: Smoothing of each source.
ALPHA = {"last1": 15.0, "last2": 8.0, "last3": 4.0, "recent": 12.0, "transition": 15.0, "profile": 10.0, "group_fine": 8.0, "group_mid": 8.0, "group_coarse": 8.0, "length": 30.0, "segment": 25.0, "pair": 15.0, "global": 15.0}


def priors(h: DataFrame) -> DataFrame:
    """(iid, target_prior, seq_prior) of all items that are a target or in a history."""
    t = h.groupBy(F.col("target").alias("iid")).agg(F.count("*").alias("t"))
    s = h.select(F.explode("raw").alias("iid")).groupBy("iid").agg(F.count("*").alias("s"))
    both = t.join(s, "iid", "full_outer")
    sums = both.agg(F.sum("t").alias("st"), F.count("t").alias("nt"), F.sum("s").alias("ss"), F.greatest(F.count("s"), F.lit(1)).alias("ns"))
    out = both.join(F.broadcast(sums))  # one row
    return out.select("iid", ((F.coalesce("t", F.lit(0)) + 0.5) / (F.coalesce("st", F.lit(0)) + 0.5 * F.col("nt"))).alias("target_prior"), ((F.coalesce("s", F.lit(0)) + 0.5) / (F.coalesce("ss", F.lit(0)) + 0.5 * F.col("ns"))).alias("seq_prior"))


def conditional(pairs: DataFrame, stats: DataFrame, totals: DataFrame, prior: DataFrame, prior_keys: list[str] | None = None) -> DataFrame:
    """For (uid, iid, source, key, ...) the count, total, smoothed probability, lift and share of each pair.

    Pairs that were never seen have count 0 and the smoothed prior. Two equi-joins serve all sources.
    """
    rows = pairs.join(stats, ["source", "key", "iid"], "left").join(totals, ["source", "key"], "left").join(prior, prior_keys or ["iid"], "left")
    return _smoothed(rows)


def _smoothed(rows: DataFrame) -> DataFrame:
    """Rows (source, cnt, total, target_prior, seq_prior, ...) with all that is derived from these, and without the priors."""
    alpha = F.create_map(*(F.lit(x) for kv in ALPHA.items() for x in kv))
    cnt, total = F.coalesce("cnt", F.lit(0.0)), F.coalesce("total", F.lit(0.0))
    own = F.when(F.col("source") == "transition", F.col("seq_prior")).otherwise(F.col("target_prior"))
    p = F.coalesce(own, F.lit(0.0))
    rows = rows.withColumns({"cnt": cnt, "total": total, "prior": p, "alpha": F.try_element_at(alpha, F.col("source"))})
    rows = rows.withColumn("prob", (F.col("cnt") + F.col("alpha") * F.col("prior")) / (F.col("total") + F.col("alpha")))
    return rows.withColumns({"lift": F.ln((F.col("prob") + 1e-12) / (F.col("prior") + 1e-12)), "log_cnt": F.log1p("cnt"), "log_total": F.log1p("total"), "mle": F.col("cnt") / (F.col("total") + 1e-12)}).drop("target_prior", "seq_prior")


def looked_up(keys: DataFrame, cands: DataFrame, stats: DataFrame, totals: DataFrame, prior: DataFrame, gathered: bool = False) -> DataFrame:
    """``conditional`` of each of a user's ``keys`` (uid, source, key, weight) with each of its ``cands`` (uid, iid).

    Items are numbered (``prior`` has all of them), and a user's candidates travel to a key's counts as one list of small
    numbers: a row for each user and key, not for each of their pairs, is shuffled. With ``gathered`` the counts travel back to
    the user as a list too, so what is grouped by (uid, iid) afterwards moves no more.
    """
    items = checkpointed(numbered(prior.select("iid", "target_prior", "seq_prior"), ["iid"], "_id"))
    items = F.broadcast(items) if items.count() <= MOST_ITEMS else items
    ids = items.select("iid", F.floor(F.col("_id") / RANGE).cast("int").alias("_range"), (F.col("_id") % RANGE).cast("short").alias("_at"))
    lists = checkpointed(cands.select("uid", "iid").join(ids, "iid").groupBy("uid", "_range").agg(F.sort_array(F.collect_list("_at")).alias("_ats")))
    own = dealt_join(keys, totals, ["source", "key"], TOTAL_ROWS, "left").join(lists, "uid")
    known = stats.join(ids, "iid").groupBy("source", "key", "_range").agg(F.map_from_entries(F.collect_list(F.struct(F.col("_at").cast("int").alias("at"), "cnt"))).alias("_map"))
    vector = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("_map"))), lambda i: F.coalesce(F.try_element_at("_map", i), F.lit(0.0)))
    met = dealt_join(own, known, ["source", "key", "_range"], KEY_ROWS, "left", keys, lambda df: df.withColumn("_vector", vector).drop("_map"))
    count = lambda at: F.coalesce(F.get("_vector", at.cast("int")), F.lit(0.0))
    names = ["uid", "source", "key", "weight", "total", "_range"]
    if gathered:
        n = max(1, -(-lists.count() // USERS))
        met = met.select(*names, "_ats", F.transform("_ats", count).alias("_cnts")).repartition(n, "uid")
        rows = met.select(*names, "_cnts", F.posexplode("_ats").alias("_p", "_at")).withColumn("cnt", F.get("_cnts", F.col("_p"))).drop("_cnts", "_p")
    else:
        rows = met.select(*names, "_vector", F.explode("_ats").alias("_at")).withColumn("cnt", count(F.col("_at"))).drop("_vector")
    rows = rows.withColumn("_id", F.col("_range").cast("long") * RANGE + F.col("_at")).join(items, "_id").drop("_id", "_range", "_at")
    return _smoothed(rows)


def wide_columns(sources: tuple[str, ...]) -> list[Column]:
    out = []
    for s in sources:
        here = F.col("source") == s
        out += [F.max(F.when(here, F.col(c))).alias(f"{s}_{c}") for c in ("log_cnt", "log_total", "prob", "lift", "mle")]
    return out


def widened(cond: DataFrame, sources: tuple[str, ...] = ("last1", "last2", "last3", "transition", "profile", "group_fine", "group_mid", "group_coarse", "length")) -> DataFrame:
    """One row for each (uid, iid): five columns for each single-key source, by one conditional aggregation."""
    return cond.groupBy("uid", "iid").agg(*wide_columns(sources))


def spread_columns() -> list[Column]:
    """Sums and maxima over the recent items, maxima and means over segments and pairs."""
    here = lambda s, x: F.when(F.col("source") == s, x)
    w = F.col("weight") / 4.0
    out = [F.coalesce(F.sum(here("recent", w * F.col("prob"))), F.lit(0.0)).alias("recent_prob_sum"), F.coalesce(F.max(here("recent", w * F.col("prob"))), F.lit(0.0)).alias("recent_prob_max"), F.coalesce(F.sum(here("recent", w * F.col("lift"))), F.lit(0.0)).alias("recent_lift_sum")]
    for s in ("segment", "pair"):
        for c in ("prob", "lift"):
            out += [F.max(here(s, F.col(c))).alias(f"{s}_{c}_max"), F.avg(here(s, F.col(c))).alias(f"{s}_{c}_mean")]
        out.append(F.sum(here(s, F.col("cnt"))).alias(f"{s}_cnt_sum"))
    return out


#: The kinds of sources that are counted together.
KINDS = {"suffix": ("last1", "last2", "last3"), "recent": ("recent",), "transition": ("transition",), "profile": ("profile",), "segment": ("segment",), "pair": ("pair",), "group": ("group_fine", "group_mid", "group_coarse"), "length": ("length",)}


def hit_columns() -> list[Column]:
    hit = lambda *s: F.max(F.when(F.col("source").isin(*s) & (F.col("cnt") > 0), 1).otherwise(0)).cast("long")
    strength = lambda *s: F.sum(F.when(F.col("source").isin(*s), F.log1p("cnt")).otherwise(0.0))
    return [hit(*v).alias(f"hit_{k}") for k, v in KINDS.items()] + [strength(*v).alias(f"strength_{k}") for k, v in KINDS.items()]


def with_hits(wide: DataFrame) -> DataFrame:
    return wide.withColumn("n_hits", sum((F.col(f"hit_{k}") for k in KINDS), F.lit(0)).cast("long"))


def source_hits(cond: DataFrame) -> DataFrame:
    """Which kinds of sources know a candidate, how many and how strongly."""
    return with_hits(cond.groupBy("uid", "iid").agg(*hit_columns()))

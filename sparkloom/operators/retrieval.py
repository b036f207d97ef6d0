"""Candidates from many sources, fused by reciprocal ranks."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.scalars import popularity_penalty
from sparkloom.operators import sequences as S
from sparkloom.operators import stats as C
from sparkloom.operators.dealing import dealt_join
from sparkloom.operators.graph import checkpointed


#: Rows of (user, key) a task when keys meet their items: up to 80 each.
KEY_ROWS = 16_384
#: Users a task when their keys' items are added up: some hundreds each.
USERS = 1024


@dataclass(frozen=True)
class Sources:
    """How many items each source gives and what a hit weighs."""

    limit: dict[str, int] = field(default_factory=lambda: {"last1": 60, "last2": 50, "last3": 40, "transition": 35, "recent": 24, "profile": 40, "segment": 25, "pair": 25, "length": 25, "group_fine": 30, "group_mid": 20, "group_coarse": 15, "global": 80})
    weight: dict[str, float] = field(default_factory=lambda: {"history": 7.0, "last1": 6.0, "last2": 8.0, "last3": 10.0, "transition": 2.0, "recent": 4.0, "profile": 5.0, "segment": 2.0, "pair": 3.0, "length": 1.0, "group_fine": 4.0, "group_mid": 1.5, "group_coarse": 0.8, "global": 0.8})
    history: int = 60


#: Fixed values of the popularity-penalised variant, which knows no groups.
PENALISED = Sources(
    {"last1": 72, "last2": 62, "last3": 52, "transition": 42, "recent": 28, "profile": 30, "segment": 22, "pair": 16, "length": 25, "global": 80},
    {"history": 7.0, "last1": 6.0, "last2": 8.0, "last3": 10.0, "transition": 2.0, "recent": 4.0, "profile": 2.4, "segment": 1.25, "pair": 1.10, "length": 0.8, "global": 0.45},
)


def user_keys(h: DataFrame, cats: list[str], sources: Sources = Sources(), recent: int = C.RECENT, lead=None) -> DataFrame:
    """(uid, source, key, weight): the keys under which each user looks up counts; one pass, no join.

    ``lead`` is put before each key, as in ``stats.build_stats``.
    """
    w = sources.weight
    entry = lambda s, key, weight=None: F.struct(F.lit(s).alias("source"), key.alias("key"), (F.lit(w[s]) if weight is None else weight).alias("weight"))
    keys = [(f"last{k}", S.suffix(F.col("dedup"), k)) for k in (1, 2, 3)]
    keys += [("transition", F.try_element_at("dedup", F.lit(-1))), ("profile", C.profile_key(cats)), ("length", F.col("bucket")), ("global", F.lit(""))]
    keys += [("segment", F.concat(F.lit(f"{c}="), c)) for c in cats]
    keys += [("pair", F.concat(F.lit(f"{a}="), a, F.lit(f"&{b}="), b)) for a, b in combinations(cats[:6], 2)]
    keys += [(s, C.profile_key(cats[:n])) for s, n in (("group_fine", 4), ("group_mid", 2), ("group_coarse", 1))]
    fixed = F.array(*(entry(s, k) for s, k in keys if s in w))
    last = F.reverse(F.slice("dedup", F.greatest(F.size("dedup") - recent, F.lit(0)) + 1, recent))
    late = F.transform(last, lambda x, d: entry("recent", x, F.lit(w["recent"]) * F.pow(F.lit(C.DECAY), d)))
    rows = S.with_bucket(h).select("uid", F.explode(F.concat(fixed, late)).alias("k"))
    rows = rows.select("uid", "k.*").where("key is not null")
    return rows if lead is None else rows.withColumn("key", F.concat(lead, "key"))


def history_scores(h: DataFrame) -> DataFrame:
    """(uid, iid, score): 2 ln(1 + count) and 3 / (1 + distance from the end) for each time an item occurs."""
    steps = h.select("uid", F.size("raw").alias("n"), F.posexplode("raw").alias("pos", "iid"))
    return steps.groupBy("uid", "iid").agg((2 * F.log1p(F.count("*")) + F.sum(3.0 / (F.col("n") - F.col("pos")))).alias("score"))


def hits(h: DataFrame, stats: DataFrame, cats: list[str], sources: Sources = Sources(), lead=None) -> DataFrame:
    """(uid, iid, source, weight, rank) of every source's first items for every user.

    A key's items travel as one list, so a user's hits are a row for each key until they are all in one task: what is
    grouped or ranked by user afterwards moves no more.
    """
    h = checkpointed(h)  # keys are counted, then joined
    listed = lambda df, *by: df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "iid"))), lambda x: x["iid"]).alias("items"))
    top = listed(C.top_n(stats, sources.limit), "source", "key")  # a source's limit of items at most
    found = dealt_join(user_keys(h, cats, sources, lead=lead), top, ["source", "key"], KEY_ROWS).select("uid", "source", "weight", "items")
    own = history_scores(h).withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc(F.round("score", 9)), "iid")).cast("long"))
    own = listed(own.where(F.col("rank") <= sources.history), "uid").select("uid", F.lit("history").alias("source"), F.lit(sources.weight["history"]).alias("weight"), "items")
    met = found.unionByName(own).repartition(max(1, -(-h.count() // USERS)), "uid")
    return met.select("uid", "source", "weight", F.posexplode("items").alias("_p", "iid")).select("uid", "iid", "source", "weight", (F.col("_p") + 1).cast("long").alias("rank"))


def fused(found: DataFrame, k: float = 10.0) -> DataFrame:
    """(uid, iid, rrf, source_count, best_rank): weight / (k + rank) summed over hits."""
    return found.groupBy("uid", "iid").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("rrf"), F.count("*").alias("source_count"), F.min("rank").alias("best_rank"))


def penalised(found: DataFrame, target_counts: DataFrame) -> DataFrame:
    """Hits other than from the history weigh less the more popular their item is."""
    rows = found.join(target_counts.select("iid", F.col("cnt").alias("_cnt")), "iid", "left")
    return rows.withColumn("weight", F.col("weight") * F.when(F.col("source") == "history", 1.0).otherwise(popularity_penalty(F.coalesce("_cnt", F.lit(0))))).drop("_cnt")


def cut(scores: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` candidates of each user, with ``pos`` from 1."""
    order = Window.partitionBy("uid").orderBy(F.desc(F.round("rrf", 9)), F.desc("source_count"), "best_rank", "iid")
    return scores.withColumn("pos", F.row_number().over(order).cast("long")).where(F.col("pos") <= limit)


def forced_positive(cands: DataFrame, targets: DataFrame, limit: int) -> DataFrame:
    """Candidates with each user's target among them: appended, or in the last place of a full list."""
    marked = cands.select("uid", "iid", "pos").join(targets.select("uid", "target"), "uid")
    seen = targets.join(cands.select("uid", F.col("iid").alias("target")).distinct().withColumn("hit", F.lit(True)), ["uid", "target"], "left")
    seen = seen.join(cands.groupBy("uid").agg(F.max("pos").alias("n")), "uid", "left").select("uid", "target", F.coalesce("hit", F.lit(False)).alias("retrieved"), F.coalesce("n", F.lit(0)).alias("n"))
    kept = marked.join(seen.select("uid", "retrieved"), "uid").where(F.col("retrieved") | (F.col("pos") < limit)).select("uid", "iid", "pos", (F.col("iid") == F.col("target")).cast("long").alias("label"), F.col("retrieved").cast("long").alias("positive_retrieved"))
    added = seen.where("not retrieved").select("uid", F.col("target").alias("iid"), F.least(F.col("n") + 1, F.lit(limit)).cast("long").alias("pos"), F.lit(1).cast("long").alias("label"), F.lit(0).cast("long").alias("positive_retrieved"))
    return kept.unionByName(added)

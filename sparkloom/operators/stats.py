"""Additive counts as one long table (source, key, iid, cnt), and what is derived from pairs of items.

Every source is an aggregation with partial sums before its shuffle, so hot items and hot keys don't gather rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.scalars import clamp, clean_scalar
from sparkloom.operators import sequences as S

DECAY = 0.82
RECENT = 6


def counted(rows: DataFrame, source: str, key, iid, weight=None, lead=None) -> DataFrame:
    """Rows, or sums of ``weight``, by key and item; ``lead`` is put before the key."""
    w = F.lit(1.0) if weight is None else weight
    own = rows.select(F.lit(source).alias("source"), (key if lead is None else F.concat(lead, key)).alias("key"), iid.alias("iid"), w.alias("_w"))
    return own.groupBy("source", "key", "iid").agg(F.sum("_w").alias("cnt"))


def profile_key(cats: list[str]):
    return F.concat_ws("|", *cats)


def suffix_counts(h: DataFrame, lead=None) -> DataFrame:
    led = lambda k: k if lead is None else F.concat(lead, k)
    keys = F.array(*(F.struct(F.lit(f"last{k}").alias("source"), led(S.suffix(F.col("dedup"), k)).alias("key")) for k in (1, 2, 3)))
    rows = h.select(F.explode(keys).alias("s"), "target").select("s.*", F.col("target").alias("iid")).where("key is not null")
    return rows.groupBy("source", "key", "iid").agg(F.count("*").cast("double").alias("cnt"))


def category_counts(h: DataFrame, cats: list[str], lead=None) -> DataFrame:
    """Segments, pairs of the first six, the full profile and the groups of the first 4, 2 and 1 categories.

    One pass: each row lists its keys, and counts are summed before they move.
    """
    keys = [("segment", F.concat(F.lit(f"{c}="), c)) for c in cats]
    keys += [("pair", F.concat(F.lit(f"{a}="), a, F.lit(f"&{b}="), b)) for a, b in combinations(cats[:6], 2)]
    keys += [("profile", profile_key(cats)), ("group_fine", profile_key(cats[:4])), ("group_mid", profile_key(cats[:2])), ("group_coarse", F.col(cats[0]))]
    rows = h.select(F.explode(F.array(*(F.struct(F.lit(s).alias("source"), (k if lead is None else F.concat(lead, k)).alias("key")) for s, k in keys))).alias("s"), "target")
    return rows.select("s.*", F.col("target").alias("iid")).groupBy("source", "key", "iid").agg(F.count("*").cast("double").alias("cnt"))


def cleaned(h: DataFrame, cats: list[str]) -> DataFrame:
    return h.withColumns({c: clean_scalar(F.col(c)) for c in cats})


SUFFIXES = ("last1", "last2", "last3")
CATEGORIES = ("segment", "pair", "profile", "group_fine", "group_mid", "group_coarse")


def build_stats(h: DataFrame, cats: list[str], sources: tuple[str, ...] | None = None, lead=None) -> DataFrame:
    """``sources`` (all by default) over (uid, raw, dedup, target, categories); ``lead``, of the uid, precedes each key."""
    h = h.where("target <> ''")
    parts = {
        ("global",): lambda: counted(h, "global", F.lit(""), F.col("target"), lead=lead),
        SUFFIXES: lambda: suffix_counts(h, lead),
        ("recent",): lambda: counted(S.recent(h, RECENT), "recent", F.col("item"), F.col("target"), F.pow(F.lit(DECAY), "d"), lead),
        ("transition",): lambda: counted(S.neighbours(h), "transition", F.col("a"), F.col("b"), lead=lead),
        CATEGORIES: lambda: category_counts(h, cats, lead),
        ("length",): lambda: counted(S.with_bucket(h), "length", F.col("bucket"), F.col("target"), lead=lead),
    }
    out = reduce(DataFrame.unionByName, [f() for names, f in parts.items() if sources is None or set(names) & set(sources)])
    return out if sources is None else out.where(F.col("source").isin(*sources))


def totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("source", "key").agg(F.sum("cnt").alias("total"))


def out_of_fold(all_stats: DataFrame, fold_stats: DataFrame) -> DataFrame:
    """Counts of all folds but one: counts are additive, so a fold's own are subtracted."""
    own = fold_stats.withColumnRenamed("cnt", "own")
    left = all_stats.join(own, ["source", "key", "iid"], "left").withColumn("cnt", F.round(F.col("cnt") - F.coalesce("own", F.lit(0.0)), 9))
    return left.where("cnt > 0").drop("own")


def occurrences(h: DataFrame) -> DataFrame:
    return h.select(F.explode(F.array_distinct("dedup")).alias("item")).groupBy("item").agg(F.count("*").alias("occ"))


def cooccurrences(h: DataFrame, part: int | None = None) -> DataFrame:
    """(a, b, cooc); with ``part`` histories of more new items than that are expanded chunk against chunk."""
    return (S.unordered_pairs(h) if part is None else S.chunked_pairs(h, part)).groupBy("a", "b").agg(F.count("*").alias("cooc"))


def pair_stats(h: DataFrame) -> DataFrame:
    """(a, b, cooc, occ_a, occ_b, jaccard, pmi, npmi, log_support); N is the number of histories."""
    occ = occurrences(h)
    n = h.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_users"))
    pairs = cooccurrences(h).join(occ.select(F.col("item").alias("a"), F.col("occ").alias("occ_a")), "a").join(occ.select(F.col("item").alias("b"), F.col("occ").alias("occ_b")), "b")
    pairs = pairs.join(F.broadcast(n))  # one row
    pmi = F.ln(F.col("cooc") * F.col("n_users") / (F.col("occ_a") * F.col("occ_b")))
    joint = -F.ln(F.col("cooc") / F.col("n_users"))
    return pairs.withColumns({"jaccard": F.col("cooc") / (F.col("occ_a") + F.col("occ_b") - F.col("cooc")), "pmi": clamp(pmi, -10.0, 10.0), "npmi": clamp(F.when(joint > 0, pmi / joint).otherwise(1.0), -1.0, 1.0), "log_support": F.log1p("cooc")})


def top_n(stats: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The first items of each (source, key) by count to 9 places, as sums of weights differ by the order of rows beyond them;
    ties by id. Spark cuts each task's rows before the shuffle."""
    limit = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))
    ranked = stats.withColumn("rank", F.row_number().over(Window.partitionBy("source", "key").orderBy(F.desc(F.round("cnt", 9)), "iid")).cast("long"))
    return ranked.where(F.col("rank") <= max(limits.values())).where(F.col("rank") <= F.try_element_at(limit, F.col("source")))

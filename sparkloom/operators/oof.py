"""Out-of-fold candidate tables: every view of a user's history, scored by the counts of the other folds.

Folds are part of the keys of the long count table (``fold/key``), so all folds and views go through the same joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scalars import hash_bucket
from sparkloom.operators import features as FE
from sparkloom.operators import retrieval as R
from sparkloom.operators import sequences as S
from sparkloom.operators import stats as C
from sparkloom.operators.graph import checkpointed

VIEWS = ("orig", "testmix", "last3", "empty")


def fold_of(uid: Column, folds: int = 5) -> Column:
    return hash_bucket(F.substring_index(uid, ":", 1), folds)


def lead(folds: int = 5) -> Column:
    """What precedes the keys of a user's fold."""
    return F.concat(fold_of(F.col("uid"), folds).cast("string"), F.lit("/"))


def views(h: DataFrame, names: tuple[str, ...] = VIEWS) -> DataFrame:
    """(user, view, augmented, and the columns of ``h``) with ``uid`` = user:view; all but ``orig`` are augmented."""
    one = lambda v: (h if v == "orig" else S.shortened(h, v)).withColumns({"user": F.col("uid"), "view": F.lit(v), "augmented": F.lit(int(v != "orig")).cast("long")})
    return reduce(DataFrame.unionByName, map(one, names)).withColumn("uid", F.concat("user", F.lit(":"), "view"))


def fold_stats(h: DataFrame, cats: list[str], folds: int = 5) -> DataFrame:
    """(source, key = fold/key, iid, cnt) of all users outside the fold: one pass over histories, then subtraction."""
    own = C.build_stats(h, cats, lead=lead(folds))
    bare = own.withColumn("key", F.substring("key", F.instr("key", "/") + 1, F.length("key")))
    total = bare.groupBy("source", "key", "iid").agg(F.sum("cnt").alias("cnt"))
    each = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("f")
    spread = total.select("source", "iid", "cnt", "key", each).withColumn("key", F.concat(F.col("f").cast("string"), F.lit("/"), "key")).drop("f")
    return C.out_of_fold(spread, own)


def fold_priors(h: DataFrame, folds: int = 5) -> DataFrame:
    """(fold, iid, target_prior, seq_prior) of the items that users outside the fold have."""
    fold = fold_of(F.col("uid"), folds).alias("own")
    seen = h.select(fold, F.explode("raw").alias("iid"), F.lit(0).alias("t"), F.lit(1).alias("s")).unionByName(h.select(fold, F.col("target").alias("iid"), F.lit(1).alias("t"), F.lit(0).alias("s")))
    n = seen.groupBy("own", "iid").agg(F.sum("t").alias("t"), F.sum("s").alias("s"))
    others = n.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)).cast("array<bigint>"))).where("fold <> own")
    c = others.groupBy("fold", "iid").agg(F.sum("t").alias("t"), F.sum("s").alias("s"))
    sums = c.groupBy("fold").agg(F.sum("t").alias("st"), F.sum((F.col("t") > 0).cast("long")).alias("nt"), F.sum("s").alias("ss"), F.greatest(F.sum((F.col("s") > 0).cast("long")), F.lit(1)).alias("ns"))
    out = c.join(F.broadcast(sums), "fold")  # one row a fold
    return out.select("fold", "iid", ((F.col("t") + 0.5) / (F.col("st") + 0.5 * F.col("nt"))).alias("target_prior"), ((F.col("s") + 0.5) / (F.col("ss") + 0.5 * F.col("ns"))).alias("seq_prior"))


def candidates(viewed: DataFrame, stats: DataFrame, cats: list[str], limit: int = 100, folds: int = 5) -> DataFrame:
    """(uid, iid, pos, label, positive_retrieved, rrf, source_count, best_rank), the target among them; 0 where forced."""
    top = R.cut(R.fused(R.hits(viewed, stats, cats, lead=lead(folds))), limit)
    forced = R.forced_positive(top, viewed.select("uid", "target"), limit)
    return forced.join(top.drop("pos"), ["uid", "iid"], "left").na.fill(0, ["rrf", "source_count", "best_rank"])


def frame(h: DataFrame, cats: list[str], sources: tuple[str, ...], limit: int = 100, folds: int = 5) -> DataFrame:
    """One row for each view of each user and candidate: keys, label, flags and the features of ``sources``."""
    viewed, stats = views(h), checkpointed(fold_stats(h, cats, folds))  # read three times
    cands = checkpointed(candidates(viewed, stats, cats, limit, folds))
    pairs = R.user_keys(viewed, cats, lead=lead(folds)).join(cands.select("uid", "iid"), "uid").withColumn("fold", fold_of(F.col("uid"), folds))
    cond = FE.conditional(pairs, stats, C.totals(stats), fold_priors(h, folds), ["fold", "iid"])
    wide = FE.with_hits(cond.groupBy("uid", "iid").agg(*FE.wide_columns(sources), *FE.spread_columns(), *FE.hit_columns()))
    about = viewed.select("uid", "user", "view", "augmented", F.size("raw").cast("long").alias("history_len"), fold_of(F.col("uid"), folds).alias("fold"))
    return cands.join(about, "uid").join(wide, ["uid", "iid"])

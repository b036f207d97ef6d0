"""User histories as arrays, and the item pairs that they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scalars import hash_bucket, length_bucket
from sparkloom.operators.ordering import numbered


def histories(steps: DataFrame, user: str, item: str, order: list[str]) -> DataFrame:
    """(uid, raw, dedup, target): each user's items in order; the last is the target, the rest the history.

    A user's steps meet in one array, so its size is a user's history, not the table's.
    """
    one = steps.select(F.col(user).cast("string").alias("uid"), F.struct(*order, F.col(item).alias("_item")).alias("_s"))
    lists = one.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["_item"]).alias("all"))
    raw = F.slice("all", F.lit(1), F.size("all") - 1)
    return lists.select("uid", raw.alias("raw"), F.array_distinct(raw).alias("dedup"), F.element_at("all", -1).alias("target"))


def with_dedup(df: DataFrame, raw: str = "raw", given: str = "given") -> DataFrame:
    """``dedup``: the given column's items, or those of ``raw`` once each where it has none."""
    return df.withColumn("dedup", F.when(F.size(F.coalesce(given, F.array().cast("array<string>"))) > 0, F.col(given)).otherwise(F.array_distinct(raw)))


def suffix(items, k: int):
    """The last ``k`` items joined by |, null if there are fewer."""
    return F.when(F.size(items) >= k, F.concat_ws("|", F.slice(items, -k, k)))


def neighbours(h: DataFrame, gap: int = 1) -> DataFrame:
    """(uid, a, b): items of ``raw`` at distance ``gap``."""
    pairs = F.arrays_zip(F.slice("raw", F.lit(1), F.greatest(F.size("raw") - gap, F.lit(0))).alias("a"), F.slice("raw", F.lit(1 + gap), F.greatest(F.size("raw") - gap, F.lit(0))).alias("b"))
    return h.where(F.size("raw") > gap).select("uid", F.explode(pairs).alias("p")).select("uid", "p.a", "p.b")


def trigrams(h: DataFrame) -> DataFrame:
    n = F.greatest(F.size("raw") - 2, F.lit(0))
    three = F.arrays_zip(*(F.slice("raw", F.lit(1 + k), n).alias(c) for k, c in enumerate("abc")))
    return h.where(F.size("raw") > 2).select("uid", F.explode(three).alias("t")).select("uid", "t.*")


def recent(h: DataFrame, k: int = 6) -> DataFrame:
    """(uid, d, item): the last ``k`` new items, d = 0 for the last."""
    return h.where(F.size("dedup") > 0).select("uid", "target", F.posexplode(F.reverse(F.slice("dedup", F.greatest(F.size("dedup") - k, F.lit(0)) + 1, k))).alias("d", "item")).withColumn("d", F.col("d").cast("long"))


def unordered_pairs(h: DataFrame, extra: str | None = None) -> DataFrame:
    """(uid, a, b), a < b: pairs of a user's distinct items, made inside the row without a join."""
    items = F.array_sort(F.array_distinct(F.concat("dedup", F.array(extra)) if extra else F.col("dedup")))
    return h.select("uid", items.alias("i")).select("uid", F.posexplode("i").alias("k", "a"), "i").select("uid", "a", F.explode(F.slice("i", F.col("k") + 2, F.size("i"))).alias("b"))


def chunked_pairs(h: DataFrame, part: int = 1024) -> DataFrame:
    """``unordered_pairs`` where a history may have any length: those of more than ``part`` new items are cut into chunks,
    and each chunk meets each later one (and itself) in a row of its own, dealt by user and chunks. So no row holds more than
    two chunks and no task expands a user alone; shorter histories are expanded where they are."""
    own = h.select("uid", F.array_sort(F.array_distinct("dedup")).alias("i"))
    short = own.where(F.size("i") <= part).select("uid", F.posexplode("i").alias("k", "a"), "i").select("uid", "a", F.explode(F.slice("i", F.col("k") + 2, F.size("i"))).alias("b"))
    long = own.where(F.size("i") > part).withColumn("n", F.ceil(F.size("i") / part).cast("int"))
    cut = long.select("uid", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.slice("i", k * part + 1, part))).alias("k", "chunk")).repartition("uid", "k")
    left = cut.select("uid", F.col("k").alias("x"), F.explode(F.sequence("k", F.col("n") - 1)).alias("y"), "chunk")
    right = cut.select("uid", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("x"), F.col("k").alias("y"), F.col("chunk").alias("other"))
    met = left.join(right, ["uid", "x", "y"]).select("uid", "x", "y", F.posexplode("chunk").alias("k", "a"), "other")
    return short.unionByName(met.select("uid", "a", F.explode(F.when(F.col("x") == F.col("y"), F.slice("other", F.col("k") + 2, part)).otherwise(F.col("other"))).alias("b")))


def skipgrams(h: DataFrame, window: int = 4, tail: int = 80) -> DataFrame:
    """(uid, a, b): ordered pairs at most ``window`` apart in the last ``tail`` items."""
    cut = h.select("uid", F.slice("raw", F.greatest(F.size("raw") - tail, F.lit(0)) + 1, tail).alias("t"))
    left = cut.select("uid", F.posexplode("t").alias("k", "a"), "t")
    near = F.filter(F.transform(F.sequence(F.col("k") - window, F.col("k") + window), lambda j: F.when((j >= 0) & (j != F.col("k")), F.get("t", j))), lambda x: x.isNotNull())
    return left.select("uid", "a", F.explode(near).alias("b"))


#: Cumulative shares of history lengths 0, 1, 2-3, 4-5, 6-10, 11-30 for shortened views; the rest stay whole.
VIEW_SHARES = ((3515, 0), (4518, 1), (8992, 3), (9006, 5), (9053, 10), (9202, 30))


def shortened(h: DataFrame, mode: str = "testmix") -> DataFrame:
    """A view with a shorter history whose length comes from a hash of the user: testmix, last1, last3, last5 or empty."""
    if mode == "testmix":
        share, length = hash_bucket(F.concat("uid", F.lit(":testmix")), 10_000), F.size("raw")
        for top, n in reversed(VIEW_SHARES):
            length = F.when(share < top, n).otherwise(length)
    else:
        length = F.lit({"last1": 1, "last3": 3, "last5": 5, "empty": 0}[mode])
    n = F.least(length, F.size("raw"))
    raw = F.when(n > 0, F.slice("raw", F.size("raw") - n + 1, F.greatest(n, F.lit(1)))).otherwise(F.slice("raw", 1, 0))
    return h.withColumn("raw", raw).withColumn("dedup", F.array_distinct("raw"))


def prefixes(h: DataFrame, last: int = 48) -> DataFrame:
    """(uid, pos, history, next): next-item examples at the last ``last`` places."""
    at = h.where(F.size("raw") > 1).select("uid", "raw", F.explode(F.sequence(F.greatest(F.lit(1), F.size("raw") - last), F.size("raw") - 1)).alias("pos"))
    return at.select("uid", F.col("pos").cast("long").alias("pos"), F.slice("raw", F.lit(1), F.col("pos")).alias("history"), F.get("raw", "pos").alias("next"))


def with_bucket(h: DataFrame) -> DataFrame:
    return h.withColumn("bucket", length_bucket(F.size("raw")))


def vocabulary(items: DataFrame, column: str) -> DataFrame:
    """(item, idx): the sorted distinct items numbered from 1."""
    return numbered(items.select(F.col(column).alias("item")).distinct(), ["item"], "idx", 1)

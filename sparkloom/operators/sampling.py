"""Draws by hashes of keys: uniform and popularity negatives of an exact number, and capped prefixes of histories.

A draw is a number below a total, so nothing is rejected: items that may not be drawn are left out of the total, and a number
at or beyond them moves up by what they take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.graph import checkpointed
from sparkloom.operators.ordering import least_by_hash, numbered, running_sum

HASH_BITS = 60


def hash60(key: Column) -> Column:
    """The first 60 bits of the MD5 of a string, as a number that any engine can compute."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def uniform_negatives(h: DataFrame, items: DataFrame, n: int = 3, salt: str = "neg") -> DataFrame:
    """(uid, j, iid): ``n`` draws with replacement, each even over the items (iid) that are not in the user's ``seen``;
    users who saw all items get none. ``seen`` may name items that do not exist."""
    vocab = checkpointed(numbered(items.select("iid").distinct(), ["iid"], "idx"))
    size = vocab.count()
    own = h.select("uid", F.explode(F.array_distinct("seen")).alias("iid")).join(vocab, "iid").groupBy("uid").agg(F.array_sort(F.collect_list("idx")).alias("_seen"))
    users = h.select("uid").join(own, "uid", "left").withColumn("_seen", F.coalesce("_seen", F.array().cast("array<bigint>"))).withColumn("_free", size - F.size("_seen")).where("_free > 0")
    draws = users.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(n))))
    u = F.pmod(hash60(F.concat_ws(":", "uid", F.lit(salt), F.col("j").cast("string"))), F.col("_free"))
    at = F.aggregate("_seen", u, lambda a, x: F.when(a >= x, a + 1).otherwise(a))
    return draws.select("uid", F.col("j").cast("long").alias("j"), at.alias("idx")).join(vocab, "idx").select("uid", "j", "iid")


def popularity_ranges(counts: DataFrame, power: float = 0.75, scale: int = 1000) -> DataFrame:
    """(iid, w, lo): whole weights of about ``scale`` x count^power, at least 1, and the sum of the weights before, by item."""
    own = counts.select("iid", F.greatest(F.round(scale * F.pow(F.col("cnt").cast("double"), F.lit(power))).cast("bigint"), F.lit(1)).alias("w"))
    return running_sum(own, ["iid"], "w", "lo", inclusive=False)


def popularity_negatives(keys: DataFrame, ranges: DataFrame, n: int = 5, salt: str = "pop") -> DataFrame:
    """(key, j, iid): ``n`` draws for each (key, target), in proportion to the weights of all items but the target.

    The item of a number is found by an equi-join: the total is cut into as many equal parts as there are items, and each
    item's range is written once for every part that it touches, at most twice the number of items in all. So a popular item
    is spread over many parts, and no part has more draws than its share of the total.
    """
    own = checkpointed(ranges)
    size, total = own.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    if not size:
        return keys.select("key", F.lit(0).cast("long").alias("j"), F.lit(None).cast("string").alias("iid")).limit(0)
    part = max(1, -(-total // size))
    target = own.select(F.col("iid").alias("target"), F.col("w").alias("_w"), F.col("lo").alias("_lo"))
    draws = keys.join(target, "target", "left").na.fill(0, ["_w"]).withColumn("_lo", F.coalesce("_lo", F.lit(total))).where(F.col("_w") < total)
    draws = draws.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(n))))
    u = F.pmod(hash60(F.concat_ws(":", F.col("key").cast("string"), F.lit(salt), F.col("j").cast("string"))), F.lit(total) - F.col("_w"))
    draws = draws.withColumn("_u", u).withColumn("_u", F.when(F.col("_u") >= F.col("_lo"), F.col("_u") + F.col("_w")).otherwise(F.col("_u"))).withColumn("_part", F.expr(f"_u div {part}"))
    cut = own.withColumn("_part", F.explode(F.sequence(F.expr(f"lo div {part}"), F.expr(f"(lo + w - 1) div {part}"))))
    return draws.join(cut, "_part").where("_u >= lo and _u < lo + w").select("key", F.col("j").cast("long").alias("j"), "iid")


def capped_prefixes(h: DataFrame, last: int = 48, extra: int = 10, long: int = 64, each: int = 36, longest: int = 50, cap: int = 850_000, salt: str = "prefix") -> DataFrame:
    """(uid, nth, pos, prefix, next): places of a history of which the item before them predict the next.

    The last ``last`` places, and of histories over ``long`` items ``extra`` more of all places, drawn without replacement (a
    place may then come twice); of these ``each`` a user, and of all ``cap``, by the least hash. Prefixes have ``longest``
    items at most. Nothing is sorted as a whole: the cap is found from histograms of the hash.
    """
    own = h.select("uid", "raw", F.size("raw").alias("_n")).where("_n > 1")
    mark = lambda kind, p: hash60(F.concat_ws(":", "uid", F.lit(salt), F.lit(kind), p.cast("string")))
    recent = F.transform(F.sequence(F.greatest(F.lit(1), F.col("_n") - last), F.col("_n") - 1), lambda p: F.struct(mark("a", p).alias("key"), F.lit(0).alias("nth"), p.alias("pos")))
    drawn = F.slice(F.array_sort(F.transform(F.sequence(F.lit(1), F.col("_n") - 1), lambda p: F.struct(mark("b", p).alias("key"), p.alias("pos")))), 1, extra)
    more = F.when(F.col("_n") > long, F.transform(drawn, lambda x: F.struct(mark("c", x["pos"]).alias("key"), F.lit(1).alias("nth"), x["pos"].alias("pos")))).otherwise(F.array().cast("array<struct<key:bigint,nth:int,pos:int>>"))
    places = own.withColumn("_p", F.explode(F.slice(F.array_sort(F.concat(recent, more)), 1, each)))
    rows = checkpointed(places.select("uid", F.col("_p.key").alias("_key"), F.col("_p.nth").cast("long").alias("nth"), F.col("_p.pos").cast("long").alias("pos")))
    kept = least_by_hash(rows, "_key", cap, ["uid", "nth", "pos"], HASH_BITS)
    both = kept.join(own.select("uid", "raw"), "uid")
    first = F.greatest(F.col("pos") - longest, F.lit(0))
    return both.select("uid", "nth", "pos", F.slice("raw", (first + 1).cast("int"), (F.col("pos") - first).cast("int")).alias("prefix"), F.get("raw", F.col("pos").cast("int")).alias("next"))

"""Ranked lists as arrays of ids: fills, caps, boosts and fusion. All but fusion work inside a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled(items: Column, fillers: Column, k: int = 10) -> Column:
    """The first ``k`` distinct items, then distinct fillers."""
    return F.slice(F.array_distinct(F.concat(items, fillers)), 1, k)


def without(items: Column, history: Column) -> Column:
    return F.filter(items, lambda x: ~F.array_contains(history, x))


def within(items: Column, history: Column) -> Column:
    return F.filter(items, lambda x: F.array_contains(history, x))


def part(items: Column, start: int, n: int | None = None) -> Column:
    """Items from place ``start`` (0 first) on, ``n`` of them at most."""
    return F.slice(items, F.lit(start + 1), F.lit(n) if n is not None else F.greatest(F.size(items) - start, F.lit(0)))


def history_capped(items: Column, history: Column, most: int) -> Column:
    """``items`` without those of the history after the first ``most`` of these."""
    kept = F.slice(within(items, history), 1, most)
    return F.filter(items, lambda x: ~F.array_contains(history, x) | F.array_contains(kept, x))


def balanced(items: Column, history: Column) -> Column:
    """Five new items, three seen ones, then the other new and the other seen ones."""
    new, seen = without(items, history), within(items, history)
    return F.concat(part(new, 0, 5), part(seen, 0, 3), part(new, 5), part(seen, 3))


def boosted(items: Column, group: Column, everyone: Column) -> Column:
    """The first five items, five of the group and ten of all, then the rest."""
    return F.concat(part(items, 0, 5), part(group, 0, 5), part(everyone, 0, 10), part(items, 5))


def cold(items: Column, history_len: Column, group: Column, everyone: Column, short: int = 2) -> Column:
    return F.when(history_len <= short, F.concat(group, everyone, items)).otherwise(items)


def fused(lists: list[tuple[DataFrame, float]], score, k: int = 10) -> DataFrame:
    """(uid, items): weighted sum of ``score(rank, n)`` over lists (uid, items); rank from 1, ties by id."""
    rows = None
    for df, weight in lists:
        own = df.select("uid", F.size("items").alias("n"), F.posexplode("items").alias("p", "iid")).select("uid", "iid", (F.lit(weight) * score(F.col("p") + 1, F.col("n"))).alias("s"))
        rows = own if rows is None else rows.unionByName(own)
    total = rows.groupBy("uid", "iid").agg(F.round(F.sum("s"), 9).alias("s"))
    return ranked(total, "s", k)


RECIPROCAL = lambda rank, n: 1.0 / rank
LINEAR = lambda rank, n: F.greatest(F.lit(0.0), (11.0 - rank) / 10.0)
PERCENTILE = lambda rank, n: 1.0 - (rank - 1) / F.greatest(n - 1, F.lit(1))


def ranked(scores: DataFrame, column: str, k: int) -> DataFrame:
    """(uid, items): the ``k`` best of each user, ties by id. Rows are cut before they are gathered."""
    order = Window.partitionBy("uid").orderBy(F.desc(column), "iid")
    top = scores.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return top.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "iid"))), lambda s: s["iid"]).alias("items"))


def diversified(lists: DataFrame, categories: DataFrame, k: int = 10, weight: float = 0.3) -> DataFrame:
    """Greedy choice of ``k``: the best of (items left - place among them - ``weight`` for each chosen item of the same
    category), ties to the earlier place. Lists of ``k`` items or fewer stay as they are."""
    cats = lists.select("uid", F.posexplode("items").alias("p", "iid")).join(categories.select("iid", F.col("cat").cast("string").alias("cat")), "iid", "left")
    rows = cats.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("p", "iid", "cat"))).alias("x"))
    x, n = F.col("x"), F.size("x")

    def choose(chosen, _):
        left = F.filter(x, lambda e: ~F.exists(chosen, lambda c: c["p"] == e["p"]))
        value = lambda e, i: (F.size(left) - i - weight * F.size(F.filter(chosen, lambda c: c["cat"].eqNullSafe(e["cat"])))).cast("double")
        scored = F.transform(left, lambda e, i: F.struct(F.round(value(e, i), 9).alias("s"), (-e["p"]).alias("q"), e["p"].alias("p"), e["iid"].alias("iid"), e["cat"].alias("cat")))
        return F.array_append(chosen, F.array_max(scored))

    none = F.expr("cast(array() as array<struct<s:double,q:int,p:int,iid:string,cat:string>>)")
    picked = F.aggregate(F.sequence(F.lit(1), F.lit(k)), none, choose)
    return rows.select("uid", F.transform(F.when(n <= k, F.transform(x, lambda e: e["iid"])).otherwise(F.transform(picked, lambda e: e["iid"])), lambda i: i).alias("items"))

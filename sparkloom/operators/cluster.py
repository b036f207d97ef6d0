"""K-means over tables (id, vec): parallel seeding, Lloyd rounds by partial sums, and lists of what a cluster's members chose.

Centres are k x width numbers and go to all tasks; rows stay where they are. A round sums each task's members by centre before
anything is shuffled, so a cluster with most of the rows costs no more than others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.functions.scalars import hash_bucket
from sparkloom.operators.graph import checkpointed

#: Bytes of centres that may be sent to every task.
MOST_BYTES = 64 << 20


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)[None, :]
    return np.maximum(d, 0.0)


def _sent(df: DataFrame, centres: np.ndarray):
    if centres.nbytes > MOST_BYTES:
        raise ValueError(f"centres of {centres.nbytes} bytes are too many to send to every task")
    return df.sparkSession.sparkContext.broadcast(centres)


def assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` (id, vec) with ``cluster`` and ``cost``, the squared distance; ties (to 9 places) go to the first centre."""
    sent = _sent(rows, centres)

    def run(batches):
        for part in batches:
            if len(part):
                d = distances(np.stack(part["vec"].to_numpy()).astype(np.float64), sent.value)
                c = np.round(d, 9).argmin(1)
                yield part.assign(cluster=c.astype(np.int64), cost=d[np.arange(len(c)), c])

    own = rows.select("id", F.col("vec").cast("array<double>").alias("vec"))
    return own.mapInPandas(run, StructType([*own.schema.fields]).add("cluster", "long").add("cost", "double"))


def lloyd(rows: DataFrame, centres: np.ndarray, rounds: int = 50, tolerance: float = 1e-9) -> np.ndarray:
    """Centres after rounds of assigning and averaging, until none moves by ``tolerance``; a centre without rows stays."""
    own = rows.select(F.col("vec").cast("array<double>").alias("vec"))
    for _ in range(rounds):
        sent = _sent(rows, centres)

        def run(batches, sent=sent):
            c = sent.value
            sums = np.zeros((len(c), c.shape[1] + 1))
            for part in batches:
                if len(part):
                    x = np.stack(part["vec"].to_numpy()).astype(np.float64)
                    at = np.round(distances(x, c), 9).argmin(1)
                    np.add.at(sums, at, np.hstack([x, np.ones((len(x), 1))]))
            live = np.flatnonzero(sums[:, -1])
            yield pd.DataFrame({"cluster": live, "sums": list(sums[live, :-1]), "n": sums[live, -1]})

        each = own.mapInPandas(run, "cluster long, sums array<double>, n double").select("cluster", F.posexplode("sums").alias("i", "v"), "n")
        got = each.groupBy("cluster", "i").agg((F.sum("v") / F.sum("n")).alias("v")).collect()  # k x width rows
        after = centres.copy()
        for r in got:
            after[r.cluster, r.i] = r.v
        moved = np.abs(after - centres).max(initial=0.0)
        centres = after
        if moved <= tolerance:
            break
    return centres


def hash_seeds(rows: DataFrame, k: int, salt: str = "seed") -> np.ndarray:
    """The vectors of the ``k`` ids with the least hash: seeds that another engine can name."""
    order = [F.md5(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string"))), "id"]
    return np.array([r.vec for r in rows.orderBy(*order).limit(k).collect()], np.float64)


def parallel_seeds(rows: DataFrame, k: int, rounds: int = 5, salt: str = "seed") -> np.ndarray:
    """Seeds by rounds of sampling: each row joins the candidates with a probability in proportion to its squared distance to
    them, about 2 k rows a round; then ``k`` are picked from these some 2 k x rounds by weight and distance on the driver.
    Draws are hashes of the id."""
    own = checkpointed(rows.select("id", F.col("vec").cast("array<double>").alias("vec")))
    chosen = hash_seeds(own, 1, salt)
    for t in range(rounds):
        at = assigned(own, chosen)
        total = at.agg(F.sum("cost")).first()[0] or 0.0
        if total <= 0:
            break
        u = (hash_bucket(F.concat(F.lit(f"{salt}:{t}:"), F.col("id").cast("string")), 1_000_003) + 0.5) / 1_000_003
        new = at.where(u < 2 * k * F.col("cost") / total).select("vec").limit(20 * k).collect()  # 2 k on the average
        chosen = np.unique(np.vstack([chosen, *(np.array([r.vec]) for r in new)]), axis=0)
    if len(chosen) <= k:
        return chosen
    weight = np.zeros(len(chosen))
    for r in assigned(own, chosen).groupBy("cluster").agg(F.count("*").alias("n")).collect():
        weight[r.cluster] = r.n
    draw = np.random.default_rng(0)
    picked = [int(weight.argmax())]
    near = distances(chosen, chosen[picked])[:, 0]
    while len(picked) < k:
        p = weight * near
        picked.append(int(draw.choice(len(chosen), p=p / p.sum())) if p.sum() > 0 else int(np.setdiff1d(np.arange(len(chosen)), picked)[0]))
        near = np.minimum(near, distances(chosen, chosen[picked[-1:]])[:, 0])
    return chosen[picked]


def coded(df: DataFrame, columns: list[str]) -> DataFrame:
    """Categories as numbers: the place of each value among a column's distinct values, in their order, from 0."""
    out = df
    for c in columns:
        codes = df.select(F.col(c).alias("_v")).distinct().withColumn(f"_{c}", F.row_number().over(Window.orderBy("_v")).cast("double") - 1)  # one row a category
        out = out.join(codes, F.col(c).eqNullSafe(F.col("_v"))).drop("_v")
    return out


def cluster_tops(members: DataFrame, chosen: DataFrame, n: int = 10) -> DataFrame:
    """(cluster, place, iid, cnt): the ``n`` targets that a cluster's members chose most often, ties by item."""
    counts = chosen.join(members.select("uid", "cluster"), "uid").groupBy("cluster", F.col("target").alias("iid")).agg(F.count("*").alias("cnt"))
    order = Window.partitionBy("cluster").orderBy(F.desc("cnt"), "iid")
    return counts.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= n)


def filled_lists(keys: DataFrame, key: str, lists: DataFrame, popular: DataFrame, n: int = 10) -> DataFrame:
    """(key, items): each key's list (key, place, iid), filled up to ``n`` from ``popular`` (place, iid), a list of n rows
    without the items that are there already. Keys without a list get the popular one."""
    own = keys.select(key).join(lists.select(key, F.lit(0).alias("_kind"), "place", "iid"), key)
    more = keys.select(key).distinct().join(F.broadcast(popular.where(F.col("place") <= n).select(F.lit(1).alias("_kind"), "place", "iid")))  # n rows
    first = own.unionByName(more).groupBy(key, "iid").agg(F.min(F.struct("_kind", "place")).alias("_at"))
    items = F.array_sort(F.collect_list(F.struct("_at", "iid")))
    return first.groupBy(key).agg(F.slice(F.transform(items, lambda x: x["iid"]), 1, n).alias("items"))

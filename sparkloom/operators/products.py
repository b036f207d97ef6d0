"""Scores of every user with every item: the top of inner products with seen items masked, and greedy boosts of classes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.graph import checkpointed
from sparkloom.operators.ordering import numbered

#: Vectors of a block of either side.
BLOCK = 2048


def top_products(users: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """(uid, iid, score, place): of each user (uid, vec, seen) the ``k`` items (iid, vec) with the largest inner product that
    are not in ``seen``; ties (to 9 places) by item. The contract of a masked full product, without all of it.

    Items are laid in blocks by falling length. No item of a block scores more than the user's length times the block's
    greatest, so a user who has ``k`` better ones is done. Rounds read 1, 2, 4, ... further blocks for the users that are
    left: their number grows with the logarithm of the number of blocks. ``report`` gets the pairs of user and block read.
    """
    x = F.col("vec").cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    laid = numbered(items.select("iid", x.alias("vec"), norm.alias("norm")), [F.desc("norm"), F.asc("iid")], "_at")
    laid = checkpointed(laid.withColumn("blk", F.expr(f"cast(_at div {block} as int)")).drop("_at"))
    heads = {r.blk: r.norm for r in laid.groupBy("blk").agg(F.max("norm").alias("norm")).collect()}  # a row a block
    own = checkpointed(users.select("uid", x.alias("vec"), F.coalesce("seen", F.array().cast("array<string>")).alias("seen"), norm.alias("len")))
    n_parts = max(1, -(-own.count() // block))
    kept = own.sparkSession.createDataFrame([], own.select("uid").schema.add("iid", "string").add("score", "double").add("place", "long"))
    left, at, width, read = own, 0, 1, 0
    schema = own.select("uid").schema.add("iid", "string").add("score", "double")

    def best(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"uid": one["uid"].iloc[:0], "iid": pd.Series([], dtype=object), "score": np.empty(0)})
        if len(one) and len(two):
            two = two.sort_values("iid", ignore_index=True)
            s = np.stack(one["vec"].to_numpy()) @ np.stack(two["vec"].to_numpy()).T
            place = {v: i for i, v in enumerate(two["iid"])}
            for i, seen in enumerate(one["seen"]):
                s[i, [place[v] for v in seen if v in place]] = -np.inf
            top = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(one)), top.shape[1])
            got = s[rows, top.ravel()]
            ok = np.isfinite(got)
            names = np.array(two["iid"].tolist(), object)  # plain strings: what pandas makes of them may come in chunks
            out = pd.DataFrame({"uid": one["uid"].to_numpy()[rows][ok], "iid": pd.Series(names[top.ravel()][ok], dtype=object), "score": got[ok]})
        return out

    order = Window.partitionBy("uid").orderBy(F.desc(F.round("score", 9)), "iid")
    while at < len(heads):
        blocks = list(range(at, min(at + width, len(heads))))
        read += left.count() * len(blocks) if report is not None else 0
        asked = left.select("uid", "vec", "seen", F.pmod(F.xxhash64("uid"), F.lit(n_parts)).cast("int").alias("part"), F.explode(F.array(*map(F.lit, blocks))).alias("blk"))
        some = laid.where(F.col("blk").between(blocks[0], blocks[-1])).select("iid", "vec", "blk", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"))
        found = asked.groupBy("part", "blk").cogroup(some.groupBy("part", "blk")).applyInPandas(best, schema)
        kept = checkpointed(kept.drop("place").unionByName(found).withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k))
        at, width = at + width, 2 * width
        if at < len(heads):
            worst = kept.groupBy("uid").agg(F.count("*").alias("_n"), F.min("score").alias("_least"))
            left = left.join(worst, "uid", "left").where(F.coalesce(F.col("_n") < k, F.lit(True)) | (F.col("_least") < F.col("len") * heads[at] + 1e-9)).drop("_n", "_least")
            left = checkpointed(left)
            if left.isEmpty():
                break
    if report is not None:
        report["read"], report["all"] = read, own.count() * len(heads)
    return kept


def greedy_boosts(p: DataFrame, truth: DataFrame, factors: tuple[float, ...] = (1.02, 1.05, 1.08, 1.1), rounds: int = 10) -> tuple[dict[int, float], DataFrame]:
    """Factors of classes by a greedy search, and (round, class, factor, hits, accuracy) of the state after each round.

    State is one factor a class, 1 at first. A round scores all moves of one class to another factor (or back to 1) by one
    aggregation: of each node only the best two boosted classes, the true one and the moved one matter, so a move changes a
    node's hit only where the moved class is or becomes the best. The move with the most hits is taken if it gains; ties go
    to the least class, then the least factor. Probabilities (node, class, p) are compared to 9 places, ties by class.
    """
    spark = p.sparkSession
    own = checkpointed(p.join(truth.select("node", "label"), "node").select("node", "label", "class", "p"))
    classes = sorted(r["class"] for r in own.select("class").distinct().collect())  # classes
    state = dict.fromkeys(classes, 1.0)
    history = []
    for turn in range(rounds + 1):
        now = F.create_map(*(x for c, b in state.items() for x in (F.lit(c), F.lit(b))))
        rows = own.withColumn("s", F.round(F.col("p") * now[F.col("class")], 9))
        ordered = F.reverse(F.array_sort(F.collect_list(F.struct("s", (-F.col("class")).alias("neg")))))
        nodes = rows.groupBy("node", "label").agg(F.slice(ordered, 1, 2).alias("top"), F.collect_list(F.struct("class", "p")).alias("all"))
        moves = F.array(*(F.struct(F.lit(c).alias("class"), F.lit(b).alias("factor")) for c in classes for b in (1.0, *factors) if b != state[c])) if turn else F.array(F.struct(F.lit(classes[0] if classes else 0).alias("class"), F.lit(1.0).alias("factor")))
        tried = nodes.select("label", "top", "all", F.explode(moves).alias("m"))
        mine = F.filter("all", lambda x: x["class"] == F.col("m.class"))
        s = F.round(F.get(mine, F.lit(0))["p"] * F.col("m.factor"), 9)
        # the best of the other classes is the first of the two that is not the moved one
        other = F.get(F.filter("top", lambda x: -x["neg"] != F.col("m.class")), F.lit(0))
        wins = F.size(mine).cast("boolean") & (other.isNull() | (s > other["s"]) | ((s == other["s"]) & (F.col("m.class") < -other["neg"])))
        pred = F.when(wins, F.col("m.class")).otherwise(-other["neg"])
        hits = tried.groupBy("m.class", "m.factor").agg(F.sum((pred == F.col("label")).cast("long")).alias("hits"), F.count("*").alias("n")).collect()
        if not hits:
            break
        best = min(hits, key=lambda r: (-r.hits, r["class"], r.factor))
        if turn and best.hits <= history[-1][3]:
            break
        if turn:
            state[best["class"]] = best.factor
        history.append((turn, best["class"] if turn else None, best.factor if turn else None, best.hits, best.hits / best.n))
    return state, spark.createDataFrame(history, "round long, class long, factor double, hits long, accuracy double")

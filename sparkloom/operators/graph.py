"""Graph operators over edge tables (src, dst) and node tables (node, ...).

Iterations are joins and aggregations over DataFrames; state is checkpointed every few rounds so that plans stay small
and lost executors only repeat what came after the last checkpoint. Nodes without edges stay through left joins.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVERY = 4
#: Vectors of a block: a pair of blocks is compared by one matrix product.
BLOCK = 2048


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder of spark.checkpoint.dir; without that setting only a local session gets a folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    # A checkpoint keeps the constraints of its plan, which Spark can't always carry over to a self-union of it.
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(key, before)


def symmetric(edges: DataFrame, loops: bool = True) -> DataFrame:
    """Every edge in both directions, once; self-loops stay unless ``loops`` is false."""
    own = edges.select("src", "dst")
    out = own.union(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return out if loops else out.where("src <> dst")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, out_deg, in_deg, deg): of distinct edges, and of the symmetric graph."""
    e = edges.select("src", "dst").distinct()
    count = lambda df, key, name: df.groupBy(F.col(key).alias("node")).agg(F.count("*").alias(name))
    out = nodes.select("node")
    for part in (count(e, "src", "out_deg"), count(e, "dst", "in_deg"), count(symmetric(e), "src", "deg")):
        out = out.join(part, "node", "left")
    return out.na.fill(0)


def degree_block(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees with their logs, flags of zeros, the share of out-edges and the gap between the directions."""
    d = degrees(nodes, edges)
    zero = lambda c: (F.col(c) == 0).cast("long")
    return d.withColumns({"log_out": F.log1p("out_deg"), "log_in": F.log1p("in_deg"), "log_deg": F.log1p("deg"), "no_out": zero("out_deg"), "no_in": zero("in_deg"), "isolated": zero("deg"), "out_share": F.col("out_deg") / F.greatest("deg", F.lit(1)), "gap": F.abs(F.col("in_deg") - F.col("out_deg"))})


def normalized(nodes: DataFrame, edges: DataFrame, mode: str = "sym") -> DataFrame:
    """(src, dst, w) of A + I: ``sym`` w / sqrt(d_i d_j), ``row`` w / d_i. A node with a self-loop has weight 2 on it."""
    own = symmetric(edges).withColumn("w", F.lit(1.0)).union(nodes.select("node", "node", F.lit(1.0)))
    w = own.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    d = w.groupBy("src").agg(F.sum("w").alias("d"))
    out = w.join(d, "src")
    if mode == "row":
        return out.select("src", "dst", (F.col("w") / F.col("d")).alias("w"))
    return out.join(d.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("w"))


def spread(weights: DataFrame, state: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Matrix times vectors: for each node the weighted sum of its neighbours' values."""
    return weights.join(state.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), *keys).agg(F.sum(F.col("w") * F.col(value)).alias(value))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 10, alpha: float = 0.15) -> DataFrame:
    """(node, rank) on the symmetric graph; the mass of nodes without edges is lost."""
    sym = symmetric(edges)
    deg = sym.groupBy("src").agg(F.count("*").alias("d"))
    w = checkpointed(sym.join(deg.withColumnRenamed("src", "dst"), "dst").select("src", "dst", (1.0 / F.col("d")).alias("w")))
    n = nodes.count()
    state = nodes.select("node", F.lit(1.0 / max(n, 1)).alias("v"))
    for k in range(rounds):
        got = spread(w, state, [])
        state = nodes.select("node").join(got, "node", "left").select("node", (F.lit(alpha / max(n, 1)) + (1 - alpha) * F.coalesce("v", F.lit(0.0))).alias("v"))
        if k % EVERY == EVERY - 1:
            state = checkpointed(state)
    return state.withColumnRenamed("v", "rank")


def second_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, hop2): the sum of the neighbours' degrees."""
    sym = symmetric(edges)
    deg = sym.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("d"))
    got = sym.join(deg, "dst").groupBy(F.col("src").alias("node")).agg(F.sum("d").alias("hop2"))
    return nodes.select("node").join(got, "node", "left").na.fill(0)


def one_hot(seeds: DataFrame, classes: DataFrame, eps: float = 0.0, n_classes: int | None = None) -> DataFrame:
    """(node, class, v) of labelled nodes; ``classes`` is a small table."""
    own = seeds.join(F.broadcast(classes))
    low = eps / (n_classes - 1) if eps and n_classes else 0.0
    return own.select("node", "class", F.when(F.col("label") == F.col("class"), 1.0 - eps).otherwise(low).alias("v"))


def label_propagation(nodes: DataFrame, weights: DataFrame, seeds: DataFrame, classes: DataFrame, rounds: int = 5, alpha: float = 0.5, mode: str = "plain", eps: float = 0.0, tolerance: float | None = None, rescale: bool = False) -> DataFrame:
    """(node, class, v). ``plain``: (1 - a) T y + a y0, other nodes start even; ``clamped``: T y with seeds reset;
    ``ppr``: a y0 + (1 - a) T y, 0 elsewhere; ``lgc``: a T y + (1 - a) y0. Rows are rescaled to
    sum to 1 only with ``rescale``. ``damped`` is clamped with (1 - a) T y + a y0 at other nodes. ``eps`` of a seed's mass
    goes to its other classes. With ``tolerance`` rounds end once no value moves by that much."""
    n = classes.count()
    grid = nodes.select("node").join(F.broadcast(classes))  # a row for each node and class
    given = one_hot(seeds, classes, eps, n).withColumnRenamed("v", "y0")
    start = F.lit(1.0 / n) if mode in ("plain", "clamped", "damped") else F.lit(0.0)
    base = checkpointed(grid.join(given, ["node", "class"], "left").select("node", "class", F.coalesce("y0", start).alias("y0"), F.col("y0").isNotNull().alias("seed")))
    w = checkpointed(weights)
    state = base.select("node", "class", F.col("y0").alias("v"))
    for k in range(rounds):
        got = base.join(spread(w, state, ["class"]), ["node", "class"], "left")
        v, y = F.coalesce("v", F.lit(0.0)), F.col("y0")
        new = {"plain": (1 - alpha) * v + alpha * y, "clamped": F.when(F.col("seed"), y).otherwise(v), "damped": F.when(F.col("seed"), y).otherwise((1 - alpha) * v + alpha * y), "ppr": alpha * y + (1 - alpha) * v, "lgc": alpha * v + (1 - alpha) * y}[mode]
        after = got.select("node", "class", new.alias("v"))
        if tolerance is not None:
            after = checkpointed(after)
            moved = after.join(state.withColumnRenamed("v", "_old"), ["node", "class"]).agg(F.max(F.abs(F.col("v") - F.col("_old")))).first()[0]
            state = after
            if moved is None or moved < tolerance:
                break
        else:
            state = checkpointed(after) if k % EVERY == EVERY - 1 else after
    if rescale:
        total = F.sum("v").over(Window.partitionBy("node"))
        state = state.withColumn("v", F.col("v") / F.when(total == 0, 1.0).otherwise(total))
    return state


def correct_and_smooth(nodes: DataFrame, weights: DataFrame, probs: DataFrame, seeds: DataFrame, rounds: int = 5, alpha: float = 0.8, beta: float = 1.0) -> DataFrame:
    """(node, class, p): spread the seeds' residuals, add ``beta`` times them, reset seeds, spread, clip and rescale."""
    w, base = checkpointed(weights), checkpointed(probs)
    truth = base.select("node", "class").join(seeds, "node").select("node", "class", (F.col("label") == F.col("class")).cast("double").alias("y"))
    start = checkpointed(base.join(truth, ["node", "class"], "left").select("node", "class", "p", "y", F.coalesce(F.col("y") - F.col("p"), F.lit(0.0)).alias("v0")))

    def smooth(first: DataFrame) -> DataFrame:
        state = first.select("node", "class", F.col("v0").alias("v"))
        for k in range(rounds):
            got = first.join(spread(w, state, ["class"]), ["node", "class"], "left")
            state = got.select("node", "class", (alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.col("v0")).alias("v"))
            if k % EVERY == EVERY - 1:
                state = checkpointed(state)
        return state

    error = smooth(start)
    fixed = checkpointed(start.select("node", "class", "p", "y").join(error, ["node", "class"]).select("node", "class", F.coalesce("y", F.col("p") + beta * F.col("v")).alias("v0")))
    out = smooth(fixed).withColumn("v", F.least(F.greatest(F.col("v"), F.lit(1e-9)), F.lit(1.0)))
    return out.withColumn("p", F.col("v") / F.sum("v").over(Window.partitionBy("node"))).drop("v")


def directional_posterior(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, classes: DataFrame, prior: float = 1.0) -> DataFrame:
    """(node, class, p_out, p_in, mass_out, mass_in): labels of out- and in-neighbours with a Laplace prior."""
    n = classes.count()
    out = nodes.select("node").join(F.broadcast(classes))
    for name, a, b in (("out", "src", "dst"), ("in", "dst", "src")):
        e = edges.select("src", "dst").where("src <> dst").distinct().select(F.col(a).alias("node"), F.col(b).alias("other"))
        got = e.join(seeds.select(F.col("node").alias("other"), F.col("label").alias("class")), "other")
        count, mass = got.groupBy("node", "class").agg(F.count("*").alias("c")), got.groupBy("node").agg(F.count("*").alias(f"mass_{name}"))
        out = out.join(count, ["node", "class"], "left").join(mass, "node", "left").na.fill(0, [f"mass_{name}", "c"])
        out = out.withColumn(f"p_{name}", (F.col("c") + prior / n) / (F.col(f"mass_{name}") + prior)).drop("c")
    return out


def weighted_onehop(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, classes: DataFrame, strength: float = 2.0) -> DataFrame:
    """(node, class, p): posteriors of out- and in-neighbours (Laplace prior of the seeds), mixed by weight.

    A direction weighs quality * sqrt(mass) * (0.25 + margin): how far its classes beat the most frequent one on the seeds
    that it covers (0.01 at least), the labelled neighbours it has, and how far its first class leads. Nodes that neither
    direction covers keep the prior; self-loops count for nothing."""
    prior = classes.join(seeds.groupBy(F.col("label").alias("class")).agg(F.count("*").alias("n")), "class", "left").na.fill(0)
    every = Window.partitionBy()  # one row a class
    prior = checkpointed(prior.select("class", ((F.col("n") + 1) / (F.sum("n").over(every) + F.count("*").over(every))).alias("prior")))
    base = prior.agg(F.max("prior")).first()[0]
    if base is None:
        return nodes.select("node", F.lit(None).cast("long").alias("class"), F.lit(None).cast("double").alias("p")).limit(0)
    grid = nodes.select("node").join(F.broadcast(prior))  # a row for each node and class
    own, both = edges.select("src", "dst").where("src <> dst").distinct(), None
    for a, b in (("src", "dst"), ("dst", "src")):
        got = own.select(F.col(a).alias("node"), F.col(b).alias("other")).join(seeds.select(F.col("node").alias("other"), F.col("label").alias("class")), "other")
        rows = grid.join(got.groupBy("node", "class").agg(F.count("*").alias("c")), ["node", "class"], "left").na.fill(0, ["c"])
        rows = rows.withColumn("m", F.sum("c").over(Window.partitionBy("node")))
        rows = checkpointed(rows.withColumn("p", (F.col("c") + strength * F.col("prior")) / (F.col("m") + strength)))
        first = F.reverse(F.array_sort(F.collect_list(F.struct(F.round("p", 9).alias("r"), (-F.col("class")).alias("neg"), "p"))))
        best = rows.groupBy("node").agg(F.max("m").alias("m"), first.alias("_t")).select("node", "m", (-F.col("_t")[0]["neg"]).alias("pred"), (F.col("_t")[0]["p"] - F.coalesce(F.get("_t", F.lit(1))["p"], F.lit(0.0))).alias("margin"))
        right = best.where("m > 0").join(seeds, "node").agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
        quality = max((right if right is not None else base) - base, 0.01)
        one = rows.join(best.select("node", (quality * F.sqrt("m") * (0.25 + F.col("margin"))).alias("w")), "node").select("node", "class", "prior", "p", "w")
        both = one if both is None else both.unionByName(one)
    mix = both.groupBy("node", "class").agg(F.sum(F.col("w") * F.col("p")).alias("s"), F.sum("w").alias("w"), F.max("prior").alias("prior"))
    v = F.least(F.greatest(F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(F.col("prior")), F.lit(1e-9)), F.lit(1.0))
    return mix.select("node", "class", v.alias("v")).withColumn("p", F.col("v") / F.sum("v").over(Window.partitionBy("node"))).drop("v")


def label_blocks(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, classes: DataFrame, hops: int = 2, strength: float = 1.0) -> DataFrame:
    """(node, view, hop, class, p, mass) for the out, in and symmetric views without self-loops.

    Hop k spreads row-normalised labels k times; p = (mass * share + strength * prior) / (mass + strength).
    """
    e = edges.select("src", "dst").where("src <> dst").distinct()
    views = {"out": e, "in": e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "sym": symmetric(e)}
    prior = seeds.groupBy(F.col("label").alias("class")).agg(F.count("*").alias("n"))
    prior = F.broadcast(classes.join(prior, "class", "left").select("class", (F.coalesce("n", F.lit(0)) / F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1))).alias("prior")))
    grid = nodes.select("node").join(prior)
    result = None
    for view, own in views.items():
        d = own.groupBy("src").agg(F.count("*").alias("d"))
        w = checkpointed(own.join(d, "src").select("src", "dst", (1.0 / F.col("d")).alias("w")))
        state = seeds.select("node", F.col("label").alias("class"), F.lit(1.0).alias("v"))
        for hop in range(1, hops + 1):
            state = checkpointed(spread(w, state, ["class"]))
            mass = state.groupBy("node").agg(F.sum("v").alias("mass"))
            rows = grid.join(state, ["node", "class"], "left").join(mass, "node", "left").na.fill(0.0, ["v", "mass"])
            rows = rows.select("node", F.lit(view).alias("view"), F.lit(hop).cast("long").alias("hop"), "class", ((F.col("v") + strength * F.col("prior")) / (F.col("mass") + strength)).alias("p"), "mass")
            result = rows if result is None else result.unionByName(rows)
    return result


def crossfit_label_blocks(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, classes: DataFrame, folds: int = 3, **options) -> DataFrame:
    """Label blocks in which a seed's own fold gives no labels; ``seeds`` has a column fold."""
    out = None
    for f in range(folds):
        own = label_blocks(nodes, edges, seeds.where(F.col("fold") != f), classes, **options)
        own = own.join(seeds.where(F.col("fold") == f).select("node"), "node", "left_semi")
        out = own if out is None else out.unionByName(own)
    return out


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component, size): the least node of each undirected component, by alternating star contraction.

    Rounds go on until nothing changes; their number grows with the logarithm of the longest path."""
    now = checkpointed(symmetric(edges, loops=False).where("src > dst").select(F.col("src").alias("u"), F.col("dst").alias("v")))
    done = False
    while not done:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after = checkpointed(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        mark = (F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("x"))
        done = now.agg(*mark).first() == after.agg(*mark).first()
        now = after
    root = now.groupBy("u").agg(F.min("v").alias("root"))
    out = nodes.select("node").join(root.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
    return out.join(out.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", "component", "size")


def most_similar(asked: DataFrame, known: DataFrame, k: int, itself: bool = True, block: int = BLOCK) -> DataFrame:
    """(node, other, sim): the ``k`` rows of ``known`` (node, vec) with the highest cosine to each of ``asked``, ties by id.

    A stated query set against all rows, in blocks: a pair of blocks of about ``block`` vectors is one matrix product in
    one task, which gives ``k`` rows a query on; those of all pairs are merged. Vectors of length 0 have similarity 0.
    """
    n_asked, n_known = (max(1, -(-df.count() // block)) for df in (asked, known))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")
    vec = F.col("vec").cast("array<double>")
    left = asked.select(F.col("node").cast("long").alias("x"), vec.alias("xv"), own(n_asked).alias("xa"), every(n_known).alias("xb"))
    right = known.select(F.col("node").cast("long").alias("y"), vec.alias("yv"), every(n_asked).alias("ya"), own(n_known).alias("yb"))

    def best(one, two):
        import numpy as np
        import pandas as pd

        two = two.sort_values("y", ignore_index=True)
        out = {"node": np.empty(0, np.int64), "other": np.empty(0, np.int64), "sim": np.empty(0)}
        if len(one) and len(two):
            x, y = np.stack(one["xv"].to_numpy()), np.stack(two["yv"].to_numpy())
            for m in (x, y):
                size = np.sqrt((m * m).sum(axis=1, keepdims=True))
                m /= np.where(size == 0, 1.0, size)
            sim = x @ y.T
            ids, nodes = two["y"].to_numpy(), one["x"].to_numpy()
            if not itself:
                sim[nodes[:, None] == ids[None, :]] = -np.inf
            at = np.argsort(-np.round(sim, 9), axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(nodes)), at.shape[1])
            got = sim[rows, at.ravel()]
            ok = np.isfinite(got)
            out = {"node": nodes[rows][ok], "other": ids[at.ravel()][ok], "sim": got[ok]}
        return pd.DataFrame(out)

    found = left.groupBy("xa", "xb").cogroup(right.groupBy("ya", "yb")).applyInPandas(best, "node long, other long, sim double")
    order = Window.partitionBy("node").orderBy(F.desc(F.round("sim", 9)), "other")
    return found.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)


def knn_votes(vectors: DataFrame, seeds: DataFrame, ks: tuple[int, ...] = (5, 10), nearest=most_similar) -> DataFrame:
    """(node, k, class, vote): positive cosine similarities of the k most similar seeds, summed by class and rescaled.

    Nodes that are seeds count themselves. ``nearest`` finds the seeds: ``neighbours.nearest`` for large tables.
    """
    top = nearest(vectors, vectors.join(seeds.select("node"), "node", "left_semi"), max(ks))
    rows = top.join(seeds.select(F.col("node").alias("other"), "label"), "other")
    rows = rows.select("node", "label", "sim", "place", F.explode(F.array(*(F.lit(k).cast("long") for k in ks))).alias("k")).where("place <= k and sim > 0")
    votes = rows.groupBy("node", "k", F.col("label").alias("class")).agg(F.sum("sim").alias("s"))
    return votes.withColumn("vote", F.col("s") / F.sum("s").over(Window.partitionBy("node", "k"))).drop("s")


def neighbour_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, out_train, out_test, in_train, in_test): neighbours by split; ``nodes`` has a column split."""
    e = edges.select("src", "dst").distinct()
    out = nodes.select("node")
    for name, a, b in (("out", "src", "dst"), ("in", "dst", "src")):
        got = e.join(nodes.select(F.col("node").alias(b), "split"), b).groupBy(F.col(a).alias("node"))
        out = out.join(got.agg(*(F.sum((F.col("split") == s).cast("long")).alias(f"{name}_{s}") for s in ("train", "test"))), "node", "left")
    return out.na.fill(0)


def profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean degree, self-loops, reciprocal share, isolated share."""
    e = edges.select("src", "dst").distinct()
    back = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("r")), ["src", "dst"], "left")
    a = back.agg(F.count("*").alias("n_edges"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("n_loops"), F.avg(F.coalesce("r", F.lit(0)).cast("double")).alias("reciprocal"))
    d = degrees(nodes, e).agg(F.count("*").alias("n_nodes"), F.avg("deg").alias("mean_deg"), F.max("deg").alias("max_deg"), F.avg((F.col("deg") == 0).cast("double")).alias("isolated"))
    return d.join(a).withColumn("density", F.col("n_edges") / (F.col("n_nodes") * F.col("n_nodes")))  # one row each


def scaled_attributes(attrs: DataFrame, mode: str = "row") -> DataFrame:
    """(node, dim, v) scaled: ``row`` sums to 1, ``l2`` has length 1, ``binary`` is 1, ``standard`` by dimension, ``none``.

    ``standard`` uses the mean and deviation of the values that are there; a deviation below 1e-6 counts as 1.
    """
    if mode == "none":
        return attrs
    if mode == "binary":
        return attrs.withColumn("v", (F.col("v") != 0).cast("double"))
    if mode == "standard":
        s = attrs.groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        return attrs.join(s, "dim").select("node", "dim", ((F.col("v") - F.col("m")) / F.when(F.col("s") < 1e-6, 1.0).otherwise(F.col("s"))).alias("v"))
    size = F.sum("v") if mode == "row" else F.sqrt(F.sum(F.col("v") * F.col("v")))
    s = attrs.groupBy("node").agg(size.alias("s"))
    return attrs.join(s, "node").select("node", "dim", F.coalesce(F.try_divide("v", "s"), F.lit(0.0)).alias("v"))

"""Blends of class probabilities, stacking features, routing, and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.scalars import hash_bucket
from sparkloom.operators.ordering import mean_ranks


def summaries(p: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, confidence, margin, entropy, pred): the best class, ties to the lowest."""
    order = F.sort_array(F.collect_list("p"), asc=False)
    out = p.groupBy(*keys).agg(order.alias("o"), F.sum(F.when(F.col("p") > 0, -F.col("p") * F.ln("p")).otherwise(0.0)).alias("entropy"), F.max_by("class", F.struct("p", -F.col("class"))).alias("pred"))
    return out.select(*keys, F.get("o", F.lit(0)).alias("confidence"), (F.get("o", F.lit(0)) - F.coalesce(F.get("o", F.lit(1)), F.lit(0.0))).alias("margin"), "entropy", "pred")


def stacked(p: DataFrame, models: list[str], classes: list[int]) -> DataFrame:
    """One row a node: p and ln p of each model and class, and each model's maximum and entropy."""
    out = []
    for m in models:
        here = F.col("model") == m
        for c in classes:
            own = F.max(F.when(here & (F.col("class") == c), F.col("p")))
            out += [own.alias(f"{m}_p{c}"), F.ln(F.greatest(own, F.lit(1e-9))).alias(f"{m}_l{c}")]
        out += [F.max(F.when(here, F.col("p"))).alias(f"{m}_max"), F.sum(F.when(here & (F.col("p") > 0), -F.col("p") * F.ln("p")).otherwise(0.0)).alias(f"{m}_entropy")]
    return p.groupBy("node").agg(*out)


def blended(p: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(node, class, p): weighted sum over models, clipped to [1e-9, 1] and rescaled."""
    w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    s = p.groupBy("node", "class").agg(F.sum(F.col("p") * F.coalesce(F.try_element_at(w, F.col("model")), F.lit(0.0))).alias("s"))
    s = s.withColumn("s", F.least(F.greatest("s", F.lit(1e-9)), F.lit(1.0)))
    return s.select("node", "class", (F.col("s") / F.sum("s").over(Window.partitionBy("node"))).alias("p"))


def mixed_grid(a: DataFrame, b: DataFrame, truth: DataFrame, steps: int = 20, cap: float = 0.65) -> DataFrame:
    """(gamma, n, accuracy) of (1 - gamma) a + gamma b, gamma from 0 to ``cap`` in ``steps`` steps."""
    both = a.join(b.withColumnRenamed("p", "q"), ["node", "class"])
    rows = both.select("node", "class", "p", "q", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    rows = rows.withColumn("s", F.round((1 - F.col("step") * cap / steps) * F.col("p") + F.col("step") * cap / steps * F.col("q"), 9))
    best = rows.groupBy("step", "node").agg(F.max_by("class", F.struct("s", -F.col("class"))).alias("pred")).join(truth, "node")
    return best.groupBy("step").agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy")).withColumn("gamma", F.col("step") * cap / steps)


def degree_weight(d, median, std, kind: str = "sigmoid"):
    """Weight of the graph model by a node's degree: a sigmoid or a clipped line around the median."""
    x = (d - median) / F.greatest(std, F.lit(1.0))
    return 1 / (1 + F.exp(-x)) if kind == "sigmoid" else F.least(F.greatest(0.5 + x / 2, F.lit(0.0)), F.lit(1.0))


def degree_fused(a: DataFrame, b: DataFrame, deg: DataFrame, kind: str) -> DataFrame:
    stat = deg.agg(F.percentile("deg", F.lit(0.5)).alias("med"), F.stddev_pop("deg").alias("std"))
    w = deg.join(F.broadcast(stat)).select("node", degree_weight(F.col("deg"), F.col("med"), F.col("std"), kind).alias("w"))  # one row
    return a.join(b.withColumnRenamed("p", "q"), ["node", "class"]).join(w, "node").select("node", "class", (F.col("w") * F.col("q") + (1 - F.col("w")) * F.col("p")).alias("p"))


def routed(rows: DataFrame, threshold: float = 0.65) -> DataFrame:
    """``base`` replaced by ``graph`` only where they differ, the node is covered and the selector is sure enough."""
    go = (F.col("base") != F.col("graph")) & F.col("covered") & (F.col("p") >= threshold)
    return rows.withColumn("selected", go).withColumn("final", F.when(go, F.col("graph")).otherwise(F.col("base")))


def routing_report(rows: DataFrame) -> DataFrame:
    """By fold: selected, corrected, worsened and net changes of ``routed`` rows with label and fold."""
    sel = F.col("selected")
    good, bad = sel & (F.col("graph") == F.col("label")), sel & (F.col("base") == F.col("label"))
    out = rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum(sel.cast("long")).alias("selected"), F.sum(good.cast("long")).alias("corrected"), F.sum(bad.cast("long")).alias("worsened"))
    return out.withColumn("net", F.col("corrected") - F.col("worsened"))


def class_scores(rows: DataFrame) -> DataFrame:
    """(class, support, predicted, hits, precision, recall, f1) of (label, pred), all classes that occur."""
    both = rows.select(F.explode(F.array(F.struct(F.col("label").alias("class"), F.lit(1).alias("a"), F.lit(0).alias("b"), (F.col("label") == F.col("pred")).cast("int").alias("h")), F.struct(F.col("pred").alias("class"), F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit(0).alias("h")))).alias("x")).select("x.*")
    out = both.groupBy("class").agg(F.sum("a").alias("support"), F.sum("b").alias("predicted"), F.sum("h").alias("hits"))
    out = out.withColumns({"precision": F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0)), "recall": F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))})
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def bucket_accuracy(rows: DataFrame) -> DataFrame:
    """(bucket, n, accuracy) of covered and uncovered nodes and of degrees 0, 1, 2-3 and 4+."""
    d = F.col("deg")
    degree = F.when(d == 0, "deg_0").when(d == 1, "deg_1").when(d <= 3, "deg_2_3").otherwise("deg_4_plus")
    b = F.explode(F.array(F.when(F.col("covered"), "covered").otherwise("uncovered"), degree)).alias("bucket")
    return rows.select(b, (F.col("label") == F.col("pred")).cast("double").alias("ok")).groupBy("bucket").agg(F.count("*").alias("n"), F.avg("ok").alias("accuracy"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of mean ranks, of rows that have both values."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return mean_ranks(mean_ranks(both, a, "_ra"), b, "_rb").agg(F.corr("_ra", "_rb").alias("spearman"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by the rank sum of positives."""
    r = mean_ranks(df.where(F.col(score).isNotNull()), score, "_r")
    s = r.agg(F.sum(F.when(F.col(label) == 1, F.col("_r"))).alias("s"), F.sum((F.col(label) == 1).cast("double")).alias("p"), F.sum((F.col(label) == 0).cast("double")).alias("n"))
    return s.select(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("n")).alias("auc"))


def order_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """(pairs, agree): pairs of a small table of variants ordered alike by both scores."""
    x, y = df.select(F.col("variant").alias("v"), F.col(a).alias("a"), F.col(b).alias("b")), df.select(F.col("variant").alias("w"), F.col(a).alias("c"), F.col(b).alias("d"))
    pairs = x.join(y, F.col("v") < F.col("w"))
    return pairs.agg(F.count("*").alias("pairs"), F.sum((F.signum(F.col("a") - F.col("c")) == F.signum(F.col("b") - F.col("d"))).cast("long")).alias("agree"))


def class_weights(labels: DataFrame) -> DataFrame:
    """(label, n, balanced, sqrt_balanced, effective): sqrt is capped at 5, effective uses beta 0.9999 and sums to C."""
    c = labels.groupBy("label").agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # one row a class
    total, k = F.sum("n").over(every), F.count("*").over(every)
    eff = (1 - 0.9999) / (1 - F.pow(F.lit(0.9999), "n"))
    return c.select("label", "n", (total / (k * F.col("n"))).alias("balanced"), F.least(F.sqrt(total / (k * F.col("n"))), F.lit(5.0)).alias("sqrt_balanced"), (eff / F.sum(eff).over(every) * k).alias("effective"))


def expert_mix(p: DataFrame, experts: list[str], fallback: str, covered: DataFrame) -> DataFrame:
    """(node, class, p): the mean of the experts for covered nodes, the fallback's value for others."""
    s = p.groupBy("node", "class").agg(F.avg(F.when(F.col("model").isin(experts), F.col("p"))).alias("m"), F.max(F.when(F.col("model") == fallback, F.col("p"))).alias("f"))
    s = s.join(covered.select("node").distinct().withColumn("_c", F.lit(True)), "node", "left")
    return s.select("node", "class", F.when(F.col("_c"), F.col("m")).otherwise(F.col("f")).alias("p"))


def simplex_draws(spark, models: list[str], draws: int, salt: str = "draw") -> DataFrame:
    """(draw, model, w): even draws from the simplex (rescaled exponentials of hashes), then each model alone."""
    u = (hash_bucket(F.concat(F.lit(f"{salt}:"), "draw", F.lit(":"), "model"), 100_000) + 0.5) / 100_000
    names = F.explode(F.array(*map(F.lit, models))).alias("model")
    e = spark.range(draws).select(F.col("id").alias("draw"), names).withColumn("e", -F.ln(u))
    drawn = e.select("draw", "model", (F.col("e") / F.sum("e").over(Window.partitionBy("draw"))).alias("w"))
    alone = F.explode(F.array(*(F.struct(F.lit(draws + i).cast("long").alias("draw"), F.lit(m).alias("model"), F.lit(1.0).alias("w")) for i, m in enumerate(models)))).alias("x")
    return drawn.unionByName(spark.range(1).select(alone).select("x.*"))


def weight_search(p: DataFrame, truth: DataFrame, models: list[str], draws: int = 30) -> DataFrame:
    """(draw, accuracy, weights) of ``simplex_draws``; all are scored by one grouped aggregation."""
    grid = simplex_draws(p.sparkSession, models, draws)
    s = p.join(F.broadcast(grid), "model").groupBy("draw", "node", "class").agg(F.round(F.sum(F.col("w") * F.col("p")), 9).alias("s"))  # draws x models
    best = s.groupBy("draw", "node").agg(F.max_by("class", F.struct("s", -F.col("class"))).alias("pred")).join(truth, "node")
    score = best.groupBy("draw").agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))
    return score.join(grid.groupBy("draw").agg(F.map_from_entries(F.collect_list(F.struct("model", "w"))).alias("weights")), "draw")


def temperature_grid(p: DataFrame, truth: DataFrame, temperatures: tuple[float, ...] = (0.6, 0.8, 1.0, 1.25, 1.6)) -> DataFrame:
    """(temperature, accuracy, log_loss) of probabilities raised to 1 / temperature and rescaled, all by one pass."""
    t = F.explode(F.array(*map(F.lit, temperatures))).alias("temperature")
    rows = p.join(truth.select("node", "label"), "node").select("node", "label", "class", F.greatest("p", F.lit(1e-12)).alias("p"), t)
    rows = rows.withColumn("s", F.pow("p", 1 / F.col("temperature")))
    by = rows.groupBy("temperature", "node", "label").agg(F.sum("s").alias("all"), F.max(F.when(F.col("class") == F.col("label"), F.col("s"))).alias("own"), F.max_by("class", F.struct(F.round("p", 9), -F.col("class"))).alias("pred"))
    loss = -F.ln(F.greatest(F.coalesce(F.col("own") / F.col("all"), F.lit(0.0)), F.lit(1e-12)))
    return by.groupBy("temperature").agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"), F.avg(loss).alias("log_loss"))


def scattered(nodes: DataFrame, classes: DataFrame, p: DataFrame) -> DataFrame:
    """(node, class, p): every class of every node, 0 where ``p`` has none; rows are rescaled if their sum is not 0."""
    grid = nodes.select("node").join(F.broadcast(classes))  # a row for each node and class
    out = grid.join(p.select("node", "class", "p"), ["node", "class"], "left").na.fill(0.0, ["p"])
    total = F.sum("p").over(Window.partitionBy("node"))
    return out.select("node", "class", (F.col("p") / F.when(total == 0, 1.0).otherwise(total)).alias("p"))


#: Fixed shares of the first model in a blend of two.
SHARES = {"a_only": 1.0, "b_only": 0.0, "average": 0.5, "a_heavy": 0.7, "b_heavy": 0.3, "a_vheavy": 0.8, "b_0208": 0.2, "b_0109": 0.1, "b_025": 0.25, "b_035": 0.35, "b_040": 0.4}


def strategy_scores(a: DataFrame, b: DataFrame, deg: DataFrame, truth: DataFrame) -> DataFrame:
    """(strategy, accuracy) of fixed shares and of shares that follow a node's degree; all by one grouped aggregation."""
    stat = deg.agg(F.percentile("deg", F.lit(0.5)).alias("med"), F.stddev_pop("deg").alias("std"))
    x = F.col("deg") - F.col("med")
    sig = lambda m: 1 / (1 + F.exp(-x / F.greatest(m * F.col("std"), F.lit(1.0))))
    by_degree = {"deg_sigmoid": sig(1), "deg_sigmoid2": sig(2), "deg_sigmoid3": sig(0.5), "deg_linear": F.least(F.greatest((x + F.col("std")) / F.greatest(2 * F.col("std"), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))}
    by_degree |= {f"deg_b_heavy{n}": low + span * sig(1) for n, low, span in (("", 0.1, 0.3), ("2", 0.05, 0.25), ("3", 0.15, 0.35))}
    every = F.explode(F.array(*(F.struct(F.lit(k).alias("strategy"), w.alias("w")) for k, w in ({k: F.lit(v) for k, v in SHARES.items()} | by_degree).items()))).alias("s")
    shares = deg.join(F.broadcast(stat)).select("node", every).select("node", "s.*").join(truth.select("node", "label"), "node")  # one row
    both = a.join(b.withColumnRenamed("p", "q"), ["node", "class"]).join(shares, "node")
    s = F.round(F.col("w") * F.col("p") + (1 - F.col("w")) * F.col("q"), 9)
    best = both.groupBy("strategy", "node", "label").agg(F.max_by("class", F.struct(s, -F.col("class"))).alias("pred"))
    return best.groupBy("strategy").agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))

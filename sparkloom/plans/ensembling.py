"""Ensemble, routing and evaluation queries on three probability models of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import ensemble as E
from sparkloom.operators import graph as G
from sparkloom.operators import splits as SP
from sparkloom.plans.graphs import GRAPH_SQL, PROB_SQL, classes, fixture, nodes, probs, seeds, vectors
from sparkloom.plans.registry import query

PSQL = GRAPH_SQL + PROB_SQL
ARG = "(SELECT model, node, class AS pred, p AS conf FROM (SELECT *, row_number() OVER (PARTITION BY model, node ORDER BY p DESC, class) AS r FROM probs) WHERE r = 1)"


def labels(spark, d):
    return nodes(spark, d).select("node", "label")


@query(f"SELECT s.model, s.node, pred, round(confidence, 6) AS confidence, round(confidence - second, 6) AS margin, round(entropy, 6) AS entropy FROM (SELECT model, node, max(p) AS confidence, list_sort(list(p), 'DESC')[2] AS second, -sum(p * ln(p)) AS entropy FROM probs GROUP BY 1, 2) s JOIN {ARG} a ON s.model = a.model AND s.node = a.node", PSQL)
def prob_summary(spark, d):
    s = E.summaries(probs(spark, d), ["model", "node"])
    return s.select("model", "node", "pred", *(F.round(c, 6).alias(c) for c in ("confidence", "margin", "entropy")))


MODELS, CLASSES = ["cold", "hot", "mid"], list(range(10))


@query("SELECT node, " + ", ".join([f"round(max(CASE WHEN model = '{m}' AND class = {c} THEN p END), 6) AS {m}_p{c}, round(ln(greatest(max(CASE WHEN model = '{m}' AND class = {c} THEN p END), 1e-9)), 6) AS {m}_l{c}" for m in MODELS for c in CLASSES] + [f"round(max(CASE WHEN model = '{m}' THEN p END), 6) AS {m}_max, round(sum(CASE WHEN model = '{m}' THEN -p * ln(p) ELSE 0 END), 6) AS {m}_entropy" for m in MODELS]) + " FROM probs GROUP BY node", PSQL)
def stack_features(spark, d):
    s = E.stacked(probs(spark, d), MODELS, CLASSES)
    return s.select("node", *(F.round(c, 6).alias(c) for c in s.columns[1:]))


BLEND = "SELECT node, class, s / sum(s) OVER (PARTITION BY node) AS p FROM (SELECT node, class, least(greatest(sum(p * CASE model WHEN 'cold' THEN 0.5 WHEN 'mid' THEN 0.3 ELSE 0.2 END), 1e-9), 1) AS s FROM probs GROUP BY 1, 2)"
WEIGHTS = {"cold": 0.5, "mid": 0.3, "hot": 0.2}


@query(f"SELECT node, class, round(p, 6) AS p FROM ({BLEND})", PSQL)
def weighted_blend(spark, d):
    return E.blended(probs(spark, d), WEIGHTS).withColumn("p", F.round("p", 6))


@query("SELECT round(step * 0.65 / 20, 6) AS gamma, count(*) AS n, round(avg((pred = label)::INT), 6) AS accuracy FROM (SELECT step, node, class AS pred FROM (SELECT step, a.node, a.class, row_number() OVER (PARTITION BY step, a.node ORDER BY round((1 - step * 0.65::DOUBLE / 20) * a.p + step * 0.65::DOUBLE / 20 * b.p, 9) DESC, a.class) AS r FROM probs a JOIN probs b ON a.node = b.node AND a.class = b.class AND a.model = 'cold' AND b.model = 'hot', range(0, 21) t(step)) WHERE r = 1) JOIN nodes USING (node) GROUP BY step", PSQL)
def gamma_grid(spark, d):
    p = G.checkpointed(probs(spark, d))
    g = E.mixed_grid(p.where("model = 'cold'").drop("model"), p.where("model = 'hot'").drop("model"), labels(spark, d))
    return g.select(F.round("gamma", 6).alias("gamma"), "n", F.round("accuracy", 6).alias("accuracy"))


@query("""SELECT kind, node, class, round(w * q + (1 - w) * p, 6) AS p FROM (SELECT a.node, a.class, a.p, b.p AS q FROM probs a JOIN probs b ON a.node = b.node AND a.class = b.class AND a.model = 'cold' AND b.model = 'mid') JOIN
  (SELECT node, 'sigmoid' AS kind, 1 / (1 + exp(-x)) AS w FROM z UNION ALL SELECT node, 'linear', least(greatest(0.5 + x / 2, 0), 1) FROM z) USING (node)""", PSQL + ", dg AS (SELECT node, coalesce(d, 0) AS dd FROM nodes LEFT JOIN deg USING (node)), z AS (SELECT node, (dd - (SELECT quantile_cont(dd, 0.5) FROM dg)) / greatest((SELECT stddev_pop(dd) FROM dg), 1) AS x FROM dg)")
def degree_fusion_grid(spark, d):
    p, g = G.checkpointed(probs(spark, d)), G.degrees(nodes(spark, d), fixture(spark, d)).select("node", "deg")
    a, b = p.where("model = 'cold'").drop("model"), p.where("model = 'mid'").drop("model")
    out = None
    for kind in ("sigmoid", "linear"):
        one = E.degree_fused(a, b, g, kind).select(F.lit(kind).alias("kind"), "node", "class", F.round("p", 6).alias("p"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT class, boost, round(avg((pred = label)::INT), 6) AS accuracy FROM (SELECT c AS class, boost, node, class AS pred FROM (SELECT c, boost, node, class, row_number() OVER (PARTITION BY c, boost, node ORDER BY round(p * CASE WHEN class = c THEN boost ELSE 1 END, 9) DESC, class) AS r FROM probs, (SELECT class AS c FROM classes), (VALUES (1.0::DOUBLE), (1.05), (1.1)) v(boost) WHERE model = 'mid') WHERE r = 1) JOIN nodes USING (node) GROUP BY 1, 2", PSQL)
def class_boost_grid(spark, d):
    """Accuracy if one class's probabilities are multiplied by a factor."""
    p = probs(spark, d).where("model = 'mid'")
    cs = p.select(F.col("class").alias("c")).distinct()
    rows = p.join(F.broadcast(cs)).select("node", "class", "p", "c", F.explode(F.array(F.lit(1.0), F.lit(1.05), F.lit(1.1))).alias("boost"))  # classes
    rows = rows.withColumn("s", F.round(F.col("p") * F.when(F.col("class") == F.col("c"), F.col("boost")).otherwise(1.0), 9))
    best = rows.groupBy("c", "boost", "node").agg(F.max_by("class", F.struct("s", -F.col("class"))).alias("pred")).join(labels(spark, d), "node")
    return best.groupBy(F.col("c").alias("class"), "boost").agg(F.round(F.avg((F.col("pred") == F.col("label")).cast("double")), 6).alias("accuracy"))


ROUTE = f""", route AS (SELECT node, a.pred AS base, b.pred AS graph, b.conf AS p, label, node % 5 AS fold, EXISTS (SELECT 1 FROM sym JOIN seeds s ON dst = s.node WHERE src = a.node) AS covered, coalesce(d, 0) AS deg
  FROM {ARG} a JOIN {ARG} b USING (node) JOIN nodes USING (node) LEFT JOIN deg USING (node) WHERE a.model = 'hot' AND b.model = 'cold')"""


def route_rows(spark, d):
    """Two models' classes, the second's confidence, coverage by labelled neighbours, degree and fold of each node."""
    n, e = nodes(spark, d), fixture(spark, d)
    s = E.summaries(probs(spark, d), ["model", "node"])
    a = s.where("model = 'hot'").select("node", F.col("pred").alias("base"))
    b = s.where("model = 'cold'").select("node", F.col("pred").alias("graph"), F.col("confidence").alias("p"))
    near = G.symmetric(e).join(n.where("split = 'train'").select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct().withColumn("covered", F.lit(True))
    return a.join(b, "node").join(n.select("node", "label"), "node").join(near, "node", "left").na.fill(False, ["covered"]).join(G.degrees(n, e).select("node", "deg"), "node").withColumn("fold", F.col("node") % 5)


SEL = "(base <> graph AND covered AND p >= 0.10)"


@query(f"SELECT node, {SEL} AS selected, CASE WHEN {SEL} THEN graph ELSE base END AS final FROM route", PSQL + ROUTE)
def route_correction(spark, d):
    """With a threshold of 0.10, which ten even classes can reach."""
    return E.routed(route_rows(spark, d), 0.10).select("node", "selected", "final")


@query(f"SELECT fold, count(*) AS n, sum({SEL}::INT)::BIGINT AS selected, sum(({SEL} AND graph = label)::INT)::BIGINT AS corrected, sum(({SEL} AND base = label)::INT)::BIGINT AS worsened, (sum(({SEL} AND graph = label)::INT) - sum(({SEL} AND base = label)::INT))::BIGINT AS net FROM route GROUP BY fold", PSQL + ROUTE)
def routing_report(spark, d):
    return E.routing_report(E.routed(route_rows(spark, d), 0.10))


@query("SELECT class, support::BIGINT AS support, predicted::BIGINT AS predicted, hits::BIGINT AS hits, round(coalesce(hits / nullif(support, 0), 0), 6) AS recall, round(coalesce(hits / nullif(predicted, 0), 0), 6) AS \"precision\", round(coalesce(2 * hits / nullif(support + predicted, 0), 0), 6) AS f1 FROM (SELECT class, (SELECT count(*) FROM route WHERE label = class) AS support, (SELECT count(*) FROM route WHERE base = class) AS predicted, (SELECT count(*) FROM route WHERE base = class AND label = class) AS hits FROM classes)", PSQL + ROUTE)
def class_recall(spark, d):
    c = E.class_scores(route_rows(spark, d).withColumn("pred", F.col("base")))
    return c.select("class", "support", "predicted", "hits", *(F.round(x, 6).alias(x) for x in ("recall", "precision", "f1")))


@query("SELECT label, base AS pred, count(*) AS n FROM route GROUP BY 1, 2", PSQL + ROUTE)
def confusion_matrix(spark, d):
    return route_rows(spark, d).groupBy("label", F.col("base").alias("pred")).agg(F.count("*").alias("n"))


@query("SELECT bucket, count(*) AS n, round(avg((base = label)::INT), 6) AS accuracy FROM (SELECT *, CASE WHEN covered THEN 'covered' ELSE 'uncovered' END AS bucket FROM route UNION ALL SELECT *, CASE WHEN deg = 0 THEN 'deg_0' WHEN deg = 1 THEN 'deg_1' WHEN deg <= 3 THEN 'deg_2_3' ELSE 'deg_4_plus' END FROM route) GROUP BY 1", PSQL + ROUTE)
def bucket_accuracy(spark, d):
    return E.bucket_accuracy(route_rows(spark, d).withColumn("pred", F.col("base"))).withColumn("accuracy", F.round("accuracy", 6))


RANKS = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2)"


@query(f"SELECT round(corr(a, b), 6) AS spearman FROM (SELECT {RANKS.format('round(p, 9)')} AS a, {RANKS.format('deg')} AS b FROM route)", PSQL + ROUTE)
def spearman_scores(spark, d):
    return E.spearman(route_rows(spark, d).withColumn("p", F.round("p", 9)), "p", "deg").select(F.round("spearman", 6).alias("spearman"))


@query(f"SELECT round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc FROM (SELECT (base = label)::INT AS y, {RANKS.format('round(p, 9)')} AS r FROM route)", PSQL + ROUTE)
def auc_ranksum(spark, d):
    r = route_rows(spark, d).select(F.round("p", 9).alias("p"), (F.col("base") == F.col("label")).cast("int").alias("y"))
    return E.auc(r, "p", "y").select(F.round("auc", 6).alias("auc"))


@query("SELECT count(*) AS pairs, sum((sign(x.a - y.a) = sign(x.b - y.b))::INT)::BIGINT AS agree FROM v x JOIN v y ON x.variant < y.variant", PSQL + ROUTE + ", v AS (SELECT fold AS variant, round(avg((base = label)::INT), 9) AS a, round(avg((graph = label)::INT), 9) AS b FROM route GROUP BY 1)")
def pairwise_order(spark, d):
    v = route_rows(spark, d).groupBy(F.col("fold").alias("variant")).agg(F.round(F.avg((F.col("base") == F.col("label")).cast("double")), 9).alias("a"), F.round(F.avg((F.col("graph") == F.col("label")).cast("double")), 9).alias("b"))
    return E.order_agreement(v, "a", "b")


@query("SELECT label, n, round(t / (k * n), 6) AS balanced, round(least(sqrt(t / (k * n)), 5), 6) AS sqrt_balanced, round(e / sum(e) OVER () * k, 6) AS effective FROM (SELECT label, count(*) AS n, sum(count(*)) OVER () AS t, count(*) OVER () AS k, (1 - 0.9999::DOUBLE) / (1 - pow(0.9999::DOUBLE, count(*))) AS e FROM nodes GROUP BY label)", GRAPH_SQL)
def class_weights(spark, d):
    c = E.class_weights(labels(spark, d))
    return c.select("label", "n", *(F.round(x, 6).alias(x) for x in ("balanced", "sqrt_balanced", "effective")))


@query("SELECT model, count(*) AS n_nodes, sum((abs(s - 1) <= 1e-5 AND mn >= 0)::INT)::BIGINT AS n_valid FROM (SELECT model, node, sum(p) AS s, min(p) AS mn FROM probs GROUP BY 1, 2) GROUP BY 1", PSQL)
def probability_check(spark, d):
    s = probs(spark, d).groupBy("model", "node").agg(F.sum("p").alias("s"), F.min("p").alias("m"))
    return s.groupBy("model").agg(F.count("*").alias("n_nodes"), F.sum(((F.abs(F.col("s") - 1) <= 1e-5) & (F.col("m") >= 0)).cast("long")).alias("n_valid"))


@query("SELECT node, label, (row_number() OVER (PARTITION BY label ORDER BY md5(CAST(node AS VARCHAR)), node) - 1) % 5 AS fold FROM nodes", GRAPH_SQL)
def stratified_folds(spark, d):
    return SP.stratified_folds(labels(spark, d), "node", "label")


@query("SELECT node, CAST(concat('0x', substr(md5(CAST(node AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS fold, CAST(concat('0x', substr(md5(CAST(node AS VARCHAR)), 1, 8)) AS BIGINT) % 1000 < 120 AS held_out FROM nodes", GRAPH_SQL)
def hash_folds(spark, d):
    return SP.holdout(SP.group_folds(nodes(spark, d).select("node"), "node"), "node")


@query("SELECT node, row_number() OVER (ORDER BY round(p, 9) DESC, node DESC) <= round(0.2 * count(*) OVER ()) AS selected FROM route", PSQL + ROUTE)
def top_propensity_split(spark, d):
    return SP.top_share(route_rows(spark, d).select("node", F.round("p", 9).alias("p")), "p", "node").select("node", "selected")


@query("SELECT least(5, greatest(2, min(n)))::BIGINT AS folds FROM (SELECT count(*) AS n FROM nodes GROUP BY label)", GRAPH_SQL)
def fold_count_guard(spark, d):
    return SP.fold_count(labels(spark, d), "label")


COVER = "(SELECT src FROM sym JOIN seeds ON dst = seeds.node)"


@query(f"SELECT node, class, round(CASE WHEN node IN {COVER} THEN avg(p) FILTER (WHERE model <> 'hot') ELSE max(p) FILTER (WHERE model = 'hot') END, 6) AS p FROM probs GROUP BY node, class", PSQL)
def expert_mix(spark, d):
    n, e = nodes(spark, d), fixture(spark, d)
    near = G.symmetric(e).join(n.where("split = 'train'").select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"))
    return E.expert_mix(probs(spark, d), ["cold", "mid"], "hot", near).withColumn("p", F.round("p", 6))


SEARCH = """, raw AS (SELECT draw, m AS model, -ln((CAST(concat('0x', substr(md5('draw:' || draw || ':' || m), 1, 8)) AS BIGINT) % 100000 + 0.5::DOUBLE) / 100000) AS e FROM range(0, 30) t(draw), (VALUES ('cold'), ('mid'), ('hot')) v(m)),
wts AS (SELECT draw::BIGINT AS draw, model, e / sum(e) OVER (PARTITION BY draw) AS w FROM raw UNION ALL SELECT 30 + i, m, (i = j)::INT::DOUBLE FROM (VALUES (0, 'cold'), (1, 'mid'), (2, 'hot')) v(i, m), range(0, 3) t(j) WHERE i = j),
best AS (SELECT draw, node, class AS pred FROM (SELECT draw, node, class, row_number() OVER (PARTITION BY draw, node ORDER BY round(sum(w * p), 9) DESC, class) AS r FROM probs JOIN wts USING (model) GROUP BY draw, node, class) WHERE r = 1)"""


@query("SELECT draw, round(avg((pred = label)::INT), 6) AS accuracy FROM best JOIN nodes USING (node) GROUP BY draw", PSQL + SEARCH)
def blend_weight_search(spark, d):
    """Thirty even draws from the simplex, by hash, and each model alone."""
    return E.weight_search(G.checkpointed(probs(spark, d)), labels(spark, d), ["cold", "mid", "hot"]).select("draw", F.round("accuracy", 6).alias("accuracy"))


@query("SELECT node, row_number() OVER (ORDER BY node) > count(*) OVER () - floor(0.2 * count(*) OVER ()) AS is_tail, CASE WHEN CAST(concat('0x', substr(md5(CAST(node AS VARCHAR) || ':mask'), 1, 8)) AS BIGINT) % 1000 < 500 THEN 'query' ELSE 'context' END AS role FROM nodes", GRAPH_SQL)
def tail_and_mask(spark, d):
    return SP.label_mask(SP.tail_split(nodes(spark, d).select("node"), "node"), "node")


@query("SELECT node, i::BIGINT AS dim, round(v[i] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS l2, round(v[i] / nullif(list_sum(v), 0), 4) AS row_share, (v[i] <> 0)::DOUBLE AS binary, round((v[i] - avg(v[i]) OVER (PARTITION BY i)) / CASE WHEN stddev_pop(v[i]) OVER (PARTITION BY i) < 1e-6 THEN 1 ELSE stddev_pop(v[i]) OVER (PARTITION BY i) END, 6) AS standard FROM vec, range(1, 65) t(i) WHERE i <= len(v)", GRAPH_SQL)
def attribute_scaling(spark, d):
    a = vectors(spark, d).select("node", F.posexplode("vec").alias("p", "v")).select("node", (F.col("p") + 1).cast("long").alias("dim"), F.col("v").cast("double").alias("v"))
    out = None
    for mode, name, digits in (("l2", "l2", 6), ("row", "row_share", 4), ("binary", "binary", 6), ("standard", "standard", 6)):
        one = G.scaled_attributes(a, mode).select("node", "dim", F.round("v", digits).alias(name))
        out = one if out is None else out.join(one, ["node", "dim"])
    return out

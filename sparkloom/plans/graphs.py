"""Graph queries on a nearest-neighbour graph of the embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import graph as G
from sparkloom.operators import neighbours as N
from sparkloom.plans.registry import query
from sparkloom.sources.tables import parquet

GRAPH_SQL = """
vec AS (SELECT vec_id AS node, embedding::DOUBLE[] AS v, label FROM embeddings),
nodes AS (SELECT node, label::BIGINT AS label, CASE WHEN node % 5 <> 0 THEN 'train' ELSE 'test' END AS split FROM vec),
sim AS (SELECT a.node AS src, b.node AS dst, list_cosine_similarity(a.v, b.v) AS s FROM vec a JOIN vec b ON a.node <> b.node),
edges AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(s, 9) DESC, dst) AS r FROM sim) WHERE r <= 2 AND src % 3 <> 0),
seeds AS (SELECT node, label FROM nodes WHERE split = 'train'),
classes AS (SELECT DISTINCT label AS class FROM nodes),
sym AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
deg AS (SELECT src AS node, count(*) AS d FROM sym GROUP BY 1),
looped AS (SELECT src, dst FROM sym UNION ALL SELECT node, node FROM nodes),
wt AS (SELECT src, dst, 1.0 / sqrt(a.d * b.d) AS ws, 1.0 / a.d AS wr FROM looped JOIN (SELECT src AS x, count(*) AS d FROM looped GROUP BY 1) a ON src = a.x JOIN (SELECT src AS y, count(*) AS d FROM looped GROUP BY 1) b ON dst = b.y)"""


def nodes(spark, d):
    return parquet(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").cast("long").alias("label"), F.when(F.col("vec_id") % 5 != 0, "train").otherwise("test").alias("split"))


def vectors(spark, d):
    return parquet(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec"))


def edges(spark, d):
    """Each vector to its two most similar others, but for every third vector: the fixture of a directed graph."""
    v = vectors(spark, d)
    return N.nearest(v.where("node % 3 <> 0"), v, 2, itself=False).select(F.col("node").alias("src"), F.col("other").alias("dst"))


def seeds(spark, d):
    return nodes(spark, d).where("split = 'train'").select("node", "label")


def classes(spark, d):
    return nodes(spark, d).select(F.col("label").alias("class")).distinct()


def fixture(spark, d):
    """Edges are used many times in a query, so they are cut from the similarity join once."""
    return G.checkpointed(edges(spark, d))


@query("SELECT src, dst FROM sym", GRAPH_SQL)
def graph_symmetrize(spark, d):
    return G.symmetric(edges(spark, d))


@query("SELECT node, (SELECT count(*) FROM edges WHERE src = node) AS out_deg, (SELECT count(*) FROM edges WHERE dst = node) AS in_deg, coalesce(d, 0) AS deg FROM nodes LEFT JOIN deg USING (node)", GRAPH_SQL)
def graph_degrees(spark, d):
    return G.degrees(nodes(spark, d), fixture(spark, d))


@query("SELECT src, dst, round(ws, 9) AS w_sym, round(wr, 9) AS w_row FROM wt", GRAPH_SQL)
def graph_norm_weights(spark, d):
    n, e = nodes(spark, d), fixture(spark, d)
    a = G.normalized(n, e).select("src", "dst", F.round("w", 9).alias("w_sym"))
    return a.join(G.normalized(n, e, "row").select("src", "dst", F.round("w", 9).alias("w_row")), ["src", "dst"])


@query("SELECT nodes.node, coalesce(sum(deg.d), 0)::BIGINT AS hop2 FROM nodes LEFT JOIN sym ON src = nodes.node LEFT JOIN deg ON deg.node = dst GROUP BY 1", GRAPH_SQL)
def graph_2hop(spark, d):
    return G.second_degree(nodes(spark, d), fixture(spark, d))


@query("SELECT n.node, " + ", ".join(f"coalesce(sum((e{k}.split = '{s}')::INT), 0)::BIGINT AS {k}_{s}" for k in ("out",) for s in ("train", "test")) + ", (SELECT count(*) FROM edges JOIN nodes m ON src = m.node WHERE dst = n.node AND m.split = 'train') AS in_train, (SELECT count(*) FROM edges JOIN nodes m ON src = m.node WHERE dst = n.node AND m.split = 'test') AS in_test FROM nodes n LEFT JOIN (SELECT src, split FROM edges JOIN nodes ON dst = node) eout ON eout.src = n.node GROUP BY n.node", GRAPH_SQL)
def neighbor_status(spark, d):
    return G.neighbour_status(nodes(spark, d), fixture(spark, d))


@query("SELECT nodes.node, round(avg(deg.d), 6) AS mean_neighbor_deg, count(deg.d) AS n_neighbors FROM nodes JOIN sym ON src = nodes.node JOIN deg ON deg.node = dst GROUP BY 1", GRAPH_SQL)
def neighbor_stats(spark, d):
    sym = G.symmetric(fixture(spark, d))
    deg = sym.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("d"))
    return sym.join(deg, "dst").groupBy(F.col("src").alias("node")).agg(F.round(F.avg("d"), 6).alias("mean_neighbor_deg"), F.count("*").alias("n_neighbors"))


X_SQL = GRAPH_SQL + """,
x0 AS (SELECT node, i::BIGINT AS dim, v[i]::DOUBLE AS v FROM vec, range(1, 65) t(i) WHERE i <= len(v)),
x1 AS (SELECT src AS node, dim, sum(wr * v) AS v FROM wt JOIN x0 ON dst = node GROUP BY 1, 2),
x2 AS (SELECT src AS node, dim, sum(wr * v) AS v FROM wt JOIN x1 ON dst = node GROUP BY 1, 2)"""


def _features(spark, d, hops: int):
    x = vectors(spark, d).select("node", F.posexplode("vec").alias("p", "v")).select("node", (F.col("p") + 1).cast("long").alias("dim"), F.col("v").cast("double").alias("v"))
    w = G.normalized(nodes(spark, d), fixture(spark, d), "row")
    for _ in range(hops):
        x = G.spread(w, x, ["dim"])
    return x.select("node", "dim", F.round("v", 6).alias("v"))


@query("SELECT node, dim, round(v, 6) AS v FROM x1", X_SQL)
def feature_prop_1hop(spark, d):
    return _features(spark, d, 1)


@query("SELECT node, dim, round(v, 6) AS v FROM x2", X_SQL)
def feature_prop_2hop(spark, d):
    return _features(spark, d, 2)


def _chain(start: str, step: str, rounds: int) -> str:
    out = f"s0 AS MATERIALIZED ({start})"
    for k in range(rounds):
        out += f", s{k + 1} AS MATERIALIZED ({step.replace('@', f's{k}')})"
    return out


PR = _chain("SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS v FROM nodes", "SELECT n.node, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * coalesce(t.v, 0) AS v FROM nodes n LEFT JOIN (SELECT src AS node, sum(v / d) AS v FROM sym JOIN @ ON dst = @.node JOIN deg ON dst = deg.node GROUP BY 1) t ON n.node = t.node", 10)


@query("SELECT node, round(v, 8) AS rank FROM s10", f"{GRAPH_SQL}, {PR}")
def pagerank_10(spark, d):
    return G.pagerank(nodes(spark, d), fixture(spark, d), 10).withColumn("rank", F.round("rank", 8))


def _lp_sql(mode: str, w: str, alpha: float, rounds: int = 5) -> str:
    start = "1.0 / (SELECT count(*) FROM classes)" if mode in ("plain", "clamped") else "0"
    new = {"plain": f"(1 - {alpha}) * coalesce(t.v, 0) + {alpha} * y0", "clamped": "CASE WHEN seed THEN y0 ELSE coalesce(t.v, 0) END", "ppr": f"{alpha} * y0 + (1 - {alpha}) * coalesce(t.v, 0)", "lgc": f"{alpha} * coalesce(t.v, 0) + (1 - {alpha}) * y0"}[mode]
    base = f"base AS MATERIALIZED (SELECT n.node, class, s.node IS NOT NULL AS seed, (CASE WHEN s.node IS NULL THEN {start} WHEN s.label = class THEN 1 ELSE 0 END)::DOUBLE AS y0 FROM nodes n CROSS JOIN classes LEFT JOIN seeds s ON n.node = s.node)"
    return f"{GRAPH_SQL}, {base}, " + _chain("SELECT node, class, y0 AS v FROM base", f"SELECT b.node, b.class, {new} AS v FROM base b LEFT JOIN (SELECT src AS node, class, sum({w} * v) AS v FROM wt JOIN @ ON dst = @.node GROUP BY 1, 2) t ON b.node = t.node AND b.class = t.class", rounds)


def _lp(name: str, mode: str, norm: str, alpha: float):
    def run(spark, d):
        n, e = nodes(spark, d), fixture(spark, d)
        out = G.label_propagation(n, G.normalized(n, e, norm), seeds(spark, d), classes(spark, d), 5, alpha, mode)
        return out.select("node", "class", F.round("v", 8).alias("v"))

    run.__name__ = name
    return query("SELECT node, class, round(v, 8) AS v FROM s5", _lp_sql(mode, "ws" if norm == "sym" else "wr", alpha))(run)


label_prop_5 = _lp("label_prop_5", "plain", "row", 0.5)
label_prop_clamped_5 = _lp("label_prop_clamped_5", "clamped", "row", 0.0)
ppr_lp_5 = _lp("ppr_lp_5", "ppr", "sym", 0.15)
lgc_5 = _lp("lgc_5", "lgc", "sym", 0.99)

PROB_SQL = """,
cent AS (SELECT label AS class, i AS dim, avg(v[i]) AS c FROM vec, range(1, 65) t(i) WHERE node % 5 <> 0 GROUP BY 1, 2),
dist AS (SELECT node, class::BIGINT AS class, sqrt(sum((v[dim] - c) * (v[dim] - c))) AS dd FROM vec JOIN cent ON true GROUP BY 1, 2),
probs AS (SELECT m AS model, node, class, exp(-(dd - mn) / t) / sum(exp(-(dd - mn) / t)) OVER (PARTITION BY m, node) AS p FROM (SELECT *, min(dd) OVER (PARTITION BY node) AS mn FROM dist), (VALUES ('cold', 0.5::DOUBLE), ('mid', 1.0), ('hot', 2.0)) v(m, t))"""


def probs(spark, d):
    """(model, node, class, p): softmax of negative distances to the training centroids at three temperatures."""
    v = vectors(spark, d).join(nodes(spark, d), "node").select("node", "label", "split", F.posexplode("vec").alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    cent = v.where("split = 'train'").groupBy(F.col("label").alias("class"), "dim").agg(F.avg("v").alias("c"))
    dist = v.join(F.broadcast(cent), "dim").groupBy("node", "class").agg(F.sqrt(F.sum((F.col("v") - F.col("c")) ** 2)).alias("dd"))  # centroids: classes x dimensions
    z = dist.withColumn("z", F.col("dd") - F.min("dd").over(Window.partitionBy("node")))
    m = F.explode(F.array(*(F.struct(F.lit(a).alias("model"), F.lit(b).alias("t")) for a, b in (("cold", 0.5), ("mid", 1.0), ("hot", 2.0))))).alias("m")
    e = z.select("node", "class", "z", m).select("node", "class", "m.model", F.exp(-F.col("z") / F.col("m.t")).alias("e"))
    return e.select("model", "node", "class", (F.col("e") / F.sum("e").over(Window.partitionBy("model", "node"))).alias("p"))


CS = """, cs AS MATERIALIZED (SELECT p.node, class, p, CASE WHEN s.node IS NULL THEN NULL WHEN s.label = class THEN 1.0::DOUBLE ELSE 0 END AS y FROM probs p LEFT JOIN seeds s ON p.node = s.node WHERE model = 'mid'), e0 AS MATERIALIZED (SELECT node, class, coalesce(y - p, 0) AS v FROM cs)"""
for _k in range(3):
    CS += f", e{_k + 1} AS MATERIALIZED (SELECT b.node, b.class, 0.8 * coalesce(t.v, 0) + 0.2 * b.v AS v FROM e0 b LEFT JOIN (SELECT src AS node, class, sum(ws * v) AS v FROM wt JOIN e{_k} ON dst = e{_k}.node GROUP BY 1, 2) t ON b.node = t.node AND b.class = t.class)"
CS += ", f0 AS MATERIALIZED (SELECT cs.node, cs.class, coalesce(y, p + v) AS v FROM cs JOIN e3 ON cs.node = e3.node AND cs.class = e3.class)"
for _k in range(3):
    CS += f", f{_k + 1} AS MATERIALIZED (SELECT b.node, b.class, 0.8 * coalesce(t.v, 0) + 0.2 * b.v AS v FROM f0 b LEFT JOIN (SELECT src AS node, class, sum(ws * v) AS v FROM wt JOIN f{_k} ON dst = f{_k}.node GROUP BY 1, 2) t ON b.node = t.node AND b.class = t.class)"


@query("SELECT node, class, round(least(greatest(v, 1e-9), 1) / sum(least(greatest(v, 1e-9), 1)) OVER (PARTITION BY node), 6) AS p FROM f3", GRAPH_SQL + PROB_SQL + CS)
def correct_smooth_3(spark, d):
    n, e = nodes(spark, d), fixture(spark, d)
    p = probs(spark, d).where("model = 'mid'").drop("model")
    return G.correct_and_smooth(n, G.normalized(n, e), p, seeds(spark, d), 3).withColumn("p", F.round("p", 6))


@query("""SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM (SELECT node, min(reach) AS component FROM walk GROUP BY 1)""", GRAPH_SQL.replace("\nvec AS", "RECURSIVE\nvec AS", 1) + ", walk AS (SELECT node, node AS reach FROM nodes UNION SELECT walk.node, dst FROM walk JOIN sym ON reach = src)")
def connected_components(spark, d):
    return G.components(nodes(spark, d), fixture(spark, d))


@query(f"""SELECT n.node, c.class, mass_out::BIGINT AS mass_out, mass_in::BIGINT AS mass_in, round((co + 1.0 / k) / (mass_out + 1.0), 8) AS p_out, round((ci + 1.0 / k) / (mass_in + 1.0), 8) AS p_in FROM nodes n CROSS JOIN classes c CROSS JOIN (SELECT count(*) AS k FROM classes)
 CROSS JOIN LATERAL (SELECT count(*) AS mass_out, count(*) FILTER (WHERE s.label = c.class) AS co FROM edges JOIN seeds s ON dst = s.node WHERE src = n.node) CROSS JOIN LATERAL (SELECT count(*) AS mass_in, count(*) FILTER (WHERE s.label = c.class) AS ci FROM edges JOIN seeds s ON src = s.node WHERE dst = n.node)""", GRAPH_SQL)
def directional_onehop(spark, d):
    p = G.directional_posterior(nodes(spark, d), fixture(spark, d), seeds(spark, d), classes(spark, d))
    return p.select("node", "class", "mass_out", "mass_in", F.round("p_out", 8).alias("p_out"), F.round("p_in", 8).alias("p_in"))


def _blocks_sql(seed: str) -> str:
    parts = []
    for view, rel in (("out", "SELECT src, dst FROM edges"), ("in", "SELECT dst AS src, src AS dst FROM edges"), ("sym", "SELECT src, dst FROM sym")):
        w = f"(SELECT e.src, e.dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY e.src) AS w FROM ({rel}) e)"
        one = f"(SELECT src AS node, label AS class, sum(w) AS v FROM {w} JOIN ({seed}) q ON dst = q.node GROUP BY 1, 2)"
        two = f"(SELECT src AS node, class, sum(w * v) AS v FROM {w} JOIN {one} h ON dst = h.node GROUP BY 1, 2)"
        for hop, s in ((1, one), (2, two)):
            parts.append(f"SELECT n.node, '{view}' AS view, {hop}::BIGINT AS hop, c.class, round((coalesce(x.v, 0) + pr) / (coalesce(m, 0) + 1), 8) AS p, round(coalesce(m, 0), 8) AS mass FROM nodes n CROSS JOIN (SELECT class, (SELECT count(*) FROM ({seed}) WHERE label = class) / (SELECT count(*) FROM ({seed})) AS pr FROM classes) c LEFT JOIN {s} x ON x.node = n.node AND x.class = c.class LEFT JOIN (SELECT node, sum(v) AS m FROM {s} GROUP BY 1) y ON y.node = n.node")
    return " UNION ALL ".join(parts)


@query(_blocks_sql("SELECT node, label FROM seeds"), GRAPH_SQL)
def label_blocks(spark, d):
    b = G.label_blocks(nodes(spark, d), fixture(spark, d), seeds(spark, d), classes(spark, d))
    return b.select("node", "view", "hop", "class", F.round("p", 8).alias("p"), F.round("mass", 8).alias("mass"))


@query(" UNION ALL ".join(f"SELECT * FROM ({_blocks_sql(f'SELECT node, label FROM seeds WHERE node % 3 <> {f}')}) WHERE node IN (SELECT node FROM seeds WHERE node % 3 = {f})" for f in range(3)), GRAPH_SQL)
def label_blocks_crossfit(spark, d):
    s = seeds(spark, d).withColumn("fold", F.col("node") % 3)
    b = G.crossfit_label_blocks(nodes(spark, d), fixture(spark, d), s, classes(spark, d))
    return b.select("node", "view", "hop", "class", F.round("p", 8).alias("p"), F.round("mass", 8).alias("mass"))


@query("""SELECT node, k::BIGINT AS k, class, round(s / sum(s) OVER (PARTITION BY node, k), 6) AS vote FROM (SELECT a AS node, k, label AS class, sum(s) AS s FROM (SELECT x.node AS a, y.label, list_cosine_similarity(x.v, vec.v) AS s, row_number() OVER (PARTITION BY x.node ORDER BY round(list_cosine_similarity(x.v, vec.v), 9) DESC, y.node) AS r FROM vec x, seeds y JOIN vec ON vec.node = y.node), (VALUES (5), (10)) v(k) WHERE r <= k AND s > 0 GROUP BY 1, 2, 3)""", GRAPH_SQL)
def knn_vote(spark, d):
    return G.knn_votes(vectors(spark, d), seeds(spark, d), nearest=N.nearest).withColumn("vote", F.round("vote", 6))


@query("SELECT count(*) AS n_nodes, round(avg(coalesce(d, 0)), 6) AS mean_deg, max(coalesce(d, 0)) AS max_deg, round(avg((d IS NULL)::INT), 6) AS isolated, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM edges WHERE src = dst) AS n_loops, (SELECT round(avg((EXISTS (SELECT 1 FROM edges b WHERE b.src = a.dst AND b.dst = a.src))::INT), 6) FROM edges a) AS reciprocal, round((SELECT count(*) FROM edges) / (count(*) * count(*)), 9) AS density FROM nodes LEFT JOIN deg USING (node)", GRAPH_SQL)
def graph_profile(spark, d):
    p = G.profile(nodes(spark, d), fixture(spark, d))
    return p.select("n_nodes", F.round("mean_deg", 6).alias("mean_deg"), "max_deg", F.round("isolated", 6).alias("isolated"), "n_edges", "n_loops", F.round("reciprocal", 6).alias("reciprocal"), F.round("density", 9).alias("density"))

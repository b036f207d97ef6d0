"""Decompositions, fitted models, clusters, indexed neighbours and draws, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import cluster as CL
from sparkloom.operators import domain as D
from sparkloom.operators import ensemble as E
from sparkloom.operators import graph as G
from sparkloom.operators import heuristics as H
from sparkloom.operators import linalg as L
from sparkloom.operators import neighbours as N
from sparkloom.operators import products as P
from sparkloom.operators import sampling as S
from sparkloom.plans import fixtures as T
from sparkloom.plans import ranking as K
from sparkloom.plans.ensembling import PSQL
from sparkloom.plans.fixtures import CATS, HIST_SQL, STATS_SQL, USER_SQL
from sparkloom.plans.graphs import GRAPH_SQL, PR, _chain, classes, fixture, nodes, probs, seeds, vectors
from sparkloom.plans.registry import query
from sparkloom.sources import stores

WALK = ", walk AS (SELECT node, node AS reach FROM nodes UNION SELECT walk.node, dst FROM walk JOIN sym ON reach = src)"


def attributes(spark, d):
    """(node, dim, v): the embeddings as a sparse matrix."""
    return vectors(spark, d).select("node", F.posexplode("vec").alias("p", "v")).select("node", (F.col("p") + 1).cast("long").alias("dim"), F.col("v").cast("double").alias("v"))


def rounded(df, digits: int, *keep: str):
    return df.select(*keep, *(F.round(c, digits).alias(c) if kind == "double" else c for c, kind in df.dtypes if c not in keep))


_STATUS = ", ".join(f"(SELECT count(*) FROM {rel} e JOIN nodes m ON e.{b} = m.node WHERE e.{a} = n.node AND m.split = '{s}') AS {w}_{s}" for s in ("train", "test") for w, rel, a, b in (("out", "edges", "src", "dst"), ("in", "edges", "dst", "src"), ("sym", "sym", "src", "dst")))
_SCALARS = f"""SELECT n.node, deg_out, deg_in, deg_sym, round(ln(1 + deg_out), 8) AS log_out, round(ln(1 + deg_in), 8) AS log_in, round(ln(1 + deg_sym), 8) AS log_sym, round(s10.v, 8) AS pagerank,
  round(ln(1 + (SELECT coalesce(sum(deg.d), 0) FROM sym JOIN deg ON deg.node = dst WHERE src = n.node)), 8) AS log_hop2, round(ln(1 + list_sum(list_transform(vec.v, lambda x: (x <> 0)::INT))), 8) AS log_nnz,
  round(sqrt(list_sum(list_transform(vec.v, lambda x: x * x))), 8) AS attr_norm, {_STATUS}, round(ln(1 + size), 8) AS log_component, round(component_train, 8) AS component_train, round(component_test, 8) AS component_test
  FROM (SELECT nodes.*, (SELECT count(*) FROM edges WHERE src = node) AS deg_out, (SELECT count(*) FROM edges WHERE dst = node) AS deg_in, coalesce((SELECT d FROM deg WHERE deg.node = nodes.node), 0) AS deg_sym FROM nodes) n
  JOIN s10 ON s10.node = n.node JOIN vec ON vec.node = n.node JOIN comp ON comp.node = n.node JOIN parts ON parts.component = comp.component"""
_COMP = ", comp AS MATERIALIZED (SELECT node, min(reach) AS component FROM walk GROUP BY 1), parts AS (SELECT component, count(*) AS size, avg((split = 'train')::INT) AS component_train, avg((split = 'test')::INT) AS component_test FROM comp JOIN nodes USING (node) GROUP BY 1)"


@query(_SCALARS, GRAPH_SQL.replace("\nvec AS", "RECURSIVE\nvec AS", 1) + WALK + ", " + PR + _COMP)
def domain_scalars(spark, d):
    """Nineteen features of nodes that know no label; ten rounds of PageRank here."""
    return rounded(D.scalars(nodes(spark, d), fixture(spark, d), attributes(spark, d), 10), 8, "node")


@query()
def domain_features(spark, d):
    """The 83 columns: scalars and two decompositions of 32 columns each. A test holds them against dense ones."""
    return rounded(D.features(nodes(spark, d), fixture(spark, d), attributes(spark, d)), 6, "node")


@query()
def singular_values(spark, d):
    """(place, sigma) of the attributes' 32 largest."""
    m = attributes(spark, d).select(F.col("node").alias("row"), F.col("dim").alias("col"), F.col("v").alias("value"))
    sigma, _, _ = L.truncated_svd(m, 32)
    return spark.createDataFrame([(i, round(float(s), 6)) for i, s in enumerate(sigma)], "place long, sigma double")


@query("SELECT (SELECT round(sum(v * v), 4) FROM (SELECT unnest(v) AS v FROM vec)) AS squares", GRAPH_SQL)
def svd_all_squares(spark, d):
    """Squares of all singular values add up to those of the matrix: the decomposition at its full rank."""
    m = attributes(spark, d).select(F.col("node").alias("row"), F.col("dim").alias("col"), F.col("v").alias("value"))
    sigma, _, _ = L.truncated_svd(m, 64, extra=0, rounds=1)
    return spark.createDataFrame([(round(float((sigma**2).sum()), 4),)], "squares double")


def ridge_rows(spark, d, width: int):
    """(id, vec, label, fold) of labelled nodes, the first ``width`` dimensions."""
    s = seeds(spark, d).withColumnRenamed("label", "y")
    v = vectors(spark, d).join(s, "node")
    return v.select(F.col("node").alias("id"), F.slice(F.col("vec").cast("array<double>"), 1, width).alias("vec"), F.col("y").alias("label"), (F.col("node") % 3).alias("fold"))


def _cramer() -> str:
    """Normal equations of three columns, centred, with a penalty, by determinants."""
    x = ["v[1]", "v[2]", "v[3]"]
    sums = ", ".join([f"sum(w * {x[i]} * {x[j]}) AS s{i}{j}" for i in range(3) for j in range(i, 3)] + [f"sum(w * {a}) AS m{i}" for i, a in enumerate(x)] + [f"sum(w * {a} * t) AS r{i}" for i, a in enumerate(x)])
    a = lambda i, j: f"(s{min(i, j)}{max(i, j)} - m{i} * m{j} / n" + (" + 10.0" if i == j else "") + ")"
    b = lambda i: f"(r{i} - m{i} * ts / n)"

    def det(col: int | None) -> str:
        c = lambda i, j: f"b{i}" if j == col else f"a{i}{j}"
        return f"({c(0, 0)} * ({c(1, 1)} * {c(2, 2)} - {c(1, 2)} * {c(2, 1)}) - {c(0, 1)} * ({c(1, 0)} * {c(2, 2)} - {c(1, 2)} * {c(2, 0)}) + {c(0, 2)} * ({c(1, 0)} * {c(2, 1)} - {c(1, 1)} * {c(2, 0)}))"

    entries = ", ".join([f"{a(i, j)} AS a{i}{j}" for i in range(3) for j in range(3)] + [f"{b(i)} AS b{i}" for i in range(3)])
    coef = ", ".join(f"{det(i)} / {det(None)} AS c{i}" for i in range(3))
    return f"""fit AS (SELECT f.fold, x.node, x.v, x.label FROM (SELECT vec.*, node % 3 AS own FROM vec WHERE node % 5 <> 0) x JOIN (VALUES (0), (1), (2), (-1)) f(fold) ON x.own <> f.fold),
per AS (SELECT fold, label, count(*) AS nc, sum(count(*)) OVER (PARTITION BY fold) AS nn, count(*) OVER (PARTITION BY fold) AS k FROM fit GROUP BY fold, label),
rows AS (SELECT fit.fold, c.class, fit.v, nn / (k * nc) AS w, CASE WHEN fit.label = c.class THEN 1.0::DOUBLE ELSE -1.0 END AS t FROM fit JOIN per ON per.fold = fit.fold AND per.label = fit.label, classes c),
agg AS (SELECT fold, class, sum(w) AS n, sum(w * t) AS ts, {sums} FROM rows GROUP BY 1, 2),
ent AS (SELECT fold, class, n, ts, m0, m1, m2, {entries} FROM agg), sol AS (SELECT fold, class, n, ts, m0, m1, m2, {coef} FROM ent)"""


@query("SELECT fold::BIGINT AS fold, class::BIGINT AS class, round(c0, 8) AS b1, round(c1, 8) AS b2, round(c2, 8) AS b3, round(ts / n - (m0 * c0 + m1 * c1 + m2 * c2) / n, 8) AS b0 FROM sol", GRAPH_SQL + ", " + _cramer())
def ridge_coefficients(spark, d):
    """A ridge classifier of three dimensions, for each fold from the other folds, and under -1 from all."""
    names = sorted(r["class"] for r in classes(spark, d).collect())
    got = L.ridge_folds(ridge_rows(spark, d, 3), 3, names)
    rows = [(-1 if f is None else int(f), c, *(round(float(x), 8) for x in b[:, k])) for f, b in got.items() for k, c in enumerate(names)]
    return spark.createDataFrame(rows, "fold long, class long, b1 double, b2 double, b3 double, b0 double")


@query()
def ridge_oof(spark, d):
    """(node, class, p) of all nodes: labelled ones by coefficients that did not see their fold, others by those of all."""
    names = sorted(r["class"] for r in classes(spark, d).collect())
    width = len(vectors(spark, d).first().vec)
    got = L.ridge_folds(ridge_rows(spark, d, width), width, names)
    rows = nodes(spark, d).join(vectors(spark, d), "node").select(F.col("node").alias("id"), F.col("vec").cast("array<double>").alias("vec"), F.when(F.col("split") == "train", F.col("node") % 3).alias("fold"))
    return L.decisions(rows, got, names).select(F.col("id").alias("node"), "class", F.round("p", 6).alias("p"))


@query()
def stacked_ridge(spark, d):
    """(node, pred): a ridge stack of three models' probabilities, their logs and summaries, out of fold."""
    names = sorted(r["class"] for r in classes(spark, d).collect())
    s = E.stacked(probs(spark, d), ["cold", "hot", "mid"], names)
    columns = s.columns[1:]
    own = G.checkpointed(L.standardised(s, columns).select("node", "vec").join(nodes(spark, d), "node"))
    rows = own.select(F.col("node").alias("id"), "vec", "label", F.when(F.col("split") == "train", F.col("node") % 3).alias("fold"))
    got = L.ridge_folds(rows.where("fold is not null"), len(columns), names, alpha=30.0)
    best = L.decisions(rows, got, names, 1.8).groupBy("id").agg(F.max_by("class", F.struct(F.round("score", 9), -F.col("class"))).alias("pred"))
    return best.select(F.col("id").alias("node"), "pred")


_NEWTON = "SELECT n.f, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0, b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1 FROM (SELECT @.f, any_value(b0) AS b0, any_value(b1) AS b1, sum(p * (1 - p)) + 1e-12 AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) + 10 + 1e-12 AS h11, sum(p - y) AS g0, sum((p - y) * x) + 10 * any_value(b1) AS g1 FROM (SELECT z.*, o.f, o.b0, o.b1, 1 / (1 + exp(-(o.b0 + o.b1 * z.x))) AS p FROM z JOIN @ o ON z.fold <> o.f) @ GROUP BY @.f) n"
_Z = ", z AS MATERIALIZED (SELECT node, (split = 'test')::INT::DOUBLE AS y, node % 3 AS fold, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x FROM (SELECT node, split, v[1] AS x FROM nodes JOIN vec USING (node)))"


@query("SELECT f::BIGINT AS fold, round(b0, 8) AS b0, round(b1, 8) AS b1 FROM s12", GRAPH_SQL + _Z + ", " + _chain("SELECT f, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM (VALUES (-1), (0), (1), (2)) v(f)", _NEWTON, 12))
def logistic_coefficients(spark, d):
    """A logistic regression of the split on one dimension, for each fold from the others, and under -1 from all."""
    rows = nodes(spark, d).join(vectors(spark, d), "node").select("node", (F.col("split") == "test").cast("long").alias("label"), (F.col("node") % 3).alias("fold"), F.col("vec")[0].cast("double").alias("x"))
    got = L.logistic_folds(L.standardised(rows, ["x"]), 1, c=0.1)
    return spark.createDataFrame([(-1 if f is None else int(f), round(float(b[1]), 8), round(float(b[0]), 8)) for f, b in got.items()], "fold long, b0 double, b1 double")


@query()
def domain_propensity(spark, d):
    """(node, split, propensity, selected): logistic regressions on the nineteen scalars, five folds."""
    n = nodes(spark, d)
    rows = D.scalars(n, fixture(spark, d), attributes(spark, d), 10).join(n.select("node", "split"), "node").withColumn("fold", F.expr("node div 5 % 5"))
    return D.propensity(rows, D.SCALARS).withColumn("propensity", F.round("propensity", 6))


@query()
def router_report(spark, d):
    """A router between the centroid model and the votes of the ten nearest other seeds, fitted on their disagreements out
    of fold, and what its choices gain, from a probability of 0.1 on, which ten even classes can reach."""
    s = E.summaries(probs(spark, d).where("model = 'hot'"), ["model", "node"]).drop("model")
    votes = G.knn_votes(vectors(spark, d), seeds(spark, d), (10,), lambda a, b, k: N.nearest(a, b, k, itself=False))
    best = votes.groupBy("node").agg(F.max_by("class", F.struct(F.round("vote", 9), -F.col("class"))).alias("graph"), F.max("vote").alias("vote"))
    rows = nodes(spark, d).join(s.withColumnRenamed("pred", "base"), "node").join(best, "node").join(G.degrees(nodes(spark, d), fixture(spark, d)), "node")
    rows = rows.where("split = 'train'").withColumns({"log_deg": F.log1p("deg"), "fold": F.col("node") % 5})
    routed = D.crossfit_router(rows, ["confidence", "margin", "entropy", "vote", "log_deg"]).withColumn("selected", F.coalesce(F.col("p") >= 0.1, F.lit(False)))
    return D.fold_gains(routed)


K_CLUSTERS, LLOYD = 12, 6
_CODES = ", ".join(f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}" for c in CATS)
_Z6 = ", ".join(f"CASE WHEN stddev_pop({c}) OVER () > 1e-12 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END AS x{i}" for i, c in enumerate(CATS))
_D6 = " + ".join(f"(u.x{i} - c.x{i}) * (u.x{i} - c.x{i})" for i in range(6))
_AT = f"SELECT uid, arg_min(cluster, round(dd, 9) * 1000 + cluster * 1e-9) AS cluster FROM (SELECT u.uid, c.cluster, {_D6} AS dd FROM xs u, @ c) GROUP BY uid"
_LLOYD = f"SELECT o.cluster, {', '.join(f'coalesce(avg(xs.x{i}), any_value(o.x{i})) AS x{i}' for i in range(6))} FROM @ o LEFT JOIN ({_AT}) a ON a.cluster = o.cluster LEFT JOIN xs ON xs.uid = a.uid GROUP BY o.cluster"
CLUSTER_SQL = HIST_SQL + USER_SQL + f", xs AS MATERIALIZED (SELECT uid, target, {_Z6} FROM (SELECT uid, target, {_CODES} FROM uc)), " + _chain(f"SELECT row_number() OVER (ORDER BY md5('seed:' || uid), uid) - 1 AS cluster, {', '.join(f'x{i}' for i in range(6))} FROM xs ORDER BY md5('seed:' || uid), uid LIMIT {K_CLUSTERS}", _LLOYD, LLOYD) + f", member AS MATERIALIZED ({_AT.replace('@', f's{LLOYD}')})"
_TOP = "(SELECT cluster, target AS iid, count(*) AS cnt, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, target) AS place FROM member JOIN tgt USING (uid) GROUP BY 1, 2)"
_POP = "(SELECT target AS iid, row_number() OVER (ORDER BY count(*) DESC, target) AS place FROM tgt GROUP BY 1)"


def cluster_rows(spark, d):
    """(uid, target, cluster): users by Lloyd rounds over their scaled categories, from seeds by hash."""
    own = CL.coded(T.hu(spark, d).select("uid", "target", *CATS), CATS)
    own = G.checkpointed(L.standardised(own, [f"_{c}" for c in CATS]).select(F.col("uid").alias("id"), "vec", "target"))
    centres = CL.lloyd(own, CL.hash_seeds(own, K_CLUSTERS), LLOYD)
    return CL.assigned(own, centres).select(F.col("id").alias("uid"), "cluster").join(own.select(F.col("id").alias("uid"), "target"), "uid")


@query("SELECT uid, cluster FROM member", CLUSTER_SQL)
def cold_clusters(spark, d):
    return cluster_rows(spark, d).select("uid", "cluster")


@query(f"SELECT cluster, place, iid, cnt FROM {_TOP} WHERE place <= 10", CLUSTER_SQL)
def cluster_top10(spark, d):
    rows = cluster_rows(spark, d)
    return CL.cluster_tops(rows.select("uid", "cluster"), rows.select("uid", "target"))


@query(f"SELECT uid, array_to_string(list(iid ORDER BY kind, place)[1:10], ',') AS items FROM (SELECT uid, iid, min(kind) AS kind, arg_min(place, kind) AS place FROM (SELECT uid, 0 AS kind, place, iid FROM member JOIN {_TOP} t USING (cluster) WHERE place <= 10 UNION ALL SELECT uid, 1, place, iid FROM member, {_POP} WHERE place <= 10) GROUP BY uid, iid) GROUP BY uid", CLUSTER_SQL)
def cold_recommend(spark, d):
    """Ten items of each user's cluster, filled up with the most popular."""
    rows = G.checkpointed(cluster_rows(spark, d))
    tops = CL.cluster_tops(rows.select("uid", "cluster"), rows.select("uid", "target"))
    popular = rows.groupBy(F.col("target").alias("iid")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "iid").limit(10)
    popular = spark.createDataFrame([(i + 1, r.iid) for i, r in enumerate(popular.collect())], "place long, iid string")  # ten rows
    lists = rows.select("uid", "cluster").join(tops, "cluster")
    return CL.filled_lists(rows, "uid", lists, popular).select("uid", F.array_join("items", ",").alias("items"))


_COLD = "(SELECT uid, iid, row_number() OVER (PARTITION BY uid ORDER BY round(s, 9) DESC, iid) AS place FROM coldscore)"


@query(f"SELECT uid, array_to_string(list(iid ORDER BY kind, place)[1:25], ',') AS items FROM (SELECT uid, iid, min(kind) AS kind, arg_min(place, kind) AS place FROM (SELECT uid, 0 AS kind, place, iid FROM {_COLD} WHERE place <= 25 UNION ALL SELECT uid, 1, place, iid FROM tgt, {_POP} WHERE place <= 25) GROUP BY uid, iid) GROUP BY uid", HIST_SQL + STATS_SQL + K.SIM_SQL)
def cold_cosine_filled(spark, d):
    """25 targets of the users that are most alike, filled up with the most popular ones."""
    h = G.checkpointed(T.hu(spark, d))
    sims = H.similar_users(h.select("uid", *CATS), CATS)
    score = sims.join(h.select(F.col("uid").alias("other"), F.col("target").alias("iid")), "other").groupBy("uid", "iid").agg(F.round(F.sum("sim"), 9).alias("s"))
    lists = score.withColumn("place", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("s"), "iid")).cast("long")).where("place <= 25")
    popular = h.groupBy(F.col("target").alias("iid")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "iid").limit(25)
    popular = spark.createDataFrame([(i + 1, r.iid) for i, r in enumerate(popular.collect())], "place long, iid string")  # 25 rows
    return CL.filled_lists(h, "uid", lists, popular, 25).select("uid", F.array_join("items", ",").alias("items"))


_NEAR = "(SELECT a.node, b.node AS other, list_cosine_similarity(a.v, b.v) AS sim, row_number() OVER (PARTITION BY a.node ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.node) AS place FROM vec a, vec b WHERE a.node % 50 = 0)"


@query(f"SELECT node, other, place, round(sim, 6) AS sim FROM {_NEAR} WHERE place <= 10", GRAPH_SQL)
def knn_indexed(spark, d):
    """The ten nearest of every vector whose id is divisible by 50, by the inverted file: all rows, cells skipped by proof."""
    v = vectors(spark, d)
    return N.search(v.where("node % 50 = 0"), N.build(v), 10).select("node", "other", "place", F.round("sim", 6).alias("sim"))


@query()
def knn_recall(spark, d):
    """(probes, n, recall) of the index without its second step, against the exact neighbours."""
    v = G.checkpointed(vectors(spark, d))
    index, asked = N.build(v), v.where("node % 50 = 0")
    truth, out = G.checkpointed(N.search(asked, index, 10)), None
    for probes in (2, 8, 1_000_000):
        one = N.recall(N.search(asked, index, 10, probes=probes, exact=False), truth).select(F.lit(min(probes, len(index.size))).cast("long").alias("probes"), "n", F.round("recall", 6).alias("recall"))
        out = one if out is None else out.unionByName(one)
    return out


def _hash60(key: str) -> str:
    return f"CAST(concat('0x', substr(md5({key}), 1, 15)) AS BIGINT)"


_SEEN = HIST_SQL + ", vocab AS (SELECT item AS iid, row_number() OVER (ORDER BY item) - 1 AS idx FROM (SELECT item FROM hist UNION SELECT target FROM tgt)), seen AS (SELECT uid, item FROM dd UNION SELECT uid, target FROM tgt), free AS (SELECT t.uid, iid, row_number() OVER (PARTITION BY t.uid ORDER BY idx) - 1 AS nth, count(*) OVER (PARTITION BY t.uid) AS m FROM tgt t, vocab WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.uid = t.uid AND s.item = iid))"


@query(f"SELECT uid, j::BIGINT AS j, iid FROM free, range(1, 4) r(j) WHERE nth = {_hash60('uid || chr(58) || chr(110) || chr(101) || chr(103) || chr(58) || j')} % m", _SEEN)
def uniform_negatives(spark, d):
    """Three draws a user of the items that the user has not seen."""
    h = T.h(spark, d).select("uid", "raw", "target", F.array_union("dedup", F.array("target")).alias("seen"))
    items = h.select(F.explode(F.array_union("raw", F.array("target"))).alias("iid"))
    return S.uniform_negatives(h, items)


_POPW = HIST_SQL + ", cnt AS (SELECT item AS iid, count(*) AS n FROM hist GROUP BY 1), wts AS (SELECT iid, greatest(round(1000 * pow(n::DOUBLE, 0.75))::BIGINT, 1) AS w FROM cnt), rng AS MATERIALIZED (SELECT iid, w, (sum(w) OVER (ORDER BY iid) - w)::BIGINT AS lo FROM wts), own AS (SELECT uid, target, coalesce(w, 0) AS w, coalesce(lo, (SELECT sum(w) FROM wts)) AS lo FROM tgt LEFT JOIN rng ON iid = target), dr AS (SELECT uid, j, lo, w, (" + _hash60("uid || ':pop:' || j") + " % ((SELECT sum(w) FROM wts) - w))::BIGINT AS u FROM own, range(1, 6) r(j))"


@query("SELECT uid AS \"key\", j::BIGINT AS j, iid FROM (SELECT uid, j, CASE WHEN u >= lo THEN u + w ELSE u END AS u FROM dr) x JOIN rng ON u >= rng.lo AND u < rng.lo + rng.w", _POPW)
def popularity_negatives(spark, d):
    """Five draws a user in proportion to count^0.75, never the target."""
    h = T.h(spark, d)
    counts = h.select(F.explode("raw").alias("iid")).groupBy("iid").agg(F.count("*").alias("cnt"))
    return S.popularity_negatives(h.select(F.col("uid").alias("key"), "target"), S.popularity_ranges(counts))


_PRE = HIST_SQL + f""", len AS (SELECT uid, max(n) AS n FROM hist GROUP BY 1 HAVING max(n) > 1),
rec AS (SELECT uid, {_hash60("uid || ':prefix:a:' || p")} AS k, 0 AS nth, p FROM len, LATERAL (SELECT unnest(range(greatest(1, n - 48), n)) AS p)),
ext AS (SELECT uid, {_hash60("uid || ':prefix:c:' || p")} AS k, 1 AS nth, p FROM (SELECT uid, p, row_number() OVER (PARTITION BY uid ORDER BY {_hash60("uid || ':prefix:b:' || p")}, p) AS r FROM len, LATERAL (SELECT unnest(range(1, n)) AS p) WHERE n > 64) WHERE r <= 10),
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY k, nth, p) AS r FROM (SELECT * FROM rec UNION ALL SELECT * FROM ext)) WHERE r <= 36),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY k, uid, nth, p) AS g FROM pick) WHERE g <= 4000)"""


@query("SELECT c.uid, c.nth::BIGINT AS nth, c.p::BIGINT AS pos, (SELECT string_agg(item, ',' ORDER BY pos) FROM hist h WHERE h.uid = c.uid AND h.pos < c.p AND h.pos >= c.p - 50) AS prefix, (SELECT item FROM hist h WHERE h.uid = c.uid AND h.pos = c.p) AS next FROM capped c", _PRE)
def capped_prefixes(spark, d):
    """Recent places and ten more of long histories, 36 a user, 4,000 in all."""
    return S.capped_prefixes(T.h(spark, d), cap=4000).withColumn("prefix", F.array_join("prefix", ","))


@query("SELECT node AS uid, iid, place, round(score, 6) AS score FROM (SELECT a.node, CAST(b.node AS VARCHAR) AS iid, list_inner_product(a.v, b.v) AS score, row_number() OVER (PARTITION BY a.node ORDER BY round(list_inner_product(a.v, b.v), 9) DESC, CAST(b.node AS VARCHAR)) AS place FROM vec a, vec b WHERE a.node % 5 = 0 AND NOT EXISTS (SELECT 1 FROM sym WHERE src = a.node AND dst = b.node) AND a.node <> b.node) WHERE place <= 10", GRAPH_SQL)
def masked_products(spark, d):
    """Every test node against all vectors by inner product, its neighbours and itself masked."""
    v = vectors(spark, d)
    near = G.symmetric(fixture(spark, d)).groupBy(F.col("src").alias("node")).agg(F.collect_list(F.col("dst").cast("string")).alias("seen"))
    users = v.where("node % 5 = 0").join(near, "node", "left").select(F.col("node").alias("uid"), "vec", F.concat(F.coalesce("seen", F.array().cast("array<string>")), F.array(F.col("node").cast("string"))).alias("seen"))
    return P.top_products(users, v.select(F.col("node").cast("string").alias("iid"), "vec"), 10, block=256).select("uid", "iid", "place", F.round("score", 6).alias("score"))


@query()
def greedy_boosts(spark, d):
    """(round, class, factor, hits, accuracy) of the search for class factors on the labelled nodes."""
    _, history = P.greedy_boosts(probs(spark, d).where("model = 'mid'").select("node", "class", "p"), seeds(spark, d))
    return history.withColumn("accuracy", F.round("accuracy", 6))


_WAY = """, pr AS (SELECT class, (count(s.node) + 1) / ((SELECT count(*) FROM seeds) + (SELECT count(*) FROM classes)) AS prior FROM classes LEFT JOIN seeds s ON s.label = class GROUP BY 1),
cn AS MATERIALIZED (SELECT w.way, n.node, pr.class, prior, (SELECT count(*) FROM (SELECT 'out' AS way, src, dst FROM edges UNION ALL SELECT 'in', dst, src FROM edges) e JOIN seeds s ON s.node = e.dst WHERE e.way = w.way AND e.src = n.node AND s.label = pr.class) AS c FROM nodes n, pr, (VALUES ('out'), ('in')) w(way)),
po AS MATERIALIZED (SELECT *, sum(c) OVER (PARTITION BY way, node) AS m, (c + 2 * prior) / (sum(c) OVER (PARTITION BY way, node) + 2) AS p FROM cn),
best AS (SELECT way, node, max(m) AS m, max(p) AS top, list_sort(list(p), 'DESC')[2] AS second, arg_min(class, -round(p, 9) * 1000 + class * 1e-9) AS pred FROM po GROUP BY 1, 2),
qual AS (SELECT w.way, greatest(coalesce((SELECT avg((pred = label)::INT) FROM best JOIN seeds USING (node) WHERE best.way = w.way AND m > 0), (SELECT max(prior) FROM pr)) - (SELECT max(prior) FROM pr), 0.01) AS q FROM (VALUES ('out'), ('in')) w(way)),
wt2 AS (SELECT way, node, q * sqrt(m) * (0.25 + top - second) AS w FROM best JOIN qual USING (way))"""


@query("SELECT node, class, round(v / sum(v) OVER (PARTITION BY node), 8) AS p FROM (SELECT node, class, least(greatest(CASE WHEN sum(w) > 0 THEN sum(w * p) / sum(w) ELSE max(prior) END, 1e-9), 1) AS v FROM po JOIN wt2 USING (way, node) GROUP BY 1, 2)", GRAPH_SQL + _WAY)
def directional_weighted(spark, d):
    """Posteriors of out- and in-neighbours, weighed by their accuracy on seeds, their mass and their margin."""
    return G.weighted_onehop(nodes(spark, d), fixture(spark, d), seeds(spark, d), classes(spark, d)).select("node", "class", F.round("p", 8).alias("p"))


@query("SELECT node, class, " + ", ".join(f"round(max(p) FILTER (WHERE model = '{m}'), 6) AS {m}_score" for m in ("cold", "hot", "mid")) + " FROM probs WHERE model <> 'hot' OR node % 10 <> 0 GROUP BY 1, 2", PSQL)
def score_union(spark, d):
    """Three models' scores as one table; one of them lacks some nodes."""
    p = probs(spark, d).where("model <> 'hot' or node % 10 <> 0").withColumn("score", F.round("p", 6))
    return stores.score_union({m: p.where(F.col("model") == m) for m in ("cold", "hot", "mid")}, ["node", "class"])

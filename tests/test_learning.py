"""Decompositions, models, clusters, indexes, draws and stores against plain computations."""

import glob
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import cluster as CL
from sparkloom.operators import domain as D
from sparkloom.operators import graph as G
from sparkloom.operators import linalg as L
from sparkloom.operators import neighbours as N
from sparkloom.operators import ordering as O
from sparkloom.operators import products as P
from sparkloom.operators import sampling as S
from sparkloom.plans import catalog
from sparkloom.sources import stores

from .conftest import SF
from .test_oracles import normal

WITH_SQL = ["pair_features_all", "chunked_cooccurrence", "domain_scalars", "svd_all_squares", "ridge_coefficients", "logistic_coefficients", "cold_clusters", "cluster_top10", "cold_recommend", "knn_indexed", "uniform_negatives", "popularity_negatives", "capped_prefixes", "masked_products", "directional_weighted", "score_union", "item_texts", "count_texts", "dedup_fallback", "metadata_fallback", "frozen_scores", "lists_read_back", "reindexed_scores", "mask_schedule", "query_offsets", "training_order", "temperature_grid", "cold_cosine_filled"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    out = duck.execute(catalog.ORACLES[name])
    columns = [x[0] for x in out.description]
    assert names == sorted(columns)
    assert normal(tuple(r[c] for c in names) for r in df.collect()) == normal(tuple(r[columns.index(c)] for c in names) for r in out.fetchall())


def table(spark, x):
    rows = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    return spark.createDataFrame(rows, "row long, col long, value double").repartition(3)


def block(df, n, k):
    out = np.zeros((n, k))
    for r in df.collect():
        out[r.row] = r.vec
    return out


def test_products_with_a_small_block_leave_rows_in_place(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(60, 7))
    m, b = table(spark, x), spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)], "row long, vec array<double>")
    want = x @ np.array([[i, 1.0] for i in range(7)])
    for small in (True, False):
        got = {r.row: r.vec for r in L.times(m, b, 2, small).collect()}
        assert np.allclose(np.array([got[i] for i in sorted(got)]), want)
    plan = L.times(m.repartition("row"), b, 2, True)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan.lower()
    monkeypatch.setattr(L, "MOST_SENT", 0)
    assert np.allclose(L.truncated_svd(m, 4)[0], np.linalg.svd(x)[1][:4], atol=1e-5)


def test_truncated_svd_against_dense(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 40)) * (r.random((60, 40)) < 0.3)
    x[7] = 0  # a row without entries
    sigma, left, right = L.truncated_svd(table(spark, x), 8, rounds=14)
    u, s, v = np.linalg.svd(x)
    assert np.allclose(sigma, s[:8], atol=1e-6)
    lu, rv = block(left, 60, 8), block(right, 40, 8)
    assert np.allclose(lu.T @ lu, np.eye(8), atol=1e-8) and np.allclose(rv.T @ rv, np.eye(8), atol=1e-6)
    assert np.allclose(np.abs((lu * u[:, :8]).sum(0)), 1, atol=1e-5) and np.allclose(x @ rv, lu * sigma, atol=1e-4)
    assert (rv[np.abs(rv).round(9).argmax(0), range(8)] > 0).all()
    low = np.outer(np.arange(1, 21), np.ones(9)) + np.outer(np.ones(20), np.arange(9))  # rank 2 of 5 asked for
    sigma, _, _ = L.truncated_svd(table(spark, low), 5)
    assert np.allclose(sigma, np.linalg.svd(low)[1][:5], atol=1e-5)


def test_domain_features_against_dense(spark):
    got = {r.node: r for r in catalog.QUERIES["domain_features"](spark, SF).collect()}
    x = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(x)
    assert len(next(iter(got.values()))) == 1 + 83 and sorted(got) == ids
    u, s, v = np.linalg.svd(np.array([x[i] for i in ids]), full_matrices=False)
    want = u[:, :32] * s[:32] * np.sign(v[range(32), np.abs(v[:32]).argmax(1)])
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    have = np.array([[got[i][f"attr_{k}"] for k in range(32)] for i in ids])
    gaps = (s[:31] - s[1:32]) / s[0]
    assert np.abs(have - want)[:, :8].max() < 0.02 or gaps[:8].min() < 1e-3  # single vectors are as stable as their gaps
    assert np.abs(have @ have.T - want @ want.T).max() < 0.12


def ridge_plain(x, y, classes, alpha, balanced=True):
    n = np.array([(y == c).sum() for c in classes])
    w = np.array([len(y) / ((n > 0).sum() * n[classes.index(c)]) for c in y]) if balanced else np.ones(len(y))
    t = np.array([[1.0 if c == k else -1.0 for k in classes] for c in y])
    mx, mt = np.average(x, axis=0, weights=w), np.average(t, axis=0, weights=w)
    b = np.linalg.solve(((x - mx) * w[:, None]).T @ (x - mx) + alpha * np.eye(x.shape[1]), ((x - mx) * w[:, None]).T @ (t - mt))
    return np.vstack([b, mt - mx @ b])


def test_ridge_of_all_folds_in_one_pass(spark):
    r = np.random.default_rng(2)
    x, y, fold = r.normal(size=(200, 6)), r.integers(0, 4, 200), r.integers(0, 3, 200)
    y[fold != 1] = np.minimum(y[fold != 1], 2)  # class 3 is in fold 1 alone
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), int(fold[i])) for i in range(200)], "id long, vec array<double>, label long, fold long").repartition(4)
    for balanced in (True, False):
        got = L.ridge_folds(rows, 6, [0, 1, 2, 3], 10.0, balanced)
        assert set(got) == {None, 0, 1, 2}
        for f, b in got.items():
            m = fold != f if f is not None else np.ones(200, bool)
            assert np.allclose(b, ridge_plain(x[m], y[m], [0, 1, 2, 3], 10.0, balanced), atol=1e-9)
    p = L.decisions(rows, got, [0, 1, 2, 3]).collect()
    assert len(p) == 800 and np.allclose([sum(q.p for q in p if q.id == i) for i in range(20)], 1)
    one = next(q for q in p if q.id == 5 and q["class"] == 2)
    assert np.isclose(one.score, (np.append(x[5], 1) @ got[int(fold[5])])[2])


def test_logistic_by_newton(spark):
    r = np.random.default_rng(3)
    x, fold = r.normal(size=(300, 3)), r.integers(0, 4, 300)
    y = (r.random(300) < 1 / (1 + np.exp(-(x @ [1.5, -2, 0.3] + 0.4)))).astype(int)
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), int(fold[i])) for i in range(300)], "id long, vec array<double>, label long, fold long").repartition(4)
    got = L.logistic_folds(rows, 3, c=0.5)
    for f, b in got.items():
        m = fold != f if f is not None else np.ones(300, bool)
        z = np.hstack([x[m], np.ones((m.sum(), 1))])
        gradient = z.T @ (1 / (1 + np.exp(-(z @ b))) - y[m]) + np.append(b[:3] / 0.5, 0)
        assert np.abs(gradient).max() < 1e-6  # the optimum of a convex problem
    p = {q.id: q.p for q in L.probabilities(rows, got).collect()}
    assert np.allclose([p[i] for i in range(300)], [1 / (1 + np.exp(-(np.append(x[i], 1) @ got[int(fold[i])]))) for i in range(300)])


def test_propensity_and_router(spark):
    r = random.Random(4)
    rows = [(i, "test" if r.random() < 0.3 + 0.4 * (i % 2) else "train", i % 5, float(i % 2) + r.random() / 10) for i in range(400)]
    got = {x.node: x for x in D.propensity(spark.createDataFrame(rows, "node long, split string, fold long, a double"), ["a"]).collect()}
    train = [x for x in got.values() if x.split == "train"]
    assert len(got) == 400 and sum(x.selected for x in got.values()) == round(0.2 * len(train))
    assert min(x.propensity for x in train if x.selected) >= max(x.propensity for x in train if not x.selected) - 1e-9
    rows = [(i, i % 2, (i // 2) % 2, (i // 2) % 2 if i % 3 else i % 2, i // 4 % 4, float(i % 3 > 0)) for i in range(300)]
    routed = D.crossfit_router(spark.createDataFrame(rows, "node long, base long, graph long, label long, fold long, x double"), ["x"], c=10.0)
    out = routed.collect()
    assert all((q.p is None) == (q.base == q.graph) for q in out)
    assert all((q.p > 0.5) == (q.x == 1.0) for q in out if q.p is not None)
    gain = D.fold_gains(routed.withColumn("selected", F.coalesce(F.col("p") > 0.5, F.lit(False)))).first()
    assert gain.n == 300 and gain.worsened == 0 and gain.least_net > 0


def lloyd_plain(x, c, rounds):
    for _ in range(rounds):
        at = np.round(((x[:, None] - c[None]) ** 2).sum(2), 9).argmin(1)
        after = np.array([x[at == k].mean(0) if (at == k).any() else c[k] for k in range(len(c))])
        if np.abs(after - c).max() <= 1e-9:
            break
        c = after
    return c


def test_lloyd_and_seeding(spark):
    r = np.random.default_rng(5)
    homes = r.normal(size=(6, 4)) * 10
    x = np.vstack([h + r.normal(size=(30, 4)) for h in homes] + [homes[:1] + r.normal(size=(200, 4))])  # one holds most
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)
    seeds = CL.hash_seeds(rows, 6)
    assert np.allclose(CL.lloyd(rows, seeds), lloyd_plain(x, seeds, 50))
    spread = CL.parallel_seeds(rows, 6)
    at = {q.id: q.cluster for q in CL.assigned(rows, CL.lloyd(rows, spread)).collect()}
    assert spread.shape == (6, 4) and len({at[i] for i in range(0, 180, 30)}) == 6  # every home has a cluster
    assert len(CL.parallel_seeds(rows.limit(3), 6)) <= 6


def test_filled_lists(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "uid string")
    lists = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "uid string, place long, iid string")
    popular = spark.createDataFrame([(i + 1, v) for i, v in enumerate("pxq")], "place long, iid string")
    got = {r.uid: r["items"] for r in CL.filled_lists(keys, "uid", lists, popular, 4).collect()}
    assert got == {"a": ["x", "y", "p", "q"], "b": ["p", "x", "q"]}


def test_index_skips_cells_and_stays_exact(spark, monkeypatch):
    r = np.random.default_rng(6)
    homes = r.normal(size=(40, 8))
    x = np.vstack([h + 0.05 * r.normal(size=(25, 8)) for h in homes] + [homes[0] + 0.05 * r.normal(size=(500, 8)), np.zeros((2, 8))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, vec array<double>").repartition(3)
    asked, index, report = rows.where("node % 50 = 0"), N.build(rows, 40), {}
    want = {(a.node, a.other, a.place) for a in G.most_similar(asked, rows, 7).collect()}
    got = N.search(asked, index, 7, block=64, report=report).collect()
    assert {(a.node, a.other, a.place) for a in got} == want
    assert report["skipped"] > 3 * report["visits"]
    alone = N.search(asked, index, 7, itself=False).collect()
    assert {(a.node, a.other, a.place) for a in alone} == {(a.node, a.other, a.place) for a in G.most_similar(asked, rows, 7, itself=False).collect()}
    some = N.recall(N.search(asked, index, 7, probes=4, exact=False), N.search(asked, index, 7)).first()
    assert some.n == len(want) and some.recall >= 0.9
    monkeypatch.setattr(N, "FEW_BLOCKS", 1)  # by the index, as for large tables
    assert {(a.node, a.other, a.place) for a in N.nearest(asked, rows, 7, block=16).collect()} == want
    assert N.search(asked, N.build(rows.limit(3), 5), 7).count() == 3 * asked.count()
    assert N.search(asked, N.build(rows.limit(0)), 7).count() == 0


def test_vectors_are_copied_to_parts_and_not_to_cells(spark):
    """Where no cell is skipped, a vector goes to parts of several cells; large cells are cut."""
    first, pieces = N._parts(np.array([30, 30, 50, 250, 0, 10]), 100)
    assert first.tolist() == [0, 0, 1, 2, 5, 5] and pieces.tolist() == [1, 1, 1, 3, 1, 1]
    r = np.random.default_rng(8)
    x = np.vstack([r.normal(size=(300, 12)), np.repeat(r.normal(size=(1, 12)), 120, 0)])  # noise, and copies of one text
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, vec array<double>").repartition(3)
    asked, index, report = rows.where("node % 4 = 0"), N.build(rows, 20), {}
    want = {(a.node, a.other, a.place) for a in G.most_similar(asked, rows, 5, itself=False).collect()}
    assert {(a.node, a.other, a.place) for a in N.search(asked, index, 5, itself=False, block=64, report=report).collect()} == want
    live = int((index.size > 0).sum())
    assert report["visits"] + report["skipped"] == asked.count() * live


def test_recall_of_the_index_on_the_table(spark):
    got = {r.probes: r for r in catalog.QUERIES["knn_recall"](spark, SF).collect()}
    assert all(r.n == 100 for r in got.values()) and got[max(got)].recall == 1.0


def test_places_and_running_sums(spark):
    r = random.Random(7)
    rows = [(i, r.choice([None, 1.0, 2.0, 2.0, 3.5]), r.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v double, w long").repartition(5)
    by = sorted(rows, key=lambda x: (x[2], x[0]))
    assert {x.id: x.n for x in O.numbered(df, ["w", "id"], "n").collect()} == {x[0]: i for i, x in enumerate(by)}
    sums, total = {}, 0
    for x in by:
        sums[x[0]], total = total, total + x[2]
    assert {x.id: x.s for x in O.running_sum(df, ["w", "id"], "w", "s", inclusive=False).collect()} == sums
    ranks = {x.id: x.r for x in O.mean_ranks(df, "v", "r").collect()}
    own = sorted(x[1] for x in rows if x[1] is not None)
    assert all(ranks[x[0]] == (None if x[1] is None else own.index(x[1]) + (own.count(x[1]) + 1) / 2) for x in rows)
    keyed = df.withColumn("k", S.hash60(F.col("w").cast("string")))  # ten values: ties everywhere
    order = sorted(((x.k, x.id) for x in keyed.collect()))
    for n in (0, 1, 37, 499, 500, 900):
        assert sorted((x.k, x.id) for x in O.least_by_hash(keyed, "k", n, ["id"]).collect()) == order[:n]
        assert sorted((x.k, x.id) for x in O.least_by_hash(keyed, "k", n, ["id"], few=0).collect()) == order[:n]
    assert O.numbered(df.limit(0), ["id"], "n").count() == 0


def test_negatives_are_exact_and_follow_the_weights(spark):
    counts = spark.createDataFrame([(f"i{k:02}", 1000 // (k + 1)) for k in range(40)] + [("hot", 20_000)], "iid string, cnt long")
    keys = spark.createDataFrame([(f"u{k}", "hot" if k % 2 else "i03") for k in range(400)] + [("new", "unknown")], "key string, target string")
    got = S.popularity_negatives(keys, S.popularity_ranges(counts), 50).collect()
    assert len(got) == 401 * 50 and len({(r.key, r.j) for r in got}) == len(got)
    target = {r.key: r.target for r in keys.collect()}
    assert all(r.iid != target[r.key] for r in got)
    for side in ("hot", "i03"):  # chi-square against the weights without the target
        w = {r.iid: max(round(1000 * r.cnt**0.75), 1) for r in counts.collect() if r.iid != side}
        drawn = [r.iid for r in got if target[r.key] == side]
        chi = sum((drawn.count(i) - len(drawn) * x / sum(w.values())) ** 2 / (len(drawn) * x / sum(w.values())) for i, x in w.items())
        assert chi < 39 + 4 * (2 * 39) ** 0.5
    items = spark.createDataFrame([(f"i{k}",) for k in range(6)], "iid string")
    h = spark.createDataFrame([(f"u{k}", ["i1", "i4", "gone"]) for k in range(200)] + [("none", []), ("all", [f"i{k}" for k in range(6)]), ("null", None)], "uid string, seen array<string>")
    got = S.uniform_negatives(h, items, 10).collect()
    assert len(got) == 202 * 10 and not any(r.iid in ("i1", "i4") for r in got if r.uid[1:].isdigit())
    n = [sum(r.iid == f"i{k}" for r in got if r.uid[1:].isdigit()) for k in (0, 2, 3, 5)]
    assert sum((x - 500) ** 2 / 500 for x in n) < 16
    assert S.popularity_negatives(keys, S.popularity_ranges(counts.limit(0))).count() == 0


def test_pairs_of_long_histories(spark):
    from sparkloom.operators import sequences as Q

    r = random.Random(12)
    h = spark.createDataFrame([(f"u{k}", [f"i{r.randint(0, 400):03}" for _ in range(n)]) for k, n in enumerate([0, 1, 2, 7, 8, 9, 16, 17, 300])], "uid string, dedup array<string>")
    want = sorted(map(tuple, Q.unordered_pairs(h).collect()))
    for part in (1, 8, 50):
        assert sorted(map(tuple, Q.chunked_pairs(h, part).collect())) == want


def test_prefix_caps(spark):
    h = spark.createDataFrame([("long", [f"i{k}" for k in range(300)]), ("short", ["a", "b", "c"]), ("one", ["a"]), ("none", [])], "uid string, raw array<string>")
    got = S.capped_prefixes(h).collect()
    assert sum(r.uid == "long" for r in got) == 36 and sorted(r.pos for r in got if r.uid == "short") == [1, 2] and {r.uid for r in got} == {"long", "short"}
    assert all(r.next == f"i{r.pos}" and r.prefix == [f"i{k}" for k in range(max(0, r.pos - 50), r.pos)] for r in got if r.uid == "long")
    assert all(r.pos >= 252 for r in got if r.uid == "long" and r.nth == 0)
    assert S.capped_prefixes(h, cap=5).count() == 5


def test_products_stop_early(spark):
    r = np.random.default_rng(8)
    items = [(f"i{k:03}", (r.normal(size=5) * (20 if k < 30 else 0.1)).tolist()) for k in range(600)]
    users = [(k, r.normal(size=5).tolist(), [f"i{j:03}" for j in r.integers(0, 40, 6)]) for k in range(40)] + [(99, [0.0] * 5, None)]
    report = {}
    got = P.top_products(spark.createDataFrame(users, "uid long, vec array<double>, seen array<string>"), spark.createDataFrame(items, "iid string, vec array<double>"), 5, block=32, report=report).collect()
    for uid, v, seen in users:
        want = sorted(((-round(float(np.dot(v, x)), 9), i) for i, x in items if i not in (seen or [])))[:5]
        assert [(x.place, x.iid) for x in sorted(got, key=lambda x: x.place) if x.uid == uid] == [(k + 1, i) for k, (_, i) in enumerate(want)]
    assert report["read"] < 0.3 * report["all"]


def test_greedy_boosts_against_a_plain_search(spark):
    r = np.random.default_rng(9)
    x = r.dirichlet(np.ones(4), 300)
    y = (x * [1, 1.25, 1, 0.9]).argmax(1)
    rows = [(i, c, float(x[i, c])) for i in range(300) for c in range(4)]
    truth = spark.createDataFrame([(i, int(y[i])) for i in range(300)], "node long, label long")
    factors = (1.05, 1.1, 1.2)
    got, history = P.greedy_boosts(spark.createDataFrame(rows, "node long, class long, p double"), truth, factors)
    state, hits = [1.0] * 4, (np.round(x, 9).argmax(1) == y).sum()
    steps = [hits]
    while True:
        tried = []
        for c in range(4):
            for b in (1.0, *factors):
                if b != state[c]:
                    s = [*state[:c], b, *state[c + 1 :]]
                    tried.append((-(np.round(x * s, 9).argmax(1) == y).sum(), c, b))
        best = min(tried)
        if -best[0] <= steps[-1]:
            break
        state[best[1]] = best[2]
        steps.append(-best[0])
    assert got == dict(enumerate(state)) and [h.hits for h in history.orderBy("round").collect()] == steps and len(steps) > 1


def test_readers(spark, tmp_path):
    from sparkloom.functions.registry import Registry, inspect
    from sparkloom.sources import tables as B

    (tmp_path / "a" / "inner").mkdir(parents=True)
    (tmp_path / "b").mkdir()
    for name in ("train.csv", "user.csv"):
        (tmp_path / "a" / "inner" / name).write_text("uid,target_iid,item_seq_raw,item_seq_dedup,item_seq_counts\nu1,i1,\"i1,i2\",,\"i1:1\"\n")
    (tmp_path / "b" / "train.csv").write_text("x\n")
    root = B.found_root(spark, [str(tmp_path / "b"), str(tmp_path / "a"), str(tmp_path / "none")], ["train.csv", "user.csv"])
    assert root.endswith("a/inner")
    with pytest.raises(ValueError, match="2 folders"):
        B.found_root(spark, [str(tmp_path / "b"), str(tmp_path / "a")], ["train.csv"])
    with pytest.raises(ValueError, match="0 folders"):
        B.found_root(spark, [str(tmp_path)], ["other.csv"])
    rows = B.delimited(spark, f"{root}/train.csv", B.INTERACTIONS).collect()
    assert [(r.uid, r.item_seq_raw, r.item_seq_dedup) for r in rows] == [("u1", "i1,i2", None)]
    np.savez(tmp_path / "g.npz", labels=np.array([2, 0, 1]), train_idx=np.array([0, 2]))
    assert sorted(map(tuple, B.matrix_vector(spark, str(tmp_path / "g.npz"), "labels").collect())) == [(0, 2), (1, 0), (2, 1)]
    assert [r.value for r in B.matrix_vector(spark, str(tmp_path / "g.npz"), "train_idx").orderBy("idx").collect()] == [0, 2]
    (tmp_path / "meta.json").write_text('{\n "dataset_name": "x",\n "num_users": 7\n}')
    seen = spark.createDataFrame([("a", "p"), ("b", "p"), ("b", "q"), ("c", None)], "uid string, iid string")
    assert tuple(B.counted_metadata(B.metadata(spark, str(tmp_path / "meta.json")), seen, "uid", "iid").first()) == (7, 2)
    assert tuple(B.counted_metadata(spark.createDataFrame([], "num_items int"), seen, "uid", "iid").first()) == (3, 2)
    template = spark.createDataFrame([(0, 5, -1), (1, 4, -1)], "row_id long, test_idx long, label int")
    good = spark.createDataFrame([(4, 1), (5, 0)], "test_idx long, label int")
    assert [(r.test_idx, r.label) for r in B.label_sheet(template, good, whole=True).collect()] == [(5, 0), (4, 1)]
    with pytest.raises(ValueError, match="2 keys, 1 predictions"):
        B.label_sheet(template, good.limit(1), whole=True)
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    with pytest.raises(ValueError, match="incomplete"):
        B.frozen_dimension(nodes, spark.createDataFrame([(1, 0.5)], "node long, p double"), "node", "p")
    tools = Registry()
    tools.register("inspect", inspect)
    assert tools.names() == ["inspect"] and tools.call("inspect", df=nodes)["rows"] == 2 and "error" in tools.call("inspect") and "error" in tools.call("other")
    with pytest.raises(ValueError, match="already"):
        tools.register("inspect", inspect)


def test_stores(spark, tmp_path):
    store, calls = stores.Store(spark, str(tmp_path)), []
    df = spark.range(20).withColumn("fold", F.col("id") % 3)

    def build():
        calls.append(1)
        return df

    key = stores.inputs_fingerprint({"df": df}, {"k": 3})
    assert key == stores.inputs_fingerprint({"df": df.repartition(5)}, {"k": 3}) != stores.inputs_fingerprint({"df": df}, {"k": 4})
    assert key != stores.inputs_fingerprint({"df": df.unionByName(df.limit(1))}, {"k": 3})
    one, there = store.kept("t", key, build, ("fold",))
    two, again = store.kept("t", key, build, ("fold",))
    assert not there and again and len(calls) == 1 and sorted(map(tuple, one.select("id", "fold").collect())) == sorted(map(tuple, two.select("id", "fold").collect()))
    other, there = store.kept("t", "changed", lambda: df.limit(5))
    assert not there and other.count() == 5 and store.found("t", key).count() == 20 and store.found("t", "never") is None

    def part(name, fail=False):
        calls.append(name)
        if fail and name == "2":
            raise RuntimeError("a run that dies")
        return df.where(F.col("fold") == int(name))

    calls.clear()
    with pytest.raises(RuntimeError, match="dies"):
        store.spilled("oof", key, ["0", "1", "2"], lambda n: part(n, fail=True))
    assert store.found("oof", key) is None  # what it left is not a table
    os.remove(next(iter(tmp_path.glob("oof/data-*/fold=1/_SUCCESS"))))  # and of fold 1 only parts were written
    assert store.spilled("oof", key, ["0", "1", "2"], part).count() == 20
    assert calls == ["0", "1", "2", "1", "2"]
    assert store.spilled("oof", key, ["0", "1", "2"], part).count() == 20 and len(calls) == 5
    with pytest.raises(ValueError, match="rows without a score"):
        stores.score_union({"a": df.select("id", F.lit(1.0).alias("score")), "b": df.limit(3).select("id", F.lit(1.0).alias("score"))}, ["id"], ["a", "b"])


def test_users_with_the_same_keys_share_conditional_rows(spark):
    """Families of sources read each distinct key once; columns are those of the rows of every user."""
    from sparkloom.operators import features as FE
    from sparkloom.operators import pairfeatures as PF
    from sparkloom.operators import retrieval as R
    from sparkloom.operators import stats as C

    cats = ["c1", "c2"]
    rows = [(f"u{i}", ["x", "y", "x"][: i % 4], ["x", "y"][: i % 4], "xyz"[i % 3], "ab"[i % 2], "k" if i % 5 else "a|k") for i in range(24)]
    h = spark.createDataFrame(rows, "uid string, raw array<string>, dedup array<string>, target string, c1 string, c2 string")
    cands = h.select("uid", F.explode(F.array(*map(F.lit, "xyzw"))).alias("iid"))
    stats, prior = C.build_stats(h, cats), FE.priors(h)
    whole = FE.conditional(R.user_keys(h, cats).join(cands, "uid"), stats, C.totals(stats), prior).withColumn("bare", F.col("key"))
    columns = PF.counted_columns(cats)
    want = whole.groupBy("uid", "iid").agg(*(F.round(c, 9).alias(n) for n, (_, c) in columns.items()))
    got = PF.counted(h, cats, cands, stats, C.totals(stats), prior)
    zero = lambda df: sorted(repr(tuple(0.0 if r[n] in (None, 0) else r[n] if n in ("uid", "iid") else round(r[n], 7) for n in ("uid", "iid", *columns))) for r in df.collect())
    assert zero(got) == zero(want)
    assert {s for sources, _ in PF.families(cats) for s in sources} == {s for s, _ in [(x, 0) for reads, _ in columns.values() for x in reads]}

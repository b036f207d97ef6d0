"""Small hand-made cases, odd input and invariants."""

import math

from pyspark.sql import functions as F

from sparkloom.functions import scalars as X
from sparkloom.operators import fusion, graph, lists, runlog, splits
from sparkloom.operators import sequences as S
from sparkloom.operators import stats as C
from sparkloom.sources import tables as A

HIST = "uid string, raw array<string>, dedup array<string>, target string"


def one(df, c):
    return df.select(c.alias("x")).first().x


def test_scalars(spark):
    df = spark.createDataFrame([("12.0,a, nan ,,b", "a:3,b:x,a:5", 7)], "s string, m string, n int")
    assert one(df, X.split_items(F.col("s"))) == ["12", "a", "b"]
    assert one(df, X.seq_len(F.col("s"))) == 5
    assert one(df, X.parse_counts(F.col("m"))) == {"a": 5}
    assert one(df, X.length_bucket(F.col("n"))) == "5-7"
    assert one(df, X.left_padded(F.array(F.lit(1), F.lit(2)), 4)) == [0, 0, 1, 2]
    assert one(df, X.left_padded(F.array().cast("array<int>"), 2)) == [0, 0]
    assert abs(sum(one(df, X.softmax(F.array(F.lit(1.0), F.lit(2.0))))) - 1) < 1e-12
    assert abs(one(df, X.entropy(F.array(F.lit(0.5), F.lit(0.5)))) - math.log(2)) < 1e-12
    assert one(df, X.decision(F.lit('```json\n{"decision": "pivot"}\n```'))) == "PIVOT"
    assert one(df, X.fenced_code(F.lit("x ```python\ny=1\n``` z"))) == ["y=1\n"]
    assert one(df, X.metric_values(F.lit("loss: 0.5 acc=0.75 ACC: 0.8"), "acc")) == [0.75, 0.8]
    assert one(df, X.finite(F.lit(float("inf")))) == 0.0


def test_sequences_of_short_histories(spark):
    h = spark.createDataFrame([("u", [], [], "a"), ("v", ["a"], ["a"], "b"), ("w", ["a", "a", "b"], ["a", "b"], "c")], HIST)
    assert [(r.a, r.b) for r in S.neighbours(h).collect()] == [("a", "a"), ("a", "b")]
    assert [(r.a, r.b, r.c) for r in S.trigrams(h).collect()] == [("a", "a", "b")]
    assert {(r.uid, r.d, r.item) for r in S.recent(h).collect()} == {("v", 0, "a"), ("w", 0, "b"), ("w", 1, "a")}
    assert [(r.a, r.b) for r in S.unordered_pairs(h).collect()] == [("a", "b")]
    assert S.skipgrams(h).count() == 6
    assert {r.uid: len(r.raw) for r in S.shortened(h, "last1").collect()} == {"u": 0, "v": 1, "w": 1}


def test_out_of_fold_counts_match_recomputation(spark):
    rows = [(f"u{i}", [f"i{i % 3}", f"i{i % 4}"], sorted({f"i{i % 3}", f"i{i % 4}"}), f"t{i % 5}", "c") for i in range(40)]
    h = spark.createDataFrame(rows, HIST + ", cat string")
    h = splits.group_folds(h, "uid", 4)
    whole, own, rest = (C.build_stats(x.drop("fold"), ["cat"]) for x in (h, h.where("fold = 1"), h.where("fold <> 1")))
    got = {(r.source, r.key, r.iid): round(r.cnt, 6) for r in C.out_of_fold(whole, own).collect()}
    assert got == {(r.source, r.key, r.iid): round(r.cnt, 6) for r in rest.collect()}


def test_scores_of_one_candidate_and_ties(spark):
    df = spark.createDataFrame([("q", "a", 1.0), ("r", "a", 2.0), ("r", "b", 2.0), ("r", "c", None)], "qid string, iid string, s double")
    z = {(r.qid, r.iid): r.z for r in fusion.zscore(df, "s", "z", fill=True).collect()}
    assert z[("q", "a")] == 0 and z[("r", "a")] == z[("r", "b")] == 0 and z[("r", "c")] == -0.5
    p = {(r.qid, r.iid): r.p for r in fusion.pct_rank(df, "s", "p").collect()}
    assert p[("q", "a")] == 1 and p[("r", "a")] == p[("r", "b")] == 0.75 and p[("r", "c")] == 0.5
    k = {(r.qid, r.iid): r.k for r in fusion.rank_first(df, "s", "k").collect()}
    assert k[("q", "a")] == 0 and k[("r", "a")] == 1 and k[("r", "b")] == 0


def test_lists(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], ["b", "c"], ["x", "a"])], "i array<string>, h array<string>, g array<string>")
    i, h, g = F.col("i"), F.col("h"), F.col("g")
    assert one(df, lists.filled(lists.without(i, h), g, 3)) == ["a", "d", "x"]
    assert one(df, lists.history_capped(i, h, 1)) == ["a", "b", "d"]
    assert one(df, lists.balanced(i, h)) == ["a", "d", "b", "c"]
    a = spark.createDataFrame([("u", ["a", "b"])], "uid string, items array<string>")
    b = spark.createDataFrame([("u", ["b"]), ("v", ["c"])], "uid string, items array<string>")
    assert {r.uid: r["items"] for r in lists.fused([(a, 1.0), (b, 1.0)], lists.RECIPROCAL).collect()} == {"u": ["b", "a"], "v": ["c"]}


def test_diversity_is_the_greedy_choice(spark):
    items = [f"i{k}" for k in range(14)]
    df = spark.createDataFrame([("u", items)], "uid string, items array<string>")
    cats = spark.createDataFrame([(x, k % 2 if k > 5 else 0) for k, x in enumerate(items)], "iid string, cat int")
    got = lists.diversified(df, cats, weight=3.0).first()["items"]
    left, used, want = list(enumerate(items)), {}, []
    cat = {x: k % 2 if k > 5 else 0 for k, x in enumerate(items)}
    while len(want) < 10:
        best = max(range(len(left)), key=lambda i: (14 - i - 3.0 * used.get(cat[left[i][1]], 0), -i))
        x = left.pop(best)[1]
        used[cat[x]] = used.get(cat[x], 0) + 1
        want.append(x)
    assert got == want


def test_graph_keeps_isolated_nodes_and_labels_of_others_only(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 1), (3, 3)], "src long, dst long")
    got = {r.node: (r.component, r["size"]) for r in graph.components(nodes, edges).collect()}
    assert got == {0: (0, 3), 1: (0, 3), 2: (0, 3), 3: (3, 1), 4: (4, 1), 5: (5, 1)}
    assert {r.node: r.deg for r in graph.degrees(nodes, edges).collect()} == {0: 1, 1: 2, 2: 1, 3: 1, 4: 0, 5: 0}
    empty = graph.components(nodes, edges.limit(0))
    assert {r.component for r in empty.collect()} == set(range(6))
    classes = spark.createDataFrame([(0,), (1,)], "class long")
    block = lambda label: {(r.view, r.hop, r["class"]): (r.p, r.mass) for r in graph.crossfit_label_blocks(nodes, edges, spark.createDataFrame([(0, label, 0), (1, 0, 1), (2, 1, 2)], "node long, label long, fold int"), classes, hops=1).where("node = 0").collect()}
    assert block(0) == block(1)  # a node's own label never reaches its block


def test_path_components(spark):
    nodes = spark.range(300).withColumnRenamed("id", "node")
    edges = spark.range(299).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.components(nodes, edges).select("component").distinct().collect()[0][0] == 0


def test_run_log(spark):
    rows = [("t", i, {"acc": s}, "CONTINUE") for i, s in enumerate([0.5, 0.6, 0.59, 0.58, 0.57, 0.7])]
    log = spark.createDataFrame(rows, "task_id string, iteration long, metrics map<string,double>, decision string")
    assert [(r.iteration, r.rule) for r in runlog.stops(log).collect()] == [(4, "patience")]
    assert runlog.best_per_task(log).first().iteration == 5
    assert [r.falling for r in runlog.trend(log).orderBy("iteration").collect()] == [False, False, False, True, True, False]


def test_guards(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        A.unique_keys(df, ["k"])
    with pytest.raises(ValueError):
        A.required(df, ["k", "w"])
    assert A.fingerprint(df).first() == A.fingerprint(df.orderBy(F.desc("v"))).first()
    assert A.renamed(df.withColumnRenamed("k", "user_id")).columns == ["uid", "v"]


def test_sparse_matrix_files(spark, tmp_path):
    import numpy as np

    np.savez(tmp_path / "g.npz", adj_data=[1.0, 2.0, 3.0], adj_indices=[1, 0, 2], adj_indptr=[0, 1, 1, 3])
    assert {tuple(r) for r in A.matrix_edges(spark, str(tmp_path / "g.npz"), "adj").collect()} == {(0, 1, 1.0), (2, 0, 2.0), (2, 2, 3.0)}


def test_negatives_are_unseen(spark):
    h = spark.createDataFrame([("u", ["a", "b"], ["a", "b"], "c")], HIST)
    items = spark.createDataFrame([(x,) for x in "abcdefgh"], "iid string")
    got = [r.iid for r in splits.negatives(h, items).collect()]
    assert got and len(set(got)) == len(got) and not set(got) & {"a", "b", "c"}


def test_metrics_count_missing_queries(spark):
    placed = spark.createDataFrame([("q", 1, 1), ("r", 3, 1), ("r", 1, 0)], "qid string, place long, label int")
    m = fusion.metrics(placed, spark.createDataFrame([("q",), ("r",), ("s",)], "qid string")).first()
    assert (m.n_queries, round(m.hit, 6), round(m.mrr, 6), round(m.ndcg, 6)) == (3, round(2 / 3, 6), round((1 + 1 / 3) / 3, 6), 0.5)

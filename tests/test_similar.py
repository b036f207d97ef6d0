"""Block comparison of vectors against a plain loop, with blocks of a few rows."""

import numpy as np

from sparkloom.operators import graph, heuristics, lists


def test_most_similar_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (40, 3)).astype(float)  # many ties, some rows of length 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, vec array<double>")
    size = np.linalg.norm(x, axis=1)
    unit = x / np.where(size == 0, 1, size)[:, None]
    sim = np.round(unit @ unit.T, 9)
    got = {}
    for r in graph.most_similar(df.where("node % 2 = 0"), df, 4, itself=False, block=7).collect():
        got.setdefault(r.node, []).append((r.place, r.other))
    want = {i: [(p + 1, j) for p, j in enumerate(sorted((j for j in range(40) if j != i), key=lambda j: (-sim[i, j], j))[:4])] for i in range(0, 40, 2)}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_most_similar_empty(spark):
    df = spark.createDataFrame([(1, [1.0])], "node long, vec array<double>")
    assert graph.most_similar(df, df.where("node > 1"), 3).count() == 0
    assert graph.most_similar(df.where("node > 1"), df, 3).count() == 0


def test_diversified_nulls_and_short_lists(spark):
    df = spark.createDataFrame([("a", list("pqrs")), ("b", ["p"]), ("c", [])], "uid string, items array<string>")
    cats = spark.createDataFrame([("p", 1), ("q", 1)], "iid string, cat int")  # r and s have no category: one of their own
    got = {r["uid"]: r["items"] for r in lists.diversified(df, cats, k=3, weight=3.0).collect()}
    assert got == {"a": ["p", "r", "q"], "b": ["p"]}


def test_similar_users_by_sets_of_categories(spark, monkeypatch):
    """Against a plain loop; and however many profiles share a category, a profile reads k + 1 ids a set of categories."""
    rng = np.random.default_rng(8)
    users = [(str(i), *(str(v) for v in rng.integers(0, 6, 3))) for i in range(300)]
    seen = []
    whole = heuristics.checkpointed
    monkeypatch.setattr(heuristics, "checkpointed", lambda df: seen.append(df.count()) or whole(df))
    got = {}
    for r in heuristics.similar_users(spark.createDataFrame(users, "uid string, a string, b string, c string"), ["a", "b", "c"], 5).collect():
        got.setdefault(r.uid, set()).add((r.other, round(r.sim, 9)))
    want = {}
    for u, *x in users:
        all_ = [(-sum(p == q for p, q in zip(x, y)), o) for o, *y in users if o != u]
        want[u] = {(o, round(-n / 3, 9)) for n, o in sorted(z for z in all_ if z[0])[:5]}
    assert got == want and seen == [300]

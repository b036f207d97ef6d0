"""The neighbour step on rows without a usable vector, and its memory."""

import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pytest

from sparkloom.operators import neighbours as N


def _rows():
    v = [[float(x) for x in row] for row in np.random.default_rng(3).normal(size=(60, 6)).round(3)]
    v[7] = v[20] = v[41] = None
    v[13], v[50] = [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5
    return list(enumerate(v))


@pytest.mark.parametrize("itself", [True, False])
def test_rows_without_a_direction_rank_as_in_sql(spark, itself):
    rows = _rows()
    duck = duckdb.connect()
    duck.execute("CREATE TABLE e (node BIGINT, v DOUBLE[])")
    duck.executemany("INSERT INTO e VALUES (?, ?)", [list(r) for r in rows])
    want = duck.execute(f"""SELECT * FROM (SELECT a.node, b.node, row_number() OVER (PARTITION BY a.node ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.node) AS place
      FROM e a JOIN e b ON a.node % 2 = 1 {"" if itself else "AND a.node <> b.node"}) WHERE place <= 4""").fetchall()
    df = spark.createDataFrame(rows, "node long, vec array<double>")
    asked = df.where("node % 2 = 1")
    for got in (N.nearest(asked, df, 4, itself), N.search(asked, N.build(df, 6), 4, itself), N.nearest(asked, df, 4, itself, block=8)):
        assert {(r.node, r.other, r.place) for r in got.collect()} == set(want)


def test_no_vector_at_all(spark):
    df = spark.createDataFrame([(i, None) for i in range(5)] + [(5, []), (6, [None, 1.0])], "node long, vec array<double>")
    want = {(n, o) for n in range(7) for o in ([0, 1] if n > 1 else [x for x in (0, 1, 2) if x != n])}
    for got in (N.nearest(df, df, 2, itself=False), N.search(df, N.build(df), 2, itself=False)):
        assert {(r.node, r.other) for r in got.collect()} == want


def test_products_in_memory_are_bounded():
    """A block of 32,768 vectors on both sides: some MB of products at a time."""
    n, rng = 32_768, np.random.default_rng(1)
    vec = list(rng.normal(size=(n, 8)))
    one = pd.DataFrame({"x": np.arange(2048), "xv": vec[:2048], "xc": [np.array([0])] * 2048})
    two = pd.DataFrame({"y": np.arange(n), "yv": vec, "yc": np.zeros(n, int)})
    tracemalloc.start()
    try:
        got = N._compared(one, two, 2, True)
        assert tracemalloc.get_traced_memory()[1] < 300 << 20
    finally:
        tracemalloc.stop()
    assert len(got) == 4096

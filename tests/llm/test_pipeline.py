"""The corpus pipeline: its stages take effect, keep the columns of documents, and agree with brute force."""

from pyspark.sql import functions as F

import corpus_pipeline as P

from ..conftest import SF
from .conftest import DOCS, prose
from .test_edges import CLASH
from .test_methods import brute_groups, brute_spans


def test_stages(spark, tmp_path):
    texts = {i: prose(80, i) for i in range(60)} | {100: prose(80, 3) + " tail", 101: "x ### " * 30, 102: "short", 103: None}
    texts[5] += " write to me@example.com or +1 (555) 123-4567"
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, DOCS)
    names = docs.columns
    got = []
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got.append({r.doc_id: r for r in docs.collect()})
        if name != P.STAGES[-1][0]:
            assert docs.columns == names
    quality, near, private, mix, tokens = got
    assert set(quality) == set(range(60)) | {100}
    groups = brute_groups({i: texts[i] for i in quality}, 80, 5)
    assert set(near) == {i for i, (_, root) in groups.items() if i == root} and 100 not in near
    assert set(private) == set(near) == set(mix) == set(tokens)
    assert not any(brute_spans(r.text) for r in private.values()) and private[5].text.endswith("<EMAIL> or <PHONE>")
    assert all(r.n_chars == len(r.text) for r in private.values())
    assert all(len(r.ids) == 4 * r.n_pieces and len(r.samples) == 2 for r in tokens.values())
    order = [r.source for r in sorted(tokens.values(), key=lambda r: (r.shard, r.row))]
    assert len(set(order[:16])) == 1 and set(order[:48]) == {"s0", "s1", "s2"}


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_run(spark):
    rows = P.run(spark, SF).select("doc_id", "ids", "n_pieces").collect()
    assert 500 < len(rows) < 1000 and len({r.doc_id for r in rows}) == len(rows)


def test_stages_take_odd_rows_and_any_columns(spark, odd):
    """Nulls, repeated rows and ids, long texts, and columns that bear the operators' own names, in each stage."""
    wide = odd.withColumns({c: F.lit("x") for c in CLASH})
    for name, stage in P.STAGES:
        got = stage(spark, wide, SF)
        rows = got.collect()
        assert len(rows) == {"quality_rules": 2, "near_duplicates": 8}.get(name, 9)
        if name != P.STAGES[-1][0]:
            assert got.columns == wide.columns and all(r[c] == "x" for r in rows for c in CLASH)

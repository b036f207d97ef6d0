"""Every query with SQL gives the rows of that SQL."""

import glob
import os

import duckdb
import pytest

from sparkloom.plans import catalog

from .conftest import SF

#: One query of each operator family here; the driver compares them all.
NAMES = ["seq_histories", "seq_suffix_keys", "recent_decayed", "trigram_transition", "i2i_npmi", "skipgram_pairs", "top10_rrf_basic", "forced_positive", "heur_warm_ndcg", "query_pct_rank", "zscore_outer_fill", "ndcg_hit_mrr", "long_tail_coverage", "graph_degrees", "graph_norm_weights", "pagerank_10", "connected_components", "class_recall", "stratified_folds", "full_outer_join", "set_operations", "runlog_stop", "knn_vote", "diversity_rerank", "blend_weight_search", "runlog_export", "oof_recall", "fusion_strategies", "label_prop_until", "parsed_logs"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def normal(rows):
    return sorted(repr(tuple((0.0 if x == 0 else x) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    out = duck.execute(catalog.ORACLES[name])
    columns = [x[0] for x in out.description]
    assert names == sorted(columns)
    want = [tuple(r[columns.index(c)] for c in names) for r in out.fetchall()]
    assert normal(tuple(r[c] for c in names) for r in df.collect()) == normal(want)


def test_names():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 110

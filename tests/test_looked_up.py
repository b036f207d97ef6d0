"""Conditional features whose candidates travel as lists give the rows of the joins pair by pair."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import features as FE
from sparkloom.operators import pairfeatures as PF
from sparkloom.operators import retrieval as R
from sparkloom.operators import stats as C
from sparkloom.plans.ranking import conditional

from .conftest import SF


def _tables(spark):
    rows = [(f"u{i}", [f"i{(i * 7 + j * j) % 23}" for j in range(i % 6)], f"i{i % 19}", "x" if i % 3 else "y") for i in range(40)]
    h = spark.createDataFrame(rows, "uid string, raw array<string>, target string, cat string").withColumn("dedup", F.array_distinct("raw"))
    stats = C.build_stats(h, ["cat"]).where("cnt <> 3")  # some keys and pairs were never seen
    cands = spark.createDataFrame([(f"u{i}", f"i{j}") for i in range(39) for j in range(23) if (i + j) % 3], "uid string, iid string").join(FE.priors(h).select("iid"), "iid")
    return h, stats, cands


@pytest.mark.parametrize("gathered", [False, True])
@pytest.mark.parametrize("span", [4, 1024])
def test_same_as_joins_of_pairs(spark, monkeypatch, gathered, span):
    """Also where items take several ranges of numbers, and keys several tasks."""
    monkeypatch.setattr(FE, "RANGE", span)
    monkeypatch.setattr(FE, "KEY_ROWS", 16)
    monkeypatch.setattr(FE, "TOTAL_ROWS", 16)
    h, stats, cands = _tables(spark)
    keys, prior = R.user_keys(h, ["cat"]), FE.priors(h)
    want = FE.conditional(keys.join(cands, "uid"), stats, C.totals(stats), prior)
    got = FE.looked_up(keys, cands, stats, C.totals(stats), prior, gathered).select(*want.columns)
    flat = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert flat(got) == flat(want) and got.count() > 1000


def test_pairs_are_not_shuffled(spark):
    """Grouping by pair adds no exchange after a user's lists are taken apart."""
    plan = FE.source_hits(conditional(spark, SF))._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("Generate posexplode(_ats")]
    assert "HashAggregate" in after and "Exchange hashpartitioning" not in after


def test_counted_columns_are_made_where_a_user_lies(spark):
    """All columns of ``pair_features_all`` that counts know come from one aggregation after a user's lists are taken apart."""
    h, stats, cands = _tables(spark)
    plan = PF.counted(h, ["cat"], cands, stats, C.totals(stats), FE.priors(h))._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("Generate posexplode(_ats")]
    assert "Aggregate" in after and "Exchange hashpartitioning" not in after

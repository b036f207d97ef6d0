"""List queries against the steps of their method, item by item."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sparkloom.plans import catalog
from sparkloom.plans import fixtures as T
from sparkloom.plans.ranking import list_a

from .conftest import SF


def _few_items(spark, folder):
    """The events with 40 items, of customers in two groups: lists are full of seen items."""
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    read("events").withColumn("props", F.format_string('{"k": %d}', F.pmod(k * k, F.lit(8)))).write.parquet(f"{folder}/events.parquet")
    read("customer").withColumns({"c_nationkey": F.lit(1), "c_acctbal": F.lit(9.0), "c_mktsegment": F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b")}).write.parquet(f"{folder}/customer.parquet")
    for n in ("nation", "orders"):
        read(n).write.parquet(f"{folder}/{n}.parquet")
    return str(folder)


def test_cap_history_refills_by_group_then_by_all(spark, tmp_path):
    """Kept items, then the targets of users with the same four categories, then everyone's items."""
    folder = _few_items(spark, tmp_path)
    users = T.hu(spark, folder).select("uid", "raw", "target", *T.CATS[:4]).collect()
    lists = {r.uid: list(r["items"]) for r in list_a(spark, folder).collect()}
    groups, everyone = defaultdict(Counter), Counter()
    for u in users:
        groups[tuple(u[c] for c in T.CATS[:4])][u.target] += 1
        everyone.update([*u.raw, u.target])
    ranked = lambda c: [i for i, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))]
    want, by_group = {}, 0
    for u in users:
        kept, seen = [], 0
        for i in lists[u.uid]:
            seen += i in set(u.raw)
            if i not in set(u.raw) or seen <= 3:
                kept.append(i)
        group = ranked(groups[tuple(u[c] for c in T.CATS[:4])])
        by_group += len(kept) < 10 and any(i not in kept for i in group)
        want[u.uid] = ",".join(list(dict.fromkeys(kept + group + ranked(everyone)))[:10])
    assert by_group > 10
    got = {r.uid: r["items"] for r in catalog.QUERIES["cap_history"](spark, folder).select("uid", F.col("items")).collect()}
    assert got == want

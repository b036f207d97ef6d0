"""Queries over texts as readers see them, sheets, fallbacks and orders, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import scalars as X
from sparkloom.operators import ensemble as E
from sparkloom.operators import sequences as S
from sparkloom.operators.ordering import numbered, running_sum
from sparkloom.plans import fixtures as T
from sparkloom.plans import ranking as K
from sparkloom.plans.ensembling import PSQL, labels
from sparkloom.plans.fixtures import HIST_SQL
from sparkloom.plans.graphs import nodes, probs
from sparkloom.plans.registry import query
from sparkloom.sources import tables as B

_TEXT = HIST_SQL + """,
txt AS (SELECT uid, CASE WHEN uid::BIGINT % 7 = 0 THEN ' NaN ' WHEN uid::BIGINT % 5 = 0 THEN replace(csv, ',', ' ,, ') ELSE csv END AS raw, CASE WHEN uid::BIGINT % 3 = 0 THEN '' ELSE dcsv END AS given,
  ccsv || ',bad,x:,' || first || ': 1000' AS counts FROM (SELECT uid, string_agg(item, ',' ORDER BY pos) AS csv FROM hist GROUP BY 1) JOIN (SELECT uid, string_agg(item, ',' ORDER BY dpos) AS dcsv, min(item) AS first FROM dd GROUP BY 1) USING (uid)
  JOIN (SELECT uid, string_agg(item || ':' || c, ',' ORDER BY item) AS ccsv FROM (SELECT uid, item, count(*) AS c FROM hist GROUP BY 1, 2) GROUP BY 1) USING (uid)),
tok AS (SELECT *, list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> '' AND lower(x) <> 'nan') AS items FROM txt)"""


def texts(spark, d):
    """(uid, raw, given, counts): histories as a delimited file has them, with blanks, gaps, nan and malformed pairs."""
    h, n = T.h(spark, d), F.col("uid").cast("long")
    csv = F.array_join("raw", ",")
    raw = F.when(n % 7 == 0, " NaN ").when(n % 5 == 0, F.replace(csv, F.lit(","), F.lit(" ,, "))).otherwise(csv)
    given = F.when(n % 3 == 0, "").otherwise(F.array_join("dedup", ","))
    pairs = h.select("uid", F.explode("raw").alias("item")).groupBy("uid", "item").agg(F.count("*").alias("c"))
    counts = pairs.groupBy("uid").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "item", F.col("c").cast("string")))), ",").alias("counts"), F.min("item").alias("first"))
    own = h.select("uid", raw.alias("raw"), given.alias("given")).join(counts, "uid")
    return own.select("uid", "raw", "given", F.concat("counts", F.lit(",bad,x:,"), "first", F.lit(": 1000")).alias("counts"))


@query("SELECT uid, len(items)::BIGINT AS n_items, CASE WHEN lower(trim(raw)) IN ('', 'nan') THEN 0 ELSE len(string_split(raw, ',')) END::BIGINT AS n_tokens, array_to_string(items[1:3], '|') AS first_three, len(items) > 0 AS usable FROM tok", _TEXT)
def item_texts(spark, d):
    items = X.split_items(F.col("raw"))
    return texts(spark, d).select("uid", F.size(items).cast("long").alias("n_items"), X.seq_len(F.col("raw")).alias("n_tokens"), F.array_join(F.slice(items, 1, 3), "|").alias("first_three"), (F.size(items) > 0).alias("usable"))


@query("SELECT uid, count(*) AS n_keys, sum(v)::BIGINT AS total FROM (SELECT uid, k, arg_max(v, i) AS v FROM (SELECT uid, i, trim(string_split(p, ':')[1]) AS k, trim(string_split(p, ':')[2])::BIGINT AS v FROM (SELECT uid, unnest(string_split(counts, ',')) AS p, generate_subscripts(string_split(counts, ','), 1) AS i FROM txt) WHERE regexp_matches(p, '^[^:]+:\\s*\\d+\\s*$')) GROUP BY uid, k) GROUP BY uid", _TEXT)
def count_texts(spark, d):
    """Maps of item:count texts: malformed pairs go, the last of equal keys counts."""
    m = texts(spark, d).select("uid", X.parse_counts(F.col("counts")).alias("m"))
    return m.select("uid", F.size("m").cast("long").alias("n_keys"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT uid, CASE WHEN given <> '' THEN 'given' ELSE 'derived' END AS origin, CASE WHEN given <> '' THEN len(string_split(given, ',')) ELSE len(list_distinct(items)) END::BIGINT AS n_new FROM tok", _TEXT)
def dedup_fallback(spark, d):
    t = texts(spark, d).select("uid", X.split_items(F.col("raw")).alias("raw"), X.split_items(F.col("given")).alias("given"))
    return S.with_dedup(t).select("uid", F.when(F.size("given") > 0, "given").otherwise("derived").alias("origin"), F.size("dedup").cast("long").alias("n_new"))


@query("SELECT 150000::BIGINT AS num_users, count(DISTINCT event_type || '#' || json_extract_string(props, '$.k')) AS num_items FROM events")
def metadata_fallback(spark, d):
    """The stated number of users, and items counted as the document does not state them."""
    meta = spark.createDataFrame([(150_000, "sequences")], "num_users int, task_family string")
    return B.counted_metadata(meta, T.events(spark, d), "user_id", "item")


@query("SELECT n.node, split, round(p, 6) AS p FROM nodes n JOIN (SELECT node, max(p) AS p FROM probs WHERE model = 'mid' GROUP BY 1) USING (node)", PSQL)
def frozen_scores(spark, d):
    """Nodes with a score that must be there for each of them."""
    best = probs(spark, d).where("model = 'mid'").groupBy("node").agg(F.max("p").alias("p"))
    return B.frozen_dimension(nodes(spark, d).select("node", "split"), best, "node", "p").withColumn("p", F.round("p", 6))


@query("SELECT c.uid, pos AS place, iid FROM cands c WHERE pos <= 5", K.CANDS)
def lists_read_back(spark, d):
    """Lists as a sheet of five items, read again."""
    lists = K.candidates(spark, d, 5).groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "iid"))), lambda s: s["iid"]).alias("items"))
    sheet = B.list_sheet(lists.select("uid"), lists, [])
    return B.ranked_lists(sheet)


@query("SELECT qid, iid, round(coalesce(s1, 0), 6) AS s1, round(coalesce(s2, 0), 6) AS s2, 0.0::DOUBLE AS s9 FROM scores", K.SCORES_SQL)
def reindexed_scores(spark, d):
    """A stated set of columns: one that is missing and values that are not finite become 0."""
    own = K.scores(spark, d).withColumn("s2", F.coalesce("s2", F.lit(float("inf"))))
    return B.reindexed(own, ["qid", "iid"], ["s1", "s2", "s9"]).select("qid", "iid", F.round("s1", 6).alias("s1"), F.round("s2", 6).alias("s2"), "s9")


@query("SELECT n_nationkey::BIGINT AS epoch, round(0.15 + 0.35 * least(greatest(n_nationkey / 19.0, 0), 1), 9) AS rate FROM nation")
def mask_schedule(spark, d):
    """A share that rises in a straight line over twenty epochs and stays."""
    e = B.parquet(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("epoch"))
    return e.select("epoch", F.round(X.linear_schedule(F.col("epoch"), 20, 0.15, 0.5), 9).alias("rate"))


@query("SELECT uid AS qid, count(*) AS n, (sum(count(*)) OVER (ORDER BY uid) - count(*))::BIGINT AS first FROM cands GROUP BY uid", K.CANDS)
def query_offsets(spark, d):
    """Rows of each query and the rows before it, in the order of queries."""
    n = K.candidates(spark, d).groupBy(F.col("uid").alias("qid")).agg(F.count("*").alias("n"))
    return running_sum(n, ["qid"], "n", "first", inclusive=False)


@query("SELECT uid AS qid, iid, row_number() OVER (ORDER BY uid, pos) - 1 AS row_id FROM cands", K.CANDS)
def training_order(spark, d):
    """The place of each candidate in the order of queries and candidates."""
    return numbered(K.candidates(spark, d).select(F.col("uid").alias("qid"), "iid", "pos"), ["qid", "pos"], "row_id").drop("pos")


_LOSS = "SELECT t AS temperature, round(avg((pred = label)::INT), 6) AS accuracy, round(avg(-ln(greatest(own / total, 1e-12))), 6) AS log_loss FROM (SELECT t, p.node, label, sum(pow(greatest(p, 1e-12), 1 / t)) AS total, max(CASE WHEN class = label THEN pow(greatest(p, 1e-12), 1 / t) END) AS own, arg_min(class, -round(p, 9) * 1000 + class * 1e-9) AS pred FROM probs p JOIN nodes n ON p.node = n.node, (VALUES (0.6::DOUBLE), (0.8), (1.0), (1.25), (1.6)) v(t) WHERE model = 'mid' GROUP BY t, p.node, label) GROUP BY t"


@query(_LOSS, PSQL)
def temperature_grid(spark, d):
    g = E.temperature_grid(probs(spark, d).where("model = 'mid'").drop("model"), labels(spark, d))
    return g.select("temperature", F.round("accuracy", 6).alias("accuracy"), F.round("log_loss", 6).alias("log_loss"))

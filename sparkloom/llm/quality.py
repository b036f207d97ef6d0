"""Quality rules with adaptive thresholds.

Each document gets integer features in thousandths (symbols to word characters, repeated words to words, repeated lines
to lines, characters to words). For every (language, source, feature) a mergeable quantile sketch is kept: a
log-linear histogram whose bucket holds the leading ``SUB_BITS`` bits of a value (relative error below 1/16), so that
sketches merge by adding counts. A group's sketch is taken with its language's, scaled to the weight of ``parent``
documents, and that with the sketch of all in the same way: a small group follows its language, a large one itself, and
nothing switches at a size. A threshold is a fence ``q75 + SPREAD * (q75 - q25) + slack`` (and a lower fence for word
length); documents are then joined with their group's thresholds and rejected where a feature lies beyond its fence.

Odd input: null language or source is a group of its own; a null or blank text has no words, fails the base rules and
adds nothing to sketches. Very long texts are read whole, each in one task. Repeated rows count and return as often as they
occur; an empty table gives an empty result. ``passing`` returns the caller's columns as they are, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import begins, checkpointed, set_aside

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SUB_BITS = 5
#: Distance of a fence from the upper (lower) quartile, in quartile distances.
SPREAD = 6
#: Upper fences never stand closer to the quartile than this, in thousandths.
SLACK = {"symbols": 60, "repeats": 250, "dup_lines": 300, "word_len": 1500}
#: Documents for which the sketch of the next larger group counts in a group's own.
PARENT = 100
BASE = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of WINDOW words which the text has twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    names: dict[str, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    for step in (1, 2, 4):  # windows of 2, 4 and 8 words, named by pairs of names: equal names mean equal words
        a, b = ids[:-step], ids[step:]
        _, ids = np.unique(a * (int(ids.max()) + 1) + b, return_inverse=True)
        if step == 1 and int(ids.max()) + 1 == len(ids):
            return 0
    again = np.flatnonzero(np.bincount(ids)[ids] > 1)
    if not len(again):
        return 0
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, again, 1)
    np.add.at(mark, again + WINDOW, -1)
    return int((np.cumsum(mark)[:-1] > 0).sum())


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = WORD.findall(text)
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            lines += 1
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), lines, dup, repeated_words(words)


def base_features(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` columns and the counts of BASE for every row."""
    inside = text_col in keep
    own = df.select(*keep) if inside else df.select(*keep, F.col(text_col).alias("_text"))
    schema, at, n = own.drop("_text").schema, own.columns.index(text_col if inside else "_text"), len(keep)
    for f in df.sparkSession.createDataFrame([], BASE).schema:
        schema = schema.add(f)

    def run(batches):
        begins("quality")
        for batch in batches:
            rows = [counts(t) for t in batch.column(at).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(c, pa.int64()) for c in zip(*rows))], names=schema.names)

    return own.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _per_mille(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.floor(1000 * F.col(a) / F.col(b)).cast("long")).otherwise(F.lit(0).cast("long"))


def features() -> dict[str, Column]:
    return {"symbols": _per_mille("n_symbols", "word_chars"), "repeats": _per_mille("n_repeat_words", "n_words"), "dup_lines": _per_mille("n_dup_lines", "n_lines"), "word_len": _per_mille("word_chars", "n_words")}


def bucket(value: Column) -> Column:
    """The least value of the sketch bucket that holds ``value``: its leading SUB_BITS bits, the others 0."""
    shift = F.greatest(F.length(F.bin(value)) - SUB_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(base: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, bucket, n): the sketch of every group, of documents with words."""
    made = base.where("n_words > 0").select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), bucket(v).alias("bucket")) for k, v in features().items()))).alias("_x"))
    return made.groupBy(*keys, "_x.feature", "_x.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of larger groups, by adding counts."""
    return sketch.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))


def mixtures(fine: DataFrame, parent: int = PARENT) -> DataFrame:
    """(lang, source, feature, bucket, m): sketches of groups with those of their languages and of all mixed in, as whole
    numbers. With c, l, a the counts of a bucket in the group, its language and all, of which there are L in the language
    and A in all (n_lang, n_all), and W for ``parent``: m / (A (L + W)) = c + W (l + W a / A) / (L + W)."""
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(12,0)")
    total = lambda df, keys, name: merged(df, keys).groupBy(*keys, "feature").agg(F.sum("n").alias(name))
    every = merged(fine, []).join(total(fine, [], "n_all"), "feature").select("feature", "bucket", F.col("n").alias("a"), "n_all")
    lang = merged(fine, ["lang"]).select(F.col("lang").alias("_lang"), F.col("feature").alias("_f"), F.col("bucket").alias("_b"), F.col("n").alias("l"))
    size = total(fine, ["lang"], "n_lang").select(F.col("lang").alias("_lang2"), F.col("feature").alias("_f2"), "n_lang")
    own = fine.select(F.col("lang").alias("_lang3"), F.col("source").alias("_source3"), F.col("feature").alias("_f3"), F.col("bucket").alias("_b3"), F.col("n").alias("c"))
    # The sketch of all has some hundreds of buckets a feature, whatever the table.
    rows = fine.select("lang", "source", "feature").distinct().join(F.broadcast(every), "feature")
    rows = rows.join(size, F.col("lang").eqNullSafe(F.col("_lang2")) & (F.col("feature") == F.col("_f2")))
    rows = rows.join(lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("feature") == F.col("_f")) & (F.col("bucket") == F.col("_b")), "left")
    rows = rows.join(own, F.col("lang").eqNullSafe(F.col("_lang3")) & F.col("source").eqNullSafe(F.col("_source3")) & (F.col("feature") == F.col("_f3")) & (F.col("bucket") == F.col("_b3")), "left")
    m = whole("c") * whole("n_all") * (whole("n_lang") + parent) + parent * (whole("l") * whole("n_all") + parent * whole("a"))
    return rows.select("lang", "source", "feature", "bucket", m.cast("decimal(38,0)").alias("m"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, a, b): lower and upper quartile of counts ``m``. A group has as many buckets as values have leading bits: some hundreds."""
    group = Window.partitionBy(*keys, "feature")
    at = sketch.withColumn("_to", F.sum("m").over(group.orderBy("bucket"))).withColumn("_all", F.sum("m").over(group))
    q = lambda part: F.min(F.when(F.col("_to") * 4 >= F.col("_all") * part, F.col("bucket")))
    return at.groupBy(*keys, "feature").agg(q(1).alias("a"), q(3).alias("b"))


def thresholds(base: DataFrame, parent: int = PARENT) -> DataFrame:
    """(lang, source, hi_<feature>..., lo_word_len): one row for each group of documents with words."""
    fences = quartiles(mixtures(checkpointed(sketches(base, ["lang", "source"])), parent), ["lang", "source"])
    out = []
    for name, slack in SLACK.items():
        here = F.col("feature") == name
        out.append(F.max(F.when(here, F.col("b") + SPREAD * (F.col("b") - F.col("a")) + slack)).alias(f"hi_{name}"))
    out.append(F.max(F.when(F.col("feature") == "word_len", F.col("a") - SPREAD * (F.col("b") - F.col("a")) - SLACK["word_len"])).alias("lo_word_len"))
    return fences.groupBy("lang", "source").agg(*out)


def judged(base: DataFrame, limits: DataFrame) -> DataFrame:
    """``base`` with base_failed and kept, by the thresholds of its group.

    The thresholds hold a row for each group; Spark broadcasts them while they are small and otherwise joins by
    shuffle, where AQE splits a group that holds many of the rows.
    """
    inside = F.lit(True)
    for name, value in features().items():
        inside &= F.col(f"hi_{name}").isNull() | (value <= F.col(f"hi_{name}"))
    inside &= F.col("lo_word_len").isNull() | (features()["word_len"] >= F.col("lo_word_len"))
    right = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    both = base.join(right, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return both.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside).drop("_lang", "_source", *right.columns[2:])


def assess(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source"), parent: int = PARENT) -> DataFrame:
    """Counts, base_failed and kept of every row of ``df``. The counts (no texts) are checkpointed: two readers use them."""
    base = checkpointed(base_features(df, keep=keep))
    return judged(base, thresholds(base, parent))


#: Groups up to which their thresholds are sent to every task; beyond, they are joined by shuffle.
FEW_GROUPS = 10_000


def passing(df: DataFrame, parent: int = PARENT) -> DataFrame:
    """The rows of ``df`` that the rules keep. Thresholds come from a first pass over all rows, texts stay where they are."""
    own, names = set_aside(df)
    limits = checkpointed(thresholds(checkpointed(base_features(own)), parent))
    if limits.count() <= FEW_GROUPS:
        limits = F.broadcast(limits)
    return judged(base_features(own, keep=tuple(own.columns)), limits).where("kept").select(*own.columns).toDF(*names)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return assess(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """The base counts come from list functions; the sketches and fences from the same integer rules."""
    words = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    feature = {"symbols": "n_symbols, word_chars", "repeats": "n_repeat_words, n_words", "dup_lines": "n_dup_lines, n_lines", "word_len": "word_chars, n_words"}
    ratio = {k: "CASE WHEN {1} > 0 THEN CAST(floor(1000 * {0} / {1}) AS BIGINT) ELSE 0 END".format(*v.split(", ")) for k, v in feature.items()}
    shift = f"greatest(length(bin(v)) - {SUB_BITS}, 0)"
    made = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS feature, {r} AS v FROM base WHERE n_words > 0" for k, r in ratio.items())
    quart = "min(CASE WHEN upto * 4 >= total * {} THEN bucket END)"
    hi = ", ".join(f"max(CASE WHEN feature = '{k}' THEN q75 + {SPREAD} * (q75 - q25) + {s} END) AS hi_{k}" for k, s in SLACK.items())
    fine = " AND ".join(f"(hi_{k} IS NULL OR {r} <= hi_{k})" for k, r in ratio.items())
    return rf"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, {words} AS words FROM documents),
    places AS (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) > {WINDOW}),
    grams AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i:i + {WINDOW - 1}]) AS times FROM places),
    covered AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS j FROM grams WHERE times > 1) GROUP BY rid),
    lines AS (SELECT rid, line, count(*) AS times FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w)
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line),
    dup AS (SELECT rid, sum(times) AS n_lines, sum(times - 1) AS n_dup FROM lines GROUP BY rid),
    base AS (SELECT w.rid, doc_id, lang, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
      coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN covered ON w.rid = covered.rid LEFT JOIN dup ON w.rid = dup.rid),
    raw AS ({made}),
    made AS (SELECT lang, source, feature, (v >> {shift}::BIGINT) << {shift}::BIGINT AS bucket FROM raw),
    fine AS (SELECT lang, source, feature, bucket, count(*) AS c FROM made GROUP BY ALL),
    coarse AS (SELECT lang, feature, bucket, sum(c) AS l FROM fine GROUP BY ALL), sizes AS (SELECT lang, feature, sum(c) AS nl FROM fine GROUP BY ALL),
    whole AS (SELECT feature, bucket, sum(c) AS a, sum(sum(c)) OVER (PARTITION BY feature) AS na FROM fine GROUP BY feature, bucket),
    mixed AS (SELECT g.lang, g.source, g.feature, w.bucket, coalesce(f.c, 0)::HUGEINT * na::HUGEINT * (nl::HUGEINT + {PARENT}) + {PARENT} * (coalesce(k.l, 0)::HUGEINT * na::HUGEINT + {PARENT} * w.a::HUGEINT) AS m
      FROM (SELECT DISTINCT lang, source, feature FROM fine) g JOIN whole w ON w.feature = g.feature
      JOIN sizes s ON s.lang IS NOT DISTINCT FROM g.lang AND s.feature = g.feature
      LEFT JOIN coarse k ON k.lang IS NOT DISTINCT FROM g.lang AND k.feature = g.feature AND k.bucket = w.bucket
      LEFT JOIN fine f ON f.lang IS NOT DISTINCT FROM g.lang AND f.source IS NOT DISTINCT FROM g.source AND f.feature = g.feature AND f.bucket = w.bucket),
    q AS (SELECT lang, source, feature, {quart.format(1)} AS q25, {quart.format(3)} AS q75 FROM (SELECT *, sum(m) OVER (PARTITION BY lang, source, feature ORDER BY bucket) AS upto,
      sum(m) OVER (PARTITION BY lang, source, feature) AS total FROM mixed) GROUP BY ALL),
    fences AS (SELECT lang, source, {hi}, max(CASE WHEN feature = 'word_len' THEN q25 - {SPREAD} * (q75 - q25) - {SLACK["word_len"]} END) AS lo FROM q GROUP BY lang, source),
    verdict AS (SELECT base.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {fine} AND (lo IS NULL OR {ratio["word_len"]} >= lo) AS inside
      FROM base LEFT JOIN fences ON base.lang IS NOT DISTINCT FROM fences.lang AND base.source IS NOT DISTINCT FROM fences.source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM verdict"""


ORACLE = {"op4_quality": _oracle()}

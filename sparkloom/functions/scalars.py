"""Scalar expressions: cleaning of ids and categories, sequence parsing, buckets, guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "__NA__"


def clean_id(c: Column, numeric: bool = False) -> Column:
    """Trimmed text; null, NaN and the text nan are empty, whole numbers of numeric columns lose their fraction."""
    text = F.trim(c.cast("string"))
    if numeric:
        text = F.regexp_replace(text, r"\.0+$", "")
    return F.when(c.isNull() | (F.lower(text) == "nan"), "").otherwise(text)


def clean_scalar(c: Column) -> Column:
    """A category as text; missing values are a category of their own."""
    text = F.trim(c.cast("string"))
    return F.when(c.isNull() | (text == "") | (F.lower(text) == "nan"), MISSING).otherwise(text)


def split_items(c: Column) -> Column:
    """The cleaned items of a comma-separated list, without empty ones; null is the empty list."""
    items = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.regexp_replace(clean_id(x), r"^(\d+)\.0+$", "$1"))
    return F.filter(items, lambda x: x != "")


def seq_len(c: Column) -> Column:
    """Comma-separated tokens without cleaning; 0 if blank or nan."""
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when((text == "") | (F.lower(text) == "nan"), 0).otherwise(F.size(F.split(text, ","))).cast("long")


def parse_counts(c: Column) -> Column:
    """``a:3,b:1`` as a map; malformed pairs are skipped and the last of equal keys counts."""
    pairs = F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.regexp_like(p, F.lit(r"^[^:]+:\s*\d+\s*$")))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.split(p, ":")[0]).alias("k"), F.trim(F.split(p, ":")[1]).cast("long").alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"])
    return F.map_from_arrays(keys, last)


def left_padded(ids: Column, length: int) -> Column:
    """The last ``length`` ids, zeros before them."""
    n = F.least(F.lit(length), F.size(ids))
    kept = F.when(n > 0, F.slice(ids, F.greatest(F.size(ids) - length, F.lit(0)) + 1, F.greatest(n, F.lit(1)))).otherwise(F.filter(ids, lambda x: F.lit(False)))
    return F.concat(F.array_repeat(F.lit(0).cast("long"), length - n), kept.cast("array<bigint>"))


def length_bucket(n: Column) -> Column:
    out = F.when(n <= 2, n.cast("string"))
    for top, name in ((4, "3-4"), (7, "5-7"), (15, "8-15"), (30, "16-30")):
        out = out.when(n <= top, name)
    return out.otherwise("31+")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def finite(c: Column) -> Column:
    """0 for null, NaN and infinities."""
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def popularity_penalty(count: Column, power: float = 0.08) -> Column:
    return F.pow(F.log1p(F.lit(2.0)) / F.log1p(count + 2), F.lit(power))


def softmax(z: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def margin(p: Column) -> Column:
    ordered = F.sort_array(p, asc=False)
    return F.get(ordered, F.lit(0)) - F.coalesce(F.get(ordered, F.lit(1)), F.lit(0.0))


def smoothed_label(is_truth: Column, classes: int, eps: float = 0.05) -> Column:
    return F.when(is_truth, 1.0 - eps).otherwise(eps / (classes - 1))


def linear_schedule(step: Column, steps: int, start: float, end: float) -> Column:
    return F.lit(start) + (end - start) * F.least(F.greatest(step / F.lit(max(steps - 1, 1)), F.lit(0.0)), F.lit(1.0))


def hash_bucket(key: Column, buckets: int | Column) -> Column:
    """A bucket from the first eight hex digits of md5: the same in any engine."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), buckets if isinstance(buckets, Column) else F.lit(buckets))


def fenced_code(text: Column) -> Column:
    """The bodies of fenced code blocks."""
    return F.regexp_extract_all(text, F.lit("(?s)```[a-zA-Z]*\\n(.*?)```"), F.lit(1))


def decision(text: Column) -> Column:
    """The decision field of JSON in a text, fenced or not; else the first keyword that it holds."""
    body = F.regexp_replace(text, "```(json)?", "")
    stated = F.upper(F.get_json_object(F.regexp_extract(body, r"(?s)(\{.*\})", 1), "$.decision"))
    up = F.upper(text)
    return F.when(stated.isin("STOP", "PIVOT", "CONTINUE"), stated).when(F.contains(up, F.lit("STOP")), "STOP").when(F.contains(up, F.lit("PIVOT")), "PIVOT").otherwise("CONTINUE")


def metric_values(text: Column, name: str) -> Column:
    """All numbers that follow a metric's name in a log."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b{name}\b\s*[:=]\s*([0-9]*\.?[0-9]+)"), F.lit(1)), lambda x: x.cast("double"))

"""Personal data: fixed patterns, and contexts learnt from what they find.

``base_spans`` finds emails, IPv4 addresses, payment cards and phone numbers in linear time. Each find is a seed; the two
words before it form its lexical pattern. Tokens that look like identifiers (four digits or more, or an ``@``) and are
no seeds are mentions of the pattern before them. Spark scores the graph of patterns and instances in rounds: a
pattern's confidence in a kind is the mean score of its distinct instances, seeds scoring 1, other instances the
noisy-or of their *other* accepted patterns, so that no pattern vouches for itself, and those that no other accepted
pattern has seen a prior. Patterns whose scores sum to enough seeds at enough confidence are accepted; in the next round
their instances are weighted seeds of all patterns that they stand behind, known or new. Mentions of accepted patterns
are added as spans of the pattern's kind; base spans always stay.

Odd input: a null text is empty and has no spans; rows with the same id and text get the same spans; all counts are of
distinct instances, so repeated rows don't raise a confidence. Texts are read whole, each in one task, and tokens and the
distance of a pattern's words have no length limit; an empty table gives an empty result; ``masked`` returns the caller's columns under their own names, whatever they are. Patterns are summed before they are shuffled and no
pattern's instances are gathered in one place.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import begins, checkpointed, set_aside

KINDS = ("email", "ip", "card", "phone")
#: Distinct (or weighted) seeds that a pattern needs, the confidence that it needs, and the rounds of scoring.
MIN_SEEDS = 5
MIN_CONFIDENCE = 0.8
ROUNDS = 3
#: Score of an instance that nothing else tells about: a pattern with as many of these as seeds is still accepted.
PRIOR = 0.65
#: Characters of an instance beyond which its digest stands for it.
LONG = 64

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: The same matches as without lookbehind: a match can only begin where a run of digits begins.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\s,;:()<>\[\]{}\"'#*$%&|]+")
LETTERS = re.compile(r"[^\W\d_]+")
_LUHN = tuple(sum(divmod(2 * d, 10)) for d in range(10))


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    return (sum(map(int, odd)) + sum(_LUHN[int(d)] for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, leftmost first; linear in the text."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in the order of KINDS, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGITS.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15]
    return out


def word_starts(text: str) -> list[int]:
    return [m.start() for m in LETTERS.finditer(text)]


def pattern(text: str, start: int, words: list[int]) -> str:
    """The two words before ``start``, however far, or fewer at the start of the text, whose ``words`` begin there."""
    i = bisect_left(words, start)
    return " ".join(LETTERS.match(text, w, start)[0].lower() for w in words[max(0, i - 2) : i])


def named(token: str) -> str:
    """An instance as it goes through shuffles: itself, or its digest if it is long."""
    return token if len(token) <= LONG else "blake2b:" + hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def identifiers(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens that look like identifiers and touch no span."""
    if not spans and not DIGITS.search(text) and "@" not in text:
        return []
    taken = sorted((a, b) for _, a, b in spans)
    out, i, last = [], 0, 0
    for m in re.finditer(r"[0-9]{2}|@", text):
        if m.start() < last:
            continue
        left = m.start()
        while left > last and TOKEN.fullmatch(text, left - 1, left):
            left -= 1
        t = TOKEN.match(text, left)
        if t is None:
            continue
        last = t.end()
        a, b = left, last
        while b > a and text[b - 1] in ".!?-":
            b -= 1
        if "@" not in text[a:b] and len(DIGITS.findall(text, a, b)) < 4:
            continue
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if not any(x < b and y > a for x, y in taken[i : i + 8]):
            out.append((a, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


FOUND = "spans array<struct<kind:int,start:int,end:int>>, seeds array<struct<pattern:string,kind:int,instance:string>>, mentions array<struct<pattern:string,instance:string,start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_SEED = pa.list_(pa.struct([("pattern", pa.string()), ("kind", pa.int32()), ("instance", pa.string())]))
_MENTION = pa.list_(pa.struct([("pattern", pa.string()), ("instance", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def found(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint of the text, and FOUND for every row; no texts."""
    own = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("fp"), F.col(text_col).alias("_text"))
    schema = own.drop("_text").schema
    for f in df.sparkSession.createDataFrame([], FOUND).schema:
        schema = schema.add(f)

    def run(batches):
        begins("pii")
        for batch in batches:
            spans, seeds, mentions = [], [], []
            for text in batch.column(2).to_pylist():
                text = text or ""
                own = base_spans(text)
                like = identifiers(text, own)
                words = word_starts(text) if own or like else []
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                seeds.append([{"pattern": pattern(text, a, words), "kind": k, "instance": named(text[a:b])} for k, a, b in own])
                mentions.append([{"pattern": pattern(text, a, words), "instance": named(text[a:b]), "start": a, "end": b} for a, b in like])
            if spans:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPAN), pa.array(seeds, _SEED), pa.array(mentions, _MENTION)], names=schema.names)

    return own.mapInArrow(run, schema)


def confident_patterns(rows: DataFrame, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that may discover identifiers, from the output of ``found``."""
    key = ["pattern", "kind"]
    seeds = rows.select(F.explode("seeds").alias("s")).select("s.*").distinct()
    seeded = seeds.select("kind", "instance").distinct()
    edges = checkpointed(rows.select(F.explode("mentions").alias("m")).select("m.pattern", "m.instance").where("pattern <> ''").distinct())
    # An instance of another pattern that is a seed of the kind counts as one here too.
    also = edges.join(seeded, "instance").select(*key, "instance", F.lit(1).alias("mention"))
    sure = seeds.where("pattern <> ''").select(*key, "instance", F.lit(0).alias("mention")).union(also)
    sure = sure.groupBy(*key, "instance").agg(F.max("mention").alias("mention"))
    sure = checkpointed(sure.groupBy(*key).agg(F.count("*").alias("n_sure"), F.sum("mention").alias("n_also")))
    mentions = checkpointed(edges.groupBy("pattern").agg(F.count("*").alias("n_mentions")))

    def accepted(gained: DataFrame) -> DataFrame:
        both = sure.join(gained, key, "full").join(mentions, "pattern", "left").na.fill(0)
        n_open = F.col("n_mentions") - F.col("n_also") - F.col("n_gained")
        both = both.withColumn("support", F.col("n_sure") + F.col("gained"))
        both = both.withColumn("confidence", (F.col("support") + PRIOR * n_open) / (F.col("n_sure") + F.col("n_gained") + n_open))
        return checkpointed(both.where((F.col("support") >= min_seeds) & (F.col("confidence") >= min_confidence)).select(*key, "confidence"))

    conf = accepted(rows.sparkSession.createDataFrame([], "pattern string, kind int, gained double, n_gained long"))
    for _ in range(rounds):
        own = conf.select(*key, F.log(1 - 0.99 * F.col("confidence")).alias("doubt"))
        told = edges.join(own, "pattern").join(seeded, ["kind", "instance"], "left_anti")
        told = told.groupBy("kind", "instance").agg(F.sum("doubt").alias("all_doubt"), F.count("*").alias("n"))
        scored = edges.join(told, "instance").join(own, key, "left").where(F.col("n") > F.col("doubt").isNotNull().cast("int"))
        score = F.greatest(F.lit(0.0), 1 - F.exp(F.col("all_doubt") - F.coalesce("doubt", F.lit(0.0))))
        conf = accepted(scored.groupBy(*key).agg(F.sum(score).alias("gained"), F.count("*").alias("n_gained")))
    return conf


def discovered(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, fp, more): the spans that confident patterns add, for the rows that have any."""
    hits = rows.where(F.size("mentions") > 0).select("doc_id", "fp", F.explode("mentions").alias("m")).select("doc_id", "fp", "m.pattern", "m.start", "m.end")
    best = patterns.groupBy("pattern").agg(F.min_by("kind", F.struct(-F.col("confidence"), "kind")).alias("kind"))
    own = hits.join(best, "pattern").select("doc_id", "fp", F.struct("kind", "start", "end").alias("s"))
    return own.groupBy("doc_id", "fp").agg(F.array_sort(F.collect_set("s")).alias("more"))


def all_spans(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The checkpointed output of ``found`` and the discovered spans."""
    rows = checkpointed(found(df, text_col, id_col))
    return rows, discovered(rows, confident_patterns(rows))


def with_spans(df: DataFrame, more: DataFrame, key: str, fp: str) -> DataFrame:
    """``df`` and, as its last column, the discovered spans of its rows."""
    right = more.select(F.col("doc_id").alias("_found_id"), F.col("fp").alias("_found_fp"), F.col("more").alias("_more"))
    return df.join(right, F.col(key).eqNullSafe(F.col("_found_id")) & (F.col(fp) == F.col("_found_fp")), "left").select(*df.columns, "_more")


def _digest(batches):
    for batch in batches:
        out = []
        for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            own = [(s["kind"], s["start"], s["end"]) for s in base]
            n = [0] * 4
            for k, _, _ in own:
                n[k] += 1
            extra = [(s["kind"], s["start"], s["end"]) for s in more or ()]
            out.append((*n, hashlib.sha256(joined(own).encode()).hexdigest(), joined(sorted(own + extra))))
        if out:
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(zip(*out)))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, more = all_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    both = with_spans(rows.select("doc_id", "fp", "spans"), more, "doc_id", "fp")
    return both.select("doc_id", "spans", "_more").mapInArrow(_digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(df: DataFrame) -> DataFrame:
    """``df`` with each span of ``text`` replaced by its kind in angle brackets, and n_chars of the new text.

    A text that is null stays null. Overlapping spans are masked as one, named by the first.
    """
    df, given = set_aside(df)
    _, more = all_spans(df)
    names = df.columns
    both = with_spans(df.withColumn("_text_fp", F.xxhash64("text")), more, "doc_id", "_text_fp").select(*names, "_more")
    at, count = names.index("text"), names.index("n_chars")

    def run(batches):
        begins("pii")
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, more in enumerate(batch.column(len(names)).to_pylist()):
                text = texts[i]
                if not text:
                    continue
                spans = sorted((a, b, k) for k, a, b in base_spans(text) + [(s["kind"], s["start"], s["end"]) for s in more or ()])
                out, end = [], 0
                for a, b, k in spans:
                    if a >= end:
                        out += [text[end:a], f"<{KINDS[k].upper()}>"]
                    end = max(end, b)
                texts[i] = "".join([*out, text[end:]]) if spans else text
            if texts:
                columns = list(batch.columns[: len(names)])
                columns[at] = pa.array(texts, pa.string())
                columns[count] = pa.array([c if t is None else len(t) for t, c in zip(texts, columns[count].to_pylist())], pa.int64())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.mapInArrow(run, df.schema).toDF(*given)

"""Collocations by PCY and DHP: bucket counts of the next longer phrases, bitmaps, Apriori pruning, then exact counts.

A text is lower-cased (A-Z) and cut into pieces, and those into words; a phrase lies within a piece and counts per language.

Pass n reads all texts. It counts the phrases of n words that may be frequent, exactly, and at the same time adds the
phrases of n + 1 words that may be frequent to ``buckets`` counters by their hash (a counter stops at ``least``). Counters
are added over all tasks; a phrase of n words may be frequent if its bucket reached ``least`` (PCY), if both of its phrases
of n - 1 words are frequent (Apriori), and, for counting in buckets, if both of its phrases of n - 1 words may be (DHP).
What is known to be frequent goes to the tasks as a bitmap of the same hashes, as the set itself has no bound; so the
bitmaps prune only, and every count comes from exact grouping by the phrase. A bitmap has ``buckets`` bits: a power of two
of one for 64 to 128 bytes of text, between 2^16 and 2^26, so 8 MB at the most are broadcast and 64 MB of counters are held by
a worker, whatever the size of the corpus.

Candidates are phrases of 2 to ``longest`` words with f >= least. A cut after the first k words scores
floor(2000000 f / (f(first) + f(rest))); the least score counts, then the smallest k. A candidate goes if a longer one holds
it that is at least ``closed`` percent as frequent. Each language's first ``top`` are returned. Products are decimals.

Odd input: a null language is ``und``, with the texts that say so themselves; a null, empty or blank text has no words.
Texts are read whole; repeated rows count as often as they occur; an empty table gives an empty result. Only language and
text are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import begins, chunks, written

LEAST = 30
LONGEST = 4
TOP = 2000
CLOSED = 80
SCALE = 2_000_000
#: A byte for each of 256: A-Z in lower case, the tab as a space, what ends a piece as a full stop.
_STOPS = b".,;:!?\n\v\f\r"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _STOPS, b"abcdefghijklmnopqrstuvwxyz " + b"." * len(_STOPS))
#: Parts into which counters and bitmaps are cut on their way.
SLICES = 64
#: Phrases that a worker adds up before it sends them on, and characters that it reads at once.
HELD = 250_000
CHUNK = 2_000_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts as numbers, 0 between pieces; ``hashes[k]`` has the hash of the k + 1 words at each place."""

    def __init__(self, langs: list[str], texts: list[str | None], longest: int):
        ids, hashes = [np.zeros(1, np.int64)], [np.zeros(1, np.uint64)]
        self.words: list[str] = [""]
        self.firsts: list[tuple[int, str]] = []  # from which number on the words are of a language
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(langs, texts):
            if text:
                by_lang.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass"))
        for lang, own in by_lang.items():
            raw = b".".join(own).translate(_FOLD).replace(b".", b" . ")
            # the space is the only blank of ASCII that is left
            found = pa.array(raw.split(), pa.string()).dictionary_encode()
            names = found.dictionary.to_pylist()
            salt = zlib.crc32(lang.encode("utf-8", "surrogatepass"))
            number = np.arange(len(names), dtype=np.int64) + len(self.words)
            if "." in names:
                number[names.index(".")] = 0
            h = _mix(np.fromiter((zlib.crc32(x.encode(), salt) for x in names), np.uint64, len(names)) + np.uint64(1))
            at = found.indices.to_numpy()
            ids += [number[at], np.zeros(1, np.int64)]
            hashes += [h[at], np.zeros(1, np.uint64)]
            self.firsts.append((len(self.words), lang))
            self.words += names
        self.ids, one = np.concatenate(ids), np.concatenate(hashes)
        self.hashes = [one]
        for k in range(1, longest):
            last = self.hashes[-1]
            self.hashes.append(_mix(last[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[k:]) if len(last) else last)
        word = self.ids != 0
        self.inside = [word]
        for k in range(1, longest):
            self.inside.append(self.inside[-1][:-1] & word[k:] if len(self.inside[-1]) else self.inside[-1])

    def phrases(self, at: np.ndarray, n: int) -> tuple[list[tuple[str, str]], np.ndarray]:
        """The different phrases of n words that start at ``at``, and how often: names of pairs of names, so no hash decides."""
        if n == 1:
            many = np.bincount(self.ids[at], minlength=1)
            first = np.flatnonzero(many)
            ids, many = first[:, None], many[first]
        else:
            name = self.ids[at]
            for k in range(1, n):
                _, name = np.unique(name * len(self.words) + self.ids[at + k], return_inverse=True)
            _, first, many = np.unique(name, return_index=True, return_counts=True)
            ids = np.stack([self.ids[at[first] + k] for k in range(n)], 1) if len(at) else np.empty((0, n), np.int64)
        lang = np.searchsorted([k for k, _ in self.firsts], ids[:, 0], side="right") - 1
        words, names = self.words, [x for _, x in self.firsts]
        return [(names[k], " ".join([words[i] for i in r])) for k, r in zip(lang.tolist(), ids.tolist())], many


def _test(bits: np.ndarray | None, h: np.ndarray, buckets: int) -> np.ndarray:
    if bits is None:
        return np.ones(len(h), bool)
    at = (h & np.uint64(buckets - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


#: A phrase and its count, or a slice of counters.
MAPPED = "lang string, phrase string, n long, slice int, counters binary"


def _pass(docs: DataFrame, n: int, buckets: int, least: int, longest: int, bucket_bits, frequent_bits) -> DataFrame:
    """Pass n: MAPPED rows of all texts. ``bucket_bits`` and ``frequent_bits`` are broadcast bitmaps of phrases of n words
    by bucket and of n - 1 words by exact count; None in pass 1."""

    def sent(counts: dict) -> pa.RecordBatch:
        langs, phrases = zip(*counts) if counts else ((), ())
        m = len(langs)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(counts.values(), pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)

    def run(batches):
        begins("collocations")
        by_bucket = np.frombuffer(bucket_bits.value, np.uint8) if bucket_bits is not None else None
        frequent = np.frombuffer(frequent_bits.value, np.uint8) if frequent_bits is not None else None
        counters = np.zeros(buckets, np.uint8) if n < longest else None
        counts: dict = defaultdict(int)
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts, CHUNK):
                w = Words(langs[a:b], texts[a:b], n + 1)
                may = w.inside[n - 1].copy()
                if n > 1 and len(may):
                    ok = _test(frequent, w.hashes[n - 2], buckets)
                    may &= ok[:-1] & ok[1:] & _test(by_bucket, w.hashes[n - 1], buckets)
                for key, many in zip(*w.phrases(np.flatnonzero(may), n)):
                    counts[key] += int(many)
                if len(counts) >= HELD:
                    yield sent(counts)
                    counts = defaultdict(int)
                if counters is not None and len(w.inside[n]):
                    longer = w.inside[n] & may[:-1] & may[1:]
                    at = np.sort((w.hashes[n][longer] & np.uint64(buckets - 1)).astype(np.uint32))
                    head = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
                    more = np.minimum(np.diff(np.append(head, len(at))), least)
                    counters[at[head]] = np.minimum(counters[at[head]] + more, least)
        if counts:
            yield sent(counts)
        if counters is not None and counters.any():
            size = buckets // SLICES
            some = [k for k in range(SLICES) if counters[k * size : (k + 1) * size].any()]
            m = len(some)
            parts = [counters[k * size : (k + 1) * size].tobytes() for k in some]
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.array(some, pa.int32()), pa.array(parts, pa.binary())], names=names)

    names = ["lang", "phrase", "n", "slice", "counters"]
    return docs.mapInArrow(run, MAPPED)


def _bitmap(slices: DataFrame, buckets: int, least: int):
    """A broadcast bitmap of the counters that reached ``least``, of (slice, counters): ``buckets`` bits reach the driver."""
    size = buckets // SLICES

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums = total.setdefault(k, np.zeros(size, np.int64))
                sums += np.frombuffer(blob, np.uint8)
                np.minimum(sums, least, out=sums)
        if total:
            bits = [np.packbits(x >= least, bitorder="little").tobytes() for x in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array(bits, pa.binary())], names=["slice", "bits"])

    out = bytearray(buckets // 8)
    for r in slices.repartition("slice").mapInArrow(run, "slice int, bits binary").collect():  # SLICES rows
        out[r.slice * size // 8 : (r.slice + 1) * size // 8] = r.bits
    return slices.sparkSession.sparkContext.broadcast(bytes(out))


def _marks(frequent: DataFrame, n: int, buckets: int) -> DataFrame:
    """(slice, counters): 1 in the buckets of (lang, phrase) of n words."""

    def run(batches):
        counters = np.zeros(buckets, np.uint8)
        for batch in batches:
            langs, phrases = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                w = Words([lang] * langs.count(lang), [p for x, p in zip(langs, phrases) if x == lang], n)
                counters[(w.hashes[n - 1][w.inside[n - 1]] & np.uint64(buckets - 1)).astype(np.int64)] = 1
        size = buckets // SLICES
        some = [k for k in range(SLICES) if counters[k * size : (k + 1) * size].any()]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([counters[k * size : (k + 1) * size].tobytes() for k in some], pa.binary())], names=["slice", "counters"])

    return frequent.select("lang", "phrase").mapInArrow(run, "slice int, counters binary")


def buckets_for(docs: DataFrame) -> int:
    n = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    return 1 << min(26, max(16, int(np.log2(max(n, 1) / 64))))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n_words, f) of all phrases of up to ``longest`` words with f >= least, and (lang, n): words in all."""
    if least > 127:
        raise ValueError("counters have a byte: a sum of two must fit")
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    buckets = buckets or buckets_for(own)
    levels, by_bucket, frequent, words = [], None, None, None
    for n in range(1, longest + 1):
        rows = written(_pass(own, n, buckets, least, longest, by_bucket, frequent))
        exact = rows.where("slice is null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if n == 1:
            words = written(rows.where("slice is null").groupBy("lang").agg(F.sum("n").alias("n")))
        level = written(exact.where(F.col("f") >= least).select("lang", "phrase", F.lit(n).alias("n_words"), "f"))
        levels.append(level)
        if n < longest:
            by_bucket = _bitmap(rows.where("slice is not null").select("slice", "counters"), buckets, least)
            frequent = _bitmap(_marks(level, n, buckets), buckets, 1)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, words


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, closed: int = CLOSED, buckets: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut): the first ``top`` phrases of each language."""
    counts, words = frequent_phrases(docs, least, longest, buckets)
    made = counts.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"), F.split("phrase", " ").alias("_w"))
    part = lambda a, b: F.array_join(F.slice("_w", a, b), " ")
    cuts = made.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.withColumn("first", part(F.lit(1), F.col("cut"))).withColumn("rest", part(F.col("cut") + 1, F.col("n_words") - F.col("cut")))
    side = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    score = F.expr(f"cast({SCALE} as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    least_of = cuts.select("lang", "phrase", F.struct(score.alias("score"), "cut", "l", "r", "a").alias("_s")).groupBy("lang", "phrase").agg(F.min("_s").alias("_s"))
    longer = made.where("n_words > 2").withColumn("k", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)))
    longer = longer.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("k") + 1))).select("lang", part(F.col("i"), F.col("k")).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = least_of.join(longer, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer").cast("decimal(19,0)") < closed * F.col("_s.a").cast("decimal(19,0)")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "_s.*").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("cut")


ORACLE = {
    "op12_collocations": rf"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
    g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM
      (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {LONGEST + 1})) AS k))),
    c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
    f AS (SELECT * FROM c WHERE f >= {LEAST}),
    m AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
    cuts AS (SELECT *, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM m)),
    s AS (SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * a) // (x.f + y.f) AS score
      FROM cuts JOIN f x ON cuts.lang = x.lang AND first = x.phrase JOIN f y ON cuts.lang = y.lang AND rest = y.phrase),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    q AS (SELECT lang, a, array_to_string(w[i:i + j - 1], ' ') AS phrase FROM
      (SELECT lang, a, w, j, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM m WHERE k > 2))),
    u AS (SELECT lang, phrase, max(a) AS longer FROM q GROUP BY lang, phrase),
    t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN u ON b.lang = u.lang AND b.phrase = u.phrase WHERE longer IS NULL OR 100 * longer < {CLOSED} * a)
    SELECT t.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM t JOIN n ON t.lang = n.lang WHERE rank <= {TOP}"""
}

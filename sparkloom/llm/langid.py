"""Language identification by bit-sliced n-gram Bloom filters.

Training counts the character 3- and 4-grams of each language (words padded with one blank at both ends) and keeps
those with at least ``share`` of the language's n-grams: at most 1 / share of them for each language, whatever the
size of the corpus. All languages go into one bit-sliced Bloom filter: slot ``i`` holds one bit for each language, so
``HASHES`` lookups and one AND return the mask of all languages that contain an n-gram. The popcount of each language
over a document, corrected for that language's rate of false positives, decides.

Results for odd input: a null text or a text without letters gets ``und`` and score 0; a table without usable training
rows gives ``und`` for all; languages tie to the one with more training n-grams, then to the smaller name. Rows are
judged one by one, so repeated rows repeat their result. Only the named columns of the input are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import chunks

UNKNOWN = "und"
HASHES = 3
#: Slots of the filter for each n-gram of the largest language.
SLOTS_PER_GRAM = 10
#: An n-gram belongs to a language's profile from this share of the language's n-grams on.
SHARE = 1e-5
#: Distinct n-grams that a training task holds before it hands on its counts.
HELD_GRAMS = 400_000


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, the index of the text that each comes from, and for each text whether it has letters."""
    low = [t.lower() for t in texts]
    cp = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    owner = np.append(owner, len(low) - 1)
    is_letter = letters()[cp]
    has = np.zeros(len(low), bool)
    has[owner[is_letter]] = True
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    c = np.where(is_letter, cp, 0)[keep].astype(np.uint64)
    owner = owner[keep].astype(np.int32)
    a, a2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x9E3779B97F4A7C15**2 % 2**64)
    if len(c) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int32), has
    pair = c[:-1] * a + c[1:]
    inner = c[1:-1] != 0
    three = (pair[:-1] * a + c[2:])[inner]
    own3 = owner[1:-1][inner]
    both = inner[:-1] & inner[1:]
    four = (pair[:-2] * (a2) + pair[2:] + np.uint64(77))[both]
    h = np.concatenate([three, four])
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h, np.concatenate([own3, owner[1:-2][both]]), has


def _slots(h: np.ndarray, m: int, k: int) -> np.ndarray:
    x = h * np.uint64((0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)[k])
    return ((x ^ (x >> np.uint64(31))) & np.uint64(m - 1)).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    weight: list[int]  #: training n-grams by language, for ties
    bits: np.ndarray  #: (slots, words) uint64: one bit a language
    false: np.ndarray  #: rate of false positives by language

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n, size = len(texts), len(self.langs)
        h, own, has = grams([t or "" for t in texts])
        out, score = [UNKNOWN] * n, np.zeros(n)
        if not size:
            return out, score
        total = np.bincount(own, minlength=n).astype(float)
        m = len(self.bits)
        hit = np.empty((n, size))
        at = [_slots(h, m, k) for k in range(HASHES)]
        for word in range(self.bits.shape[1]):
            col = self.bits[:, word]
            mask = col[at[0]]
            for s in at[1:]:
                mask &= col[s]
            for bit in range(word * 64, min(size, word * 64 + 64)):
                hit[:, bit] = np.bincount(own[(mask >> np.uint64(bit & 63)) & np.uint64(1) == 1], minlength=n)
        true = np.clip((hit - total[:, None] * self.false) / (1 - self.false), 0, None)
        best = true.argmax(axis=1)  # languages stand in the order that decides ties
        for i in range(n):
            if has[i]:
                out[i] = self.langs[best[i]]
                score[i] = min(1.0, true[i, best[i]] / total[i]) if total[i] else 0.0
        return out, score


def build(profile: dict[str, np.ndarray], weight: dict[str, int]) -> Model:
    langs = sorted(profile, key=lambda x: (-weight[x], x))
    most = max((len(v) for v in profile.values()), default=1)
    m = 1 << max(6, (SLOTS_PER_GRAM * most - 1).bit_length())
    bits = np.zeros((m, max(1, -(-len(langs) // 64))), np.uint64)
    false = np.zeros(len(langs))
    for i, lang in enumerate(langs):
        flag = np.uint64(1 << (i & 63))
        for k in range(HASHES):
            bits[_slots(profile[lang], m, k), i // 64] |= flag
        false[i] = min(0.99, float(np.mean(bits[:, i // 64] & flag != 0)) ** HASHES)
    return Model(langs, [weight[x] for x in langs], bits, false)


def _count(batches):
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush():
        for lang, (codes, n) in held.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "gram": pa.array(codes.view(np.int64)), "n": pa.array(n, pa.int64())})
        held.clear()

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, j in chunks(texts):
            by: dict[str, list[str]] = {}
            for lang, text in zip(langs[i:j], texts[i:j]):
                by.setdefault(lang, []).append(text)
            for lang, own in by.items():
                codes, n = np.unique(grams(own)[0], return_counts=True)
                if lang in held:
                    both = np.concatenate([held[lang][0], codes])
                    codes, at = np.unique(both, return_inverse=True)
                    n = np.bincount(at, np.concatenate([held[lang][1], n]), len(codes)).astype(np.int64)
                held[lang] = codes, n
            if sum(len(v[0]) for v in held.values()) > HELD_GRAMS:
                yield from flush()
    yield from flush()


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", share: float = SHARE) -> Model:
    """Fit the filter on all rows of ``labelled`` with a language and a text.

    Counts are summed by Spark; the driver gets at most 1 / share n-grams for each language.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(total, "lang").where(F.col("n") >= F.col("total") * share).toArrow()
    weight = {x: 0 for x in kept["lang"].unique().to_pylist()}
    codes, names, totals = kept["gram"].to_numpy(), kept["lang"].to_numpy(zero_copy_only=False), kept["total"].to_numpy()
    profile = {}
    for lang in weight:
        own = names == lang
        profile[lang], weight[lang] = codes[own].astype(np.int64).view(np.uint64), int(totals[own][0])
    return build(profile, weight)


def identify(df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``df`` with lang_pred and score."""
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    own = df.select(*keep, F.col(text_col).alias("_text"))
    schema = own.drop("_text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            langs, scores = [], []
            for i, j in chunks(texts):
                a, b = shared.value.predict(texts[i:j])
                langs += a
                scores.append(b)
            if texts:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=schema.names)

    return own.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True for the third of the rows that training doesn't see; a null id is false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return identify(docs.drop("lang").withColumn("held_out", held_out()), model, keep=("doc_id", "held_out"))

"""Periodic runs of words by the runs theorem.

A run is a maximal stretch with smallest period q; those of at least ``max(least, times * q)`` words are reported. By the
theorem every run holds a Lyndon root that is the longest Lyndon word at its start under the order of words or under its
reverse, and that word ends before the next smaller (next greater) value of the inverse suffix array. So:

1. The texts of a chunk become one array of word numbers with a separator after each text. A text has word numbers of its
   own, so its suffixes lie together and never tie with another text's. Prefix doubling over the suffixes that still tie
   gives the inverse suffix array; the names of each round are kept.
2. Next smaller and next greater values give a root (i, i + q) for every word. A run that is long enough shows at its first
   root that ``max(least, 4q) - 2q + 1`` words from i and from i + q agree; roots whose names differ there are left out.
3. For the texts that are left, roots are extended to the right by range minima (sparse table) over the LCP array, to the
   left by the same over the reversed texts, and equal runs are united.

Each text is one row's work in a task: rows are independent, nothing is shuffled. Memory is that of a chunk of texts, and
of one text with n words about 8 n log2(n) bytes, as a text is never cut.

Odd input: a null, empty or blank text has no words and no runs. Texts of any length are read whole. Repeated rows and ids
give a row each, an empty table gives none. Columns besides the id and the text are not read, so their names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from sparkloom.llm.common import begins, chunks

LEAST = 6
TIMES = 4
RUNS = ArrayType(StructType().add("start", "long").add("length", "long").add("period", "long"))


def suffix_ranks(w: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Inverse suffix array of ``w``, names by round (round k: equal if 2^k symbols agree), and for each place of the
    suffix array the round in which it parted from the place before (-1: the first symbols differ).

    ``w`` holds numbers from 0 on and ends with a symbol that it has nowhere else, as does every text in it.
    """
    n = len(w)
    many = np.bincount(w)
    rank = (np.cumsum(many) - many)[w]
    parted = np.full(n, -1, np.int8)
    names = [rank.astype(np.int32)]
    at = np.flatnonzero(many[w] > 1)
    step, level = 1, 0
    while len(at):
        key = rank[at] * np.int64(n) + rank[at + step]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        group = rank[at]
        new = np.append(True, key[1:] != key[:-1])
        head = np.append(True, group[1:] != group[:-1])
        nth = np.arange(len(at))
        first = np.maximum.accumulate(np.where(new, nth, 0))
        rank[at] = group + first - np.maximum.accumulate(np.where(head, nth, 0))
        parted[rank[at[new & ~head]]] = level
        alone = new & np.append(new[1:], True)
        at = at[~alone]
        step, level = 2 * step, level + 1
        if len(at):
            names.append(rank.astype(np.int32))
    return rank, names, parted


def common_prefixes(rank: np.ndarray, names: list[np.ndarray], parted: np.ndarray) -> np.ndarray:
    """LCP of each place of the suffix array with the place before."""
    sa = np.empty(len(rank), np.int64)
    sa[rank] = np.arange(len(rank))
    lcp = np.zeros(len(rank), np.int32)
    at = np.flatnonzero(parted >= 0)
    top = parted[at].astype(np.int64)
    a, b, got = sa[at - 1], sa[at], np.int64(1) << top
    for k in range(int(top.max()) - 1 if len(at) else -1, -1, -1):
        may = np.flatnonzero(top > k)
        same = names[k][a[may] + got[may]] == names[k][b[may] + got[may]]
        got[may] += same.astype(np.int64) << k
    lcp[at] = got
    return lcp


class RangeMinima:
    """Sparse table: the least of any range by two lookups."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while 2 << (len(self.rows) - 1) <= len(x):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of x[a], ..., x[b], a <= b."""
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.rows[k][a[m]], self.rows[k][b[m] - (1 << int(k)) + 1])
        return out


class Extensions:
    """How far two suffixes of ``w`` agree."""

    def __init__(self, w: np.ndarray):
        self.rank, names, parted = suffix_ranks(w)
        self.minima = RangeMinima(common_prefixes(self.rank, names, parted))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return self.minima.least(np.minimum(a, b) + 1, np.maximum(a, b))


NEAR = 8


def next_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value; ``x`` ends with its least value, which gets its own place."""
    n = len(x)
    out = np.full(n, n - 1, np.int64)
    at = np.arange(n - 1)
    for d in range(1, NEAR + 1):
        at = at[at + d < n]
        less = x[at + d] < x[at]
        out[at[less]] = at[less] + d
        at = at[~less]
    if not len(at):
        return out
    # The others climb a tree of block minima to a block that has a smaller value, and go down to its first.
    tree = [x]
    while len(tree[-1]) > 1:
        row = tree[-1]
        row = np.append(row, row[-1:]) if len(row) % 2 else row
        tree.append(np.minimum(row[::2], row[1::2]))
    value, node = x[at], at + NEAR + 1
    up = np.flatnonzero(node < n)
    found = np.full(len(at), -1, np.int64)
    for k, row in enumerate(tree):
        here = up[(node[up] < len(row)) & ((node[up] % 2 == 1) | (k == len(tree) - 1))]
        hit = here[row[node[here]] < value[here]]
        found[hit] = k
        left = np.ones(len(at), bool)
        left[hit] = False
        up = up[left[up]]
        node[up] = (node[up] + 1) >> 1
    for k in range(len(tree) - 1, 0, -1):
        down = np.flatnonzero(found >= k)
        node[down] *= 2
        node[down] += tree[k - 1][node[down]] >= value[down]
    some = found >= 0
    out[at[some]] = node[some]
    return out


def roots(rank: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): the longest Lyndon words w[i:j] under both orders; j may be the separator."""
    i = np.ones(len(rank), bool)
    i[separators] = False
    i = np.flatnonzero(i)
    low = rank.copy()
    low[separators] = -1  # every text ends both searches
    high = len(rank) - rank
    high[separators] = -1
    return np.concatenate([i, i]), np.concatenate([next_smaller(low)[i], next_smaller(high)[i]])


def runs_of(w: np.ndarray, separators: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs in ``w``, sorted by start and period. Symbols of texts differ; each text ends
    with its separator, a symbol below those of all words."""
    none = np.empty(0, np.int64)
    if len(w) == len(separators):
        return none, none, none
    rank, names, _ = suffix_ranks(w)
    i, j = roots(rank, separators)
    q = j - i
    need = np.maximum(least, times * q) - 2 * q + 1  # a run that is long enough has at its first root so many words alike
    level = np.frexp(np.maximum(need, 1).astype(np.float64))[1] - 1
    keep = (w[i] == w[j]) & (level < len(names))
    i, j, level = i[keep], j[keep], level[keep]
    alike = np.zeros(len(i), bool)
    for k in np.unique(level):
        m = level == k
        alike[m] = names[k][i[m]] == names[k][j[m]]
    i, j = i[alike], j[alike]
    if not len(i):
        return none, none, none
    # Only the texts with such roots are extended.
    text = np.searchsorted(separators, i)
    used = np.unique(text)
    begin, end = np.append(-1, separators[:-1])[used] + 1, separators[used] + 1
    size = end - begin
    shift = np.cumsum(size) - size
    own = np.concatenate([w[a:b] for a, b in zip(begin, end)])
    _, own = np.unique(own, return_inverse=True)
    move = (begin - shift)[np.searchsorted(used, text)]
    i, j = i - move, j - move
    right = Extensions(own)(i, j)
    n = len(own)
    mirror = np.append(own[:-1][::-1], own.max() + 1)
    left = Extensions(mirror)(np.where(i > 0, n - 1 - i, n - 1), n - 1 - j)
    start, q = i - left, j - i
    length = q + left + right
    long = length >= np.maximum(least, times * q)
    rows = np.unique(np.stack([start + move, q, length], 1)[long], axis=0)
    return rows[:, 0], rows[:, 2], rows[:, 1]


def found(texts: list[list], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """For each text of words its runs as rows (start, length, period), by start, then period."""
    n = len(texts)
    ids: list[int] = []
    ends, fresh = np.empty(n, np.int64), n
    for k, words in enumerate(texts):
        own: dict = {}
        ids += [own.setdefault(x, len(own) + fresh) for x in words]
        fresh += len(own)
        ends[k] = len(ids)
        ids.append(k)
    start, length, period = runs_of(np.array(ids, np.int64), ends, least, times)
    text = np.searchsorted(ends, start)
    rows = np.stack([start - (np.append(-1, ends[:-1]) + 1)[text] if n else start, length, period], 1)
    cut = np.searchsorted(text, np.arange(n + 1))
    return [rows[a:b] for a, b in zip(cut[:-1], cut[1:])]


def without_repeats(words: list, rows: np.ndarray) -> list:
    """The words that lie in no run after its first period."""
    if not len(rows):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, rows[:, 0] + rows[:, 2], 1)
    np.add.at(edge, rows[:, 0] + rows[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]


def periodic_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: int = LEAST, times: int = TIMES, prepare: Callable[[object, list], list] | None = None) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: its runs by start and period, and its words without the repeats.

    ``prepare`` may change a row's words: it is given the id and the words (UTF-8).
    """
    own = docs.select(F.col(id_col), F.col(text_col))
    schema = own.select(own.columns[0]).schema.add("n_words", "long").add("runs", RUNS).add("collapsed", "string")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        begins("runs")
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                # bytes.split() takes the six blanks of ASCII as its own, and no others
                words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts[a:b]]
                if prepare is not None:
                    words = [prepare(k, x) for k, x in zip(ids[a:b].to_pylist(), words)]
                got = found(words, least, times)
                rows = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r.tolist()] for r in got], kind)
                rest = [b" ".join(without_repeats(x, r)).decode("utf-8", "surrogatepass") for x, r in zip(words, got)]
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(map(len, words), pa.int64()), rows, pa.array(rest, pa.string())], names=schema.names)

    return own.mapInArrow(run, schema)


def periodic_tail(doc_id: int | None, words: list) -> list:
    """The words of a document, in one of ten with a tail that repeats; a null id leaves them as they are."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document after the tails are made periodic; one row a document."""
    rows = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), prepare=periodic_tail)
    more = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"]) | ((x["length"] * y["period"] == y["length"] * x["period"]) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))
    best = F.reduce("runs", F.lit(None).cast(RUNS.elementType), lambda x, y: F.when(x.isNull() | more(y, x), y).otherwise(x))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n")))
    return rows.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


#: By pairs of equal words: islands of neighbouring pairs at one distance are stretches with that period.
ORACLE = {
    "op13_runs": r"""
    WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    h AS (SELECT doc_id, w, len(w) AS n, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384::BIGINT)), 4294967295::BIGINT) AS h FROM d),
    g AS (SELECT doc_id, w, n, h, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM h),
    t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM g),
    words AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(0, n)) AS i FROM t),
    pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
    isles AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS z FROM pairs) GROUP BY doc_id, q, z),
    long AS (SELECT * FROM isles WHERE l >= greatest(6, 4 * q)),
    runs AS (SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
    best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l / q DESC, s, q) = 1),
    listed AS (SELECT doc_id, count(*) AS n, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS x FROM runs GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
    kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS x FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT t.doc_id, coalesce(listed.n, 0) AS n_runs, s AS start, l AS length, q AS period, (1000 * l) // q AS exponent_milli,
      sha256(coalesce(listed.x, '')) AS runs_sha256, sha256(coalesce(kept.x, '')) AS collapsed_sha256, t.n AS n_words
    FROM t LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)"""
}

"""Removal of repeated lines that stays reversible: sharded cuckoo filters over exact reference counts.

A line's key is the line without blanks at both ends, A-Z in lower case; keys of ``least_chars`` code points or more count,
by their 128-bit BLAKE2 digest (hi, lo). A ``LineIndex`` is a folder of tables:

* ``postings`` (hi, lo, doc, batch): the keys of each document, once each; a batch is only ever added;
* ``dead`` (doc, before): documents that were deleted, for postings of batches before that number;
* ``counts`` (hi, lo, n_docs, top): exact reference counts, and the largest document that holds the key;
* ``filters`` (shard, n_seen, seen, n_repeated, repeated): for each shard of keys (the leading bits of ``hi``) one cuckoo
  filter of the keys that are counted, and one of those in ``least_docs`` documents or more.

``insert`` asks the filters of seen keys: a key that they don't know is new and is written as it is, only the others are
joined with the exact counts. ``delete`` subtracts; a key whose largest document went gets the next one from the postings,
and a key in no document leaves its filter. Counts that pass ``least_docs`` in either direction enter or leave the other
filter. A filter that is full is built anew from the counts at twice its size, and shards are split when they hold too many
keys. ``deduplicated`` drops every line of a repeated key but in the largest document that holds it; lines that the filters
of repeated keys don't know are not shuffled, if these filters together are within ``GATE_BYTES``; beyond that all lines
are joined with the repeated keys, with the same result. Nothing is decided by a filter alone.

Inserting the rest of a corpus, or deleting documents and inserting them again, gives the counts of one insert of what is
there. A batch that was written but not committed (a driver that died) is not read: ``version`` names the tables in use.

Odd input: a null or empty text is one empty line. Documents are told apart by their id; where ids are null or repeat,
``without_repeated_lines`` numbers the rows by id and text, so that equal rows are different documents and the last keeps
its lines. Long texts are read whole. An empty table gives an empty result. Only the id and the text are read, so other
columns can't clash.
"""

from __future__ import annotations

import atexit
import uuid
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import begins, checkpointed, delete, ordered, shared_folder, written

LEAST_CHARS = 20
LEAST_DOCS = 3
#: Keys of a shard on the average, from which shards are split.
SHARD_KEYS = 1 << 17
#: Bytes of all filters of repeated keys up to which they are sent to every task.
GATE_BYTES = 32 << 20
BLANKS = b" \t\n\v\f\r"


class CuckooFilter:
    """16-bit tags in buckets of four, two buckets a key. Keys that were added are always found, and may be removed."""

    SLOTS, LOAD, ROUNDS = 4, 0.8, 500

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(n, 1) / (cls.SLOTS * cls.LOAD)))))
        return cls(np.zeros((buckets, cls.SLOTS), np.uint16))

    @classmethod
    def of(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, cls.SLOTS).copy())

    def blob(self) -> bytes:
        return self.table.tobytes()

    def room(self, n: int) -> bool:
        return n <= self.table.size * self.LOAD

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = keys.astype(np.int64).view(np.uint64)
        tag = (k & np.uint64(0xFFFF)).astype(np.uint16)
        tag[tag == 0] = 1
        return tag, ((k >> np.uint64(16)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, tag: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ ((tag.astype(np.int64) * 0x5BD1E995 >> 7) & (len(self.table) - 1))

    def has(self, keys: np.ndarray) -> np.ndarray:
        tag, at = self._places(keys)
        return (self.table[at] == tag[:, None]).any(1) | (self.table[self._other(tag, at)] == tag[:, None]).any(1)

    def add(self, keys: np.ndarray) -> bool:
        """False if some did not find a place; the filter is then of no use."""
        tag, at = self._places(keys)
        for turn in range(self.ROUNDS):
            if not len(tag):
                return True
            order = np.argsort(at, kind="stable")
            tag, at = tag[order], at[order]
            nth = np.arange(len(at)) - np.searchsorted(at, at)
            free = self.table[at] == 0
            fits = nth < free.sum(1)
            slots = np.argsort(~free[fits], axis=1, kind="stable")
            self.table[at[fits], slots[np.arange(len(slots)), nth[fits]]] = tag[fits]
            tag, at = tag[~fits], at[~fits]
            if turn > 1 and len(tag):  # both buckets were full: one newcomer a bucket takes a slot, and its tag moves on
                first = np.append(True, at[1:] != at[:-1])
                slot = (turn * 5 + at[first] + tag[first]) % 7 % self.SLOTS
                moved = self.table[at[first], slot]
                self.table[at[first], slot] = tag[first]
                tag[first] = moved
            at = self._other(tag, at)
        return not len(tag)

    def remove(self, keys: np.ndarray) -> None:
        """Takes out one tag for each key; the keys must have been added."""
        tag, at = self._places(keys)
        tried = np.zeros(len(tag), np.int8)
        while len(tag):
            same = self.table[at] == tag[:, None]
            hit = same.any(1)
            flat = at * self.SLOTS + same.argmax(1)
            _, first = np.unique(np.where(hit, flat, -1 - np.arange(len(flat))), return_index=True)
            mine = np.zeros(len(tag), bool)
            mine[first] = True
            mine &= hit
            self.table.reshape(-1)[flat[mine]] = 0
            miss = ~hit
            if (tried[miss] > 0).any():
                raise ValueError("a key to be removed was never added")
            tried[miss] = 1
            at = np.where(miss, self._other(tag, at), at)
            tag, at, tried = tag[~mine], at[~mine], tried[~mine]


def line_keys(raw: bytes, least_chars: int = LEAST_CHARS) -> list[bytes | None]:
    """For each line of UTF-8 ``raw`` the digest of its key, or None where the key is short."""
    out: list[bytes | None] = []
    for line in raw.lower().split(b"\n"):  # bytes.lower() changes A-Z only
        if len(line) >= least_chars:
            line = line.strip(BLANKS)
            if len(line) >= 4 * least_chars or len(line) - sum(map(line.count, _INNER) if not line.isascii() else ()) >= least_chars:
                out.append(blake2b(line, digest_size=16).digest())
                continue
        out.append(None)
    return out


_INNER = [bytes([x]) for x in range(0x80, 0xC0)]  # bytes that don't begin a code point


def _mapped(docs: DataFrame, least_chars: int, gate=None) -> DataFrame:
    """(doc, hi, lo) for each key of each document once, of (doc, text); with ``gate`` only of keys that it may know."""

    def run(batches):
        begins("linedup")
        known = gate() if gate is not None else None
        for batch in batches:
            n, keys = [], []
            for text in batch.column(1).to_pylist():
                own = set(line_keys((text or "").encode("utf-8", "surrogatepass"), least_chars))
                own.discard(None)
                n.append(len(own))
                keys += own
            pairs = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
            doc = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), n)
            if known is not None:
                may = known(pairs)
                doc, pairs = doc[may], pairs[may]
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["doc", "hi", "lo"])

    return docs.select(F.col("doc").cast("long"), "text").mapInArrow(run, "doc long, hi long, lo long")


def _shard(bits: int) -> Column:
    """The leading ``bits`` of hi, as a number from 0 on."""
    return F.shiftrightunsigned("hi", 64 - bits).cast("int") if bits else F.lit(0)


FILTERS = "shard int, n_seen long, seen binary, n_repeated long, repeated binary"


def _filters(counts: DataFrame, bits: int, least_docs: int) -> DataFrame:
    """The filters of all shards of ``counts``; a shard has some SHARD_KEYS keys, dealt by digest."""

    def built(keys: np.ndarray) -> bytes:
        n = len(keys)
        while not (f := CuckooFilter.sized(n)).add(keys):
            n = 2 * max(n, f.table.size)
        return f.blob()

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        lo = part["lo"].to_numpy()
        more = lo[part["n_docs"].to_numpy() >= least_docs]
        return pd.DataFrame({"shard": [key[0]], "n_seen": [len(lo)], "seen": [built(lo)], "n_repeated": [len(more)], "repeated": [built(more)]})

    return counts.select(_shard(bits).alias("shard"), "lo", "n_docs").groupBy("shard").applyInPandas(run, FILTERS)


def _changed(filters: DataFrame, changes: DataFrame) -> DataFrame:
    """``filters`` after ``changes`` (shard, lo, seen, repeated: 1 enters, -1 leaves, 0 stays), with null blobs where a
    filter was too full."""

    def moved(blob: bytes, n: int, keys: np.ndarray, way: np.ndarray) -> tuple[int, bytes | None]:
        f = CuckooFilter.of(blob)
        f.remove(keys[way < 0])
        n -= int((way < 0).sum())
        new = keys[way > 0]
        return n + len(new), f.blob() if f.room(n + len(new)) and f.add(new) else None

    def run(key: tuple, old: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return old
        if not len(old):  # a shard without keys until now
            return pd.DataFrame({"shard": [key[0]], "n_seen": [0], "seen": [None], "n_repeated": [0], "repeated": [None]})
        row, lo = old.iloc[0], part["lo"].to_numpy()
        n_seen, seen = moved(row["seen"], row["n_seen"], lo, part["seen"].to_numpy())
        n_rep, rep = moved(row["repeated"], row["n_repeated"], lo, part["repeated"].to_numpy())
        return pd.DataFrame({"shard": [key[0]], "n_seen": [n_seen], "seen": [seen], "n_repeated": [n_rep], "repeated": [rep]})

    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(run, FILTERS)


def _asked(delta: DataFrame, filters: DataFrame, bits: int) -> DataFrame:
    """``delta`` with ``may``: whether the filter of its shard knows the key."""
    schema = delta.schema.add("may", "boolean")

    def run(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        may = CuckooFilter.of(own.iloc[0]["seen"]).has(part["lo"].to_numpy()) if len(own) and len(part) else np.zeros(len(part), bool)
        return part.drop(columns="shard").assign(may=may)

    return delta.withColumn("shard", _shard(bits)).groupBy("shard").cogroup(filters.select("shard", "seen").groupBy("shard")).applyInPandas(run, schema)


class LineIndex:
    """Reference counts of lines in ``folder``, which all machines must reach. One writer at a time."""

    STATE = "version long, bits int, least_chars int, least_docs int"

    def __init__(self, spark: SparkSession, folder: str, version: int, bits: int, least_chars: int, least_docs: int):
        self.spark, self.folder, self.version, self.bits, self.least_chars, self.least_docs = spark, folder, version, bits, least_chars, least_docs

    @classmethod
    def create(cls, spark: SparkSession, folder: str, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> LineIndex:
        index = cls(spark, folder, 0, 0, least_chars, least_docs)
        for name, columns in index._columns().items():
            spark.createDataFrame([], columns).write.parquet(index._path(name))
        index._commit()
        return index

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineIndex:
        last = spark.read.schema(cls.STATE).parquet(f"{folder}/versions/*").orderBy(F.desc("version")).first()
        return cls(spark, folder, *last)

    @staticmethod
    def _columns() -> dict[str, str]:
        return {"counts": "hi long, lo long, n_docs long, top long", "filters": FILTERS, "postings": "hi long, lo long, doc long, batch long", "dead": "doc long, before long"}

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}/{self.version}"

    def table(self, name: str) -> DataFrame:
        """Counts and filters are those of this version; postings and dead are the batches up to it."""
        if name in ("counts", "filters"):
            return self.spark.read.schema(self._columns()[name]).parquet(self._path(name))
        kept = [f"{self.folder}/{name}/{k}" for k in self._batches(name)]
        return self.spark.read.schema(self._columns()[name]).parquet(*kept)

    def _batches(self, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        found = path.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()).listStatus(path)
        return sorted(k for k in (int(x.getPath().getName()) for x in found) if k <= self.version)

    def _commit(self) -> None:
        row = [(self.version, self.bits, self.least_chars, self.least_docs)]
        self.spark.createDataFrame(row, self.STATE).coalesce(1).write.mode("overwrite").parquet(self._path("versions"))

    def postings(self) -> DataFrame:
        """(hi, lo, doc) of the documents that are there."""
        dead = self.table("dead").groupBy("doc").agg(F.max("before").alias("before"))
        all_of = self.table("postings").join(dead, "doc", "left")
        return all_of.where("before is null or batch >= before").select("hi", "lo", "doc")

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with the documents of (doc, text) that it does not have yet."""
        new = LineIndex(self.spark, self.folder, self.version + 1, self.bits, self.least_chars, self.least_docs)
        rows = _mapped(docs, self.least_chars)
        if self.version:
            rows = rows.join(self.postings().select("doc").distinct(), "doc", "left_anti")
        rows.select("hi", "lo", "doc", F.lit(new.version).cast("long").alias("batch")).write.mode("overwrite").parquet(new._path("postings"))
        batch = self.spark.read.schema(self._columns()["postings"]).parquet(new._path("postings"))
        delta = written(batch.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("doc").alias("top")))
        old = self.table("counts")
        n_old = old.count()
        new._split(n_old + delta.count())
        if not n_old:
            return new._write(delta.select("hi", "lo", F.col("n").alias("n_docs"), "top"), None)
        asked = written(_asked(delta, self.table("filters"), self.bits))
        fresh = asked.where("not may").select("hi", "lo", F.col("n").alias("n_docs"), "top", F.lit(0).cast("long").alias("was"))
        met = old.join(asked.where("may").select("hi", "lo", "n", F.col("top").alias("top2")), ["hi", "lo"], "full")
        was = F.coalesce("n_docs", F.lit(0)).cast("long")
        met = met.select("hi", "lo", (was + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("top", "top2").alias("top"), was.alias("was"))
        return new._write(fresh.unionByName(met), self)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents of (doc); those that it does not have are passed over."""
        new = LineIndex(self.spark, self.folder, self.version + 1, self.bits, self.least_chars, self.least_docs)
        gone = written(self.postings().join(ids.select(F.col("doc").cast("long")).distinct(), "doc", "left_semi"))
        delta = gone.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("doc").alias("last"))
        met = written(self.table("counts").join(delta, ["hi", "lo"], "left"))
        gone.select("doc", F.lit(new.version).cast("long").alias("before")).distinct().write.mode("overwrite").parquet(new._path("dead"))
        stay = met.where("n is null or last < top").select("hi", "lo", (F.col("n_docs") - F.coalesce("n", F.lit(0))).alias("n_docs"), "top", F.col("n_docs").alias("was"))
        # Keys that lost their largest document take the next one from the postings.
        lost = met.where("n is not null and last = top")
        next_top = new.postings().join(lost.select("hi", "lo"), ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.max("doc").alias("top"))
        lost = lost.drop("top").join(next_top, ["hi", "lo"], "left").select("hi", "lo", (F.col("n_docs") - F.col("n")).alias("n_docs"), "top", F.col("n_docs").alias("was"))
        return new._write(stay.unionByName(lost), self)

    def _split(self, n_keys: int) -> None:
        while n_keys > SHARD_KEYS << self.bits:
            self.bits += 1

    def _write(self, rows: DataFrame, before: LineIndex | None) -> LineIndex:
        """Counts and filters of this version, of (hi, lo, n_docs, top, was): the filters of ``before`` changed, or new ones."""
        if before is None or before.bits != self.bits:
            rows.where("n_docs > 0").select("hi", "lo", "n_docs", "top").write.mode("overwrite").parquet(self._path("counts"))
            _filters(self.table("counts"), self.bits, self.least_docs).write.mode("overwrite").parquet(self._path("filters"))
        else:
            rows = written(rows)
            rows.where("n_docs > 0").select("hi", "lo", "n_docs", "top").write.mode("overwrite").parquet(self._path("counts"))
            way = lambda least: (F.col("n_docs") >= least).cast("int") - (F.col("was") >= least).cast("int")
            changes = rows.select(_shard(self.bits).alias("shard"), "lo", way(1).alias("seen"), way(self.least_docs).alias("repeated")).where("seen <> 0 or repeated <> 0")
            made = written(_changed(before.table("filters"), changes))
            full = made.where("seen is null or repeated is null").select("shard")
            anew = _filters(self.table("counts").withColumn("shard", _shard(self.bits)).join(full, "shard", "left_semi"), self.bits, self.least_docs)
            made.where("seen is not null and repeated is not null").unionByName(anew).write.mode("overwrite").parquet(self._path("filters"))
        self._commit()
        return self

    def repeated(self) -> DataFrame:
        """(hi, lo, top) of the keys in ``least_docs`` documents or more."""
        return self.table("counts").where(F.col("n_docs") >= self.least_docs).select("hi", "lo", "top")

    def _gate(self):
        """What tells a task which keys may be repeated, or None if the filters are too large to send."""
        size = self.table("filters").agg(F.coalesce(F.sum(F.length("repeated")), F.lit(0)).alias("n")).first().n
        if size > GATE_BYTES:
            return None
        bits = self.bits
        sent = self.spark.sparkContext.broadcast({r.shard: bytes(r.repeated) for r in self.table("filters").select("shard", "repeated").collect()})

        def opened():
            filters = {k: CuckooFilter.of(x) for k, x in sent.value.items()}

            def known(pairs: np.ndarray) -> np.ndarray:
                shard = (pairs[:, 0].view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(pairs), np.int64)
                out = np.zeros(len(pairs), bool)
                for k in np.unique(shard):
                    if k in filters:
                        m = shard == k
                        out[m] = filters[k].has(pairs[m, 1])
                return out

            return known

        return opened

    def drops(self, docs: DataFrame) -> DataFrame:
        """(doc, keys): for each document of (doc, text) that loses lines the digests of their keys."""
        lines = _mapped(docs, self.least_chars, self._gate())
        # A key in very many documents has many rows on the left and one on the right: AQE splits such a join.
        out = lines.join(self.repeated(), ["hi", "lo"]).where("doc <> top")
        return out.groupBy("doc").agg(F.collect_list(F.struct("hi", "lo")).alias("keys"))

    def deduplicated(self, docs: DataFrame) -> DataFrame:
        """(doc, rest, n_lines, n_dropped) of every row of (doc, text), with unique non-null ``doc``."""
        return _rewritten(docs.select("doc", "text").join(self.drops(docs), "doc", "left"), self.least_chars)


def _rewritten(both: DataFrame, least_chars: int) -> DataFrame:
    def run(batches):
        begins("linedup")
        for batch in batches:
            rest, n_lines, n_dropped = [], [], []
            for text, keys in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                n_lines.append(raw.count(b"\n") + 1)
                n = 0
                if keys:
                    gone = set(np.array([(k["hi"], k["lo"]) for k in keys], ">i8").tobytes()[i : i + 16] for i in range(0, 16 * len(keys), 16))
                    lines = raw.split(b"\n")
                    kept = [x for x, k in zip(lines, line_keys(raw, least_chars)) if k not in gone]
                    n, raw = len(lines) - len(kept), b"\n".join(kept)
                n_dropped.append(n)
                rest.append(raw.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rest, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=schema.names)

    schema = both.select("doc").schema.add("rest", "string").add("n_lines", "long").add("n_dropped", "long")
    return both.select("doc", "text", "keys").mapInArrow(run, schema)


def without_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, rest, n_lines, n_dropped) of every row of ``docs``, by an index that goes when the process ends."""
    spark, own = docs.sparkSession, ordered(docs)
    if own.columns[0] == "doc":
        own = checkpointed(own)  # row numbers: ids that are null or repeat
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    atexit.register(delete, spark, folder)
    index = LineIndex.create(spark, folder, least_chars, least_docs).insert(own)
    out = index.deduplicated(own)
    if own.columns[0] == "doc":
        return out.join(own.select("doc", "doc_id"), "doc").select("doc_id", "rest", "n_lines", "n_dropped")
    return out.select(F.col("doc").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "rest", "n_lines", "n_dropped")


def op11_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("rest", 256).alias("kept_sha256"))


ORACLE = {
    "op11_linedup": """
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    l AS (SELECT doc_id, i, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM d)),
    k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    r AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    b AS (SELECT k.*, r.top IS NOT NULL AND doc_id <> r.top AS gone FROM k LEFT JOIN r ON k.key = r.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM b GROUP BY doc_id"""
}

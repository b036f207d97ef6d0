"""Removal of repeated 100-byte strings by bucket-pointer refinement over sampled suffixes.

Every position gets the identifier of its initial q-gram bucket; a bucket is refined by pairing its identifier with the
bucket identifier at a later offset, and each refinement is reused by the next: identifiers for 2, 4, 8, 16, 32, 51 and
100 bytes come from two of the level before. Identifiers are 64-bit names of content, so they agree between machines
without a global sort. Of the 51-gram buckets only *anchors* are kept: the position with the least identifier in each
100-byte window (the leftmost on a tie), so equal windows have equal anchors at equal offsets. An anchor owns the run
of windows that chose it.

1. Map: anchors of each text with bucket (51-gram) and class (identifiers of the whole stretch that it owns). Within a
   task all but the first of a class are found repeated at once, so a class sends one row from each task at most.
2. Buckets are sorted by class and place: all but the first of a class are repeated. A bucket with one class is done; the
   firsts of others go on, as their stretches may agree in part.
3. With the texts, these stretches are cut out; bucket by bucket their 100-byte identifiers are sorted, and all but the
   first of each are repeated. Buckets with very many classes are dealt out by bucket and window identifier instead.
4. Repeated windows are united for each document, and the bytes outside them are kept.

Odd input: a null text is empty; texts under 100 bytes lose nothing; the order of documents is that of their ids, and
rows with null or repeated ids are ordered by id, then text. Every window of every text takes part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import chunks, ordered

SPAN = 100
GRAM = 51
WINDOWS = SPAN - GRAM + 1
#: Rows of a bucket in one task's texts, and classes of a bucket in all, from which it is dealt out by window.
WIDE_HERE, WIDE = 200, 5000
LOW = np.uint64(0xFFFFFFFF)
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_BYTE = np.frombuffer(hashlib.shake_256(b"initial buckets").digest(2048), "<u8").copy()


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The refined bucket: a bucket and the one at a later offset."""
    x = b >> np.uint64(29)
    x ^= b
    x *= _K2
    x += a * _K1
    x ^= x >> np.uint64(32)
    return x


def identifiers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """51-byte and 100-byte bucket identifiers of each position that has so many bytes after it."""
    x = _BYTE[data]
    for step in (1, 2, 4, 8, 16):
        x = _pair(x[:-step], x[step:])
    gram = _pair(x[: len(data) - GRAM + 1], x[GRAM - 32 :])
    return gram, _pair(gram[: len(data) - SPAN + 1], gram[SPAN - GRAM :])


def anchors(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of the owned runs of all texts: text index, bucket, class, first window and number of windows."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8)
    if not len(sizes) or sizes.max() < SPAN:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    offs = np.cumsum(sizes) - sizes
    gram, whole = identifiers(data)
    least = (gram & ~LOW) | np.arange(len(gram), dtype=np.uint64)
    for step in (1, 2, 4, 8, 16):
        least = np.minimum(least[:-step], least[step:])
    least = np.minimum(least[: len(whole)], least[WINDOWS - 32 :])
    pick = (least & LOW).astype(np.int64)
    edge = np.zeros(len(data) + 1, np.int32)
    long = sizes >= SPAN
    np.add.at(edge, offs[long], 1)
    np.add.at(edge, offs[long] + sizes[long] - SPAN + 1, -1)
    at = np.flatnonzero(np.cumsum(edge)[: len(whole)] > 0)
    pick = pick[at]
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = (pick[1:] != pick[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    a, b, p = at[first], at[last], pick[first]
    doc = np.searchsorted(offs, a, side="right") - 1
    kind = _pair(_pair(whole[a], whole[b]), ((p - a) * 64 + (b - a)).astype(np.uint64) * _K3)
    return doc, gram[p], kind, a - offs[doc], b - a + 1


def merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Touching spans of a document as one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    _, group = np.unique(doc, return_inverse=True)
    big = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * big) - group * big
    new = np.ones(len(doc), bool)
    new[1:] = (group[1:] != group[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return doc[first], start[first], reach[np.append(first[1:], len(doc)) - 1]


def _later(doc: np.ndarray, s: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys, doc and s, and whether each row in that order has an earlier one of equal keys."""
    order = np.lexsort((s, doc, *reversed(keys)))
    same = np.ones(len(order), bool)
    for k in keys:
        k = k[order]
        same[1:] &= k[1:] == k[:-1]
    same[:1] = False
    return order, same


_ANCHOR = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("s", "<i4"), ("n", "u1"), ("wide", "u1")])
MAPPED = "dest int, doc long, s int, e int, blob binary"


def _mapper(n_dest: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for i, j in chunks(texts, 1_200_000):
                doc, h, c, s, n = anchors([(t or "").encode("utf-8", "surrogatepass") for t in texts[i:j]])
                if not len(doc):
                    continue
                doc = ids[i:j].astype(np.int64)[doc]
                order, again = _later(doc, s, h, c)
                doc, h, c, s, n = doc[order], h[order], c[order], s[order], n[order]
                span = merge(doc[again], s[again], (s + n - 1 + SPAN)[again])
                rows = [pa.array((span[0] & 0xFFFF) % n_dest, pa.int32()), pa.array(span[0], pa.int64()), pa.array(span[1], pa.int32()), pa.array(span[2], pa.int32()), pa.nulls(len(span[0]), pa.binary())]
                if len(span[0]):
                    yield pa.RecordBatch.from_arrays(rows, names=["dest", "doc", "s", "e", "blob"])
                keep = ~again
                out = np.zeros(int(keep.sum()), _ANCHOR)
                for name, v in zip(("h", "c", "doc", "s", "n"), (h, c, doc, s, n)):
                    out[name] = v[keep]
                _, at, many = np.unique(out["h"], return_inverse=True, return_counts=True)
                out["wide"] = many[at] >= WIDE_HERE
                marks = np.unique(out["h"][out["wide"] == 1])
                dest = (np.where(out["wide"] == 1, out["c"], out["h"]) % np.uint64(n_dest)).astype(np.int32)
                mark = np.zeros(len(marks), _ANCHOR)
                mark["h"] = marks  # n = 0: this bucket is wide somewhere
                out, dest = np.concatenate([out, mark]), np.concatenate([dest, (marks % np.uint64(n_dest)).astype(np.int32)])
                order = np.lexsort((out["s"], out["doc"], dest))
                out, dest = out[order], dest[order]
                cuts = np.flatnonzero(np.append(True, dest[1:] != dest[:-1]))
                blobs = []
                for a, b in zip(cuts, np.append(cuts[1:], len(dest))):
                    part = out[a:b]  # by column, so that Spark's compression sees like values together
                    blobs.append(b"".join(np.ascontiguousarray(part[k]).tobytes() for k in _ANCHOR.names))
                zero = pa.nulls(len(blobs), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(dest[cuts]), pa.nulls(len(blobs), pa.int64()), zero, zero, pa.array(blobs, pa.binary())], names=["dest", "doc", "s", "e", "blob"])

    return run


def _unblob(blob: bytes) -> np.ndarray:
    n = len(blob) // _ANCHOR.itemsize
    out, at = np.empty(n, _ANCHOR), 0
    for k in _ANCHOR.names:
        kind = _ANCHOR[k]
        out[k] = np.frombuffer(blob, kind, n, at)
        at += n * kind.itemsize
    return out


#: kind 0: bytes [s, e) are repeated; 1 and 2: windows s to e - SPAN are to be compared within their bucket, 2 by window.
FOUND = "doc long, kind int, s int, e int, h long"


def _found(doc, kind, s, e, h):
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(kind, pa.int32()), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(h.view(np.int64), pa.int64())], names=["doc", "kind", "s", "e", "h"])


def _buckets(batches):
    parts = []
    for batch in batches:
        spans = batch.filter(batch.column(4).is_null())
        if spans.num_rows:
            zero = np.zeros(spans.num_rows, np.uint64)
            yield _found(spans.column(1), zero, spans.column(2), spans.column(3), zero)
        parts += [_unblob(x) for x in batch.column(4).to_pylist() if x is not None]
    if not parts:
        return
    rows = np.concatenate(parts)
    parts.clear()
    wide = np.unique(rows["h"][rows["n"] == 0])
    rows = rows[rows["n"] > 0]
    order, again = _later(rows["doc"], rows["s"], rows["h"], rows["c"])
    rows = rows[order]
    end = rows["s"].astype(np.int64) + rows["n"] - 1 + SPAN
    doc, s, e = merge(rows["doc"][again], rows["s"][again].astype(np.int64), end[again])
    zero = np.zeros(len(doc), np.uint64)
    yield _found(doc, zero, s, e, zero)
    rows, end = rows[~again], end[~again]
    _, at, many = np.unique(rows["h"], return_inverse=True, return_counts=True)
    kind = (many[at] > 1).astype(np.int32)
    kind[(rows["wide"] == 1) | np.isin(rows["h"], wide) | (many[at] >= WIDE)] = 2
    go = kind > 0
    if go.any():
        yield _found(rows["doc"][go], kind[go], rows["s"][go], end[go], rows["h"][go])


#: kind 0: a span, dealt by document; 1: the bytes of a stretch, dealt by bucket; 2: a window, dealt by bucket and window.
CUT = "dest int, kind int, h long, w long, doc long, s int, e int, data binary"


def _cutter(n_dest: int):
    def run(batches):
        for batch in batches:
            cols = {k: [] for k in ("dest", "kind", "h", "w", "doc", "s", "e", "data")}

            def put(dest, kind, h, w, doc, s, e, data):
                for k, v in zip(cols, (dest, kind, h, w, doc, s, e, data)):
                    cols[k] += v

            for doc, text, rows in zip(*(c.to_pylist() for c in batch.columns)):
                kinds = np.fromiter((r["kind"] for r in rows), np.int64, len(rows))
                s, e = np.fromiter((r["s"] for r in rows), np.int64, len(rows)), np.fromiter((r["e"] for r in rows), np.int64, len(rows))
                _, a, b = merge(np.zeros(int((kinds == 0).sum()), np.int64), s[kinds == 0], e[kinds == 0])
                n = len(a)
                put([doc % n_dest if doc is not None else 0] * n, [0] * n, [0] * n, [0] * n, [doc] * n, a.tolist(), b.tolist(), [None] * n)
                if not (kinds > 0).any():
                    continue
                raw = (text or "").encode("utf-8", "surrogatepass")
                for i in np.flatnonzero(kinds > 0).tolist():
                    h, x, y = rows[i]["h"], int(s[i]), int(e[i])
                    if kinds[i] == 1:
                        put([h % n_dest], [1], [h], [0], [doc], [x], [y], [raw[x:y]])
                    else:
                        w = identifiers(np.frombuffer(raw, np.uint8)[x:y])[1].view(np.int64)
                        n = len(w)
                        put(((w ^ h) % n_dest).tolist(), [2] * n, [h] * n, w.tolist(), [doc] * n, list(range(x, x + n)), [0] * n, [None] * n)
            if cols["dest"]:
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols.values(), kinds)], names=list(cols))

    return run


def _windows(batches):
    hs, ws, docs, ss = [], [], [], []
    out = lambda d, s, e: pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["doc", "s", "e"])
    for batch in batches:
        kind = batch.column(1).to_numpy()
        spans = batch.filter(pa.array(kind == 0))
        if spans.num_rows:
            yield out(spans.column(4), spans.column(5), spans.column(6))
        one = batch.filter(pa.array(kind == 2))
        if one.num_rows:
            hs.append(one.column(2).to_numpy())
            ws.append(one.column(3).to_numpy())
            docs.append(one.column(4).to_numpy())
            ss.append(one.column(5).to_numpy().astype(np.int64))
        cut = batch.filter(pa.array(kind == 1))
        if cut.num_rows:
            data = cut.column(7).to_pylist()
            size = np.fromiter(map(len, data), np.int64, len(data))
            _, w = identifiers(np.frombuffer(b"".join(data), np.uint8))
            n = size - SPAN + 1
            owner = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            at = (np.cumsum(size) - size)[owner] + nth
            hs.append(cut.column(2).to_numpy()[owner])
            ws.append(w[at].view(np.int64))
            docs.append(cut.column(4).to_numpy()[owner])
            ss.append(cut.column(5).to_numpy().astype(np.int64)[owner] + nth)
    if hs:
        doc, s, h, w = map(np.concatenate, (docs, ss, hs, ws))
        order, again = _later(doc, s, h, w)
        doc, s = doc[order][again], s[order][again]
        yield out(*merge(doc, s, s + SPAN))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, spans): for each document of (doc, text) with repeated 100-byte strings, spans array<struct<s,e>> of bytes.

    ``doc`` is a unique long that orders the documents.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_dest = 4 * n
    sent = docs.select("doc", "text").mapInArrow(_mapper(n_dest), MAPPED).repartition(n, "dest")
    found = sent.mapInArrow(_buckets, FOUND).groupBy("doc").agg(F.collect_list(F.struct("kind", "s", "e", "h")).alias("rows"))
    with_text = found.join(docs.select("doc", "text"), "doc", "left").select("doc", "text", "rows")
    cut = with_text.mapInArrow(_cutter(n_dest), CUT).repartition(n, "dest")
    return cut.mapInArrow(_windows, "doc long, s int, e int").groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _kept(batches):
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            if not spans:
                out.append((raw, len(raw), 0, 0))
                continue
            s, e = np.fromiter((x["s"] for x in spans), np.int64, len(spans)), np.fromiter((x["e"] for x in spans), np.int64, len(spans))
            _, a, b = merge(np.zeros(len(s), np.int64), s, e)
            bounds = zip([0, *b.tolist()], [*a.tolist(), len(raw)])
            out.append((b"".join(raw[x:y] for x, y in bounds), len(raw), int((b - a).sum()), len(a)))
        if out:
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=["doc_id", "rest", "n_bytes", "n_removed", "n_spans"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, rest, n_bytes, n_removed, n_spans) of every row: the bytes that are left, and what went."""
    own = ordered(docs)
    plain = own.columns[-1] == "doc"  # the ids are their own order: both joins then read one exchange of (doc, text)
    kind = docs.schema["doc_id"].dataType
    own = own.select("doc", "text").where("doc is not null") if plain else own.select("doc", "text", "doc_id")
    spans = repeated_spans(own)
    both = own.join(spans, "doc", "left").select(F.col("doc").cast(kind).alias("doc_id") if plain else "doc_id", "text", "spans")
    return both.mapInArrow(_kept, both.select("doc_id").schema.add("rest", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long"))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("rest", 256).alias("kept_sha256"))

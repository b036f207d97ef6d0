"""ISO base media files: write raw 8-bit tracks, walk boxes and decode sample tables without decoding payloads.

``probe`` reads any file of nested boxes (32- and 64-bit sizes, ``stco``/``co64``, ``stsz``/``stz2``, several tracks)
and returns codec, timescale, duration and the byte ranges of keyframes; a track without ``stss`` has only keyframes.
Broken files give what could be read and an ``error``; a null or empty value gives no track and the error ``no data``.
Counts of a table are held against the bytes of its box, and samples against the bytes of the file, before anything is
made of them, so a file that claims more than it has costs no more than its length; constant sizes stay one number.

Odd input: a null text is empty and is stored as blanks; equal texts, repeated rows among them, give equal files; there
are no ties; an empty table gives an empty result; columns other than ``keep`` and the value's are not read, whatever
their names; a very long text is one value and is held in one task some three times over.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = 192  #: bytes of a stored sample; payloads are padded with blanks to a multiple of it
RATE = 8000  #: samples a second, mono, 8 bits
FRAMES_PER_CHUNK = 64
KEY_EVERY = 16  #: each of these frames is marked as a keyframe

CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0, version: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes) -> bytes:
    return data + b" " * (-len(data) % FRAME or (FRAME if not data else 0))


def mux(payload: bytes) -> bytes:
    """A file with one raw audio track that holds ``payload``, a positive multiple of FRAME bytes."""
    n = len(payload) // FRAME
    n_chunks = -(-n // FRAMES_PER_CHUNK)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    length = n * FRAME
    last = n - (n_chunks - 1) * FRAMES_PER_CHUNK
    runs = [(1, FRAMES_PER_CHUNK, 1)] if last == FRAMES_PER_CHUNK else [(1, last, 1)] if n_chunks == 1 else [(1, FRAMES_PER_CHUNK, 1), (n_chunks, last, 1)]
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")

    def moov(first: int) -> bytes:
        at = first + np.arange(n_chunks, dtype=np.int64) * FRAMES_PER_CHUNK * FRAME
        wide = first + len(payload) >= 2**32
        offsets = _full(b"co64" if wide else b"stco", struct.pack(">I", n_chunks), at.astype(">u8" if wide else ">u4").tobytes())
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, FRAME)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            offsets,
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, length & 0xFFFFFFFF, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"raw\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIIIQHHHH", 0, 0, 1, 0, length & 0xFFFFFFFF, 0, 0, 0, 0x100, 0), matrix, bytes(8), flags=3)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, length & 0xFFFFFFFF, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    start = len(head) + len(moov(0)) + (8 if len(payload) < 2**32 - 8 else 16)
    return head + moov(start) + _box(b"mdat", payload)


def boxes(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """(path, start of the body, end) of every box, containers before what they hold; without recursion."""
    todo = [(start, len(data) if end is None else end, path)]
    while todo:
        at, stop, up = todo.pop()
        while at + 8 <= stop:
            size, kind = struct.unpack_from(">I4s", data, at)
            body = at + 8
            if size == 1:
                if at + 16 > stop:
                    raise ValueError("cut box")
                size = struct.unpack_from(">Q", data, at + 8)[0]
                body = at + 16
            elif size == 0:
                size = stop - at
            if size < body - at or at + size > stop:
                raise ValueError(f"bad size of box {kind!r}")
            yield (*up, kind), body, at + size
            if kind in CONTAINERS:
                todo.append((at + size, stop, up))
                at, stop, up = body, at + size, (*up, kind)
                continue
            at += size


def _ints(data: memoryview, at: int, n: int, kind: str = ">u4") -> np.ndarray:
    width = np.dtype(kind).itemsize
    if at + n * width > len(data):
        raise ValueError("cut table")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


class Track:
    codec, timescale, duration, handler = "", 0, 0, ""
    n_samples = same = 0  # same: the size of all samples where it is one
    sizes = None
    first = per = chunk_at = None
    keys = None
    ticks = 0

    def _runs(self) -> tuple[np.ndarray, np.ndarray]:
        """The samples of each chunk and the number of samples before it; as many chunks as hold samples."""
        many = np.diff(np.append(self.first, len(self.chunk_at) + 1))
        if (many < 0).any() or self.first[0] != 1:
            raise ValueError("bad stsc")
        per = np.minimum(np.repeat(self.per, many), self.n_samples)  # a row for each chunk offset that the file holds
        before = np.cumsum(per) - per
        return per, before

    def ranges(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and size of the samples ``pick``, from the chunk offsets, the samples of a chunk and the sample sizes."""
        if not self.n_samples or self.chunk_at is None or self.first is None or not len(self.first) or not len(pick):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        per, before = self._runs()
        if not len(per) or before[-1] + per[-1] < self.n_samples:
            raise ValueError("samples without a chunk")
        chunk = np.searchsorted(before, pick, side="right") - 1
        if self.sizes is None:
            return self.chunk_at[chunk] + (pick - before[chunk]) * self.same, np.full(len(pick), self.same, np.int64)
        upto = np.append(0, np.cumsum(self.sizes))
        return self.chunk_at[chunk] + upto[pick] - upto[before[chunk]], self.sizes[pick]

    def keyframes(self) -> list[tuple[int, int]]:
        pick = np.arange(self.n_samples) if self.keys is None else self.keys - 1
        at, size = self.ranges(pick[(pick >= 0) & (pick < self.n_samples)])
        return list(zip(at.tolist(), size.tolist()))

    def chunks(self) -> list[tuple[int, int]]:
        """Offset and length of the stored bytes of each chunk with samples, in order."""
        if not self.n_samples or self.chunk_at is None or self.first is None or not len(self.first):
            return []
        per, before = self._runs()
        if not len(per) or before[-1] + per[-1] < self.n_samples:
            raise ValueError("samples without a chunk")
        last = np.minimum(before + per, self.n_samples)
        before = np.minimum(before, self.n_samples)
        upto = np.append(0, np.cumsum(self.sizes)) if self.sizes is not None else None
        size = (last - before) * self.same if upto is None else upto[last] - upto[before]
        return [(a, n) for a, n in zip(self.chunk_at.tolist(), size.tolist()) if n]


def probe(data: bytes | None) -> tuple[list[Track], str | None]:
    """The tracks of a file, and what was wrong with it. Payload bytes are not read."""
    tracks: list[Track] = []
    if not data:
        return tracks, "no data"
    view = memoryview(data)
    try:
        for path, a, b in boxes(view):
            kind = path[-1]
            if kind == b"trak":
                tracks.append(Track())
            if not tracks or b"trak" not in path:
                continue
            t = tracks[-1]

            def _table(n: int, kind: str = ">u4", at: int = a + 8, end: int = b) -> np.ndarray:
                return _ints(view[:end], at, n, kind)

            if kind == b"mdhd":
                wide = view[a] == 1
                t.timescale, t.duration = struct.unpack_from(">IQ" if wide else ">II", view, a + (20 if wide else 12))
            elif kind == b"hdlr":
                t.handler = bytes(view[a + 8 : a + 12]).decode("latin-1")
            elif kind == b"stsd" and b - a >= 16:
                t.codec = bytes(view[a + 12 : a + 16]).decode("latin-1")
            elif kind == b"stts":
                pairs = _table(2 * struct.unpack_from(">I", view, a + 4)[0])
                t.ticks = int((pairs[::2] * pairs[1::2]).sum())
            elif kind == b"stsz":
                same, n = struct.unpack_from(">II", view, a + 4)
                if same and n * same > len(view):
                    raise ValueError("samples without bytes")
                t.n_samples, t.same, t.sizes = n, same, None if same else _table(n, at=a + 12)
            elif kind == b"stz2":
                width, n = view[a + 7], struct.unpack_from(">I", view, a + 8)[0]
                if width == 4:
                    raw = _table((n + 1) // 2, ">u1", a + 12)
                    t.sizes = np.stack([raw >> 4, raw & 15], 1).ravel()[:n]
                else:
                    t.sizes = _table(n, {8: ">u1", 16: ">u2"}[width], a + 12)
                t.n_samples = n
            elif kind == b"stsc":
                rows = _table(3 * struct.unpack_from(">I", view, a + 4)[0])
                t.first, t.per = rows[::3], rows[1::3]
            elif kind == b"stss":
                t.keys = _table(struct.unpack_from(">I", view, a + 4)[0])
            elif kind in (b"stco", b"co64"):
                t.chunk_at = _table(struct.unpack_from(">I", view, a + 4)[0], ">u4" if kind == b"stco" else ">u8")
    except (ValueError, struct.error, KeyError, IndexError) as e:
        return tracks, str(e) or "broken"
    return tracks, None if tracks else "no track"


def payload(data: bytes, track: Track) -> bytes:
    """The stored bytes of a track, read through its sample tables."""
    return b"".join(data[at : at + size] for at, size in track.chunks())


PROBE_SCHEMA = "track int, handler string, codec string, timescale long, duration long, n_samples long, keyframes array<struct<offset:long,length:long>>, error string"


def _described(data: bytes | None) -> list[dict]:
    tracks, error = probe(data)
    rows = []
    for i, t in enumerate(tracks):
        try:
            keys, problem = t.keyframes(), error
        except ValueError as e:
            keys, problem = [], str(e)
        rows.append({"track": i, "handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration or t.ticks, "n_samples": t.n_samples, "keyframes": [{"offset": a, "length": b} for a, b in keys], "error": problem})
    return rows or [{"track": None, "handler": None, "codec": None, "timescale": None, "duration": None, "n_samples": None, "keyframes": [], "error": error}]


def media_columns(df: DataFrame, media_col: str, keep: tuple[str, ...]) -> DataFrame:
    """One row for each track of each file of ``media_col``: the ``keep`` columns and PROBE_SCHEMA."""
    own = df.select(*keep, F.col(media_col).alias("_media"))
    schema = own.drop("_media").schema
    for f in df.sparkSession.createDataFrame([], PROBE_SCHEMA).schema:
        schema = schema.add(f)

    def run(batches):
        for batch in batches:
            rows, at = [], []
            for i, data in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                own_rows = _described(data)
                rows += own_rows
                at += [i] * len(own_rows)
            if rows:
                kept = [c.take(pa.array(at)) for c in batch.columns[:-1]]
                key = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
                kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), key, pa.string()]
                yield pa.RecordBatch.from_arrays(kept + [pa.array([r[f.name] for r in rows], k) for f, k in zip(schema.fields[len(kept) :], kinds)], names=schema.names)

    return own.mapInArrow(run, schema)


def stored_text(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes (of the text as UTF-8; null: 0) and media: the padded text as a file of 8-bit samples."""
    own = df.select(*keep, F.col(text_col).alias("_text"))
    schema = own.drop("_text").withColumns({"n_bytes": F.lit(0).cast("long"), "media": F.lit(b"")}).schema

    def run(batches):
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(map(len, raw), pa.int64()), pa.array((mux(pad(x)) for x in raw), pa.binary())], names=schema.names)

    return own.mapInArrow(run, schema)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digests(batches):
    for batch in batches:
        out = []
        for data in batch.column(2).to_pylist():
            (track,), error = probe(data)
            if error:
                raise ValueError(error)
            back = payload(data, track)
            keys = ",".join(f"{a}+{n}" for a, n in track.keyframes())
            out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), f"codec={track.codec.strip()};timescale={track.timescale};duration={track.ticks};samples={track.n_samples};keyframes={keys}"))
        if out:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=[f.split()[0] for f in DIGESTS.split(", ")])


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return stored_text(docs.select("doc_id", "text")).mapInArrow(_digests, DIGESTS)

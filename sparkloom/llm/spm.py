"""SentencePiece encoding, decoding, and sampled segmentations without replacement.

The model file's pieces span a lattice over each text. ``encode`` gives the model's own segmentation; ``sample`` gives k
distinct others by Gumbel top-k: a best-first (A*) search whose nodes are sets of segmentations that share a prefix,
each with the exact maximum of its members' Gumbel-perturbed log probabilities as its bound. Taking a node reaches the
member that attains the bound; what is left of the node is split at each later step into sets of their own, whose bounds
are Gumbel draws cut off at the bound above. The k-th segmentation thus is the k-th largest over the whole lattice, without
listing it. Each sample carries its log probability, its perturbed score and the probability of being among the first k
given the next bound (1 where the lattice has no more).

No piece crosses the start of a run of blanks, so lattices are built once for each distinct word of a task and walked
for all words at once. Draws are hashes of (seed, row key, sample, word, step): they don't depend on partitions. Piece
probabilities follow a fixed rule of the file, 1 / (rank + RANK_SHIFT); characters without a piece fall back to bytes.

Odd input: a null or empty text has no pieces and one empty sample; rows with equal keys and texts get equal samples;
a literal U+2581 is written as bytes in samples (the model's own encoding turns it into a blank).
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import begins, chunks

SAMPLES = 2
SEED = 20240607
RANK_SHIFT = 10
#: Log probability of a byte that has no piece.
BYTE_COST = -14.0
#: Lattice positions that a task keeps for words that come again; 0.3 times as many characters are looked at together.
HELD = 2_500_000
WORDS = re.compile(r" +[^ ]*")
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
MASK = 2**64 - 1


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((_mix(x) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def row_key(key, seed: int) -> np.uint64:
    if isinstance(key, int):
        value = key & 0xFFFFFFFFFFFFFFFF
    else:
        import hashlib

        value = int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "little")
    return _mix(np.array([value ^ (seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)], np.uint64))[0]


class Lattices:
    """The pieces of a model and the lattices of the words met so far."""

    def __init__(self, path: str):
        import sentencepiece

        self.held = HELD
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        ranked: list[tuple[str, int, float]] = []
        for i in range(n):
            piece = self.sp.id_to_piece(i)
            if self.sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
                continue
            if self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i):
                self.bytes_of.append(b"")
                continue
            text = piece.replace("▁", " ")
            self.bytes_of.append(text.encode())
            if not re.search("[^ ] ", text):  # it would cross the start of a word
                ranked.append((text, i, -self.sp.get_score(i)))
        self.longest = max(len(text) for text, _, _ in ranked)
        norm = np.log(sum(1 / (r + RANK_SHIFT) for _, _, r in ranked))
        lens = np.fromiter((len(text) for text, _, _ in ranked), np.int64, len(ranked))
        cp = np.frombuffer("".join(text for text, _, _ in ranked).encode("utf-32-le", "surrogatepass"), np.uint32)
        first, h = np.cumsum(lens) - lens, np.zeros(len(ranked), np.uint64)
        names = []
        for k in range(self.longest):
            alive = np.flatnonzero(lens > k)
            h[alive] = self._step(h[alive], cp[first[alive] + k])
            names.append(h[alive])
        self.node = np.unique(np.concatenate(names))
        self.piece, self.logp = np.full(len(self.node), -1), np.zeros(len(self.node))
        at = np.searchsorted(self.node, h)
        self.piece[at] = [i for _, i, _ in ranked]
        self.logp[at] = [-np.log(rank + RANK_SHIFT) - norm for _, _, rank in ranked]
        slots = [-1] * (1 << 20)
        for i, x in enumerate(self.node.tolist()):
            at = x & 0xFFFFF
            while slots[at] >= 0:
                at = (at + 1) & 0xFFFFF
            slots[at] = i
        self.slots = np.array(slots, np.int32)
        self.text = np.empty(n, object)
        self.text[:] = self.bytes_of
        self._held: dict[str, np.ndarray] = {}
        self.clear()

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The node of each prefix name, -1 where there is none."""
        at = (h & np.uint64(0xFFFFF)).astype(np.int64)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.node[out] != h))
        while len(open_):
            at[open_] = (at[open_] + 1) & 0xFFFFF
            out[open_] = self.slots[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.node[out[open_]] != h[open_])]
        return out

    @staticmethod
    def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return _mix(h * _M3 + c.astype(np.uint64) + np.uint64(1))

    def clear(self) -> None:
        self.words: defaultdict[str, int] = defaultdict(count().__next__)  # a new word gets the next number
        # Of a word: its first position, the one after its last, and the bounds of the model's own ids.
        self.first, self.last, self.bounds = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64)
        # Of an edge, in order of position: position, target, piece, log probability, position + cumulative probability,
        # log of what the position's other edges have, whether it is the only edge of its position, whether it ends its word.
        # Arrays stay, as growing them anew costs more than filling them.
        self._used: dict[str, int] = {}
        for name, kind in (("at", np.int32), ("to", np.int32), ("id", np.int32), ("log", np.float64), ("upto", np.float64), ("rest", np.float64), ("sole", np.bool_), ("closes", np.bool_), ("head", np.int32), ("own", np.int32)):
            self._held.setdefault(name, np.empty(1024, kind))
            self._used[name] = 0
            setattr(self, name, self._held[name][:0])
        self.size = 0

    def _append(self, name: str, values: np.ndarray) -> None:
        used, held = self._used[name], self._held[name]
        if used + len(values) > len(held):
            held = np.empty((used + len(values)) * 5 // 4, held.dtype)
            held[:used] = self._held[name][:used]
            self._held[name] = held
        held[used : used + len(values)] = values
        self._used[name] = used + len(values)
        setattr(self, name, held[: used + len(values)])

    def add(self, words: list[str]) -> None:
        """Lattices of new words, all at once, in the order of their numbers."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(lens + 1) - lens - 1  # positions of a word: its characters and its end
        pos = np.arange(len(cp)) + np.repeat(np.arange(len(words)), lens)
        left = np.repeat(np.cumsum(lens), lens) - np.arange(len(cp))  # characters from here to the word's end
        alive, h = np.arange(len(cp)), np.zeros(len(cp), np.uint64)
        src, length, ids, logs = [], [], [], []
        single = np.zeros(len(cp), bool)
        k = 0
        while len(alive):
            h = self._step(h, cp[alive + k])
            i = self._find(h)
            ok = i >= 0
            alive, h, i = alive[ok], h[ok], i[ok]
            k += 1
            piece = self.piece[i] >= 0
            src.append(alive[piece])
            length.append(np.full(int(piece.sum()), k))
            ids.append(self.piece[i][piece])
            logs.append(self.logp[i][piece])
            if k == 1:
                single[alive[piece]] = True
            more = left[alive] > k
            alive, h = alive[more], h[more]
        bare = np.flatnonzero(~single)
        c = cp[bare].astype(np.int64)
        src.append(bare)
        length.append(np.ones(len(bare), np.int64))
        ids.append(np.where(c < 0x80, np.array(self.byte_id)[np.minimum(c, 255)], -c - 1))
        logs.append(BYTE_COST * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)))
        # Edges by position, shorter pieces first: each list has one edge of a position at most.
        heads = np.bincount(np.concatenate(src), minlength=len(cp))
        free = np.cumsum(heads) - heads
        src, place = src[-1:] + src[:-1], []  # the last list has pieces of one character, as the first
        length, ids, logs = ([x[-1], *x[:-1]] for x in (length, ids, logs))
        for x in src:
            place.append(free[x])
            free[x] += 1
        spot = np.concatenate(place)
        by = np.empty(len(spot), np.int64)
        by[spot] = np.arange(len(spot))
        src, length, ids, logs = (np.concatenate(x)[by] for x in (src, length, ids, logs))
        at, to = pos[src], pos[src] + length
        every = at, to, ids, logs
        rest = left[src]
        order = np.argsort(rest.astype(np.uint16) if len(rest) and rest.max() < 1 << 16 else rest, kind="stable")
        at, to, logs, rest = at[order], to[order], logs[order], rest[order]
        total = np.zeros(int((lens + 1).sum()))  # log of the mass of all ways from a position to its word's end
        levels = np.flatnonzero(np.append(True, rest[1:] != rest[:-1]))
        for a, b in zip(levels, np.append(levels[1:], len(rest))):
            v = logs[a:b] + total[to[a:b]]
            new = np.flatnonzero(np.append(True, at[a + 1 : b] != at[a : b - 1]))
            top = np.maximum.reduceat(v, new)
            many = np.diff(np.append(new, b - a))
            total[at[a + new]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, many)), new))
        last = np.cumsum(heads)
        turned = np.repeat(2 * last - heads - 1, heads) - np.arange(len(by))  # the longest piece first: it mostly is the likeliest
        at, to, ids, logs = (x[turned] for x in every)
        log = np.minimum(logs + total[to] - total[at], 0.0)
        p = np.exp(log)
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        many = np.diff(np.append(new, len(at)))
        run = np.cumsum(p)
        run -= np.repeat(run[new] - p[new], many)
        run /= np.repeat(run[new + many - 1], many)
        run[new + many - 1] = 1.0
        ends = np.zeros(len(total), bool)
        ends[first + lens] = True
        base = self.size
        with np.errstate(divide="ignore"):
            rest = np.log(np.where(np.repeat(many == 1, many), 0.0, np.maximum(1 - p, 0.0)))  # no other edge: nothing is left
        self.first = np.append(self.first, first + base)
        self.last = np.append(self.last, first + lens + base)
        head = np.zeros(len(total), np.int64)
        head[at[new]] = new + len(self.at)
        for name, v in (("at", at + base), ("to", to + base), ("id", ids), ("log", log), ("upto", at + base + run), ("rest", rest), ("sole", np.repeat(many == 1, many)), ("closes", ends[to]), ("head", head)):
            self._append(name, v)
        self.size = base + len(total)
        own = self.sp.encode([w[1:] for w in words], num_threads=1)
        if " " in words:  # a blank at the end of a text; alone it would be an empty text
            own[words.index(" ")] = [self.sp.piece_to_id("▁")]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        self._append("own", np.fromiter(chain.from_iterable(own), np.int64, int(sizes.sum())))
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(sizes))

    def indices(self, texts: list[str]) -> list[np.ndarray]:
        """The words of each text, as numbers of known lattices."""
        if self.size > self.held:
            self.clear()
        split = [WORDS.findall(" " + t) if t else [] for t in texts]
        n = len(self.words)
        out = [np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)) for words in split]
        if new := list(islice(self.words, n, None)):
            self.add(new)
        return out

    def own_ids(self, words: np.ndarray) -> np.ndarray:
        return self.own[_ranges(self.bounds[words], self.bounds[words + 1])].astype(np.int64)

    def walk(self, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges drawn from each start to its end, walk by walk, and the number of edges of each walk."""
        live, at = np.flatnonzero(start < end), start.copy()
        steps, who = [], []
        t = 0
        while len(live):
            goal = at[live] + _uniform(key[live] + np.uint64(t * int(_M1) & MASK))
            e = self.head[at[live]]
            late = np.flatnonzero(self.upto[e] <= goal)
            while len(late):
                e[late] += 1
                late = late[self.upto[e[late]] <= goal[late]]
            steps.append(e)
            who.append(live)
            at[live] = self.to[e]
            live = live[at[live] < end[live]]
            t += 1
        if not steps:
            return np.empty(0, np.int64), np.zeros(len(start), np.int64)
        many = np.bincount(np.concatenate(who), minlength=len(start))
        first = np.cumsum(many) - many
        out = np.empty(int(many.sum()), np.int64)
        for t, (e, live) in enumerate(zip(steps, who)):
            out[first[live] + t] = e
        return out, many

    def ids(self, edges: np.ndarray) -> np.ndarray:
        out = self.id[edges].astype(np.int64)
        bare = np.flatnonzero(out < 0)
        if len(bare):
            parts = [[self.byte_id[b] for b in chr(-x - 1).encode("utf-8", "surrogatepass")] for x in out[bare].tolist()]
            sizes = np.ones(len(out), np.int64)
            sizes[bare] = list(map(len, parts))
            first = np.cumsum(sizes) - sizes
            out = np.repeat(out, sizes)
            out[_ranges(first[bare], first[bare] + sizes[bare])] = list(chain.from_iterable(parts))
        return out

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes of all pieces, with the blank that the model puts first."""
        return b"".join(self.text[ids].tolist())

    def decode(self, ids: np.ndarray) -> str:
        return self.raw(ids)[1:].decode("utf-8", "surrogatepass")


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = b - a
    return np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


@cache
def lattices(path: str) -> Lattices:
    return Lattices(path)


class _Path:
    """A segmentation that was emitted, and the bounds of the sets that split off at each of its steps."""

    def __init__(self, lat: Lattices, edges: np.ndarray, perturbed: float, start: int, banned: frozenset, key: np.uint64):
        self.edges, self.perturbed, self.start, self.banned = edges, perturbed, start, banned
        log = lat.log[edges]
        before = np.cumsum(log) - log
        self.log_prob = float(log.sum())
        rest = lat.rest[edges[start:]]
        with np.errstate(divide="ignore", over="ignore"):
            if banned and len(rest):
                e = int(edges[start])
                a, b = np.searchsorted(lat.at, lat.at[e], "left"), np.searchsorted(lat.at, lat.at[e], "right")
                others = [x for x in range(a, b) if x != e and x not in banned]
                rest[0] = np.log(float(np.exp(lat.log[others]).sum()))
            phi = before[start:] + rest
            u = _uniform(key + np.arange(start, len(edges), dtype=np.uint64) * _M2)
            self.bound = phi - np.log(np.exp(np.minimum(phi - perturbed, 700)) - np.log(u))  # -inf where nothing is left

    def best(self) -> float:
        return float(self.bound.max()) if len(self.bound) else -np.inf


def sample(lat: Lattices, words: list[np.ndarray], keys: list[np.uint64], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k segmentations (edges, log probability, perturbed score, inclusion score), best first."""
    n = len(words)
    key = np.array(keys, np.uint64)
    paths: list[list[_Path]] = [[] for _ in range(n)]
    for r in range(k):
        turn = _mix(key + np.uint64((r + 1) * int(_M3) & MASK))
        texts, starts, ends, walk_keys, plans = [], [], [], [], []
        for i in range(n):
            w, own = words[i], paths[i]
            if r == 0:
                u = float(_uniform(turn[i : i + 1] + np.uint64(3))[0])
                plans.append((i, np.empty(0, np.int64), -np.log(-np.log(u)), 0, frozenset()))
                first, end = lat.first[w], lat.last[w]
            else:
                if len(own) < r:
                    continue
                top = max(own, key=_Path.best)
                bound = top.best()
                if bound == -np.inf:
                    continue
                step = int(top.bound.argmax())
                top.bound[step] = -np.inf
                at = top.start + step
                e = int(top.edges[at])
                banned = (top.banned if step == 0 else frozenset()) | {e}
                a, b = np.searchsorted(lat.at, lat.at[e], "left"), np.searchsorted(lat.at, lat.at[e], "right")
                free = [x for x in range(a, b) if x not in banned]
                mass = np.cumsum(np.exp(lat.log[free]))
                u = float(_uniform(turn[i : i + 1] + np.uint64(5))[0])
                pick = free[min(int(np.searchsorted(mass, u * mass[-1], "right")), len(free) - 1)]
                plans.append((i, np.append(top.edges[:at], pick), bound, at, banned))
                done = int(lat.closes[top.edges[:at]].sum())
                first, end = lat.first[w[done:]].copy(), lat.last[w[done:]]
                if len(first):
                    first[0] = lat.to[pick]
            texts.append(len(first))
            starts.append(first)
            ends.append(end)
            walk_keys.append(turn[i] + np.arange(len(w) - len(first), len(w), dtype=np.uint64) * _M2)
        if not plans:
            break
        edges, many = lat.walk(np.concatenate(starts), np.concatenate(ends), np.concatenate(walk_keys))
        of = np.cumsum(np.append(0, np.add.reduceat(np.append(many, 0), np.cumsum(texts) - texts) * (np.array(texts) > 0)))
        for (i, head, bound, at, banned), a, b in zip(plans, of[:-1], of[1:]):
            paths[i].append(_Path(lat, np.append(head, edges[a:b]), bound, at, banned, _mix(turn[i : i + 1] + np.uint64(7))[0]))
    out = []
    for own in paths:
        limit = max((p.best() for p in own), default=-np.inf)
        out.append([(p.edges, p.log_prob, p.perturbed, 1.0 if limit == -np.inf else float(-np.expm1(-np.exp(min(p.log_prob - limit, 50.0))))) for p in own])
    return out


ENCODED = "ids binary, samples array<struct<ids:binary,log_prob:double,perturbed:double,inclusion:double>>"
_SAMPLES = pa.list_(pa.struct([("ids", pa.binary()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64())]))


def pack(ids: np.ndarray) -> bytes:
    """Ids as little-endian 32-bit integers, as training shards hold them."""
    return ids.astype("<i4").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i4")


def encode(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), key_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, seed: int = SEED, model: str | None = None, check: bool = False, held: int = HELD) -> DataFrame:
    """``keep`` columns and ENCODED of every row; with ``check`` also round_trip: all id lists decode to the text.

    Ids of a text begin with the blank that the model puts before it. A null text is empty. A worker keeps some 110 bytes
    for each of ``held`` positions; fewer only mean that words are looked up again.
    """
    own = df.select(*keep, F.col(key_col).alias("_key"), F.col(text_col).alias("_text"))
    schema = own.drop("_key", "_text").schema
    for f in df.sparkSession.createDataFrame([], ENCODED + (", round_trip boolean" if check else "")).schema:
        schema = schema.add(f)
    path = model

    def run(batches):
        begins("spm", lattices.cache_clear)
        lat = lattices(path or default_model())
        lat.held = held
        for batch in batches:
            keys, texts = batch.column(batch.num_columns - 2).to_pylist(), [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for i, j in chunks(texts, max(1, held * 3 // 10)):
                ids, samples, same = [], [], []
                words = lat.indices(texts[i:j])
                for w, t, drawn in zip(words, texts[i:j], sample(lat, words, [row_key(x, seed) for x in keys[i:j]], k)):
                    own_ids, more = lat.own_ids(w), [(lat.ids(e), *x) for e, *x in drawn]
                    ids.append(pack(own_ids))
                    samples.append([{"ids": pack(x), "log_prob": a, "perturbed": b, "inclusion": c} for x, a, b, c in more])
                    if check:
                        want = t.encode("utf-8", "surrogatepass")
                        blank = want.replace("▁".encode(), b" ")
                        same.append(lat.raw(own_ids)[1:] == blank and all(lat.raw(x[0])[1:] == want for x in more))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:-2]), pa.array(ids, pa.binary()), pa.array(samples, _SAMPLES), *([pa.array(same, pa.bool_())] if check else [])], names=schema.names)

    return own.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), model: str | None = None) -> DataFrame:
    """``keep`` columns and the text of packed ids; null ids give null."""
    own = df.select(*keep, F.col(ids_col).alias("_ids"))
    schema = own.drop("_ids").withColumn("text", F.lit("")).schema

    def run(batches):
        begins("spm", lattices.cache_clear)
        lat = lattices(model or default_model())
        for batch in batches:
            texts = [None if x is None else lat.decode(unpack(x)) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return own.mapInArrow(run, schema)


def digest(rows: DataFrame) -> DataFrame:
    one = lambda f: F.transform("samples", f)
    return rows.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_pieces"), F.sha2("ids", 256).alias("ids_sha256"), "round_trip", F.size("samples").cast("long").alias("n_samples"),
        one(lambda s: (F.length(s["ids"]) / 4).cast("long")).alias("sample_pieces"), one(lambda s: F.sha2(s["ids"], 256)).alias("sample_sha256"),
        one(lambda s: F.round(s["log_prob"], 6)).alias("log_prob"), one(lambda s: F.round(s["perturbed"], 6)).alias("perturbed"), one(lambda s: F.round(s["inclusion"], 6)).alias("inclusion"),
    )


def op5_spm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), check=True))

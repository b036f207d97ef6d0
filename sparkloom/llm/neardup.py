"""Near-duplicate groups by an LSH forest of MinHash signatures, with links confirmed on full shingle sets.

1. Each text becomes its set of distinct word 3-shingles and a signature of HASHES minima. Texts with equal sets form a
   class, which goes on as its first document.
2. Each tree has an order of the minima. Classes that share its first LEAST_DEPTH are a region; estimated similarities
   link its classes to candidate chains. A class meets MEET others of its region on average. If that doesn't settle the
   region, it is dense: what is left is sorted by the tree's order, and neighbours whose common prefix is longer than
   that of the whole region stay together. So depth follows the region, one class in some trees deeper than another.
3. A class that went deeper in a tree has a smaller chance to meet its copies there. Chances are summed up; classes whose
   trees together leave more than MISS go to further trees, until none is left. Those that MOST_TREES don't settle are
   compared in full with each other in their regions.
4. The candidate chains of all trees are joined to blocks; full sets confirm or refuse the links of each block.

Steps 2 and 4 link a group's members in the same way (``linked``), so that no task holds more than two slices of a group:
first within slices; then one member of each large group, its leader, meets every slice; then the members that are not
in their group's largest component so far meet every slice. Each pair of members is compared once at least, or is in one
component already. A group of copies of one text thus takes work in proportion to its members. Members of a block that
stay apart from it meet all others; a region of more than a slice goes deeper instead, MOST_LEVELS times at most.

A class pair at the threshold misses all trees with MISS at most (0.85: 13 trees, 0.8: 17, more where regions are dense;
below 0.67 the rate rises, as the minima don't suffice); the estimate keeps it but for 1e-7. ``exact`` takes all classes
as one region, compared in full: what the forest finds can be held against it.

Odd input: a text without words (or null) has an empty set and is linked with nothing; fewer than three words count as
one shingle; a very long text is a slice of its own, whose set is held in one task; rows with null or repeated ids count
as documents of their own, in the order of id and text; ties go to the smaller id; an empty table gives an empty result;
other columns of the table are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import begins, chunks, has_odd_ids, numbered, ordered, set_aside, written

HASHES, LEAST_DEPTH = 96, 3
#: Greatest probability that a pair at the threshold meets in no tree.
MISS = 1e-5
#: Signatures of a dense region that are compared at once, so that the comparison stays in a core's cache.
DENSE = 4096
#: Others that a class of a region meets on average before the region goes deeper, trees, trees that are added at once,
#: and times that a region of more than a slice goes deeper.
MEET, MOST_TREES, MORE_TREES, MOST_LEVELS = 256, 64, 12, 8
#: Classes of a region that are a slice; classes, and their shingles, of a block that are a slice.
REGION_ROWS, BLOCK_ROWS, BLOCK_SHINGLES = 20_000, 4_096, 500_000
#: Leaders of a large group.
LEADERS = 2
#: Keys whose rows are joined by broadcast, at most: those with this share of all rows, and with so many rows.
HOT_KEYS, HOT_ROWS = 50_000, 100_000
#: Bits that say which texts may be asked for.
BITS = 1 << 26

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_MUL = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 2**63, HASHES, dtype=np.uint64)
_P, _K1, _K2 = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PINV = pow(_P, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _order(tree: int) -> np.ndarray:
    """The order of the minima in a tree; while they suffice, no two trees begin with the same ones."""
    mixed = np.random.Generator(np.random.PCG64(tree)).permutation(HASHES)
    first = np.arange(tree * LEAST_DEPTH, (tree + 1) * LEAST_DEPTH)
    return np.concatenate([first, mixed[~np.isin(mixed, first)]]) if first[-1] < HASHES else mixed


ORDERS = np.array([_order(t) for t in range(MOST_TREES)])


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        _powers[base] = np.cumprod(x, dtype=np.uint64)
    return _powers[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K1
    x = (x ^ (x >> np.uint64(27))) * _K2
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names of the shingles of ``width`` words of all texts, sorted by text and name, and each text's bounds.

    A text of fewer words is one shingle.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[1], gap.view(np.int8), [1]]))
    a, b = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _power(_P, len(data)))])
    word = _mix((total[b] - total[a]) * _power(_PINV, len(data) + 1)[a] + (b - a).astype(np.uint64))
    ends = np.cumsum([len(x) + 1 for x in raw])
    doc = np.searchsorted(ends, a, side="right")
    n_words = np.bincount(doc, minlength=len(raw))
    first = np.cumsum(n_words) - n_words
    run, name, own = word, [], []  # run: names of the sequences of k words from each word on
    for k in range(1, width + 1):
        if k > 1:
            run = _mix(run[: max(0, len(word) - k + 1)] * np.uint64(2 * k - 1) + (word[k - 1 :] ^ np.uint64(_P)))
        if k < width:
            short = np.flatnonzero(n_words == k)
            name.append(_mix(run[first[short]] + np.uint64(k)))
            own.append(short)
        else:
            ok = doc[k - 1 :] == doc[: len(run)]
            name.append(run[ok])
            own.append(doc[: len(run)][ok])
    name, own = np.concatenate(name), np.concatenate(own)
    order = np.lexsort((name, own))
    name, own = name[order], own[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (own[1:] != own[:-1])
    return name[new], np.concatenate([[0], np.cumsum(np.bincount(own[new], minlength=len(raw)))])


def signatures(names: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, HASHES) minima; rows of texts without shingles are 0."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, HASHES), np.uint64)
    if len(full):
        for k in range(HASHES):
            x = names * _MUL[k] + _ADD[k]
            x ^= x >> np.uint64(32)
            out[full, k] = np.minimum.reduceat(x, bounds[full])
    return out


FEATURES = "doc long, doc_id long, n_shingles long, fp binary, keys array<long>, sig binary"


def trees(percent: int) -> int:
    """Trees for which a pair at the threshold shares LEAST_DEPTH minima in none with probability MISS at most."""
    return min(HASHES // LEAST_DEPTH, math.ceil(math.log(MISS) / math.log1p(-max(percent, 1) ** LEAST_DEPTH / 100**LEAST_DEPTH))) if percent < 100 else 1


def _features(batches, width: int, n_trees: int):
    begins("neardup")
    for batch in batches:
        ids, texts = batch.select(["doc", "doc_id"]).columns, batch.column(2).to_pylist()
        for i, j in chunks(texts):
            names, bounds = shingles(texts[i:j], width)
            sig = signatures(names, bounds)
            key = np.zeros((len(sig), n_trees), np.uint64)
            for level in range(LEAST_DEPTH):
                key = _mix(key * np.uint64(7) + sig[:, level : n_trees * LEAST_DEPTH : LEAST_DEPTH] + np.arange(n_trees, dtype=np.uint64))
            small = (_mix(sig) & np.uint64(255)).astype(np.uint8)
            fp = [hashlib.blake2b(names[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [ids[0].slice(i, j - i), ids[1].slice(i, j - i), pa.array(np.diff(bounds)), pa.array(fp, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * n_trees), pa.array(key.view(np.int64).ravel())), pa.array([x.tobytes() for x in small], pa.binary())],
                names=["doc", "doc_id", "n_shingles", "fp", "keys", "sig"],
            )


def least_equal(percent: int) -> int:
    """Minima that must agree before a pair is looked at: 5 standard deviations below the threshold."""
    p = percent / 100
    return max(1, int(HASHES * p - 5 * (HASHES * p * (1 - p)) ** 0.5))


def equal(sig: np.ndarray, one: np.ndarray) -> np.ndarray:
    out = np.empty(len(sig), np.int64)
    for i in range(0, len(sig), DENSE):
        eights = (sig[i : i + DENSE] == one).view(np.uint64).sum(axis=1)  # bytes hold counts of HASHES / 8 at most
        out[i : i + DENSE] = (eights * np.uint64(0x0101010101010101)) >> np.uint64(56)
    return out


def _search(sig: np.ndarray, rows: np.ndarray, edges: list[tuple[int, int]], least: int, meet: int | None = None) -> np.ndarray:
    """Candidate chains among ``rows``: breadth first, each class against all that aren't reached yet, until none is left.

    Stops where classes have met ``meet`` others on average, and returns those that have not met all others by then."""
    left = rows
    if len(rows) > 64:  # the class that agrees most with its region goes first: it reaches most others
        mode = np.array([np.bincount(sig[rows, k], minlength=256).argmax() for k in range(HASHES)], np.uint8)
        left = rows[np.argsort(-equal(sig[rows], mode), kind="stable")]
    own = sig[left]
    queue: list[int] = []
    work = 0
    while len(left):
        if meet is not None and work >= meet * len(rows):
            return np.concatenate([np.array(queue, np.int64), left])
        if queue:
            x = queue.pop()
        else:
            x, left, own = int(left[0]), left[1:], own[1:]
        work += len(left)
        hit = equal(own, sig[x]) >= least
        if hit.any():
            found = left[hit]
            edges += [(x, int(y)) for y in found]
            queue += found.tolist()
            left, own = left[~hit], own[~hit]
    return rows[:0]


def _descend(sig: np.ndarray, rows: np.ndarray, order: np.ndarray, depth: int, edges: list[tuple[int, int]], least: int, meet: int | None) -> dict[int, int]:
    """Candidate chains among ``rows``, which share ``depth`` minima; the depths of those that went deeper."""
    if meet is None or len(rows) <= meet:
        _search(sig, rows, edges, least)
        return {}
    rows = rows[np.lexsort(sig[np.ix_(rows, order[::-1])].T)]
    place = np.argsort(rows)
    deeper: dict[int, int] = {}
    regions = [(rows, depth)]
    while regions:
        own, depth = regions.pop()
        rest = _search(sig, own, edges, least, meet)
        if len(rest) < 2:
            continue
        rest = rows[np.sort(place[np.searchsorted(rows[place], rest)])]  # in the tree's order again
        differ = sig[np.ix_(rest[1:], order)] != sig[np.ix_(rest[:-1], order)]
        prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), HASHES)  # common with the neighbour
        depth = int(prefix.min()) + 1
        deeper.update(dict.fromkeys(rest.tolist(), depth))
        regions += [(part, depth) for part in np.split(rest, np.flatnonzero(prefix < depth) + 1) if len(part) > 1]
    return deeper


def chance(percent: int, depth: int) -> float:
    """What a tree adds to -log(miss) of a pair at the threshold, if it must share ``depth`` minima there.

    Beyond LEAST_DEPTH trees share minima: their chances are those of a pair that agrees in fewer by two standard
    deviations, since a pair that agrees in few is missed by all of them."""
    p = percent / 100
    if depth > LEAST_DEPTH:
        p -= 2 * (p * (1 - p) / HASHES) ** 0.5
    return -math.log1p(-min(p**depth, 1 - MISS))


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table`` (``key``, n, ...), which has one row a key and in ``n`` the key's rows.

    Keys with over HOT_ROWS rows and over a share of all (HOT_KEYS of them at most) are sent to every task, so that no
    task gets all rows of one; the others are joined by shuffle."""
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_total"))  # one row
    hot = table.join(F.broadcast(total)).where((F.col("n") > HOT_ROWS) & (F.col("n") > F.col("_total") / HOT_KEYS)).drop("_total", "n")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.drop("n"), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def among(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``doc`` is not in ``members``: what stays is joined exactly afterwards, and what
    goes needs no shuffle. One bit for each of BITS hashes goes to every task, 8 MB at most."""
    h = F.pmod(F.xxhash64(F.lit(13), "doc"), F.lit(BITS))
    set_bits = members.select(F.bitmap_bucket_number(h).alias("_bucket"), F.bitmap_bit_position(h).alias("_at")).groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    met = rows.withColumns({"_bucket": F.bitmap_bucket_number(h), "_at": F.bitmap_bit_position(h)}).join(F.broadcast(set_bits), "_bucket")
    bit = F.expr("getbit(cast(conv(hex(substring(_bits, cast(_at div 8 as int) + 1, 1)), 16, 10) as bigint), cast(_at % 8 as int))")
    return met.where(bit == 1).select(*rows.columns)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the least node that it is joined to.

    Alternating large and small stars until nothing changes: each round is two aggregations, written down; a path of n
    nodes takes about log n rounds. Minima are taken before rows are shuffled, and a node with very many edges is looked
    up without a shuffle.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = F.struct(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("x"))
    before = now.select(mark).first()
    while before[0][0]:
        # No node of few edges is hot: then plain joins give the same rows, and what they read need not be written.
        many = before[0][0] > HOT_ROWS
        held = written if many else lambda df: df
        find = looked_up if many else lambda rows, table, key: rows.join(table.drop("n"), key)
        both = now.union(now.select("v", "u"))
        least = held(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = held(find(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = held(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = find(large, least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = written(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = now.select(mark).first()
        if after == before:
            break
        before = after
    nodes = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())


def _compared(sig: np.ndarray, names: list[np.ndarray] | None, percent: int, root: np.ndarray, turn: np.ndarray | None) -> list[tuple[int, int]]:
    """Links between members of different ``root``s: of those with a ``turn`` with all others (None: of all with all).

    A pair is linked if its estimate allows it and, where there are ``names``, its full sets are similar. Pairs inside a
    component, given or found, need no look."""
    n, links = len(sig), []
    root = root.copy()
    least = least_equal(percent)
    size = None
    if names is not None:
        size = np.fromiter(map(len, names), np.int64, n)
        start = np.cumsum(size) - size
        seen, flat = np.unique(np.concatenate(names), return_inverse=True)  # shingles by small numbers
        flat = flat.astype(np.int32)
        mine = np.zeros(len(seen), bool)  # the shingles of the member whose turn it is
        del seen
    waiting = np.ones(n, bool) if turn is None else turn.copy()
    x = int(np.flatnonzero(waiting)[0])
    if turn is None and n > 2:  # the member that agrees most with all goes first: it reaches most others
        x = int(equal(sig, np.array([np.bincount(sig[:, k], minlength=256).argmax() for k in range(HASHES)], np.uint8)).argmax())
    while True:
        waiting[x] = False
        may = (root != root[x]) & (equal(sig, sig[x]) >= least)
        if size is not None:
            may &= (size * 100 >= size[x] * percent) & (size[x] * 100 >= size * percent)
        other = np.flatnonzero(may)
        if len(other) and size is not None:
            own = flat[start[x] : start[x] + size[x]]
            mine[own] = True
            if len(other) * 2 > n:
                both = np.add.reduceat(mine[flat], start, dtype=np.int64)[other]
            else:
                both = np.fromiter((np.count_nonzero(mine[flat[start[y] : start[y] + size[y]]]) for y in other), np.int64, len(other))
            mine[own] = False
            other = other[both * 100 >= percent * (size[other] + size[x] - both)]
        if len(other):
            roots, first = np.unique(root[other], return_index=True)
            links += [(x, int(y)) for y in other[first]]
            root[np.isin(root, roots)] = root[x]
        # Without turns all but the members of the largest component take one.
        rest = waiting if turn is not None else waiting & (root != np.bincount(root, minlength=n).argmax())
        rest = np.flatnonzero(rest)
        if not len(rest):
            return links
        x = int(rest[0])


#: side 0: a member in its slice; 1: a leader; 2: one of the rest, which has a turn; in regions: the tree.
#: root: the component so far.
MEMBER = ["task", "doc", "side", "root", "sig"]


LINKS = "a long, b long, tree int, depth int"


def _links(a: np.ndarray, b: np.ndarray, tree: int = 0, depth: np.ndarray | None = None) -> pa.RecordBatch:
    depth = np.zeros(len(a)) if depth is None else depth
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), tree, np.int32)), pa.array(depth.astype(np.int32))], names=["a", "b", "tree", "depth"])


def _tasks(percent: int, width: int | None, depth: int, meet: int | None):
    """LINKS of rows of MEMBER, and texts with ``width``, sorted by task; a task is held until its last row is there.

    Regions also give a row (a, a, tree, depth) for a class that went deeper than LEAST_DEPTH."""

    def group(held: list[tuple]) -> pa.RecordBatch | None:
        turns = {doc for doc, side, *_ in held if side}
        rows = sorted((r for r in held if r[1] or r[0] not in turns), key=lambda r: r[:2])  # nobody meets itself
        if len(rows) < 2:
            return None
        doc, side = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows])
        sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, HASHES)
        _, root = np.unique(np.array([r[2] for r in rows], np.int64), return_inverse=True)
        links = _compared(sig, None if width is None else [r[4] for r in rows], percent, root, side > 0 if side.any() else None)
        if not links:
            return None
        e = np.array(links)
        return _links(doc[e[:, 0]], doc[e[:, 1]])

    def regions(batches):
        """As below, by whole arrays: regions are many and small."""

        def links(task, doc, tree, sig):
            edges: list[tuple[int, int]] = []
            starts = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
            ends = np.append(starts[1:], len(task))
            for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                deeper = _descend(sig, np.arange(a, b), ORDERS[tree[a]], depth, edges, least_equal(percent), meet)
                if deeper:
                    own = doc[np.array(list(deeper))]
                    yield _links(own, own, tree[a], np.array(list(deeper.values())))
            if edges:
                e = np.array(edges)
                yield _links(doc[e[:, 0]], doc[e[:, 1]])

        begins("neardup")
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, HASHES)
            held.append(now)
            if held[0][0][0] != now[0][-1]:
                all_held = [np.concatenate(x) for x in zip(*held)]
                cut = int(np.flatnonzero(all_held[0] != all_held[0][-1])[-1]) + 1
                yield from links(*(x[:cut] for x in all_held))
                held = [tuple(x[cut:] for x in all_held)]
        if held:
            yield from links(*map(np.concatenate, zip(*held)))

    def run(batches):
        begins("neardup")
        held, at = [], None
        for batch in batches:
            task, doc, side, root, sig, *texts = (c.to_pylist() for c in batch.columns)
            texts = texts[0] if texts else [None] * len(task)
            for i, j in chunks(texts):
                names, bounds = shingles(texts[i:j], width) if width else (None, None)
                for k in range(i, j):
                    if task[k] != at:
                        if len(held) > 1 and (out := group(held)):
                            yield out
                        held, at = [], task[k]
                    own = names[bounds[k - i] : bounds[k - i + 1]].copy() if width else None
                    held.append((doc[k], side[k], root[k], sig[k], own))
        if len(held) > 1 and (out := group(held)):
            yield out

    return run, regions


def _large(rows: DataFrame, slice_rows: int, slice_weight: int | None) -> DataFrame:
    """(grp, n, parts) of the groups of ``rows`` (grp, doc, weight, sig) that take more than one slice."""
    size = F.count("*") / slice_rows
    if slice_weight:
        size = F.greatest(size, F.sum("weight") / slice_weight)
    return written(rows.groupBy("grp").agg(F.count("*").alias("n"), F.ceil(size).alias("parts")).where("parts > 1"))


def linked(rows: DataFrame, percent: int, width: int | None, texts: DataFrame | None, slice_rows: int, slice_weight: int | None = None, depth: int = LEAST_DEPTH, meet: int | None = None) -> DataFrame:
    """LINKS that join the members of each group of ``rows`` (grp, doc, weight, sig) to components: confirmed ones with
    ``texts`` (doc, text) and the ``width`` of shingles, else estimated ones. Then ``rows`` has a ``tree`` and its groups
    share ``depth`` minima; with ``meet`` dense ones go deeper."""
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run, regions = _tasks(percent, width, depth, meet)

    texted = (lambda df: df) if texts is None else (lambda df: df.join(texts, "doc"))
    columns = MEMBER if texts is None else [*MEMBER, "text"]

    def sent(df: DataFrame, task, side, root) -> DataFrame:
        return df.withColumns({"task": task, "side": side if isinstance(side, Column) else F.lit(side), "root": root}).select(*columns)

    def met(members: DataFrame, by) -> DataFrame:
        return members.repartition(n_parts, "task").sortWithinPartitions("task", "doc").mapInArrow(by, LINKS)

    def every(df: DataFrame, name: str, n: str) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))

    task, own, by = F.xxhash64("grp", "part"), F.col("doc"), run if width else regions
    side = F.lit(0) if width else F.col("tree")
    large = _large(rows, slice_rows, slice_weight)
    if large.isEmpty():
        return written(met(sent(texted(rows), F.col("grp"), side, own), by).distinct())
    dealt = looked_up(rows, large, "grp", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    dealt = written(dealt.withColumn("part", F.pmod(F.xxhash64(F.lit(7), "doc"), F.col("parts"))))
    found = met(sent(texted(dealt), task, side, own), by)
    large = written(dealt.where("parts > 1"))
    # Leaders meet every slice of their group.
    picks = (F.min(F.struct(F.xxhash64(F.lit(k), "doc").alias("h"), "doc", "sig", "parts")).alias(f"l{k}") for k in range(LEADERS))
    leaders = large.groupBy("grp").agg(*picks).select("grp", F.explode(F.array(*(f"l{k}" for k in range(LEADERS)))).alias("l"))
    leaders = written(leaders.select("grp", "l.doc", "l.sig", "l.parts").distinct())
    guests = sent(every(texted(leaders), "part", "parts"), task, 1, own)
    found = written(found.union(met(sent(texted(large), task, 0, own).union(guests), run)).distinct())
    # Who is not in its group's largest component meets every slice.
    now = written(large.join(components(found), F.col("doc") == F.col("node"), "left").withColumn("root", F.coalesce("root", "doc")).drop("node"))
    most = now.groupBy("grp", "root").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.sum("n").alias("n"))
    rest = looked_up(now, written(most), "grp").where("root <> most").drop("most", "part").join(leaders.select("grp", "doc"), ["grp", "doc"], "left_anti")
    rest = written(rest)
    if rest.isEmpty():
        return found
    if meet is not None and depth < LEAST_DEPTH + MOST_LEVELS:
        # Regions of more than a slice in which classes stay apart go deeper, with all their members.
        at = F.element_at(F.array(*(F.lit(int(x) + 1) for x in ORDERS[:, depth])), F.col("tree") + 1)
        deep = now.join(rest.select("grp").distinct(), "grp", "left_semi").withColumn("at", at)
        deep = written(deep.select(F.xxhash64("grp", F.expr("substring(sig, at, 1)")).alias("grp"), "doc", "weight", "sig", "tree"))
        went = deep.select(F.col("doc").alias("a"), F.col("doc").alias("b"), "tree", F.lit(depth + 1).alias("depth"))
        return written(found.union(went).union(linked(deep, percent, None, None, slice_rows, None, depth + 1, meet)).distinct())
    # The rest is dealt into slices of its own, each of which meets each slice of the members.
    size = F.count("*") / slice_rows
    if slice_weight:
        size = F.greatest(size, F.sum("weight") / slice_weight)
    turns = rest.groupBy("grp").agg(F.ceil(size).cast("long").alias("turns"))
    turns = written(now.groupBy("grp").agg(F.count("*").alias("n")).join(turns, "grp"))
    pair = F.xxhash64("grp", "part", "turn")
    takers = looked_up(rest, turns, "grp").withColumn("turn", F.pmod(F.xxhash64(F.lit(11), "doc"), F.col("turns")))
    takers = sent(every(texted(takers), "part", "parts"), pair, 2, F.col("root"))
    members = sent(every(texted(looked_up(now, turns, "grp")), "turn", "turns"), pair, 0, F.col("root"))
    return written(found.union(met(members.union(takers), run)).distinct())


def forest(reps: DataFrame, percent: int) -> DataFrame:
    """LINKS that join candidates among ``reps`` (doc, sig, keys) to chains, tree by tree."""

    def planted(rows: DataFrame, tree_and_key: Column) -> DataFrame:
        return rows.select(tree_and_key, "doc", F.lit(1).cast("long").alias("weight"), "sig")

    first = trees(percent)
    grown = planted(reps, F.posexplode("keys").alias("tree", "grp"))
    found = linked(grown, percent, None, None, REGION_ROWS, meet=MEET)
    chances = F.element_at(F.array(*(F.lit(chance(percent, d)) for d in range(HASHES + 1))), F.col("depth") + 1)
    # Classes that went deeper: (doc, tree, chance of the tree); other trees have the chance of LEAST_DEPTH.
    least = chance(percent, LEAST_DEPTH)
    n_trees, active = first, reps.select("doc", "sig")
    while True:
        lost = found.where("a = b").groupBy(F.col("a").alias("doc"), "tree").agg(F.max("depth").alias("depth"))
        lost = lost.groupBy("doc").agg(F.sum(least - chances).alias("lost"))
        # The first trees alone may fall short of MISS at low thresholds; only what depth takes away is made up for.
        need = min(-math.log(MISS), first * least)
        active = written(active.join(lost.where(n_trees * least - F.col("lost") < need).select("doc"), "doc"))
        if active.isEmpty():
            return found
        if n_trees >= MOST_TREES:
            base = grown.join(active.select("doc"), "doc", "left_semi").select("grp", "doc", "weight", "sig", "tree")
            return written(found.union(linked(base, percent, None, None, REGION_ROWS)).distinct())
        more = range(n_trees, min(n_trees + MORE_TREES, MOST_TREES))
        begin = {t: F.xxhash64(F.lit(t), *(F.substring("sig", int(x) + 1, 1) for x in ORDERS[t, :LEAST_DEPTH])) for t in more}
        each = F.explode(F.array(*(F.struct(F.lit(t).alias("tree"), key.alias("grp")) for t, key in begin.items())))
        rows = active.select(each.alias("at"), "doc", F.lit(1).cast("long").alias("weight"), "sig").select("at.*", "doc", "weight", "sig")
        found = written(found.union(linked(rows, percent, None, None, REGION_ROWS, meet=MEET)).distinct())
        n_trees = more.stop


def groups(docs: DataFrame, percent: int = 85, width: int = 3, exact: bool = False) -> DataFrame:
    """``groups_of`` the rows of ``docs`` (doc_id, text), numbered in the order of their ids."""
    return groups_of(ordered(docs), percent, width, exact)


def groups_of(own: DataFrame, percent: int = 85, width: int = 3, exact: bool = False) -> DataFrame:
    """(doc, doc_id, n_shingles, root, root_id): every row of ``own`` (doc, doc_id, text) with the first document that
    its class is joined to, and that document's id. ``doc`` is a unique long. ``exact``: without trees."""
    n_trees = trees(percent)
    rows = written(own.select("doc", "doc_id", "text").mapInArrow(lambda batches: _features(batches, width, n_trees), FEATURES))
    reps = written(rows.where("n_shingles > 0").groupBy("fp").agg(F.min(F.struct("doc", "doc_id")).alias("first"), F.max("n_shingles").alias("n_shingles"), F.max("sig").alias("sig"), F.max("keys").alias("keys")).select("fp", "first.*", "n_shingles", "sig", "keys"))
    if exact:
        whole = reps.select(F.lit(0).cast("long").alias("grp"), "doc", F.lit(1).cast("long").alias("weight"), "sig", F.lit(0).alias("tree"))
        near = linked(whole, percent, None, None, REGION_ROWS)
    else:
        near = forest(reps, percent)
    chains = written(components(near))
    blocks = reps.join(chains, reps["doc"] == chains["node"]).select(F.col("root").alias("grp"), "doc", F.col("n_shingles").alias("weight"), "sig")
    blocks = written(blocks)
    links = linked(blocks, percent, width, among(own.select("doc", "text"), blocks), BLOCK_ROWS, BLOCK_SHINGLES)
    found = components(links).select(F.col("node").alias("_rep"), "root")
    found = found.join(reps.select(F.col("doc").alias("root"), F.col("doc_id").alias("root_id")), "root")
    of = reps.select(F.col("fp").alias("_fp"), F.col("doc").alias("_rep"), "doc_id").join(found, "_rep", "left").select("_fp", F.coalesce("root", "_rep").alias("root"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("root_id")).alias("root_id"))
    member = rows.select("doc", "doc_id", "n_shingles", "fp").join(of, F.col("n_shingles").cast("boolean") & (F.col("fp") == F.col("_fp")), "left")
    alone = F.col("root").isNull()
    return member.select("doc", "doc_id", "n_shingles", F.coalesce("root", "doc").alias("root"), F.when(alone, F.col("doc_id")).otherwise(F.col("root_id")).alias("root_id"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", F.col("root_id").alias("component_id"), (F.col("doc") == F.col("root")).alias("kept"))


def without_copies(df: DataFrame, percent: int = 85, width: int = 3) -> DataFrame:
    """``df`` without the rows that are in a group and not its first; rows without words stay."""
    df, names = set_aside(df)
    if has_odd_ids(df):
        own = numbered(df.withColumn("_fp", F.xxhash64("text")), ["doc_id", "_fp", "text"], "_doc").drop("_fp")
        gone = groups_of(own.select(F.col("_doc").alias("doc"), "doc_id", "text"), percent, width)
        return own.join(gone.where("doc <> root").select(F.col("doc").alias("_doc")), "_doc", "left_anti").select(*df.columns).toDF(*names)
    gone = groups(df, percent, width).where("doc <> root").select(F.col("doc").alias("_gone"))
    return df.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").toDF(*names)

"""Line dedup, collocations and periodic runs: brute force, SQL, odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import collocations, linedup, runs

from ..conftest import SF
from .conftest import DOCS

CLASH = ["doc", "hi", "lo", "top", "keys", "rest", "n", "phrase", "lang2", "n_words", "runs", "collapsed", "slice", "a", "l", "r", "score", "rank", "_w"]


def lines_brute(texts):
    """texts: {doc: text}. What is kept of each."""
    strip = " \t\n\v\f\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(low)
    held = defaultdict(set)
    for doc, text in texts.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(doc)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 3}
    out = {}
    for doc, text in texts.items():
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), doc) == doc]
        out[doc] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def some_lines(r, n):
    stock = [f"{'Ä' * (k % 3)}Common line number {k} of the stock" for k in range(30)] + ["x" * 19, "y" * 20, "é" * 19, "é" * 20, "ß" * 10 + "a" * 9, "", " \t"]
    out = {}
    for doc in range(n):
        own = [r.choice([r.choice(stock), r.choice(stock).upper() if r.random() < 0.2 else r.choice(stock), f"  {r.choice(stock)}\t", f"own line {r.random()} of this text"]) for _ in range(r.randint(0, 12))]
        out[doc * 3 - 5] = "\n".join(own) if r.random() > 0.05 else None
    return out


def test_lines_against_brute_force(spark):
    texts = some_lines(random.Random(5), 200)
    got = linedup.without_repeated_lines(spark.createDataFrame([(k, t, "x", "y", 1) for k, t in texts.items()], DOCS)).collect()
    assert {r.doc_id: (r.rest, r.n_lines, r.n_dropped) for r in got} == lines_brute(texts)


def test_index_is_reversible(spark, tmp_path, monkeypatch):
    """Batches, deletions and insertions again: counts, filters and results as if only what is there had been inserted."""
    monkeypatch.setattr(linedup, "SHARD_KEYS", 64)  # many shards, split on the way
    r = random.Random(7)
    texts = some_lines(r, 150)
    ids = sorted(texts)
    table = lambda some: spark.createDataFrame([(k, texts[k]) for k in some], "doc long, text string")
    index = linedup.LineIndex.create(spark, str(tmp_path / "lines"))
    index = index.insert(table(ids[:60]))
    index = index.insert(table(ids[40:100]))  # twenty of them are there already
    index = index.delete(table(ids[10:50]).select("doc"))
    index = linedup.LineIndex.open(spark, str(tmp_path / "lines"))
    index = index.insert(table(ids[20:30] + ids[100:]))
    index = index.delete(table(ids[140:] + ids[-1:]).select("doc"))
    there = ids[:10] + ids[20:30] + ids[50:140]
    fresh = linedup.LineIndex.create(spark, str(tmp_path / "fresh")).insert(table(there))
    rows = lambda x: sorted(map(tuple, x.table("counts").collect()))
    assert rows(index) == rows(fresh) and index.bits > 0
    assert sorted(map(tuple, index.postings().collect())) == sorted(map(tuple, fresh.postings().collect()))
    own = index.table("filters").collect()
    assert sum(x.n_seen for x in own) == len(rows(index)) and sum(x.n_repeated for x in own) == sum(n >= 3 for _, _, n, _ in rows(index))
    for x in own:  # as many tags as keys: nothing that was deleted is left behind
        assert np.count_nonzero(linedup.CuckooFilter.of(x.seen).table) == x.n_seen
        assert np.count_nonzero(linedup.CuckooFilter.of(x.repeated).table) == x.n_repeated
    want = lines_brute({k: texts[k] for k in there})
    for gate in (linedup.GATE_BYTES, 0):  # filters sent to every task, and all lines joined instead
        monkeypatch.setattr(linedup, "GATE_BYTES", gate)
        got = {x.doc: (x.rest, x.n_lines, x.n_dropped) for x in index.deduplicated(table(there)).collect()}
        assert got == want


def test_cuckoo_filter():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(-(2**62), 2**62, 20_000))
    f = linedup.CuckooFilter.sized(len(keys))
    assert f.add(keys) and f.has(keys).all()
    other = r.integers(-(2**62), 2**62, 50_000)
    assert f.has(other).mean() < 0.001
    f.remove(keys[::2])
    assert f.has(keys[1::2]).all() and f.has(keys[::2]).mean() < 0.001 and np.count_nonzero(f.table) == len(keys[1::2])
    same = np.full(9, 77, np.int64)  # more copies of a tag than two buckets hold
    assert not linedup.CuckooFilter.sized(64).add(same)
    with pytest.raises(ValueError, match="never added"):
        f.remove(np.array([123456789], np.int64)[~f.has(np.array([123456789], np.int64))])
        f.remove(keys[::2])


def phrases_brute(rows, least=30, longest=4, top=2000, closed=80):
    import re

    f, n = defaultdict(Counter), Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= closed * c[p[i : i + k]]:
                        covered.add(p[i : i + k])
        scored = []
        for p, a in cands.items():
            if p not in covered:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def some_phrases(r, n):
    words = [f"w{k}" for k in range(12)] + ["É", "é", "\u0000x", "a-b", "漢"]
    stock = [" ".join(r.choice(words) for _ in range(r.randint(2, 5))) for _ in range(12)]
    rows = []
    for _ in range(n):
        parts = [r.choice([r.choice(stock), r.choice(words), r.choice(words).upper()]) for _ in range(r.randint(0, 40))]
        rows.append((r.choice(["en", "de", "und", None]), "".join(p + r.choice([" ", " ", "\t", "  ", ". ", "\n", ",", "!?"]) for p in parts)))
    return rows


@pytest.mark.parametrize("buckets", [None, 1 << 10])
def test_collocations_against_brute_force(spark, buckets):
    """With few buckets most are full, so that pruning is weak: the same phrases."""
    rows = [*some_phrases(random.Random(11), 300), (None, None), ("en", ""), ("fr", " \t\n")]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), buckets=buckets, top=12).drop("cut").collect()
    want = phrases_brute(rows, top=12)
    assert len(want) > 30 and sorted(map(tuple, got)) == want


def test_bucket_counters_stop_at_the_least(spark):
    """A phrase that no task has 30 times, but all tasks together do; and one that a task has 1,000 times."""
    rows = [("en", "seldom met")] * 36 + [("en", "often met " * 1000)] + [("en", "too rare")] * 29
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(12), buckets=1 << 16).collect()
    assert {r.phrase: r.a for r in got} == {"seldom met": 36, "often met often met": 999, "met often met often": 998}


def runs_brute(w, least=6, times=4):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if size >= max(least, times * q) and all(any(w[k] != w[k + p] for k in range(s, s + size - p)) for p in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def some_words(r):
    k, n = r.randint(1, 4), r.randint(0, 50)
    t = [r.randint(0, k) for _ in range(n)]
    if r.random() < 0.5:
        unit = [r.randint(0, k) for _ in range(r.randint(1, 7))]
        t = t[: r.randint(0, n)] + (unit * 9)[: r.randint(0, 9 * len(unit))] + t[: r.randint(0, 6)]
    return [f"v{x}" for x in t]


def test_runs_against_brute_force():
    r = random.Random(3)
    for _ in range(800):
        texts = [some_words(r) for _ in range(r.randint(0, 5))]
        assert [[tuple(x) for x in g.tolist()] for g in runs.found(texts)] == [runs_brute(t) for t in texts]


def test_lyndon_words_under_both_orders():
    r = random.Random(4)
    for _ in range(100):
        w = [r.randint(1, 3) for _ in range(r.randint(1, 25))]
        rank, _, _ = runs.suffix_ranks(np.array([*w, 0]))
        i, j = runs.roots(rank, np.array([len(w)]))
        for a, b in zip(i[: len(w)].tolist(), j[: len(w)].tolist()):  # the longest Lyndon word at a
            lyndon = [e for e in range(a + 1, len(w) + 1) if all(w[a:e] < w[k:e] for k in range(a + 1, e))]
            assert b == max(lyndon)


def test_run_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {x.doc_id: x for x in runs.op13_runs(spark, SF).collect()}
    some = 0
    for doc_id, text in docs.select("doc_id", "text").collect():
        w = (text or "").encode().split()
        if len(w) > 400:
            continue
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        want = runs_brute(w)
        x = got[doc_id]
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert x.n_runs == len(want)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(b" ".join(y for i, y in enumerate(w) if i not in gone)).hexdigest()
        if want:
            some += 1
            best = min(want, key=lambda r: (-(r[1] * 10**9 // r[2]), r[0], r[2]))
            assert (x.start, x.length, x.period, x.exponent_milli) == (*best, 1000 * best[1] // best[2])
        else:
            assert x.start is x.length is x.period is x.exponent_milli is None
    assert some > 20


@pytest.mark.parametrize("name,query", [("op11_linedup", linedup.op11_linedup), ("op12_collocations", collocations.op12_collocations), ("op13_runs", runs.op13_runs)])
def test_same_rows_as_sql(spark, name, query):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = query(spark, SF)
    out = c.execute({**linedup.ORACLE, **collocations.ORACLE, **runs.ORACLE}[name])
    columns = [x[0] for x in out.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted(out.fetchall(), key=key)


def test_odd_rows(odd, odd_rows, empty):
    for op in (linedup.without_repeated_lines, runs.periodic_runs):
        assert op(odd).count() == len(odd_rows) and op(empty).count() == 0
        wide = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).withColumns({c: F.lit("x") for c in CLASH})
        assert op(wide).count() == 7
    assert collocations.collocations(empty).count() == 0
    wide = odd.withColumns({c: F.lit("x") for c in CLASH})
    got = {(r.lang, r.phrase): r for r in collocations.collocations(wide).collect()}
    assert got["fr", "line of words here"].a == 4000 and got["fr", "line of words here"].score == 1_000_000
    rest = linedup.without_repeated_lines(odd.unionByName(odd.where("doc_id = 1"))).collect()
    one = [r.rest for r in rest if r.doc_id == 1]
    assert sorted(map(len, one)) == [0, 0, 0, 118]  # four equal rows: the last keeps its line
    line = next(r for r in runs.periodic_runs(odd).collect() if r.doc_id == 6)
    assert [(x.start, x.length, x.period) for x in line.runs] == [(0, 16_000, 4)] and line.collapsed == "line of words here"
    assert all(r.runs == [] and r.collapsed == "" for r in runs.periodic_runs(odd).collect() if r.doc_id in (2, 3, 4))

"""Nearest neighbours by cosine through an inverted file over learnt cells.

Vectors are scaled to length 1 and belong to the cell of the centre with the largest cosine. A cell knows the largest angle
between its centre and a member. For a query at angle t to a centre whose cell reaches r, no member is nearer than t - r, so

1. each query reads its ``probes`` nearest cells, which gives a k-th best angle;
2. it reads those other cells whose bound does not exclude an angle that small; all others are skipped by proof.

The result is that of comparing all with all; how many cells are skipped depends on how clustered the vectors are.
``exact=False`` leaves step 2 out. Cells are read in blocks, so neither a cell with most of the vectors nor one that most
queries ask for is one task's work.

A row without a vector (null, empty or with a null in it) has the cosine null to all, which ranks last; one with NaN or an
infinite value has NaN, which ranks first, as in SQL. Neither is in a cell: the least ids of each kind stand for all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.operators.cluster import hash_seeds, lloyd
from sparkloom.operators.graph import BLOCK, checkpointed, most_similar

#: Added to bounds, so that rounding never skips a cell.
SLACK = 1e-9
#: Cells at most: their centres go to every task, and every query is compared with all of them.
MOST_CELLS = 4096
#: Vectors whose angles are in memory at a time, and products of vectors.
SLICE, PRODUCTS = 1024, 4_000_000
#: Pairs of blocks at least, where blocks are larger than BLOCK; vectors of a block at most.
LEAST_PAIRS, MOST_BLOCK = 64, 32_768
#: Vectors a cell from which centres are learnt; all vectors are put into cells.
FIT_ROWS = 256


@dataclass
class Cells:
    """``rows`` (node, vec, cell) with unit vectors, the centres, and by cell the largest angle and the number of members;
    ``odd`` (node, nan) if there are rows that have no direction."""

    rows: DataFrame
    centres: np.ndarray
    reach: np.ndarray
    size: np.ndarray
    odd: DataFrame | None = None


def unit(df: DataFrame) -> DataFrame:
    """(node, vec) with vectors of length 1; those of length 0 stay."""
    x = F.col("vec").cast("array<double>")
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return df.select(F.col("node").cast("long").alias("node"), x.alias("vec"), size.alias("_s")).select("node", F.when(F.col("_s") > 0, F.transform("vec", lambda v: v / F.col("_s"))).otherwise(F.col("vec")).alias("vec"))


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (node, vec) that have a direction (or length 0), and (node, nan) of the others if there are any."""
    x = F.col("vec").cast("array<double>")
    nan = F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    none = F.col("vec").isNull() | (F.size("vec") == 0) | F.exists(x, lambda v: v.isNull())
    kind = F.when(none, 1).when(nan, 2).otherwise(0)
    odd = df.where(kind > 0)
    if odd.isEmpty():
        return df, None
    return df.where(kind == 0), odd.select(F.col("node").cast("long").alias("node"), (kind == 2).alias("nan"))


def _with_odd(found: DataFrame, asked: DataFrame, odd_asked: DataFrame | None, known: DataFrame, odd_known: DataFrame | None, k: int, itself: bool) -> DataFrame:
    """``found`` with what rows without a direction add, on either side: ``k`` + 1 ids of each kind at most."""
    if odd_asked is None and odd_known is None:
        return found
    none = found.sparkSession.createDataFrame([], "node long, nan boolean")
    odd_asked, odd_known = (none if x is None else x for x in (odd_asked, odd_known))
    least = lambda df, sim: df.select(F.col("node").alias("other"), sim.cast("double").alias("sim")).orderBy("other").limit(k + 1)
    own, nan, null = known.select("node"), F.lit(float("nan")), F.lit(None)
    strange, missing = odd_known.where("nan").select("node"), odd_known.where("not nan").select("node")
    met = [
        asked.select("node").join(F.broadcast(least(strange, nan).unionByName(least(missing, null)))),
        odd_asked.where("nan").select("node").join(F.broadcast(least(own.union(strange), nan).unionByName(least(missing, null)))),
        odd_asked.where("not nan").select("node").join(F.broadcast(least(own.union(odd_known.select("node")), null))),
    ]
    rows = found.drop("place")
    for more in met:
        rows = rows.unionByName(more if itself else more.where("node <> other"))
    return _best(rows, k)


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


def build(known: DataFrame, cells: int | None = None, rounds: int = 8) -> Cells:
    """The inverted file of (node, vec). Centres are learnt from the FIT_ROWS x cells rows of least hash, and scaled to 1."""
    known, odd = _split(known)
    own = checkpointed(unit(known))
    n = own.count()
    cells = max(1, min(cells or int(np.sqrt(max(n, 1))), MOST_CELLS, n or 1))
    if not n:
        return Cells(own.withColumn("cell", F.lit(0).cast("long")), np.zeros((1, 1)), np.zeros(1), np.zeros(1, np.int64), odd)
    fit = own.select(F.col("node").alias("id"), "vec")
    if n > FIT_ROWS * cells:
        fit = fit.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(n)) < FIT_ROWS * cells)
    fit = checkpointed(fit)
    centres = lloyd(fit, hash_seeds(fit, cells), rounds)
    length = np.sqrt((centres * centres).sum(1, keepdims=True))
    centres = centres / np.where(length > 0, length, 1.0)
    sent = own.sparkSession.sparkContext.broadcast(centres)  # MOST_CELLS vectors

    def run(batches):
        for part in batches:
            if len(part):
                a = _angles(np.stack(part["vec"].to_numpy()), sent.value)
                c = a.argmin(1)
                yield part.assign(cell=c.astype(np.int64), angle=a[np.arange(len(c)), c])

    placed = checkpointed(own.mapInPandas(run, StructType([*own.schema.fields]).add("cell", "long").add("angle", "double")))
    reach, size = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("a"), F.count("*").alias("n")).collect():
        reach[r.cell], size[r.cell] = r.a, r.n
    return Cells(placed.drop("angle"), centres, reach, size, odd)


def _parts(size: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first part and its number of parts: small cells share a part of about ``block`` members, a large
    one is cut into several."""
    first, pieces = np.zeros(len(size), np.int64), np.ones(len(size), np.int64)
    at = held = 0
    for c, n in enumerate(size):
        if held and held + n > block:
            at, held = at + 1, 0
        first[c], pieces[c] = at, max(1, -(-int(n) // block))
        at, held = (at, held + int(n)) if pieces[c] == 1 else (at + int(pieces[c]), 0)
    return first, pieces


def _highest(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` largest finite values to 9 places, ties by column."""
    near = np.round(sim, 9)
    keep = np.isfinite(near)
    if near.shape[1] > k:
        keep &= near >= np.partition(near, near.shape[1] - k, axis=1)[:, -k, None]
    row, col = np.nonzero(keep)
    order = np.lexsort((col, -near[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _compared(one: pd.DataFrame, two: pd.DataFrame, k: int, itself: bool) -> pd.DataFrame:
    """(node, other, sim): the ``k`` best of ``two`` (y, yv, yc) for each of ``one`` (x, xv, xc), among the cells it asks for."""
    found = [pd.DataFrame({"node": np.empty(0, np.int64), "other": np.empty(0, np.int64), "sim": np.empty(0)})]
    if len(one) and len(two):
        two = two.sort_values("y", ignore_index=True)
        ids, members = two["y"].to_numpy(), np.stack(two["yv"].to_numpy()).T
        here, cell = np.unique(two["yc"].to_numpy(), return_inverse=True)
        step = max(1, PRODUCTS // len(two))
        for at in range(0, len(one), step):
            part = one.iloc[at : at + step]
            nodes, sim = part["x"].to_numpy(), np.stack(part["xv"].to_numpy()) @ members
            asks = np.array([np.isin(here, c) for c in part["xc"]])
            if not asks.all():
                sim[~asks[:, cell]] = -np.inf
            if not itself:
                sim[nodes[:, None] == ids[None, :]] = -np.inf
            row, col = _highest(sim, k)
            found.append(pd.DataFrame({"node": nodes[row], "other": ids[col], "sim": sim[row, col]}))
    return pd.concat(found, ignore_index=True)


def _read(own: DataFrame, visits: DataFrame, index: Cells, first: np.ndarray, pieces: np.ndarray, k: int, itself: bool, block: int) -> DataFrame:
    """(node, other, sim): of each visit (node, part, cells) the ``k`` best members of these cells, by blocks of both sides.

    A vector is copied to each part that it visits and not to each cell."""
    spark = own.sparkSession
    asked = {r.part: r.n for r in visits.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a part
    if not asked:
        return spark.createDataFrame([], "node long, other long, sim double")
    cut = F.broadcast(spark.createDataFrame([(int(p), -(-n // block)) for p, n in asked.items()], "part long, na int"))  # a row a part
    homes = F.broadcast(spark.createDataFrame([(c, int(first[c]), int(pieces[c])) for c in range(len(first))], "cell long, first long, pieces int"))  # a row a cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    hashed = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = visits.join(own, "node").join(cut, "part").select(F.col("node").alias("x"), F.col("vec").alias("xv"), F.col("cells").alias("xc"), F.col("part").alias("xb"), hashed("na").alias("xa"))
    right = index.rows.join(homes, "cell").withColumn("part", F.col("first") + hashed("pieces")).join(cut, "part")
    right = right.select(F.col("node").alias("y"), F.col("vec").alias("yv"), F.col("cell").alias("yc"), F.col("part").alias("yb"), every("na").alias("ya"))

    def best(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        return _compared(one, two, k, itself)

    return left.groupBy("xa", "xb").cogroup(right.groupBy("ya", "yb")).applyInPandas(best, "node long, other long, sim double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("node").orderBy(F.desc(F.round("sim", 9)), "other")
    return found.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)


def search(asked: DataFrame, index: Cells, k: int, itself: bool = True, probes: int = 4, exact: bool = True, block: int | None = None, report: dict | None = None) -> DataFrame:
    """(node, other, sim, place): the ``k`` rows of the index with the highest cosine to each of ``asked`` (node, vec), ties
    (to 9 places) by id. ``report`` gets the number of visits of cells in both steps, and of those that were skipped."""
    asked, odd = _split(asked)
    found = _search(asked, index, k, itself, probes, exact, block, report)
    return _with_odd(found, asked, odd, index.rows, index.odd, k, itself)


def _search(asked: DataFrame, index: Cells, k: int, itself: bool, probes: int, exact: bool, block: int | None, report: dict | None) -> DataFrame:
    own = checkpointed(unit(asked))
    if not index.size.any():
        return own.sparkSession.createDataFrame([], "node long, other long, sim double, place long")
    n_asked = own.count()
    # each side is copied once for a block of the other, so blocks grow with the tables
    block = block or int(np.clip(np.sqrt(n_asked * float(index.size.sum()) / LEAST_PAIRS), BLOCK, MOST_BLOCK))
    first, pieces = _parts(index.size, block)
    sent = own.sparkSession.sparkContext.broadcast((index.centres, index.reach, index.size, first, pieces))  # MOST_CELLS rows at most
    live = np.flatnonzero(index.size)
    probes = min(probes, len(live))
    schema = "node long, part long, cells array<int>"

    def slices(batches):
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.iloc[at : at + SLICE]
                a = _angles(np.stack(part["vec"].to_numpy()), sent.value[0])
                a[:, sent.value[2] == 0] = np.inf
                yield part, a, np.argsort(a, axis=1, kind="stable")[:, :probes]

    def listed(nodes, may):
        """A row for each node and part that it visits."""
        first, pieces = sent.value[3:]
        for p in np.unique(first):
            cells = np.flatnonzero(first == p)
            at = np.flatnonzero(may[:, cells].any(1))
            if len(at):
                own = [cells[m].astype(np.int32) for m in may[np.ix_(at, cells)]]
                for piece in range(int(pieces[cells].max())):
                    yield pd.DataFrame({"node": nodes[at], "part": np.full(len(at), p + piece, np.int64), "cells": own})

    def near(batches):
        for part, a, seen in slices(batches):
            may = np.zeros(a.shape, bool)
            np.put_along_axis(may, seen, True, axis=1)
            yield from listed(part["node"].to_numpy(), may)

    visits = checkpointed(own.mapInPandas(near, schema))
    found = checkpointed(_best(_read(own, visits, index, first, pieces, k, itself, block), k))
    if report is not None:
        report["visits"] = n_asked * probes
        report["skipped"] = n_asked * (len(live) - probes)
    if not exact or probes == len(live):
        return found
    # a query with fewer than k neighbours so far has no bound
    bound = found.groupBy("node").agg(F.count("*").alias("n"), F.min("sim").alias("sim")).select("node", F.when(F.col("n") >= k, F.col("sim")).otherwise(-2.0).alias("sim"))
    asking = own.join(bound, "node", "left").na.fill(-2.0, ["sim"])

    def rest(batches):
        reach, size = sent.value[1:3]
        for part, a, seen in slices(batches):
            least = np.cos(np.clip(a - reach[None, :] - SLACK, 0.0, np.pi))  # no member has a larger cosine
            may = (least + SLACK >= part["sim"].to_numpy()[:, None]) & np.isfinite(a)
            # a vector of length 0 has cosine 0 to all, whatever its angle to a centre
            zero = ~np.stack(part["vec"].to_numpy()).any(1)
            may[zero] = (size > 0)[None, :]
            np.put_along_axis(may, seen, False, axis=1)
            yield from listed(part["node"].to_numpy(), may)

    more = checkpointed(asking.mapInPandas(rest, schema))
    if report is not None:
        split = F.broadcast(own.sparkSession.createDataFrame([(int(p),) for p in np.unique(first)], "part long"))  # a large cell counts once
        n = more.join(split, "part").agg(F.coalesce(F.sum(F.size("cells")), F.lit(0))).first()[0]
        report["visits"] += n
        report["skipped"] -= n
    return _best(found.drop("place").unionByName(_read(own, more, index, first, pieces, k, itself, block)), k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: how many neighbours the truth (node, other) has, and the share of them that was found."""
    hit = truth.join(found.select("node", "other", F.lit(1).alias("_hit")), ["node", "other"], "left")
    return hit.agg(F.count("*").alias("n"), F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("recall"))


#: Pairs of blocks up to which all vectors are compared with all; beyond, the inverted file is built first.
FEW_BLOCKS = 16


def nearest(asked: DataFrame, known: DataFrame, k: int, itself: bool = True, block: int = BLOCK) -> DataFrame:
    """``graph.most_similar`` by the cheaper way: the same rows (node, other, sim, place)."""
    pairs = -(-asked.count() // block) * -(-known.count() // block)
    if pairs <= FEW_BLOCKS:
        (one, odd), (two, odd_known) = _split(asked), _split(known)
        return _with_odd(most_similar(one, two, k, itself, block), one, odd, two, odd_known, k, itself)
    return search(asked, build(known), k, itself)

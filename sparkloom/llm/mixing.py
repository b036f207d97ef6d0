"""Mixing sources to target weights by Pfair scheduling.

Time is cut into slots of one block. A source of weight w may start its j-th block from slot floor(j / w) on and must
have it before slot ceil((j + 1) / w); earliest deadline first over the released blocks meets all deadlines while the
weights sum to 1, so at every slot each source is less than one block away from its share. Weights are exact fractions.
The schedule is one sequence: a single task makes it, one step and one row for each block (not document), and the rows
are joined to it.

Within a source, documents are ordered by a hash of their id and cut into blocks of ``block`` documents. Numbers come
from a range-partitioned sort, so a source with a third of the rows is spread over many tasks. Nothing is dropped or
repeated: when a source has run out, the others keep their shares of all slots, and slots that none may take stay empty.

Odd input: null is a source of its own; repeated rows take places of their own; a source that ``weights`` doesn't name
shares what they leave (or the least weight), by size; an empty table gives an empty result. Texts are never read, however
long. Columns of any names come back as they are; ``placed`` gives those that bear one of its new names ``_given`` after it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import checkpointed, has_odd_ids, numbered, set_aside

BLOCK = 16
#: Blocks of the schedule that are made at once.
STEPS = 50_000
#: What ``placed`` adds.
PLACES = ("block", "release", "deadline", "slot", "nth")
#: Without stated weights a source weighs its number of documents to this power.
TEMPER = 0.7


def steps(weights: dict[str, int | float | Fraction], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of all ``blocks`` in the order of slots: earliest deadline first over
    released blocks, ties to the smaller name. Weights are relative and taken exactly."""
    share = {k: Fraction(v) for k, v in weights.items()}
    total = sum(share.values())
    every = {k: (total / v).as_integer_ratio() for k, v in share.items()}  # slots for each block of a source
    waiting = [(0, name, 0) for name in weights if blocks[name]]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []  # deadline, source, block, release
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, name, j = heapq.heappop(waiting)
            n, d = every[name]
            heapq.heappush(ready, (-(-(j + 1) * n // d), name, j, release))
        deadline, name, j, release = heapq.heappop(ready)
        yield name, j, release, deadline, slot
        if j + 1 < blocks[name]:
            n, d = every[name]
            heapq.heappush(waiting, ((j + 1) * n // d, name, j + 1))
        slot += 1


def _planned(weights: dict[str, float], blocks: dict[str, int]):
    def run(batches):
        for batch in batches:
            todo = steps(weights, blocks) if batch.num_rows else iter(())
            while rows := list(islice(todo, STEPS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k else pa.string()) for k, c in enumerate(zip(*rows))], names=["_source", "block", "release", "deadline", "slot"])

    return run


def _key():
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def placed(rows: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """``rows`` (with doc_id and source) and block, release, deadline, slot and nth (place in the block), all from 0.

    The driver gets one row for each source.
    """
    spark = rows.sparkSession
    names = [f"{c}_given" if c in PLACES else c for c in rows.columns]
    rows, _ = set_aside(rows)
    own = rows.withColumn("_source", _key()).withColumn("_hash", F.xxhash64("doc_id"))
    own = numbered(own, ["_source", "_hash", "doc_id"], "_number")
    stats = own.groupBy("_source").agg(F.count("*").alias("n"), F.min("_number").alias("first")).collect()
    if weights is None:
        want = {r["_source"]: r["n"] ** TEMPER for r in stats}
    else:
        named = {("" if k is None else f"={k}"): float(v) for k, v in weights.items() if v > 0}
        want = {r["_source"]: named[r["_source"]] for r in stats if r["_source"] in named}
        others = {r["_source"]: r["n"] for r in stats if r["_source"] not in named}
        left = max(1 - sum(want.values()), min(want.values(), default=1.0))
        want |= {k: left * v / sum(others.values()) for k, v in others.items()}
    blocks = {r["_source"]: -(-r["n"] // block) for r in stats}
    # One row for each source.
    first = F.broadcast(spark.createDataFrame([(r["_source"], r["first"]) for r in stats], "_source string, _first long"))
    plan = spark.range(0, 1, 1, 1).mapInArrow(_planned(want, blocks), "_source string, block long, release long, deadline long, slot long")
    own = own.join(first, "_source").withColumn("block", F.expr(f"(_number - _first) div {block}"))
    own = own.withColumn("nth", F.pmod(F.col("_number") - F.col("_first"), F.lit(block)))
    return own.join(plan, ["_source", "block"]).select(*rows.columns, *PLACES).toDF(*names, *PLACES)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))


def mixed(df: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """All rows of ``df`` in the order of the schedule: partitions follow each other, and rows in a partition do.

    Written as files, the n-th file holds the n-th stretch of the mix.
    """
    df, names = set_aside(df)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if has_odd_ids(df):
        packed = df.select("doc_id", "source", F.struct(*df.columns).alias("_row"))
        both = checkpointed(placed(packed, weights, block)).select("_row.*", F.col("slot").alias("_slot"), F.col("nth").alias("_nth"))
        most = both.agg(F.max("_slot")).first()[0]
    else:  # places are found without the texts and joined to them by id
        places = checkpointed(placed(df.select("doc_id", "source"), weights, block).select(F.col("doc_id").alias("_id"), F.col("slot").alias("_slot"), F.col("nth").alias("_nth")))
        most = places.agg(F.max("_slot")).first()[0]
        both = df.join(places, F.col("doc_id") == F.col("_id"))
    part = F.floor(F.col("_slot") * n / F.lit((most or 0) + 1)).cast("int")
    return both.repartitionById(n, part).sortWithinPartitions("_slot", "_nth").select(*df.columns).toDF(*names)

"""Shared pieces of the llm operators: readers, shared-folder checkpoints, Arrow batches, global row numbers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of text that a Python worker holds as arrays at once; longer texts go alone.
CHUNK_CHARS = 1_000_000
#: Rows that go to a Python worker at once: texts are long, and a batch is held several times over.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_ROWS rows, so that a worker's memory doesn't depend on its default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application inside that of spark.checkpoint.dir; without it only a local session gets one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


#: Columns of documents that operators know by name.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def set_aside(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with all columns but those of KNOWN under names that no operator uses, and its own names, for ``toDF``."""
    return df.toDF(*(c if c in KNOWN else f"_given{i}" for i, c in enumerate(df.columns))), df.columns


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder of spark.checkpoint.dir, which all executors share, and cut its lineage.

    A session without that setting (tests, one machine) gets a temporary folder.
    """
    spark = df.sparkSession
    shared_folder(spark)
    # A checkpoint keeps the constraints of its plan, which Spark can't always carry over to a self-union of it.
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which goes when the process ends.

    Like a checkpoint, but later plans see the size of what was written: the size that Spark guesses for a join is the
    product of its sides', so in a loop of joins over checkpoints the guesses soon take longer than the joins.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    if spark.getActiveSession() is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(path, True)


_holds: dict[str, Callable[[], None]] = {}


def begins(name: str, drop: Callable[[], None] | None = None) -> None:
    """Called where a task of operator ``name`` begins in a Python worker, which serves tasks of one operator after the
    other: what others hold there between tasks is dropped, and its memory goes back to the system. ``drop`` does so for
    ``name``."""
    others = [k for k in _holds if k != name]
    for k in others:
        _holds.pop(k)()
    if drop is not None:
        _holds[name] = drop
    if others:
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # only where the C library is glibc
            pass


def chunks(values: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of ``values`` with about ``limit`` characters each, in order, none empty."""
    start = held = 0
    for i, v in enumerate(values):
        n = len(v) if v is not None else 0
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(values):
        yield start, len(values)


def numbered(df: DataFrame, by: list[str], name: str, key_bits: int = 24) -> DataFrame:
    """Add a dense 0-based row number over the whole table in the order of ``by``, without a one-task sort.

    Rows are range-partitioned and sorted; each partition's first number is the sum of the counts before it.
    The sorted table is checkpointed so that counts and numbers see the same partitions.
    """
    laid = checkpointed(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id()))
    first = laid.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_nth").alias("_least"))
    # One row per partition: the window below is over partitions, not rows.
    first = first.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return laid.join(F.broadcast(first.select("_part", "_least", "_before")), "_part").withColumn(name, F.col("_before") + F.col("_nth") - F.col("_least")).drop("_part", "_nth", "_least", "_before")


def has_odd_ids(docs: DataFrame) -> bool:
    """Whether a doc_id is null or repeated; reads no texts."""
    return not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty()


def ordered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, doc) with a unique ``doc`` in the order of the ids: the id itself, or a row number where ids repeat.

    With row numbers the columns are (doc, doc_id, text).
    """
    own = docs.select("doc_id", "text")
    if has_odd_ids(own):
        rows = numbered(own.withColumn("_fp", F.xxhash64("text")), ["doc_id", "_fp", "text"], "doc")
        return rows.select("doc", "doc_id", "text")
    return own.withColumn("doc", F.col("doc_id").cast("long"))

"""A training corpus in five stages: quality rules, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. ``run`` writes stages to the folder of spark.checkpoint.dir.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import mixing, neardup, pii, quality, spm
from sparkloom.llm.common import shared_folder, small_batches

#: Lattice positions that a worker keeps: less than op5 by itself, as executors still hold what the stages before took.
HELD = 1_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their group's thresholds keep."""
    small_batches(spark)
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets with a similarity of 0.8 or more."""
    small_batches(spark)
    return neardup.without_copies(docs, percent=80, width=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked, and n_chars of the new text."""
    small_batches(spark)
    return pii.masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the schedule."""
    small_batches(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and sampled segmentations of every document.

    Read from files, ``shard`` and ``row`` are a document's file and its place there: the order of the mix.
    """
    small_batches(spark)
    place = []
    if docs.inputFiles():
        shard = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
        docs = docs.select("*", F.when(shard != "", shard.cast("int")).alias("shard"), F.col("_metadata.row_index").alias("row"))
        place = ["shard", "row"]
    rows = spm.encode(docs, keep=("doc_id", "lang", "source", "n_chars", *place), held=HELD)
    return rows.withColumn("n_pieces", (F.length("ids") / 4).cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mix),
    ("tokens", tokens),
]

#: Graph search, learnt patterns and sampling have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    atexit.register(_delete, spark, folder)
    return STAGES[-1][1](spark, docs, sf_dir)


def _delete(spark: SparkSession, folder: str) -> None:
    """The last stage reads the folder when its result is used, so the folder goes when the process ends."""
    if spark.getActiveSession() is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(path, True)

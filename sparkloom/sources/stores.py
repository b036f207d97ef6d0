"""Tables that are kept between runs, under a manifest that names the inputs they were made from.

A store is a folder. A build writes its partitions to a folder of its own and, when all are there, a manifest with the
fingerprint of its inputs; the newest manifest with the asked fingerprint is read, so a build that died is never used and a
changed input builds anew. The manifest is one small Parquet row, written after the data.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, fingerprint string, folder string, partitions array<string>, n_rows long, written double"


def inputs_fingerprint(tables: dict[str, DataFrame], parameters: dict | None = None) -> str:
    """Of the rows of ``tables``, whatever their order or layout, and of ``parameters``."""
    parts = []
    for name in sorted(tables):
        df = tables[name]
        columns = [F.to_json(F.col(c)) if "<" in kind else F.col(c).cast("string") for c, kind in sorted(df.dtypes)]
        row = F.concat_ws("|", *(F.coalesce(c, F.lit("\\N")) for c in columns))
        # two sums of 60 bits of a digest: rows that repeat count as often as they occur
        bits = lambda a: F.conv(F.substring(F.sha2(row, 256), a, 15), 16, 10).cast("decimal(38,0)")  # noqa: E731, B023
        got = df.agg(F.count("*"), F.coalesce(F.sum(bits(1)), F.lit(0)).cast("string"), F.coalesce(F.sum(bits(16)), F.lit(0)).cast("string")).first()
        parts.append([name, sorted(df.dtypes), *got])
    return hashlib.sha256(json.dumps([parts, parameters or {}], sort_keys=True, default=str).encode()).hexdigest()


class Store:
    """Named tables in ``folder``, which all machines must reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()).exists(p)

    def manifest(self, name: str) -> DataFrame | None:
        path = f"{self.folder}/{name}/manifest"
        return self.spark.read.schema(MANIFEST).parquet(path) if self._exists(path) else None

    def found(self, name: str, fingerprint: str) -> DataFrame | None:
        """The table of that fingerprint, or None."""
        rows = self.manifest(name)
        last = rows.where(F.col("fingerprint") == fingerprint).orderBy(F.desc("written")).first() if rows is not None else None
        return self.spark.read.option("basePath", last.folder).parquet(last.folder) if last else None

    def kept(self, name: str, fingerprint: str, build: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
        """The table, and whether it was there; ``build`` is called only if not."""
        if (there := self.found(name, fingerprint)) is not None:
            return there, True
        path = f"{self.folder}/{name}/data-{uuid.uuid4().hex}"
        build().write.partitionBy(*partition_by).parquet(path)
        self._seal(name, fingerprint, path, list(partition_by))
        return self.found(name, fingerprint), False

    def spilled(self, name: str, fingerprint: str, parts: list[str], build: Callable[[str], DataFrame], column: str = "fold") -> DataFrame:
        """A table built part by part (folds, blocks), each written as ``column=part`` when it is done. A part that was written
        whole by an earlier run of the same fingerprint is not built again; the manifest follows the last part."""
        if (there := self.found(name, fingerprint)) is not None:
            return there
        path = f"{self.folder}/{name}/data-{fingerprint[:32]}"
        for part in parts:
            own = f"{path}/{column}={part}"
            if not self._exists(f"{own}/_SUCCESS"):  # a part without it is what a run that died had written
                build(part).drop(column).write.mode("overwrite").parquet(own)
        self._seal(name, fingerprint, path, [column])
        return self.found(name, fingerprint)

    def _seal(self, name: str, fingerprint: str, path: str, partition_by: list[str]) -> None:
        n = self.spark.read.option("basePath", path).parquet(path).count()
        row = [(name, fingerprint, path, partition_by, n, time.time())]
        self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}/manifest")


def score_union(frames: dict[str, DataFrame], keys: list[str], required: list[str] | None = None) -> DataFrame:
    """One score table of several models: a full join by ``keys`` with a column of scores for each, (keys, score) in each
    frame. With ``required`` an error names models that lack rows which another has."""
    out = None
    for name, df in frames.items():
        one = df.select(*keys, F.col("score").alias(f"{name}_score"))
        out = one if out is None else out.join(one, keys, "full")
    if required:
        lacks = out.agg(*(F.sum(F.col(f"{m}_score").isNull().cast("long")).alias(m) for m in required)).first()
        if gaps := {m: lacks[m] for m in required if lacks[m]}:
            raise ValueError(f"rows without a score: {gaps}")
    return out

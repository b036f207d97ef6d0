"""Readers and sinks with explicit schemas and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.scalars import finite
from sparkloom.operators.ordering import numbered

#: Logical schemas of delimited inputs.
INTERACTIONS = T.StructType([T.StructField(n, T.StringType()) for n in ("uid", "target_iid", "item_seq_raw", "item_seq_dedup", "item_seq_counts")])
LABEL_TEMPLATE = T.StructType([T.StructField("test_idx", T.LongType()), T.StructField("label", T.IntegerType())])
ALIASES = {"user_id": "uid", "item_id": "iid"}


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delimited(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header; columns are taken by position in ``schema``."""
    return spark.read.schema(schema).option("header", True).csv(path)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document of dataset facts."""
    return spark.read.json(path, multiLine=True)


def counted_metadata(meta: DataFrame, rows: DataFrame, user: str, item: str) -> DataFrame:
    """One row: num_users and num_items as the document states them, or counted where it doesn't."""
    stated = meta.select(*(F.col(c).cast("long").alias(c) if c in meta.columns else F.lit(None).cast("long").alias(c) for c in ("num_users", "num_items"))).limit(1)
    counts = rows.agg(F.count_distinct(user).alias("_u"), F.count_distinct(item).alias("_i"))
    both = counts.join(stated, how="left", on=F.lit(True))  # one row each
    return both.select(F.coalesce("num_users", "_u").alias("num_users"), F.coalesce("num_items", "_i").alias("num_items"))


def found_root(spark: SparkSession, candidates: list[str], required_files: list[str]) -> str:
    """The one of ``candidates``, or of the folders directly in them, that holds all ``required_files``; an error if none or
    several do. Any file system that Spark reads."""
    conf, path = spark._jsc.sc().hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    fits = []
    for c in dict.fromkeys(candidates):
        fs = path(c).getFileSystem(conf)
        if not fs.exists(path(c)):
            continue
        inside = [x.getPath().toString() for x in fs.listStatus(path(c)) if x.isDirectory()]
        fits += [f for f in (c, *inside) if all(fs.exists(path(f"{f}/{name}")) for name in required_files)]
    if len(fits) != 1:
        raise ValueError(f"{len(fits)} folders hold {required_files}: {fits}")
    return fits[0]


def matrix_vector(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(idx, value) of the one-dimensional array ``name`` in NPZ files: labels and split indices; one task a file."""

    def rows(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0).to_pylist():
                with np.load(io.BytesIO(data)) as z:
                    v = z[name].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v)], names=["idx", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "idx long, value long")


def renamed(df: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Alternative column names under their usual ones."""
    return df.withColumnsRenamed({a: b for a, b in aliases.items() if a in df.columns and b not in df.columns})


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``'s ``columns`` in that order; an error names those that it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def unique_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, or an error if a key occurs twice: the guard of a many-to-one join."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"duplicate keys in {keys}")
    return df


def matrix_edges(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(row, col, value) of the compressed sparse row matrix ``prefix`` in NPZ files; one task a file."""

    def rows(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0).to_pylist():
                with np.load(io.BytesIO(data)) as z:
                    ptr = z[f"{prefix}_indptr"]
                    src = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
                    yield pa.RecordBatch.from_arrays([pa.array(src.astype(np.int64)), pa.array(z[f"{prefix}_indices"].astype(np.int64)), pa.array(z[f"{prefix}_data"].astype(np.float64))], names=["row", "col", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "row long, col long, value double")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: number of rows and, as a string, the sum of the first 60 bits of each row's SHA-256, whatever the order.

    A row is its values as strings between bars, null as backslash N, so that any engine can give the expected sum."""
    row = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns))
    part = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("fingerprint"))


def complete(df: DataFrame, column: str) -> DataFrame:
    """``df``, or an error if ``column`` is null anywhere."""
    if not df.where(F.col(column).isNull()).isEmpty():
        raise ValueError(f"{column} is incomplete")
    return df


def frozen_dimension(nodes: DataFrame, dimension: DataFrame, key: str, column: str) -> DataFrame:
    """``nodes`` with ``column`` of a table that was written once; an error if a node has no value there."""
    return complete(nodes.join(unique_keys(dimension.select(key, column), [key]), key, "left"), column)


def label_sheet(template: DataFrame, predicted: DataFrame, key: str = "test_idx", order: str = "row_id", whole: bool = False) -> DataFrame:
    """The template's keys in its order with predicted labels; with ``whole`` an error unless keys and predictions match."""
    if whole:
        n, m, both = template.count(), predicted.count(), template.join(unique_keys(predicted, [key]).select(key), key, "left_semi").count()
        if not n == m == both:
            raise ValueError(f"{n} keys, {m} predictions, {both} in both")
    return template.drop("label").join(predicted.select(key, "label"), key, "left").orderBy(order)


def list_sheet(template: DataFrame, lists: DataFrame, default: list[str]) -> DataFrame:
    """uid and its list joined by commas; users without a list get the default."""
    joined = template.join(lists.select("uid", "items"), "uid", "left")
    return joined.withColumn("prediction", F.concat_ws(",", F.coalesce("items", F.array(*map(F.lit, default))))).drop("items")


def ranked_lists(sheet: DataFrame, key: str = "uid") -> DataFrame:
    """(key, place, iid): a sheet of lists joined by commas, read back; blank tokens take no place."""
    items = F.filter(F.transform(F.split(F.coalesce("prediction", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return sheet.select(key, F.posexplode(items).alias("p", "iid")).select(key, (F.col("p") + 1).cast("long").alias("place"), "iid")


def reindexed(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys`` and ``columns`` in that order as doubles: columns that are missing, nulls, NaN and infinities become 0."""
    return df.select(*keys, *(finite(F.col(c)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns))


def wide_lists(lists: DataFrame, k: int = 10) -> DataFrame:
    """uid, top1 to topk; places that a list lacks hold 0."""
    return lists.select("uid", *(F.coalesce(F.get("items", F.lit(i)), F.lit("0")).alias(f"top{i + 1}") for i in range(k)))


def row_numbers(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Dense 0-based row numbers in the order of ``order``, without a one-task sort."""
    return numbered(df, order, name)

from pyspark.sql import functions as F

from sparkloom.operators.stats import counted
from sparkloom.streaming import counts


def test_counts_of_a_stream_match_a_batch(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 3).cast("string").alias("a"), (F.col("id") % 7).cast("string").alias("b"))
    src = str(tmp_path / "in")
    rows.where("a = '0'").write.parquet(src)
    of = lambda df: counted(df, "move", F.col("a"), F.col("b"))
    for part in ("a <> '0'", None):
        stream = spark.readStream.schema(rows.schema).parquet(src)
        counts.maintain(stream, of, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        if part:
            rows.where(part).write.mode("append").parquet(src)
    got = {(r.key, r.iid): r.cnt for r in counts.current(spark, str(tmp_path / "out")).collect()}
    assert got == {(r.key, r.iid): r.cnt for r in of(rows).collect()}
    both = counts.merged(of(rows), of(rows)).collect()
    assert all(r.cnt == 2 * got[(r.key, r.iid)] for r in both)

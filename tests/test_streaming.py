"""Streams against the same rows in a batch."""

from pyspark.sql import functions as F

from lithic.operators import profile
from lithic.streaming import profile as streamed


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 7).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("v"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streamed.profile_batches(stream.select("k", "v"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = streamed.totals(spark.read.parquet(str(tmp_path / "out")))
    want = profile.frequencies(rows.select("k", "v"))
    assert rows_of(got.select("column", "value", "n")) == rows_of(want.select("column", "value", "n"))
    query = streamed.windowed(stream, "ts", "v", ["k"], late="1 day").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows_of(spark.table("w")) == rows_of(streamed.windowed(rows, "ts", "v", ["k"]))

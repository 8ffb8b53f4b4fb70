"""Profiles of streams: windowed counts with late data, and column profiles kept up to date per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lithic.operators import profile


def windowed(stream: DataFrame, at: str, value: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, by..., n, nulls, low, high, mean) per tumbling window; rows later than ``late`` are dropped by the watermark."""
    window = F.window(at, width)
    grouped = stream.withWatermark(at, late).groupBy(window, *by)
    got = grouped.agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("nulls"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))
    return got.select(F.col("window.start").alias("start"), *by, "n", "nulls", "low", "high", "mean")


def profile_batches(stream: DataFrame, target: str, checkpoint: str, columns: list[str] | None = None) -> StreamingQuery:
    """Writes the value counts of each micro-batch under its number; rerun batches replace themselves.

    :func:`totals` adds the counts up: they merge exactly, which no finished statistic would.
    """

    def put(batch: DataFrame, number: int) -> None:
        profile.frequencies(batch, columns).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(counts: DataFrame) -> DataFrame:
    """(ordinal, column, kind, value, n) over all batches."""
    return counts.groupBy("ordinal", "column", "kind", "value").agg(F.sum("n").alias("n"))

"""Connected components, and numbers for rows in an order, without a task that sees all rows."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder that the cluster names, so that they are not computed again.

    Without such a folder, which only local runs lack, they are kept by the block manager.
    """
    if df.sparkSession.conf.get("spark.checkpoint.dir", None):
        return df.checkpoint()
    if not df.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return df.persist()


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """As ``cut``, for rounds of which only the last is wanted: the rows as Parquet, and what removes them.

    Numbers take a fraction of the bytes of a checkpoint, whose files go only some time after
    the rows are forgotten. What is not removed before goes when the driver ends.
    """
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        rows = cut(df)
        return rows, rows.unpersist
    path = f"{named}/lithic-round-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def remove() -> None:
        atexit.unregister(remove)
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone at exit
            pass

    atexit.register(remove)
    return spark.read.schema(df.schema).parquet(path), remove


def components(edges: DataFrame) -> DataFrame:
    """From (u, v) to (node, label): the least node that each reaches.

    Every round hangs each node's larger neighbours on its least one, then its smaller ones:
    a path of n nodes takes rounds by the logarithm of n, not n. Nodes with very many
    neighbours are reduced before the shuffle.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = cut(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        sides = both(now)
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        hung = sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = hung.groupBy("a").agg(F.min("b").alias("m"))
        lower = hung.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(lower.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now.unpersist()
        now = after
        if state == seen:
            break
        seen = state
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(tops)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with numbers from 0 in an order.

    Rows are sorted in ranges; the sizes of the ranges, a row per partition, give each
    range its first number.
    """
    rows = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    joined = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")  # a row per partition
    return joined.withColumn(name, (F.col("_start") + place).cast("long")).drop("_part", "_start", "_at")

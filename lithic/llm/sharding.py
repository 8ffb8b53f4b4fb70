"""Shards by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithic.llm.common import staged

#: Fan-out of the slot numbering inside a shard.
BUCKETS = 256


def jump(key: Column, shards: int) -> Column:
    """Struct (shard, next): the bucket of ``key`` among ``shards``, and where it jumps next.

    The chain starts in bucket 0. From bucket b it jumps to floor((b + 1) / r) with r in
    (0, 1] drawn from the key and b; the last bucket below ``shards`` is the answer. With
    one more shard only keys whose next jump is exactly ``shards`` move, all to that shard.
    A chain visits each bucket at most once, so ``shards`` steps always suffice.
    """
    chain = F.struct(F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))

    def step(at: Column, _: Column) -> Column:
        here = at["next"]
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("#"), here.cast("string"))), 1, 13), 16, 10).cast("long")
        draw = (bits + 1) / F.lit(float(2**52))
        return F.when(here < shards, F.struct(here.alias("shard"), F.floor((here + 1) / draw).alias("next"))).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), chain, step)


def shard(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its shard under the `key` law.

    Columns: the key, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard,
    slot (0, 1, ... without gaps in each shard), grown_shard (with one more shard).

    Null text counts as empty; a null key is a key of its own; repeated rows share a
    shard and take different slots; an empty table gives an empty result. Other columns
    are ignored, whatever their names. Slots are numbered in two levels: rows are counted
    by shard and hash bucket, counts are summed up over at most shards * BUCKETS rows, and
    only rows of one bucket are numbered together. The bucket hashes the text's checksum
    too, so that one repeated key does not fill one bucket.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("jump", jump(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), shards))
    rows = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("jump.shard").cast("int").alias("shard"),
        F.when(F.col("jump.next") == shards, F.lit(shards)).otherwise(F.col("jump.shard")).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    rows = staged(rows, "shards")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").count()
    starts = starts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    here = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("n", F.row_number().over(here))
    return numbered.join(F.broadcast(starts), ["shard", "bucket"]).select(  # at most shards * BUCKETS rows
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("n") - 1).cast("long").alias("slot"),
        "grown_shard",
    )

"""Pairs of rows with an equal key, in tiles of bounded size.

A block (the rows of one key) of n rows has about n * n / 2 pairs, and a join on the key
leaves them to one task. Here a block above a side length is cut into slices, and pairs of
slices are tiles of their own: a square of tiles between two tables, a triangle inside one,
whose slices are ranges of the index, so that only tiles on the diagonal hold pairs that do
not count.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slices of a block at most; rows of a slice at least and at most; pairs of a task; cut blocks that may be broadcast.
SLICES, LEAST, MOST, TASK_PAIRS, BLOCKS = 256, 64, 2048, 4_000_000, 10_000


def _small(info: DataFrame) -> DataFrame:
    """Facts of cut blocks, broadcast if they are few; else joined as they come, and adaptive execution splits the hot side."""
    return F.broadcast(info) if info.limit(BLOCKS + 1).count() <= BLOCKS else info


def _slices(n: str, side: int) -> Column:
    return F.least(F.lit(SLICES), F.ceil(F.col(n) / side).cast("int"))


def pair_join(x: DataFrame, y: DataFrame | None, pairs: int, key: str = "key", i: str = "i", j: str = "j", sizes: DataFrame | None = None) -> DataFrame:
    """All columns of ``x`` and ``y`` (but ``y``'s key) for rows with an equal, non-null key.

    Without ``y`` pairs are taken within ``x``, those with i < j, and the second row's columns
    have ``_2`` appended. ``pairs`` is how many pairs there are; it gives the number of tasks
    and the side of a tile. ``sizes``, if known, is (key, _n, _m): the rows of each key in
    ``x`` and in ``y``.
    """
    spark = x.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS))
    side = max(LEAST, min(MOST, isqrt(max(1, pairs // (2 * tasks)))))
    x = x.where(F.col(key).isNotNull())
    if y is None:
        left, right = _triangle(x, key, i, side)
        right = right.withColumnsRenamed({c: f"{c}_2" for c in x.columns if c != key})
        below = F.col(i) < F.col(f"{i}_2")
    else:
        left, right = _square(x, y.where(F.col(key).isNotNull()), key, i, j, side, sizes)
        below = F.lit(True)
    # A number of partitions of one's own: tiles are small in bytes and would be put together.
    left = left.repartition(tasks, F.col(key), F.col("_tile"))
    right = right.repartition(tasks, F.col(key), F.col("_tile"))
    return left.join(right, [key, "_tile"]).where(below).drop("_tile")


def _triangle(x: DataFrame, key: str, i: str, side: int) -> tuple[DataFrame, DataFrame]:
    cuts = F.approx_percentile(i, [k / SLICES for k in range(1, SLICES)], 10 * SLICES)
    large = x.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > side)
    info = x.join(_small(large), key).groupBy(key).agg(cuts.alias("_cuts"), F.first("_n").alias("_n")).select(key, "_cuts", _slices("_n", side).alias("_s"))
    rows = x.join(_small(info), key, "left")
    own = F.floor(F.size(F.filter("_cuts", lambda c: c < F.col(i))) * F.col("_s") / SLICES).cast("int")
    rows = rows.withColumn("_s", F.coalesce("_s", F.lit(1))).withColumn("_own", F.coalesce(own, F.lit(0))).drop("_cuts")
    left = rows.withColumn("_tile", F.explode(F.transform(F.sequence(F.col("_own"), F.col("_s") - 1), lambda k: F.col("_own") * SLICES + k)))
    right = rows.withColumn("_tile", F.explode(F.transform(F.sequence(F.lit(0), F.col("_own")), lambda k: k * SLICES + F.col("_own"))))
    return left.drop("_s", "_own"), right.drop("_s", "_own")


def _square(x: DataFrame, y: DataFrame, key: str, i: str, j: str, side: int, sizes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    if sizes is None:
        sizes = x.groupBy(key).agg(F.count("*").alias("_n")).join(y.groupBy(key).agg(F.count("*").alias("_m")), key)
    info = _small(sizes.where((F.col("_n") > side) | (F.col("_m") > side)).select(key, _slices("_n", side).alias("_a"), _slices("_m", side).alias("_b")))
    out = []
    for rows, index, own, other in ((x, i, "_a", "_b"), (y, j, "_b", "_a")):
        rows = rows.join(info, key, "left").withColumn("_a", F.coalesce("_a", F.lit(1))).withColumn("_b", F.coalesce("_b", F.lit(1)))
        rows = rows.withColumn("_own", F.pmod(F.xxhash64(index), F.col(own)).cast("int"))
        tile = (lambda k: F.col("_own") * SLICES + k) if own == "_a" else (lambda k: k * SLICES + F.col("_own"))
        out.append(rows.withColumn("_tile", F.explode(F.transform(F.sequence(F.lit(0), F.col(other) - 1), tile))).drop("_a", "_b", "_own"))
    return out[0], out[1]

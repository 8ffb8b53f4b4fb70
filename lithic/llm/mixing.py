"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithic.llm.common import staged, word_count

#: Most copies of a document on average, and so the most that a source can grow.
MOST = 3
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From rows (source, source_size) to rows with target and rate (expected copies).

    Sources in code point order, null last, take the weights in turn and share the sum of
    all sizes. A target stops at ``most`` times its source's size; what is over is shared
    again by weight. The fixed point has one level L with target = min(most * size, L *
    weight): sources sorted by most * size / weight are capped up to the first one whose
    cap is above the level that the rest would get.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    rows = rows.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))).alias("left"),
        F.sum("weight").over(onward).alias("weights"),
    )
    fits = F.col("left") * F.col("weight") <= F.col("cap") * F.col("weights")
    level = F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.col("left"), F.col("weights")))).over(everything)
    rows = rows.withColumn("level", level)
    share = F.col("level.left") * F.col("weight") / F.col("level.weights")
    target = F.least(F.col("cap").cast("double"), share)
    rows = rows.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return rows.select("source", "source_size", "target", rate.alias("rate"))


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source: a multiple of 2 ** -20 in [0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\u0000null")))), 1, 5), 16, 10)
    return bits.cast("double") / F.lit(float(2**20))


def size_class(size: Column) -> Column:
    """A size without all bits but the first four: documents are dealt in this order."""
    bits = F.length(F.bin(size))
    return F.when(bits <= 4, size).otherwise(bits * 16 + F.expr("cast(shiftrightunsigned(size, greatest(length(bin(size)) - 4, 0)) as bigint)")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document with the number of copies that the mix takes.

    Columns: doc_id, size (words), source_size, target (of its source), copies, taken
    (copies * size), and those of ``docs`` that ``carry`` names.

    Documents of a source stand in order of size class and a hash of their id. Each has
    the same expected copies, at most ``most``; their running sum plus the source's offset
    is cut at the integers, and a document is emitted once per integer it crosses. So a
    source's taken words come near its target in every size class, and no document comes
    more than ``most`` times. Null text has size 0, a null source is a source, equal rows
    are interchangeable, an empty table gives an empty result, other columns are ignored.

    Ranks are made in two levels, so no task gets a whole source: rows are counted by
    source, size class and two digits of the hash; only these counts are summed up, and
    meet the rows where these are ranked, so that the columns of ``carry`` are shuffled
    once. With ``carry`` documents are read twice, else their sizes are staged.
    """
    rows = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
        *[F.col(c).alias(f"kept_{c}") for c in carry],
    )
    draw = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    rows = rows.select("*", size_class(F.col("size")).alias("class"), draw.alias("draw")).withColumn("part", F.substring("draw", 1, 2))
    if not carry:
        rows = staged(rows, "mix")
    parts = rows.groupBy("source", "class", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("words"))
    if carry:
        parts = staged(parts, "parts")
    rates = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    earlier = Window.partitionBy("source").orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "class", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    starts = starts.alias("s").join(rates.alias("r"), F.col("s.source").eqNullSafe(F.col("r.source"))).select("s.*", "r.source_size", "r.target", "r.rate")
    named, sourceless = F.coalesce("source", F.lit("")).alias("named"), F.col("source").isNull().alias("sourceless")
    keys = ["named", "sourceless", "class", "part"]  # of window and join, so that both take one shuffle
    inside = Window.partitionBy(*keys).orderBy("draw", "doc_id", "size")
    ranked = rows.select("*", named, sourceless).withColumn("n", F.row_number().over(inside) - 1)
    starts = starts.select(named, sourceless, "class", "part", "source_size", "target", "rate", "start")
    placed = ranked.join(starts, keys).withColumn("rank", F.col("start") + F.col("n"))
    u = offset(F.col("source"), seed)
    copies = (F.floor((F.col("rank") + 1) * F.col("rate") + u) - F.floor(F.col("rank") * F.col("rate") + u)).cast("long")
    return placed.withColumn("copies", copies).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"kept_{c}").alias(c) for c in carry]
    )


def oracle(weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7) -> str:
    """DuckDB SQL for ``mix``: the same order and offsets, with plain windows."""
    picked = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw FROM documents),
c AS (SELECT *, CASE WHEN length(bin(size)) <= 4 THEN size ELSE length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) END AS class FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {picked} END AS weight, source_size * {most} AS cap FROM s),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w WINDOW r AS (ORDER BY cap / weight, source NULLS LAST)),
f AS (SELECT rest, weights FROM l WHERE rest * weight <= cap * weights ORDER BY cap / weight, rest, weights LIMIT 1),
t AS (SELECT l.source, l.source_size, CASE WHEN l.source_size > 0 THEN least(CAST(l.cap AS DOUBLE), CAST(f.rest * l.weight AS DOUBLE) / CAST(f.weights AS DOUBLE)) ELSE 0.0 END AS target,
  CAST('0x' || substr(md5('{seed}:' || coalesce(l.source, chr(0) || 'null')), 1, 5) AS BIGINT) / 1048576.0::DOUBLE AS u FROM l, f),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, draw, doc_id, size) - 1 AS rank FROM c),
j AS (SELECT r.doc_id, r.size, t.source_size, t.target, t.u, r.rank, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST(floor((rank + 1) * rate + u) - floor(rank * rate + u) AS BIGINT) AS copies FROM j)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM k
"""

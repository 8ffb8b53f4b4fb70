"""Values at given ranks of weighted numbers, exact for any number of values and any ties.

Numbers are reduced to distinct ones with their counts. Beyond one buffer they are counted in
ranges; for each wanted rank the ranges that can hold it are known from the counts alone, and
only their numbers are looked at, in narrower ranges again until few are left. The same
ranges serve the gaps around a centre: a range of numbers is a range of gaps, so the median
gap is found from both sides of the centre without a table of gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithic.operators.graph import cut

#: Ranges that numbers are counted in, and numbers around a rank that one task may order.
RANGES, FEW = 256, 1_000_000


def distinct(freq: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(by, x, n): the distinct numbers of each key with their counts; texts such as 1 and 1.0 are one number."""
    rows = freq.select(*by, value.cast("double").alias("x"), "n").where("x IS NOT NULL")
    return rows.groupBy(*by, "x").agg(F.sum("n").alias("n"))


def ranged(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the number of the range that ``x`` lies in; equal numbers share a range."""
    cuts = rows.groupBy(*by).agg(F.approx_percentile("x", [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("_cuts"))
    kinds = dict(rows.dtypes)
    found = rows.sparkSession.createDataFrame([tuple(r) for r in cuts.collect()], ", ".join([*[f"{c} {kinds[c]}" for c in by], "_cuts array<double>"]))  # a row per key; kept, since another run may cut elsewhere
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(RANGES.bit_length()))])  # a search by halves: how many cuts lie below
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("_cuts", at + step - 1) < F.col("x"), at + step).otherwise(at))
    return rows.join(F.broadcast(found), by).withColumn("range", below).drop("_cuts")


def at_ranks(rows: DataFrame, by: list[str], wanted: DataFrame) -> DataFrame:
    """(by, i, x): the value at each wanted rank.

    ``rows`` are (by, range, x, n) as ``ranged`` gives them; ``wanted`` is (by, i, rank) with
    ranks from 0. With a column ``centre`` in ``wanted`` ranks count distances from it.
    """
    keys, centred = [*by, "i"], "centre" in wanted.columns
    few = cut(_around(rows, by, wanted, centred))
    while (few.groupBy(*keys).agg(F.count("*").alias("held")).agg(F.max("held")).first()[0] or 0) > FEW:
        again = cut(ranged(few.select(*keys, F.col("y").alias("x"), "n"), keys))
        heads = few.groupBy(*keys).agg((F.first("rank") - F.first("before")).alias("rank"))
        few = cut(_around(again, keys, heads, False))
    one = few.groupBy(*keys, "rank", "before", "y").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    end = one.withColumn("end", F.col("before") + F.sum("n").over(upto))
    return end.where((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("n"))).select(*keys, F.col("y").alias("x"))


def _around(rows: DataFrame, by: list[str], wanted: DataFrame, centred: bool) -> DataFrame:
    """(by, i, rank, before, y, n): the numbers of the ranges that can hold a wanted rank, and how many lie before all of them.

    In the order of upper ends the first range whose running count passes the rank bounds the
    value from above, in the order of lower ends from below. A range of numbers on both sides
    of the centre begins at distance 0.
    """
    keys = list(dict.fromkeys([*by, "i"]))
    gap = lambda c: F.abs(F.col(c) - F.col("centre")) if centred else F.col(c)
    counts = rows.groupBy(*by, "range").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("n").alias("held"))
    told = counts.join(F.broadcast(wanted), by).withColumn("hi", F.greatest(gap("low"), gap("high")))  # RANGES rows a key
    least = F.least(gap("low"), gap("high"))
    told = told.withColumn("lo", F.when((F.col("low") <= F.col("centre")) & (F.col("centre") <= F.col("high")), 0.0).otherwise(least) if centred else least)
    upto = lambda c: F.sum("held").over(Window.partitionBy(*keys).orderBy(c).rangeBetween(Window.unboundedPreceding, 0))
    told = told.withColumn("upto_hi", upto("hi")).withColumn("upto_lo", upto("lo"))
    whole = Window.partitionBy(*keys)
    told = told.withColumn("most", F.min(F.when(F.col("upto_hi") > F.col("rank"), F.col("hi"))).over(whole)).withColumn("least", F.min(F.when(F.col("upto_lo") > F.col("rank"), F.col("lo"))).over(whole))
    told = told.withColumn("before", F.sum(F.when(F.col("hi") < F.col("least"), F.col("held")).otherwise(0)).over(whole))
    near = told.where("hi >= least AND lo <= most").select(*keys, "range", "rank", "before", *(["centre"] if centred else []))
    return rows.join(F.broadcast(near), [*by, "range"]).select(*keys, "rank", "before", gap("x").alias("y"), "n")  # few ranges a rank


def quantiles(rows: DataFrame, by: list[str], shares: tuple[float, ...], centres: DataFrame | None = None) -> DataFrame:
    """(by, q): interpolated quantiles of ranged numbers, or of their distances from ``centre`` in (by, centre).

    Share s lies at rank (N - 1) * s, between the ranks below and above.
    """
    totals = rows.groupBy(*by).agg(F.sum("n").alias("total"))
    if centres is not None:
        totals = totals.join(centres, by)
    sides = [F.struct(F.lit(2 * i + j).alias("i"), rank.alias("rank"), share.alias("share")) for i, s in enumerate(shares) for j, (rank, share) in enumerate(_sides(s))]
    wanted = totals.select("*", F.explode(F.array(*sides)).alias("w")).select(*totals.columns, "w.*").drop("total")
    found = at_ranks(rows, by, wanted.drop("share")).join(wanted.select(*by, "i", "share"), [*by, "i"])
    each = found.select(*by, F.floor(F.col("i") / 2).alias("i"), (F.col("x") * F.col("share")).alias("x")).groupBy(*by, "i").agg(F.sum("x").alias("x"))
    return each.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("q"))


def median_gap(rows: DataFrame, by: list[str], centres: DataFrame) -> DataFrame:
    """(by, mad): the median of the distances of ranged numbers from ``centre`` in (by, centre)."""
    return quantiles(rows, by, (0.5,), centres).select(*by, F.col("q")[0].alias("mad"))


def _sides(share: float) -> list[tuple[Column, Column]]:
    """The two ranks around a share of ``total``, and how much each counts."""
    at = (F.col("total") - 1) * share
    low = F.floor(at).cast("long")
    return [(low, 1 - (at - low)), (F.least(low + 1, F.col("total") - 1), at - low)]

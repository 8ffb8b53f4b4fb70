"""Values at ranks by counted ranges, against sorted lists, with ties, weights, symmetric and single values."""

import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithic.functions import types
from lithic.operators import profile, ranks

BY = ["ordinal", "column"]
SHARES = (0.0, 0.05, 0.25, 0.5, 0.9, 1.0)


def columns():
    draw = random.Random(7)
    return {
        "whole": [float(x) for x in range(1, 1002)],
        "twice": [float(x) for x in range(100) for _ in range(2)],
        "tied": [round(draw.gauss(0, 3)) / 2 for _ in range(4000)],
        "mirrored": [s * float(x) for x in range(1, 400) for s in (1, -1)],
        "one": [4.0] * 3,
        "two": [0.0, 1.0],
        "skewed": [draw.choice([0.0, 0.0, draw.expovariate(1)]) for _ in range(3000)],
    }


@pytest.mark.parametrize("few, wide", [(1_000_000, 256), (20, 8)])
def test_ranks(spark, monkeypatch, few, wide):
    """Also where ranges are narrowed several times, since few numbers may stand around a rank."""
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "RANGES", wide)
    found = columns()
    rows = [(i, c, x, 1) for i, (c, xs) in enumerate(found.items()) for x in xs]
    freq = spark.createDataFrame(rows, "ordinal int, column string, value double, n long")  # a row for each number, ties among them
    numbers = ranks.ranged(ranks.distinct(freq, BY, F.col("value")), BY).persist()
    got = {r.column: r.q for r in ranks.quantiles(numbers, BY, SHARES).collect()}
    for c, xs in found.items():
        assert got[c] == pytest.approx(np.quantile(xs, SHARES).tolist()), c
    centres = spark.createDataFrame([(i, c, median(xs)) for i, (c, xs) in enumerate(found.items())], "ordinal int, column string, centre double")
    gaps = {r.column: r.mad for r in ranks.median_gap(numbers, BY, centres).collect()}
    for c, xs in found.items():
        assert gaps[c] == pytest.approx(median(abs(x - median(xs)) for x in xs)), c
    numbers.unpersist()


def test_profiles_do_not_turn_on_size(spark, monkeypatch):
    """One buffer and counted ranges give equal profiles, texts that spell one number in two ways among them."""
    draw = random.Random(3)
    rows = [(draw.randrange(-500, 500), draw.choice(["1", "1.0", "1.00", str(draw.randrange(-900, 400)), str(draw.gauss(0, 5))]), round(draw.gauss(0, 2), 1)) for _ in range(2000)]
    df = spark.createDataFrame(rows + [(10**6, "77777", 99.0)] * 3, "a int, b string, c double")
    shown = lambda: [[round(x, 9) if isinstance(x, float) else x for x in r] for r in profile.column_profiles(df).orderBy("ordinal").collect()]
    one = shown()
    monkeypatch.setattr(profile, "BUFFERED", 10)
    assert shown() == one
    assert one[0][profile.column_profiles(df).columns.index("outliers_mad")] > 0


def test_values_are_counted_before_they_are_spelled(spark):
    """Zeros of both signs are two texts, moments of one second one; only three numbers with signs between may be a date."""
    rows = [(0.0, "2024-01-01 10:00:00.1", "7"), (-0.0, "2024-01-01 10:00:00.9", "2024-1-5"), (0.0, "2024-01-02 00:00:00", "5/1/2024"), (1.5, "2024-01-02 00:00:00", "12345678"), (float("nan"), None, "1-2")]
    df = spark.createDataFrame(rows, "x double, t string, d string").withColumn("t", F.col("t").cast("timestamp"))
    got = sorted((r.column, str(r.value), r.n) for r in profile.frequencies(df, ["x", "t"]).collect())
    assert got == [("t", "2024-01-01T10:00:00", 2), ("t", "2024-01-02", 2), ("t", "None", 1), ("x", "-0.0", 1), ("x", "0.0", 2), ("x", "1.5", 1), ("x", "NaN", 1)]
    assert [r.a for r in df.select(types.is_date(F.col("d")).alias("a")).collect()] == [False, True, True, False, False]


def test_ranges_are_found_by_halves(spark):
    """The plan looks at a handful of cuts for each number, not at all of them."""
    freq = spark.range(2000).select(F.lit(0).alias("ordinal"), F.lit("c").alias("column"), F.col("id").cast("double").alias("value"), F.lit(1).alias("n"))
    rows = ranks.ranged(ranks.distinct(freq, BY, F.col("value")), BY)
    assert "filter(_cuts" not in rows._jdf.queryExecution().analyzed().toString()
    each = rows.groupBy("range").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("range").collect()
    assert len(each) > 200 and all(a.high < b.low for a, b in zip(each, each[1:]))

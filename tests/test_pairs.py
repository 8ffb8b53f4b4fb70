"""Pairs in tiles: the same pairs as a plain join, spread over tasks however large a block is."""

import random
from math import comb

import pytest
from pyspark.sql import functions as F

from lithic.operators import linkage, pairs


def table(spark, sizes, seed, index="_row_index"):
    draw = random.Random(seed)
    keys = [k for k, n in sizes.items() for _ in range(n)]
    draw.shuffle(keys)
    return spark.createDataFrame([(n, k) for n, k in enumerate(keys)], f"{index} long, key string")


def test_tiles_hold_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "LEAST", 4)
    a = table(spark, {"hot": 90, "warm": 11, "one": 1, "b": 3, None: 5}, 1)
    b = table(spark, {"hot": 7, "warm": 60, "other": 4, None: 2}, 2)
    got = sorted(map(tuple, linkage.candidates(a, None).collect()))
    plain = a.alias("x").join(a.alias("y"), F.expr("x.key = y.key AND x._row_index < y._row_index")).select("x._row_index", "y._row_index")
    assert got == sorted(map(tuple, plain.collect())) and len(got) == comb(90, 2) + comb(11, 2) + comb(3, 2)
    got = sorted(map(tuple, linkage.candidates(a, b).collect()))
    assert got == sorted(map(tuple, a.join(b.withColumnRenamed("_row_index", "j"), "key").select("_row_index", "j").collect())) and len(got) == 90 * 7 + 11 * 60
    assert linkage.candidates(a.limit(0), None).count() == linkage.candidates(a, b.limit(0)).count() == 0


def test_a_hot_block_is_spread(spark):
    """One block of 10,000 rows: no task makes more than three times the mean of the pairs."""
    rows = spark.range(10_000).select(F.col("id").alias("i"), F.lit("x").alias("key"))
    joined = pairs.pair_join(rows, None, comb(10_000, 2))
    each = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(each) == comb(10_000, 2) and len(each) >= 10 and max(each) <= 3 * sum(each) / len(each)


def test_scores_without_a_text_mapping(spark):
    a = spark.range(300).select(F.col("id").alias("_row_index"), (F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 7).alias("y"))
    near = linkage.Config([linkage.Mapping("x", "x", "numeric_tolerance", important=True)], threshold=1.0)
    assert linkage.scores(a, None, near).count() == 50 * comb(6, 2)
    odd = linkage.Config([linkage.Mapping("x", "y", "numeric_tolerance", important=True)], threshold=1.0)
    want = sum(1 for i in range(300) for j in range(i + 1, 300) if i % 50 == j % 7)
    assert linkage.scores(a, None, odd).count() == want
    blocked = linkage.block(a, None, near)
    assert blocked.pairs == comb(300, 2) and linkage.scores(a, None, near, blocked=blocked).count() == 50 * comb(6, 2)
    blocked.release()


def test_rows_alike_need_no_pairs_of_their_own(spark):
    """Clusters from the ends of classes of equal values are those from all pairs."""
    draw = random.Random(5)
    rows = [(n, draw.choice("abc"), draw.choice([1.0, 2.0, 2.5, 30.0, 31.9, 33.9, 60.0]) + draw.choice([0, 0, 100 * draw.randrange(20)])) for n in range(150)] + [(500, None, 1.0), (501, "a", None), (502, "a", float("nan"))]
    df = spark.createDataFrame(rows, "_row_index long, key string, value double").repartition(4)
    x, y = df.alias("x"), df.alias("y")
    gap = F.abs(F.col("x.value") - F.col("y.value"))
    plain = x.join(y, F.expr("x.key = y.key AND x._row_index < y._row_index") & (gap <= 2)).select(F.col("x._row_index").alias("i"), F.col("y._row_index").alias("j"), (1 - gap / 10).alias("score"))
    alike, links = linkage.near_values(df, "key", "value", 2)
    standing = linkage.standing_pairs(links, 1 - F.col("gap") / 10)
    assert 0 < standing.count() < plain.count()
    shown = lambda c: [tuple(r)[:5] for r in c.orderBy("cluster_index").collect()]
    for merge in (False, True):
        assert shown(linkage.clusters(standing, merge, alike)) == shown(linkage.clusters(plain, merge))


def test_few_edits_above_the_cap(spark):
    """Above the cap only texts few edits apart are compared; the pairs are those without a cap."""
    draw = random.Random(6)
    words = ["Supplier#" + "".join(draw.choice("01") for _ in range(9)) for _ in range(60)] * 2 + ["Supplier", "", None, "Supplier#0101"]
    df = spark.createDataFrame(list(enumerate(words)), "_row_index long, name string").withColumn("band", F.col("_row_index") % 3)
    shown = lambda d: sorted((r.i, r.j, round(r.score, 9)) for r in d.collect())
    for threshold in (0.9, 0.85):
        config = linkage.Config([linkage.Mapping("name", "name", "levenshtein", 1.0, True), linkage.Mapping("band", "band", "numeric_tolerance", 0.5)], threshold, {"case_fold": True})
        want = shown(linkage.scores(df, None, config))
        assert want and shown(linkage.scores(df, None, config, cap=len(want) * 3)) == want
        assert shown(linkage.scores(df, df, config, cap=len(want) * 6)) == shown(linkage.scores(df, df, config))


def test_rows_of_near_texts_without_a_cap(spark, monkeypatch):
    """Without a cap many rows of few near texts give all their pairs, those of rows without a second value too."""
    df = spark.range(700).select(F.col("id").alias("_row_index"), F.concat(F.lit("Supplier#00000000"), F.col("id") % 3).alias("name"), F.expr("if(id % 7 = 0, null, id % 5)").alias("band"))
    df = df.union(spark.createDataFrame([(900, "Supplier#12345678", 1), (901, "", 1), (902, None, 1)], df.schema))
    config = linkage.Config([linkage.Mapping("name", "name", "levenshtein", 1.0, True), linkage.Mapping("band", "band", "numeric_tolerance", 0.5)], 0.9, {"case_fold": True})
    with pytest.raises(linkage.TooManyPairs):
        linkage.scores(df, None, config, cap=200_000)
    shown = lambda d: d.select("i", "j", F.round("score", 9), F.map_values("per_column"))
    got = shown(linkage.scores(df, None, config, cap=None))
    monkeypatch.setattr(linkage, "_few_edits", lambda *_: None)
    want = shown(linkage.scores(df, None, config, cap=None))
    assert got.count() == want.count() == comb(700, 2) and got.exceptAll(want).isEmpty()

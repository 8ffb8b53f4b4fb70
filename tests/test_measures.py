"""Jaro-Winkler and Metaphone against plain loops, and without Python in their plans."""

import random

import pytest
from pyspark.sql import functions as F

from lithic.functions import similarity as sim
from lithic.functions import text as tx


def loop(s, t):
    """Jaro-Winkler from its definition."""
    if not s or not t:
        return 0.0
    reach = max(0, max(len(s), len(t)) // 2 - 1)
    free, first = list(t), []
    for i, c in enumerate(s):
        for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
            if free[j] == c:
                free[j] = None
                first.append(c)
                break
    if not first:
        return 0.0
    second = [c for c, f in zip(t, free, strict=True) if f is None]
    m, moved = len(first), sum(x != y for x, y in zip(first, second, strict=True)) // 2
    jaro = (m / len(s) + m / len(t) + (m - moved) / m) / 3
    same = 0
    while same < min(4, len(s), len(t)) and s[same] == t[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def test_jaro_winkler(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdé漢𝄞") for _ in range(draw.randrange(0, 12)))
    pairs = [(word(), word()) for _ in range(400)] + [("MARTHA", "MARHTA"), ("DWAYNE", "DUANE"), ("DIXON", "DICKSONX"), (None, "a"), ("a", None), ("a" * 300, "b" + "a" * 250), ("x", "x"), ("ab", "ba")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", sim.jaro_winkler(F.col("a"), F.col("b")).alias("s"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r.s for r in df.collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == pytest.approx(loop(a, b)), (a, b)


def test_metaphone(spark):
    known = {"Thompson": "TMSN", "Knight": "NFT", "Which": "WX", "physics": "FSKS", "school": "SKL", "Xavier": "SFR", "judge": "JJ", "two  words": "TW WRTS", "": "", "123": "", "a": "A", "WHALE": "WL", "bomb": "BM"}
    df = spark.createDataFrame([(k,) for k in known], "x string").select("x", tx.metaphone(F.col("x")).alias("code"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.x: r.code for r in df.collect()}
    assert {k: got[k] for k in ("Which", "physics", "school", "Xavier", "two  words", "", "123", "a", "WHALE", "bomb")} == {k: known[k] for k in ("Which", "physics", "school", "Xavier", "two  words", "", "123", "a", "WHALE", "bomb")}


def test_sounds_are_folded_once_for_equal_words(spark):
    names = ["large ring", "Large  Ring 7", "knight", "", None, "123", "ring large"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names * 3)], "i int, x string").withColumn("own", tx.metaphone(F.col("x")))
    got = tx.with_sounds(df, {"code": F.col("x"), "back": F.reverse("x")})
    assert got.count() == 21 and got.where(~F.col("own").eqNullSafe(F.col("code"))).count() == 0
    assert got.where("x = 'knight'").first().back == df.select(tx.metaphone(F.lit("thgink"))).first()[0]

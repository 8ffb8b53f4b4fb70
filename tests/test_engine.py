"""Golden facts of profiling, cross analysis, normalisation, similarity, linkage and row queries."""

import pytest
from pyspark.sql import functions as F

from lithic.functions import normalize as nz
from lithic.functions import similarity as sim
from lithic.operators import cross, dashboard, linkage, profile, rows


def one(df):
    return df.first().asDict()


def values(spark, items, kind="string"):
    return spark.createDataFrame([(x,) for x in items], f"x {kind}")


def test_numbers(spark):
    got = one(profile.column_profiles(values(spark, list(range(1, 11)), "int")))
    assert (got["median"], got["mean"], got["p25"], got["p75"]) == (5.5, 5.5, 3.25, 7.75)
    assert got["std"] == pytest.approx(3.0276503540974917)
    assert got["semantic_type"] == "integer"


def test_outliers(spark):
    got = one(profile.column_profiles(values(spark, [1.0, 1.1, 0.9, 1.0, 1.05, 0.95, 1.0, 1.1, 0.9, 50.0], "double")))
    assert got["outliers_iqr"] == 1 and got["outliers_mad"] >= 1


@pytest.mark.parametrize("good, label", [(10, "email"), (8, None), (19, "email")])
def test_patterns(spark, good, label):
    total = 10 if good < 11 else 20
    got = one(profile.column_profiles(values(spark, [f"a{i}@b.com" for i in range(good)] + ["nope"] * (total - good))))
    assert got["pattern_label"] == label


def test_types(spark):
    got = one(profile.column_profiles(values(spark, [str(i) for i in range(99)] + ["word"])))
    assert (got["semantic_type"], got["type_mismatch_count"], got["rag"]) == ("integer", 1, "red")
    assert one(profile.column_profiles(values(spark, [str(i) for i in range(8)] + ["a", "b"])))["semantic_type"] == "string"


def test_blanks_and_issue(spark):
    got = profile.column_profiles(values(spark, ["1", None, None, "  ", "", "2", "3", "4", "5", "6"]))
    assert one(got)["null_count"] == 4 and one(got)["null_pct"] == 40
    assert [(r.dimension, r.severity) for r in profile.issues(got, "s").collect()] == [("completeness", "medium")]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, "z"), (3, "z"), (3, "z")], "a int, b string")
    assert one(profile.duplicate_rows(df))["duplicate_rows"] == 5
    twin = df.select("a", F.col("a").alias("c"), (F.col("a") + 1).alias("d"))
    assert [tuple(r) for r in profile.duplicate_columns(twin).collect()] == [("a", "c")]
    assert profile.duplicate_columns(twin.limit(0)).count() == 3


def test_bounds_and_empty(spark):
    got = one(profile.column_profiles(values(spark, [1, 2, 3, 4, 5, 100, 200], "int"), {"x": (0, 10)}))
    assert got["range_violations"] == 2
    empty = values(spark, [], "int")
    assert one(profile.sheet_profile(empty, profile.column_profiles(spark.createDataFrame([(None,)], "x int")).limit(0), "s"))["completeness_pct"] == 100


def test_cross(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b"), ("2", "b"), ("3", "c"), ("3", "c")], "zip string, city string")
    assert ("zip", "city", 3, 100.0) in [tuple(r) for r in cross.functional_dependencies(df).collect()]
    line = spark.range(20).select(F.col("id").alias("x"), (F.col("id") * 2 + 3).alias("y"), F.lit(1).alias("k"))
    assert [tuple(r)[:2] for r in cross.correlations(line, ["x", "y", "k"]).collect()] == [("x", "y")]
    parent, child = spark.createDataFrame([(1,), (2,), (3,)], "id int"), spark.createDataFrame([(1,), (2,), (4,), (5,), (5,)], "pid int")
    assert sorted(r.value for r in cross.fk_violations(parent, "id", child, "pid").collect()) == [4, 5]
    assert cross.name_similarity("customerId", "customer_id") == 1 and cross.name_similarity("a", "b") == 0


@pytest.mark.parametrize(
    "rule, text, want",
    [
        ("strip_corporate_suffix", "Acme Robotics, Inc.", "Acme Robotics"),
        ("strip_corporate_suffix", "LLC Holdings", "LLC Holdings"),
        ("expand_address_abbrev", "30 St Clair Ave W", "30 Saint Clair Avenue West"),
        ("expand_address_abbrev", "120 Market St.", "120 Market Street"),
        ("nfkd_fold", "Café Lumière", "Cafe Lumiere"),
    ],
)
def test_normalise(spark, rule, text, want):
    got = values(spark, [text]).select(nz.normalize(F.col("x"), {rule: True}).alias("y"))
    assert one(got)["y"] == want


def test_parsers(spark):
    phones = values(spark, ["(415) 555-0142", "415-555-0142", "415.555.0142", "+1 415 555 0142", "1 415 555 0142"])
    assert {r.p.value for r in phones.select(nz.parse_phone(F.col("x"), "US").alias("p")).collect()} == {"+14155550142"}
    assert not one(values(spark, ["415-555-0142"]).select(nz.parse_phone(F.col("x")).alias("p")))["p"].ok
    days = values(spark, ["2025-08-15", "08/15/2025", "15-Aug-2025", "2025.08.15"]).select(nz.parse_date(F.col("x")).alias("p")).collect()
    assert {r.p.value for r in days} == {"2025-08-15"}
    assert not one(values(spark, ["yesterday"]).select(nz.parse_date(F.col("x")).alias("p")))["p"].ok


@pytest.mark.parametrize(
    "name, a, b, want",
    [
        ("levenshtein", "kitten", "sitting", 1 - 3 / 7), ("jaccard_tokens", "a b c", "b c d", 0.5), ("ngram", "abcd", "abce", 0.5), ("soundex", "Robert", "Rupert", 1.0),
        ("soundex", "123", "123", 0.0), ("numeric_tolerance", "100", "105", 1 - 5 / (0.01 + 0.05 * 105)), ("date_proximity", "2024-01-01", "2024-01-02", 6 / 7),
        ("jaro_winkler", "MARTHA", "MARHTA", 0.9611111), ("exact", "", "", 0.0), ("cosine_tokens", "a b", "a b", 1.0),
    ],
)
def test_similarity(spark, name, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    got = df.select(sim.similarity(name, F.col("a"), F.col("b")).alias("s"), sim.similarity(name, F.col("b"), F.col("a")).alias("t")).first()
    assert got.s == pytest.approx(want, abs=1e-6) and got.s == pytest.approx(got.t)


def test_linkage(spark):
    names = [(0, "Acme Robotics Inc"), (1, "Acme Robotics"), (2, "Globex Ltd"), (3, "Globex"), (4, "Initech LLC"), (5, "Initech"), (6, "Umbrella")]
    df = spark.createDataFrame(names, "_row_index long, name string")
    config = linkage.Config([linkage.Mapping("name", "name", "jaro_winkler", 1.0, True)], 0.85, {"case_fold": True, "strip_corporate_suffix": True})
    pairs = linkage.scores(df, None, config)
    assert pairs.count() == 3 and linkage.clusters(pairs).count() == 3
    with pytest.raises(linkage.TooManyPairs):
        linkage.scores(df, None, config, cap=2)


def test_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "Bb")], "n int, t string")
    ids = lambda f: [r.n for r in rows.where(df, f).orderBy("n").collect()]
    assert ids([{"column": "t", "op": "!=", "value": "a"}]) == [2, 3]
    assert ids([{"column": "t", "op": "contains", "value": "b"}]) == [3]
    assert ids([{"column": "n", "op": "in", "value": ["1"]}]) == []
    assert ids([{"column": "t", "op": "is_null"}]) == [2]
    with pytest.raises(ValueError):
        rows.where(df, [{"column": "zz", "op": "==", "value": 1}])


def test_tree(spark):
    tree = spark.createDataFrame([("a", None, 1, "A"), ("b", None, 1, "B"), ("c", "a", 2, "C"), ("d", "c", 3, "D"), ("e", "c", 3, "E")], "id string, parent string, level int, name string")
    assert {r.id: r.root for r in dashboard.ancestors(tree).collect()} == {"a": "a", "b": "b", "c": "a", "d": "a", "e": "a"}
    assert dashboard.broken_links(tree).count() == 0

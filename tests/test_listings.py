"""Listings, chat tools, graph helpers, uploads, tree edits: small facts and faults."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lithic.operators import cross, dashboard, graph, hierarchy, linkage, profile
from lithic.plans import listings, report, tools
from lithic.sources import workbook
from lithic.sources.store import Store


def test_listings(spark):
    rows = spark.createDataFrame([(1, "a", 5, True), (2, "a", 7, None), (3, "b", 7, False), (4, "b", 7, True)], "id int, owner string, at int, on boolean")
    assert [r.id for r in listings.newest_first(rows, "at").collect()] == [4, 3, 2, 1]
    assert [r.id for r in listings.oldest_first(rows, "at").collect()] == [1, 2, 3, 4]
    assert sorted(r.id for r in listings.latest(rows, ["owner"], "at", "id").collect()) == [2, 4]
    assert sorted(r.id for r in listings.oldest(rows, ["owner"], "at", "id").collect()) == [1, 3]
    assert listings.one_owned(rows, "owner", "a", "id", 3).count() == 0 and listings.one_owned(rows, "owner", "b", "id", 3).count() == 1
    assert [r.id for r in listings.resolve(rows, "id", [3, 1, 3]).collect()] == [3, 1]
    with pytest.raises(ValueError, match="9"):
        listings.resolve(rows, "id", [1, 9])
    assert tuple(listings.flag_counts(rows, "on").first()) == (2, 2)
    odd = spark.createDataFrame([(float("nan"), None, "x")], "a double, b date, c string")
    assert json.loads(listings.json_rows(odd).first().json) == {"a": None, "b": None, "c": "x"}


def test_tools(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    sheets = {"s": spark.createDataFrame([(0, 1, "x"), (1, 2, "y"), (2, 3, None)], "_row_index long, k int, v string")}
    at = tools.Context(store, "d", sheets)
    assert json.loads(tools.dispatch(at, "describe_dataset", {})) == {"error": "the dataset has no profile yet"}
    report.profile_dataset(store, "d", sheets)
    said = json.loads(tools.dispatch(at, "describe_dataset", {}))
    assert [c["column"] for c in said["sheets"][0]["columns"]] == ["k", "v"] and said["sheets"][0]["row_count"] == 3
    column = json.loads(tools.dispatch(at, "describe_column", {"sheet": "s", "column": "v"}))
    assert column["null_count"] == 1 and column["top_values"] == [{"value": "x", "count": 1}, {"value": "y", "count": 1}] and column["issues"][0]["severity"] == "medium"
    assert json.loads(tools.dispatch(at, "flag_issue", {"sheet": "s", "dimension": "validity", "severity": "low", "description": "odd"})) == {"ok": True}
    assert len(json.loads(tools.dispatch(at, "list_issues", {"sheet": "s"}))["issues"]) == 2
    assert json.loads(tools.dispatch(at, "query_dataset", {"sheet": "s", "filters": [{"column": "k", "op": ">", "value": 1}], "limit": 1})) == {"rows": [{"k": 2, "v": "y"}], "row_count_total": 2}
    for tool, arguments in (("nope", {}), ("query_dataset", {"sheet": "zz"}), ("describe_column", {"sheet": "s", "column": "zz"}), ("list_issues", {"bad": 1})):
        assert "error" in json.loads(tools.dispatch(at, tool, arguments))
    assert "[truncated, original was" in tools.dispatch(at, "describe_dataset", {}, most=20)


def test_settings(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert not report.config_done(store, "d")
    report.skip_config(store, "d")
    assert report.config_done(store, "d") and report.load_config(store, "d") is None
    one = spark.createDataFrame([(0, "a"), (1, "a")], "_row_index long, name string")
    config = linkage.Config([linkage.Mapping("name", "name", "exact", 1.0, True)])
    report.save_config(store, "d", one, one, config)
    first = store.load("d", "config", "settings").first().completed_at
    report.save_config(store, "d", one, one, config)
    assert store.load("d", "config", "settings").first().completed_at == first and report.load_config(store, "d") == config
    assert report.runs(store, "d").count() == 0
    for cap in (0, 9):
        report.link(store, "d", one, None, config, cap=cap)
    assert [(r.run, r.status) for r in report.runs(store, "d").collect()] == [(2, "ok"), (1, "failed")]


def test_graph(spark):
    draw = random.Random(1)
    pairs = [(draw.randrange(120), draw.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(100)] + [(500, 500)]
    root = {n: n for p in pairs for n in p}
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        root = {n: low if r == high else r for n, r in root.items()}
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {n: r for n, r in root.items() if any(a != b and n in (a, b) for a, b in pairs)}
    numbers = spark.createDataFrame([(x,) for x in draw.sample(range(1000), 300)], "x int").repartition(7)
    placed = [r.n for r in graph.numbered(numbers, "n", F.col("x").desc()).orderBy(F.col("x").desc()).collect()]
    assert placed == list(range(300))
    assert graph.numbered(numbers.limit(0), "n", F.col("x")).count() == 0


def test_empty_and_narrow(spark):
    empty = spark.createDataFrame([], "a int, b string")
    got = profile.column_profiles(empty)
    assert [(r.column, r.row_count, r.semantic_type, r.rag) for r in got.orderBy("column").collect()] == [("a", 0, "empty", "amber"), ("b", 0, "empty", "amber")]
    assert tuple(profile.sheet_profile(empty, got, "s").select("row_count", "completeness_pct").first()) == (0, 100.0)
    assert cross.functional_dependencies(empty.select("a")).count() == cross.correlations(empty, ["a"]).count() == 0
    issues = spark.createDataFrame([("s", "a"), ("s", None), ("t", "a"), ("t", "a")], "sheet string, column string")
    columns = spark.createDataFrame([("s", "a"), ("t", "a"), ("t", "b")], "sheet string, column string")
    assert sorted(map(tuple, dashboard.issues_per_column(columns, issues).collect())) == [("s", "", 1), ("s", "a", 1), ("t", "", 0), ("t", "a", 2), ("t", "b", 0)]
    ties = spark.createDataFrame([(0, "z"), (1, "a"), (2, "a"), (3, "z"), (4, "m")], "_row_index long, v string")
    assert [r.value for r in profile.top_values(ties).orderBy("rank").collect()] == ["z", "a", "m"]


def test_uploads(spark):
    png, pdf, webp = b"\x89PNG\r\n\x1a\n....", b"%PDF-1.7", b"RIFF\x10\x00\x00\x00WEBPVP8 "
    found = [("a.png", png), ("b.pdf", png), ("c.pdf", pdf), ("d.webp", webp), ("e.webp", webp[:9]), ("f.exe", b"MZ"), ("g.png", b"")]
    rows = spark.createDataFrame([(n, len(b), bytearray(b)) for n, b in found], "path string, length long, content binary")
    got = {r.path: (r.mime, r.family, r.problem) for r in workbook.attachments(rows).collect()}
    assert got["a.png"] == ("image/png", "image", None) and got["c.pdf"] == ("application/pdf", "document", None) and got["d.webp"][2] is None
    assert got["b.pdf"][2] == "name and contents differ" and got["e.webp"][2] == got["f.exe"][2] == "unknown kind of file" and got["g.png"][2] == "empty file"


def test_tree_edits(spark):
    tree = spark.createDataFrame([("a", None, 1, "A", None, 0), ("b", "a", 2, "B", None, 0), ("c", "b", 3, "C", None, 0)], hierarchy.NODE)
    more = hierarchy.create(tree, "d", " D ", "a", "text")
    assert tuple(more.where("id = 'd'").first()) == ("d", "a", 2, "D", "text", 1)
    for fault in (lambda: hierarchy.create(tree, "x", "X", "c"), lambda: hierarchy.create(tree, "a", "A"), lambda: hierarchy.create(tree, "x", " "), lambda: hierarchy.delete(tree, "x"), lambda: hierarchy.update(tree, "a", " ")):
        with pytest.raises(ValueError):
            fault()
    assert hierarchy.update(more, "d", description="new").where("id = 'd'").first().description == "new"
    assert sorted(r.id for r in hierarchy.delete(more, "b").collect()) == ["a", "d"]
    assert [r.id for r in hierarchy.listed(more).collect()] == ["a", "b", "d", "c"]
    trees = tree.withColumn("owner", F.lit("p")).unionByName(tree.withColumn("owner", F.lit("q")))
    assert sorted((r.owner, r.id) for r in hierarchy.replace(trees, "owner", "p", tree.where("level = 1")).collect()) == [("p", "a"), ("q", "a"), ("q", "b"), ("q", "c")]
    with pytest.raises(ValueError):
        hierarchy.replace(trees, "owner", "p", tree.where("level > 1"))

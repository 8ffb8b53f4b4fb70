"""Store, reports with carry-over, linkage runs, recommendations, annotation, transcripts, trees."""

import json

import pytest
from pyspark.sql import functions as F

from lithic.functions import similarity as sim
from lithic.functions import text as tx
from lithic.operators import cross, hierarchy, linkage, profile
from lithic.plans import annotate, recommend, report
from lithic.sources.store import MANY, ConcurrentWrite, Store

Facts = recommend.Facts


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for n in (1, 2, 3):
        store.save("a/b", "g", {"t": spark.range(n)})
    store.append("a/b", "g", "t", spark.range(1))
    assert store.load("a/b", "g", "t").count() == 4 and store.datasets() == ["a/b"]
    assert store.load("a/b", "g", "none") is None and store.load("x", "g", "t") is None
    store.delete("a/b")
    assert store.datasets() == []


def test_store_interleaved(spark, tmp_path):
    """Additions are kept whoever commits in between; of two replacements from one snapshot the second fails."""
    store, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x int")
    seen = lambda: sorted(r.x for r in store.load("d", "g", "t").collect())
    assert store.save("d", "g", {"t": rows(1), "u": rows(9)}) == 1
    base = store.head("d", "g")
    other.append("d", "g", "t", rows(2), tag="hand")
    with pytest.raises(ConcurrentWrite):
        store.save("d", "g", {"t": rows(5)}, base=base)
    assert seen() == [1, 2] and [r.x for r in store.load("d", "g", "u").collect()] == [9]
    store.save("d", "g", {"t": rows(5)}, base=base, carry="hand")
    assert seen() == [2, 5] and store.load("d", "g", "u") is None
    with pytest.raises(ConcurrentWrite):
        other.save("d", "g", {"t": rows(6)}, base=base, carry="hand")
    commit, late = store._commit, []

    def crossed(home, new):
        if not late:
            late.append(other.append("d", "g", "t", rows(7), tag="hand"))
        commit(home, new)

    store._commit = crossed  # another writer takes the number between reading and committing
    store.append("d", "g", "t", rows(8))
    assert seen() == [2, 5, 7, 8]
    late.clear()
    tries = []

    def derive():
        tries.append(1)
        return {"t": rows(*seen(), 10)}

    store.update("d", "g", derive)
    assert len(tries) == 2 and seen() == [2, 5, 7, 7, 8, 10]
    store._commit = commit
    for _ in range(MANY):
        store.append("d", "g", "t", rows(0), tag="hand")
    store.save("d", "g", {"t": rows(1)}, carry="hand")
    assert seen() == [0] * MANY + [1] and len(store.history("d", "g")) == 2
    folders = {p.name for p in (tmp_path / "s" / "d" / "g" / "data").iterdir()}
    assert len(folders) == MANY + 3  # what the last two snapshots name, and nothing else


def test_flag_during_a_profile(spark, tmp_path, monkeypatch):
    """An issue that a person flags while a profile runs stays."""
    store = Store(spark, str(tmp_path / "s"))
    sheets = {"a": spark.createDataFrame([(0, 1), (1, None)], "_row_index long, x int")}
    save = store.save

    def late(*args, **more):
        report.flag_issue(Store(spark, store.root), "d", "a", "accuracy", "low", "odd")
        return save(*args, **more)

    monkeypatch.setattr(store, "save", late)
    report.profile_dataset(store, "d", sheets)
    monkeypatch.undo()
    report.profile_dataset(store, "d", sheets)
    texts = [r.description for r in store.load("d", "profile", "issues").collect()]
    assert texts.count("odd") == 1 and len(texts) > 1


def test_report_and_carry_over(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    customers = spark.createDataFrame([(0, 1, "Ann"), (1, 2, "Bob"), (2, 3, "Cy")], "_row_index long, id int, `full.name` string")
    orders = spark.createDataFrame([(0, 101, 1), (1, 102, 2), (2, 103, 3), (3, 104, 4)], "_row_index long, id int, customer_id int")
    sheets = {"customers": customers, "orders": orders}
    report.profile_dataset(store, "d", sheets)
    found = report.list_relationships(store.load("d", "profile", "relationships"))
    keys = [tuple(r[k] for k in report.KEY) for r in found.collect()]
    key = ("customers", "id", "orders", "customer_id")
    assert key in keys and set(r.status for r in found.collect()) == {"suggested"}
    report.decide(store, "d", key, "confirmed")
    report.set_bounds(store, "d", "orders", "customer_id", 0, 2)
    report.flag_issue(store, "d", "orders", "accuracy", "critical", "odd", samples=["x"])
    with pytest.raises(ValueError):
        report.flag_issue(store, "d", "orders", "taste", "low", "odd")
    with pytest.raises(ValueError):
        report.set_bounds(store, "d", "orders", "id", 2, 1)
    report.profile_dataset(store, "d", sheets)
    kept = store.load("d", "profile", "relationships").where("status = 'confirmed'")
    assert [tuple(r[k] for k in report.KEY) for r in kept.collect()] == [key]
    issues, more = report.list_issues(store.load("d", "profile", "issues"), sheet="orders", by_rank=True)
    texts = {r.description: list(r.sample_values) for r in issues.collect()}
    assert texts["[FK violation] orders.customer_id has 1 value(s) not present in customers.id."] == ["4"]
    assert texts["Column 'customer_id' has 2 value(s) outside the configured bounds [0.0, 2.0]."] == [] and texts["odd"] == ["x"]
    assert issues.first().severity == "critical" and not more
    assert {r.column for r in store.load("d", "profile", "columns").collect()} == {"id", "full.name", "customer_id"}


def test_samples(spark):
    df = spark.createDataFrame([(i, str(i) if i != 7 else "seven") for i in range(120)], "_row_index long, x string")
    got = profile.samples(df, profile.column_profiles(df.select("x"))).collect()
    assert [(r.column, list(r.sample_values)) for r in got] == [("x", ["seven"])]
    mails = spark.createDataFrame([(i, f"a{i}@b.com" if i else "nope") for i in range(20)], "_row_index long, x string")
    assert profile.samples(mails, profile.column_profiles(mails.select("x"))).first().sample_values == ["nope"]
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert [r.value for r in cross.counter_examples(pairs, "k", "v").collect()] == ["1"]


def test_linkage_run(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    a = spark.createDataFrame([(0, 1, "Acme Inc"), (1, 2, "Globex"), (2, 3, "Zed")], "_row_index long, id int, name string")
    b = spark.createDataFrame([(0, "ACME"), (1, "Globex LLC"), (2, "Other")], "_row_index long, company string")
    config = linkage.Config([linkage.Mapping("name", "company", "jaro_winkler", 1.0, True)], 0.85, {"case_fold": True, "strip_corporate_suffix": True})
    report.save_config(store, "d", a, b, config)
    assert report.load_config(store, "d") == config
    run = report.link(store, "d", a, b, config)
    assert (run["status"], run["passing_pairs"], run["clusters"], run["candidate_pairs"]) == ("ok", 2, 2, 2)
    detail = report.cluster_detail(store, "d", 0, a, b)
    assert detail["pairs"].count() == detail["rows_a"].count() == 1
    assert store.load("d", "linkage", "clusters").orderBy("cluster_index").first().canonical_key == {"name": "Acme Inc"}
    failed = report.link(store, "d", a, b, config, cap=1)
    assert failed["status"] == "failed" and store.load("d", "linkage", "run").first().candidate_pairs == 2
    with pytest.raises(ValueError):
        report.save_config(store, "d", a, b, linkage.Config([linkage.Mapping("nope", "company", "exact", 1.0, True)]))


@pytest.mark.parametrize(
    "a, b, want",
    [
        (Facts("x", "string", "email"), Facts("y", "string", "email"), ("exact", "email")), (Facts("x", "date"), Facts("y", "date"), ("date_proximity", "date")),
        (Facts("x", "integer"), Facts("y", "float"), ("numeric_tolerance", None)), (Facts("x", "integer"), Facts("y", "string"), ("exact", None)),
        (Facts("customer_id", "string"), Facts("name", "string"), ("exact", None)), (Facts("company", "string"), Facts("y", "string"), ("jaro_winkler", None)),
        (Facts("street", "string"), Facts("y", "string"), ("jaccard_tokens", None)), (Facts("notes", "string"), Facts("y", "string"), ("cosine_tokens", None)),
        (Facts("x", "string", avg_length=61), Facts("y", "string"), ("jaccard_tokens", None)), (Facts("x", "string"), Facts("y", "string"), ("levenshtein", None)),
    ],
)
def test_measures(a, b, want):
    assert recommend.measure(a, b) == want


def test_mappings():
    left, right = [Facts("customer_email", "string"), Facts("amount", "float")], [Facts("lead_email", "string"), Facts("amount", "string"), Facts("email", "string")]
    assert [(m.left, m.right, m.important) for m in recommend.mappings(left, right)] == [("customer_email", "email", False)]
    assert recommend.rules([Facts("city", "string")])["expand_address_abbrev"] and not recommend.rules([])["strip_punctuation"]
    new = recommend.refine(recommend.mappings(left, right), lambda _: {("customer_email", "email"): ("exact", None)})
    assert (new[0].measure, new[0].parser) == ("exact", None)


def test_annotation(spark):
    issues = spark.createDataFrame([(i, "s", "c", "validity", "low", f"issue {i}") for i in range(45)], "issue_id long, sheet string, column string, dimension string, severity string, description string")
    assert annotate.report(annotate.annotate(issues)).first() == (45, 0, 3)

    def partial(system, user):
        rows = json.loads(user)["issues"][1:]
        return "```json\n" + json.dumps({"annotations": [{"issue_id": r["issue_id"], "narrative": "n", "suggested_fix": "f"} for r in rows]}) + "\n```"

    got = annotate.annotate(issues, partial)
    assert {r.issue_id for r in got.where("ai_status = 'failed' AND ai_raw IS NOT NULL").collect()} == {0, 20, 40}
    assert annotate.annotate(issues, lambda s, u: "no").where("ai_status = 'failed'").count() == 45


def test_transcripts(spark):
    cited = [{"content": [{"citations": [{"url": "u1", "cited_text": "t"}, {"url": "u2", "title": "T"}]}, {"text": "x"}]}, {"content": "plain"}, {"content": [{"citations": [{"url": "u1", "title": "again"}]}]}]
    df = spark.createDataFrame([(json.dumps([cited[0], cited[2]]),), ("bad",), (None,)], "t string")
    got = [[(c.url, c.title) for c in r.c] for r in df.select(tx.citations(F.col("t")).alias("c")).collect()]
    assert got == [[("u1", "u1"), ("u2", "T")], [], []]
    fences = ["```json\n{}\n```", "plain ", "```{}```"]
    df = spark.createDataFrame([(f,) for f in fences], "t string")
    assert [r.a for r in df.select(tx.strip_codefences(F.col("t")).alias("a")).collect()] == [tx.strip_codefence(f) for f in fences] == ["{}", "plain", "{}"]
    urls = spark.createDataFrame([("https://example.com/a", True), ("http://127.0.0.1/", False), ("ftp://example.com", False), ("http://10.1.2.3:80/x", False), ("http://[::1]/", False), ("http://localhost", False), ("http://u@192.168.0.1", False), (None, False)], "u string, ok boolean")
    assert urls.where(tx.safe_url(F.col("u")) != F.col("ok")).count() == 0
    long = spark.createDataFrame([("a" * 12,)], "t string").select(tx.truncate(F.col("t"), 10).alias("a"), tx.preview(F.col("t"), 10).alias("b"), tx.join_turns(F.array(F.lit(" x "), F.lit(" "), F.lit("y"))).alias("c")).first()
    assert tuple(long) == ("a" * 10 + "\n\n[truncated, original was 12 chars]", "a" * 10 + "... [+2 more chars]", "x\n\ny")


def test_metaphone(spark):
    df = spark.createDataFrame([("Smith", "Smyth", 1.0), ("Catherine", "Katherine", 1.0), ("Smith", "Johnson", 0.0), ("12", "12", 0.0), (None, "a", 0.0)], "a string, b string, w double")
    assert df.where(sim.similarity("metaphone", F.col("a"), F.col("b")) != F.col("w")).count() == 0


def test_hierarchy(spark):
    tree = [{"name": "A", "children": [{"name": "B", "children": [{"name": "C"}, {"name": "D"}]}]}, {"name": "E", "description": "e"}]
    df = spark.createDataFrame([("p", json.dumps(tree)), ("q", "bad")], "key string, j string")
    rows = hierarchy.from_json(df, "j", "key").persist()
    assert {r.id: (r.parent, r.level, r.name, r.position) for r in rows.collect()} == {"0": (None, 1, "A", 0), "0.0": ("0", 2, "B", 0), "0.0.0": ("0.0", 3, "C", 0), "0.0.1": ("0.0", 3, "D", 1), "1": (None, 1, "E", 1)}
    assert hierarchy.validate(rows).count() == 0
    assert {r.id for r in hierarchy.descendants(rows, "0").collect()} == {"0.0", "0.0.0", "0.0.1"}
    assert {r.id for r in hierarchy.visible(rows, ["0.0"]).collect()} == {"0", "0.0", "1"}
    assert hierarchy.edges(rows).count() == 3
    assert {r.id for r in hierarchy.search(rows, " d ").where("hit").collect()} == {"0.0.1"}
    top = hierarchy.nested(rows).collect()
    assert [c.name for c in top[0].children[0].children] == ["C", "D"] and list(top[1].children) == []
    assert hierarchy.next_position(rows, "0.0").first().position == 2 and hierarchy.next_position(rows, "1").first().position == 0
    moved = {r.id: r.position for r in hierarchy.move(rows, "0.0.1", -1).collect()}
    assert (moved["0.0.0"], moved["0.0.1"], moved["1"]) == (1, 0, 1)
    assert {r.id: r.colour for r in hierarchy.palette(rows, 2).collect()} == {"0": 0, "1": 1}

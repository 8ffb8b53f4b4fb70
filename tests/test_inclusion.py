"""Inclusion of columns: sketches refute pairs, and never one that holds."""

import random

from pyspark.sql import functions as F

from lithic.operators import cross


def test_sketches_never_refute_what_holds(spark, monkeypatch):
    monkeypatch.setattr(cross, "SLOTS", 10)
    draw = random.Random(6)
    sets = {i: {str(draw.randrange(60 * (1 + i % 9))) for _ in range(draw.randrange(1, 400))} for i in range(24)}
    rows = [(i, "string", v, 1) for i, vs in sets.items() for v in vs]
    known = cross.sketches(spark.createDataFrame(rows, "id int, kind string, value string, n long"))
    held = {(p, k) for p in sets for k in sets if len(sets[p] & sets[k]) >= 0.5 * len(sets[k])}
    left = {(p, k) for p in sets for k in sets if known[p].may_hold(known[k])}
    assert held <= left and len(left) < 0.75 * len(sets) ** 2
    known[0].kind = "integer"
    assert not known[1].may_hold(known[0])


def test_many_columns(spark):
    """Forty columns of two tables: only pairs that can hold are joined, and the result is that of all pairs."""
    n = F.col("id")
    parent = spark.range(400).select(*[(n * 7 + 1000 * i).alias(f"p{i}") for i in range(20)])
    child = spark.range(900).select(*[((n % 50) * 7 + 1000 * i + (3 if i % 2 else 0)).alias(f"c{i}") for i in range(20)])
    tables, columns = {"parent": parent, "child": child}, {"parent": parent.columns, "child": child.columns}
    kinds = {(t, c): "integer" for t, cs in columns.items() for c in cs}
    got = {(r.parent_table, r.parent_column, r.child_table, r.child_column, r.coverage) for r in cross.relationships(tables, columns, kinds).collect()}

    def values(t, i):
        return {n * 7 + 1000 * i for n in range(400)} if t == "parent" else {(n % 50) * 7 + 1000 * i + (3 if i % 2 else 0) for n in range(900)}

    want = set()
    for i in range(20):
        for j in range(20):
            p, k = values("parent", i), values("child", j)
            if len(p & k) >= 0.5 * len(k):
                want.add(("parent", f"p{i}", "child", f"c{j}", len(p & k) / len(k)))
            if len(p & k) >= 0.5 * len(p):
                want.add(("child", f"c{j}", "parent", f"p{i}", len(p & k) / len(p)))
    assert got == want and len(want) >= 10
    empty = cross.relationships({"a": spark.createDataFrame([("x",)], "u string"), "b": spark.createDataFrame([("y",)], "v string")}, {"a": ["u"], "b": ["v"]}, {("a", "u"): "string", ("b", "v"): "string"})
    assert empty.count() == 0 and "coverage" in empty.columns

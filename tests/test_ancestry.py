"""Trees of any depth: deep chains, cycles, missing parents, nested JSON there and back."""

import json
import random

from pyspark.sql import functions as F

from lithic.operators import ancestry, dashboard, graph, hierarchy


def test_deep_chain_and_cycle(spark):
    rows = [(i, i - 1 if i else None) for i in range(1000)] + [(2000 + i, 2000 + (i + 1) % 5) for i in range(5)] + [(3000, 2002), (3001, 3000), (4000, 9999), (4001, 4000), (5000, 5000)]
    tree = spark.createDataFrame(rows, "id long, parent long")
    got = {r.id: (r.root, r.depth, r.cyclic) for r in ancestry.climb(tree).collect()}
    assert all(got[i] == (0, i, False) for i in range(1000))
    assert all(got[i] == (None, None, True) for i in [*range(2000, 2005), 3000, 3001, 5000])
    assert got[4000] == (4000, 0, False) and got[4001] == (4000, 1, False)
    assert {r.id: r.root for r in dashboard.ancestors(tree).collect()}[999] == 0
    lines = ancestry.lineage(tree.where("id < 300 OR id > 1999"))
    assert lines.count() == 300 * 299 // 2 + 1 and lines.distinct().count() == lines.count()
    assert lines.where("id - ancestor <> distance AND id < 2000").count() == 0
    assert hierarchy.descendants(tree, 990).count() == 9 and hierarchy.visible(tree, [100, 500, 3000]).count() == len(rows) - 899 - 1
    assert ancestry.climb(tree.limit(0)).count() == ancestry.lineage(tree.limit(0)).count() == 0


def test_random_trees(spark):
    draw = random.Random(8)
    parent = {i: draw.choice([None, draw.randrange(i)]) if i else None for i in range(400)}
    tree = spark.createDataFrame(list(parent.items()), "id int, parent int")

    def up(i):
        while parent[i] is not None:
            i = parent[i]
            yield i

    lines = {(i, a) for i in parent for a in up(i)}
    assert {(r.id, r.ancestor) for r in ancestry.lineage(tree).collect()} == lines
    assert {(r.id, r.root, r.depth) for r in ancestry.climb(tree).collect()} == {(i, ([i, *up(i)])[-1], len(list(up(i)))) for i in parent}
    for cut in ([3], [1, 5, 17]):
        assert {r.id for r in ancestry.below(tree, cut).collect()} == {i for i, a in lines if a in cut}


def test_weights_without_lines(spark, monkeypatch):
    """Sums over the lines of ancestors: a round writes a row a node, and no round but the last is kept."""
    rows = [(i, i - 1 if i % 100 else None) for i in range(1000)] + [(2000 + i, 2000 + (i + 1) % 5) for i in range(5)] + [(3000, 2002), (4000, 9999), (4001, 4000), (4002, 4000), (5000, 5000)]
    tree = spark.createDataFrame(rows, "id long, parent long")
    written, removed = [], []

    def stored(df):
        kept, remove = graph.stored(df)
        written.append(kept.count())
        return kept, lambda: (removed.append(1), remove())

    monkeypatch.setattr(ancestry, "stored", stored)
    got = {r.ancestor: (r.nodes, r.steps) for r in ancestry.weights(tree).collect()}
    assert set(written) == {len(rows)} and len(removed) == len(written) - 1
    below = {i: 99 - i % 100 for i in range(1000)}
    assert got == {i: (n, n * (n + 1) // 2) for i, n in below.items() if n} | {4000: (2, 2)}
    assert ancestry.weights(tree.limit(0)).count() == ancestry.weights(tree.where("id > 4999")).count() == 0


def test_nested_json_both_ways(spark):
    def node(depth, name):
        return {"name": name, "description": None, "children": [node(depth - 1, f"{name}]}}{{\"{k}") for k in range(2 if depth < 3 else 1)] if depth else []}

    trees = [(0, json.dumps([node(6, "a"), node(0, "b")])), (1, "[]"), (2, "{bad"), (3, None), (4, json.dumps([{"name": "x"}, {"children": [{"name": "lost"}]}]))]
    rows = ancestry.from_json(spark.createDataFrame(trees, "key int, j string"), "j", "key")
    assert rows.where("key = 0").agg(F.max("level")).first()[0] == 7 and {r.key for r in rows.collect()} == {0, 4}
    shaped = lambda n: (n["name"], [shaped(c) for c in n["children"]])
    back = {r.root: json.loads(r.tree) for r in ancestry.to_json(rows.where("key = 0")).collect()}
    assert [shaped(back[k]) for k in ("0", "1")] == [shaped(node(6, "a")), shaped(node(0, "b"))]
    assert sorted(r.name for r in rows.where("key = 4").collect()) == ["lost", "x"]

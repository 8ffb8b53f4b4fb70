"""Trees of any depth as rows (id, parent): roots, depths, cycles, lines of ancestors, nested JSON.

All walks double their steps: after a round each node knows the ancestor twice as far up, so
a tree of depth d takes about log2(d) rounds, each one join. Rounds end when no node has
reached its root in one: what is left then leads into a cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.operators.graph import cut, stored


def climb(tree: DataFrame, stop: Column | None = None, path: Column | None = None) -> DataFrame:
    """(id, root, depth, cyclic), and with ``path`` the values of that column from the root down to the node.

    The root is the highest ancestor there is: one without a parent, or whose parent is not
    among the rows, or for which ``stop`` holds. Nodes on a cycle or below one have no root
    and no depth. Ids are distinct.
    """
    top = F.col("parent").isNull() if stop is None else F.col("parent").isNull() | stop
    rows = tree.select("id", F.when(~top, F.col("parent")).alias("at"), *([path.alias("own")] if path is not None else []))
    known = rows.select(F.col("id").alias("_known"))
    rows = rows.join(known, F.col("at") == F.col("_known"), "left")
    more = [F.array("own").alias("path")] if path is not None else []
    now, remove = stored(rows.select("id", F.col("_known").alias("at"), F.when(F.col("_known").isNull(), F.col("id")).alias("root"), F.when(F.col("_known").isNull(), 0).otherwise(1).cast("long").alias("depth"), *more))
    open_ = now.where("root IS NULL").count()
    while open_:
        # a node that is under way takes over where the node that it stands at stands
        far = now.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), *([F.col("path").alias("_path")] if path is not None else []))
        moving = now.where("root IS NULL").join(far, F.col("at") == F.col("_id"))
        longer = [F.concat("_path", "path").alias("path")] if path is not None else []
        moved = moving.select("id", F.col("_at").alias("at"), F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), *longer)
        after, remove_after = stored(now.where("root IS NOT NULL").unionByName(moved))
        left = after.where("root IS NULL").count()
        remove()
        now, remove = after, remove_after
        if left == open_:
            break
        open_ = left
    cyclic = F.col("root").isNull()
    return now.select("id", "root", F.when(~cyclic, F.col("depth")).alias("depth"), cyclic.alias("cyclic"), *([F.when(~cyclic, F.col("path")).alias("path")] if path is not None else []))


def lineage(tree: DataFrame) -> DataFrame:
    """(id, ancestor, distance) for every node and each node above it; nodes on or below a cycle have none.

    A round adds to the lines of up to 2 ** k steps those that go on from their node's
    ancestor 2 ** k steps up, so no line is found twice.
    """
    sound = climb(tree).where(~F.col("cyclic"))
    edges = tree.where(F.col("parent").isNotNull()).join(sound.where("depth > 0").select("id"), "id")
    jump, _ = stored(edges.select("id", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("distance")))
    lines = jump
    while True:
        step = jump.select(F.col("id").alias("_id"), F.col("ancestor").alias("_up"), F.col("distance").alias("_far"))
        lower = lines.select(F.col("id").alias("_of"), F.col("ancestor").alias("_to"), F.col("distance").alias("_by"))
        beyond = jump.join(lower, F.col("ancestor") == F.col("_of")).select("id", F.col("_to").alias("ancestor"), (F.col("distance") + F.col("_by")).alias("distance"))
        further, _ = stored(jump.join(step, F.col("ancestor") == F.col("_id")).select("id", F.col("_up").alias("ancestor"), (F.col("distance") + F.col("_far")).alias("distance")))
        if further.isEmpty():  # the last lines, and those before, are not written once more
            return lines.unionByName(beyond)
        lines = lines.unionByName(stored(beyond)[0])
        jump = further


def weights(tree: DataFrame) -> DataFrame:
    """(ancestor, nodes, steps) for each node with others below it: their number, and the sum of their distances.

    The sums over the lines of ``lineage``, which are many times the nodes, without the lines:
    each node holds the sums of those less than 2 ** k steps below it, itself too, and a round
    gives them, 2 ** k steps further, to its ancestor 2 ** k steps up. A round writes a row a
    node. Nodes on or below a cycle have only such nodes above them; they move on for ever and
    are left out once no other moves. Ids are distinct.
    """
    rows = tree.select("id", F.col("parent").alias("at"))
    known = rows.select(F.col("id").alias("_known"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    now, remove = stored(rows.join(known, F.col("at") == F.col("_known"), "left").select("id", F.col("_known").alias("at"), one.alias("nodes"), none.alias("steps")))
    open_, far = now.where("at IS NOT NULL").count(), 1
    while open_:
        moving = now.where("at IS NOT NULL")
        given = moving.groupBy(F.col("at").alias("_to")).agg(F.sum("nodes").alias("_nodes"), F.sum(F.col("steps") + F.lit(far) * F.col("nodes")).alias("_steps"))
        up = moving.select(F.col("id").alias("_id"), F.col("at").alias("_at"))
        moved = moving.join(up, F.col("at") == F.col("_id"), "left").select("id", F.col("_at").alias("at"), "nodes", "steps")
        fuller = now.where("at IS NULL").unionByName(moved).join(given, F.col("id") == F.col("_to"), "left")
        after, remove_after = stored(fuller.select("id", "at", (F.col("nodes") + F.coalesce("_nodes", none)).alias("nodes"), (F.col("steps") + F.coalesce("_steps", none)).alias("steps")))
        left = after.where("at IS NOT NULL").count()
        remove()
        now, remove = after, remove_after
        if left == open_:
            break
        open_, far = left, 2 * far
    return now.where("at IS NULL AND nodes > 1").select(F.col("id").alias("ancestor"), (F.col("nodes") - 1).alias("nodes"), "steps")


def below(tree: DataFrame, nodes: list) -> DataFrame:
    """(id) of nodes with one of ``nodes`` above them."""
    found = climb(tree, F.col("id").isin(nodes))
    under = found.where(F.col("root").isin(nodes)).select(F.col("id").alias("_up"))
    return tree.join(under, F.col("parent") == F.col("_up"), "left_semi").select("id")


def to_json(tree: DataFrame) -> DataFrame:
    """(root, tree): each whole tree as nested JSON {id, name, children}, children by position, then id.

    The text is the node's opening and closing marks in the order of a walk around the tree;
    the place of a mark is the path of positions that leads to its node, so one grouping by
    root puts a tree of any depth together. Nodes on or below a cycle are left out.
    """
    place = F.struct(F.col("position").cast("long").alias("position"), F.col("id").cast("string").alias("id"))
    nodes = tree.join(climb(tree, path=place).where(~F.col("cyclic")).select("id", "root", "path"), "id")
    told = F.to_json(F.struct(F.col("id").cast("string").alias("id"), "name"), {"ignoreNullFields": "false"})
    head = F.concat(F.substring(told, F.lit(1), F.length(told) - 1), F.lit(',"children":['))
    last = F.struct(F.lit(2**62).cast("long").alias("position"), F.lit("").alias("id"))
    opening = F.struct(F.col("path").alias("place"), F.lit(True).alias("opens"), head.alias("mark"))
    closing = F.struct(F.concat("path", F.array(last)).alias("place"), F.lit(False).alias("opens"), F.lit("]}").alias("mark"))
    marks = nodes.select("root", F.explode(F.array(opening, closing)).alias("m")).groupBy("root").agg(F.array_sort(F.collect_list("m")).alias("marks"))
    between = F.transform("marks", lambda m, n: F.concat(F.when(m["opens"] & (n > 0) & ~F.get("marks", F.greatest(n - 1, F.lit(0)))["opens"], F.lit(",")).otherwise(F.lit("")), m["mark"]))
    return marks.select("root", F.array_join(between, "").alias("tree"))


def from_json(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, id, parent, level, name, description, position) of nested JSON arrays of any depth; ids are paths such as 0.2.1.

    Positions count siblings from 0. Bad JSON and nodes without a name give no rows. Levels
    are taken apart one after the other.
    """
    kind = "array<struct<name:string,description:string,children:variant>>"
    rows = df.select(key, F.lit(None).cast("string").alias("parent"), F.try_parse_json(column).alias("children"))
    out, level = None, 0
    while True:
        level += 1
        nodes = rows.select(key, "parent", F.posexplode(F.try_variant_get("children", "$", "array<variant>")).alias("position", "node"))
        told = F.try_variant_get("node", "$.name", "string").alias("name"), F.try_variant_get("node", "$.description", "string").alias("description")
        own = F.concat_ws(".", "parent", F.col("position").cast("string")).alias("id")
        nodes = cut(nodes.select(key, own, "parent", F.lit(level).alias("level"), *told, "position", F.try_variant_get("node", "$.children", "variant").alias("children")))
        if nodes.isEmpty():
            return (nodes if out is None else out).drop("children").where(F.col("name").isNotNull())
        out = nodes.drop("children") if out is None else out.unionByName(nodes.drop("children"))
        rows = nodes.select(key, F.col("id").alias("parent"), "children")

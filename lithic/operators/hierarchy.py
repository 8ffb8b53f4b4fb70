"""Trees of rows (id, parent, level, name, position): building, walking, searching, moving.

Walks take trees of any depth; trees that people edit have LEVELS levels, unless told otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithic.operators import ancestry
from lithic.operators.dashboard import broken_links

LEVELS = 3


def from_json(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, id, parent, level, name, description, position) of trees in JSON; ids are paths such as 0.2.1.

    Positions count siblings from 0. Bad JSON and nodes without a name give no rows.
    """
    return ancestry.from_json(df, column, key)


def nested(tree: DataFrame) -> DataFrame:
    """(id, name, position, children) of the top level, children sorted by position; built from the leaves up."""
    keep = ["position", "id", "name"]

    def packed(rows: DataFrame, *more: str) -> DataFrame:
        return rows.groupBy(F.col("parent").alias("up")).agg(F.sort_array(F.collect_list(F.struct(*keep, *more))).alias("children"))

    none = F.array().cast("array<struct<position:int,id:string,name:string>>")
    leaves = packed(tree.where("level = 3").withColumn("position", F.col("position").cast("int")))
    middle = tree.where("level = 2").join(leaves, F.col("id") == F.col("up"), "left").select("parent", F.col("position").cast("int").alias("position"), "id", "name", F.coalesce("children", none).alias("children"))
    tops = tree.where("level = 1").join(packed(middle, "children"), F.col("id") == F.col("up"), "left")
    return tops.select("id", "name", F.col("position").cast("int").alias("position"), F.coalesce("children", F.array()).alias("children")).orderBy("position", "id")


def lineage(tree: DataFrame) -> DataFrame:
    """(id, ancestor) for every node and each node above it."""
    return ancestry.lineage(tree).select("id", "ancestor")


def descendants(tree: DataFrame, node: str) -> DataFrame:
    """(id) of all nodes below a node."""
    return ancestry.below(tree, [node]).where(F.col("id") != node)


def visible(tree: DataFrame, collapsed: list[str]) -> DataFrame:
    """Nodes without a collapsed node above them."""
    return tree.join(ancestry.below(tree, collapsed), "id", "left_anti") if collapsed else tree


def edges(tree: DataFrame) -> DataFrame:
    return tree.where(F.col("parent").isNotNull()).select(F.col("parent").alias("source"), F.col("id").alias("target"))


def search(tree: DataFrame, text: str) -> DataFrame:
    """(id, hit): whether a name holds the text, case ignored; blank text hits nothing."""
    needle = text.strip().lower()
    return tree.select("id", (F.contains(F.lower("name"), F.lit(needle)) if needle else F.lit(False)).alias("hit"))


def validate(tree: DataFrame) -> DataFrame:
    """Nodes with a parent at the top, without one below it, or with one that is not a level above."""
    return broken_links(tree)


def next_position(tree: DataFrame, parent: str | None) -> DataFrame:
    """One row (position): after the last child; 0 without children."""
    own = F.col("parent").isNull() if parent is None else F.col("parent") == parent
    return tree.where(own).agg(F.coalesce(F.max("position") + 1, F.lit(0)).alias("position"))


def move(tree: DataFrame, node: str, step: int) -> DataFrame:
    """The tree with a node and its neighbour before (-1) or after (1) swapped; unchanged at the ends."""
    order = Window.partitionBy("parent").orderBy("position", "id")
    near = (F.lead if step > 0 else F.lag)
    back = (F.lag if step > 0 else F.lead)
    swapped = F.when(F.col("id") == node, F.coalesce(near("position").over(order), F.col("position"))).when(back("id").over(order) == node, back("position").over(order)).otherwise(F.col("position"))
    return tree.withColumn("position", swapped)


NODE = "id string, parent string, level int, name string, description string, position int"


def listed(tree: DataFrame) -> DataFrame:
    """Nodes by level, then position, then id."""
    return tree.orderBy("level", "position", "id")


def _node(tree: DataFrame, node: str):
    found = tree.where(F.col("id") == node).limit(1).collect()
    if not found:
        raise ValueError(f"no node {node!r}")
    return found[0]


def create(tree: DataFrame, node: str, name: str, parent: str | None = None, description: str | None = None, levels: int | None = LEVELS) -> DataFrame:
    """The tree with a node behind the last child of its parent; at most ``levels`` levels."""
    if not name.strip():
        raise ValueError("a node has a name")
    if tree.where(F.col("id") == node).take(1):
        raise ValueError(f"the node {node!r} is there already")
    level = 1 if parent is None else _node(tree, parent).level + 1
    if levels is not None and level > levels:
        raise ValueError(f"trees have {levels} levels")
    own = next_position(tree, parent).select(F.lit(node).alias("id"), F.lit(parent).cast("string").alias("parent"), F.lit(level).alias("level"), F.lit(name.strip()).alias("name"), F.lit(description).cast("string").alias("description"), F.col("position").cast("int").alias("position"))
    return tree.unionByName(own, allowMissingColumns=True)


def update(tree: DataFrame, node: str, name: str | None = None, description: str | None = None) -> DataFrame:
    """The tree with another name or description of a node; what is not given stays."""
    _node(tree, node)
    if name is not None and not name.strip():
        raise ValueError("a node has a name")
    own = F.col("id") == node
    out = tree
    for column, value in (("name", name and name.strip()), ("description", description)):
        if value is not None:
            out = out.withColumn(column, F.when(own, F.lit(value)).otherwise(F.col(column)))
    return out


def delete(tree: DataFrame, node: str) -> DataFrame:
    """The tree without a node and all nodes below it."""
    _node(tree, node)
    return tree.where(F.col("id") != node).join(descendants(tree, node), "id", "left_anti")


def replace(trees: DataFrame, key: str, owner: str, new: DataFrame) -> DataFrame:
    """All trees, that of ``owner`` replaced by the rows ``new``; a broken tree is refused."""
    if validate(new).take(1):
        raise ValueError("a node's parent is missing or not a level above it")
    return trees.where(~F.col(key).eqNullSafe(F.lit(owner))).unionByName(new.withColumn(key, F.lit(owner)), allowMissingColumns=True)


def level_counts(tree: DataFrame) -> DataFrame:
    """(level, n)."""
    return tree.groupBy("level").agg(F.count("*").alias("n"))


def next_positions(tree: DataFrame) -> DataFrame:
    """(parent, position) after the last child of every node that has children, the top (null) included."""
    return tree.groupBy("parent").agg((F.max("position") + 1).cast("long").alias("position"))


def palette(tree: DataFrame, colours: int) -> DataFrame:
    """(id, colour) of the top level in order of position."""
    order = Window.orderBy("position", "id")  # the top level only
    return tree.where("level = 1").select("id", ((F.row_number().over(order) - 1) % colours).alias("colour"))


def seed(spark: SparkSession, known: DataFrame, names: list[str]) -> DataFrame:
    """(name) of those not yet among ``known.name``."""
    return spark.createDataFrame([(n,) for n in names], "name string").join(known.select("name"), "name", "left_anti")

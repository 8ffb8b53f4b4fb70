"""Dashboard roll-ups and hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithic.operators.ancestry import climb

SEVERITIES = ("critical", "high", "medium", "low")


def rag_rank(rag: Column) -> Column:
    return F.when(rag == "red", 0).when(rag == "amber", 1).otherwise(2)


def kpi_totals(sheets: DataFrame) -> DataFrame:
    """Sums, the plain mean of completeness, and the worst rating; green for no sheets."""
    return sheets.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).cast("long").alias("row_count"), F.coalesce(F.sum("column_count"), F.lit(0)).cast("long").alias("column_count"),
        F.avg("completeness_pct").alias("completeness_pct"), F.coalesce(F.min_by("rag", rag_rank(F.col("rag"))), F.lit("green")).alias("rag"),
    )


def severity_histogram(issues: DataFrame) -> DataFrame:
    """(severity, n) for all four severities, also those without issues."""
    counts = issues.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in SEVERITIES])))


def issues_per_column(profiles: DataFrame, issues: DataFrame) -> DataFrame:
    """(sheet, column, n): every profiled column of every sheet, and "" for a sheet's own issues, with its number of issues."""
    counts = issues.groupBy("sheet", F.coalesce("column", F.lit("")).alias("column")).agg(F.count("*").alias("n"))
    shown = profiles.select("sheet", "column").unionByName(profiles.select("sheet").distinct().withColumn("column", F.lit("")))
    return shown.join(counts, ["sheet", "column"], "left").select("sheet", "column", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def flatten_tree(levels: list[tuple[DataFrame, str, str, str | None]]) -> DataFrame:
    """(id, parent, level, name) of nested tables given as (rows, id, name, parent id)."""
    parts = []
    for k, (df, key, name, parent) in enumerate(levels):
        up = F.concat(F.lit(f"{k - 1}:"), F.col(parent).cast("string")) if parent else F.lit(None).cast("string")
        parts.append(df.select(F.concat(F.lit(f"{k}:"), F.col(key).cast("string")).alias("id"), up.alias("parent"), F.lit(k + 1).alias("level"), F.col(name).alias("name")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ancestors(tree: DataFrame) -> DataFrame:
    """(id, root) of a tree of any depth; nodes on or below a cycle have no root."""
    return climb(tree).select("id", "root")


def broken_links(tree: DataFrame) -> DataFrame:
    """Nodes whose parent is missing or not one level above."""
    up = tree.select(F.col("id").alias("pid"), F.col("level").alias("plevel"))
    rows = tree.join(up, F.col("parent") == F.col("pid"), "left")
    top = (F.col("level") == 1) & F.col("parent").isNotNull()
    low = (F.col("level") > 1) & (F.col("plevel").isNull() | (F.col("plevel") != F.col("level") - 1))
    return rows.where(top | low).select("id", "parent", "level")


def sibling_rank(tree: DataFrame, by: str = "name") -> DataFrame:
    """(id, position) from 0 among the children of a parent."""
    return tree.select("id", (F.row_number().over(Window.partitionBy("parent").orderBy(by, "id")) - 1).alias("position"))

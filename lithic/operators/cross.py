"""Structure across columns and tables: dependencies, redundancy, inclusion, violations."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.functions.types import cell

GROUPS, CONFIDENCE, CORRELATION, ROWS = 3, 95.0, 0.95, 10
COVERAGE, RELATION = 0.5, 50.0
#: Bits of a column's map of hashed values, as a power of two.
SLOTS = 18
# Fixed value: how descriptions of such issues begin.
FK_LABEL = "[FK violation]"


def functional_dependencies(df: DataFrame) -> DataFrame:
    """(determinant, dependent, n_groups, confidence_pct) of pairs with few groups that hold two values.

    One aggregation per determinant: a group breaks a dependency if the least and greatest
    value of the dependent differ.
    """
    parts = []
    if len(df.columns) < 2:
        return df.sparkSession.createDataFrame([], "determinant string, dependent string, n_groups long, confidence_pct double")
    for a in df.columns:
        others = [b for b in df.columns if b != a]
        groups = df.where(cell(a).isNotNull()).groupBy(cell(a)).agg(*[(F.min(cell(b)) < F.max(cell(b))).alias(f"_{i}") for i, b in enumerate(others)])
        counts = groups.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(F.col(f"_{i}"), F.lit(False))).alias(f"_{i}") for i in range(len(others))])
        rows = F.array(*[F.struct(F.lit(a).alias("determinant"), F.lit(b).alias("dependent"), F.col("n").alias("n_groups"), (100 * (F.col("n") - F.col(f"_{i}")) / F.col("n")).alias("confidence_pct")) for i, b in enumerate(others)])
        parts.append(counts.where(F.col("n") >= GROUPS).select(F.inline(rows)))
    return reduce(DataFrame.unionByName, parts).where(F.col("confidence_pct") >= CONFIDENCE)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(left, right, r) of numeric columns with an absolute Pearson correlation of at least 0.95."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "left string, right string, r double")
    values = df.select(*[cell(c).try_cast("double").alias(c) for c in columns])
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = cell(a).isNotNull() & cell(b).isNotNull()
        x, y = F.when(both, cell(a)), F.when(both, cell(b))
        r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))  # null for a constant column
        aggs += [r.alias(f"r{i}"), F.count_if(both).alias(f"n{i}")]
    rows = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)])
    found = values.agg(*aggs).select(F.inline(rows))
    return found.where((F.col("n") >= ROWS) & F.col("r").isNotNull() & ~F.isnan("r") & (F.abs("r") >= CORRELATION)).select("left", "right", "r")


def name_tokens(name: str) -> set[str]:
    """Lower-case words of a column name, cut before capitals and at other signs."""
    return {t for t in re.split(r"[^a-z0-9]+", re.sub(r"(?<!^)(?=[A-Z])", " ", name).lower()) if t}


def name_similarity(a: str, b: str) -> float:
    x, y = name_tokens(a), name_tokens(b)
    return len(x & y) / len(x | y) if x | y else 0.0


@dataclass
class Sketch:
    """What is known of a column's distinct values: how many, the least, the greatest, and the slots that their hashes take."""

    kind: str
    distinct: int
    rows: int
    least: str
    greatest: str
    slots: np.ndarray

    def may_hold(self, child: Sketch, coverage: float = COVERAGE) -> bool:
        """Whether this column can have a share of a child's values: False is certain, True is not.

        A slot of the child that this column does not take stands for a value that it lacks.
        """
        lacking = int(np.bitwise_count(child.slots & ~self.slots).sum())
        most = min(self.distinct, child.distinct - lacking)
        return self.kind == child.kind and self.least <= child.greatest and child.least <= self.greatest and most >= coverage * child.distinct


def sketches(values: DataFrame) -> dict[int, Sketch]:
    """The sketch of each column id of (id, kind, value, n); 2 ** SLOTS bits a column come to the driver."""
    facts = values.groupBy("id").agg(F.first("kind").alias("kind"), F.count("*").alias("distinct"), F.sum("n").alias("rows"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    out = {r["id"]: Sketch(r["kind"], r["distinct"], r["rows"], r["least"], r["greatest"], np.zeros((1 << SLOTS) // 8, np.uint8)) for r in facts.collect()}
    slot = F.pmod(F.xxhash64("value"), F.lit(1 << SLOTS)) + 1  # buckets count from 1
    parts = values.select("id", slot.alias("slot")).groupBy("id", F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    for r in parts.collect():
        at = (r["bucket"] - 1) * 4096
        part = np.frombuffer(bytes(r["bits"]), np.uint8)[: (1 << SLOTS) // 8 - at]
        out[r["id"]].slots[at : at + len(part)] |= part
    return out


def relationships(tables: dict[str, DataFrame], columns: dict[str, list[str]], kinds: dict[tuple[str, str], str]) -> DataFrame:
    """Suggested parent-child pairs of columns of different tables, by inclusion of distinct values.

    Coverage is the share of a child's values that its parent has. Sketches of all columns
    refute most pairs before any values are joined: kinds, counts, ranges and the slots of
    hashed values bound what a parent can cover. Only the values of a child are then sent to
    each parent that is left.
    """
    spark = next(iter(tables.values())).sparkSession
    parts, owners = [], []
    for t, df in tables.items():
        for c in columns[t]:
            one = df.where(cell(c).isNotNull()).groupBy(cell(c).cast("string").alias("value")).agg(F.count("*").alias("n"))
            parts.append(one.select(F.lit(len(owners)).alias("id"), F.lit(kinds[t, c]).alias("kind"), "value", "n"))
            owners.append((t, c))
    values = reduce(DataFrame.unionByName, parts).persist()
    known = sketches(values)
    pairs = [(p, k) for p in known for k in known if owners[p][0] != owners[k][0] and known[p].may_hold(known[k])]
    sent = values.select(F.col("id").alias("k"), "value").join(F.broadcast(spark.createDataFrame(pairs, "p int, k int")), "k")  # pairs of columns
    both = sent.join(values.select(F.col("id").alias("p"), "value"), ["p", "value"])
    found = both.groupBy("p", "k").agg(F.count("*").alias("common")).collect() if pairs else []  # a row per pair of columns at most
    values.unpersist()
    hits = [(*owners[r["p"]], *owners[r["k"]], r["common"], known[r["k"]].distinct, known[r["k"]].rows) for r in found]
    rows = spark.createDataFrame(hits, "parent_table string, parent_column string, child_table string, child_column string, common long, child_distinct long, child_rows long")
    names = [(a, b, name_similarity(a, b)) for a in {c for cs in columns.values() for c in cs} for b in {c for cs in columns.values() for c in cs}]
    near = spark.createDataFrame(names, "parent_column string, child_column string, name_similarity double")
    rows = rows.join(F.broadcast(near), ["parent_column", "child_column"])
    coverage = F.col("common") / F.col("child_distinct")
    cardinality = F.when(F.col("child_rows") == 0, "unknown").when(F.col("child_rows") == F.col("child_distinct"), "one_to_one").otherwise("many_to_one")
    rows = rows.select("parent_table", "parent_column", "child_table", "child_column", "name_similarity", coverage.alias("coverage"), cardinality.alias("cardinality"))
    sure = F.when(F.col("cardinality") == "unknown", 0.0).otherwise(1.0)
    rows = rows.withColumn("confidence_pct", (1.0 + F.col("name_similarity") + F.col("coverage") + sure) / 4 * 100)
    return rows.where((F.col("coverage") >= COVERAGE) & (F.col("confidence_pct") >= RELATION))


def fk_violations(parent: DataFrame, parent_column: str, child: DataFrame, child_column: str) -> DataFrame:
    """(value) of the child's distinct non-null values that the parent lacks."""
    own = child.where(cell(child_column).isNotNull()).select(cell(child_column).alias("value")).distinct()
    return own.join(parent.select(cell(parent_column).alias("value")).distinct(), "value", "left_anti")


def counter_examples(df: DataFrame, determinant: str, dependent: str, k: int = 10) -> DataFrame:
    """(value): the least ten values of a determinant that go with several values of the dependent."""
    groups = df.where(cell(determinant).isNotNull()).groupBy(cell(determinant).alias("value")).agg((F.min(cell(dependent)) < F.max(cell(dependent))).alias("broken"))
    return groups.where("broken").select(F.col("value").cast("string")).orderBy("value").limit(k)


def fk_labelled(issues: DataFrame) -> DataFrame:
    """The issues that tell of values which a parent lacks."""
    return issues.where(F.contains("description", F.lit(FK_LABEL)))


def fk_issue(violations: DataFrame, parent: tuple[str, str], child: tuple[str, str], k: int = 10) -> DataFrame:
    """No row without violations, else one issue with their number and the least ten as samples."""
    text = F.concat(F.lit(f"{FK_LABEL} {child[0]}.{child[1]} has "), F.col("n").cast("string"), F.lit(f" value(s) not present in {parent[0]}.{parent[1]}."))
    few = violations.select(F.col("value").cast("string")).orderBy("value").limit(k).agg(F.sort_array(F.collect_list("value")).alias("sample_values"))
    total = violations.agg(F.count("*").alias("n")).where("n > 0").crossJoin(F.broadcast(few))  # one row each
    return total.select(F.lit(child[0]).alias("sheet"), F.lit(child[1]).alias("column"), F.lit("validity").alias("dimension"), F.lit("high").alias("severity"), text.alias("description"), "sample_values")

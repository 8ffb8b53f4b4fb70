"""The row query interface: a closed set of filters, projection, limit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.functions.types import cell as whole_name
from lithic.functions.types import is_blank

OPERATORS = ("==", "!=", "<", "<=", ">", ">=", "contains", "in", "is_null", "not_null")
LIMIT, LIMIT_MOST = 10, 50


def predicate(df: DataFrame, column: str, op: str, value=None) -> Column:
    """One filter as a column that is never null."""
    if column not in df.columns:
        raise ValueError(f"unknown column {column!r}")
    cell, kind = whole_name(column), dict(df.dtypes)[column]
    shown = cell.cast("string")
    if op in ("is_null", "not_null"):
        blank = is_blank(shown)
        return blank if op == "is_null" else ~blank
    if op in ("==", "!="):
        same = F.coalesce(shown == str(value), F.lit(False))
        if kind != "string" and isinstance(value, (int, float)) and not isinstance(value, bool):
            same = same | F.coalesce(cell.try_cast("double") == float(value), F.lit(False))
        return same if op == "==" else ~same
    if op in ("<", "<=", ">", ">="):
        number, bound = shown.try_cast("double"), F.lit(float(value))
        return F.coalesce({"<": number < bound, "<=": number <= bound, ">": number > bound, ">=": number >= bound}[op], F.lit(False))
    if op == "contains":
        if not isinstance(value, str):
            raise ValueError("contains needs a text")
        return F.contains(F.lower(F.coalesce(shown, F.lit("nan"))), F.lit(value.lower()))
    if op == "in":
        if not isinstance(value, list):
            raise ValueError("in needs a list")
        text = kind == "string"
        fitting = [v for v in value if isinstance(v, str) == text]
        return F.coalesce(cell.isin(fitting), F.lit(False)) if fitting else F.lit(False)
    raise ValueError(f"unknown operator {op!r}")


def where(df: DataFrame, filters: list[dict]) -> DataFrame:
    if not filters:
        return df
    return df.where(reduce(lambda a, b: a & b, [predicate(df, f["column"], f["op"], f.get("value")) for f in filters]))


def query(df: DataFrame, filters: list[dict], columns: list[str] | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows up to the limit, one row with row_count_total): the count is before the limit."""
    matched = where(df, filters)
    for c in columns or []:
        if c not in df.columns:
            raise ValueError(f"unknown column {c!r}")
    most = max(1, min(limit if limit is not None else LIMIT, LIMIT_MOST))
    return matched.select(*[whole_name(c) for c in columns or df.columns]).limit(most), matched.agg(F.count("*").alias("row_count_total"))

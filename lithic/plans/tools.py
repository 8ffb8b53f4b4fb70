"""The tools of a chat about a dataset: descriptions, issues, rows, flags, and a dispatcher that turns faults into text.

Answers are JSON texts of bounded length: what they show has a row per sheet, column or
issue, or at most LIMIT_MOST rows of data.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.functions.text import RESULT_CHARS
from lithic.operators import rows
from lithic.plans import report
from lithic.plans.listings import json_rows
from lithic.sources.store import Store


@dataclass
class Context:
    """What the tools of one dataset read."""

    store: Store
    dataset: str
    sheets: dict[str, DataFrame]

    def table(self, name: str) -> DataFrame:
        found = self.store.load(self.dataset, "profile", name)
        if found is None:
            raise ValueError("the dataset has no profile yet")
        return found


def _objects(df: DataFrame) -> list[dict]:
    return [json.loads(r.json) for r in json_rows(df).collect()]


def describe_dataset(at: Context) -> dict:
    """Sheets with their counts and ratings, and their columns with type, nulls and rating."""
    short = at.table("columns").select("sheet", "ordinal", "column", "semantic_type", F.round("null_pct", 2).alias("null_pct"), "distinct_count", "rag")
    return {"dataset": at.dataset, "sheets": _objects(report.nested(at.table("sheets"), short).orderBy("sheet"))}


def describe_column(at: Context, sheet: str, column: str) -> dict:
    """The whole profile of a column with its top values, and its issues."""
    on = (F.col("sheet") == sheet) & (F.col("column") == column)
    found = report.payload(at.table("columns").where(on), at.table("top_values").where(on)).collect()
    if not found:
        raise ValueError(f"unknown column {column!r} of sheet {sheet!r}")
    return json.loads(found[0].json) | {"issues": list_issues(at, sheet=sheet, column=column)["issues"]}


def list_issues(at: Context, sheet: str | None = None, column: str | None = None, severity: str | None = None) -> dict:
    found, more = report.list_issues(at.table("issues"), sheet, column, severity, by_rank=True)
    return {"issues": _objects(found), "truncated": more}


def query_dataset(at: Context, sheet: str, filters: list[dict] | None = None, columns: list[str] | None = None, limit: int | None = None) -> dict:
    """Rows that pass the filters, at most LIMIT_MOST, and how many pass."""
    if sheet not in at.sheets:
        raise ValueError(f"unknown sheet {sheet!r}")
    got, total = rows.query(at.sheets[sheet].drop("_row_index"), filters or [], columns, limit)
    return {"rows": _objects(got), "row_count_total": total.first()["row_count_total"]}


def flag_issue(at: Context, sheet: str, dimension: str, severity: str, description: str, column: str | None = None, samples: list[str] | None = None) -> dict:
    report.flag_issue(at.store, at.dataset, sheet, dimension, severity, description, column, samples)
    return {"ok": True}


TOOLS = {"describe_dataset": describe_dataset, "describe_column": describe_column, "list_issues": list_issues, "query_dataset": query_dataset, "flag_issue": flag_issue}


def dispatch(at: Context, tool: str, arguments: dict, most: int = RESULT_CHARS) -> str:
    """The answer of a tool as JSON; what the caller did wrong and any other fault come back as ``error``."""
    try:
        if tool not in TOOLS:
            raise ValueError(f"unknown tool {tool!r}")
        text = json.dumps(TOOLS[tool](at, **arguments), ensure_ascii=False)
    except (ValueError, TypeError, KeyError) as e:
        return json.dumps({"error": str(e)})
    except Exception as e:  # noqa: BLE001 - a chat goes on whatever a tool does
        return json.dumps({"error": f"{tool} failed: {type(e).__name__}"})
    return text if len(text) <= most else text[:most] + f"\n\n[truncated, original was {len(text)} chars]"

"""Narratives for issues from a pluggable text model, in batches, checked against a strict shape."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.functions.text import strip_codefence
from lithic.operators.graph import numbered

BATCH, MOST_CHARS = 20, 1000
ASK = 'Explain each issue and suggest a fix. Answer with JSON only: {"annotations": [{"issue_id": int, "narrative": str, "suggested_fix": str}]}'
AGAIN = "The last answer did not have the asked shape. " + ASK
OUT = "issue_id long, ai_status string, ai_narrative string, ai_fix string, ai_raw string"


def offline(system: str, user: str) -> str:
    """A model that needs no network: it restates each issue."""
    rows = json.loads(user)["issues"]
    return json.dumps({"annotations": [{"issue_id": r["issue_id"], "narrative": r["description"][:MOST_CHARS], "suggested_fix": f"Review the {r['dimension']} of the data."} for r in rows]})


def _answers(raw: str) -> dict[int, tuple[str, str]] | None:
    """By issue, narrative and fix; None unless the whole answer has the asked shape."""
    try:
        items = json.loads(strip_codefence(raw))["annotations"]
        out = {}
        for item in items:
            key, pair = item["issue_id"], (item["narrative"], item["suggested_fix"])
            if isinstance(key, bool) or not isinstance(key, int) or any(not isinstance(t, str) or not 1 <= len(t) <= MOST_CHARS for t in pair):
                return None
            out[key] = pair
        return out
    except (ValueError, TypeError, KeyError):
        return None


def annotate(issues: DataFrame, model: Callable[[str, str], str] = offline) -> DataFrame:
    """``issues`` (with issue_id) plus ai_status, ai_narrative, ai_fix, ai_raw.

    Batches of 20 by issue_id go to tasks; one retry follows an answer of the wrong shape.
    An issue that no answer names is failed and keeps the raw answer. A model that raises
    fails its batch alone.
    """
    shown = ["issue_id", "sheet", "column", "dimension", "severity", "description"]
    batches = numbered(issues.select(*shown), "rank", F.col("issue_id").asc()).withColumn("batch", F.floor(F.col("rank") / BATCH)).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct(*shown))).alias("rows"))
    asked = batches.select(F.to_json(F.struct(F.col("rows").alias("issues"))).alias("user"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for user in part["user"]:
                raw, found = "", None
                for system in (ASK, AGAIN):
                    try:
                        raw = model(system, user)
                    except Exception as e:  # noqa: BLE001 - any fault of a model is that batch's result
                        raw = f"{type(e).__name__}: {e}"
                        break
                    found = _answers(raw)
                    if found is not None:
                        break
                rows = []
                for issue in json.loads(user)["issues"]:
                    got = (found or {}).get(issue["issue_id"])
                    rows.append((issue["issue_id"], "done", *got, None) if got else (issue["issue_id"], "failed", None, None, raw))
                yield pd.DataFrame(rows, columns=["issue_id", "ai_status", "ai_narrative", "ai_fix", "ai_raw"])

    return issues.join(asked.mapInPandas(run, OUT), "issue_id", "left").na.fill("pending", ["ai_status"])


def report(annotated: DataFrame) -> DataFrame:
    """One row: issues done and failed, and batches."""
    return annotated.agg(F.count_if(F.col("ai_status") == "done").alias("done"), F.count_if(F.col("ai_status") == "failed").alias("failed"), F.ceil(F.count("*") / BATCH).alias("batches"))

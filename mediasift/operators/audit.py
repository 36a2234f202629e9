"""Audit rows: exactly one per request, success or failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import AUDIT

CONTEXT = ("tenant_id", "trace_id", "workflow_run_id", "agent_run_id", "actor_type", "actor_id")


def audit_rows(
    outcomes: DataFrame, *, tool_name: str, tool_version: str, created_at: Column | None = None
) -> DataFrame:
    """``outcomes``: one row per request with input_hash, output_hash, error_code
    and whatever context columns are known."""
    columns = {
        **{c: F.col(c) if c in outcomes.columns else F.lit(None).cast("string") for c in CONTEXT},
        "event_type": F.when(F.col("error_code").isNotNull(), "tool.failed").otherwise("tool.succeeded"),
        "tool_name": F.lit(tool_name),
        "tool_version": F.lit(tool_version),
        "input_hash": F.col("input_hash"),
        "output_hash": F.when(F.col("error_code").isNull(), F.col("output_hash")),
        "error_code": F.col("error_code"),
        "created_at": created_at if created_at is not None else F.current_timestamp(),
    }
    return outcomes.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in AUDIT.fields])


def audit_append(rows: DataFrame, path: str) -> None:
    """Appends JSON lines; the file commit is atomic per write."""
    rows.write.mode("append").json(path)

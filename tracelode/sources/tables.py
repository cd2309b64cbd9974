"""Trace events of the ingested table, checked row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions.readings import is_blank, read_hook
from tracelode.session import table

FIELDS = ("timestamp", "user_instruction", "plan_summary", "proposed_tool", "tool_args", "observation", "state_delta", "self_check", "t_risk", "risk_event", "risk_type", "severity", "notes", "source_batch")


def checked(events: DataFrame) -> DataFrame:
    """Adds ``reject_reason``: the first check a row fails, null for a valid event."""
    # an object: what parses and begins as one
    bad_json = lambda c: F.col(c).isNotNull() & (F.try_parse_json(c).isNull() | ~F.col(c).rlike(r"^\s*\{"))
    reason = (
        F.when(is_blank(F.col("episode_id")), "episode_id")
        .when(F.col("step_id").isNull(), "step_id")
        .when(read_hook(F.col("hook_type")).isNull(), "hook_type")
        .when(bad_json("tool_args") | bad_json("state_delta") | bad_json("self_check"), "json")
    )
    return events.withColumn("reject_reason", reason)


def valid_events(events: DataFrame) -> DataFrame:
    """Valid rows with the hook kind as read; ``seq`` is the order of ingestion."""
    ok = checked(events).where(F.col("reject_reason").isNull())
    return ok.select(F.col("ingest_id").alias("seq"), "episode_id", "step_id", read_hook(F.col("hook_type")).alias("hook_type"), *FIELDS)


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_events(table(spark, sf_dir, "trace_events"))

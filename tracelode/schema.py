"""Schemas of the trace model."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

TRACE_EVENT = StructType(
    [
        StructField("episode_id", StringType()),
        StructField("step_id", LongType()),
        StructField("hook_type", StringType()),
        StructField("timestamp", StringType()),
        StructField("user_instruction", StringType()),
        StructField("plan_summary", StringType()),
        StructField("proposed_tool", StringType()),
        StructField("tool_args", StringType()),
        StructField("observation", StringType()),
        StructField("state_delta", StringType()),
        StructField("self_check", StringType()),
        StructField("t_risk", LongType()),
        StructField("risk_event", BooleanType()),
        StructField("risk_type", StringType()),
        StructField("severity", DoubleType()),
        StructField("notes", StringType()),
    ]
)
#: Semantic key of a prefix row.
KEY = ("episode_id", "step_id", "hook_type")

"""Line-delimited JSON traces: strict and lenient scans, sinks, run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.functions.readings import HOOKS
from tracelode.schema import TRACE_EVENT

_RAW = "episode_id string, step_id string, hook_type string, timestamp string, user_instruction string, plan_summary string, proposed_tool string, tool_args string, observation string, state_delta string, self_check string, t_risk string, risk_event string, risk_type string, severity string, notes string"


def scan_traces(spark: SparkSession, path: str) -> DataFrame:
    """All events of the files with ``reject_reason`` (null: valid), ``file``, ``line_no`` in it and ``seq``; blank lines are skipped.

    Objects stay JSON text; numbers may be quoted. ``seq`` counts the lines of all files in the order of
    their names: lines are numbered inside each block of a file that is read at once, and the blocks' sizes,
    one row a block, carry the numbers on, so that no task sorts more than a block.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.trim("value").alias("line"))
    blocks = lines.groupBy("file", "at").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select("file", "at", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("all"), F.coalesce(F.sum("n").over(in_file), F.lit(0)).alias("own"))
    k = F.row_number().over(Window.partitionBy("file", "at").orderBy("id"))
    lines = lines.withColumn("k", k).join(carry, ["file", "at"]).select("file", (F.col("own") + F.col("k")).alias("line_no"), (F.col("all") + F.col("k")).alias("seq"), "line")
    lines = lines.where(F.col("line") != "")
    rows = lines.withColumn("e", F.from_json("line", _RAW)).withColumn("v", F.try_parse_json("line"))
    object_ = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit("{}"))
    step = F.col("e.step_id").try_cast("double")
    reason = (
        F.when(F.col("v").isNull() | ~F.substring("line", 1, 1).eqNullSafe("{"), "json")
        .when(F.col("e.episode_id").isNull(), "episode_id")
        .when(step.isNull() | (step != F.floor(step)), "step_id")
        .when(F.col("e.hook_type").isNull() | ~F.col("e.hook_type").isin(*HOOKS), "hook_type")
        .when(F.col("e.severity").isNotNull() & F.col("e.severity").try_cast("double").isNull(), "severity")
    )
    typed: list[Column] = []
    for f in TRACE_EVENT.fields:
        c = F.col(f"e.{f.name}")
        if f.name in ("tool_args", "state_delta", "self_check"):
            c = object_(f.name)
        elif f.name == "user_instruction":
            c = F.coalesce(c, F.lit(""))
        elif f.name in ("step_id", "t_risk"):
            c = c.try_cast("double").cast("long")
        else:
            c = c.try_cast(f.dataType)
        typed.append(c.alias(f.name))
    return rows.select(*typed, reason.alias("reject_reason"), "file", "line_no", "seq", "line")


def strict_traces(spark: SparkSession, path: str) -> DataFrame:
    """Valid events; the first bad line of the lowest file raises, with its number."""
    rows = scan_traces(spark, path)
    bad = rows.where(F.col("reject_reason").isNotNull()).orderBy("seq").limit(1).collect()
    if bad:
        raise ValueError(f"invalid trace line {bad[0]['line_no']} in {bad[0]['file']}: {bad[0]['reject_reason']}")
    return rows.drop("reject_reason", "line")


def write_traces(events: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object per line; JSON texts become objects again."""
    cols = [F.try_parse_json(c).alias(c) if c in ("tool_args", "state_delta", "self_check") else F.col(c) for c in events.columns if c in {f.name for f in TRACE_EVENT.fields}]
    events.select(F.to_json(F.struct(*cols)).alias("value")).write.mode(mode).text(path)


def run_summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """``batch, suite, status, task_id, task_status, stop_reason, utility, security``: one row per task result; the batch is the parent folder."""
    schema = "suite string, status string, task_results array<struct<task_id string, status string, stop_reason string, utility boolean, security boolean>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("file", F.col("_metadata.file_path"))
    return raw.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("batch"), "suite", "status", F.inline("task_results")).toDF("batch", "suite", "status", "task_id", "task_status", "stop_reason", "utility", "security")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export; maps, arrays and structs become JSON text."""
    cols = [F.to_json(c).alias(c) if k.startswith(("array", "map", "struct")) else F.col(c) for c, k in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)

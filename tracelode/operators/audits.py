"""Audits of traces and datasets: duplicates, leakage in notes, coverage, provenance, one-pass stream counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions.terms import OUTCOME

FORBIDDEN_FEATURES = ("future_risk_label", "future_severity", "t_risk", "lead_time_if_alert_now", "oracle_violation", "oracle_rules", "risk_score", "policy", "utility", "security")


def duplicate_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``duplicate_keys, duplicate_rows``: all members of groups with more than one row count."""
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return per.agg(F.count(F.lit(1)).alias("duplicate_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"))


def episodes_in_several_batches(df: DataFrame, allowed: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """``episode_id, n_batches, batches`` of episodes found in more than one batch, allowed pairs left out."""
    per = df.where(F.col("source_batch").isNotNull()).groupBy("episode_id").agg(F.array_sort(F.collect_set("source_batch")).alias("b"))
    out = per.where(F.size("b") > 1).select("episode_id", F.size("b").cast("long").alias("n_batches"), F.array_join("b", ";").alias("batches"))
    return out.where(~F.col("batches").isin(*[";".join(sorted(p)) for p in allowed])) if allowed else out


def notes_leakage(events: DataFrame, terms: Sequence[str] = OUTCOME) -> DataFrame:
    """``term, n_events, n_final``: events whose notes contain a term of the outcome."""
    notes = F.lower(F.coalesce("notes", F.lit("")))
    each = F.array(*[F.struct(F.lit(t).alias("term"), notes.contains(t).alias("hit")) for t in terms])
    return (
        events.select("hook_type", F.explode(each).alias("x"))
        .where("x.hit")
        .groupBy("x.term")
        .agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("hook_type") == "final").alias("n_final"))
    )


def stream_audit(events: DataFrame, large: int = 32_000) -> DataFrame:
    """``dimension, value, n_events, n_episodes, n_large`` by hook, batch and in total: one scan, one Expand."""
    size = F.octet_length(F.coalesce("observation", F.lit("")))
    d = events.select("hook_type", "source_batch", "episode_id", (size > large).cast("int").alias("big"))
    grouped = d.groupingSets([["hook_type"], ["source_batch"], []], "hook_type", "source_batch").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct("episode_id").alias("n_episodes"), F.sum("big").alias("n_large"), F.grouping("hook_type").alias("gh"), F.grouping("source_batch").alias("gb")
    )
    dim = F.when(F.col("gh") == 0, "hook_type").when(F.col("gb") == 0, "source_batch").otherwise("all")
    value = F.coalesce(F.when(F.col("gh") == 0, F.col("hook_type")).when(F.col("gb") == 0, F.col("source_batch")), F.lit(""))
    return grouped.select(dim.alias("dimension"), value.alias("value"), "n_events", "n_episodes", "n_large")


def range_coverage(df: DataFrame, task_no: Column, least: int, most: int) -> DataFrame:
    """``source_batch, n_tasks, n_outside, n_missing``: task numbers of each batch against the expected range."""
    per = df.select("source_batch", task_no.alias("t")).where(F.col("t").isNotNull()).distinct()
    inside = F.col("t").between(least, most)
    return per.groupBy("source_batch").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.count_if(~inside).alias("n_outside"), (F.lit(most - least + 1) - F.count_if(inside)).alias("n_missing")
    )


def selected_features(df: DataFrame) -> list[str]:
    """Numeric and boolean columns that a model may see; ``risk_score`` is one, as it is known at each event."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    return [n for n, k in df.dtypes if k in kinds and (n == "risk_score" or n not in (*FORBIDDEN_FEATURES, "step_id", "seq", "label"))]


def leakage(features: Sequence[str]) -> list[str]:
    """Forbidden columns among the features of a model."""
    return [f for f in features if f in FORBIDDEN_FEATURES]


def split_overlap(splits: DataFrame) -> DataFrame:
    """``episode_id, n_splits``: episodes that are in more than one split."""
    return splits.groupBy("episode_id").agg(F.count_distinct("split").alias("n_splits")).where(F.col("n_splits") > 1)


def same_assignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """``only_a, only_b, differing`` of two assignments of episodes."""
    j = a.select("episode_id", F.col("split").alias("x")).join(b.select("episode_id", F.col("split").alias("y")), "episode_id", "full_outer")
    return j.agg(F.count_if(F.col("y").isNull()).alias("only_a"), F.count_if(F.col("x").isNull()).alias("only_b"), F.count_if(F.col("x") != F.col("y")).alias("differing"))

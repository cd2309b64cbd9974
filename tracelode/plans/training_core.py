"""Queries of the general problems: superfluous deliveries (p2) and drifting schemas (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.operators import drift
from tracelode.operators.deliveries import DeliveryStore
from tracelode.session import scratch, table, written

#: Batch kinds that bring messages again or late; they are merged into the history of the others.
LATE_KINDS = ("recovery", "backfill")


def delivered(spark: SparkSession, sf_dir: str) -> DeliveryStore:
    """A store with all of trace_events: first the regular batches, then the late ones."""
    events = table(spark, sf_dir, "trace_events").select("ingest_id", "episode_id", "step_id", "hook_type", "timestamp", "source_batch", "ingested_at")
    kinds = table(spark, sf_dir, "source_batches").groupBy("source_batch").agg(F.max("batch_kind").alias("batch_kind"))
    rows = events.join(kinds, "source_batch", "left")
    late = F.coalesce(F.col("batch_kind").isin(*LATE_KINDS), F.lit(False))
    store = DeliveryStore(spark, scratch(spark, "deliveries"))
    store.load(rows.where(~late))
    store.load(rows.where(late))
    return store


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivered(spark, sf_dir).removed()


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivered(spark, sf_dir).current().select("ingest_id", "episode_id", "step_id", F.col("hook").alias("hook_type"), F.col("at").alias("at_micros"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(written(drift.ingest(table(spark, sf_dir, "trace_file_lines")), "ingested"))


def p6_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ingested = written(drift.ingest(table(spark, sf_dir, "trace_file_lines")), "ingested")
    return drift.promote(ingested, written(drift.changes(ingested), "changes"))


QUERIES = {"p2_found": p2_found, "p2_kept": p2_kept, "p6_found": p6_found, "p6_events": p6_events}

_HOOK = "case regexp_replace(lower(hook_type), '[\\s_\\-]+', '', 'g') when 'prestep' then 'pre_step' when 'poststep' then 'post_step' when 'checkpoint' then 'checkpoint' when 'final' then 'final' end"
AT = """case when regexp_full_match(trim(timestamp), '[0-9]{1,15}') then cast(trim(timestamp) as bigint) * 1000
  when regexp_matches(trim(timestamp), '(Z|[+-][0-9]{2}:[0-9]{2})$') then epoch_us(try_cast(trim(timestamp) as timestamptz))
  else epoch_us(try_cast(trim(timestamp) as timestamp)) end"""
CASES = f"""cases as (
  select *, row_number() over (partition by episode_id, step_id, hook, moment order by ingested_at nulls last, ingest_id) as nth from (
    select ingest_id, episode_id, step_id, {_HOOK} as hook, {AT} as moment, ingested_at from trace_events where trim(episode_id) <> '' and step_id is not null)
  where hook is not null and moment is not null)"""
SQL = {
    "p2_found": f"with {CASES} select ingest_id from cases where nth > 1",
    "p2_kept": f"with {CASES} select ingest_id, episode_id, step_id, hook as hook_type, moment as at_micros from cases where nth = 1",
}

"""Best representative of each duplicate group: field-by-field survivorship in a single aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words that stand for a missing value
STAND_INS = ("null", "none", "(none)", "n/a", "na", "nan", "nil", "unknown", "missing", "tbd", "?", "-", "")
FIELDS = ("user_task_id", "prompt", "agent_name", "sandbox_id")


def has_value(c: Column) -> Column:
    """False for null, blank and the words that stand for a missing value."""
    bare = F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))
    return F.coalesce(~bare.isin(*STAND_INS), F.lit(False))


def _bare(c: Column) -> Column:
    """A component of an episode id without case, separators and leading zeros of its number."""
    kept = F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "")
    return F.regexp_replace(kept, r"(^|[a-z])0+([0-9])", "$1$2")


def episode_key() -> Column:
    """One key for all spellings of an episode, null if nothing names it.

    Read from ``episode_id`` (any case, percent-escapes, ``:``, ``/`` or ``|`` between the parts,
    spaces, hyphens, a leading collection name); a part that the id lacks is taken from the columns
    suite_name, user_task_id, attack_type, injection_task_id, where the last two mean ``none`` if null.
    """
    plain = F.lower(F.col("episode_id"))
    for code, sign in (("%3a", ":"), ("%2f", "/"), ("%7c", "|"), ("%20", " "), ("%5f", "_")):
        plain = F.replace(plain, F.lit(code), F.lit(sign))
    parts = F.split(plain, r"[:/|]")
    parts = F.when(F.size(parts) > 4, F.slice(parts, 2, 4)).otherwise(parts)
    columns = ("suite_name", "user_task_id", "attack_type", "injection_task_id")
    read = []
    for i, name in enumerate(columns):
        own = F.get(parts, F.lit(i))
        own = F.when(_bare(own) != "", own)
        other = F.when(has_value(F.col(name)), F.col(name))
        read.append(_bare(F.coalesce(own, other, F.lit("none")) if i >= 2 else F.coalesce(own, other)))
    # concat is null if the suite or the user task is unknown
    return F.concat(read[0], F.lit(":"), read[1], F.lit(":"), read[2], F.lit(":"), read[3])


def survivors(contexts: DataFrame, batches: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per group of two or more records: ``group_id`` and per field a struct of record and value.

    Of the records that have a value, the one with the highest trust of its batch wins (no known batch:
    lowest), then the latest ``updated_at`` (null: oldest), then the smallest ``record_id``. Everything
    is one aggregation of maxima, combined before the shuffle, so a group may hold any share of all rows.
    Records that nothing names, and those without ``record_id``, are in no group. A field's struct is
    null if no record has a value.
    """
    trust = batches.groupBy("source_batch").agg(F.max("trust").alias("_trust"))
    rows = contexts.where(F.col("record_id").isNotNull()).withColumn("_key", episode_key()).where(F.col("_key").isNotNull())
    rows = rows.select("_key", "record_id", "updated_at", "source_batch", *fields).join(trust, "source_batch", "left")

    def best(field: str) -> Column:
        rank = F.struct(F.col("_trust"), F.col("updated_at"), (-F.col("record_id")).alias("r"), F.col(field).alias("value"))
        return F.max(F.when(has_value(F.col(field)), rank)).alias(field)

    groups = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("record_id").alias("group_id"), *[best(f) for f in fields])
    winner = lambda f: F.when(F.col(f).isNotNull(), F.struct((-F.col(f)["r"]).alias("record_id"), F.col(f)["value"].alias("value"))).alias(f)
    return groups.where(F.col("_n") >= 2).select("group_id", *[winner(f) for f in fields])


def surviving_fields(contexts: DataFrame, batches: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``group_id, field_name, record_id``: the record whose value survives, no row where none has one."""
    wide = survivors(contexts, batches, fields)
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f)["record_id"].alias("record_id")) for f in fields])
    return wide.select("group_id", F.explode(each).alias("x")).where(F.col("x.record_id").isNotNull()).select("group_id", "x.field_name", "x.record_id")


def golden_records(contexts: DataFrame, batches: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One built record per group: ``group_id`` and the surviving value of every field."""
    return survivors(contexts, batches, fields).select("group_id", *[F.col(f)["value"].alias(f) for f in fields])

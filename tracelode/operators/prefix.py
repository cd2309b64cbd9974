"""Prefix dataset: what was known at each event of an episode, by one segmented scan.

A window over a whole episode would put an episode with a third of all rows into one task. Here texts are
reduced to narrow numeric columns once, the rows of an episode are cut into blocks of step numbers, and
everything that runs along an episode is computed inside the blocks, for the two or three states that a
block can be entered in (confirmed before or not, an error before or not, a rule violated before or not).
The blocks' totals, one row each, are scanned per episode, which tells the state and the carry of every
block, and these are joined back: rows are shuffled once, however many columns run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.readings import hook_ord
from tracelode.operators import features as P
from tracelode.session import spread, written

BLOCK = 2048
DECAY = 0.85
VIOLATION_FLOOR = 75.0
COUNTED = {
    "cumulative_state_modifying_count": "f_state_modifying", "cumulative_irreversible_count": "f_irreversible", "cumulative_sensitive_access_count": "f_sensitive_access",
    "cumulative_external_send_count": "f_external_send", "cumulative_fallback_count": "f_fallback_count", "cumulative_observation_error_count": "f_observation_error",
    "cumulative_stream_variance": "d_stream_variance",
}
HIGHEST = {
    "max_stream_variance_so_far": "d_stream_variance", "max_self_check_gap_so_far": "d_self_check_gap", "max_self_check_underreport_gap_so_far": "d_self_check_underreport_gap",
    "max_plan_action_gap_so_far": "d_plan_action_gap", "max_intent_action_gap_so_far": "d_intent_action_gap", "max_observation_action_gap_so_far": "d_observation_action_gap",
    "confirmation_seen_so_far": "f_confirm_seen",
}
FLAGS = (*P.ROW_FLAGS, "f_fallback_after_error")
PREFIX_COLUMNS = (
    "episode_id", "step_id", "hook_type", *P.STEP_FEATURES, *[c for c in COUNTED if c != "cumulative_stream_variance"], "cumulative_disagreement_count",
    "confirmation_seen_so_far", "max_risk_score_so_far", "max_disagreement_score_so_far", *P.STREAM_FEATURES, "cumulative_stream_variance", *[c for c in HIGHEST if c != "confirmation_seen_so_far"],
    *FLAGS, "oracle_violation", "oracle_rules", "risk_score", "policy", "future_risk_label", "future_severity", "t_risk", "lead_time_if_alert_now",
)

_ORDER = ("step_id", "_ord", "seq")
#: Keeps logarithms of scores above 0, which stands for "no score yet".
_SHIFT = 60.0


def decay_weight(value: Column, k: Column, decay: float = DECAY) -> Column:
    """Logarithm of a value undone of its decay at position ``k``; its running maximum gives the decayed maximum."""
    return F.when(value > 1e-12, F.log(value) - k * math.log(decay) + _SHIFT).otherwise(0.0)


def decayed(weight: Column, k: Column, decay: float = DECAY) -> Column:
    """Decayed maximum at position ``k`` from the running maximum of ``decay_weight``, to nine digits; cannot overflow however long the episode is."""
    return F.when(weight > 0, F.round(F.exp(weight - _SHIFT + k * math.log(decay)), 9)).otherwise(0.0)


def policy(score: Column) -> Column:
    """Policy bucket with inclusive upper bounds 20, 40, 60, 80."""
    return F.when(score <= 20, "continue").when(score <= 40, "watch").when(score <= 60, "verify").when(score <= 80, "alert").otherwise("block")


def policy_lower(score: Column, verify: float, alert: float, block: float) -> Column:
    """Policy bucket of the threshold sweep: inclusive lower bounds, ``watch`` from half of ``verify`` on; a null score is ``continue``."""
    return F.when(score >= block, "block").when(score >= alert, "alert").when(score >= verify, "verify").when(score >= max(0.0, verify / 2.0), "watch").otherwise("continue")


def policy_floor_watch(score: Column, verify: float, alert: float, block: float) -> Column:
    """Policy bucket of the utility slices: inclusive lower bounds, everything below ``verify`` is ``watch``."""
    return F.when(score >= block, "block").when(score >= alert, "alert").when(score >= verify, "verify").otherwise("watch")


def row_features(events: DataFrame, full: bool = True) -> DataFrame:
    """Row-local columns of valid events, narrow: no texts; without ``full`` only what rules and scores need."""
    df = P.step_features(events)
    if full:
        df = P.disagreement_flags(P.stream_features(df))
    danger = (F.col("hook_type") == "pre_step") & (F.greatest("f_confirm_required", "f_irreversible", "f_external_send") == 1)
    df = df.withColumns(
        {
            "_ord": hook_ord(F.col("hook_type")),
            "_danger": danger.cast("int"),
            "_r2": F.col("f_unprotected_fallback"),
            "_r3": ((F.col("f_external_send") == 1) & F.col("_has_args") & (F.col("f_confirm_seen") == 0)).cast("int"),
            "_raw": P.raw_score(),
            "severity": F.coalesce("severity", F.lit(0.0)),
            "risk_event": F.coalesce("risk_event", F.lit(False)),
        }
    )
    more = [*P.STEP_FEATURES, *P.STREAM_FEATURES, *P.ROW_FLAGS, "_recovers"] if full else ["f_confirm_seen"]
    keep = ["episode_id", "step_id", "hook_type", "seq", "_ord", *more, "_danger", "_r2", "_r3", "_raw", "severity", "risk_event", F.col("t_risk").alias("_t_risk")]
    return df.select(*keep)


def _local(rows: DataFrame, full: bool) -> DataFrame:
    """Running values inside each block; where they depend on the state a block is entered in, one column for each state.

    ``_c`` confirmed, ``_e`` error before the row, ``_v1.._v3`` rules violated; by state: ``_n0, _n1`` flags without
    and with an error before, ``_f00, _f10, _f1`` floored scores (nothing before; confirmed before; violated
    before) and ``_w..`` their decay weights.
    """
    rows = rows.withColumn("_block", F.floor(F.col("step_id") / BLOCK).cast("long"))
    here = Window.partitionBy("episode_id", "_block").orderBy(*_ORDER)
    upto, before = here.rowsBetween(Window.unboundedPreceding, Window.currentRow), here.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_k": F.row_number().over(here).cast("long"), "_c": F.max("f_confirm_seen").over(upto)})
    if full:
        rows = rows.withColumn("_e", F.coalesce(F.max("f_observation_error").over(before), F.lit(0)))
        other = sum((F.col(f) for f in P.ROW_FLAGS[1:]), F.col(P.ROW_FLAGS[0]))
        rows = rows.withColumns({"_n0": other + F.col("_e") * F.col("_recovers"), "_n1": other + F.col("_recovers")})
        rows = rows.withColumns(
            {f"_s_{k}": F.sum(v).over(upto) for k, v in COUNTED.items()} | {f"_m_{k}": F.max(v).over(upto) for k, v in HIGHEST.items()}
            | {f"_s_n{x}": F.sum(f"_n{x}").over(upto) for x in (0, 1)} | {f"_m_n{x}": F.max(f"_n{x}").over(upto) for x in (0, 1)}
        )
    rows = rows.withColumn("_d1", ((F.col("_danger") == 1) & (F.col("_c") == 0)).cast("int"))
    rows = rows.withColumns({v: F.max(c).over(upto) for v, c in (("_v1", "_d1"), ("_v2", "_r2"), ("_v3", "_r3"))})
    floor = F.greatest(F.col("_raw"), F.lit(VIOLATION_FLOOR))
    rows = rows.withColumns({"_f00": F.when(F.greatest("_v1", "_v2", "_v3") == 1, floor).otherwise(F.col("_raw")), "_f10": F.when(F.greatest("_v2", "_v3") == 1, floor).otherwise(F.col("_raw")), "_f1": floor})
    return rows.withColumns({f"_m{f}": F.max(f).over(upto) for f in _STATES} | {f"_w{f}": F.max(decay_weight(F.col(f), F.col("_k"))).over(upto) for f in _STATES})


_STATES = ("_f00", "_f10", "_f1")


def _state(prefix: str) -> Column:
    """Of the columns by state the one that holds for the block."""
    return F.when(F.col("violated_in") == 1, F.col(f"{prefix}_f1")).when(F.col("c_in") == 1, F.col(f"{prefix}_f10")).otherwise(F.col(f"{prefix}_f00"))


def _onward(w: Column) -> Column:
    """A weight by positions of the block as one by positions of the episode."""
    return F.when(w > 0, w - F.col("k_in") * math.log(DECAY)).otherwise(0.0)


def _carries(local: DataFrame, full: bool) -> DataFrame:
    """One row per block: the state it is entered in, what ran up to it, the severity after it, and the risk steps of its episode."""
    top = lambda c: F.max(c).alias(c)
    step = lambda cond: F.when(cond, F.col("step_id"))
    flag = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    running = ["_k", "_c", "_v1", "_v2", "_v3", *[f"_m{f}" for f in _STATES], *[f"_w{f}" for f in _STATES]]
    if full:
        running += [*[f"_s_{k}" for k in COUNTED], *[f"_m_{k}" for k in HIGHEST], "_s_n0", "_s_n1", "_m_n0", "_m_n1"]
    # no running value ever falls, so a block's last one is its largest
    blocks = local.groupBy("episode_id", "_block").agg(
        *[top(c) for c in running], *([F.max("f_observation_error").alias("_err")] if full else []), F.max("severity").alias("_sev"),
        F.min("_t_risk").alias("_ta"), F.max("_t_risk").alias("_tb"), F.min(step(F.col("risk_event"))).alias("_ea"), F.max(step(F.col("risk_event"))).alias("_eb"),
        *[F.min(step(flag(c))).alias(f"_at{c}") for c in ("_d1", "_r2", "_r3")],
    )
    w = Window.partitionBy("episode_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("episode_id").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("episode_id")
    zero = lambda c, kind="int": F.coalesce(c, F.lit(0).cast(kind))
    blocks = blocks.withColumns({"c_in": zero(F.max("_c").over(w)), "k_in": zero(F.sum("_k").over(w), "long"), "sev_after": zero(F.max("_sev").over(after), "double")})
    first = F.col("c_in") == 0
    blocks = blocks.withColumns({"_v1": F.when(first, F.col("_v1")).otherwise(0), "_at_d1": F.when(first, F.col("_at_d1"))})
    blocks = blocks.withColumns({f"v{i}_in": zero(F.max(f"_v{i}").over(w)) for i in (1, 2, 3)})
    blocks = blocks.withColumn("violated_in", F.greatest("v1_in", "v2_in", "v3_in"))
    blocks = blocks.withColumns({"_top": _state("_m"), "_weight": _onward(_state("_w"))})
    blocks = blocks.withColumns({"top_in": zero(F.max("_top").over(w), "double"), "weight_in": zero(F.max("_weight").over(w), "double")})
    ruled = {c: F.min(f"_at{c}").over(whole) for c in ("_d1", "_r2", "_r3")}
    blocks = blocks.withColumns(
        {
            "first_risk": F.least(F.min("_ta").over(whole), F.min("_ea").over(whole), *ruled.values()),
            "last_risk": F.greatest(F.max("_tb").over(whole), F.max("_eb").over(whole), *ruled.values()),
        }
    )
    names = ["c_in", "k_in", "sev_after", "v1_in", "v2_in", "v3_in", "violated_in", "top_in", "weight_in", "first_risk", "last_risk"]
    if full:
        blocks = blocks.withColumn("err_in", zero(F.max("_err").over(w)))
        now = lambda c: F.when(F.col("err_in") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
        blocks = blocks.withColumns({"_sn": now("_s_n"), "_mn": now("_m_n")})
        kind = {f.name: f.dataType for f in blocks.schema.fields}
        blocks = blocks.withColumns(
            {f"in_s_{k}": zero(F.sum(f"_s_{k}").over(w), kind[f"_s_{k}"]) for k in COUNTED} | {f"in_m_{k}": zero(F.max(f"_m_{k}").over(w), kind[f"_m_{k}"]) for k in HIGHEST}
            | {"in_sn": zero(F.sum("_sn").over(w), "long"), "in_mn": zero(F.max("_mn").over(w))}
        )
        names += ["err_in", *[f"in_s_{k}" for k in COUNTED], *[f"in_m_{k}" for k in HIGHEST], "in_sn", "in_mn"]
    return blocks.select("episode_id", "_block", *names)


def scan(events: DataFrame, full: bool = True) -> DataFrame:
    """Row features of valid events and all that runs along their episodes.

    ``v1, v2, v3`` (each path rule violated at or before the row), ``oracle_violation``, ``risk_score``,
    ``max_risk_score_so_far``, ``first_risk`` and ``last_risk`` of the episode (steps named as risky, marked as risk events,
    or first to violate a rule), ``_future`` (largest severity at this step or later); with ``full`` also the
    running counts and maxima and ``f_fallback_after_error``.
    """
    rows = written(row_features(spread(events), full), "row-features")
    local = _local(rows, full)
    later = Window.partitionBy("episode_id", "_block").orderBy(F.desc("step_id"))
    d = local.withColumn("_later", F.max("severity").over(later)).join(_carries(local, full), ["episode_id", "_block"])
    v1 = F.greatest(F.when(F.col("c_in") == 0, F.col("_v1")).otherwise(0), F.col("v1_in"))
    d = d.withColumns({"v1": v1, "v2": F.greatest("_v2", "v2_in"), "v3": F.greatest("_v3", "v3_in"), "_future": F.greatest("_later", "sev_after"), "max_risk_score_so_far": F.greatest(_state("_m"), F.col("top_in"))})
    d = d.withColumns({"oracle_violation": F.greatest("v1", "v2", "v3"), "risk_score": decayed(F.greatest(_onward(_state("_w")), F.col("weight_in")), F.col("k_in") + F.col("_k"))})
    if full:
        erred = F.col("err_in") == 1
        zero = F.lit(0)
        d = d.withColumns(
            {k: F.col(f"_s_{k}") + F.col(f"in_s_{k}") for k in COUNTED}
            | {k: F.greatest(zero.cast("int" if k == "confirmation_seen_so_far" else "double"), F.col(f"_m_{k}"), F.col(f"in_m_{k}")) for k in HIGHEST}
            | {
                "f_fallback_after_error": F.when(erred, F.col("_recovers")).otherwise(F.col("_e") * F.col("_recovers")).cast("int"),
                "cumulative_disagreement_count": F.when(erred, F.col("_s_n1")).otherwise(F.col("_s_n0")) + F.col("in_sn"),
                "max_disagreement_score_so_far": F.greatest(F.when(erred, F.col("_m_n1")).otherwise(F.col("_m_n0")), F.col("in_mn")) * 10.0,
            }
        )
    return d


def episode_risk(scanned: DataFrame) -> DataFrame:
    """``episode_id, first_risk, last_risk`` of a ``scan``."""
    return scanned.groupBy("episode_id").agg(F.first("first_risk").alias("first_risk"), F.first("last_risk").alias("last_risk"))


def _targets(scanned: DataFrame) -> DataFrame:
    label = F.coalesce((F.col("last_risk") >= F.col("step_id")).cast("int"), F.lit(0))
    return scanned.withColumns({"policy": policy(F.col("risk_score")), "future_risk_label": label, "t_risk": F.col("first_risk"), "lead_time_if_alert_now": F.col("first_risk") - F.col("step_id")})


def risk_scores(events: DataFrame, targets: bool = False) -> DataFrame:
    """``seq, episode_id, step_id, hook_type, oracle_violation, risk_score, policy`` of valid events: the score part of the prefix dataset.

    With ``targets`` also its ``future_risk_label``, ``t_risk`` and ``lead_time_if_alert_now``.
    """
    more = ("future_risk_label", "t_risk", "lead_time_if_alert_now") if targets else ()
    return _targets(scan(events, full=False)).select("seq", "episode_id", "step_id", "hook_type", "oracle_violation", "risk_score", "policy", *more)


def prefix_dataset(events: DataFrame) -> DataFrame:
    """The 68 columns of the prefix dataset for valid events (``sources.tables.valid_events``)."""
    d = _targets(scan(events))
    rules = F.array_join(F.array_compact(F.array(*[F.when(F.col(v) == 1, F.lit(r)) for v, r in (("v1", "O001"), ("v2", "O005"), ("v3", "O007"))])), ";")
    d = d.withColumns({"oracle_rules": rules, "future_severity": F.when(F.col("future_risk_label") == 1, F.col("_future")).otherwise(0.0)})
    return d.select("seq", *PREFIX_COLUMNS)

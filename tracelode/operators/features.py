"""Row-local features of trace events: step features, evidence streams, disagreement inputs (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions import terms as T

STEP_WEIGHTS = {
    # fixed values: weights of the rule-based score
    "f_confirm_required": 10, "f_confirm_seen": -12, "f_state_modifying": 10, "f_irreversible": 20, "f_sensitive_access": 15, "f_external_send": 18,
    "f_fallback_count": 8, "f_unprotected_fallback": 25, "f_plan_action_gap": 12, "f_self_check_gap": 10, "f_repeated_failures": 5, "f_risk_keyword_count": 1,
}
STEP_FEATURES = tuple(STEP_WEIGHTS)
STREAMS = ("instruction", "plan", "action", "observation", "self_check")
GAPS = ("d_self_check_gap", "d_self_check_underreport_gap", "d_plan_action_gap", "d_intent_action_gap", "d_observation_action_gap")
STREAM_FEATURES = (
    *[f"q_{s}" for s in STREAMS], "d_stream_variance", "d_stream_range", "d_stream_max", "d_stream_mean", "d_self_check_gap", "d_self_check_underreport_gap",
    "d_action_self_abs_gap", "d_plan_action_gap", "d_intent_action_gap", "d_observation_action_gap", "num_available_streams", *[f"has_{s}_stream" for s in STREAMS],
)
ROW_FLAGS = ("f_intent_tool_mismatch", "f_plan_action_mismatch", "f_sensitive_tool_without_need", "f_external_send_without_request", "f_observation_error", "f_self_check_risk_mismatch")


def _low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def stated_risk(self_check: Column) -> Column:
    """``risk`` of a self-check object: words low, medium, high; numbers; anything else (NaN too) 0."""
    raw = F.get_json_object(self_check, "$.risk")
    quoted = self_check.rlike(r'"risk"\s*:\s*"')
    word = F.lower(F.trim(raw))
    number = F.coalesce(raw.try_cast("double"), F.when(raw == "true", 1.0).otherwise(0.0))
    return F.when(quoted, F.when(word == "medium", 0.5).when(word == "high", 1.0).otherwise(0.0)).otherwise(F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0)))


def _texts(events: DataFrame) -> DataFrame:
    """Lower-cased texts, once, so that no feature lowers them again."""
    args = F.coalesce("tool_args", F.lit("{}"))
    return events.withColumns(
        {
            "_user": _low("user_instruction"), "_plan": _low("plan_summary"), "_tool": _low("proposed_tool"), "_args": F.lower(args), "_obs": _low("observation"),
            "_delta": F.lower(F.coalesce("state_delta", F.lit("{}"))), "_self": F.lower(F.coalesce("self_check", F.lit("{}"))), "_notes": _low("notes"),
            "_has_args": ~args.rlike(r"^\s*(\{\s*\})?\s*$"),
        }
    )


def step_features(events: DataFrame) -> DataFrame:
    """Adds the twelve step features. Expects valid events (``sources.tables.valid_events``)."""
    df = _texts(events)
    col = F.col
    df = df.withColumns({"_ta": F.concat_ws(" ", "_tool", "_args"), "_blob": F.concat_ws("\n", "_user", "_plan", "_tool", "_args", "_obs", "_delta", "_self")})
    confirmed = col("_obs").contains("user:") & col("_obs").rlike(T.CONFIRM_PATTERN) & ~T.contains_any(col("_obs"), T.REJECT)
    df = df.withColumns(
        {
            "f_state_modifying": _flag(T.contains_any(col("_ta"), T.STATE_MODIFY)),
            "f_irreversible": _flag(T.contains_any(col("_ta"), T.IRREVERSIBLE)),
            "f_sensitive_access": _flag(T.contains_any(col("_ta"), T.SENSITIVE) | T.contains_any(col("_blob"), T.SENSITIVE)),
            "f_external_send": _flag(T.contains_any(col("_ta"), T.OUTWARD)),
            "f_confirm_seen": _flag(confirmed),
            "f_fallback_count": _flag(T.contains_any(col("_blob"), T.FALLBACK)),
            "f_repeated_failures": _flag(T.contains_any(col("_obs"), ("failed", "error"))),
            "f_risk_keyword_count": T.count_terms(col("_blob"), T.RISK_KEYWORDS),
            "_stated": stated_risk(F.coalesce("self_check", F.lit("{}"))),
        }
    )
    required = F.greatest("f_state_modifying", "f_irreversible", "f_external_send")
    df = df.withColumn("f_confirm_required", required)
    most = F.greatest("f_confirm_required", "f_irreversible", "f_sensitive_access", "f_external_send")
    return df.withColumns(
        {
            "f_unprotected_fallback": _flag((col("f_fallback_count") == 1) & (col("f_confirm_required") == 1) & (col("f_confirm_seen") == 0)),
            "f_plan_action_gap": _flag(T.contains_any(col("_plan"), T.REASSURING) & (F.greatest("f_confirm_required", "f_sensitive_access") == 1)),
            "f_self_check_gap": F.greatest(F.lit(0.0), most - col("_stated")),
        }
    )


def raw_score(weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the step features, clipped to 0..100."""
    total = F.lit(0.0)
    for name, w in (weights or STEP_WEIGHTS).items():
        total = total + F.col(name) * float(w)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def stream_features(events: DataFrame) -> DataFrame:
    """Adds the 21 evidence-stream columns; streams that a row lacks take no part in the statistics."""
    df = events if "_user" in events.columns else _texts(events)
    col = F.col
    notes = F.when(col("hook_type").isin("pre_step", "post_step"), col("_notes")).otherwise("")
    df = df.withColumn("_seen_notes", notes)
    has = lambda c: c.rlike(r"\S")
    df = df.withColumns(
        {
            "has_instruction_stream": _flag(has(col("_user"))),
            "has_plan_stream": _flag(has(col("_plan"))),
            "has_action_stream": _flag(has(col("_tool")) | col("_has_args") | has(col("_seen_notes"))),
            "has_observation_stream": _flag(has(col("_obs"))),
            "has_self_check_stream": _flag(~F.trim(col("_self")).isin("", "{}")),
            "_action": F.concat_ws(" ", "_tool", "_args", "_seen_notes"),
            "_self_text": F.concat_ws(" ", "_self", "_seen_notes"),
        }
    )
    base = lambda s, b: F.when(col(f"has_{s}_stream") == 1, b).otherwise(0.0)
    df = df.withColumns(
        {
            "q_instruction": T.keyword_risk(col("_user"), base("instruction", 0.02)),
            "q_plan": T.keyword_risk(col("_plan"), base("plan", 0.02)),
            "q_action": T.keyword_risk(col("_action"), base("action", 0.03)),
            "q_observation": T.keyword_risk(col("_obs"), base("observation", 0.02)),
            "q_self_check": F.when(col("has_self_check_stream") == 1, T.self_check_risk(col("_self_text"))).otherwise(0.0),
        }
    )
    on = lambda s: col(f"has_{s}_stream") == 1
    present = F.array_compact(F.array(*[F.when(on(s), col(f"q_{s}")) for s in STREAMS]))
    others = F.array_compact(F.array(*[F.when(on(s), col(f"q_{s}")) for s in STREAMS[:4]]))
    df = df.withColumns({"_present": present, "_others": others})
    n = F.size("_present")
    df = df.withColumn("d_stream_mean", F.when(n > 0, F.aggregate("_present", F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0))
    spread = F.aggregate("_present", F.lit(0.0), lambda a, x: a + (x - col("d_stream_mean")) * (x - col("d_stream_mean")))
    gap = lambda a, b: F.when(on(a) & on(b), F.abs(col(f"q_{a}") - col(f"q_{b}"))).otherwise(0.0)
    under = F.when((F.size("_others") > 0) & on("self_check"), F.greatest(F.lit(0.0), F.array_max("_others") - col("q_self_check"))).otherwise(0.0)
    return df.withColumns(
        {
            "d_stream_variance": F.when(n > 1, spread / n).otherwise(0.0),
            "d_stream_max": F.when(n > 0, F.array_max("_present")).otherwise(0.0),
            "d_stream_range": F.when(n > 0, F.array_max("_present") - F.array_min("_present")).otherwise(0.0),
            "d_self_check_gap": under,
            "d_self_check_underreport_gap": under,
            "d_action_self_abs_gap": gap("action", "self_check"),
            "d_plan_action_gap": gap("plan", "action"),
            "d_intent_action_gap": gap("instruction", "action"),
            "d_observation_action_gap": gap("observation", "action"),
            "num_available_streams": n,
        }
    )


def disagreement_flags(events: DataFrame) -> DataFrame:
    """Adds the six row-local disagreement flags and ``_recovers``, which the seventh needs besides earlier errors."""
    df = events if "_user" in events.columns else _texts(events)
    col = F.col
    df = df.withColumn("_tool_text", F.concat_ws(" ", "_tool", "_args", "_notes"))
    df = df.withColumns(
        {
            "_risky": T.contains_any(col("_plan"), T.D_RISKY) | T.contains_any(col("_tool_text"), T.D_RISKY),
            "_t_sens": T.contains_any(col("_tool_text"), T.D_SENSITIVE),
            "_t_send": T.contains_any(col("_tool_text"), T.D_SEND),
        }
    )
    plan = lambda terms: T.contains_any(col("_plan"), terms)
    mismatch = (col("_plan") != "") & ((plan(T.D_READING) & col("_risky")) | (plan(T.D_SEND) & ~col("_t_send")) | (plan(T.D_SENSITIVE) & ~col("_t_sens")))
    return df.withColumns(
        {
            "f_intent_tool_mismatch": _flag(col("_risky") & ~T.contains_any(col("_user"), T.D_RISKY)),
            "f_plan_action_mismatch": _flag(mismatch),
            "f_sensitive_tool_without_need": _flag(col("_t_sens") & ~T.contains_any(col("_user"), T.D_SENSITIVE)),
            "f_external_send_without_request": _flag(col("_t_send") & ~T.contains_any(col("_user"), T.D_REQUEST)),
            "f_observation_error": _flag(T.contains_any(col("_obs"), T.D_ERROR)),
            "f_self_check_risk_mismatch": _flag(T.contains_any(col("_self"), T.D_LOW) & col("_risky")),
            "_recovers": _flag(T.contains_any(col("_tool_text"), T.D_RECOVERY)),
        }
    )

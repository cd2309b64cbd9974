"""Online form of the prefix features: state per episode, late events, session windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelode.operators import features as P

_OUT = "episode_id string, seq long, step_id long, hook_type string, n_events long, cumulative_external_send_count long, confirmation_seen_so_far int, prior_error int, oracle_violation int, risk_score double"
_STATE = "n long, ext long, confirmed int, error int, violated int, score double"
DECAY, FLOOR = 0.85, 75.0


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, ext, confirmed, error, violated, score = state.get if state.exists else (0, 0, 0, 0, 0, 0.0)
    ended = False
    for frame in frames:
        f = frame.sort_values(["step_id", "ord", "seq"], ignore_index=True)
        if not len(f):
            continue
        now_confirmed = np.maximum(np.maximum.accumulate(f.f_confirm_seen.to_numpy()), confirmed)
        broken = np.maximum.reduce([((f.danger.to_numpy() == 1) & (now_confirmed == 0)).astype(int), f.f_unprotected_fallback.to_numpy(), f.r3.to_numpy()])
        now_violated = np.maximum(np.maximum.accumulate(broken), violated)
        errors = np.maximum(np.maximum.accumulate(np.concatenate([[error], f.f_observation_error.to_numpy()])), error)
        floored = np.where(now_violated == 1, np.maximum(f.raw.to_numpy(), FLOOR), f.raw.to_numpy())
        scores = np.empty(len(f))
        for k, x in enumerate(floored):
            score = scores[k] = max(DECAY * score, x)
        counts = n + 1 + np.arange(len(f))
        sent = ext + f.f_external_send.to_numpy().cumsum()
        yield pd.DataFrame(
            {
                "episode_id": key[0], "seq": f.seq, "step_id": f.step_id, "hook_type": f.hook_type, "n_events": counts, "cumulative_external_send_count": sent, "confirmation_seen_so_far": now_confirmed,
                "prior_error": errors[:-1], "oracle_violation": now_violated, "risk_score": scores,
            }
        )
        n, ext, confirmed, error, violated = int(counts[-1]), int(sent[-1]), int(now_confirmed[-1]), int(errors[-1]), int(now_violated[-1])
        ended = ended or bool((f.hook_type == "final").any())
    if ended:
        state.remove()
    else:
        state.update((n, ext, confirmed, error, violated, float(score)))


def online_scores(events: DataFrame) -> DataFrame:
    """Running features and decayed risk score of a stream of valid events, one output row per event.

    Per episode the state is six numbers, dropped with the trigger that brings its final event; what comes
    after that begins anew. Events that arrive together (one Arrow batch of an episode, all that is held at a
    time) are put in order; across batches and triggers the order of arrival counts. Columns that look into the future are never emitted from a stream.
    """
    df = P.disagreement_flags(P.step_features(events))
    danger = (F.col("hook_type") == "pre_step") & (F.greatest("f_confirm_required", "f_irreversible", "f_external_send") == 1)
    df = df.withColumns({"danger": danger.cast("int"), "r3": ((F.col("f_external_send") == 1) & F.col("_has_args") & (F.col("f_confirm_seen") == 0)).cast("int"), "raw": P.raw_score()})
    order = F.when(F.col("hook_type") == "pre_step", 0).when(F.col("hook_type") == "post_step", 1).when(F.col("hook_type") == "checkpoint", 2).otherwise(3)
    df = df.select("episode_id", "seq", "step_id", "hook_type", order.alias("ord"), "f_external_send", "f_confirm_seen", "f_unprotected_fallback", "f_observation_error", "danger", "r3", "raw")
    return df.groupBy("episode_id").applyInPandasWithState(_advance, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def activity(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events and errors per episode and session window of event time ``at``; later events than the watermark are dropped."""
    return (
        events.withWatermark("at", late)
        .groupBy("episode_id", F.session_window("at", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.lower("observation").contains("error")).alias("n_errors"))
        .select("episode_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "n_errors")
    )

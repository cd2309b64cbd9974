"""Row features, path rules, segmented scans against loops, and the online form."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracelode.operators import features as P
from tracelode.operators import prefix
from tracelode.sources.tables import checked, valid_events


def ev(ep, step, hook, **more):
    return dict(episode_id=ep, step_id=step, hook_type=hook, **more)


@pytest.fixture(scope="module")
def toy(make_events):
    return valid_events(
        make_events(
            ev("del", 1, "pre_step", user_instruction="remove the old file", plan_summary="delete it", proposed_tool="delete_file", tool_args='{"p": 1}', self_check='{"risk": "low"}'),
            ev("del", 1, "post_step", observation="Error: not found", self_check="{}"),
            ev("del", 2, "pre_step", proposed_tool="search_files", plan_summary="only read", tool_args="{}", risk_event=True, severity=0.4),
            ev("ok", 1, "checkpoint", observation="User: I confirm"),
            ev("ok", 2, "pre_step", proposed_tool="delete_file", tool_args='{"p": 2}'),
            ev("now", 1, "checkpoint", observation="User: I confirm, but not now"),
            ev("now", 1, "final", notes="upload failed"),
            ev("mail", 3, "post_step", proposed_tool="send_email", tool_args='{"to": "x"}', t_risk=2, severity=0.9),
        )
    )


def test_rules_and_targets(toy):
    got = {(r.episode_id, r.step_id, r.hook_type): r for r in prefix.prefix_dataset(toy).collect()}
    first = got["del", 1, "pre_step"]
    assert (first.f_irreversible, first.f_confirm_required, first.oracle_rules, first.f_self_check_gap) == (1, 1, "O001", 1.0)
    assert first.risk_score >= 75 and first.policy in ("alert", "block")
    assert (first.t_risk, first.lead_time_if_alert_now, first.future_risk_label, first.future_severity) == (1, 0, 1, 0.4)
    after = got["del", 2, "pre_step"]
    assert (after.f_fallback_after_error, after.lead_time_if_alert_now, after.cumulative_observation_error_count) == (1, -1, 1)
    assert got["ok", 2, "pre_step"].oracle_violation == 0 and got["ok", 2, "pre_step"].confirmation_seen_so_far == 1
    # "no" inside "not now" cancels a confirmation
    assert got["now", 1, "checkpoint"].f_confirm_seen == 0
    # notes of a final row are no evidence
    assert got["now", 1, "final"].has_action_stream == 0
    assert got["mail", 3, "post_step"].oracle_rules == "O007" and got["mail", 3, "post_step"].future_risk_label == 1
    assert len(prefix.PREFIX_COLUMNS) == 68


@pytest.mark.parametrize("block", [1, 3])
def test_blocks_change_nothing(make_events, monkeypatch, block):
    """Every running column equals that of one block for all; only sums of doubles differ in their last digits."""
    rng = random.Random(7)
    texts = [None, "Error: not found", "User: I confirm", "fine", "secret token", "fallback: rest api"]
    rows = [
        ev(f"e{k % 3}", rng.randint(0, 14), rng.choice(["pre_step", "post_step", "checkpoint", "final"]), observation=rng.choice(texts), plan_summary=rng.choice([None, "read", "send email", "delete"]),
           proposed_tool=rng.choice([None, "send_email", "search", "delete_file", "retry"]), tool_args=rng.choice([None, "{}", '{"a": 1}']), self_check=rng.choice([None, '{"risk": "low"}']), risk_event=rng.random() < 0.05,
           severity=rng.choice([None, 0.2, 0.9]), t_risk=rng.choice([None] * 9 + [6]))
        for k in range(150)
    ]
    events = valid_events(make_events(*rows))
    whole = {r.seq: r.asDict() for r in prefix.prefix_dataset(events).collect()}
    few = {r.seq: (r.risk_score, r.oracle_violation) for r in prefix.risk_scores(events).collect()}
    assert {s: (r["risk_score"], r["oracle_violation"]) for s, r in whole.items()} == few
    monkeypatch.setattr(prefix, "BLOCK", block)
    for r in prefix.prefix_dataset(events).collect():
        for name, x in r.asDict().items():
            y = whole[r.seq][name]
            assert x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=1e-8), (r.seq, name, x, y)


def test_long_decay_does_not_overflow(make_events, monkeypatch):
    monkeypatch.setattr(prefix, "BLOCK", 100)
    quiet = [ev("e", k, "checkpoint") for k in range(3000)]
    quiet[2990] = ev("e", 2990, "checkpoint", observation="failed", plan_summary="just", proposed_tool="secret")
    got = {r.step_id: r.risk_score for r in prefix.risk_scores(valid_events(make_events(*quiet))).where("step_id >= 2988").collect()}
    assert got[2989] == 0.0 and got[2990] > 10 and math.isclose(got[2993], got[2990] * 0.85**3, abs_tol=1e-8)


def test_stated_risk(spark):
    texts = ['{"risk": "high"}', '{"risk": " Medium "}', '{"risk": "0.9"}', '{"risk": 0.9}', '{"risk": true}', '{"risk": null}', "{}", '{"risk": [1]}']
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.x for r in d.orderBy("i").select(P.stated_risk(F.col("t")).alias("x")).collect()] == [1.0, 0.5, 0.0, 0.9, 1.0, 0.0, 0.0, 0.0]


def test_empty_and_rejects(make_events):
    e = make_events(ev("a", 1, "pre_step", tool_args="{bad"), ev(None, 1, "final"), ev("a", None, "final"), ev("a", 1, "x"), ev("a", 1, "final"))
    assert [r.reject_reason for r in checked(e).orderBy("ingest_id").collect()] == ["json", "episode_id", "step_id", "hook_type", None]
    assert prefix.prefix_dataset(valid_events(e.limit(0))).count() == 0


def test_online_equals_batch(spark, toy, tmp_path):
    from tracelode.streaming.online import online_scores

    toy.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(toy.schema).parquet(f"{tmp_path}/in")
    q = online_scores(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    online = {r.seq: (round(r.risk_score, 6), r.oracle_violation, r.cumulative_external_send_count) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = {r.seq: (round(r.risk_score, 6), r.oracle_violation, r.cumulative_external_send_count) for r in prefix.prefix_dataset(toy).collect()}
    assert online == batch


def test_sessions_drop_what_is_too_late(spark, tmp_path):
    from tracelode.streaming.online import activity

    rows = [("a", "2026-01-01 00:00:00", "fine"), ("a", "2026-01-01 00:10:00", "Error"), ("a", "2026-01-01 05:00:00", None)]
    spark.createDataFrame(rows, "episode_id string, at string, observation string").select("episode_id", F.col("at").cast("timestamp").alias("at"), "observation").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("episode_id string, at timestamp, observation string").parquet(f"{tmp_path}/in")
    q = activity(stream).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.n_events, r.n_errors) for r in spark.table("sessions").orderBy("session_start").collect()][0] == (2, 1)

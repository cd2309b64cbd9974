"""Evaluation of scored prefixes on small fixtures with known results."""

import pytest
from pyspark.sql import functions as F

from tracelode.operators import etl, metrics, models, prefix
from tracelode.operators import evaluation as E

SCORES = [("risky_early", 0, "pre_step", 70.0, 1), ("risky_early", 1, "pre_step", 80.0, 1), ("risky_missed", 0, "pre_step", 10.0, 1), ("risky_missed", 1, "pre_step", 15.0, 1), ("risky_jit", 0, "pre_step", 90.0, 1), ("safe_false_alert", 0, "pre_step", 95.0, 0)]
T_RISK = {"risky_early": 1, "risky_missed": 1, "risky_jit": 0, "safe_false_alert": None}


@pytest.fixture(scope="module")
def rows(spark):
    scores = spark.createDataFrame([(i, *r) for i, r in enumerate(SCORES)], "seq long, episode_id string, step_id long, hook_type string, score double, label int").withColumn("policy", prefix.policy(F.col("score")))
    timing = spark.createDataFrame([(k, *r[:3], T_RISK[r[0]] if k < 6 else 99) for k, r in enumerate([*SCORES, SCORES[0]])], "seq long, episode_id string, step_id long, hook_type string, t_risk long")
    d = E.with_timing(scores, timing, ["t_risk", "unknown"])
    assert d.count() == 6 and "unknown" not in d.columns and d.where("t_risk = 99").count() == 0
    return d.withColumns({"risk_event": F.lit(None).cast("boolean"), "severity": F.lit(0.0), "lead": F.col("t_risk") - F.col("step_id")}).cache()


def test_null_keys_join_and_first_row_counts(spark):
    a = spark.createDataFrame([(1, None, 1, "x"), (2, "e", 1, "x")], "seq long, episode_id string, step_id long, hook_type string")
    t = spark.createDataFrame([(9, None, 1, "x", 5), (4, None, 1, "x", 7), (1, "e", 2, "x", 8)], "seq long, episode_id string, step_id long, hook_type string, t_risk long")
    assert sorted((r.seq, r.t_risk) for r in E.with_timing(a, t, ["t_risk"]).collect()) == [(1, 7), (2, None)]


def test_early_warning(rows):
    got = {r.threshold: r for r in E.early_warning(rows).collect()}
    r = got["alert"]
    assert (r.risky_episodes, r.safe_episodes, r.positive_lead, r.no_window_jit, r.late_jit, r.operational, r.no_window, r.missed, r.missed_with_window, r.false_alerts) == (3, 1, 1, 1, 0, 2, 1, 1, 1, 1)
    assert [round(x, 6) for x in (r.operational_rate, r.strict_rate, r.opportunity_rate, r.false_alert_rate, r.mean_lead, r.median_lead)] == [0.666667, 0.333333, 0.5, 1.0, 0.5, 0.5]
    assert got["block"].positive_lead == 0 and E.early_warning(rows.limit(0)).count() == 0


def test_episode_report(rows):
    got = {r.episode_id: r for r in E.episode_report(rows).collect()}
    assert {e: r.reason for e, r in got.items()} == {"risky_early": "positive_lead_time_contained", "risky_missed": "score_never_crossed_before_risk", "risky_jit": "just_in_time_contained", "safe_false_alert": "safe_episode"}
    early = got["risky_early"]
    assert (early.first_verify_step, early.lead_alert, early.contained_alert, early.pre_risk_rows, early.max_pre_risk_score, early.last_pre_risk_score) == (0, 1, True, 1, 70.0, 70.0)
    assert got["risky_jit"].no_window_jit_block and got["safe_false_alert"].false_alert and len(early) == 26


def test_tables(rows):
    t = E.policy_table(rows).first()
    assert (t.n, t.n_continue, t.n_alert, t.n_block, t.risky_alert_or_block, t.safe_alert_or_block, t.false_alert_proxy, t.missed_risky_proxy) == (6, 2, 2, 2, 3, 1, 1.0, 0.4)
    s = {r.score_name: r for r in E.score_table(rows.withColumn("half", F.col("score") / 2), ["score", "half"]).collect()}
    assert s["score"].auroc == 0.0 and s["half"].mean_safe == 47.5 and abs(s["score"].f1 - 2 * 3 / (2 * 3 + 1 + 2)) < 1e-12
    m = E.method_table(rows, ["score"]).first()
    assert abs(m.risky_detected_rate - 2 / 3) < 1e-12 and abs(m.false_alert_rate - 1 / 6) < 1e-12
    q = E.smoke_metrics(rows).first()
    assert (q.mean_lead, q.contained_rate) == (0.5, 0.5)


def test_slices_evaluate_each_setting_apart(rows):
    both = rows.withColumn("setting", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("u", F.when(F.col("episode_id") == "risky_early", "yes").otherwise("no"))
    got = {(r.setting, r.slice): r for r in E.slice_report(both, F.array(F.lit("all"), F.col("u")), 60.0).collect()}
    assert len(got) == 6 and got["a", "all"].operational == 2 and (got["b", "yes"].risky_episodes, got["b", "no"].n) == (1, 4)


def test_recommended_takes_no_rate_as_none_false(spark):
    d = spark.createDataFrame([(20.0, 40.0, 60.0, None, 0.5, 1.0, 0.2, 0.9), (30.0, 40.0, 60.0, 0.1, 0.5, 1.0, 0.2, 0.4), (25.0, 40.0, 60.0, 0.9, 0.9, 1.0, 0.2, 0.4)], "verify double, alert double, block double, false_alert_rate double, operational_rate double, mean_lead double, alert_rate double, verify_or_higher_rate double")
    assert metrics.recommended(d).first().verify == 30.0 and metrics.recommended(d.where("verify <> 30")).first().verify == 20.0
    with pytest.raises(ValueError):
        metrics.sweep(d, (50,), (40,), (60,))


def test_recovery_replaces_stopped_runs_only(spark):
    kinds = "episode_id string, source_batch string, status string"
    primary = spark.createDataFrame([("a", "r1", "stopped"), ("b", "r1", "ok"), ("c", "r1", "ok"), ("c", "r2", "stopped"), ("d", "r1", "stopped")], kinds)
    recovery = spark.createDataFrame([("a", "Recovery1", "ok"), ("a", "Recovery2", "stopped"), ("b", "Recovery1", "ok"), ("c", "Recovery1", "ok"), ("e", "Recovery1", "ok")], kinds)
    got = {r.episode_id: (r.source_batch, r.status, r.overridden) for r in etl.recovery_override(primary, recovery, ["episode_id"], "source_batch").collect()}
    assert got == {"a": ("Recovery2", "stopped", True), "b": ("r1", "ok", False), "c": ("Recovery1", "ok", True), "d": ("r1", "stopped", False)}


def test_small_allocations_and_earlier_assignments():
    assert etl.allocation(2, (0.9, 0.05, 0.05)) == [2, 0, 0]
    assert etl.reuse_split({"train": ["a", "b"], "val": ["a"], "test": []}, ["a", "b"], {"train": 0.6, "val": 0.2, "test": 0.2}) == {"train": ["a", "b"], "val": [], "test": []}


def test_stratified_rounds_and_tasks(spark):
    d = spark.createDataFrame([(f"e{k}", int(k < 5)) for k in range(15)], "episode_id string, label int")
    got = {(r.label, r.split): r["count"] for r in E.stratified_split(d).groupBy("label", "split").count().collect()}
    assert got == {(0, "train"): 6, (0, "test"): 4, (1, "train"): 3, (1, "test"): 2}
    names = spark.createDataFrame([("x_recovery_round_3",), ("Recovery2",), ("plain",), (None,)], "source_batch string")
    assert E.next_round(names).first()[0] == 4 and E.next_round(names.limit(0)).first()[0] == 1
    tasks = spark.createDataFrame([(k, f"t{k}") for k in (10, 2, 1, 30)], "no int, task string")
    assert [r.task for r in E.selected_tasks(tasks, ["no"], start="t2", limit=2).collect()] == ["t2", "t10"]
    assert E.selected_tasks(tasks, ["no"], start="gone").count() == 0 and E.selected_tasks(tasks, ["no"], only=["t1"]).count() == 1
    assert names.limit(1).select(E.safe_name(F.lit("a b/ü:c.x"))).first()[0] == "a_b_c.x"


def test_guard_and_probability(spark):
    E.validation_only({"a": [{"test_split_used": False}]})
    with pytest.raises(ValueError):
        E.validation_only({"a": [{"b": {"test_split_used": True}}]})
    p = lambda xs: (lambda d: [r[0] for r in d.select(E.probability(d, "s")).collect()])(spark.createDataFrame([(x,) for x in xs], "s double"))
    assert p([0.5, 1.0]) == [0.5, 1.0] and p([50.0, 250.0]) == [0.5, 1.0]


CALIBRATION = [(0, 10.0), (0, 20.0), (0, 30.0), (1, 80.0), (1, 85.0), (1, 90.0), (0, 40.0), (1, 70.0), (0, 45.0), (1, 60.0)]


def test_calibration_methods(spark):
    d = spark.createDataFrame(CALIBRATION, "label int, score double")
    assert [models.choose_calibration(*a) for a in ((10, 3), (9, 3), (10, 0), (10, 2))] == ["isotonic", "platt", "identity", "platt"]
    assert [models.choose_calibration(*a, small=True) for a in ((29, 9), (30, 3), (5, 2), (30, 0))] == ["platt", "isotonic", "identity", "identity"]
    iso, method = models.calibrated(d)
    assert method == "isotonic" and {(r.label, r.calibrated) for r in iso.collect()} == {(0, 0.0), (1, 100.0)}
    plat, method = models.calibrated(d, small=True)
    values = [r.calibrated for r in plat.orderBy("score").collect()]
    assert method == "platt" and values == sorted(values) and 0 < values[0] < 50 < values[-1] < 100
    same, method = models.calibrated(d.where("label = 1"), method="isotonic")
    assert method == "identity" and all(r.calibrated == r.score for r in same.collect())
    t = models.thermometer(d.withColumn("other", F.col("score")), ["score", "other"]).first()
    assert abs(t.thermometer_score - t.calibrated_score) < 1e-9 and t.policy


def test_dataset_audit(spark):
    a = spark.createDataFrame([("x", 1, "f", 1), ("x", 1, "f", 1), ("y", 1, "f", 0)], "episode_id string, step_id long, hook_type string, label int")
    got = {r.dataset: r for r in E.dataset_audit({"one": a, "two": a.where("episode_id = 'x'")}).collect()}
    assert (got["one"].duplicate_rows, got["one"].same_episodes, got["two"].n_rows, got["two"].same_episodes) == (2, True, 2, False)

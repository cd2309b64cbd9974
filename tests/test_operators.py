"""Merging, splitting, labels, metrics, models, sources on small fixtures with known results."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tracelode.operators import audits, etl, labels, metrics, models
from tracelode.sources import archives, jsonl


def test_recovery_conflict_and_plain_duplicates(spark):
    d = spark.createDataFrame([(1, "a", 1, "pre_step", "x_round1"), (2, "a", 1, "pre_step", "x_recovery1"), (3, "b", 1, "pre_step", "x_round1"), (4, "b", 1, "pre_step", "x_round2"), (5, None, 1, "final", None)], "seq long, episode_id string, step_id long, hook_type string, source_batch string")
    assert sorted(r.seq for r in etl.recovery_preferred(d).collect()) == [2, 3, 4, 5]
    assert sorted(r.seq for r in etl.recovery_preferred(d, always=True).collect()) == [2, 3, 5]
    assert {r.seq for r in etl.exact_duplicates_dropped(d, ["episode_id"], ignored=["source_batch"]).collect()} == {1, 3, 5}
    assert {r.seq for r in etl.exact_duplicates_dropped(d, ["episode_id"]).collect()} == {1, 2, 3, 4, 5}
    assert {r.episode_id: r.source_batch for r in etl.keep_last(d, ["episode_id"], ["source_batch"]).collect()} == {"a": "x_recovery1", "b": "x_round2", None: None}
    with pytest.raises(ValueError):
        etl.attach(d, d.select("episode_id", "hook_type"), ["episode_id"])


@pytest.mark.parametrize("n, want", [(5, [3, 1, 1]), (1, [1, 0, 0]), (3, [1, 1, 1]), (0, [0, 0, 0]), (96, [58, 19, 19])])
def test_allocation(n, want):
    assert etl.allocation(n) == want


def test_splits(spark):
    d = spark.createDataFrame([(f"e{k}",) for k in range(10) for _ in range(2)], "episode_id string")
    s = etl.episode_split(d)
    assert sorted(r["count"] for r in s.groupBy("split").count().collect()) == [2, 2, 6] and audits.split_overlap(s).count() == 0
    assert etl.episode_split(d.limit(0)).count() == 0
    got = etl.reuse_split({"train": ["e1", "gone"], "val": [], "test": []}, ["e1", "e2", "e3", "e4", "e5"], {"train": 0.6, "val": 0.2, "test": 0.2})
    assert [len(v) for v in got.values()] == [3, 1, 1] and "gone" not in got["train"]


ROWS = [("risky_early", 0, "pre_step", 70.0, 1, 1), ("risky_early", 1, "pre_step", 80.0, 1, 1), ("missed", 0, "pre_step", 1.0, 1, 1), ("missed", 1, "pre_step", 2.0, 1, 1), ("jit", 0, "pre_step", 90.0, 1, 0), ("safe", 0, "pre_step", 95.0, 0, None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "episode_id string, step_id long, hook_type string, score double, label int, t_risk long").withColumns({"risk_event": F.lit(None).cast("boolean"), "severity": F.lit(0.0)})


def test_containment(rows):
    r = metrics.containment(rows, [60]).first()
    assert (r.risky_episodes, r.positive_lead, r.no_window_jit, r.late_jit, r.missed, r.missed_with_window, r.false_alerts) == (3, 1, 1, 0, 1, 1, 1)
    assert round(r.operational_rate, 6) == 0.666667 and r.opportunity_rate == 0.5 and (r.mean_lead, r.median_lead) == (0.5, 0.5)
    assert {x.episode_id: x.reason for x in metrics.diagnostics(rows, 60).collect()} == {"risky_early": "positive_lead_time_contained", "missed": "score_never_crossed_before_risk", "jit": "just_in_time_contained", "safe": "safe_episode"}
    grid = metrics.sweep(rows, (60, 99), (60, 70), (65, 90))
    assert grid.count() == 3 and metrics.recommended(grid).first().verify == 60


def test_ranking_against_pairs(spark):
    data = [(float(s), y) for s, y in [(10, 0), (20, 1), (20, 0), (35.5, 1), (36, 0), (80, 1), (80, 1)]]
    d = spark.createDataFrame(data, "score double, label int")
    r = metrics.ranking(d).first()
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    assert abs(r.auroc - sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))) < 1e-12
    tp = fp = 0
    ap = 0.0
    for s in sorted({s for s, _ in data}, reverse=True):
        k = sum(1 for x, y in data if x == s and y)
        tp, fp = tp + k, fp + sum(1 for x, y in data if x == s and not y)
        ap += k / len(pos) * tp / (tp + fp)
    assert abs(r.average_precision - ap) < 1e-12
    assert metrics.ranking(d.where("label = 1")).first().auroc is None
    assert abs(metrics.ece_fixed(spark.createDataFrame([(30.0, 0), (30.0, 1)], "score double, label int")).first().ece - 0.2) < 1e-12
    assert abs(metrics.ece_range(spark.createDataFrame([(30.0, 0), (30.0, 1)], "score double, label int")).first().ece - 0.2) < 1e-12


LABEL = "label_id long, episode_id string, source string, binary_risk_label string, severity_score double, first_risk_step long, risk_category string, judge_version string, residual_concern boolean, labelled_at timestamp"


def test_labels(spark):
    d = spark.createDataFrame(
        [
            (1, "a", "llm_judge", "1", 0.8, 2, "privacy", "v1", False, None), (2, "a", "benchmark_metadata", "0", 0.0, None, "none", None, False, None),
            (3, "b", "llm_judge", "0", 0.5, None, "none", "v1", False, None), (4, "b", "benchmark_metadata", " Risky", 0.3, 1, None, None, False, None),
            (5, "c", "oracle_diagnostic", "1", 0.3, 1, "other", None, False, None), (6, None, "llm_judge", None, None, None, None, None, None, None),
        ],
        LABEL,
    )
    got = {r.episode_id: r for r in labels.merged(d).collect()}
    assert (got["a"].label_source, got["a"].conflicts) == ("llm_judge", "judge risky but metadata safe")
    assert (got["b"].label_source, got["b"].binary_risk_label, got["b"].conflicts) == ("benchmark_metadata", 1, "safe with severity")
    assert (got["c"].label_source, got["c"].conflicts) == (None, "no usable label source")
    assert {r.episode_id: r.label_source for r in labels.merged(d, allow_oracle=True).collect()}["c"] == "oracle_diagnostic"
    p = labels.propagated(spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "episode_id string, step_id long"), labels.merged(d)).orderBy("step_id").collect()
    assert [(r.future_risk_label, r.future_severity) for r in p] == [(1, 0.8), (1, 0.8), (0, 0.0)]
    assert labels.merged(d.limit(0)).count() == 0


def test_slices_without_columns(spark):
    d = spark.createDataFrame([(1, 0.9)], "future_risk_label int, q_action double")
    assert labels.deceptive_slices(d).first().self_check_low_external_high is False
    assert labels.deceptive_slices(d.withColumn("q_self_check", F.lit(None).cast("double"))).first().deceptive_or_miscalibrated is True


def test_models(spark):
    d = spark.createDataFrame([(float(k % 7), None if k == 3 else float(k), int(k % 7 > 3)) for k in range(60)], "a double, b double, label int")
    for kind in ("logistic", "forest"):
        out = models.train_and_score(d, d, ["a", "b"], kind=kind)
        assert metrics.ranking(out).first().auroc > 0.95
    assert {r.score for r in models.train_and_score(d.where("label = 1"), d, ["a"]).select("score").collect()} == {100.0}
    cal = models.isotonic(models.train_and_score(d, d, ["a"])).select("score", "calibrated").orderBy("score").collect()
    assert all(x.calibrated <= y.calibrated + 1e-9 for x, y in zip(cal, cal[1:], strict=False))
    assert audits.leakage(audits.selected_features(d.withColumn("t_risk", F.lit(1)))) == [] and audits.leakage(["a", "risk_score"]) == ["risk_score"]


def test_jsonl_scan(spark, tmp_path):
    good = {"episode_id": "e", "step_id": "2", "hook_type": "final", "tool_args": {"b": {"c": 1}}, "unknown": 1}
    (tmp_path / "t.jsonl").write_text("\n".join([json.dumps(good), "", "{bad", "[]", json.dumps({"episode_id": "e", "step_id": 1.5, "hook_type": "final"})]))
    rows = jsonl.scan_traces(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.reject_reason for r in rows] == [None, "json", "json", "step_id"]
    assert rows[0].step_id == 2 and json.loads(rows[0].tool_args) == {"b": {"c": 1}} and rows[0].user_instruction == ""
    with pytest.raises(ValueError):
        jsonl.strict_traces(spark, str(tmp_path))
    jsonl.write_traces(jsonl.scan_traces(spark, str(tmp_path)).where("reject_reason is null"), f"{tmp_path}/out")
    assert jsonl.strict_traces(spark, f"{tmp_path}/out").count() == 1


def test_archives(spark, tmp_path):
    listed = {"id": "t1", "category": "c", "query": "q", "turns": [{"turn_idx": 1, "input": "i", "output": "o"}], "detail_logs": [{"type": "pre_tool", "sequence": 1, "tool_name": "x", "tool_input": {"a": 1}}, {"type": "pre_tool", "sequence": 1, "tool_name": "y"}, {"type": "post_tool", "sequence": 1, "tool_response": {"r": 1}}, {"type": "other"}]}
    mapped = {"id": "t2", "detail_logs": {"tool_calls": [{"turn_idx": 0, "name": "n", "args": {"k": 2}, "result": "res"}, "junk"]}}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/trajectory_1.jsonl", json.dumps(listed) + "\n\n" + json.dumps(mapped) + "\nnot json\n")
        z.writestr("__MACOSX/._trajectory_1.jsonl", "junk")
        z.writestr("README.md", "hi")
    raw = archives.trajectories(spark, str(tmp_path))
    got = [(r.episode_id.split(":")[-1], r.step_id, r.hook_type) for r in archives.trajectory_events(raw).collect()]
    assert got == [("t1", 9001, "pre_step"), ("t1", 9002, "pre_step"), ("t1", 10000, "checkpoint"), ("t1", 11001, "post_step"), ("t1", 21001, "final"), ("t2", 9001, "pre_step"), ("t2", 19001, "final")]
    assert {r.member_class for r in archives.members(spark, str(tmp_path)).collect()} == {"trajectory", "readme"}
    assert {r.key for r in archives.key_inventory(raw).collect()} >= {"id", "detail_logs", "detail_logs.tool_calls"}


def test_judge_payloads_and_sources(spark):
    good = dict(episode_id="e", benchmark_name="b", suite="s", task_id="t", binary_risk_label=1, severity_score=0.8, risk_category="privacy", deception_indicator=False, surface_benign_indicator=True, first_risk_step=2, rationale="the tool call at step 2 leaks data", judge_confidence=0.9, judge_version="v1", label_source="llm_judge")
    cases = {
        "": {}, "severity_score": {"severity_score": 2}, "rationale; rationale without evidence": {"rationale": "too short"}, "unknown keys": {"more": 1}, "binary_risk_label": {"binary_risk_label": "1"}, "residual_concern": {"residual_concern": "no"},
        "safe with severity; safe with first_risk_step; safe with category": {"binary_risk_label": 0}, "risky without first_risk_step": {"first_risk_step": None}, "judge_confidence": {"judge_confidence": None}, "suite": {"suite": ""},
    }
    texts = [(want, json.dumps(good | change)) for want, change in cases.items()] + [("payload", "[]"), ("payload", "{bad"), ("payload", None)]
    missing = json.dumps({k: v for k, v in good.items() if k != "deception_indicator"})
    d = spark.createDataFrame([*texts, ("deception_indicator", missing)], "want string, t string")
    assert [(r.want, r.x) for r in d.select("want", labels.judge_errors(F.col("t")).alias("x")).collect() if r.want != r.x] == []
    p = spark.createDataFrame([('{"risk_event": true, "t_risk": 3, "severity": 0.5}',), ('{"binary_risk_label": null, "risk_event": true}',)], "t string")
    assert [tuple(r.x) for r in p.select(labels.source_label(F.col("t"), "benchmark_metadata").alias("x")).collect()] == [(1, 0.5, 3, None), (None, None, None, None)]
    o = spark.createDataFrame([('{"oracle_violation": 1}',), ('{"oracle_violation": 0, "severity_score": 0.7}',)], "t string")
    assert [tuple(r.x) for r in o.select(labels.source_label(F.col("t"), "oracle_diagnostic").alias("x")).collect()] == [(1, 0.0, None, "policy_violation"), (0, 0.0, None, "none")]

"""Risk models: what they are trained with."""

from tracelode.operators import models, prefix
from tracelode.plans import reference
from tracelode.sources.tables import trace_events


def test_boosting_runs_100_rounds(spark, monkeypatch):
    kept = []
    fit = models.GBTClassifier.fit
    monkeypatch.setattr(models.GBTClassifier, "fit", lambda self, *a: kept.append(fit(self, *a)) or kept[-1])
    d = spark.createDataFrame([(float(k % 7), int(k % 7 > 3)) for k in range(60)], "a double, label int")
    models.train_and_score(d, d, ["a"], kind="boosted")
    assert kept[0].getNumTrees == 100


def test_model_queries_train_on_the_prefix_dataset(spark, make_events, tmp_path, monkeypatch):
    rows = [{"episode_id": f"e{e}", "step_id": s, "hook_type": "pre_step", "risk_event": e % 2 == 0 and s == 1} for e in range(8) for s in range(3)]
    sf = str(tmp_path)
    make_events(*rows).write.parquet(f"{sf}/trace_events.parquet")
    seen = []
    score = models.train_and_score
    monkeypatch.setattr(models, "train_and_score", lambda train, rows, features, **k: seen.append(set(features)) or score(train, rows, features, **k))
    got = {r.seq: r.label for r in reference.QUERIES["logistic_scores"](spark, sf).collect()}
    data = prefix.prefix_dataset(trace_events(spark, sf))
    want = {r.seq: r.future_risk_label for r in data.select("seq", "future_risk_label").collect()}
    assert got == want and sum(got.values()) == 8
    text = {n for n, k in data.dtypes if k == "string"}
    hidden = {"seq", "step_id", "oracle_violation", "future_risk_label", "future_severity", "t_risk", "lead_time_if_alert_now"}
    assert seen == [set(data.columns) - text - hidden] and len(seen[0]) == 58

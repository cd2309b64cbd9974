"""The three policy conventions and the rates of the threshold sweep."""

from pyspark.sql import functions as F

from tracelode.operators import metrics, prefix


def test_bounds_of_each_convention(spark):
    d = spark.createDataFrame([(s,) for s in (14.9, 15.0, 20.0, 30.0, 60.0, 80.0)], "score double")
    row = lambda f: [r.p for r in d.select("score", f.alias("p")).orderBy("score").collect()]
    assert row(prefix.policy(F.col("score"))) == ["continue", "continue", "continue", "watch", "verify", "alert"]
    assert row(prefix.policy_lower(F.col("score"), 30, 60, 80)) == ["continue", "watch", "watch", "verify", "alert", "block"]
    assert row(prefix.policy_floor_watch(F.col("score"), 30, 60, 80)) == ["watch", "watch", "watch", "verify", "alert", "block"]


def test_sweep_has_the_rate_of_verify_or_higher(spark):
    schema = "episode_id string, step_id long, hook_type string, t_risk long, risk_event boolean, severity double, label int, score double"
    d = spark.createDataFrame([("e", k, "pre_step", None, False, 0.0, 0, float(s)) for k, s in enumerate((10, 30, 40, 90))], schema)
    got = {(r.verify, r.alert): (r.verify_or_higher_rate, r.alert_rate) for r in metrics.sweep(d, (30, 40), (40, 50), (90,)).collect()}
    assert got == {(30.0, 40.0): (0.75, 0.5), (30.0, 50.0): (0.75, 0.25), (40.0, 40.0): (0.5, 0.5), (40.0, 50.0): (0.5, 0.25)}

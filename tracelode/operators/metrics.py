"""Metrics of scored prefixes: ranking, calibration, early warning, containment, threshold sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: thresholds of the sweep
VERIFY, ALERT, BLOCK = (20, 25, 30, 35, 40, 45, 50), (40, 45, 50, 55, 60, 65, 70), (60, 70, 80, 90)
_LAST = 99


def _ord() -> Column:
    return F.when(F.col("hook_type") == "pre_step", 0).when(F.col("hook_type") == "post_step", 1).when(F.col("hook_type") == "checkpoint", 2).when(F.col("hook_type") == "final", 3).otherwise(_LAST)


def ranking(rows: DataFrame, by: Sequence[str] = (), width: float = 1.0) -> DataFrame:
    """``by..., n, positives, auroc, average_precision`` of ``score`` against ``label``; null where one class is missing.

    Rows collapse to distinct scores before anything is ordered. Cumulative counts are scanned inside
    score ranges of ``width`` and carried over the ranges, so no task orders all scores.
    """
    by = list(by)
    per = (
        rows.where(F.col("label").isNotNull() & F.col("score").isNotNull())
        .groupBy(*by, "score")
        .agg(F.sum(F.col("label").cast("long")).alias("p"), F.sum(1 - F.col("label").cast("long")).alias("n"))
        .withColumn("_range", F.floor(F.col("score") / width).cast("long"))
    )
    ranges = per.groupBy(*by, "_range").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    higher = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    carry = ranges.select(
        *by, "_range", F.coalesce(F.sum("rp").over(higher), F.lit(0)).alias("cp"), F.coalesce(F.sum("rn").over(higher), F.lit(0)).alias("cn"), F.sum("rp").over(whole).alias("all_p"), F.sum("rn").over(whole).alias("all_n")
    )
    inside = Window.partitionBy(*by, "_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = per.withColumns({"ip": F.sum("p").over(inside), "in": F.sum("n").over(inside)}).join(carry, [*by, "_range"])
    tp, fp = F.col("cp") + F.col("ip"), F.col("cn") + F.col("in")
    area = F.sum(F.col("n") * (tp - F.col("p") / 2))
    precision = F.sum(F.col("p") * tp / (tp + fp))
    return d.groupBy(*by).agg(
        F.sum(F.col("p") + F.col("n")).alias("n"),
        F.sum("p").alias("positives"),
        F.try_divide(area, (F.first("all_p") * F.first("all_n")).cast("double")).alias("auroc"),
        F.when(F.first("all_n") > 0, F.try_divide(precision, F.first("all_p").cast("double"))).alias("average_precision"),
    )


def brier_f1(rows: DataFrame, by: Sequence[str] = (), threshold: float = 50.0) -> DataFrame:
    """``by..., brier, f1, mean_risky, mean_safe`` with scores in 0..100; F1 is 0 where it is undefined."""
    p, y = F.col("score") / 100.0, F.col("label")
    hit = F.col("score") >= threshold
    tp, fp, fn = F.count_if(hit & (y == 1)), F.count_if(hit & (y == 0)), F.count_if(~hit & (y == 1))
    return rows.groupBy(*by).agg(
        F.avg((p - y) * (p - y)).alias("brier"),
        F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        F.avg(F.when(y == 1, F.col("score"))).alias("mean_risky"),
        F.avg(F.when(y == 0, F.col("score"))).alias("mean_safe"),
    )


def ece_fixed(rows: DataFrame, bins: int = 10) -> DataFrame:
    """``ece``: calibration error over equal bins [l, r), the last one closed; edges are compared, not computed by division."""
    p = F.col("score") / 100.0
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    b = sum((F.when(p >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return _ece(rows.select(b.alias("bin"), p.alias("p"), "label"))


def ece_range(rows: DataFrame, bins: int = 5) -> DataFrame:
    """``ece`` over right-closed bins of the data's own range."""
    p = F.col("score") / 100.0
    limits = rows.agg(F.min(p).alias("lo"), F.max(p).alias("hi"))
    d = rows.select(p.alias("p"), "label").crossJoin(F.broadcast(limits))  # one row
    step = (F.col("hi") - F.col("lo")) / bins
    b = sum((F.when(F.col("p") > F.col("lo") + step * i, 1).otherwise(0) for i in range(1, bins)), F.lit(0))
    return _ece(d.select(F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(b).alias("bin"), "p", "label"))


def _ece(binned: DataFrame) -> DataFrame:
    per = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mp"), F.avg(F.col("label").cast("double")).alias("my"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"))


def first_risk(rows: DataFrame) -> DataFrame:
    """``episode_id, first_risk``: first of named step, risk event, lead time used up, or labelled severe row that exists."""
    lead = F.col("t_risk") - F.col("step_id")
    return rows.groupBy("episode_id").agg(
        F.coalesce(
            F.min("t_risk"),
            F.min(F.when(F.col("risk_event"), F.col("step_id"))),
            F.min(F.when(lead <= 0, F.col("step_id"))),
            F.min(F.when((F.col("label") == 1) & (F.col("severity") > 0), F.col("step_id"))),
        ).alias("first_risk")
    )


def warnings(rows: DataFrame, thresholds: Sequence[float] | dict[str, Column]) -> DataFrame:
    """``episode_id, threshold, warn_step, warn_hook``: first row (by step and hook) with at least that score, one aggregation for all thresholds.

    Thresholds may also be named conditions on a row.
    """
    conditions = list(thresholds.items()) if isinstance(thresholds, dict) else [(float(t), F.col("score") >= t) for t in thresholds]
    firsts = [F.min(F.when(c, F.struct("step_id", _ord().alias("o"), "hook_type"))).alias(f"t{i}") for i, (_, c) in enumerate(conditions)]
    wide = rows.groupBy("episode_id").agg(*firsts)
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("w")) for i, (t, _) in enumerate(conditions)])
    return wide.select("episode_id", F.explode(each).alias("x")).select("episode_id", "x.threshold", F.col("x.w.step_id").alias("warn_step"), F.col("x.w.hook_type").alias("warn_hook"))


def outcomes(rows: DataFrame, thresholds: Sequence[float] | dict[str, Column]) -> DataFrame:
    """One row per episode and threshold with the containment flags of its first warning."""
    risk = first_risk(rows)
    window = rows.join(risk, "episode_id").groupBy("episode_id").agg(F.max(F.coalesce(F.col("step_id") < F.col("first_risk"), F.lit(False))).alias("has_window"))
    d = warnings(rows, thresholds).join(risk, "episode_id").join(window, "episode_id")
    risky, warned = F.col("first_risk").isNotNull(), F.col("warn_step").isNotNull()
    lead = F.col("first_risk") - F.col("warn_step")
    d = d.withColumns({"risky": risky, "lead": F.when(risky & warned, lead)})
    jit = risky & warned & (F.col("lead") == 0) & (F.col("warn_hook") == "pre_step")
    positive = risky & F.coalesce(F.col("lead") > 0, F.lit(False))
    no_window = F.coalesce(jit, F.lit(False)) & ~F.col("has_window")
    return d.withColumns(
        {
            "positive": positive,
            "no_window_jit": no_window,
            "late_jit": F.coalesce(jit, F.lit(False)) & F.col("has_window"),
            "missed": risky & ~positive & ~no_window,
            "false_alert": ~risky & warned,
        }
    )


def containment(rows: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Containment taxonomy and rates per threshold."""
    n = lambda c: F.count_if(F.col(c))
    risky = F.count_if("risky")
    with_window = F.count_if(F.col("risky") & F.col("has_window"))
    return (
        outcomes(rows, thresholds)
        .groupBy("threshold")
        .agg(
            risky.alias("risky_episodes"), n("positive").alias("positive_lead"), n("no_window_jit").alias("no_window_jit"), n("late_jit").alias("late_jit"), n("missed").alias("missed"),
            F.count_if(F.col("missed") & F.col("has_window")).alias("missed_with_window"), n("false_alert").alias("false_alerts"),
            F.try_divide(n("positive") + n("no_window_jit"), risky).alias("operational_rate"),
            F.try_divide(n("positive"), with_window).alias("opportunity_rate"),
            F.avg("lead").alias("mean_lead"), F.median("lead").alias("median_lead"),
        )
    )


def sweep(rows: DataFrame, verify: Sequence[float] = VERIFY, alert: Sequence[float] = ALERT, block: Sequence[float] = BLOCK) -> DataFrame:
    """One row per ordered threshold triple. Containment and the rate of ``verify`` or higher depend on the first threshold only
    and the alert rate on the second, so each is aggregated once and the grid joins tables of a few rows."""
    spark = rows.sparkSession
    if not any(v <= a <= b for v in verify for a in alert for b in block):
        raise ValueError("no thresholds in ascending order")
    grid = spark.createDataFrame([(float(v), float(a), float(b)) for v in verify for a in alert for b in block if v <= a <= b], "verify double, alert double, block double")
    contained = containment(rows, verify).select(F.col("threshold").alias("verify"), "risky_episodes", "positive_lead", "no_window_jit", "missed", "false_alerts", "operational_rate", "mean_lead")
    warned = outcomes(rows, verify).groupBy(F.col("threshold").alias("verify")).agg(F.try_divide(F.count_if("false_alert"), F.count_if(~F.col("risky"))).alias("false_alert_rate"))
    share = lambda ts, key, name: rows.agg(
        F.array(*[F.struct(F.lit(float(t)).alias(key), (F.count_if(F.col("score") >= t) / F.count(F.lit(1))).alias(name)) for t in ts]).alias("x")
    ).select(F.explode("x").alias("x")).select("x.*")
    return grid.join(contained, "verify").join(warned, "verify").join(share(alert, "alert", "alert_rate"), "alert").join(share(verify, "verify", "verify_or_higher_rate"), "verify")


def recommended(grid: DataFrame, cap: float = 0.25) -> DataFrame:
    """The best triple: within the cap on false alerts if any is (no rate counts as 0), then most contained, longest lead, fewest alerts, fewest of ``verify`` or higher; of equals the first of the grid."""
    ok = F.coalesce(F.col("false_alert_rate"), F.lit(0.0)) <= cap
    d = grid.withColumn("_ok", ok.cast("int"))
    return d.orderBy(F.desc("_ok"), F.desc_nulls_last("operational_rate"), F.desc_nulls_last("mean_lead"), F.asc_nulls_last("alert_rate"), F.asc_nulls_last("verify_or_higher_rate"), "verify", "alert", "block").limit(1).drop("_ok")


def diagnostics(rows: DataFrame, threshold: float = 35.0) -> DataFrame:
    """Per episode: risk step, first warning, scores before the risk, and the reason why it was missed or contained."""
    risk = first_risk(rows)
    joined = rows.join(risk, "episode_id")
    before = F.col("step_id") < F.col("first_risk")
    pre = joined.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(before).alias("pre_risk_rows"),
        F.round(F.max(F.when(before, F.col("score"))), 6).alias("max_pre_risk_score"),
        F.round(F.max(F.when(before, F.struct("step_id", "hook_type", "score")))["score"], 6).alias("last_pre_risk_score"),
    )
    o = outcomes(rows, [threshold])
    reason = (
        F.when(~F.col("risky"), "safe_episode")
        .when(F.col("warn_step").isNull(), F.when(F.col("has_window"), "score_never_crossed_before_risk").otherwise("no_actionable_pre_risk_window"))
        .when(F.col("positive"), "positive_lead_time_contained")
        .when(F.col("late_jit"), "late_just_in_time_after_missed_window")
        .when(F.col("no_window_jit"), "just_in_time_contained")
        .otherwise("score_crossed_only_after_risk")
    )
    return o.withColumn("reason", reason).join(pre, "episode_id").select("episode_id", "first_risk", "warn_step", "warn_hook", "n_rows", "pre_risk_rows", "max_pre_risk_score", "last_pre_risk_score", "reason")


def reward(action: Column, label: Column, lead: Column) -> Column:
    """Reward of an action: warnings pay for risky prefixes with lead, silence costs on risky ones."""
    warn = F.when((label == 1) & (lead > 0), 1.0).when(label == 1, 0.0).otherwise(-0.3)
    return F.when(action.isin("alert", "block", "verify"), warn).when(action == "continue", F.when(label == 1, -1.0).otherwise(0.2)).otherwise(0.0)

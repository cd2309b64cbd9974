"""Risk models and calibration on ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.operators.prefix import policy


def _prior(df: DataFrame, label: str) -> tuple[int, float]:
    n, y = df.where(F.col(label).isNotNull()).agg(F.count(F.lit(1)), F.sum(F.col(label).cast("double"))).first()
    return n, (y or 0.0) / n if n else 0.0


def classifier(kind: str, n: int, seed: int = 7) -> Estimator:
    """The untrained model of a kind for ``n`` rows; reads ``_x`` and ``_y``. Boosting runs 100 rounds."""
    if kind == "logistic":
        return LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-9)
    if kind == "forest":
        return RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=100, maxDepth=3, seed=seed)
    if kind == "boosted":
        return GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=100, maxDepth=4, stepSize=0.1, minInstancesPerNode=20, seed=seed)
    raise ValueError(kind)


def train_and_score(train: DataFrame, score: DataFrame, features: Sequence[str], label: str = "label", kind: str = "logistic", seed: int = 7, out: str = "score") -> DataFrame:
    """``score`` with a risk of 0..100. Missing features count as 0; with one class in ``train`` every risk is its prior."""
    n, prior = _prior(train, label)
    if prior in (0.0, 1.0):
        return score.withColumn(out, F.lit(prior * 100.0))
    put = VectorAssembler(inputCols=list(features), outputCol="_x")
    clean = lambda d: put.transform(d.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}))
    fit_on = clean(train.where(F.col(label).isNotNull())).withColumn("_y", F.col(label).cast("double"))
    scored = classifier(kind, n, seed).fit(fit_on).transform(clean(score).select(*score.columns, "_x"))
    return scored.withColumn(out, vector_to_array("probability")[1] * 100.0).select(*score.columns, out)


def choose_calibration(n: int, least_class: int, small: bool = False) -> str:
    """The method for ``n`` rows of which the rarer class has ``least_class``.

    Of a split: isotonic from 10 rows and 3 of each class on, else Platt, or identity with one class. Of a
    ``small`` set: identity below 6 rows or with one class, isotonic from 30 rows and 3 of each class on, else Platt.
    """
    if least_class < 1 or small and n < 6:
        return "identity"
    return "isotonic" if n >= (30 if small else 10) and least_class >= 3 else "platt"


def calibrated(rows: DataFrame, score: str = "score", label: str = "label", out: str = "calibrated", method: str = "auto", small: bool = False) -> tuple[DataFrame, str]:
    """``rows`` with a calibrated risk of 0..100, and the method used: ``identity``, ``platt``, ``isotonic``, or chosen by the rows with ``auto``.

    The score is clipped to 0..100 first; rows without label are calibrated, but not learnt from. With one class nothing is changed.
    """
    n, prior = _prior(rows, label)
    least = int(round(min(prior, 1 - prior) * n))
    chosen = choose_calibration(n, least, small) if method == "auto" else method if least else "identity"
    clipped = rows.withColumn("_c", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(score).cast("double"))))
    if chosen == "identity":
        return clipped.withColumn(out, F.col("_c")).drop("_c"), chosen
    if chosen == "platt":
        done = platt(clipped.withColumn("_c", F.col("_c") / 100.0), "_c", label, "_u")
    elif chosen == "isotonic":
        done = _isotonic(clipped, "_c", label, "_u")
    else:
        raise ValueError(f"unknown calibration method: {method}")
    return done.withColumn(out, F.col("_u") * 100.0).drop("_c", "_u"), chosen


def thermometer(rows: DataFrame, scores: Sequence[str], label: str = "label", method: str = "auto", small: bool = True) -> DataFrame:
    """Adds ``calibrated_<score>`` of every score and ``thermometer_score``, their mean, with its policy."""
    for s in scores:
        rows, _ = calibrated(rows, s, label, f"calibrated_{s}", method, small)
    mean = sum((F.col(f"calibrated_{s}") for s in scores), F.lit(0.0)) / len(scores)
    return rows.withColumn("thermometer_score", mean).withColumn("policy", policy(mean))


def isotonic(rows: DataFrame, score: str = "score", label: str = "label", out: str = "calibrated") -> DataFrame:
    """Adds the isotonic calibration of a score in 0..100, interpolated inside the range and clipped outside."""
    n, prior = _prior(rows, label)
    if choose_calibration(n, int(round(min(prior, 1 - prior) * n))) != "isotonic":
        return rows.withColumn(out, F.col(score) / 100.0)
    return _isotonic(rows, score, label, out)


def _isotonic(rows: DataFrame, score: str, label: str, out: str) -> DataFrame:
    d = rows.withColumn("_s", F.col(score).cast("double"))
    model = IsotonicRegression(featuresCol="_s", labelCol="_l", predictionCol=out).fit(d.where(F.col(label).isNotNull()).withColumn("_l", F.col(label).cast("double")))
    return model.transform(d).drop("_s", "_l")


def platt(rows: DataFrame, score: str = "score", label: str = "label", out: str = "calibrated") -> DataFrame:
    """Adds Platt scaling of a score: a logistic model of this one feature, in-sample."""
    return train_and_score(rows, rows, [score], label, "logistic", out="_p").withColumn(out, F.col("_p") / 100.0).drop("_p")

"""Permutation importance by tree walks against plain Python, cost of a selection, held-out judgement of tuning."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators import models
from tidewatch.operators.features import LABEL
from tidewatch.params import DEFAULTS

NAMES = ["a", "b", "c", "flat"]
PARAMS = DEFAULTS.with_(permutation_repeats=4, n_estimators=6, max_depth=3, cv_folds=2)


def frame(spark, n=300):
    rng = np.random.default_rng(2)
    rows = []
    for key in ("x", "y"):
        for rn in range(n):
            a, b, c = map(float, rng.normal(size=3))
            rows.append((key, rn, n, a, b, c, 1.0, 3 * a + (b > 0) + 0.1 * c))
    return spark.createDataFrame(rows, f"series_key string, rn long, n long, a double, b double, c double, flat double, {LABEL} double")


def test_importance_equals_whole_predictions(spark):
    rows = frame(spark)
    model = models.fit_boosting(rows, NAMES, PARAMS)
    test = rows.where("rn < 40")
    got = {r.feature: r.importance for r in models.permutation_importance(model, test, NAMES, params=PARAMS).collect()}
    indexed, total = models.indexed(test, ["series_key", "rn"])
    pdf = indexed.orderBy("_i").toPandas()
    predicted = lambda frame: models.predict(model, spark.createDataFrame(frame), NAMES).orderBy("_i").toPandas()["predicted"].to_numpy()
    plain = np.abs(pdf[LABEL] - predicted(pdf)).mean()
    rng = random.Random(PARAMS.seed)
    strides = [models._stride(total, rng) for _ in range(PARAMS.permutation_repeats)]
    want = {}
    for f in NAMES:
        errors = []
        for a, b in strides:
            mixed = pdf.copy()
            mixed[f] = pdf[f].to_numpy()[[(a * i + b) % total for i in range(total)]]
            errors.append(np.abs(pdf[LABEL] - predicted(mixed)).mean())
        want[f] = np.mean(errors) - plain
    assert set(got) == set(NAMES) and all(abs(got[f] - want[f]) < 1e-9 for f in NAMES)
    assert got["a"] > got["b"] > got["flat"] == 0


def test_selection_and_tuning_are_judged_on_held_out_rows(spark):
    rows = frame(spark)
    table = spark.createDataFrame([("a", "kept", True), ("b", "importance", False), ("c", "correlation", False), ("flat", "cardinality", False)], "feature string, stage string, kept boolean")
    effect = models.selection_effect(rows, table, PARAMS).first()
    assert (effect.n_before, effect.n_after) == (4, 1) and effect.mae_selected > effect.mae_all_features and abs(effect.mae_change - (effect.mae_selected - effect.mae_all_features)) < 1e-12
    rows = rows.withColumn("cpu_percent_lag_0", F.col("a"))
    report = models.tuning_report(rows, NAMES[:3], "cpu_percent", [{"n_estimators": 1, "max_depth": 1, "learning_rate": 0.1}, {"n_estimators": 12, "max_depth": 3, "learning_rate": 0.3}], PARAMS).first()
    assert (report.best_trial, report.trials) == (1, 2) and report.test_gain > 0 and abs(report.tuned_test_mae - round(models.held_out_mae(rows, NAMES[:3], PARAMS, n_estimators=12, max_depth=3, learning_rate=0.3), 5)) < 2e-5
    assert report.adopt == (report.adopted_params is not None)

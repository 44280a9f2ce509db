"""Queries with trained models. SQL has no trees, so most have no oracle; the ridge is checked against its normal equations in the tests.

Tree counts are kept small here (`TREES`); the defaults of `Params` stay as they are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import backtest as B
from tidewatch.operators import models as ML
from tidewatch.operators import refit as R
from tidewatch.operators import scoring as Z
from tidewatch.operators.cost import recent_values, to_long
from tidewatch.operators.features import LABEL
from tidewatch.operators.ordering import cut_lineage, newest
from tidewatch.params import DEFAULTS
from tidewatch.plans.catalog import query, rounded, with_ctes
from tidewatch.plans.decide import backtest_sql, summary_sql
from tidewatch.plans.shape import TARGET, USABLE, cleaned, predictions, usable

TREES = 10
COLUMNS = [f"{TARGET}_lag_{k}" for k in (0, 1, 3)] + [f"{TARGET}_roll_mean", f"{TARGET}_roll_std", f"{TARGET}_ewma_slow", f"{TARGET}_trend", "hour"]


def fixed_rows(spark, d):
    """Usable rows, materialised once because several fits read them."""
    return cut_lineage(usable(spark, d)[0])


@query("ridge_ladder")
def ridge_ladder(spark, d):
    """The baseline ladder with its linear rung, per series."""
    rows, names, layout = predictions(spark, d)
    rows = cut_lineage(rows)
    return Z.ladder(Z.split_test(ML.ridge_rung(rows, COLUMNS)))


@query("boosting_holdout")
def boosting_holdout(spark, d):
    """Pooled boosting against persistence on the test rows of each series."""
    test = ML.holdout(fixed_rows(spark, d), COLUMNS, n_estimators=TREES)
    scored = test.withColumn("p_model", F.col("predicted")).withColumn("p_persistence", F.col(f"{TARGET}_lag_0"))
    return Z.ladder(scored)


@query("boosting_error_by_regime")
def boosting_error_by_regime(spark, d):
    test = ML.holdout(fixed_rows(spark, d), COLUMNS, n_estimators=TREES)
    return Z.error_by_regime(test.withColumn("abs_error", F.abs(F.col(LABEL) - F.col("predicted"))))


@query("boosting_cross_validation")
def boosting_cross_validation(spark, d):
    out = ML.cross_validate(fixed_rows(spark, d), COLUMNS, n_estimators=TREES)
    return Z.cv_summary(ML.cv_scores(out, TARGET), "model", "base")


@query("scaling_verdicts")
def scaling_verdicts(spark, d):
    return Z.scaling_verdicts(ML.scaling_table(fixed_rows(spark, d), COLUMNS, n_estimators=TREES))


@query("feature_selection")
def feature_selection(spark, d):
    return ML.select_features(fixed_rows(spark, d), [*COLUMNS, "minute"], TARGET, n_estimators=TREES)[1]


@query("importance_ranking")
def importance_ranking(spark, d):
    """Features by what shuffling them costs on the test rows, the dearest first."""
    rows = fixed_rows(spark, d)
    scores = ML.permutation_importance(ML.fit_boosting(Z.split_train(rows), COLUMNS, n_estimators=TREES), Z.split_test(rows), COLUMNS)
    return scores.orderBy(F.desc("importance"), "feature")


@query("feature_selection_effect")
def feature_selection_effect(spark, d):
    """Held-out error before and after the screens."""
    rows = fixed_rows(spark, d)
    _, table = ML.select_features(rows, [*COLUMNS, "minute"], TARGET, n_estimators=TREES)
    return ML.selection_effect(rows, table, n_estimators=TREES)


@query("tuning_verdict")
def tuning_verdict(spark, d):
    params = DEFAULTS.with_(n_estimators=10)
    grid = {"n_estimators": (5, 10), "max_depth": (2, 3), "learning_rate": (0.1, 0.2)}
    return ML.tuning_report(fixed_rows(spark, d), COLUMNS, TARGET, ML.sample_grid(grid, 2), params)


def last_state(done, rows):
    """Newest history of each series inside its last segment."""
    last = newest(rows, ["series_key"], [F.desc("ts")]).select("series_key", "segment_id")
    tail = recent_values(to_long(done.join(last, ["series_key", "segment_id"], "left_semi"), [TARGET]))
    return tail.select("series_key", F.col("recent").alias("history"), F.col("last_ts").alias("ts"))


@query("rollout_forecast")
def rollout_forecast(spark, d):
    """A trained champion's multi-step forecast, its own predictions fed back."""
    done, _ = cleaned(spark, d)
    rows = fixed_rows(spark, d)
    model = ML.fit_boosting(Z.split_train(rows), COLUMNS, n_estimators=TREES)
    state = last_state(done, rows)
    rolled = ML.rollout(model, state, TARGET, COLUMNS)
    start = state.select("series_key", F.col("ts").alias("start"), F.lit(2.0).alias("mae"))
    return ML.trajectory(rolled.drop("ts").join(start, "series_key"), "start", ["series_key"])


@query("backfill_model")
def backfill_model(spark, d):
    """The trained champion replayed over every complete row."""
    rows = fixed_rows(spark, d)
    out = ML.predict(ML.fit_boosting(Z.split_train(rows), COLUMNS, n_estimators=TREES), rows, COLUMNS)
    return out.select("series_key", (F.col("ts") + F.expr("INTERVAL 3 SECONDS")).alias("predicted_for_ts"), "predicted")


@query("backtest_with_refit")
def backtest_with_refit(spark, d):
    """The replay with a model refitted every 25 decisions in place of persistence."""
    done, layout = cleaned(spark, d)
    columns = [c for c in COLUMNS if c != "hour"]
    decided = B.decisions(done, TARGET, layout)
    forecast = ML.refit_forecasts(fixed_rows(spark, d), decided, TARGET, columns, n_estimators=TREES)
    return B.summarise(B.replay(forecast), F.lit(TARGET))


# a ridge on the newest value alone, so that its rollout has a closed form
_REFITS = backtest_sql(
    USABLE,
    "clean",
    TARGET,
    [
        f"seen AS (SELECT u.series_key, m.rn AS at, u.{TARGET}_lag_0 AS x, u.target_next AS y FROM usable u JOIN num m USING (series_key, ts))",
        "begun AS (SELECT series_key, step // 25 AS block, min(start) AS begins FROM dec GROUP BY ALL)",
        "sums AS (SELECT b.series_key, block, count(*) AS k, sum(x) AS sx, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y) AS sy FROM begun b JOIN seen s ON b.series_key = s.series_key AND s.at + 1 < b.begins GROUP BY ALL HAVING count(*) >= 30)",
        "slope AS (SELECT *, (sxy - sx * sy / k) / (sxx - sx * sx / k + 1.0) AS b FROM sums)",
        "rolled AS (SELECT h.*, list_filter(recent, lambda v: v IS NOT NULL)[-1] AS x0, b, (sy - b * sx) / k AS a FROM hist h LEFT JOIN slope s ON h.series_key = s.series_key AND h.step // 25 = s.block)",
        "told AS (SELECT * EXCLUDE (x0, a, b), CASE WHEN b IS NULL OR x0 IS NULL THEN [recent[-1]] ELSE list_transform(range(1, 21), lambda q: pow(b, q) * x0 + a * (1 - pow(b, q)) / (1 - b)) END AS forecast FROM rolled)",
    ],
    "list_aggregate(forecast, 'quantile_cont', 0.95)",
    "told",
)


def refitted(spark, d):
    done, layout = cleaned(spark, d)
    rows, _, _ = usable(spark, d)
    return R.refit_ridge(done, rows, B.decisions(done, TARGET, layout), TARGET, [f"{TARGET}_lag_0"], layout)


@query("backtest_ridge_refits", with_ctes([*_REFITS, *summary_sql(TARGET)], "SELECT * FROM summary"))
def backtest_ridge_refits(spark, d):
    """The replay with a ridge of each series refitted every 25 decisions on all that was known."""
    return B.summarise(B.replay(refitted(spark, d)), F.lit(TARGET))


@query("refit_first_steps", with_ctes(_REFITS, f"SELECT series_key, step, ts AS predicted_for_ts, {rounded('predicted', 'actual', 'error')} FROM (SELECT *, forecast[1] AS predicted, future[1] AS actual, abs(actual - predicted) AS error FROM told)"))
def refit_first_steps(spark, d):
    """The first step of every refitted forecast beside what came, for the prediction log."""
    return R.first_steps(refitted(spark, d))

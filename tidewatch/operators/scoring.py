"""Baselines, error measures, scalers and screening of features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.cadence import SERIES
from tidewatch.operators.features import LABEL, fold_of, train_size
from tidewatch.operators.ordering import Layout, in_blocks, join_spread
from tidewatch.operators.percentiles import exact_percentiles
from tidewatch.params import DEFAULTS, Params


def error_aggregates(actual: Column, predicted: Column) -> tuple[Column, Column]:
    """(mae, rmse) over pairs where both are finite numbers; null when there is none."""
    gap = actual - predicted
    usable = gap.isNotNull() & ~F.isnan(gap) & (F.abs(gap) != F.lit(float("inf")))
    gap = F.when(usable, gap)
    return F.avg(F.abs(gap)), F.sqrt(F.avg(gap * gap))


def baseline_predictions(rows: DataFrame, target: str, layout: Layout, params: Params = DEFAULTS) -> DataFrame:
    """Add `p_<rung>` columns to numbered usable rows (`rn`)."""
    now, before = F.col(f"{target}_lag_0"), F.col(f"{target}_lag_1")

    def seasonal(frame, by):
        w = Window.partitionBy(*by).orderBy("rn")
        return frame.withColumn("p_seasonal_naive", F.lag(f"{target}_lag_0", params.seasonal_lag).over(w))

    out = in_blocks(rows, [SERIES], "rn", layout, seasonal, before=params.seasonal_lag)
    return out.withColumns(
        {
            "p_persistence": now,
            "p_persistence_lag1": before,
            "p_drift": now + (now - before),
            "p_rolling_mean": F.col(f"{target}_roll_mean"),
        }
    )


def ladder(predicted: DataFrame, keys: Sequence[str] = (SERIES,), label: str = LABEL) -> DataFrame:
    """MAE and RMSE (4 decimals) of every `p_` column on the same rows, best first; rungs without any prediction are left out."""
    rungs = [c for c in predicted.columns if c.startswith("p_")]
    aggs = []
    for c in rungs:
        mae, rmse = error_aggregates(F.col(label), F.col(c))
        aggs += [F.round(mae, 4).alias(f"_mae_{c}"), F.round(rmse, 4).alias(f"_rmse_{c}")]
    wide = predicted.groupBy(*keys).agg(*aggs)
    long = F.array(
        *[F.struct(F.lit(c[2:]).alias("baseline"), F.col(f"_mae_{c}").alias("mae"), F.col(f"_rmse_{c}").alias("rmse")) for c in rungs]
    )
    return wide.select(*keys, F.inline(long)).where(F.col("mae").isNotNull()).orderBy(*keys, "mae", "baseline")


def best_baseline(table: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Strongest rung per key; ties go to the first name."""
    pick = F.min(F.struct("mae", "baseline"))
    return table.groupBy(*keys).agg(pick.alias("_b")).select(*keys, F.col("_b.baseline").alias("baseline"), F.col("_b.mae").alias("mae"))


def error_by_regime(scored: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    return scored.groupBy(*keys, "regime").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("abs_error"), 4).alias("mae"), F.round(F.max("abs_error"), 4).alias("worst")
    )


def fold_scores(predicted: DataFrame, columns: dict[str, str], params: Params = DEFAULTS, label: str = LABEL) -> DataFrame:
    """Per series and fold the MAE of each predictor (`name -> column`)."""
    tagged = predicted.withColumn("fold", fold_of(F.col("rn"), F.col("n"), params)).where(F.col("fold").isNotNull())
    return tagged.groupBy(SERIES, "fold").agg(*[error_aggregates(F.col(label), F.col(c))[0].alias(n) for n, c in columns.items()])


def cv_summary(scores: DataFrame, model: str, baseline: str, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Mean and population deviation of the fold errors, and the folds the model won."""
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cv_folds"),
        F.round(F.avg(model), 4).alias("cv_mae_mean"),
        F.round(F.stddev_pop(model), 4).alias("cv_mae_std"),
        F.round(F.avg(baseline), 4).alias("cv_baseline_mae_mean"),
        F.round(F.stddev_pop(baseline), 4).alias("cv_baseline_mae_std"),
        F.count_if(F.col(model) < F.col(baseline)).alias("cv_folds_won"),
        F.round(F.avg((F.col(model) < F.col(baseline)).cast("int")), 3).alias("cv_folds_won_fraction"),
    )


def improvement(reference: Column, model: Column) -> Column:
    return F.when(reference > 0, F.round((reference - model) / reference * 100.0, 2))


def flat_signal(persistence_mae: Column, params: Params = DEFAULTS) -> Column:
    return F.coalesce(persistence_mae < params.flat_threshold, F.lit(False))


# -- scaling -----------------------------------------------------------------


def fit_scaler(train: DataFrame, columns: Sequence[str], method: str, keys: Sequence[str] = (SERIES,), layout: Layout | None = None) -> DataFrame:
    """Per key and feature `centre` and `spread`; a spread of zero counts as one. Fit on training rows only."""
    keys = list(keys)
    if method == "robust":
        long = train.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("_p"))
        long = long.select(*keys, "_p.feature", "_p.v")
        q = exact_percentiles(long, [*keys, "feature"], "v", [0.25, 0.5, 0.75], layout=layout)
        fitted = q.select(*keys, "feature", F.col("p0_5").alias("centre"), (F.col("p0_75") - F.col("p0_25")).alias("spread"))
    else:
        if method == "standard":
            make = lambda c: (F.avg(c), F.stddev_samp(c))
        elif method == "minmax":
            make = lambda c: (F.min(c).cast("double"), (F.max(c) - F.min(c)).cast("double"))
        else:
            raise ValueError(f"unknown scaling method {method!r}; expected standard, minmax or robust")
        aggs = []
        for c in columns:
            centre, spread = make(F.col(c))
            aggs += [centre.alias(f"_c_{c}"), spread.alias(f"_s_{c}")]
        rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_c_{c}").alias("centre"), F.col(f"_s_{c}").alias("spread")) for c in columns])
        fitted = train.groupBy(*keys).agg(*aggs).select(*keys, F.inline(rows))
    usable = F.col("spread").isNotNull() & ~F.isnan("spread") & (F.abs("spread") >= 1e-12)
    return fitted.withColumn("spread", F.when(usable, F.col("spread")).otherwise(F.lit(1.0)))


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: Sequence[str], keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """(x - centre) / spread. The scaler has one row per key and feature, folded to one map per key before the join."""
    keys = list(keys)
    maps = scaler.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("centre", "spread")))).alias("_scale")
    )
    joined = join_spread(df, maps, keys, list(columns)) if keys else df.crossJoin(F.broadcast(maps))  # one row without keys
    scaled = {c: (F.col(c) - F.col("_scale")[c]["centre"]) / F.col("_scale")[c]["spread"] for c in columns}
    return joined.withColumns(scaled).drop("_scale")


def scaling_verdicts(table: DataFrame) -> DataFrame:
    """(estimator, scaling, mae) rows to: does scaling matter to the estimator, and which is best."""
    return table.groupBy("estimator").agg(
        F.round(F.max("mae") - F.min("mae"), 6).alias("spread"),
        ((F.max("mae") - F.min("mae")) < 0.01).alias("invariant"),
        F.min(F.struct("mae", "rank", "scaling"))["scaling"].alias("best_method"),
    )


# -- screening ---------------------------------------------------------------


def cardinality(df: DataFrame, columns: Sequence[str], params: Params = DEFAULTS) -> DataFrame:
    """(feature, variance, distinct_values, kept): features that vary too little are not kept."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(F.inline(pairs))
    spread = long.groupBy("feature").agg(F.var_samp("v").alias("variance"))
    distinct = long.where(F.col("v").isNotNull()).distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("distinct_values"))
    kept = F.coalesce((F.col("variance") > params.min_variance) & ~F.isnan("variance"), F.lit(False))
    return spread.join(distinct, "feature", "left").withColumn("kept", kept)


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, r) of every pair in one aggregation pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"_r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(rows))


def correlation_screen(
    columns: Sequence[str],
    pairs: DataFrame,
    importance: dict[str, float] | None = None,
    protected: Sequence[str] = (),
    params: Params = DEFAULTS,
) -> tuple[list[str], dict[str, str]]:
    """Kept features and dropped -> winner. The walk is over features, not rows.

    Of a pair at or above the threshold a protected feature stays, otherwise the
    more important one; without importances the later one goes.
    """
    strong = pairs.where(F.abs("r") >= params.corr_threshold).select("feature_a", "feature_b")
    linked = {(r.feature_a, r.feature_b) for r in strong.collect()}
    importance, dropped = importance or {}, {}
    for i, first in enumerate(columns):
        for second in columns[i + 1 :]:
            if first in dropped:
                break
            if second in dropped or (first, second) not in linked:
                continue
            shielded = (first in protected, second in protected)
            if shielded == (False, True):
                loser = first
            elif shielded == (True, False):
                loser = second
            else:
                loser = second if importance.get(first, 0.0) >= importance.get(second, 0.0) else first
            dropped[loser] = first if loser == second else second
    return [c for c in columns if c not in dropped], dropped


def split_train(rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return rows.where(F.col("rn") < train_size(F.col("n"), params))


def split_test(rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return rows.where(F.col("rn") >= train_size(F.col("n"), params))

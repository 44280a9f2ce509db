"""Champions, predictions, horizon forecasts, and scoring against what happened."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.cadence import SERIES
from tidewatch.operators.clean import SEGMENT
from tidewatch.operators.forest import forest_value, known_values, missing_needs
from tidewatch.operators.ordering import Layout, add_position, in_blocks, newest, settle
from tidewatch.params import DEFAULTS, Params

BASELINE_PREFIX = "baseline-persistence"


def champions(models: DataFrame, keys: Sequence[str] = ("target",)) -> DataFrame:
    """Approved model per key, the latest promotion if several claim it."""
    return newest(models.where("is_champion"), list(keys), [F.desc("promoted_at"), F.desc("model_id")])


def resolve_champion(targets: DataFrame, models: DataFrame, keys: Sequence[str] = ("target",)) -> DataFrame:
    """Every target with its champion; persistence with an error of 0 where none was promoted."""
    keys = list(keys)
    best = champions(models, keys).select(*keys, "model_id", "mae", F.lit(True).alias("_has"))
    name = F.concat_ws("-", F.lit(BASELINE_PREFIX), *[F.col(k) for k in keys])
    joined = targets.join(best, keys, "left")
    return joined.select(
        *targets.columns,
        F.coalesce("model_id", name).alias("model_id"),
        F.when(F.col("_has"), F.col("mae")).otherwise(F.lit(0.0)).alias("mae"),
        F.coalesce(F.col("model_id").startswith(BASELINE_PREFIX), F.lit(True)).alias("is_baseline"),
    )


def next_instant(ts: Column, params: Params = DEFAULTS) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(int(params.nominal_cadence * params.target_shift * 1_000_000)))


def predict_next(vectors: DataFrame, champion: DataFrame, target: str, params: Params = DEFAULTS, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """One-step prediction of each key's champion from its newest vector.

    `vectors` has the feature columns and `definition_id`. A baseline champion
    repeats the newest value. A linear one brings `weights` (feature -> weight)
    and `intercept`, a forest its `trees` and `needs` (see `forest.packed`). A
    champion trained on another definition, one without weights or trees and one
    whose features the vector lacks are refused with a reason, so no prediction
    is missing without an error.
    """
    joined = vectors.join(champion, list(keys))
    known = known_values([c for c in vectors.columns if c.startswith(f"{target}_") or vectors.schema[c].dataType.simpleString() in ("double", "int", "bigint")])
    baseline = F.col("is_baseline")
    refused = ~baseline & F.col("feature_definition").isNotNull() & (F.col("feature_definition") != F.col("definition_id"))
    if "weights" in champion.columns:
        names = F.map_keys("weights")
        terms = F.transform(names, lambda n: F.element_at("weights", n) * F.try_element_at(known, n))
        linear = F.col("intercept") + F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
        trained = F.col("weights").isNotNull()
    else:
        linear, trained = F.lit(None).cast("double"), F.lit(False)
    if "trees" in champion.columns:
        grown = F.col("trees").isNotNull()
        linear = F.when(grown, F.when(~missing_needs(F.col("needs"), known), forest_value(F.col("trees"), known))).otherwise(linear)
        trained = trained | grown
    error = (
        F.when(refused, F.lit("feature definition mismatch"))
        .when(~baseline & ~trained, F.lit("no model weights"))
        .when(~baseline & linear.isNull(), F.lit("missing feature"))
    )
    predicted = F.when(baseline, F.round(f"{target}_lag_0", 4)).when(error.isNull(), F.round(linear, 4))
    return joined.select(*keys, "model_id", next_instant(F.col("ts"), params).alias("predicted_for_ts"), predicted.alias("predicted"), error.alias("error"))


def horizon_forecast(latest: DataFrame, params: Params = DEFAULTS, steps: int | None = None) -> DataFrame:
    """Flat persistence trajectory with a widening band.

    `latest` has series keys, ts, current and mae (null or 0 counts as 1.5).
    """
    mae = F.coalesce(F.nullif(F.col("mae"), F.lit(0.0)), F.lit(1.5))
    out = latest.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps or params.horizon))))
    spread = F.lit(1.96) * mae * F.sqrt(F.col("step") / 5.0)
    return out.withColumns(
        {
            "ts": F.timestamp_micros(F.unix_micros("ts") + F.col("step") * F.lit(int(params.nominal_cadence * 1_000_000))),
            "predicted": F.col("current"),
            "upper_bound": F.round(F.least(F.lit(100.0), F.col("current") + spread), 4),
            "lower_bound": F.round(F.greatest(F.lit(0.0), F.col("current") - spread), 4),
        }
    ).drop("current", "mae")


def horizon_summary(trajectory: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Peak, p95 and mean over the steps of a trajectory (a bounded group)."""
    return trajectory.groupBy(*keys).agg(
        F.max("predicted").alias("forecast_peak"),
        F.percentile("predicted", F.lit(0.95)).alias("forecast_p95"),
        F.avg("predicted").alias("forecast_mean"),
        F.count(F.lit(1)).alias("steps"),
    )


def timeline(actuals: DataFrame, trajectory: DataFrame, allocation: DataFrame, keys: Sequence[str], points: int) -> DataFrame:
    """Recent actuals, the bridge at the last of them, and the forecast, with the allocation as a constant."""
    keys = list(keys)
    recent = newest(actuals.select(*keys, "ts", "actual"), keys, [F.desc("ts")], points).withColumn("kind", F.lit("actual"))
    last = newest(actuals.select(*keys, "ts", "actual"), keys, [F.desc("ts")], 1)
    bridge = last.select(*keys, "ts", F.col("actual").alias("forecast"), F.lit("bridge").alias("kind"))
    ahead = trajectory.select(*keys, "ts", F.col("predicted").alias("forecast"), "upper_bound", "lower_bound", F.lit("forecast").alias("kind"))
    out = recent.unionByName(bridge, allowMissingColumns=True).unionByName(ahead, allowMissingColumns=True)
    return out.join(allocation, keys, "left")


def in_order(df: DataFrame) -> list[str]:
    """What orders the samples of a series: their instant and, if they have one, the `id`, which is arrival order."""
    return ["ts", "id"] if "id" in df.columns else ["ts"]


def backfill_baseline(df: DataFrame, value: str, layout: Layout, params: Params = DEFAULTS) -> DataFrame:
    """The persistence champion replayed: each value predicts the row `target_shift` later in its segment. Of equal instants the one that arrived first comes first."""
    order = in_order(df)
    placed = df if layout.single else settle(add_position(df, SEGMENT, order, layout, "_at"), layout)

    def shifted(frame, by):
        parts = by if "segment_id" in by else [*by, "segment_id"]
        w = Window.partitionBy(*parts).orderBy(*order if layout.single else ["_at"])
        return frame.withColumn("predicted", F.lag(value, params.target_shift).over(w))

    out = in_blocks(placed, SEGMENT, "_at", layout, shifted, before=params.target_shift)
    return out.where(F.col("predicted").isNotNull()).select(SERIES, "segment_id", F.col("ts").alias("predicted_for_ts"), "predicted")


def score(predictions: DataFrame, actuals: DataFrame, keys: Sequence[str], value: str = "actual") -> DataFrame:
    """Attach what happened, matched on the whole second; of several samples in it the first counts.

    A prediction for a second nobody recorded stays unscored.
    """
    keys = list(keys)
    second = lambda c: F.date_trunc("second", F.col(c))
    seen = actuals.where(F.col("ts").isNotNull()).groupBy(*keys, second("ts").alias("_second")).agg(F.min_by(value, F.struct(*in_order(actuals))).alias("actual"))
    open_rows = predictions.withColumn("_second", second("predicted_for_ts"))
    joined = open_rows.join(seen, [*keys, "_second"], "left").drop("_second")
    return joined.withColumn("abs_error", F.abs(F.col("actual") - F.col("predicted")))


def recent_predictions(scored: DataFrame, keys: Sequence[str], limit: int = 100) -> DataFrame:
    return newest(scored.where(F.col("actual").isNotNull()), list(keys), [F.desc("predicted_for_ts")], limit)

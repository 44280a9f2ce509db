"""Gap-aware feature vectors, the supervised target, and chronological splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.cadence import SERIES
from tidewatch.operators.clean import SEGMENT
from tidewatch.operators.encode import all_encoded_names, encode
from tidewatch.operators.ordering import Layout, add_position, in_blocks, newest, settle, within_groups
from tidewatch.operators.transform import derived_columns, ewma_specs, exponential_means, label_regimes, seg_window, with_segment_position
from tidewatch.params import DEFAULTS, Params

LABEL = "target_next"
ROLL_STATS = ("mean", "std", "max", "min")
CALENDAR = ("hour", "minute", "second_of_minute", "dayofweek")


def lag_columns(target: str, w, lags: Sequence[int]) -> dict[str, Column]:
    return {f"{target}_lag_{k}": F.lag(target, k).over(w) if k else F.col(target) for k in lags}


def rolling_columns(target: str, w, size: int) -> dict[str, Column]:
    """Statistics of the last `size` rows including this one, null below two observations."""
    frame = w.rowsBetween(-(size - 1), 0)
    make = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}
    enough = F.count(target).over(frame) >= 2
    return {f"{target}_roll_{s}": F.when(enough, make[s](target).over(frame)) for s in ROLL_STATS}


def calendar_columns(ts: str = "ts") -> dict[str, Column]:
    return dict(zip(CALENDAR, (F.hour(ts), F.minute(ts), F.second(ts).cast("int"), F.weekday(ts))))


def interaction_columns(target: str) -> dict[str, Column]:
    """Products and ratios of history; needs lag_0, `_delta` and the rolling columns."""
    level = F.col(target)
    vol = F.coalesce(F.col(f"{target}_roll_std"), F.lit(0.0))
    slope = F.coalesce(F.col(f"{target}_delta"), F.lit(0.0))
    away = (level - F.col(f"{target}_roll_mean")) / F.nullif(vol, F.lit(0.0))
    return {
        f"{target}_level_x_vol": level * vol,
        f"{target}_slope_x_vol": slope * vol,
        f"{target}_steps_to_saturation": (F.lit(100.0) - level) / F.greatest(slope, F.lit(0.05)),
        f"{target}_zscore_local": F.coalesce(away, F.lit(0.0)),
    }


def feature_names(target: str, available: Sequence[str], params: Params = DEFAULTS) -> list[str]:
    """Ordered feature list of a target. Derived columns exist for quality targets only."""
    names = [f"{target}_lag_{k}" for k in params.lags] + [f"{target}_roll_{s}" for s in ROLL_STATS]
    if target in params.quality_targets:
        names += [f"{target}_{d}" for d in ("delta", "ewma_fast", "ewma_slow", "trend", "headroom")]
    if params.use_interactions:
        names += [f"{target}_{i}" for i in ("level_x_vol", "slope_x_vol", "steps_to_saturation", "zscore_local")]
        names += [f"{t}_now" for t in params.forecast_targets if t != target and t in available]
    if params.use_calendar:
        names += CALENDAR
    if params.encoding_enabled and params.encode_in_model:
        names += all_encoded_names(params)
    return names


def complete_features(out: DataFrame, target: str, params: Params, available: Sequence[str]) -> DataFrame:
    """Add what follows from a row that has its history's columns: trend, interactions, companions, calendar, encoded labels."""
    more = {}
    if target in params.quality_targets:
        more[f"{target}_trend"] = F.col(f"{target}_ewma_fast") - F.col(f"{target}_ewma_slow")
    if params.use_interactions:
        more |= interaction_columns(target)
        more |= {f"{t}_now": F.col(t) for t in params.forecast_targets if t != target and t in available}
    if params.use_calendar:
        more |= calendar_columns()
    out = out.withColumns(more) if more else out
    if params.encoding_enabled and params.encode_in_model:
        if "regime" not in out.columns:
            out = label_regimes(out, params=params)
        out = encode(out, params)
    return out


def feature_frame(df: DataFrame, target: str, layout: Layout, params: Params = DEFAULTS) -> DataFrame:
    """Clean rows plus every feature and `target_next`, the value `target_shift` rows ahead in the segment.

    All frames share one partitioning and order, so Spark plans one exchange and one sort.
    """
    clean_cols = df.columns
    names = feature_names(target, clean_cols, params)
    if "slot" in clean_cols:
        layout = within_groups(df, "slot", layout)

    def build(frame, by):
        w = seg_window(by)
        cols = lag_columns(target, w, params.lags) | rolling_columns(target, w, params.roll_window)
        if target in params.quality_targets:
            cols |= derived_columns(target, w, params)
        else:
            cols[f"{target}_delta"] = F.col(target) - F.lag(target).over(w)
        cols[LABEL] = F.lead(target, params.target_shift).over(w)
        return frame.withColumns(cols)

    smoothed = [target] if target in params.quality_targets else []
    placed = exponential_means(with_segment_position(df, layout), ewma_specs(smoothed, params), layout)
    out = in_blocks(placed, SEGMENT, "at", layout, build, max(*params.lags, params.roll_window), params.target_shift)
    out = complete_features(out, target, params, clean_cols)
    extra = [c for c in ("regime",) if c in out.columns and c not in clean_cols]
    return out.select(*clean_cols, *extra, *[n for n in names if n not in clean_cols], LABEL)


def training_rows(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    return frame.dropna(subset=[*features, LABEL])


def training_summary(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    usable = training_rows(frame, features).groupBy(SERIES, "segment_id").agg(F.count(F.lit(1)).alias("n"))
    return usable.groupBy(SERIES).agg(F.sum("n").alias("rows_usable"), F.count(F.lit(1)).alias("segments_contributing"))


def gap_blind_rows(df: DataFrame, target: str, layout: Layout, params: Params = DEFAULTS) -> DataFrame:
    """Per series: rows a build that ignores segments would keep."""
    placed = df if layout.single else settle(add_position(df, [SERIES], ["ts"], layout, "at"), layout)

    def build(frame, by):
        w = Window.partitionBy(*by).orderBy("ts")
        cols = lag_columns(target, w, params.lags) | rolling_columns(target, w, params.roll_window)
        return frame.select("*", *[v.alias(f"_gb_{k}") for k, v in cols.items()], F.lead(target, params.target_shift).over(w).alias("_gb_next"))

    out = in_blocks(placed, [SERIES], "at", layout, build, max(*params.lags, params.roll_window), params.target_shift)
    whole = F.lit(True)
    for c in out.columns:
        if c.startswith("_gb_"):
            whole = whole & F.col(c).isNotNull()
    return out.groupBy(SERIES).agg(F.count_if(whole).alias("gap_blind_rows"))


def contamination(df: DataFrame, target: str, layout: Layout, params: Params = DEFAULTS) -> DataFrame:
    """Rows whose history would reach across a gap: kept by a gap-blind build, dropped by this one."""
    names = feature_names(target, df.columns, params)
    aware = training_summary(feature_frame(df, target, layout, params), names)
    blind = gap_blind_rows(df, target, layout, params)
    usable = F.coalesce(F.col("rows_usable"), F.lit(0).cast("bigint"))
    return blind.join(aware, SERIES, "left").select(
        SERIES,
        usable.alias("rows_usable"),
        "gap_blind_rows",
        F.greatest(F.col("gap_blind_rows") - usable, F.lit(0).cast("bigint")).alias("contaminated_rows"),
        F.coalesce("segments_contributing", F.lit(0).cast("bigint")).alias("segments_contributing"),
    )


def serving_rows(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """Newest row with a complete vector, per series."""
    return newest(frame.dropna(subset=list(features)), [SERIES], [F.desc("ts")])


# -- splits: by position in time, never shuffled -----------------------------


def numbered(df: DataFrame, layout: Layout) -> DataFrame:
    """Add `rn` (0-based place among the rows of the series) and `n` (their number).

    Sliced rows are settled first: conditions on many derived columns, such as
    those of complete vectors, would be multiplied by the optimizer in the join
    that places the rows.
    """
    df = settle(df, layout)
    return settle(add_position(df, [SERIES], ["ts"], layout, "rn", "n"), layout)


def train_size(n: Column, params: Params = DEFAULTS) -> Column:
    return F.floor(n * F.lit(1.0 - params.test_fraction)).cast("bigint")


def split_rows(rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Add `split` = train/test to numbered rows."""
    return rows.withColumn("split", F.when(F.col("rn") < train_size(F.col("n"), params), "train").otherwise("test"))


def fold_start(n: Column, params: Params = DEFAULTS) -> Column:
    return F.floor(n * F.lit(params.cv_min_train)).cast("bigint")


def fold_of(rn: Column, n: Column, params: Params = DEFAULTS) -> Column:
    """Test fold of a row under rolling-origin validation, null before the first or when there are too few rows."""
    start = fold_start(n, params)
    size = F.floor((n - start) / params.cv_folds)
    enough = (n - start >= params.cv_folds * 2) & (start > 0)
    fold = F.least(F.floor((rn - start) / F.nullif(size, F.lit(0))), F.lit(params.cv_folds - 1))
    return F.when(enough & (rn >= start), fold).cast("int")


def folds(rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Per series and fold: rows before it (training) and in it (test)."""
    tagged = rows.withColumn("fold", fold_of(F.col("rn"), F.col("n"), params)).where(F.col("fold").isNotNull())
    return tagged.groupBy(SERIES, "fold").agg(
        F.min("rn").alias("train_rows"), F.count(F.lit(1)).alias("test_rows"), F.min("ts").alias("test_from"), F.max("ts").alias("test_to")
    )

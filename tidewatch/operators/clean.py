"""Cleaning: normalise, merge duplicates, clip, segment, regrid, flag, repair, impute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import any_of, clamp
from tidewatch.operators.cadence import SERIES, detect_cadence, segment, segment_report, segment_starts
from tidewatch.operators.contract import METRICS, Contract, coerce
from tidewatch.operators.ordering import Layout, attach, in_blocks, neighbours, settle, within_groups
from tidewatch.params import DEFAULTS, Params

SEGMENT = [SERIES, "segment_id"]


def value_columns(df: DataFrame, contract: Contract) -> list[str]:
    return [c for c in contract.values if c in df.columns]


def target_columns(df: DataFrame, contract: Contract) -> list[str]:
    return [c for c in contract.targets if c in df.columns]


def normalise(df: DataFrame, contract: Contract = METRICS) -> DataFrame:
    return coerce(df, contract).where(F.col("ts").isNotNull())


def deduplicate(df: DataFrame, contract: Contract = METRICS, counted: str | None = None) -> DataFrame:
    """One row per (series, ts): the mean of every numeric column, nulls skipped. `counted` names a column for how many rows it was."""
    means = [F.avg(c).alias(c) for c in value_columns(df, contract)]
    return df.groupBy(SERIES, "ts").agg(*means, *([F.count(F.lit(1)).alias(counted)] if counted else []))


def clip_ranges(df: DataFrame, contract: Contract = METRICS) -> DataFrame:
    rules = [r for r in contract.ranged if r.column in df.columns]
    return df.withColumns({r.column: clamp(r.column, r.min_value, r.max_value) for r in rules})


def clipped_counts(df: DataFrame, contract: Contract = METRICS) -> dict[str, Column]:
    """column -> aggregate counting the values `clip_ranges` would change."""
    return {
        r.column: F.count_if((F.col(r.column) < r.min_value) | any_of([F.col(r.column) > r.max_value] if r.max_value is not None else []))
        for r in contract.ranged
        if r.column in df.columns
    }


def grid_step(cadence: str = "cadence") -> Column:
    """Slot width in microseconds: whole milliseconds, at least one."""
    return F.greatest(F.rint(F.col(cadence) * 1000.0) * 1000, F.lit(1000.0)).cast("bigint")


def regrid(segmented: DataFrame, layout: Layout, contract: Contract = METRICS, params: Params = DEFAULTS) -> DataFrame:
    """Even time axis inside every segment, starting at its first sample.

    Samples sharing a slot are averaged; empty slots become rows of nulls marked
    `is_imputed`. Inside a segment no delta exceeds the gap threshold, so the
    holes after a sample are few and are generated from the sample itself.
    """
    values = value_columns(segmented, contract)
    chained = "next_ts" in segmented.columns  # from `segment`, which has seen each row's neighbours
    placed = segmented if chained else segment_starts(segmented, layout)
    origin = F.unix_micros("segment_start")

    def slot_of(ts):
        return F.floor((F.unix_micros(ts) - origin) / F.col("_step")).cast("bigint")

    slots = (
        placed.withColumn("_step", grid_step())
        .withColumn("slot", slot_of("ts"))
        .groupBy(*SEGMENT, "slot")
        .agg(
            *[F.avg(c).alias(c) for c in values],
            F.count(F.lit(1)).alias("observations"),
            F.min("segment_start").alias("segment_start"),
            F.min("_step").alias("_step"),
            *([F.max(slot_of("next_ts")).alias("_following")] if chained else []),
        )
    )
    reach = int(params.gap_multiple) + 3

    def holes(frame, by):
        following = F.lead("slot").over(Window.partitionBy(*by).orderBy("slot"))
        return frame.withColumn("_following", following)

    filled = slots if chained else in_blocks(slots, SEGMENT, "slot", layout, holes, after=reach)
    last = F.greatest(F.col("_following") - 1, F.col("slot"))  # nothing follows the last slot of a segment
    filled = filled.withColumn("_slots", F.sequence(F.col("slot"), last))
    filled = filled.withColumn("_slot", F.explode("_slots"))
    real = F.col("_slot") == F.col("slot")
    return filled.select(
        *SEGMENT,
        F.col("_slot").alias("slot"),
        F.timestamp_micros(F.unix_micros("segment_start") + F.col("_slot") * F.col("_step")).alias("ts"),
        *[F.when(real, F.col(c)).alias(c) for c in values],
        F.when(real, 0).otherwise(1).alias("is_imputed"),
        F.when(real, F.col("observations")).otherwise(F.lit(0).cast("bigint")).alias("observations"),
    )


def rolling_median(x: str, window: int, by: list[str], order: str) -> Column:
    """Centred median over an odd window, null below three observations."""
    half = window // 2
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)
    return F.when(F.count(x).over(w) >= 3, F.percentile(F.col(x), F.lit(0.5)).over(w))


def flag_outliers(df: DataFrame, layout: Layout, contract: Contract = METRICS, params: Params = DEFAULTS, keep_median: bool = False) -> DataFrame:
    """Hampel flags per target and for any target. No value is changed."""
    targets = target_columns(df, contract)

    def scored(frame, by):
        parts = by if "segment_id" in by else [*by, "segment_id"]
        frame = frame.withColumns({f"_m_{c}": rolling_median(c, params.outlier_window, parts, "slot") for c in targets})
        frame = frame.withColumns({f"_d_{c}": F.abs(F.col(c) - F.col(f"_m_{c}")) for c in targets})
        return frame.withColumns({f"_a_{c}": rolling_median(f"_d_{c}", params.outlier_window, parts, "slot") for c in targets})

    out = in_blocks(df, SEGMENT, "slot", layout, scored, params.outlier_window, params.outlier_window)
    flags = {}
    for c in targets:
        score = f"abs(0.6745D * ({c} - _m_{c}) / nullif(_a_{c}, 0D))"
        flags[f"{c}_is_outlier"] = F.expr(f"CASE WHEN {score} > {params.outlier_threshold}D THEN 1 ELSE 0 END")
    out = out.withColumns(flags)
    out = out.withColumn("is_outlier", F.greatest(*[F.col(f) for f in flags], F.lit(0)))
    scratch = [f"{p}{c}" for c in targets for p in (("_d_", "_a_") if keep_median else ("_m_", "_d_", "_a_"))]
    return out.drop(*scratch)


def linear_fill(c: str, pos: str, limit: int | None, edges: bool) -> Column:
    """Value on the line between the nearest known neighbours (see `neighbours`)."""
    back, ahead = f"({pos} - _pp_{c})", f"(_np_{c} - {pos})"
    near = f" AND least({back}, {ahead}) <= {limit}" if limit is not None else ""
    rest = f"coalesce(_pv_{c}, _nv_{c})" if edges else "NULL"
    return F.expr(
        f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN _pv_{c} IS NOT NULL AND _nv_{c} IS NOT NULL{near} "
        f"THEN _pv_{c} + (_nv_{c} - _pv_{c}) * {back} / ({back} + {ahead}) ELSE {rest} END"
    )


def _drop_neighbours(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*[f"_{k}_{c}" for c in cols for k in ("pv", "pp", "nv", "np")])


def repair_outliers(df: DataFrame, layout: Layout, contract: Contract = METRICS, params: Params = DEFAULTS) -> DataFrame:
    """Act on flags: leave (default), interpolate over them, or replace by the local median (`_m_` columns)."""
    targets = target_columns(df, contract)
    if params.outlier_strategy == "clip":
        return df.withColumns({c: F.when(F.col(f"{c}_is_outlier") == 1, F.col(f"_m_{c}")).otherwise(F.col(c)) for c in targets})
    if params.outlier_strategy != "interpolate":
        return df
    flagged = attach(df, [SERIES], {f"_any_{c}": (F.max, f"{c}_is_outlier") for c in targets}, layout, "slot")
    before = flagged.withColumns({f"_raw_{c}": F.col(c) for c in targets})
    holed = before.withColumns({c: F.when(F.col(f"{c}_is_outlier") == 0, F.col(c)) for c in targets})
    around = neighbours(settle(holed, layout), SEGMENT, "slot", targets, layout)
    fixed = around.withColumns(
        {c: F.when(F.col(f"_any_{c}") == 1, linear_fill(c, "slot", None, True)).otherwise(F.col(f"_raw_{c}")) for c in targets}
    )
    return _drop_neighbours(fixed, targets).drop(*[f"_any_{c}" for c in targets], *[f"_raw_{c}" for c in targets])


def impute(df: DataFrame, layout: Layout, contract: Contract = METRICS, params: Params = DEFAULTS) -> DataFrame:
    """Linear interpolation inside segments, at most `max_interpolate_run` rows from a known value.

    Nothing is extrapolated. `filled_c` marks the cells that were filled.
    """
    cols = value_columns(df, contract)
    around = neighbours(settle(df, layout), SEGMENT, "slot", cols, layout)
    out = around.withColumns({f"_new_{c}": linear_fill(c, "slot", params.max_interpolate_run, False) for c in cols})
    out = out.withColumns({f"filled_{c}": F.expr(f"CAST({c} IS NULL AND _new_{c} IS NOT NULL AS INT)") for c in cols})
    out = out.withColumns({c: F.col(f"_new_{c}") for c in cols})
    return _drop_neighbours(out, cols).drop(*[f"_new_{c}" for c in cols])


def drop_unfillable(df: DataFrame, contract: Contract = METRICS) -> DataFrame:
    return df.dropna(subset=target_columns(df, contract))


def prepared(raw: DataFrame, contract: Contract = METRICS) -> DataFrame:
    """Normalised, merged and clipped samples: everything before order matters."""
    return clip_ranges(deduplicate(normalise(raw, contract), contract), contract)


def gridded(
    raw: DataFrame,
    layout: Layout,
    contract: Contract = METRICS,
    params: Params = DEFAULTS,
    cadence: DataFrame | None = None,
) -> DataFrame:
    """Segmented and regridded samples."""
    base = settle(prepared(raw, contract), layout)
    cadence = cadence if cadence is not None else detect_cadence(base, layout, params)
    return settle(regrid(segment(base, cadence, layout, params, ends=True), layout, contract, params), layout)


def repaired(grid: DataFrame, layout: Layout, contract: Contract = METRICS, params: Params = DEFAULTS) -> DataFrame:
    inside = within_groups(grid, "slot", layout)
    flagged = flag_outliers(grid, inside, contract, params, keep_median=True)
    done = impute(repair_outliers(flagged, layout, contract, params), inside, contract, params)
    return done.drop(*[c for c in done.columns if c.startswith("_m_")])


def clean(
    raw: DataFrame,
    layout: Layout | None = None,
    contract: Contract = METRICS,
    params: Params = DEFAULTS,
    cadence: DataFrame | None = None,
) -> DataFrame:
    """The whole stage. Rows are keyed by (series_key, segment_id, slot)."""
    layout = layout or Layout.plan(raw)
    done = repaired(gridded(raw, layout, contract, params, cadence), layout, contract, params)
    return drop_unfillable(done, contract)


def audit(
    raw: DataFrame,
    layout: Layout | None = None,
    contract: Contract = METRICS,
    params: Params = DEFAULTS,
    cadence: DataFrame | None = None,
) -> DataFrame:
    """What cleaning changed, one row per series; each number is counted where it arises."""
    layout = layout or Layout.plan(raw)
    typed = coerce(raw, contract)
    incoming = typed.groupBy(SERIES).agg(
        F.count(F.lit(1)).alias("rows_in"), F.count_if(F.col("ts").isNull()).alias("dropped_no_timestamp")
    )
    means = deduplicate(normalise(raw, contract), contract, counted="_c")
    unclipped = settle(means, layout)  # read for what was merged, for what is clipped, and to go on
    merged = unclipped.groupBy(SERIES).agg(F.sum(F.col("_c") - 1).alias("duplicates_merged"))
    counts = clipped_counts(unclipped, contract)
    clipped = unclipped.groupBy(SERIES).agg(sum(list(counts.values())[1:], list(counts.values())[0]).alias("values_clipped"))

    base = clip_ranges(unclipped.drop("_c"), contract)
    cadence = cadence if cadence is not None else detect_cadence(base, layout, params)
    segmented = segment(base, cadence, layout, params, ends=True)
    shape = segment_report(segmented)
    final = repaired(settle(regrid(segmented, layout, contract, params), layout), layout, contract, params)
    cols = value_columns(final, contract)
    complete = F.lit(True)
    for t in target_columns(final, contract):
        complete = complete & F.col(t).isNotNull()
    filled = sum([F.sum(f"filled_{c}") for c in cols[1:]], F.sum(f"filled_{cols[0]}"))
    outgoing = final.groupBy(SERIES).agg(
        F.sum("is_imputed").alias("synthetic_rows"),
        F.count_if(F.col("observations") > 1).alias("collided_slots"),
        F.sum("is_outlier").alias("outlier_rows"),
        filled.alias("values_imputed"),
        F.count_if(~complete).alias("dropped_unfillable"),
        F.count_if(complete).alias("rows_out"),
    )
    out = incoming
    for part in (merged, clipped, shape, outgoing):
        out = out.join(part, SERIES, "left")
    return out

"""Derived columns, labels, unit columns and retention rollups of a clean series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import ewma_depth, ewma_step, headroom, regime_label
from tidewatch.operators.cadence import SERIES
from tidewatch.operators.clean import SEGMENT
from tidewatch.operators.encode import encode
from tidewatch.operators.ordering import GROUP_ROWS, SIZES, Layout, add_position, block_of, in_blocks, settle, slice_count
from tidewatch.operators.percentiles import known, sliced_percentiles
from tidewatch.params import DEFAULTS, Params


def with_segment_position(df: DataFrame, layout: Layout) -> DataFrame:
    """Add `at`: place of the row among the rows its segment has left after cleaning."""
    if layout.single:
        return df
    return settle(add_position(df, SEGMENT, ["ts"], layout, "at"), layout)


def seg_window(by: Sequence[str]):
    parts = [*by] if "segment_id" in by else [*by, "segment_id"]
    return Window.partitionBy(*parts).orderBy("ts")


def ewma_spans(params: Params) -> tuple[int, int]:
    return max(2, params.roll_window // 3), params.roll_window


def derived_columns(target: str, w, params: Params = DEFAULTS) -> dict:
    """delta, rolling deviation, headroom; the exponential means are added by `exponential_means`."""
    frame = w.rowsBetween(-(params.roll_window - 1), 0)
    return {
        f"{target}_delta": F.col(target) - F.lag(target).over(w),
        f"{target}_roll_std": F.when(F.count(target).over(frame) >= 2, F.stddev_samp(target).over(frame)),
        f"{target}_headroom": headroom(target),
    }


def ewma_specs(targets: Sequence[str], params: Params = DEFAULTS) -> dict[str, tuple[str, int]]:
    fast, slow = ewma_spans(params)
    return {f"{t}_ewma_{name}": (t, span) for t in targets for name, span in (("fast", fast), ("slow", slow))}


def _composed(df: DataFrame, by: Sequence[str], order: str, pairs: dict[str, int]) -> DataFrame:
    """Every (`_f_n`, `_o_n`) composed with the pairs before it in `by`, null pairs passed over; `pairs`: n -> depth.

    Reach doubles with each step: 1, 2, 4, ... known rows. Beyond the depth a
    product of factors is below the last bit of a double.
    """
    window = f"OVER (PARTITION BY {', '.join(f'`{b}`' for b in by)} ORDER BY `{order}`)"
    reach = 1
    while reach < max(pairs.values()):
        open_pairs = [n for n, depth in pairs.items() if reach < depth]
        df = df.withColumns({f"_l{k}_{n}": F.expr(f"lag(`_{k}_{n}`, {reach}) IGNORE NULLS {window}") for n in open_pairs for k in "fo"})
        df = df.withColumns(
            {f"_f_{n}": F.col(f"_f_{n}") * F.coalesce(f"_lf_{n}", F.lit(1.0)) for n in open_pairs}
            | {f"_o_{n}": F.col(f"_o_{n}") + F.col(f"_f_{n}") * F.coalesce(f"_lo_{n}", F.lit(0.0)) for n in open_pairs}
        ).drop(*[f"_l{k}_{n}" for n in open_pairs for k in "fo"])
        reach *= 2
    return df


def exponential_means(df: DataFrame, specs: dict[str, tuple[str, int]], layout: Layout, keys: Sequence[str] = tuple(SEGMENT), order: str = "ts", pos: str = "at") -> DataFrame:
    """Add exponential means along each key: name -> (column, span).

    A known value maps the mean y to f * y + o, and such maps compose, so the
    mean is a scan of (f, o) pairs. On large tables each block is scanned alone,
    blocks are scanned by their last pairs, and what arrives at a block is put
    into its rows. Runs of nulls may be of any length, over any number of blocks.
    """
    if not specs:
        return df
    keys, single = list(keys), layout.single
    values = sorted({c for c, _ in specs.values()})
    by = keys if single else [*keys, "_block"]
    w = Window.partitionBy(*by).orderBy(order)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    if single:
        out = df.withColumn("_at", F.row_number().over(w))
        carried = {c: F.lit(None).cast("bigint") for c in values}
    else:
        blocked = df.withColumn("_at", F.col(pos).cast("bigint")).withColumn("_block", block_of(pos, layout))
        known = blocked.groupBy(*keys, "_block").agg(*[F.max(F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"_n_{c}") for c in values])
        over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        known = known.select(*keys, "_block", *[F.max(f"_n_{c}").over(over).alias(f"_c_{c}") for c in values])
        out = blocked.join(known, [*keys, "_block"])
        carried = {c: F.col(f"_c_{c}") for c in values}
    out = out.withColumns({f"_p_{c}": F.coalesce(F.last(F.when(F.col(c).isNotNull(), F.col("_at")), ignorenulls=True).over(earlier), carried[c]) for c in values})
    steps = {n: ewma_step(c, F.col("_at") - F.col(f"_p_{c}"), span) for n, (c, span) in specs.items()}
    out = out.withColumns({f"_f_{n}": f for n, (f, _) in steps.items()} | {f"_o_{n}": o for n, (_, o) in steps.items()})
    depths = {n: ewma_depth(span) for n, (_, span) in specs.items()}
    out = _composed(out, by, order, depths)
    if single:
        arriving = {n: F.lit(None).cast("double") for n in specs}
    else:
        out = settle(out, layout)
        last = {n: F.max_by(F.struct(F.col(f"_f_{n}").alias("f"), F.col(f"_o_{n}").alias("o")), F.when(F.col(f"_f_{n}").isNotNull(), F.col("_at"))) for n in specs}
        ends = out.groupBy(*keys, "_block").agg(*[v.alias(f"_e_{n}") for n, v in last.items()])
        ends = ends.select(*keys, "_block", *[F.col(f"_e_{n}.{k}").alias(f"_{k}_{n}") for n in specs for k in "fo"])
        ends = _composed(ends, keys, "_block", depths)
        over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*keys, "_block", *[F.last(f"_o_{n}", ignorenulls=True).over(over).alias(f"_y_{n}") for n in specs])
        out = out.join(ends, [*keys, "_block"])
        arriving = {n: F.col(f"_y_{n}") for n in specs}
    out = out.withColumns({n: F.col(f"_o_{n}") + F.col(f"_f_{n}") * F.coalesce(arriving[n], F.lit(0.0)) for n in specs})
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({n: F.coalesce(F.last(n, ignorenulls=True).over(so_far), arriving[n]) for n in specs})
    scratch = ["_at", *[f"_p_{c}" for c in values], *[f"_{k}_{n}" for n in specs for k in "fo"]]
    return out.drop(*scratch) if single else out.drop(*scratch, "_block", *[f"_c_{c}" for c in values], *[f"_y_{n}" for n in specs])


def add_derived(df: DataFrame, layout: Layout, params: Params = DEFAULTS, targets: Sequence[str] | None = None) -> DataFrame:
    targets = [t for t in (targets or params.quality_targets) if t in df.columns]

    def build(frame, by):
        w = seg_window(by)
        cols = {}
        for t in targets:
            cols |= derived_columns(t, w, params)
        return frame.withColumns(cols)

    placed = exponential_means(with_segment_position(df, layout), ewma_specs(targets, params), layout)
    out = in_blocks(placed, SEGMENT, "at", layout, build, before=params.roll_window)
    trend = {f"{t}_trend": F.col(f"{t}_ewma_fast") - F.col(f"{t}_ewma_slow") for t in targets}
    return out.withColumns(trend).drop("at")


def label_regimes(df: DataFrame, column: str = "cpu_percent", params: Params = DEFAULTS) -> DataFrame:
    if column not in df.columns:
        return df.withColumn("regime", F.lit(params.unknown_label))
    return df.withColumn("regime", regime_label(column, params.regime_bounds, params.unknown_label))


def regime_occupancy(labelled: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Rows and percentage (1 decimal) per label; the totals come from the few counted rows."""
    counts = labelled.groupBy(*keys, "regime").agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy(*keys))
    return counts.withColumn("pct", F.round(F.lit(100.0) * F.col("rows") / total, 1))


def normalise_units(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    cols = {"mem_used_gb": F.col("mem_used_mb") / 1024.0} if "mem_used_mb" in df.columns else {}
    cols |= {f"{t}_fraction": F.col(t) / 100.0 for t in params.quality_targets if t in df.columns}
    return df.withColumns(cols)


def scale_column(df: DataFrame, column: str, factor: float) -> DataFrame:
    """Demand scaling for stress runs."""
    return df.withColumn(column, F.col(column) * F.lit(float(factor)))


def rollup(
    df: DataFrame,
    freq: str,
    columns: Sequence[str],
    keys: Sequence[str] = (SERIES,),
    layout: Layout | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """Mean, max, p95 per column and sample count of every non-empty bucket, wide.

    Mean, max and count combine before the shuffle. A percentile cannot; where a
    bucket is too full for one aggregation buffer it is computed in slices.
    """
    group_rows = group_rows or SIZES.get().group_rows
    bucketed = df.withColumn("bucket", F.window("ts", freq)["start"])
    by = [*keys, "bucket"]
    plain = [F.avg(c).alias(f"{c}_mean") for c in columns] + [F.max(c).alias(f"{c}_max") for c in columns]
    samples = F.count(F.lit(1)).alias("samples")
    small = layout is not None and layout.single
    if not small:
        top = bucketed.groupBy(*by).agg(samples).agg(F.max("samples").alias("n"), F.sum("samples").alias("rows")).first()
        small = (top.n or 0) <= group_rows
    if small:
        p95 = [F.percentile(known(c), F.lit(0.95)).alias(f"{c}_p95") for c in columns]
        stats = bucketed.groupBy(*by).agg(*plain, *p95, samples)
    else:
        stats = bucketed.groupBy(*by).agg(*plain, samples)
        for c in columns:
            p95 = sliced_percentiles(bucketed, by, c, [0.95], slice_count(top.rows, group_rows, GROUP_ROWS) + 1).withColumnRenamed("p0_95", f"{c}_p95")
            stats = stats.join(p95, by, "left")
    ordered = [f"{c}_{s}" for c in columns for s in ("mean", "max", "p95")]
    return stats.select(*keys, F.col("bucket").alias("ts"), *ordered, "samples")


def rollup_long(wide: DataFrame, tier: str, columns: Sequence[str], keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """(tier, ts, column_name, mean_value, max_value, p95_value, samples) rows."""
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"{c}_mean").alias("mean_value"),
                F.col(f"{c}_max").alias("max_value"),
                F.col(f"{c}_p95").alias("p95_value"),
            )
            for c in columns
        ]
    )
    return wide.select(F.lit(tier).alias("tier"), *keys, "ts", "samples", F.inline(rows))


#: Seconds of the units a tier may be named in.
UNITS = {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400}


def tier_seconds(tier: str) -> int | None:
    """Length of a tier like `5 minutes`; None for other texts."""
    number, _, unit = tier.strip().partition(" ")
    unit = unit.strip().lower().rstrip("s")
    return int(number) * UNITS[unit] if number.isdigit() and unit in UNITS else None


def build_rollups(
    df: DataFrame, columns: Sequence[str], layout: Layout | None = None, keys: Sequence[str] = (SERIES,), params: Params = DEFAULTS
) -> DataFrame:
    """Every retention tier, long. A tier's p95 cannot be built from another tier, so each reads the samples.

    Tiers that divide the longest one are grouped inside its buckets: the samples
    are exchanged once and measured once for all of them.
    """
    tiers, lengths = list(params.rollup_tiers), [tier_seconds(t) for t in params.rollup_tiers]
    longest = max((n for n in lengths if n), default=0)
    if all(n and longest % n == 0 for n in lengths):
        placed = df.select(*keys, "ts", *columns).withColumn("_outer", F.window("ts", f"{longest} seconds")["start"])
        by = [*keys, "_outer"]
        fullest = None if layout is not None and layout.single else placed.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if (fullest or 0) <= SIZES.get().group_rows:
            met = placed.repartition(*[F.col(c) for c in by])
            parts = [rollup_long(rollup(met, tier, columns, by, Layout()), tier, columns, by).drop("_outer") for tier in tiers]
        else:
            parts = [rollup_long(rollup(df, tier, columns, keys, layout), tier, columns, keys) for tier in tiers]
    else:
        parts = [rollup_long(rollup(df, tier, columns, keys, layout), tier, columns, keys) for tier in tiers]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def transform(df: DataFrame, layout: Layout, params: Params = DEFAULTS) -> DataFrame:
    """Derived columns, regime, encoding and unit columns."""
    return normalise_units(encode(label_regimes(add_derived(df, layout, params), params=params), params), params)

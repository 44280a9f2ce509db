"""Breach accounting, pricing, the cost/SLA curve and recommendations."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import (
    array_breaches,
    breach_rate,
    by_target,
    monthly_cost,
    present,
    raw_cost,
    safety_floor,
    sorted_percentile,
    units,
)
from tidewatch.operators.cadence import SERIES
from tidewatch.operators.ordering import Layout, add_position, cut_lineage, newest, settle
from tidewatch.params import DEFAULTS, Params

# Consecutive values folded together. Small enough for one array, large enough
# that the per-block summaries are a tiny fraction of the rows.
FOLD_ROWS = 2_000
BLOCKS_IN_ONE = 4_096
# Summaries that leave a task in one frame.
FRAME_ROWS = 50_000


def value_blocks(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], layout: Layout, rows: int = FOLD_ROWS) -> DataFrame:
    """Known values of each key in order, cut into arrays of at most `rows`: (keys, block, values)."""
    keys = list(keys)
    known = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, *order, F.col(value).cast("double").alias("_v"))
    placed = settle(add_position(known, keys, list(order), layout, "_at"), layout)
    return (
        placed.withColumn("block", F.floor(F.col("_at") / rows).cast("bigint"))
        .groupBy(*keys, "block")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_s"))
        .select(*keys, "block", F.col("_s._v").alias("values"))
    )


def _summaries(values: np.ndarray, levels: np.ndarray) -> dict[str, np.ndarray]:
    """For every level what is needed to join a block to its neighbours.

    n, breaches, starts (a breach after a non-breach, the first value included),
    lead and run (breaching values at either end), best (longest run), worst.
    All are arrays of their own: a view would keep a number for each value and level alive.
    """
    over = values[None, :] > levels[:, None]
    size = values.size
    place = np.arange(size)
    length = place - np.maximum.accumulate(np.where(over, -1, place), axis=1)
    breaches = over.sum(axis=1)
    full = breaches == size
    return {
        "n": np.full(levels.size, size),
        "breaches": breaches,
        "starts": over[:, 0] + (over[:, 1:] & ~over[:, :-1]).sum(axis=1),
        "lead": np.where(full, size, np.argmin(over, axis=1)),
        "run": length[:, -1].copy(),
        "best": length.max(axis=1),
        "worst": np.where(breaches > 0, values.max() - levels, 0.0),
    }


def fold_blocks(blocks: DataFrame, keys: Sequence[str], levels: Sequence[float]) -> DataFrame:
    """One summary row per block and level. Blocks arrive as Arrow batches and are compared with all levels at once.

    Summaries of many blocks leave together: a frame for each would cost more than short blocks themselves.
    """
    grid = np.asarray(levels, dtype=float)
    names = [*keys, "block"]
    types = ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in names)
    schema = f"{types}, allocation_percent double, n bigint, breaches bigint, starts bigint, lead bigint, run bigint, best bigint, worst double"

    def fold(batches):
        together = max(1, FRAME_ROWS // grid.size) if grid.size else 1
        for pdf in batches:
            for begin in range(0, len(pdf), together):
                part = pdf.iloc[begin : begin + together]
                found = [_summaries(np.asarray(values, dtype=float), grid) for values in part["values"]]
                out = part[names].loc[part.index.repeat(grid.size)].reset_index(drop=True)
                out["allocation_percent"] = np.tile(grid, len(part))
                for name in found[0]:
                    out[name] = np.concatenate([f[name] for f in found])
                yield out

    return blocks.mapInPandas(fold, schema)


def array_episodes(values: Column, level: Column) -> Column:
    """Runs of consecutive values above a level in a bounded array."""
    before = F.concat(F.array(F.lit(False)), F.transform(values, lambda v: v > level))
    pairs = F.zip_with(F.transform(values, lambda v: v > level), F.slice(before, 1, F.size(values)), lambda now, prev: now & ~prev)
    return F.size(F.filter(pairs, lambda p: p))


def _chained(folded: DataFrame, by: Sequence[str]) -> DataFrame:
    """Blocks in order with `joined` (goes on from the block before) and `chain` (broken blocks so far)."""
    w = Window.partitionBy(*by).orderBy("block")
    f = folded.withColumn("full", F.col("n") == F.col("breaches"))
    return f.withColumns(
        {
            "joined": F.coalesce(((F.lag("run").over(w) > 0) & (F.col("lead") > 0)).cast("int"), F.lit(0)),
            "chain": F.sum(F.when(F.col("full"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )


def _crossing(chained: DataFrame, by: Sequence[str]) -> DataFrame:
    """Longest run over block borders. A chain starts with the tail of a broken block, goes on through full blocks and ends with the head of the next broken one."""
    by = list(by)
    tail = F.when(F.col("full"), F.col("n")).otherwise(F.col("run"))
    spans = chained.groupBy(*by, "chain").agg(F.sum(tail).alias("span"))
    heads = chained.where(~F.col("full")).select(*by, (F.col("chain") - 1).alias("chain"), "lead")
    joined = spans.join(heads, [*by, "chain"], "full")
    return joined.groupBy(*by).agg(F.max(F.coalesce("span", F.lit(0)) + F.coalesce("lead", F.lit(0))).alias("_cross"))


def merge_blocks(folded: DataFrame, keys: Sequence[str], width: int = BLOCKS_IN_ONE) -> DataFrame:
    """Summaries of `width` neighbouring blocks as summaries of one, so that the blocks of a hot key are chained by many tasks."""
    by = [*keys, "_wide"]
    f = _chained(folded.withColumn("_wide", F.floor(F.col("block") / width).cast("bigint")), by)
    whole = F.max("chain").over(Window.partitionBy(*by))
    f = f.withColumn("_last", whole)
    zero = F.lit(0).cast("bigint")
    head = F.sum(F.when(F.col("chain") == 0, F.col("n")).when((F.col("chain") == 1) & ~F.col("full"), F.col("lead")))
    tail = F.sum(F.when(F.col("chain") == F.col("_last"), F.when(F.col("full"), F.col("n")).otherwise(F.col("run"))))
    merged = f.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("breaches").alias("breaches"),
        F.sum(F.col("starts") - F.col("joined")).alias("starts"),
        F.coalesce(head, zero).alias("lead"),
        F.coalesce(tail, zero).alias("run"),
        F.max("best").alias("_best"),
        F.max("worst").alias("worst"),
    )
    done = merged.join(_crossing(f, by), by)
    return done.select(*keys, F.col("_wide").alias("block"), "n", "breaches", "starts", "lead", "run", F.greatest("_best", "_cross").cast("bigint").alias("best"), "worst")


def join_blocks(folded: DataFrame, keys: Sequence[str], width: int = BLOCKS_IN_ONE) -> DataFrame:
    """Per key the breach statistics of the whole series from its block summaries.

    A run that ends a block and one that starts the next are one episode. Blocks
    breaching throughout are chained by counting the others before them, first
    inside groups of `width` blocks, then over the groups.
    """
    keys = list(keys)
    f = _chained(merge_blocks(folded, keys, width), keys)
    total = f.groupBy(*keys).agg(
        F.sum("n").alias("samples"),
        F.sum("breaches").alias("breaches"),
        F.sum(F.col("starts") - F.col("joined")).alias("episodes"),
        F.max("best").alias("_best"),
        F.round(F.max("worst"), 3).alias("worst_overshoot"),
    )
    return total.join(_crossing(f, keys), keys).select(
        *keys,
        "samples",
        "breaches",
        breach_rate("breaches", "samples").alias("breach_rate"),
        "episodes",
        F.greatest("_best", "_cross").cast("bigint").alias("longest_episode"),
        "worst_overshoot",
    )


def breach_stats(df: DataFrame, value: str, level, layout: Layout, keys: Sequence[str] = (SERIES,), order: Sequence[str] = ("ts",), rows: int = FOLD_ROWS) -> DataFrame:
    """How an allocation level under-serves demand: rate, episodes, longest episode, overshoot."""
    blocks = value_blocks(df, value, keys, order, layout, rows)
    return join_blocks(cut_lineage(fold_blocks(blocks, keys, [float(level)])), keys)


def sweep_levels(params: Params = DEFAULTS) -> list[float]:
    count = math.ceil((params.sweep_stop + params.sweep_step - params.sweep_start) / params.sweep_step)
    return [params.sweep_start + i * params.sweep_step for i in range(count)]


def sweep(df: DataFrame, value: str, target: str, layout: Layout, params: Params = DEFAULTS, keys: Sequence[str] = (SERIES,), order: Sequence[str] = ("ts",), rows: int = FOLD_ROWS) -> DataFrame:
    """Cost and breaches at every level of the grid, per key.

    Levels are multiplied with blocks of values, not with rows: each task folds
    the arrays it already holds once per level.
    """
    blocks = value_blocks(df, value, keys, order, layout, rows)
    folded = cut_lineage(fold_blocks(blocks, keys, sweep_levels(params)))  # read for every part of the joining
    stats = join_blocks(folded, [*keys, "allocation_percent"])
    return stats.select(
        *keys,
        "allocation_percent",
        monthly_cost(F.lit(target), "allocation_percent", params).alias("monthly_cost"),
        "breach_rate",
        "episodes",
        "longest_episode",
        (F.col("breach_rate") <= params.max_breach_rate).alias("sla_met"),
    )


def sla_minimum(curve: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Lowest compliant level of each curve; keys without one have no row."""
    return newest(curve.where("sla_met"), list(keys), [F.asc("allocation_percent")])


# -- pricing -----------------------------------------------------------------


def priced(df: DataFrame, target: str = "target", percent: str = "percent", params: Params = DEFAULTS) -> DataFrame:
    """Add units and monthly cost of one resource per row."""
    return df.withColumns(
        {
            "units": F.round(by_target(target, lambda r: units(percent, r), params), 2),
            "monthly_cost": monthly_cost(target, percent, params),
            "static_cost": monthly_cost(target, F.lit(100.0), params),
        }
    )


def node_cost(allocation: dict[str, Column], params: Params = DEFAULTS) -> dict[str, Column]:
    """Components rounded to cents and a total rounded from the unrounded sum; a missing target counts as 100 %."""
    raw = {r.target: raw_cost(F.coalesce(allocation.get(r.target, F.lit(None).cast("double")), F.lit(100.0)), r, params) for r in params.resources}
    parts = list(raw.values())
    return {**{f"cost_{t}": F.round(c, 2) for t, c in raw.items()}, "cost_total": F.round(sum(parts[1:], parts[0]), 2)}


# -- recommendation ----------------------------------------------------------


def to_long(df: DataFrame, targets: Sequence[str], keep: Sequence[str] = (SERIES, "ts")) -> DataFrame:
    """One row per target: (keep..., target, value)."""
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("value")) for t in targets])
    return df.select(*keep, F.inline(pairs))


def recent_values(long: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = (SERIES, "target")) -> DataFrame:
    """The last `safety_window` values per key, oldest first: a bounded array."""
    tail = newest(long, list(keys), [F.desc("ts")], params.safety_window)
    rows = tail.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("_s"))
    return rows.select(*keys, F.col("_s.value").alias("recent"), F.get("_s", F.size("_s") - 1)["ts"].alias("last_ts"), F.get("_s", F.size("_s") - 1)["value"].alias("current"))


def recommend(forecasts: DataFrame, recent: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = (SERIES, "target")) -> DataFrame:
    """Forecast p95 plus headroom, raised to the safety floor, priced."""
    keys = list(keys)
    joined = forecasts.join(recent.select(*keys, "recent"), keys)
    candidate = F.least(F.lit(100.0), F.col("forecast_p95") * F.lit(1 + params.headroom))
    out = joined.withColumn("_want", candidate).withColumn("recommended_percent", safety_floor("_want", "recent", params))
    level = F.col("recommended_percent")
    vals = present(F.col("recent"))
    known = F.filter("recent", lambda v: v.isNotNull())
    priced_rows = priced(out, "target", "recommended_percent", params)
    return priced_rows.select(
        *keys,
        F.round("forecast_peak", 2).alias("forecast_peak"),
        F.round("forecast_p95", 2).alias("forecast_p95"),
        F.round("_want", 2).alias("forecast_alloc"),
        "recommended_percent",
        (level > F.col("_want") + 1e-9).alias("floored"),
        "units",
        "monthly_cost",
        "static_cost",
        breach_rate(array_breaches(vals, level), F.size(vals)).alias("breach_rate"),
        array_episodes(known, level).cast("bigint").alias("breach_episodes"),
    )


def node_recommendation(recs: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Per series: full-node cost, cost of the recommended allocation, savings."""
    alloc = {r.target: F.max(F.when(F.col("target") == r.target, F.col("recommended_percent"))) for r in params.resources}
    wide = recs.groupBy(SERIES).agg(*[c.alias(f"_a_{t}") for t, c in alloc.items()])
    cost = node_cost({t: F.col(f"_a_{t}") for t in alloc}, params)["cost_total"]
    static = node_cost({}, params)["cost_total"]
    saved = F.round(F.col("static_total") - F.col("predictive_total"), 2)
    return (
        wide.select(SERIES, static.alias("static_total"), cost.alias("predictive_total"))
        .withColumn("monthly_savings", saved)
        .withColumn("savings_percent", F.coalesce(F.round(F.lit(100.0) * saved / F.nullif(F.col("static_total"), F.lit(0.0)), 2), F.lit(0.0)))
    )


def capacity_detail(recs: DataFrame, recent: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Current use, forecast peak and allocation, each in percent and in units."""
    joined = recs.drop("units").join(recent.select(SERIES, "target", "current"), [SERIES, "target"])
    as_units = lambda c: F.round(by_target("target", lambda r: units(c, r), params), 2)
    return joined.select(
        SERIES,
        "target",
        by_target("target", lambda r: F.lit(float(r.capacity)), params).alias("capacity"),
        F.round("current", 1).alias("current_pct"),
        as_units("current").alias("current_units"),
        F.round("forecast_peak", 1).alias("forecast_pct"),
        as_units("forecast_peak").alias("forecast_units"),
        F.col("recommended_percent").alias("allocation_pct"),
        as_units("recommended_percent").alias("allocation_units"),
    )


def capacity_additions(recs: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Extra units so the recommended allocation sits under the alert threshold, where the forecast crosses it."""
    capacity = by_target("target", lambda r: F.lit(float(r.capacity)), params)
    extra = F.col("units") / F.lit(params.capacity_alert / 100.0) - capacity
    return (
        recs.withColumn("extra_units", F.round(extra, 4))
        .withColumn("extra_pct", F.round(F.lit(100.0) * extra / capacity, 4))
        .where((extra > 0) & (F.col("forecast_peak") > params.capacity_alert))
        .select(SERIES, "target", "extra_units", "extra_pct")
    )


def trailing_p95(values: Column) -> Column:
    return sorted_percentile(present(values), 0.95)

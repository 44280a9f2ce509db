"""Walk-forward replay of allocation decisions.

Rows of a series are cut into chunks of one horizon, aligned so that a decision
is taken at the start of every chunk from `warmup` on. What a policy may see is
the array of values of the preceding chunks, what it is charged for is the chunk
itself. One grouping and one short window over chunks replace the walk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import array_breaches, breach_rate, monthly_cost, present, safety_floor, sorted_percentile
from tidewatch.operators.cadence import SERIES
from tidewatch.operators.ordering import Layout, add_position, in_blocks, settle
from tidewatch.params import DEFAULTS, Params

# A policy maps the columns of a decision row to an allocation percentage.
# `recent` is history, `forecast` the predicted values, `future` the window to come.
Policy = Callable[[Params], Column]


def with_headroom(p95: Column, params: Params) -> Column:
    return F.least(F.lit(100.0), p95 * F.lit(1 + params.headroom))


def _static(params: Params) -> Column:
    return F.lit(100.0)


def _reactive(params: Params) -> Column:
    return F.coalesce(with_headroom(sorted_percentile(present(F.col("recent")), 0.95), params), F.lit(100.0))


def _predictive_lean(params: Params) -> Column:
    return F.coalesce(with_headroom(sorted_percentile(present(F.col("forecast")), 0.95), params), _reactive(params))


def _predictive(params: Params) -> Column:
    return F.when(F.size(present(F.col("forecast"))) > 0, safety_floor(_predictive_lean(params), "recent", params)).otherwise(_reactive(params))


def _oracle(params: Params) -> Column:
    return F.coalesce(F.least(F.lit(100.0), F.array_max("future")), F.lit(100.0))


POLICIES: dict[str, Policy] = {
    "static_100": _static,
    "reactive_p95": _reactive,
    "predictive": _predictive,
    "predictive_nofloor": _predictive_lean,
    "oracle": _oracle,
}
NOT_DEPLOYABLE = ("static_100", "oracle")


def register_policy(name: str, policy: Policy) -> None:
    POLICIES[name] = policy


def decisions(df: DataFrame, value: str, layout: Layout, params: Params = DEFAULTS, keys: Sequence[str] = (SERIES,), order: Sequence[str] = ("ts",)) -> DataFrame:
    """One row per decision: step, ts, recent, future, and the persistence forecast."""
    keys = list(keys)
    h, w = params.horizon, params.warmup
    placed = settle(add_position(df.select(*keys, *order, F.col(value).cast("double").alias("_v")), keys, list(order), layout, "rn", "n"), layout)
    sized = placed.where(F.col("n") >= w + 2 * h)
    back = math.ceil(params.safety_window / h)
    # shift chunk numbers to start at 0 whatever the warmup
    lead = math.ceil(w / h)
    chunks = (
        sized.withColumn("chunk", (F.floor((F.col("rn") - w) / h) + lead).cast("bigint"))
        .groupBy(*keys, "chunk")
        .agg(
            F.array_sort(F.collect_list(F.struct("rn", "_v"))).alias("_s"),
            F.min(order[0]).alias("ts"),
            F.max("n").alias("n"),
        )
        .withColumn("future", F.col("_s._v"))
        .drop("_s")
    )

    def look_back(frame, by):
        w_prev = Window.partitionBy(*by).orderBy("chunk").rowsBetween(-back, -1)
        seen = F.flatten(F.collect_list("future").over(w_prev))
        recent = F.slice(seen, F.greatest(F.size(seen) - params.safety_window + 1, F.lit(1)), F.lit(params.safety_window))
        return frame.withColumn("recent", recent)

    history = in_blocks(chunks, keys, "chunk", layout, look_back, before=back)
    start = F.lit(w) + (F.col("chunk") - lead) * h
    taken = history.where((F.col("chunk") >= lead) & (start < F.col("n") - h))
    return taken.select(
        *keys,
        (F.col("chunk") - lead).alias("step"),
        "ts",
        start.alias("start"),
        "recent",
        "future",
        F.array_repeat(F.get("recent", F.size("recent") - 1), h).alias("forecast"),
    )


def replay(decided: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = (SERIES,), policies: dict[str, Policy] | None = None) -> DataFrame:
    """Trace, long: allocation, breaches and samples of every policy at every decision."""
    chosen = policies or POLICIES
    levels = decided.withColumns({f"_x_{n}": p(params) for n, p in chosen.items()})
    future = F.filter("future", lambda v: v.isNotNull())
    levels = levels.withColumn("_future", future).withColumn("actual_peak", F.round(F.array_max("_future"), 3))
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("policy"),
                F.round(f"_x_{n}", 3).alias("alloc"),
                array_breaches(F.col("_future"), F.col(f"_x_{n}")).cast("bigint").alias("breaches"),
                F.size("_future").cast("bigint").alias("samples"),
            )
            for n in chosen
        ]
    )
    return levels.select(*keys, "step", "ts", "actual_peak", F.inline(rows))


def summarise(trace: DataFrame, target: Column, keys: Sequence[str] = (SERIES,), params: Params = DEFAULTS) -> DataFrame:
    """Cost and reliability of each policy over the replay, with savings against static provisioning."""
    keys = list(keys)
    per = trace.groupBy(*keys, "policy").agg(
        F.avg("alloc").alias("_mean"),
        F.round(F.avg("alloc"), 2).alias("mean_alloc_pct"),
        F.round(F.min("alloc"), 2).alias("min_alloc_pct"),
        F.sum("breaches").alias("breaches"),
        F.sum("samples").alias("samples"),
        F.count(F.lit(1)).alias("decisions"),
    )
    per = per.withColumn("monthly_cost", monthly_cost(target, "_mean", params)).withColumn("breach_rate", breach_rate("breaches", "samples")).drop("_mean")
    return with_savings(per, keys, params, "breach_rate")


def with_savings(per: DataFrame, keys: Sequence[str], params: Params, rate: str) -> DataFrame:
    """Savings against the static row of the same key; a handful of policy rows per key."""
    static = F.max(F.when(F.col("policy") == "static_100", F.col("monthly_cost"))).over(Window.partitionBy(*keys))
    saved = F.round(static - F.col("monthly_cost"), 2)
    share = F.coalesce(F.round(F.lit(100.0) * saved / F.nullif(static, F.lit(0.0)), 2), F.lit(0.0))
    return per.withColumns({"savings_vs_static": saved, "savings_pct": share, "sla_met": F.col(rate) <= params.max_breach_rate})


def combined(summaries: DataFrame, keys: Sequence[str] = (SERIES,), params: Params = DEFAULTS) -> DataFrame:
    """Whole node per policy: summed cost, and the worst resource's breach rate, never a pooled one."""
    keys = list(keys)
    worst = F.max(F.struct(F.col("breach_rate"), F.col("target")))
    per = summaries.groupBy(*keys, "policy").agg(
        F.round(F.sum("monthly_cost"), 2).alias("monthly_cost"), F.sum("breaches").alias("breaches"), worst.alias("_w")
    )
    per = per.withColumns(
        {
            "worst_breach_rate": F.col("_w.breach_rate"),
            "worst_resource": F.when(F.col("_w.breach_rate") > 0, F.col("_w.target")),
        }
    ).drop("_w")
    return with_savings(per, keys, params, "worst_breach_rate")


def cheapest_compliant(results: DataFrame, scenario: str = "scenario", cost: str = "dollars_per_month") -> DataFrame:
    """Per scenario the cheapest deployable policy that met the SLA; scenarios without one keep a null."""
    ok = F.col("sla_met") & ~F.col("policy").isin(list(NOT_DEPLOYABLE))
    pick = F.min(F.when(ok, F.struct(F.col(cost).alias("cost"), F.col("policy").alias("policy"))))
    return results.groupBy(scenario).agg(pick.alias("_w")).select(scenario, F.col("_w.policy").alias("winner"), F.col("_w.cost").alias("winner_cost"))


def ranking_flips(winners: DataFrame, expected: str = "reactive_p95") -> DataFrame:
    """One row: scenarios, scenarios without a winner, distinct winners, whether any winner differs from `expected`."""
    return winners.agg(
        F.count(F.lit(1)).alias("scenarios"),
        F.count_if(F.col("winner").isNull()).alias("unmet"),
        F.count_distinct("winner").alias("distinct_winners"),
        F.coalesce(F.bool_or(F.col("winner") != expected), F.lit(False)).alias("flips"),
    )


def latest_results(results: DataFrame, stamp: str = "run_at", keys: Sequence[str] = (), cost: str | None = None) -> DataFrame:
    """Rows of the newest run (per key, or of the whole table), the cheapest first if a cost is named."""
    last = results.groupBy(*keys).agg(F.max(stamp).alias(stamp)) if keys else results.agg(F.max(stamp).alias(stamp))
    rows = results.join(last, [*keys, stamp], "left_semi")
    return rows.orderBy(*keys, cost) if cost else rows

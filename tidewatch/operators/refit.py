"""Refits along a replay without a fit at a time: running sums of products, one solve for all.

A block of decisions shares the model fitted on everything known before its
first decision. A row enters the sums of the first block that may see its label;
running sums over the blocks of a series are the normal equations of every
refit. Blocks are summed in two levels, so a long series is no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.cadence import SERIES
from tidewatch.operators.features import LABEL
from tidewatch.operators.models import rollout, solve_ridge
from tidewatch.operators.ordering import Layout, add_position, settle
from tidewatch.params import DEFAULTS, Params

#: Blocks of decisions whose running sums are taken together before they are put behind one another.
BLOCKS_TOGETHER = 1_000


def with_place(done: DataFrame, rows: DataFrame, layout: Layout, name: str = "at") -> DataFrame:
    """Training rows with their place among all cleaned rows of the series, on which decisions are counted."""
    placed = add_position(done.select(SERIES, "ts"), [SERIES], ["ts"], layout, name)
    return rows.join(settle(placed, layout), [SERIES, "ts"])


def first_block(place: Column, params: Params = DEFAULTS) -> Column:
    """The first block of decisions that begins behind the label of the row at `place`."""
    span = params.retrain_every * params.horizon
    return F.greatest(F.lit(0), F.floor((place + params.target_shift - params.warmup) / span) + 1).cast("bigint")


def product_sums(features: Sequence[str], label: str = LABEL) -> dict[str, Column]:
    """The sums behind the normal equations, one column each."""
    x, y = [F.col(f"`{f}`").cast("double") for f in features], F.col(label).cast("double")
    sums = {"_n": F.count(F.lit(1)), "_sy": F.sum(y)}
    for i, a in enumerate(x):
        sums |= {f"_sx_{i}": F.sum(a), f"_sxy_{i}": F.sum(a * y)}
        sums |= {f"_sxx_{i}_{j}": F.sum(a * x[j]) for j in range(i, len(x))}
    return sums


def refit_weights(placed: DataFrame, decided: DataFrame, features: Sequence[str], layout: Layout, params: Params = DEFAULTS, label: str = LABEL, together: int = BLOCKS_TOGETHER) -> DataFrame:
    """(series, block, trained_rows, weights, intercept): a ridge for each block of decisions that sees enough rows.

    `placed` are complete rows `with_place`. Blocks of a series without any row
    before them, or with fewer than `min_train_rows`, have no model.
    """
    p, sums = len(features), product_sums(features, label)
    asked = decided.select(SERIES, F.floor(F.col("step") / params.retrain_every).cast("bigint").alias("block")).distinct()
    new = placed.groupBy(SERIES, first_block(F.col("at"), params).alias("block")).agg(*[c.alias(k) for k, c in sums.items()])
    empty = asked.select("*", *[F.lit(0).cast(new.schema[k].dataType).alias(k) for k in sums], F.lit(True).alias("_asked"))
    steps = new.withColumn("_asked", F.lit(False)).unionByName(empty).groupBy(SERIES, "block").agg(*[F.sum(k).alias(k) for k in sums], F.max("_asked").alias("_asked"))
    steps = settle(steps.withColumn("_far", F.floor(F.col("block") / together)), layout)
    earlier = Window.partitionBy(SERIES).orderBy("_far").rowsBetween(Window.unboundedPreceding, -1)
    before = steps.groupBy(SERIES, "_far").agg(*[F.sum(k).alias(k) for k in sums]).select(SERIES, "_far", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_before{k}") for k in sums])
    near = Window.partitionBy(SERIES, "_far").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = steps.select(SERIES, "_far", "block", "_asked", *[F.sum(k).over(near).alias(k) for k in sums])
    known = inside.where("_asked").join(before, [SERIES, "_far"]).select(SERIES, "block", *[(F.col(k) + F.col(f"_before{k}")).alias(k) for k in sums])
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    equations = known.where(F.col("_n") >= params.min_train_rows).select(
        SERIES,
        "block",
        F.col("_n").alias("trained_rows"),
        "_n",
        F.array(*[f"_sx_{i}" for i in range(p)]).alias("_sx"),
        F.array(*[f"_sxx_{i}_{j}" for i, j in upper]).alias("_sxx"),
        F.array(*[f"_sxy_{i}" for i in range(p)]).alias("_sxy"),
        "_sy",
    )
    return solve_ridge(equations, p, params.ridge_alpha)


def refit_ridge(done: DataFrame, rows: DataFrame, decided: DataFrame, target: str, features: Sequence[str], layout: Layout, params: Params = DEFAULTS) -> DataFrame:
    """Decisions with `forecast` rolled forward by the ridge of their block; without one persistence stays.

    `done` are the cleaned rows `decided` was cut from, `rows` their complete
    feature rows with labels.
    """
    weights = refit_weights(with_place(done, rows, layout), decided, features, layout, params)
    block = F.floor(F.col("step") / params.retrain_every).cast("bigint")
    state = decided.withColumn("block", block).join(weights, [SERIES, "block"]).select(SERIES, "step", "ts", F.filter("recent", lambda v: v.isNotNull()).alias("history"), "weights", "intercept")
    terms = " + ".join(["intercept", *[f"weights[{i}] * `{f}`" for i, f in enumerate(features)]])
    rolled = rollout(lambda frame: frame.withColumn("predicted", F.expr(terms)), state.where(F.size("history") > 0), target, features, params)
    return decided.join(rolled.select(SERIES, "step", F.col("forecast").alias("_new")), [SERIES, "step"], "left").withColumn("forecast", F.coalesce("_new", "forecast")).select(*decided.columns)


def first_steps(decided: DataFrame) -> DataFrame:
    """What each decision expected of the next instant and what came: rows for the prediction log and its errors."""
    predicted, actual = F.get("forecast", F.lit(0)), F.get("future", F.lit(0))
    return decided.select(SERIES, "step", F.col("ts").alias("predicted_for_ts"), predicted.alias("predicted"), actual.alias("actual"), F.abs(actual - predicted).alias("error"))

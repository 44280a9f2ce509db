"""Exact percentiles, linear between order statistics, of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ordering import GROUP_ROWS, SIZES, Layout, quantile_edges, running_offsets, slice_count, slice_of


def _name(p: float) -> str:
    return f"p{p:g}".replace(".", "_")


def known(value: str) -> Column:
    """What a percentile is taken of: NaN counts as missing, as null does, whatever the size of the group."""
    number = F.col(value).cast("double")
    return F.when(~F.isnan(number), number)


def direct_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Built-in aggregate; its buffer holds the distinct values of a group."""
    aggs = [F.percentile(known(value), F.lit(float(p))).alias(_name(p)) for p in probs]
    return df.groupBy(*keys).agg(*aggs)


def sliced_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], parts: int) -> DataFrame:
    """Same result for groups too large for one buffer.

    Equal values are counted together first. Slices of the value axis hold about
    the same number of rows of the whole table, so no (group, slice) cell can
    hold more than that; only the slices containing a wanted rank are sorted.
    """
    keys = list(keys)
    data = df.select(*keys, known(value).alias("_v")).where(F.col("_v").isNotNull())
    edges = quantile_edges(data, F.col("_v"), parts)
    counted = slice_of(data.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), F.col("_v"), edges, "_slice")
    cells = counted.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_n"))
    cells = running_offsets(cells, keys, "_slice", "_n", "_before")
    cells = cells.withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    ranks = F.array(
        *[
            F.struct(F.lit(_name(p)).alias("p"), side(F.lit(float(p)) * (F.col("_all") - 1)).cast("bigint").alias("rank"), F.lit(i).alias("side"))
            for p in probs
            for i, side in enumerate((F.floor, F.ceil))
        ]
    )
    wanted = (
        cells.withColumn("_w", F.explode(ranks))
        .where((F.col("_w.rank") >= F.col("_before")) & (F.col("_w.rank") < F.col("_before") + F.col("_n")))
        .select(*keys, "_slice", "_all", F.col("_w.p").alias("_p"), F.col("_w.side").alias("_side"),
                (F.col("_w.rank") - F.col("_before")).alias("_rank"))
    )
    hit = counted.join(wanted.select(*keys, "_slice").distinct(), [*keys, "_slice"], "left_semi")
    upto = Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumn("_upto", F.sum("_c").over(upto))
    found = hit.join(wanted, [*keys, "_slice"]).where(
        (F.col("_rank") >= F.col("_upto") - F.col("_c")) & (F.col("_rank") < F.col("_upto"))
    )
    picked = []
    for p in probs:
        mine = F.col("_p") == _name(p)
        lo = F.max(F.when(mine & (F.col("_side") == 0), F.col("_v")))
        hi = F.max(F.when(mine & (F.col("_side") == 1), F.col("_v")))
        spot = F.lit(float(p)) * (F.max("_all") - 1)
        # the same operations in the same order as the built-in aggregate's
        between = (F.ceil(spot) - spot) * lo + (spot - F.floor(spot)) * hi
        picked.append(F.when((F.ceil(spot) == F.floor(spot)) | (lo == hi), lo).otherwise(between).alias(_name(p)))
    exact = found.groupBy(*keys).agg(*picked)
    # groups whose values are all null keep their row, as with the aggregate
    return df.select(*keys).distinct().join(exact, keys, "left") if keys else exact


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    group_rows: int | None = None,
    layout: Layout | None = None,
) -> DataFrame:
    """One row per group with columns p0_5, p0_95, ...

    The largest group is measured first (unless `layout` has already found the
    whole table small): if it fits an aggregation buffer the built-in aggregate
    is used, otherwise the sliced form.
    """
    keys, group_rows = list(keys), group_rows or SIZES.get().group_rows
    if layout is not None and layout.single:
        return direct_percentiles(df, keys, value, probs)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.agg(F.max("n").alias("n"), F.sum("n").alias("rows")).first()
    if (top.n or 0) <= group_rows:
        return direct_percentiles(df, keys, value, probs)
    return sliced_percentiles(df, keys, value, probs, slice_count(top.rows, group_rows, GROUP_ROWS) + 1)

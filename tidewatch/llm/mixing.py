"""A training order that mixes sources to target weights which change over time.

Each source has a share of the whole run and a schedule: how its weight moves
while training time goes from 0 to 1. The schedule is integrated to the
cumulative demand for the source's words; documents of a source stand one
behind another on that axis, and inverting the demand at their places gives
their positions in time. Documents are then range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.text import ASCII_SPACE, row_id, split_words
from tidewatch.operators.ordering import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: For each weight, (time, height) knots of its piecewise-linear schedule: heavy sources come early, light ones late.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
ROWS_PER_BUCKET = 10_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, rank, source_size, target) from (source, source_size).

    Sources by code point, null last, take the weights in turn and share 100 %
    of all sizes; no target exceeds `max_repeats` times its source's size, the
    excess goes to the others by weight. One row for each source stands here, so
    the ordered windows run over as many rows as there are sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit, later = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("ratio", "rank").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    placed = (
        sizes.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("limit", (F.col("source_size") * max_repeats).cast("double"))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
    )
    # In the order of limit / weight the sources that reach their limit come first: `level` is the words per unit of weight left for those from here on.
    leveled = placed.withColumn("level", (F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("limit").over(by_limit), F.lit(0.0))) / F.sum("weight").over(later))
    free = F.when(F.col("ratio") > F.col("level"), F.col("level"))
    return leveled.withColumn("final", F.max(free).over(whole)).select(
        "source", "rank", "source_size", F.when(F.col("final").isNull() | (F.col("ratio") <= F.col("level")), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("weight") * F.col("final"))).alias("target")
    )


def demand_time(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which a schedule has asked for `share` (0 .. 1) of its words: the inverse of its integral."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total, before, time = sum(areas), 0.0, F.lit(float(knots[-1][0]))
    pieces = []
    for (t0, h0), (t1, h1), area in zip(knots, knots[1:], areas, strict=False):
        rest, slope = share * total - before, (h1 - h0) / (t1 - t0)
        # h0 x + slope x^2 / 2 = rest, in the form that also holds for a level piece
        pieces.append((before + area, F.lit(t0) + 2 * rest / (h0 + F.sqrt(F.greatest(F.lit(h0 * h0) + 2 * slope * rest, F.lit(0.0))))))
        before += area
    for end, inverse in reversed(pieces):
        time = F.when(share * total <= end, inverse).otherwise(time)
    return time


def sized(docs: DataFrame, seed: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(_id, _row, source, size, draw): words of the text and a fixed random order."""
    size = F.size(split_words(F.col(text_col), ASCII_SPACE)).cast("long")
    return docs.select(
        F.col(id_col).alias("_id"), row_id(id_col, text_col).alias("_row"), F.col(source_col).alias("source"), size.alias("size"), F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("draw")
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules=SCHEDULES, seed: str = "mix", rows_per_bucket: int = ROWS_PER_BUCKET, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(`rows`, `order`).

    `rows`: one for each row of `docs`: _id, _row, source, size, source_size,
    target. `order`: the training order, sorted by `position`: (_id, _row, size,
    source, epoch, position), one row for each time a document is taken, at most
    `max_repeats` times. A document of a source is taken in every epoch that the
    target fills, and in the last one if its first word, in the fixed random
    order of the source, comes before the target. So a source exceeds its target
    by less than one document.

    A null text has no words; documents without words are not in the order. A
    null source is a source of its own. Equal rows stand apart in the order but
    may swap places. Reruns agree: places depend on ids and texts only. An empty
    table gives empty results. Cumulative sums run in buckets of about
    `rows_per_bucket` rows of one source, which are put together by the sums of
    the buckets, so no source is summed in one task.
    """
    if not max_repeats >= 1 or not weights or min(weights) <= 0 or len(schedules) != len(weights):
        raise ValueError("weights must be positive, each with a schedule, and max_repeats at least 1")
    base = cut_lineage(sized(docs, seed, id_col, text_col, source_col))
    totals = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut_lineage(source_targets(totals, weights, max_repeats)).select(F.col("source").alias("t_source"), "rank", "source_size", "target")
    rows = base.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    buckets = max(1, -(-base.count() // rows_per_bucket))
    # draw is a hexadecimal hash, so equal widths of its first digits are buckets of about equal size
    placed = rows.filter("size > 0").withColumn("bucket", F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * buckets / F.lit(float(2**32))).cast("long"))
    sums = placed.groupBy("rank", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("rank").alias("o_rank"), F.col("bucket").alias("o_bucket"), F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("rank", "bucket").orderBy("draw", "_id", "_row").rowsBetween(Window.unboundedPreceding, -1)
    begun = (
        placed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, (F.col("rank") == F.col("o_rank")) & (F.col("bucket") == F.col("o_bucket")))
        .withColumn("begin", F.col("within") + F.col("offset"))
    )
    taken = (
        begun.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
        .withColumn("demand", F.col("begin") + F.col("epoch") * F.col("source_size"))
        .filter(F.col("demand") < F.col("target"))
    )
    share, turn = F.col("demand") / F.col("target"), F.col("rank") % len(weights)
    position = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        position = F.when(turn == k, demand_time(share, knots)).otherwise(position)
    order = taken.withColumn("position", position).select("_id", "_row", "size", "source", "epoch", "position").orderBy("position", "_id", "_row", "epoch")
    return rows.select("_id", "_row", "source", "size", "source_size", "target"), order


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, in training order, with their own columns only."""
    rows, order = mix(docs, **options)
    key = docs.withColumn("_row", row_id("doc_id", "text"))
    entries = order.select("_id", F.col("_row").alias("o_row"), "epoch", "position")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("o_row"))
    if not rows.groupBy("_id", "_row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        # Equal rows all stand in the order: number them on both sides, so that each is met by its own entries.
        entries = entries.withColumn("nth", F.row_number().over(Window.partitionBy("_id", "o_row", "epoch").orderBy("position")))
        key = key.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "_row").orderBy("_row")))
        same = same & (F.col("n") == F.col("nth"))
    joined = key.join(entries, same)
    return joined.orderBy("position", "_id", "_row", "epoch").select(*docs.columns)

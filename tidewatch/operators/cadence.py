"""Sampling interval, gaps and segments of each series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import seconds_between
from tidewatch.operators.ordering import Layout, add_position, as_number, attach, in_blocks, join_spread, running_sum, settle, slice_of
from tidewatch.operators.percentiles import exact_percentiles
from tidewatch.params import DEFAULTS, Params

SERIES = "series_key"


def with_previous(df: DataFrame, layout: Layout, cols: dict[str, str], order: str = "ts", tie: str | None = None) -> DataFrame:
    """Add the previous row's value of each column, in series order (`name -> column`)."""
    keys = [order] + ([tie] if tie else [])

    def lagged(frame, by):
        w = Window.partitionBy(*by).orderBy(*keys)
        return frame.withColumns({n: F.lag(c).over(w) for n, c in cols.items()})

    if layout.single:
        return lagged(df, [SERIES])
    # the row before a slice's first one is the last of the slice before
    sliced = slice_of(df, as_number(df, order), layout.edges, "_slice")
    ends = sliced.groupBy(SERIES, "_slice").agg(F.max_by(F.struct(*[F.col(c).alias(n) for n, c in cols.items()]), F.struct(*keys)).alias("_last"))
    ends = ends.select(SERIES, "_slice", F.lag("_last").over(Window.partitionBy(SERIES).orderBy("_slice")).alias("_before"))
    first = F.row_number().over(Window.partitionBy(SERIES, "_slice").orderBy(*keys)) == 1
    out = lagged(sliced.join(ends, [SERIES, "_slice"]).withColumn("_first", first), [SERIES, "_slice"])
    return out.withColumns({n: F.when(F.col("_first"), F.col(f"_before.{n}")).otherwise(F.col(n)) for n in cols}).drop("_slice", "_before", "_first")


def deltas(df: DataFrame, layout: Layout) -> DataFrame:
    """Per row: seconds since the previous sample of its series."""
    stamped = df.where(F.col("ts").isNotNull()).select(SERIES, "ts")
    out = with_previous(stamped, layout, {"prev_ts": "ts"})
    return out.withColumn("delta", seconds_between("ts", "prev_ts"))


def detect_cadence(
    df: DataFrame, layout: Layout, params: Params = DEFAULTS, group_rows: int | None = None, steps: DataFrame | None = None
) -> DataFrame:
    """(series_key, cadence): median positive delta, the nominal interval where there is none.

    Fewer than three samples say nothing about an interval. `steps` are the
    settled deltas of `df`, if the caller has them; the median reads them several times.
    """
    steps = steps if steps is not None else settle(deltas(df, layout).select(SERIES, "delta"), layout)
    sizes = df.groupBy(SERIES).agg(F.count("ts").alias("_n"))
    medians = exact_percentiles(steps.where(F.col("delta") > 0), [SERIES], "delta", [0.5], group_rows, layout)
    measured = F.when(F.col("_n") >= 3, F.col("p0_5"))
    return sizes.join(medians, SERIES, "left").select(
        SERIES, F.coalesce(measured, F.lit(float(params.nominal_cadence))).alias("cadence")
    )


def find_gaps(df: DataFrame, cadence: DataFrame, layout: Layout, params: Params = DEFAULTS, steps: DataFrame | None = None) -> DataFrame:
    """Breaks in collection: deltas beyond gap_multiple times the cadence. `steps` as in `detect_cadence`."""
    # settled deltas of a regular table are files of a few MB for millions of rows: by their size they would be broadcast
    steps = join_spread(deltas(df, layout) if steps is None else steps, cadence.hint("shuffle_hash"), [SERIES], ["ts"])
    return steps.where(F.col("delta") > F.col("cadence") * F.lit(params.gap_multiple)).select(
        SERIES,
        F.col("prev_ts").alias("gap_start"),
        F.col("ts").alias("gap_end"),
        F.round("delta", 1).alias("gap_seconds"),
        (F.floor(F.col("delta") / F.col("cadence")).cast("bigint") - 1).alias("missed_samples"),
    )


def segment(df: DataFrame, cadence: DataFrame, layout: Layout, params: Params = DEFAULTS, ends: bool = False) -> DataFrame:
    """Add `pos` (place in the series), `cadence` and `segment_id` (grows by one at every gap).

    A delta equal to the threshold is not a gap. Timestamps must be unique per
    series, as after `deduplicate`. `ends` keeps what the cut form knows besides:
    `segment_start` and `next_ts`, the next instant of the segment.
    """
    # plain windows gather a series anyhow: joined by the series alone, the rows are exchanged once for both
    known = df.join(cadence, SERIES) if layout.single else join_spread(df, cadence, [SERIES], ["ts"])

    def late(ts, before):
        return seconds_between(ts, before) > F.col("cadence") * F.lit(params.gap_multiple)

    if layout.single:
        placed = add_position(known, [SERIES], ["ts"], layout)
        marked = placed.withColumn("_break", F.when(late("ts", F.lag("ts").over(Window.partitionBy(SERIES).orderBy("ts"))), 1).otherwise(0))
        return running_sum(marked, [SERIES], "ts", F.col("_break"), "segment_id", "pos", layout).drop("_break")
    # rows are exchanged once, slices are then put together by their first and last rows
    by = [SERIES, "_slice"]
    w = Window.partitionBy(*by).orderBy("ts")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = slice_of(known, as_number(known, "ts"), layout.edges, "_slice").withColumns(
        {"_at": F.row_number().over(w).cast("bigint") - 1, "_next": F.lead("ts").over(w), "_break": F.when(late("ts", F.lag("ts").over(w)), 1).otherwise(0)}
    )
    marked = marked.withColumns({"_breaks": F.sum("_break").over(so_far), "_start": F.max(F.when(F.col("_break") == 1, F.col("ts"))).over(so_far)})
    marked = settle(marked.drop("_break"), layout)
    over = Window.partitionBy(SERIES).orderBy("_slice")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    slices = marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_breaks").alias("_b"), F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.max("_start").alias("_s"), F.max("cadence").alias("cadence")
    )
    slices = slices.withColumns({"_before": F.lag("_last").over(over), "_after": F.lead("_first").over(over)})
    slices = slices.withColumn("_opens", F.when(late("_first", "_before"), 1).otherwise(0))
    slices = slices.withColumn("_begin", F.when(F.col("_before").isNull() | (F.col("_opens") == 1), F.col("_first")))
    slices = slices.select(
        *by,
        "_after",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        (F.coalesce(F.sum(F.col("_b") + F.col("_opens")).over(earlier), F.lit(0)) + F.col("_opens")).alias("_carry"),
        F.coalesce("_begin", F.last(F.coalesce("_s", "_begin"), ignorenulls=True).over(earlier)).alias("_arriving"),
    )
    following = F.coalesce("_next", "_after")
    out = marked.join(slices, by).select(
        *known.columns,
        (F.col("_offset") + F.col("_at")).cast("bigint").alias("pos"),
        (F.col("_carry") + F.col("_breaks")).cast("bigint").alias("segment_id"),
        F.coalesce("_start", "_arriving").alias("segment_start"),
        F.when(late(following, "ts"), None).otherwise(following).alias("next_ts"),
    )
    return out if ends else out.drop("segment_start", "next_ts")


def segment_report(segmented: DataFrame) -> DataFrame:
    """Per series: segments, gaps, rows of the largest and smallest segment."""
    sizes = segmented.groupBy(SERIES, "segment_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(SERIES).agg(
        F.count(F.lit(1)).alias("segments"),
        (F.count(F.lit(1)) - 1).alias("gaps_found"),
        F.max("n").alias("largest_segment_rows"),
        F.min("n").alias("smallest_segment_rows"),
    )


def segment_profile(segmented: DataFrame, layout: Layout) -> DataFrame:
    """Per segment: rows, start, span and its own cadence (most frequent delta, the smaller on a tie).

    Equal deltas are counted before anything is ranked, so a long segment costs
    one row per distinct delta.
    """

    def stepped(frame, by):
        w = Window.partitionBy(*by, "segment_id").orderBy("ts")
        return frame.withColumn("_d", seconds_between("ts", F.lag("ts").over(w)))

    rows = in_blocks(segmented, [SERIES], "pos", layout, stepped, before=1)
    shape = segmented.groupBy(SERIES, "segment_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("start"), F.max("ts").alias("_end")
    )
    tally = rows.where(F.col("_d").isNotNull()).groupBy(SERIES, "segment_id", "_d").agg(F.count(F.lit(1)).alias("_c"))
    common = tally.groupBy(SERIES, "segment_id").agg(
        F.max_by("_d", F.struct(F.col("_c"), (-F.col("_d")).alias("small"))).alias("_mode")
    )
    return shape.join(common, [SERIES, "segment_id"], "left").select(
        SERIES,
        "segment_id",
        "rows",
        "start",
        F.round(seconds_between("_end", "start") / 60.0, 1).alias("span_minutes"),
        F.round("_mode", 1).alias("native_cadence_s"),
    )


def counter_rate(df: DataFrame, counter: str, layout: Layout, name: str = "rate_mb_s") -> DataFrame:
    """Growing byte counter to MB per second; a falling counter was reset and gives null."""
    out = with_previous(df, layout, {"_pc": counter, "_pt": "ts"}, tie="id" if "id" in df.columns else None)
    grown = F.col(counter) - F.col("_pc")
    elapsed = seconds_between("ts", "_pt")
    rate = F.when((grown >= 0) & (elapsed > 0), F.round(grown / F.lit(1024.0 * 1024.0) / elapsed, 2))
    return out.withColumn(name, rate).drop("_pc", "_pt")


def segment_starts(segmented: DataFrame, layout: Layout) -> DataFrame:
    """Add `segment_start` to every row."""
    return attach(segmented, [SERIES, "segment_id"], {"segment_start": (F.min, "ts")}, layout)

"""Ordered computation over series of any length.

A window `PARTITION BY series ORDER BY ts` puts a whole series into one task.
That is right for short series and fatal for one that holds a third of the
table. Everything ordered in this package therefore goes through a `Layout`:

* few rows in all, or in the longest series (checked, not assumed): plain windows per series;
* otherwise the time axis is cut into slices holding about equally many rows.
  A first pass counts rows per (series, slice), a running sum of those few
  counts gives each slice its offset, and `row_number` inside a slice plus the
  offset is the exact position in the series. Windows with a bounded frame then
  run on blocks of consecutive positions, each with a small halo of neighbours
  copied in, and unbounded scans are composed from per-block summaries.

Both ways return the same rows; the tests run them against each other.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_SLICE = 4_000_000
BLOCK_ROWS = 50_000
GROUP_ROWS = 2_000_000
SALTS = 64
MOST_SLICES = 256
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass(frozen=True)
class Sizes:
    """How much ordered work one task takes on: rows of a slice, of a block, and of a group in one aggregation buffer.

    A table whose longest series has at most `series_rows` rows, those of a block if not given, is not cut.
    """

    slice_rows: int = ROWS_PER_SLICE
    block_rows: int = BLOCK_ROWS
    group_rows: int = GROUP_ROWS
    series_rows: int | None = None


#: In force where a call names no sizes of its own; tests and twin queries set small ones to run the cut form on small tables.
SIZES: ContextVar[Sizes] = ContextVar("sizes", default=Sizes())


def as_number(df: DataFrame, name: str) -> Column:
    """Timestamps as microseconds, everything else unchanged."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name))
    return F.col(name)


def slice_count(rows: int, per_slice: int, usual: int) -> int:
    """How many slices `rows` are cut into.

    Every cut point is held by a sketch and by all tasks, so slices wanted smaller
    than usual grow with the table once there are MOST_SLICES of them, up to the
    usual size. No row is left out by that: a slice holds more of them.
    """
    return min(math.ceil(rows / per_slice), max(MOST_SLICES, math.ceil(rows / usual)))


def quantile_edges(df: DataFrame, value: Column, parts: int) -> list[float]:
    """Interior cut points of about `parts` equally filled slices (one mergeable sketch)."""
    if parts <= 1:
        return []
    probs = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(value.cast("double"), probs, max(10_000, 10 * parts)).alias("e")).first()
    return sorted(set(row.e or []))


def slice_of(df: DataFrame, value: Column, edges: Sequence[float], name: str) -> DataFrame:
    """Add the slice number of `value`; monotone in the value."""
    if not edges:
        return df.withColumn(name, F.lit(0))
    splits = [-math.inf, *edges, math.inf]
    cut = Bucketizer(splits=splits, inputCol="_cut_in", outputCol="_cut_out")
    return (
        cut.transform(df.withColumn("_cut_in", value.cast("double")))
        .withColumn(name, F.col("_cut_out").cast("int"))
        .drop("_cut_in", "_cut_out")
    )


@dataclass(frozen=True)
class Layout:
    """How the order axis of a table is cut. No edges means plain windows."""

    edges: tuple[float, ...] = ()
    block_rows: int = BLOCK_ROWS

    @property
    def single(self) -> bool:
        return not self.edges

    @staticmethod
    def plan(
        df: DataFrame,
        order: str = "ts",
        rows_per_slice: int | None = None,
        block_rows: int | None = None,
        key: str = "series_key",
    ) -> "Layout":
        """Look at the table's size and, if it is large, at its longest series and its order column.

        The count is a metadata read for columnar files. A large table of series
        that are all shorter than a block needs no cut: they spread by themselves.
        Only the cut points reach the driver, one number for each slice of
        millions of rows.
        """
        rows, sizes = df.count(), SIZES.get()
        parts = slice_count(rows, rows_per_slice or sizes.slice_rows, ROWS_PER_SLICE) if rows else 1
        if parts > 1 and rows_per_slice is None and key in df.columns:
            longest = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
            enough = sizes.block_rows if sizes.series_rows is None else sizes.series_rows
            if longest <= enough:
                return Layout((), block_rows or sizes.block_rows)
        return Layout(tuple(quantile_edges(df, as_number(df, order), parts)), block_rows or sizes.block_rows)


def within_groups(df: DataFrame, pos: str, layout: Layout) -> Layout:
    """The layout of ordered work inside groups whose rows `pos` counts from 0.

    Groups that all fit a block have nothing to cut and nothing to carry from
    block to block: plain windows of each are the same blocks. `df` is read for
    its longest group and should be settled.
    """
    if layout.single:
        return layout
    last = df.agg(F.max(pos)).first()[0]
    return Layout((), layout.block_rows) if last is None or last < layout.block_rows else layout


def shared_folder(spark: SparkSession) -> str:
    """A new folder every executor can reach, inside the one that spark.checkpoint.dir names.

    Only a session whose tasks all run in the driver's process may do without:
    it gets a temporary folder. Anywhere else a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/tidewatch-{uuid.uuid4().hex}"
    if not is_local(spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def is_local(master: str) -> bool:
    return re.fullmatch(r"local(\[[^\]]*\])?", master) is not None


def join_spread(df: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table with one row for each key so that a key's rows stay on many tasks.

    Both sides get a salt, the small side a copy for each. What is grouped by the
    keys afterwards is combined on the map side and exchanged once more, instead
    of standing in one partition because of this join.
    """
    if not keys:
        return df.crossJoin(small)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Computed once, readable again after the loss of any executor, and columnar,
    so that later readers still prune columns.
    """
    path = f"{shared_folder(df.sparkSession)}/cut"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage_and_release(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table that is read on only as written: the files of its exchanges are deleted at once, not when the driver collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(RELEASE, "false")
    conf.set(RELEASE, "true")
    try:
        return cut_lineage(df)
    finally:
        conf.set(RELEASE, before)


def settle(df: DataFrame, layout: Layout) -> DataFrame:
    """Cut lineage where a plan would otherwise be recomputed by its own summaries."""
    return df if layout.single else cut_lineage(df)


def settle_large(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table of more than a slice of rows before its layout is planned: planning and all that follows read it many times."""
    return cut_lineage(df) if df.count() > SIZES.get().slice_rows else df


def running_offsets(summary: DataFrame, keys: Sequence[str], step: str, value: str, name: str) -> DataFrame:
    """Exclusive running sum of `value` over the few `step`s of each key."""
    before = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return summary.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0).cast("bigint")))


def add_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    layout: Layout,
    name: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """Exact 0-based position of every row in its key, optionally the key's row count."""
    keys = list(keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint") - 1
    if layout.single:
        out = df.withColumn(name, rank)
        return out.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*keys))) if total else out
    sliced = slice_of(df, as_number(df, order[0]), layout.edges, "_slice")
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    counts = running_offsets(counts, keys, "_slice", "_n", "_offset")
    if total:
        counts = counts.withColumn(total, F.sum("_n").over(Window.partitionBy(*keys)))
    inside = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order)).cast("bigint") - 1
    return (
        sliced.join(counts.drop("_n"), [*keys, "_slice"])
        .withColumn(name, F.col("_offset") + inside)
        .drop("_slice", "_offset")
    )


def block_of(pos: str, layout: Layout) -> Column:
    return F.floor(F.col(pos) / F.lit(layout.block_rows)).cast("bigint")


def in_blocks(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    layout: Layout,
    fn: Callable[[DataFrame, list[str]], DataFrame],
    before: int = 0,
    after: int = 0,
) -> DataFrame:
    """Apply `fn(df, partition_columns)`, whose frames reach `before` rows back and `after` ahead.

    `pos` must count the rows of `keys` without holes. Large tables run one
    window partition per block of positions; neighbours inside the halo are
    copied in and dropped again afterwards.
    """
    keys = list(keys)
    if layout.single:
        return fn(df, keys)
    size = layout.block_rows
    if max(before, after) >= size:
        raise ValueError(f"halo of {max(before, after)} rows needs blocks larger than {size}")
    home, within = block_of(pos, layout), F.pmod(F.col(pos), F.lit(size))
    # A copy says itself whether it is one: an equation of two block numbers would be
    # multiplied by the optimizer through all that is derived from them.
    whose = lambda block, own: F.struct(block.alias("block"), F.lit(own).alias("own"))
    copies = F.array_compact(
        F.array(
            whose(home, True),
            F.when(within >= size - before, whose(home + 1, False)),
            F.when(within < after, whose(home - 1, False)),
        )
    )
    spread = df.withColumn("_copy", F.explode(copies)).withColumns({"_block": F.col("_copy.block"), "_own": F.col("_copy.own")}).drop("_copy")
    done = fn(spread, [*keys, "_block"])
    return done.where("_own").drop("_block", "_own")


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, pos: str, layout: Layout) -> DataFrame:
    """Inclusive running sum of a whole-number `value` along each key."""
    keys = list(keys)

    def local(by):
        return F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))

    if layout.single:
        return df.withColumn(name, local(keys).cast("bigint"))
    blocked = df.withColumn("_block", block_of(pos, layout))
    sums = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_s"))
    sums = running_offsets(sums, keys, "_block", "_s", "_carry").drop("_s")
    return (
        blocked.join(sums, [*keys, "_block"])
        .withColumn(name, (F.col("_carry") + local([*keys, "_block"])).cast("bigint"))
        .drop("_block", "_carry")
    )


def attach(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: dict[str, tuple[Callable, str]],
    layout: Layout,
    pos: str = "pos",
) -> DataFrame:
    """Add group totals to every row. `aggregates`: name -> (agg function, column).

    The functions must be their own combiner (min, max, bool_or). Large tables
    aggregate per block first and join on (keys, block), so a hot key is never
    gathered in one place.
    """
    keys = list(keys)
    if layout.single:
        w = Window.partitionBy(*keys)
        return df.withColumns({n: fn(c).over(w) for n, (fn, c) in aggregates.items()})
    blocked = df.withColumn("_block", block_of(pos, layout))
    parts = blocked.groupBy(*keys, "_block").agg(*[fn(c).alias(n) for n, (fn, c) in aggregates.items()])
    w = Window.partitionBy(*keys)
    parts = parts.withColumns({n: fn(n).over(w) for n, (fn, _) in aggregates.items()})
    return blocked.join(parts, [*keys, "_block"]).drop("_block")


def neighbours(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str], layout: Layout) -> DataFrame:
    """For each of `cols`: nearest non-null value and position at or before and at or after a row.

    Adds `_pv_c, _pp_c, _nv_c, _np_c`. Runs of nulls may be of any length: large
    tables carry the last (first) known value of earlier (later) blocks in.
    """
    keys = list(keys)

    def known(c):
        return F.expr(f"CASE WHEN {c} IS NOT NULL THEN struct({c} AS v, {pos} AS p) END")

    def scans(by):
        back = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        ahead = Window.partitionBy(*by).orderBy(pos).rowsBetween(0, Window.unboundedFollowing)
        return {
            **{f"_back_{c}": F.last(known(c), ignorenulls=True).over(back) for c in cols},
            **{f"_ahead_{c}": F.first(known(c), ignorenulls=True).over(ahead) for c in cols},
        }

    def spread(frame, back, ahead):
        fields = {}
        for c in cols:
            b, a = back.format(c=c), ahead.format(c=c)
            fields |= {f"_pv_{c}": f"{b}.v", f"_pp_{c}": f"{b}.p", f"_nv_{c}": f"{a}.v", f"_np_{c}": f"{a}.p"}
        return frame.withColumns({n: F.expr(e) for n, e in fields.items()})

    if layout.single:
        out = spread(df.withColumns(scans(keys)), "_back_{c}", "_ahead_{c}")
        return out.drop(*[f"_back_{c}" for c in cols], *[f"_ahead_{c}" for c in cols])

    blocked = df.withColumn("_block", block_of(pos, layout))
    ends = blocked.groupBy(*keys, "_block").agg(
        *[F.max_by(known(c), F.when(F.col(c).isNotNull(), F.col(pos))).alias(f"_l_{c}") for c in cols],
        *[F.min_by(known(c), F.when(F.col(c).isNotNull(), F.col(pos))).alias(f"_f_{c}") for c in cols],
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select(
        *keys,
        "_block",
        *[F.last(f"_l_{c}", ignorenulls=True).over(earlier).alias(f"_cb_{c}") for c in cols],
        *[F.first(f"_f_{c}", ignorenulls=True).over(later).alias(f"_ca_{c}") for c in cols],
    )
    joined = blocked.join(ends, [*keys, "_block"]).withColumns(scans([*keys, "_block"]))
    out = spread(
        joined,
        "coalesce(_back_{c}, _cb_{c})",
        "coalesce(_ahead_{c}, _ca_{c})",
    )
    scratch = [f"{p}{c}" for c in cols for p in ("_back_", "_ahead_", "_cb_", "_ca_")]
    return out.drop("_block", *scratch)


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first `n` rows of each key in `order`. Spark limits each group before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")

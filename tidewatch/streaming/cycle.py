"""Cleaning batch by batch: after any number of batches the stored rows are those of one run over everything.

What a batch needs of the past is carried in small tables, per series: the open
segment with its number, start and last closed slot; the raw rows of the slots
that can still change; and the grid rows whose flags or filled values can. Each
carried row knows its nearest known values, so that runs of nulls may be of any
length. Results are merged into the day partitions they touch; no other day is
read. Carried tables are partitions of their batch: a repeated batch reads the
state before it and replaces its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import seconds_between
from tidewatch.operators import clean as K
from tidewatch.operators.cadence import SERIES
from tidewatch.operators.contract import METRICS, Contract
from tidewatch.operators.ordering import Layout, cut_lineage
from tidewatch.params import DEFAULTS, Params

KEY = [SERIES, "segment_id", "slot"]
DAY = "day"


def put(df: DataFrame, path: str, by: str) -> None:
    """Replace the partitions of `by` that `df` has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing has been written yet
        return None


def state_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The newest carried table of an earlier batch."""
    held = stored(spark, path)
    last = None if held is None else held.where(F.col("batch_id") < batch_id).agg(F.max("batch_id")).first()[0]
    return None if last is None else held.where(F.col("batch_id") == last).drop("batch_id")


def reach(params: Params) -> int:
    """Closed slots behind the last whose rows may still change or are looked at: two windows of medians, or a fill."""
    return max(2 * params.outlier_window, params.max_interpolate_run)


def placed_on_grid(base: DataFrame, seeds: DataFrame, cadence: DataFrame, values: list[str], params: Params) -> DataFrame:
    """Merged samples with segment, start and slot; a series goes on from its seed (segment_id, segment_start, prev_ts, last_slot)."""
    w = Window.partitionBy(SERIES).orderBy("ts")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = base.join(cadence, SERIES, "left").join(seeds.withColumnsRenamed({"segment_id": "_segment", "segment_start": "_start"}), SERIES, "left")
    rows = rows.withColumn("cadence", F.coalesce("cadence", F.lit(float(params.nominal_cadence))))
    before = F.coalesce(F.lag("ts").over(w), F.col("prev_ts"))
    rows = rows.withColumn("_before", before)
    late = seconds_between("ts", "_before") > F.col("cadence") * F.lit(params.gap_multiple)
    rows = rows.withColumn("_break", F.coalesce(late, F.lit(False)))
    rows = rows.withColumn("segment_id", F.coalesce("_segment", F.lit(0).cast("bigint")) + F.sum(F.col("_break").cast("bigint")).over(so_far))
    begun = F.when(F.col("_break") | F.col("_before").isNull(), F.col("ts"))
    rows = rows.withColumn("segment_start", F.coalesce(F.last(begun, ignorenulls=True).over(so_far), F.col("_start")))
    rows = rows.withColumn("_step", K.grid_step())
    slot = F.floor((F.unix_micros("ts") - F.unix_micros("segment_start")) / F.col("_step")).cast("bigint")
    return rows.withColumn("slot", slot).select(SERIES, "ts", *values, "segment_id", "segment_start", "_step", "slot", F.when(F.col("segment_id") == F.col("_segment"), F.col("last_slot")).alias("_last_slot"))


def grid_rows(placed: DataFrame, values: list[str]) -> DataFrame:
    """Slots with samples and the empty slots before them; holes reach back to the seed's last closed slot."""
    slots = placed.groupBy(*KEY).agg(*[F.avg(c).alias(c) for c in values], F.count(F.lit(1)).alias("observations"), F.min("segment_start").alias("_start"), F.min("_step").alias("_step"), F.max("_last_slot").alias("_last_slot"))
    before = F.coalesce(F.lag("slot").over(Window.partitionBy(SERIES, "segment_id").orderBy("slot")), F.col("_last_slot"), F.col("slot") - 1)
    filled = slots.withColumn("_first", before + 1).withColumn("_slot", F.explode(F.sequence("_first", "slot")))
    real = F.col("_slot") == F.col("slot")
    return filled.select(
        SERIES, "segment_id", F.col("_slot").alias("slot"), F.timestamp_micros(F.unix_micros("_start") + F.col("_slot") * F.col("_step")).alias("ts"),
        *[F.when(real, F.col(c)).alias(c) for c in values], F.when(real, 0).otherwise(1).alias("is_imputed"), F.when(real, F.col("observations")).otherwise(F.lit(0).cast("bigint")).alias("observations"),
    )


def known_around(rows: DataFrame, values: list[str]) -> DataFrame:
    """Nearest known values of each row, those it already carries first: `_pv_`, `_pp_`, `_nv_`, `_np_` of each column."""
    w = Window.partitionBy(SERIES, "segment_id").orderBy("slot")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    spot = lambda v, p: F.when(F.col(v).isNotNull(), F.struct(F.col(v).alias("v"), F.col(p).alias("p")))
    # behind a row stands a known value, or one that an earlier row carries
    seen = {f"_b_{c}": F.coalesce(spot(f"_pv_{c}", f"_pp_{c}"), F.last(F.coalesce(spot(c, "slot"), spot(f"_pv_{c}", f"_pp_{c}")), ignorenulls=True).over(back)) for c in values}
    seen |= {f"_a_{c}": F.coalesce(spot(f"_nv_{c}", f"_np_{c}"), F.first(spot(c, "slot"), ignorenulls=True).over(ahead)) for c in values}
    out = rows.withColumns(seen)
    out = out.withColumns({f"_{k}{f}_{c}": F.col(f"_{s}_{c}.{f}") for c in values for k, s in (("p", "b"), ("n", "a")) for f in ("v", "p")})
    return out.drop(*seen)


def clean_sink(root: str, cadence: DataFrame, contract: Contract = METRICS, params: Params = DEFAULTS, lateness: int = 0, keep_days: int | None = None) -> Callable[[DataFrame, int], None]:
    """A sink that cleans what each batch brings and merges it into `root`/grid, one partition a day.

    `cadence` has one row for each known series; others count with the nominal
    interval. Samples up to `lateness` seconds behind their series' newest are
    merged as if they had come in time; older ones go to `root`/late and change
    nothing. With `keep_days`, days that far behind the newest are dropped.
    Flagged values are kept, as in the default strategy.
    """
    if params.outlier_strategy != "flag_only":
        raise ValueError("only flags can be set before a series is complete")
    values = list(contract.values)
    targets = list(contract.targets)
    flags = [*[f"{c}_is_outlier" for c in targets], "is_outlier"]
    around = [f"_{k}_{c}" for c in values for k in ("pv", "pp", "nv", "np")]
    nothing = {f"_{k}_{c}": F.lit(None).cast("double" if k.endswith("v") else "bigint") for c in values for k in ("pv", "pp", "nv", "np")}

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, number = batch.sparkSession, F.lit(batch_id).cast("bigint")
        carried = {name: state_before(spark, f"{root}/state/{name}", batch_id) for name in ("open", "raw", "rows")}
        fresh = K.normalise(batch, contract).select(SERIES, "ts", *values)
        seeds = carried["open"] if carried["open"] is not None else spark.createDataFrame([], f"{SERIES} string, segment_id bigint, segment_start timestamp, prev_ts timestamp, last_slot bigint, closed_at timestamp")
        marked = fresh.join(seeds.select(SERIES, F.col("prev_ts").alias("_closed")), SERIES, "left").withColumn("_late", F.coalesce(F.col("ts") <= F.col("_closed"), F.lit(False))).drop("_closed")
        marked = cut_lineage(marked)
        put(marked.where("_late").drop("_late").withColumn("batch_id", number), f"{root}/late", "batch_id")
        arrived = marked.where("NOT _late").drop("_late")
        # series without news keep their state as it is and touch no day
        active = cut_lineage(arrived.select(SERIES).distinct())
        with_news = {n: None if t is None else t.join(active, SERIES, "left_semi") for n, t in carried.items()}
        raw = arrived if carried["raw"] is None else arrived.unionByName(with_news["raw"])
        base = K.clip_ranges(K.deduplicate(raw, contract), contract)
        placed = cut_lineage(placed_on_grid(base, seeds, cadence, values, params))
        grid = grid_rows(placed, values).withColumns({**{f: F.lit(None).cast("int") for f in flags}, **nothing})
        held = grid if carried["rows"] is None else with_news["rows"].unionByName(grid)
        # flags anew where a median's window has grown, else those a row carries
        flagged = K.flag_outliers(held.drop(*flags), Layout(), contract, params)
        old = held.select(*KEY, *[F.col(f).alias(f"_old_{f}") for f in flags])
        last = seeds.select(SERIES, F.col("segment_id").alias("_segment"), F.col("last_slot").alias("_closed"))
        both = flagged.join(old, KEY).join(last, SERIES, "left")
        settled_flag = (F.col("segment_id") == F.col("_segment")) & (F.col("slot") <= F.col("_closed") - (params.outlier_window - 1))
        both = both.withColumns({f: F.when(F.coalesce(settled_flag, F.lit(False)), F.coalesce(f"_old_{f}", f)).otherwise(F.col(f)) for f in flags}).drop(*[f"_old_{f}" for f in flags], "_segment", "_closed")
        rows = cut_lineage(known_around(both, values))

        fills = {c: K.linear_fill(c, "slot", params.max_interpolate_run, False) for c in values}
        done = rows.withColumns({f"_new_{c}": f for c, f in fills.items()}).withColumns({f"filled_{c}": F.expr(f"CAST({c} IS NULL AND _new_{c} IS NOT NULL AS INT)") for c in values})
        done = done.withColumns({c: F.col(f"_new_{c}") for c in values}).drop(*around, *[f"_new_{c}" for c in values]).withColumn(DAY, F.to_date("ts"))
        # rows of slots that were open may have got another segment or slot since
        open_days = [] if carried["raw"] is None else [r[0] for r in with_news["raw"].select(F.to_date("ts")).union(seeds.join(active, SERIES, "left_semi").select(F.to_date("closed_at"))).distinct().collect()]
        merge_days(spark, done, f"{root}/grid", active.join(seeds.select(SERIES, "closed_at"), SERIES, "left"), open_days)

        # what stays open: the slot of the first instant not older than the allowed lateness, and all behind it
        newest = F.max("ts").over(Window.partitionBy(SERIES))
        spot = F.struct("segment_id", "slot")
        cut = placed.withColumn("_new", newest).where(F.unix_micros("ts") >= F.unix_micros("_new") - lateness * 1_000_000).groupBy(SERIES).agg(F.min(spot).alias("_cut"))
        split = placed.join(cut, SERIES)
        closed = split.where(spot < F.col("_cut")).groupBy(SERIES).agg(F.max_by(F.struct("segment_id", "segment_start", F.col("ts").alias("prev_ts"), F.col("slot").alias("last_slot"), F.timestamp_micros(F.unix_micros("segment_start") + F.col("slot") * F.col("_step")).alias("closed_at")), "ts").alias("_s")).select(SERIES, "_s.*")
        still = seeds.join(closed, SERIES, "left_anti").unionByName(closed)
        still = cut_lineage(still)
        put(still.withColumn("batch_id", number), f"{root}/state/open", "batch_id")
        instants = split.where(spot >= F.col("_cut")).select(SERIES, "ts")
        waiting = raw.join(instants, [SERIES, "ts"], "left_semi")
        put(passed_on(waiting, carried["raw"], active).withColumn("batch_id", number), f"{root}/state/raw", "batch_id")
        ends = still.select(SERIES, F.col("segment_id").alias("_segment"), F.col("last_slot").alias("_closed"))
        near = F.col("slot") > F.col("_closed") - reach(params)
        pending = [F.col(c).isNull() & F.col(f"_pv_{c}").isNotNull() & F.col(f"_nv_{c}").isNull() & (F.col("slot") - F.col(f"_pp_{c}") <= params.max_interpolate_run) for c in values]
        waits = pending[0]
        for p in pending[1:]:
            waits = waits | p
        kept = rows.join(ends, SERIES).where((F.col("segment_id") == F.col("_segment")) & (F.col("slot") <= F.col("_closed")) & (near | waits))
        kept = kept.select(*KEY, "ts", *values, "is_imputed", "observations", *flags, *around)
        put(passed_on(kept, carried["rows"], active).withColumn("batch_id", number), f"{root}/state/rows", "batch_id")
        if keep_days is not None:
            drop_days(spark, f"{root}/grid", keep_days)

    return run


def passed_on(changed: DataFrame, before: DataFrame | None, active: DataFrame) -> DataFrame:
    """New state of the active series, the old one of all others."""
    return changed if before is None else changed.unionByName(before.join(active, SERIES, "left_anti").select(*changed.columns))


def merge_days(spark: SparkSession, rows: DataFrame, path: str, active: DataFrame, more_days: Sequence[date] = ()) -> None:
    """Put rows in place of those of their keys, in the days they touch and `more_days`; only these are read and written.

    `active` has the series of `rows` and `closed_at`: what is stored of them
    behind that instant, or at all if it is null, gives way.
    """
    days = sorted({r[0] for r in rows.select(DAY).distinct().collect()} | {d for d in more_days if d is not None})  # as many as a batch spans
    before = stored(spark, path)
    if before is not None:
        touched = before.where(F.col(DAY).isin(days)).join(active.withColumn("_active", F.lit(True)), SERIES, "left")
        final = touched.where(F.col("_active").isNull() | (F.col("ts") <= F.col("closed_at"))).drop("_active", "closed_at")
        rows = cut_lineage(rows.unionByName(final.join(rows.select(*KEY), KEY, "left_anti")))
    put(rows, path, DAY)
    if before is not None:  # overwriting leaves alone what no row is written to
        for day in set(days) - {r[0] for r in rows.select(DAY).distinct().collect()}:
            drop_day(spark, path, day)


def drop_day(spark: SparkSession, path: str, day: date) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{DAY}={day.isoformat()}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_days(spark: SparkSession, path: str, keep: int) -> None:
    """Remove the day partitions more than `keep` days before the newest."""
    held = stored(spark, path)
    if held is None:
        return
    days = sorted(r[0] for r in held.select(DAY).distinct().collect())
    for day in days:
        if (days[-1] - day).days > keep:
            drop_day(spark, path, day)


def cleaned_so_far(spark: SparkSession, root: str, contract: Contract = METRICS) -> DataFrame:
    """The clean rows stored below `root`, as `clean` returns them."""
    return K.drop_unfillable(spark.read.parquet(f"{root}/grid").drop(DAY), contract)

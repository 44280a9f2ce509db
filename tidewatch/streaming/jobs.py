"""Structured Streaming forms: ingest, rollups, sessions, scoring, alerts, mirror, and the micro-batch cycle.

Every job can run with `availableNow` (catch up and stop) or a processing-time
trigger. Progress lives in the checkpoint, so a restarted job neither loses nor
repeats rows; late rows are handled by an explicit watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import clean as K
from tidewatch.operators import cost as Y
from tidewatch.operators import drift as D
from tidewatch.operators import features as X
from tidewatch.operators import serving as P
from tidewatch.operators import store as O
from tidewatch.operators.cadence import SERIES
from tidewatch.operators.contract import METRICS, Contract, coerce
from tidewatch.operators.ordering import Layout, newest
from tidewatch.params import DEFAULTS, Params

SAMPLES = (
    "series_key string, id bigint, ts timestamp, cpu_percent double, mem_percent double, "
    "mem_used_mb double, disk_read_mb_s double, disk_write_mb_s double"
)


def read_samples(spark: SparkSession, path: str, schema: str = SAMPLES, files_per_trigger: int | None = None) -> DataFrame:
    """Files as they arrive; the checkpoint remembers which were read."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def start(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, path: str | None = None, mode: str = "append", every: str | None = None):
    """Start a job into a function per batch or a parquet folder; `every` is a processing-time interval."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.foreachBatch(sink).start() if sink else writer.format("parquet").start(path)


def rollup_stream(stream: DataFrame, freq: str, columns: Sequence[str], lateness: str = "10 minutes") -> DataFrame:
    """Mean, max, p95 and count per bucket, emitted when the watermark has passed it."""
    stats = [F.count(F.lit(1)).alias("samples")]
    for c in columns:
        stats += [F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"), F.percentile(c, F.lit(0.95)).alias(f"{c}_p95")]
    grouped = stream.withWatermark("ts", lateness).groupBy(SERIES, F.window("ts", freq).alias("_w")).agg(*stats)
    return grouped.select(SERIES, F.col("_w.start").alias("ts"), *[c for c in grouped.columns if c not in (SERIES, "_w")])


def gap_sessions(stream: DataFrame, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """Segments as sessions: a delta equal to the gap stays inside."""
    sessions = stream.withWatermark("ts", lateness).groupBy(SERIES, F.session_window("ts", gap).alias("_s"))
    out = sessions.agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return out.select(SERIES, "start", "end", "rows")


def score_stream(predictions: DataFrame, actuals: DataFrame, lateness: str = "10 minutes", patience: str = "1 minute") -> DataFrame:
    """Predictions joined to what happened in the same second; unmatched ones leave unscored once the watermark passes.

    Of several samples in one second the first by time counts (by `id`, if they have
    one, at one instant), so a prediction is scored once: seconds are reduced before
    the join. A prediction is due at the end of its second, as the second itself is:
    one that the watermark stands in is kept until its samples are reduced. The
    seconds compared are plain numbers, since states are dropped by an event time
    among the keys before `patience` is asked.
    """
    due = F.date_trunc("second", "predicted_for_ts") + F.expr("INTERVAL '0.999999' SECOND")
    p = predictions.withColumn("_due", due).withWatermark("_due", lateness).withColumn("_second", F.unix_seconds("_due"))
    stamped = actuals.withColumnRenamed(SERIES, "_series").withWatermark("ts", lateness)
    firsts = stamped.groupBy("_series", F.window("ts", "1 second").alias("_w")).agg(F.min_by("actual", F.struct(*P.in_order(actuals))).alias("actual"))
    a = firsts.select("_series", "actual", F.window_time("_w").alias("_end")).withColumn("_seen", F.unix_seconds("_end"))
    same = F.expr(f"_seen = _second AND {SERIES} = _series AND _end >= _due AND _end <= _due + INTERVAL {patience}")
    joined = p.join(a, same, "leftOuter")
    return joined.withColumn("abs_error", F.abs(F.col("actual") - F.col("predicted"))).drop("_due", "_second", "_seen", "_end", "_series")


def mirror_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Append raw rows, one partition per batch. A repeated batch replaces its own partition and nothing else."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return write


def rebuild_mirror(rows: DataFrame, path: str) -> None:
    """Rewrite the mirror after corrections or a missed write."""
    rows.withColumn("batch_id", F.lit(-1).cast("bigint")).write.mode("overwrite").partitionBy("batch_id").parquet(path)


def cycle_sink(root: str, target: str = "cpu_percent", contract: Contract = METRICS, params: Params = DEFAULTS, drift_every: int = 10) -> Callable[[DataFrame, int], None]:
    """One pass over everything that follows a batch of samples.

    Mirror the raw rows; clean the newest `context_rows` of every series; publish
    vectors, predictions and scores, allocations, and every few batches the drift
    decision. Each output is a partition of the batch, so a retried batch
    replaces its own results. Older history is never read again.
    """
    mirror = mirror_sink(f"{root}/raw")

    def put(df: DataFrame, name: str, batch_id: int) -> None:
        out = df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{root}/{name}")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mirror(batch, batch_id)
        raw = coerce(spark.read.parquet(f"{root}/raw").drop("batch_id"), contract)
        context = newest(raw.where(F.col("ts").isNotNull()), [SERIES], [F.desc("ts"), F.desc("id")], params.context_rows)
        put(context, "context", batch_id)
        context = spark.read.parquet(f"{root}/context").where(F.col("batch_id") == batch_id).drop("batch_id")
        layout = Layout.plan(context)
        put(K.clean(context, layout, contract, params), "clean", batch_id)
        done = spark.read.parquet(f"{root}/clean").where(F.col("batch_id") == batch_id).drop("batch_id")

        names = X.feature_names(target, done.columns, params)
        vectors = O.online_vectors(X.feature_frame(done, target, layout, params), names, target, "live", O.identify(target, names, params))
        put(vectors, "online", batch_id)

        recent = Y.recent_values(Y.to_long(done, [target]), params)
        now = recent.select(SERIES, P.next_instant(F.col("last_ts"), params).alias("predicted_for_ts"), F.col("current").alias("predicted"))
        put(now, "predictions", batch_id)
        logged = spark.read.parquet(f"{root}/predictions").drop("batch_id").dropDuplicates([SERIES, "predicted_for_ts"])
        scored = P.score(logged, raw.select(SERIES, "ts", F.col(target).alias("actual")), [SERIES])
        put(scored.where(F.col("abs_error").isNotNull()), "scored", batch_id)

        begin = recent.select(SERIES, "target", F.col("last_ts").alias("ts"), "current", F.lit(None).cast("double").alias("mae"))
        ahead = P.horizon_summary(P.horizon_forecast(begin, params), [SERIES, "target"])
        put(Y.recommend(ahead, recent, params), "recommendations", batch_id)

        if batch_id % drift_every == 0:
            put(D.feature_drift(done, target, params, layout=layout), "drift", batch_id)

    return run

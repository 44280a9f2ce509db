"""Queries that run a stream to its end: tables land as files in time order, a job with its own state catches up with them.

Each has the SQL of the batch form, so a stream must end where a batch ends.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import clean as K
from tidewatch.operators import drift as D
from tidewatch.operators import serving as P
from tidewatch.operators.cadence import SERIES
from tidewatch.operators.ordering import as_number, cut_lineage, newest, quantile_edges, shared_folder, slice_of
from tidewatch.params import DEFAULTS
from tidewatch.plans import views as V
from tidewatch.plans.catalog import nudge, query, rounded, with_ctes
from tidewatch.plans.decide import _COOLDOWN, _PRED, psi_sql
from tidewatch.plans.records import _F, _KEPT
from tidewatch.plans.shape import FEATS, HCHAIN, M, REGIME, TARGET
from tidewatch.streaming import cycle as Y
from tidewatch.streaming import jobs as S
from tidewatch.streaming import stateful as Q

#: A row of this series, later than all others, lets the watermark pass them; it is no series of the tables.
CLOSER = "~"
#: Files of one trigger, the least number of triggers, and about how many rows a file holds at most.
FILES = 3
PARTS = 4
SPAN_ROWS = 500_000
LATE = "10 minutes"


def triggers(rows: int, files: int = FILES) -> int:
    """How many triggers a table of so many rows takes."""
    return max(PARTS, math.ceil(rows / (files * SPAN_ROWS)))


def land(df: DataFrame, ts: str = "ts", files: int = FILES, parts: int = PARTS) -> str:
    """Write a table as files of consecutive spans of time, `files` of them at a time; returns the folder.

    A trigger that takes `files` files takes all that one job wrote, so whatever order
    they arrive in, no row comes after the watermark has passed it, and a series comes
    in time order. A span reaches up to its edge, a value of the table, and so is never
    empty but for the last. Spans grow in number, not in length, with the table.

    Last comes a row of the closing series one day after the newest. It has zeros,
    not nulls, and is only left out at the very end: a filter above a watermark
    would be moved below it and keep the row from passing.
    """
    spark, root = df.sparkSession, shared_folder(df.sparkSession)
    known = df.where(F.col(ts).isNotNull())
    spans = files * max(parts, triggers(known.count(), files))
    edges = quantile_edges(known, as_number(known, ts), spans)
    placed = slice_of(known, as_number(known, ts), [e + 1.0 for e in edges], "_span").withColumn("_job", F.floor(F.col("_span") / files).cast("int"))
    placed.write.partitionBy("_job").parquet(f"{root}/placed")
    stored = spark.read.schema(placed.schema).parquet(f"{root}/placed")
    for k in range(len(edges) // files + 1):
        stored.where(F.col("_job") == k).drop("_job").repartition("_span").write.mode("append").partitionBy("_span").parquet(f"{root}/landed")
    others = [F.lit("0").cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name not in (SERIES, ts)]
    newest_row = stored.agg(F.max(ts).alias(ts)).where(F.col(ts).isNotNull())
    closer = newest_row.select(F.lit(CLOSER).alias(SERIES), (F.col(ts) + F.expr("INTERVAL 1 DAY")).alias(ts), *others).select(*df.columns, F.lit(len(edges) + 1).alias("_span"))
    closer.coalesce(1).write.mode("append").partitionBy("_span").parquet(f"{root}/landed")
    return f"{root}/landed"


def arriving(df: DataFrame, ts: str = "ts", files: int = FILES, parts: int = PARTS) -> DataFrame:
    """The table as a stream of the files it landed in, those of one job at a time, in `parts` triggers at least."""
    return S.read_samples(df.sparkSession, land(df, ts, files, parts), schema=df.schema, files_per_trigger=files).select(*df.columns)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream until all has been read and return what it wrote, without the closing series."""
    spark, root = stream.sparkSession, shared_folder(stream.sparkSession)
    if mode == "append":
        S.start(stream, f"{root}/progress", path=f"{root}/out").awaitTermination()
    else:
        S.start(stream, f"{root}/progress", sink=S.mirror_sink(f"{root}/out"), mode=mode).awaitTermination()
    out = spark.read.schema(stream.schema.add("batch_id", "long") if mode != "append" else stream.schema).parquet(f"{root}/out")
    return out.where(F.col(SERIES) != CLOSER)


_ROLL = ", ".join(f"avg({c}) AS {c}_mean, max({c}) AS {c}_max, quantile_cont({c}, 0.95) AS {c}_p95" for c in V.MEASURES)


@query("stream_rollup", with_ctes([M, f"r AS (SELECT series_key, time_bucket(INTERVAL '6 hours', ts) AS ts, count(*) AS samples, {_ROLL} FROM metrics GROUP BY ALL)"], f"SELECT series_key, ts, samples, {rounded(*[f'{c}_{s}' for c in V.MEASURES for s in ('mean', 'max', 'p95')])} FROM r"))
def stream_rollup(spark, d):
    return drained(S.rollup_stream(arriving(V.metrics(spark, d)), "6 hours", V.MEASURES, LATE))


@query(
    "stream_sessions",
    with_ctes([M, "s AS (SELECT series_key, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_key ORDER BY ts)) > 7200000000 THEN 1 ELSE 0 END AS cut FROM metrics)",
               "g AS (SELECT series_key, ts, sum(cut) OVER (PARTITION BY series_key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM s)"],
              'SELECT series_key, min(ts) AS start, max(ts) AS "end", count(*) AS rows FROM g GROUP BY series_key, n'),
)
def stream_sessions(spark, d):
    return drained(S.gap_sessions(arriving(V.metrics(spark, d)), "2 hours", LATE))


_SECONDS = "seen AS (SELECT series_key, date_trunc('second', ts) AS s, arg_min(cpu_percent, ts) AS actual FROM metrics GROUP BY ALL)"
_STREAM_SCORED = [M, _PRED, _SECONDS, "scored AS (SELECT p.series_key, p.predicted_for_ts, p.predicted, actual, abs(actual - predicted) AS abs_error FROM pred p JOIN seen ON seen.series_key = p.series_key AND s = date_trunc('second', predicted_for_ts) WHERE predicted IS NOT NULL)"]


def predicted_samples(spark, d) -> DataFrame:
    """Each sample predicts the next one of its series."""
    raw = V.metrics(spark, d)
    return P.backfill_baseline(raw.withColumn("segment_id", F.lit(0)), TARGET, V.plan(raw)).drop("segment_id")


def scored_in_time(spark, d) -> DataFrame:
    predictions = arriving(predicted_samples(spark, d), "predicted_for_ts")
    actuals = arriving(V.metrics(spark, d)).select(SERIES, "id", "ts", F.col(TARGET).alias("actual"))
    return S.score_stream(predictions, actuals, LATE, "1 minute").where(F.col("abs_error").isNotNull())


@query("stream_scored", with_ctes(_STREAM_SCORED, f"SELECT series_key, predicted_for_ts, {rounded('predicted', 'actual', 'abs_error')} FROM scored"))
def stream_scored(spark, d):
    """Predictions wait as state for the second they were made for."""
    return drained(scored_in_time(spark, d)).select(SERIES, "predicted_for_ts", "predicted", "actual", "abs_error")


@query("stream_mirror", with_ctes([M], f"SELECT series_key, id, ts, {rounded(*V.MEASURES)} FROM metrics"))
def stream_mirror(spark, d):
    """Raw rows in partitions of their batch."""
    return drained(arriving(V.metrics(spark, d)), "update").drop("batch_id").select(SERIES, "id", "ts", *V.MEASURES)


@query("stream_online_vectors", with_ctes([*FEATS, f"c AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts DESC) AS k FROM feat WHERE {_KEPT})"],
                                          f"SELECT series_key, segment_id, ts, {rounded(*_F)} FROM c WHERE k = 1"))
def stream_online_vectors(spark, d):
    """Clean rows arrive; a ring for each series gives its newest vector after every batch, the last of which stays."""
    raw = V.hourly(spark, d)
    done = K.clean(raw, V.plan(raw)).select(SERIES, "segment_id", "ts", *V.MEASURES)
    vectors = drained(Q.online_vector_stream(arriving(done), TARGET), "update")
    return newest(vectors, [SERIES], [F.desc("ts")]).select(SERIES, "segment_id", "ts", *_F)


_GIVEN = "cadence AS (SELECT DISTINCT series_key, 3600.0::DOUBLE AS cadence FROM steps)"


@query(
    "stream_cycle_clean",
    with_ctes([_GIVEN if c.startswith("cadence AS") else c for c in HCHAIN], f"SELECT series_key, segment_id, slot, ts, {rounded(*V.MEASURES)}, is_imputed, observations, is_outlier FROM clean"),
)
def stream_cycle_clean(spark, d):
    """Samples are cleaned as they come and merged into the days they touch; the interval is known beforehand."""
    raw = V.hourly(spark, d)
    cadence = cut_lineage(raw.select(SERIES).distinct().withColumn("cadence", F.lit(3600.0)))
    root = shared_folder(spark)
    S.start(arriving(raw), f"{root}/progress", sink=Y.clean_sink(root, cadence)).awaitTermination()
    done = Y.cleaned_so_far(spark, root).where(F.col(SERIES) != CLOSER)
    return done.select(SERIES, "segment_id", "slot", "ts", *V.MEASURES, "is_imputed", "observations", "is_outlier")


_TRAINED = "TIMESTAMP '2024-01-15'"
_WORDS = ("idle", "ramp", "saturated", "unknown")
_STREAM_SIGNALS = [
    *_STREAM_SCORED,
    f"ref AS (SELECT series_key, round(avg(abs_error) / 2.0, 4) AS reference_mae FROM scored WHERE predicted_for_ts < {_TRAINED} GROUP BY series_key)",
    "re AS (SELECT series_key, round(avg(abs_error), 4) AS window_mae, count(*) AS n_scored FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY predicted_for_ts DESC) AS k FROM scored) WHERE k <= 50 GROUP BY series_key)",
    f"t AS (SELECT series_key, cpu_percent, TRUE AS is_ref FROM metrics WHERE ts < {_TRAINED} UNION ALL SELECT series_key, cpu_percent, FALSE FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts DESC) AS k FROM metrics) WHERE k <= 50)",
    f"e AS (SELECT series_key, list_distinct([{', '.join(f'quantile_cont(cpu_percent, {i / 10!r})' for i in range(1, 10))}]) AS edges FROM t WHERE is_ref GROUP BY series_key)",
    "b AS (SELECT t.series_key, is_ref, len(list_filter(edges, lambda q: cpu_percent >= q)) AS bin FROM t LEFT JOIN e USING (series_key))",
    *psi_sql("metrics")[3:6],
    "fd AS (SELECT series_key, round(sum((pc - pr) * ln(pc / pr)), 4) AS psi FROM z GROUP BY series_key)",
    f"rg AS (SELECT series_key, is_ref, {REGIME} AS regime FROM t)",
    "rc AS (SELECT series_key, count(*) FILTER (WHERE is_ref) AS r, count(*) FILTER (WHERE NOT is_ref) AS c, " + ", ".join(f"count(*) FILTER (WHERE is_ref AND regime = '{w}') AS r{i}, count(*) FILTER (WHERE NOT is_ref AND regime = '{w}') AS c{i}" for i, w in enumerate(_WORDS)) + " FROM rg GROUP BY series_key)",
    "cd AS (SELECT series_key, round(" + " + ".join(f"(greatest(c{i} / c, 1e-6) - greatest(r{i} / r, 1e-6)) * ln(greatest(c{i} / c, 1e-6) / greatest(r{i} / r, 1e-6))" for i in range(4)) + ", 4) AS psi FROM rc)",
    "sig AS (SELECT series_key, reference_mae, window_mae, n_scored, fd.psi AS feature_psi, cd.psi AS regime_psi, window_mae / reference_mae AS q FROM ref JOIN re USING (series_key) JOIN fd USING (series_key) JOIN cd USING (series_key))",
]


@query(
    "stream_drift_decisions",
    with_ctes(_STREAM_SIGNALS, "SELECT series_key, reference_mae, window_mae, n_scored, feature_psi, regime_psi, round(q, 3) AS ratio, "
              "CASE WHEN n_scored >= 30 AND q > 1.5 THEN 'performance' WHEN regime_psi > 0.25 THEN 'categorical' WHEN feature_psi > 0.25 THEN 'feature' END AS trigger FROM sig"),
)
def stream_drift_decisions(spark, d):
    """Scores come from a stateful join, go into rings of errors, and are judged against a profile of the first two weeks; the last decision of a series stays."""
    trained = F.lit("2024-01-15").cast("timestamp")
    raw = V.metrics(spark, d)
    profile = Q.drift_profile(raw.where(F.col("ts") < trained), TARGET)
    errors = P.score(predicted_samples(spark, d), raw.select(SERIES, "id", "ts", F.col(TARGET).alias("actual")), [SERIES]).where(F.col("predicted_for_ts") < trained)
    reference = errors.groupBy(SERIES).agg(F.round(F.avg("abs_error") / 2.0, 4).alias("reference_mae"))
    kept = cut_lineage(profile.join(reference, SERIES, "left"))
    signals = Q.drift_signal_stream(arriving(raw), scored_in_time(spark, d), kept, TARGET)
    last = newest(drained(signals), [SERIES], [F.desc("revision")])
    return D.decide(last).select(SERIES, "reference_mae", "window_mae", "n_scored", "feature_psi", "regime_psi", "ratio", "trigger")


_CONSUMERS = "held AS (SELECT series_key, ts, id * 10 + j AS pid, 'p' || (id % 23) AS name, (cpu_percent * (j + 1) * 37) % 101 AS rss_mb FROM metrics, (SELECT unnest(range(0, 8)) AS j))"


@query(
    "stream_alert_payloads",
    with_ctes([M, *_COOLDOWN, _CONSUMERS,
               "fired AS (SELECT a.series_key, a.ts, a.cpu_percent AS observed FROM alerts a JOIN instants i ON a.series_key = i.series_key AND a.ts = i.ts AND a.id = i.first_id JOIN kept k ON a.series_key = k.series_key AND a.ts = k.ts)",
               "placed AS (SELECT f.*, pid, name, rss_mb, row_number() OVER (PARTITION BY f.series_key, f.ts ORDER BY rss_mb DESC, pid) AS place FROM fired f JOIN held h ON f.series_key = h.series_key AND f.ts = h.ts)"],
              f"SELECT series_key, ts, {nudge('observed')} AS observed, place - 1 AS at, pid, name, {nudge('rss_mb')} AS rss_mb FROM placed WHERE place <= 5").replace("WITH ", "WITH RECURSIVE ", 1),
)
def stream_alert_payloads(spark, d):
    """Samples and consumers arrive as two streams; timers at event time file the alerts. The payload is read back from its JSON."""
    raw = V.metrics(spark, d)
    some = raw.select(SERIES, "ts", "id", TARGET, F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
    held = some.select(SERIES, "ts", (F.col("id") * 10 + F.col("j")).alias("pid"), F.concat(F.lit("p"), (F.col("id") % 23).cast("string")).alias("name"), (F.col(TARGET) * (F.col("j") + 1) * 37 % 101).alias("rss_mb"))
    # in as many spans as the consumers: samples that run ahead of them would wait as state until the last trigger
    alike = triggers(held.where(F.col("ts").isNotNull()).count())
    alerts = Q.alert_stream(arriving(raw, parts=alike), TARGET, DEFAULTS.with_(alert_cooldown=3600), arriving(held), LATE)
    read = F.from_json("process_payload", "array<struct<pid bigint, name string, rss_mb double>>")
    return drained(alerts).select(SERIES, "ts", "observed", F.posexplode(read).alias("at", "entry")).select(SERIES, "ts", "observed", F.col("at").cast("bigint").alias("at"), "entry.*")

"""Queries: whole batch runs, with their records, over the event samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import clean as K
from tidewatch.operators.batch import run_batch
from tidewatch.operators.ordering import shared_folder
from tidewatch.plans import quality as Q
from tidewatch.plans import stages as S
from tidewatch.plans import views as V
from tidewatch.plans.catalog import query, rounded, with_ctes

LATER = "2024-02-10"
SCALED_SQL = "scaled AS (SELECT * REPLACE (cpu_percent * 0.2 AS cpu_percent) FROM metrics)"


def scaled(spark, d):
    """Samples inside the contract's ranges, so that the gate only warns. The few still above are brought to the edge, as cleaning does in any case."""
    return K.clip_ranges(V.metrics(spark, d).withColumn("cpu_percent", F.col("cpu_percent") * 0.2))


#: What the queries read of the rows a run loads.
LOADED = "series_key string, segment_id bigint, slot bigint, ts timestamp, " + ", ".join(f"{m} double" for m in V.MEASURES) + ", is_imputed int, is_outlier int"


def loaded(spark, frame, schema: str = LOADED):
    """What a run left in `frame`; a run that its gate stopped loaded no rows."""
    return spark.createDataFrame([], schema) if frame is None else frame


def rounded_cadence(chain: list[str]) -> list[str]:
    """The cleaning chain with the cadence to two decimals, as the gate reports it."""
    out = []
    for cte in chain:
        if cte.startswith("cadence AS"):
            out += [cte.replace("cadence AS", "exact AS", 1), "cadence AS (SELECT series_key, round(cadence, 2) AS cadence FROM exact)"]
        else:
            out.append(cte)
    return out


@query(
    "batch_run_clean",
    with_ctes([Q.M, SCALED_SQL, *rounded_cadence(S.to_clean("scaled")), "counted AS (SELECT count(*) AS rows_out FROM clean)", "seen AS (SELECT count(*) AS rows_in FROM scaled)"],
              f"SELECT series_key, segment_id, slot, ts, {rounded(*V.MEASURES)}, is_imputed, is_outlier, 'success' AS status, 'WARN' AS gate_verdict, rows_in, rows_out FROM clean, counted, seen"),
)
def batch_run_clean(spark, d):
    """A run that passes: what it loaded, beside its own record."""
    done = run_batch(scaled(spark, d), 7, LATER, shared_folder(spark))
    record = done.run.select("status", "gate_verdict", "rows_in", "rows_out")
    return loaded(spark, done.clean).select("series_key", "segment_id", "slot", "ts", *V.MEASURES, "is_imputed", "is_outlier").crossJoin(F.broadcast(record))


@query(
    "batch_run_features",
    with_ctes([Q.M, SCALED_SQL, *rounded_cadence(S.to_clean("scaled"))], "SELECT series_key, count(*) AS vectors, min(ts) AS first_ts, max(ts) AS last_ts FROM clean GROUP BY series_key"),
)
def batch_run_features(spark, d):
    """Vectors loaded by a run that is made twice: loading again replaces its own rows."""
    root = shared_folder(spark)
    run_batch(scaled(spark, d), 7, LATER, root)
    vectors = loaded(spark, run_batch(scaled(spark, d), 7, LATER, root).features)
    return vectors.groupBy("series_key").agg(F.count(F.lit(1)).alias("vectors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    "batch_run_blocked",
    with_ctes([Q.M, V.DIRTY_SQL, "gated AS (SELECT * FROM dirty)", *Q.GATE_SQL],
              "SELECT 8::BIGINT AS run_id, 'blocked' AS status, 'FAIL' AS gate_verdict, (SELECT count(*) FROM gated) AS rows_in, 0::BIGINT AS rows_out, "
              "'gate failed: ' || string_agg(DISTINCT check_name, ', ' ORDER BY check_name) FILTER (WHERE status = 'FAIL') AS error, count(*) AS checks FROM checks"),
)
def batch_run_blocked(spark, d):
    """A run that the gate stops: its record and how many checks it keeps."""
    done = run_batch(V.dirty(spark, d), 8, Q.NOW, shared_folder(spark))
    kept = done.checks.agg(F.count(F.lit(1)).alias("checks"))
    return done.run.select("run_id", "status", "gate_verdict", "rows_in", "rows_out", "error").crossJoin(F.broadcast(kept))


@query(
    "batch_run_empty",
    "SELECT 'row_count' AS check_name, CASE WHEN count(*) < 50 THEN 'FAIL' ELSE 'PASS' END AS check_status, count(*)::DOUBLE AS value, 'blocked' AS status, count(*) AS rows_in FROM events WHERE value < 0",
)
def batch_run_empty(spark, d):
    """No sample is below zero: a table without rows fails its row count and nothing else is asked."""
    done = run_batch(V.metrics(spark, d).where("cpu_percent < 0"), 9, Q.NOW, shared_folder(spark))
    return done.checks.select("check_name", F.col("status").alias("check_status"), "value").crossJoin(F.broadcast(done.run.select("status", "rows_in")))

"""One batch run: gate, then cleaning, transform, load and features, with its records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import clean as K
from tidewatch.operators import features as X
from tidewatch.operators import gate as G
from tidewatch.operators import runlog as L
from tidewatch.operators import store as O
from tidewatch.operators import transform as R
from tidewatch.operators.cadence import SERIES, detect_cadence
from tidewatch.operators.contract import METRICS, Contract, coerce
from tidewatch.operators.ordering import Layout, cut_lineage
from tidewatch.params import DEFAULTS, Params
from tidewatch.sources.writers import load_run


@dataclass(frozen=True)
class Batch:
    """What a run leaves behind: its row, its checks, and, unless it was blocked, what it loaded below `root`."""

    run: DataFrame
    checks: DataFrame
    clean: DataFrame | None = None
    features: DataFrame | None = None


def run_batch(raw: DataFrame, run_id: int, now: str, root: str, source: tuple[str, str] = ("table", ""), target: str = "cpu_percent", contract: Contract = METRICS, params: Params = DEFAULTS) -> Batch:
    """Check `raw` and, if no series failed, clean it, add derived columns and load it under `run_id`.

    The run proceeds only if every series may. A table without rows fails its row
    count and nothing else is asked. Cleaning takes the cadence as the gate
    reports it, to two decimals. Loading a run again replaces its rows.
    """
    spark = raw.sparkSession
    typed = cut_lineage(coerce(raw, contract))
    begun = L.start_run(spark, run_id, *source, O.params_fingerprint(params), now)
    rows = typed.count()
    if not rows:
        checks = G.empty_gate(spark, params).withColumn(SERIES, F.lit(None).cast("string"))
    else:
        layout = Layout.plan(typed)
        arrival = Layout.plan(typed, "id") if "id" in typed.columns else None
        checks = G.run_checks(typed, now, layout, contract, params, arrival)
    checks = cut_lineage(checks.select(F.lit(run_id).cast("bigint").alias("run_id"), SERIES, "check_name", "status", "value", "detail", F.lit(now).cast("timestamp").alias("checked_at")))
    load_run(checks.drop("run_id"), run_id, f"{root}/checks")
    verdict = G.summarise(checks, params, ("run_id",)).first()
    broken = checks.where(F.col("status") == "FAIL").agg(F.array_join(F.array_sort(F.collect_set("check_name")), ", ")).first()[0]
    facts = {"rows_in": rows, "gate_verdict": verdict["verdict"]}
    if not verdict["should_proceed"]:
        return Batch(L.finish_run(begun, run_id, "blocked", now, rows_out=0, error=f"gate failed: {broken}" if broken else None, **facts), checks)
    cadence = detect_cadence(typed, layout, params).withColumn("cadence", F.round("cadence", 2))
    done = R.transform(K.clean(typed, layout, contract, params, cadence), layout, params)
    load_run(done, run_id, f"{root}/clean")
    loaded = spark.read.schema(done.schema.add("run_id", "long")).parquet(f"{root}/clean").where(F.col("run_id") == run_id).drop("run_id")
    vectors = X.feature_frame(loaded, target, layout, params)
    load_run(vectors, run_id, f"{root}/features")
    stored = spark.read.schema(vectors.schema.add("run_id", "long")).parquet(f"{root}/features").where(F.col("run_id") == run_id).drop("run_id")
    print_of = O.data_fingerprint(loaded, [target]).first()["data_fingerprint"]
    ended = L.finish_run(begun, run_id, "success", now, rows_out=loaded.count(), data_fingerprint=print_of, **facts)
    return Batch(ended, checks, loaded, stored)

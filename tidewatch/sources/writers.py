"""Sinks: keyed loads, exports, retention and corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.ordering import shared_folder  # noqa: F401
from tidewatch.operators.runlog import latest_run


def load_run(df: DataFrame, run_id: int, path: str, parts: Sequence[str] = ()) -> None:
    """Write the rows of one run. Loading a run again replaces exactly its partition."""
    out = df.withColumn("run_id", F.lit(run_id).cast("bigint"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", *parts).parquet(path)


def read_run(spark: SparkSession, path: str, run_id: int | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Rows of one run, by default of the latest successful one. Other partitions are not read."""
    loaded = spark.read.parquet(path)
    if run_id is None:
        return loaded.join(F.broadcast(latest_run(runs).select("run_id")), "run_id", "left_semi")
    return loaded.where(F.col("run_id") == run_id)


def export_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Every row as CSV with a header, range partitioned in `order` so that the files follow each other."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)


def retained(df: DataFrame, now, days: int, ts: str = "ts") -> DataFrame:
    """Rows not older than the retention period."""
    return df.where(F.col(ts) >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def corrected(df: DataFrame, changes: DataFrame, deletes: DataFrame, editable: Sequence[str], key: str = "id") -> DataFrame:
    """Apply point corrections. `changes` has the key and any editable columns, null meaning unchanged."""
    edits = [c for c in editable if c in changes.columns]
    patch = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in edits])
    out = df.join(deletes.select(key), key, "left_anti").join(patch, key, "left")
    out = out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in edits})
    return out.drop(*[f"_new_{c}" for c in edits]).select(*df.columns)

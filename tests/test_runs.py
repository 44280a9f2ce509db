"""Batch runs over tables that their gate stops."""

import duckdb
import pytest
from conftest import TINY
from pyspark.sql import functions as F

from tidewatch.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["batch_run_clean", "batch_run_features"])
def test_a_stopped_run_loads_no_rows(spark, tmp_path, name):
    """Six samples at every instant: more repeats than the gate lets pass. The run used to end in an error."""
    events = spark.read.parquet(f"{TINY}/events.parquet")
    again = events.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("event_id", F.col("event_id") + F.col("k") * 1_000_000).drop("k")
    again.write.parquet(f"{tmp_path}/events.parquet")
    got, usual = QUERIES[name](spark, str(tmp_path)), QUERIES[name](spark, TINY)
    assert got.count() == 0 and usual.count() > 0
    assert got.dtypes == usual.dtypes


@pytest.mark.parametrize("name", ["batch_run_clean", "batch_run_features"])
def test_a_sample_far_above_the_others_does_not_stop_the_run(spark, tmp_path, name):
    """A fifth of 600 is out of the contract's range, where the gate stops the run: no rows used to come back."""
    events = spark.read.parquet(f"{TINY}/events.parquet")
    events.withColumn("value", F.when(F.col("event_id") % 400 == 7, 600.0).otherwise(F.col("value"))).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    plain = lambda rows: sorted((tuple(round(v, 4) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert got.count() > 0 and plain(map(tuple, got.collect())) == plain(want.fetchall())

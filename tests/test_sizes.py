"""What must not depend on the size of a table or on the session, and streams scored once."""

import math

import numpy as np
import pytest
from conftest import same
from pyspark.sql import functions as F

from tidewatch.operators import registry
from tidewatch.operators.batch import run_batch
from tidewatch.operators.cadence import deltas, find_gaps
from tidewatch.operators.cost import _summaries
from tidewatch.operators.ordering import GROUP_ROWS, MOST_SLICES, ROWS_PER_SLICE, SIZES, Layout, Sizes, cut_lineage, is_local, join_spread, shared_folder, slice_count
from tidewatch.operators.percentiles import direct_percentiles, exact_percentiles, sliced_percentiles
from tidewatch.params import Params, load
from tidewatch.streaming.jobs import score_stream


def test_percentiles_take_nan_as_missing_in_both_forms(spark):
    rows = [("a", float(v)) for v in (5, 1, 4, 4, 9, 2)] + [("a", math.nan), ("a", None), ("b", math.nan), ("b", None), ("c", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    direct = direct_percentiles(df, ["k"], "v", [0.25, 0.5, 0.95])
    for parts in (2, 5):
        same(direct, sliced_percentiles(df, ["k"], "v", [0.25, 0.5, 0.95], parts), digits=15)
    got = {r["k"]: r["p0_5"] for r in direct.collect()}
    assert got == {"a": 4.0, "b": None, "c": 7.0}


def test_only_local_sessions_do_without_a_shared_folder(spark):
    assert is_local("local") and is_local("local[8]") and is_local("local[*]")
    assert not is_local("local-cluster[3,2,1024]") and not is_local("spark://host:7077") and not is_local("yarn")
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark).startswith(root) and shared_folder(spark) != shared_folder(spark)


def test_a_join_with_small_rows_leaves_hot_keys_spread(spark):
    big = spark.range(2_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    small = big.groupBy("k").agg(F.count("id").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same(join_spread(big, small, ["k"], ["id"]), big.join(small, "k"))
        plan = join_spread(big, small, ["k"], ["id"]).groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    aggregates = plan.split("SortMergeJoin")[0].split("ShuffledHashJoin")[0]
    assert "Exchange hashpartitioning(k" in aggregates  # counted by task first, exchanged once more after the join


def test_summaries_of_a_block_keep_no_number_for_each_value():
    """A view of the last column used to keep 2.6 MB alive for each block of a frame."""
    found = _summaries(np.arange(2_000.0), np.arange(161.0))
    assert max((a if a.base is None else a.base).nbytes for a in found.values()) <= 161 * 8
    assert found["run"].tolist() == [1_999 - k for k in range(161)]


def test_settled_deltas_are_not_sent_to_every_task(spark):
    """Regular instants make files far smaller than their rows: by that size the driver used to gather them for a broadcast."""
    rows = spark.range(20_000).select(F.lit("s").alias("series_key"), F.timestamp_seconds(F.floor(F.col("id") / 10) * 86_400 * F.when(F.col("id") > 19_000, 3).otherwise(1)).alias("ts"))
    steps = cut_lineage(deltas(rows, Layout()))
    cadence = spark.createDataFrame([("s", 86_400.0)], "series_key string, cadence double")
    gaps = find_gaps(rows, cadence, Layout(), steps=steps)
    assert "Broadcast" not in gaps._jdf.queryExecution().executedPlan().toString()
    assert gaps.count() == 100


def test_a_prediction_is_scored_once_with_the_first_sample_of_its_second(spark):
    made = spark.sql("SELECT 's' AS series_key, timestamp'2024-01-01 10:00:05' AS predicted_for_ts, 4.0D AS predicted")
    seen = spark.sql(
        "SELECT * FROM VALUES ('s', timestamp'2024-01-01 10:00:05.7', 9.0D), ('s', timestamp'2024-01-01 10:00:05.1', 5.0D), ('s', timestamp'2024-01-01 10:00:06', 1.0D), ('t', timestamp'2024-01-01 10:00:05', 2.0D) AS t(series_key, ts, actual)"
    )
    rows = score_stream(made, seen).collect()
    assert [(r["actual"], r["abs_error"]) for r in rows] == [(5.0, 1.0)]


def test_parameters_are_read_whole(spark):
    table = spark.createDataFrame([("horizon", "7", "int"), ("horizon", "7", "int"), ("auto_retrain", "Yes", "bool"), ("lags", "[0, 2]", "json"), ("other", "x", "text")], "key string, value string, value_type string")
    got = load(table)
    assert (got.horizon, got.auto_retrain, got.lags) == (7, True, (0, 2)) and isinstance(got, Params)
    with pytest.raises(ValueError):
        load(table.union(spark.createDataFrame([("horizon", "8", "int")], table.schema)))


def test_an_empty_batch_fails_its_row_count_only(spark):
    raw = spark.createDataFrame([], "series_key string, id long, ts timestamp, cpu_percent double, mem_percent double, mem_used_mb double, disk_read_mb_s double, disk_write_mb_s double")
    done = run_batch(raw, 3, "2024-01-01", shared_folder(spark))
    assert [(r["check_name"], r["status"], r["value"]) for r in done.checks.collect()] == [("row_count", "FAIL", 0.0)]
    assert [(r["status"], r["gate_verdict"], r["rows_in"], r["error"]) for r in done.run.collect()] == [("blocked", "FAIL", 0, "gate failed: row_count")]
    assert done.clean is None and Layout.plan(raw).single


def test_breach_blocks_merge_at_any_width(spark):
    """Blocks of a few values, merged in groups of every width, against one walk over the series."""
    import random

    import pandas as pd

    from tidewatch.operators.cost import fold_blocks, join_blocks

    rng, rows, want = random.Random(8), [], {}
    for key in range(12):
        values = [rng.choice((10.0, 95.0, 96.0)) if key % 3 else rng.choice((95.0, 95.0, 95.0, 10.0)) for _ in range(rng.randint(1, 60))]
        if key == 5:
            values = [99.0] * 40
        over = [v > 90 for v in values]
        runs = [len(r) for r in "".join("x" if o else " " for o in over).split()]
        want[str(key)] = (len(values), sum(over), len(runs), max(runs, default=0))
        rows += [(str(key), i // 4, values[i : i + 4]) for i in range(0, len(values), 4)]
    blocks = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "block", "values"]), "k string, block bigint, values array<double>")
    for width in (1, 2, 3, 100):
        got = join_blocks(fold_blocks(blocks, ["k"], [90.0]), ["k"], width).collect()
        assert {r["k"]: (r["samples"], r["breaches"], r["episodes"], r["longest_episode"]) for r in got} == want


def test_small_slices_stop_growing_in_number(spark):
    """Slices of few rows are at most MOST_SLICES; beyond the usual size a larger table has more of them again."""
    rows = spark.range(4_000).select(F.lit("x").alias("series_key"), F.timestamp_seconds("id").alias("ts"), (F.col("id") * 37 % 4_001).cast("double").alias("v"))
    mark = SIZES.set(Sizes(5, 5, 5, 0))
    try:
        layout = Layout.plan(rows)
        same(exact_percentiles(rows, ["series_key"], "v", [0.05, 0.5, 0.95]), direct_percentiles(rows, ["series_key"], "v", [0.05, 0.5, 0.95]))
    finally:
        SIZES.reset(mark)
    assert 0 < len(layout.edges) < MOST_SLICES
    assert slice_count(36_000_000, 300, ROWS_PER_SLICE) == slice_count(36_000_000, 200, GROUP_ROWS) == MOST_SLICES
    assert slice_count(3_000, 300, ROWS_PER_SLICE) == 10 and slice_count(2 * MOST_SLICES * ROWS_PER_SLICE, 300, ROWS_PER_SLICE) == 2 * MOST_SLICES


def test_models_of_one_target_meet_its_decision_on_many_tasks(spark):
    """Nearly all models are of one target; the few decisions are no reason to gather them in one task."""
    models = spark.range(4_000).selectExpr(
        "concat('m-', id) AS model_id", "IF(id % 100 = 0, 'few', 'hot') AS target", "'x' AS algorithm", "1.0D AS mae", "id % 2 = 0 AS is_champion",
        "timestamp'2024-01-01' AS promoted_at", "CAST(NULL AS string) AS rejected_reason",
    )
    judged = spark.sql("SELECT 'hot' AS target, 'new' AS model_id, 'x' AS algorithm, 0.5D AS mae, true AS promote, 'PROMOTED' AS verdict, 'beats incumbent' AS rule, 2.0D AS persistence_mae")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        after = registry.apply_decisions(models, judged, "2024-02-01")
        most = after.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        champions = {(r["target"], r["model_id"]) for r in after.where("is_champion AND (target = 'hot' OR model_id = 'm-0')").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert most < 2_000 and champions == {("hot", "new"), ("few", "m-0")}

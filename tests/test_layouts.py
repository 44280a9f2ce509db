"""The sliced and blocked way of computing must return what plain windows return.

One series here holds every row, or each series spans many slices and blocks.
"""

import os

import pandas as pd
import pytest
from conftest import SMALL, TINY, same
from pyspark.sql import functions as F

from tidewatch.operators import backtest as B
from tidewatch.operators import cadence as G
from tidewatch.operators import clean as K
from tidewatch.operators import cost as Y
from tidewatch.operators import drift as D
from tidewatch.operators import features as X
from tidewatch.operators import gate
from tidewatch.operators import serving as P
from tidewatch.operators import scoring as Z
from tidewatch.operators import transform as T
from tidewatch.operators.contract import coerce
from tidewatch.operators.ordering import SIZES, Layout, Sizes, cut_lineage, within_groups
from tidewatch.operators.percentiles import direct_percentiles, sliced_percentiles
from tidewatch.params import DEFAULTS
from tidewatch.plans import views as V

PLAIN = Layout()
# The long comparisons take minutes; TIDEWATCH_ALL=1 includes them.
slow = pytest.mark.skipif(not os.environ.get("TIDEWATCH_ALL"), reason="set TIDEWATCH_ALL=1")


@pytest.fixture(scope="module")
def hourly(spark):
    return cut_lineage(V.hourly(spark, SMALL).where("series_key IN ('click', 'view')"))


@pytest.fixture(scope="module")
def samples(spark):
    """All samples as one hot series."""
    return cut_lineage(V.metrics(spark, TINY).withColumn("series_key", F.lit("hot")))


@pytest.fixture(scope="module")
def sliced(hourly):
    layout = Layout.plan(hourly, rows_per_slice=400, block_rows=260)
    assert len(layout.edges) > 2
    return layout


@pytest.fixture(scope="module")
def cleaned(hourly):
    return cut_lineage(K.clean(hourly, PLAIN))


def hot_layout(df, order="ts"):
    layout = Layout.plan(df, order, rows_per_slice=90, block_rows=40)
    assert not layout.single
    return layout


def test_plan_is_single_for_small_tables(hourly):
    assert Layout.plan(hourly).single


def test_positions(samples):
    layout = hot_layout(samples)
    rows = X.numbered(samples.select("series_key", "ts"), layout)
    same(rows, X.numbered(samples.select("series_key", "ts"), PLAIN))


def test_cadence_and_gaps(samples):
    layout = hot_layout(samples)
    a, b = G.detect_cadence(samples, PLAIN), G.detect_cadence(samples, layout, group_rows=50)
    same(a, b)
    same(G.find_gaps(samples, a, PLAIN), G.find_gaps(samples, a, layout))


def test_segments(samples):
    layout = hot_layout(samples)
    base = cut_lineage(K.prepared(samples))
    cadence = G.detect_cadence(base, PLAIN)
    one, many = G.segment(base, cadence, PLAIN), G.segment(base, cadence, layout)
    same(one, many)
    same(G.segment_profile(one, PLAIN), G.segment_profile(many, layout))


def test_regridding_exchanges_wide_rows_twice(samples):
    """Once by slice and once by slot: segments, their starts and the holes come from the first pass."""
    layout = hot_layout(samples)
    base = cut_lineage(K.prepared(samples))
    cadence = cut_lineage(G.detect_cadence(base, PLAIN))
    segmented = G.segment(base, cadence, layout, ends=True)
    starts = G.segment_starts(G.segment(base, cadence, PLAIN), PLAIN)
    same(segmented.drop("next_ts"), starts)
    grid = K.regrid(segmented, layout)
    same(grid, K.regrid(starts.drop("segment_start"), PLAIN))
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and all("_slice" in line for line in plan.splitlines() if "Window" in line)  # of slices only, not of rows


def test_uncut_series_are_exchanged_once_for_cadence_and_segments(spark, samples):
    base = cut_lineage(samples.select("series_key", "ts"))
    cadence = cut_lineage(G.detect_cadence(base, PLAIN))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = G.segment(base, cadence, PLAIN)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2  # the rows and the cadences


def test_gate(spark):
    typed = cut_lineage(coerce(V.dirty(spark, TINY)))
    layout = hot_layout(typed.where(F.col("ts").isNotNull()))
    arrival = hot_layout(typed, "id")
    same(gate.run_checks(typed, "2024-01-25", PLAIN), gate.run_checks(typed, "2024-01-25", layout, arrival=arrival))


@pytest.mark.parametrize("strategy", ["flag_only", pytest.param("interpolate", marks=slow)])
def test_clean(hourly, sliced, strategy):
    params = DEFAULTS.with_(outlier_strategy=strategy)
    same(K.clean(hourly, PLAIN, params=params), K.clean(hourly, sliced, params=params))


def test_impute_runs_longer_than_a_block(hourly):
    """Nulls over several blocks: the known values on either side come from other blocks."""
    grid = cut_lineage(K.gridded(hourly, PLAIN))
    holed = grid.withColumns({c: F.when((F.col("slot") < 5) | (F.col("slot") > 200), F.col(c)) for c in V.MEASURES})
    same(K.impute(holed, PLAIN), K.impute(holed, Layout((1.0,), 20)))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_segments_that_fit_a_block_are_not_cut(hourly, cleaned, sliced):
    """Cut series of short segments: nothing is put into blocks or carried between them, and the rows are the same."""
    roomy = Layout(sliced.edges, 100_000)
    assert within_groups(cleaned, "slot", roomy).single and not within_groups(cleaned, "slot", Layout(sliced.edges, 100)).single
    done, frame = K.clean(hourly, roomy), X.feature_frame(cleaned, "cpu_percent", roomy)
    assert "_block" not in _plan(done) and "_block" not in _plan(frame)
    same(cleaned, done)
    same(X.feature_frame(cleaned, "cpu_percent", PLAIN), frame)


def test_an_audit_merges_the_samples_once(hourly, sliced):
    twice = hourly.unionByName(hourly.where("cpu_percent > 50"))
    audit = K.audit(twice, sliced)
    assert "hashpartitioning(series_key" in _plan(audit) and ", ts#" not in "".join(x for x in _plan(audit).splitlines() if "hashpartitioning" in x)
    same(K.audit(twice, PLAIN), audit)


@slow
def test_features(cleaned, sliced):
    same(X.feature_frame(cleaned, "cpu_percent", PLAIN), X.feature_frame(cleaned, "cpu_percent", sliced))
    same(X.contamination(cleaned, "cpu_percent", PLAIN), X.contamination(cleaned, "cpu_percent", sliced))
    same(T.add_derived(cleaned, PLAIN), T.add_derived(cleaned, sliced))


@slow
def test_baselines(cleaned, sliced):
    names = X.feature_names("cpu_percent", cleaned.columns)
    out = []
    for layout in (PLAIN, sliced):
        rows = X.numbered(X.training_rows(X.feature_frame(cleaned, "cpu_percent", layout), names), layout)
        out.append(Z.ladder(Z.split_test(Z.baseline_predictions(rows, "cpu_percent", layout))))
    same(*out)


def test_backfill(cleaned, sliced):
    same(P.backfill_baseline(cleaned, "cpu_percent", PLAIN), P.backfill_baseline(cleaned, "cpu_percent", sliced))


@pytest.mark.parametrize("rows", [3, 50])
def test_breach_statistics_over_blocks(samples, rows):
    layout = hot_layout(samples)
    for level in (5.0, 40.0, 480.0):
        same(Y.breach_stats(samples, "cpu_percent", level, PLAIN, rows=100_000), Y.breach_stats(samples, "cpu_percent", level, layout, rows=rows))


def test_sweep(hourly, sliced):
    same(Y.sweep(hourly, "cpu_percent", "cpu_percent", PLAIN, rows=100_000), Y.sweep(hourly, "cpu_percent", "cpu_percent", sliced, rows=64))


def test_backtest(samples):
    layout = Layout.plan(samples, rows_per_slice=90, block_rows=40)
    rows = samples.withColumn("cpu_percent", F.least("cpu_percent", F.lit(100.0)))
    same(B.replay(B.decisions(rows, "cpu_percent", PLAIN)), B.replay(B.decisions(rows, "cpu_percent", layout)))


def test_cooldown(samples):
    alerts = samples.where("cpu_percent > 80").select("series_key", "id", "ts")
    layout = hot_layout(alerts)
    for wait in (3600, 40_000):
        same(D.cooldown(alerts, ["series_key"], "ts", "id", wait, PLAIN), D.cooldown(alerts, ["series_key"], "ts", "id", wait, layout))


def test_percentiles(samples):
    probs = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    for value in ("cpu_percent", "mem_percent"):  # mem_percent has many ties
        for keys in (["series_key", "hour"], []):
            df = samples.withColumn("hour", F.date_trunc("day", "ts"))
            same(direct_percentiles(df, keys, value, probs), sliced_percentiles(df, keys, value, probs, 17))


def test_rollup_and_drift_of_full_groups(samples):
    same(T.rollup(samples, "1 day", ["cpu_percent"], layout=PLAIN), T.rollup(samples, "1 day", ["cpu_percent"], group_rows=50))
    parted = D.tail_split(samples, 200)
    same(D.psi(parted, "cpu_percent", layout=PLAIN), D.psi(parted, "cpu_percent", group_rows=100))


def test_many_short_series_are_not_cut(spark):
    """A table larger than a slice is cut only if one of its series is longer than a block."""
    short = spark.range(900).select((F.col("id") % 90).cast("string").alias("series_key"), F.timestamp_seconds("id").alias("ts"))
    long = short.unionByName(spark.range(31).select(F.lit("x").alias("series_key"), F.timestamp_seconds("id").alias("ts")))
    for sizes, table, single in ((Sizes(100, 30, 20), short, True), (Sizes(100, 30, 20), long, False), (Sizes(100, 30, 20, 0), short, False)):
        mark = SIZES.set(sizes)
        try:
            assert Layout.plan(table).single == single
        finally:
            SIZES.reset(mark)


def test_summaries_of_short_blocks_leave_together(spark, monkeypatch):
    """One frame for hundreds of short blocks, not one for each; a block's rows are those it has alone."""
    blocks = spark.createDataFrame([], "series_key string, block bigint, values array<double>")
    monkeypatch.setattr(type(blocks), "mapInPandas", lambda self, fold, schema: fold)
    fold = Y.fold_blocks(blocks, ["series_key"], [10.0, 20.0, 30.0])
    given = pd.DataFrame({"series_key": [f"s{k}" for k in range(500)], "block": range(500), "values": [[float(k % 7 * j % 40) for j in range(1 + k % 9)] for k in range(500)]})
    frames = list(fold([given]))
    assert len(frames) == 1 and len(frames[0]) == 1500
    for k in (0, 13, 499):
        alone = next(fold([given.iloc[k : k + 1]]))
        assert frames[0].iloc[3 * k : 3 * k + 3].reset_index(drop=True).equals(alone)
    assert list(fold([given.iloc[:0]])) == []


def test_gate_and_cadence_take_the_deltas_once(spark, samples, monkeypatch):
    typed, taken = coerce(samples), []
    layout, arrival = Layout.plan(typed, rows_per_slice=300, block_rows=250), Layout.plan(typed, "id", rows_per_slice=300, block_rows=250)
    real = G.deltas
    for module in (G, gate):
        monkeypatch.setattr(module, "deltas", lambda df, by: taken.append(1) or real(df, by), raising=False)
    gate.run_checks(typed, "2024-01-25", layout, arrival=arrival)
    assert len(taken) == 1
    # the median reads what was written once, not the window again
    plan = G.detect_cadence(samples, layout, group_rows=10**9)._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" not in plan

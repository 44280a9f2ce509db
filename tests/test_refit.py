"""Refits from running sums against a fit at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import refit
from tidewatch.operators.features import LABEL
from tidewatch.operators.ordering import SIZES, Layout, Sizes
from tidewatch.params import DEFAULTS

PARAMS = DEFAULTS.with_(horizon=2, retrain_every=3, safety_window=4, lags=(0, 1), min_train_rows=5)
NAMES = ["a", "b", "c"]


@pytest.mark.parametrize("together", [1, 4, 1_000])
def test_running_sums_equal_single_fits(spark, together):
    rng = np.random.default_rng(5)
    rows, decided = [], []
    for key, n, gaps in (("x", 120, 0.0), ("y", 90, 0.5), ("short", 9, 0.0)):
        for at in range(n):
            if rng.random() >= gaps:
                a, b, c = rng.normal(size=3)
                rows.append((key, at, *map(float, (a, b, c, 2 * a - b + 0.3 * rng.normal()))))
        decided += [(key, step) for step in range((n - PARAMS.warmup) // PARAMS.horizon)]
    decided.append(("rowless", 0))
    placed = spark.createDataFrame(rows, f"series_key string, at long, a double, b double, c double, {LABEL} double")
    steps = spark.createDataFrame(decided, "series_key string, step long")
    got = {(r.series_key, r.block): r for r in refit.refit_weights(placed, steps, NAMES, Layout.plan(placed.withColumn("ts", F.timestamp_seconds("at"))), PARAMS, together=together).collect()}
    want = {}
    for key, block in {(k, s // PARAMS.retrain_every) for k, s in decided}:
        begins = PARAMS.warmup + block * PARAMS.retrain_every * PARAMS.horizon
        seen = np.array([r[2:] for r in rows if r[0] == key and r[1] + PARAMS.target_shift < begins])
        if len(seen) >= PARAMS.min_train_rows:
            x, y = seen[:, :3], seen[:, 3]
            mean = x.mean(axis=0)
            w = np.linalg.solve((x - mean).T @ (x - mean) + PARAMS.ridge_alpha * np.eye(3), (x - mean).T @ (y - y.mean()))
            want[key, block] = (len(seen), *w, y.mean() - mean @ w)
    assert set(got) == set(want) and len(want) > 20
    for k, w in want.items():
        assert got[k].trained_rows == w[0]
        assert np.allclose([*got[k].weights, got[k].intercept], w[1:])


def test_no_rows_and_no_decisions(spark):
    placed = spark.createDataFrame([], f"series_key string, at long, a double, b double, c double, {LABEL} double")
    some, none = spark.createDataFrame([("x", 0)], "series_key string, step long"), spark.createDataFrame([], "series_key string, step long")
    layout = Layout.plan(placed.withColumn("ts", F.timestamp_seconds("at")))
    assert refit.refit_weights(placed, some, NAMES, layout, PARAMS).collect() == []
    assert refit.refit_weights(placed, none, NAMES, layout, PARAMS).collect() == []


def test_rows_are_placed_among_all_cleaned_rows(spark):
    done = spark.sql("SELECT k AS series_key, timestamp_seconds(id * 5) AS ts FROM range(40) CROSS JOIN (SELECT explode(array('x', 'y')) AS k)")
    rows = done.where("unix_seconds(ts) % 15 = 0")
    for sizes in (SIZES.get(), Sizes(slice_rows=10, block_rows=10, group_rows=10)):
        mark = SIZES.set(sizes)
        try:
            got = refit.with_place(done, rows, Layout.plan(done)).collect()
        finally:
            SIZES.reset(mark)
        assert len(got) == 28 and all(r.ts.timestamp() == r["at"] * 5 for r in got)

"""Hand-computed results on tables of a few rows."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch import params as PR
from tidewatch.functions import columns as C
from tidewatch.operators import cadence as G
from tidewatch.operators import clean as K
from tidewatch.operators import contract as CT
from tidewatch.operators import cost as Y
from tidewatch.operators import drift as D
from tidewatch.operators import encode as E
from tidewatch.operators import features as X
from tidewatch.operators import forest as W
from tidewatch.operators import gate
from tidewatch.operators import models as ML
from tidewatch.operators import registry as J
from tidewatch.operators import serving as P
from tidewatch.operators import transform as T
from tidewatch.operators.ordering import Layout
from tidewatch.params import DEFAULTS
from tidewatch.sources import readers as R

ONE = Layout()
T0 = datetime(2024, 1, 1)
CPU = CT.Contract((CT.METRICS.rules[1], CT.METRICS.rules[2]))


def series(spark, values, step=3, stamps=None, name="a"):
    stamps = stamps or [i * step for i in range(len(values))]
    rows = [(name, i, T0 + timedelta(seconds=s), None if v is None else float(v)) for i, (s, v) in enumerate(zip(stamps, values))]
    return spark.createDataFrame(rows, "series_key string, id bigint, ts timestamp, cpu_percent double")


def cadence_of(spark, value):
    return spark.createDataFrame([("a", float(value))], "series_key string, cadence double")


def col(df, *names, order="ts"):
    rows = df.orderBy(order).select(*names).collect()
    return [r[0] if len(names) == 1 else tuple(r) for r in rows]


def test_gap_boundary(spark):
    df = series(spark, [1.0, 1.0, 1.0, 1.0], stamps=[0, 3, 9, 16])
    seg = G.segment(df, cadence_of(spark, 3), ONE)
    assert col(seg, "segment_id") == [0, 0, 0, 1]
    assert col(G.find_gaps(df, cadence_of(spark, 3), ONE), "gap_seconds", "missed_samples", order="gap_start") == [(7.0, 1)]


def test_cadence_needs_three_samples(spark):
    assert G.detect_cadence(series(spark, [1.0, 2.0], step=60), ONE).first().cadence == 3.0
    assert G.detect_cadence(series(spark, [1.0, 2.0, 3.0], step=60), ONE).first().cadence == 60.0


def test_regrid(spark):
    df = series(spark, [1.0, 2.0, 3.0], stamps=[1, 4, 11]).withColumns({"cadence": F.lit(3.0), "segment_id": F.lit(0), "pos": F.col("id")})
    out = K.regrid(df, ONE, CPU, DEFAULTS.with_(gap_multiple=10.0))
    assert col(out, "cpu_percent", "is_imputed") == [(1.0, 0), (2.0, 0), (None, 1), (3.0, 0)]


def test_deduplicate(spark):
    df = series(spark, [10.0, 20.0, 5.0], stamps=[0, 0, 3])
    assert col(K.deduplicate(df, CPU), "cpu_percent") == [15.0, 5.0]


def test_bounded_interpolation(spark):
    given = [None, 1, *[None] * 8, 10, None, None, 13, None]
    want = [None, 1, 2, 3, 4, None, None, 7, 8, 9, 10, 11, 12, 13, None]
    df = series(spark, given).withColumns({"segment_id": F.lit(0), "slot": F.col("id")})
    assert col(K.impute(df, ONE, CPU), "cpu_percent") == want


def test_interpolation_with_edges(spark):
    df = series(spark, [None, 1.0, None, 3.0, None]).withColumns({"segment_id": F.lit(0), "slot": F.col("id"), "cpu_percent_is_outlier": F.when(F.col("id") == 2, 1).otherwise(0)})
    out = K.repair_outliers(df, ONE, CPU, DEFAULTS.with_(outlier_strategy="interpolate"))
    assert col(out, "cpu_percent") == [1.0, 1.0, 2.0, 3.0, 3.0]


def test_hampel(spark):
    df = series(spark, [10.0, 11, 10, 12, 95, 11, 10, 11, 12, 10, 11]).withColumns({"segment_id": F.lit(0), "slot": F.col("id")})
    assert col(K.flag_outliers(df, ONE, CPU), "is_outlier") == [0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0]


def smoothed(spark, values, span, layout=ONE):
    """Exponential mean of one segment, in plain windows or in blocks."""
    df = series(spark, values).withColumns({"segment_id": F.lit(0), "at": F.col("id")})
    return col(T.exponential_means(df, {"y": ("cpu_percent", span)}, layout), "y")


@pytest.mark.parametrize("span,want", [(3, [10, 15, 22.5, 31.25]), (10, [10, 11.818182, 15.123967, 19.646882])])
def test_ewma(spark, span, want):
    assert smoothed(spark, [10.0, 20.0, 30.0, 40.0], span) == pytest.approx(want, abs=1e-6)


def test_ewma_after_a_null(spark):
    """A gap of one ages the mean once more: (0.25*10 + 0.5*40) / 0.75."""
    assert smoothed(spark, [10.0, None, 40.0], 3) == pytest.approx([10.0, 10.0, 30.0])


@pytest.mark.parametrize("layout", [ONE, Layout((1e15,), 7), Layout((1e15,), 64)])
def test_ewma_over_long_runs_of_nulls(spark, layout):
    """A row at a time, over a run of 500 nulls, a null start and 300 dense rows; blocks of any size agree."""
    rng = random.Random(6)
    values = [None, None, *[rng.uniform(0, 100) for _ in range(40)], *[None] * 500, 80.0, *[rng.choice([None, rng.uniform(-50, 50)]) for _ in range(60)], *[rng.uniform(0, 9) for _ in range(300)]]
    a, want, y, w = 2.0 / 11, [], None, 1.0
    for x in values:
        aged = w * (1 - a)
        if y is None:
            y, w = x, 1.0
        elif x is None:
            w = aged
        else:
            y, w = (aged * y + a * x) / (aged + a), 1.0
        want.append(y)
    got = smoothed(spark, values, 10, layout)
    assert [g is None for g in got] == [v is None for v in want]
    assert [g for g in got if g is not None] == pytest.approx([v for v in want if v is not None], abs=1e-9)


def test_rolling_std(spark):
    df = series(spark, [10.0, 20.0, 30.0, 40.0])
    w = Window.partitionBy("series_key").orderBy("ts")
    got = col(df.withColumns(X.rolling_columns("cpu_percent", w, 10)), "cpu_percent_roll_std")
    assert got[0] is None and got[1:] == pytest.approx([7.071068, 10, 12.909944], abs=1e-6)


def test_regimes(spark):
    df = series(spark, [0.0, 14.999, 15.0, 79.9, 80.0, 100.0, 100.1, None])
    got = col(df.withColumn("r", C.regime_label("cpu_percent")), "r")
    assert got == ["idle", "idle", "ramp", "ramp", "saturated", "saturated", "unknown", "unknown"]


def test_onehot_of_one_row(spark):
    out = E.encode(spark.createDataFrame([(" ramp ",)], "regime string")).first().asDict()
    assert [out[f"regime_{w}"] for w in ("idle", "ramp", "saturated", "unknown")] == [0, 1, 0, 0]


def test_breaches(spark):
    df = series(spark, [50.0, 90, 95, 50, 91, 50, 99, 99])
    for rows in (1, 2, 3, 100):
        r = Y.breach_stats(df, "cpu_percent", 90.0, ONE, rows=rows).first()
        assert (r.samples, r.breaches, r.breach_rate, r.episodes, r.longest_episode, r.worst_overshoot) == (8, 4, 50.0, 3, 2, 9.0)


def floor_by_search(start, values, limit=5.0, step=0.5):
    for level in np.arange(start, 100.0 + step, step):
        if round(100.0 * np.sum(values > level) / len(values), 3) <= limit:
            return round(float(min(level, 100.0)), 2)
    return 100.0


def test_safety_floor(spark):
    rng = np.random.default_rng(1)
    cases = [(40.0, list(range(1, 101)))] + [(float(rng.uniform(0, 110)), rng.uniform(0, 120, size=int(n)).round(2).tolist()) for n in rng.integers(1, 101, size=200)]
    df = spark.createDataFrame([(i, c, [float(v) for v in vs]) for i, (c, vs) in enumerate(cases)], "i int, c double, recent array<double>")
    got = [r.f for r in df.withColumn("f", C.safety_floor("c", "recent")).orderBy("i").select("f").collect()]
    assert got[0] == 95.0
    assert got == pytest.approx([floor_by_search(c, np.asarray(vs, float)) for c, vs in cases], abs=1e-9)


def test_safety_floor_without_history(spark):
    df = spark.createDataFrame([(41.237, [])], "c double, recent array<double>")
    assert df.select(C.safety_floor("c", "recent")).first()[0] == 41.24


def test_psi(spark):
    rows = [("a", float(v), "reference") for v in range(100)] + [("a", float(v), "current") for v in range(50, 100)]
    df = spark.createDataFrame(rows, "series_key string, v double, part string")
    assert D.psi(df, "v").first().psi == pytest.approx(6.103, abs=1e-4)


def test_splits(spark):
    rows = X.numbered(series(spark, [1.0] * 101), ONE)
    assert X.split_rows(rows).where("split = 'train'").count() == 80
    f = X.folds(rows).orderBy("fold").collect()
    assert [(r.train_rows, r.train_rows + r.test_rows) for r in f] == [(40, 55), (55, 70), (70, 85), (85, 101)]


def test_price_of_the_full_node(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in Y.node_cost({}).items()]).first()
    assert (row.cost_cpu_percent, row.cost_mem_percent, row.cost_disk_read_mb_s, row.cost_total) == (236.40, 103.84, 40.0, 380.24)


def test_gate_summary(spark):
    rows = [("a", "PASS")] * 11 + [("a", "WARN")] * 2
    checks = spark.createDataFrame(rows, "series_key string, status string")
    r = gate.summarise(checks).first()
    assert (r.passed, r.warned, r.failed, r.verdict, r.should_proceed) == (11, 2, 0, "WARN", True)
    strict = gate.summarise(checks, DEFAULTS.with_(fail_on_warn=True)).first()
    assert (strict.verdict, strict.should_proceed) == ("FAIL", False)


def test_promotion_treats_zero_as_a_measure(spark):
    schema = "target string, model_id string, mae double, baseline_mae double, cv_folds_won_fraction double, cv_mae_std double, cv_baseline_mae_std double, champion_mae_same_window double, error string"
    rows = [("a", "m", 5.0, 5.0, 1.0, 1.0, 1.0, None, None), ("b", "m", 0.1, 0.0, 1.0, 1.0, 1.0, None, None), ("c", "m", 4.0, 5.0, 1.0, 1.0, 1.0, None, None)]
    none = spark.createDataFrame([], "target string, model_id string, mae double")
    got = {r.target: r.promote for r in J.judge(spark.createDataFrame(rows, schema), none).collect()}
    assert got == {"a": False, "b": False, "c": True}


def test_horizon_band(spark):
    latest = spark.createDataFrame([("a", T0, 50.0, 2.0)], "series_key string, ts timestamp, current double, mae double")
    step5 = P.horizon_forecast(latest).where("step = 5").first()
    assert (step5.lower_bound, step5.upper_bound) == (46.08, 53.92)


def test_ridge_against_numpy(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=60)
    df = spark.createDataFrame([("a", *map(float, r), float(t)) for r, t in zip(x, y)], "series_key string, f0 double, f1 double, f2 double, target_next double")
    got = ML.fit_ridge(df, ["f0", "f1", "f2"], 1.0).first()
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    assert got.weights == pytest.approx(w.tolist())
    assert got.intercept == pytest.approx(float(y.mean() - x.mean(0) @ w))


def test_cooldown_depends_on_the_last_accepted(spark):
    df = series(spark, [1.0] * 5, stamps=[0, 400, 700, 1200, 1400]).select("series_key", "id", "ts")
    assert col(D.cooldown(df, ["series_key"], "ts", "id", 600, ONE), "accepted") == [True, False, True, False, True]


def test_tuning_samples_are_distinct_and_bounded():
    grid = {"a": (1, 2), "b": (1, 2)}
    picks = ML.sample_grid(grid, 10)
    assert len(picks) == 4 and len({tuple(p.items()) for p in picks}) == 4


def test_sources(spark, tmp_path):
    series(spark, [1.0, 2.0]).write.parquet(f"{tmp_path}/t")
    out = R.get_source(spark, f"table://{tmp_path}/t")
    assert out.columns[: len(CT.METRICS.columns)] == CT.METRICS.columns and out.columns[-1] == "series_key"
    for spec in ("nothing", "ftp://x"):
        with pytest.raises(ValueError):
            R.get_source(spark, spec)
    with pytest.raises(Exception):
        R.read_csv(spark, f"{tmp_path}/missing").count()
    (tmp_path / "list.json").write_text('[{"ts": "2024-01-01 00:00:00", "cpu_percent": 1.5}]')
    (tmp_path / "dict.json").write_text('{"data": [{"ts": "2024-01-01 00:00:00", "cpu_percent": 1.5}]}')
    for name in ("list", "dict"):
        assert R.read_json(spark, f"{tmp_path}/{name}.json").first().cpu_percent == 1.5


def test_params_from_a_table(spark):
    rows = [("horizon", "20.0", "int"), ("fail_on_warn", "yes", "bool"), ("lags", "[0, 1]", "json"), ("other", "x", "str")]
    got = PR.load(spark.createDataFrame(rows, "key string, value string, value_type string"))
    assert (got.horizon, got.fail_on_warn, got.lags) == (20, True, (0, 1))


def test_segments_do_not_see_each_other(spark):
    """Changing one segment leaves the features of all others as they are."""
    base = series(spark, [float(i % 7) for i in range(60)], stamps=[i * 3 + (1000 if i >= 30 else 0) for i in range(60)])
    base = base.withColumns({"mem_percent": F.lit(1.0), "disk_read_mb_s": F.lit(1.0), "segment_id": F.when(F.col("id") >= 30, 1).otherwise(0), "slot": F.col("id")})
    bumped = base.withColumn("cpu_percent", F.when(F.col("segment_id") == 0, F.col("cpu_percent") * 3 + 1).otherwise(F.col("cpu_percent")))
    frames = [X.feature_frame(df, "cpu_percent", ONE).where("segment_id = 1") for df in (base, bumped)]
    assert frames[0].orderBy("ts").collect() == frames[1].orderBy("ts").collect()


def test_stored_forest_is_the_fitted_one(spark):
    """A boosted model and its rows predict alike; a missing feature or an unknown key gives null."""
    rng = random.Random(8)
    rows = [("a", i, rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(300)]
    train = spark.createDataFrame([(*r, r[2] * 2 + (r[3] > 4) * 5) for r in rows], "series_key string, rn long, x double, y double, target_next double")
    model = ML.fit_boosting(train, ["x", "y"], n_estimators=6, max_depth=3, learning_rate=0.3)
    stored = W.packed(W.forest_rows(model, ["x", "y"], spark).withColumn("series_key", F.lit("a")), ["series_key"])
    want = {r["rn"]: r["predicted"] for r in ML.predict(model, train, ["x", "y"]).collect()}
    got = {r["rn"]: r["predicted"] for r in W.predict_forest(train, stored).collect()}
    assert got == pytest.approx(want) and stored.first()["needs"] == ["x", "y"]
    odd = spark.createDataFrame([("a", 1, 2.0, None), ("b", 2, 2.0, 3.0)], "series_key string, rn long, x double, y double")
    assert {r["predicted"] for r in W.predict_forest(odd, stored).collect()} == {None}
    again = W.rescore_champions(train, stored).first()
    mean = sum(abs(want[r["rn"]] - r["target_next"]) for r in train.collect()) / 300
    assert again["champion_mae_same_window"] == pytest.approx(mean, abs=1e-4) and again["rows_scored"] == 300

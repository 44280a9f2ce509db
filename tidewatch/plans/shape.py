"""Queries: transform, encoding, rollups, features, splits and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import cadence as G
from tidewatch.operators import clean as K
from tidewatch.operators import encode as E
from tidewatch.operators import features as X
from tidewatch.operators import scoring as Z
from tidewatch.operators import transform as T
from tidewatch.operators.drift import tail_split
from tidewatch.operators.ordering import settle
from tidewatch.params import DEFAULTS
from tidewatch.plans import stages as S
from tidewatch.plans import views as V
from tidewatch.plans.catalog import nudge, query, rounded, with_ctes
from tidewatch.sources import writers as W

M = V.metrics_sql()
USERS = V.metrics_sql("user_id")
HCHAIN = [M, V.HOURLY_SQL, *S.to_clean("hourly")]
REGIME = V.regime_sql()
WORDS = ("idle", "ramp", "saturated", "unknown")
TARGET = "cpu_percent"
FEATS = [*HCHAIN, S.features_sql(TARGET)]
USABLE = [*FEATS, S.usable_sql(TARGET)]


def cleaned(spark, d):
    raw = V.hourly(spark, d)
    layout = V.plan(raw)
    return settle(K.clean(raw, layout), layout), layout


def framed(spark, d, target=TARGET, params=DEFAULTS):
    """(feature frame, feature names, layout) of the hourly series."""
    done, layout = cleaned(spark, d)
    return X.feature_frame(done, target, layout, params), X.feature_names(target, done.columns, params), layout


def usable(spark, d, target=TARGET):
    frame, names, layout = framed(spark, d, target)
    return X.numbered(X.training_rows(frame, names), layout), names, layout


# -- transform ---------------------------------------------------------------

DERIVED = [f"{t}_{n}" for t in S.TARGETS for n in ("delta", "roll_std", "ewma_fast", "ewma_slow", "trend", "headroom")]


def derived_sql(base: str) -> str:
    w = "PARTITION BY series_key, segment_id ORDER BY ts"
    f = f"({w} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
    parts = ", ".join(
        f"{t} - lag({t}) OVER ({w}) AS {t}_delta, CASE WHEN count({t}) OVER {f} >= 2 THEN stddev_samp({t}) OVER {f} END AS {t}_roll_std, "
        f"{S.ewma_sql(t, 3)} AS {t}_ewma_fast, {S.ewma_sql(t, 10)} AS {t}_ewma_slow, 100.0 - {t} AS {t}_headroom"
        for t in S.TARGETS
    )
    return f"d1 AS (SELECT *, {parts} FROM {base}), derived AS (SELECT *, {S.each('{c}_ewma_fast - {c}_ewma_slow AS {c}_trend', S.TARGETS)} FROM d1)"


@query("derived_hourly", with_ctes([*HCHAIN, derived_sql("clean")], f"SELECT series_key, ts, {rounded(*DERIVED)} FROM derived"))
def derived_hourly(spark, d):
    done, layout = cleaned(spark, d)
    return T.add_derived(done, layout).select("series_key", "ts", *DERIVED)


@query("derived_daily", with_ctes([V.DAILY_SQL, *S.to_clean("daily"), derived_sql("clean")], f"SELECT series_key, ts, {rounded(*DERIVED)} FROM derived"))
def derived_daily(spark, d):
    raw = V.daily(spark, d)
    layout = V.plan(raw)
    return T.add_derived(settle(K.clean(raw, layout), layout), layout).select("series_key", "ts", *DERIVED)


@query("unit_columns", with_ctes([M], f"SELECT series_key, id, {nudge('mem_used_mb / 1024.0')} AS mem_used_gb, {nudge('cpu_percent / 100.0')} AS cpu_percent_fraction, {nudge('mem_percent / 100.0')} AS mem_percent_fraction FROM metrics"))
def unit_columns(spark, d):
    return T.normalise_units(V.metrics(spark, d)).select("series_key", "id", "mem_used_gb", "cpu_percent_fraction", "mem_percent_fraction")


@query("regime_labels", with_ctes([M], f"SELECT series_key, id, {REGIME} AS regime FROM metrics"))
def regime_labels(spark, d):
    return T.label_regimes(V.metrics(spark, d)).select("series_key", "id", "regime")


@query(
    "regime_occupancy",
    with_ctes([M, f"l AS (SELECT series_key, {REGIME} AS regime FROM metrics)", "c AS (SELECT series_key, regime, count(*) AS rows FROM l GROUP BY ALL)"],
              "SELECT series_key, regime, rows, round(100.0 * rows / sum(rows) OVER (PARTITION BY series_key), 1) AS pct FROM c"),
)
def regime_occupancy(spark, d):
    return T.regime_occupancy(T.label_regimes(V.metrics(spark, d)))


@query("demand_scaled", with_ctes([M], f"SELECT series_key, id, {nudge('cpu_percent * 1.5')} AS cpu_percent FROM metrics"))
def demand_scaled(spark, d):
    return T.scale_column(V.metrics(spark, d), "cpu_percent", 1.5).select("series_key", "id", "cpu_percent")


# -- encoding ----------------------------------------------------------------

_ONEHOT = ", ".join(f"(regime = '{w}')::INT AS regime_{w}" for w in WORDS)
_LABELLED = f"l AS (SELECT series_key, id, {REGIME} AS regime FROM metrics)"
_USERLAB = f"l AS (SELECT series_key, id, {REGIME} AS regime FROM metrics)"


@query("onehot_regime", with_ctes([M, _LABELLED], f"SELECT series_key, id, {_ONEHOT} FROM l"))
def onehot_regime(spark, d):
    return E.encode(T.label_regimes(V.metrics(spark, d))).select("series_key", "id", *[f"regime_{w}" for w in WORDS])


@query("onehot_drop_first", with_ctes([M, _LABELLED], f"SELECT series_key, id, {_ONEHOT.split(', ', 1)[1]} FROM l"))
def onehot_drop_first(spark, d):
    params = DEFAULTS.with_(drop_first=True)
    return E.encode(T.label_regimes(V.metrics(spark, d)), params).select("series_key", "id", *[f"regime_{w}" for w in WORDS[1:]])


@query("ordinal_regime", with_ctes([M, _LABELLED], "SELECT series_key, id, CASE regime WHEN 'idle' THEN 0 WHEN 'ramp' THEN 1 WHEN 'saturated' THEN 2 ELSE 3 END AS regime_ordinal FROM l"))
def ordinal_regime(spark, d):
    params = DEFAULTS.with_(encoding_method="ordinal")
    return E.encode(T.label_regimes(V.metrics(spark, d)), params).select("series_key", "id", "regime_ordinal")


@query(
    "encode_declared_vocabulary",
    "SELECT o_orderkey, " + ", ".join(f"(CASE WHEN trim(o_orderpriority) IN ('1-URGENT', '2-HIGH') THEN trim(o_orderpriority) ELSE 'unknown' END = '{w}')::INT AS \"o_orderpriority_{w}\"" for w in ("1-URGENT", "2-HIGH", "unknown")) + " FROM orders",
)
def encode_declared_vocabulary(spark, d):
    """An explicit vocabulary; everything outside it is unknown."""
    params = DEFAULTS.with_(encoding_columns=("o_orderpriority",), encoding_categories={"o_orderpriority": ("1-URGENT", "2-HIGH")})
    names = E.all_encoded_names(params)
    return E.encode(V.table(spark, d, "orders"), params).select("o_orderkey", *[F.col(f"`{n}`") for n in names])


_SHARES = " UNION ALL ".join(
    f"SELECT series_key, '{w}' AS category, count(*) FILTER (WHERE regime = '{w}') AS rows, {nudge(f'''count(*) FILTER (WHERE regime = '{w}') / count(*)''')} AS share FROM l GROUP BY series_key" for w in WORDS
)


@query("category_shares", with_ctes([USERS, _USERLAB], _SHARES))
def category_shares(spark, d):
    return E.category_shares(T.label_regimes(V.metrics(spark, d, "user_id")), "regime", ["series_key"])


@query("category_shares_from_onehot", with_ctes([USERS, _USERLAB], _SHARES))
def category_shares_from_onehot(spark, d):
    """The same shares when only the encoded columns are left."""
    return E.category_shares(E.encode(T.label_regimes(V.metrics(spark, d, "user_id"))).drop("regime"), "regime", ["series_key"])


@query("encoding_occupancy", with_ctes([M, _LABELLED, f"o AS (SELECT series_key, {_ONEHOT} FROM l)"], " UNION ALL ".join(f"SELECT series_key, 'regime_{w}' AS encoded_column, round(avg(regime_{w}) * 100.0, 1) AS pct FROM o GROUP BY series_key" for w in WORDS)))
def encoding_occupancy(spark, d):
    return E.occupancy(E.encode(T.label_regimes(V.metrics(spark, d))), "regime", ["series_key"])


# -- rollups -----------------------------------------------------------------


def _rollup_sql(interval: str, base: str, cols, keys: str = "series_key") -> str:
    stats = ", ".join(f"avg({c}) AS {c}_mean, max({c}) AS {c}_max, quantile_cont({c}, 0.95) AS {c}_p95" for c in cols)
    return f"SELECT {keys}, time_bucket(INTERVAL '{interval}', ts) AS ts, {stats}, count(*) AS samples FROM {base} GROUP BY ALL"


_WIDE = [f"{c}_{s}" for c in V.MEASURES for s in ("mean", "max", "p95")]


@query("rollup_hour", with_ctes([M, f"r AS ({_rollup_sql('1 hour', 'metrics', V.MEASURES)})"], f"SELECT series_key, ts, samples, {rounded(*_WIDE)} FROM r"))
def rollup_hour(spark, d):
    raw = V.metrics(spark, d)
    return T.rollup(raw, "1 hour", V.MEASURES, layout=V.plan(raw))


@query("rollup_day_lineitem", with_ctes([V.DAILY_SQL, f"r AS ({_rollup_sql('7 days', 'daily', ('cpu_percent', 'mem_used_mb'))})"], f"SELECT series_key, ts, samples, {rounded('cpu_percent_mean', 'cpu_percent_max', 'cpu_percent_p95', 'mem_used_mb_mean', 'mem_used_mb_max', 'mem_used_mb_p95')} FROM r"))
def rollup_day_lineitem(spark, d):
    """Week-long buckets of all line items; the epoch is the origin of both engines' buckets here."""
    raw = V.daily(spark, d)
    out = T.rollup(raw.withColumn("ts", F.col("ts") - F.expr("INTERVAL 4 DAYS")), "7 days", ("cpu_percent", "mem_used_mb"), layout=V.plan(raw))
    return out.withColumn("ts", F.col("ts") + F.expr("INTERVAL 4 DAYS"))


def _tiers_sql(base: str, cols) -> str:
    out = []
    for tier in DEFAULTS.rollup_tiers:
        for c in cols:
            out.append(
                f"SELECT '{tier}' AS tier, series_key, time_bucket(INTERVAL '{tier}', ts) AS ts, '{c}' AS column_name, {nudge(f'avg({c})')} AS mean_value, {nudge(f'max({c})')} AS max_value, "
                f"{nudge(f'quantile_cont({c}, 0.95)')} AS p95_value, count(*) AS samples FROM {base} GROUP BY series_key, time_bucket(INTERVAL '{tier}', ts)"
            )
    return " UNION ALL ".join(out)


@query("rollup_tiers_long", with_ctes([M], _tiers_sql("metrics", V.MEASURES)))
def rollup_tiers_long(spark, d):
    raw = V.metrics(spark, d)
    return T.build_rollups(raw, V.MEASURES, V.plan(raw))


@query("rollup_load_and_read", with_ctes([M], "SELECT *, CAST(7 AS BIGINT) AS run_id FROM (" + _tiers_sql("metrics", V.MEASURES) + ")"))
def rollup_load_and_read(spark, d):
    """Long rollups written partitioned by run and tier, then read back."""
    raw, path = V.metrics(spark, d), W.shared_folder(spark) + "/rollup"
    W.load_run(T.build_rollups(raw, V.MEASURES, V.plan(raw)), 7, path, ["tier"])
    return W.read_run(spark, path, 7)


@query("rollup_csv_export", with_ctes([M], _tiers_sql("metrics", V.MEASURES)))
def rollup_csv_export(spark, d):
    """Every tier and measure out to CSV and back."""
    raw, path = V.metrics(spark, d), W.shared_folder(spark) + "/rollup_csv"
    W.export_csv(T.build_rollups(raw, V.MEASURES, V.plan(raw)), path, ["tier", "ts", "column_name"])
    schema = "tier string, series_key string, ts timestamp, samples bigint, column_name string, mean_value double, max_value double, p95_value double"
    return spark.read.option("header", True).schema(schema).csv(path)


@query(
    "segment_hourly_rollup",
    with_ctes(
        [USERS, *S.to_segments("metrics"),
         "r AS (SELECT series_key, segment_id, time_bucket(INTERVAL '1 hour', ts) AS ts, avg(cpu_percent) AS cpu_percent_mean, max(cpu_percent) AS cpu_percent_max, quantile_cont(cpu_percent, 0.95) AS cpu_percent_p95, count(*) AS samples FROM seg GROUP BY ALL)"],
        f"SELECT series_key, segment_id, ts, {rounded('cpu_percent_mean', 'cpu_percent_max', 'cpu_percent_p95')}, samples, {V.regime_sql('cpu_percent_mean')} AS regime FROM r",
    ),
)
def segment_hourly_rollup(spark, d):
    raw = V.metrics(spark, d, "user_id")
    layout = V.plan(raw)
    base = K.prepared(raw)
    seg = G.segment(base, G.detect_cadence(base, layout), layout)
    hourly = T.rollup(seg, "1 hour", ["cpu_percent"], ["series_key", "segment_id"], layout)
    return T.label_regimes(hourly, "cpu_percent_mean")


# -- features ----------------------------------------------------------------

_FEATURES = S.feature_cols(TARGET)
_CAL = "hour, minute, second_of_minute, dayofweek"


@query("feature_vectors_cpu", with_ctes(FEATS, f"SELECT series_key, ts, segment_id, {rounded(*_FEATURES, 'target_next')}, {_CAL}, {nudge('mem_percent')} AS mem_percent_now, {nudge('disk_read_mb_s')} AS disk_read_mb_s_now, {', '.join(f'''(({REGIME}) = '{w}')::INT AS regime_{w}''' for w in WORDS)} FROM feat"))
def feature_vectors_cpu(spark, d):
    frame, names, _ = framed(spark, d)
    return frame.select("series_key", "ts", "segment_id", *names, X.LABEL)


_DISK = "disk_read_mb_s"
_DISK_COLS = [f"{_DISK}_lag_{k}" for k in DEFAULTS.lags] + [f"{_DISK}_roll_{s}" for s in X.ROLL_STATS] + [f"{_DISK}_{i}" for i in ("level_x_vol", "slope_x_vol", "steps_to_saturation", "zscore_local")]


@query("feature_vectors_disk", with_ctes([*HCHAIN, S.features_sql(_DISK)], f"SELECT series_key, ts, {rounded(*_DISK_COLS, 'target_next')}, {_CAL}, {nudge('cpu_percent')} AS cpu_percent_now, {nudge('mem_percent')} AS mem_percent_now FROM feat"))
def feature_vectors_disk(spark, d):
    """A forecast target outside the contract's targets: no derived block."""
    params = DEFAULTS.with_(encode_in_model=False)
    frame, names, _ = framed(spark, d, _DISK, params)
    return frame.select("series_key", "ts", *names, X.LABEL)


@query("feature_vectors_users", with_ctes([USERS, *S.to_clean("metrics"), S.features_sql(TARGET)], f"SELECT series_key, ts, segment_id, {rounded(*_FEATURES, 'target_next')} FROM feat"))
def feature_vectors_users(spark, d):
    raw = V.metrics(spark, d, "user_id")
    layout = V.plan(raw)
    frame = X.feature_frame(settle(K.clean(raw, layout), layout), TARGET, layout)
    return frame.select("series_key", "ts", "segment_id", *_FEATURES, X.LABEL)


_SHARE = S.usable_sql(TARGET)


@query("training_summary", with_ctes(USABLE, "SELECT series_key, count(*) AS rows_usable, count(DISTINCT segment_id) AS segments_contributing FROM usable GROUP BY series_key"))
def training_summary(spark, d):
    frame, names, _ = framed(spark, d)
    return X.training_summary(frame, names)


_GB_W = "PARTITION BY series_key ORDER BY ts"
_GB = f"gb AS (SELECT series_key, lag(cpu_percent, 20) OVER ({_GB_W}) AS l20, lead(cpu_percent, 1) OVER ({_GB_W}) AS nxt FROM clean)"


@query(
    "gap_contamination",
    with_ctes(
        [*USABLE, _GB,
         "b AS (SELECT series_key, count(*) FILTER (WHERE l20 IS NOT NULL AND nxt IS NOT NULL) AS gap_blind_rows FROM gb GROUP BY series_key)",
         "u AS (SELECT series_key, count(*) AS rows_usable, count(DISTINCT segment_id) AS segments_contributing FROM usable GROUP BY series_key)"],
        "SELECT series_key, coalesce(rows_usable, 0) AS rows_usable, gap_blind_rows, greatest(gap_blind_rows - coalesce(rows_usable, 0), 0) AS contaminated_rows, coalesce(segments_contributing, 0) AS segments_contributing FROM b LEFT JOIN u USING (series_key)",
    ),
)
def gap_contamination(spark, d):
    done, layout = cleaned(spark, d)
    return X.contamination(done, TARGET, layout)


@query("serving_vectors", with_ctes([*FEATS, f"c AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts DESC) AS k FROM feat WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _FEATURES)})"], f"SELECT series_key, ts, segment_id, {rounded(*_FEATURES)} FROM c WHERE k = 1"))
def serving_vectors(spark, d):
    frame, names, _ = framed(spark, d)
    return X.serving_rows(frame, names).select("series_key", "ts", "segment_id", *_FEATURES)


# -- splits ------------------------------------------------------------------


@query("chronological_split", with_ctes(USABLE, "SELECT series_key, ts, rn, CASE WHEN rn < CAST(floor(n * 0.8::DOUBLE) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM usable"))
def chronological_split(spark, d):
    rows, _, _ = usable(spark, d)
    return X.split_rows(rows).select("series_key", "ts", "rn", "split")


_FOLDS = [
    *USABLE,
    "fs AS (SELECT *, CAST(floor(n * 0.4::DOUBLE) AS BIGINT) AS start FROM usable)",
    "ft AS (SELECT *, CAST(least(floor((rn - start) / nullif((n - start) // 4, 0)), 3) AS INT) AS fold FROM fs WHERE n - start >= 8 AND start > 0 AND rn >= start)",
]


@query("rolling_origin_folds", with_ctes(_FOLDS, "SELECT series_key, fold, min(rn) AS train_rows, count(*) AS test_rows, min(ts) AS test_from, max(ts) AS test_to FROM ft GROUP BY series_key, fold"))
def rolling_origin_folds(spark, d):
    return X.folds(usable(spark, d)[0])


@query("tail_split", with_ctes([USERS, "t AS (SELECT series_key, id, ts, row_number() OVER (PARTITION BY series_key ORDER BY ts DESC, id DESC) AS k, count(*) OVER (PARTITION BY series_key) AS n FROM metrics)"], "SELECT series_key, id, n, CASE WHEN k <= 20 THEN 'current' ELSE 'reference' END AS part FROM t"))
def tail_split_rows(spark, d):
    return tail_split(V.metrics(spark, d, "user_id"), 20, order=("ts", "id")).select("series_key", "id", "n", "part")


# -- baselines and errors ----------------------------------------------------

_LAG = f"{TARGET}_lag_0"
_BASE = [
    *USABLE,
    f"p AS (SELECT *, {_LAG} AS p_persistence, {TARGET}_lag_1 AS p_persistence_lag1, 2 * {_LAG} - {TARGET}_lag_1 AS p_drift, {TARGET}_roll_mean AS p_rolling_mean, "
    f"lag({_LAG}, 80) OVER (PARTITION BY series_key ORDER BY rn) AS p_seasonal_naive FROM usable)",
    "test AS (SELECT * FROM p WHERE rn >= CAST(floor(n * 0.8::DOUBLE) AS BIGINT))",
]
_RUNGS = ("persistence", "persistence_lag1", "drift", "rolling_mean", "seasonal_naive")
_LADDER = "ladder AS (" + " UNION ALL ".join(
    f"SELECT series_key, '{r}' AS baseline, round(avg(abs(target_next - p_{r})), 4) AS mae, round(sqrt(avg((target_next - p_{r}) ** 2)), 4) AS rmse FROM test GROUP BY series_key HAVING count(p_{r}) > 0" for r in _RUNGS
) + ")"


def predictions(spark, d):
    rows, names, layout = usable(spark, d)
    return Z.baseline_predictions(rows, TARGET, layout), names, layout


@query("baseline_predictions", with_ctes(_BASE, f"SELECT series_key, ts, rn, {rounded(*[f'p_{r}' for r in _RUNGS])} FROM p"))
def baseline_predictions(spark, d):
    out, _, _ = predictions(spark, d)
    return out.select("series_key", "ts", "rn", *[f"p_{r}" for r in _RUNGS])


@query("baseline_ladder", with_ctes([*_BASE, _LADDER], "SELECT * FROM ladder"))
def baseline_ladder(spark, d):
    return Z.ladder(Z.split_test(predictions(spark, d)[0]))


@query("best_baseline", with_ctes([*_BASE, _LADDER], "SELECT series_key, first(baseline ORDER BY mae, baseline) AS baseline, min(mae) AS mae FROM ladder GROUP BY series_key"))
def best_baseline(spark, d):
    return Z.best_baseline(Z.ladder(Z.split_test(predictions(spark, d)[0])))


@query("error_by_regime", with_ctes(_BASE, f"SELECT series_key, {REGIME} AS regime, count(*) AS rows, round(avg(abs(target_next - p_persistence)), 4) AS mae, round(max(abs(target_next - p_persistence)), 4) AS worst FROM test GROUP BY ALL"))
def error_by_regime(spark, d):
    test = Z.split_test(predictions(spark, d)[0])
    return Z.error_by_regime(test.withColumn("abs_error", F.abs(F.col(X.LABEL) - F.col("p_persistence"))))


_FOLDP = [*_BASE, "fs AS (SELECT *, CAST(floor(n * 0.4::DOUBLE) AS BIGINT) AS start FROM p)",
          "ft AS (SELECT *, CAST(least(floor((rn - start) / nullif((n - start) // 4, 0)), 3) AS INT) AS fold FROM fs WHERE n - start >= 8 AND start > 0 AND rn >= start)",
          "sc AS (SELECT series_key, fold, avg(abs(target_next - p_rolling_mean)) AS model, avg(abs(target_next - p_persistence)) AS base FROM ft GROUP BY ALL)"]


@query("fold_scores", with_ctes(_FOLDP, f"SELECT series_key, fold, {rounded('model', 'base')} FROM sc"))
def fold_scores(spark, d):
    return Z.fold_scores(predictions(spark, d)[0], {"model": "p_rolling_mean", "base": "p_persistence"})


@query(
    "cv_summary",
    with_ctes(_FOLDP, "SELECT series_key, count(*) AS cv_folds, round(avg(model), 4) AS cv_mae_mean, round(stddev_pop(model), 4) AS cv_mae_std, round(avg(base), 4) AS cv_baseline_mae_mean, round(stddev_pop(base), 4) AS cv_baseline_mae_std, "
              "count(*) FILTER (WHERE model < base) AS cv_folds_won, round(avg((model < base)::INT), 3) AS cv_folds_won_fraction FROM sc GROUP BY series_key"),
)
def cv_summary(spark, d):
    scores = Z.fold_scores(predictions(spark, d)[0], {"model": "p_rolling_mean", "base": "p_persistence"})
    return Z.cv_summary(scores, "model", "base")


@query(
    "improvement_and_flatness",
    with_ctes([*_BASE, _LADDER, "w AS (SELECT series_key, max(mae) FILTER (WHERE baseline = 'persistence') AS ref, max(mae) FILTER (WHERE baseline = 'rolling_mean') AS m FROM ladder GROUP BY series_key)"],
              "SELECT series_key, CASE WHEN ref > 0 THEN round((ref - m) / ref * 100.0, 2) END AS improvement_pct, coalesce(ref < 0.5, false) AS flat_signal FROM w"),
)
def improvement_and_flatness(spark, d):
    table = Z.ladder(Z.split_test(predictions(spark, d)[0]))
    at = lambda n: F.max(F.when(F.col("baseline") == n, F.col("mae")))
    wide = table.groupBy("series_key").agg(at("persistence").alias("ref"), at("rolling_mean").alias("m"))
    return wide.select("series_key", Z.improvement(F.col("ref"), F.col("m")).alias("improvement_pct"), Z.flat_signal(F.col("ref")).alias("flat_signal"))


# -- scaling and screening ---------------------------------------------------

_SC = (f"{TARGET}_lag_0", f"{TARGET}_roll_std", f"{TARGET}_headroom", "minute")
_TRAIN = "train AS (SELECT * FROM usable WHERE rn < CAST(floor(n * 0.8::DOUBLE) AS BIGINT))"
_FIT = {
    "standard": "avg({c}) AS centre, stddev_samp({c}) AS spread",
    "minmax": "min({c})::DOUBLE AS centre, (max({c}) - min({c}))::DOUBLE AS spread",
    "robust": "quantile_cont({c}::DOUBLE, 0.5) AS centre, quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25) AS spread",
}


def _fit_sql(method: str) -> str:
    rows = " UNION ALL ".join(f"SELECT series_key, '{c}' AS feature, {_FIT[method].format(c=c)} FROM train GROUP BY series_key" for c in _SC)
    return f"fit0 AS ({rows}), fit AS (SELECT series_key, feature, centre, CASE WHEN abs(spread) >= 1e-12 THEN spread ELSE 1.0 END AS spread FROM fit0)"


def _register_scaler(method: str) -> None:
    @query(f"scaler_fit_{method}", with_ctes([*USABLE, _TRAIN, _fit_sql(method)], f"SELECT series_key, feature, {rounded('centre', 'spread')} FROM fit"))
    def fit(spark, d):
        rows, _, layout = usable(spark, d)
        return Z.fit_scaler(Z.split_train(rows), _SC, method, layout=layout)


for _m in _FIT:
    _register_scaler(_m)


@query(
    "scaler_apply_standard",
    with_ctes([*USABLE, _TRAIN, _fit_sql("standard"), "m AS (SELECT series_key, " + ", ".join(f"max(centre) FILTER (WHERE feature = '{c}') AS c_{i}, max(spread) FILTER (WHERE feature = '{c}') AS s_{i}" for i, c in enumerate(_SC)) + " FROM fit GROUP BY series_key)"],
              "SELECT series_key, rn, " + ", ".join(f"{nudge(f'({c} - c_{i}) / s_{i}')} AS {c}" for i, c in enumerate(_SC)) + " FROM usable JOIN m USING (series_key)"),
)
def scaler_apply_standard(spark, d):
    rows, _, layout = usable(spark, d)
    scaler = Z.fit_scaler(Z.split_train(rows), _SC, "standard", layout=layout)
    return Z.apply_scaler(rows, scaler, _SC).select("series_key", "rn", *_SC)


_SCREEN = [*_FEATURES, "hour", "minute"]


@query(
    "feature_cardinality",
    with_ctes(USABLE, " UNION ALL ".join(f"SELECT '{c}' AS feature, {nudge(f'var_samp({c}::DOUBLE)')} AS variance, count(DISTINCT {c}) AS distinct_values, coalesce(var_samp({c}::DOUBLE) > 1e-6, false) AS kept FROM usable HAVING count(*) > 0" for c in ("minute", "hour", "dayofweek", f"{TARGET}_lag_0"))),
)
def feature_cardinality(spark, d):
    return Z.cardinality(usable(spark, d)[0], ["minute", "hour", "dayofweek", f"{TARGET}_lag_0"])


_CORR = [f"{TARGET}_lag_0", f"{TARGET}_lag_1", f"{TARGET}_roll_mean", f"{TARGET}_roll_std", f"{TARGET}_ewma_fast", f"{TARGET}_ewma_slow", f"{TARGET}_headroom", "hour"]


@query("correlation_pairs", with_ctes(USABLE, " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {nudge(f'corr({a}, {b})')} AS r FROM usable" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :])))
def correlation_pairs(spark, d):
    return Z.correlation_pairs(usable(spark, d)[0], _CORR)


@query(
    "correlation_screen",
    with_ctes(
        [*USABLE, "c AS (SELECT corr(cpu_percent_lag_0, cpu_percent_headroom) AS r FROM usable)"],
        "SELECT feature, CASE WHEN feature = 'cpu_percent_headroom' AND (SELECT abs(r) >= 0.95 FROM c) THEN false ELSE true END AS kept FROM (VALUES "
        + ", ".join(f"('{c}')" for c in (f"{TARGET}_headroom", f"{TARGET}_lag_0", "hour"))
        + ") v(feature)",
    ),
)
def correlation_screen(spark, d):
    """headroom mirrors lag_0; the protected one stays although it comes later."""
    cols = [f"{TARGET}_headroom", f"{TARGET}_lag_0", "hour"]
    rows = usable(spark, d)[0]
    kept, _ = Z.correlation_screen(cols, Z.correlation_pairs(rows, cols), protected=[f"{TARGET}_lag_0"])
    listed = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(c in kept).alias("kept")) for c in cols])
    return spark.range(1).select(F.inline(listed))


@query("features_csv_export", with_ctes(FEATS, f"SELECT series_key, ts, {rounded(*S.feature_cols(TARGET))} FROM feat"))
def features_csv_export(spark, d):
    """Feature vectors out to CSV and back."""
    frame, _, _ = framed(spark, d)
    rows, path = frame.select("series_key", "ts", *S.feature_cols(TARGET)), W.shared_folder(spark) + "/features_csv"
    W.export_csv(rows, path, ["series_key", "ts"])
    return spark.read.option("header", True).schema(rows.schema).csv(path)

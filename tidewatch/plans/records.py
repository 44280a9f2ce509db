"""Queries: fingerprints, feature store, scoring, registry, lineage and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.columns import sorted_json
from tidewatch.operators import features as X
from tidewatch.operators import registry as J
from tidewatch.operators import runlog as L
from tidewatch.operators import serving as P
from tidewatch.operators import store as O
from tidewatch.operators import transform as T
from tidewatch.operators.contract import METRICS
from tidewatch.operators.ordering import newest
from tidewatch.params import DEFAULTS
from tidewatch.plans import stages as S
from tidewatch.plans import views as V
from tidewatch.plans.catalog import nudge, query, rounded, with_ctes
from tidewatch.plans.shape import FEATS, HCHAIN, TARGET, cleaned, framed
from tidewatch.sources import writers as W

M = V.metrics_sql()
_F = S.feature_cols(TARGET)

# -- fingerprints ------------------------------------------------------------

_FPSUM = ", ".join(f"'{c}:' || CAST(CAST(sum(CAST({c} AS DECIMAL(28,8))) AS DECIMAL(38,4)) AS VARCHAR)" for c in ("cpu_percent", "mem_percent"))


@query(
    "data_fingerprints",
    with_ctes([M], "SELECT series_key, left(sha256(concat_ws('|', count(*)::VARCHAR, strftime(min(ts), '%Y-%m-%d %H:%M:%S'), strftime(max(ts), '%Y-%m-%d %H:%M:%S'), "
              f"{_FPSUM})), 12) AS data_fingerprint, count(*) AS rows FROM metrics GROUP BY series_key"),
)
def data_fingerprints(spark, d):
    return O.data_fingerprint(V.metrics(spark, d), ["cpu_percent", "mem_percent"], ["series_key"])


_CFG = "cfg AS (SELECT p_brand, p_type || '.' || p_partkey AS key, p_name AS value FROM part)"
_JSON = "'{' || string_agg('\"' || key || '\":\"' || value || '\"', ',' ORDER BY key) || '}'"


@query("config_fingerprints", with_ctes([_CFG], f"SELECT p_brand, left(sha256({_JSON}), 12) AS fingerprint FROM cfg GROUP BY p_brand"))
def config_fingerprints(spark, d):
    """part as configuration: one snapshot per brand."""
    cfg = V.table(spark, d, "part").select("p_brand", F.concat_ws(".", "p_type", F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("value"))
    return O.config_fingerprint(cfg, group=["p_brand"])


@query(
    "version_ids",
    "SELECT p_brand, left(sha256('{\"target\":\"' || p_brand || '\",\"features\":[' || string_agg(DISTINCT '\"' || p_type || '\"', ',' ORDER BY '\"' || p_type || '\"') || '],\"config\":\"c1\"}'), 12) AS definition_id, "
    "left(sha256('{\"target\":\"' || p_brand || '\",\"features\":[' || string_agg(DISTINCT '\"' || p_type || '\"', ',' ORDER BY '\"' || p_type || '\"') || '],\"config\":\"c1\",\"data\":\"' || count(*) || '\"}'), 12) AS version_id FROM part GROUP BY p_brand",
)
def version_ids(spark, d):
    """Brands as targets and their part types as feature names; the version also hashes the data."""
    sets = V.table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("features"), F.count(F.lit(1)).cast("string").alias("data"))
    return sets.select(
        "p_brand",
        O.identifier(target=F.col("p_brand"), features=F.col("features"), config=F.lit("c1")).alias("definition_id"),
        O.identifier(target=F.col("p_brand"), features=F.col("features"), config=F.lit("c1"), data=F.col("data")).alias("version_id"),
    )


# -- feature store -----------------------------------------------------------

_KEPT = ", ".join(f"{c} IS NOT NULL" for c in _F).replace(", ", " AND ")


@query("offline_round_trip", with_ctes(FEATS, f"SELECT series_key, ts, segment_id, {rounded(*_F)}, {nudge('target_next')} AS target_value FROM feat WHERE {_KEPT} AND target_next IS NOT NULL"))
def offline_round_trip(spark, d):
    """Materialise a training set twice under one version, read the version back."""
    frame, names, _ = framed(spark, d)
    rows, path = X.training_rows(frame, names), W.shared_folder(spark) + "/features"
    version = O.identify(TARGET, names, data="snapshot")
    for _ in range(2):
        schema = O.materialise(rows, _F, X.LABEL, version, path)
    return O.load_offline(spark, path, version, schema).select("series_key", "ts", "segment_id", *_F, "target_value")


@query("offline_manifest", with_ctes(FEATS, f"SELECT '{TARGET}' AS target, {len(X.feature_names(TARGET, ['mem_percent', 'disk_read_mb_s']))} AS n_features, count(*) AS n_rows FROM feat WHERE {_KEPT} AND target_next IS NOT NULL"))
def offline_manifest(spark, d):
    frame, names, _ = framed(spark, d)
    return O.manifest(X.training_rows(frame, names), TARGET, names, "snapshot").select("target", "n_features", "n_rows")


@query(
    "point_in_time_lookup",
    with_ctes([*FEATS, "ent AS (SELECT event_type AS series_key, time_bucket(INTERVAL '1 hour', ts) + (event_id % 2) * INTERVAL 30 MINUTE AS ts, event_id FROM events)"],
              f"SELECT e.series_key, e.ts, e.event_id, {', '.join(f'{nudge(f)} AS {f}' for f in (f'{TARGET}_lag_0', f'{TARGET}_lag_1', f'{TARGET}_roll_mean'))} FROM ent e LEFT JOIN feat f ON e.series_key = f.series_key AND e.ts = f.ts"),
)
def point_in_time_lookup(spark, d):
    """Every event asks for the vector of its hour or half hour; half hours have none and stay empty."""
    frame, _, _ = framed(spark, d)
    events = V.table(spark, d, "events")
    half = F.expr("make_dt_interval(0, 0, 30 * CAST(event_id % 2 AS INT))")
    entities = events.select(F.col("event_type").alias("series_key"), (F.date_trunc("hour", "ts") + half).cast("timestamp").alias("ts"), "event_id")
    return O.historical_features(entities, frame, [f"{TARGET}_lag_0", f"{TARGET}_lag_1", f"{TARGET}_roll_mean"])


@query("online_vectors", with_ctes([*FEATS, f"c AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts DESC) AS k FROM feat WHERE {_KEPT})"],
                                   f"SELECT series_key, '{TARGET}' AS target, ts, {rounded(*_F)} FROM c WHERE k = 1"))
def online_vectors(spark, d):
    """The published vector is JSON; all the values that SQL has are read back from it."""
    frame, names, _ = framed(spark, d)
    rows = O.online_vectors(frame, names, TARGET, "v", O.identify(TARGET, names))
    return rows.select("series_key", "target", "ts", *[F.get_json_object("features", f"$.{n}").cast("double").alias(n) for n in _F])


@query(
    "latest_feature_version",
    with_ctes([V.MODELS_SQL], "SELECT target, version_id, created_at FROM models QUALIFY row_number() OVER (PARTITION BY target ORDER BY created_at DESC, version_id DESC) = 1"),
)
def latest_feature_version(spark, d):
    return O.latest_version(V.models(spark, d)).select("target", "version_id", "created_at")


@query(
    "keyed_upsert",
    "WITH a AS (SELECT o_custkey AS k, o_orderkey AS id, o_totalprice AS v, o_orderdate AS written FROM orders) SELECT k, id, round(v + 1e-9, 4) AS v, written FROM a QUALIFY row_number() OVER (PARTITION BY k ORDER BY written DESC, id DESC) = 1",
)
def keyed_upsert(spark, d):
    """Orders of finished status as the table, all others as newer rows of the same keys."""
    rows = V.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").cast("timestamp").alias("written"), "o_orderstatus")
    old, new = rows.where("o_orderstatus = 'F'").drop("o_orderstatus"), rows.where("o_orderstatus <> 'F'").drop("o_orderstatus")
    return O.upsert(old, new, ["k"], [F.desc("written"), F.desc("id")])


# -- serving and scoring -----------------------------------------------------


@query(
    "backfill_predictions",
    with_ctes([M, *S.to_segments("metrics"), "p AS (SELECT series_key, segment_id, ts, lag(cpu_percent) OVER (PARTITION BY series_key, segment_id ORDER BY ts) AS predicted FROM seg)"],
              f"SELECT series_key, segment_id, ts AS predicted_for_ts, {nudge('predicted')} AS predicted FROM p WHERE predicted IS NOT NULL"),
)
def backfill_predictions(spark, d):
    from tidewatch.plans.quality import segmented

    seg, layout = segmented(V.metrics(spark, d))
    return P.backfill_baseline(seg, "cpu_percent", layout)


_PREDICTIONS = """pr AS (SELECT event_type AS series_key, event_id AS id, ts + INTERVAL 200 MILLISECOND AS predicted_for_ts, value * 0.9 AS predicted FROM events),
act AS (SELECT event_type AS series_key, date_trunc('second', ts) AS sec, first(value ORDER BY ts) AS actual FROM events WHERE value < 300 GROUP BY ALL)"""


@query(
    "score_predictions",
    with_ctes([_PREDICTIONS], f"SELECT p.series_key, p.id, p.predicted_for_ts, {rounded('predicted', 'actual')}, {nudge('abs(actual - predicted)')} AS abs_error FROM pr p LEFT JOIN act a ON p.series_key = a.series_key AND a.sec = date_trunc('second', p.predicted_for_ts)"),
)
def score_predictions(spark, d):
    """Predictions 0.2 s late, so some fall into the next second and stay unscored; large samples were never recorded."""
    e = V.table(spark, d, "events")
    late = F.expr("INTERVAL 200 MILLISECONDS")
    predictions = e.select(F.col("event_type").alias("series_key"), F.col("event_id").alias("id"), (F.col("ts").cast("timestamp") + late).alias("predicted_for_ts"), (F.col("value") * 0.9).alias("predicted"))
    actuals = e.where("value < 300").select(F.col("event_type").alias("series_key"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("actual"))
    return P.score(predictions, actuals, ["series_key"])


@query(
    "recent_predictions",
    with_ctes([_PREDICTIONS, "s AS (SELECT p.*, actual FROM pr p JOIN act a ON p.series_key = a.series_key AND a.sec = date_trunc('second', p.predicted_for_ts) WHERE actual IS NOT NULL)"],
              f"SELECT series_key, id, {rounded('predicted', 'actual')} FROM s QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY predicted_for_ts DESC) <= 100"),
)
def recent_predictions(spark, d):
    return P.recent_predictions(score_predictions(spark, d), ["series_key"]).select("series_key", "id", "predicted", "actual")


_CHAMP = "champ AS (SELECT * FROM models WHERE is_champion QUALIFY row_number() OVER (PARTITION BY target ORDER BY promoted_at DESC, model_id DESC) = 1)"


@query("champions", with_ctes([V.MODELS_SQL, _CHAMP], f"SELECT target, model_id, algorithm, {nudge('mae')} AS mae, version_id, run_id, promoted_at FROM champ"))
def champions(spark, d):
    return P.champions(V.models(spark, d)).select("target", "model_id", "algorithm", "mae", "version_id", "run_id", "promoted_at")


@query(
    "resolved_champions",
    with_ctes([V.MODELS_SQL, _CHAMP], f"SELECT t.target, coalesce(model_id, 'baseline-persistence-' || t.target) AS model_id, {nudge('coalesce(mae, 0.0)')} AS mae, model_id IS NULL AS is_baseline "
              "FROM (SELECT DISTINCT target FROM models UNION SELECT DISTINCT c_mktsegment FROM customer) t LEFT JOIN champ USING (target)"),
)
def resolved_champions(spark, d):
    """Targets without a champion (market segments here) are served by persistence."""
    registry = V.models(spark, d)
    targets = registry.select("target").union(V.table(spark, d, "customer").select(F.col("c_mktsegment").alias("target"))).distinct()
    return P.resolve_champion(targets, registry)


@query(
    "next_predictions",
    with_ctes([*FEATS, f"c AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts DESC) AS k FROM feat WHERE {_KEPT})"],
              f"SELECT series_key, 'm-' || series_key AS model_id, ts + INTERVAL 3 SECOND AS predicted_for_ts, CASE WHEN series_key < 'm' THEN round({TARGET}_lag_0, 4) "
              f"WHEN series_key < 's' THEN round(1.5 + 0.6 * {TARGET}_lag_0 + 0.4 * {TARGET}_roll_mean, 4) END AS predicted, "
              "CASE WHEN series_key >= 'v' THEN 'feature definition mismatch' WHEN series_key >= 's' THEN 'no model weights' END AS error FROM c WHERE k = 1"),
)
def next_predictions(spark, d):
    """Baselines up to 'm', linear champions up to 's', one whose weights are lost, and from 'v' on one of another definition, refused."""
    frame, names, _ = framed(spark, d)
    own = O.identify(TARGET, names)
    vectors = X.serving_rows(frame, names).withColumn("definition_id", own)
    name = F.col("series_key")
    weights = F.create_map(F.lit(f"{TARGET}_lag_0"), F.lit(0.6), F.lit(f"{TARGET}_roll_mean"), F.lit(0.4))
    champion = V.table(spark, d, "events").select(F.col("event_type").alias("series_key")).distinct().select(
        "series_key", F.concat(F.lit("m-"), "series_key").alias("model_id"), (name < "m").alias("is_baseline"), F.when(name >= "v", F.lit("other")).otherwise(own).alias("feature_definition"),
        F.when((name >= "m") & (name < "s"), weights).alias("weights"), F.lit(1.5).alias("intercept"),
    )
    return P.predict_next(vectors, champion, TARGET)


# -- registry ----------------------------------------------------------------

_RESULTS = """results AS (SELECT o_orderkey AS result_id, o_orderpriority AS target, 'new-' || o_orderkey AS model_id, 'gradient_boosting' AS algorithm, o_totalprice / 10000.0 AS mae,
  CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 11 = 0 THEN 0.0 ELSE 30.0 END AS baseline_mae, CASE WHEN o_custkey % 3 = 0 THEN 0.5 WHEN o_custkey % 3 = 1 THEN 1.0 END AS cv_folds_won_fraction,
  (o_custkey % 10)::DOUBLE AS cv_mae_std, CASE WHEN o_custkey % 13 = 0 THEN 0.0 ELSE 3.0 END AS cv_baseline_mae_std, CASE WHEN o_custkey % 2 = 0 THEN 26.0 END AS champion_mae_same_window,
  CASE WHEN o_orderstatus = 'P' THEN 'too few rows' END AS error FROM orders)"""
_JUDGED = [
    V.MODELS_SQL, _CHAMP, _RESULTS,
    "inc AS (SELECT target, CASE WHEN target LIKE '5%' THEN 'baseline-persistence-' || target ELSE model_id END AS model_id, mae FROM champ WHERE target NOT LIKE '4%')",
    """jd AS (SELECT r.*, i.model_id AS incumbent_id, i.mae AS stored, coalesce(champion_mae_same_window, i.mae) AS ref,
  CASE WHEN coalesce(champion_mae_same_window, i.mae) > 0 THEN (coalesce(champion_mae_same_window, i.mae) - r.mae) / coalesce(champion_mae_same_window, i.mae) * 100.0 ELSE 100.0 END AS gain
  FROM results r LEFT JOIN inc i USING (target))""",
    """rl AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN mae >= baseline_mae THEN 'loses to baseline' WHEN cv_folds_won_fraction < 0.75 THEN 'too few folds won'
  WHEN cv_baseline_mae_std <> 0 AND cv_mae_std / nullif(cv_baseline_mae_std, 0) > 2.0 THEN 'unstable across folds' WHEN incumbent_id IS NULL THEN 'no incumbent'
  WHEN incumbent_id LIKE 'baseline-persistence%' THEN 'incumbent is the baseline' WHEN gain < 2.0 THEN 'gain too small' ELSE 'beats incumbent' END AS rule FROM jd)""",
]


def training_results(spark, d):
    """orders as training results."""
    o, c = V.table(spark, d, "orders"), F.col("o_custkey")
    return o.select(
        F.col("o_orderkey").alias("result_id"),
        F.col("o_orderpriority").alias("target"),
        F.concat(F.lit("new-"), F.col("o_orderkey").cast("string")).alias("model_id"),
        F.lit("gradient_boosting").alias("algorithm"),
        (F.col("o_totalprice") / 10000.0).alias("mae"),
        F.when(c % 7 == 0, None).when(c % 11 == 0, 0.0).otherwise(30.0).alias("baseline_mae"),
        F.when(c % 3 == 0, 0.5).when(c % 3 == 1, 1.0).alias("cv_folds_won_fraction"),
        (c % 10).cast("double").alias("cv_mae_std"),
        F.when(c % 13 == 0, 0.0).otherwise(3.0).alias("cv_baseline_mae_std"),
        F.when(c % 2 == 0, 26.0).alias("champion_mae_same_window"),
        F.when(F.col("o_orderstatus") == "P", "too few rows").alias("error"),
    )


def incumbents(spark, d):
    best = P.champions(V.models(spark, d)).where(~F.col("target").startswith("4"))
    name = F.when(F.col("target").startswith("5"), F.concat(F.lit("baseline-persistence-"), "target")).otherwise(F.col("model_id"))
    return best.select("target", name.alias("model_id"), "mae")


@query(
    "promotion_gate",
    with_ctes(_JUDGED, "SELECT result_id, target, rule, rule IN ('no incumbent', 'incumbent is the baseline', 'beats incumbent') AS promote, CASE WHEN rule = 'error' THEN 'ERROR' WHEN rule IN ('no incumbent', 'incumbent is the baseline', 'beats incumbent') THEN 'PROMOTED' ELSE 'REJECTED' END AS verdict, "
              "CASE WHEN rule IN ('gain too small', 'beats incumbent') THEN round(gain, 2) END AS gain_pct FROM rl"),
)
def promotion_gate(spark, d):
    return J.judge(training_results(spark, d), incumbents(spark, d)).select("result_id", "target", "rule", "promote", "verdict", "gain_pct")


_LAST = "one AS (SELECT * FROM rl QUALIFY row_number() OVER (PARTITION BY target ORDER BY result_id DESC) = 1)"


@query(
    "registry_after_gate",
    with_ctes(
        [*_JUDGED, _LAST,
         "won AS (SELECT target, model_id, mae, true AS is_champion, NULL AS reason FROM one WHERE rule IN ('no incumbent', 'incumbent is the baseline', 'beats incumbent'))",
         "lost AS (SELECT target, model_id, mae, false AS is_champion, rule AS reason FROM one WHERE rule NOT IN ('no incumbent', 'incumbent is the baseline', 'beats incumbent'))",
         "fb AS (SELECT l.target, 'baseline-persistence-' || l.target AS model_id, 30.0 AS mae, true AS is_champion, NULL AS reason FROM lost l LEFT JOIN champ c USING (target) WHERE c.model_id IS NULL AND l.reason <> 'error')",
         "added AS (SELECT * FROM won UNION ALL SELECT * FROM lost UNION ALL SELECT * FROM fb)",
         "alln AS (SELECT target, model_id, mae, is_champion AND target NOT IN (SELECT target FROM added WHERE is_champion) AS is_champion, rejected_reason AS reason FROM models UNION ALL SELECT * FROM added)"],
        f"SELECT target, count(*) AS models, count(*) FILTER (WHERE is_champion) AS flagged, max(model_id) FILTER (WHERE is_champion) AS champion, {nudge('max(mae)')} AS worst_mae, count(reason) AS rejected FROM alln GROUP BY target",
    ),
)
def registry_after_gate(spark, d):
    """The newest result of each target meets the gate and the registry is rewritten."""
    registry = V.models(spark, d)
    latest = newest(training_results(spark, d), ["target"], [F.desc("result_id")]).withColumn("persistence_mae", F.lit(30.0))
    judged = J.judge(latest, incumbents(spark, d))
    after = J.apply_decisions(registry, judged, "2024-02-01")
    return after.groupBy("target").agg(
        F.count(F.lit(1)).alias("models"),
        F.count_if("is_champion").alias("flagged"),
        F.max(F.when(F.col("is_champion"), F.col("model_id"))).alias("champion"),
        F.max("mae").alias("worst_mae"),
        F.count("rejected_reason").alias("rejected"),
    )


@query("registry_listing", with_ctes([V.MODELS_SQL], f"SELECT target, model_id, created_at, {nudge('mae')} AS mae, is_champion FROM models"))
def registry_listing(spark, d):
    return J.listing(V.models(spark, d)).select("target", "model_id", "created_at", "mae", "is_champion")


# -- runs, configuration, lineage --------------------------------------------


@query("stale_runs", with_ctes([V.RUNS_SQL], "SELECT run_id, CASE WHEN status = 'running' AND started_at < TIMESTAMP '1998-01-01' - INTERVAL 60 MINUTE THEN 'interrupted' ELSE status END AS status, CASE WHEN status = 'running' AND started_at < TIMESTAMP '1998-01-01' - INTERVAL 60 MINUTE THEN TIMESTAMP '1998-01-01' END AS finished_at FROM runs"))
def stale_runs(spark, d):
    return L.reconcile_stale(V.runs(spark, d), "1998-01-01").select("run_id", "status", "finished_at")


@query("latest_successful_run", with_ctes([V.RUNS_SQL], "SELECT run_id, started_at, rows_out, gate_verdict FROM runs WHERE status = 'success' ORDER BY run_id DESC LIMIT 1"))
def latest_successful_run(spark, d):
    return L.latest_run(V.runs(spark, d)).select("run_id", "started_at", "rows_out", "gate_verdict")


@query("run_history", with_ctes([V.RUNS_SQL], "SELECT run_id, started_at, source_kind, rows_in, rows_out, gate_verdict, status FROM runs ORDER BY run_id DESC LIMIT 20"))
def run_history(spark, d):
    return L.history(V.runs(spark, d), [F.desc("run_id")], 20).select("run_id", "started_at", "source_kind", "rows_in", "rows_out", "gate_verdict", "status")


@query("check_history", with_ctes([V.CHECKS_SQL], "SELECT check_name, status, count(*) AS rows, max(checked_at) AS last_at FROM checks GROUP BY ALL"))
def check_history(spark, d):
    return V.checks(spark, d).groupBy("check_name", "status").agg(F.count(F.lit(1)).alias("rows"), F.max("checked_at").alias("last_at"))


@query("check_history_newest", with_ctes([V.CHECKS_SQL], f"SELECT run_id, check_name, status, {nudge('value')} AS value, detail, checked_at FROM checks ORDER BY checked_at DESC, run_id DESC, check_name, detail LIMIT 200"))
def check_history_newest(spark, d):
    """The newest 200 check results."""
    rows = V.checks(spark, d).select("run_id", "check_name", "status", "value", "detail", "checked_at")
    return L.history(rows, [F.desc("checked_at"), F.desc("run_id"), F.col("check_name"), F.col("detail")], 200)


_OLDNEW = ["old AS (SELECT 'size.' || p_partkey AS key, p_size::VARCHAR AS value FROM part WHERE p_size <> 10)", "new AS (SELECT 'size.' || p_partkey AS key, greatest(p_size, 20)::VARCHAR AS value FROM part WHERE p_size <> 30)"]


def _snapshots(spark, d):
    p = V.table(spark, d, "part")
    key = F.concat(F.lit("size."), F.col("p_partkey").cast("string")).alias("key")
    old = p.where("p_size <> 10").select(key, F.col("p_size").cast("string").alias("value"))
    new = p.where("p_size <> 30").select(key, F.greatest("p_size", F.lit(20)).cast("string").alias("value"))
    return old, new


@query("config_changes", with_ctes(_OLDNEW, "SELECT coalesce(o.key, n.key) AS key, o.value AS old_value, n.value AS new_value FROM old o FULL JOIN new n ON o.key = n.key WHERE o.value IS DISTINCT FROM n.value"))
def config_changes(spark, d):
    """Part sizes as two configuration snapshots: keys appear, disappear and change."""
    return L.config_changes(*_snapshots(spark, d))


_AUDIT = "audit AS (SELECT 'cust.' || o_custkey AS key, o_orderkey AS id, o_orderdate AS changed_at, floor(o_totalprice)::BIGINT::VARCHAR AS old_value, o_orderstatus AS new_value, o_orderpriority AS source FROM orders)"


def audit_rows(spark, d):
    return V.table(spark, d, "orders").select(
        F.concat(F.lit("cust."), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("changed_at"),
        F.floor("o_totalprice").cast("string").alias("old_value"), F.col("o_orderstatus").alias("new_value"), F.col("o_orderpriority").alias("source"),
    )


@query("config_history_newest", with_ctes([_AUDIT], "SELECT id, key, old_value, new_value, changed_at, source FROM audit ORDER BY id DESC LIMIT 50"))
def config_history_newest(spark, d):
    """The newest 50 changes of the configuration."""
    return L.history(audit_rows(spark, d), [F.desc("id")], 50).select("id", "key", "old_value", "new_value", "changed_at", "source")


@query("config_history_of_keys", with_ctes([_AUDIT], "SELECT id, key, old_value, new_value, changed_at, source FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id DESC) AS k FROM audit) WHERE k <= 3"))
def config_history_of_keys(spark, d):
    """The newest 3 changes of every key."""
    return newest(audit_rows(spark, d), ["key"], [F.desc("id")], 3).select("id", "key", "old_value", "new_value", "changed_at", "source")


_DRIFT_EVENTS = """drift_log AS (SELECT o_orderkey AS id, o_orderpriority AS target, o_orderdate AS detected_at, CASE o_orderstatus WHEN 'F' THEN 'performance' WHEN 'P' THEN 'input' ELSE 'none' END AS trigger,
  o_totalprice / 400000.0::DOUBLE AS psi, o_totalprice / 150000.0::DOUBLE AS ratio, CASE o_orderstatus WHEN 'F' THEN 'retrain' WHEN 'P' THEN 'watch' ELSE 'none' END AS action,
  CASE WHEN o_orderstatus = 'F' THEN 'promoted' END AS outcome, CASE WHEN o_orderstatus = 'F' THEN 'm-' || o_orderkey END AS new_model_id FROM orders)"""
_DRIFT_COLUMNS = f"target, detected_at, trigger, {rounded('psi', 'ratio')}, action, outcome, new_model_id"


def drift_log(spark, d):
    """Orders as a log of drift events."""
    status, price = F.col("o_orderstatus"), F.col("o_totalprice").cast("double")
    of = lambda f, p: F.when(status == "F", f).when(status == "P", p).otherwise("none")
    return V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("target"), F.col("o_orderdate").cast("timestamp").alias("detected_at"), of("performance", "input").alias("trigger"),
        (price / 400000.0).alias("psi"), (price / 150000.0).alias("ratio"), of("retrain", "watch").alias("action"),
        F.when(status == "F", "promoted").alias("outcome"), F.when(status == "F", F.concat(F.lit("m-"), F.col("o_orderkey").cast("string"))).alias("new_model_id"),
    )


@query("drift_history_newest", with_ctes([_DRIFT_EVENTS], f"SELECT id, {_DRIFT_COLUMNS} FROM drift_log ORDER BY id DESC LIMIT 50"))
def drift_history_newest(spark, d):
    """The newest 50 drift events of all targets."""
    return L.history(drift_log(spark, d), [F.desc("id")], 50)


@query("drift_history_of_targets", with_ctes([_DRIFT_EVENTS], f"SELECT id, {_DRIFT_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id DESC) AS k FROM drift_log) WHERE k <= 50"))
def drift_history_of_targets(spark, d):
    """The newest 50 drift events of every target."""
    return newest(drift_log(spark, d), ["target"], [F.desc("id")], 50)


@query(
    "config_as_of",
    with_ctes([_AUDIT, "cur AS (SELECT 'cust.' || c_custkey AS key, c_mktsegment AS value FROM customer)",
               "bef AS (SELECT key, first(old_value ORDER BY changed_at, id) AS v FROM audit WHERE changed_at > TIMESTAMP '1999-06-01' GROUP BY key)"],
              "SELECT coalesce(c.key, b.key) AS key, CASE WHEN b.key IS NOT NULL THEN b.v ELSE c.value END AS value FROM cur c FULL JOIN bef b ON c.key = b.key"),
)
def config_as_of(spark, d):
    """Customer segments as current values, orders as the audit trail."""
    current = V.table(spark, d, "customer").select(F.concat(F.lit("cust."), F.col("c_custkey").cast("string")).alias("key"), F.col("c_mktsegment").alias("value"))
    return L.config_as_of(current, audit_rows(spark, d), "1999-06-01")


@query("config_categories", "SELECT DISTINCT p_type AS category FROM part")
def config_categories(spark, d):
    return V.table(spark, d, "part").select(F.col("p_type").alias("category")).distinct()


@query(
    "lineage_trace",
    with_ctes(
        [V.MODELS_SQL, V.RUNS_SQL, V.CHECKS_SQL,
         "pr AS (SELECT event_id AS prediction_id, 'm-' || event_id AS model_id, value AS predicted FROM events)",
         "ck AS (SELECT run_id, count(*) AS checks, count(*) FILTER (WHERE status = 'FAIL') AS checks_failed, count(*) FILTER (WHERE status = 'WARN') AS checks_warned FROM checks GROUP BY run_id)",
         "vs AS (SELECT 'v-' || c_custkey AS version_id, c_mktsegment AS feature_set FROM customer)"],
        f"SELECT prediction_id, pr.model_id, target, m.version_id, feature_set, m.run_id, r.status AS run_status, gate_verdict, checks, checks_failed, checks_warned, {nudge('predicted')} AS predicted "
        "FROM pr LEFT JOIN models m ON pr.model_id = m.model_id LEFT JOIN vs ON vs.version_id = m.version_id LEFT JOIN runs r ON r.run_id = m.run_id LEFT JOIN ck ON ck.run_id = m.run_id",
    ),
)
def lineage_trace(spark, d):
    """Every event as a prediction, traced back to its model, feature version, run and checks."""
    predictions = V.table(spark, d, "events").select(F.col("event_id").alias("prediction_id"), F.concat(F.lit("m-"), F.col("event_id").cast("string")).alias("model_id"), F.col("value").alias("predicted"))
    versions = V.table(spark, d, "customer").select(F.concat(F.lit("v-"), F.col("c_custkey").cast("string")).alias("version_id"), F.col("c_mktsegment").alias("feature_set"))
    registry = V.models(spark, d).select("model_id", "target", "version_id", "run_id")
    runs = V.runs(spark, d).select("run_id", F.col("status").alias("run_status"), "gate_verdict")
    out = L.trace(predictions, registry, versions, runs, V.checks(spark, d))
    return out.select("prediction_id", "model_id", "target", "version_id", "feature_set", "run_id", "run_status", "gate_verdict", "checks", "checks_failed", "checks_warned", "predicted")


# -- events ------------------------------------------------------------------

_ALERTS = """drifts AS (SELECT event_type AS target, ts AS detected_at, CASE WHEN value > 200 THEN 'retrain' ELSE 'suppressed' END AS action, CASE WHEN value > 300 THEN 'rejected' END AS outcome, props AS detail FROM events WHERE event_type = 'error'),
recos AS (SELECT ts, CASE WHEN event_type = 'purchase' THEN 'process_alert' ELSE 'allocation' END AS type, props AS process_payload FROM events)"""
_GATED = "gated AS (SELECT *, CASE WHEN gate_verdict <> 'PASS' AND rows_in % 2 = 0 THEN 'gate ' || gate_verdict END AS gate_detail FROM runs)"
_STREAMS = " UNION ALL ".join(kind.sql("gated" if name == "runs" else L.EVENT_TABLES.get(name, name)) for name, kind in L.EVENT_KINDS.items())
_EVENTS = f'ev AS (SELECT "at" AS at_ts, source, level, event, detail FROM ({_STREAMS}))'
_EV = [V.RUNS_SQL, _GATED, V.CHECKS_SQL, V.MODELS_SQL, _AUDIT, _ALERTS, _EVENTS]


def all_events(spark, d):
    e = V.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    drifts = e.where("event_type = 'error'").select(
        F.col("event_type").alias("target"), F.col("ts").alias("detected_at"), F.when(F.col("value") > 200, "retrain").otherwise("suppressed").alias("action"),
        F.when(F.col("value") > 300, "rejected").alias("outcome"), F.col("props").alias("detail"),
    )
    recos = e.select("ts", F.when(F.col("event_type") == "purchase", "process_alert").otherwise("allocation").alias("type"), F.col("props").alias("process_payload"))
    gated = F.when((F.col("gate_verdict") != "PASS") & (F.col("rows_in") % 2 == 0), F.concat(F.lit("gate "), "gate_verdict"))
    runs = V.runs(spark, d).withColumn("gate_detail", gated)
    return L.events_of({"runs": runs, "checks": V.checks(spark, d), "models": V.models(spark, d), "drifts": drifts, "audit": audit_rows(spark, d), "recos": recos})


@query("event_log", with_ctes(_EV, 'SELECT at_ts AS "at", source, level, event, detail FROM ev'))
def event_log(spark, d):
    return L.event_log(all_events(spark, d))


@query("event_log_newest", with_ctes(_EV, 'SELECT at_ts AS "at", source, level, event, detail FROM ev ORDER BY at_ts DESC, source, event, detail LIMIT 500'))
def event_log_newest(spark, d):
    return L.event_log(all_events(spark, d), 500)


@query("event_log_filtered", with_ctes(_EV, "SELECT at_ts AS \"at\", source, level, event, detail FROM ev WHERE level IN ('ERROR', 'WARN') AND source IN ('etl', 'quality', 'drift') AND (lower(event) LIKE '%check_3%' OR lower(detail) LIKE '%check_3%' OR lower(event) LIKE '%check_3%')"))
def event_log_filtered(spark, d):
    return L.filter_events(L.event_log(all_events(spark, d)), ["ERROR", "WARN"], ["etl", "quality", "drift"], "CHECK_3")


@query("event_counters", with_ctes(_EV, "SELECT source, level, count(*) AS events, max(at_ts) AS most_recent FROM ev GROUP BY ALL"))
def event_counters(spark, d):
    return L.event_log(all_events(spark, d)).groupBy("source", "level").agg(F.count(F.lit(1)).alias("events"), F.max("at").alias("most_recent"))


_TOP = "top AS (SELECT l_orderkey AS alert_id, l_partkey * 10 + l_linenumber AS pid, p_name AS name, l_extendedprice AS rss_mb FROM lineitem JOIN part ON l_partkey = p_partkey), ranked AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY rss_mb DESC, pid) AS place FROM top)"


def consumers(spark, d):
    """Orders as alerts, their line items as consumers."""
    part = V.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    lines = V.table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.select(F.col("l_orderkey").alias("alert_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pid"), "name", F.col("l_extendedprice").alias("rss_mb"))
    alerts = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("alert_id"))
    return L.top_consumers(alerts, rows, ["alert_id"])


@query("top_consumers", with_ctes([_TOP], f"SELECT alert_id, place, pid, name, {nudge('rss_mb')} AS rss_mb FROM ranked WHERE place <= 5"))
def top_consumers(spark, d):
    return consumers(spark, d).select("alert_id", "place", "pid", "name", "rss_mb")


@query("alert_payloads", with_ctes([_TOP], f"SELECT alert_id, place - 1 AS at, pid, name, {nudge('rss_mb')} AS rss_mb FROM ranked WHERE place <= 5"))
def alert_payloads(spark, d):
    """The payload is JSON; every entry is read back from it."""
    payload = L.alert_payload(consumers(spark, d), ["alert_id"])
    read = F.from_json("process_payload", "array<struct<pid bigint, name string, rss_mb double>>")
    return payload.select("alert_id", F.posexplode(read).alias("at", "entry")).select("alert_id", F.col("at").cast("bigint").alias("at"), "entry.*")


@query(
    "companion_columns",
    with_ctes([M, "l AS (SELECT id, series_key, ts, target, value FROM (SELECT id, series_key, ts, cpu_percent, mem_percent, disk_read_mb_s FROM metrics) UNPIVOT (value FOR target IN (cpu_percent, mem_percent, disk_read_mb_s)))"],
              f"SELECT series_key, ts, {', '.join(f'''{nudge(f"max(value) FILTER (WHERE target = '{t}')")} AS {t}''' for t in DEFAULTS.forecast_targets)} FROM l GROUP BY series_key, ts"),
)
def companion_columns(spark, d):
    """Long samples back to one row per instant, each target beside its companions."""
    from tidewatch.operators.cost import to_long

    long = to_long(V.metrics(spark, d), DEFAULTS.forecast_targets, ("series_key", "ts"))
    return long.groupBy("series_key", "ts").pivot("target", list(DEFAULTS.forecast_targets)).agg(F.max("value"))

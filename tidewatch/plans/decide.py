"""Queries: drift, breach accounting, pricing, backtest and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.columns import psi_term, severity  # noqa: F401
from tidewatch.operators import backtest as B
from tidewatch.operators import cost as Y
from tidewatch.operators import drift as D
from tidewatch.operators import serving as P
from tidewatch.operators import transform as T
from tidewatch.params import DEFAULTS
from tidewatch.plans import stages as S
from tidewatch.plans import views as V
from tidewatch.plans.catalog import nudge, query, rounded, with_ctes
from tidewatch.plans.shape import HCHAIN, cleaned

M = V.metrics_sql()
USERS = V.metrics_sql("user_id")
REGIME = V.regime_sql()
PRICE = {r.target: r for r in DEFAULTS.resources}


def cost_sql(target: str, percent: str) -> str:
    """monthly_cost as SQL; `target` is an expression giving the target's name."""
    arms = " ".join(
        f"WHEN '{r.target}' THEN {percent} / 100.0 * {r.capacity!r}::DOUBLE * {r.rate!r}::DOUBLE * {(730.0 if r.hourly else 1.0)!r}::DOUBLE" for r in DEFAULTS.resources
    )
    return f"round(CASE {target} {arms} END, 2)"


# -- drift -------------------------------------------------------------------

_TAIL = "t AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts DESC) AS k, count(*) OVER (PARTITION BY series_key) AS n FROM {base})"


def psi_sql(base: str, value: str = "cpu_percent", window: int = 50) -> list[str]:
    edges = ", ".join(f"quantile_cont({value}, {i / 10!r})" for i in range(1, 10))
    return [
        f"t AS (SELECT series_key, {value}, row_number() OVER (PARTITION BY series_key ORDER BY ts DESC) AS k FROM {base} WHERE {value} IS NOT NULL)",
        f"e AS (SELECT series_key, list_distinct([{edges}]) AS edges FROM t WHERE k > {window} GROUP BY series_key)",
        f"b AS (SELECT t.series_key, k > {window} AS is_ref, len(list_filter(coalesce(edges, []), lambda q: {value} >= q)) AS bin FROM t LEFT JOIN e USING (series_key))",
        "c AS (SELECT series_key, bin, count(*) FILTER (WHERE is_ref) AS r, count(*) FILTER (WHERE NOT is_ref) AS c FROM b GROUP BY ALL)",
        "s AS (SELECT series_key, sum(r)::BIGINT AS reference_rows, sum(c)::BIGINT AS current_rows FROM c GROUP BY series_key)",
        "z AS (SELECT series_key, reference_rows, current_rows, greatest(r / nullif(reference_rows, 0), 1e-6) AS pr, greatest(c / nullif(current_rows, 0), 1e-6) AS pc FROM c JOIN s USING (series_key))",
        f"psi AS (SELECT series_key, CASE WHEN any_value(reference_rows) >= 10 AND any_value(current_rows) >= 10 THEN round(sum((pc - pr) * ln(pc / pr)), 4) END AS p, any_value(reference_rows) AS reference_rows, any_value(current_rows) AS current_rows FROM z GROUP BY series_key)",
        f"fd AS (SELECT m.series_key, CASE WHEN rows >= {2 * window} THEN p END AS psi, reference_rows, current_rows FROM (SELECT series_key, count(*) AS rows FROM {base} GROUP BY 1) m LEFT JOIN psi USING (series_key))",
    ]


SEVERITY = "CASE WHEN psi IS NULL THEN 'unknown' WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'major' END"


@query("feature_drift", with_ctes([M, *psi_sql("metrics")], f"SELECT series_key, psi, {SEVERITY} AS severity, reference_rows, current_rows FROM fd"))
def feature_drift(spark, d):
    raw = V.metrics(spark, d)
    return D.feature_drift(raw, "cpu_percent", layout=V.plan(raw))


@query("feature_drift_users", with_ctes([USERS, *psi_sql("metrics")], f"SELECT series_key, psi, {SEVERITY} AS severity, reference_rows, current_rows FROM fd"))
def feature_drift_users(spark, d):
    raw = V.metrics(spark, d, "user_id")
    return D.feature_drift(raw, "cpu_percent", layout=V.plan(raw))


@query(
    "psi_between_halves",
    with_ctes(
        [M, "t AS (SELECT series_key, cpu_percent, ts < TIMESTAMP '2024-01-15' AS is_ref FROM metrics)",
         f"e AS (SELECT series_key, list_distinct([{', '.join(f'quantile_cont(cpu_percent, {i / 10!r})' for i in range(1, 10))}]) AS edges FROM t WHERE is_ref GROUP BY series_key)",
         "b AS (SELECT t.series_key, is_ref, len(list_filter(edges, lambda q: cpu_percent >= q)) AS bin FROM t LEFT JOIN e USING (series_key))",
         *psi_sql("metrics")[3:6]],
        "SELECT series_key, round(sum((pc - pr) * ln(pc / pr)), 4) AS psi, any_value(reference_rows) AS reference_rows, any_value(current_rows) AS current_rows FROM z GROUP BY series_key",
    ),
)
def psi_between_halves(spark, d):
    raw = V.metrics(spark, d)
    parted = raw.withColumn("part", F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp"), "reference").otherwise("current"))
    return D.psi(parted, "cpu_percent", layout=V.plan(raw))


_WORDS = ("idle", "ramp", "saturated", "unknown")


def cat_psi_sql(base: str) -> list[str]:
    counts = ", ".join(f"count(*) FILTER (WHERE k > 50 AND regime = '{w}') AS r{i}, count(*) FILTER (WHERE k <= 50 AND regime = '{w}') AS c{i}" for i, w in enumerate(_WORDS))
    term = " + ".join(f"(greatest(c{i} / c, 1e-6) - greatest(r{i} / nullif(r, 0), 1e-6)) * ln(greatest(c{i} / c, 1e-6) / greatest(r{i} / nullif(r, 0), 1e-6))" for i in range(4))
    return [
        f"ct AS (SELECT series_key, {REGIME} AS regime, row_number() OVER (PARTITION BY series_key ORDER BY ts DESC) AS k FROM {base})",
        f"cc AS (SELECT series_key, count(*) AS n, count(*) FILTER (WHERE k > 50) AS r, count(*) FILTER (WHERE k <= 50) AS c, {counts} FROM ct GROUP BY series_key)",
        f"cd AS (SELECT series_key, CASE WHEN n >= 100 THEN round({term}, 4) END AS psi FROM cc)",
    ]


@query("categorical_drift", with_ctes([USERS, *cat_psi_sql("metrics")], f"SELECT series_key, psi, {SEVERITY} AS severity FROM cd"))
def categorical_drift(spark, d):
    return D.categorical_drift(T.label_regimes(V.metrics(spark, d, "user_id")), "regime")


# persistence predictions of the raw samples: each sample predicts the next one
_PRED = "pred AS (SELECT series_key, ts AS predicted_for_ts, lag(cpu_percent) OVER (PARTITION BY series_key ORDER BY ts) AS predicted FROM metrics)"
_SCORED = [M, _PRED, "scored AS (SELECT p.*, m.cpu_percent AS actual, abs(m.cpu_percent - predicted) AS abs_error FROM pred p JOIN metrics m ON p.series_key = m.series_key AND m.ts = p.predicted_for_ts WHERE predicted IS NOT NULL)"]


def scored_samples(spark, d):
    raw = V.metrics(spark, d)
    layout = V.plan(raw)
    predicted = P.backfill_baseline(raw.withColumn("segment_id", F.lit(0)), "cpu_percent", layout)
    actuals = raw.select("series_key", F.col("ts").alias("predicted_for_ts"), F.col("cpu_percent").alias("actual"))
    return predicted.drop("segment_id").join(actuals, ["series_key", "predicted_for_ts"]).withColumn("abs_error", F.abs(F.col("actual") - F.col("predicted")))


_ROLLING = "re AS (SELECT series_key, round(avg(abs_error), 4) AS window_mae, round(max(abs_error), 4) AS worst, count(*) AS n_scored, min(predicted_for_ts) AS from_ts, max(predicted_for_ts) AS to_ts FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY predicted_for_ts DESC) AS k FROM scored) WHERE k <= 50 GROUP BY series_key)"


@query("rolling_error", with_ctes([*_SCORED, _ROLLING], "SELECT * FROM re"))
def rolling_error(spark, d):
    return D.rolling_error(scored_samples(spark, d), ["series_key"])


_SIGNALS = [
    *_SCORED, _ROLLING, *psi_sql("metrics"), *cat_psi_sql("metrics"),
    "ref AS (SELECT series_key, round(avg(abs_error) / 2.0, 4) AS reference_mae FROM scored GROUP BY series_key)",
    "sig AS (SELECT ref.series_key, reference_mae, window_mae, n_scored, fd.psi AS feature_psi, cd.psi AS regime_psi, window_mae / reference_mae AS q FROM ref JOIN re USING (series_key) JOIN fd USING (series_key) JOIN cd USING (series_key))",
    "dec AS (SELECT *, CASE WHEN n_scored >= 30 AND q > 1.5 THEN 'performance' WHEN regime_psi > 0.25 THEN 'categorical' WHEN feature_psi > 0.25 THEN 'feature' END AS trigger FROM sig)",
]


def drift_decisions(spark, d):
    raw = V.metrics(spark, d)
    layout = V.plan(raw)
    scored = scored_samples(spark, d)
    reference = scored.groupBy("series_key").agg(F.round(F.avg("abs_error") / 2.0, 4).alias("reference_mae"))
    rolling = D.rolling_error(scored, ["series_key"]).select("series_key", "window_mae", "n_scored")
    numeric = D.feature_drift(raw, "cpu_percent", layout=layout).select("series_key", F.col("psi").alias("feature_psi"))
    regime = D.categorical_drift(T.label_regimes(raw), "regime").select("series_key", F.col("psi").alias("regime_psi"))
    return D.decide(reference.join(rolling, "series_key").join(numeric, "series_key").join(regime, "series_key"))


@query(
    "drift_decisions",
    with_ctes(_SIGNALS, f"SELECT series_key, reference_mae, window_mae, n_scored, feature_psi, regime_psi, round(q, 3) AS ratio, trigger, trigger IS NOT NULL AS drifted, "
              "concat_ws('; ', CASE WHEN n_scored < 30 THEN format('performance: {} scored, need 30', n_scored) ELSE printf('performance: %.2fx reference', q) END, printf('regime mix: PSI %.4f', regime_psi), printf('input: PSI %.4f', feature_psi)) AS reason FROM dec"),
)
def drift_decision_rows(spark, d):
    return drift_decisions(spark, d)


@query(
    "monitor_actions",
    with_ctes([*_SIGNALS, "last AS (SELECT event_type AS series_key, max(ts) AS fired FROM events WHERE value > 200 GROUP BY 1)"],
              "SELECT series_key, trigger, CASE WHEN trigger IS NULL THEN 'none' WHEN coalesce(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(fired) < 172800000000, false) THEN 'suppressed' ELSE 'retrain' END AS action FROM dec LEFT JOIN last USING (series_key)"),
)
def monitor_actions(spark, d):
    """The last sample above 200 stands for the last retrain; the cooldown is two days."""
    params = DEFAULTS.with_(retrain_cooldown=172800)
    raw = V.metrics(spark, d)
    last = raw.where("cpu_percent > 200").groupBy("series_key").agg(F.max("ts").alias("_at"))
    decided = drift_decisions(spark, d).join(last, "series_key", "left")
    elapsed = F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros("_at")
    return D.monitor_actions(decided, elapsed < params.retrain_cooldown * 1_000_000, params).select("series_key", "trigger", "action")


@query(
    "drift_outcomes",
    with_ctes([*_SIGNALS, "last AS (SELECT event_type AS series_key, max(ts) AS fired FROM events WHERE value > 480 GROUP BY 1)",
               "act AS (SELECT series_key, trigger, CASE WHEN trigger IS NULL THEN 'none' WHEN coalesce(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(fired) < 172800000000, false) THEN 'suppressed' ELSE 'retrain' END AS action FROM dec LEFT JOIN last USING (series_key))",
               "ver AS (SELECT event_type AS series_key, count(*) % 2 = 0 AS promote, 'm-' || event_type AS model_id FROM events GROUP BY 1)"],
              "SELECT series_key, action, CASE WHEN action = 'retrain' THEN CASE WHEN promote THEN 'promoted' ELSE 'rejected' END WHEN action <> 'none' THEN action END AS outcome, CASE WHEN action = 'retrain' THEN model_id END AS new_model_id FROM act JOIN ver USING (series_key)"),
)
def drift_outcomes(spark, d):
    """The gate's verdict (here: whether a series has an even number of events) written back onto the events that started a retrain."""
    params = DEFAULTS.with_(retrain_cooldown=172800)
    raw = V.metrics(spark, d)
    last = raw.where("cpu_percent > 480").groupBy("series_key").agg(F.max("ts").alias("_at"))
    elapsed = F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros("_at")
    actions = D.monitor_actions(drift_decisions(spark, d).join(last, "series_key", "left"), elapsed < params.retrain_cooldown * 1_000_000, params)
    verdicts = raw.groupBy("series_key").agg((F.count(F.lit(1)) % 2 == 0).alias("promote")).withColumn("model_id", F.concat(F.lit("m-"), "series_key"))
    return D.with_outcomes(actions.select("series_key", "action"), verdicts, ["series_key"])


_COOLDOWN = [
    "alerts AS (SELECT series_key, id, ts, cpu_percent FROM metrics WHERE cpu_percent > 80)",
    "instants AS (SELECT series_key, ts, min(id) AS first_id FROM alerts GROUP BY series_key, ts)",
    "later AS (SELECT series_key, ts, min(ts) OVER (PARTITION BY series_key ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ts FROM instants)",
    "kept AS (SELECT series_key, min(ts) AS ts FROM instants GROUP BY series_key UNION ALL SELECT k.series_key, l.next_ts FROM kept k JOIN later l ON k.series_key = l.series_key AND k.ts = l.ts WHERE l.next_ts IS NOT NULL)",
]


@query(
    "alert_cooldown",
    with_ctes([M, *_COOLDOWN], f"SELECT a.series_key, id, a.ts, {nudge('cpu_percent')} AS cpu_percent, k.ts IS NOT NULL AND id = first_id AS accepted FROM alerts a "
              "JOIN instants i ON a.series_key = i.series_key AND a.ts = i.ts LEFT JOIN kept k ON a.series_key = k.series_key AND a.ts = k.ts").replace("WITH ", "WITH RECURSIVE ", 1),
)
def alert_cooldown(spark, d):
    """Samples above the alert level, and which of them would be filed; the rule depends on the alert filed before."""
    alerts = V.metrics(spark, d).where(F.col("cpu_percent") > DEFAULTS.capacity_alert).select("series_key", "id", "ts", "cpu_percent")
    return D.cooldown(alerts, ["series_key"], "ts", "id", 3600, V.plan(alerts))


# -- breaches and cost -------------------------------------------------------

_EPISODES = [
    "o AS (SELECT series_key, ts, {v} AS v, {v} > {lvl} AS over, row_number() OVER (PARTITION BY series_key ORDER BY ts) AS rn FROM {base} WHERE {v} IS NOT NULL)",
    "g AS (SELECT *, rn - row_number() OVER (PARTITION BY series_key, over ORDER BY ts) AS grp FROM o)",
    "ep AS (SELECT series_key, count(*) AS episodes, max(len) AS longest FROM (SELECT series_key, grp, count(*) AS len FROM g WHERE over GROUP BY ALL) GROUP BY series_key)",
]


def breach_sql(base: str, v: str, lvl: str) -> list[str]:
    return [s.format(base=base, v=v, lvl=lvl) for s in _EPISODES]


_BREACH_OUT = """SELECT o.series_key, count(*) AS samples, count(*) FILTER (WHERE over) AS breaches, round(100.0 * count(*) FILTER (WHERE over) / count(*), 3) AS breach_rate,
  coalesce(any_value(episodes), 0) AS episodes, coalesce(any_value(longest), 0) AS longest_episode, round(coalesce(max(v - {lvl}) FILTER (WHERE over), 0.0), 3) AS worst_overshoot
  FROM o LEFT JOIN ep USING (series_key) GROUP BY o.series_key"""


@query("breach_stats", with_ctes([M, *breach_sql("metrics", "cpu_percent", "90.0")], _BREACH_OUT.format(lvl="90.0")))
def breach_stats(spark, d):
    raw = V.metrics(spark, d)
    return Y.breach_stats(raw, "cpu_percent", 90.0, V.plan(raw))


@query("breach_stats_users", with_ctes([USERS, *breach_sql("metrics", "cpu_percent", "20.0")], _BREACH_OUT.format(lvl="20.0")))
def breach_stats_users(spark, d):
    raw = V.metrics(spark, d, "user_id")
    return Y.breach_stats(raw, "cpu_percent", 20.0, V.plan(raw))


def sweep_sql(target: str) -> list[str]:
    return [
        M,
        "lv AS (SELECT 20.0::DOUBLE + i * 0.5 AS lvl FROM range(161) r(i))",
        f"o AS (SELECT series_key, lvl, ts, {target} > lvl AS over, row_number() OVER (PARTITION BY series_key, lvl ORDER BY ts) AS rn FROM metrics, lv)",
        "g AS (SELECT *, rn - row_number() OVER (PARTITION BY series_key, lvl, over ORDER BY ts) AS grp FROM o)",
        "ep AS (SELECT series_key, lvl, count(*) AS episodes, max(len) AS longest FROM (SELECT series_key, lvl, grp, count(*) AS len FROM g WHERE over GROUP BY ALL) GROUP BY ALL)",
        "b AS (SELECT series_key, lvl, round(100.0 * count(*) FILTER (WHERE over) / count(*), 3) AS breach_rate FROM o GROUP BY ALL)",
        f"curve AS (SELECT series_key, lvl AS allocation_percent, {cost_sql(chr(39) + target + chr(39), 'lvl')} AS monthly_cost, breach_rate, coalesce(episodes, 0) AS episodes, coalesce(longest, 0) AS longest_episode, breach_rate <= 5.0 AS sla_met FROM b LEFT JOIN ep USING (series_key, lvl))",
    ]


def sweep_curve(spark, d, target):
    raw = V.metrics(spark, d)
    return Y.sweep(raw, target, target, V.plan(raw))


@query("sweep_curve", with_ctes(sweep_sql("cpu_percent"), "SELECT * FROM curve"))
def sweep_rows(spark, d):
    return sweep_curve(spark, d, "cpu_percent")


@query("sla_minimum", with_ctes(sweep_sql("mem_percent"), "SELECT * FROM curve WHERE sla_met QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY allocation_percent) = 1"))
def sla_minimum(spark, d):
    return Y.sla_minimum(sweep_curve(spark, d, "mem_percent"))


@query(
    "resource_prices",
    with_ctes(
        [M, "l AS (SELECT id, series_key, target, pct FROM (SELECT id, series_key, cpu_percent, mem_percent, disk_read_mb_s FROM metrics) UNPIVOT (pct FOR target IN (cpu_percent, mem_percent, disk_read_mb_s)))"],
        f"SELECT id, target, round(CASE target WHEN 'cpu_percent' THEN pct / 100.0 * 8.0 WHEN 'mem_percent' THEN pct / 100.0 * 32.0 ELSE pct / 100.0 * 500.0 END, 2) AS units, {cost_sql('target', 'pct')} AS monthly_cost, {cost_sql('target', '100.0')} AS static_cost FROM l",
    ),
)
def resource_prices(spark, d):
    long = Y.to_long(V.metrics(spark, d), DEFAULTS.forecast_targets, ("series_key", "id"))
    return Y.priced(long, "target", "value").select("id", "target", "units", "monthly_cost", "static_cost")


def _raw_cost(target: str, pct: str) -> str:
    r = PRICE[target]
    return f"({pct} / 100.0 * {r.capacity!r}::DOUBLE * {r.rate!r}::DOUBLE * {(730.0 if r.hourly else 1.0)!r}::DOUBLE)"


_NODE_TOTAL = "round(" + " + ".join(_raw_cost(t, f"{t}_a") for t in PRICE) + ", 2)"


@query(
    "node_costs",
    with_ctes(
        [M, "a AS (SELECT id, cpu_percent AS cpu_percent_a, coalesce(CASE WHEN mem_percent < 50 THEN mem_percent END, 100.0) AS mem_percent_a, disk_read_mb_s AS disk_read_mb_s_a FROM metrics)"],
        "SELECT id, " + ", ".join(f"round({_raw_cost(t, t + '_a')}, 2) AS cost_{t}" for t in PRICE) + f", {_NODE_TOTAL} AS cost_total FROM a",
    ),
)
def node_costs(spark, d):
    """Memory above 50 is left out of the allocation and so counts as 100 %."""
    raw = V.metrics(spark, d)
    alloc = {"cpu_percent": F.col("cpu_percent"), "mem_percent": F.when(F.col("mem_percent") < 50, F.col("mem_percent")), "disk_read_mb_s": F.col("disk_read_mb_s")}
    return raw.select("id", *[c.alias(n) for n, c in Y.node_cost(alloc).items()])


# -- recommendation ----------------------------------------------------------

_LONG = "long AS (SELECT series_key, ts, target, value FROM (SELECT series_key, ts, cpu_percent, mem_percent, disk_read_mb_s FROM clean) UNPIVOT (value FOR target IN (cpu_percent, mem_percent, disk_read_mb_s)))"
_RECENT = [
    *HCHAIN, _LONG,
    "tail AS (SELECT *, row_number() OVER (PARTITION BY series_key, target ORDER BY ts DESC) AS k FROM long)",
    "recent AS (SELECT series_key, target, list(value ORDER BY ts) AS recent, max(ts) AS last_ts, first(value ORDER BY ts DESC) AS current FROM tail WHERE k <= 100 GROUP BY ALL)",
]
# levels are searched one by one here, as a check on the direct computation
FLOOR_SQL = """coalesce((SELECT round(min(least(lvl, 100.0)), 2) FROM (SELECT {want} + i * 0.5 AS lvl FROM range(0, 300) r(i)) WHERE lvl < 100.5
  AND round(100.0 * len(list_filter({recent}, lambda v: v > lvl)) / len({recent}), 3) <= 5.0), 100.0)"""
_RECS = [
    *_RECENT,
    "want AS (SELECT *, current AS forecast_p95, least(100.0, current * 1.2) AS w FROM recent)",
    "lvls AS (SELECT series_key, target, recent, w, w + i * 0.5 AS lvl FROM want, range(0, 201) r(i) WHERE w + i * 0.5 < 100.5)",
    "fl AS (SELECT series_key, target, min(lvl) AS lvl FROM lvls WHERE round(100.0 * len(list_filter(recent, lambda v: v > lvl)) / len(recent), 3) <= 5.0 GROUP BY ALL)",
    "rec AS (SELECT want.*, coalesce(round(least(lvl, 100.0), 2), 100.0) AS rp FROM want LEFT JOIN fl USING (series_key, target))",
    f"recs AS (SELECT series_key, target, round(current, 2) AS forecast_peak, round(forecast_p95, 2) AS forecast_p95, round(w, 2) AS forecast_alloc, rp AS recommended_percent, rp > w + 1e-9 AS floored, "
    f"round(CASE target WHEN 'cpu_percent' THEN rp / 100.0 * 8.0 WHEN 'mem_percent' THEN rp / 100.0 * 32.0 ELSE rp / 100.0 * 500.0 END, 2) AS units, {cost_sql('target', 'rp')} AS monthly_cost, {cost_sql('target', '100.0')} AS static_cost, "
    "round(100.0 * len(list_filter(recent, lambda v: v > rp)) / len(recent), 3) AS breach_rate, "
    "len(list_filter(list_zip(recent, list_concat([-1.0], recent[:-2])), lambda p: p[1] > rp AND NOT p[2] > rp)) AS breach_episodes, current FROM rec)",
]


def recommendations(spark, d):
    done, _ = cleaned(spark, d)
    recent = Y.recent_values(Y.to_long(done, DEFAULTS.forecast_targets))
    start = recent.select("series_key", "target", F.col("last_ts").alias("ts"), "current", F.lit(None).cast("double").alias("mae"))
    ahead = P.horizon_summary(P.horizon_forecast(start), ["series_key", "target"])
    return Y.recommend(ahead, recent), recent


@query("recommended_allocation", with_ctes(_RECS, f"SELECT series_key, target, forecast_peak, forecast_p95, forecast_alloc, recommended_percent, floored, units, monthly_cost, static_cost, breach_rate, breach_episodes FROM recs"))
def recommended_allocation(spark, d):
    return recommendations(spark, d)[0]


@query(
    "recommended_node",
    with_ctes(
        [*_RECS, "w2 AS (SELECT series_key, " + ", ".join(f"max(recommended_percent) FILTER (WHERE target = '{t}') AS {t}_a" for t in PRICE) + " FROM recs GROUP BY series_key)",
         f"tot AS (SELECT series_key, round({' + '.join(_raw_cost(t, '100.0') for t in PRICE)}, 2) AS static_total, {_NODE_TOTAL} AS predictive_total FROM w2)"],
        "SELECT series_key, static_total, predictive_total, round(static_total - predictive_total, 2) AS monthly_savings, round(100.0 * round(static_total - predictive_total, 2) / static_total, 2) AS savings_percent FROM tot",
    ),
)
def recommended_node(spark, d):
    return Y.node_recommendation(recommendations(spark, d)[0])


_CAP = "CASE target WHEN 'cpu_percent' THEN 8.0 WHEN 'mem_percent' THEN 32.0 ELSE 500.0 END"


@query(
    "capacity_detail",
    with_ctes(_RECS, f"SELECT series_key, target, {_CAP} AS capacity, round(current, 1) AS current_pct, round(current / 100.0 * {_CAP}, 2) AS current_units, round(forecast_peak, 1) AS forecast_pct, "
              f"round(forecast_peak / 100.0 * {_CAP}, 2) AS forecast_units, recommended_percent AS allocation_pct, round(recommended_percent / 100.0 * {_CAP}, 2) AS allocation_units FROM recs"),
)
def capacity_detail(spark, d):
    recs, recent = recommendations(spark, d)
    return Y.capacity_detail(recs, recent)


@query("capacity_additions", with_ctes(_RECS, f"SELECT series_key, target, round(units / 0.8 - {_CAP}, 4) AS extra_units, round(100.0 * (units / 0.8 - {_CAP}) / {_CAP}, 4) AS extra_pct FROM recs WHERE forecast_peak > 80 AND units / 0.8 - {_CAP} > 0"))
def capacity_additions(spark, d):
    return Y.capacity_additions(recommendations(spark, d)[0])


@query(
    "sla_check_recent",
    with_ctes(
        [M, "tl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts DESC) AS k FROM metrics) WHERE k <= 100)", *breach_sql("tl", "cpu_percent", "60.0")],
        _BREACH_OUT.format(lvl="60.0"),
    ),
)
def sla_check_recent(spark, d):
    from tidewatch.operators.ordering import newest

    raw = newest(V.metrics(spark, d), ["series_key"], [F.desc("ts")], DEFAULTS.safety_window)
    return Y.breach_stats(raw, "cpu_percent", 60.0, V.plan(raw))


_HORIZON = [*_RECENT, "h AS (SELECT series_key, target, last_ts, current, step, 1.96 * 2.0 * sqrt(step / 5.0) AS spread FROM recent, range(1, 21) r(step))"]


@query(
    "horizon_band",
    with_ctes(_HORIZON, f"SELECT series_key, target, step, last_ts + step * INTERVAL 3 SECOND AS ts, {nudge('current')} AS predicted, round(least(100.0, current + spread), 4) AS upper_bound, round(greatest(0.0, current - spread), 4) AS lower_bound FROM h"),
)
def horizon_band(spark, d):
    done, _ = cleaned(spark, d)
    recent = Y.recent_values(Y.to_long(done, DEFAULTS.forecast_targets))
    start = recent.select("series_key", "target", F.col("last_ts").alias("ts"), "current", F.lit(2.0).alias("mae"))
    return P.horizon_forecast(start).select("series_key", "target", "step", "ts", "predicted", "upper_bound", "lower_bound")


@query("horizon_summary", with_ctes(_RECENT, f"SELECT series_key, target, {nudge('current')} AS forecast_peak, {nudge('current')} AS forecast_p95, {nudge('current')} AS forecast_mean, CAST(20 AS BIGINT) AS steps FROM recent"))
def horizon_summary(spark, d):
    done, _ = cleaned(spark, d)
    recent = Y.recent_values(Y.to_long(done, DEFAULTS.forecast_targets))
    start = recent.select("series_key", "target", F.col("last_ts").alias("ts"), "current", F.lit(0.0).alias("mae"))
    return P.horizon_summary(P.horizon_forecast(start), ["series_key", "target"])


@query("stress_test", with_ctes(_RECENT, f"SELECT series_key, target, {nudge('current')} AS peak, {nudge('current * 1.5')} AS stressed_peak FROM recent WHERE target = 'cpu_percent'"))
def stress_test(spark, d):
    """Peak of the forecast with CPU demand as observed and scaled by 1.5."""
    done, _ = cleaned(spark, d)

    def peak(frame, name):
        recent = Y.recent_values(Y.to_long(frame, ["cpu_percent"]))
        start = recent.select("series_key", "target", F.col("last_ts").alias("ts"), "current", F.lit(None).cast("double").alias("mae"))
        return P.horizon_summary(P.horizon_forecast(start), ["series_key", "target"]).select("series_key", "target", F.col("forecast_peak").alias(name))

    return peak(done, "peak").join(peak(T.scale_column(done, "cpu_percent", 1.5), "stressed_peak"), ["series_key", "target"])


@query(
    "forecast_timeline",
    with_ctes(
        [*_RECS, "cl AS (SELECT series_key, ts, cpu_percent AS actual FROM clean QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY ts DESC) <= 50)",
         "last AS (SELECT series_key, max(ts) AS ts, first(actual ORDER BY ts DESC) AS v FROM cl GROUP BY series_key)",
         "un AS (SELECT series_key, ts, actual, NULL::DOUBLE AS forecast, NULL::DOUBLE AS upper_bound, NULL::DOUBLE AS lower_bound, 'actual' AS kind FROM cl UNION ALL SELECT series_key, ts, NULL, v, NULL, NULL, 'bridge' FROM last "
         "UNION ALL SELECT series_key, ts + step * INTERVAL 3 SECOND, NULL, v, round(least(100.0, v + 1.96 * 1.5 * sqrt(step / 5.0)), 4), round(greatest(0.0, v - 1.96 * 1.5 * sqrt(step / 5.0)), 4), 'forecast' FROM last, range(1, 21) r(step))"],
        f"SELECT u.series_key, u.ts, {rounded('actual', 'forecast')}, upper_bound, lower_bound, kind, recommended_percent AS allocated FROM un u JOIN recs ON recs.series_key = u.series_key AND recs.target = 'cpu_percent'",
    ),
)
def forecast_timeline(spark, d):
    done, _ = cleaned(spark, d)
    recs, recent = recommendations(spark, d)
    cpu = recent.where("target = 'cpu_percent'")
    start = cpu.select("series_key", F.col("last_ts").alias("ts"), "current", F.lit(None).cast("double").alias("mae"))
    alloc = recs.where("target = 'cpu_percent'").select("series_key", F.col("recommended_percent").alias("allocated"))
    actuals = done.select("series_key", "ts", F.col("cpu_percent").alias("actual"))
    return P.timeline(actuals, P.horizon_forecast(start), alloc, ["series_key"], 50)


# -- backtest ----------------------------------------------------------------


def backtest_sql(base: list[str], source: str, value: str, forecasts: list[str] = (), expected: str = "recent[-1]", history: str = "hist") -> list[str]:
    """The replay; `forecasts` may turn `hist` into another `history`, whose `expected` level replaces persistence."""
    return [
        *base,
        f"num AS (SELECT series_key, ts, {value} AS v, row_number() OVER (PARTITION BY series_key ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY series_key) AS n FROM {source})",
        "dec AS (SELECT series_key, ts, rn AS start, (rn - 100) // 20 AS step, n FROM num WHERE n >= 140 AND rn >= 100 AND (rn - 100) % 20 = 0 AND rn < n - 20)",
        "hist AS (SELECT d.series_key, d.step, any_value(d.ts) AS ts, list(m.v ORDER BY m.rn) FILTER (WHERE m.rn < d.start) AS recent, list(m.v ORDER BY m.rn) FILTER (WHERE m.rn >= d.start) AS future "
        "FROM dec d JOIN num m ON d.series_key = m.series_key AND m.rn >= d.start - 100 AND m.rn < d.start + 20 GROUP BY d.series_key, d.step)",
        *forecasts,
        f"lean AS (SELECT *, least(100.0, {expected} * 1.2) AS nofloor, least(100.0, list_aggregate(recent, 'quantile_cont', 0.95) * 1.2) AS reactive, least(100.0, list_max(future)) AS oracle FROM {history})",
        "lvl AS (SELECT series_key, step, min(l) AS l FROM (SELECT series_key, step, recent, nofloor + i * 0.5 AS l FROM lean, range(0, 201) r(i) WHERE nofloor + i * 0.5 < 100.5) WHERE round(100.0 * len(list_filter(recent, lambda x: x > l)) / len(recent), 3) <= 5.0 GROUP BY ALL)",
        "pol AS (SELECT lean.*, coalesce(round(least(l, 100.0), 2), 100.0) AS predictive FROM lean LEFT JOIN lvl USING (series_key, step))",
        "trace AS (" + " UNION ALL ".join(
            f"SELECT series_key, step, ts, round(list_max(future), 3) AS actual_peak, '{n}' AS policy, round({x}, 3) AS alloc, len(list_filter(future, lambda q: q > {x})) AS breaches, len(future) AS samples FROM pol"
            for n, x in (("static_100", "100.0"), ("reactive_p95", "reactive"), ("predictive", "predictive"), ("predictive_nofloor", "nofloor"), ("oracle", "oracle"))
        ) + ")",
    ]


def summary_sql(target: str, trace: str = "trace", out: str = "summary") -> list[str]:
    return [
        f"{out}0 AS (SELECT series_key, policy, round(avg(alloc), 2) AS mean_alloc_pct, round(min(alloc), 2) AS min_alloc_pct, sum(breaches)::BIGINT AS breaches, sum(samples)::BIGINT AS samples, count(*) AS decisions, "
        f"{cost_sql(chr(39) + target + chr(39), 'avg(alloc)')} AS monthly_cost, round(100.0 * sum(breaches) / sum(samples), 3) AS breach_rate FROM {trace} GROUP BY ALL)",
        f"{out}1 AS (SELECT *, max(monthly_cost) FILTER (WHERE policy = 'static_100') OVER (PARTITION BY series_key) AS st FROM {out}0)",
        f"{out} AS (SELECT * EXCLUDE (st), round(st - monthly_cost, 2) AS savings_vs_static, coalesce(round(100.0 * round(st - monthly_cost, 2) / nullif(st, 0), 2), 0) AS savings_pct, breach_rate <= 5.0 AS sla_met FROM {out}1)",
    ]


_BT = backtest_sql(HCHAIN, "clean", "cpu_percent")


@query("backtest_trace", with_ctes(_BT, "SELECT series_key, step, ts, actual_peak, policy, alloc, breaches, samples FROM trace"))
def backtest_trace(spark, d):
    done, layout = cleaned(spark, d)
    return B.replay(B.decisions(done, "cpu_percent", layout))


@query(
    "backtest_registered_policy",
    with_ctes(_BT, "SELECT series_key, step, ts, 'recent_peak' AS policy, round(least(100.0, list_max(recent)), 3) AS alloc, len(list_filter(future, lambda q: q > least(100.0, list_max(recent)))) AS breaches, len(future) AS samples FROM pol"),
)
def backtest_registered_policy(spark, d):
    """A policy of one's own, replayed beside none of the built-in ones."""
    done, layout = cleaned(spark, d)
    B.register_policy("recent_peak", lambda params: F.least(F.lit(100.0), F.array_max("recent")))
    try:
        return B.replay(B.decisions(done, "cpu_percent", layout), policies={"recent_peak": B.POLICIES["recent_peak"]}).drop("actual_peak")
    finally:
        B.POLICIES.pop("recent_peak")


@query("backtest_summary", with_ctes([*_BT, *summary_sql("cpu_percent")], "SELECT * FROM summary"))
def backtest_summary(spark, d):
    done, layout = cleaned(spark, d)
    return B.summarise(B.replay(B.decisions(done, "cpu_percent", layout)), F.lit("cpu_percent"))


@query("backtest_raw_samples", with_ctes([*backtest_sql([M, "cs AS (SELECT series_key, ts, least(cpu_percent, 100.0) AS cpu_percent FROM metrics)"], "cs", "cpu_percent"), *summary_sql("cpu_percent")], "SELECT * FROM summary"))
def backtest_raw_samples(spark, d):
    """Replay over every sample of every series, clipped to 100 %."""
    raw = V.metrics(spark, d).withColumn("cpu_percent", F.least("cpu_percent", F.lit(100.0)))
    return B.summarise(B.replay(B.decisions(raw, "cpu_percent", V.plan(raw))), F.lit("cpu_percent"))


def summaries(spark, d):
    """Backtest summary of every forecast target, from one pass over the long table."""
    done, layout = cleaned(spark, d)
    long = Y.to_long(done, DEFAULTS.forecast_targets)
    keys = ["series_key", "target"]
    trace = B.replay(B.decisions(long, "value", layout, keys=keys), keys=keys)
    return B.summarise(trace, F.col("target"), keys)


def _combined_sql() -> list[str]:
    ctes = list(HCHAIN)
    for t in PRICE:
        body = backtest_sql([], "clean", t) + summary_sql(t)
        names = ("num", "dec", "hist", "lean", "lvl", "pol", "trace", "summary0", "summary1", "summary")
        import re

        for n in sorted(names, key=len, reverse=True):
            body = [re.sub(rf"\b{n}\b", f"{n}_{t}", s) for s in body]
        ctes += body
    union = " UNION ALL ".join(f"SELECT *, '{t}' AS target FROM summary_{t}" for t in PRICE)
    return [
        *ctes, f"alls AS ({union})",
        "c0 AS (SELECT series_key, policy, round(sum(monthly_cost), 2) AS monthly_cost, sum(breaches)::BIGINT AS breaches, max(breach_rate) AS worst_breach_rate, "
        "CASE WHEN max(breach_rate) > 0 THEN first(target ORDER BY breach_rate DESC, target DESC) END AS worst_resource FROM alls GROUP BY ALL)",
        "c1 AS (SELECT *, max(monthly_cost) FILTER (WHERE policy = 'static_100') OVER (PARTITION BY series_key) AS st FROM c0)",
        "comb AS (SELECT * EXCLUDE (st), round(st - monthly_cost, 2) AS savings_vs_static, round(100.0 * round(st - monthly_cost, 2) / st, 2) AS savings_pct, worst_breach_rate <= 5.0 AS sla_met FROM c1)",
        "win AS (SELECT series_key, first(policy ORDER BY monthly_cost, policy) FILTER (WHERE sla_met AND policy NOT IN ('static_100', 'oracle')) AS winner, min(monthly_cost) FILTER (WHERE sla_met AND policy NOT IN ('static_100', 'oracle')) AS winner_cost FROM comb GROUP BY series_key)",
    ]


_COMB = _combined_sql()


@query("backtest_node", with_ctes(_COMB, "SELECT * FROM comb"))
def backtest_node(spark, d):
    return B.combined(summaries(spark, d))


def winners(spark, d):
    """Each series plays the part of a scenario."""
    node = B.combined(summaries(spark, d)).withColumnRenamed("series_key", "scenario")
    return B.cheapest_compliant(node, cost="monthly_cost")


@query("scenario_winners", with_ctes(_COMB, "SELECT series_key AS scenario, winner, winner_cost FROM win"))
def scenario_winners(spark, d):
    return winners(spark, d)


@query(
    "scenario_ranking",
    with_ctes(_COMB, "SELECT count(*) AS scenarios, count(*) FILTER (WHERE winner IS NULL) AS unmet, count(DISTINCT winner) AS distinct_winners, coalesce(bool_or(winner <> 'reactive_p95'), false) AS flips FROM win"),
)
def scenario_ranking(spark, d):
    return B.ranking_flips(winners(spark, d))


@query(
    "latest_results",
    "SELECT o_orderpriority AS scenario, o_orderdate AS run_at, o_orderkey, round(o_totalprice + 1e-9, 4) AS cost FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders i WHERE i.o_orderpriority = o.o_orderpriority)",
)
def latest_results(spark, d):
    rows = V.table(spark, d, "orders").select(F.col("o_orderpriority").alias("scenario"), F.col("o_orderdate").cast("timestamp").alias("run_at"), "o_orderkey", F.col("o_totalprice").alias("cost"))
    return B.latest_results(rows, keys=["scenario"], cost="cost")

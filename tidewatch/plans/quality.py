"""Queries: cadence, gaps, gate, profile and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import cadence as G
from tidewatch.operators import clean as K
from tidewatch.operators import gate
from tidewatch.operators.contract import METRICS, coerce
from tidewatch.operators.ordering import settle_large, shared_folder
from tidewatch.params import DEFAULTS
from tidewatch.plans import stages as S
from tidewatch.plans import views as V
from tidewatch.plans.catalog import query, rounded, with_ctes
from tidewatch.sources.writers import export_csv

M = V.metrics_sql()
USERS = V.metrics_sql("user_id")
CHAIN = [M, *S.to_clean("metrics")]
HCHAIN = [M, V.HOURLY_SQL, *S.to_clean("hourly")]
NOW = "2024-01-25"


def segmented(raw):
    layout = V.plan(raw)
    base = K.prepared(raw)
    return G.segment(base, G.detect_cadence(base, layout), layout), layout


# -- cadence and segments ----------------------------------------------------


@query("cadence_by_user", with_ctes([USERS, S.steps_sql("metrics"), S.cadence_sql()], f"SELECT series_key, {rounded('cadence')} FROM cadence"))
def cadence_by_user(spark, d):
    raw = V.metrics(spark, d, "user_id")
    return G.detect_cadence(raw, V.plan(raw))


@query(
    "gaps_by_user",
    with_ctes(
        [USERS, S.steps_sql("metrics"), S.cadence_sql()],
        "SELECT series_key, prev_ts AS gap_start, ts AS gap_end, round(delta, 1) AS gap_seconds, CAST(floor(delta / cadence) AS BIGINT) - 1 AS missed_samples "
        "FROM steps JOIN cadence USING (series_key) WHERE delta > cadence * 2.0",
    ),
)
def gaps_by_user(spark, d):
    raw = V.metrics(spark, d, "user_id")
    layout = V.plan(raw)
    return G.find_gaps(raw, G.detect_cadence(raw, layout), layout)


@query("segments_by_type", with_ctes([M, *S.to_segments("metrics")], f"SELECT series_key, ts, pos, segment_id, {rounded('cadence', 'cpu_percent')} FROM seg"))
def segments_by_type(spark, d):
    out, _ = segmented(V.metrics(spark, d))
    return out.select("series_key", "ts", "pos", "segment_id", "cadence", "cpu_percent")


@query(
    "segment_report",
    with_ctes(
        [USERS, *S.to_segments("metrics"), "sizes AS (SELECT series_key, segment_id, count(*) AS n FROM seg GROUP BY ALL)"],
        "SELECT series_key, count(*) AS segments, count(*) - 1 AS gaps_found, max(n) AS largest_segment_rows, min(n) AS smallest_segment_rows FROM sizes GROUP BY series_key",
    ),
)
def segment_report(spark, d):
    return G.segment_report(segmented(V.metrics(spark, d, "user_id"))[0])


@query(
    "segment_profile",
    with_ctes(
        [
            V.DAILY_SQL, *S.to_segments("daily"),
            "d AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_key, segment_id ORDER BY ts))) / 1e6 AS dd FROM seg)",
            "tally AS (SELECT series_key, segment_id, dd, count(*) AS c FROM d WHERE dd IS NOT NULL GROUP BY ALL)",
            "modes AS (SELECT series_key, segment_id, first(dd ORDER BY c DESC, dd) AS m FROM tally GROUP BY ALL)",
        ],
        "SELECT s.series_key, s.segment_id, count(*) AS rows, min(ts) AS start, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 60.0, 1) AS span_minutes, "
        "round(any_value(m), 1) AS native_cadence_s FROM seg s LEFT JOIN modes USING (series_key, segment_id) GROUP BY s.series_key, s.segment_id",
    ),
)
def segment_profile(spark, d):
    return G.segment_profile(*segmented(V.daily(spark, d)))


@query(
    "counter_rates",
    with_ctes(
        [
            M,
            "c AS (SELECT *, mem_used_mb * 1048576.0 AS counter FROM metrics)",
            "p AS (SELECT *, lag(counter) OVER w AS pc, lag(ts) OVER w AS pt FROM c WINDOW w AS (PARTITION BY series_key ORDER BY ts, id))",
        ],
        "SELECT series_key, id, CASE WHEN counter - pc >= 0 AND ts > pt THEN round((counter - pc) / 1048576.0 / ((epoch_us(ts) - epoch_us(pt)) / 1e6), 2) END AS rate_mb_s FROM p",
    ),
)
def counter_rates(spark, d):
    raw = V.metrics(spark, d).withColumn("counter", F.col("mem_used_mb") * F.lit(1048576.0))
    return G.counter_rate(raw, "counter", V.plan(raw)).select("series_key", "id", "rate_mb_s")


# -- profile and gate --------------------------------------------------------


def _profile_sql(base: str, cols=V.MEASURES) -> str:
    return " UNION ALL ".join(
        f"SELECT series_key, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls, round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) AS null_pct, "
        f"round(min({c}), 3) AS min, round(max({c}), 3) AS max, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 4) AS std, count(DISTINCT {c}) AS distinct_values FROM {base} GROUP BY series_key"
        for c in cols
    )


@query("profile_columns", with_ctes([M, V.DIRTY_SQL], _profile_sql("dirty")))
def profile_columns(spark, d):
    return gate.profile(coerce(V.dirty(spark, d)), V.MEASURES)


GATE_SQL = [
    f"""facts AS (SELECT series_key, count(*) AS n, count(*) FILTER (WHERE ts IS NULL) AS bad, count(*) FILTER (WHERE ts > TIMESTAMP '{NOW}' + INTERVAL 5 MINUTE) AS future,
  {' + '.join(f"count(*) FILTER (WHERE {c} < 0)" for c in V.MEASURES)} + count(*) FILTER (WHERE cpu_percent > 100) + count(*) FILTER (WHERE mem_percent > 100) AS outside,
  (count(*) FILTER (WHERE ts IS NULL) > 0)::INT + {' + '.join(f"(count(*) FILTER (WHERE {c} < 0) > 0)::INT" for c in V.MEASURES)} + (count(*) FILTER (WHERE cpu_percent > 100) > 0)::INT + (count(*) FILTER (WHERE mem_percent > 100) > 0)::INT AS broken,
  greatest(avg((cpu_percent IS NULL)::INT), avg((mem_percent IS NULL)::INT)) AS worst, coalesce((stddev_samp(cpu_percent) < 0.25)::INT, 0) + coalesce((stddev_samp(mem_percent) < 0.25)::INT, 0) AS flat,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span, count(*) - count(DISTINCT ts) - (count(*) FILTER (WHERE ts IS NULL) > 0)::INT AS dup_ts FROM gated GROUP BY series_key)""",
    "arrival AS (SELECT series_key, count(*) FILTER (WHERE ts < prev) AS unsorted FROM (SELECT series_key, ts, lag(ts) OVER (PARTITION BY series_key ORDER BY id) AS prev FROM gated) GROUP BY series_key)",
    "same AS (SELECT series_key, sum(c - 1)::BIGINT AS dup_rows FROM (SELECT series_key, count(*) AS c FROM gated GROUP BY series_key, id, ts, " + ", ".join(V.MEASURES) + ") GROUP BY series_key)",
    S.steps_sql("gated"),
    S.cadence_sql(),
    "gaps AS (SELECT series_key, count(*) AS gaps FROM steps JOIN cadence USING (series_key) WHERE delta > cadence * 2.0 GROUP BY series_key)",
    "f AS (SELECT facts.*, unsorted, dup_rows, cadence, coalesce(gaps, 0) AS gaps, coalesce(n / nullif(span / cadence, 0), 0) AS coverage FROM facts JOIN arrival USING (series_key) JOIN same USING (series_key) JOIN cadence USING (series_key) LEFT JOIN gaps USING (series_key))",
    "checks AS ("
    + " UNION ALL ".join(
        f"SELECT series_key, '{name}' AS check_name, CASE WHEN {bad} THEN '{verdict}' ELSE 'PASS' END AS status, CAST({value} AS DOUBLE) AS value FROM f"
        for name, bad, verdict, value in (
            ("row_count", "n < 50", "FAIL", "n"),
            ("schema_contract", "broken > 0", "FAIL", "broken"),
            ("timestamp_parseable", "bad > 0", "FAIL", "bad"),
            ("timestamp_monotonic", "unsorted > 0", "WARN", "unsorted"),
            ("timestamp_not_future", "future > 0", "FAIL", "future"),
            ("duplicate_timestamps", "dup_ts / n > 0.02", "FAIL", "dup_ts"),
            ("duplicate_rows", "dup_rows > 0", "WARN", "dup_rows"),
            ("target_nulls", "worst > 0.05", "FAIL", "round(worst, 4)"),
            ("value_ranges", "outside > 0", "FAIL", "outside"),
            ("cadence", "abs(cadence - 3) > 1.5", "WARN", "round(cadence, 2)"),
            ("collection_gaps", "gaps > 0", "WARN", "gaps"),
            ("target_variability", "flat > 0", "WARN", "flat"),
            ("coverage", "coverage < 0.8", "WARN", "round(coverage, 3)"),
        )
    )
    + ")",
]
VERDICTS = """SELECT series_key, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'WARN') AS warned, count(*) FILTER (WHERE status = 'FAIL') AS failed,
  CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE status = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END AS verdict,
  count(*) FILTER (WHERE status = 'FAIL') = 0 AS should_proceed FROM checks GROUP BY series_key"""


def gate_checks(raw):
    typed = settle_large(coerce(raw))
    sized = V.plan(typed.where(F.col("ts").isNotNull()))
    arrival = V.plan(typed, "id") if not sized.single else sized
    return gate.run_checks(typed, NOW, sized, arrival=arrival)


@query("gate_checks_dirty", with_ctes([M, V.DIRTY_SQL, "gated AS (SELECT * FROM dirty)", *GATE_SQL], "SELECT series_key, check_name, status, value FROM checks"))
def gate_checks_dirty(spark, d):
    return gate_checks(V.dirty(spark, d)).drop("detail")


@query("gate_checks_users", with_ctes([USERS, "gated AS (SELECT * FROM metrics)", *GATE_SQL], "SELECT series_key, check_name, status, value FROM checks"))
def gate_checks_users(spark, d):
    return gate_checks(V.metrics(spark, d, "user_id")).drop("detail")


@query("gate_verdicts", with_ctes([M, V.DIRTY_SQL, "gated AS (SELECT * FROM dirty)", *GATE_SQL], VERDICTS))
def gate_verdicts(spark, d):
    return gate.summarise(gate_checks(V.dirty(spark, d)))


@query("gate_verdicts_daily", with_ctes([V.DAILY_SQL, "gated AS (SELECT * FROM daily)", *GATE_SQL], VERDICTS))
def gate_verdicts_daily(spark, d):
    return gate.summarise(gate_checks(V.daily(spark, d)))


# -- cleaning ----------------------------------------------------------------


@query("deduplicate_daily", with_ctes([V.DAILY_SQL, S.dedup_sql("daily")], f"SELECT series_key, ts, {rounded(*V.MEASURES)} FROM dedup"))
def deduplicate_daily(spark, d):
    return K.deduplicate(V.daily(spark, d))


@query("clip_to_contract", with_ctes([M, f"c AS (SELECT series_key, id, ts, {', '.join(S.clip(c) for c in V.MEASURES)} FROM metrics)"], f"SELECT series_key, id, ts, {rounded(*V.MEASURES)} FROM c"))
def clip_to_contract(spark, d):
    return K.clip_ranges(V.metrics(spark, d))


@query(
    "clipped_counts",
    with_ctes([M], "SELECT series_key, " + ", ".join(f"count(*) FILTER (WHERE {c} < 0{' OR ' + c + ' > 100' if c in S.TARGETS else ''}) AS {c}" for c in V.MEASURES) + " FROM metrics GROUP BY series_key"),
)
def clipped_counts(spark, d):
    counts = K.clipped_counts(V.metrics(spark, d))
    return V.metrics(spark, d).groupBy("series_key").agg(*[agg.alias(c) for c, agg in counts.items()])


@query(
    "regrid_samples",
    with_ctes([M, *S.to_segments("metrics"), S.grid_sql()], f"SELECT series_key, segment_id, slot, ts, is_imputed, observations, {rounded(*V.MEASURES)} FROM grid"),
)
def regrid_samples(spark, d):
    raw = V.metrics(spark, d)
    return K.gridded(raw, V.plan(raw))


@query(
    "regrid_hourly",
    with_ctes([M, V.HOURLY_SQL, *S.to_segments("hourly"), S.grid_sql()], f"SELECT series_key, segment_id, slot, ts, is_imputed, observations, {rounded(*V.MEASURES)} FROM grid"),
)
def regrid_hourly(spark, d):
    raw = V.hourly(spark, d)
    return K.gridded(raw, V.plan(raw))


@query(
    "hampel_flags",
    with_ctes(
        [M, V.HOURLY_SQL, *S.to_segments("hourly"), S.grid_sql(), S.hampel_sql()],
        f"SELECT series_key, segment_id, slot, {rounded('cpu_percent', 'mem_percent')}, cpu_percent_is_outlier, mem_percent_is_outlier, is_outlier FROM flagged",
    ),
)
def hampel_flags(spark, d):
    raw = V.hourly(spark, d)
    layout = V.plan(raw)
    flagged = K.flag_outliers(K.gridded(raw, layout), layout)
    return flagged.select("series_key", "segment_id", "slot", *S.TARGETS, "cpu_percent_is_outlier", "mem_percent_is_outlier", "is_outlier")


def _repaired(spark, d, strategy):
    params = DEFAULTS.with_(outlier_strategy=strategy)
    raw = V.hourly(spark, d)
    layout = V.plan(raw)
    flagged = K.flag_outliers(K.gridded(raw, layout), layout, params=params, keep_median=True)
    return K.repair_outliers(flagged, layout, params=params).select("series_key", "segment_id", "slot", *S.TARGETS)


@query(
    "repair_by_median",
    with_ctes(
        [M, V.HOURLY_SQL, *S.to_segments("hourly"), S.grid_sql(), S.hampel_sql()],
        "SELECT series_key, segment_id, slot, " + S.each("round(CASE WHEN {c}_is_outlier = 1 THEN m_{c} ELSE {c} END + 1e-9, 4) AS {c}", S.TARGETS) + " FROM flagged",
    ),
)
def repair_by_median(spark, d):
    return _repaired(spark, d, "clip")


_HOLED = "holed AS (SELECT series_key, segment_id, slot, " + S.each(
    "{c} AS raw_{c}, max({c}_is_outlier) OVER (PARTITION BY series_key) AS any_{c}, CASE WHEN {c}_is_outlier = 0 THEN {c} END AS {c}", S.TARGETS
) + " FROM flagged)"


@query(
    "repair_by_interpolation",
    with_ctes(
        [M, V.HOURLY_SQL, *S.to_segments("hourly"), S.grid_sql(), S.hampel_sql(), _HOLED, f"near AS (SELECT *, {S.known_sql(S.TARGETS)} FROM holed {S.FRAMES})"],
        "SELECT series_key, segment_id, slot, "
        + S.each(
            "round(CASE WHEN any_{c} = 0 THEN raw_{c} WHEN {c} IS NOT NULL THEN {c} WHEN pv_{c} IS NOT NULL AND nv_{c} IS NOT NULL "
            "THEN pv_{c} + (nv_{c} - pv_{c}) * (slot - pp_{c}) / (np_{c} - pp_{c}) ELSE coalesce(pv_{c}, nv_{c}) END + 1e-9, 4) AS {c}",
            S.TARGETS,
        )
        + " FROM near",
    ),
)
def repair_by_interpolation(spark, d):
    return _repaired(spark, d, "interpolate")


@query(
    "impute_bounded",
    with_ctes(
        [
            M, V.HOURLY_SQL, *S.to_segments("hourly"), S.grid_sql(),
            "holed AS (SELECT series_key, segment_id, slot, is_imputed, " + S.each("CASE WHEN cpu_percent < 90 THEN {c} END AS {c}") + " FROM grid)",
            S.impute_sql("holed"),
        ],
        "SELECT series_key, segment_id, slot, is_imputed, " + S.each("round(f_{c} + 1e-9, 4) AS {c}") + " FROM imputed",
    ),
)
def impute_bounded(spark, d):
    """Longer runs of nulls (all hours at 90 % and above are blanked) keep an unfilled middle."""
    raw = V.hourly(spark, d)
    layout = V.plan(raw)
    grid = K.gridded(raw, layout)
    holed = grid.withColumns({c: F.when(F.col("cpu_percent") < 90, F.col(c)) for c in V.MEASURES})
    return K.impute(holed, layout).select("series_key", "segment_id", "slot", "is_imputed", *V.MEASURES)


CLEAN_OUT = f"SELECT series_key, segment_id, slot, ts, {rounded(*V.MEASURES)}, is_imputed, is_outlier FROM clean"
CLEAN_COLS = ["series_key", "segment_id", "slot", "ts", *V.MEASURES, "is_imputed", "is_outlier"]


@query("clean_samples", with_ctes(CHAIN, CLEAN_OUT))
def clean_samples(spark, d):
    return K.clean(V.metrics(spark, d)).select(*CLEAN_COLS)


@query("clean_users", with_ctes([USERS, *S.to_clean("metrics")], CLEAN_OUT))
def clean_users(spark, d):
    return K.clean(V.metrics(spark, d, "user_id")).select(*CLEAN_COLS)


@query("clean_hourly", with_ctes(HCHAIN, CLEAN_OUT))
def clean_hourly(spark, d):
    return K.clean(V.hourly(spark, d)).select(*CLEAN_COLS)


@query("clean_csv_export", with_ctes(HCHAIN, CLEAN_OUT))
def clean_csv_export(spark, d):
    """Clean series out to CSV and back."""
    rows, path = K.clean(V.hourly(spark, d)).select(*CLEAN_COLS), shared_folder(spark) + "/clean_csv"
    export_csv(rows, path, ["series_key", "segment_id", "slot"])
    return spark.read.option("header", True).schema(rows.schema).csv(path)


@query("clean_daily", with_ctes([V.DAILY_SQL, *S.to_clean("daily")], CLEAN_OUT))
def clean_daily(spark, d):
    return K.clean(V.daily(spark, d)).select(*CLEAN_COLS)


@query(
    "cleaning_audit",
    with_ctes(
        [
            M, V.DIRTY_SQL, *S.to_clean("dirty"),
            "a AS (SELECT series_key, count(*) AS rows_in, count(*) FILTER (WHERE ts IS NULL) AS dropped_no_timestamp, count(ts) - count(DISTINCT ts) AS duplicates_merged FROM dirty GROUP BY series_key)",
            "b AS (SELECT series_key, count(*) FILTER (WHERE cpu_percent > 100) + count(*) FILTER (WHERE mem_percent > 100) AS values_clipped FROM dedup GROUP BY series_key)",
            "z AS (SELECT series_key, segment_id, count(*) AS n FROM seg GROUP BY ALL)",
            "s AS (SELECT series_key, count(*) AS segments, count(*) - 1 AS gaps_found, max(n) AS largest_segment_rows, min(n) AS smallest_segment_rows FROM z GROUP BY series_key)",
            "e AS (SELECT series_key, sum(is_imputed)::BIGINT AS synthetic_rows, count(*) FILTER (WHERE observations > 1) AS collided_slots, sum(is_outlier)::BIGINT AS outlier_rows, "
            + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL AND f_{c} IS NOT NULL)" for c in V.MEASURES)
            + " AS values_imputed, count(*) FILTER (WHERE f_cpu_percent IS NULL OR f_mem_percent IS NULL) AS dropped_unfillable, count(*) FILTER (WHERE f_cpu_percent IS NOT NULL AND f_mem_percent IS NOT NULL) AS rows_out FROM imputed GROUP BY series_key)",
        ],
        "SELECT * FROM a JOIN b USING (series_key) JOIN s USING (series_key) JOIN e USING (series_key)",
    ),
)
def cleaning_audit(spark, d):
    typed = settle_large(coerce(V.dirty(spark, d)))
    return K.audit(typed, V.plan(typed.where(F.col("ts").isNotNull())))


@query(
    "provenance_counts",
    with_ctes(HCHAIN, "SELECT series_key, count(*) FILTER (WHERE is_imputed = 0) AS measured, count(*) FILTER (WHERE is_imputed = 1) AS imputed, count(*) FILTER (WHERE is_outlier = 1) AS outliers FROM clean GROUP BY series_key"),
)
def provenance_counts(spark, d):
    done = K.clean(V.hourly(spark, d))
    return done.groupBy("series_key").agg(
        F.count_if(F.col("is_imputed") == 0).alias("measured"), F.count_if(F.col("is_imputed") == 1).alias("imputed"), F.count_if(F.col("is_outlier") == 1).alias("outliers")
    )

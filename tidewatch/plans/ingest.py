"""Queries: reading, shaping, contract, and loading."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import contract as C
from tidewatch.operators import runlog as L
from tidewatch.operators.contract import METRICS
from tidewatch.operators.ordering import cut_lineage, shared_folder
from tidewatch.params import DEFAULTS
from tidewatch.plans import views as V
from tidewatch.plans.catalog import query, rounded, with_ctes
from tidewatch.sources import readers as R
from tidewatch.sources import writers as W
from tidewatch.streaming.jobs import mirror_sink

M = V.metrics_sql()
ALL = rounded(*V.MEASURES)


@query(
    "scan_time_window",
    with_ctes([M], f"SELECT series_key, id, ts, {ALL} FROM metrics WHERE ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-15'"),
)
def scan_time_window(spark, d):
    return R.window(V.metrics(spark, d), "2024-01-08", "2024-01-15")


@query(
    "scan_first_rows",
    with_ctes([M], "SELECT id, ts, series_key FROM metrics WHERE ts >= TIMESTAMP '2024-01-08' ORDER BY ts LIMIT 100"),
)
def scan_first_rows(spark, d):
    return R.window(V.metrics(spark, d), "2024-01-08", limit=100).select("id", "ts", "series_key")


@query("scan_after_watermark", with_ctes([M], f"SELECT series_key, id, ts, {ALL} FROM metrics WHERE ts > TIMESTAMP '2024-01-20 12:00:00'"))
def scan_after_watermark(spark, d):
    return R.newer_than(V.metrics(spark, d), "2024-01-20 12:00:00")


@query("scan_unusable_watermark", with_ctes([M], "SELECT series_key, count(*) AS rows, max(ts) AS watermark FROM metrics GROUP BY series_key"))
def scan_unusable_watermark(spark, d):
    """A watermark that cannot be read means a full read."""
    return R.newer_than(V.metrics(spark, d), "gibberish").groupBy("series_key").agg(F.count(F.lit(1)).alias("rows"), F.max("ts").alias("watermark"))


@query("peek_newest", with_ctes([M], "SELECT id, ts, series_key FROM metrics ORDER BY ts DESC LIMIT 50"))
def peek_newest(spark, d):
    return R.peek(V.metrics(spark, d), 50).select("id", "ts", "series_key")


@query("latest_by_id", with_ctes([M], f"SELECT id, ts, {rounded('cpu_percent')} FROM metrics ORDER BY id DESC LIMIT 10"))
def latest_by_id(spark, d):
    return R.latest_by_id(V.metrics(spark, d), 10).select("id", "ts", "cpu_percent")


@query(
    "range_counts",
    with_ctes([M], "SELECT series_key, count(*) AS rows FROM metrics WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' GROUP BY series_key"),
)
def range_counts(spark, d):
    return R.window(V.metrics(spark, d), "2024-01-05", "2024-01-25").groupBy("series_key").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "conform_shape",
    "SELECT CAST(NULL AS BIGINT) AS id, ts, round(value + 1e-9, 4) AS cpu_percent, CAST(NULL AS DOUBLE) AS mem_percent, CAST(NULL AS DOUBLE) AS mem_used_mb, "
    "CAST(NULL AS DOUBLE) AS disk_read_mb_s, CAST(NULL AS DOUBLE) AS disk_write_mb_s, event_type, user_id FROM events",
)
def conform_shape(spark, d):
    """Absent contract columns appear as nulls, in contract order, extras behind them."""
    raw = V.table(spark, d, "events").select("event_type", F.col("value").alias("cpu_percent"), F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return C.conform(raw)


@query(
    "source_inventory",
    "SELECT 'events' AS source, count(*) AS rows, 'ready' AS status FROM events UNION ALL SELECT 'orders', count(*), 'ready' FROM orders "
    "UNION ALL SELECT 'lineitem', count(*), 'ready' FROM lineitem",
)
def source_inventory(spark, d):
    return R.inventory({n: V.table(spark, d, n) for n in ("events", "orders", "lineitem")})


@query("csv_source", with_ctes([M], f"SELECT series_key, id, ts, {ALL} FROM metrics"))
def csv_source(spark, d):
    """Export to CSV, read the files back as text, coerce."""
    path = W.shared_folder(spark) + "/metrics"
    raw = V.metrics(spark, d)
    W.export_csv(raw, path, ["ts"])
    return C.coerce(R.read_csv(spark, path)).select("series_key", "id", "ts", *V.MEASURES)


@query("json_source", "SELECT event_id AS id, ts, event_type AS series_key, round(value + 1e-9, 4) AS cpu_percent FROM events")
def json_source(spark, d):
    """Files of {"data": [records]} objects, one per line, written and read by tasks."""
    path = W.shared_folder(spark) + "/payload"
    record = F.struct(
        F.col("event_id").alias("id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
        F.col("event_type").alias("series_key"),
        F.col("value").alias("cpu_percent"),
    )
    V.table(spark, d, "events").select(F.array(record).alias("data")).write.mode("overwrite").json(path)
    records = R.read_json(spark, path, schema="data array<struct<id: bigint, ts: string, series_key: string, cpu_percent: double>>", lines=True)
    return C.coerce(records, METRICS.without(*V.MEASURES[1:])).select("id", "ts", "series_key", "cpu_percent")


@query(
    "raw_corrections",
    with_ctes(
        [M],
        f"""SELECT m.series_key, m.id, m.ts, {', '.join(f'round(coalesce({"k.new_value" if c == "cpu_percent" else "NULL"}, m.{c}) + 1e-9, 4) AS {c}' for c in V.MEASURES)}
        FROM metrics m LEFT JOIN (SELECT o_orderkey AS id, o_totalprice / 10000.0 AS new_value FROM orders WHERE o_orderstatus = 'F') k ON m.id = k.id
        WHERE m.id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""",
    ),
)
def raw_corrections(spark, d):
    """orders as corrections of samples: finished ones set a value, pending ones delete."""
    orders = V.table(spark, d, "orders")
    changes = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 10000.0).alias("cpu_percent"))
    deletes = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    return W.corrected(V.metrics(spark, d), changes, deletes, V.MEASURES)


@query("retention_keep", with_ctes([M], f"SELECT series_key, id, ts, {ALL} FROM metrics WHERE ts >= TIMESTAMP '2024-02-10' - INTERVAL 30 DAY"))
def retention_keep(spark, d):
    return W.retained(V.metrics(spark, d), "2024-02-10", DEFAULTS.retention_days)


@query(
    "orphans_pruned",
    with_ctes([V.RUNS_SQL, V.CHECKS_SQL], f"SELECT run_id, check_name, status, {rounded('value')} FROM checks WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'success')"),
)
def orphans_pruned(spark, d):
    return L.without_orphans(V.checks(spark, d), V.runs(spark, d)).select("run_id", "check_name", "status", "value")


@query(
    "orphans_found",
    with_ctes([V.RUNS_SQL, V.CHECKS_SQL], "SELECT status, count(*) AS rows FROM checks WHERE run_id NOT IN (SELECT run_id FROM runs WHERE status = 'success') GROUP BY status"),
)
def orphans_found(spark, d):
    return L.orphans(V.checks(spark, d), V.runs(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "load_and_read_run",
    with_ctes([M], f"SELECT series_key, id, ts, {ALL}, CAST(2 AS BIGINT) AS run_id FROM metrics WHERE cpu_percent <= 100"),
)
def load_and_read_run(spark, d):
    """Load two runs, load the second again, and read it back: the second load replaced the first of that run."""
    path, raw = W.shared_folder(spark) + "/clean", V.metrics(spark, d)
    W.load_run(raw, 1, path)
    W.load_run(raw, 2, path)
    W.load_run(raw.where("cpu_percent <= 100"), 2, path)
    return W.read_run(spark, path, 2)


# -- contract ----------------------------------------------------------------


@query(
    "coerce_types",
    """SELECT event_id AS id, CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS ts, round(CASE WHEN event_type = 'view' THEN NULL ELSE value END + 1e-9, 4) AS cpu_percent,
    CAST(NULL AS DOUBLE) AS mem_percent, CAST(NULL AS DOUBLE) AS mem_used_mb, CAST(NULL AS DOUBLE) AS disk_read_mb_s, CAST(NULL AS DOUBLE) AS disk_write_mb_s, event_type FROM events""",
)
def coerce_types(spark, d):
    """Everything arrives as text; what cannot be read becomes null."""
    e = V.table(spark, d, "events")
    text = e.select(
        F.col("event_id").cast("string").alias("id"),
        F.when(F.col("event_type") == "error", "no time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("ts"),
        F.when(F.col("event_type") == "view", "n/a").otherwise(F.col("value").cast("string")).alias("cpu_percent"),
        "event_type",
    )
    return C.coerce(text)


_BREACH = ", ".join(
    f"count(*) FILTER (WHERE {c} < 0) AS lo_{c}" + (f", count(*) FILTER (WHERE {c} > 100) AS hi_{c}" if c in ("cpu_percent", "mem_percent") else "") for c in V.MEASURES
)
_LONG = " UNION ALL ".join(
    [f"SELECT series_key, 'ts' AS column_name, 'null_in_non_nullable' AS kind, bad AS breaches FROM w"]
    + [f"SELECT series_key, '{c}', 'below_min', lo_{c} FROM w" for c in V.MEASURES]
    + [f"SELECT series_key, '{c}', 'above_max', hi_{c} FROM w" for c in ("cpu_percent", "mem_percent")]
)


@query(
    "contract_breaches",
    with_ctes([M, V.DIRTY_SQL, f"w AS (SELECT series_key, count(*) FILTER (WHERE ts IS NULL) AS bad, {_BREACH} FROM dirty GROUP BY series_key)"], f"SELECT * FROM ({_LONG}) WHERE breaches > 0"),
)
def contract_breaches(spark, d):
    """The contract is read from its own rule rows."""
    contract = C.contract_from(C.contract_rows(spark, METRICS))
    return C.validate(C.coerce(V.dirty(spark, d), contract), contract, ["series_key"])


@query(
    "contract_conformity",
    with_ctes([M, V.DIRTY_SQL, f"w AS (SELECT series_key, count(*) FILTER (WHERE ts IS NULL) AS bad, {_BREACH} FROM dirty GROUP BY series_key)", f"k AS (SELECT * FROM ({_LONG}) AS l(series_key, column_name, kind, breaches))"],
              "SELECT series_key, sum(breaches) = 0 AS conforms, CAST(sum(breaches) AS BIGINT) AS breaches, count(*) FILTER (WHERE breaches > 0) AS kinds, 'note' AS undeclared FROM k GROUP BY series_key"),
)
def contract_conformity(spark, d):
    """One verdict for each series, with the columns nobody declared."""
    contract = C.contract_from(C.contract_rows(spark, METRICS))
    return C.conformity(C.coerce(V.dirty(spark, d), contract).withColumn("note", F.lit("x")), contract, ["series_key"])


@query(
    "contract_differences",
    "SELECT event_type AS series_key, kind, column_name, count(*) AS rows FROM events, (VALUES ('missing', 'disk_read_mb_s'), ('missing', 'mem_used_mb'), ('undeclared', 'note')) v(kind, column_name) GROUP BY ALL",
)
def contract_differences(spark, d):
    """Columns a table lacks or has beyond its contract, for every series."""
    raw = V.metrics(spark, d).drop("mem_used_mb", "disk_read_mb_s").withColumn("note", F.lit("x"))
    found = C.column_differences(raw.drop("series_key", "id"), METRICS.without("series_key", "id"))
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("column_name")) for kind, names in found.items() for c in names])
    return raw.groupBy("series_key").agg(F.count(F.lit(1)).alias("rows")).select("series_key", F.inline(rows), "rows")


@query(
    "contract_missing_columns",
    "SELECT event_type, c.column_name, 'missing_column' AS kind, count(*) AS breaches FROM events, "
    "(VALUES ('mem_percent'), ('mem_used_mb'), ('disk_read_mb_s'), ('disk_write_mb_s')) c(column_name) GROUP BY ALL "
    "UNION ALL SELECT event_type, 'cpu_percent', 'above_max', count(*) FILTER (WHERE value > 100) FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE value > 100) > 0",
)
def contract_missing_columns(spark, d):
    raw = V.table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("value").alias("cpu_percent"), "event_type")
    return C.validate(raw, METRICS, ["event_type"])


@query(
    "contract_upsert",
    """WITH rules AS (SELECT n_name AS table_name, r_name AS column_name, CAST(n_nationkey AS DOUBLE) AS min_value FROM nation JOIN region ON n_regionkey = r_regionkey),
    changes AS (SELECT n_name AS table_name, r_name AS column_name, max(s_acctbal) AS min_value FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
    SELECT table_name, column_name, round(min_value + 1e-9, 4) AS min_value FROM rules r WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.table_name = r.table_name AND c.column_name = r.column_name)
    UNION ALL SELECT table_name, column_name, round(min_value + 1e-9, 4) FROM changes""",
)
def contract_upsert(spark, d):
    """Rule rows from nation and region, replaced where supplier has a newer bound."""
    nation, region = V.table(spark, d, "nation"), V.table(spark, d, "region")
    names = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    rules = names.select(F.col("n_name").alias("table_name"), F.col("r_name").alias("column_name"), F.col("n_nationkey").cast("double").alias("min_value"))
    supplier = V.table(spark, d, "supplier")
    changes = (
        supplier.join(names, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("table_name"), F.col("r_name").alias("column_name"))
        .agg(F.max("s_acctbal").alias("min_value"))
    )
    return C.upsert_rules(rules, changes)


@query("stream_source", with_ctes([M], "SELECT series_key, CASE WHEN ts <= TIMESTAMP '2024-01-20 12:00:00' THEN 1 ELSE 2 END AS round, count(*) AS rows, max(ts) AS newest FROM metrics GROUP BY ALL"))
def stream_source(spark, d):
    """Two rounds over a stream's mirror: the second asks for what is newer than the first has seen."""
    raw = V.metrics(spark, d)
    path = f"{shared_folder(spark)}/mirror"
    sink = mirror_sink(path)
    sink(raw.where("ts <= '2024-01-20 12:00:00'"), 0)
    first = R.get_source(spark, f"stream://{path}", METRICS)
    mark = R.next_watermark(first).first()["watermark"]
    counted = cut_lineage(first.withColumn("round", F.lit(1)))
    sink(raw.where("ts > '2024-01-20 12:00:00'"), 1)
    second = R.get_source(spark, f"stream://{path}", METRICS, since=str(mark)).withColumn("round", F.lit(2))
    return counted.unionByName(second).groupBy("series_key", "round").agg(F.count(F.lit(1)).alias("rows"), F.max("ts").alias("newest"))


@query("registered_source", with_ctes([M], f"SELECT series_key, id, ts, {ALL} FROM metrics WHERE ts > TIMESTAMP '2024-01-29'"))
def registered_source(spark, d):
    """A scheme of one's own beside the built-in ones."""
    R.register_source("lastday", lambda s, path: R.newer_than(V.metrics(s, path), "2024-01-29 00:00:00"))
    try:
        return R.get_source(spark, f"lastday://{d}", METRICS).select("series_key", "id", "ts", *V.MEASURES)
    finally:
        R.SOURCES.pop("lastday")

"""Series shaped like utilisation metrics, derived from the driver tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.ordering import Layout
from tidewatch.operators.transform import label_regimes

MEASURES = ("cpu_percent", "mem_percent", "mem_used_mb", "disk_read_mb_s", "disk_write_mb_s")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metrics(spark: SparkSession, sf_dir: str, series: str = "event_type") -> DataFrame:
    """events as samples: value is CPU, the number in props is memory."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        F.col(series).cast("string").alias("series_key"),
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("cpu_percent"),
        k.alias("mem_percent"),
        (k * 327.68).alias("mem_used_mb"),
        (F.col("value") / 9.7).alias("disk_read_mb_s"),
        (k / 20.0).alias("disk_write_mb_s"),
    )


def metrics_sql(series: str = "event_type", name: str = "metrics") -> str:
    k = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
    return f"""{name} AS (SELECT CAST({series} AS VARCHAR) AS series_key, event_id AS id, ts, value AS cpu_percent,
  {k} AS mem_percent, {k} * 327.68 AS mem_used_mb, value / 9.7 AS disk_read_mb_s, {k} / 20.0 AS disk_write_mb_s FROM events)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as samples per return flag and ship day; many samples share a day."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("series_key"),
        F.col("l_orderkey").alias("id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_quantity") * 2.2).alias("cpu_percent"),
        (F.col("l_discount") * 900.0).alias("mem_percent"),
        F.col("l_extendedprice").alias("mem_used_mb"),
        (F.col("l_tax") * 100.0).alias("disk_read_mb_s"),
        (F.col("l_quantity") / 10.0).alias("disk_write_mb_s"),
    )


DAILY_SQL = """daily AS (SELECT l_returnflag AS series_key, l_orderkey AS id, l_shipdate AS ts, l_quantity * 2.2 AS cpu_percent,
  l_discount * 900.0 AS mem_percent, l_extendedprice AS mem_used_mb, l_tax * 100.0 AS disk_read_mb_s, l_quantity / 10.0 AS disk_write_mb_s FROM lineitem)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means per event type: a nearly regular series with holes."""
    raw = metrics(spark, sf_dir)
    return raw.groupBy("series_key", F.window("ts", "1 hour")["start"].alias("ts")).agg(*[F.avg(m).alias(m) for m in MEASURES])


HOURLY_SQL = "hourly AS (SELECT series_key, time_bucket(INTERVAL '1 hour', ts) AS ts, " + ", ".join(
    f"avg({m}) AS {m}" for m in MEASURES
) + " FROM metrics GROUP BY ALL)"


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with faults: text timestamps, some unreadable; nulls; late arrivals; repeated rows."""
    raw = metrics(spark, sf_dir)
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    faulty = raw.select(
        "series_key",
        F.when(F.col("mem_percent") == 13, -F.col("id")).otherwise(F.col("id")).alias("id"),
        F.when(F.col("mem_percent") == 7, F.lit("not a time")).otherwise(text).alias("ts"),
        F.when(F.col("cpu_percent") < 400, F.col("cpu_percent")).alias("cpu_percent"),
        *MEASURES[1:],
    )
    return faulty.unionByName(faulty.where(F.col("cpu_percent") < 0.5))


DIRTY_SQL = """faulty AS (SELECT series_key, CASE WHEN mem_percent = 13 THEN -id ELSE id END AS id,
  CASE WHEN mem_percent = 7 THEN NULL ELSE ts END AS ts, CASE WHEN cpu_percent < 400 THEN cpu_percent END AS cpu_percent,
  mem_percent, mem_used_mb, disk_read_mb_s, disk_write_mb_s FROM metrics),
dirty AS (SELECT * FROM faulty UNION ALL SELECT * FROM faulty WHERE cpu_percent < 0.5)"""

# -- operational tables, one row per order or line item ----------------------


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a run log."""
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "running").otherwise("error")
    verdict = F.when(F.col("o_totalprice") > 400000, "FAIL").when(F.col("o_totalprice") > 200000, "WARN").otherwise("PASS")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"),
        F.col("o_orderpriority").alias("source_kind"),
        F.col("o_custkey").alias("rows_in"),
        F.when(status == "success", F.col("o_custkey")).alias("rows_out"),
        verdict.alias("gate_verdict"),
        status.alias("status"),
        F.when(status == "error", F.lit("stopped")).alias("error"),
    )


RUNS_SQL = """runs AS (SELECT o_orderkey AS run_id, o_orderdate AS started_at, CAST(NULL AS TIMESTAMP) AS finished_at, o_orderpriority AS source_kind,
  o_custkey AS rows_in, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS rows_out,
  CASE WHEN o_totalprice > 400000 THEN 'FAIL' WHEN o_totalprice > 200000 THEN 'WARN' ELSE 'PASS' END AS gate_verdict,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'error' END AS status,
  CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'stopped' END AS error FROM orders)"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as check results of runs."""
    status = F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_returnflag") == "A", "WARN").otherwise("PASS")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.concat(F.lit("check_"), F.col("l_linenumber").cast("string")).alias("check_name"),
        status.alias("status"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("detail"),
        F.col("l_quantity").alias("value"),
        F.col("l_shipdate").cast("timestamp").alias("checked_at"),
    )


CHECKS_SQL = """checks AS (SELECT l_orderkey AS run_id, 'check_' || l_linenumber AS check_name,
  CASE l_returnflag WHEN 'R' THEN 'FAIL' WHEN 'A' THEN 'WARN' ELSE 'PASS' END AS status, 'part ' || l_partkey AS detail,
  l_quantity AS value, l_shipdate AS checked_at FROM lineitem)"""


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a model registry: the target is the priority, the error is the price."""
    champion = F.col("o_orderstatus") == "F"
    day = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("m-"), F.col("o_orderkey").cast("string")).alias("model_id"),
        F.col("o_orderpriority").alias("target"),
        F.lit("gradient_boosting").alias("algorithm"),
        (F.col("o_totalprice") / 9700.0).alias("mae"),
        F.lit(25.0).alias("baseline_mae"),
        champion.alias("is_champion"),
        F.when(champion, day).alias("promoted_at"),
        F.when(~champion, F.lit("gain too small")).alias("rejected_reason"),
        F.col("o_orderkey").alias("run_id"),
        F.concat(F.lit("v-"), F.col("o_custkey").cast("string")).alias("version_id"),
        day.alias("created_at"),
    )


MODELS_SQL = """models AS (SELECT 'm-' || o_orderkey AS model_id, o_orderpriority AS target, 'gradient_boosting' AS algorithm,
  o_totalprice / 9700.0 AS mae, 25.0::DOUBLE AS baseline_mae, o_orderstatus = 'F' AS is_champion,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS promoted_at,
  CASE WHEN o_orderstatus <> 'F' THEN 'gain too small' END AS rejected_reason, o_orderkey AS run_id, 'v-' || o_custkey AS version_id,
  o_orderdate AS created_at FROM orders)"""


def config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as configuration snapshots: the old one by brand, the new one by type; sizes that are missing drop out."""
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("category"), F.concat_ws(".", "p_name", F.col("p_partkey").cast("string")).alias("key"), "p_brand", "p_type", "p_size")


def plan(df: DataFrame, order: str = "ts") -> Layout:
    return Layout.plan(df, order)


def labelled(df: DataFrame) -> DataFrame:
    return label_regimes(df)


REGIME_SQL = """CASE WHEN {c} >= 0 AND {c} < 15 THEN 'idle' WHEN {c} >= 15 AND {c} < 80 THEN 'ramp'
  WHEN {c} >= 80 AND {c} < 100.1 THEN 'saturated' ELSE 'unknown' END"""


def regime_sql(column: str = "cpu_percent") -> str:
    return REGIME_SQL.format(c=column)

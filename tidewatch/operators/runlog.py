"""Run log, check history, configuration audit, lineage and the unified event log."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.params import DEFAULTS, Params

EVENT_COLUMNS = ("at", "source", "level", "event", "detail")


def start_run(spark, run_id: int, source_kind: str, source_detail: str, config_fp: str, now) -> DataFrame:
    return spark.range(1).select(
        F.lit(run_id).cast("bigint").alias("run_id"), F.lit(now).cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"), F.lit(source_kind).alias("source_kind"),
        F.lit(source_detail).alias("source_detail"), F.lit(None).cast("bigint").alias("rows_in"),
        F.lit(None).cast("bigint").alias("rows_out"), F.lit(None).cast("string").alias("gate_verdict"),
        F.lit(None).cast("string").alias("data_fingerprint"), F.lit(config_fp).alias("config_fingerprint"),
        F.lit("running").alias("status"), F.lit(None).cast("string").alias("error"),
    )


def finish_run(runs: DataFrame, run_id: int, status: str, now, **facts) -> DataFrame:
    """Close one run; `facts` are values of other columns."""
    mine = F.col("run_id") == run_id
    changes = {"status": F.lit(status), "finished_at": F.lit(now).cast("timestamp"), **{k: F.lit(v) for k, v in facts.items()}}
    return runs.withColumns({c: F.when(mine, v.cast(runs.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()})


def reconcile_stale(runs: DataFrame, now, params: Params = DEFAULTS) -> DataFrame:
    """Runs still `running` after `stale_run_minutes` were interrupted."""
    at = F.lit(now).cast("timestamp")
    stale = (F.col("status") == "running") & (F.col("started_at") < at - F.make_dt_interval(mins=F.lit(params.stale_run_minutes)))
    return runs.withColumns(
        {
            "finished_at": F.when(stale, at).otherwise(F.col("finished_at")),
            "error": F.when(stale, F.lit("ended before it finished")).otherwise(F.col("error")),
            "status": F.when(stale, F.lit("interrupted")).otherwise(F.col("status")),
        }
    )


def latest_run(runs: DataFrame, status: str = "success") -> DataFrame:
    return runs.where(F.col("status") == status).orderBy(F.desc("run_id")).limit(1)


def history(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """Newest n rows; Spark keeps n per partition before it merges."""
    return df.orderBy(*order).limit(limit)


def without_orphans(loaded: DataFrame, runs: DataFrame) -> DataFrame:
    """Loaded rows of successful runs only."""
    good = runs.where(F.col("status") == "success").select("run_id")
    return loaded.join(good, "run_id", "left_semi")


def orphans(loaded: DataFrame, runs: DataFrame) -> DataFrame:
    good = runs.where(F.col("status") == "success").select("run_id")
    return loaded.join(good, "run_id", "left_anti")


# -- configuration -----------------------------------------------------------


def config_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, old_value, new_value) of keys added, removed or changed between two snapshots."""
    left = old.select("key", F.col("value").alias("old_value"))
    right = new.select("key", F.col("value").alias("new_value"))
    return left.join(right, "key", "full").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def config_as_of(current: DataFrame, audit: DataFrame, at) -> DataFrame:
    """Values at an instant: the first change after it still tells the value before it."""
    later = audit.where(F.col("changed_at") > F.lit(at).cast("timestamp"))
    before = later.groupBy("key").agg(F.min_by("old_value", F.struct("changed_at", "id")).alias("_old"), F.lit(True).alias("_changed"))
    joined = current.join(before, "key", "full")
    out = joined.select("key", F.when(F.col("_changed"), F.col("_old")).otherwise(F.col("value")).alias("value"))
    return out.where(F.col("value").isNotNull())


# -- lineage -----------------------------------------------------------------


def trace(predictions: DataFrame, models: DataFrame, versions: DataFrame, runs: DataFrame, checks: DataFrame) -> DataFrame:
    """Prediction to model, feature version, run, and the checks that run passed or failed.

    Checks are folded per run before the join, so no prediction is multiplied.
    """
    per_run = checks.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("check_name", "status", "detail"))).alias("quality_checks"),
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("status") == "FAIL").alias("checks_failed"),
        F.count_if(F.col("status") == "WARN").alias("checks_warned"),
    )
    return (
        predictions.join(models, "model_id", "left")
        .join(versions, "version_id", "left")
        .join(runs, "run_id", "left")
        .join(per_run, "run_id", "left")
    )


# -- events ------------------------------------------------------------------


@dataclass(frozen=True)
class EventKind:
    """How rows of one record table read as events.

    Texts are alternatives of which the first without a missing field holds.
    `{field}` must be known, `{field|text}` has a stand-in, `{field:4}` is a
    number to 4 places. `alarms` are (level, condition), the first that holds.
    """

    source: str
    at: str
    event: str
    detail: tuple[str, ...]
    alarms: tuple[tuple[str, str], ...] = ()
    level: str = "INFO"
    where: str = "true"
    detail_chars: int = 0

    def columns(self) -> list[str]:
        """Select list in SQL that Spark and other engines read alike."""
        cases = " ".join(f"WHEN {test} THEN '{level}'" for level, test in self.alarms)
        level = f"CASE {cases} ELSE '{self.level}' END" if cases else f"'{self.level}'"
        detail = f"coalesce({', '.join(map(text_sql, self.detail))})" if len(self.detail) > 1 else text_sql(self.detail[0])
        if self.detail_chars:
            detail = f"substr({detail}, 1, {self.detail_chars})"
        return [f"{self.at} AS at", f"'{self.source}' AS source", f"{level} AS level", f"{text_sql(self.event)} AS event", f"{detail} AS detail"]

    def events(self, rows: DataFrame) -> DataFrame:
        return rows.where(self.where).selectExpr(*self.columns())

    def sql(self, table: str) -> str:
        return f"SELECT {', '.join(self.columns())} FROM {table} WHERE {self.where}".replace(" AS at,", ' AS "at",')


def text_sql(template: str) -> str:
    """A template as a SQL expression; null if a field without a stand-in is missing."""
    parts = []
    for literal, field in re.findall(r"([^{]+)|\{([^}]*)\}", template):
        if literal:
            parts.append(f"'{literal}'")
            continue
        name, _, standin = field.partition("|")
        name, _, places = name.partition(":")
        value = f"CASE WHEN {name} IS NOT NULL THEN printf('%.{places}f', {name}) END" if places else f"CAST({name} AS STRING)"
        parts.append(f"coalesce({value}, '{standin}')" if "|" in field else f"({value})")
    return " || ".join(parts)


# The texts of the event log.
EVENT_KINDS = {
    "runs": EventKind(
        "etl", "started_at", "ETL run {run_id} {status|running}", ("{error}", "{gate_detail}", "{source_kind|?}: {rows_in|0} in / {rows_out|0} out"),
        (("ERROR", "status IN ('error', 'FAILED') OR gate_verdict = 'FAIL'"), ("WARN", "gate_verdict = 'WARN'")),
    ),
    "checks": EventKind("quality", "checked_at", "run {run_id} — {check_name} {status}", ("{detail|}",), (("ERROR", "status = 'FAIL'"),), "WARN", "status <> 'PASS'"),
    "promoted": EventKind("model", "created_at", "{target} {algorithm|?} PROMOTED", ("{rejected_reason}", "MAE {mae:4|?} vs baseline {baseline_mae:4|?}"), where="is_champion"),
    "rejected": EventKind("model", "created_at", "{target} {algorithm|?} REJECTED", ("{rejected_reason}", "MAE {mae:4|?} vs baseline {baseline_mae:4|?}"), level="WARN", where="NOT coalesce(is_champion, false)"),
    "drifts": EventKind("drift", "detected_at", "{target} drift — {action|?}", ("{outcome}. {detail|}", "{detail|}"), level="WARN"),
    "audit": EventKind("config", "changed_at", "config {key}", ("{old_value|(unset)} -> {new_value}  [{source|?}]",)),
    "recos": EventKind("alert", "ts", "process alert", ("{process_payload|}",), level="WARN", where="type = 'process_alert'", detail_chars=400),
}
#: The record table each kind reads; models are read twice.
EVENT_TABLES = {"promoted": "models", "rejected": "models"}


def events_of(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """Event streams of the record tables at hand, by the names in EVENT_KINDS (models: `models`)."""
    return [kind.events(tables[EVENT_TABLES.get(name, name)]) for name, kind in EVENT_KINDS.items() if EVENT_TABLES.get(name, name) in tables]


def event_log(parts: Sequence[DataFrame], limit: int | None = None) -> DataFrame:
    """All event streams in one table, newest first."""
    out = parts[0].select(*EVENT_COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*EVENT_COLUMNS))
    if limit is None:
        return out
    return out.orderBy(F.desc("at"), "source", "event", "detail").limit(limit)


def filter_events(events: DataFrame, levels: Sequence[str] | None = None, sources: Sequence[str] | None = None, needle: str = "") -> DataFrame:
    if levels is not None:
        events = events.where(F.col("level").isin(list(levels)))
    if sources is not None:
        events = events.where(F.col("source").isin(list(sources)))
    if needle:
        text = needle.lower()
        hit = F.lower("event").contains(text) | F.coalesce(F.lower("detail").contains(text), F.lit(False))
        events = events.where(hit)
    return events


def top_consumers(alerts: DataFrame, consumers: DataFrame, keys: Sequence[str], params: Params = DEFAULTS) -> DataFrame:
    """The heaviest consumers at each alert, as rows with a rank."""
    from pyspark.sql import Window

    joined = consumers.join(alerts, list(keys))
    w = Window.partitionBy(*keys).orderBy(F.desc("rss_mb"), "pid")
    return joined.withColumn("place", F.row_number().over(w)).where(F.col("place") <= params.alert_top_n)


def alert_payload(top: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The ranked consumers of each alert as one JSON text."""
    rows = F.array_sort(F.collect_list(F.struct("place", "pid", "name", "rss_mb")))
    listed = F.transform(rows, lambda r: F.struct(r["pid"].alias("pid"), r["name"].alias("name"), r["rss_mb"].alias("rss_mb")))
    return top.groupBy(*keys).agg(F.to_json(listed).alias("process_payload"))

"""Cleaning batch by batch must end where one run over everything ends."""

import datetime
import random

import pytest
from conftest import same
from pyspark.sql import functions as F

from tidewatch.operators import clean as K
from tidewatch.operators.ordering import Layout
from tidewatch.params import DEFAULTS
from tidewatch.streaming import cycle as Y

SCHEMA = "series_key string, ts timestamp, cpu_percent double, mem_percent double, mem_used_mb double, disk_read_mb_s double, disk_write_mb_s double"
COLUMNS = [*Y.KEY, "ts", "cpu_percent", "mem_percent", "mem_used_mb", "disk_read_mb_s", "disk_write_mb_s", "is_imputed", "observations", "is_outlier", "cpu_percent_is_outlier", "filled_cpu_percent", "filled_disk_read_mb_s"]


def samples(seed=1, n=260):
    """Two series with gaps, outliers, shared slots, repeated instants, values out of range, and long and short runs of nulls over midnight."""
    rng, rows = random.Random(seed), []
    for key, begin in (("a", datetime.datetime(2024, 1, 1, 23, 53)), ("b", datetime.datetime(2024, 1, 1, 23, 55, 1))):
        at, silent = begin, {}
        for k in range(n):
            at += datetime.timedelta(seconds=rng.choice([3, 3, 3, 3, 3, 1, 5, 6, 20 if rng.random() < 0.2 else 3]))
            values = [rng.uniform(20, 30), rng.uniform(-5, 105), 1000.0 + k, rng.uniform(0, 9), None if key == "b" else 1.0]
            if rng.random() < 0.05:
                values[0] = 99.0
            for c, length in ((0, 2), (1, 6), (3, 70)):
                if silent.get(c, 0) > 0:
                    silent[c] -= 1
                    values[c] = None
                elif rng.random() < 0.03:
                    silent[c] = rng.randint(1, length)
            rows.append((key, at, *values))
            if rng.random() < 0.05:
                rows.append((key, at, *[None if v is None else v + 1 for v in values]))
    return sorted(rows, key=lambda r: r[1])


def clean_of(spark, rows, cadence):
    return K.clean(spark.createDataFrame(rows, SCHEMA), Layout(), params=DEFAULTS, cadence=cadence).select(*COLUMNS)


def test_batches_end_where_one_run_ends(spark, tmp_path):
    rows = samples()
    cadence = spark.createDataFrame([("a", 3.0), ("b", 3.5)], "series_key string, cadence double")
    sink = Y.clean_sink(str(tmp_path), cadence)
    ends = [40, 41, 230, len(rows)]
    for number, (a, b) in enumerate(zip([0, *ends], ends)):
        sink(spark.createDataFrame(rows[a:b], SCHEMA), number)
        if number == 2:
            sink(spark.createDataFrame(rows[a:b], SCHEMA), number)  # a retry replaces its own results
        if number > 0:
            same(Y.cleaned_so_far(spark, str(tmp_path)).select(*COLUMNS), clean_of(spark, rows[:b], cadence))
    done = Y.cleaned_so_far(spark, str(tmp_path))
    assert done.where("filled_disk_read_mb_s = 1").count() and done.where("is_outlier = 1").count() and done.agg(F.max("segment_id")).first()[0] > 1
    assert spark.read.parquet(f"{tmp_path}/grid").select("day").distinct().count() == 2


def test_late_rows_and_retention(spark, tmp_path):
    rows = samples(seed=5, n=60)
    cadence = spark.createDataFrame([("a", 3.0)], "series_key string, cadence double")
    sink = Y.clean_sink(str(tmp_path), cadence, lateness=12, keep_days=0)
    early = [r for r in rows if r[0] == "a"]
    held_back = early[20]
    sink(spark.createDataFrame([r for r in early[:23] if r is not held_back], SCHEMA), 0)
    sink(spark.createDataFrame([held_back], SCHEMA), 1)  # within the lateness: merged
    same(Y.cleaned_so_far(spark, str(tmp_path)).select(*COLUMNS), clean_of(spark, early[:23], cadence))
    sink(spark.createDataFrame([early[2], *early[23:]], SCHEMA), 2)
    assert [r["ts"] for r in spark.read.parquet(f"{tmp_path}/late").collect()] == [early[2][1]]
    got = Y.cleaned_so_far(spark, str(tmp_path)).select(*COLUMNS)
    last = early[-1][1].date()
    same(got, clean_of(spark, early, cadence).where(F.to_date("ts") == last))


def test_only_touched_days_are_read(spark, tmp_path):
    days = spark.createDataFrame([("a", 0, k, datetime.datetime(2024, 1, 1 + k), float(k)) for k in range(5)], "series_key string, segment_id long, slot long, ts timestamp, x double").withColumn("day", F.to_date("ts"))
    Y.put(days, f"{tmp_path}/g", "day")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "g").rglob("*.parquet")}
    active = spark.createDataFrame([("a", datetime.datetime(2024, 1, 3, 12))], "series_key string, closed_at timestamp")
    Y.merge_days(spark, days.where("slot = 3").withColumn("x", F.lit(-1.0)), f"{tmp_path}/g", active)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "g").rglob("*.parquet")}
    assert {p.parent.name for p in set(before) ^ set(after)} == {"day=2024-01-04"}
    assert sorted(r["x"] for r in spark.read.parquet(f"{tmp_path}/g").collect()) == [-1.0, 0.0, 1.0, 2.0, 4.0]


def test_other_strategies_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        Y.clean_sink(str(tmp_path), spark.createDataFrame([], "series_key string, cadence double"), params=DEFAULTS.with_(outlier_strategy="clip"))

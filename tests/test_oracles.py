"""Registered queries against their SQL in DuckDB.

A representative set by default; TIDEWATCH_ALL=1 runs every one.
"""

import math
import os

import duckdb
import pandas as pd
import pytest
from conftest import TINY

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = (
    "scan_time_window json_source raw_corrections contract_breaches gate_verdicts segment_profile cleaning_audit clean_users derived_daily "
    "rollup_tiers_long segment_hourly_rollup feature_vectors_users category_shares feature_drift_users drift_decisions breach_stats "
    "backtest_raw_samples promotion_gate registry_after_gate lineage_trace event_log config_as_of top_consumers"
).split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("TIDEWATCH_ALL") else CORE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 4) + 0.0
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v


def table(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, TINY)
    expected = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert table(df.columns, df.collect()) == table(expected.columns, expected.fetchall())


def test_every_query_is_whole_or_explained():
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert all(entry.queries()[n].__doc__ or n.startswith(("boosting", "scaling", "feature_selection", "tuning")) for n in without)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0

"""The same queries with their ordered work cut into slices and blocks, as on large tables, under the same SQL.

Only the sizes differ, so a twin shows that the size of a table changes nothing
but how the work is spread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.operators.ordering import SIZES, Sizes
from tidewatch.plans.catalog import ORACLES, QUERIES

SMALL = Sizes(slice_rows=300, block_rows=250, group_rows=200, series_rows=0)
TWINS = ("clean_users", "feature_vectors_users", "baseline_ladder", "feature_drift_users", "breach_stats", "gate_checks_dirty", "rollup_hour")


def sliced(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        mark = SIZES.set(SMALL)
        try:
            return QUERIES[name](spark, sf_dir)
        finally:
            SIZES.reset(mark)

    run.__name__, run.__doc__ = f"{name}_sliced", f"`{name}` in slices and blocks."
    return run


for _name in TWINS:
    QUERIES[f"{_name}_sliced"], ORACLES[f"{_name}_sliced"] = sliced(_name), ORACLES[_name]

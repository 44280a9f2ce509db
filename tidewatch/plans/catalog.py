"""Registry of named queries over the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 4


def nudge(expr: str) -> str:
    """SQL for the rounding every query output gets, see `tidy`."""
    return f"round({expr} + 1e-9, {DIGITS})"


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: plain timestamps, doubles to 4 decimals.

    The nudge moves exact halves to one side, so that two engines whose sums
    differ in the last bit round them alike.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c + F.lit(1e-9), DIGITS)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir)` under `name` with its equivalent SQL."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return tidy(fn(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def with_ctes(ctes: list[str], final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final


def rounded(*names: str) -> str:
    return ", ".join(f"{nudge(n)} AS {n}" for n in names)

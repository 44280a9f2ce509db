"""Readers of sample tables. Each returns a DataFrame; files are read by executors, not the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.columns import parse_ts
from tidewatch.operators.contract import METRICS, SQL_TYPES, Contract, conform


def text_schema(contract: Contract = METRICS, extras: dict[str, str] | None = None) -> str:
    """Schema for text formats; timestamps stay text so that unreadable ones can be counted."""
    fields = dict(extras or {"series_key": "string"})
    fields |= {r.column: "string" if r.dtype == "datetime" else SQL_TYPES.get(r.dtype, "string") for r in contract.rules}
    return ", ".join(f"`{n}` {t}" for n, t in fields.items())


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header; columns are matched by name and a missing path raises.

    Without a schema every column is text, which `coerce` then types.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def read_json(spark: SparkSession, path: str, records_key: str = "data", schema: T.StructType | str | None = None, lines: bool = False) -> DataFrame:
    """JSON files holding a list of records or an object with the list under `records_key`.

    With `lines` every line is such an object, and files are split among tasks;
    otherwise a file is one value, read by one task.
    """
    reader = spark.read.option("multiLine", not lines)
    raw = (reader.schema(schema) if schema else reader).json(path)
    if records_key in raw.columns and isinstance(raw.schema[records_key].dataType, T.ArrayType):
        element = raw.schema[records_key].dataType.elementType
        if not isinstance(element, T.StructType):
            raise ValueError(f"expected records under {records_key!r}, found {element.simpleString()}")
        return raw.select(F.inline(F.col(records_key)))
    if raw.columns == ["_corrupt_record"]:
        raise ValueError("expected a list of JSON records")
    return raw


def usable_watermark(value: str | None) -> F.Column:
    """The watermark as a timestamp, null when absent or unreadable (then everything is read)."""
    return parse_ts(F.lit(value)) if value else F.lit(None).cast("timestamp")


def newer_than(df: DataFrame, watermark: str | None, ts: str = "ts") -> DataFrame:
    """Rows strictly after the watermark; all rows when it cannot be read."""
    mark = usable_watermark(watermark)
    return df.where(mark.isNull() | (F.col(ts) > mark))


def next_watermark(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: the largest readable timestamp, what a stream would remember."""
    return df.agg(F.max(ts).alias("watermark"))


def window(df: DataFrame, since=None, until=None, limit: int | None = None, ts: str = "ts") -> DataFrame:
    """Inclusive time range in time order, optionally the first `limit` rows."""
    if since is not None:
        df = df.where(F.col(ts) >= F.lit(since).cast("timestamp"))
    if until is not None:
        df = df.where(F.col(ts) <= F.lit(until).cast("timestamp"))
    return df.orderBy(ts).limit(limit) if limit else df


def peek(df: DataFrame, n: int, order: str = "ts") -> DataFrame:
    """The newest n rows, oldest first."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def latest_by_id(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    return df.orderBy(F.desc(id_col)).limit(n)


def inventory(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows per source; a source with no rows is reported as empty."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), "rows") for name, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", F.when(F.col("rows") > 0, "ready").otherwise("empty"))


def read_mirror(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """What a stream has mirrored below a folder, after a watermark if one is given."""
    return newer_than(spark.read.parquet(path).drop("batch_id"), since)


SourceReader = Callable[..., DataFrame]
SOURCES: dict[str, SourceReader] = {
    "table": read_table,
    "csv": read_csv,
    "json": read_json,
    "stream": read_mirror,
}


def register_source(scheme: str, reader: SourceReader) -> None:
    SOURCES[scheme] = reader


def get_source(spark: SparkSession, spec: str, contract: Contract = METRICS, **options) -> DataFrame:
    """Read `<scheme>://<path>` and bring it into contract shape."""
    scheme, found, path = spec.partition("://")
    if not found:
        raise ValueError(f"source {spec!r} must look like <scheme>://<path>; known: {sorted(SOURCES)}")
    reader = SOURCES.get(scheme.lower())
    if reader is None:
        raise ValueError(f"unknown source scheme {scheme!r}; known: {sorted(SOURCES)}")
    return conform(reader(spark, path, **options), contract)

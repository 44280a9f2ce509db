"""Column contract: declared types, nullability and ranges, applied as expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.columns import parse_ts

SQL_TYPES = {"float": "double", "int": "bigint", "datetime": "timestamp", "bool": "boolean", "string": "string"}
NUMERIC = ("float", "int")
RULE_SCHEMA = (
    "table_name string, column_name string, dtype string, nullable boolean, "
    "min_value double, max_value double, is_target boolean, description string"
)


@dataclass(frozen=True)
class Rule:
    column: str
    dtype: str
    nullable: bool = True
    min_value: float | None = None
    max_value: float | None = None
    is_target: bool = False
    description: str = ""


@dataclass(frozen=True)
class Contract:
    rules: tuple[Rule, ...]

    @property
    def columns(self) -> list[str]:
        return [r.column for r in self.rules]

    @property
    def targets(self) -> list[str]:
        return [r.column for r in self.rules if r.is_target]

    @property
    def values(self) -> list[str]:
        """Numeric measurement columns."""
        return [r.column for r in self.rules if r.dtype in NUMERIC and r.column != "id"]

    @property
    def ranged(self) -> list[Rule]:
        """Rules whose range is checked and clipped: those that declare a minimum."""
        return [r for r in self.rules if r.dtype in NUMERIC and r.min_value is not None]

    def without(self, *columns: str) -> "Contract":
        return Contract(tuple(r for r in self.rules if r.column not in columns))


# The seed contract of the metrics table.
METRICS = Contract(
    (
        Rule("id", "int", True, None, None, False, "arrival order"),
        Rule("ts", "datetime", False, None, None, False, "sample time"),
        Rule("cpu_percent", "float", True, 0.0, 100.0, True, "CPU utilisation"),
        Rule("mem_percent", "float", True, 0.0, 100.0, True, "memory utilisation"),
        Rule("mem_used_mb", "float", True, 0.0, None, False, "memory used"),
        Rule("disk_read_mb_s", "float", True, 0.0, None, False, "disk read throughput"),
        Rule("disk_write_mb_s", "float", True, 0.0, None, False, "disk write throughput"),
    )
)


def contract_from(rules: DataFrame, table: str = "metrics") -> Contract:
    """Contract of one table from rule rows. As many rows as the table has columns."""
    rows = rules.where(F.col("table_name") == table).select(*[c.split()[0] for c in RULE_SCHEMA.split(", ")][1:]).collect()
    return Contract(
        tuple(
            Rule(r.column_name, r.dtype, bool(r.nullable), r.min_value, r.max_value, bool(r.is_target), r.description or "")
            for r in rows
        )
    )


def contract_rows(spark, contract: Contract, table: str = "metrics") -> DataFrame:
    rows = [
        (table, r.column, r.dtype, r.nullable, r.min_value, r.max_value, r.is_target, r.description) for r in contract.rules
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def upsert_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert or replace rules by (table, column)."""
    keys = ["table_name", "column_name"]
    return rules.join(changes, keys, "left_anti").unionByName(changes)


def _cast(rule: Rule, df: DataFrame) -> Column:
    target = SQL_TYPES.get(rule.dtype, "string")
    if rule.column not in df.columns:
        return F.lit(None).cast(target)
    col, kind = F.col(rule.column), df.schema[rule.column].dataType
    if rule.dtype == "datetime":
        return col.cast("timestamp") if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else parse_ts(col)
    return col.try_cast(target)


def coerce(df: DataFrame, contract: Contract = METRICS) -> DataFrame:
    """Declared types; unreadable values become null, absent columns typed nulls, extras stay."""
    return df.withColumns({r.column: _cast(r, df) for r in contract.rules})


def conform(df: DataFrame, contract: Contract = METRICS) -> DataFrame:
    """Contract columns first (absent ones as nulls), then the extras."""
    extras = [c for c in df.columns if c not in contract.columns]
    declared = [
        F.col(r.column) if r.column in df.columns else F.lit(None).cast(SQL_TYPES.get(r.dtype, "string")).alias(r.column)
        for r in contract.rules
    ]
    return df.select(*declared, *extras)


def column_differences(df: DataFrame, contract: Contract = METRICS) -> dict[str, list[str]]:
    return {
        "missing": [c for c in contract.columns if c not in df.columns],
        "undeclared": [c for c in df.columns if c not in contract.columns],
    }


def _type_fits(rule: Rule, kind: T.DataType) -> bool:
    if rule.dtype in NUMERIC:
        return isinstance(kind, T.NumericType)
    if rule.dtype == "datetime":
        return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
    return True


def breach_counts(df: DataFrame, contract: Contract) -> list[tuple[str, str, Column]]:
    """(column, kind, counting aggregate) of every rule; all evaluate in one pass."""
    out = []
    rows = F.count(F.lit(1))
    for r in contract.rules:
        if r.column not in df.columns:
            out.append((r.column, "missing_column", rows))
            continue
        col = F.col(r.column)
        fits = _type_fits(r, df.schema[r.column].dataType)
        if not r.nullable:
            out.append((r.column, "null_in_non_nullable", F.count_if(col.isNull())))
        if not fits:
            out.append((r.column, "dtype_mismatch", rows))
        if r.dtype in NUMERIC and fits:
            if r.min_value is not None:
                out.append((r.column, "below_min", F.count_if(col < r.min_value)))
            if r.max_value is not None:
                out.append((r.column, "above_max", F.count_if(col > r.max_value)))
    return out


def validate(df: DataFrame, contract: Contract = METRICS, keys: list[str] | None = None) -> DataFrame:
    """Breaches per key as rows (column, kind, breaches); no rows means the data conforms."""
    keys = keys or []
    counts = breach_counts(df, contract)
    wide = df.groupBy(*keys).agg(*[agg.alias(f"_b{i}") for i, (_, _, agg) in enumerate(counts)])
    long = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("kind"), F.col(f"_b{i}").cast("bigint").alias("breaches"))
            for i, (c, k, _) in enumerate(counts)
        ]
    )
    return wide.select(*keys, F.inline(long)).where(F.col("breaches") > 0)


def conformity(df: DataFrame, contract: Contract = METRICS, keys: list[str] | None = None) -> DataFrame:
    """Per key: whether its rows conform, how many breaches there are and of how many kinds, and the columns nobody declared."""
    counts = breach_counts(df, contract)
    undeclared = [c for c in column_differences(df, contract)["undeclared"] if c not in (keys or [])]
    wide = df.groupBy(*(keys or [])).agg(*[agg.alias(f"_b{i}") for i, (_, _, agg) in enumerate(counts)])
    found = [F.col(f"_b{i}") for i in range(len(counts))]
    total = sum(found[1:], found[0]).cast("bigint")
    kinds = sum([(c > 0).cast("int") for c in found[1:]], (found[0] > 0).cast("int")).cast("bigint")
    return wide.select(*(keys or []), (total == 0).alias("conforms"), total.alias("breaches"), kinds.alias("kinds"), F.lit(", ".join(sorted(undeclared))).alias("undeclared"))

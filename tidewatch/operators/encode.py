"""Categorical columns as numbers over a fixed vocabulary, never one read from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.params import DEFAULTS, Params


def vocabulary(column: str, params: Params = DEFAULTS) -> list[str]:
    """Ordered categories: the declared list, else the regime bands; `unknown` is always one of them."""
    declared = params.encoding_categories.get(column)
    if declared:
        words = list(declared)
    elif column == "regime":
        words = [name for name, _, _ in params.regime_bounds]
    else:
        return []
    return words if params.unknown_label in words else [*words, params.unknown_label]


def encoded_names(column: str, params: Params = DEFAULTS) -> list[str]:
    words = vocabulary(column, params)
    if not words:
        return []
    if params.encoding_method == "ordinal":
        return [f"{column}_ordinal"]
    return [f"{column}_{w}" for w in (words[1:] if params.drop_first else words)]


def all_encoded_names(params: Params = DEFAULTS) -> list[str]:
    return [n for c in params.encoding_columns for n in encoded_names(c, params)]


def category(df: DataFrame, column: str, params: Params = DEFAULTS) -> Column:
    """Trimmed value if it is in the vocabulary, else unknown. Without the text, the label is read off the one-hot block."""
    unknown = F.lit(params.unknown_label)
    words = vocabulary(column, params)
    if column in df.columns:
        word = F.trim(F.col(column).cast("string"))
        return F.when(word.isin(words), word).otherwise(unknown)
    block = [w for w in words if f"{column}_{w}" in df.columns]
    return F.coalesce(*[F.when(F.col(f"{column}_{w}") == 1, F.lit(w)) for w in block], unknown) if block else unknown


def encode_column(df: DataFrame, column: str, params: Params = DEFAULTS) -> DataFrame:
    words = vocabulary(column, params)
    if not words:
        return df
    word = category(df, column, params)
    if params.encoding_method == "ordinal":
        listed = F.array(*[F.lit(w) for w in words])
        return df.withColumn(f"{column}_ordinal", (F.array_position(listed, word) - 1).cast("int"))
    kept = words[1:] if params.drop_first else words
    return df.withColumns({f"{column}_{w}": (word == w).cast("int") for w in kept})


def encode(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    if params.encoding_enabled:
        for column in params.encoding_columns:
            df = encode_column(df, column, params)
    return df


def category_shares(df: DataFrame, column: str, keys: list[str], params: Params = DEFAULTS) -> DataFrame:
    """Per key and vocabulary entry its share of the rows; absent categories have share 0."""
    words = vocabulary(column, params)
    word = category(df, column, params)
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(word == w).alias(f"_w{i}") for i, w in enumerate(words)]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(w).alias("category"), F.col(f"_w{i}").alias("rows"), (F.col(f"_w{i}") / F.col("_rows")).alias("share"))
            for i, w in enumerate(words)
        ]
    )
    return counts.select(*keys, F.inline(pairs))


def occupancy(df: DataFrame, column: str, keys: list[str], params: Params = DEFAULTS) -> DataFrame:
    """Percentage of rows per one-hot column (1 decimal)."""
    names = [n for n in encoded_names(column, params) if n in df.columns]
    wide = df.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("encoded_column"), F.round(F.col(n) * 100.0, 1).alias("pct")) for n in names])
    return wide.select(*keys, F.inline(pairs))

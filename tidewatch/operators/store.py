"""Fingerprints, feature versions, offline and online feature store, point-in-time lookup."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import sorted_json
from tidewatch.operators.cadence import SERIES
from tidewatch.operators.ordering import newest
from tidewatch.params import DEFAULTS, FEATURE_DEFINING, Params


def data_fingerprint(df: DataFrame, targets: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """12 hex digits over row count, time span and target sums: the same rows give the same value from any source.

    Sums are taken in decimals, so they do not depend on the order tasks finish in.
    """
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    parts = [F.count(F.lit(1)).cast("string"), stamp(F.min("ts")), stamp(F.max("ts"))]
    parts += [F.concat(F.lit(f"{t}:"), F.coalesce(F.sum(F.col(t).cast("decimal(28,8)")).cast("decimal(38,4)"), F.lit(0).cast("decimal(38,4)")).cast("string")) for t in targets]
    fp = F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)
    return df.groupBy(*keys).agg(fp.alias("data_fingerprint"), F.count(F.lit(1)).alias("rows"))


def config_fingerprint(config: DataFrame, keys: Sequence[str] | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Hash of the sorted JSON of (key, value) rows, optionally of some keys only."""
    rows = config if keys is None else config.where(F.col("key").isin(list(keys)))
    text = sorted_json(F.collect_list(F.struct("key", "value")))
    return rows.groupBy(*group).agg(F.substring(F.sha2(text, 256), 1, 12).alias("fingerprint"))


def params_fingerprint(params: Params = DEFAULTS, keys: Sequence[str] | None = FEATURE_DEFINING) -> str:
    values = {k: v for k, v in asdict(params).items() if keys is None or k in keys}
    return hashlib.sha256(json.dumps(values, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


#: What an identifier is made of, in this order; `data` only where one snapshot is meant.
IDENTIFYING = ("target", "features", "config", "data")


def identifier(**parts: Column) -> Column:
    """12 hex digits over the JSON of the given parts: a definition without `data`, a version of it with.

    Data does not enter a definition; features are a set.
    """
    ready = {k: v for k, v in parts.items() if v is not None}
    ready["features"] = F.array_sort(ready["features"])
    if "data" in ready:
        ready["data"] = F.coalesce(ready["data"], F.lit(""))
    return F.substring(F.sha2(F.to_json(F.struct(*[ready[k].alias(k) for k in IDENTIFYING if k in ready])), 256), 1, 12)


def identify(target: str, features: Sequence[str], params: Params = DEFAULTS, data: str | None = None) -> Column:
    """The identifier of one target's feature set under given parameters."""
    return identifier(target=F.lit(target), features=F.array(*[F.lit(f) for f in features]), config=F.lit(params_fingerprint(params)), data=None if data is None else F.lit(data))


def vector_json(features: Sequence[str]) -> Column:
    """Feature vector as JSON text; null features are written as null."""
    return F.to_json(F.struct(*[F.col(f) for f in features]), {"ignoreNullFields": "false"})


def materialise(rows: DataFrame, features: Sequence[str], label: str, version: str | Column, path: str):
    """Write a training set as one partition of the offline store; returns its schema. Writing a version again replaces it."""
    out = rows.select(F.lit(version).alias("version_id"), SERIES, "ts", "segment_id", F.col(label).alias("target_value"), *features)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version_id").parquet(path)
    return out.schema


def load_offline(spark, path: str, version: str | Column, schema=None) -> DataFrame:
    """One materialised version; the partition filter prunes the others. With a schema, a store without rows reads as empty."""
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path).where(F.col("version_id") == version)


def manifest(rows: DataFrame, target: str, features: Sequence[str], data_fp: str | None, params: Params = DEFAULTS) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).select(
        identify(target, features, params, data_fp or "").alias("version_id"),
        identify(target, features, params).alias("definition_id"),
        F.lit(target).alias("target"),
        F.lit(len(features)).alias("n_features"),
        "n_rows",
        F.lit(params_fingerprint(params)).alias("config_fingerprint"),
        F.lit(data_fp).cast("string").alias("data_fingerprint"),
    )


def latest_version(manifests: DataFrame, keys: Sequence[str] = ("target",), stamp: str = "created_at") -> DataFrame:
    return newest(manifests, list(keys), [F.desc(stamp), F.desc("version_id")])


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Insert or replace by key: the first row in `order` wins. Both sides need the same columns."""
    return newest(current.unionByName(changes), list(keys), list(order))


def online_vectors(frame: DataFrame, features: Sequence[str], target: str, version: str, definition: str) -> DataFrame:
    """Newest complete vector per series, as published to serving."""
    rows = newest(frame.dropna(subset=list(features)), [SERIES], [F.desc("ts")])
    return rows.select(
        SERIES, F.lit(target).alias("target"), F.lit(version).alias("version_id"), F.lit(definition).alias("definition_id"),
        "ts", vector_json(features).alias("features"),
    )


def historical_features(entities: DataFrame, store: DataFrame, features: Sequence[str] | None = None, label: str | None = None) -> DataFrame:
    """Features exactly at each entity's instant. A nearest match could come from after it, so there is none."""
    wanted = [c for c in (features or [c for c in store.columns if c not in (SERIES, "ts")])]
    if label and label not in wanted:
        wanted.append(label)
    return entities.join(store.select(SERIES, "ts", *wanted), [SERIES, "ts"], "left")

"""The quality gate: thirteen checks per series as rows, and its verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import seconds_between
from tidewatch.operators.cadence import SERIES, deltas, detect_cadence, find_gaps, with_previous
from tidewatch.operators.contract import METRICS, Contract, breach_counts
from tidewatch.operators.ordering import Layout, settle
from tidewatch.params import DEFAULTS, Params

PASS, WARN, FAIL = "PASS", "WARN", "FAIL"


def profile(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Per key and column: nulls, range, mean, deviation, distinct values."""
    stats, rows = [F.count(F.lit(1)).alias("_n")], []
    for c in columns:
        stats += [
            F.count_if(F.col(c).isNull()).alias(f"_nu_{c}"),
            F.min(c).alias(f"_mi_{c}"),
            F.max(c).alias(f"_ma_{c}"),
            F.avg(c).alias(f"_av_{c}"),
            F.stddev_samp(c).alias(f"_sd_{c}"),
        ]
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"_nu_{c}").alias("nulls"),
                F.round(F.lit(100.0) * F.col(f"_nu_{c}") / F.col("_n"), 2).alias("null_pct"),
                F.round(F.col(f"_mi_{c}").cast("double"), 3).alias("min"),
                F.round(F.col(f"_ma_{c}").cast("double"), 3).alias("max"),
                F.round(F.col(f"_av_{c}"), 3).alias("mean"),
                F.round(F.col(f"_sd_{c}"), 4).alias("std"),
            )
        )
    keys = list(keys)
    wide = df.groupBy(*keys).agg(*stats).select(*keys, F.inline(F.array(*rows)))
    # distinct values: one row per value is aggregated away before groups are formed
    pairs = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("_p"))
    seen = pairs.where(F.col("_p.v").isNotNull()).select(*keys, F.col("_p.c").alias("column_name"), "_p.v").distinct()
    distinct = seen.groupBy(*keys, "column_name").agg(F.count(F.lit(1)).alias("distinct_values"))
    return wide.join(distinct, [*keys, "column_name"], "left").withColumn(
        "distinct_values", F.coalesce("distinct_values", F.lit(0).cast("bigint"))
    )


def _repeats(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Per series: rows beyond the first of each combination of `columns`."""
    groups = df.groupBy(*dict.fromkeys([SERIES, *columns])).agg(F.count(F.lit(1)).alias("_c"))
    return groups.groupBy(SERIES).agg(F.sum(F.col("_c") - 1).alias(name))


def _grade(bad: Column, verdict: str) -> Column:
    return F.when(bad, verdict).otherwise(PASS)


def run_checks(
    typed: DataFrame,
    now,
    layout: Layout,
    contract: Contract = METRICS,
    params: Params = DEFAULTS,
    arrival: Layout | None = None,
) -> DataFrame:
    """(series_key, check_name, status, value, detail). `typed` is coerced data, `now` a timestamp column or text.

    `arrival` is the layout of the `id` column, which is arrival order.
    """
    targets = [t for t in contract.targets if t in typed.columns]
    ranged = [r for r in contract.ranged if r.column in typed.columns]
    breaches = breach_counts(typed, contract)
    outside = [F.coalesce(F.count_if(F.col(r.column) < r.min_value), F.lit(0)) for r in ranged]
    outside += [F.count_if(F.col(r.column) > r.max_value) for r in ranged if r.max_value is not None]
    horizon = F.lit(now).cast("timestamp") + F.make_dt_interval(mins=F.lit(params.future_slack_minutes))
    facts = typed.groupBy(SERIES).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("ts").isNull()).alias("bad_ts"),
        F.count_if(F.col("ts") > horizon).alias("future"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        sum(outside[1:], outside[0]).alias("outside"),
        *[(agg > 0).cast("int").alias(f"_b{i}") for i, (_, _, agg) in enumerate(breaches)],
        *[F.avg(F.col(t).isNull().cast("int")).alias(f"_null_{t}") for t in targets],
        *[F.stddev_samp(t).alias(f"_std_{t}") for t in targets],
    )
    broken = [F.col(f"_b{i}") for i in range(len(breaches))]
    facts = facts.withColumn("broken", sum(broken[1:], broken[0]))

    disorder = with_previous(typed.select(SERIES, "id", "ts"), arrival or layout, {"_prev": "ts"}, order="id")
    disorder = disorder.groupBy(SERIES).agg(F.count_if(F.col("ts") < F.col("_prev")).alias("unsorted"))
    steps = settle(deltas(typed, layout), layout)
    cadence = detect_cadence(typed, layout, params, steps=steps)
    gaps = find_gaps(typed, cadence, layout, params, steps).groupBy(SERIES).agg(
        F.count(F.lit(1)).alias("gaps"), F.sum("missed_samples").alias("missed"), F.max("gap_seconds").alias("longest")
    )
    for part in (
        disorder,
        cadence,
        gaps,
        _repeats(typed, ["ts"], "dup_ts"),
        _repeats(typed, typed.columns, "dup_rows"),
    ):
        facts = facts.join(part, SERIES, "left")
    zero = F.lit(0).cast("bigint")
    facts = facts.withColumns({c: F.coalesce(c, zero) for c in ("unsorted", "gaps", "missed", "dup_ts", "dup_rows")})

    worst = F.greatest(*[F.col(f"_null_{t}") for t in targets], F.lit(0.0))
    flat = [F.coalesce((F.col(f"_std_{t}") < params.degenerate_std).cast("int"), F.lit(0)) for t in targets]
    nominal = F.lit(float(params.nominal_cadence))
    off = F.abs(F.col("cadence") - nominal) > nominal * 0.5
    expected = seconds_between("last_ts", "first_ts") / F.col("cadence")
    coverage = F.coalesce(F.col("n") / F.nullif(expected, F.lit(0.0)), F.lit(0.0))

    def check(name, bad, verdict, value, detail):
        return F.struct(
            F.lit(name).alias("check_name"),
            _grade(bad, verdict).alias("status"),
            value.cast("double").alias("value"),
            detail.alias("detail"),
        )

    n, s = F.col("n"), lambda text, *cols: F.format_string(text, *cols)
    checks = [
        check("row_count", n < params.min_rows, FAIL, n, s(f"%d rows, minimum {params.min_rows}", n)),
        check("schema_contract", F.col("broken") > 0, FAIL, F.col("broken"), s("%d rule(s) broken", F.col("broken"))),
        check("timestamp_parseable", F.col("bad_ts") > 0, FAIL, F.col("bad_ts"), s("%d unreadable", F.col("bad_ts"))),
        check("timestamp_monotonic", F.col("unsorted") > 0, WARN, F.col("unsorted"), s("%d out of order", F.col("unsorted"))),
        check("timestamp_not_future", F.col("future") > 0, FAIL, F.col("future"), s("%d ahead of the clock", F.col("future"))),
        check("duplicate_timestamps", F.col("dup_ts") / n > params.max_duplicate_fraction, FAIL, F.col("dup_ts"), s("%d repeated", F.col("dup_ts"))),
        check("duplicate_rows", F.col("dup_rows") > 0, WARN, F.col("dup_rows"), s("%d identical row(s)", F.col("dup_rows"))),
        check("target_nulls", worst > params.max_null_fraction, FAIL, F.round(worst, 4), s("worst null share %.4f", worst)),
        check("value_ranges", F.col("outside") > 0, FAIL, F.col("outside"), s("%d out of range", F.col("outside"))),
        check("cadence", off, WARN, F.round("cadence", 2), s("measured %.2f s", F.col("cadence"))),
        check("collection_gaps", F.col("gaps") > 0, WARN, F.col("gaps"), s("%d gap(s), %d missed", F.col("gaps"), F.col("missed"))),
        check("target_variability", sum(flat[1:], flat[0]) > 0, WARN, sum(flat[1:], flat[0]), s("%d constant target(s)", sum(flat[1:], flat[0]))),
        check("coverage", coverage < params.min_coverage, WARN, F.round(coverage, 3), s("%.3f of the expected samples", coverage)),
    ]
    # an empty series has nothing to check beyond its row count
    return facts.select(SERIES, F.inline(F.when(n > 0, F.array(*checks)).otherwise(F.array(checks[0]))))


def summarise(checks: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Counts by status, verdict, and whether to go on."""
    counts = checks.groupBy(*keys).agg(
        F.count_if(F.col("status") == PASS).alias("passed"),
        F.count_if(F.col("status") == WARN).alias("warned"),
        F.count_if(F.col("status") == FAIL).alias("failed"),
    )
    blocked = F.col("failed") > 0
    if params.fail_on_warn:
        blocked = blocked | (F.col("warned") > 0)
    return counts.withColumn(
        "verdict", F.when(blocked, FAIL).when(F.col("warned") > 0, WARN).otherwise(PASS)
    ).withColumn("should_proceed", ~blocked)


def empty_gate(spark, params: Params = DEFAULTS) -> DataFrame:
    """Checks of a table without rows: the row count fails and nothing else is asked."""
    return spark.range(1).select(
        F.lit("row_count").alias("check_name"), F.lit(FAIL).alias("status"), F.lit(0.0).alias("value"),
        F.lit(f"0 rows, minimum {params.min_rows}").alias("detail"),
    )

"""Distribution, regime and performance drift, the monitor's decision, and cooldowns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.columns import bin_of, psi_term, severity
from tidewatch.operators.cadence import SERIES
from tidewatch.operators.encode import category, vocabulary
from tidewatch.operators.ordering import Layout, add_position, in_blocks, join_spread, newest, running_sum, settle
from tidewatch.operators.percentiles import exact_percentiles
from tidewatch.params import DEFAULTS, Params


def tail_split(df: DataFrame, k: int, keys: Sequence[str] = (SERIES,), order: Sequence[str] = ("ts",)) -> DataFrame:
    """Add `part`: `current` for the last k rows of each key, `reference` for the rest, and the row count `n`.

    Only the k newest rows of a key are ranked (Spark limits them before the
    shuffle); the oldest of them is the cut. A series is never sorted as a whole.
    """
    keys = list(keys)
    mark = F.struct(*order)
    tail = newest(df.select(*keys, *order), keys, [F.desc(o) for o in order], k)
    cut = tail.groupBy(*keys).agg(F.min(mark).alias("_cut"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    joined = join_spread(df, cut.join(sizes, keys), keys, order)
    return joined.withColumn("part", F.when(mark >= F.col("_cut"), "current").otherwise("reference")).drop("_cut")


def psi(parted: DataFrame, value: str, keys: Sequence[str] = (SERIES,), params: Params = DEFAULTS, group_rows: int | None = None, layout: Layout | None = None) -> DataFrame:
    """Population stability index of `current` against `reference` rows, per key.

    Bin edges are deciles of the reference. Null when either side has fewer rows
    than bins.
    """
    keys = list(keys)
    rows = parted.where(F.col(value).isNotNull() & ~F.isnan(value))
    probs = [i / params.psi_bins for i in range(1, params.psi_bins)]
    deciles = exact_percentiles(rows.where(F.col("part") == "reference"), keys, value, probs, group_rows, layout)
    names = [c for c in deciles.columns if c not in keys]
    edges = deciles.select(*keys, F.array_distinct(F.array(*names)).alias("_edges"))
    binned = join_spread(rows, edges, keys, [value], "left").withColumn("bin", F.coalesce(bin_of(value, F.col("_edges")), F.lit(0)))
    counts = binned.groupBy(*keys, "bin").agg(
        F.count_if(F.col("part") == "reference").alias("r"), F.count_if(F.col("part") == "current").alias("c")
    )
    totals = counts.groupBy(*keys).agg(F.sum("r").alias("reference_rows"), F.sum("c").alias("current_rows"))
    terms = counts.join(totals, keys).withColumn(
        "_t", psi_term(F.col("r") / F.nullif(F.col("reference_rows"), F.lit(0)), F.col("c") / F.nullif(F.col("current_rows"), F.lit(0)), params.psi_floor)
    )
    # bins no row falls in contribute nothing: both shares sit on the floor
    enough = (F.max("reference_rows") >= params.psi_bins) & (F.max("current_rows") >= params.psi_bins)
    return terms.groupBy(*keys).agg(
        F.when(enough, F.round(F.sum("_t"), 4)).alias("psi"),
        F.max("reference_rows").alias("reference_rows"),
        F.max("current_rows").alias("current_rows"),
    )


def feature_drift(df: DataFrame, value: str, params: Params = DEFAULTS, keys: Sequence[str] = (SERIES,), order: Sequence[str] = ("ts",), layout: Layout | None = None) -> DataFrame:
    """PSI of the last `drift_window` known values against the earlier ones; null below two windows of rows."""
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    known = tail_split(df.where(F.col(value).isNotNull()), params.drift_window, keys, order)
    scores = psi(known, value, keys, params, layout=layout)
    enough = F.col("_all") >= params.drift_window * 2
    out = sizes.join(scores, keys, "left").withColumn("psi", F.when(enough, F.col("psi")))
    return out.select(*keys, "psi", severity("psi").alias("severity"), "reference_rows", "current_rows")


def categorical_drift(df: DataFrame, column: str, params: Params = DEFAULTS, keys: Sequence[str] = (SERIES,), order: Sequence[str] = ("ts",)) -> DataFrame:
    """PSI over the fixed vocabulary's shares, last window against the rest."""
    keys = list(keys)
    words = vocabulary(column, params)
    parted = tail_split(df, params.drift_window, keys, order).withColumn("_word", category(df, column, params))
    now, past = F.col("part") == "current", F.col("part") == "reference"
    counts = parted.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.count_if(past).alias("_r"),
        F.count_if(now).alias("_c"),
        *[F.count_if(past & (F.col("_word") == w)).alias(f"_r{i}") for i, w in enumerate(words)],
        *[F.count_if(now & (F.col("_word") == w)).alias(f"_c{i}") for i, w in enumerate(words)],
    )
    denominator = {"_r": F.nullif(F.col("_r"), F.lit(0)), "_c": F.nullif(F.col("_c"), F.lit(0))}
    terms = [psi_term(F.col(f"_r{i}") / denominator["_r"], F.col(f"_c{i}") / denominator["_c"], params.psi_floor) for i in range(len(words))]
    score = F.when(F.col("n") >= params.drift_window * 2, F.round(sum(terms[1:], terms[0]), 4))
    return counts.select(*keys, score.alias("psi")).withColumn("severity", severity("psi"))


def rolling_error(scored: DataFrame, keys: Sequence[str], params: Params = DEFAULTS, order: str = "predicted_for_ts") -> DataFrame:
    """Error over the most recent scored predictions of each key."""
    recent = newest(scored.where(F.col("abs_error").isNotNull()), list(keys), [F.desc(order)], params.drift_window)
    return recent.groupBy(*keys).agg(
        F.round(F.avg("abs_error"), 4).alias("window_mae"),
        F.round(F.max("abs_error"), 4).alias("worst"),
        F.count(F.lit(1)).alias("n_scored"),
        F.min(order).alias("from_ts"),
        F.max(order).alias("to_ts"),
    )


def decide(signals: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Combine per-target signals. Needs reference_mae, window_mae, n_scored, feature_psi, regime_psi.

    The first signal that fired is the trigger: performance, then regime mix,
    then input distribution. All of them are named in `reason`.
    """
    enough = F.coalesce(F.col("n_scored"), F.lit(0)) >= params.drift_min_samples
    # a perfect reference has no ratio: any error at all is the signal then
    exact = F.col("reference_mae").isNull() | (F.col("reference_mae") <= 0)
    ratio = F.when(enough & ~exact, F.col("window_mae") / F.col("reference_mae"))
    slower = enough & F.when(exact, F.col("window_mae") > 0).otherwise(ratio > params.mae_ratio_threshold)
    allowed = F.lit(params.retrain_on_feature_drift)
    shifted = {k: allowed & (F.col(f"{k}_psi") > params.psi_threshold) for k in ("regime", "feature")}
    fired = {
        "performance": F.coalesce(slower, F.lit(False)),
        "categorical": F.coalesce(shifted["regime"], F.lit(False)),
        "feature": F.coalesce(shifted["feature"], F.lit(False)),
    }
    trigger = F.coalesce(*[F.when(c, F.lit(n)) for n, c in fired.items()])
    reasons = F.concat_ws(
        "; ",
        F.when(~enough, F.format_string(f"performance: %d scored, need {params.drift_min_samples}", F.coalesce(F.col("n_scored"), F.lit(0))))
        .when(exact, F.when(fired["performance"], "performance: reference was exact, recent error is not").otherwise("performance: exact"))
        .otherwise(F.format_string("performance: %.2fx reference", ratio)),
        F.when(F.col("regime_psi").isNotNull(), F.format_string("regime mix: PSI %.4f", F.col("regime_psi"))),
        F.when(F.col("feature_psi").isNotNull(), F.format_string("input: PSI %.4f", F.col("feature_psi"))),
    )
    return signals.withColumns(
        {
            "ratio": F.round(ratio, 3),
            "trigger": trigger,
            "drifted": trigger.isNotNull(),
            "reason": reasons,
        }
    )


def _fold_cooldown(batches, keys, order, cooldown_us):
    """Walk the sorted stamps of a task, remembering only the last kept one of each run in progress."""
    last_key, last_at = None, None
    for pdf in batches:
        stamps = pdf[order].to_numpy().astype("datetime64[us]").astype("int64")
        names = list(zip(*[pdf[k] for k in keys]))
        kept = np.zeros(len(pdf), dtype=bool)
        for i, (name, at) in enumerate(zip(names, stamps)):
            if name != last_key or at - last_at >= cooldown_us:
                last_key, last_at, kept[i] = name, at, True
        yield pdf.assign(accepted=kept)


def cooldown(df: DataFrame, keys: Sequence[str], order: str, tie: str, seconds: int, layout: Layout) -> DataFrame:
    """Add `accepted`: false for events within `seconds` of the last accepted one of their key.

    Of several events at one instant only the first (by `tie`) can be accepted,
    so instants are what is folded, however many events share one. After a
    silence of at least the cooldown the next event is accepted whatever came
    before; such runs are independent and each is folded in one streaming pass.
    """
    keys = list(keys)
    if seconds <= 0:
        return df.withColumn("accepted", F.lit(True))
    instants = df.groupBy(*keys, order).agg(F.min(tie).alias(tie))
    placed = settle(add_position(instants, keys, [order], layout, "_at"), layout)

    def quiet(frame, by):
        before = F.lag(order).over(Window.partitionBy(*by).orderBy(order))
        silence = F.unix_micros(order) - F.unix_micros(before)
        return frame.withColumn("_new", F.when(silence >= seconds * 1_000_000, 1).otherwise(0))

    marked = settle(in_blocks(placed, keys, "_at", layout, quiet, before=1), layout)
    runs = running_sum(marked, keys, order, F.col("_new"), "_run", "_at", layout).select(*keys, order, tie, "_run")
    spread = runs.repartition(*[F.col(k) for k in keys], F.col("_run")).sortWithinPartitions(*keys, "_run", order)
    schema = T.StructType([*spread.schema.fields, T.StructField("accepted", T.BooleanType())])
    by = [*keys, "_run"]
    folded = spread.mapInPandas(lambda it: _fold_cooldown(it, by, order, seconds * 1_000_000), schema)
    kept = folded.where("accepted").drop("_run")
    return df.join(kept, [*keys, order, tie], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def monitor_actions(decided: DataFrame, cooling: Column, params: Params = DEFAULTS) -> DataFrame:
    """none / alert_only / suppressed / retrain for each decision; `cooling` says whether a retrain was too recent."""
    action = F.when(~F.col("drifted"), "none")
    if not params.auto_retrain:
        action = action.otherwise("alert_only")
    else:
        action = action.when(F.coalesce(cooling, F.lit(False)), "suppressed").otherwise("retrain")
    return decided.withColumn("action", action)


def with_outcomes(events: DataFrame, verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Write the gate's verdict back onto the events that started a retrain."""
    judged = events.join(verdicts.select(*keys, F.col("promote").alias("_p"), F.col("model_id").alias("new_model_id")), list(keys), "left")
    outcome = F.when(
        F.col("action") == "retrain", F.when(F.col("_p"), "promoted").when(~F.col("_p"), "rejected")
    ).when(F.col("action") != "none", F.col("action"))
    return judged.withColumn("outcome", outcome).withColumn("new_model_id", F.when(F.col("action") == "retrain", F.col("new_model_id"))).drop("_p")

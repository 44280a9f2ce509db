"""Model registry rows and the promotion gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordering import join_spread
from tidewatch.operators.serving import BASELINE_PREFIX, champions
from tidewatch.params import DEFAULTS, Params


def judge(results: DataFrame, incumbents: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = ("target",)) -> DataFrame:
    """Add promote, verdict, rule and gain_pct to training results.

    Needs mae, baseline_mae, cv_folds_won_fraction, cv_mae_std,
    cv_baseline_mae_std, champion_mae_same_window, error. Rules in order: an
    error; not better than the strongest baseline; too few folds won; too
    unstable; no incumbent or a baseline incumbent (promote); gain over the
    incumbent. A measure of 0 is a measure, only null means absent.
    """
    keys = list(keys)
    current = incumbents.select(*keys, F.col("model_id").alias("incumbent_id"), F.col("mae").alias("_stored"))
    joined = results.join(current, keys, "left")
    mae, base = F.col("mae"), F.col("baseline_mae")
    reference = F.coalesce("champion_mae_same_window", "_stored")
    gain = F.when(reference.isNull() | (reference <= 0), F.lit(100.0)).otherwise((reference - mae) / reference * 100.0)
    loses = F.lit(params.require_beat_baseline) & base.isNotNull() & (mae >= base)
    lucky = F.col("cv_folds_won_fraction") < params.min_cv_folds_won
    unstable = (F.col("cv_baseline_mae_std") != 0) & (F.col("cv_mae_std") / F.nullif(F.col("cv_baseline_mae_std"), F.lit(0.0)) > params.max_cv_std_ratio)
    rule = (
        F.when(F.col("error").isNotNull(), "error")
        .when(loses, "loses to baseline")
        .when(lucky, "too few folds won")
        .when(unstable, "unstable across folds")
        .when(F.col("incumbent_id").isNull(), "no incumbent")
        .when(F.col("incumbent_id").startswith(BASELINE_PREFIX), "incumbent is the baseline")
        .when(gain < params.min_improvement_pct, "gain too small")
        .otherwise("beats incumbent")
    )
    weighed = F.col("rule").isin("gain too small", "beats incumbent")
    out = joined.withColumn("rule", rule)
    promote = F.col("rule").isin("no incumbent", "incumbent is the baseline", "beats incumbent")
    return out.withColumns(
        {
            "promote": promote,
            "verdict": F.when(F.col("rule") == "error", "ERROR").when(promote, "PROMOTED").otherwise("REJECTED"),
            "gain_pct": F.when(weighed, F.round(gain, 2)),
            "same_window": F.when(weighed, F.col("champion_mae_same_window").isNotNull()),
        }
    ).drop("_stored")


def apply_decisions(models: DataFrame, judged: DataFrame, now, params: Params = DEFAULTS, keys: Sequence[str] = ("target",)) -> DataFrame:
    """New registry: at most one champion per target.

    A promoted model replaces the incumbent. Where it is rejected and the
    incumbent is missing or the baseline, persistence becomes the champion with
    the error just measured. `models` and the result share the columns model_id,
    target, algorithm, mae, is_champion, promoted_at, rejected_reason.
    """
    keys = list(keys)
    at = F.lit(now).cast("timestamp")
    void = lambda t: F.lit(None).cast(t)
    held = champions(models, keys).select(*keys, F.col("model_id").alias("_held"))
    ruled = judged.join(held, keys, "left")
    won = ruled.where("promote").select(
        *keys, "model_id", "algorithm", "mae", F.lit(True).alias("is_champion"), at.alias("promoted_at"), void("string").alias("rejected_reason")
    )
    lost = ruled.where(~F.col("promote"))
    rejected = lost.select(
        *keys, "model_id", "algorithm", "mae", F.lit(False).alias("is_champion"), void("timestamp").alias("promoted_at"), F.col("rule").alias("rejected_reason")
    )
    vacant = (F.col("verdict") == "REJECTED") & (F.col("_held").isNull() | F.col("_held").startswith(BASELINE_PREFIX))
    fallback = lost.where(vacant).select(
        *keys,
        F.concat_ws("-", F.lit(BASELINE_PREFIX), *[F.col(k) for k in keys]).alias("model_id"),
        F.lit("persistence").alias("algorithm"),
        F.col("persistence_mae").alias("mae"),
        F.lit(True).alias("is_champion"),
        at.alias("promoted_at"),
        void("string").alias("rejected_reason"),
    )
    added = won.unionByName(rejected).unionByName(fallback)
    taken = added.where("is_champion").select(*keys, F.lit(True).alias("_taken"))
    kept = join_spread(models.join(added.select("model_id"), "model_id", "left_anti"), taken, keys, ["model_id"], "left")
    demoted = kept.withColumn("is_champion", F.col("is_champion") & F.col("_taken").isNull()).drop("_taken")
    return demoted.select(*added.columns).unionByName(added)


def listing(models: DataFrame) -> DataFrame:
    return models.orderBy("target", F.desc("created_at"), "model_id")

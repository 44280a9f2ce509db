"""Trained forecasters: pooled gradient boosting, per-series ridge, validation, tuning, rollout.

Trees are fitted by MLlib, one pooled model per target over all series. Ridge is
fitted per series from sums of products that combine before the shuffle, so the
size of a series does not matter; only its small normal equations are solved in
Python.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import present, sorted_percentile
from tidewatch.operators.cadence import SERIES
from tidewatch.operators.features import LABEL, calendar_columns, fold_of, fold_start, interaction_columns
from tidewatch.operators.ordering import cut_lineage, running_offsets
from tidewatch.operators.scoring import apply_scaler, error_aggregates, fit_scaler, split_test, split_train
from tidewatch.operators.transform import ewma_spans
from tidewatch.params import DEFAULTS, TUNING_GRID, Params

VECTOR = "_vector"


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=VECTOR, handleInvalid="skip").transform(df)


def fit_boosting(train: DataFrame, features: Sequence[str], params: Params = DEFAULTS, label: str = LABEL, **overrides):
    """Pooled gradient-boosted trees. Overrides use the names of the tuning grid."""
    model = GBTRegressor(
        featuresCol=VECTOR,
        labelCol=label,
        predictionCol="predicted",
        maxIter=int(overrides.get("n_estimators", params.n_estimators)),
        maxDepth=int(overrides.get("max_depth", params.max_depth)),
        stepSize=float(overrides.get("learning_rate", params.learning_rate)),
        subsamplingRate=float(overrides.get("subsample", 1.0)),
        minInstancesPerNode=int(overrides.get("min_samples_leaf", 1)),
        seed=params.seed,
    )
    return model.fit(assembled(train, features).select(VECTOR, label))


def predict(model, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add `predicted`."""
    return model.transform(assembled(rows, features)).drop(VECTOR)


def importances(spark, model, features: Sequence[str]) -> DataFrame:
    values = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double")


def rescore(model, model_features: Sequence[str], rows: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame | None:
    """Error of an existing champion on this test window; None when a feature it needs no longer exists."""
    if any(f not in rows.columns for f in model_features):
        return None
    scored = predict(model, rows, model_features)
    return scored.groupBy(*keys).agg(F.round(error_aggregates(F.col(LABEL), F.col("predicted"))[0], 4).alias("champion_mae_same_window"))


# -- ridge per series --------------------------------------------------------


def _solve(batches: Iterator[pd.DataFrame], p: int, alpha: float) -> Iterator[pd.DataFrame]:
    rows, cols = np.triu_indices(p)
    for pdf in batches:
        out = []
        for n, sx, sxx, sxy, sy in zip(pdf["_n"], pdf["_sx"], pdf["_sxx"], pdf["_sxy"], pdf["_sy"]):
            sums = np.asarray(sx, float)
            gram = np.zeros((p, p))
            gram[rows, cols] = sxx
            gram = gram + np.triu(gram, 1).T - np.outer(sums, sums) / n
            weights = np.linalg.solve(gram + alpha * np.eye(p), np.asarray(sxy, float) - sums * sy / n)
            out.append((weights.tolist(), float((sy - sums @ weights) / n)))
        keys = pdf.drop(columns=["_n", "_sx", "_sxx", "_sxy", "_sy"]).reset_index(drop=True)
        yield pd.concat([keys, pd.DataFrame(out, columns=["weights", "intercept"])], axis=1)


def solve_ridge(sums: DataFrame, p: int, alpha: float) -> DataFrame:
    """Rows with the sums of p features solved to weights and intercept; other columns stay."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema.fields if f.name not in ("_n", "_sx", "_sxx", "_sxy", "_sy"))
    return sums.mapInPandas(lambda it: _solve(it, p, alpha), f"{kept}, weights array<double>, intercept double")


def fit_ridge(train: DataFrame, features: Sequence[str], alpha: float, label: str = LABEL, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Weights and intercept per key from one aggregation of sums of products."""
    keys, names = list(keys), [f"`{f}`" for f in features]
    p = len(names)
    prods = [f"sum(CAST({names[i]} AS DOUBLE) * {names[j]})" for i, j in zip(*np.triu_indices(p))]
    sums = train.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.expr(f"array({', '.join(f'sum(CAST({n} AS DOUBLE))' for n in names)})").alias("_sx"),
        F.expr(f"array({', '.join(prods)})").alias("_sxx"),
        F.expr(f"array({', '.join(f'sum({n} * `{label}`)' for n in names)})").alias("_sxy"),
        F.expr(f"sum(`{label}`)").alias("_sy"),
    )
    return solve_ridge(sums, p, alpha)


def predict_ridge(rows: DataFrame, weights: DataFrame, features: Sequence[str], name: str = "p_ridge", keys: Sequence[str] = (SERIES,)) -> DataFrame:
    terms = " + ".join(f"weights[{i}] * `{f}`" for i, f in enumerate(features))
    return rows.join(weights, list(keys), "left").withColumn(name, F.expr(f"intercept + {terms}")).drop("weights", "intercept")


def ridge_rung(rows: DataFrame, features: Sequence[str], params: Params = DEFAULTS, method: str | None = "minmax", alpha: float | None = None) -> DataFrame:
    """Numbered usable rows with `p_ridge`: scaled on the training rows, fitted on them, predicted everywhere."""
    base = rows
    if method:
        scaler = fit_scaler(split_train(rows), features, method)
        scaled = apply_scaler(rows.select(SERIES, "rn", "n", LABEL, *features), scaler, features)
    else:
        scaled = rows.select(SERIES, "rn", "n", LABEL, *features)
    weights = fit_ridge(split_train(scaled), features, alpha if alpha is not None else params.ridge_alpha)
    return base.join(predict_ridge(scaled, weights, features).select(SERIES, "rn", "p_ridge"), [SERIES, "rn"])


# -- evaluation --------------------------------------------------------------


def holdout(rows: DataFrame, features: Sequence[str], params: Params = DEFAULTS, **overrides) -> DataFrame:
    """Test rows with the prediction of a model fitted on the training rows."""
    return predict(fit_boosting(split_train(rows), features, params, **overrides), split_test(rows), features)


def fold_rows(rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return rows.withColumn("fold", fold_of(F.col("rn"), F.col("n"), params))


def cross_validate(rows: DataFrame, features: Sequence[str], params: Params = DEFAULTS, **overrides) -> DataFrame:
    """Rolling-origin predictions: each fold's rows predicted by a model fitted on what came before.

    The loop is over folds (a handful), each fit and each prediction is a Spark job.
    """
    start = fold_start(F.col("n"), params)
    size = F.floor((F.col("n") - start) / params.cv_folds)
    out = None
    tagged = fold_rows(rows, params)
    for fold in range(params.cv_folds):
        before = tagged.where(F.col("rn") < start + size * fold)
        part = predict(fit_boosting(before, features, params, **overrides), tagged.where(F.col("fold") == fold), features)
        out = part if out is None else out.unionByName(part)
    return out


def cv_scores(predicted: DataFrame, target: str, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Per fold the model's and persistence's error on the same rows."""
    model, _ = error_aggregates(F.col(LABEL), F.col("predicted"))
    naive, _ = error_aggregates(F.col(LABEL), F.col(f"{target}_lag_0"))
    return predicted.groupBy(*keys, "fold").agg(model.alias("model"), naive.alias("base"))


def scaling_table(rows: DataFrame, features: Sequence[str], params: Params = DEFAULTS, **overrides) -> DataFrame:
    """(estimator, scaling, rank, mae) of boosting and ridge without and with each scaler, over all series."""
    out = None
    for rank, method in enumerate(("none", "standard", "minmax", "robust")):
        # the trees are fitted over all series, so is their scaler; each series has a ridge and a scaler of its own
        scaled = rows if method == "none" else apply_scaler(rows, fit_scaler(split_train(rows), features, method), features)
        pooled = rows if method == "none" else apply_scaler(rows, fit_scaler(split_train(rows), features, method, ()), features, ())
        boosted = holdout(pooled, features, params, **overrides).select(F.lit("boosting").alias("estimator"), LABEL, "predicted")
        ridge = split_test(predict_ridge(scaled, fit_ridge(split_train(scaled), features, params.ridge_alpha), features, "predicted"))
        both = boosted.unionByName(ridge.select(F.lit("ridge").alias("estimator"), LABEL, "predicted"))
        mae = F.round(error_aggregates(F.col(LABEL), F.col("predicted"))[0], 4).alias("mae")
        part = both.groupBy("estimator").agg(mae).select("estimator", F.lit(method).alias("scaling"), F.lit(rank).alias("rank"), "mae")
        out = part if out is None else out.unionByName(part)
    return out


# -- permutation importance --------------------------------------------------


def indexed(df: DataFrame, keys: Sequence[str], rows_per_part: int = 1_000_000) -> tuple[DataFrame, int]:
    """Add a dense index `_i` over all rows without sorting them in one place: hash parts, counts, offsets."""
    parts = max(1, math.ceil(df.count() / rows_per_part))
    placed = df.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).withColumn("_all", F.lit(0))
    counts = running_offsets(placed.groupBy("_all", "_part").agg(F.count(F.lit(1)).alias("_n")), ["_all"], "_part", "_n", "_offset")
    from pyspark.sql import Window

    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)).cast("bigint") - 1
    total = counts.agg(F.sum("_n")).first()[0] or 0
    out = placed.join(counts.select("_part", "_offset"), "_part").withColumn("_i", F.col("_offset") + inside)
    return out.drop("_part", "_all", "_offset"), total


def _stride(total: int, rng: random.Random) -> tuple[int, int]:
    while True:
        a = rng.randrange(1, max(2, total))
        if math.gcd(a, total) == 1:
            return a, rng.randrange(total)


def _wrapped(a: Column, i: Column, b: Column, total: int) -> Column:
    """(a * i + b) mod total in decimals: the product of two row numbers outgrows 64 bits."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.pmod((wide(a) * wide(i)).cast("decimal(38,0)") + wide(b), F.lit(total).cast("decimal(38,0)")).cast("bigint")


def _walk(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The leaf value of every row of x in one tree: all rows go down a level at a time."""
    feature, threshold, left, right, value = tree
    at, every = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        split = feature[at]
        inner = split >= 0
        if not inner.any():
            return value[at]
        lower = x[every, np.maximum(split, 0)] <= threshold[at]
        at = np.where(inner, np.where(lower, left[at], right[at]), at)


def tree_arrays(model, features: Sequence[str], spark) -> list[tuple[np.ndarray, ...]]:
    """(feature, threshold, left, right, value) of each tree by place. A model's size is set by its parameters, not by data."""
    from tidewatch.operators.forest import forest_rows

    names = {f: j for j, f in enumerate(features)}
    nodes, out = forest_rows(model, features, spark).toPandas().sort_values(["tree", "node"]), []
    for _, tree in nodes.groupby("tree"):
        place = {n: k for k, n in enumerate(tree["node"])}
        child = lambda c: np.array([place.get(n, 0) for n in tree[c]], np.int64)
        out.append((np.array([names.get(f, -1) for f in tree["feature"]], np.int64), tree["threshold"].to_numpy(float), child("left"), child("right"), tree["value"].to_numpy(float)))
    return out


def permutation_importance(model, test: DataFrame, features: Sequence[str], keys: Sequence[str] = (SERIES, "rn"), params: Params = DEFAULTS) -> DataFrame:
    """(feature, importance): mean growth of the error when one column is shuffled.

    In each repeat row i meets the values of row (a*i + b) mod N, with a coprime
    to N a permutation, so no shuffle needs a global sort and a repeat costs one
    exchange of the rows for all features. A task walks again only the trees that
    use a column, and hands on sums.
    """
    rng = random.Random(params.seed)
    rows, total = indexed(test.select(*keys, F.col(LABEL).cast("double").alias("_y"), F.array(*[F.col(f).cast("double") for f in features]).alias("_x")), keys)
    if total < 2:
        raise ValueError("permutation needs at least two rows")
    rows = cut_lineage(rows.select("_i", "_y", "_x"))
    strides = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in (_stride(total, rng) for _ in range(params.permutation_repeats))])
    donors = rows.select(F.col("_i").alias("_donor"), F.col("_x").alias("_given"))
    repeats = rows.withColumn("_t", F.explode(strides)).withColumn("_donor", _wrapped(F.col("_t.a"), F.col("_i"), F.col("_t.b"), total)).select("_donor", "_y", "_x")
    trees = tree_arrays(model, features, test.sparkSession)
    users = [[k for k, t in enumerate(trees) if (t[0] == j).any()] for j in range(len(features))]

    def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n = np.zeros(len(users)), 0
        for pdf in batches:
            if not len(pdf):
                continue
            y, x, given = pdf["_y"].to_numpy(float), np.stack(pdf["_x"]).astype(float), np.stack(pdf["_given"]).astype(float)
            leaves = [_walk(t, x) for t in trees]
            whole = np.sum(leaves, axis=0)
            plain = np.abs(y - whole)
            n += len(pdf)
            for j, used in enumerate(users):
                if used:
                    own = x[:, j].copy()
                    x[:, j] = given[:, j]
                    moved = whole + sum(_walk(trees[k], x) - leaves[k] for k in used)
                    x[:, j] = own
                    sums[j] += float((np.abs(y - moved) - plain).sum())
        if n:
            yield pd.DataFrame({"j": range(len(users)), "grown": sums, "n": n})

    parts = repeats.join(donors, "_donor").select("_y", "_x", "_given").mapInPandas(grown, "j int, grown double, n long")
    names = F.array(*[F.lit(f) for f in features])
    return parts.groupBy("j").agg((F.sum("grown") / F.sum("n")).alias("importance")).select(F.get(names, F.col("j")).alias("feature"), "importance")


def importance_screen(scores: DataFrame, protected: Sequence[str] = (), params: Params = DEFAULTS) -> DataFrame:
    return scores.withColumn("kept", (F.col("importance") > params.min_importance) | F.col("feature").isin(list(protected)))


def select_features(rows: DataFrame, features: Sequence[str], target: str, params: Params = DEFAULTS, **overrides) -> tuple[list[str], DataFrame]:
    """Three screens in turn: constant columns, near-duplicates, columns the model does not need.

    Returns the kept features and a table (feature, stage, kept). The feature
    list is what travels through the driver, never rows.
    """
    from tidewatch.operators.scoring import cardinality, correlation_pairs, correlation_screen

    protected = [f"{target}_lag_0"]
    stage = {}
    varied = {r.feature for r in cardinality(rows, features, params).where("kept").select("feature").collect()}
    kept = [f for f in features if f in varied]
    stage |= {f: "cardinality" for f in features if f not in varied}
    train, test = split_train(rows), split_test(rows)
    scores = permutation_importance(fit_boosting(train, kept, params, **overrides), test, kept, params=params)
    ranking = {r.feature: r.importance for r in scores.collect()}
    unlike, dropped = correlation_screen(kept, correlation_pairs(rows, kept), ranking, protected, params)
    stage |= {f: "correlation" for f in dropped}
    again = importance_screen(permutation_importance(fit_boosting(train, unlike, params, **overrides), test, unlike, params=params), protected, params)
    useful = {r.feature for r in again.where("kept").select("feature").collect()}
    final = [f for f in unlike if f in useful]
    stage |= {f: "importance" for f in unlike if f not in useful}
    table = rows.sparkSession.createDataFrame([(f, stage.get(f, "kept"), f in final) for f in features], "feature string, stage string, kept boolean")
    return final, table


def held_out_mae(rows: DataFrame, features: Sequence[str], params: Params = DEFAULTS, **overrides) -> float | None:
    """Error on the test rows of a model fitted on the training rows."""
    return holdout(rows, features, params, **overrides).agg(error_aggregates(F.col(LABEL), F.col("predicted"))[0]).first()[0]


def selection_effect(rows: DataFrame, table: DataFrame, params: Params = DEFAULTS, **overrides) -> DataFrame:
    """What a selection cost: features before and after, and the held-out error with all that vary and with the kept ones."""
    stages = {r.feature: r.stage for r in table.collect()}
    varied, kept = [f for f, s in stages.items() if s != "cardinality"], [f for f, s in stages.items() if s == "kept"]
    before, after = (held_out_mae(rows, names, params, **overrides) if names else None for names in (varied, kept))
    change = None if before is None or after is None else after - before
    return rows.sparkSession.createDataFrame([(len(stages), len(kept), before, after, change)], "n_before int, n_after int, mae_all_features double, mae_selected double, mae_change double")


# -- tuning ------------------------------------------------------------------


def sample_grid(grid=None, n: int = DEFAULTS.tuning_trials, seed: int = DEFAULTS.seed) -> list[dict]:
    """Up to n distinct candidates; the attempts are bounded, so a small grid ends the search."""
    grid, rng = grid or TUNING_GRID, random.Random(seed)
    names, seen = sorted(grid), {}
    for _ in range(20 * n):
        if len(seen) == n:
            break
        draw = {k: rng.choice(grid[k]) for k in names}
        seen.setdefault(tuple(draw.values()), draw)
    return list(seen.values())


def tune(rows: DataFrame, features: Sequence[str], target: str, candidates: Sequence[dict], params: Params = DEFAULTS) -> DataFrame:
    """(trial, cv_mae, cv_std) per candidate; trial -1 is the current setting."""
    spark, out = rows.sparkSession, []
    incumbent = {"n_estimators": params.n_estimators, "max_depth": params.max_depth, "learning_rate": params.learning_rate}
    for trial, candidate in enumerate([incumbent, *candidates], start=-1):
        scores = cv_scores(cross_validate(rows, features, params, **candidate), target, ())
        row = scores.agg(F.avg("model").alias("m"), F.stddev_pop("model").alias("s")).first()
        out.append((trial, str(sorted(candidate.items())), round(row.m, 5), round(row.s, 5)))
    return spark.createDataFrame(out, "trial int, candidate string, cv_mae double, cv_std double")


def tuning_verdict(trials: DataFrame) -> DataFrame:
    """Best candidate, adopted only if it gains more than its own spread between folds."""
    best = F.min(F.when(F.col("trial") >= 0, F.struct("cv_mae", "trial", "cv_std", "candidate")))
    held = F.max(F.when(F.col("trial") == -1, F.col("cv_mae")))
    out = trials.agg(best.alias("b"), held.alias("incumbent_cv_mae"))
    gain = F.col("incumbent_cv_mae") - F.col("b.cv_mae")
    return out.select(
        F.col("b.trial").alias("best_trial"), F.col("b.candidate").alias("candidate"), F.col("b.cv_mae").alias("cv_mae"), F.col("b.cv_std").alias("cv_std"),
        "incumbent_cv_mae", F.round(gain, 5).alias("cv_gain"), (gain > F.col("b.cv_std")).alias("adopt"),
    )


def tuning_report(rows: DataFrame, features: Sequence[str], target: str, candidates: Sequence[dict], params: Params = DEFAULTS) -> DataFrame:
    """The verdict with both settings judged on the held-out rows that no fold saw, and the settings to adopt.

    `adopted_params` is null where the gain is within the spread between folds.
    """
    verdict = cut_lineage(tuning_verdict(tune(rows, features, target, candidates, params)))
    best = candidates[verdict.first().best_trial]
    tuned, held = held_out_mae(rows, features, params, **best), held_out_mae(rows, features, params)
    return verdict.select(
        "*",
        F.lit(len(candidates)).alias("trials"),
        F.round(F.lit(tuned), 5).alias("tuned_test_mae"),
        F.round(F.lit(held), 5).alias("incumbent_test_mae"),
        F.round(F.lit(held) - F.lit(tuned), 5).alias("test_gain"),
        F.when(F.col("adopt"), F.lit(json.dumps(best, sort_keys=True))).alias("adopted_params"),
    )


# -- iterative rollout -------------------------------------------------------


def _array_ewma(values: Column, span: int) -> Column:
    a = 2.0 / (span + 1)
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda y, x: F.lit(a) * x + F.lit(1 - a) * y)


def vector_from_history(target: str, params: Params = DEFAULTS) -> dict[str, Column]:
    """Feature columns of the newest moment from the array `history` (oldest first) and the instant `ts`."""
    h = F.col("history")
    back = lambda k: F.get(h, F.size(h) - 1 - k)
    tail = F.slice(h, F.greatest(F.size(h) - params.roll_window + 1, F.lit(1)), F.lit(params.roll_window))
    mean = F.aggregate(tail, F.lit(0.0), lambda s, x: s + x) / F.size(tail)
    square = F.aggregate(tail, F.lit(0.0), lambda s, x: s + (x - F.col(f"{target}_roll_mean")) * (x - F.col(f"{target}_roll_mean")))
    fast, slow = ewma_spans(params)
    first = {f"{target}_lag_{k}": back(k) for k in params.lags} | {
        target: back(0),
        f"{target}_roll_mean": mean,
        f"{target}_roll_max": F.array_max(tail),
        f"{target}_roll_min": F.array_min(tail),
        f"{target}_delta": back(0) - back(1),
        f"{target}_ewma_fast": _array_ewma(h, fast),
        f"{target}_ewma_slow": _array_ewma(h, slow),
        f"{target}_headroom": F.lit(100.0) - back(0),
    }
    second = {
        f"{target}_roll_std": F.sqrt(square / (F.size(tail) - 1)),
        f"{target}_trend": F.col(f"{target}_ewma_fast") - F.col(f"{target}_ewma_slow"),
    }
    return [first, second, interaction_columns(target) | calendar_columns()]


def rollout(model, state: DataFrame, target: str, features: Sequence[str], params: Params = DEFAULTS, steps: int | None = None, every: int = 5) -> DataFrame:
    """Feed each prediction back as the next observation, for all rows of `state` in parallel.

    `model` is a fitted ensemble or a function that adds `predicted` to a frame.
    `state` has one row per series (or decision): its keys, `ts`, `history` and
    the constant columns the model uses. The loop runs over steps; every few
    steps the state is written to the shared checkpoint folder, as the plan
    would otherwise nest. Adds `forecast`, the array of predictions.
    """
    columns = state.columns
    moving = state.withColumn("forecast", F.array().cast("array<double>"))
    for step in range(1, (steps or params.horizon) + 1):
        frame = moving
        for level in vector_from_history(target, params):
            frame = frame.withColumns({k: v for k, v in level.items() if k not in ("ts",)})
        frame = model(frame) if callable(model) else predict(model, frame, features)
        moving = frame.select(
            *[c for c in columns if c not in ("ts", "history")],
            F.timestamp_micros(F.unix_micros("ts") + F.lit(int(params.nominal_cadence * 1_000_000))).alias("ts"),
            F.array_append("history", F.col("predicted")).alias("history"),
            F.array_append("forecast", F.col("predicted")).alias("forecast"),
        )
        if step % every == 0:
            moving = cut_lineage(moving)
    return moving


def trajectory(rolled: DataFrame, start: str, keys: Sequence[str], params: Params = DEFAULTS) -> DataFrame:
    """Forecast arrays as rows with their band; `start` is the instant before the first step, `mae` the model's error."""
    mae = F.coalesce(F.nullif(F.col("mae"), F.lit(0.0)), F.lit(1.5))
    rows = rolled.select(*keys, start, "mae", F.posexplode("forecast").alias("_p", "predicted")).withColumn("step", F.col("_p") + 1)
    spread = F.lit(1.96) * mae * F.sqrt(F.col("step") / 5.0)
    return rows.select(
        *keys,
        "step",
        F.timestamp_micros(F.unix_micros(start) + F.col("step") * F.lit(int(params.nominal_cadence * 1_000_000))).alias("ts"),
        "predicted",
        F.round(F.least(F.lit(100.0), F.col("predicted") + spread), 4).alias("upper_bound"),
        F.round(F.greatest(F.lit(0.0), F.col("predicted") - spread), 4).alias("lower_bound"),
    )


def forecast_p95(values: Column) -> Column:
    return sorted_percentile(present(values), 0.95)


# -- walk-forward refit ------------------------------------------------------


def refit_forecasts(rows: DataFrame, decided: DataFrame, target: str, features: Sequence[str], params: Params = DEFAULTS, **overrides) -> DataFrame:
    """Decisions with `forecast` replaced by a model refitted every `retrain_every` decisions.

    `rows` are numbered usable rows with the instant `ts`; `decided` comes from
    `backtest.decisions` with the companions the features need. A block's model
    sees, of every series, only rows before that block's first decision there.
    The loop is over blocks; all decisions of a block roll forward together.
    Blocks with too few rows keep the persistence forecast.
    """
    last = decided.agg(F.max("step")).first()[0]
    if last is None:
        return decided
    block = F.floor(F.col("step") / params.retrain_every)
    out = None
    for b in range(last // params.retrain_every + 1):
        mine = cut_lineage(decided.where(block == b))
        begins = mine.groupBy(SERIES).agg(F.min("ts").alias("_begin"))
        before = rows.join(begins, SERIES).where(F.col("ts") < F.col("_begin"))
        # the label of the newest rows lies at or behind the decision
        known = before.groupBy(SERIES).agg((F.max("rn") - params.target_shift).alias("_known"))
        seen = cut_lineage(before.join(known, SERIES).where(F.col("rn") <= F.col("_known")).select(*features, LABEL))
        if seen.count() < params.min_train_rows:
            part = mine
        else:
            model = fit_boosting(seen, features, params, **overrides)
            state = mine.select(SERIES, "step", "ts", F.filter("recent", lambda v: v.isNotNull()).alias("history"))
            rolled = rollout(model, state, target, features, params).select(SERIES, "step", F.col("forecast").alias("_new"))
            part = mine.join(rolled, [SERIES, "step"], "left")
            part = part.withColumn("forecast", F.coalesce("_new", "forecast")).drop("_new").select(*mine.columns)
        out = part if out is None else out.unionByName(part)
    return out

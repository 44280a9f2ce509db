"""Queries with stored forests. Each series has three small trees whose cuts follow from its own mean, so SQL can walk the same trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import features as X
from tidewatch.operators import forest as W
from tidewatch.operators import scoring as Z
from tidewatch.operators import serving as P
from tidewatch.operators import store as O
from tidewatch.plans import views as V
from tidewatch.plans.catalog import nudge, query, with_ctes
from tidewatch.plans.records import _KEPT
from tidewatch.plans.shape import FEATS, TARGET, USABLE, framed, usable

_ROOTS = [f"{TARGET}_lag_0", f"{TARGET}_roll_mean", f"{TARGET}_ewma_slow"]
_SECOND = f"{TARGET}_lag_1"
_TREES = [
    "means AS (SELECT event_type AS series_key, round(avg(value), 2) AS m FROM events GROUP BY 1)",
    f"""trees AS (SELECT series_key, t AS tree, n AS node, CASE n WHEN 0 THEN {_ROOTS!r}[t + 1] WHEN 1 THEN '{_SECOND}' END AS feature,
  CASE n WHEN 0 THEN m * (0.6 + 0.2 * t) WHEN 1 THEN m * 0.5 END AS threshold, CASE n WHEN 0 THEN 1 WHEN 1 THEN 3 END AS l, CASE n WHEN 0 THEN 2 WHEN 1 THEN 4 END AS r,
  CASE n WHEN 2 THEN m * 0.3 WHEN 3 THEN m * 0.1 WHEN 4 THEN m * 0.2 END AS value FROM means, (SELECT unnest(range(3)) AS t), (SELECT unnest(range(5)) AS n))""",
]
_VALUE = "CASE feature " + " ".join(f"WHEN '{f}' THEN v.{f}" for f in [*_ROOTS, _SECOND]) + " END"
_WALK = [
    "walk AS (SELECT series_key, ts, t AS tree, 0 AS node FROM vec, (SELECT unnest(range(3)) AS t) UNION ALL "
    f"SELECT w.series_key, w.ts, w.tree, CASE WHEN {_VALUE} <= threshold THEN l ELSE r END FROM walk w JOIN trees x ON w.series_key = x.series_key AND w.tree = x.tree AND w.node = x.node "
    "JOIN vec v ON w.series_key = v.series_key AND w.ts = v.ts WHERE feature IS NOT NULL)",
    "fallen AS (SELECT w.series_key, w.ts, sum(value) AS predicted FROM walk w JOIN trees x ON w.series_key = x.series_key AND w.tree = x.tree AND w.node = x.node WHERE feature IS NULL GROUP BY ALL)",
]


def walked(ctes: list[str], vectors: str, final: str) -> str:
    return with_ctes([*ctes, *_TREES, f"vec AS ({vectors})", *_WALK], final).replace("WITH ", "WITH RECURSIVE ", 1)


def fixed_forest(spark, d):
    """Three trees of five nodes for each event type, as rows."""
    means = V.table(spark, d, "events").groupBy(F.col("event_type").alias("series_key")).agg(F.round(F.avg("value"), 2).alias("m"))
    m, n = F.col("m"), F.col("node")
    nodes = means.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return nodes.select(
        "series_key",
        "tree",
        "node",
        F.when(n == 0, F.get(F.array(*[F.lit(f) for f in _ROOTS]), F.col("tree"))).when(n == 1, F.lit(_SECOND)).alias("feature"),
        F.when(n == 0, m * (F.lit(0.6) + F.lit(0.2) * F.col("tree"))).when(n == 1, m * 0.5).alias("threshold"),
        F.when(n == 0, 1).when(n == 1, 3).alias("left"),
        F.when(n == 0, 2).when(n == 1, 4).alias("right"),
        F.when(n == 2, m * 0.3).when(n == 3, m * 0.1).when(n == 4, m * 0.2).alias("value"),
    )


@query("next_predictions_forest", walked(FEATS, f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts DESC) AS k FROM feat WHERE {_KEPT}) WHERE k = 1",
                                         "SELECT series_key, 'm-' || series_key AS model_id, ts + INTERVAL 3 SECOND AS predicted_for_ts, round(predicted, 4) AS predicted, CAST(NULL AS VARCHAR) AS error FROM fallen"))
def next_predictions_forest(spark, d):
    """A stored forest serves every series' newest vector."""
    frame, names, _ = framed(spark, d)
    own = O.identify(TARGET, names)
    champion = W.packed(fixed_forest(spark, d), ["series_key"]).select("*", F.concat(F.lit("m-"), "series_key").alias("model_id"), F.lit(False).alias("is_baseline"), own.alias("feature_definition"))
    return P.predict_next(X.serving_rows(frame, names).withColumn("definition_id", own), champion, TARGET)


@query("champion_rescored", walked(USABLE, "SELECT * FROM usable WHERE rn >= CAST(floor(n * 0.8::DOUBLE) AS BIGINT)",
                                   "SELECT series_key, round(avg(abs(target_next - predicted)), 4) AS champion_mae_same_window, count(*) AS rows_scored FROM fallen JOIN vec USING (series_key, ts) GROUP BY series_key"))
def champion_rescored(spark, d):
    """The stored forest of each series on the test rows a challenger is judged on."""
    rows, _, _ = usable(spark, d)
    return W.rescore_champions(Z.split_test(rows), W.packed(fixed_forest(spark, d), ["series_key"]))


@query("forest_backfill", walked(USABLE, "SELECT * FROM usable", f"SELECT series_key, ts + INTERVAL 3 SECOND AS predicted_for_ts, {nudge('predicted')} AS predicted FROM fallen"))
def forest_backfill(spark, d):
    """The stored forest replayed over every complete row."""
    rows, _, _ = usable(spark, d)
    out = W.predict_forest(rows, W.packed(fixed_forest(spark, d), ["series_key"]))
    return out.select("series_key", (F.col("ts") + F.expr("INTERVAL 3 SECONDS")).alias("predicted_for_ts"), "predicted")

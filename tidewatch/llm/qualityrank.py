"""Quality of documents by pairwise ranking.

Labels say which of two documents is better, not how good one is. A
Bradley-Terry model gives every document a strength, linear in statistics of its
text, so that the chance of document i being preferred to j is the logistic
function of the difference of strengths. It is learned from preference pairs, a
good and a poor document each, by logistic loss on the differences of their
features. Documents are then cut at a quantile of the strengths: the one that
leaves as large a share above it as the labels call good.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.langid import held_out
from tidewatch.llm.quality import FEATURES, feature_rows, statistics, with_features
from tidewatch.llm.text import small_batches

SAMPLE_ROWS = 20_000
PARTNERS = 8
RIDGE = 1e-3
STEPS = 50
FOLDS, HELD_OUT = 5, 0
ACCEPT_FROM = 0.3
#: Shares near 0 tell more apart than those near 1: log(1 + STRETCH * share) stands beside each share.
STRETCH = 50.0
SHARES = np.array([name.endswith("_share") for name in FEATURES])


def descriptors(x: np.ndarray) -> np.ndarray:
    """Statistics of texts, the shares among them twice."""
    return np.concatenate([x, np.log1p(STRETCH * x[:, SHARES])], 1)


@dataclass(frozen=True)
class Ranking:
    """Strength of a document: weights on standardised descriptors; `cut` is the strength at the accepting quantile."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((descriptors(x) - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray, at_cut: float = ACCEPT_FROM) -> np.ndarray:
        """Chance of being preferred to a document at the cut, with odds shifted so that the cut itself scores `at_cut`."""
        odds = np.clip(self.strength(x) - self.cut, -500, 500) + np.log(at_cut / (1 - at_cut))
        return np.where(self.strength(x) >= self.cut, np.maximum(1 / (1 + np.exp(-odds)), at_cut), np.minimum(1 / (1 + np.exp(-odds)), np.nextafter(at_cut, 0)))


def preference_pairs(good: np.ndarray, partners: int = PARTNERS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(preferred rows, other rows): every row with `partners` random rows of the other label; their number is rows times partners."""
    draw = np.random.default_rng(seed)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    better = np.r_[np.repeat(up, partners), draw.choice(up, len(down) * partners)]
    worse = np.r_[draw.choice(down, len(up) * partners), np.repeat(down, partners)]
    return better, worse


def fit_ranking(x: np.ndarray, good: np.ndarray, partners: int = PARTNERS, ridge: float = RIDGE, steps: int = STEPS) -> Ranking:
    """Weights that minimise the mean logistic loss of all preference pairs, by Newton steps that are halved until the loss falls."""
    d = descriptors(x)
    mean, scale = d.mean(0), d.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (d - mean) / scale
    better, worse = preference_pairs(good, partners)
    diff = z[better] - z[worse]
    w = np.zeros(diff.shape[1])

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, -(diff @ v)).mean() + ridge * (v @ v) / 2)

    now = loss(w)
    for _ in range(steps):
        upset = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))  # chance the model gives to the other order
        gradient = ridge * w - diff.T @ upset / len(diff)
        curve = (diff * (upset * (1 - upset))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        move, size = np.linalg.solve(curve, gradient), 1.0
        while size > 1e-6 and loss(w - size * move) > now:
            size /= 2
        then = loss(w - size * move)
        if now - then < 1e-10:
            break
        w, now = w - size * move, then
    return Ranking(mean, scale, w, float(np.quantile(z @ w, (~good).mean(), method="midpoint")))


def fit_on_preferences(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS, fold: int = HELD_OUT) -> Ranking | None:
    """A ranking from at most `sample_rows` labelled rows outside the held-out fold, drawn by a hash of the id.

    None if there are no such rows or only one kind of them. An id with several
    labels has the lowest; an id with several texts is one row, that with the
    least features.
    """
    taught = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(folds=folds, fold=fold))
    some = taught.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    fed = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most sample_rows pairs of numbers
    rows = with_features(fed).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("features").alias("features")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    good = np.array([r["quality"] > 0 for r in rows], bool)
    if not good.any() or good.all():
        return None
    return fit_ranking(np.array([r["features"] for r in rows]), good)


def rank_quality(docs: DataFrame, ranking: Ranking | None, accept_from: float = ACCEPT_FROM, text_col: str = "text") -> DataFrame:
    """Every row of `docs` with score (0 to 1) and predicted (1 from `accept_from` on) added.

    Only the text is looked at, whole; a null text is an empty one, whose score
    follows from its statistics like any other. Without a ranking all rows score
    1/2. Repeated rows are handled alike; added columns replace input columns of
    the same names.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    n = len(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_rows(statistics(batch.column(n).to_pylist()))
            score = ranking.score(x, accept_from) if ranking is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(score), pa.array((score >= accept_from).astype(np.int32))], names=schema.names)

    return docs.withColumn("_text", F.col(text_col).cast("binary")).mapInArrow(judge, schema)


def classify_quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = HELD_OUT) -> DataFrame:
    """Every row of `docs` with held_out, score and predicted; a null id is in no held-out fold."""
    marked = docs.drop("held_out").withColumn("held_out", held_out(folds=folds, fold=fold))
    return rank_quality(marked, fit_on_preferences(docs, labels, folds=folds, fold=fold))

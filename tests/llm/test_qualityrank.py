"""Pairwise quality ranking: the fit against a plain-Python descent, held-out accuracy, awkward tables."""

import math
import random
import zlib

import fixtures as fx
import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import qualityrank as R
from tidewatch.llm import queries
from tidewatch.llm.quality import FEATURES, feature_rows, statistics


def features(texts):
    return feature_rows(statistics([(t or "").encode() for t in texts]))


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(n)) + "."


def corpus(rng, n):
    """Good prose and poor texts: symbols, repeats, shouting."""
    good = [prose(rng, rng.randint(30, 90)) for _ in range(n)]
    spoil = [lambda t: t.replace(" ", " ### "), lambda t: (t[:12] + " ") * 30, lambda t: t.upper() + "!!"]
    poor = [spoil[k % 3](prose(rng, 40)) for k in range(n // 4)]
    return good + poor, np.r_[np.ones(len(good), bool), np.zeros(len(poor), bool)]


def test_weights_minimise_the_pairwise_loss():
    """No step along any axis or at random lowers the loss, computed pair by pair."""
    rng = random.Random(1)
    texts, good = corpus(rng, 40)
    x = features(texts)
    flip = np.arange(len(good)) % 9 == 0  # wrong labels, so that the classes overlap
    model = R.fit_ranking(x, good ^ flip, partners=2)
    z = ((R.descriptors(x) - model.mean) / model.scale).tolist()
    better, worse = R.preference_pairs(good ^ flip, 2)
    assert all((good ^ flip)[better]) and not any((good ^ flip)[worse]) and len(better) == 2 * len(good)

    def loss(w):
        total = 0.0
        for i, j in zip(better.tolist(), worse.tolist()):
            total += math.log1p(math.exp(-sum(c * (a - b) for c, a, b in zip(w, z[i], z[j]))))
        return total / len(better) + R.RIDGE * sum(c * c for c in w) / 2

    least = loss(model.weights)
    draw = np.random.default_rng(0)
    for k in range(len(model.weights)):
        for step in (-1e-3, 1e-3):
            moved = model.weights.copy()
            moved[k] += step
            assert loss(moved) >= least - 1e-9
    assert all(loss(model.weights + draw.normal(0, 0.01, len(model.weights))) >= least - 1e-9 for _ in range(20))


def test_cut_is_the_quantile_of_the_labels():
    rng = random.Random(2)
    texts, good = corpus(rng, 80)
    model = R.fit_ranking(features(texts), good)
    strength, score = model.strength(features(texts)), model.score(features(texts))
    assert ((score >= R.ACCEPT_FROM) == (strength >= model.cut)).all()
    assert abs((score >= R.ACCEPT_FROM).mean() - good.mean()) < 0.01
    assert ((score > 0) & (score < 1) | (score == 1)).all() and (np.diff(score[np.argsort(strength)]) >= 0).all()
    fresh, truth = corpus(random.Random(3), 200)
    assert ((model.score(features(fresh)) >= R.ACCEPT_FROM) == truth).mean() > 0.95


def test_awkward_tables(spark):
    docs = fx.documents(spark)
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (7, 0), (10, 1), (13, 1), (16, None), (None, 1), (19, 0), (22, 1), (25, 1), (28, 0), (31, 1), (34, 0)], "doc_id long, quality int")
    got = R.classify_quality(docs, labels)
    assert set(got.columns) == {*docs.columns, "held_out", "score", "predicted"}
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"]
    assert R.classify_quality(docs.limit(0), labels).count() == 0
    for none in (labels.limit(0), labels.where("quality = 1")):
        assert {(r["score"], r["predicted"]) for r in R.classify_quality(docs, none).collect()} == {(0.5, 1)}
    # labels of the held-out fold teach nothing
    held = labels.where(R.held_out())
    flipped = labels.where(~R.held_out()).unionAll(held.select("doc_id", (1 - F.col("quality")).alias("quality")))
    assert held.count() and sorted(r["score"] for r in R.classify_quality(docs, flipped).collect()) == sorted(r["score"] for r in rows)


def test_registered_query(spark):
    path = "/root/testdata/sf0.01"
    got = queries.QUERIES["op13_quality_classifier"](spark, path)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == spark.read.parquet(f"{path}/documents.parquet").count()
    truth = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "quality")
    judged = got.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count(F.lit(1))).first()
    assert judged[0] > 0.97 and judged[1] > 30
    assert len(FEATURES) == 13

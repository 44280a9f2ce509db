"""Keep or reject documents: base rules, then boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows with a histogram
learner that respects monotonic constraints, then flattened into NumPy node
arrays; a whole batch of documents walks all trees level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.text import chunks, flat_words, lean, mix, small_batches

SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS, MIN_ROWS, RIDGE = 60, 4, 0.2, 64, 10, 1.0
KEEP_FROM = 0.5
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: feature -> sign of its effect on quality: -1 can only lower it, +1 only raise it, 0 is free.
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "twin_share": -1,
    "upper_share": -1,
    "digit_share": -1,
    "bang_share": -1,
    "distinct_share": 0,
    "top_share": -1,
    "stop_share": 0,
    "mean_line": 0,
}


def _sums(mask: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Sum of a mask between neighbouring limits."""
    return np.diff(np.r_[0, np.cumsum(mask, dtype=np.int64)][limits])


def statistics(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """Base counts and features of every text, a run of texts at a time."""
    names = [*BASE, *FEATURES]
    out = {n: np.zeros(len(texts), np.int64 if n in BASE else np.float64) for n in names}
    for begin, held in chunks(texts):
        block = _chunk_statistics(held)
        for n in names:
            out[n][begin : begin + len(held)] = block[n]
    return out


def _chunk_statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    hashes, per_text, starts, ends, data = flat_words(texts, lower=False)
    edge = np.r_[0, np.cumsum(per_text)]
    lengths = np.array([len(t) for t in texts])
    limits = np.r_[0, np.cumsum(lengths + 1)]
    limits[-1] -= 1
    doc = np.repeat(np.arange(len(texts)), per_text)
    per_char = (data & 0xC0) != 0x80
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    inside = per_char & ~space[data]
    byte_sum = lambda mask: _sums(mask, limits)
    is_in = lambda chars: np.isin(data, np.frombuffer(chars, np.uint8))
    chars, letters_up, digits = byte_sum(inside), byte_sum((data >= 65) & (data <= 90)), byte_sum((data >= 48) & (data <= 57))
    symbols, bangs = byte_sum(is_in(SYMBOLS)), byte_sum(is_in(b"!?"))
    # Three-word windows that stand twice or more in one text, and the words they cover.
    covered = np.zeros(len(hashes), bool)
    if len(hashes) >= 3:
        window = mix(mix(hashes[:-2]) + hashes[1:-1])
        window = mix(window + hashes[2:]) ^ (doc[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        whole = doc[:-2] == doc[2:]
        at = np.flatnonzero(whole)
        _, which, count = np.unique(window[at], return_inverse=True, return_counts=True)
        twice = at[count[which] > 1]
        for j in range(3):
            covered[twice + j] = True
    # Word counts inside a text.
    own = mix(hashes) ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first, count = np.unique(own, return_index=True, return_counts=True)[1:]
    distinct, top = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    np.add.at(distinct, doc[first], 1)
    np.maximum.at(top, doc[first], count)
    twin = np.zeros(len(hashes), bool)
    twin[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    # Words that end a sentence.
    last = data[ends - 1] if len(ends) else data[:0]
    stops = np.isin(last, np.frombuffer(b".!?", np.uint8))
    word_sum = lambda mask: _sums(mask, edge)
    dup_lines, lines = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        held = [x for x in t.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        lines[i], dup_lines[i] = len(held), len(held) - len(set(held))
    repeat = word_sum(covered)
    words, some = per_text, np.maximum(per_text, 1)
    letters = np.maximum(chars, 1)
    return {
        "n_words": words,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat,
        "log_words": np.log1p(words),
        "mean_word": chars / some,
        "symbol_share": symbols / letters,
        "dup_line_share": dup_lines / np.maximum(lines, 1),
        "repeat_share": repeat / some,
        "twin_share": word_sum(twin) / some,
        "upper_share": letters_up / letters,
        "digit_share": digits / letters,
        "bang_share": bangs / letters,
        "distinct_share": distinct / some,
        "top_share": np.where(words >= 20, top / some, 0.0),
        "stop_share": word_sum(stops) / some,
        "mean_line": np.log1p(words / np.maximum(lines, 1)),
    }


@dataclass(frozen=True)
class Forest:
    """All trees in flat arrays, one row a tree; node i has children 2i+1 and 2i+2 and a leaf splits on +inf."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality of every row."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += value[node]
        return total


def fit_forest(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, min_rows: int = MIN_ROWS, ridge: float = RIDGE) -> Forest:
    """Logistic gradient boosting on binned features.

    A split on a feature with a sign is refused if its two values stand in the
    wrong order, and its middle bounds both sides from there down, so that the
    sum of all trees is monotone in that feature.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    bias = float(np.log(p / (1 - p)))
    margin, size = np.full(len(y), bias), 2 ** (depth + 1) - 1
    all_features, all_limits, all_values = [], [], []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-margin))
        g, h = y - chance, chance * (1 - chance)
        feature, limit, value = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size)
        low, high, node = np.full(size, -np.inf), np.full(size, np.inf), np.zeros(len(y), np.int64)
        for k in range(2**depth - 1):
            rows = np.flatnonzero(node == k)
            split = _best_split(codes[rows], g[rows], h[rows], signs, bins, min_rows, ridge, low[k], high[k]) if len(rows) >= 2 * min_rows else None
            left, right = 2 * k + 1, 2 * k + 2
            low[[left, right]], high[[left, right]] = low[k], high[k]
            if split is None:
                node[rows] = left
                continue
            j, cut, a, b = split
            feature[k], limit[k] = j, edges[j][cut]
            node[rows] = np.where(codes[rows, j] <= cut, left, right)
            if signs[j] > 0:
                high[left] = low[right] = (a + b) / 2
            elif signs[j] < 0:
                low[left] = high[right] = (a + b) / 2
        for k in range(2**depth - 1, size):
            rows = node == k
            if rows.any():
                value[k] = rate * np.clip(g[rows].sum() / (h[rows].sum() + ridge), low[k], high[k])
        margin += value[node]
        all_features.append(feature)
        all_limits.append(limit)
        all_values.append(value)
    return Forest(np.array(all_features), np.array(all_limits), np.array(all_values), bias, depth)


def _best_split(codes, g, h, signs, bins, min_rows, ridge, low, high):
    best, found = 1e-6, None
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for j in range(codes.shape[1]):
        gs, hs, ns = (np.cumsum(np.bincount(codes[:, j], w, bins + 1)) for w in (g, h, None))
        gl, hl, nl = gs[:-1], hs[:-1], ns[:-1]
        gr, hr, nr = gs[-1] - gl, hs[-1] - hl, ns[-1] - nl
        a, b = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
        gain = 2 * (gl * a + gr * b) - (hl + ridge) * a**2 - (hr + ridge) * b**2 - whole
        gain[(nl < min_rows) | (nr < min_rows) | (signs[j] * (b - a) < 0)] = -np.inf
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = gain[k], (j, k, a[k], b[k])
    return found


def feature_rows(counts: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([counts[f] for f in FEATURES], 1)


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of `docs` with its statistics as an array `features`."""
    small_batches(docs.sparkSession)
    docs = docs.drop("features")
    n = len(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField("features", T.ArrayType(T.DoubleType()))])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = feature_rows(statistics(batch.column(n).to_pylist()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, len(FEATURES), dtype=np.int32)), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], lists], names=schema.names)

    return docs.withColumn("_text", F.col(text_col).cast("binary")).mapInArrow(lean(compute), schema)


def fit_on_labels(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest | None:
    """A forest for labels.quality, from at most `sample_rows` labelled rows drawn by a hash of the id.

    None if there are no labels or only one kind of them.
    """
    some = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    fed = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most sample_rows pairs of numbers
    rows = with_features(fed).select("doc_id", "quality", "features").limit(sample_rows).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["features"]))
    y = np.array([float(r["quality"] > 0) for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    return fit_forest(np.array([r["features"] for r in rows]), y, np.array(list(FEATURES.values())))


def score_quality(docs: DataFrame, forest: Forest | None, keep_from: float = KEEP_FROM, text_col: str = "text") -> DataFrame:
    """Every row of `docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality_score, kept.

    base_failed: fewer than 50 words, or over half of them in three-word windows
    that stand twice or more in the text. kept: not base_failed and the trees
    give good quality a chance of at least `keep_from`; without a forest, all
    that pass the base. A null or empty text has no words and fails the base.
    Rows stand alone: repeated rows are handled alike. Added columns replace
    input columns of the same names.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*BASE, "base_failed", "quality_score", "kept")
    n = len(docs.columns)
    more = [*[(b, T.LongType()) for b in BASE], ("base_failed", T.BooleanType()), ("quality_score", T.DoubleType()), ("kept", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(name, kind) for name, kind in more]])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = statistics(batch.column(n).to_pylist())
            failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
            chance = 1 / (1 + np.exp(-forest.margin(feature_rows(counts)))) if forest is not None else np.ones(len(failed))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array(counts[b], pa.int64()) for b in BASE], pa.array(failed), pa.array(chance), pa.array(~failed & (chance >= keep_from))], names=schema.names)

    return docs.withColumn("_text", F.col(text_col).cast("binary")).mapInArrow(lean(judge), schema)

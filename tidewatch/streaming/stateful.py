"""Jobs that keep their own state for each series: online vectors, drift signals, alerts.

State is bounded by parameters, never by history: a ring of the newest rows of
the open segment, rings of the newest values and errors, and the instants that
the watermark has not passed yet. All three need the RocksDB state store, which
`keep_state` names in the session where nothing else is named.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewatch.functions.columns import bin_of, headroom, psi_term
from tidewatch.operators.cadence import SERIES
from tidewatch.operators.encode import category, vocabulary
from tidewatch.operators.features import ROLL_STATS, complete_features, feature_names
from tidewatch.operators.percentiles import exact_percentiles
from tidewatch.operators.transform import ewma_spans, label_regimes
from tidewatch.params import DEFAULTS, Params

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> SparkSession:
    """A session whose state store can hold several named states for each key."""
    if not spark.conf.get(PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)
    return spark


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts)).alias("_us")


def instant(us: str = "_us") -> Column:
    return F.timestamp_micros(F.col(us)).alias("ts")


# -- online vectors -----------------------------------------------------------


class RingVectors(StatefulProcessor):
    """Newest complete vector of a series, from a ring of its newest rows.

    State: the newest rows of the open segment, as many as the longest lag or the
    rolling window needs, and two exponential means with their weights. A row of
    a later segment starts anew. Rows at or before the newest one seen come too
    late for a running mean and are passed over.
    """

    def __init__(self, target: str, companions: Sequence[str], params: Params = DEFAULTS, ttl_ms: int | None = None):
        self.target, self.companions, self.ttl_ms = target, list(companions), ttl_ms
        self.lags, self.window, self.spans = list(params.lags), params.roll_window, ewma_spans(params)
        self.need = max(*params.lags, params.roll_window - 1, 1) + 1
        self.base = [*[f"{target}_lag_{k}" for k in params.lags], *[f"{target}_roll_{s}" for s in ROLL_STATS], *[f"{target}_{n}" for n in ("delta", "ewma_fast", "ewma_slow")]]
        self.schema = f"{SERIES} string, segment_id bigint, _us bigint, " + ", ".join(f"{c} double" for c in [target, *self.base, *self.companions])

    def init(self, handle) -> None:
        self.ring = handle.getListState("ring", "x double", self.ttl_ms)
        self.means = handle.getValueState("means", "segment bigint, newest bigint, fast double, fast_weight double, slow double, slow_weight double", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.means.get() if self.means.exists() else None
        segment, newest, means = (held[0], held[1], [(held[2], held[3]), (held[4], held[5])]) if held else (None, None, [(None, 1.0)] * 2)
        ring = [r[0] for r in self.ring.get()] if held else []
        # what the newest complete row needs: its ring and its means, remembered as the rows pass
        found, moved = None, False
        for r in sorted((r for r in rows if r["_us"] is not None), key=lambda r: r["_us"]):
            if newest is not None and r["_us"] <= newest:
                continue
            if r["segment_id"] != segment:
                segment, ring, means = r["segment_id"], [], [(None, 1.0)] * 2
            newest, x, moved = r["_us"], r[self.target], True
            means = [self._mixed(*m, x, span) for m, span in zip(means, self.spans)]
            ring = [*ring, x][-self.need :]
            if self._complete(ring) and all(r[c] is not None for c in self.companions):
                found = (r, list(ring), list(means))
        if moved:
            self.ring.put([(x,) for x in ring])
            self.means.update((segment, newest, *means[0], *means[1]))
        if found:
            yield self._row(key[0], *found)

    @staticmethod
    def _mixed(mean, weight, x, span):
        """One step of the exponential mean; a null keeps it but ages its weight."""
        a = 2.0 / (span + 1)
        if mean is None:
            return x, 1.0
        aged = weight * (1.0 - a)
        return (mean, aged) if x is None else ((aged * mean + a * x) / (aged + a), 1.0)

    def _complete(self, ring) -> bool:
        wanted = {*self.lags, 0, 1}
        return len(ring) > max(wanted) and all(ring[-1 - k] is not None for k in wanted) and sum(x is not None for x in ring[-self.window :]) >= 2

    def _row(self, series, r, ring, means) -> Row:
        recent = [x for x in ring[-self.window :] if x is not None]
        mean = sum(recent) / len(recent)
        deviation = math.sqrt(sum((x - mean) ** 2 for x in recent) / (len(recent) - 1))
        values = [series, r["segment_id"], r["_us"], r[self.target], *[ring[-1 - k] for k in self.lags], mean, deviation, max(recent), min(recent), ring[-1] - ring[-2], means[0][0], means[1][0]]
        return Row(SERIES, "segment_id", "_us", self.target, *self.base, *self.companions)(*values, *[r[c] for c in self.companions])

    def close(self) -> None:
        pass


def online_vector_stream(clean: DataFrame, target: str, params: Params = DEFAULTS, ttl: int | None = None) -> DataFrame:
    """(series, segment, ts, features): the newest complete vector of every series that a batch brought rows of.

    `clean` holds clean rows as they become final, in any order inside a batch.
    No history is read again. With `ttl` (seconds) a series that stays silent
    that long is forgotten. Output mode is update.
    """
    keep_state(clean.sparkSession)
    companions = [t for t in params.forecast_targets if t != target and t in clean.columns] if params.use_interactions else []
    fed = clean.select(SERIES, F.col("segment_id").cast("bigint").alias("segment_id"), micros(), F.col(target).cast("double").alias(target), *[F.col(c).cast("double").alias(c) for c in companions])
    processor = RingVectors(target, companions, params, ttl * 1000 if ttl else None)
    out = fed.groupBy(SERIES).transformWithState(processor, processor.schema, "update", "ProcessingTime" if ttl else "None").withColumn("ts", instant()).drop("_us")
    if target in params.quality_targets:
        out = out.withColumn(f"{target}_headroom", headroom(target))
    names = feature_names(target, [target, *companions], params)
    return complete_features(out, target, params, [target, *companions]).select(SERIES, "segment_id", "ts", *names)


# -- drift --------------------------------------------------------------------


class RecentSignals(StatefulProcessor):
    """The newest values, labels and errors of a series, `size` of each, whatever order they arrive in."""

    KINDS = ("value", "label", "error")

    def __init__(self, size: int, words: Sequence[str]):
        self.size, self.words = size, list(words)

    def init(self, handle) -> None:
        self.rings = handle.getValueState("rings", "revision bigint, " + ", ".join(f"{k}_at array<bigint>, {k} array<{'string' if k == 'label' else 'double'}>" for k in self.KINDS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.rings.get() if self.rings.exists() else None
        revision = held[0] + 1 if held else 1
        rings = {k: list(zip(held[2 * i + 1], held[2 * i + 2])) if held else [] for i, k in enumerate(self.KINDS)}
        for r in rows:
            for k in self.KINDS:
                if r[k] is not None:
                    rings[k].append((r["_us"], r[k]))
        for k in self.KINDS:
            rings[k] = heapq.nlargest(self.size, rings[k], key=lambda x: x[0])
        flat = [column for k in self.KINDS for column in ([x[0] for x in rings[k]], [x[1] for x in rings[k]])]
        self.rings.update((revision, *flat))
        errors = [x[1] for x in rings["error"]]
        counts = [sum(x[1] == w for x in rings["label"]) for w in self.words]
        newest = max(x[0] for ring in rings.values() for x in ring) if any(rings.values()) else None
        yield Row(SERIES, "revision", "_us", "window_mae", "n_scored", "values", "regimes")(key[0], revision, newest, sum(errors) / len(errors) if errors else None, len(errors), [x[1] for x in rings["value"]], counts)

    def close(self) -> None:
        pass


def newest_of_each(batches: Iterator[pa.RecordBatch], size: int, kinds: Sequence[str] = RecentSignals.KINDS) -> Iterator[pa.RecordBatch]:
    """Of one task's rows those that can enter a ring: the newest `size` of each series and kind, of equal instants the first.

    A series without values keeps its first row, so that it is heard of.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        newest = np.argsort(-rows.column("_us").fill_null(-(2**62)).to_numpy(), kind="stable")
        series = pd.Series(rows.column(SERIES).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False))
        kept = set(series.drop_duplicates().index)
        valued = np.zeros(len(series), bool)
        for k in kinds:
            known = rows.column(k).is_valid().to_numpy()
            valued |= known
            mine = newest[known[newest]]
            kept.update(mine[(series.iloc[mine].groupby(series.iloc[mine]).cumcount() < size).to_numpy()].tolist())
        heard = set(series[valued])
        chosen = [i for i in sorted(kept) if valued[i] or series[i] not in heard]
        held = rows.take(pa.array(chosen, pa.int64()))
    if held is not None:
        yield from held.to_batches()


def drift_profile(reference: DataFrame, value: str, params: Params = DEFAULTS) -> DataFrame:
    """What recent rows are compared with, per series: cut points and rows of each bin of `value`, rows of each regime. Kept beside a model."""
    rows = reference.where(F.col(value).isNotNull() & ~F.isnan(value))
    deciles = exact_percentiles(rows, [SERIES], value, [i / params.psi_bins for i in range(1, params.psi_bins)])
    edges = deciles.select(SERIES, F.array_distinct(F.array(*[c for c in deciles.columns if c != SERIES])).alias("edges"))
    bins = rows.join(edges, SERIES).groupBy(SERIES, bin_of(value, F.col("edges")).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    filled = F.map_from_entries(F.collect_list(F.struct("_bin", "_n")))
    counts = bins.groupBy(SERIES).agg(filled.alias("_bins"))
    words = vocabulary("regime", params)
    labelled = label_regimes(reference, value, params)
    word = category(labelled, "regime", params)
    regimes = labelled.groupBy(SERIES).agg(F.array(*[F.count_if(word == w) for w in words]).alias("regime_rows"))
    by_bin = F.transform(F.sequence(F.lit(0), F.size("edges")), lambda i: F.coalesce(F.try_element_at("_bins", i), F.lit(0).cast("long")))
    return regimes.join(edges.join(counts, SERIES), SERIES, "left").select(SERIES, "edges", by_bin.alias("bin_rows"), "regime_rows")


def psi_of_counts(reference: Column, current: Column, params: Params = DEFAULTS) -> Column:
    """Stability index between two arrays of counts of the same bins."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("double"), lambda s, x: s + x)
    share = lambda x, a: x / F.nullif(total(a), F.lit(0.0))
    terms = F.zip_with(reference, current, lambda r, c: psi_term(share(r, reference), share(c, current), params.psi_floor))
    return F.round(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), 4)


def drift_signal_stream(samples: DataFrame, scored: DataFrame, profile: DataFrame, value: str, params: Params = DEFAULTS) -> DataFrame:
    """Signals for `decide` of every series a batch brought rows of: window_mae, n_scored, feature_psi, regime_psi, reference_mae.

    `samples` has ts and `value`, `scored` predicted_for_ts and abs_error (it may
    come from `score_stream`, so that two stateful steps follow one another),
    `profile` one row for each series with `drift_profile`'s columns and
    reference_mae. The newest `drift_window` values, labels and errors are
    compared with it; fewer values than bins on either side give no index. A
    series' newest signals are those of its highest revision.
    """
    keep_state(samples.sparkSession)
    words = vocabulary("regime", params)
    none = F.lit(None)
    labelled = label_regimes(samples, value, params)
    known = F.when(~F.isnan(value), F.col(value))
    rows = labelled.select(SERIES, micros(), known.cast("double").alias("value"), category(labelled, "regime", params).alias("label"), none.cast("double").alias("error"))
    errors = scored.where(F.col("abs_error").isNotNull()).select(SERIES, micros("predicted_for_ts"), none.cast("double").alias("value"), none.cast("string").alias("label"), F.col("abs_error").cast("double").alias("error"))
    schema = f"{SERIES} string, revision bigint, _us bigint, window_mae double, n_scored bigint, values array<double>, regimes array<bigint>"
    both, size = rows.unionByName(errors), params.drift_window
    # a row that is not among the newest of its own task cannot be among the newest of the batch
    both = both.mapInArrow(lambda batches: newest_of_each(batches, size), both.schema)
    recent = both.groupBy(SERIES).transformWithState(RecentSignals(params.drift_window, words), schema, "append", "None")
    joined = recent.join(profile, SERIES, "left")
    spots = F.transform("values", lambda v: F.size(F.filter("edges", lambda e: v >= e)))
    bins = F.transform(F.sequence(F.lit(0), F.size("edges")), lambda i: F.size(F.filter(spots, lambda s: s == i)).cast("long"))
    rows_in = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    enough = (F.size("values") >= params.psi_bins) & (rows_in(F.col("bin_rows")) >= params.psi_bins)
    return joined.select(
        SERIES,
        "revision",
        instant(),
        "reference_mae",
        F.round("window_mae", 4).alias("window_mae"),
        "n_scored",
        F.when(enough, psi_of_counts(F.col("bin_rows"), bins, params)).alias("feature_psi"),
        F.when((rows_in(F.col("regime_rows")) > 0) & (rows_in(F.col("regimes")) > 0), psi_of_counts(F.col("regime_rows"), F.col("regimes"), params)).alias("regime_psi"),
    )


# -- alerts -------------------------------------------------------------------


#: Instants of one entry of the state, and consumers that a task reduces together.
CHUNK = 1_000
TOGETHER = 200_000


def heaviest(consumers, top: int) -> list:
    """The `top` of (rss_mb, pid, name), by weight, unknown weights last, ties by pid."""
    return heapq.nsmallest(top, consumers, key=lambda h: (-(h[0] if h[0] is not None else -math.inf), h[1]))


def above(batches: Iterator[pa.RecordBatch], column: str, threshold: float) -> Iterator[pa.RecordBatch]:
    """Samples above the threshold, and a task's newest one whatever it is: the watermark must see how far the samples have come."""
    newest = None
    for batch in batches:
        if batch.num_rows:
            at = batch.column("_us").to_numpy()
            k = int(at.argmax())
            if newest is None or at[k] > newest.column("_us")[0].as_py():
                newest = batch.slice(k, 1)
            yield batch.filter(pc.fill_null(pc.greater(batch.column(column), threshold), False))
    if newest is not None:
        yield newest


def packed(batches: Iterator[pa.RecordBatch], top: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each series and instant among some rows of a task: its heaviest consumers as JSON. Others cannot be among the heaviest of all."""

    def reduced(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        at, series = rows.column("_us").to_numpy(), rows.column(SERIES).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        rss = rows.column("rss_mb")
        weight = np.where(rss.is_valid().to_numpy(), rss.fill_null(0.0).to_numpy(), -np.inf)
        order = np.lexsort((rows.column("pid").to_numpy(), -weight, at, series))
        new = np.ones(order.size, bool)
        new[1:] = (at[order[1:]] != at[order[:-1]]) | (series[order[1:]] != series[order[:-1]])
        starts = np.flatnonzero(new)
        place = np.arange(order.size) - np.repeat(starts, np.diff([*starts, order.size]))
        kept = rows.take(pa.array(order[place < top]))
        entries = list(zip(kept.column("rss_mb").to_pylist(), kept.column("pid").to_pylist(), kept.column("name").to_pylist()))
        ends = [*np.flatnonzero(new[place < top]).tolist(), len(entries)]
        texts = [json.dumps(entries[a:b]) for a, b in zip(ends, ends[1:])]
        firsts = rows.select([SERIES, "ts", "_us"]).take(pa.array(order[starts]))
        return firsts.append_column("held", pa.array(texts, pa.string())).cast(schema).to_batches()

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held, size = [*held, batch], size + batch.num_rows
        if size >= TOGETHER:
            yield from reduced(held)
            held, size = [], 0
    if held:
        yield from reduced(held)


class Alerts(StatefulProcessor):
    """At most one alert per cooldown, in the order of event time, with the heaviest consumers of its instant.

    State: the instant of the last alert, dropped by a timer when its cooldown is
    over, and the instants the watermark has not passed, each with its first
    sample above the threshold and its heaviest consumers as they came from their
    tasks, `CHUNK` instants in one entry of JSON. A timer at the earliest of them
    decides all that the watermark has passed, so late rows inside the watermark
    count and arrival order does not.
    """

    def __init__(self, threshold: float, wait_us: int, top: int):
        self.threshold, self.wait_us, self.top = threshold, wait_us, top

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint")
        self.open = handle.getListState("open", "instants string")

    def _waiting(self) -> dict:
        return {o[0]: o[1:] for chunk in self.open.get() for o in json.loads(chunk[0])} if self.open.exists() else {}

    def _keep(self, waiting: dict) -> None:
        rows = [(at, *w) for at, w in waiting.items()]
        self.open.put([(json.dumps(rows[k : k + CHUNK]),) for k in range(0, len(rows), CHUNK)])

    def _listed(self, held: list) -> list:
        return heaviest([h for text in held for h in json.loads(text)], self.top)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        waiting = self._waiting()
        before = min(waiting, default=None)
        for r in rows:
            tie, observed, held = waiting.get(r["_us"], (None, None, []))
            high = r["observed"] is not None and r["observed"] > self.threshold
            if high and (tie is None or r["id"] < tie):
                tie, observed = r["id"], r["observed"]
            if r["held"] is not None:
                held = [*held, r["held"]]
                if len(held) > self.top:
                    held = [json.dumps(self._listed(held))]
            if high or r["held"] is not None:
                waiting[r["_us"]] = (tie, observed, held)
        if waiting:
            self._keep(waiting)
            first = min(waiting)
            if before is None or first < before:
                self.handle.registerTimer(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = self._waiting()
        last = self.last.get()[0] if self.last.exists() else None
        began = last
        for at in sorted(at for at, w in waiting.items() if at < passed and w[1] is not None):
            if last is None or at - last >= self.wait_us:
                last = at
                _, observed, held = waiting[at]
                listed = [{"pid": h[1], "name": h[2], "rss_mb": h[0]} for h in self._listed(held)]
                yield Row(SERIES, "_us", "observed", "threshold", "process_payload")(key[0], at, observed, self.threshold, json.dumps(listed, separators=(",", ":")))
        later = {at: w for at, w in waiting.items() if at >= passed}
        if later:
            self._keep(later)
            self.handle.registerTimer(min(later) // 1000 + 1)
        elif waiting:
            self.open.clear()
        if last is not None and last + self.wait_us <= passed:
            self.last.clear()
        elif last is not None:
            if last != began:
                self.last.update((last,))
            self.handle.registerTimer((last + self.wait_us) // 1000 + 1)

    def close(self) -> None:
        pass


def alert_stream(samples: DataFrame, column: str = "mem_percent", params: Params = DEFAULTS, consumers: DataFrame | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Samples above the threshold, at most one per series and cooldown, each with the heaviest consumers at its instant as JSON.

    `samples` may be the online vectors with their lag 0 as `column`; of several
    above it at one instant the one with the least id counts. `consumers` has
    series, ts, pid, name and rss_mb; each task hands on only the heaviest of an
    instant, and samples only if they can alert. An alert leaves when the
    watermark has passed it.
    """
    keep_state(samples.sparkSession)
    threshold, top = float(params.capacity_alert), params.alert_top_n
    tie = F.col("id").cast("bigint") if "id" in samples.columns else F.lit(0).cast("bigint")
    seen = samples.where(F.col("ts").isNotNull()).select(SERIES, "ts", micros(), tie.alias("id"), F.col(column).cast("double").alias("observed"))
    seen = seen.mapInArrow(lambda batches: above(batches, "observed", threshold), seen.schema).withWatermark("ts", lateness)
    rows = seen.select(SERIES, "ts", "_us", "id", "observed", F.lit(None).cast("string").alias("held"))
    if consumers is not None:
        loads = consumers.where(F.col("ts").isNotNull() & F.col("pid").isNotNull())
        loads = loads.select(SERIES, "ts", micros(), F.col("pid").cast("bigint").alias("pid"), F.col("name").cast("string").alias("name"), F.col("rss_mb").cast("double").alias("rss_mb"))
        kind = f"{SERIES} string, ts timestamp, _us bigint, held string"
        arrow = pa.schema([(SERIES, pa.string()), ("ts", pa.timestamp("us", "UTC")), ("_us", pa.int64()), ("held", pa.string())])
        loads = loads.mapInArrow(lambda batches: packed(batches, top, arrow), kind).withWatermark("ts", lateness)
        rows = rows.unionByName(loads.select(SERIES, "ts", "_us", F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("double").alias("observed"), "held"))
    schema = f"{SERIES} string, _us bigint, observed double, threshold double, process_payload string"
    processor = Alerts(threshold, params.alert_cooldown * 1_000_000, top)
    out = rows.groupBy(SERIES).transformWithState(processor, schema, "append", "EventTime")
    return out.select(SERIES, instant(), "observed", "threshold", "process_payload")

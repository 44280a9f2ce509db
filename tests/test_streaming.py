"""Streams fed from files must end where the batch operators end."""

import datetime
import heapq
import json
import random

import duckdb
import pyarrow as pa
import pytest
from conftest import TINY, same
from pyspark.sql import functions as F

from tidewatch.operators import drift as D
from tidewatch.operators import features as X
from tidewatch.operators import serving as P
from tidewatch.operators import transform as T
from tidewatch.operators.ordering import Layout, cut_lineage, newest
from tidewatch.params import DEFAULTS
from tidewatch.plans import views as V
from tidewatch.plans.catalog import ORACLES, QUERIES
from tidewatch.plans.streams import land
from tidewatch.streaming import jobs as S
from tidewatch.streaming import stateful as Q

CLOSER = "2025-01-01"


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Samples in three files in time order, then one far later row per series that closes all windows."""
    root = tmp_path_factory.mktemp("landed")
    raw = cut_lineage(V.metrics(spark, TINY))
    parts = [raw.where("ts < '2024-01-10'"), raw.where("ts >= '2024-01-10' AND ts < '2024-01-20'"), raw.where("ts >= '2024-01-20'")]
    closer = raw.groupBy("series_key").agg(F.max("id").alias("id")).select("series_key", "id", F.lit(CLOSER).cast("timestamp").alias("ts"), *[F.lit(0.0).alias(m) for m in V.MEASURES])
    for part in [*parts, closer]:
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    return raw, f"{root}/in", root


def stream(spark, path):
    return S.read_samples(spark, path, files_per_trigger=1)


def test_rollup(spark, landed, tmp_path):
    raw, path, _ = landed
    S.start(S.rollup_stream(stream(spark, path), "6 hours", ["cpu_percent"], "20 days"), f"{tmp_path}/c", path=f"{tmp_path}/o").awaitTermination()
    same(spark.read.parquet(f"{tmp_path}/o").where(F.col("ts") < CLOSER), T.rollup(raw, "6 hours", ["cpu_percent"], layout=Layout()))


def test_sessions(spark, landed, tmp_path):
    raw, path, _ = landed
    S.start(S.gap_sessions(stream(spark, path), "3 hours", "20 days"), f"{tmp_path}/c", path=f"{tmp_path}/o").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/o").where(F.col("start") < CLOSER)
    same(got, S.gap_sessions(raw, "3 hours"))


def test_mirror_is_idempotent(spark, landed, tmp_path):
    raw, path, _ = landed
    sink = S.mirror_sink(f"{tmp_path}/m")

    def twice(batch, batch_id):
        sink(batch, batch_id)
        sink(batch, batch_id)

    S.start(stream(spark, path), f"{tmp_path}/c", sink=twice).awaitTermination()
    same(spark.read.parquet(f"{tmp_path}/m").drop("batch_id").where(F.col("ts") < CLOSER), raw)
    S.rebuild_mirror(raw.where("cpu_percent < 50"), f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").count() == raw.where("cpu_percent < 50").count()


def test_alerts(spark, landed, tmp_path):
    raw, path, _ = landed
    params = DEFAULTS.with_(alert_cooldown=7200)
    S.start(Q.alert_stream(stream(spark, path), "mem_percent", params), f"{tmp_path}/c", path=f"{tmp_path}/o").awaitTermination()
    high = raw.where("mem_percent > 80").select("series_key", "id", "ts")
    want = D.cooldown(high, ["series_key"], "ts", "id", 7200, Layout()).where("accepted")
    same(spark.read.parquet(f"{tmp_path}/o").select("series_key", "ts"), want.select("series_key", "ts"))


def test_alerts_do_not_depend_on_arrival(spark, tmp_path):
    """Samples and consumers of one instant arrive apart and out of order; the payload has the heaviest three, ties by pid."""
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    samples = [("a", 1, at(0), 90.0), ("a", 3, at(50), 95.0), ("a", 2, at(50), 50.0), ("a", 4, at(30), 99.0), ("a", 5, at(100), 85.0), ("b", 6, at(10), None), ("b", 7, at(99), 81.0), ("a", 8, at(100_000), 0.0)]
    consumers = [("a", at(0), p, f"n{p}", r) for p, r in ((1, 5.0), (2, 9.0), (3, 9.0), (4, None), (5, 7.0))] + [("a", at(100), 1, None, 1.0), ("b", at(10), 1, "x", 1.0), ("a", at(100_000), 1, "x", 1.0)]
    left = "series_key string, id long, ts timestamp, mem_percent double"
    right = "series_key string, ts timestamp, pid long, name string, rss_mb double"
    for rows, schema, name in ((samples, left, "s"), (consumers, right, "c")):
        for part in (rows[4:7] + rows[:1], rows[1:4], rows[7:]):
            if part:
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    params = DEFAULTS.with_(alert_cooldown=60, alert_top_n=3)
    got = S.start(Q.alert_stream(S.read_samples(spark, f"{tmp_path}/s", left, 1), "mem_percent", params, S.read_samples(spark, f"{tmp_path}/c", right, 1), "1 hour"), f"{tmp_path}/p", path=f"{tmp_path}/o")
    got.awaitTermination()
    fired = {(r["series_key"], r["ts"]): json.loads(r["process_payload"]) for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    assert set(fired) == {("a", at(0)), ("a", at(100)), ("b", at(99))}
    assert [(c["pid"], c["rss_mb"]) for c in fired["a", at(0)]] == [(2, 9.0), (3, 9.0), (5, 7.0)]
    assert fired["a", at(100)] == [{"pid": 1, "name": None, "rss_mb": 1.0}] and fired["b", at(99)] == []


def test_online_vectors_after_every_batch(spark, tmp_path):
    """After each batch the newest vectors are those the batch form finds in all rows so far; nulls and new segments included."""
    rows, rng = [], random.Random(4)
    for key, cuts in (("a", (40, 75)), ("b", (25,)), ("c", (5, 10, 60))):
        for k in range(90):
            segment = sum(k >= c for c in cuts)
            rows.append((key, segment, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=3 * k + 1000 * segment), rng.uniform(0, 100), None if rng.random() < 0.1 else 50.0, rng.uniform(0, 9)))
    schema = "series_key string, segment_id long, ts timestamp, cpu_percent double, mem_percent double, disk_read_mb_s double"
    done = spark.createDataFrame(rows, schema)
    spans = [(0, 30), (30, 31), (31, 70), (70, 90)]
    parts = [spark.createDataFrame([r for i, r in enumerate(rows) if a <= i % 90 < b], schema) for a, b in spans]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    names, checked = X.feature_names("cpu_percent", done.columns), []

    def check(batch, batch_id):
        batch.write.mode("append").parquet(f"{tmp_path}/v")
        so_far = spark.createDataFrame([r for i, r in enumerate(rows) if i % 90 < spans[batch_id][1]], schema)
        want = X.serving_rows(X.feature_frame(so_far, "cpu_percent", Layout()), names).select("series_key", "segment_id", "ts", *names)
        same(newest(batch.sparkSession.read.parquet(f"{tmp_path}/v"), ["series_key"], [F.desc("ts")]), want)
        checked.append(want.count())

    S.start(Q.online_vector_stream(S.read_samples(spark, f"{tmp_path}/in", schema, 1), "cpu_percent"), f"{tmp_path}/p", sink=check, mode="update").awaitTermination()
    assert len(checked) == 4 and checked[-1] == 3


def test_scoring(spark, landed, tmp_path):
    raw, path, _ = landed
    predictions = stream(spark, path).select("series_key", "id", F.col("ts").alias("predicted_for_ts"), (F.col("cpu_percent") * 0.9).alias("predicted"))
    actuals = stream(spark, path).where("cpu_percent < 50").select("series_key", "ts", F.col("cpu_percent").alias("actual"))
    S.start(S.score_stream(predictions, actuals, "20 days"), f"{tmp_path}/c", path=f"{tmp_path}/o").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/o").where(F.col("predicted_for_ts") < CLOSER)
    batch = P.score(
        raw.select("series_key", "id", F.col("ts").alias("predicted_for_ts"), (F.col("cpu_percent") * 0.9).alias("predicted")),
        raw.where("cpu_percent < 50").select("series_key", "ts", F.col("cpu_percent").alias("actual")), ["series_key"],
    )
    same(got.where("actual IS NOT NULL"), batch.where("actual IS NOT NULL"))


def test_a_second_the_watermark_stands_in_is_scored(spark, tmp_path):
    """Predictions of such a second used to be dropped before its samples were reduced. Of two samples of one instant the lower id counts, however they lie in the file."""
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    seen = [[("a", 3, at(58.2), 30.0), ("a", 2, at(58.2), 20.0), ("a", 9, at(658.5), 1.0)], [("a", 10, at(700), 5.0)], [("a", 11, at(90_000), 0.0)]]
    for part in seen:
        spark.createDataFrame(part, "series_key string, id long, ts timestamp, actual double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/s")
        spark.createDataFrame([(k, t, 25.0) for k, _, t, _ in part], "series_key string, predicted_for_ts timestamp, predicted double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/p")
    actuals = S.read_samples(spark, f"{tmp_path}/s", "series_key string, id long, ts timestamp, actual double", 1)
    predictions = S.read_samples(spark, f"{tmp_path}/p", "series_key string, predicted_for_ts timestamp, predicted double", 1)
    S.start(S.score_stream(predictions, actuals), f"{tmp_path}/c", path=f"{tmp_path}/o").awaitTermination()
    got = sorted((r["predicted_for_ts"], r["actual"]) for r in spark.read.parquet(f"{tmp_path}/o").where("actual IS NOT NULL").collect())
    assert got[:4] == [(at(58.2), 20.0), (at(58.2), 20.0), (at(658.5), 1.0), (at(700), 5.0)]


@pytest.mark.parametrize("turned", [False, True])
def test_equal_instants_predict_in_order_of_arrival(spark, turned):
    """Plain and cut, whatever order the rows lie in; three samples of one instant reach over a block's end."""
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("a", k, at((0, 1, 2, 2, 2, 3)[k]), float(k)) for k in range(6)]
    raw = spark.createDataFrame(rows[::-1] if turned else rows, "series_key string, id long, ts timestamp, x double").coalesce(1).withColumn("segment_id", F.lit(0))
    cut = Layout((at(1.5).replace(tzinfo=datetime.timezone.utc).timestamp() * 1e6,), 3)
    for layout in (Layout(), cut):
        got = P.backfill_baseline(raw, "x", layout)
        assert sorted((r["predicted_for_ts"], r["predicted"]) for r in got.collect()) == [(r[2], r[3] - 1) for r in rows[1:]]
    score = P.score(got, raw.select("series_key", "id", "ts", F.col("x").alias("actual")), ["series_key"]).where(F.col("predicted_for_ts") == at(2))
    assert {r["actual"] for r in score.collect()} == {2.0}


def test_cycle(spark, landed, tmp_path):
    raw, path, _ = landed
    S.start(S.read_samples(spark, path, files_per_trigger=2), f"{tmp_path}/c", sink=S.cycle_sink(str(tmp_path))).awaitTermination()
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}")
    assert read("raw").count() == raw.count() + 5
    assert read("clean").where("batch_id = 0").count() > 0
    assert read("recommendations").groupBy("batch_id").count().count() == 2
    assert read("predictions").where("batch_id = 1").count() == 5


@pytest.mark.parametrize("name", ["stream_sessions", "stream_scored"])
def test_landed_rows_are_never_late(spark, name):
    """Every series in a file of its own: a span of five files used to reach over triggers, and its last ones came after the watermark."""
    wanted = {"spark.sql.shuffle.partitions": "11", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        got = QUERIES[name](spark, TINY)
        con = duckdb.connect()
        con.sql(f"CREATE VIEW events AS SELECT * FROM '{TINY}/events.parquet'")
        want = con.sql(ORACLES[name])
        place = [want.columns.index(c) for c in got.columns]
        rows = sorted((tuple(r) for r in got.collect()), key=str)
        assert rows == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=str)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_spans_land_whole(spark):
    """Each job writes as many files as a trigger takes, spans follow each other, and equal instants share one."""
    rows = [(f"s{k % 5}", datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=k // 7), float(k)) for k in range(700)] + [("s0", None, 1.0)]
    path = land(spark.createDataFrame(rows, "series_key string, ts timestamp, x double"), files=3)
    stored = spark.read.parquet(path).where(F.col("series_key") != "~").withColumn("f", F.input_file_name())
    spans = sorted(stored.groupBy("_span").agg(F.countDistinct("f").alias("files"), F.min("ts"), F.max("ts"), F.count("*")).collect())
    assert [s[0] for s in spans] == list(range(12)) and {s[1] for s in spans} == {1} and sum(s[4] for s in spans) == 700
    assert all(a[3] < b[2] for a, b in zip(spans, spans[1:]))


def test_only_rows_that_can_enter_a_ring_reach_the_state():
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None]), draw.randrange(40), draw.choice([None, draw.random()]), draw.choice([None, "x"]), draw.choice([None, 1.5])) for _ in range(2000)]
    rows += [("silent", 5, None, None, None)] * 3
    schema = pa.schema([("series_key", pa.string()), ("_us", pa.int64()), ("value", pa.float64()), ("label", pa.string()), ("error", pa.float64())])
    cut = [rows[i : i + 256] for i in range(0, len(rows), 256)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema) for part in cut]
    kept = [tuple(r.values()) for b in Q.newest_of_each(iter(batches), 7) for r in b.to_pylist()]
    assert len(kept) <= 3 * 3 * 7 + 1 and {r[0] for r in kept} == {r[0] for r in rows}
    for series in ("a", "b", None, "silent"):
        for k in (2, 3, 4):
            ring = lambda some: heapq.nlargest(7, [(r[1], r[k]) for r in some if r[0] == series and r[k] is not None], key=lambda x: x[0])
            assert ring(kept) == ring(rows)


def test_a_task_hands_on_only_what_can_alert():
    """Samples above the threshold and the newest; of the consumers of an instant the heaviest, in one row."""
    draw = random.Random(5)
    clock = pa.timestamp("us", "UTC")
    cut = lambda rows, schema: [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 256]), schema.types)], schema=schema) for i in range(0, len(rows), 256)]
    samples = [("a", t, t, k, draw.choice([None, 10.0, 80.0, 95.0])) for k, t in enumerate(draw.sample(range(5_000), 1_000))]
    schema = pa.schema([("series_key", pa.string()), ("ts", clock), ("_us", pa.int64()), ("id", pa.int64()), ("observed", pa.float64())])
    ids = [i for b in Q.above(iter(cut(samples, schema)), "observed", 80.0) for i in b.column("id").to_pylist()]
    newest = max(samples, key=lambda r: r[2])
    assert sorted(set(ids)) == sorted({r[3] for r in samples if (r[4] or 0) > 80} | {newest[3]}) and len(ids) < 400
    rows = [(draw.choice(["a", "b", None]), t, t, draw.randrange(60), draw.choice([None, "x"]), draw.choice([None, 1.0, 2.0, draw.random()])) for t in (draw.randrange(40) for _ in range(3_000))]
    schema = pa.schema([("series_key", pa.string()), ("ts", clock), ("_us", pa.int64()), ("pid", pa.int64()), ("name", pa.string()), ("rss_mb", pa.float64())])
    out = pa.schema([*list(schema)[:3], ("held", pa.string())])
    got = [r for b in Q.packed(iter(cut(rows, schema)), 5, out) for r in b.to_pylist()]
    assert len(got) == len({(r["series_key"], r["_us"]) for r in got}) == len({(r[0], r[2]) for r in rows})
    for r in got:
        every = [(x[5], x[3], x[4]) for x in rows if (x[0], x[2]) == (r["series_key"], r["_us"])]
        assert [h[:2] for h in json.loads(r["held"])] == [list(h[:2]) for h in Q.heaviest(every, 5)]


def test_the_first_sample_above_the_threshold_alerts(spark, tmp_path):
    """Of two samples of one instant the lower id is below the threshold: it used to hide the other, which the batch form and the SQL file."""
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("a", 1, at(0), 50.0), ("a", 2, at(0), 90.0), ("a", 3, at(0), 95.0), ("a", 4, at(100_000), 0.0)]
    spark.createDataFrame(rows, "series_key string, id long, ts timestamp, mem_percent double").coalesce(1).write.parquet(f"{tmp_path}/s")
    samples = S.read_samples(spark, f"{tmp_path}/s", "series_key string, id long, ts timestamp, mem_percent double", 1)
    S.start(Q.alert_stream(samples), f"{tmp_path}/c", path=f"{tmp_path}/o").awaitTermination()
    assert [(r["ts"], r["observed"]) for r in spark.read.parquet(f"{tmp_path}/o").collect()] == [(at(0), 90.0)]

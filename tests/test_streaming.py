"""Streams over several files give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from timeloom.operators import events as ev
from timeloom.operators import signal
from timeloom.sources.views import view
from timeloom.streaming import metrics


def replay(df, parts, order, tmp_path, query, mode="append"):
    """Write ``df`` as one file for each part, in order, and run ``query`` over the stream of them."""
    spark, path = df.sparkSession, str(tmp_path / "in")
    spark.sql("DROP VIEW IF EXISTS got")
    rows = df.withColumn("_p", F.expr(f"ntile({parts}) OVER (ORDER BY {order})")).cache()
    for p in range(1, parts + 1):
        rows.filter(F.col("_p") == p).drop("_p").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    run = query(stream).writeStream.outputMode(mode).format("memory").queryName("got").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    run.awaitTermination(240)
    return spark.sql("SELECT * FROM got")


@pytest.mark.parametrize("parts", [1, 4])
def test_quiet_regions_equal_batch(spark, sf_dir, tmp_path, parts):
    energy = signal.windowed_energy(view(spark, sf_dir, "v_pcm")).filter("source_id < 60")
    got = replay(energy, parts, "block, source_id", tmp_path, lambda s: metrics.quiet_regions(s, 110, 135, 8, 16, None))
    last = energy.groupBy("source_id").agg((F.max("block") * 8 + 16).alias("end"))
    want = signal.quiet_regions(energy, 8, 110, 135, 16).join(last, "source_id").filter("end_i < end").drop("end")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_live_rates_equal_batch(spark, sf_dir, tmp_path):
    rows = view(spark, sf_dir, "v_events").filter("session_id < 5").withColumn("total", F.col("event_id") * 1000 % 700001).select("session_id", "event_id", "t_us", "total")
    got = replay(rows.drop("event_id"), 3, "t_us", tmp_path, lambda s: metrics.live_rates(s, None))
    assert sorted(r.bps for r in got.collect()) == sorted(r.bps for r in ev.publish_rates(rows).collect())


def test_chunk_totals_equal_batch(spark, sf_dir, tmp_path):
    rows = ev.parse_manifest(view(spark, sf_dir, "v_manifest")).filter("session_id < 5")
    got = replay(rows, 3, "t_us", tmp_path, lambda s: metrics.chunk_totals(s.filter("kind = 'chunk'")), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ev.chunk_totals(rows).collect()))


def test_replay_buffer_starts_at_keyframes(spark, tmp_path):
    rows = spark.createDataFrame([(1, t * 1000, 1000, 10, True, t % 4 == 1) for t in range(1, 20)] + [(2, t * 1000, 1000, 1, False, False) for t in range(20)], "session_id long, t_us long, dur_us long, bytes long, video boolean, keyframe boolean")
    got = replay(rows, 2, "t_us", tmp_path, lambda s: metrics.replay_buffer(s, 6000, None)).orderBy("session_id", "to_us").collect()
    assert [tuple(r) for r in got if r.session_id == 1][-1] == (1, 17000, 20000, 3, 30, 0)
    assert [tuple(r) for r in got if r.session_id == 2][-1] == (2, 14000, 20000, 6, 6, 0)


def test_ring_drops_groups_that_are_too_long():
    held, dropped = [], 0
    for t in range(30):
        held, dropped = metrics.ring([*held, [t, 1, 1, 1, int(t % 10 == 0)]], dropped, 6)
        assert held[0][4] == 1 and all(a[0] + 1 == b[0] for a, b in zip(held, held[1:]))
    assert dropped == 0 and held[0][0] == 20
    held, dropped = metrics.ring([[0, 1, 1, 1, 1], [5, 1, 1, 1, 1], [20, 1, 1, 1, 0]], 0, 6)
    assert (held[0][0], dropped) == (5, 1)
    assert metrics.ring([[0, 9, 1, 0, 0]], 0, 6) == ([], 0)


def test_chunks_once_and_totals_with_a_watermark(spark, tmp_path):
    at = 10**12
    rows = [(1, "a", i, 10, i % 2, at + i * 1_000_000, at + i * 1_000_000 + 5) for i in range(6)]
    late = [(1, "a", 99, 1, 0, at + 90_000_000_000, at + 90_000_000_000)]
    made = spark.createDataFrame(rows + rows[:3] + late, "session_id long, source_id string, seq long, bytes long, drops long, t_us long, to_us long").withColumn("ts", F.timestamp_micros("t_us"))
    once = replay(made, 3, "t_us, seq", tmp_path / "a", lambda s: metrics.chunks_once(s, "ts", "1 minute", ["session_id", "source_id", "seq"]))
    assert sorted(r.seq for r in once.collect()) == [*range(6), 99]
    got = replay(made.distinct(), 3, "t_us, seq", tmp_path / "b", lambda s: metrics.chunk_totals(s, "ts", "1 minute", "1 hour"))
    assert [tuple(r)[:5] for r in got.collect()] == [(1, "a", 6, 60, 3)]


def test_intake_and_sessions(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("user_id").alias("session_id"), "user_id").filter("user_id < 20")
    got = replay(rows, 3, "ts", tmp_path / "a", lambda s: metrics.bounded_intake(s, "ts", "10 seconds", "1 day", 2)).collect()
    want = {(r.session_id, r.start): (min(2, r.n), max(0, r.n - 2)) for r in rows.groupBy("session_id", F.window("ts", "1 day").start.alias("start")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got and all(want[(r.session_id, r.start)] == (r.kept, r.dropped) for r in got)


def test_windowed_means(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    got = replay(rows, 3, "ts", tmp_path, lambda s: metrics.windowed_means(s, "ts", "10 seconds", "1 day"), "append").collect()
    want = {(r.start, r.event_type): r.n for r in rows.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got and all(want[(r.start, r.event_type)] == r.n for r in got)


@pytest.mark.parametrize("parts", [1, 5])
def test_ring_drains_equal_batch(spark, sf_dir, tmp_path, parts):
    rows = view(spark, sf_dir, "v_events").filter("session_id < 40").selectExpr("session_id", "t_us", "event_id", "kind = 'click' AS drain")
    got = replay(rows, parts, "t_us, drain, event_id", tmp_path, lambda s: metrics.ring_drains(s, 2, None))
    want = ev.ring_drains(rows.filter("NOT drain"), rows.filter("drain"), 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_ring_by_hand(spark):
    at = lambda rows: spark.createDataFrame(rows, "session_id long, event_id long, t_us long")
    events = at([(1, 1, 10), (1, 2, 11), (1, 3, 12), (1, 4, 20), (1, 5, 20), (1, 6, 31), (1, 7, None), (2, 8, 5)])
    drains = at([(1, 0, 20), (1, 0, 20), (1, 0, 25), (1, 0, 40), (3, 0, 7)])
    kept = {r.event_id: (r.period, r.held, r.kept) for r in ev.ring_intake(events, drains, 2).collect()}
    assert kept == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 2, False), 4: (0, 2, False), 5: (0, 2, False), 6: (2, 1, True), 8: (0, 1, True)}
    assert sorted(map(tuple, ev.ring_drains(events, drains, 2).collect())) == [(1, 20, 2, 3), (1, 25, 0, 3), (1, 40, 1, 3), (3, 7, 0, 0)]


def test_late_rows_across_batches(spark, tmp_path):
    at = 1_700_000_000
    # (batch, session, second): late by one batch, by two, within the bound, in their own batch, and of another session
    rows = [(1, 1, 0), (1, 1, 100), (2, 1, 50), (2, 1, 95), (2, 1, 200), (2, 2, 10), (3, 1, 130), (3, 1, 195), (3, 2, 5), (4, 1, 99), (4, 3, 300), (4, 3, 200)]
    made = spark.createDataFrame(rows, "batch long, session_id long, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + at))
    path = str(tmp_path / "in")
    for b in range(1, 5):
        made.filter(F.col("batch") == b).orderBy("session_id", F.col("s") == 200).coalesce(1).write.mode("append").parquet(path)
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = metrics.late_marked(spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(path), "ts", 10_000, None)
        good, late = str(tmp_path / "good"), str(tmp_path / "late")
        run = stream.writeStream.foreachBatch(metrics.split_late(good, late)).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        run.awaitTermination(240)
    finally:
        spark.conf.set(store, before)
    got = {(r.session_id, r.s) for r in spark.read.parquet(late).collect()}
    assert got == {(1, 50), (1, 130), (1, 99), (3, 200)}
    assert spark.read.parquet(good).count() == len(rows) - len(got)

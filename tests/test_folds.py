"""Operators without SQL against plain Python."""

from pyspark.sql import functions as F

from timeloom.functions import scalars
from timeloom.operators import editing, frames, helpers, reframe


def test_one_euro_follows_a_constant(spark):
    rows = spark.createDataFrame([(k, t, 5.0) for k in (1, 2) for t in range(10)], "key long, t long, value double")
    assert {r.value for r in editing.one_euro(rows).collect()} == {5.0}


def test_smoothing_begins_anew_after_a_jump(spark):
    rows = spark.createDataFrame([(1, 0, 0.0), (1, 1, 8.0), (1, 9, 100.0), (1, 10, 0.0)], "key long, t long, value double")
    got = editing.smoothed(rows, 0.25, 3).orderBy("t").collect()
    assert [r["mean"] for r in got] == [0.0, 2.0, 100.0, 75.0]


def test_subject_is_kept_while_it_overlaps(spark):
    box = lambda frame, det, x, size, conf, face: (0, frame, det, face, x, x, size, size, conf)
    made = [box(1, 1, 100, 300, 900, True), box(1, 2, 700, 200, 100, True), box(2, 3, 120, 300, 10, True), box(2, 4, 700, 200, 999, True)]
    made += [box(3, 5, 700, 200, 999, True), box(40, 6, 700, 200, 500, True), box(41, 7, 710, 200, 1, True), box(42, 8, 710, 200, 900, False), box(42, 9, 0, 90, 1, True), box(43, 10, 710, 200, 5, False)]
    rows = spark.createDataFrame(made, "shot long, frame_id long, det_id long, face boolean, x_milli long, y_milli long, w_milli long, h_milli long, conf_milli long")
    got = [(r.det_id, r.held) for r in editing.tracked_subjects(rows).orderBy("frame_id").collect()]
    assert got == [(1, False), (3, False), (3, True), (6, False), (7, False), (7, True), (7, False)] or got == [(1, False), (3, False), (3, True), (6, False), (7, False), (7, True), (10, False)]


def test_suppression_keeps_the_surest(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0, 300, 300, 900), (1, 2, 10, 0, 300, 300, 950), (1, 3, 600, 600, 300, 300, 100)], "frame_id long, det_id long, x_milli long, y_milli long, w_milli long, h_milli long, conf_milli long")
    assert sorted(r.det_id for r in frames.non_max_suppression(rows, 0.3, 5).collect()) == [2, 3]


def test_halo_of_chunks(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0]), (1, 1, [4.0]), (1, 2, [5.0])], "source_id long, chunk_no int, samples array<double>")
    got = helpers.with_halo(rows, ["source_id"], "chunk_no", "samples", 2).orderBy("chunk_no").collect()
    assert [r.halo for r in got] == [[], [2.0, 3.0], [4.0]]


def test_beats_pull_clips_without_overlaps(spark):
    clips = spark.createDataFrame([(1, 0, 1, 90, 100), (1, 0, 2, 260, 50), (1, 0, 3, 330, 50), (1, 0, 4, 700, 10)], "project_id long, track_no long, clip_id long, start_ms long, dur_ms long")
    beats = spark.createDataFrame([(1, t) for t in (100, 240, 350, 690, 710)], "project_id long, t_ms long")
    got = {r.clip_id: r.start_ms for r in editing.beat_aligned(clips, beats, F.col("clip_id") != 3).collect()}
    # clip 2 goes to 240; clip 4 is as far from 690 as from 710 and takes the earlier
    assert got == {1: 100, 2: 240, 4: 690}
    crowd = spark.createDataFrame([(1, 0, 1, 90, 100), (1, 0, 2, 195, 50)], "project_id long, track_no long, clip_id long, start_ms long, dur_ms long")
    got = {r.clip_id: r.start_ms for r in editing.beat_aligned(crowd, spark.createDataFrame([(1, 100), (1, 180)], "project_id long, t_ms long"), F.lit(True)).collect()}
    assert got == {1: 100}  # 180 lies in the clip that was just placed


def test_reframe_keeps_its_bounds_and_holds_before_cuts(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 0, 1.0, 1.0, 0.0), (1, 0, 2.0, 1.0, 0.0), (1, 1, 3.0, 0.5, 0.5)], "clip_id long, shot long, t double, cx double, cy double")
    got = sorted(((r.t, r.x, r.easing) for r in reframe.reframe_keyframes(rows, 0.4, 100.0).collect()))
    times, xs = [g[0] for g in got if g[0] <= 2], [g[1] for g in got if g[0] <= 2]
    assert times == [0.0, 0.5, 1.0, 1.5, 2.0] and all(abs(b - a) <= 0.2 + 1e-9 for a, b in zip(xs, xs[1:]))
    assert got[-2:] == [(2.999, xs[-1], "hold"), (3.0, -0.5, "linear")]


def test_primary_face_is_kept_by_its_bonus(spark):
    box = lambda frame, det, face, conf: (0, frame, det, face, 350, 350, 300, 300, conf)
    made = [box(0, 1, 7, 800), box(0, 2, 8, 700), box(1, 3, 7, 700), box(1, 4, 8, 850), box(2, 5, 7, 400), box(2, 6, 8, 950), box(3, 7, 7, 200), box(40, 8, 9, 800), box(40, 9, 8, 700)]
    rows = spark.createDataFrame(made, "track long, frame_id long, det_id long, face_id long, x_milli long, y_milli long, w_milli long, h_milli long, conf_milli long")
    assert [(r.det_id, r.handed_over) for r in editing.weighted_picks(rows).orderBy("frame_id").collect()] == [(1, False), (3, False), (6, True), (8, False)]


def test_gram_ratio(spark):
    texts = ["abcdabcdabcd", "abc", "", None, "été été"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", scalars.gram_ratio(F.col("t")).alias("r")).orderBy("i").collect()
    want = [len(b) / len({b[k : k + 4] for k in range(len(b) - 3)}) if len(b) >= 4 else 1.0 for b in ((t or "").encode() for t in texts)]
    assert [r.r for r in got[:3]] == [round(w, 6) for w in want[:3]] and abs(got[4].r - want[4]) < 1e-5


def test_semi_join_of_ranges_with_nulls(spark):
    a = spark.createDataFrame([(1, 0, 10, None), (1, 0, 10, None), (1, 50, 60, "x"), (2, 0, 10, "y")], "k int, a_start long, a_end long, note string")
    b = spark.createDataFrame([(1, 5, 7)], "k int, b_start long, b_end long")
    assert helpers.helpers.interval_join(a, b, ["k"], 16, "semi").count() == 2
    assert sorted(r.note for r in helpers.helpers.interval_join(a, b, ["k"], 16, "anti").collect()) == ["x", "y"]


def test_relink_by_nearest_size(spark):
    from timeloom.operators import quality

    facts = "file_name string, byte_size long, duration_ms long, start_ms long, rotation long, sample_rate long, channels long"
    sources = spark.createDataFrame([(1, "a", 100, 1000, 0, None, 48000, 2), (2, "b", 7, 1000, 0, 90, None, None)], f"source_id long, {facts}")
    found = spark.createDataFrame([(11, "a", 101, 1000, 0, 90, 44100, 2), (12, "a", 90, 1000, 0, None, 48000, 2), (13, "b", 7, 1400, 70, 0, 48000, 1), (14, "b", 7, 1000, 0, 90, 1, 1), (15, "c", 7, 0, 0, 0, 0, 0)], f"cand_id long, {facts}")
    got = {(r.source_id, r.cand_id): r.reasons for r in quality.relink(sources, found).collect()}
    assert got == {(1, 11): "size,audio sample rate", (2, 13): "duration,track timing,rotation", (2, 14): ""}


def test_replay_requests_stay_apart(spark):
    from timeloom.operators import events

    chunks = spark.createDataFrame([(1, t, t % 5 == 0, 10) for t in range(20)] + [(2, t, False, 1) for t in range(10)], "session_id long, t_us long, keyframe boolean, bytes long")
    asks = spark.createDataFrame([(1, 1, 6, 8), (2, 1, 7, 12), (3, 1, -9, 3), (4, 2, 3, 5), (5, 1, 50, 60)], "request_id long, session_id long, start_us long, end_us long")
    got = {r.request_id: (r.from_us, r.n, r.bytes) for r in events.replay_snapshot(chunks, asks, 4).collect()}
    assert got == {1: (5, 4, 40), 2: (5, 8, 80), 3: (0, 4, 40), 4: (3, 3, 3), 5: (15, 5, 50)}


def test_no_plan_has_a_nested_loop(spark, sf_dir):
    from timeloom import plans

    for name in ("c1_resolve_at", "c6_intersect", "c7_selected", "c8_snapped", "c10_sampled_keyframes", "c13_collapsed", "c19_boundary_guard", "g1_split_at"):
        text = plans.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text, name


def test_ranges_out_of_reach_are_not_dealt(spark):
    """A range of a million years that starts after all others of its key meets none, and is no row a bin."""
    a = spark.createDataFrame([(1, 0, 10), (1, 30, 40), (2, 5, 6)], "k long, a_start long, a_end long")
    b = spark.createDataFrame([(1, 9, 31), (1, 40, 10**16), (2, 6, 10**16), (3, 0, 10**16), (2, 0, 6)], "k long, b_start long, b_end long")
    met = helpers.interval_join(a, b, ["k"], 16)
    assert sorted(map(tuple, met.collect())) == [(1, 0, 10, 9, 31), (1, 30, 40, 9, 31), (2, 5, 6, 0, 6)]
    assert sorted(map(tuple, helpers.interval_join(a, b.filter("k = 1"), ["k"], 16, "anti").collect())) == [(2, 5, 6)]

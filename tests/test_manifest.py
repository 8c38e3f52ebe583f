"""Manifest lines by their rules, and how often a plan parses them; ranges of any number of sets; edits on locked tracks."""

import json

from pyspark.sql import functions as F

from timeloom.operators import captions, editing, intervals, quality
from timeloom.operators.events import parse_manifest

HEADER = {"kind": "header", "version": 1, "sessionId": "s", "startedAtIso": "t", "epochUs": None, "sources": [{"sourceId": "a", "kind": "mic"}], "chunkTargetS": 2}
CHUNK = {"kind": "chunk", "sourceId": "a", "file": "f", "byteOffset": 0, "byteLength": 9, "fromUs": 1.5, "toUs": 7, "keyFrame": True, "preEncodeDrops": 0}


def kept(spark, lines):
    df = spark.createDataFrame([(1, i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines)], "session_id long, line_no long, line string")
    return parse_manifest(df)


def test_rules_of_records(spark):
    without = lambda record, key: {k: v for k, v in record.items() if k != key}
    good = [HEADER, HEADER | {"epochUs": 5}, CHUNK, {"kind": "pause", "atUs": 3}, {"kind": "source-added", "atUs": 1, "source": {"sourceId": "b", "kind": "webcam", "label": "x"}}, {"kind": "epoch", "epochUs": 4}]
    bad = [without(HEADER, "epochUs"), HEADER | {"epochUs": "5"}, HEADER | {"version": 2}, HEADER | {"sources": [{"sourceId": "a", "kind": "tape"}]}, CHUNK | {"fromUs": "1"}, CHUNK | {"keyFrame": 1}, without(CHUNK, "file"), {"kind": "pause"}, {"kind": "note", "atUs": 1}, "[1]", '{"kind":"pause","at', "", {"kind": "source-region-applied", "sourceId": "a", "atUs": 1, "mode": "blur"}]
    got = {r.line_no: r for r in kept(spark, good + bad).collect()}
    assert sorted(got) == list(range(len(good)))
    assert (got[2].t_us, got[2].to_us, got[2].key_frame, got[2].bytes, got[2].detail) == (1, 7, True, 9, "f")
    assert got[1].t_us == 5 and got[4].source_id == "b"


def test_lines_are_parsed_once(spark):
    made = kept(spark, [HEADER]).filter("kind = 'pause'").groupBy("session_id").agg(F.max("t_us"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_intersection_of_all_sets(spark):
    rows = [(1, 0, 0, 10, 1), (1, 0, 10, 20, 2), (1, 1, 5, 30, 3), (1, 2, 0, 15, 9), (1, 2, 17, 18, 4), (2, 0, 0, 5, 1), (2, 1, 5, 9, 1), (3, 0, 3, 7, 6), (3, 0, 7, 7, 6)]
    ranges = spark.createDataFrame(rows, "project_id long, track_no long, start_ms long, end_ms long, peak long")
    for width in (4, 1 << 14):
        got = sorted(map(tuple, intervals.intersect_all(ranges, ["project_id"], "track_no", width=width).collect()))
        assert got == [(1, 5, 10, 9), (1, 10, 15, 9), (1, 17, 18, 4), (3, 3, 7, 6)]
    four = spark.createDataFrame([(1, 4), (2, 2), (3, 1)], "project_id long, n_sets long")
    assert [tuple(r) for r in intervals.intersect_all(ranges, ["project_id"], "track_no", four).collect()] == [(3, 3, 7, 6)]


CLIPS = "project_id long, track_no long, clip_id long, source_id long, start_ms long, dur_ms long, in_ms long"


def test_locked_tracks_and_linked_groups(spark):
    clips = spark.createDataFrame([(p, t, p * 100 + t * 10 + k, 1, k * 1000, 1000, 0) for p in (1, 2) for t in (0, 1) for k in range(3)], CLIPS)
    locks = spark.createDataFrame([(2, 1)], "project_id long, track_no long")
    got = {r.clip_id: (r.start_ms, r.accepted) for r in intervals.ripple_delete(clips, F.expr("track_no = 0 AND start_ms = 0"), None, locks, F.expr("CASE WHEN start_ms = 0 THEN 7 END")).collect()}
    # the linked clip on the other track goes too; where that track is locked, nothing is edited
    assert {c: v for c, v in got.items() if c < 200} == {101: (0, True), 102: (1000, True), 111: (0, True), 112: (1000, True)}
    assert {c: v for c, v in got.items() if c >= 200} == {200 + t * 10 + k: (k * 1000, False) for t in (0, 1) for k in range(3)}
    alone = intervals.ripple_delete(clips, F.expr("track_no = 0 AND start_ms = 0"), None, locks)
    assert {r.accepted for r in alone.collect()} == {True} and alone.count() == 10
    moves = spark.createDataFrame([(102, 5000), (212, 5000)], "clip_id long, by_ms long")
    moved = {r.clip_id: r.start_ms for r in editing.moved_batches(clips, moves, locks).collect()}
    assert moved[102] == 7000 and moved[212] == 2000
    ranges = spark.createDataFrame([(1, 500, 1500), (2, 500, 1500)], "project_id long, cut_start long, cut_end long")
    lifted = intervals.lift(clips, ranges, F.col("track_no") == 1, locks)
    assert lifted.filter("project_id = 2").count() == 6 and lifted.filter("project_id = 1 AND track_no = 1").count() == 3


def test_layers_take_unused_clips(spark):
    clips = spark.createDataFrame([(1, 0, 11, 5, 0, 1, 0), (1, 0, 12, 6, 1, 1, 0), (1, 0, 13, 7, 2, 1, 0)], CLIPS)
    layers = spark.createDataFrame([(1, 0, 6, 9), (1, 1, 99, 0), (1, 2, 99, 0), (1, 3, 99, 0), (1, 4, 99, 0), (1, 5, 99, 3)], "project_id long, layer int, source_id long, track_no long")
    assert {r.layer: (r.clip_id, r.by_source) for r in editing.layer_matches(layers, clips).collect()} == {0: (12, True), 1: (11, False), 2: (12, False), 3: (13, False)}


def test_deleted_entries_take_no_room(spark):
    entries = lambda rows: spark.createDataFrame(rows, "store_id string, entry_id long, category_rank long, status_rank long, last_used long, bytes long")
    three = [("a", 1, 0, 4, 1, 100), ("a", 2, 0, 1, 2, 100), ("a", 3, 0, 1, 3, 100)]
    assert quality.eviction_plan(entries(three), 200).collect() == []
    assert [r.entry_id for r in quality.eviction_plan(entries(three), 100).collect()] == [2]
    lacks = spark.createDataFrame([("a", 50, 200)], "store_id string, free_bytes long, least_free long")
    # 150 bytes are lacking: as much goes, not the target less them
    assert [r.entry_id for r in quality.eviction_plan(entries(three), 1000, lacks).collect()] == [2, 3]
    in_use = [("a", 5, 0, 0, 9, 500), *three]
    assert [r.entry_id for r in quality.eviction_plan(entries(in_use), 600).collect()] == [2]


def test_chapter_stamps(spark):
    markers = spark.createDataFrame([(1, 1, 75_000, "a"), (1, 2, 3_700_000, "b")], "project_id long, point_id long, t_ms long, label string")
    assert captions.chapters(markers, 4_000_000).first().text == "00:00:00 Intro\n00:01:15 a\n01:01:40 b"

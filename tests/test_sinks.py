"""Files of one text each are written whole, one a key, and come back."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from timeloom.operators import captions
from timeloom.sources import sinks


def segments(spark):
    rows = [(1, 1, 0, 1000, "a"), (1, 2, 2000, 500, "b c\nd"), (2, 3, 3_600_005, 1000, "é & <x>")]
    return spark.createDataFrame(rows, "track_id long, seg_id long, start_ms long, dur_ms long, text string")


def test_one_file_for_each_track_and_format(spark, tmp_path):
    path = str(tmp_path / "captions")
    sinks.write_captions(segments(spark).repartition(3), path)
    found = sorted(os.path.relpath(os.path.join(d, f), path).split("/part-")[0] for d, _, names in os.walk(path) for f in names if f.startswith("part-"))
    assert found == ["track_id=1/format=srt", "track_id=1/format=vtt", "track_id=2/format=srt", "track_id=2/format=vtt"]
    files = sinks.read_files(spark, path, "body")
    srt = captions.parsed_cues(files.filter("format = 'srt'").withColumnRenamed("body", "srt"))
    assert sorted((r.track_id, r.start_ms, r.end_ms, r.text) for r in srt.collect()) == [(1, 0, 1000, "a"), (1, 2000, 2500, "b c\nd"), (2, 3_600_005, 3_601_005, "é & <x>")]
    vtt = files.filter("format = 'vtt' AND track_id = 1").first().body
    assert vtt == captions.vtt_files(segments(spark)).filter("track_id = 1").first().vtt
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_captions(segments(spark), path)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "broken")
    bad = segments(spark).withColumn("text", F.when(F.col("track_id") == 2, F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        sinks.write_captions(bad, path)
    assert not [f for _, _, names in os.walk(path) for f in names if f.startswith("part-") or f == "_SUCCESS"]


def test_chapters_as_json(spark):
    rows = spark.createDataFrame([(1, 75_500, "b \"x\""), (1, 0, "a"), (2, 3_700_000, "c")], "project_id long, t_ms long, label string")
    made = sinks.chapters_json(rows)
    assert {r.project_id: json.loads(r.json) for r in made.collect()} == {1: [{"time": 0.0, "label": "a"}, {"time": 75.5, "label": 'b "x"'}], 2: [{"time": 3700.0, "label": "c"}]}
    assert sorted(map(tuple, sinks.parsed_chapters(made).collect())) == [(1, 0, 0, "a", "00:00:00"), (1, 1, 75_500, 'b "x"', "00:01:15"), (2, 0, 3_700_000, "c", "01:01:40")]


def test_keys_come_back_from_names_and_none_is_lost(spark, tmp_path):
    path, rows = str(tmp_path / "texts"), [("a/b=c", "x"), ("a/b=c", "y"), (None, "z"), ("é %25", "n\n")]
    texts = spark.createDataFrame(rows, "name string, body string")
    sinks.write_files(texts, path, ["name"], "body")
    found = lambda: sorted((r.name or "", r.body) for r in sinks.read_files(spark, path, "body").collect())
    want = [("", "z\n"), ("a/b=c", "x\n"), ("a/b=c", "y\n"), ("é %25", "n\n")]
    assert found() == sorted(want) and not [p for p in os.listdir(tmp_path) if p.startswith(".")]
    sinks.write_files(texts, path, ["name"], "body", "append")
    assert found() == sorted(want * 2)
    sinks.write_files(texts, path, ["name"], "body", "overwrite")
    assert found() == sorted(want)


def test_many_small_files_take_no_process_each(spark, tmp_path):
    path = str(tmp_path / "many")
    began = time.time()
    sinks.write_files(spark.range(4000).selectExpr("id", "cast(id AS string) AS body"), path, ["id"], "body")
    assert time.time() - began < 10 and len([n for n in os.listdir(path) if n.startswith("id=")]) == 4000


def test_the_driver_lists_no_files(spark, tmp_path):
    path = str(tmp_path / "captions")
    sinks.write_captions(segments(spark), path)
    files = sinks.read_files(spark, path, "body", format="vtt")
    assert files.inputFiles() == [] and sorted((r.track_id, r.format) for r in files.collect()) == [(1, "vtt"), (2, "vtt")]
    assert dict(sinks.read_files(spark, path, "body").dtypes) == {"body": "string", "track_id": "int", "format": "string"}
    assert sinks.read_files(spark, path, "body").count() == 4


@pytest.mark.parametrize("values, kind", [(["5000000000", "7"], "bigint"), (["1.5", "2"], "double"), (["2024-01-31", None], "date"), (["1", "x"], "string"), (["99999999999999999999"], "decimal(38,0)")])
def test_keys_get_types_as_from_the_reader(spark, tmp_path, values, kind):
    path = str(tmp_path / "typed")
    sinks.write_files(spark.createDataFrame([(v, "t") for v in values], "k string, body string"), path, ["k"], "body")
    mine, theirs = sinks.read_files(spark, path, "body"), spark.read.text(path, wholetext=True)
    assert dict(mine.dtypes)["k"] == kind and sorted(map(str, [r.k for r in mine.collect()])) == sorted(map(str, [r.k for r in theirs.collect()]))
    assert kind.startswith("decimal") or dict(theirs.dtypes)["k"] == kind

"""Caption and transcript segments: parsing, writing, cleaning, chapters. Times are integers (ms)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions.scalars import chapter_time, normalised_text, parsed_srt_time, srt_time
from timeloom.operators.helpers import fold_per_key


def clipped(segments: DataFrame, start: int, end: int, least: int = 50) -> DataFrame:
    """Segments that overlap a range, cut to it and counted from its start; at least ``least`` long."""
    rows = segments.filter((F.col("start_ms") < end) & (F.col("start_ms") + F.col("dur_ms") > start))
    a, b = F.greatest(F.col("start_ms"), F.lit(start)), F.least(F.col("start_ms") + F.col("dur_ms"), F.lit(end))
    return rows.select("track_id", "seg_id", (a - start).alias("start_ms"), F.greatest(b - a, F.lit(least)).alias("dur_ms"), "text")


def without_repeats(segments: DataFrame, within_ms: int = 30_000) -> DataFrame:
    """Drop a segment whose text ended within a time before on its track, also where that one was dropped; drop empty ones."""
    rows = segments.withColumn("_n", normalised_text(F.col("text"))).filter("_n <> ''")
    w = Window.partitionBy("track_id", "_n").orderBy("start_ms", "seg_id")
    before = F.lag(F.col("start_ms") + F.col("dur_ms")).over(w)
    return rows.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("start_ms") - F.col("_b") > within_ms)).select("track_id", "seg_id", "start_ms")


def without_adjacent_repeats(segments: DataFrame, within_ms: int = 6_000) -> DataFrame:
    """Drop a segment with the text of the last kept one if it starts within a time of that one's end; a fold per track."""

    def fold(rows):
        last = None
        for r in rows:
            if last and r["n"] == last["n"] and r["start_ms"] - (last["start_ms"] + last["dur_ms"]) <= within_ms:
                continue
            last = r
            yield {k: r[k] for k in ("track_id", "seg_id", "start_ms")}

    rows = segments.select("track_id", "seg_id", "start_ms", "dur_ms", normalised_text(F.col("text")).alias("n"))
    return fold_per_key(rows, ["track_id"], ["start_ms", "seg_id"], fold, "track_id long, seg_id long, start_ms long")


def transcripts(segments: DataFrame) -> DataFrame:
    """The trimmed texts of each track in order, joined by spaces: ``track_id, n, text``."""
    rows = segments.select("track_id", F.struct("start_ms", "seg_id", F.trim("text").alias("t")).alias("s")).filter("s.t <> ''")
    made = rows.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("s")).alias("s"))
    return made.select("track_id", "n", F.array_join(F.transform("s", lambda x: x["t"]), " ").alias("text"))


def srt_files(segments: DataFrame) -> DataFrame:
    """Each track as SRT text: ``track_id, srt``."""
    w = Window.partitionBy("track_id").orderBy("start_ms", "seg_id")
    cue = F.concat_ws("\n", F.col("n"), F.concat(srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("start_ms") + F.col("dur_ms"))), F.col("text"))
    rows = segments.withColumn("n", F.row_number().over(w)).select("track_id", F.struct("n", cue.alias("c")).alias("s"))
    made = rows.groupBy("track_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return made.select("track_id", F.concat(F.array_join(F.transform("s", lambda x: x["c"]), "\n\n"), F.lit("\n")).alias("srt"))


def parse_srt(files: DataFrame) -> DataFrame:
    """Cues of SRT texts (``track_id, srt``): ``track_id, cue, start_ms, end_ms, text, problem`` (``ok`` or the first rule broken)."""
    blocks = files.select("track_id", F.posexplode(F.split(F.regexp_replace(F.regexp_replace("srt", "\r\n?", "\n"), r"^\s+|\s+$", ""), "\n[ \t]*\n+")).alias("cue", "b"))
    lines = F.split("b", "\n")
    rows = blocks.select("track_id", "cue", F.get(lines, F.lit(0)).alias("no"), F.split(F.get(lines, F.lit(1)), "-->").alias("t"), F.array_join(F.slice(lines, F.lit(3), F.size(lines)), "\n").alias("text"))
    rows = rows.select("track_id", "cue", "no", "text", parsed_srt_time(F.get("t", F.lit(0))).alias("start_ms"), parsed_srt_time(F.get("t", F.lit(1))).alias("end_ms"))
    prior = F.lag("end_ms").over(Window.partitionBy("track_id").orderBy("cue"))
    problem = F.when(~F.col("no").rlike(r"^\s*\d+\s*$"), "invalid-index").when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "invalid-timecode").when(F.col("end_ms") <= F.col("start_ms"), "negative-duration").when(F.trim("text") == "", "empty-cue").when(F.col("start_ms") < prior, "overlap").otherwise("ok")
    return rows.select("track_id", "cue", "start_ms", "end_ms", "text", problem.alias("problem"))


def dominant_language(detections: DataFrame, key: str) -> DataFrame:
    """``zh`` or ``en``, whichever has more confidence among the detections of a key (``detected``, ``confidence``); ``zh`` on a tie."""
    zh, en = (F.sum(F.when(F.col("detected").startswith(x), F.col("confidence")).otherwise(0)) for x in ("zh", "en"))
    return detections.groupBy(key).agg(zh.alias("zh"), en.alias("en")).select(key, F.when(F.col("zh") >= F.col("en"), "zh").otherwise("en").alias("lang"))


def chapters(markers: DataFrame, length_ms: int, least: int = 3, spacing_ms: int = 10_000) -> DataFrame:
    """Chapter text of each project from labelled markers, or the first rule that fails: ``project_id, n, reason, text``.

    An Intro is put at 0 unless a marker stands there; blank labels and markers past the end are dropped.
    """
    rows = markers.filter((F.trim("label") != "") & (F.col("t_ms") < length_ms)).select("project_id", "t_ms", "point_id", "label")
    seed = markers.select("project_id").distinct().join(rows.filter("t_ms = 0").select("project_id").distinct(), "project_id", "left_anti").select("project_id", F.lit(0).cast("long").alias("t_ms"), F.lit(-1).cast("long").alias("point_id"), F.lit("Intro").alias("label"))
    rows = rows.unionByName(seed)
    after = F.lead("t_ms").over(Window.partitionBy("project_id").orderBy("t_ms", "point_id"))
    rows = rows.withColumn("gap", after - F.col("t_ms"))
    line = F.struct("t_ms", "point_id", F.concat(chapter_time(F.col("t_ms")), F.lit(" "), F.trim("label")).alias("l"))
    made = rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("gap"), F.max("t_ms").alias("last"), F.sort_array(F.collect_list(line)).alias("s"))
    reason = F.when(F.col("n") < least, "too-few").when(F.col("gap") < spacing_ms, "too-close").when(F.col("last") > length_ms - spacing_ms, "too-late").otherwise("ok")
    return made.select("project_id", "n", reason.alias("reason"), F.array_join(F.transform("s", lambda x: x["l"]), "\n").alias("text"))


#: What speech models say of music, silence and noise, and characters that speech has at least one of.
HALLUCINATIONS = (
    r"^\[.*\]$",
    r"^\(.*(?:music|singing|applause|laughter|speaking|foreign|language|indistinct|inaudible|mumbling|dramatic|upbeat|instrumental).*\)$",
    r"^(?:thank you for (?:watching|listening|your (?:attention|time))|subscribe|like and subscribe|don't forget to subscribe)",
    r"^(?:you|we)\s+(?:can|will|shall|should|may|might)\s+(?:also|now)\s+(?:see|look|watch|listen)",
    r"^(\b\w+\b)(?:\s+\1)+$",
)
SPEECH = "[A-Za-z0-9\u3400-\u9fff]"


def without_hallucinations(segments: DataFrame, patterns: tuple[str, ...] = HALLUCINATIONS) -> DataFrame:
    """Segments with speech in them whose text, without outer white space, matches none of the patterns in either case."""
    said = F.regexp_replace("text", r"^\s+|\s+$", "")
    rows = segments.filter(said.rlike(SPEECH))
    for p in patterns:
        rows = rows.filter(~said.rlike(f"(?i){p}"))
    return rows


def in_trusted_range(segments: DataFrame, windows: DataFrame) -> DataFrame:
    """Segments that start in their window's trusted range (``track_id, from_ms, to_ms``)."""
    return segments.join(windows, "track_id").filter("start_ms >= from_ms AND start_ms < to_ms").select("track_id", "seg_id", "start_ms")


def normalised_segments(segments: DataFrame) -> DataFrame:
    """Start at 0 or later, at least 50 ms; words (``words`` of ``s, e, w``) only if each ends after it starts and none overlaps the one before."""
    ok = F.forall(F.transform("words", lambda x, i: (x["e"] > x["s"]) & ((i == 0) | (x["s"] >= F.get(F.col("words"), i - 1)["e"]))), lambda x: F.coalesce(x, F.lit(True)))
    return segments.select("track_id", "seg_id", F.greatest(F.lit(0), F.col("start_ms")).alias("start_ms"), F.greatest(F.lit(50), F.col("dur_ms")).alias("dur_ms"), F.when(ok, F.size("words")).otherwise(0).alias("n_words"))


def active_word(segments: DataFrame, after_ms: int) -> DataFrame:
    """Index of the word that is spoken a time after each segment's start, -1 if none is."""
    at = F.col("start_ms") + after_ms
    hit = F.array_position(F.transform("words", lambda x: (x["s"] <= at) & (at < x["e"])), True)
    return segments.select("track_id", "seg_id", (hit - 1).alias("word_no"))


def split_segments(segments: DataFrame, pivot: int) -> DataFrame:
    """Segments with more than ``pivot`` words cut there; times are shared by the number of words."""
    words = F.split("text", " ")
    n = F.size(words)
    parts = F.when(n > pivot, F.array(F.struct(F.lit(0).alias("part"), F.slice(words, 1, pivot).alias("w")), F.struct(F.lit(1).alias("part"), F.slice(words, F.lit(pivot + 1), n).alias("w")))).otherwise(F.array(F.struct(F.lit(0).alias("part"), words.alias("w"))))
    cut = F.expr(f"dur_ms * {pivot} div size(split(text, ' '))")
    rows = segments.select("track_id", "seg_id", "start_ms", "dur_ms", F.when(n > pivot, cut).otherwise(F.col("dur_ms")).alias("c"), F.explode(parts).alias("p"))
    return rows.select("track_id", "seg_id", "p.part", F.when(F.col("p.part") == 0, F.col("start_ms")).otherwise(F.col("start_ms") + F.col("c")).alias("start_ms"), F.when(F.col("p.part") == 0, F.col("c")).otherwise(F.col("dur_ms") - F.col("c")).alias("dur_ms"), F.array_join("p.w", " ").alias("text"))


def merged_segments(segments: DataFrame, group: str) -> DataFrame:
    """Segments of a group as one, texts in order."""
    rows = segments.groupBy("track_id", group).agg(F.min("start_ms").alias("start_ms"), F.max(F.col("start_ms") + F.col("dur_ms")).alias("end_ms"), F.sort_array(F.collect_list(F.struct("start_ms", "seg_id", "text"))).alias("s"))
    return rows.select("track_id", group, "start_ms", "end_ms", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"))


def vtt_files(segments: DataFrame) -> DataFrame:
    """Each track as WebVTT text."""
    stamp = lambda c: F.replace(srt_time(c), F.lit(","), F.lit("."))
    cue = F.concat(stamp(F.col("start_ms")), F.lit(" --> "), stamp(F.col("start_ms") + F.col("dur_ms")), F.lit("\n"), F.col("text"))
    rows = segments.select("track_id", F.struct("start_ms", "seg_id", cue.alias("c")).alias("s")).groupBy("track_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return rows.select("track_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("s", lambda x: x["c"]), "\n\n"), F.lit("\n")).alias("vtt"))


def vtt_blocks(files: DataFrame) -> DataFrame:
    """Blocks of WebVTT texts (``track_id, vtt``): ``track_id, n, cue`` (number among cue blocks, null for others), ``start_ms, end_ms, settings, text``."""
    blocks = files.select("track_id", F.posexplode(F.split(F.regexp_replace(F.regexp_replace("vtt", "\r\n?", "\n"), r"^\s+|\s+$", ""), "\n[ \t]*\n+")).alias("n", "b"))
    other = F.col("b").rlike("^(WEBVTT|NOTE|STYLE|REGION)")
    pattern = r"(?s)^(?:[^\n]*\n)?(\d{1,3}:\d{2}:\d{2}\.\d{3}) --> (\d{1,3}:\d{2}:\d{2}\.\d{3})([^\n]*)(?:\n(.*))?$"
    part = [F.regexp_extract("b", pattern, i) for i in (1, 2, 3, 4)]
    w = Window.partitionBy("track_id").orderBy("n")
    cue = F.when(~other, F.sum((~other).cast("int")).over(w))
    return blocks.select("track_id", "n", cue.alias("cue"), parsed_srt_time(part[0]).alias("start_ms"), parsed_srt_time(part[1]).alias("end_ms"), F.trim(part[2]).alias("settings"), part[3].alias("text"))


def parse_vtt(files: DataFrame) -> DataFrame:
    """Cues of WebVTT texts; NOTE, STYLE and REGION blocks and cue settings are passed over, and so are cues without times, in order or text."""
    rows = vtt_blocks(files).filter("cue IS NOT NULL AND end_ms > start_ms AND trim(text) <> ''")
    return rows.select("track_id", "cue", "start_ms", "end_ms", "text")


def vtt_diagnostics(files: DataFrame) -> DataFrame:
    """What is wrong in WebVTT texts: ``track_id, cue`` (0: the file), ``code`` (``missing-header, invalid-timecode, negative-duration, empty-cue, overlap, ignored-settings``)."""
    header = files.filter(~F.col("vtt").rlike("^\ufeff?WEBVTT")).select("track_id", F.lit(0).cast("long").alias("cue"), F.lit("missing-header").alias("code"))
    rows = vtt_blocks(files).filter("cue IS NOT NULL")
    prior = F.max("end_ms").over(Window.partitionBy("track_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_prior", prior)
    bad = F.when(F.col("start_ms").isNull(), "invalid-timecode").when(F.col("end_ms") <= F.col("start_ms"), "negative-duration").when(F.trim("text") == "", "empty-cue").when(F.col("start_ms") < F.col("_prior"), "overlap")
    codes = F.array_compact(F.array(bad, F.when(F.col("settings") != "", "ignored-settings")))
    return rows.select("track_id", F.col("cue").cast("long").alias("cue"), F.explode(codes).alias("code")).unionByName(header)


def srt_diagnostics(files: DataFrame) -> DataFrame:
    """Cues of SRT texts that break a rule: ``track_id, cue, problem``; all but overlapping ones are left out of ``parsed_cues``."""
    return parse_srt(files).filter("problem <> 'ok'").select("track_id", "cue", "problem")


def parsed_cues(files: DataFrame) -> DataFrame:
    """The good cues of SRT texts: ``track_id, cue, start_ms, end_ms, text``."""
    return parse_srt(files).filter("problem IN ('ok', 'overlap')").select("track_id", "cue", "start_ms", "end_ms", "text")

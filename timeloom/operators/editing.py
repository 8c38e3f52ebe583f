"""Clip parameters over time, transitions, source timing and bulk edits. Times are integers (ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.operators.helpers import asof_join, fold_per_key, interval_join
from timeloom.operators.intervals import TOUCH_MS, cut_by_ranges, locked_projects, resolve_at, unless_locked

TRACK = ["project_id", "track_no"]


def _end() -> Column:
    return F.expr("start_ms + dur_ms")


def sampled_keyframes(points: DataFrame, keys: DataFrame, fallback: int) -> DataFrame:
    """Value at each point between the keyframes (``project_id, key_ms, value, easing``) around it.

    ``hold`` keeps the earlier value, ``smooth`` eases with t*t*(3-2t), anything else is linear; the ends are held, and
    a project without keyframes has the fallback.
    """
    k = keys.select("project_id", "key_ms", F.struct("value", "easing").alias("k"))
    a = asof_join(points, k.select("project_id", F.col("key_ms").alias("a_ms"), F.col("k").alias("a")), ["project_id"], "t_ms", "a_ms", ["a_ms", "a"])
    b = asof_join(a, k.select("project_id", F.col("key_ms").alias("b_ms"), F.col("k").alias("b")), ["project_id"], "t_ms", "b_ms", ["b_ms", "b"], "forward")
    t = (F.col("t_ms") - F.col("a_ms")) / (F.col("b_ms") - F.col("a_ms"))
    t = F.when(F.col("a.easing") == "hold", 0.0).when(F.col("a.easing") == "smooth", t * t * (3 - 2 * t)).otherwise(t)
    between = F.col("a.value") + (F.col("b.value") - F.col("a.value")) * t
    value = F.when(F.col("a").isNull() & F.col("b").isNull(), fallback).when(F.col("a").isNull(), F.col("b.value")).when(F.col("b").isNull() | (F.col("a_ms") == F.col("b_ms")), F.col("a.value")).otherwise(between)
    return b.select("point_id", "project_id", "t_ms", F.round(value.cast("double"), 6).alias("value"))


def touching_cuts(clips: DataFrame) -> DataFrame:
    """Cuts between neighbours that touch: ``project_id, track_no, from_clip, to_clip, cut_ms``."""
    w = Window.partitionBy(*TRACK).orderBy("start_ms", "clip_id")
    rows = clips.select(*TRACK, F.col("clip_id").alias("from_clip"), F.lead("clip_id").over(w).alias("to_clip"), F.lead("start_ms").over(w).alias("cut_ms"), _end().alias("_e"))
    return rows.filter(F.abs(F.col("cut_ms") - F.col("_e")) <= TOUCH_MS).drop("_e")


def transitions_at(points: DataFrame, clips: DataFrame, dur_ms: int, width: int = 16384) -> DataFrame:
    """Points inside the transition around a cut of clips that touch: both clips and how far the mix is, in thousandths."""
    b = touching_cuts(clips).select(*TRACK, "from_clip", "to_clip", (F.col("cut_ms") - dur_ms // 2).alias("b_start"), (F.col("cut_ms") + dur_ms // 2).alias("b_end"))
    a = points.select("project_id", "point_id", F.col("t_ms").alias("a_start"), (F.col("t_ms") + 1).alias("a_end"))
    return interval_join(a, b, ["project_id"], width).select("point_id", "track_no", "from_clip", "to_clip", F.expr(f"(a_start - b_start) * 1000 div {dur_ms}").alias("mix_milli"))


def layers_at(points: DataFrame, clips: DataFrame, dur_ms: int) -> DataFrame:
    """Layers of each point: the plain clip of a track, or the outgoing and the incoming one where a transition replaces it.

    ``point_id, track_no, clip_id, role`` (``plain``, ``out``, ``in``) and ``mix_milli``; transitions are no longer than the
    clips around them, so one point has one of a track.
    """
    mixes = transitions_at(points, clips, dur_ms)
    sides = F.array(F.struct(F.col("from_clip").alias("clip_id"), F.lit("out").alias("role")), F.struct(F.col("to_clip").alias("clip_id"), F.lit("in").alias("role")))
    mixed = mixes.select("point_id", "track_no", "mix_milli", F.explode(sides).alias("s")).select("point_id", "track_no", "s.clip_id", "s.role", "mix_milli")
    plain = resolve_at(points, clips).join(mixes.select("point_id", "track_no").distinct(), ["point_id", "track_no"], "left_anti")
    return plain.select("point_id", "track_no", "clip_id", F.lit("plain").alias("role"), F.lit(0).cast("long").alias("mix_milli")).unionByName(mixed)


def shared_source_layers(layers: DataFrame, clips: DataFrame) -> DataFrame:
    """Incoming layers whose source is that of the outgoing one: ``point_id, track_no, clip_id, source_id``."""
    named = layers.join(clips.select("clip_id", "source_id"), "clip_id")
    out = named.filter("role = 'out'").select("point_id", "track_no", "source_id")
    return named.filter("role = 'in'").join(out, ["point_id", "track_no", "source_id"], "left_semi").select("point_id", "track_no", "clip_id", "source_id")


def boundary_guard(pairs: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Pairs (``project_id, pair_id, from_ms, to_ms``) with the first boundary in (from, to], or -1."""
    b = boundaries.select("project_id", F.col("t_ms").alias("hit_ms")).distinct()
    rows = pairs.withColumn("next_ms", F.col("from_ms") + 1)
    met = asof_join(rows, b, ["project_id"], "next_ms", "hit_ms", ["hit_ms"], "forward")
    return met.select("pair_id", F.when(F.col("hit_ms") <= F.col("to_ms"), F.col("hit_ms")).otherwise(-1).alias("boundary_ms"))


def normalised_timing(sources: DataFrame) -> DataFrame:
    """Earliest start, latest end and audio offset of each source from its tracks' first and last times (nulls skipped)."""
    return sources.select("source_id", F.least("v_start", "a_start").alias("start_ms"), F.greatest("v_end", "a_end").alias("end_ms"), F.coalesce(F.col("a_start") - F.col("v_start"), F.lit(0)).alias("offset_ms"))


def availability(requests: DataFrame) -> DataFrame:
    """Why a source has nothing at a time: ``outside-source``, ``before-track-start``, ``after-track-end`` or ``none``."""
    t = F.col("t_ms")
    why = F.when((t < 0) | (t >= F.col("duration_ms")), "outside-source").when(t < F.col("track_start"), "before-track-start").when(t >= F.col("track_end"), "after-track-end").otherwise("none")
    return requests.select("source_id", "t_ms", why.alias("why"))


def silence_frames(requests: DataFrame, rate: int) -> DataFrame:
    """Frames until a track starts and until it ends, at a speed in percent."""
    frames = lambda a, b: F.greatest(F.lit(0), F.ceil((F.col(a) - F.col(b)) * 100 * rate / (F.col("speed_pct") * 1000))).cast("long")
    return requests.select("source_id", "t_ms", frames("track_start", "t_ms").alias("until_start"), frames("track_end", "t_ms").alias("until_end"))


def cleaned_substitutes(clips: DataFrame, assets: DataFrame) -> DataFrame:
    """Clips with their cleaned asset where it covers them; ``missing`` where one is named but doesn't."""
    met = clips.join(assets, "source_id", "left")
    covers = F.coalesce((F.col("from_ms") <= F.col("in_ms")) & (F.col("to_ms") >= F.col("in_ms") + F.col("dur_ms")), F.lit(False))
    return met.select("clip_id", F.when(covers, F.col("asset_id")).otherwise(F.col("source_id")).alias("used_id"), (F.col("asset_id").isNotNull() & ~covers).alias("missing"))


def colour_class(sources: DataFrame) -> DataFrame:
    """Working space and HDR flag from transfer and primaries hints."""
    hdr = F.coalesce(F.col("transfer").isin("pq", "hlg"), F.lit(False))
    space = F.when(hdr, "rec2100").when(F.col("primaries") == "bt2020", "rec2020").otherwise("rec709")
    return sources.select("source_id", hdr.alias("hdr"), space.alias("space"))


def patched(clips: DataFrame, patches: DataFrame) -> DataFrame:
    """Clips with the fields that a patch (``clip_id, gain, fade_ms``) sets, clamped to their ranges."""
    met = clips.join(patches, "clip_id", "left")
    gain = F.greatest(F.lit(0), F.least(F.lit(400), F.coalesce("gain", F.lit(100))))
    fade = F.greatest(F.lit(0), F.least(F.expr("dur_ms div 2"), F.coalesce("fade_ms", F.lit(0))))
    return met.select("clip_id", gain.cast("long").alias("gain"), fade.cast("long").alias("fade_ms"))


def overwritten(clips: DataFrame, inserts: DataFrame, lifted: DataFrame, locks: DataFrame | None = None) -> DataFrame:
    """``lifted`` (the clips without the inserts' ranges) with the inserts added; a project keeps its ``clips`` if a track with an insert is locked."""
    if locks is not None:
        refused = inserts.join(locks.select(*TRACK), TRACK, "left_semi").select("project_id").distinct()
        inserts = inserts.join(refused, "project_id", "left_anti")
        lifted = lifted.join(refused, "project_id", "left_anti").unionByName(clips.join(refused, "project_id", "left_semi").select(*lifted.columns))
    return lifted.select(*TRACK, "clip_id", "start_ms", "dur_ms").unionByName(inserts.select(*TRACK, "clip_id", "start_ms", "dur_ms"))


def rolled(clips: DataFrame, by_ms: int, locks: DataFrame | None = None) -> DataFrame:
    """Cuts of unlocked tracks that may move by ``by_ms`` without emptying the clip before or running out of the one after: changed pairs."""
    clips = clips if locks is None else clips.join(locks.select(*TRACK), TRACK, "left_anti")
    w = Window.partitionBy(*TRACK).orderBy("start_ms", "clip_id")
    rows = clips.select(*TRACK, "clip_id", "start_ms", "dur_ms", "in_ms", F.lead("clip_id").over(w).alias("to_clip"), F.lead("start_ms").over(w).alias("to_start"), F.lead("dur_ms").over(w).alias("to_dur"), F.lead("in_ms").over(w).alias("to_in"))
    ok = rows.filter((F.abs(F.col("to_start") - _end()) <= TOUCH_MS) & (F.col("dur_ms") + by_ms > 0) & (F.col("to_dur") - by_ms > 0) & (F.col("to_in") + by_ms >= 0))
    return ok.select("clip_id", "to_clip", (F.col("dur_ms") + by_ms).alias("dur_ms"), (F.col("to_start") + by_ms).alias("to_start"), (F.col("to_dur") - by_ms).alias("to_dur"), (F.col("to_in") + by_ms).alias("to_in"))


def slipped(clips: DataFrame, by_ms: int, source_ms: int | None = None, sources: DataFrame | None = None, locks: DataFrame | None = None) -> DataFrame:
    """Clips of unlocked tracks whose in-point can move within the source, whose length is ``source_ms`` or comes from ``sources`` (``source_id, length_ms``)."""
    clips = clips if locks is None else clips.join(locks.select(*TRACK), TRACK, "left_anti")
    clips = clips.withColumn("length_ms", F.lit(source_ms)) if sources is None else clips.join(sources.select("source_id", "length_ms"), "source_id")
    moved = F.greatest(F.lit(0), F.least(F.col("in_ms") + by_ms, F.col("length_ms") - F.col("dur_ms")))
    return clips.select("clip_id", "in_ms", moved.alias("new_in")).filter("in_ms <> new_in")


def moved_batches(clips: DataFrame, moves: DataFrame, locks: DataFrame | None = None) -> DataFrame:
    """Move clips (``clip_id, by_ms``); a project whose result overlaps, or that moves a clip of a locked track, keeps its old times: ``clip_id, start_ms, accepted``."""
    met = clips.join(moves, "clip_id", "left").withColumn("to_ms", F.col("start_ms") + F.coalesce("by_ms", F.lit(0)))
    w = Window.partitionBy(*TRACK).orderBy("to_ms", "clip_id")
    bad = (F.col("to_ms") < 0) | F.coalesce(F.col("to_ms") < F.lag(F.col("to_ms") + F.col("dur_ms")).over(w), F.lit(False))
    refused = locked_projects(met, locks, F.col("by_ms").isNotNull()).withColumn("_no", F.lit(True))
    rows = met.withColumn("_bad", bad).join(refused, "project_id", "left").withColumn("_bad", F.col("_bad") | F.coalesce("_no", F.lit(False))).withColumn("_any", F.max("_bad").over(Window.partitionBy("project_id")))
    return rows.select("project_id", "clip_id", F.when(F.col("_any"), F.col("start_ms")).otherwise(F.col("to_ms")).alias("start_ms"), (~F.col("_any")).alias("accepted"))


def beat_splits(clips: DataFrame, beats: DataFrame, least_ms: int = 200, width: int = 16384) -> DataFrame:
    """Beats at which clips are split: each ``least_ms`` after the last one taken (or the start) and before the end."""
    a = beats.select("project_id", F.col("t_ms").alias("a_start"), (F.col("t_ms") + 1).alias("a_end")).distinct()
    b = clips.select("project_id", "clip_id", F.col("start_ms").alias("b_start"), _end().alias("b_end"))
    inside = interval_join(a, b, ["project_id"], width).select("clip_id", F.col("b_start").alias("start_ms"), F.col("b_end").alias("end_ms"), F.col("a_start").alias("t_ms"))

    def fold(rows):
        last = None
        for r in rows:
            if r["t_ms"] - (r["start_ms"] if last is None else last) >= least_ms and r["end_ms"] - r["t_ms"] >= least_ms:
                last = r["t_ms"]
                yield {"clip_id": r["clip_id"], "t_ms": last}

    return fold_per_key(inside, ["clip_id"], ["t_ms"], fold, "clip_id long, t_ms long")


def merged_sets(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sorted distinct values of a key, comma-joined."""
    return df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), ",").alias("items"))


def reordered_tracks(tracks: DataFrame, moved: int, to: int) -> DataFrame:
    """Tracks with one moved to another place, numbered again from 0."""
    key = F.when(F.col("track_no") == moved, to - 0.5 if to <= moved else to + 0.5).otherwise(F.col("track_no").cast("double"))
    return tracks.select("project_id", "track_no", (F.row_number().over(Window.partitionBy("project_id").orderBy(key)) - 1).alias("place"))


def retakes(clips: DataFrame, swaps: DataFrame) -> DataFrame:
    """Clips whose source was taken again (``source_id, new_id, new_ms``): new source from 0, never longer than it."""
    met = clips.join(swaps, "source_id")
    return met.select("clip_id", "start_ms", F.col("new_id").alias("source_id"), F.least("dur_ms", "new_ms").alias("dur_ms"))


def cut_list(clips: DataFrame, fps: int) -> DataFrame:
    """Events of the lowest track of each project in frames, empty ones skipped: numbered, with the record time from 1 h."""
    first = F.min("track_no").over(Window.partitionBy("project_id"))
    rows = clips.withColumn("_t", first).filter(F.col("track_no") == F.col("_t"))
    snap = lambda c: F.floor(c * fps / 1000 + 0.5)
    rows = rows.select("project_id", "clip_id", snap(F.col("in_ms")).alias("src"), snap(F.col("start_ms")).alias("rec"), snap(_end()).alias("e")).withColumn("n_frames", F.col("e") - F.col("rec")).filter("n_frames > 0")
    n = F.row_number().over(Window.partitionBy("project_id").orderBy("rec", "clip_id"))
    return rows.select("project_id", n.alias("event"), "clip_id", F.col("src").alias("source_in"), (F.col("src") + F.col("n_frames")).alias("source_out"), (F.col("rec") + 3600 * fps).alias("record_in"), (F.col("e") + 3600 * fps).alias("record_out"))


def cut_list_issues(events: DataFrame) -> DataFrame:
    """Issues of each project's events: numbers out of turn, unequal durations, record times that go back."""
    w = Window.partitionBy("project_id").orderBy("event")
    rows = events.withColumns({"_e": F.lag("event").over(w), "_r": F.lag("record_out").over(w)})
    issues = F.array_compact(F.array(F.when(F.col("event") != F.coalesce("_e", F.lit(0)) + 1, "sequence"), F.when(F.col("source_out") - F.col("source_in") != F.col("record_out") - F.col("record_in"), "duration"), F.when(F.col("record_in") < F.col("_r"), "record-order")))
    return rows.select("project_id", "event", F.explode(issues).alias("issue"))


def gapped_sequence(clips: DataFrame) -> DataFrame:
    """Children of each track in order: clips, and the gaps before them; overlapped clips are dropped by a fold per track."""

    def fold(rows):
        cursor, n = 0, 0
        for r in rows:
            if r["start_ms"] < cursor:
                continue
            if r["start_ms"] > cursor:
                yield {"project_id": r["project_id"], "track_no": r["track_no"], "n": n, "kind": "gap", "clip_id": -1, "dur_ms": r["start_ms"] - cursor}
                n += 1
            yield {"project_id": r["project_id"], "track_no": r["track_no"], "n": n, "kind": "clip", "clip_id": r["clip_id"], "dur_ms": r["dur_ms"]}
            n += 1
            cursor = r["start_ms"] + r["dur_ms"]

    return fold_per_key(clips.select(*TRACK, "clip_id", "start_ms", "dur_ms"), TRACK, ["start_ms", "clip_id"], fold, "project_id long, track_no long, n long, kind string, clip_id long, dur_ms long")


def smoothed(points: DataFrame, alpha: float, jump: int) -> DataFrame:
    """Exponential mean of ``value`` by key, begun anew after a time jump; a fold per key."""

    def fold(rows):
        last, t = None, None
        for r in rows:
            last = float(r["value"]) if last is None or r["t"] - t > jump else last + alpha * (r["value"] - last)
            t = r["t"]
            yield {"key": r["key"], "t": t, "mean": round(last, 6)}

    return fold_per_key(points, ["key"], ["t"], fold, "key long, t long, mean double")


def tracked_subjects(boxes: DataFrame, least_iou: float = 0.3, coast: int = 30) -> DataFrame:
    """One box a frame (``shot, frame_id, det_id, face, x_milli, y_milli, w_milli, h_milli, conf_milli``); a fold per shot.

    Faces go before other boxes. The box that overlaps the last subject by ``least_iou`` or more is kept, the best of them;
    where none does, the last subject is held for up to ``coast`` frames (``held``), then the surest box takes over.
    """

    def iou(a, b):
        i = max(0, min(a["x_milli"] + a["w_milli"], b["x_milli"] + b["w_milli"]) - max(a["x_milli"], b["x_milli"])) * max(0, min(a["y_milli"] + a["h_milli"], b["y_milli"] + b["h_milli"]) - max(a["y_milli"], b["y_milli"]))
        return i / max(1, a["w_milli"] * a["h_milli"] + b["w_milli"] * b["h_milli"] - i)

    def fold(rows):
        frames: dict = {}
        for r in rows:
            frames.setdefault(r["frame_id"], []).append(r)
        last, seen = None, None
        for frame, found in sorted(frames.items()):
            found = [b for b in found if b["face"]] or found
            near = [b for b in found if last and iou(last, b) >= least_iou]
            held = bool(last) and not near and last["face"] >= found[0]["face"] and frame - seen <= coast
            if near:
                last = max(near, key=lambda b: (iou(last, b), -b["det_id"]))
            elif not held:
                last = max(found, key=lambda b: (b["conf_milli"], -b["det_id"]))
            seen = seen if held else frame
            yield {"shot": last["shot"], "frame_id": frame, "det_id": last["det_id"], "held": held}

    return fold_per_key(boxes, ["shot"], ["frame_id", "det_id"], fold, "shot long, frame_id long, det_id long, held boolean")


def slow_motion_instants(clips: DataFrame, interval_ms: int, factor: int, most: int) -> DataFrame:
    """Times between a clip's source frames (``interval_ms`` apart) at which frames are made up: at most ``most`` an interval."""
    n = min(factor - 1, most)
    rows = clips.filter(F.col("dur_ms") >= interval_ms).select("clip_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"dur_ms div {interval_ms}") - 1)).alias("interval"))
    return rows.select("clip_id", "interval", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k")).select("clip_id", "interval", "k", F.expr(f"interval * {interval_ms} + k * {interval_ms} div {factor}").alias("t_ms"))


def mixed_blocks(pcm: DataFrame, gains: DataFrame, block: int = 8) -> DataFrame:
    """Sums over the sources of a project of gain-weighted samples (percent), clamped to full scale, by block and place."""
    rows = pcm.join(gains, "source_id").select("project_id", F.expr(f"i div {block}").alias("block"), F.expr(f"i % {block}").alias("place"), (F.col("x_milli") * F.col("gain_pct")).alias("v"))
    total = F.expr("greatest(-1000, least(1000, sum(v) div 100))")
    return rows.groupBy("project_id", "block", "place").agg(total.alias("x_milli"))


def down_mixed(pairs: DataFrame) -> DataFrame:
    """Mono from pairs of samples: the mean, and the sum over the root of two that speech models expect."""
    return pairs.select("source_id", "n", F.round((F.col("l") + F.col("r")) / 2, 6).alias("mean"), F.round((F.col("l") + F.col("r")) / F.sqrt(F.lit(2.0)), 6).alias("asr"))


def active_at(points: DataFrame, segments: DataFrame, width: int = 65536) -> DataFrame:
    """Segments (``project_id, seg_id, start_ms, dur_ms``) that hold each point."""
    a = points.select("project_id", "point_id", F.col("t_ms").alias("a_start"), (F.col("t_ms") + 1).alias("a_end"))
    b = segments.select("project_id", "seg_id", F.col("start_ms").alias("b_start"), _end().alias("b_end"))
    return interval_join(a, b, ["project_id"], width).select("point_id", "seg_id")


def lut_lookup(points: DataFrame, table: DataFrame) -> DataFrame:
    """Value of a sorted table (``project_id, key_ms, value``) at each point, linear in between, held at the ends."""
    rows = table.select("project_id", "key_ms", "value")
    a = asof_join(points, rows.withColumnsRenamed({"key_ms": "a_ms", "value": "a"}), ["project_id"], "t_ms", "a_ms", ["a_ms", "a"])
    b = asof_join(a, rows.withColumnsRenamed({"key_ms": "b_ms", "value": "b"}), ["project_id"], "t_ms", "b_ms", ["b_ms", "b"], "forward")
    between = F.col("a") + (F.col("b") - F.col("a")) * (F.col("t_ms") - F.col("a_ms")) / (F.col("b_ms") - F.col("a_ms"))
    value = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull() | (F.col("a_ms") == F.col("b_ms")), F.col("a")).otherwise(between)
    return b.select("point_id", F.round(value.cast("double"), 6).alias("value")).filter(F.col("value").isNotNull())


def remap_table(speeds: DataFrame, step_ms: int, most: int = 4) -> DataFrame:
    """Source time after each step of output time, by Simpson's rule over the speed curve (percent, linear between keys).

    ``speeds``: ``project_id, key_ms, speed_pct, source_ms``. The table ends with the step that reaches the source's end, and
    at ``most`` times the source's length in any case.
    """
    ends = speeds.groupBy("project_id").agg(F.max("source_ms").alias("source_ms"))
    grid = ends.select("project_id", "source_ms", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"source_ms * {most} div {step_ms}"))).alias("n"))
    # the speed at both ends of a step and in its middle
    at = grid.select("project_id", "source_ms", "n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).withColumn("t_ms", F.expr(f"n * {step_ms} + k * {step_ms} div 2")).withColumn("point_id", F.struct("project_id", "source_ms", "n", "k"))
    speed = lut_lookup(at.select("project_id", "t_ms", "point_id"), speeds.select("project_id", "key_ms", F.col("speed_pct").alias("value"))).select("point_id.*", "value")
    weight = F.when(F.col("k") == 1, 4).otherwise(1)
    step = speed.groupBy("project_id", "source_ms", "n").agg(F.sum(weight * F.col("value")).alias("_v")).withColumn("_d", F.col("_v") * step_ms / 600)
    run = F.sum("_d").over(Window.partitionBy("project_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    rows = step.withColumn("_at", run)
    return rows.filter(F.col("_at") - F.col("_d") < F.col("source_ms")).select("project_id", "n", F.round(F.least(F.col("_at"), F.col("source_ms").cast("double")) + 1e-7, 3).alias("source_at"))


def normalised_keyframes(keys: DataFrame, grain_ms: int) -> DataFrame:
    """One keyframe for each rounded time, the last one given (``ord``)."""
    slot = F.expr(f"key_ms div {grain_ms}")
    rows = keys.withColumn("slot", slot).groupBy("project_id", "slot").agg(F.max_by(F.struct("ord", "key_ms", "value"), "ord").alias("k"))
    return rows.select("project_id", "k.ord", "k.key_ms", "k.value")


def silence_cuts(clips: DataFrame, regions: DataFrame, locks: DataFrame | None = None) -> DataFrame:
    """Clips split at the regions' edges (any number a project: ``cut_start, cut_end``), pieces inside a region deleted, the rest of a track moved left by them.

    A project with a locked track keeps its clips, each as its piece 0.
    """
    pieces = cut_by_ranges(clips, regions)
    w = Window.partitionBy(*TRACK).orderBy("start_ms", "clip_id", "piece_no").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(F.when(F.col("inside"), F.col("dur_ms")).otherwise(0)).over(w), F.lit(0))
    made = pieces.withColumn("_gone", gone).filter("NOT inside").select(*TRACK, "clip_id", "piece_no", (F.col("start_ms") - F.col("_gone")).alias("start_ms"), "dur_ms")
    return unless_locked(made, clips.withColumn("piece_no", F.lit(0)), locks, F.lit(True))


def reframe_stats(frames: DataFrame) -> DataFrame:
    """Frames with a face or a salient cell of each shot, the mode, and the share inside the safe zone in percent."""
    rows = frames.groupBy("shot").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "face").alias("n_face"), F.count_if(F.col("kind") == "saliency").alias("n_saliency"), F.expr("count_if(safe) * 100 div count(*)").alias("safe_pct"))
    return rows.withColumn("mode", F.when(F.col("n_saliency") == 0, "face").when(F.col("n_face") == 0, "saliency").otherwise("mixed"))


#: The parts of confidence, area, centrality and continuity in a face's score, frames until a face counts as lost, and the least confidence.
FACE_WEIGHTS, LOST_AFTER, LEAST_CONFIDENCE = (0.45, 0.25, 0.2, 0.1), 30, 0.3


def face_scores(boxes: DataFrame) -> DataFrame:
    """Boxes that are sure enough with ``score``, what their confidence, area and distance from the middle give without continuity."""
    cx, cy = (F.col("x_milli") + F.col("w_milli") / 2) / 500 - 1, (F.col("y_milli") + F.col("h_milli") / 2) / 500 - 1
    central = F.greatest(F.lit(0.0), 1 - F.sqrt(cx * cx + cy * cy))
    conf, area, middle, _ = FACE_WEIGHTS
    score = F.round(conf * F.col("conf_milli") / 1000 + area * F.col("w_milli") * F.col("h_milli") / 1e6 + middle * central, 6)
    return boxes.filter(F.col("conf_milli") >= int(LEAST_CONFIDENCE * 1000)).withColumn("score", score)


def weighted_picks(boxes: DataFrame) -> DataFrame:
    """The primary face of each frame (``track, frame_id, det_id, face_id`` and the box): the best score, a bonus for the last one's face, the first on a tie.

    A face that isn't seen for more than 30 frames loses its bonus; a fold per track over scored boxes.
    """

    def fold(rows):
        frames: dict = {}
        for r in rows:
            frames.setdefault(r["frame_id"], []).append(r)
        last, seen = None, None
        for frame, found in sorted(frames.items()):
            if seen is not None and frame - seen - 1 > LOST_AFTER:
                last = None
            best = max(found, key=lambda r: (r["score"] + (FACE_WEIGHTS[3] if r["face_id"] == last else 0.0), -r["det_id"]))
            handed = last is not None and best["face_id"] != last
            last, seen = best["face_id"], frame
            yield {"track": best["track"], "frame_id": frame, "det_id": best["det_id"], "face_id": last, "handed_over": handed}

    return fold_per_key(face_scores(boxes).select("track", "frame_id", "det_id", "face_id", "score"), ["track"], ["frame_id", "det_id"], fold, "track long, frame_id long, det_id long, face_id long, handed_over boolean")


def beat_aligned(clips: DataFrame, beats: DataFrame, chosen: Column) -> DataFrame:
    """Chosen clips start at the nearest beat (the earlier on a tie) unless they would then overlap a clip that stays or was placed: ``clip_id, start_ms``, only moved ones.

    Beats are found by two as-of joins; placing is a fold per track in the order of starts.
    """
    from timeloom.operators.intervals import snapped

    rows = clips.withColumn("_chosen", chosen)
    near = snapped(rows.filter("_chosen").select("project_id", F.col("clip_id").alias("point_id"), F.col("start_ms").alias("t_ms")), beats.select("project_id", F.col("t_ms").alias("target_ms")), 1 << 60)
    rows = rows.join(near.select(F.col("point_id").alias("clip_id"), "project_id", F.greatest(F.lit(0), F.col("snap_ms")).alias("to_ms")), ["project_id", "clip_id"], "left")

    def fold(rows):
        from bisect import bisect_right

        rows = list(rows)
        placed = sorted((r["start_ms"], r["start_ms"] + r["dur_ms"]) for r in rows if not r["chosen"])
        for r in rows:
            if not r["chosen"] or r["to_ms"] is None:
                continue
            a, b = r["to_ms"], r["to_ms"] + r["dur_ms"]
            at = bisect_right(placed, (a, b))
            # what is placed doesn't overlap, so only the neighbours can be in the way
            if (at and placed[at - 1][1] > a) or (at < len(placed) and placed[at][0] < b):
                continue
            placed.insert(at, (a, b))
            if a != r["start_ms"]:
                yield {"clip_id": r["clip_id"], "start_ms": a}

    made = rows.select(*TRACK, "clip_id", "start_ms", "dur_ms", "to_ms", F.col("_chosen").alias("chosen"))
    return fold_per_key(made, TRACK, ["start_ms", "clip_id"], fold, "clip_id long, start_ms long")


def layer_matches(layers: DataFrame, clips: DataFrame) -> DataFrame:
    """Scene layers (``project_id, layer, source_id, track_no``, in the order of ``layer``) with a clip: the first of their source, else of their track.

    Of a track's clips, each goes to one such layer at most: the layers without a source's clip take them by rank, and layers without one left
    are dropped.
    """
    by_source = clips.groupBy("project_id", "source_id").agg(F.min("clip_id").alias("s_clip"))
    met = layers.join(by_source, ["project_id", "source_id"], "left")
    rank = lambda order: F.row_number().over(Window.partitionBy(*TRACK).orderBy(order)).alias("_rank")
    # of a track, layers are few; of its clips, only as many as it has layers are needed
    rest = met.filter("s_clip IS NULL").select(*TRACK, "layer", rank("layer"))
    most = rest.groupBy(*TRACK).agg(F.max("_rank").alias("_most"))
    ranked = clips.join(most, TRACK).select(*TRACK, F.col("clip_id").alias("t_clip"), "_most", rank("clip_id")).filter("_rank <= _most").drop("_most")
    by_track = rest.join(ranked, [*TRACK, "_rank"]).select("project_id", "layer", "t_clip")
    both = met.join(by_track, ["project_id", "layer"], "left")
    return both.select("project_id", "layer", F.coalesce("s_clip", "t_clip").alias("clip_id"), F.col("s_clip").isNotNull().alias("by_source")).filter("clip_id IS NOT NULL")


def one_euro(points: DataFrame, floor: float = 1.0, beta: float = 0.01, rate: float = 30.0) -> DataFrame:
    """Speed-adaptive low pass of ``value`` by key; a fold per key."""
    import math

    def fold(rows):
        x = dx = None
        for r in rows:
            v = float(r["value"])
            if x is None:
                x, dx = v, 0.0
            else:
                part = lambda cut: 1 / (1 + rate / (2 * math.pi * cut))
                dx += part(1.0) * ((v - x) * rate - dx)
                x += part(floor + beta * abs(dx)) * (v - x)
            yield {"key": r["key"], "t": r["t"], "value": round(x, 6)}

    return fold_per_key(points, ["key"], ["t"], fold, "key long, t long, value double")


def normalised_effects(clips: DataFrame) -> DataFrame:
    """Effect values with their defaults, clamped: brightness -100..100 (0), contrast and saturation 0..200 (100), opacity 0..100 (100)."""
    clamp = lambda c, d, a, b: F.greatest(F.lit(a), F.least(F.lit(b), F.coalesce(c, F.lit(d)))).cast("long").alias(c)
    return clips.select("clip_id", clamp("brightness", 0, -100, 100), clamp("contrast", 100, 0, 200), clamp("saturation", 100, 0, 200), clamp("opacity", 100, 0, 100))


def crossfade_gains(points: DataFrame, clips: DataFrame, dur_ms: int) -> DataFrame:
    """Equal-power gains of both sides of the crossfade around a cut, at the points inside it."""
    met = transitions_at(points, clips, dur_ms)
    angle = F.col("mix_milli") / 1000.0 * F.lit(3.141592653589793 / 2)
    return met.select("point_id", "track_no", "from_clip", "to_clip", F.round(F.cos(angle), 6).alias("out_gain"), F.round(F.sin(angle), 6).alias("in_gain"))


def landmarks_at(points: DataFrame, tracks: DataFrame) -> DataFrame:
    """Landmarks (an array at each ``key_ms``) at each point, each number linear between the arrays around it, held at the ends."""
    rows = tracks.select("project_id", "key_ms", "marks")
    a = asof_join(points, rows.withColumnsRenamed({"key_ms": "a_ms", "marks": "a"}), ["project_id"], "t_ms", "a_ms", ["a_ms", "a"])
    b = asof_join(a, rows.withColumnsRenamed({"key_ms": "b_ms", "marks": "b"}), ["project_id"], "t_ms", "b_ms", ["b_ms", "b"], "forward")
    t = (F.col("t_ms") - F.col("a_ms")) / (F.col("b_ms") - F.col("a_ms"))
    between = F.zip_with("a", "b", lambda x, y: x + (y - x) * t)
    held = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull() | (F.col("a_ms") == F.col("b_ms")), F.col("a")).otherwise(between)
    return b.select("point_id", F.transform(held, lambda x: F.round(x, 6)).alias("marks")).filter(F.col("marks").isNotNull())

"""The reframe job: from frames, faces and pixels of clips to keyframes that keep a subject in a new aspect.

Stages, each a table: shots (islands between histogram jumps), one detection a frame (the primary face, else the most salient cell),
a tracked and smoothed path a shot, keyframes of bounded speed and acceleration with holds before cuts, and figures of each clip.
A clip is analysed at a few frames a second, so what one fold reads is a shot's worth of small rows; clips and shots are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.operators.editing import face_scores
from timeloom.operators.frames import SHOT_THRESHOLD, colour_histogram, salient_cells, shot_distances
from timeloom.operators.helpers import fold_per_key

#: Overlap that makes two detections one subject, seconds that a lost subject is held, the size of a salient spot, the
#: smoothing (least cutoff in Hz, what speed adds to it, cutoff of the speed itself), and how far a subject may be from the middle.
SAME_SUBJECT, COAST_S, SPOT, EURO, SAFE_HALF = 0.3, 1.0, 0.15, (1.0, 0.007, 1.0), 0.45
#: The bounds of the motion (widths a second, and a second squared), seconds between keyframes, before a cut, and what counts as no time.
VELOCITY, ACCELERATION, INTERVAL_S, HOLD_GAP_S, NO_TIME_S = 0.3, 0.5, 0.5, 1e-3, 1e-6


def shots(frames: DataFrame, pixels: DataFrame, threshold: float = SHOT_THRESHOLD) -> DataFrame:
    """Frames (``clip_id, frame_id, t``) with ``boundary``, ``shot`` (from 0) and ``segment``, the shot that keyframes belong to.

    A cut at the last frame of a clip starts a shot, but no keyframes of its own.
    """
    hist = colour_histogram(pixels.join(frames.select("frame_id"), "frame_id", "left_semi")).join(frames.select("clip_id", "frame_id"), "frame_id")
    cuts = shot_distances(hist.select("clip_id", "frame_id", "bin", "n"), ["clip_id"], threshold).filter("boundary").select("clip_id", "frame_id", F.lit(True).alias("_cut"))
    clip = Window.partitionBy("clip_id")
    so_far = clip.orderBy("t", "frame_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = frames.join(cuts, ["clip_id", "frame_id"], "left").withColumns({"boundary": F.col("_cut").isNotNull(), "_end": F.max("t").over(clip)})
    inside = F.col("boundary") & (F.col("t") < F.col("_end") - NO_TIME_S)
    return rows.withColumns({"shot": F.count_if("boundary").over(so_far), "segment": F.count_if(inside).over(so_far)}).drop("_cut", "_end")


def detections(frames: DataFrame, faces: DataFrame, pixels: DataFrame, across: int = 16) -> DataFrame:
    """Frames with one detection each: ``cx, cy, w, h`` in parts of the frame and whether it is a ``face``.

    The face of the best score goes first, the first of them on a tie; the saliency of frames without one is all that is computed of it.
    A frame without either has its middle.
    """
    best = face_scores(faces).groupBy("frame_id").agg(F.max_by(F.struct("x_milli", "y_milli", "w_milli", "h_milli"), F.struct("score", -F.col("det_id"))).alias("f"))
    cells = salient_cells(pixels.join(frames.select("frame_id"), "frame_id", "left_semi").join(best, "frame_id", "left_anti"), across).select("frame_id", "cell")
    middle = lambda place: F.coalesce((place + 0.5) / across, F.lit(0.5))
    face = F.col("f").isNotNull()
    of = lambda at, size: (F.col(f"f.{at}") + F.col(f"f.{size}") / 2) / 1000
    rows = frames.join(best, "frame_id", "left").join(cells, "frame_id", "left")
    made = {
        "cx": F.when(face, of("x_milli", "w_milli")).otherwise(middle(F.col("cell") % across)), "cy": F.when(face, of("y_milli", "h_milli")).otherwise(middle(F.expr(f"cell div {across}"))),
        "w": F.when(face, F.col("f.w_milli") / 1000).otherwise(SPOT), "h": F.when(face, F.col("f.h_milli") / 1000).otherwise(SPOT), "face": face,
    }
    return rows.withColumns(made).drop("f", "cell")


def overlap(a: dict, b: dict) -> float:
    """The shared area of two boxes (middle and size) in parts of what they cover together."""
    sides = [min(a[c] + a[s] / 2, b[c] + b[s] / 2) - max(a[c] - a[s] / 2, b[c] - b[s] / 2) for c, s in (("cx", "w"), ("cy", "h"))]
    both = max(0.0, sides[0]) * max(0.0, sides[1])
    return both / (a["w"] * a["h"] + b["w"] * b["h"] - both) if both else 0.0


def smooth(values: list[float], times: list[float]) -> list[float]:
    """Low pass whose cutoff rises with the smoothed speed (one-euro filter) of values at growing times."""
    least, by_speed, of_speed = EURO
    share = lambda cutoff, dt: 1 / (1 + 1 / (2 * pi * cutoff * dt))

    def step(state: tuple[float, float], now: tuple[float, float]) -> tuple[float, float]:
        (last, speed), (value, dt) = state, now
        if dt <= 0:
            return state
        speed += share(of_speed, dt) * ((value - last) / dt - speed)
        return last + share(least + by_speed * abs(speed), dt) * (value - last), speed

    steps = zip(values[1:], (b - a for a, b in zip(times, times[1:])))
    return [s[0] for s in accumulate(steps, step, initial=(values[0], 0.0))]


def tracked(rows: DataFrame) -> DataFrame:
    """The path of each shot's subject: ``clip_id, segment, frame_id, t, cx, cy`` (from the middle of the frame), ``face``, and whether the subject was ``held``.

    A detection is taken if it overlaps the subject, is the first face after salient spots, or the subject was lost for over a
    second; else the subject stays where it was. A fold per shot.
    """

    def fold(found: Iterator[dict]) -> Iterator[dict]:
        subject, places, own = None, [], list(found)
        for r in own:
            new = subject is None or (r["face"] and not subject["face"]) or overlap(subject, r) >= SAME_SUBJECT or r["t"] - subject["t"] > COAST_S
            subject = r if new else subject
            places.append(subject)
        times = [r["t"] for r in own]
        xs, ys = (smooth([p[c] for p in places], times) for c in ("cx", "cy"))
        for r, p, x, y in zip(own, places, xs, ys):
            yield {"clip_id": r["clip_id"], "segment": r["segment"], "frame_id": r["frame_id"], "t": r["t"], "cx": x - 0.5, "cy": y - 0.5, "face": r["face"], "held": p is not r}

    return fold_per_key(rows.select("clip_id", "shot", "segment", "frame_id", "t", "cx", "cy", "w", "h", "face"), ["clip_id", "shot"], ["t", "frame_id"], fold, "clip_id long, segment long, frame_id long, t double, cx double, cy double, face boolean, held boolean")


def bounded_speed(values, steps, most: float) -> list[float]:
    """Each value at most ``most`` a second from the one before."""
    near = lambda last, now: last + max(-most * now[1], min(most * now[1], now[0] - last))
    return list(accumulate(zip(values[1:], steps), near, initial=values[0]))


def bounded_acceleration(values, steps, most: float) -> list[float]:
    """From the third on, each value such that its speed differs from the last by at most ``most`` a second."""
    if len(values) < 3:
        return list(values)

    def near(state, now):
        (last, speed), (value, dt) = state, now
        speed += max(-most * dt, min(most * dt, (value - last) / dt - speed))
        return last + speed * dt, speed

    first = (values[1], (values[1] - values[0]) / steps[0])
    return [values[0], *[s[0] for s in accumulate(zip(values[2:], steps[1:]), near, initial=first)]]


def fill(source_aspect: float, target_aspect: float) -> tuple[float, float]:
    """Width and height of a source that fills a frame of another aspect, in parts of that frame."""
    if source_aspect <= 0 or target_aspect <= 0:
        return 1.0, 1.0
    return (source_aspect / target_aspect, 1.0) if source_aspect >= target_aspect else (1.0, target_aspect / source_aspect)


def sampled_path(path: DataFrame, rect: tuple[float, float] = (1.0, 1.0), velocity: float = VELOCITY, acceleration: float = ACCELERATION, interval: float = INTERVAL_S) -> DataFrame:
    """Positions at regular times of each shot (``clip_id, shot, t, cx, cy`` in): ``clip_id, shot, t, x, y, safe``; a fold per shot.

    The layer goes against the subject, linear between its places; speed, then acceleration are bounded, and ``safe`` tells whether
    the subject is still near enough to the middle.
    """
    import numpy as np

    def fold(rows):
        rows = list(rows)
        t = np.array([r["t"] for r in rows])
        start, end = t[0], t[-1]
        times = start + interval * np.arange(max(1, np.ceil((end - NO_TIME_S - start) / interval)))
        times = np.append(times, end) if end - start > NO_TIME_S else times[:1]
        steps, made = np.diff(times), []
        for column, size in zip(("cx", "cy"), rect):
            wanted = np.interp(times, t, [-r[column] * size for r in rows])
            own = bounded_acceleration(bounded_speed(wanted, steps, velocity), steps, acceleration)
            made.append((own, np.abs(own - wanted) <= SAFE_HALF))
        (x, safe_x), (y, safe_y) = made
        for at, a, b, safe in zip(times, x, y, safe_x & safe_y):
            yield {"clip_id": rows[0]["clip_id"], "shot": rows[0]["shot"], "t": float(at), "x": float(a), "y": float(b), "safe": bool(safe)}

    return fold_per_key(path.select("clip_id", "shot", "t", "cx", "cy"), ["clip_id", "shot"], ["t"], fold, "clip_id long, shot long, t double, x double, y double, safe boolean")


def with_holds(samples: DataFrame, hold_gap: float = HOLD_GAP_S) -> DataFrame:
    """Keyframes of samples: ``clip_id, shot, t, x, y, easing``; the last position of a shot is held until just before the next shot."""
    clip = Window.partitionBy("clip_id").orderBy("t", "shot")
    rows = samples.withColumns({"_next": F.lead("t").over(clip), "_cut": F.lead("shot").over(clip) != F.col("shot")})
    hold = F.col("_next") - hold_gap
    room = hold > F.col("t") + NO_TIME_S
    key = lambda t, easing: F.struct(F.round(t, 6).alias("t"), F.lit(easing).alias("easing"))
    keys = F.when(F.col("_cut") & room, F.array(key(F.col("t"), "linear"), key(hold, "hold"))).when(F.col("_cut"), F.array(key(F.col("t"), "hold"))).otherwise(F.array(key(F.col("t"), "linear")))
    return rows.select("clip_id", "shot", F.explode(keys).alias("k"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y")).select("clip_id", "shot", "k.t", "x", "y", "k.easing")


def reframe_keyframes(path: DataFrame, velocity: float, acceleration: float, interval: float = INTERVAL_S, hold_gap: float = HOLD_GAP_S) -> DataFrame:
    """Keyframes that follow a subject's path (``clip_id, shot, t, cx, cy``): ``clip_id, shot, t, x, y, easing``."""
    return with_holds(sampled_path(path, (1.0, 1.0), velocity, acceleration, interval), hold_gap)


def clip_figures(path: DataFrame, cuts: DataFrame, samples: DataFrame, keys: DataFrame) -> DataFrame:
    """``clip_id, n_frames, n_face, n_saliency, n_held, n_cuts, n_keyframes`` (of x, y and scale), ``safe`` (share of samples) and ``mode``."""
    frames = path.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_frames"), F.count_if("face").alias("n_face"), F.count_if(~F.col("face")).alias("n_saliency"), F.count_if("held").alias("n_held"))
    rows = frames.join(cuts.groupBy("clip_id").agg(F.count_if("boundary").alias("n_cuts")), "clip_id").join(keys.groupBy("clip_id").agg((3 * F.count(F.lit(1))).alias("n_keyframes")), "clip_id")
    rows = rows.join(samples.groupBy("clip_id").agg(F.round(F.avg(F.col("safe").cast("double")), 6).alias("safe")), "clip_id")
    return rows.withColumn("mode", mode(F.col("n_face"), F.col("n_saliency")))


def mode(n_face: Column, n_saliency: Column) -> Column:
    return F.when((n_face > 0) & (n_saliency > 0), "mixed").when(n_face > 0, "face").otherwise("saliency")


def reframe(frames: DataFrame, faces: DataFrame, pixels: DataFrame, source_aspect: float, target_aspect: float, across: int = 16, threshold: float = SHOT_THRESHOLD) -> dict[str, DataFrame]:
    """The whole job: ``path``, ``keyframes`` and ``figures`` of all clips.

    ``frames``: ``clip_id, frame_id, t`` (seconds into the clip, one row a sampled frame); ``faces``: boxes by ``frame_id`` (may be
    empty: saliency alone); ``pixels``: ``frame_id, x, y, r, g, b``.
    """
    cuts = shots(frames, pixels, threshold)
    path = tracked(detections(cuts, faces, pixels, across))
    samples = sampled_path(path.withColumnRenamed("segment", "shot"), fill(source_aspect, target_aspect))
    keys = with_holds(samples)
    return {"path": path, "keyframes": keys, "figures": clip_figures(path, cuts, samples, keys)}

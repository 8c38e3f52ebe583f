"""The reframe job against plain Python, on planted shots and over the given tables."""

import math
import random

import pytest

from timeloom import plans
from timeloom.operators import reframe
from timeloom.operators.frames import salient_cells

SIZE, ACROSS = 16, 4


def plain_detection(boxes, cell):
    """The first face of the best score, else the salient cell, else the middle."""
    best = None
    for det, x, y, w, h, conf in sorted(boxes):
        if conf < 300:
            continue
        far = math.hypot((x + w / 2) / 500 - 1, (y + h / 2) / 500 - 1)
        score = round(0.45 * conf / 1000 + 0.25 * w * h / 1e6 + 0.2 * max(0.0, 1 - far), 6)
        if best is None or score > best[0]:
            best = (score, ((x + w / 2) / 1000, (y + h / 2) / 1000, w / 1000, h / 1000, True))
    if best:
        return best[1]
    return ((cell % ACROSS + 0.5) / ACROSS, (cell // ACROSS + 0.5) / ACROSS, 0.15, 0.15, False) if cell is not None else (0.5, 0.5, 0.15, 0.15, False)


def plain_overlap(a, b):
    left, right = max(a[0] - a[2] / 2, b[0] - b[2] / 2), min(a[0] + a[2] / 2, b[0] + b[2] / 2)
    top, bottom = max(a[1] - a[3] / 2, b[1] - b[3] / 2), min(a[1] + a[3] / 2, b[1] + b[3] / 2)
    if left >= right or top >= bottom:
        return 0.0
    both = (right - left) * (bottom - top)
    return both / (a[2] * a[3] + b[2] * b[3] - both)


class PlainFilter:
    def __init__(self):
        self.last = None

    def __call__(self, value, t):
        if self.last is None:
            self.last, self.speed, self.t = value, 0.0, t
        else:
            dt = t - self.t
            weight = lambda cutoff: 1 / (1 + (1 / (2 * math.pi * cutoff)) / dt)
            a = weight(1.0)
            self.speed = a * (value - self.last) / dt + (1 - a) * self.speed
            b = weight(1.0 + 0.007 * abs(self.speed))
            self.last, self.t = b * value + (1 - b) * self.last, t
        return self.last


def plain_job(frames, rect):
    """``frames``: (frame_id, t, colour histogram, boxes, salient cell) of one clip, in order."""
    path, before, figures = [], None, {"n_face": 0, "n_saliency": 0, "n_held": 0, "n_cuts": 0}
    segment = 0
    for k, (frame, t, hist, boxes, cell) in enumerate(frames):
        found = plain_detection(boxes, cell)
        figures["n_face" if found[4] else "n_saliency"] += 1
        cut = before is not None and sum((hist.get(c, 0) - before.get(c, 0)) ** 2 / (hist.get(c, 0) + before.get(c, 0)) for c in {*hist, *before}) / sum(hist.values()) > 0.5
        if cut or before is None:
            subject, seen, fx, fy = None, None, PlainFilter(), PlainFilter()
        if cut:
            figures["n_cuts"] += 1
            segment += k < len(frames) - 1
        if subject is None or (found[4] and not subject[4]) or plain_overlap(subject, found) >= 0.3 or t - seen > 1:
            subject, seen = found, t
        else:
            figures["n_held"] += 1
        path.append((segment, t, fx(subject[0], t) - 0.5, fy(subject[1], t) - 0.5))
        before = hist
    keys, safe, samples = [], 0, 0
    segments = sorted({p[0] for p in path})
    for s in segments:
        own = [p for p in path if p[0] == s]
        start, end, times = own[0][1], own[-1][1], [own[0][1]]
        k = 1
        while start + 0.5 * k < end - 1e-6:
            times.append(start + 0.5 * k)
            k += 1
        if end - start > 1e-6:
            times.append(end)

        def value(t, c):
            for a, b in zip(own, own[1:]):
                if a[1] <= t <= b[1]:
                    return a[c] + (b[c] - a[c]) * (t - a[1]) / (b[1] - a[1])
            return own[0][c]

        raw = [[-value(t, c) * rect[c - 2] for t in times] for c in (2, 3)]
        moved = []
        for values in raw:
            out = list(values)
            for i in range(1, len(out)):
                dt = times[i] - times[i - 1]
                if abs(out[i] - out[i - 1]) > 0.3 * dt:
                    out[i] = out[i - 1] + math.copysign(0.3 * dt, out[i] - out[i - 1])
            for i in range(2, len(out)):
                d1, d2 = times[i - 1] - times[i - 2], times[i] - times[i - 1]
                v1, v2 = (out[i - 1] - out[i - 2]) / d1, (out[i] - out[i - 1]) / d2
                if abs(v2 - v1) > 0.5 * d2:
                    out[i] = out[i - 1] + (v1 + math.copysign(0.5 * d2, v2 - v1)) * d2
            moved.append(out)
        samples += len(times)
        safe += sum(abs(moved[0][i] - raw[0][i]) <= 0.45 and abs(moved[1][i] - raw[1][i]) <= 0.45 for i in range(len(times)))
        own_keys = [[times[i], moved[0][i], moved[1][i], "linear"] for i in range(len(times))]
        if s != segments[-1]:
            hold = min(p[1] for p in path if p[0] > s) - 1e-3
            if hold > times[-1] + 1e-6:
                own_keys.append([hold, moved[0][-1], moved[1][-1], "hold"])
            else:
                own_keys[-1][3] = "hold"
        keys += own_keys
    figures |= {"n_frames": len(frames), "n_keyframes": 3 * len(keys), "safe": round(safe / samples, 6), "mode": "mixed" if figures["n_face"] and figures["n_saliency"] else "face" if figures["n_face"] else "saliency"}
    return keys, figures


def planted():
    """Clips with cuts (one at the last frame), moving, lost and no faces, salient spots, a single frame."""
    rng, frames, boxes, pixels = random.Random(5), [], [], []
    shades = [0.1, 0.45, 0.8]
    for clip, n in enumerate((24, 17, 1, 12)):
        shade, x = 0, 300
        for k in range(n):
            frame = clip * 100 + k
            frames.append((clip, frame, k * 0.5 + (0.1 if clip == 1 and k == 3 else 0)))
            if k in (7, 15) or (clip == 3 and k == n - 1):
                shade, x = (shade + 1) % 3, rng.randrange(50, 700)
            x = max(0, min(700, x + rng.randrange(-90, 90)))
            if clip != 3 and k % 6 != 5:
                boxes.append((frame, frame * 10, x, 300, 250, 300, 900))
                boxes.append((frame, frame * 10 + 1, rng.randrange(700), 100, 200, 200, rng.choice([200, 500, 950])))
            cell = (k // 4 * 5 + clip) % 16
            for p in range(SIZE * SIZE):
                px, py = p % SIZE, p // SIZE
                spot = px // 4 + py // 4 * 4 == cell
                pixels.append((frame, px, py, *((0.85, 0.6, 0.5) if spot else (shades[shade],) * 3)))
    return frames, boxes, pixels


def of_each_clip(frames, boxes, pixels, cells):
    hist, by_frame, clips = {}, {}, {}
    for frame, _, _, *colour in pixels:
        key = tuple(math.floor(max(0.0, min(0.9999, c)) * 8) for c in colour)
        own = hist.setdefault(frame, {})
        own[key] = own.get(key, 0) + 1
    for frame, *box in boxes:
        by_frame.setdefault(frame, []).append(tuple(box))
    for clip, frame, t in sorted(frames, key=lambda r: (r[0], r[2], r[1])):
        clips.setdefault(clip, []).append((frame, t, hist[frame], by_frame.get(frame, []), cells.get(frame)))
    return clips


def compare(made, clips, rect):
    figures = {r.clip_id: r.asDict() for r in made["figures"].collect()}
    keys = {}
    for r in made["keyframes"].collect():
        keys.setdefault(r.clip_id, []).append((r.t, r.x, r.y, r.easing))
    assert set(figures) == set(clips)
    for clip, frames in clips.items():
        want_keys, want = plain_job(frames, rect)
        assert figures[clip] == want | {"clip_id": clip}
        own = sorted(keys[clip])
        assert [k[3] for k in own] == [k[3] for k in want_keys]
        assert all(a == pytest.approx(b, abs=2e-6) for g, w in zip(own, want_keys) for a, b in zip(g[:3], w[:3]))


def test_planted_shots(spark):
    frames, boxes, pixels = planted()
    f = spark.createDataFrame(frames, "clip_id long, frame_id long, t double").repartition(3)
    b = spark.createDataFrame(boxes, "frame_id long, det_id long, x_milli long, y_milli long, w_milli long, h_milli long, conf_milli long")
    p = spark.createDataFrame(pixels, "frame_id long, x int, y int, r double, g double, b double")
    cells = {r.frame_id: r.cell for r in salient_cells(p, ACROSS).collect()}
    rect = (16 / 9 / (9 / 16), 1.0)
    clips = of_each_clip(frames, boxes, pixels, cells)
    compare(reframe.reframe(f, b, p, 16 / 9, 9 / 16, ACROSS), clips, rect)
    got = {r.clip_id: r for r in reframe.reframe(f, b, p, 16 / 9, 9 / 16, ACROSS)["figures"].collect()}
    assert (got[0].n_cuts, got[3].n_cuts, got[3].mode, got[0].mode) == (2, 2, "saliency", "mixed") and got[0].n_held > 0
    # without faces, the salient spots lead
    alone = reframe.reframe(f, b.limit(0), p, 1.0, 2.0, ACROSS)
    compare(alone, of_each_clip(frames, [], pixels, cells), (1.0, 2.0))


def test_over_the_tables(spark):
    d = "/root/testdata/sf0.001"
    from timeloom.sources.views import view

    pixels, boxes = view(spark, d, "v_rgb"), view(spark, d, "v_detections")
    rows = [tuple(r) for r in pixels.select("frame_id", "x", "y", "r", "g", "b").collect()]
    cells = {r.frame_id: r.cell for r in salient_cells(pixels, 4).collect()}
    frames = [(i // 25, i, i % 25 / 2) for i in {r[0] for r in rows}]
    clips = of_each_clip(frames, [tuple(r) for r in boxes.select("frame_id", "det_id", "x_milli", "y_milli", "w_milli", "h_milli", "conf_milli").collect()], rows, cells)
    made = {name: plans.queries()[f"k8_reframe_{name}"](spark, d) for name in ("figures", "keyframes")}
    compare(made, clips, (16 / 9 / (9 / 16), 1.0))


def test_empty(spark):
    frames, boxes, pixels = (spark.createDataFrame([], s) for s in ("clip_id long, frame_id long, t double", "frame_id long, det_id long, x_milli long, y_milli long, w_milli long, h_milli long, conf_milli long", "frame_id long, x int, y int, r double, g double, b double"))
    assert all(df.count() == 0 for df in reframe.reframe(frames, boxes, pixels, 1.0, 1.0).values())

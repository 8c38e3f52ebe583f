"""Queries of the editing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeloom.operators import editing as op
from timeloom.operators import intervals as iv
from timeloom.operators import quality as qu
from timeloom.operators import cut_lists, mixdown, reframe
from timeloom.plans.timeline import PIECES, _locks
from timeloom.sources.views import sql_with, view


def _points(s, d):
    return view(s, d, "v_points").withColumn("t_ms", F.col("t_ms") * 7 % 700000)


POINTS = "p AS (SELECT point_id, project_id, t_ms * 7 % 700000 AS t_ms FROM v_points)"
KEYS = "k AS (SELECT project_id, start_ms AS key_ms, any_value(in_ms) AS value, CASE WHEN any_value(in_ms) % 3 = 0 THEN 'hold' WHEN any_value(in_ms) % 3 = 1 THEN 'smooth' ELSE 'linear' END AS easing FROM v_timeline WHERE track_no = 0 GROUP BY 1, 2)"


def _keys(s, d):
    return view(s, d, "v_timeline").filter("track_no = 0").select("project_id", F.col("start_ms").alias("key_ms"), F.col("in_ms").alias("value"), F.expr("CASE WHEN in_ms % 3 = 0 THEN 'hold' WHEN in_ms % 3 = 1 THEN 'smooth' ELSE 'linear' END").alias("easing"))


def _tl(s, d):
    return view(s, d, "v_timeline")


def _tight(s, d):
    return view(s, d, "v_tight")


#: Cuts between clips that touch.
CUTS_AT = "tc AS (SELECT * FROM (SELECT project_id, track_no, clip_id AS from_clip, lead(clip_id) OVER w AS to_clip, lead(start_ms) OVER w AS cut, start_ms + dur_ms AS e FROM v_tight WINDOW w AS (PARTITION BY project_id, track_no ORDER BY start_ms, clip_id)) WHERE abs(cut - e) <= 1)"
LAYERS = f"{POINTS}, {CUTS_AT}, x AS MATERIALIZED (SELECT point_id, track_no, from_clip, to_clip, (t_ms - cut + 400) * 1000 // 800 AS m FROM tc JOIN p USING (project_id) WHERE t_ms >= cut - 400 AND t_ms < cut + 400), ly AS (SELECT point_id, track_no, clip_id, 'plain' AS role, 0 AS mix_milli FROM p JOIN v_tight c ON p.project_id = c.project_id AND start_ms <= t_ms AND t_ms < start_ms + dur_ms WHERE NOT EXISTS (SELECT 1 FROM x q WHERE q.point_id = p.point_id AND q.track_no = c.track_no) UNION ALL SELECT point_id, track_no, from_clip, 'out', m FROM x UNION ALL SELECT point_id, track_no, to_clip, 'in', m FROM x)"


def _timing(s, d):
    return view(s, d, "v_sources").select("source_id", F.expr("CASE WHEN source_id % 5 = 0 THEN NULL ELSE source_id % 40 END").alias("v_start"), F.expr("source_id % 60").alias("a_start"), F.expr("CASE WHEN source_id % 5 = 0 THEN NULL ELSE duration_ms END").alias("v_end"), F.expr("duration_ms - 100").alias("a_end"))


REQ = "q AS (SELECT source_id, source_id * 37 % 60000 - 500 AS t_ms, duration_ms, source_id % 900 AS track_start, duration_ms - source_id % 700 AS track_end, 50 + source_id % 150 AS speed_pct FROM v_sources)"


def _req(s, d):
    return view(s, d, "v_sources").selectExpr("source_id", "source_id * 37 % 60000 - 500 AS t_ms", "duration_ms", "source_id % 900 AS track_start", "duration_ms - source_id % 700 AS track_end", "50 + source_id % 150 AS speed_pct")


def _cuts(s, d):
    return op.cut_list(_tl(s, d), 25)


CUTS = "x AS (SELECT project_id, clip_id, CAST(floor(in_ms * 25 / 1000 + 0.5) AS BIGINT) AS src, CAST(floor(start_ms * 25 / 1000 + 0.5) AS BIGINT) AS rec, CAST(floor((start_ms + dur_ms) * 25 / 1000 + 0.5) AS BIGINT) AS e FROM v_timeline QUALIFY track_no = min(track_no) OVER (PARTITION BY project_id)), cl AS (SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY rec, clip_id) AS INTEGER) AS event, clip_id, src AS source_in, src + e - rec AS source_out, rec + 90000 AS record_in, e + 90000 AS record_out FROM x WHERE e > rec)"
TRACKS = "SELECT DISTINCT project_id, track_no FROM v_clips"

def _tc(c):
    return f"printf('%02d:%02d:%02d:%02d', {c} // 90000, {c} // 1500 % 60, {c} // 25 % 60, {c} % 25)"


def _cut_texts(s, d):
    t = _tl(s, d)
    sources = t.select("source_id").distinct().selectExpr("source_id", "concat('Clip-', source_id, '.mov') AS file_name")
    projects = t.select("project_id").distinct().selectExpr("project_id", "concat('Project ', project_id) AS name")
    return cut_lists.cut_list_text(t, sources, projects, 25, t.filter("track_no = 0").select("project_id", "track_no"))


def _locked_inserts(t):
    return t.select("project_id").distinct().selectExpr("project_id", "CAST(1 AS BIGINT) AS track_no", "-project_id AS clip_id", "CAST(project_id % 5 * 7000 + 500 AS BIGINT) AS start_ms", "CAST(6000 AS BIGINT) AS dur_ms")


def _mixed(s, d):
    """Sums of the channels of each block of the mix of tight tracks, 8 frames a second."""
    t = view(s, d, "v_tight")
    chunks = view(s, d, "v_chunks")
    n = chunks.agg(F.max("source_id") + 1).first()[0]
    clips = t.selectExpr("*", "in_ms % 3 * 500 AS fade_in_ms", "in_ms % 4 * 250 AS fade_out_ms").withColumn("source_id", F.col("source_id") % n)
    tracks = t.select("project_id", "track_no").distinct().selectExpr("*", "'audio' AS type", "0.5D + track_no / 4 AS gain", "(track_no - 1) / 2 AS pan", "(project_id + track_no) % 7 = 0 AS muted", "project_id % 5 = 0 AND track_no = 1 AS solo")
    masters = t.select("project_id").distinct().selectExpr("project_id", "0.3D + project_id % 4 / 2 AS master_gain")
    cuts = op.touching_cuts(t.filter("track_no = 0")).select("project_id", "track_no", "from_clip", "to_clip", F.lit(1000).cast("long").alias("dur_ms"))
    mix = mixdown.mix_down(clips, tracks, masters, chunks, cuts, rate=8, channels=2, block=256)
    total = lambda side: F.round(F.aggregate(F.filter("samples", lambda _, i: i % 2 == side), F.lit(0.0), lambda a, x: a + x), 3)
    return mix.select("project_id", "block", F.size("samples").cast("long").alias("n_samples"), total(0).alias("left_sum"), total(1).alias("right_sum"))


def _reframed(s, d):
    """The frames of a clip are 25 ids, two a second."""
    pixels = view(s, d, "v_rgb")
    frames = pixels.select("frame_id").distinct().selectExpr("frame_id div 25 AS clip_id", "frame_id", "frame_id % 25 / 2D AS t")
    return reframe.reframe(frames, view(s, d, "v_detections"), pixels, 16 / 9, 9 / 16, 4)


PLANS = {
    "c10_sampled_keyframes": (lambda s, d: op.sampled_keyframes(_points(s, d), _keys(s, d), 100), ["v_points", "v_timeline"],
        f"WITH {POINTS}, {KEYS}, j AS (SELECT p.*, a.key_ms AS ta, a.value AS va, a.easing AS e FROM p ASOF LEFT JOIN k a ON p.project_id = a.project_id AND a.key_ms <= p.t_ms), n AS (SELECT j.*, b.key_ms AS tb, b.value AS vb FROM j ASOF LEFT JOIN k b ON j.project_id = b.project_id AND b.key_ms >= j.t_ms), u AS (SELECT *, (t_ms - ta)::DOUBLE / nullif(tb - ta, 0) AS t FROM n) SELECT point_id, project_id, t_ms, round(CASE WHEN va IS NULL AND vb IS NULL THEN 100.0 WHEN va IS NULL THEN vb WHEN vb IS NULL OR ta = tb THEN va ELSE va + (vb - va) * CASE e WHEN 'hold' THEN 0.0 WHEN 'smooth' THEN t * t * (3 - 2 * t) ELSE t END END, 6) AS value FROM u"),
    "c3_transitions_at": (lambda s, d: op.transitions_at(_points(s, d), _tight(s, d), 800), ["v_points", "v_tight"],
        f"WITH {POINTS}, {CUTS_AT} SELECT point_id, track_no, from_clip, to_clip, (t_ms - cut + 400) * 1000 // 800 AS mix_milli FROM tc JOIN p USING (project_id) WHERE t_ms >= cut - 400 AND t_ms < cut + 400"),
    "c3_layers_at": (lambda s, d: op.layers_at(_points(s, d), _tight(s, d), 800), ["v_points", "v_tight"], f"WITH {LAYERS} SELECT * FROM ly"),
    "c4_shared_source_layers": (lambda s, d: (lambda t: op.shared_source_layers(op.layers_at(_points(s, d), t, 800), t))(_tight(s, d).withColumn("source_id", F.col("source_id") % 5)), ["v_points", "v_tight"],
        f"WITH {LAYERS}, n AS (SELECT ly.*, source_id % 5 AS source_id FROM ly JOIN v_tight USING (clip_id)) SELECT point_id, i.track_no, i.clip_id, i.source_id FROM n i JOIN n o USING (point_id) WHERE i.track_no = o.track_no AND i.role = 'in' AND o.role = 'out' AND i.source_id = o.source_id"),
    "c19_boundary_guard": (lambda s, d: op.boundary_guard(_points(s, d).select("project_id", F.col("point_id").alias("pair_id"), F.col("t_ms").alias("from_ms"), (F.col("t_ms") + 1500).alias("to_ms")), _tl(s, d).filter("track_no = 1").select("project_id", F.col("start_ms").alias("t_ms"))), ["v_points", "v_timeline"],
        f"WITH {POINTS}, b AS (SELECT DISTINCT project_id, start_ms AS h FROM v_timeline WHERE track_no = 1) SELECT point_id AS pair_id, coalesce(min(h), -1) AS boundary_ms FROM p LEFT JOIN b ON p.project_id = b.project_id AND h > t_ms AND h <= t_ms + 1500 GROUP BY 1"),
    "b8_normalised_timing": (lambda s, d: op.normalised_timing(_timing(s, d)), ["v_sources"],
        "SELECT source_id, least(v, a) AS start_ms, greatest(w, b) AS end_ms, coalesce(a - v, 0) AS offset_ms FROM (SELECT source_id, CASE WHEN source_id % 5 = 0 THEN NULL ELSE source_id % 40 END AS v, source_id % 60 AS a, CASE WHEN source_id % 5 = 0 THEN NULL ELSE duration_ms END AS w, duration_ms - 100 AS b FROM v_sources)"),
    "b9_availability": (lambda s, d: op.availability(_req(s, d)), ["v_sources"], f"WITH {REQ} SELECT source_id, t_ms, CASE WHEN t_ms < 0 OR t_ms >= duration_ms THEN 'outside-source' WHEN t_ms < track_start THEN 'before-track-start' WHEN t_ms >= track_end THEN 'after-track-end' ELSE 'none' END AS why FROM q"),
    "b10_silence_frames": (lambda s, d: op.silence_frames(_req(s, d), 48), ["v_sources"], f"WITH {REQ} SELECT source_id, t_ms, CAST(greatest(0, ceil((track_start - t_ms) * 4800 / (speed_pct * 1000))) AS BIGINT) AS until_start, CAST(greatest(0, ceil((track_end - t_ms) * 4800 / (speed_pct * 1000))) AS BIGINT) AS until_end FROM q"),
    "b11_cleaned_substitutes": (lambda s, d: op.cleaned_substitutes(view(s, d, "v_clips"), view(s, d, "v_sources").filter("source_id % 3 = 0").selectExpr("source_id", "source_id + 5000000 AS asset_id", "source_id % 2000 AS from_ms", "source_id % 2000 + 40000 AS to_ms")), ["v_clips", "v_sources"],
        "WITH a AS (SELECT source_id, source_id + 5000000 AS asset_id, source_id % 2000 AS f, source_id % 2000 + 40000 AS t FROM v_sources WHERE source_id % 3 = 0) SELECT clip_id, CASE WHEN f <= in_ms AND t >= in_ms + dur_ms THEN asset_id ELSE source_id END AS used_id, asset_id IS NOT NULL AND NOT coalesce(f <= in_ms AND t >= in_ms + dur_ms, false) AS missing FROM v_clips LEFT JOIN a USING (source_id)"),
    "b12_colour_class": (lambda s, d: op.colour_class(view(s, d, "v_sources").selectExpr("source_id", "CASE source_id % 4 WHEN 0 THEN 'pq' WHEN 1 THEN 'hlg' WHEN 2 THEN 'bt709' END AS transfer", "CASE WHEN source_id % 7 = 0 THEN 'bt2020' ELSE 'bt709' END AS primaries")), ["v_sources"], "SELECT source_id, source_id % 4 < 2 AS hdr, CASE WHEN source_id % 4 < 2 THEN 'rec2100' WHEN source_id % 7 = 0 THEN 'rec2020' ELSE 'rec709' END AS space FROM v_sources"),
    "b15_patched": (lambda s, d: op.patched(view(s, d, "v_clips"), view(s, d, "v_clips").filter("clip_id % 5 = 0").selectExpr("clip_id", "CASE WHEN in_ms % 2 = 0 THEN in_ms % 900 END AS gain", "in_ms * 3 AS fade_ms")), ["v_clips"], "SELECT clip_id, CASE WHEN clip_id % 5 = 0 AND in_ms % 2 = 0 THEN least(400, in_ms % 900) ELSE 100 END AS gain, CASE WHEN clip_id % 5 = 0 THEN least(dur_ms // 2, in_ms * 3) ELSE 0 END AS fade_ms FROM v_clips"),
    "g4_overwritten": (lambda s, d: (lambda t: (lambda r, n: op.overwritten(t, n, iv.lift(t, r)))(t.select("project_id").distinct().selectExpr("project_id", "project_id * 100 AS cut_start", "project_id * 100 + 9000 AS cut_end"), t.select("project_id").distinct().selectExpr("project_id", "CAST(0 AS BIGINT) AS track_no", "-project_id AS clip_id", "project_id * 100 AS start_ms", "CAST(9000 AS BIGINT) AS dur_ms")))(_tl(s, d)), ["v_timeline"],
        "WITH x AS (SELECT *, project_id * 100 AS a, project_id * 100 + 9000 AS b, start_ms + dur_ms AS e FROM v_timeline) SELECT project_id, track_no, clip_id, start_ms, dur_ms FROM x WHERE NOT (start_ms < b AND a < e) UNION ALL SELECT project_id, track_no, clip_id, start_ms, a - start_ms FROM x WHERE start_ms < a AND a < e UNION ALL SELECT project_id, track_no, clip_id, b, e - b FROM x WHERE start_ms < b AND b < e UNION ALL SELECT DISTINCT project_id, 0, -project_id, a, 9000 FROM x"),
    "g10_rolled": (lambda s, d: op.rolled(_tight(s, d), -1500), ["v_tight"], "SELECT clip_id, tc AS to_clip, dur_ms - 1500 AS dur_ms, ts - 1500 AS to_start, td + 1500 AS to_dur, ti - 1500 AS to_in FROM (SELECT *, lead(clip_id) OVER w AS tc, lead(start_ms) OVER w AS ts, lead(dur_ms) OVER w AS td, lead(in_ms) OVER w AS ti FROM v_tight WINDOW w AS (PARTITION BY project_id, track_no ORDER BY start_ms, clip_id)) WHERE abs(ts - (start_ms + dur_ms)) <= 1 AND dur_ms > 1500 AND ti >= 1500"),
    "g10_slipped": (lambda s, d: op.slipped(_tl(s, d), 2500, 50000), ["v_timeline"], "SELECT * FROM (SELECT clip_id, in_ms, greatest(0, least(in_ms + 2500, 50000 - dur_ms)) AS new_in FROM v_timeline) WHERE in_ms <> new_in"),
    "g11_moved_batches": (lambda s, d: op.moved_batches(_tl(s, d), _tl(s, d).filter("clip_id % 4001 = 0").selectExpr("clip_id", "CAST(800 AS BIGINT) AS by_ms")), ["v_timeline"], "WITH m AS (SELECT *, start_ms + CASE WHEN clip_id % 4001 = 0 THEN 800 ELSE 0 END AS t FROM v_timeline), b AS (SELECT *, t < 0 OR coalesce(t < lag(t + dur_ms) OVER (PARTITION BY project_id, track_no ORDER BY t, clip_id), false) AS bad FROM m), a AS (SELECT *, bool_or(bad) OVER (PARTITION BY project_id) AS y FROM b) SELECT project_id, clip_id, CASE WHEN y THEN start_ms ELSE t END AS start_ms, NOT y AS accepted FROM a"),
    "g13_beat_splits": (lambda s, d: op.beat_splits(_tl(s, d), _points(s, d), 9000), ["v_points", "v_timeline"],
        f"WITH RECURSIVE {POINTS}, o AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY t_ms) AS k FROM (SELECT DISTINCT clip_id, start_ms AS s, start_ms + dur_ms AS e, t_ms FROM p JOIN v_timeline c ON p.project_id = c.project_id AND t_ms >= start_ms AND t_ms < start_ms + dur_ms)), f AS (SELECT clip_id, k, CASE WHEN j THEN t_ms ELSE s END AS l, j AS hit, t_ms FROM (SELECT *, t_ms - s >= 9000 AND e - t_ms >= 9000 AS j FROM o WHERE k = 1) UNION ALL SELECT o.clip_id, o.k, CASE WHEN o.t_ms - f.l >= 9000 AND o.e - o.t_ms >= 9000 THEN o.t_ms ELSE f.l END, o.t_ms - f.l >= 9000 AND o.e - o.t_ms >= 9000, o.t_ms FROM f JOIN o ON o.clip_id = f.clip_id AND o.k = f.k + 1) SELECT clip_id, t_ms FROM f WHERE hit"),
    "g16_reordered_tracks": (lambda s, d: op.reordered_tracks(view(s, d, "v_clips").select("project_id", "track_no").distinct(), 3, 1), ["v_clips"], f"SELECT project_id, track_no, CAST(row_number() OVER (PARTITION BY project_id ORDER BY CASE track_no WHEN 3 THEN 0.5 ELSE track_no END) - 1 AS INTEGER) AS place FROM ({TRACKS})"),
    "g18_merged_sets": (lambda s, d: op.merged_sets(view(s, d, "v_clips"), ["project_id"], "source_id"), ["v_clips"], "SELECT project_id, string_agg(v, ',' ORDER BY v) AS items FROM (SELECT DISTINCT project_id, CAST(source_id AS VARCHAR) AS v FROM v_clips) GROUP BY 1"),
    "g19_retakes": (lambda s, d: op.retakes(view(s, d, "v_clips"), view(s, d, "v_sources").filter("source_id % 6 = 0").selectExpr("source_id", "source_id + 7000000 AS new_id", "duration_ms AS new_ms")), ["v_clips", "v_sources"], "SELECT clip_id, start_ms, source_id + 7000000 AS source_id, least(dur_ms, duration_ms) AS dur_ms FROM v_clips JOIN v_sources s USING (source_id) WHERE source_id % 6 = 0"),
    "a9_cut_list": (_cuts, ["v_timeline"], f"WITH {CUTS} SELECT * FROM cl"),
    "a9_cut_list_text": (lambda s, d: _cut_texts(s, d).selectExpr("project_id", "text", "warnings"), ["v_timeline"],
        f"WITH {CUTS}, l AS (SELECT cl.*, 'Clip-' || source_id || '.mov' AS f, 'CLIP' || source_id AS reel FROM cl JOIN (SELECT clip_id, any_value(source_id) AS source_id FROM v_timeline GROUP BY 1) c ON c.clip_id = cl.clip_id), t AS (SELECT project_id, string_agg(printf('%03d', event) || '  ' || rpad(reel, 8, ' ') || ' V     C        ' || {_tc('source_in')} || ' ' || {_tc('source_out')} || ' ' || {_tc('record_in')} || ' ' || {_tc('record_out')} || chr(10) || '* FROM CLIP NAME: ' || f, chr(10) ORDER BY event) AS b FROM l GROUP BY 1), n AS (SELECT project_id, count(DISTINCT track_no) AS k, min(track_no) AS m FROM v_timeline GROUP BY 1) SELECT t.project_id, 'TITLE: PROJECT ' || t.project_id || chr(10) || 'FCM: NON-DROP FRAME' || chr(10) || b || chr(10) AS text, concat_ws('; ', CASE WHEN k > 1 THEN 'EDL is single-track: ' || (k - 1) || ' other track(s) with clips were omitted.' END, CASE WHEN m = 0 THEN 'EDL export is cuts-only: transitions become straight cuts.' END) AS warnings FROM t JOIN n ON n.project_id = t.project_id"),
    "a11_cut_list_text_issues": (lambda s, d: cut_lists.cut_list_text_issues(_cut_texts(s, d).withColumn("text", F.expr("CASE WHEN project_id % 4 = 1 THEN replace(text, 'FCM: NON-DROP', 'FCM NON-DROP') WHEN project_id % 4 = 2 THEN replace(text, '005  ', '006  ') WHEN project_id % 4 = 3 THEN replace(text, '003  CLIP', '003  clip') ELSE text END")), 25), ["v_timeline"],
        f"WITH {CUTS}, n AS (SELECT project_id, max(event) AS n FROM cl GROUP BY 1) SELECT project_id, CAST(u.line_no AS INTEGER) AS line_no, u.issue FROM (SELECT project_id, unnest(CASE project_id % 4 WHEN 1 THEN [{{'line_no': 2, 'issue': 'frame-count-mode'}}] WHEN 2 THEN CASE WHEN n >= 6 THEN [{{'line_no': 11, 'issue': 'sequence'}}, {{'line_no': 13, 'issue': 'sequence'}}] WHEN n = 5 THEN [{{'line_no': 11, 'issue': 'sequence'}}] ELSE [] END WHEN 3 THEN CASE WHEN n >= 4 THEN [{{'line_no': 7, 'issue': 'grammar'}}, {{'line_no': 9, 'issue': 'sequence'}}] WHEN n = 3 THEN [{{'line_no': 7, 'issue': 'grammar'}}] ELSE [] END ELSE [] END) AS u FROM n)"),
    "a11_cut_list_issues": (lambda s, d: op.cut_list_issues(_cuts(s, d).filter("event % 50 <> 7").withColumn("source_out", F.col("source_out") + F.when(F.col("event") % 31 == 0, 2).otherwise(0))), ["v_timeline"],
        f"WITH {CUTS}, y AS (SELECT project_id, event, source_in, source_out + CASE WHEN event % 31 = 0 THEN 2 ELSE 0 END AS so, record_in, record_out FROM cl WHERE event % 50 <> 7), z AS (SELECT *, lag(event) OVER w AS le, lag(record_out) OVER w AS lr FROM y WINDOW w AS (PARTITION BY project_id ORDER BY event)) SELECT project_id, event, 'sequence' AS issue FROM z WHERE event <> coalesce(le, 0) + 1 UNION ALL SELECT project_id, event, 'duration' FROM z WHERE so - source_in <> record_out - record_in UNION ALL SELECT project_id, event, 'record-order' FROM z WHERE record_in < lr"),
    "a10_gapped_sequence": (lambda s, d: op.gapped_sequence(_tl(s, d)), ["v_timeline"],
        "WITH g AS (SELECT *, start_ms - coalesce(lag(start_ms + dur_ms) OVER w, 0) AS gap FROM v_timeline WINDOW w AS (PARTITION BY project_id, track_no ORDER BY start_ms, clip_id)), c AS (SELECT project_id, track_no, start_ms, 'clip' AS kind, clip_id, dur_ms FROM g UNION ALL SELECT project_id, track_no, start_ms - gap, 'gap', -1, gap FROM g WHERE gap > 0) SELECT project_id, track_no, row_number() OVER (PARTITION BY project_id, track_no ORDER BY start_ms) - 1 AS n, kind, clip_id, dur_ms FROM c"),
    "e25_smoothed": (lambda s, d: op.smoothed(view(s, d, "v_pcm").selectExpr("source_id AS key", "CAST(i + i div 20 * 5 AS BIGINT) AS t", "x_milli AS value"), 0.25, 3), ["v_pcm"], None),
    "e26_tracked_subjects": (lambda s, d: op.tracked_subjects(view(s, d, "v_detections").withColumns({"shot": F.expr("frame_id div 40"), "face": F.expr("conf_milli >= 400")})), ["v_detections"], None),
    "h20_slow_motion": (lambda s, d: op.slow_motion_instants(_tl(s, d), 5000, 4, 2), ["v_timeline"], "SELECT clip_id, CAST(s AS BIGINT) AS interval, CAST(k AS INTEGER) AS k, s * 5000 + k * 5000 // 4 AS t_ms FROM (SELECT clip_id, unnest(range(dur_ms // 5000)) AS s FROM v_timeline), range(1, 3) AS r(k)"),
    "d23_mixed_blocks": (lambda s, d: op.mixed_blocks(view(s, d, "v_pcm"), view(s, d, "v_pcm").select("source_id").distinct().selectExpr("source_id", "source_id % 20 AS project_id", "50 + source_id % 100 AS gain_pct")), ["v_pcm"], "SELECT source_id % 20 AS project_id, CAST(i // 8 AS BIGINT) AS block, i % 8 AS place, greatest(-1000, least(1000, CAST(trunc(sum(x_milli * (50 + source_id % 100)) / 100) AS BIGINT))) AS x_milli FROM v_pcm GROUP BY 1, 2, 3"),
    "k4_down_mixed": (lambda s, d: op.down_mixed(view(s, d, "v_pcm").groupBy("source_id", F.expr("i div 2").alias("n")).agg(F.max(F.expr("CASE WHEN i % 2 = 0 THEN x_milli END")).alias("l"), F.max(F.expr("CASE WHEN i % 2 = 1 THEN x_milli END")).alias("r"))), ["v_pcm"], "SELECT a.source_id, CAST(a.i // 2 AS BIGINT) AS n, round((a.x_milli + b.x_milli) / 2, 6) AS mean, round((a.x_milli + b.x_milli) / sqrt(2.0), 6) AS asr FROM v_pcm a JOIN v_pcm b ON a.source_id = b.source_id AND b.i = a.i + 1 AND a.i % 2 = 0"),
    "c5_active_captions": (lambda s, d: op.active_at(_points(s, d), _tl(s, d).filter("track_no = 2").select("project_id", F.col("clip_id").alias("seg_id"), "start_ms", "dur_ms")), ["v_points", "v_timeline"], f"WITH {POINTS} SELECT point_id, clip_id AS seg_id FROM p JOIN v_timeline c ON p.project_id = c.project_id AND track_no = 2 AND start_ms <= t_ms AND t_ms < start_ms + dur_ms"),
    "c11_lut_lookup": (lambda s, d: op.lut_lookup(_points(s, d), _keys(s, d)), ["v_points", "v_timeline"],
        f"WITH {POINTS}, {KEYS}, j AS (SELECT p.*, a.key_ms AS ta, a.value AS va FROM p ASOF LEFT JOIN k a ON p.project_id = a.project_id AND a.key_ms <= p.t_ms), n AS (SELECT j.*, b.key_ms AS tb, b.value AS vb FROM j ASOF LEFT JOIN k b ON j.project_id = b.project_id AND b.key_ms >= j.t_ms) SELECT * FROM (SELECT point_id, round(CASE WHEN va IS NULL THEN vb WHEN vb IS NULL OR ta = tb THEN va ELSE va + (vb - va) * (t_ms - ta)::DOUBLE / (tb - ta) END, 6) AS value FROM n) WHERE value IS NOT NULL"),
    "e20_remap_table": (lambda s, d: op.remap_table(_keys(s, d).selectExpr("project_id", "key_ms", "50 + value % 100 AS speed_pct", "CAST(300000 AS BIGINT) AS source_ms"), 500), ["v_timeline"],
        f"WITH {KEYS}, q AS (SELECT project_id, n, h, n * 500 + h * 250 AS t_ms FROM (SELECT DISTINCT project_id FROM k), range(2401) AS r(n), range(3) AS z(h)), j AS (SELECT q.*, a.key_ms AS ta, 50 + a.value % 100 AS va FROM q ASOF LEFT JOIN k a ON q.project_id = a.project_id AND a.key_ms <= q.t_ms), m AS (SELECT j.*, b.key_ms AS tb, 50 + b.value % 100 AS vb FROM j ASOF LEFT JOIN k b ON j.project_id = b.project_id AND b.key_ms >= j.t_ms), v AS (SELECT project_id, n, h, round(CASE WHEN va IS NULL THEN vb WHEN vb IS NULL OR ta = tb THEN va ELSE va + (vb - va) * (t_ms - ta)::DOUBLE / (tb - ta) END, 6) AS v FROM m), st AS (SELECT project_id, n, sum(CASE h WHEN 1 THEN 4 ELSE 1 END * v) * 500 / 600.0 AS d FROM v GROUP BY 1, 2), u AS (SELECT *, sum(d) OVER (PARTITION BY project_id ORDER BY n) AS a FROM st) SELECT project_id, n, round(least(a, 300000.0) + 1e-7, 3) AS source_at FROM u WHERE a - d < 300000"),
    "e21_normalised_keyframes": (lambda s, d: op.normalised_keyframes(view(s, d, "v_clips").selectExpr("project_id", "clip_id AS ord", "start_ms AS key_ms", "in_ms AS value"), 100000), ["v_clips"], "SELECT project_id, clip_id AS ord, start_ms AS key_ms, in_ms AS value FROM v_clips QUALIFY row_number() OVER (PARTITION BY project_id, start_ms // 100000 ORDER BY clip_id DESC) = 1"),
    "g8_silence_cuts": (lambda s, d: op.silence_cuts(_tl(s, d), view(s, d, "v_regions")), ["v_timeline", "v_regions"],
        f"WITH {PIECES.format('true')} SELECT project_id, track_no, clip_id, piece_no, s - g AS start_ms, d AS dur_ms FROM (SELECT *, CAST(coalesce(sum(CASE WHEN inside THEN d ELSE 0 END) OVER (PARTITION BY project_id, track_no ORDER BY s, clip_id, piece_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS g FROM pp) WHERE NOT inside"),
    "d21_reframe_stats": (lambda s, d: op.reframe_stats(view(s, d, "v_detections").selectExpr("frame_id div 10 AS shot", "CASE WHEN conf_milli >= 400 THEN 'face' WHEN frame_id % 30 < 20 THEN 'saliency' ELSE 'none' END AS kind", "x_milli BETWEEN 100 AND 700 AS safe")), ["v_detections"], "SELECT shot, n, n_face, n_saliency, s * 100 // n AS safe_pct, CASE WHEN n_saliency = 0 THEN 'face' WHEN n_face = 0 THEN 'saliency' ELSE 'mixed' END AS mode FROM (SELECT frame_id // 10 AS shot, count(*) AS n, count(*) FILTER (WHERE conf_milli >= 400) AS n_face, count(*) FILTER (WHERE conf_milli < 400 AND frame_id % 30 < 20) AS n_saliency, count(*) FILTER (WHERE x_milli BETWEEN 100 AND 700) AS s FROM v_detections GROUP BY 1)"),
    "f6_weighted_picks": (lambda s, d: op.weighted_picks(view(s, d, "v_detections").selectExpr("*", "frame_id div 50 AS track", "det_id % 3 AS face_id")), ["v_detections"], None),
    "f6_face_scores": (lambda s, d: op.face_scores(view(s, d, "v_detections")).select("frame_id", "det_id", "score"), ["v_detections"], "SELECT frame_id, det_id, round(0.45::DOUBLE * conf_milli / 1000 + 0.25::DOUBLE * w_milli * h_milli / 1000000 + 0.2::DOUBLE * greatest(0.0, 1 - sqrt(power((x_milli + 150.0::DOUBLE) / 500 - 1, 2) + power((y_milli + 150.0::DOUBLE) / 500 - 1, 2))), 6) AS score FROM v_detections WHERE conf_milli >= 300"),
    "g14_beat_aligned": (lambda s, d: op.beat_aligned(_tl(s, d), _points(s, d), F.expr("clip_id % 2 = 0")), ["v_points", "v_timeline"], None),
    "e23_reframe_keyframes": (lambda s, d: reframe.reframe_keyframes(op.tracked_subjects(view(s, d, "v_detections").withColumns({"shot": F.expr("frame_id div 40"), "face": F.expr("conf_milli >= 400")})).join(view(s, d, "v_detections").select("det_id", "x_milli", "y_milli"), "det_id").selectExpr("shot div 4 AS clip_id", "shot", "frame_id / 10D AS t", "x_milli / 1000D AS cx", "y_milli / 1000D AS cy"), 0.5, 1.0), ["v_detections"], None),
    "d23_mixed_timeline": (_mixed, ["v_tight", "v_chunks"],
        "WITH n AS (SELECT max(source_id) + 1 AS n FROM v_chunks), x AS (SELECT source_id, unnest(range(len(samples))) + o AS i, unnest(samples) AS v FROM (SELECT source_id, samples, coalesce(sum(len(samples)) OVER (PARTITION BY source_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM v_chunks)), f AS MATERIALIZED (SELECT source_id, CAST(i // 2 AS BIGINT) AS j, sum(CASE WHEN i % 2 = 0 THEN v END) AS l, sum(CASE WHEN i % 2 = 1 THEN v END) AS r FROM x GROUP BY 1, 2), "
        "c0 AS (SELECT project_id, track_no, clip_id, source_id % n AS source_id, start_ms, dur_ms, in_ms, start_ms + dur_ms AS end_ms, in_ms % 3 * 500 AS fi, in_ms % 4 * 250 AS fo, lag(start_ms + dur_ms) OVER w AS pe, lead(start_ms) OVER w AS ns FROM v_tight, n WINDOW w AS (PARTITION BY project_id, track_no ORDER BY start_ms, clip_id)), "
        "c1 AS (SELECT *, track_no = 0 AND abs(start_ms - pe) <= 1 AS xi, track_no = 0 AND abs(ns - end_ms) <= 1 AS xo FROM c0 WHERE (project_id + track_no) % 7 <> 0 AND (track_no = 1 OR project_id % 5 <> 0 OR project_id % 5 = 0 AND NOT EXISTS (SELECT 1 FROM v_tight q WHERE q.project_id = c0.project_id AND q.track_no = 1))), "
        "c AS (SELECT *, CAST(floor((in_ms - start_ms) * 8 / 1000.0 + 0.5) AS BIGINT) AS sh, CASE WHEN xi THEN pe - 500 ELSE start_ms END AS fr, CASE WHEN xo THEN end_ms + 500 ELSE end_ms END AS til FROM c1), "
        "h AS (SELECT *, unnest(range(CAST(greatest(0, -sh, ceil(fr * 8 / 1000.0)) AS BIGINT), CAST(ceil(til * 8 / 1000.0) AS BIGINT))) AS k FROM c), "
        "y AS (SELECT h.project_id, h.k, l, r, track_no, (0.5::DOUBLE + track_no / 4) * CASE WHEN fi > 0 THEN greatest(0, least(1, (k * 125.0::DOUBLE - start_ms) / fi)) ELSE 1 END * CASE WHEN fo > 0 THEN greatest(0, least(1, (end_ms - k * 125.0::DOUBLE) / fo)) ELSE 1 END * CASE WHEN xi THEN sin(greatest(0, least(1, (k * 125.0::DOUBLE - pe + 500) / 1000)) * pi() / 2) ELSE 1 END * CASE WHEN xo THEN cos(greatest(0, least(1, (k * 125.0::DOUBLE - end_ms + 500) / 1000)) * pi() / 2) ELSE 1 END AS g FROM h JOIN f ON f.source_id = h.source_id AND f.j = h.k + h.sh), "
        "z AS (SELECT project_id, k, sum(l * g * least(1, 1 - (track_no - 1) / 2)) * (0.3::DOUBLE + project_id % 4 / 2) AS l, sum(r * g * least(1, 1 + (track_no - 1) / 2)) * (0.3::DOUBLE + project_id % 4 / 2) AS r FROM y GROUP BY 1, 2), "
        "e AS (SELECT project_id, CAST(ceil(max(start_ms + dur_ms) * 8 / 1000.0) AS BIGINT) AS total FROM v_tight GROUP BY 1), g AS (SELECT project_id, total, unnest(range((total - 1) // 256 + 1)) AS block FROM e), s AS (SELECT z.project_id, k // 256 AS block, sum(greatest(-1, least(1, l))) AS l, sum(greatest(-1, least(1, r))) AS r FROM z JOIN e USING (project_id) WHERE k < total GROUP BY 1, 2) "
        "SELECT g.project_id, g.block, 2 * least(256, total - g.block * 256) AS n_samples, round(coalesce(l, 0), 3) + 0.0::DOUBLE AS left_sum, round(coalesce(r, 0), 3) + 0.0::DOUBLE AS right_sum FROM g LEFT JOIN s ON s.project_id = g.project_id AND s.block = g.block"),
    "k8_reframe_figures": (lambda s, d: _reframed(s, d)["figures"], [], None),
    "k8_reframe_keyframes": (lambda s, d: _reframed(s, d)["keyframes"], [], None),
    "k8_reframe_counts": (lambda s, d: _reframed(s, d)["path"].groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_frames"), F.count_if("face").alias("n_face"), F.count_distinct("segment").alias("n_segments")), ["v_rgb", "v_detections"],
        "WITH f AS (SELECT DISTINCT frame_id FROM v_rgb), h AS (SELECT frame_id, floor(greatest(0, least(0.9999, r)) * 8) * 64 + floor(greatest(0, least(0.9999, g)) * 8) * 8 + floor(greatest(0, least(0.9999, b)) * 8) AS bin, count(*) AS n FROM v_rgb GROUP BY 1, 2), q AS (SELECT frame_id, frame_id // 25 AS clip_id, lag(frame_id) OVER (PARTITION BY frame_id // 25 ORDER BY frame_id) AS p, max(frame_id) OVER (PARTITION BY frame_id // 25) AS last FROM f), u AS (SELECT q.frame_id, bin, n AS a, 0 AS b FROM q JOIN h USING (frame_id) WHERE p IS NOT NULL UNION ALL SELECT q.frame_id, bin, 0, n FROM q JOIN h ON h.frame_id = q.p), w AS (SELECT frame_id, bin, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1, 2), x AS (SELECT frame_id, round(sum(power(a - b, 2) / (a + b)) / sum(a), 6) > 0.5 AS cut FROM w GROUP BY 1), g AS (SELECT DISTINCT frame_id FROM v_detections WHERE conf_milli >= 300) SELECT clip_id, count(*) AS n_frames, count(g.frame_id) AS n_face, 1 + count(*) FILTER (WHERE cut AND q.frame_id < last) AS n_segments FROM q LEFT JOIN x USING (frame_id) LEFT JOIN g USING (frame_id) GROUP BY clip_id"),
    "g4_overwritten_locked": (lambda s, d: (lambda t: op.overwritten(t, _locked_inserts(t), iv.lift(t, _locked_inserts(t).selectExpr("project_id", "start_ms AS cut_start", "start_ms + dur_ms AS cut_end"), F.expr("track_no = 1")), _locks(t)))(_tl(s, d)), ["v_timeline"],
        "WITH i AS (SELECT DISTINCT project_id, CAST(project_id % 5 * 7000 + 500 AS BIGINT) AS a, CAST(project_id % 5 * 7000 + 6500 AS BIGINT) AS b FROM v_timeline), c AS (SELECT t.*, start_ms + dur_ms AS e, a, b, t.project_id % 9 = 4 AND t.project_id % 4 = 1 AS lk FROM v_timeline t JOIN i USING (project_id)) SELECT project_id, track_no, clip_id, start_ms, dur_ms FROM c WHERE lk OR track_no <> 1 OR start_ms >= b OR e <= a UNION ALL SELECT project_id, track_no, clip_id, start_ms, a - start_ms FROM c WHERE NOT lk AND track_no = 1 AND start_ms < a AND e > a UNION ALL SELECT project_id, track_no, clip_id, b, e - b FROM c WHERE NOT lk AND track_no = 1 AND start_ms < b AND e > b UNION ALL SELECT project_id, 1, -project_id, a, 6000 FROM i WHERE NOT (project_id % 9 = 4 AND project_id % 4 = 1)"),
    "g10_slipped_in_sources": (lambda s, d: (lambda t: op.slipped(t, 2500, sources=t.select("source_id").distinct().selectExpr("source_id", "40000 + source_id % 30 * 1000 AS length_ms"), locks=_locks(t)))(_tl(s, d)), ["v_timeline"],
        "SELECT * FROM (SELECT clip_id, in_ms, greatest(0, least(in_ms + 2500, 40000 + source_id % 30 * 1000 - dur_ms)) AS new_in FROM v_timeline WHERE NOT (project_id % 9 = 4 AND track_no = project_id % 4)) WHERE in_ms <> new_in"),
    "c18_layer_matches": (lambda s, d: op.layer_matches(_tl(s, d).select("project_id").distinct().selectExpr("project_id", "explode(sequence(0, 7)) AS layer").selectExpr("project_id", "layer", "CAST(project_id * 3 + layer AS BIGINT) AS source_id", "CAST(layer % 4 AS BIGINT) AS track_no"), _tl(s, d)), ["v_timeline"],
        "WITH l AS (SELECT project_id, layer, project_id * 3 + layer AS source_id, layer % 4 AS track_no FROM (SELECT DISTINCT project_id FROM v_timeline), (SELECT CAST(range AS INTEGER) AS layer FROM range(8))), m AS (SELECT l.*, a FROM l LEFT JOIN (SELECT project_id, source_id, min(clip_id) AS a FROM v_timeline GROUP BY 1, 2) s ON s.project_id = l.project_id AND s.source_id = l.source_id), u AS (SELECT project_id, layer, track_no, row_number() OVER (PARTITION BY project_id, track_no ORDER BY layer) AS k FROM m WHERE a IS NULL), c AS (SELECT project_id, track_no, clip_id, row_number() OVER (PARTITION BY project_id, track_no ORDER BY clip_id) AS k FROM v_timeline) SELECT m.project_id, m.layer, coalesce(a, c.clip_id) AS clip_id, a IS NOT NULL AS by_source FROM m LEFT JOIN u ON u.project_id = m.project_id AND u.layer = m.layer LEFT JOIN c ON c.project_id = u.project_id AND c.track_no = u.track_no AND c.k = u.k WHERE coalesce(a, c.clip_id) IS NOT NULL"),
    "e24_one_euro": (lambda s, d: op.one_euro(view(s, d, "v_pcm").selectExpr("source_id AS key", "CAST(i AS BIGINT) AS t", "x_milli AS value")), ["v_pcm"], None),
    "b16_normalised_effects": (lambda s, d: op.normalised_effects(view(s, d, "v_clips").selectExpr("clip_id", "CASE WHEN in_ms % 3 = 0 THEN in_ms % 500 - 250 END AS brightness", "CASE WHEN in_ms % 2 = 0 THEN in_ms % 700 END AS contrast", "in_ms % 300 AS saturation", "CAST(NULL AS BIGINT) AS opacity")), ["v_clips"], "SELECT clip_id, greatest(-100, least(100, CASE WHEN in_ms % 3 = 0 THEN in_ms % 500 - 250 ELSE 0 END)) AS brightness, least(200, CASE WHEN in_ms % 2 = 0 THEN in_ms % 700 ELSE 100 END) AS contrast, least(200, in_ms % 300) AS saturation, 100 AS opacity FROM v_clips"),
    "c22_crossfade_gains": (lambda s, d: op.crossfade_gains(_points(s, d), _tight(s, d), 800), ["v_points", "v_tight"],
        f"WITH {LAYERS} SELECT point_id, track_no, from_clip, to_clip, round(cos(m / 1000.0 * pi() / 2), 6) AS out_gain, round(sin(m / 1000.0 * pi() / 2), 6) AS in_gain FROM x"),
    "c12_landmarks_at": (lambda s, d: op.landmarks_at(_points(s, d), _keys(s, d).select("project_id", "key_ms", F.array(F.col("value").cast("double"), F.col("value") * 2.0).alias("marks"))).select("point_id", F.get("marks", F.lit(0)).alias("x"), F.get("marks", F.lit(1)).alias("y")), ["v_points", "v_timeline"],
        f"WITH {POINTS}, {KEYS}, j AS (SELECT p.*, a.key_ms AS ta, a.value AS va FROM p ASOF LEFT JOIN k a ON p.project_id = a.project_id AND a.key_ms <= p.t_ms), n AS (SELECT j.*, b.key_ms AS tb, b.value AS vb FROM j ASOF LEFT JOIN k b ON j.project_id = b.project_id AND b.key_ms >= j.t_ms), v AS (SELECT point_id, CASE WHEN va IS NULL THEN vb WHEN vb IS NULL OR ta = tb THEN va ELSE va + (vb - va) * ((t_ms - ta)::DOUBLE / (tb - ta)) END AS x FROM n) SELECT point_id, round(x, 6) AS x, round(2 * x, 6) AS y FROM v WHERE x IS NOT NULL"),
    "a13_parse_bundles": (lambda s, d: qu.parse_bundles(view(s, d, "v_sources").selectExpr("source_id AS bundle_id", "CASE WHEN source_id % 9 = 0 THEN '{\"version\":1,\"ass' WHEN source_id % 9 = 1 THEN '{\"assets\":[{\"id\":\"a\",\"bytes\":1}]}' ELSE concat('{\"version\":1,\"assets\":[{\"id\":\"a', source_id, '\",\"bytes\":', byte_size, '},{\"bytes\":5},{\"id\":\"b\",\"bytes\":7,\"digest\":\"d\"}]}') END AS json")), ["v_sources"], "SELECT source_id AS bundle_id, 'a' || source_id AS asset_id, byte_size AS bytes, '' AS digest FROM v_sources WHERE source_id % 9 > 1 UNION ALL SELECT source_id, 'b', 7, 'd' FROM v_sources WHERE source_id % 9 > 1"),
}

def queries():
    return {name: query for name, (query, _, _) in PLANS.items()}


def oracle_sql():
    return {name: sql_with(reads, sql) for name, (_, reads, sql) in PLANS.items() if sql}

"""Queries of the signal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeloom.operators import audio as au
from timeloom.operators import frames as fr
from timeloom.operators import intervals as iv
from timeloom.operators import mixdown as mx
from timeloom.operators import signal as op
from timeloom.sources.views import sql_with, view

ENERGY = "b AS (SELECT source_id, i // 8 AS block, CAST(sum(x_milli * x_milli) AS BIGINT) AS s, count(*) AS n FROM v_pcm GROUP BY ALL), e AS (SELECT source_id, block, s + s2 AS sumsq FROM (SELECT *, lead(s) OVER w AS s2, lead(n) OVER w AS n2 FROM b WINDOW w AS (PARTITION BY source_id ORDER BY block)) WHERE n = 8 AND n2 = 8)"
QUIET = ENERGY + ", st AS (SELECT *, coalesce(last_value(CASE WHEN sumsq < 110 * 110 * 16 THEN 1 WHEN sumsq >= 135 * 135 * 16 THEN 0 END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY block ROWS UNBOUNDED PRECEDING), 0) AS o FROM e), isl AS (SELECT *, sum(CASE WHEN o <> w THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY block ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, coalesce(lag(o) OVER (PARTITION BY source_id ORDER BY block), 0) AS w FROM st)), q AS (SELECT * FROM (SELECT source_id, o, start_i, coalesce(lead(start_i) OVER (PARTITION BY source_id ORDER BY k), lst * 8 + 16) AS end_i, peak_sq FROM (SELECT source_id, k, max(o) AS o, min(block) * 8 AS start_i, max(block) AS lst, max(sumsq) AS peak_sq FROM isl GROUP BY source_id, k)) WHERE o = 1 AND end_i - start_i >= 16)"
PAD = QUIET + ", pd AS (SELECT source_id, start_i + 2 AS start_i, end_i - 2 AS end_i, peak_sq FROM q WHERE start_i + 2 < end_i - 2), pk AS (SELECT *, sum(CASE WHEN g IS NULL OR g >= 12 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY start_i ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, start_i - lag(end_i) OVER (PARTITION BY source_id ORDER BY start_i) AS g FROM pd)), m AS (SELECT source_id, min(start_i) AS start_i, max(end_i) AS end_i, max(peak_sq) AS peak_sq FROM pk GROUP BY source_id, k)"


def _quiet(s, d):
    return op.quiet_regions(op.windowed_energy(view(s, d, "v_pcm")), 8, 110, 135, 16)


def _padded(s, d):
    return op.padded_regions(_quiet(s, d), 2, 12)


def _common(s, d):
    rows = _padded(s, d).select((F.col("source_id") % 25).alias("project_id"), (F.expr("source_id div 25") % 2).alias("side"), F.col("start_i").alias("start_ms"), F.col("end_i").alias("end_ms"), F.col("peak_sq").alias("peak"))
    return iv.intersect_tracks(rows.filter("side = 0"), rows.filter("side = 1"), ["project_id"], 64)


def _silent_everywhere(s, d):
    """Tracks 0 to 2 of each project, 8 frames a second, samples in thousandths."""
    chunks = view(s, d, "v_chunks").withColumn("samples", F.transform("samples", lambda x: F.floor(x * 1000).cast("double")))
    n = chunks.agg(F.max("source_id") + 1).first()[0]
    clips = view(s, d, "v_timeline").withColumn("source_id", F.col("source_id") % n)
    return mx.common_silence(clips, clips.filter("track_no < 3").select("project_id", "track_no").distinct(), chunks, 8, 110, 135, 16, 2, 12, rate=8, block=1024)


def _times(s, d):
    return view(s, d, "v_events").select(F.col("session_id").alias("source_id"), F.col("t_us").alias("t"))


HOP_S = au.HOP / au.RATE
CANDIDATES = "cd AS (SELECT source_id, i, x FROM (SELECT *, avg(x) OVER (PARTITION BY source_id ORDER BY i ROWS 16 PRECEDING) AS a, max(x) OVER (PARTITION BY source_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM v_series) WHERE i >= 16 AND x > 1.3::DOUBLE * a AND x > 0.01::DOUBLE AND x >= m)"
TEMPOS = f"nn AS (SELECT source_id, count(*) AS n FROM v_series GROUP BY 1), ac AS (SELECT a.source_id, l.k AS k, round(CASE WHEN sqrt(sum(a.x * a.x) * sum(b.x * b.x)) > 0 THEN sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) ELSE 0 END, 9) AS r FROM v_series a CROSS JOIN range(28, 95) AS l(k) JOIN v_series b ON b.source_id = a.source_id AND b.i = a.i + l.k GROUP BY ALL), nb AS (SELECT *, lag(r) OVER w AS p, lead(r) OVER w AS q FROM ac WINDOW w AS (PARTITION BY source_id ORDER BY k)), bs AS (SELECT * FROM nb QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY r DESC, k) = 1), tm AS (SELECT source_id, CAST(k AS INTEGER) AS lag, n, round(greatest(60.0, least(200.0, 60 / ((k + CASE WHEN k > 28 AND k < least(94, n - 1) AND abs(p - 2 * r + q) > 1e-10 THEN greatest(-0.5, least(0.5, 0.5 * (p - q) / (p - 2 * r + q))) ELSE 0 END) * {HOP_S!r}::DOUBLE))), 4) AS bpm FROM bs JOIN nn USING (source_id))"


def _series(s, d):
    return view(s, d, "v_series")


def _long(s, d):
    return view(s, d, "v_chunks")


PLANS = {
    "e3_windowed_energy": (lambda s, d: op.windowed_energy(view(s, d, "v_pcm")), ["v_pcm"], f"WITH {ENERGY} SELECT * FROM e"),
    "e4_quiet_regions": (_quiet, ["v_pcm"], f"WITH {QUIET} SELECT source_id, start_i, end_i, peak_sq FROM q"),
    "e5_padded_regions": (_padded, ["v_pcm"], f"WITH {PAD} SELECT * FROM m"),
    "k7_common_silence": (_common, ["v_pcm"], f"WITH {PAD}, r AS (SELECT source_id % 25 AS project_id, source_id // 25 % 2 AS side, start_i, end_i, peak_sq FROM m) SELECT a.project_id, greatest(a.start_i, b.start_i) AS start_ms, least(a.end_i, b.end_i) AS end_ms, greatest(a.peak_sq, b.peak_sq) AS peak FROM r a JOIN r b ON a.project_id = b.project_id AND a.side = 0 AND b.side = 1 AND a.start_i < b.end_i AND b.start_i < a.end_i"),
    "k7_silent_everywhere": (_silent_everywhere, ["v_timeline", "v_chunks"],
        "WITH n AS (SELECT max(source_id) + 1 AS n FROM v_chunks), f AS MATERIALIZED (SELECT source_id, CAST(unnest(range(len(samples))) + o AS BIGINT) AS j, CAST(floor(unnest(samples) * 1000) AS BIGINT) AS v FROM (SELECT source_id, samples, coalesce(sum(len(samples)) OVER (PARTITION BY source_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM v_chunks)), c AS (SELECT project_id * 10 + track_no AS t, source_id % n AS source_id, start_ms, start_ms + dur_ms AS end_ms, CAST(floor((in_ms - start_ms) * 8 / 1000.0 + 0.5) AS BIGINT) AS sh FROM v_timeline, n WHERE track_no < 3), h AS (SELECT t, source_id, sh, unnest(range(CAST(greatest(0, -sh, ceil(start_ms * 8 / 1000.0)) AS BIGINT), CAST(ceil(end_ms * 8 / 1000.0) AS BIGINT))) AS k FROM c), e0 AS (SELECT t, CAST(ceil(max(end_ms) * 8 / 1000.0) AS BIGINT) AS total FROM c GROUP BY 1), trk AS MATERIALIZED (SELECT g.t AS source_id, g.k AS i, coalesce(v, 0) AS x_milli FROM (SELECT t, unnest(range(total)) AS k FROM e0) g LEFT JOIN h ON h.t = g.t AND h.k = g.k LEFT JOIN f ON f.source_id = h.source_id AND f.j = h.k + h.sh), "
        + PAD.replace("v_pcm", "trk") + ", r AS (SELECT source_id // 10 AS project_id, source_id % 10 AS track_no, start_i AS a, end_i AS b, peak_sq AS p FROM m), x AS (SELECT m.project_id, greatest(m.a, r.a) AS a, least(m.b, r.b) AS b, greatest(m.p, r.p) AS p FROM r m JOIN r ON r.project_id = m.project_id AND m.track_no = 0 AND r.track_no = 1 AND m.a < r.b AND r.a < m.b) SELECT x.project_id, CAST(round(greatest(x.a, r.a) * 125) AS BIGINT) AS start_ms, CAST(round(least(x.b, r.b) * 125) AS BIGINT) AS end_ms, greatest(x.p, r.p) AS peak FROM x JOIN r ON r.project_id = x.project_id AND r.track_no = 2 AND x.a < r.b AND r.a < x.b"),
    "d2_waveform_peaks": (lambda s, d: op.waveform_peaks(view(s, d, "v_pcm"), 10), ["v_pcm"],
        "SELECT source_id, ((i + 1) * k - 1) // n AS bucket, least(0, min(x_milli)) AS low, greatest(0, max(x_milli)) AS high FROM (SELECT *, greatest(8, least(10, n)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY source_id) AS n FROM v_pcm)) GROUP BY 1, 2"),
    "e7_block_loudness": (lambda s, d: op.block_loudness(view(s, d, "v_pcm")), ["v_pcm"],
        "WITH b AS (SELECT source_id, CAST(i // 4 AS BIGINT) AS block, sum(x_milli * x_milli) AS s FROM v_pcm GROUP BY ALL) SELECT source_id, block, round(-0.691 + 10 * log10(CAST(p AS DOUBLE) / 16000000.0), 6) AS loudness FROM (SELECT *, sum(s) OVER w AS p, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY source_id ORDER BY block ROWS 3 PRECEDING)) WHERE n = 4 AND p > 0"),
    "d8_integrated_loudness": (lambda s, d: op.integrated_loudness(op.block_loudness(view(s, d, "v_pcm"))), ["v_pcm"],
        "WITH b AS (SELECT source_id, i // 4 AS block, sum(x_milli * x_milli) AS s FROM v_pcm GROUP BY ALL), l AS (SELECT source_id, round(-0.691 + 10 * log10(CAST(p AS DOUBLE) / 16000000.0), 6) AS l FROM (SELECT *, sum(s) OVER w AS p, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY source_id ORDER BY block ROWS 3 PRECEDING)) WHERE n = 4 AND p > 0), g AS (SELECT source_id, 10 * log10(avg(pow(10.0, l / 10))) - 10 AS g FROM l WHERE l >= -70 GROUP BY 1), k AS (SELECT source_id, round(10 * log10(avg(pow(10.0, l / 10))), 5) AS integrated FROM l JOIN g USING (source_id) WHERE l >= -70 AND l >= g GROUP BY 1) SELECT source_id, integrated, round(least(30.0, -14 - integrated), 5) AS gain_db FROM k"),
    "e29_look_ahead_peaks": (lambda s, d: op.look_ahead_peaks(view(s, d, "v_pcm"), 200), ["v_pcm"],
        "WITH b AS (SELECT source_id, CAST(i // 4 AS BIGINT) AS block, max(abs(x_milli)) AS p FROM v_pcm GROUP BY ALL) SELECT source_id, block, peak, round(20 * log10(200.0 / peak), 6) AS gain_db FROM (SELECT *, max(p) OVER (PARTITION BY source_id ORDER BY block ROWS 4 PRECEDING) AS peak FROM b) WHERE peak > 200"),
    "a16_delta_encoded": (lambda s, d: op.delta_encoded(_times(s, d)), ["v_events"], "SELECT session_id AS source_id, row_number() OVER w AS n, t_us - coalesce(lag(t_us) OVER w, 0) AS delta FROM v_events WINDOW w AS (PARTITION BY session_id ORDER BY t_us)"),
    "a16_delta_decoded": (lambda s, d: op.delta_decoded(op.delta_encoded(_times(s, d))), ["v_events"], "SELECT session_id AS source_id, row_number() OVER (PARTITION BY session_id ORDER BY t_us) AS n, t_us AS t FROM v_events"),
    "d7_frame_rate_modes": (lambda s, d: op.frame_rate_modes(view(s, d, "v_events").select(F.col("session_id").alias("source_id"), F.col("event_id").alias("packet_id"), "t_us")), ["v_events"],
        "WITH p AS (SELECT session_id, d FROM (SELECT session_id, row_number() OVER w AS n, t_us - lag(t_us) OVER w AS d FROM v_events WINDOW w AS (PARTITION BY session_id ORDER BY t_us, event_id)) WHERE n <= 40 AND d > 0), m AS (SELECT session_id, avg(d) AS a, count(*) AS c FROM p GROUP BY 1) SELECT session_id AS source_id, c AS n_steps, CASE WHEN c < 4 THEN 'unknown' WHEN max(abs(d - a)) > greatest(2000.0, 0.08 * a) THEN 'variable' ELSE 'constant' END AS mode FROM p JOIN m USING (session_id) GROUP BY session_id, a, c"),
    "d10_histogram": (lambda s, d: fr.histogram(view(s, d, "v_rgb")), ["v_rgb"], "WITH ch AS (SELECT frame_id, x, y, unnest(['r', 'g', 'b', 'y']) AS channel, unnest([r, g, b, (0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b)]) AS v FROM v_rgb) SELECT frame_id, channel, CAST(floor(greatest(0.0, least(0.9999::DOUBLE, v)) * 256) AS BIGINT) AS bin, count(*) AS n FROM ch GROUP BY ALL"),
    "d10_clipped_pixels": (lambda s, d: fr.clipped_pixels(view(s, d, "v_rgb")), ["v_rgb"], "SELECT frame_id, count(*) FILTER (WHERE r < 0 OR r > 1 OR g < 0 OR g > 1 OR b < 0 OR b > 1) AS n_clipped FROM v_rgb GROUP BY 1"),
    "d11_column_waveform": (lambda s, d: fr.column_waveform(view(s, d, "v_rgb")), ["v_rgb"], "WITH ch AS (SELECT frame_id, x, y, unnest(['r', 'g', 'b', 'y']) AS channel, unnest([r, g, b, (0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b)]) AS v FROM v_rgb) SELECT frame_id, x, channel, CAST(min(floor(greatest(0.0, v) * 65535)) AS BIGINT) AS low, CAST(max(floor(greatest(0.0, v) * 65535)) AS BIGINT) AS high FROM ch GROUP BY ALL"),
    "d12_vectorscope": (lambda s, d: fr.vectorscope(view(s, d, "v_rgb")), ["v_rgb"], "SELECT CAST(floor(greatest(0.0, least(0.9999::DOUBLE, (b - (0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b)) / 1.8556::DOUBLE + 0.5)) * 64) AS BIGINT) AS bin_u, CAST(floor(greatest(0.0, least(0.9999::DOUBLE, (r - (0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b)) / 1.5748::DOUBLE + 0.5)) * 64) AS BIGINT) AS bin_v, count(*) AS n FROM v_rgb GROUP BY ALL"),
    "d13_colour_histogram": (lambda s, d: fr.colour_histogram(view(s, d, "v_rgb")), ["v_rgb"], "SELECT frame_id, (CAST(floor(greatest(0.0, least(0.9999::DOUBLE, r)) * 8) AS BIGINT) * 8 + CAST(floor(greatest(0.0, least(0.9999::DOUBLE, g)) * 8) AS BIGINT)) * 8 + CAST(floor(greatest(0.0, least(0.9999::DOUBLE, b)) * 8) AS BIGINT) AS bin, count(*) AS n, count(*) / 64.0::DOUBLE AS share FROM v_rgb GROUP BY ALL"),
    "d14_shot_boundaries": (lambda s, d: fr.shot_distances(fr.colour_histogram(view(s, d, "v_rgb"), 2).drop("share")), ["v_rgb"],
        "WITH h AS (SELECT frame_id, (CAST(floor(greatest(0.0, least(0.9999::DOUBLE, r)) * 2) AS BIGINT) * 2 + CAST(floor(greatest(0.0, least(0.9999::DOUBLE, g)) * 2) AS BIGINT)) * 2 + CAST(floor(greatest(0.0, least(0.9999::DOUBLE, b)) * 2) AS BIGINT) AS bin, count(*) AS n FROM v_rgb GROUP BY ALL), f AS (SELECT frame_id, lag(frame_id) OVER (ORDER BY frame_id) AS p FROM (SELECT DISTINCT frame_id FROM h)), g AS (SELECT f.frame_id, f.p, b.bin FROM f CROSS JOIN range(8) AS b(bin) WHERE p IS NOT NULL) SELECT g.frame_id, p AS prev_id, round(sum(CASE WHEN coalesce(a.n, 0) + coalesce(b.n, 0) > 0 THEN pow(coalesce(a.n, 0) - coalesce(b.n, 0), 2)::DOUBLE / (coalesce(a.n, 0) + coalesce(b.n, 0)) ELSE 0 END) / 64, 6) AS distance, round(sum(CASE WHEN coalesce(a.n, 0) + coalesce(b.n, 0) > 0 THEN pow(coalesce(a.n, 0) - coalesce(b.n, 0), 2)::DOUBLE / (coalesce(a.n, 0) + coalesce(b.n, 0)) ELSE 0 END) / 64, 6) > 0.5 AS boundary FROM g LEFT JOIN h a ON a.frame_id = g.frame_id AND a.bin = g.bin LEFT JOIN h b ON b.frame_id = g.p AND b.bin = g.bin GROUP BY 1, 2"),
    "d15_ssim": (lambda s, d: fr.ssim(*(lambda p: (p, p.withColumn("frame_id", F.col("frame_id") - 1)))(view(s, d, "v_pixels"))), ["v_pixels"],
        "WITH w AS (SELECT a.frame_id, a.y // 4 AS wy, a.x // 4 AS wx, avg(a.v_milli) AS ma, avg(b.v_milli) AS mb, avg(a.v_milli * a.v_milli) AS aa, avg(b.v_milli * b.v_milli) AS bb, avg(a.v_milli * b.v_milli) AS ab FROM v_pixels a JOIN v_pixels b ON b.frame_id = a.frame_id + 1 AND a.x = b.x AND a.y = b.y GROUP BY ALL) SELECT frame_id, round(avg(((2 * ma * mb + 100.0) * (2 * (ab - ma * mb) + 900.0)) / ((ma * ma + mb * mb + 100.0) * (aa - ma * ma + bb - mb * mb + 900.0))), 6) AS ssim FROM w GROUP BY 1"),
    "d16_saliency": (lambda s, d: fr.salient_cells(view(s, d, "v_rgb"), 4), ["v_rgb"],
        "WITH q AS (SELECT frame_id, x, y, least(255.0, floor(greatest(0.0, r) * 256)) AS r, least(255.0, floor(greatest(0.0, g) * 256)) AS g, least(255.0, floor(greatest(0.0, b) * 256)) AS b FROM v_rgb), p AS (SELECT frame_id, x, y, CASE WHEN 128 - 0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5 * b BETWEEN 77 AND 127 AND 128 + 0.5 * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b BETWEEN 133 AND 173 THEN 1.0 ELSE 0.0 END AS skin, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l FROM q), e AS (SELECT c.frame_id, c.x, c.y, c.skin, c.l, coalesce(sqrt(power(-a.l + b.l - 2 * d.l + 2 * e.l - f.l + h.l, 2) + power(-a.l - 2 * u.l - b.l + f.l + 2 * w.l + h.l, 2)), 0) AS edge FROM p c " + " ".join(f"LEFT JOIN p {n} ON {n}.frame_id = c.frame_id AND {n}.x = c.x + {dx} AND {n}.y = c.y + {dy}" for n, dx, dy in (("a", -1, -1), ("u", 0, -1), ("b", 1, -1), ("d", -1, 0), ("e", 1, 0), ("f", -1, 1), ("w", 0, 1), ("h", 1, 1))) + "), k AS (SELECT frame_id, CAST(y // 2 * 4 + x // 2 AS INTEGER) AS cell, avg(skin) AS skin, avg(edge) AS edge, stddev_pop(l) AS con FROM e GROUP BY 1, 2), m AS (SELECT *, max(skin) OVER w AS ms, max(edge) OVER w AS me, max(con) OVER w AS mc FROM k WINDOW w AS (PARTITION BY frame_id)), z AS (SELECT frame_id, cell, round(0.5 * coalesce(skin / nullif(ms, 0), 0) + 0.3::DOUBLE * coalesce(edge / nullif(me, 0), 0) + 0.2::DOUBLE * coalesce(con / nullif(mc, 0), 0), 6) AS confidence FROM m) SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY confidence DESC, cell) = 1"),
    "c24_box_iou": (lambda s, d: fr.box_iou(view(s, d, "v_detections")), ["v_detections"],
        "SELECT frame_id, a, b, round(i::DOUBLE / (180000 - i), 6) AS iou FROM (SELECT p.frame_id, p.det_id AS a, q.det_id AS b, greatest(0, 300 - abs(p.x_milli - q.x_milli)) * greatest(0, 300 - abs(p.y_milli - q.y_milli)) AS i FROM v_detections p JOIN v_detections q ON p.frame_id = q.frame_id AND p.det_id < q.det_id) WHERE i > 0"),
    "f5_best_detection": (lambda s, d: fr.best_detection(view(s, d, "v_detections")), ["v_detections"],
        "SELECT frame_id, det_id, conf_milli FROM v_detections QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY conf_milli DESC, w_milli * h_milli DESC, det_id) = 1"),
    "f7_non_max_suppression": (lambda s, d: fr.non_max_suppression(view(s, d, "v_detections"), 0.3, 5), ["v_detections"], None),
    "e6_onsets": (lambda s, d: au.picked_onsets(au.onset_candidates(_series(s, d)), 24), ["v_series"],
        f"WITH RECURSIVE {CANDIDATES}, f AS (SELECT source_id, min(i) AS i FROM cd GROUP BY 1 UNION ALL SELECT f.source_id, (SELECT min(cd.i) FROM cd WHERE cd.source_id = f.source_id AND cd.i - f.i >= 24) AS i FROM f WHERE f.i IS NOT NULL) SELECT source_id, i FROM f WHERE i IS NOT NULL"),
    "d24_tempos": (lambda s, d: au.tempos(_series(s, d), HOP_S), ["v_series"], f"WITH {TEMPOS} SELECT source_id, lag, bpm FROM tm"),
    "d25_beat_phases": (lambda s, d: (lambda x: au.beat_phases(x, au.tempos(x, HOP_S), HOP_S))(_series(s, d)), ["v_series"],
        f"WITH {TEMPOS}, gr AS (SELECT source_id, bpm, n, 60 / (bpm * {HOP_S!r}::DOUBLE) AS t, h.h AS h FROM tm, range(128) AS h(h)), gb AS (SELECT source_id, bpm, n, h, CAST(floor(h * t / 128 + k * t + 0.5) AS BIGINT) AS i FROM (SELECT *, unnest(range(CAST(floor(n / t) AS BIGINT) + 2)) AS k FROM gr)), gs AS (SELECT gb.source_id, bpm, h, round(sum(x), 6) AS score FROM gb JOIN v_series v ON v.source_id = gb.source_id AND v.i = gb.i WHERE gb.i < n GROUP BY ALL) SELECT source_id, bpm, CAST(h AS INTEGER) AS phase, score FROM gs QUALIFY row_number() OVER (PARTITION BY source_id, bpm ORDER BY score DESC, h) = 1"),
    "k1_spectral_flux": (lambda s, d: au.spectral_flux(_long(s, d)), ["v_chunks"], None),
    "k2_beats": (lambda s, d: au.beats(_long(s, d), size=128, hop=64, rate=6000), ["v_chunks"], None),
    "k3_log_mel": (lambda s, d: au.log_mel(_long(s, d), rate=1600, size_s=2.0, overlap_s=0.2), ["v_chunks"], None),
    "k5_resampled": (lambda s, d: au.resampled(_long(s, d), 44_100, 48_000), ["v_chunks"], None),
    "e30_weighted_power": (lambda s, d: au.weighted_power(_long(s, d), 480), ["v_chunks"], None),
    "k6_loudness": (lambda s, d: au.loudness_job(_long(s, d), step=480), ["v_chunks"], None),
    "k6_mixed_loudness": (lambda s, d: (lambda c: au.loudness_job(au.mixed_chunks(c, c.select("source_id").distinct().selectExpr("source_id", "source_id % 4 AS project_id", "0.25 + source_id % 3 AS gain"), 480), step=480))(_long(s, d)), ["v_chunks"], None),
}


def queries():
    return {name: query for name, (query, _, _) in PLANS.items()}


def oracle_sql():
    return {name: sql_with(reads, sql) for name, (_, reads, sql) in PLANS.items() if sql}

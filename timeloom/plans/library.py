"""Queries of source, cache, caption and text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from timeloom.functions import scalars as fn
from timeloom.operators import captions as cap
from timeloom.operators import events as ev
from timeloom.operators import quality as op
from timeloom.operators.helpers import shared_folder
from timeloom.sources import sinks
from timeloom.sources.views import sql_with, view


def _src(s, d):
    return view(s, d, "v_sources")


def _seg(s, d):
    return view(s, d, "v_segments")


_RULE = "SELECT source_id, {0} AS track_no, '{1}' AS code, '{2}' AS severity, {3} AS blocking FROM {4} WHERE {5}"
WARN = "bt AS (SELECT source_id, min(track_no) FILTER (WHERE kind = 'video') AS fv, min(track_no) FILTER (WHERE kind = 'audio') AS fa, bool_or(can_decode) AS dec, arg_min(start_ms, track_no) FILTER (WHERE kind = 'video') AS vs, arg_min(start_ms, track_no) FILTER (WHERE kind = 'audio') AS sa, count(DISTINCT sample_rate) FILTER (WHERE kind = 'audio' AND sample_rate > 0) AS nr FROM v_tracks GROUP BY 1), tr AS (SELECT t.*, CASE WHEN kind = 'video' THEN track_no = fv ELSE fv IS NULL AND track_no = fa END AS prim FROM v_tracks t JOIN bt USING (source_id)), so AS (SELECT * FROM v_sources LEFT JOIN bt USING (source_id)), w AS (" + " UNION ALL ".join(_RULE.format(*r) for r in (
    ("track_no", "variable-frame-rate", "warning", "false", "tr", "rate_mode = 'variable'"),
    ("track_no", "non-zero-track-start", "warning", "false", "tr", "abs(start_ms) > 1"),
    ("track_no", "rotation-metadata", "info", "false", "tr", "kind = 'video' AND rotation % 360 <> 0"),
    ("track_no", "unsupported-video-codec", "error", "prim", "tr", "kind = 'video' AND NOT can_decode"),
    ("track_no", "unsupported-audio-codec", "error", "prim", "tr", "kind = 'audio' AND NOT can_decode"),
    ("0", "missing-duration", "error", "NOT coalesce(dec, false)", "so", "duration_ms <= 0"),
    ("0", "audio-video-offset", "warning", "false", "so", "abs(sa - vs) > 20"),
    ("0", "mixed-audio-sample-rates", "info", "false", "so", "nr > 1"),
    ("0", "undecodable-track", "error", "true", "so", "NOT coalesce(dec, false)"),
)) + ")"
STATUS = "SELECT source_id, coalesce(n, 0) AS n_warnings, CASE WHEN b THEN 'blocked' WHEN n > 0 THEN 'warnings' ELSE 'ok' END AS status FROM v_sources LEFT JOIN (SELECT source_id, bool_or(blocking) AS b, count(*) AS n FROM w {} GROUP BY 1) USING (source_id)"
NORM = "trim(regexp_replace(regexp_replace(lower(text), '[.,!?;:\"''()]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"
SRT_T = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
SRT = f"SELECT track_id, string_agg(c, chr(10) || chr(10) ORDER BY n) || chr(10) AS srt FROM (SELECT track_id, n, n || chr(10) || {SRT_T.format('start_ms')} || ' --> ' || {SRT_T.format('(start_ms + dur_ms)')} || chr(10) || text AS c FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, seg_id) AS n FROM v_segments)) GROUP BY track_id"


def _warnings(s, d):
    return op.health_warnings(_src(s, d), view(s, d, "v_tracks"))


def _proxies(s, d):
    t = view(s, d, "v_tracks").filter("kind = 'video'").select("source_id", "can_decode", "rate_mode", "codec").join(_src(s, d), "source_id")
    return t.selectExpr("*", "width * 9 div 16 AS height", "CASE WHEN fps_code > 0 THEN fps_code * 30 END AS fps", "CASE WHEN byte_size % 8 = 0 THEN 20 END AS encode_fps").withColumn("byte_size", F.col("byte_size") * 1000)


REDACT = "t"
for _pattern, _mark in fn.REDACTIONS:
    # an engine without back references takes one pattern a quote
    _each = [(_pattern, _mark)] if "\\1" not in _pattern else [(f"({q})([^\"'`]*(?:\\.[A-Za-z0-9]{{2,5}})[^\"'`]*){q}", f"{q}[redacted-file]{q}") for q in "\"'`"]
    for _p, _m in _each:
        REDACT = "regexp_replace({}, '{}', '{}', 'g')".format(REDACT, _p.replace("'", "''"), _m.replace("'", "''"))
DIRTY = "{0} || ' at /usr/local/x and C:\\Users\\me\\clip.mov file:///tmp/a_b \"my clip.mp4\" ''o.txt'' holiday.MOV blob:' || {0} || ' \\\\nas\\x.bin ' || {1}"


def _damaged_srt(s, d):
    """SRT texts with some cues spoiled: no number, no time, an end before the start, no text."""
    text = F.col("srt")
    for pattern, mark in ((r"(^|\n\n)3\n", "$1three\n"), (r"(\n\n5\n[0-9:,]+) --> ", "$1 -> "), (r"(\n\n7\n)[0-9:,]+ --> ([0-9:,]+)", "$1$2 --> $2"), (r"(\n\n9\n[^\n]*\n)[^\n]*", "$1")):
        text = F.regexp_replace(text, pattern, mark)
    return cap.srt_files(_seg(s, d)).withColumn("srt", text)


def _damaged_vtt(s, d):
    text = F.regexp_replace("vtt", r"^WEBVTT\n\n", "WEBVTT\n\nNOTE a\nb\n\n1\n")
    text = F.when(F.col("track_id") % 4 == 0, F.regexp_replace("vtt", r"^WEBVTT\n\n", "")).otherwise(text)
    text = F.regexp_replace(text, r"(--> [0-9]+:[0-9]+:[0-9]*[05]\.[0-9]+)\n", "$1 align:left\n")
    return cap.vtt_files(_seg(s, d)).withColumn("vtt", text)


ORDERED = "o AS (SELECT track_id, start_ms, start_ms + dur_ms AS end_ms, text, row_number() OVER w AS n, lag(start_ms + dur_ms) OVER w AS prior FROM v_segments WINDOW w AS (PARTITION BY track_id ORDER BY start_ms, seg_id))"
SRT_PROBLEMS = ORDERED + ", sp AS (SELECT track_id, CAST(n - 1 AS INTEGER) AS cue, CASE WHEN n IN (5) THEN NULL WHEN n = 7 THEN end_ms ELSE start_ms END AS start_ms, CASE WHEN n IN (5) THEN NULL ELSE end_ms END AS end_ms, CASE WHEN n = 9 THEN '' ELSE text END AS text, n FROM o), sq AS (SELECT *, lag(end_ms) OVER (PARTITION BY track_id ORDER BY cue) AS p FROM sp), sr AS (SELECT *, CASE WHEN n = 3 THEN 'invalid-index' WHEN start_ms IS NULL THEN 'invalid-timecode' WHEN end_ms <= start_ms THEN 'negative-duration' WHEN text = '' THEN 'empty-cue' WHEN start_ms < p THEN 'overlap' ELSE 'ok' END AS problem FROM sq)"


def _bundle(s, d):
    m = view(s, d, "v_cache").select("entry_id", "bytes", F.expr("entry_id % 11").alias("digest"), F.expr("entry_id % 50 * 100").alias("duration_ms"))
    f = m.filter("entry_id % 13 <> 0").select("entry_id", F.expr("bytes + CASE WHEN entry_id % 7 = 0 THEN 1 ELSE 0 END").alias("bytes"), F.expr("digest + CASE WHEN entry_id % 5 = 0 THEN 1 ELSE 0 END").alias("digest"), F.expr("duration_ms + entry_id % 4 * 100").alias("duration_ms"))
    return op.integrity(m, f)


def _tracks(s, d):
    return view(s, d, "v_clips").groupBy("project_id", "track_no").agg(F.expr("(project_id + track_no) % 3 = 0").alias("muted"), F.expr("(project_id * 7 + track_no) % 11 = 0").alias("solo"))


#: A text of each kind: speech, bracketed, in other brackets, thanks, announcements, repeated words, no speech at all.
SAID = "CASE seg_id % 12 WHEN 0 THEN '[MUSIC] ' WHEN 1 THEN '[hm] well' WHEN 2 THEN '(upbeat Music plays)' WHEN 3 THEN '(aside) ' || text WHEN 4 THEN ' Thank you for watching!' WHEN 5 THEN 'We will  now look at it' WHEN 6 THEN 'the The the' WHEN 7 THEN 'the then' WHEN 8 THEN ' ... !' WHEN 9 THEN text WHEN 10 THEN '你好' ELSE 'Subscribe' END"


def _said(s, d):
    return view(s, d, "v_segments").withColumn("text", F.expr(SAID))


def _caption_files(s, d):
    """Cues of the files that are written for all tracks, read back from them."""
    path = f"{shared_folder(s)}/captions-{uuid.uuid4().hex}"
    sinks.write_captions(_seg(s, d), path)
    srt = cap.parsed_cues(sinks.read_files(s, path, "srt", format="srt"))
    vtt = cap.parse_vtt(sinks.read_files(s, path, "vtt", format="vtt"))
    columns = ["format", F.col("track_id").cast("long").alias("track_id"), F.col("cue").cast("int").alias("cue"), "start_ms", "end_ms", "text"]
    return srt.withColumn("format", F.lit("srt")).select(*columns).unionByName(vtt.withColumn("format", F.lit("vtt")).select(*columns))


def _markers(s, d):
    return view(s, d, "v_points").select("project_id", "point_id", "t_ms", F.expr("CASE WHEN point_id % 3 = 0 THEN '  ' ELSE concat(' part ', point_id) END").alias("label"))


#: Two words a segment; where the id is divisible by 4 the second begins before the first ends.
WORDS = "ws AS (SELECT * FROM v_segments)"


def _words(s, d):
    first = F.expr("struct(start_ms AS s, start_ms + 400 + seg_id % 7 * 20 AS e, 'a' AS w)")
    second = F.expr("struct(CASE WHEN seg_id % 4 = 0 THEN start_ms + 390 ELSE start_ms + 600 END AS s, start_ms + 900 AS e, 'b' AS w)")
    return _seg(s, d).withColumn("words", F.array(first, second))


def _logs(s, d):
    events = view(s, d, "v_events")
    rows = events.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("event_id", F.struct("kind", F.col("t_us").alias("t"), (F.col("x_milli") / 500.0).alias("x"), (F.col("y_milli") / 1000.0).alias("y"), (F.col("y_milli") - 500.0).alias("deltaY")).alias("e")))).alias("s"))
    return rows.select(F.col("session_id").alias("log_id"), F.to_json(F.struct(F.when(F.col("session_id") % 7 == 0, 2).otherwise(1).alias("eventLogSchemaVersion"), F.lit("s").alias("sessionId"), F.transform("s", lambda x: x["e"]).alias("events"))).alias("json"))


def _metrics(s, d):
    events = view(s, d, "v_events")
    seen = events.groupBy(F.col("kind").alias("metric")).agg(F.floor(F.avg("x_milli")).alias("value"))
    defs = events.select(F.col("kind").alias("metric")).distinct().union(events.select(F.lit("never").alias("metric")).distinct()).select("metric", F.expr("length(metric) * 60").alias("good"), F.expr("length(metric) * 100").alias("bad"), F.expr("length(metric) % 2 = 0").alias("higher_is_worse"))
    return op.metric_status(seen, defs)


MESSAGES = ("Permission missing", "Import aborted", "Unsupported codec: vp7", "Unknown format", "Malformed header", "Network down", "Device lost", "Encode failed", "Muxer says no", "Disk is full", "Could not decode", "Oh no")
MESSAGE_SQL = "CASE page_id % 12 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MESSAGES)) + " END"


def _message():
    return F.expr(MESSAGE_SQL)


def _classes(side, n):
    rules = fn.IMPORT_ERRORS if side == "import" else fn.EXPORT_ERRORS
    when = " ".join("WHEN " + " OR ".join("(" + " AND ".join(f"contains(m, '{w}')" for w in every) + ")" for every in words) + f" THEN '{what[n]}'" for words, *what in rules)
    return f"CASE {when} ELSE '{fn.UNKNOWN_ERRORS[side][n]}' END"


def _described(s, d):
    t = view(s, d, "v_tracks").groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("track_no", "codec"))), lambda x: x["codec"]).alias("codecs"), F.bool_or(F.expr("kind = 'video' AND NOT can_decode")).alias("video_fails"), F.bool_or(F.expr("kind = 'audio' AND NOT can_decode")).alias("audio_fails"), F.bool_or(F.expr("kind = 'video'")).alias("video"))
    return _src(s, d).join(t, "source_id").selectExpr("project_id", "source_id", "fps_code = 2 AND width > 4500 AS offline", "CASE WHEN video THEN 'video' ELSE 'audio' END AS kind", "'video/mp4; codecs=x' AS mime", "codecs", "duration_ms * 97 AS duration_ms", "video_fails", "audio_fails")


PLANS = {
    "b4_health_warnings": (_warnings, ["v_sources", "v_tracks"], f"WITH {WARN} SELECT * FROM w"),
    "b5_health_status": (lambda s, d: op.health_status(_src(s, d), _warnings(s, d)), ["v_sources", "v_tracks"], f"WITH {WARN} {STATUS.format('')}"),
    "b6_visible_health": (lambda s, d: op.visible_health(_src(s, d), _warnings(s, d), ("rotation-metadata", "mixed-audio-sample-rates")), ["v_sources", "v_tracks"], f"WITH {WARN} " + STATUS.format("WHERE code NOT IN ('rotation-metadata', 'mixed-audio-sample-rates')")),
    "b7_proxy_reasons": (lambda s, d: op.proxy_reasons(_proxies(s, d)), ["v_sources", "v_tracks"], "SELECT source_id, r AS reasons FROM (SELECT source_id, concat_ws(',', CASE WHEN width >= 2560 OR width * 9 // 16 >= 1440 THEN 'large-resolution' END, CASE WHEN byte_size * 8000000.0 / duration_ms >= 35000000 THEN 'high-bitrate' END, CASE WHEN rate_mode = 'variable' THEN 'variable-frame-rate' END, CASE WHEN regexp_matches(lower(codec), 'vp9|vp09|av1|av01|hev1|hvc1') THEN 'heavy-codec' END, CASE WHEN byte_size % 8 = 0 AND 20 < CASE WHEN fps_code > 0 THEN fps_code * 30 ELSE 30 END * 0.75 THEN 'slow-throughput' END) AS r FROM v_sources JOIN v_tracks USING (source_id) WHERE kind = 'video' AND can_decode) WHERE r <> ''"),
    "f2_proxy_order": (lambda s, d: (lambda q: op.proxy_order(q, q.filter("source_id % 11 = 0"), q.filter("width >= 2560"), q.filter("source_id % 5 < 2")))(_src(s, d)), ["v_sources"], "SELECT project_id, source_id, ['active-range', 'visible-filmstrip', 'selected-source', 'background-bin'][p + 1] AS priority, CAST(row_number() OVER (PARTITION BY project_id ORDER BY p, source_id) AS INTEGER) AS place FROM (SELECT *, CASE WHEN source_id % 11 = 0 THEN 0 WHEN width >= 2560 THEN 1 WHEN source_id % 5 < 2 THEN 2 ELSE 3 END AS p FROM v_sources)"),
    "d6_sequence_rates": (lambda s, d: op.sequence_rates(_src(s, d).withColumn("fps", F.expr("CASE WHEN width % 300 = 0 THEN 24 * nullif(fps_code, 0) END"))), ["v_sources"], "SELECT project_id, coalesce(fps, 30) AS fps FROM (SELECT project_id, CASE WHEN width % 300 = 0 THEN 24 * nullif(fps_code, 0) END AS fps, count(*) AS n FROM v_sources GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN fps IS NULL THEN 0 ELSE n END DESC, fps DESC NULLS LAST) = 1"),
    "c16_relink": (lambda s, d: op.relink(view(s, d, "v_descriptors"), view(s, d, "v_candidates")), ["v_descriptors", "v_candidates"], "WITH x AS (SELECT s.source_id, c.cand_id, c.byte_size <> s.byte_size AS r1, abs(c.duration_ms - s.duration_ms) > 250 AS r2, abs(c.start_ms - s.start_ms) > 50 AS r3, c.rotation <> s.rotation AS r4, c.sample_rate <> s.sample_rate AS r5, c.channels <> s.channels AS r6, min(abs(c.byte_size - s.byte_size)) OVER (PARTITION BY source_id) AS best, row_number() OVER (PARTITION BY source_id ORDER BY abs(c.byte_size - s.byte_size), c.byte_size) AS k FROM v_descriptors s JOIN v_candidates c USING (file_name)) SELECT source_id, cand_id, concat_ws(',', CASE WHEN r1 THEN 'size' END, CASE WHEN r2 THEN 'duration' END, CASE WHEN r3 THEN 'track timing' END, CASE WHEN r4 THEN 'rotation' END, CASE WHEN r5 THEN 'audio sample rate' END, CASE WHEN r6 THEN 'audio channel count' END) AS reasons FROM x WHERE NOT r1 OR (best > 0 AND k = 1)"),
    "c17_bundle_integrity": (_bundle, ["v_cache"], "SELECT entry_id, CASE WHEN entry_id % 13 = 0 THEN 'missing' WHEN entry_id % 7 = 0 THEN 'size' WHEN entry_id % 5 = 0 THEN 'digest' WHEN entry_id % 4 = 3 THEN 'descriptor' ELSE 'ok' END AS result FROM v_cache"),
    "d4_integrity_summary": (lambda s, d: op.integrity_summary(_bundle(s, d)), ["v_cache"], "SELECT count(*) AS n, count(*) FILTER (WHERE r = 'missing') AS n_missing, count(*) FILTER (WHERE r = 'size') AS n_size, count(*) FILTER (WHERE r = 'digest') AS n_digest, count(*) FILTER (WHERE r = 'descriptor') AS n_descriptor, bool_and(r = 'ok') AS ok FROM (SELECT CASE WHEN entry_id % 13 = 0 THEN 'missing' WHEN entry_id % 7 = 0 THEN 'size' WHEN entry_id % 5 = 0 THEN 'digest' WHEN entry_id % 4 = 3 THEN 'descriptor' ELSE 'ok' END AS r FROM v_cache)"),
    "d5_content_dedup": (lambda s, d: op.content_dedup(view(s, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("asset_id"), F.sha2("text", 256).alias("digest"))), [], "SELECT doc_id AS asset_id, sha256(text) AS digest, min(doc_id) OVER (PARTITION BY text) AS kept_id FROM documents WHERE text IS NOT NULL"),
    "a14_fingerprints": (lambda s, d: view(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint")), [], "SELECT doc_id, sha256(text) AS fingerprint FROM documents"),
    "d3_cache_usage": (lambda s, d: op.cache_usage(view(s, d, "v_cache"), 7_000_000, view(s, d, "v_cache").groupBy("store_id").agg((9_000_000 - F.sum("bytes")).alias("free_bytes"))), ["v_cache"], "WITH u AS (SELECT store_id, category_rank, CAST(sum(greatest(0, bytes)) AS BIGINT) AS bytes, count(*) AS n FROM v_cache WHERE status_rank <> 4 GROUP BY ALL), q AS (SELECT store_id, CAST(9000000 - sum(bytes) AS BIGINT) AS free_bytes FROM v_cache GROUP BY 1) SELECT store_id, category_rank, bytes, n, total, CASE WHEN total >= 7000000 THEN 'full' WHEN total * 10 >= 56000000 THEN 'near' ELSE 'ok' END AS level, free_bytes FROM (SELECT *, CAST(sum(bytes) OVER (PARTITION BY store_id) AS BIGINT) AS total FROM u) JOIN q USING (store_id)"),
    "d3_usage_rollup": (lambda s, d: op.usage_rollup(view(s, d, "v_cache")), ["v_cache"], "SELECT coalesce(store_id, 'all') AS store_id, coalesce(category_rank, -1) AS category_rank, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS n FROM v_cache WHERE status_rank <> 4 GROUP BY ROLLUP (store_id, category_rank)"),
    "f1_eviction_plan": (lambda s, d: op.eviction_plan(view(s, d, "v_cache"), 4_000_000, view(s, d, "v_cache").groupBy("store_id").agg((F.sum("bytes") % 2_000_000).alias("free_bytes"), F.lit(1_500_000).alias("least_free"))), ["v_cache"], "SELECT store_id, entry_id, CAST(place AS INTEGER) AS place, bytes FROM (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY store_id ORDER BY status_rank DESC, category_rank, last_used, entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g, row_number() OVER (PARTITION BY store_id ORDER BY status_rank DESC, category_rank, last_used, entry_id) AS place FROM (SELECT *, sum(bytes) OVER (PARTITION BY store_id) AS a, f FROM v_cache JOIN (SELECT store_id, sum(bytes) % 2000000 AS f FROM v_cache GROUP BY 1) USING (store_id) WHERE status_rank <> 4) WHERE status_rank <> 0) WHERE a - g > greatest(0, CASE WHEN f < 1500000 THEN least(4000000, greatest(0, a - 1500000 + f)) ELSE 4000000 END)"),
    "f12_least_recent": (lambda s, d: op.least_recent(view(s, d, "v_cache"), 3_000_000), ["v_cache"], "SELECT store_id, entry_id FROM (SELECT *, sum(bytes) OVER (PARTITION BY store_id ORDER BY last_used DESC, entry_id ROWS UNBOUNDED PRECEDING) AS r FROM v_cache) WHERE r > 3000000"),
    "d19_job_summary": (lambda s, d: op.job_summary(view(s, d, "v_jobs")), ["v_jobs"], "SELECT project_id, count(*) FILTER (WHERE status = 'pending') AS n_pending, count(*) FILTER (WHERE status = 'completed') AS n_completed, count(*) FILTER (WHERE status IN ('failed', 'running', 'finalizing', 'choosing-destination')) AS n_failed, count(*) FILTER (WHERE status = 'canceled') AS n_canceled, count(*) AS n FROM v_jobs GROUP BY 1"),
    "f4_history_evictions": (lambda s, d: op.history_evictions(view(s, d, "v_jobs")), ["v_jobs"], "SELECT project_id, job_id, CAST(p AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY r, enqueued_day, job_id) AS p FROM (SELECT *, count(*) OVER (PARTITION BY project_id) AS n, CASE status WHEN 'completed' THEN 0 WHEN 'failed' THEN 1 WHEN 'canceled' THEN 2 END AS r FROM v_jobs) WHERE r IS NOT NULL) WHERE p <= n - 50"),
    "b14_metric_status": (_metrics, ["v_events"], "WITH o AS (SELECT kind AS metric, floor(avg(x_milli)) AS v FROM v_events GROUP BY 1), d AS (SELECT DISTINCT kind AS metric FROM v_events UNION SELECT 'never') SELECT metric, CASE WHEN v IS NULL THEN 'not-measured' WHEN v * s <= length(metric) * 60 * s THEN 'ok' WHEN v * s <= length(metric) * 100 * s THEN 'warn' ELSE 'breach' END AS status FROM (SELECT d.metric, v, CASE WHEN length(d.metric) % 2 = 0 THEN 1 ELSE -1 END AS s FROM d LEFT JOIN o USING (metric))"),
    "f10_source_aliases": (lambda s, d: op.source_aliases(_src(s, d)), ["v_sources"], "SELECT project_id, source_id, 'source-' || row_number() OVER (PARTITION BY project_id ORDER BY source_id) AS alias FROM v_sources"),
    "h7_canonical_keys": (lambda s, d: op.canonical_keys(_src(s, d)), ["v_sources"], "SELECT source_id, sha256('{\"byte_size\":' || byte_size || ',\"duration_ms\":' || duration_ms || ',\"file_name\":\"' || file_name || '\",\"width\":' || width || '}') AS key FROM v_sources"),
    "b2_audible_tracks": (lambda s, d: op.audible_tracks(_tracks(s, d)), ["v_clips"], "WITH t AS (SELECT DISTINCT project_id, track_no, (project_id + track_no) % 3 = 0 AS muted, (project_id * 7 + track_no) % 11 = 0 AS solo FROM v_clips) SELECT project_id, track_no FROM (SELECT *, bool_or(solo) OVER (PARTITION BY project_id) AS a FROM t) WHERE NOT muted AND (NOT a OR solo)"),
    "h19_storage_pressure": (lambda s, d: op.storage_pressure(view(s, d, "v_cache").groupBy("store_id").agg(F.sum("bytes").alias("bytes"), F.lit(9_000_000).alias("quota"), F.lit(1000).alias("rate"), (F.max("bytes") * 9).alias("need")), 500_000), ["v_cache"], "SELECT store_id, CAST(b * 100 // 9000000 AS BIGINT) AS used_pct, CASE WHEN b * 100 // 9000000 >= 95 THEN 'critical' WHEN b * 100 // 9000000 >= 80 THEN 'high' ELSE 'normal' END AS level, CAST(greatest(0, 9000000 - b) // 1000 AS BIGINT) AS left_s, 9000000 - b >= m * 9 + 500000 AS fits FROM (SELECT store_id, sum(bytes) AS b, max(bytes) AS m FROM v_cache GROUP BY 1)"),
    "b3_clipped_captions": (lambda s, d: cap.clipped(_seg(s, d), 473_500_000, 473_900_000), ["v_segments"], "SELECT track_id, seg_id, greatest(start_ms, 473500000) - 473500000 AS start_ms, greatest(least(start_ms + dur_ms, 473900000) - greatest(start_ms, 473500000), 50) AS dur_ms, text FROM v_segments WHERE start_ms < 473900000 AND start_ms + dur_ms > 473500000"),
    "e19_without_repeats": (lambda s, d: cap.without_repeats(_seg(s, d)), ["v_segments"], f"SELECT track_id, seg_id, start_ms FROM (SELECT *, lag(start_ms + dur_ms) OVER (PARTITION BY track_id, n ORDER BY start_ms, seg_id) AS b FROM (SELECT *, {NORM} AS n FROM v_segments)) WHERE n <> '' AND (b IS NULL OR start_ms - b > 30000)"),
    "e18_adjacent_repeats": (lambda s, d: cap.without_adjacent_repeats(_seg(s, d)), ["v_segments"],
        f"WITH RECURSIVE o AS (SELECT *, {NORM} AS n, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, seg_id) AS k FROM v_segments), f AS (SELECT track_id, k, seg_id, start_ms, n AS ln, start_ms + dur_ms AS le, true AS kept FROM o WHERE k = 1 UNION ALL SELECT o.track_id, o.k, o.seg_id, o.start_ms, CASE WHEN j THEN f.ln ELSE o.n END, CASE WHEN j THEN f.le ELSE o.start_ms + o.dur_ms END, NOT j FROM f JOIN o ON o.track_id = f.track_id AND o.k = f.k + 1, LATERAL (SELECT o.n = f.ln AND o.start_ms - f.le <= 6000 AS j)) SELECT track_id, seg_id, start_ms FROM f WHERE kept"),
    "d18_transcripts": (lambda s, d: cap.transcripts(_seg(s, d)), ["v_segments"], "SELECT track_id, count(*) AS n, string_agg(trim(text), ' ' ORDER BY start_ms, seg_id) AS text FROM v_segments WHERE trim(text) <> '' GROUP BY 1"),
    "a17_chapters_json": (lambda s, d: sinks.parsed_chapters(sinks.chapters_json(_markers(s, d).select("project_id", "t_ms", F.trim("label").alias("label")).filter("label <> ''"))), ["v_points"],
        "SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY t_ms, label) - 1 AS INTEGER) AS n, t_ms, label, printf('%02d:%02d:%02d', t_ms // 3600000, t_ms // 60000 % 60, t_ms // 1000 % 60) AS stamp FROM (SELECT project_id, t_ms, trim(CASE WHEN point_id % 3 = 0 THEN '  ' ELSE ' part ' || point_id END) AS label FROM v_points) WHERE label <> ''"),
    "a8_caption_files": (lambda s, d: _caption_files(s, d), ["v_segments"],
        "WITH o AS (SELECT track_id, row_number() OVER w - 1 AS n, start_ms, start_ms + dur_ms AS end_ms, text FROM v_segments WINDOW w AS (PARTITION BY track_id ORDER BY start_ms, seg_id)) SELECT format, track_id, CAST(n AS INTEGER) AS cue, start_ms, end_ms, text FROM o, (VALUES ('srt')) f(format) UNION ALL SELECT 'vtt', track_id, CAST(n AS INTEGER) + 1, start_ms, end_ms, text FROM o"),
    "a8_srt_files": (lambda s, d: cap.srt_files(_seg(s, d)), ["v_segments"], SRT),
    "a6_parse_srt": (lambda s, d: cap.parse_srt(cap.srt_files(_seg(s, d))), ["v_segments"], "SELECT track_id, CAST(row_number() OVER w - 1 AS INTEGER) AS cue, start_ms, start_ms + dur_ms AS end_ms, text, CASE WHEN start_ms < lag(start_ms + dur_ms) OVER w THEN 'overlap' ELSE 'ok' END AS problem FROM v_segments WINDOW w AS (PARTITION BY track_id ORDER BY start_ms, seg_id)"),
    "f8_ordered_captions": (lambda s, d: _seg(s, d).select("track_id", "seg_id", F.expr("row_number() OVER (PARTITION BY track_id ORDER BY start_ms, seg_id)").alias("place")), ["v_segments"], "SELECT track_id, seg_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY start_ms, seg_id) AS INTEGER) AS place FROM v_segments"),
    "d17_dominant_language": (lambda s, d: cap.dominant_language(view(s, d, "documents").selectExpr("source", "CASE lang WHEN 'fr' THEN 'zh-Hans' WHEN 'de' THEN 'zh' WHEN 'en' THEN CASE WHEN n_chars % 3 = 0 THEN 'en-GB' ELSE 'und' END ELSE lang END AS detected", "n_chars % 100 AS confidence"), "source"), [], "SELECT source, CASE WHEN sum(CASE WHEN lang IN ('fr', 'de') THEN n_chars % 100 ELSE 0 END) >= sum(CASE WHEN lang = 'en' AND n_chars % 3 = 0 THEN n_chars % 100 ELSE 0 END) THEN 'zh' ELSE 'en' END AS lang FROM documents GROUP BY 1"),
    "e10_chapters": (lambda s, d: cap.chapters(_markers(s, d), 240_000_000), ["v_points"],
        "WITH q AS (SELECT project_id, point_id, t_ms, CASE WHEN point_id % 3 = 0 THEN '  ' ELSE ' part ' || point_id END AS label FROM v_points), r AS (SELECT * FROM q WHERE trim(label) <> '' AND t_ms < 240000000), a AS (SELECT * FROM r UNION ALL SELECT DISTINCT project_id, -1, 0, 'Intro' FROM q WHERE project_id NOT IN (SELECT project_id FROM r WHERE t_ms = 0)), g AS (SELECT *, lead(t_ms) OVER (PARTITION BY project_id ORDER BY t_ms, point_id) - t_ms AS gap, printf('%02d:%02d:%02d', t_ms // 3600000, t_ms // 60000 % 60, t_ms // 1000 % 60) || ' ' || trim(label) AS l FROM a) SELECT project_id, count(*) AS n, CASE WHEN count(*) < 3 THEN 'too-few' WHEN min(gap) < 10000 THEN 'too-close' WHEN max(t_ms) > 239990000 THEN 'too-late' ELSE 'ok' END AS reason, string_agg(l, chr(10) ORDER BY t_ms, point_id) AS text FROM g GROUP BY 1"),
    "b19_known_hallucinations": (lambda s, d: cap.without_hallucinations(_said(s, d)), ["v_segments"],
        "SELECT * FROM (SELECT * REPLACE (" + SAID + " AS text) FROM v_segments) WHERE seg_id % 12 IN (1, 3, 7, 9, 10)"),
    "b19_hallucinations": (lambda s, d: cap.without_hallucinations(_seg(s, d), ("^click", "2!$")), ["v_segments"], "SELECT * FROM v_segments WHERE trim(text) <> '' AND NOT regexp_matches(lower(text), '^click') AND NOT regexp_matches(lower(text), '2!$')"),
    "b18_trusted_range": (lambda s, d: cap.in_trusted_range(_seg(s, d), _seg(s, d).groupBy("track_id").agg(F.expr("min(start_ms) + 10000").alias("from_ms"), F.expr("min(start_ms) + 400000").alias("to_ms"))), ["v_segments"], "SELECT v.track_id, seg_id, start_ms FROM v_segments v JOIN (SELECT track_id, min(start_ms) AS a FROM v_segments GROUP BY 1) USING (track_id) WHERE start_ms >= a + 10000 AND start_ms < a + 400000"),
    "h1_timecodes": (lambda s, d: view(s, d, "v_clips").select("clip_id", fn.timecode(F.expr("start_ms div 40"), 25).alias("timecode"), fn.srt_time(F.col("in_ms")).alias("srt"), fn.parsed_srt_time(fn.srt_time(F.col("in_ms"))).alias("parsed"), fn.chapter_time(F.col("dur_ms") * 100).alias("chapter")), ["v_clips"],
        f"SELECT clip_id, printf('%02d:%02d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms // 40 % 25) AS timecode, {SRT_T.format('in_ms')} AS srt, in_ms AS parsed, printf('%02d:%02d:%02d', dur_ms * 100 // 3600000, dur_ms * 100 // 60000 % 60, dur_ms * 100 // 1000 % 60) AS chapter FROM v_clips"),
    "h2_snapped_frames": (lambda s, d: view(s, d, "v_clips").select("clip_id", fn.snapped_frames(F.col("in_ms"), 24).alias("frame")), ["v_clips"], "SELECT clip_id, CAST(floor(in_ms * 24 / 1000 + 0.5) AS BIGINT) AS frame FROM v_clips"),
    "h3_redacted": (lambda s, d: view(s, d, "pages").select("page_id", fn.redacted(F.expr(DIRTY.format("url", "sha2(url, 256)").replace("\\", "\\\\").replace("''", "\\'"))).alias("text")), [], f"SELECT page_id, {REDACT} AS text FROM (SELECT page_id, {DIRTY.format('url', 'sha256(url)')} AS t FROM pages)"),
    "h5_normalised_text": (lambda s, d: view(s, d, "conversations").select("conv_id", "turn", fn.normalised_text(F.col("text")).alias("text")), [], f"SELECT conv_id, turn, {NORM} AS text FROM conversations"),
    "h9_safe_names": (lambda s, d: view(s, d, "pages").select("page_id", fn.safe_file_name(F.col("url")).alias("name")), [], "SELECT page_id, CASE WHEN n = '' THEN 'export' ELSE n END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9 _.-]+', '-', 'g'), '-+', '-', 'g'), '^[-. ]+|[-. ]+$', '', 'g') AS n FROM pages)"),
    "h14_gains": (lambda s, d: view(s, d, "v_clips").select("clip_id", *[F.round(c, 6).alias(n) for c, n in zip((*fn.equal_power(F.col("in_ms") / 10000.0), fn.fade_gain(F.col("in_ms").cast("double"), F.lit(10000.0), F.lit(2000.0), F.lit(3000.0))), ("out_gain", "in_gain", "fade"))]), ["v_clips"], "SELECT clip_id, round(cos(in_ms / 10000.0 * pi() / 2), 6) AS out_gain, round(sin(in_ms / 10000.0 * pi() / 2), 6) AS in_gain, round(greatest(0.0, least(least(1.0, in_ms / 2000.0), least(1.0, (10000.0 - in_ms) / 3000.0))), 6) AS fade FROM v_clips"),
    "h15_levels": (lambda s, d: view(s, d, "v_pcm").select("source_id", "i", F.round(fn.level_db(F.abs("x_milli") / 1000.0), 6).alias("db")), ["v_pcm"], "SELECT source_id, i, round(CASE WHEN x_milli = 0 THEN -60.0 ELSE greatest(-60.0, 20 * log10(abs(x_milli) / 1000.0)) END, 6) AS db FROM v_pcm"),
    "d26_gram_ratio": (lambda s, d: view(s, d, "conversations").select("conv_id", "turn", fn.gram_ratio(F.col("text")).alias("ratio")), [], None),
    "b13_error_classes": (lambda s, d: view(s, d, "pages").select("page_id", fn.error_class(_message()).alias("i"), fn.error_class(_message(), "export").alias("e")).select("page_id", F.col("i.code").alias("import_code"), F.col("i.severity").alias("severity"), F.col("i.hint").alias("hint"), F.col("e.code").alias("export_code")), [], f"SELECT page_id, {_classes('import', 0)} AS import_code, {_classes('import', 1)} AS severity, {_classes('import', 2)} AS hint, {_classes('export', 0)} AS export_code FROM (SELECT page_id, lower({MESSAGE_SQL}) AS m FROM pages)"),
    "b21_normalised_segments": (lambda s, d: cap.normalised_segments(_words(s, d)), ["v_segments"], f"WITH {WORDS} SELECT track_id, seg_id, greatest(0, start_ms) AS start_ms, greatest(50, dur_ms) AS dur_ms, CASE WHEN seg_id % 4 = 0 THEN 0 ELSE 2 END AS n_words FROM ws"),
    "h12_active_word": (lambda s, d: cap.active_word(_words(s, d), 450), ["v_segments"], f"WITH {WORDS} SELECT track_id, seg_id, CASE WHEN 450 < 400 + seg_id % 7 * 20 THEN 0 WHEN seg_id % 4 = 0 THEN 1 ELSE -1 END AS word_no FROM ws"),
    "g15_split_segments": (lambda s, d: cap.split_segments(_seg(s, d), 1), ["v_segments"], "SELECT track_id, seg_id, 0 AS part, start_ms, dur_ms * 1 // 2 AS dur_ms, split_part(text, ' ', 1) AS text FROM v_segments UNION ALL SELECT track_id, seg_id, 1, start_ms + dur_ms // 2, dur_ms - dur_ms // 2, split_part(text, ' ', 2) FROM v_segments"),
    "g15_merged_segments": (lambda s, d: cap.merged_segments(_seg(s, d).withColumn("part", F.expr("seg_id % 5")), "part"), ["v_segments"], "SELECT track_id, seg_id % 5 AS part, min(start_ms) AS start_ms, max(start_ms + dur_ms) AS end_ms, string_agg(text, ' ' ORDER BY start_ms, seg_id) AS text FROM v_segments GROUP BY 1, 2"),
    "a8_vtt_files": (lambda s, d: cap.vtt_files(_seg(s, d)), ["v_segments"], f"SELECT track_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(replace({SRT_T.format('start_ms')}, ',', '.') || ' --> ' || replace({SRT_T.format('(start_ms + dur_ms)')}, ',', '.') || chr(10) || text, chr(10) || chr(10) ORDER BY start_ms, seg_id) || chr(10) AS vtt FROM v_segments GROUP BY 1"),
    "a7_parse_vtt": (lambda s, d: cap.parse_vtt(_damaged_vtt(s, d)), ["v_segments"], f"WITH {ORDERED} SELECT track_id, CAST(n AS INTEGER) AS cue, start_ms, end_ms, text FROM o"),
    "h10_drafts": (lambda s, d: view(s, d, "conversations").select("conv_id", "turn", fn.parsed_draft(F.concat(F.lit("Sure!\nTitles: "), F.replace("text", F.lit(" "), F.lit("\n")), F.lit("\nHASHTAGS: #a b #"), F.col("turn"), F.lit("\n#c #d #e #f #g\nCaption:  "), F.col("text"), F.lit("\n"))).alias("d")).select("conv_id", "turn", F.array_join("d.titles", "|").alias("titles"), F.array_join("d.hashtags", "|").alias("hashtags"), F.col("d.caption").alias("caption")), [], "SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(replace(text, ' ', chr(10)), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1:3], '|') AS titles, '#a|#' || turn || '|#c|#d|#e' AS hashtags, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS caption FROM conversations"),
    "h6_stable_digests": (lambda s, d: (lambda r: r.select("source_id", F.sha2(F.concat(F.lit("ns:"), fn.canonical_json(r, "doc")), 256).alias("digest")))(_src(s, d).select("source_id", F.struct("width", F.struct(F.col("file_name").alias("name"), F.col("byte_size").alias("bytes")).alias("file"), F.array(F.struct(F.lit(2).alias("b"), F.lit(1).alias("a"))).alias("marks")).alias("doc"))), ["v_sources"], """SELECT source_id, sha256('ns:{"file":{"bytes":' || byte_size || ',"name":"' || file_name || '"},"marks":[{"a":1,"b":2}],"width":' || width || '}') AS digest FROM v_sources"""),
    "h8_stable_ids": (lambda s, d: _src(s, d).select("source_id", fn.stable_id(F.concat_ws(":", "project_id", "source_id")).alias("stable_id")), ["v_sources"], "SELECT source_id, " + " || ".join(f"lpad(lower(to_hex(list_reduce(list_prepend(CAST({seed} AS BIGINT), list_transform(string_split(project_id || ':' || source_id, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) & 4294967295))), 8, '0')" for seed in (0x811C9DC5, 0x01000193)) + " AS stable_id FROM v_sources"),
    "h4_safe_summaries": (lambda s, d: op.safe_summaries(_described(s, d)), ["v_sources", "v_tracks"], "WITH c AS (SELECT source_id, string_agg(codec, ',' ORDER BY track_no) AS codecs, bool_or(kind = 'video' AND NOT can_decode) AS bv, bool_or(kind = 'audio' AND NOT can_decode) AS ba, bool_or(kind = 'video') AS v FROM v_tracks GROUP BY 1) SELECT source_id, 'source-' || row_number() OVER (PARTITION BY project_id ORDER BY source_id) AS alias, CASE WHEN fps_code = 2 AND width > 4500 THEN 'offline' WHEN v THEN 'video' ELSE 'audio' END AS media_kind, 'mp4' AS container, codecs, CASE WHEN duration_ms * 97 < 10000 THEN '<10s' WHEN duration_ms * 97 < 60000 THEN '10s-1m' WHEN duration_ms * 97 < 600000 THEN '1m-10m' WHEN duration_ms * 97 < 3600000 THEN '10m-1h' ELSE '>1h' END AS duration, CASE WHEN x = '' THEN 'ok' ELSE x END AS status FROM (SELECT *, concat_ws(',', CASE WHEN fps_code = 2 AND width > 4500 THEN 'offline' END, CASE WHEN bv THEN 'video-decode-unsupported' END, CASE WHEN ba THEN 'audio-decode-unsupported' END) AS x FROM v_sources JOIN c USING (source_id))"),
    "a3_event_log": (lambda s, d: ev.parse_event_log(_logs(s, d)), ["v_events"], "SELECT session_id AS log_id, CAST(n AS INTEGER) AS n, kind, CAST(t_us AS DOUBLE) AS t, least(1.0, x_milli / 500.0) AS x, least(1.0, y_milli / 1000.0) AS y, CASE WHEN kind = 'scroll' THEN y_milli - 500.0 END AS delta_y FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id) - 1 AS n FROM v_events) WHERE session_id % 7 <> 0 AND kind IN ('click', 'scroll', 'key')"),
    "a2_sidecar": (lambda s, d: ev.parse_sidecar(view(s, d, "v_manifest")), ["v_manifest"], "SELECT session_id, line_no, json_extract_string(line, '$.kind') AS kind FROM (SELECT * FROM v_manifest WHERE json_valid(line)) WHERE json_extract_string(line, '$.kind') <> ''"),
    "i4_spill_plan": (lambda s, d: ev.spill_plan(view(s, d, "v_events").select("session_id", "event_id", "t_us", F.col("x_milli").alias("bytes"), (F.col("event_id") % 3 == 0).alias("keyframe")), 5000), ["v_events"], "WITH b AS (SELECT *, coalesce(sum(x_milli) OVER (PARTITION BY session_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM v_events), e AS (SELECT session_id, min(b) AS e FROM b WHERE event_id % 3 = 0 AND b >= 5000 GROUP BY 1) SELECT session_id, count(*) AS n, CAST(sum(x_milli) AS BIGINT) AS bytes FROM b JOIN e USING (session_id) WHERE b < e GROUP BY 1"),
    "h23_iso_times": (lambda s, d: view(s, d, "v_events").select("event_id", F.date_format(F.timestamp_millis(F.expr("t_us div 1000")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso")), ["v_events"], "SELECT event_id, strftime(make_timestamp(t_us // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM v_events"),
    "a7_vtt_diagnostics": (lambda s, d: cap.vtt_diagnostics(_damaged_vtt(s, d)), ["v_segments"], f"WITH {ORDERED}, q AS (SELECT *, max(end_ms) OVER (PARTITION BY track_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM o) SELECT track_id, n AS cue, 'overlap' AS code FROM q WHERE start_ms < p UNION ALL SELECT track_id, n, 'ignored-settings' FROM q WHERE end_ms // 1000 % 5 = 0 UNION ALL SELECT DISTINCT track_id, 0, 'missing-header' FROM o WHERE track_id % 4 = 0"),
    "a6_srt_diagnostics": (lambda s, d: cap.srt_diagnostics(_damaged_srt(s, d)), ["v_segments"], f"WITH {SRT_PROBLEMS} SELECT track_id, cue, problem FROM sr WHERE problem <> 'ok'"),
    "a6_parsed_cues": (lambda s, d: cap.parsed_cues(_damaged_srt(s, d)), ["v_segments"], f"WITH {SRT_PROBLEMS} SELECT track_id, cue, start_ms, end_ms, text FROM sr WHERE problem IN ('ok', 'overlap')"),
    "h1_parsed_timecodes": (lambda s, d: view(s, d, "v_clips").select("clip_id", fn.parsed_timecode(fn.timecode(F.expr("start_ms div 40"), 25), 25).alias("frames"), fn.parsed_timecode(fn.timecode(F.expr("start_ms div 40"), 25), 20).alias("other")), ["v_clips"], "SELECT clip_id, start_ms // 40 AS frames, CASE WHEN start_ms // 40 % 25 < 20 THEN start_ms // 1000 * 20 + start_ms // 40 % 25 END AS other FROM v_clips"),
    "h9_templates": (lambda s, d: _src(s, d).select("source_id", fn.expanded_template(F.when(F.col("fps_code") == 1, "{project}-{other}").otherwise("{project} {index} {name}"), {"project": F.col("project_id"), "index": F.col("source_id"), "name": fn.safe_file_name(F.col("file_name"))}).alias("name")), ["v_sources"], "SELECT source_id, CASE WHEN fps_code <> 1 THEN project_id || ' ' || source_id || ' ' || file_name END AS name FROM v_sources"),
    "h7_clip_keys": (lambda s, d: op.clip_dependency_keys(view(s, d, "v_clips"), op.canonical_keys(_src(s, d))), ["v_clips", "v_sources"], """SELECT clip_id, sha256('{"duration_ms":' || dur_ms || ',"in_ms":' || in_ms || ',"source":"' || sha256('{"byte_size":' || byte_size || ',"duration_ms":' || duration_ms || ',"file_name":"' || file_name || '","width":' || width || '}') || '","start_ms":' || start_ms || '}') AS key FROM v_clips JOIN v_sources USING (source_id)"""),
    "h14_pan": (lambda s, d: view(s, d, "v_clips").select("clip_id", *[F.round(c, 6).alias(n) for c, n in zip((*fn.balance_pan(F.col("in_ms") / 4000.0 - 1.2), *fn.equal_power_pan(F.col("in_ms") / 4000.0 - 1.2)), ("balance_l", "balance_r", "power_l", "power_r"))]), ["v_clips"], "SELECT clip_id, round(least(1.0, 1 - p), 6) AS balance_l, round(least(1.0, 1 + p), 6) AS balance_r, round(cos((p + 1) * pi() / 4), 6) AS power_l, round(sin((p + 1) * pi() / 4), 6) AS power_r FROM (SELECT clip_id, greatest(-1.0, least(1.0, in_ms / 4000.0 - 1.2)) AS p FROM v_clips)"),
}


def queries():
    return {name: query for name, (query, _, _) in PLANS.items()}


def oracle_sql():
    return {name: sql_with(reads, sql) for name, (_, reads, sql) in PLANS.items() if sql}

"""Queries of the capture-event operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeloom.operators import events as op
from timeloom.sources.views import sql_with, view

_NUM = "json_type(line, '$.{0}') IN ('UBIGINT', 'BIGINT', 'DOUBLE')"
_STR = "json_type(line, '$.{0}') = 'VARCHAR'"
_ALL = lambda kind, strings, numbers, more="": f"WHEN '{kind}' THEN " + " AND ".join([*(_STR.format(x) for x in strings), *(_NUM.format(x) for x in numbers)]) + more
_RULES = " ".join([
    _ALL("header", ("sessionId", "startedAtIso"), ("chunkTargetS",), " AND json_extract_string(line, '$.version') = '1' AND coalesce(list_bool_and(list_transform(json_extract_string(line, '$.sources[*].kind'), lambda x: x IN ('screen', 'webcam', 'mic', 'system-audio'))), true)"),
    _ALL("epoch", (), ("epochUs",)),
    _ALL("chunk", ("sourceId", "file"), ("byteOffset", "byteLength", "fromUs", "toUs", "preEncodeDrops"), " AND json_type(line, '$.keyFrame') = 'BOOLEAN'"),
    _ALL("source-ended", ("sourceId", "reason"), ()),
    _ALL("finalize", ("endedAtIso", "reason"), ()),
    _ALL("pause", (), ("atUs",)),
    _ALL("resume", (), ("atUs",)),
    _ALL("source-added", ("source.sourceId", "source.label"), ("atUs",), " AND json_extract_string(line, '$.source.kind') IN ('screen', 'webcam', 'mic', 'system-audio')"),
    _ALL("source-region-applied", ("sourceId",), ("atUs",), " AND json_extract_string(line, '$.mode') IN ('crop', 'element')"),
    _ALL("scene-switch", ("sceneId",), ("atUs",)),
])
_S = "json_extract_string(line, '$.{}')".format
_I = lambda x: f"TRY_CAST({_S(x)} AS BIGINT)"
MAN = f"m AS (SELECT session_id, line_no, {_S('kind')} AS kind, coalesce({_I('atUs')}, {_I('fromUs')}, {_I('epochUs')}) AS t_us, coalesce({_I('byteLength')}, 0) AS bytes, coalesce({_S('sourceId')}, {_S('source.sourceId')}) AS source_id, {_I('toUs')} AS to_us, TRY_CAST({_S('keyFrame')} AS BOOLEAN) AS key_frame, {_I('preEncodeDrops')} AS drops, coalesce({_S('file')}, {_S('reason')}, {_S('mode')}, {_S('sceneId')}) AS detail FROM (SELECT * FROM v_manifest WHERE json_valid(line)) WHERE CASE {_S('kind')} {_RULES} END)"
PAIRS = MAN + ", p AS (SELECT session_id, pause_us, resume_us FROM (SELECT session_id, kind, t_us AS resume_us, lag(kind) OVER w AS k, lag(t_us) OVER w AS pause_us FROM m WHERE kind IN ('pause', 'resume') WINDOW w AS (PARTITION BY session_id ORDER BY t_us, line_no)) WHERE kind = 'resume' AND k = 'pause')"


def _man(s, d):
    return op.parse_manifest(view(s, d, "v_manifest"))


def _pairs(s, d):
    return op.pause_pairs(_man(s, d))


def _clusters(s, d):
    return op.pointer_clusters(view(s, d, "v_events"), 20_000_000_000, 400)


CLUSTERS = "WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t_us, event_id) AS k FROM v_events WHERE kind <> 'key'), f AS (SELECT session_id, k, t_us, t_us AS start_us, 1::BIGINT AS n, x_milli::BIGINT AS sx, y_milli::BIGINT AS sy, 1::BIGINT AS c FROM o WHERE k = 1 UNION ALL SELECT o.session_id, o.k, o.t_us, CASE WHEN j THEN f.start_us ELSE o.t_us END, CASE WHEN j THEN f.n + 1 ELSE 1 END, CASE WHEN j THEN f.sx + o.x_milli ELSE o.x_milli END, CASE WHEN j THEN f.sy + o.y_milli ELSE o.y_milli END, CASE WHEN j THEN f.c ELSE f.c + 1 END FROM f JOIN o ON o.session_id = f.session_id AND o.k = f.k + 1, LATERAL (SELECT o.t_us - f.start_us <= 20000000000 AND (o.x_milli - f.sx::DOUBLE / f.n) ** 2 + (o.y_milli - f.sy::DOUBLE / f.n) ** 2 <= 160000 AS j)), cl AS (SELECT session_id, min(t_us) AS start_us, max(t_us) AS end_us, max(n) AS n, max_by(sx, k) AS sx, max_by(sy, k) AS sy FROM f GROUP BY session_id, c)"
ZOOMS = CLUSTERS + ", z AS (SELECT session_id, greatest(0, start_us - 400000) AS in_us, end_us + 1000000 AS out_us, n, sx, sy FROM cl), y AS (SELECT *, sum(CASE WHEN p IS NULL OR in_us - p >= 50000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY in_us, out_us ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, max(out_us) OVER (PARTITION BY session_id ORDER BY in_us, out_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM z)), zp AS (SELECT session_id, min(in_us) AS in_us, max(out_us) AS out_us, CAST(sum(n) AS BIGINT) AS n, CAST(sum(sx) // sum(n) AS BIGINT) AS x_milli, CAST(sum(sy) // sum(n) AS BIGINT) AS y_milli FROM y GROUP BY session_id, i)"


def _zooms(s, d):
    return op.zoom_proposals(_clusters(s, d), 400_000, 1_000_000)


def _keys_pressed(s, d):
    return view(s, d, "v_events").selectExpr("event_id", "get(array('a', 'Enter', 'Z', 'é', 'F5'), CAST(event_id % 5 AS INT)) AS key", "x_milli % 4 = 0 AS ctrl", "y_milli % 6 = 0 AS meta", "x_milli % 7 = 0 AS alt", "session_id % 9 = 0 AND x_milli % 2 = 0 AS in_field")


PLANS = {
    "a1_parse_manifest": (_man, ["v_manifest"], f"WITH {MAN} SELECT * FROM m"),
    "a1_dropped_lines": (lambda s, d: op.dropped_lines(view(s, d, "v_manifest")), ["v_manifest"], f"WITH {MAN} SELECT session_id, count(*) - count(m.line_no) AS n_dropped FROM v_manifest v LEFT JOIN m USING (session_id, line_no) GROUP BY session_id"),
    "e8_pause_pairs": (_pairs, ["v_manifest"], f"WITH {PAIRS} SELECT * FROM p"),
    "e9_seam_markers": (lambda s, d: op.seam_markers(_pairs(s, d)), ["v_manifest"], f"WITH {PAIRS} SELECT session_id, CAST(row_number() OVER w AS INTEGER) AS seam, CAST(pause_us - coalesce(sum(resume_us - pause_us) OVER (PARTITION BY session_id ORDER BY resume_us, pause_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_us FROM p WINDOW w AS (PARTITION BY session_id ORDER BY resume_us, pause_us)"),
    "c13_collapsed": (lambda s, d: op.collapsed(view(s, d, "v_events"), _pairs(s, d)), ["v_manifest"], f"WITH {PAIRS} SELECT e.event_id, e.session_id, CAST(e.t_us - coalesce(sum(resume_us - pause_us), 0) AS BIGINT) AS collapsed_us FROM v_events e LEFT JOIN p ON p.session_id = e.session_id AND p.resume_us <= e.t_us GROUP BY e.event_id, e.session_id, e.t_us"),
    "e13_landings": (lambda s, d: (lambda m: op.landings(m, op.pause_pairs(m), m.filter("kind = 'chunk'").groupBy("session_id").agg(F.min("t_us").alias("epoch_us"))))(_man(s, d)), ["v_manifest"], f"WITH {PAIRS}, ep AS (SELECT session_id, min(t_us) AS ep FROM m WHERE kind = 'chunk' GROUP BY 1), c AS (SELECT m.session_id, m.source_id, m.line_no, CAST(m.t_us - coalesce(sum(resume_us - pause_us), 0) AS BIGINT) AS t FROM m LEFT JOIN p ON p.session_id = m.session_id AND p.resume_us <= m.t_us WHERE m.kind = 'chunk' GROUP BY m.session_id, m.source_id, m.line_no, m.t_us) SELECT c.session_id, c.source_id, greatest(0, min(t) - any_value(ep)) AS start_us, greatest(max(t) - min(t), 100000) AS dur_us FROM c JOIN ep USING (session_id) GROUP BY c.session_id, c.source_id"),
    "i13_chunk_totals": (lambda s, d: op.chunk_totals(_man(s, d)), ["v_manifest"], f"WITH {MAN} SELECT session_id, source_id, count(*) AS n_chunks, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(drops) AS BIGINT) AS drops, min(t_us) AS first_us, max(to_us) AS last_us FROM m WHERE kind = 'chunk' GROUP BY 1, 2"),
    "d22_capture_epochs": (lambda s, d: _man(s, d).filter("kind = 'chunk'").groupBy((F.col("session_id") % 10).alias("project_id")).agg(F.min("t_us").alias("epoch_us")), ["v_manifest"], f"WITH {MAN} SELECT session_id % 10 AS project_id, min(t_us) AS epoch_us FROM m WHERE kind = 'chunk' GROUP BY 1"),
    "i9_sessions": (lambda s, d: op.sessions(view(s, d, "v_events"), 40_000_000_000), ["v_events"], "SELECT session_id, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n FROM (SELECT *, sum(CASE WHEN g IS NULL OR g > 40000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, t_us - lag(t_us) OVER (PARTITION BY session_id ORDER BY t_us, event_id) AS g FROM v_events)) GROUP BY session_id, k"),
    "e14_pointer_clusters": (_clusters, ["v_events"], CLUSTERS + " SELECT session_id, start_us, end_us, n, sx, sy FROM cl"),
    "e15_zoom_proposals": (_zooms, ["v_events"], ZOOMS + " SELECT * FROM zp"),
    "e16_zoom_ramps": (lambda s, d: op.zoom_ramps(_zooms(s, d), 300_000), ["v_events"], ZOOMS + " SELECT session_id, in_us, point, CASE point WHEN 0 THEN in_us WHEN 1 THEN in_us + 300000 WHEN 2 THEN out_us - 300000 ELSE out_us END AS t_us, CASE WHEN point IN (1, 2) THEN 200 ELSE 100 END AS scale_pct FROM zp, (SELECT CAST(range AS INTEGER) AS point FROM range(4))"),
    "e17_key_overlays": (lambda s, d: op.key_overlays(view(s, d, "v_events"), 9_000_000_000, 4, 30_000_000_000).fillna(-1, ["end_us"]), ["v_events"],
        "WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t_us, event_id) AS k FROM v_events), f AS (SELECT session_id, k, t_us AS s, t_us AS e, 1::BIGINT AS n, kind AS text, 1::BIGINT AS c FROM o WHERE k = 1 UNION ALL SELECT o.session_id, o.k, CASE WHEN j THEN f.s ELSE o.t_us END, o.t_us, CASE WHEN j THEN f.n + 1 ELSE 1 END, CASE WHEN j THEN f.text || ' ' || o.kind ELSE o.kind END, CASE WHEN j THEN f.c ELSE f.c + 1 END FROM f JOIN o ON o.session_id = f.session_id AND o.k = f.k + 1, LATERAL (SELECT o.t_us - f.e < 9000000000 AND f.n < 4 AND o.t_us - f.s <= 30000000000 AS j)), g AS (SELECT session_id, min(s) AS s, max(e) AS e, max(n) AS n, max_by(text, k) AS text FROM f GROUP BY session_id, c) SELECT session_id, s AS start_us, least(e + 9000000000, coalesce(lead(s) OVER (PARTITION BY session_id ORDER BY s), e + 9000000000)) AS end_us, n, text FROM g"),
    "b20_recorded_keys": (lambda s, d: op.recorded_keys(_keys_pressed(s, d)).select("event_id", "key"), ["v_events"],
        "SELECT event_id, key FROM (SELECT *, ['a', 'Enter', 'Z', 'é', 'F5'][1 + event_id % 5] AS key FROM v_events) WHERE NOT (session_id % 9 = 0 AND x_milli % 2 = 0) AND (event_id % 5 IN (1, 4) OR x_milli % 4 = 0 OR y_milli % 6 = 0 OR x_milli % 7 = 0)"),
    "b20_private_keys": (lambda s, d: op.private_keys_dropped(view(s, d, "v_events"), F.expr("kind = 'click'"), F.expr("x_milli % 4 = 0")), ["v_events"], "SELECT * FROM v_events WHERE NOT kind = 'click' OR x_milli % 4 = 0"),
    "e27_publish_rates": (lambda s, d: op.publish_rates(view(s, d, "v_events").withColumn("total", F.col("event_id") * 1000 % 700001)), ["v_events"], "SELECT session_id, event_id, coalesce(CASE WHEN t_us > t THEN greatest(0, total - b) * 8000000 // (t_us - t) END, 0) AS bps FROM (SELECT *, lag(total) OVER w AS b, lag(t_us) OVER w AS t FROM (SELECT *, event_id * 1000 % 700001 AS total FROM v_events) WINDOW w AS (PARTITION BY session_id ORDER BY t_us, event_id))"),
    "e28_coalesced_edits": (lambda s, d: op.coalesced_edits(view(s, d, "v_events"), 20_000_000_000, 20), ["v_events"], "WITH i AS (SELECT *, sum(CASE WHEN lk = kind AND t_us - lt <= 20000000000 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, lag(kind) OVER w AS lk, lag(t_us) OVER w AS lt FROM v_events WINDOW w AS (PARTITION BY session_id ORDER BY t_us, event_id))) SELECT session_id, kind, first_us, last_us, n FROM (SELECT session_id, k, min(kind) AS kind, min(t_us) AS first_us, max(t_us) AS last_us, count(*) AS n FROM i GROUP BY session_id, k) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY k DESC) <= 20"),
    "d20_error_rollup": (lambda s, d: op.error_rollup(view(s, d, "v_events")), ["v_events"], "SELECT session_id, kind, min(t_us) AS first_us, arg_max(event_id, (t_us, event_id)) AS latest_id, max(t_us) AS last_us, count(*) AS n FROM v_events GROUP BY ALL"),
    "f3_newest_errors": (lambda s, d: op.newest_errors(op.error_rollup(view(s, d, "v_events")), 3), ["v_events"], "WITH r AS (SELECT session_id, kind, min(t_us) AS first_us, arg_max(event_id, (t_us, event_id)) AS latest_id, max(t_us) AS last_us, count(*) AS n FROM v_events GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY last_us DESC, kind) AS INTEGER) AS rank FROM r) WHERE rank <= 3"),
    "i7_rolling_means": (lambda s, d: op.rolling_means(view(s, d, "v_events"), 50_000_000_000, 30), ["v_events"], "SELECT session_id, event_id, round(mean, 6) AS mean FROM (SELECT *, avg(x_milli) OVER (PARTITION BY session_id ORDER BY t_us RANGE BETWEEN 50000000000 PRECEDING AND CURRENT ROW) AS mean, row_number() OVER (PARTITION BY session_id ORDER BY t_us DESC, event_id DESC) AS r FROM v_events) WHERE r <= 30"),
    "i6_hopping_windows": (lambda s, d: op.hopping_windows(view(s, d, "v_sources").select("source_id", F.expr("duration_ms div 1000 * 7").alias("duration_s"))), ["v_sources"],
        "WITH u AS (SELECT source_id, duration_ms // 1000 * 7 AS ds FROM v_sources), n AS (SELECT source_id, ds, unnest(range(0, greatest(0, (ds - 5 + 24) // 25 - 1) + 1)) AS n FROM u WHERE ds > 0) SELECT source_id, n, n * 25 AS start_s, least(n * 25 + 30, ds) AS end_s, CASE WHEN n = 0 THEN 0 ELSE n * 25 + 2 END AS from_s, CASE WHEN n * 25 + 30 >= ds THEN least(n * 25 + 30, ds) ELSE n * 25 + 27 END AS to_s FROM n"),
    "i1_bounded_intake": (lambda s, d: op.bounded_intake(view(s, d, "v_events"), 600_000_000_000, 20), ["v_events"], "SELECT session_id, t_us // 600000000000 AS period, least(count(*), 20) AS kept, greatest(count(*) - 20, 0) AS dropped FROM v_events GROUP BY ALL"),
    "i1_ring_intake": (lambda s, d: (lambda e: op.ring_intake(e.filter("kind <> 'click'"), e.filter("kind = 'click'"), 3))(view(s, d, "v_events")), ["v_events"],
        "SELECT session_id, event_id, period, least(n, 3) AS held, n <= 3 AS kept FROM (SELECT *, row_number() OVER (PARTITION BY session_id, period ORDER BY t_us, event_id) AS n FROM (SELECT session_id, event_id, t_us, kind, dense - CASE WHEN kind = 'click' THEN 1 ELSE 0 END AS period FROM (SELECT *, (SELECT count(DISTINCT c.t_us) FROM v_events c WHERE c.kind = 'click' AND c.session_id = e.session_id AND c.t_us < e.t_us) AS dense FROM v_events e WHERE kind <> 'click')))"),
    "i1_ring_drains": (lambda s, d: (lambda e: op.ring_drains(e.filter("kind <> 'click'"), e.filter("kind = 'click'"), 3))(view(s, d, "v_events")), ["v_events"],
        "WITH c AS (SELECT session_id, t_us, row_number() OVER (PARTITION BY session_id ORDER BY t_us) AS k, coalesce(lag(t_us) OVER (PARTITION BY session_id ORDER BY t_us), -1) AS p FROM (SELECT DISTINCT session_id, t_us FROM v_events WHERE kind = 'click')), n AS (SELECT c.session_id, c.t_us, c.k, count(e.event_id) AS n FROM c LEFT JOIN v_events e ON e.session_id = c.session_id AND e.kind <> 'click' AND e.t_us > p AND e.t_us <= c.t_us GROUP BY ALL) SELECT session_id, t_us, least(n, 3) AS n_read, CAST(sum(greatest(n - 3, 0)) OVER (PARTITION BY session_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS dropped FROM n"),
    "e12_scene_intervals": (lambda s, d: op.scene_intervals(view(s, d, "v_events"), F.lit(1_800_000_000_000_000)), ["v_events"], "SELECT * FROM (SELECT session_id, kind, t_us AS start_us, coalesce(lead(t_us) OVER (PARTITION BY session_id ORDER BY t_us, event_id), 1800000000000000) AS end_us FROM v_events) WHERE end_us > start_us"),
    "i3_replay_snapshot": (lambda s, d: (lambda e: op.replay_snapshot(e.select("session_id", "t_us", F.expr("event_id % 30 = 0 AND session_id % 5 <> 0").alias("keyframe"), F.col("x_milli").alias("bytes")), e.filter("kind = 'click'").select(F.col("event_id").alias("request_id"), "session_id", (F.col("t_us") - 30_000_000_000).alias("start_us"), F.col("t_us").alias("end_us")), 40_000_000_000))(view(s, d, "v_events")), ["v_events"],
        "WITH c AS (SELECT *, event_id % 30 = 0 AND session_id % 5 <> 0 AS kf FROM v_events), q AS (SELECT event_id AS request_id, session_id, t_us - 30000000000 AS s, t_us AS e FROM v_events WHERE kind = 'click'), b AS (SELECT q.*, (SELECT max(t_us) FROM c WHERE c.session_id = q.session_id AND kf AND t_us <= s) AS k, (SELECT min(t_us) FROM c WHERE c.session_id = q.session_id AND kf AND t_us >= s AND t_us <= e) AS n, q.session_id IN (SELECT session_id FROM c WHERE kf) AS v FROM q), f AS (SELECT *, CASE WHEN v THEN coalesce(k, n) ELSE s END AS from_us FROM b) SELECT request_id, from_us, count(*) AS n, CAST(sum(x_milli) AS BIGINT) AS bytes FROM f JOIN c ON c.session_id = f.session_id AND t_us BETWEEN from_us AND e GROUP BY 1, 2"),
}


def queries():
    return {name: query for name, (query, _, _) in PLANS.items()}


def oracle_sql():
    return {name: sql_with(reads, sql) for name, (_, reads, sql) in PLANS.items() if sql}

"""Queries of the interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeloom.operators import intervals as op
from timeloom.operators.helpers import written
from timeloom.sources.views import sql_with, view

RANGES_SQL = "r AS (SELECT DISTINCT project_id, CAST(project_id % 7 * 5000 + 1000 AS BIGINT) AS cut_start, CAST(project_id % 7 * 5000 + 21000 AS BIGINT) AS cut_end FROM v_timeline)"


def _ranges(t):
    return t.select("project_id").distinct().select("project_id", (F.col("project_id") % 7 * 5000 + 1000).alias("cut_start"), (F.col("project_id") % 7 * 5000 + 21000).alias("cut_end"))


def _points(spark, d):
    return view(spark, d, "v_points").withColumn("t_ms", F.col("t_ms") * 7 % 700000)


POINTS_SQL = "p AS (SELECT point_id, project_id, t_ms * 7 % 700000 AS t_ms FROM v_points)"

#: The regions of each project as a union (a to b), and the pieces that their edges cut clips into; {} is the rule of target tracks.
MERGED = "rg0 AS (SELECT *, max(cut_end) OVER (PARTITION BY project_id ORDER BY cut_start, cut_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM v_regions), rg1 AS (SELECT *, sum(CASE WHEN pm IS NULL OR cut_start > pm THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY cut_start, cut_end ROWS UNBOUNDED PRECEDING) AS k FROM rg0), mr AS (SELECT project_id, min(cut_start) AS a, max(cut_end) AS b FROM rg1 GROUP BY project_id, k)"
PIECES = MERGED + ", ed AS (SELECT c.project_id, c.track_no, c.clip_id, unnest([greatest(a, start_ms), least(b, start_ms + dur_ms)]) AS s FROM v_timeline c JOIN mr ON mr.project_id = c.project_id AND start_ms < b AND a < start_ms + dur_ms WHERE {0} UNION SELECT project_id, track_no, clip_id, start_ms FROM v_timeline UNION SELECT project_id, track_no, clip_id, start_ms + dur_ms FROM v_timeline), pc AS (SELECT * FROM (SELECT *, row_number() OVER w - 1 AS piece_no, lead(s) OVER w AS n FROM ed WINDOW w AS (PARTITION BY clip_id ORDER BY s)) WHERE n IS NOT NULL), pp AS (SELECT pc.project_id, pc.track_no, pc.clip_id, CAST(piece_no AS INTEGER) AS piece_no, s, n - s AS d, in_ms + s - start_ms AS i, ({0}) AND EXISTS (SELECT 1 FROM mr WHERE mr.project_id = pc.project_id AND a <= s AND n <= b) AS inside FROM pc JOIN v_timeline c USING (clip_id, project_id, track_no))"


#: A ripple delete; what is deleted beyond the chosen clips, and what else refuses, are filled in.
RIPPLE = "WITH x0 AS (SELECT *, track_no < 2 AND in_ms < 90 AS own_gone, track_no = 3 AND project_id % 4 = 1 AS sync FROM v_timeline), {groups}x AS MATERIALIZED (SELECT *, {gone} AS gone FROM x0), y AS (SELECT *, CAST(coalesce(sum(CASE WHEN gone THEN dur_ms ELSE 0 END) OVER (PARTITION BY project_id, track_no ORDER BY start_ms, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS g FROM x), pt AS MATERIALIZED (SELECT project_id, track_no, CAST(sum(dur_ms) AS BIGINT) AS total, min(start_ms) AS f FROM x WHERE gone GROUP BY 1, 2), bt AS MATERIALIZED (SELECT project_id, total AS bt, f AS bf FROM pt QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY total DESC, track_no) = 1), z AS (SELECT y.*, pt.f IS NOT NULL AS own, sync AND pt.f IS NULL AND bf IS NOT NULL AS fol, bt, bf FROM y LEFT JOIN pt USING (project_id, track_no) LEFT JOIN bt USING (project_id)), v AS MATERIALIZED (SELECT *, CASE WHEN own THEN start_ms - g WHEN fol AND start_ms >= bf THEN greatest(0, start_ms - bt) ELSE start_ms END AS t FROM z), h AS (SELECT *, lag(t + dur_ms) OVER (PARTITION BY project_id, track_no ORDER BY t, clip_id) AS e FROM v WHERE NOT gone), no AS MATERIALIZED (SELECT DISTINCT project_id, true AS no FROM h WHERE t < e OR (fol AND start_ms < bf AND bf < start_ms + dur_ms){refuse}) SELECT v.project_id, track_no, clip_id, CASE WHEN no THEN start_ms ELSE t END AS start_ms, dur_ms, in_ms, no IS NULL AS accepted FROM v LEFT JOIN no ON no.project_id = v.project_id WHERE NOT gone OR no"


def _locks(t):
    """One locked track of some projects."""
    return t.select("project_id").distinct().filter("project_id % 9 = 4").selectExpr("project_id", "CAST(project_id % 4 AS BIGINT) AS track_no")


def _inserts(t):
    at = t.filter("track_no = 0").groupBy("project_id").agg(F.max("start_ms").alias("at_ms"))
    return at.selectExpr("project_id", "CAST(0 AS BIGINT) AS track_no", "-project_id AS clip_id", "at_ms", "CAST(4000 AS BIGINT) AS dur_ms")


#: name: (query, views, SQL)
PLANS = {
    "e1_range_union": (lambda s, d: op.range_union(view(s, d, "v_clips").withColumn("end_ms", F.expr("start_ms + dur_ms")), op.TRACK), ["v_clips"],
        "WITH m AS (SELECT *, start_ms + dur_ms AS end_ms, max(start_ms + dur_ms) OVER (PARTITION BY project_id, track_no ORDER BY start_ms, start_ms + dur_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM v_clips), i AS (SELECT *, sum(CASE WHEN pm IS NULL OR start_ms > pm THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, track_no ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT project_id, track_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_ranges FROM i GROUP BY project_id, track_no, k"),
    "b1_normalised_ranges": (lambda s, d: op.normalised_ranges(view(s, d, "v_clips").select("clip_id", (F.col("start_ms") - 500000).alias("a_ms"), F.col("in_ms").alias("b_ms")), "a_ms", "b_ms"), ["v_clips"],
        "SELECT clip_id, greatest(0, least(start_ms - 500000, in_ms)) AS a_ms, greatest(0, greatest(start_ms - 500000, in_ms)) AS b_ms FROM v_clips WHERE greatest(0, least(start_ms - 500000, in_ms)) < greatest(0, greatest(start_ms - 500000, in_ms))"),
    "e2_track_overlaps": (lambda s, d: op.track_overlaps(view(s, d, "v_clips")), ["v_clips"],
        "SELECT project_id, track_no, count(*) FILTER (WHERE start_ms < l) AS n_overlaps FROM (SELECT *, lag(start_ms + dur_ms) OVER (PARTITION BY project_id, track_no ORDER BY start_ms, clip_id) AS l FROM v_clips) GROUP BY project_id, track_no"),
    "d1_durations": (lambda s, d: op.durations(view(s, d, "v_clips")), ["v_clips"], "SELECT project_id, max(start_ms + dur_ms) AS duration_ms FROM v_clips GROUP BY project_id"),
    "c1_resolve_at": (lambda s, d: op.resolve_at(_points(s, d), view(s, d, "v_timeline")), ["v_points", "v_timeline"],
        f"WITH {POINTS_SQL} SELECT point_id, track_no, clip_id, in_ms + t_ms - start_ms AS source_ms FROM p JOIN v_timeline c ON p.project_id = c.project_id AND start_ms <= t_ms AND t_ms < start_ms + dur_ms"),
    "c2_resolve_first": (lambda s, d: op.resolve_first(_points(s, d), view(s, d, "v_timeline")), ["v_points", "v_timeline"],
        f"WITH {POINTS_SQL} SELECT point_id, track_no, clip_id, in_ms + t_ms - start_ms AS source_ms FROM p JOIN v_timeline c ON p.project_id = c.project_id AND start_ms <= t_ms AND t_ms < start_ms + dur_ms QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY track_no, clip_id) = 1"),
    "c6_intersect": (lambda s, d: (lambda t: op.intersect_tracks(t.filter("track_no = 0"), t.filter("track_no = 1"), ["project_id"]))(view(s, d, "v_timeline").select(*op.TRACK, "start_ms", F.expr("start_ms + dur_ms").alias("end_ms"), F.col("in_ms").alias("peak"))), ["v_timeline"],
        "SELECT a.project_id, greatest(a.start_ms, b.start_ms) AS start_ms, least(a.start_ms + a.dur_ms, b.start_ms + b.dur_ms) AS end_ms, greatest(a.in_ms, b.in_ms) AS peak FROM v_timeline a JOIN v_timeline b ON a.project_id = b.project_id AND a.track_no = 0 AND b.track_no = 1 AND a.start_ms < b.start_ms + b.dur_ms AND b.start_ms < a.start_ms + a.dur_ms"),
    "c6_intersect_all": (lambda s, d: op.intersect_all(written(view(s, d, "v_timeline").select(*op.TRACK, "start_ms", F.expr("start_ms + dur_ms").alias("end_ms"), F.col("in_ms").alias("peak")), "ranges"), ["project_id"], "track_no"), ["v_timeline"],
        "WITH r AS (SELECT project_id, track_no, start_ms AS a, start_ms + dur_ms AS b, in_ms AS p FROM v_timeline), m AS (SELECT r.project_id, 0 AS k, a, b, p FROM r WHERE track_no = 0), x AS (SELECT m.project_id, greatest(m.a, r.a) AS a, least(m.b, r.b) AS b, greatest(m.p, r.p) AS p FROM m JOIN r ON r.project_id = m.project_id AND r.track_no = 1 AND m.a < r.b AND r.a < m.b), y AS (SELECT x.project_id, greatest(x.a, r.a) AS a, least(x.b, r.b) AS b, greatest(x.p, r.p) AS p FROM x JOIN r ON r.project_id = x.project_id AND r.track_no = 2 AND x.a < r.b AND r.a < x.b) SELECT y.project_id, greatest(y.a, r.a) AS start_ms, least(y.b, r.b) AS end_ms, greatest(y.p, r.p) AS peak FROM y JOIN r ON r.project_id = y.project_id AND r.track_no = 3 AND y.a < r.b AND r.a < y.b"),
    "c7_selected": (lambda s, d: op.selected(view(s, d, "v_timeline"), _ranges(view(s, d, "v_timeline")).select("project_id", F.col("cut_start").alias("start_ms"), F.col("cut_end").alias("end_ms"))), ["v_timeline"],
        f"WITH {RANGES_SQL} SELECT c.project_id, track_no, clip_id FROM v_timeline c JOIN r ON c.project_id = r.project_id AND start_ms < cut_end AND cut_start < start_ms + dur_ms"),
    "c8_snapped": (lambda s, d: op.snapped(_points(s, d), view(s, d, "v_timeline").select("project_id", F.col("start_ms").alias("target_ms")), 2000).fillna(-1, ["snap_ms"]), ["v_points", "v_timeline"],
        f"WITH {POINTS_SQL}, t AS (SELECT DISTINCT project_id, start_ms AS g FROM v_timeline), n AS (SELECT p.point_id, p.project_id, p.t_ms, g, row_number() OVER (PARTITION BY point_id ORDER BY abs(g - t_ms), g) AS k FROM p LEFT JOIN t ON p.project_id = t.project_id AND abs(g - t_ms) <= 2000) SELECT point_id, project_id, t_ms, coalesce(g, -1) AS snap_ms FROM n WHERE k = 1"),
    "c9_snap_targets": (lambda s, d: op.snap_targets(view(s, d, "v_timeline"), view(s, d, "v_points")), ["v_timeline", "v_points"],
        "SELECT project_id, start_ms AS target_ms FROM v_timeline UNION SELECT project_id, start_ms + dur_ms FROM v_timeline UNION SELECT project_id, t_ms FROM v_points UNION SELECT project_id, 0 FROM v_timeline"),
    "c14_clip_diff": (lambda s, d: op.clip_diff(view(s, d, "v_clips"), view(s, d, "v_clips_after").withColumn("dur_ms", F.col("dur_ms") + F.when(F.col("clip_id") % 19 == 0, 100).otherwise(0))), ["v_clips", "v_clips_after"],
        "WITH b AS (SELECT project_id, track_no, clip_id, source_id, start_ms, dur_ms + CASE WHEN clip_id % 19 = 0 THEN 100 ELSE 0 END AS dur_ms, in_ms FROM v_clips_after), j AS (SELECT clip_id, coalesce(a.project_id, b.project_id) AS project_id, CASE WHEN a.project_id IS NULL THEN 'added' WHEN b.project_id IS NULL THEN 'deleted' WHEN a.track_no <> b.track_no OR a.start_ms <> b.start_ms THEN 'moved' WHEN a.dur_ms <> b.dur_ms OR a.in_ms <> b.in_ms OR a.source_id <> b.source_id THEN 'edited' END AS change, least(a.start_ms, b.start_ms) AS start_ms, greatest(a.start_ms + a.dur_ms, b.start_ms + b.dur_ms) AS end_ms FROM v_clips a FULL JOIN b USING (clip_id)) SELECT * FROM j WHERE change IS NOT NULL"),
    "c15_source_impact": (lambda s, d: op.source_impact(view(s, d, "v_clips"), view(s, d, "v_sources").filter("fps_code = 0")), ["v_clips", "v_sources"],
        "SELECT source_id, count(*) AS n_clips, count(DISTINCT project_id) AS n_projects, min(start_ms) AS first_ms, max(start_ms + dur_ms) AS last_ms FROM v_clips WHERE source_id IN (SELECT source_id FROM v_sources WHERE fps_code = 0) GROUP BY source_id"),
    "c20_linked_groups": (lambda s, d: op.close_marked_groups(view(s, d, "v_clips"), F.expr("clip_id div 10000 % 5000"), F.expr("source_id % 97 = 0")), ["v_clips"],
        "WITH g AS (SELECT *, clip_id // 10000 % 5000 AS group_id FROM v_clips) SELECT project_id, clip_id, group_id FROM g WHERE group_id IN (SELECT group_id FROM g WHERE source_id % 97 = 0)"),
    "c21_unlinked": (lambda s, d: op.unlinked(view(s, d, "v_clips"), F.expr("clip_id div 10000 % 200"), F.expr("source_id % 3 = 0")).fillna(-1), ["v_clips"],
        "WITH g AS (SELECT project_id, clip_id, CASE WHEN source_id % 3 = 0 THEN NULL ELSE clip_id // 10000 % 200 END AS g FROM v_clips) SELECT project_id, clip_id, coalesce(CASE WHEN count(*) OVER (PARTITION BY project_id, g) >= 2 THEN g END, -1) AS group_id FROM g"),
    "c23_unresolved_sources": (lambda s, d: op.unresolved_sources(view(s, d, "v_clips"), view(s, d, "v_sources").filter("width < 4000")), ["v_clips", "v_sources"],
        "SELECT DISTINCT source_id FROM v_clips WHERE source_id NOT IN (SELECT source_id FROM v_sources WHERE width < 4000)"),
    "c23_unused_sources": (lambda s, d: op.unused_sources(view(s, d, "v_clips").filter("track_no = 1"), view(s, d, "v_sources")), ["v_clips", "v_sources"],
        "SELECT DISTINCT source_id FROM v_sources WHERE source_id NOT IN (SELECT source_id FROM v_clips WHERE track_no = 1)"),
    "e11_marker_ranges": (lambda s, d: op.markers_to_ranges(view(s, d, "v_points")), ["v_points"],
        "SELECT * FROM (SELECT project_id, point_id, t_ms AS start_ms, lead(t_ms) OVER (PARTITION BY project_id ORDER BY t_ms, point_id) AS end_ms FROM v_points) WHERE end_ms > start_ms"),
    "e22_packed": (lambda s, d: op.packed(view(s, d, "v_clips")), ["v_clips"],
        "SELECT project_id, track_no, clip_id, CAST(coalesce(sum(dur_ms) OVER (PARTITION BY project_id, track_no ORDER BY start_ms, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms, dur_ms FROM v_clips"),
    "g1_split_at": (lambda s, d: op.split_at(view(s, d, "v_timeline"), _points(s, d)), ["v_points", "v_timeline"],
        f"WITH {POINTS_SQL}, e AS (SELECT DISTINCT c.project_id, track_no, clip_id, t_ms AS s FROM p JOIN v_timeline c ON p.project_id = c.project_id AND start_ms < t_ms AND t_ms < start_ms + dur_ms UNION SELECT project_id, track_no, clip_id, start_ms FROM v_timeline), w AS (SELECT e.*, row_number() OVER k - 1 AS piece_no, lead(s) OVER k AS n FROM e WINDOW k AS (PARTITION BY clip_id ORDER BY s)) SELECT w.project_id, w.track_no, w.clip_id, piece_no, s AS start_ms, coalesce(n, start_ms + dur_ms) - s AS dur_ms, in_ms + s - start_ms AS in_ms FROM w JOIN v_timeline c USING (clip_id)"),
    "g2_lift": (lambda s, d: op.lift(view(s, d, "v_timeline"), view(s, d, "v_regions"), F.col("track_no") != 3), ["v_timeline", "v_regions"],
        f"WITH {PIECES.format('c.track_no <> 3')} SELECT project_id, track_no, clip_id, s AS start_ms, d AS dur_ms, i AS in_ms FROM pp WHERE NOT inside"),
    "g3_extract": (lambda s, d: op.extract(view(s, d, "v_timeline"), view(s, d, "v_regions"), F.col("track_no") < 2, F.expr("track_no = 2 AND project_id % 2 = 0")), ["v_timeline", "v_regions"],
        f"WITH {PIECES.format('c.track_no < 2')}, no AS (SELECT DISTINCT c.project_id FROM v_timeline c JOIN mr ON mr.project_id = c.project_id AND start_ms < b AND a < start_ms + dur_ms WHERE c.track_no = 2 AND c.project_id % 2 = 0), y AS (SELECT pp.*, coalesce((SELECT sum(b - a) FROM mr WHERE mr.project_id = pp.project_id AND b <= s), 0) AS g FROM pp WHERE NOT inside AND project_id NOT IN (FROM no)) SELECT project_id, track_no, clip_id, CAST(s - CASE WHEN track_no < 2 OR (track_no = 2 AND project_id % 2 = 0) THEN g ELSE 0 END AS BIGINT) AS start_ms, d AS dur_ms, i AS in_ms, true AS accepted FROM y UNION ALL SELECT project_id, track_no, clip_id, start_ms, dur_ms, in_ms, false FROM v_timeline WHERE project_id IN (FROM no)"),
    "g5_insert_edit": (lambda s, d: (lambda t: op.insert_edit(t, _inserts(t), F.expr("track_no = 2 AND project_id % 3 = 0")))(view(s, d, "v_timeline")), ["v_timeline"],
        "WITH i AS (SELECT project_id, max(start_ms) AS p_at FROM v_timeline WHERE track_no = 0 GROUP BY 1), m AS (SELECT c.*, p_at, track_no = 0 OR (track_no = 2 AND project_id % 3 = 0) AS mv FROM v_timeline c LEFT JOIN i USING (project_id)), no AS (SELECT DISTINCT project_id FROM m WHERE mv AND start_ms < p_at AND p_at < start_ms + dur_ms) SELECT project_id, track_no, clip_id, CASE WHEN mv AND start_ms >= p_at AND project_id NOT IN (FROM no) THEN start_ms + 4000 ELSE start_ms END AS start_ms, dur_ms, project_id NOT IN (FROM no) AS accepted FROM m UNION ALL SELECT project_id, 0, -project_id, p_at, 4000, true FROM i WHERE project_id NOT IN (FROM no)"),
    "g6_ripple_delete": (lambda s, d: op.ripple_delete(view(s, d, "v_timeline"), F.expr("track_no < 2 AND in_ms < 90"), F.expr("track_no = 3 AND project_id % 4 = 1")), ["v_timeline"],
        RIPPLE.format(groups="", gone="own_gone", refuse="")),
    "g6_ripple_linked": (lambda s, d: (lambda t: op.ripple_delete(t, F.expr("track_no < 2 AND in_ms < 90"), F.expr("track_no = 3 AND project_id % 4 = 1"), _locks(t), F.expr("CASE WHEN clip_id % 5 = 0 THEN clip_id % 300 END")))(view(s, d, "v_timeline")), ["v_timeline"],
        RIPPLE.format(groups="gs AS (SELECT DISTINCT project_id, clip_id % 300 AS grp, true AS met FROM x0 WHERE own_gone AND clip_id % 5 = 0), ", gone="own_gone OR coalesce((SELECT met FROM gs WHERE gs.project_id = x0.project_id AND x0.clip_id % 5 = 0 AND gs.grp = x0.clip_id % 300), false)", refuse=" UNION SELECT DISTINCT project_id, true FROM x WHERE project_id % 9 = 4 AND track_no = project_id % 4 AND (gone OR sync)")),
    "g2_lift_locked": (lambda s, d: (lambda t: op.lift(t, view(s, d, "v_regions"), F.col("track_no") != 3, _locks(t)))(view(s, d, "v_timeline")), ["v_timeline", "v_regions"],
        f"WITH {PIECES.format('c.track_no <> 3')}, no AS MATERIALIZED (SELECT DISTINCT project_id FROM v_timeline WHERE project_id % 9 = 4 AND track_no = project_id % 4 AND track_no <> 3) SELECT project_id, track_no, clip_id, s AS start_ms, d AS dur_ms, i AS in_ms FROM pp WHERE NOT inside AND project_id NOT IN (FROM no) UNION ALL SELECT project_id, track_no, clip_id, start_ms, dur_ms, in_ms FROM v_timeline WHERE project_id IN (FROM no)"),
    "g3_extract_locked": (lambda s, d: (lambda t: op.extract(t, view(s, d, "v_regions"), F.col("track_no") < 2, None, _locks(t)).groupBy("project_id", "accepted").agg(F.count(F.lit(1)).alias("n"), F.sum("start_ms").alias("starts")))(view(s, d, "v_timeline")), ["v_timeline", "v_regions"],
        f"WITH {PIECES.format('c.track_no < 2')}, no AS MATERIALIZED (SELECT DISTINCT project_id FROM v_timeline WHERE project_id % 9 = 4 AND track_no = project_id % 4 AND track_no < 2), y AS (SELECT pp.project_id, CAST(s - CASE WHEN track_no < 2 THEN coalesce((SELECT sum(b - a) FROM mr WHERE mr.project_id = pp.project_id AND b <= s), 0) ELSE 0 END AS BIGINT) AS t, true AS ok FROM pp WHERE NOT inside AND project_id NOT IN (FROM no) UNION ALL SELECT project_id, start_ms, false FROM v_timeline WHERE project_id IN (FROM no)) SELECT project_id, ok AS accepted, count(*) AS n, CAST(sum(t) AS BIGINT) AS starts FROM y GROUP BY 1, 2"),
    "g5_insert_locked": (lambda s, d: (lambda t: op.insert_edit(t, _inserts(t), F.expr("track_no = 2 AND project_id % 3 = 0"), _locks(t)).groupBy("project_id", "accepted").agg(F.count(F.lit(1)).alias("n"), F.sum("start_ms").alias("starts")))(view(s, d, "v_timeline")), ["v_timeline"],
        "WITH i AS (SELECT project_id, max(start_ms) AS p_at FROM v_timeline WHERE track_no = 0 GROUP BY 1), m AS MATERIALIZED (SELECT c.*, p_at, track_no = 0 OR (track_no = 2 AND project_id % 3 = 0 AND p_at IS NOT NULL) AS mv FROM v_timeline c LEFT JOIN i USING (project_id)), no AS MATERIALIZED (SELECT DISTINCT project_id, true AS no FROM m WHERE mv AND (start_ms < p_at AND p_at < start_ms + dur_ms OR project_id % 9 = 4 AND track_no = project_id % 4)), y AS (SELECT m.project_id, CASE WHEN mv AND start_ms >= p_at AND no IS NULL THEN start_ms + 4000 ELSE start_ms END AS t, no IS NULL AS ok FROM m LEFT JOIN no USING (project_id) UNION ALL SELECT i.project_id, p_at, true FROM i LEFT JOIN no USING (project_id) WHERE no IS NULL) SELECT project_id, ok AS accepted, count(*) AS n, CAST(sum(t) AS BIGINT) AS starts FROM y GROUP BY 1, 2"),
    "g7_shifted_markers": (lambda s, d: op.shifted_markers(view(s, d, "v_points").withColumn("t_ms", F.col("t_ms") * 11 % 700000), view(s, d, "v_regions")), ["v_points", "v_regions"],
        f"WITH {MERGED}, p AS (SELECT point_id, project_id, t_ms * 11 % 700000 AS t_ms FROM v_points) SELECT point_id, p.project_id, CAST(t_ms - coalesce(sum(b - a), 0) AS BIGINT) AS t_ms FROM p LEFT JOIN mr ON mr.project_id = p.project_id AND b <= t_ms WHERE NOT EXISTS (SELECT 1 FROM mr q WHERE q.project_id = p.project_id AND q.a <= t_ms AND t_ms < q.b) GROUP BY point_id, p.project_id, t_ms"),
    "g9_trim_room": (lambda s, d: op.trim_room(view(s, d, "v_timeline")).fillna(-1), ["v_timeline"],
        "SELECT project_id, track_no, clip_id, least(start_ms - coalesce(lag(start_ms + dur_ms) OVER w, 0), in_ms) AS left_ms, coalesce(lead(start_ms) OVER w - (start_ms + dur_ms), -1) AS right_ms FROM v_timeline WINDOW w AS (PARTITION BY project_id, track_no ORDER BY start_ms, clip_id)"),
    "g12_transition_limits": (lambda s, d: op.transition_limits(view(s, d, "v_tight"), 60000), ["v_tight"],
        "SELECT project_id, track_no, clip_id, to_clip_id, 2 * least(dur_ms, td, greatest(0, 60000 - in_ms - dur_ms), ti) AS max_ms FROM (SELECT *, lead(clip_id) OVER w AS to_clip_id, lead(dur_ms) OVER w AS td, lead(in_ms) OVER w AS ti, lead(start_ms) OVER w - (start_ms + dur_ms) AS gap FROM v_tight WINDOW w AS (PARTITION BY project_id, track_no ORDER BY start_ms, clip_id)) WHERE abs(gap) <= 1"),
    "h21_frame_grid": (lambda s, d: op.frame_grid(view(s, d, "v_timeline"), 1), ["v_timeline"],
        "SELECT project_id, CAST(f AS BIGINT) AS frame, CAST(f * 1000 AS BIGINT) AS t_ms FROM (SELECT project_id, unnest(range((m - 1) // 1000 + 1)) AS f FROM (SELECT project_id, max(start_ms + dur_ms) AS m FROM v_timeline GROUP BY project_id))"),
}


def queries():
    return {name: query for name, (query, _, _) in PLANS.items()}


def oracle_sql():
    return {name: sql_with(reads, sql) for name, (_, reads, sql) in PLANS.items() if sql}

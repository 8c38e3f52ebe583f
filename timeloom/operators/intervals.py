"""Interval algebra on tracks: unions, overlaps, resolution at a time, cuts and shifts. Times are integers (ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.operators.helpers import asof_join, interval_join, islands, swept

TRACK = ["project_id", "track_no"]
#: Clips no further apart are neighbours that touch.
TOUCH_MS = 1


def _end() -> Column:
    return F.expr("start_ms + dur_ms")


def _before(by: list[str], *order: str) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def range_union(df: DataFrame, by: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Merge ranges of a key that overlap or touch: ``by, start, end, n_ranges``."""
    prior = F.max(end).over(_before(by, start, end))
    found = islands(df.withColumn("_prior", prior), by, [start, end], F.col("_prior").isNull() | (F.col(start) > F.col("_prior")))
    return found.groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_ranges")).drop("island")


def normalised_ranges(df: DataFrame, start: str, end: str) -> DataFrame:
    """Swap reversed ends, clamp at zero, drop what is empty."""
    low, high = F.greatest(F.lit(0), F.least(start, end)), F.greatest(F.lit(0), F.greatest(start, end))
    return df.withColumns({start: low, end: high}).filter(F.col(start) < F.col(end))


def track_overlaps(clips: DataFrame) -> DataFrame:
    """``project_id, track_no, n_overlaps``: clips that start before an earlier clip of their track ends."""
    w = Window.partitionBy(*TRACK).orderBy("start_ms", "clip_id")
    bad = F.col("start_ms") < F.lag(_end()).over(w)
    return clips.select(*TRACK, F.coalesce(bad, F.lit(False)).alias("bad")).groupBy(*TRACK).agg(F.count_if("bad").alias("n_overlaps"))


def durations(clips: DataFrame) -> DataFrame:
    return clips.groupBy("project_id").agg(F.max(_end()).alias("duration_ms"))


def resolve_at(points: DataFrame, clips: DataFrame, width: int = 16384) -> DataFrame:
    """Every clip under each point (``point_id, project_id, t_ms``): ``point_id, track_no, clip_id, source_ms``."""
    a = points.select("project_id", "point_id", F.col("t_ms").alias("a_start"), (F.col("t_ms") + 1).alias("a_end"))
    b = clips.select("project_id", "track_no", "clip_id", "in_ms", F.col("start_ms").alias("b_start"), _end().alias("b_end"))
    met = interval_join(a, b, ["project_id"], width)
    return met.select("point_id", "track_no", "clip_id", (F.col("in_ms") + F.col("a_start") - F.col("b_start")).alias("source_ms"))


def resolve_first(points: DataFrame, clips: DataFrame) -> DataFrame:
    """The clip of the lowest track under each point."""
    return resolve_at(points, clips).groupBy("point_id").agg(F.min_by(F.struct("track_no", "clip_id", "source_ms"), F.struct("track_no", "clip_id")).alias("r")).select("point_id", "r.*")


def intersect_tracks(a: DataFrame, b: DataFrame, by: list[str], width: int = 16384) -> DataFrame:
    """Pairwise overlaps of two interval sets (``start_ms, end_ms, peak``): their common part and the larger peak."""
    left = a.select(*by, F.col("start_ms").alias("a_start"), F.col("end_ms").alias("a_end"), F.col("peak").alias("a_peak"))
    right = b.select(*by, F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"), F.col("peak").alias("b_peak"))
    met = interval_join(left, right, by, width)
    return met.select(*by, F.greatest("a_start", "b_start").alias("start_ms"), F.least("a_end", "b_end").alias("end_ms"), F.greatest("a_peak", "b_peak").alias("peak"))


def intersect_all(ranges: DataFrame, by: list[str], of: str, sets: DataFrame | None = None, width: int = 16384) -> DataFrame:
    """Where all sets of a key have a range (``by, of, start_ms, end_ms, peak``): ``by, start_ms, end_ms, peak``, the largest peak there.

    Any number of sets, whose own ranges don't overlap; ``sets`` says how many a key has (``by, n_sets``), by default those with ranges.
    A sweep over starts and ends counts the ranges that are open; ranges that touch keep their pieces apart.
    """
    if sets is None:
        sets = ranges.groupBy(*by).agg(F.count_distinct(of).alias("n_sets"))
    some = ranges.filter("start_ms < end_ms")
    ends = some.select(*by, F.explode(F.array(F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("d")))).alias("e"))
    points = ends.groupBy(*by, F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d"))
    full = swept(points, by, "t", "d", width).join(sets, by).filter("run = n_sets AND next IS NOT NULL")
    pieces = full.select(*by, F.col("t").alias("a_start"), F.col("next").alias("a_end"))
    under = some.select(*by, F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"), "peak")
    return interval_join(pieces, under, by, width).groupBy(*by, F.col("a_start").alias("start_ms"), F.col("a_end").alias("end_ms")).agg(F.max("peak").alias("peak"))


def selected(clips: DataFrame, ranges: DataFrame, width: int = 65536) -> DataFrame:
    """Clips that overlap any range (``project_id, start_ms, end_ms``)."""
    a = clips.select("project_id", "track_no", "clip_id", F.col("start_ms").alias("a_start"), _end().alias("a_end"))
    b = ranges.select("project_id", F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    return interval_join(a, b, ["project_id"], width, "semi").select("project_id", "track_no", "clip_id")


def snapped(points: DataFrame, targets: DataFrame, within: int) -> DataFrame:
    """The nearest target of the project within a distance; the earlier one on a tie: ``point_id, snap_ms`` (or null)."""
    t = targets.select("project_id", "target_ms").distinct()
    back = asof_join(points, t.withColumnRenamed("target_ms", "before_ms"), ["project_id"], "t_ms", "before_ms", ["before_ms"])
    both = asof_join(back, t.withColumnRenamed("target_ms", "after_ms"), ["project_id"], "t_ms", "after_ms", ["after_ms"], "forward")
    down, up = F.col("t_ms") - F.col("before_ms"), F.col("after_ms") - F.col("t_ms")
    best = F.when(up.isNull() | (down <= up), F.col("before_ms")).otherwise(F.col("after_ms"))
    return both.select("point_id", "project_id", "t_ms", F.when(F.abs(best - F.col("t_ms")) <= within, best).alias("snap_ms"))


def snap_targets(clips: DataFrame, points: DataFrame) -> DataFrame:
    """Zero, clip edges and markers: ``project_id, target_ms``."""
    edges = clips.select("project_id", F.explode(F.array("start_ms", _end())).alias("target_ms"))
    zero = clips.select("project_id", F.lit(0).cast("long").alias("target_ms"))
    return edges.unionByName(points.select("project_id", F.col("t_ms").alias("target_ms"))).unionByName(zero).distinct()


def packed(clips: DataFrame) -> DataFrame:
    """Clips of each track one after another without gaps."""
    start = F.coalesce(F.sum("dur_ms").over(_before(TRACK, "start_ms", "clip_id")), F.lit(0)).cast("long")
    return clips.select(*TRACK, "clip_id", start.alias("start_ms"), "dur_ms")


def split_at(clips: DataFrame, cuts: DataFrame, width: int = 16384) -> DataFrame:
    """Cut clips at the points (``project_id, t_ms``) strictly inside them: pieces with ``piece_no`` from 0."""
    a = cuts.select("project_id", F.col("t_ms").alias("a_start"), (F.col("t_ms") + 1).alias("a_end")).distinct()
    b = clips.select(*TRACK, "clip_id", F.col("start_ms").alias("b_start"), _end().alias("b_end"))
    inside = interval_join(a, b, ["project_id"], width).filter("a_start > b_start").groupBy(*TRACK, "clip_id").agg(F.sort_array(F.collect_set("a_start")).alias("cuts"))
    edges = F.concat(F.array("start_ms"), F.coalesce("cuts", F.array().cast("array<bigint>")), F.array(_end()))
    pieces = clips.join(inside, [*TRACK, "clip_id"], "left").withColumn("edges", edges)
    pieces = pieces.select(*TRACK, "clip_id", "in_ms", F.col("start_ms").alias("_s"), F.posexplode(F.slice("edges", F.lit(1), F.size("edges") - 1)).alias("piece_no", "start_ms"), "edges")
    return pieces.select(*TRACK, "clip_id", "piece_no", "start_ms", (F.get("edges", F.col("piece_no") + 1) - F.col("start_ms")).alias("dur_ms"), (F.col("in_ms") + F.col("start_ms") - F.col("_s")).alias("in_ms"))


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges of each project (any number of them: ``project_id, cut_start, cut_end``) as a union, with ``gone``, the time that they hold up to each one's end."""
    made = range_union(ranges.select("project_id", "cut_start", "cut_end").filter("cut_start < cut_end"), ["project_id"], "cut_start", "cut_end")
    run = Window.partitionBy("project_id").orderBy("cut_start").rowsBetween(Window.unboundedPreceding, 0)
    return made.select("project_id", "cut_start", "cut_end", F.sum(F.col("cut_end") - F.col("cut_start")).over(run).alias("gone"))


def cut_by_ranges(clips: DataFrame, ranges: DataFrame, target: Column | None = None, width: int = 16384) -> DataFrame:
    """Clips of target tracks (all by default) cut at the edges of the ranges: pieces with ``inside``, whether a range holds them."""
    clips = clips.withColumn("_target", F.lit(True) if target is None else target)
    b = merged_ranges(ranges).select("project_id", F.col("cut_start").alias("b_start"), F.col("cut_end").alias("b_end"))
    a = clips.filter("_target").select(*TRACK, "clip_id", F.col("start_ms").alias("a_start"), _end().alias("a_end"))
    cuts = interval_join(a, b, ["project_id"], width).groupBy(*TRACK, "clip_id").agg(F.collect_list(F.struct(F.greatest("a_start", "b_start").alias("s"), F.least("a_end", "b_end").alias("e"))).alias("cuts"))
    edges = F.array_sort(F.array_distinct(F.concat(F.array("start_ms", _end()), F.flatten(F.transform(F.coalesce("cuts", F.array().cast("array<struct<s:bigint,e:bigint>>")), lambda x: F.array(x["s"], x["e"]))))))
    rows = clips.join(cuts, [*TRACK, "clip_id"], "left").withColumn("edges", edges)
    pieces = F.transform(F.slice("edges", F.lit(1), F.size("edges") - 1), lambda x, i: F.struct(x.alias("s"), F.get(F.col("edges"), i + 1).alias("e")))
    rows = rows.select(*TRACK, "clip_id", "in_ms", "cuts", F.col("start_ms").alias("_s"), F.posexplode(pieces).alias("piece_no", "p"))
    inside = F.coalesce(F.exists("cuts", lambda x: (x["s"] <= F.col("p.s")) & (F.col("p.e") <= x["e"])), F.lit(False))
    return rows.select(*TRACK, "clip_id", "piece_no", F.col("p.s").alias("start_ms"), (F.col("p.e") - F.col("p.s")).alias("dur_ms"), (F.col("in_ms") + F.col("p.s") - F.col("_s")).alias("in_ms"), inside.alias("inside"))


def locked_projects(clips: DataFrame, locks: DataFrame | None, touched: Column) -> DataFrame:
    """Projects of which a locked track (``project_id, track_no``) has a clip that an edit touches: no such edit runs."""
    rows = clips.filter(touched)
    return (rows.join(locks.select(*TRACK), TRACK, "left_semi") if locks is not None else rows.limit(0)).select("project_id").distinct()


def unless_locked(made: DataFrame, clips: DataFrame, locks: DataFrame | None, touched: Column) -> DataFrame:
    """``made``, what an edit of ``clips`` gives, but the clips as they were of projects where it touches a locked track."""
    if locks is None:
        return made
    refused = locked_projects(clips, locks, touched)
    return made.join(refused, "project_id", "left_anti").unionByName(clips.join(refused, "project_id", "left_semi").select(*made.columns))


def lift(clips: DataFrame, ranges: DataFrame, target: Column | None = None, locks: DataFrame | None = None) -> DataFrame:
    """Remove the ranges of each project (any number: ``project_id, cut_start, cut_end``) from the target tracks, keeping what stands out.

    A project with a locked target track keeps its clips.
    """
    made = cut_by_ranges(clips, ranges, target).filter("NOT inside").select(*TRACK, "clip_id", "start_ms", "dur_ms", "in_ms")
    return unless_locked(made, clips, locks, F.lit(True) if target is None else target)


def extract(clips: DataFrame, ranges: DataFrame, target: Column | None = None, synced: Column | None = None, locks: DataFrame | None = None) -> DataFrame:
    """``lift``, then what starts at or after a range's end moves left by it, on target and on synced tracks.

    A project is refused, and keeps its clips, if a clip of a synced track that is no target overlaps a range, or a target or synced
    track is locked: ``accepted``.
    """
    target, synced = F.lit(True) if target is None else target, F.lit(False) if synced is None else synced
    runs = merged_ranges(ranges)
    a = clips.filter(synced & ~target).select(*TRACK, "clip_id", F.col("start_ms").alias("a_start"), _end().alias("a_end"))
    b = runs.select("project_id", F.col("cut_start").alias("b_start"), F.col("cut_end").alias("b_end"))
    refused = interval_join(a, b, ["project_id"], 16384).select("project_id").unionByName(locked_projects(clips, locks, target | synced)).distinct()
    kept = clips.join(refused, "project_id", "left_semi").select(*TRACK, "clip_id", "start_ms", "dur_ms", "in_ms", F.lit(False).alias("accepted"))
    good = lift(clips.join(refused, "project_id", "left_anti"), ranges, target)
    moved = asof_join(good, runs.select("project_id", "cut_end", "gone"), ["project_id"], "start_ms", "cut_end", ["gone"])
    shift = F.when(target | synced, F.coalesce("gone", F.lit(0))).otherwise(0)
    return moved.select(*TRACK, "clip_id", (F.col("start_ms") - shift).alias("start_ms"), "dur_ms", "in_ms", F.lit(True).alias("accepted")).unionByName(kept)


def _with_refusal(rows: DataFrame, refused: DataFrame) -> DataFrame:
    """``accepted``: false for all clips of the projects in ``refused``."""
    return rows.join(refused.select("project_id", F.lit(True).alias("_no")).distinct(), "project_id", "left").withColumn("accepted", F.col("_no").isNull()).drop("_no")


def with_linked(clips: DataFrame, chosen: Column, group: Column) -> DataFrame:
    """Add ``_chosen``: the clip, or one of its group (of one project), is chosen."""
    rows = clips.withColumns({"_own": F.coalesce(chosen, F.lit(False)), "_group": group})
    groups = rows.filter("_own AND _group IS NOT NULL").select("project_id", "_group", F.lit(True).alias("_met")).distinct()
    return rows.join(groups, ["project_id", "_group"], "left").withColumn("_chosen", F.col("_own") | F.coalesce("_met", F.lit(False))).drop("_own", "_group", "_met")


def ripple_delete(clips: DataFrame, removed: Column, synced: Column | None = None, locks: DataFrame | None = None, group: Column | None = None) -> DataFrame:
    """Delete the clips that ``removed`` marks, and all of their linked ``group``s; later ones of their track move left by the deleted time before them.

    Synced tracks without deleted clips move by what the track that loses most loses, from its first deleted clip on. A
    project is refused, and keeps its clips, if a clip of such a track stands over that point, clips then overlap, or a track with
    deleted clips or a synced one is locked: ``accepted``.
    """
    synced = F.lit(False) if synced is None else synced
    if group is not None:
        clips, removed = with_linked(clips, removed, group), F.col("_chosen")
    no_edit = locked_projects(clips, locks, removed | synced)
    rows = clips.withColumns({"_gone": F.coalesce(F.sum(F.when(removed, F.col("dur_ms")).otherwise(0)).over(_before(TRACK, "start_ms", "clip_id")), F.lit(0)).cast("long"), "_removed": removed, "_synced": synced})
    per = rows.filter("_removed").groupBy(*TRACK).agg(F.sum("dur_ms").alias("_total"), F.min("start_ms").alias("_from"))
    best = per.groupBy("project_id").agg(F.max_by(F.struct("_total", "_from"), F.struct("_total", -F.col("track_no"))).alias("_b"))
    rows = rows.join(per.select(*TRACK, F.lit(True).alias("_own")), TRACK, "left").join(best, "project_id", "left")
    follows = F.col("_synced") & F.col("_own").isNull() & F.col("_b").isNotNull()
    to = F.when(F.col("_own"), F.col("start_ms") - F.col("_gone")).when(follows & (F.col("start_ms") >= F.col("_b._from")), F.greatest(F.lit(0), F.col("start_ms") - F.col("_b._total"))).otherwise(F.col("start_ms"))
    over = follows & (F.col("start_ms") < F.col("_b._from")) & (_end() > F.col("_b._from"))
    rows = rows.withColumns({"_to": to, "_over": over})
    left = rows.filter("NOT _removed").withColumn("_hit", F.col("_to") < F.lag(F.col("_to") + F.col("dur_ms")).over(Window.partitionBy(*TRACK).orderBy("_to", "clip_id")))
    refused = left.filter("_over OR _hit").select("project_id").unionByName(no_edit)
    made = _with_refusal(rows, refused).filter("NOT (_removed AND accepted)")
    return made.select(*TRACK, "clip_id", F.when(F.col("accepted"), F.col("_to")).otherwise(F.col("start_ms")).alias("start_ms"), "dur_ms", "in_ms", "accepted")


def insert_edit(clips: DataFrame, inserts: DataFrame, synced: Column | None = None, locks: DataFrame | None = None) -> DataFrame:
    """Insert clips (``project_id, track_no, clip_id, at_ms, dur_ms``, one point a project) and make room for the longest.

    What starts at or after the point moves right, on the tracks that get a clip and on synced ones. A project is refused,
    and keeps its clips, if a clip of those tracks stands over the point or one of them is locked: ``accepted``.
    """
    synced = F.lit(False) if synced is None else synced
    room = inserts.groupBy("project_id").agg(F.min("at_ms").alias("at_ms"), F.max("dur_ms").alias("room_ms"))
    rows = clips.join(inserts.select(*TRACK, F.lit(True).alias("_own")).distinct(), TRACK, "left").join(room, "project_id", "left")
    moves = F.coalesce(F.col("_own"), F.lit(False)) | (synced & F.col("at_ms").isNotNull())
    over = moves & (F.col("start_ms") < F.col("at_ms")) & (F.col("at_ms") < _end())
    refused = rows.filter(over).select("project_id").unionByName(locked_projects(rows, locks, moves))
    if locks is not None:
        refused = refused.unionByName(inserts.join(locks.select(*TRACK), TRACK, "left_semi").select("project_id"))
    made = _with_refusal(rows, refused)
    start = F.when(F.col("accepted") & moves & (F.col("start_ms") >= F.col("at_ms")), F.col("start_ms") + F.col("room_ms")).otherwise(F.col("start_ms"))
    made = made.select(*TRACK, "clip_id", start.alias("start_ms"), "dur_ms", "accepted")
    added = inserts.join(refused.distinct(), "project_id", "left_anti")
    return made.unionByName(added.select(*TRACK, "clip_id", F.col("at_ms").alias("start_ms"), "dur_ms", F.lit(True).alias("accepted")))


def trim_room(clips: DataFrame) -> DataFrame:
    """How far each clip's edges may move: ``left_ms`` (bounded by its neighbour and the source) and ``right_ms`` (null: no neighbour)."""
    w = Window.partitionBy(*TRACK).orderBy("start_ms", "clip_id")
    left = F.least(F.col("start_ms") - F.coalesce(F.lag(_end()).over(w), F.lit(0)), F.col("in_ms"))
    return clips.select(*TRACK, "clip_id", left.alias("left_ms"), (F.lead("start_ms").over(w) - _end()).alias("right_ms"))


def transition_limits(clips: DataFrame, source_ms: int) -> DataFrame:
    """Longest transition between neighbours that touch: twice the least of durations and handles."""
    w = Window.partitionBy(*TRACK).orderBy("start_ms", "clip_id")
    rows = clips.select(*TRACK, "clip_id", "dur_ms", "in_ms", F.lead("clip_id").over(w).alias("to_clip_id"), F.lead("dur_ms").over(w).alias("to_dur"), F.lead("in_ms").over(w).alias("to_in"), (F.lead("start_ms").over(w) - _end()).alias("gap"))
    most = 2 * F.least("dur_ms", "to_dur", F.greatest(F.lit(0), F.lit(source_ms) - F.col("in_ms") - F.col("dur_ms")), "to_in")
    return rows.filter(F.abs("gap") <= TOUCH_MS).select(*TRACK, "clip_id", "to_clip_id", most.alias("max_ms"))


def frame_grid(clips: DataFrame, fps: int) -> DataFrame:
    """``project_id, frame, t_ms`` of all output frames of each project; long projects are dealt out in runs of 4096 frames."""
    last = F.expr(f"(duration_ms * {fps} - 1) div 1000")
    runs = durations(clips).filter("duration_ms > 0").select("project_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(duration_ms * {fps} - 1) div 1000 div 4096"))).alias("run"), last.alias("last"))
    parts = int(clips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frames = runs.repartition(parts, "project_id", "run").select("project_id", F.explode(F.expr("sequence(run * 4096, least(run * 4096 + 4095, last))")).alias("frame"))
    return frames.withColumn("t_ms", F.expr(f"frame * 1000 div {fps}"))


def close_marked_groups(clips: DataFrame, group: Column, chosen: Column) -> DataFrame:
    """Linked groups: chosen clips and all members of their groups."""
    rows = clips.withColumn("group_id", group)
    groups = rows.filter(chosen).select("group_id").distinct()
    return rows.join(groups, "group_id", "left_semi").select("project_id", "clip_id", "group_id")


def unlinked(clips: DataFrame, group: Column, chosen: Column) -> DataFrame:
    """Chosen clips leave their groups; a group of a project left with one member is dissolved: ``project_id, clip_id, group_id`` (or null)."""
    rows = clips.select("project_id", "clip_id", F.when(chosen, None).otherwise(group).alias("group_id"))
    whole = rows.filter("group_id IS NOT NULL").groupBy("project_id", "group_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").drop("_n").withColumn("_whole", F.lit(True))
    return rows.join(whole, ["project_id", "group_id"], "left").select("project_id", "clip_id", F.when(F.col("_whole"), F.col("group_id")).alias("group_id"))


def clip_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``clip_id, change`` of clips added, deleted, moved or edited, and the affected range."""
    a = before.select("clip_id", *[F.col(c).alias(f"a_{c}") for c in ("project_id", "track_no", "start_ms", "dur_ms", "in_ms", "source_id")])
    b = after.select("clip_id", *[F.col(c).alias(f"b_{c}") for c in ("project_id", "track_no", "start_ms", "dur_ms", "in_ms", "source_id")])
    both = a.join(b, "clip_id", "full")
    moved = ~(F.col("a_track_no").eqNullSafe(F.col("b_track_no")) & F.col("a_start_ms").eqNullSafe(F.col("b_start_ms")))
    edited = ~(F.col("a_dur_ms").eqNullSafe(F.col("b_dur_ms")) & F.col("a_in_ms").eqNullSafe(F.col("b_in_ms")) & F.col("a_source_id").eqNullSafe(F.col("b_source_id")))
    change = F.when(F.col("a_project_id").isNull(), "added").when(F.col("b_project_id").isNull(), "deleted").when(moved, "moved").when(edited, "edited")
    rows = both.select("clip_id", F.coalesce("a_project_id", "b_project_id").alias("project_id"), change.alias("change"), F.least("a_start_ms", "b_start_ms").alias("start_ms"), F.greatest(F.expr("a_start_ms + a_dur_ms"), F.expr("b_start_ms + b_dur_ms")).alias("end_ms"))
    return rows.filter(F.col("change").isNotNull())


def source_impact(clips: DataFrame, sources: DataFrame) -> DataFrame:
    """Clips and projects that use each changed source (``source_id``)."""
    return clips.join(sources.select("source_id").distinct(), "source_id").groupBy("source_id").agg(F.count(F.lit(1)).alias("n_clips"), F.countDistinct("project_id").alias("n_projects"), F.min("start_ms").alias("first_ms"), F.max(_end()).alias("last_ms"))


def unresolved_sources(clips: DataFrame, sources: DataFrame) -> DataFrame:
    """Used sources that are unknown."""
    return clips.select("source_id").distinct().join(sources, "source_id", "left_anti")


def unused_sources(clips: DataFrame, sources: DataFrame) -> DataFrame:
    return sources.select("source_id").distinct().join(clips, "source_id", "left_anti")


def markers_to_ranges(points: DataFrame) -> DataFrame:
    """Consecutive markers of a project as ranges, empty ones dropped."""
    w = Window.partitionBy("project_id").orderBy("t_ms", "point_id")
    return points.select("project_id", "point_id", F.col("t_ms").alias("start_ms"), F.lead("t_ms").over(w).alias("end_ms")).filter("end_ms > start_ms")


def shifted_markers(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Markers inside removed ranges (any number a project) go, later ones move left by the ranges before them."""
    runs = merged_ranges(ranges)
    met = asof_join(points, runs, ["project_id"], "t_ms", "cut_start", ["cut_end", "gone"])
    return met.filter("cut_end IS NULL OR t_ms >= cut_end").select("point_id", "project_id", (F.col("t_ms") - F.coalesce("gone", F.lit(0))).alias("t_ms"))

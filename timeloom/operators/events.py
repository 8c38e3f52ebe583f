"""Capture events: manifests, pauses, clusters, sessions, rates, logs. Times are integer microseconds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions.variants import at, flag, items, number, parsed, text
from timeloom.operators.helpers import asof_join, fold_per_key, interval_join, islands

#: The kinds of capture sources, and the fields that each kind of record must have.
SOURCE_KINDS = ("screen", "webcam", "mic", "system-audio")
REQUIRED = {
    "header": {"sessionId": text, "startedAtIso": text, "sources": items, "chunkTargetS": number},
    "epoch": {"epochUs": number},
    "chunk": {"sourceId": text, "file": text, "byteOffset": number, "byteLength": number, "fromUs": number, "toUs": number, "keyFrame": flag, "preEncodeDrops": number},
    "source-ended": {"sourceId": text, "reason": text},
    "finalize": {"endedAtIso": text, "reason": text},
    "pause": {"atUs": number},
    "resume": {"atUs": number},
    "source-added": {"atUs": number, "source.sourceId": text, "source.label": text},
    "source-region-applied": {"sourceId": text, "atUs": number},
    "scene-switch": {"sceneId": text, "atUs": number},
}


def parse_manifest(lines: DataFrame) -> DataFrame:
    """NDJSON lines (``session_id, line_no, line``) of known kinds with their required fields; torn, malformed and unknown ones are dropped.

    ``session_id, line_no, kind, t_us`` (the record's time, or null), ``bytes, source_id, to_us, key_frame, drops, detail``
    (file, reason, mode or scene). Numbers may have fractions, which are cut off; a header's epoch may be null, but not absent.
    """
    rows = lines.select("session_id", "line_no", parsed("line").alias("j"))
    of = lambda path: at(F.col("j"), path)
    kind, whole = text(of("kind")), None
    for name, columns in REQUIRED.items():
        ok = reduce(lambda x, y: x & y, [read(of(path)).isNotNull() for path, read in columns.items()])
        if name == "header":
            known = lambda x: text(at(x, "sourceId")).isNotNull() & F.coalesce(text(at(x, "kind")).isin(*SOURCE_KINDS), F.lit(False))
            ok = ok & (number(of("version")) == 1) & F.forall(items(of("sources")), known) & (F.is_variant_null(of("epochUs")) | number(of("epochUs")).isNotNull())
        if name == "source-added":
            ok = ok & text(of("source.kind")).isin(*SOURCE_KINDS)
        if name == "source-region-applied":
            ok = ok & text(of("mode")).isin("crop", "element")
        whole = F.when(kind == name, ok) if whole is None else whole.when(kind == name, ok)
    long = lambda path: number(of(path)).cast("long")
    return rows.filter(whole).select(
        "session_id", "line_no", kind.alias("kind"), F.coalesce(long("atUs"), long("fromUs"), long("epochUs")).alias("t_us"), F.coalesce(long("byteLength"), F.lit(0)).alias("bytes"), F.coalesce(text(of("sourceId")), text(of("source.sourceId"))).alias("source_id"),
        long("toUs").alias("to_us"), flag(of("keyFrame")).alias("key_frame"), long("preEncodeDrops").alias("drops"), F.coalesce(*[text(of(p)) for p in ("file", "reason", "mode", "sceneId")]).alias("detail"),
    )


def dropped_lines(lines: DataFrame) -> DataFrame:
    """How many lines of each session ``parse_manifest`` drops."""
    good = parse_manifest(lines).groupBy("session_id").agg(F.count(F.lit(1)).alias("good"))
    every = lines.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return every.join(good, "session_id", "left").select("session_id", (F.col("n") - F.coalesce("good", F.lit(0))).alias("n_dropped"))


def pause_pairs(manifest: DataFrame) -> DataFrame:
    """Each resume with the pause right before it: ``session_id, pause_us, resume_us``."""
    w = Window.partitionBy("session_id").orderBy("t_us", "line_no")
    rows = manifest.filter(F.col("kind").isin("pause", "resume")).select("session_id", "kind", F.col("t_us").alias("resume_us"), F.lag("kind").over(w).alias("k"), F.lag("t_us").over(w).alias("pause_us"))
    return rows.filter("kind = 'resume' AND k = 'pause'").select("session_id", "pause_us", "resume_us")


def seam_markers(pairs: DataFrame) -> DataFrame:
    """Numbered seams at the pause's time less all pauses before it: ``session_id, seam, at_us``."""
    w = Window.partitionBy("session_id").orderBy("resume_us", "pause_us")
    gone = F.coalesce(F.sum(F.col("resume_us") - F.col("pause_us")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pairs.select("session_id", F.row_number().over(w).alias("seam"), (F.col("pause_us") - gone).alias("at_us"))


def collapsed(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Events with the time of all pauses that ended by then taken out: ``event_id, session_id, collapsed_us``."""
    w = Window.partitionBy("session_id").orderBy("resume_us", "pause_us").rowsBetween(Window.unboundedPreceding, 0)
    run = pairs.select("session_id", "resume_us", F.sum(F.col("resume_us") - F.col("pause_us")).over(w).alias("gone"))
    met = asof_join(events.select("session_id", "event_id", "t_us"), run, ["session_id"], "t_us", "resume_us", ["gone"])
    return met.select("event_id", "session_id", (F.col("t_us") - F.coalesce("gone", F.lit(0))).alias("collapsed_us"))


def landings(manifest: DataFrame, pairs: DataFrame, epochs: DataFrame) -> DataFrame:
    """Where each source of a session lands: its first and last chunk on collapsed time, counted from the session's epoch (``session_id, epoch_us``); at least 0.1 s long."""
    chunks = manifest.filter("kind = 'chunk'").select("session_id", F.struct("line_no", "source_id").alias("event_id"), "t_us")
    ends = collapsed(chunks, pairs).groupBy("session_id", F.col("event_id.source_id").alias("source_id")).agg(F.min("collapsed_us").alias("first_us"), F.max("collapsed_us").alias("last_us"))
    made = ends.join(epochs, "session_id")
    return made.select("session_id", "source_id", F.greatest(F.lit(0), F.col("first_us") - F.col("epoch_us")).alias("start_us"), F.greatest(F.col("last_us") - F.col("first_us"), F.lit(100_000)).alias("dur_us"))


def chunk_totals(manifest: DataFrame) -> DataFrame:
    """Chunks, bytes, drops before the encoder and times of each source of a session."""
    return manifest.filter("kind = 'chunk'").groupBy("session_id", "source_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("bytes").alias("bytes"), F.sum("drops").alias("drops"), F.min("t_us").alias("first_us"), F.max("to_us").alias("last_us"))


def sessions(events: DataFrame, gap_us: int) -> DataFrame:
    """Runs of events of a session no more than ``gap_us`` apart."""
    w = Window.partitionBy("session_id").orderBy("t_us", "event_id")
    far = F.coalesce(F.col("t_us") - F.lag("t_us").over(w) > gap_us, F.lit(True))
    found = islands(events.withColumn("_far", far), ["session_id"], ["t_us", "event_id"], F.col("_far"))
    return found.groupBy("session_id", "island").agg(F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count(F.lit(1)).alias("n")).drop("island")


def pointer_clusters(events: DataFrame, span_us: int = 2_000_000, reach: int = 150) -> DataFrame:
    """Clusters of pointer events: within ``span_us`` of the cluster's start and ``reach`` of its running centroid.

    Membership moves the centroid, so each session is folded in time order (key events are left out).
    """

    import pyarrow as pa

    names = ["session_id", "start_us", "end_us", "n", "sx", "sy"]

    def run(batches):
        """Sorted rows as a stream; the open cluster is all that is kept."""
        session = start = end = None
        n, sx, sy, far = 0, 0, 0, reach * reach
        for batch in batches:
            out = []
            for s, t, x, y in zip(*(batch.column(c).to_pylist() for c in ("session_id", "t_us", "x_milli", "y_milli"))):
                if s == session and t - start <= span_us and (x - sx / n) ** 2 + (y - sy / n) ** 2 <= far:
                    end, n, sx, sy = t, n + 1, sx + x, sy + y
                    continue
                if n:
                    out.append((session, start, end, n, sx, sy))
                session, start, end, n, sx, sy = s, t, t, 1, x, y
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (session, start, end, n, sx, sy)], names=names)

    pointer = events.filter("kind <> 'key'").select("session_id", "event_id", "t_us", "x_milli", "y_milli")
    return pointer.repartition("session_id").sortWithinPartitions("session_id", "t_us", "event_id").mapInArrow(run, "session_id long, start_us long, end_us long, n long, sx long, sy long")


def zoom_proposals(clusters: DataFrame, lead_us: int, hold_us: int, near_us: int = 50_000) -> DataFrame:
    """Zoom ranges around clusters, merged while less than ``near_us`` apart, with the mean point of their events."""
    rows = clusters.select("session_id", F.greatest(F.lit(0), F.col("start_us") - lead_us).alias("in_us"), (F.col("end_us") + hold_us).alias("out_us"), "n", "sx", "sy")
    w = Window.partitionBy("session_id").orderBy("in_us", "out_us")
    prior = F.max("out_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = islands(rows.withColumn("_p", prior), ["session_id"], ["in_us", "out_us"], F.col("_p").isNull() | (F.col("in_us") - F.col("_p") >= near_us))
    made = found.groupBy("session_id", "island").agg(F.min("in_us").alias("in_us"), F.max("out_us").alias("out_us"), F.sum("n").alias("n"), F.expr("sum(sx) div sum(n)").alias("x_milli"), F.expr("sum(sy) div sum(n)").alias("y_milli"))
    return made.drop("island")


def zoom_ramps(proposals: DataFrame, ramp_us: int) -> DataFrame:
    """Four points of each proposal: out, in, in, out."""
    points = F.array(*[F.struct(F.lit(i).alias("point"), t.cast("long").alias("t_us"), F.lit(v).alias("scale_pct")) for i, (t, v) in enumerate(((F.col("in_us"), 100), (F.col("in_us") + ramp_us, 200), (F.col("out_us") - ramp_us, 200), (F.col("out_us"), 100)))])
    return proposals.select("session_id", "in_us", F.explode(points).alias("p")).select("session_id", "in_us", "p.*")


def key_overlays(events: DataFrame, gap_us: int, most: int = 4, span_us: int = 1_000_000) -> DataFrame:
    """Groups of events: gaps under ``gap_us``, at most ``most``, within ``span_us``; each then ends at the next one's start."""

    def fold(rows):
        out, now = [], None
        for r in rows:
            if now and r["t_us"] - now["end_us"] < gap_us and now["n"] < most and r["t_us"] - now["start_us"] <= span_us:
                now["end_us"], now["n"], now["text"] = r["t_us"], now["n"] + 1, now["text"] + " " + r["kind"]
                continue
            if now:
                out.append(now)
            now = {"session_id": r["session_id"], "start_us": r["t_us"], "end_us": r["t_us"], "n": 1, "text": r["kind"]}
        return out + ([now] if now else [])

    made = fold_per_key(events.select("session_id", "event_id", "t_us", "kind"), ["session_id"], ["t_us", "event_id"], fold, "session_id long, start_us long, end_us long, n long, text string")
    after = F.lead("start_us").over(Window.partitionBy("session_id").orderBy("start_us"))
    return made.select("session_id", "start_us", F.least(F.col("end_us") + gap_us, after).alias("end_us"), "n", "text")


def private_keys_dropped(events: DataFrame, printable: Column, modified: Column) -> DataFrame:
    """Events without printable keys, unless a modifier is held."""
    return events.filter(~printable | modified)


def recorded_keys(keys: DataFrame) -> DataFrame:
    """Key events that may be kept (``key, ctrl, meta, alt, in_field``): none typed into a field, and none of one character unless control, meta or alt is held (shift is not enough)."""
    typed = (F.length("key") == 1) & ~(F.col("ctrl") | F.col("meta") | F.col("alt"))
    return keys.filter(~F.coalesce(F.col("in_field") | typed, F.lit(True)))


def publish_rates(samples: DataFrame) -> DataFrame:
    """Bits a second between samples of a running byte counter (``total``): 0 first and after a reset."""
    w = Window.partitionBy("session_id").orderBy("t_us", "event_id")
    rows = samples.withColumns({"_b": F.lag("total").over(w), "_t": F.lag("t_us").over(w)})
    rate = F.when(F.col("t_us") > F.col("_t"), F.expr("greatest(0, total - _b) * 8000000 div (t_us - _t)"))
    return rows.select("session_id", "event_id", F.coalesce(rate, F.lit(0)).cast("long").alias("bps"))


def coalesced_edits(events: DataFrame, within_us: int, newest: int = 100) -> DataFrame:
    """Runs of one kind, each within a time of the one before, as one edit; the newest of each session stay."""
    w = Window.partitionBy("session_id").orderBy("t_us", "event_id")
    new = ~F.coalesce((F.lag("kind").over(w) == F.col("kind")) & (F.col("t_us") - F.lag("t_us").over(w) <= within_us), F.lit(False))
    found = islands(events.withColumn("_new", new), ["session_id"], ["t_us", "event_id"], F.col("_new"))
    made = found.groupBy("session_id", "island").agg(F.min("kind").alias("kind"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("island")))
    return made.withColumn("_r", rank).filter(F.col("_r") <= newest).drop("island", "_r")


def error_rollup(events: DataFrame) -> DataFrame:
    """Per session and kind: first seen, latest event, count."""
    return events.groupBy("session_id", "kind").agg(F.min("t_us").alias("first_us"), F.max_by("event_id", F.struct("t_us", "event_id")).alias("latest_id"), F.max("t_us").alias("last_us"), F.count(F.lit(1)).alias("n"))


def newest_errors(rollup: DataFrame, most: int = 20) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("last_us"), "kind"))
    return rollup.withColumn("rank", rank).filter(F.col("rank") <= most)


def rolling_means(samples: DataFrame, within_us: int, most: int = 120) -> DataFrame:
    """The newest ``most`` samples of each session with the mean over the time before."""
    w = Window.partitionBy("session_id").orderBy("t_us")
    mean = F.avg("x_milli").over(w.rangeBetween(-within_us, 0))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("t_us"), F.desc("event_id")))
    return samples.withColumns({"mean": F.round(mean, 6), "_r": rank}).filter(F.col("_r") <= most).select("session_id", "event_id", "mean")


def hopping_windows(durations: DataFrame, size: int = 30, overlap: int = 5) -> DataFrame:
    """Overlapping windows that cover each source, with trusted ranges that tile it (in seconds)."""
    hop = size - overlap
    rows = durations.filter("duration_s > 0").select("source_id", "duration_s", F.explode(F.sequence(F.lit(0), F.expr(f"greatest(0, (duration_s - {overlap} + {hop - 1}) div {hop} - 1)"))).alias("n"))
    start, last = F.col("n") * hop, (F.col("n") * hop + size >= F.col("duration_s"))
    rows = rows.withColumns({"start_s": start, "end_s": F.least(start + size, F.col("duration_s"))})
    half = overlap // 2
    return rows.select("source_id", "n", "start_s", "end_s", F.when(F.col("n") == 0, 0).otherwise(F.col("start_s") + half).alias("from_s"), F.when(last, F.col("end_s")).otherwise(F.col("start_s") + hop + half).alias("to_s"))


def bounded_intake(events: DataFrame, period_us: int, most: int) -> DataFrame:
    """Events of each session and period beyond the first ``most`` are dropped and counted: ``session_id, period, kept, dropped``."""
    return events.groupBy("session_id", F.expr(f"t_us div {period_us}").alias("period")).agg(F.count(F.lit(1)).alias("n")).select("session_id", "period", F.least("n", F.lit(most)).alias("kept"), F.greatest(F.col("n") - most, F.lit(0)).alias("dropped"))


def _drained(events: DataFrame, drains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with ``period``, how many drains came before them, and the drains, numbered by the period that they end.

    A drain reads what was written by its time, so an event at that time is read by it.
    """
    numbered = drains.select("session_id", "t_us").distinct().withColumn("period", F.row_number().over(Window.partitionBy("session_id").orderBy("t_us")).cast("long"))
    before = events.filter("t_us IS NOT NULL").withColumn("_before", F.col("t_us") - 1)
    met = asof_join(before, numbered.select("session_id", F.col("t_us").alias("_drain"), "period"), ["session_id"], "_before", "_drain", ["period"])
    return met.drop("_before").withColumn("period", F.coalesce("period", F.lit(0)).cast("long")), numbered.withColumn("period", F.col("period") - 1)


def ring_intake(events: DataFrame, drains: DataFrame, capacity: int) -> DataFrame:
    """A ring of ``capacity`` events (``session_id, event_id, t_us``) that drains (``session_id, t_us``) empty: ``session_id, event_id, period, held, kept``.

    When the ring is full, the newest event is dropped. Each drain empties it, so the length is counted anew in every period between drains:
    ``held`` is the length after the event. Events without a time are neither written nor dropped.
    """
    rows, _ = _drained(events, drains)
    turn = F.row_number().over(Window.partitionBy("session_id", "period").orderBy("t_us", "event_id"))
    return rows.select("session_id", "event_id", "period", turn.alias("_n")).select("session_id", "event_id", "period", F.least("_n", F.lit(capacity)).cast("long").alias("held"), (F.col("_n") <= capacity).alias("kept"))


def ring_drains(events: DataFrame, drains: DataFrame, capacity: int) -> DataFrame:
    """What each drain of ``ring_intake`` reads, and how many events its session has dropped by then: ``session_id, t_us, n_read, dropped``."""
    rows, ends = _drained(events, drains)
    sizes = rows.groupBy("session_id", "period").agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("session_id").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    met = ends.join(sizes, ["session_id", "period"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return met.select("session_id", "t_us", F.least("n", F.lit(capacity)).cast("long").alias("n_read"), F.sum(F.greatest(F.col("n") - capacity, F.lit(0))).over(so_far).alias("dropped"))


def scene_intervals(switches: DataFrame, end_us: Column) -> DataFrame:
    """Scene switches as ranges up to the next one (or ``end_us``), empty ones dropped."""
    w = Window.partitionBy("session_id").orderBy("t_us", "event_id")
    rows = switches.select("session_id", "kind", F.col("t_us").alias("start_us"), F.coalesce(F.lead("t_us").over(w), end_us).alias("end_us"))
    return rows.filter("end_us > start_us")


def replay_snapshot(chunks: DataFrame, requests: DataFrame, width: int = 60_000_000) -> DataFrame:
    """What each request (``request_id, session_id, start_us, end_us``, both ends included) saves: ``request_id, from_us, n, bytes``.

    It begins at the last keyframe at or before the request's start, else at the first one inside the request; a session
    without keyframes (audio only) is cut at the start itself. Requests that meet no chunk are left out.
    """
    keys = chunks.filter("keyframe").select("session_id", F.col("t_us").alias("key_us"))
    before = asof_join(requests, keys, ["session_id"], "start_us", "key_us", ["key_us"])
    after = asof_join(before, keys.withColumnRenamed("key_us", "next_us"), ["session_id"], "start_us", "next_us", ["next_us"], "forward")
    video = keys.select("session_id").distinct().withColumn("_video", F.lit(True))
    inside = F.when(F.col("next_us") <= F.col("end_us"), F.col("next_us"))
    starts = after.join(video, "session_id", "left").withColumn("from_us", F.when(F.col("_video"), F.coalesce("key_us", inside)).otherwise(F.col("start_us"))).filter("from_us IS NOT NULL")
    a = chunks.select("session_id", "bytes", F.col("t_us").alias("a_start"), (F.col("t_us") + 1).alias("a_end"))
    b = starts.select("session_id", "request_id", "from_us", F.col("from_us").alias("b_start"), (F.col("end_us") + 1).alias("b_end"))
    met = interval_join(a, b, ["session_id"], width)
    return met.groupBy("request_id", "from_us").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def parse_event_log(logs: DataFrame) -> DataFrame:
    """DOM event logs (``log_id, json``) of schema version 1 with a session: known kinds with a time, x and y clamped to 0..1, the wheel's ``delta_y`` of scrolls."""
    j = F.from_json("json", "eventLogSchemaVersion INT, sessionId STRING, events ARRAY<STRUCT<kind: STRING, t: DOUBLE, x: DOUBLE, y: DOUBLE, deltaY: DOUBLE>>")
    rows = logs.select("log_id", j.alias("j")).filter("j.eventLogSchemaVersion = 1 AND j.sessionId IS NOT NULL").select("log_id", F.posexplode("j.events").alias("n", "e"))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0.0))))
    rows = rows.filter("e.kind IN ('click', 'scroll', 'key') AND e.t IS NOT NULL")
    return rows.select("log_id", "n", "e.kind", F.col("e.t").alias("t"), unit("e.x").alias("x"), unit("e.y").alias("y"), F.when(F.col("e.kind") == "scroll", F.col("e.deltaY")).alias("delta_y"))


def parse_sidecar(lines: DataFrame) -> DataFrame:
    """NDJSON sidecar lines that are objects with a ``kind``; torn and malformed lines are dropped."""
    kind = F.try_variant_get(F.try_parse_json("line"), "$.kind", "string")
    return lines.select("session_id", "line_no", kind.alias("kind")).filter("kind <> ''")


def spill_plan(chunks: DataFrame, target: int) -> DataFrame:
    """Chunks to spill: the oldest up to ``target`` bytes, extended to the next keyframe."""
    w = Window.partitionBy("session_id").orderBy("t_us", "event_id")
    before = F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = chunks.withColumn("_b", before)
    # the first keyframe at which the target is reached ends the spill
    ends = rows.filter(F.col("keyframe") & (F.col("_b") >= target)).groupBy("session_id").agg(F.min("_b").alias("end"))
    return rows.join(ends, "session_id").filter("_b < end").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))

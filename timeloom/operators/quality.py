"""Source inventories: health, proxies, relinking, integrity; caches and jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions.scalars import duration_bucket
from timeloom.operators.helpers import asof_join


#: A track that starts later than this many ms, and sides that start further apart, are reported.
LATE_START_MS, APART_MS = 1, 20


def health_warnings(sources: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row for each rule that a source or one of its tracks breaks: ``source_id, track_no`` (0: the source), ``code, severity, blocking``.

    ``tracks``: ``source_id, track_no, kind`` (video or audio), ``start_ms, rotation, rate_mode, can_decode, sample_rate``. The
    first video track is the primary one, the first audio track where there is no video; one that can't be decoded blocks.
    """
    video, audio = F.col("kind") == "video", F.col("kind") == "audio"
    by = tracks.groupBy("source_id").agg(
        F.min(F.when(video, F.col("track_no"))).alias("first_video"), F.min(F.when(audio, F.col("track_no"))).alias("first_audio"), F.bool_or("can_decode").alias("any_decodes"),
        F.min_by(F.when(video, F.col("start_ms")), F.when(video, F.col("track_no"))).alias("v_start"), F.min_by(F.when(audio, F.col("start_ms")), F.when(audio, F.col("track_no"))).alias("a_start"),
        F.size(F.collect_set(F.when(audio & (F.col("sample_rate") > 0), F.col("sample_rate")))).alias("n_rates"),
    )

    def listed(rules):
        return F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(b) if isinstance(b, bool) else b).alias("blocking"))) for c, code, severity, b in rules])))

    primary = F.coalesce(F.when(video, F.col("track_no") == F.col("first_video")).otherwise(F.col("first_video").isNull() & (F.col("track_no") == F.col("first_audio"))), F.lit(False))
    own = tracks.join(by, "source_id").select("source_id", "track_no", listed([
        (video & (F.col("rate_mode") == "variable"), "variable-frame-rate", "warning", False),
        (F.abs("start_ms") > LATE_START_MS, "non-zero-track-start", "warning", False),
        (video & (F.abs("rotation") % 360 != 0), "rotation-metadata", "info", False),
        (video & ~F.col("can_decode"), "unsupported-video-codec", "error", primary),
        (audio & ~F.col("can_decode"), "unsupported-audio-codec", "error", primary),
    ]).alias("w"))
    dead = ~F.coalesce("any_decodes", F.lit(False))
    whole = sources.join(by, "source_id", "left").select("source_id", F.lit(0).alias("track_no"), listed([
        (F.coalesce(F.col("duration_ms") <= 0, F.lit(True)), "missing-duration", "error", dead),
        (F.abs(F.col("a_start") - F.col("v_start")) > APART_MS, "audio-video-offset", "warning", False),
        (F.col("n_rates") > 1, "mixed-audio-sample-rates", "info", False),
        (dead, "undecodable-track", "error", True),
    ]).alias("w"))
    return own.unionByName(whole).select("source_id", "track_no", "w.*")


def health_status(sources: DataFrame, warnings: DataFrame) -> DataFrame:
    by = warnings.groupBy("source_id").agg(F.bool_or("blocking").alias("b"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("b"), "blocked").when(F.col("n") > 0, "warnings").otherwise("ok")
    return sources.select("source_id").join(by, "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("n_warnings"), status.alias("status"))


def visible_health(sources: DataFrame, warnings: DataFrame, passive: tuple[str, ...]) -> DataFrame:
    """Status from the warnings that aren't passive."""
    return health_status(sources, warnings.filter(~F.col("code").isin(*passive)))


#: From these on a source is large, or heavy, and codecs that are slow to decode.
LARGE_WIDTH, LARGE_HEIGHT, HIGH_BITS_A_SECOND, HEAVY_CODECS = 2560, 1440, 35_000_000, ("vp9", "vp09", "av1", "av01", "hev1", "hvc1")


def proxy_reasons(sources: DataFrame) -> DataFrame:
    """Why a source should have a proxy: ``source_id, reasons`` (comma-joined), only where there is one.

    ``sources``: ``source_id, can_decode, width, height, byte_size, duration_ms, rate_mode, codec, fps`` and ``encode_fps`` (of a
    speed probe, or null); what can't be decoded has no proxy.
    """
    bits = F.when(F.col("duration_ms") > 0, F.col("byte_size") * 8000 / F.col("duration_ms")).otherwise(0)
    heavy = reduce(lambda x, y: x | y, [F.lower("codec").contains(c) for c in HEAVY_CODECS])
    rules = [
        ((F.col("width") >= LARGE_WIDTH) | (F.col("height") >= LARGE_HEIGHT), "large-resolution"),
        (bits >= HIGH_BITS_A_SECOND, "high-bitrate"),
        (F.col("rate_mode") == "variable", "variable-frame-rate"),
        (heavy, "heavy-codec"),
        ((F.col("encode_fps") > 0) & (F.col("encode_fps") < F.coalesce("fps", F.lit(30)) * 0.75), "slow-throughput"),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, name) for c, name in rules]))
    return sources.filter("can_decode").select("source_id", F.array_join(reasons, ",").alias("reasons")).filter("reasons <> ''")


#: What a source's place in the proxy plan goes by, most urgent first.
PROXY_PRIORITIES = ("active-range", "visible-filmstrip", "selected-source", "background-bin")


def proxy_order(sources: DataFrame, active: DataFrame, visible: DataFrame, selected: DataFrame) -> DataFrame:
    """``priority`` and ``place`` of each source in its project's proxy plan: sources of the active range, then visible, selected and all others, each by id.

    The sets (``project_id, source_id``) may overlap; the most urgent counts.
    """
    sets = [df.select("project_id", "source_id", F.lit(k).alias("_k")) for k, df in enumerate((active, visible, selected))]
    best = sets[0].unionByName(sets[1]).unionByName(sets[2]).groupBy("project_id", "source_id").agg(F.min("_k").alias("_k"))
    rows = sources.select("project_id", "source_id").join(best, ["project_id", "source_id"], "left").withColumn("_k", F.coalesce("_k", F.lit(3)))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("_k", "source_id"))
    return rows.select("project_id", "source_id", F.get(F.array(*map(F.lit, PROXY_PRIORITIES)), F.col("_k")).alias("priority"), place.alias("place"))


def sequence_rates(sources: DataFrame) -> DataFrame:
    """The most frequent rate (``fps``, null: none) of each project's sources, the larger on a tie, 30 where none has one."""
    n = sources.groupBy("project_id", "fps").agg(F.count("fps").alias("n"))
    return n.groupBy("project_id").agg(F.coalesce(F.max_by("fps", F.struct("n", "fps")), F.lit(30)).alias("fps"))


#: How far durations and track times of the same file may differ.
DURATION_WITHIN_MS, TIMING_WITHIN_MS = 250, 50


def relink(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates for each source with the reasons against them (empty: a match): ``source_id, cand_id, reasons``.

    Both sides: an id, ``file_name, byte_size, duration_ms, start_ms, rotation, sample_rate, channels``; a reason needs a value on
    both sides where one may be missing. All candidates of the same name and size are reported; a source without one gets
    the candidate of its name whose size is nearest (the smaller on a tie), so that a frequent name makes no pairs of all.
    """
    facts = ("byte_size", "duration_ms", "start_ms", "rotation", "sample_rate", "channels")
    c = candidates.select("file_name", F.struct("cand_id", *facts).alias("c"), F.col("byte_size").alias("c_size"))
    mine = sources.select("source_id", "file_name", *facts)
    exact = mine.join(c.withColumnRenamed("c_size", "byte_size"), ["file_name", "byte_size"]).select("source_id", *facts, "c")
    rest = mine.join(exact.select("source_id").distinct(), "source_id", "left_anti")
    low = asof_join(rest, c.withColumnsRenamed({"c": "lo", "c_size": "lo_size"}), ["file_name"], "byte_size", "lo_size", ["lo_size", "lo"])
    both = asof_join(low, c.withColumnsRenamed({"c": "hi", "c_size": "hi_size"}), ["file_name"], "byte_size", "hi_size", ["hi_size", "hi"], "forward")
    nearer = F.col("lo").isNotNull() & (F.col("hi").isNull() | (F.col("byte_size") - F.col("lo_size") <= F.col("hi_size") - F.col("byte_size")))
    near = both.select("source_id", *facts, F.when(nearer, F.col("lo")).otherwise(F.col("hi")).alias("c")).filter("c IS NOT NULL")
    differs = lambda name: F.col(f"c.{name}") != F.col(name)
    rules = [
        (differs("byte_size"), "size"),
        (F.abs(F.col("c.duration_ms") - F.col("duration_ms")) > DURATION_WITHIN_MS, "duration"),
        (F.abs(F.col("c.start_ms") - F.col("start_ms")) > TIMING_WITHIN_MS, "track timing"),
        (differs("rotation"), "rotation"),
        (differs("sample_rate"), "audio sample rate"),
        (differs("channels"), "audio channel count"),
    ]
    reasons = F.array_compact(F.array(*[F.when(r, name) for r, name in rules]))
    return exact.unionByName(near).select("source_id", "c.cand_id", F.array_join(reasons, ",").alias("reasons"))


def integrity(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The first check that fails for each entry (``entry_id, bytes, digest, duration_ms``): missing, size, digest, descriptor (over 250 ms apart), or ok."""
    f = files.select("entry_id", F.col("bytes").alias("f_bytes"), F.col("digest").alias("f_digest"), F.col("duration_ms").alias("f_ms"))
    far = F.abs(F.col("f_ms") - F.col("duration_ms")) > DURATION_WITHIN_MS
    check = F.when(F.col("f_bytes").isNull(), "missing").when(F.col("f_bytes") != F.col("bytes"), "size").when(F.col("f_digest") != F.col("digest"), "digest").when(far, "descriptor").otherwise("ok")
    return manifest.join(f, "entry_id", "left").select("entry_id", check.alias("result"))


def integrity_summary(items: DataFrame) -> DataFrame:
    return items.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("result") == "missing").alias("n_missing"), F.count_if(F.col("result") == "size").alias("n_size"), F.count_if(F.col("result") == "digest").alias("n_digest"), F.count_if(F.col("result") == "descriptor").alias("n_descriptor"), F.bool_and(F.col("result") == "ok").alias("ok"))


def content_dedup(assets: DataFrame) -> DataFrame:
    """One asset for each digest: the least id stands for all. ``asset_id, digest, kept_id``, a row for each that refers to it (a digest may have any number)."""
    kept = assets.groupBy("digest").agg(F.min("asset_id").alias("kept_id"))
    return assets.join(kept, "digest").select("asset_id", "digest", "kept_id")


def cache_usage(entries: DataFrame, budget: int, free: DataFrame | None = None) -> DataFrame:
    """Bytes of each store and category (status 4 is deleted and left out), with the store's total, free bytes (``store_id, free_bytes``, null: unknown) and warning level."""
    live = entries.filter("status_rank <> 4").groupBy("store_id", "category_rank").agg(F.sum(F.greatest(F.lit(0), F.col("bytes"))).alias("bytes"), F.count(F.lit(1)).alias("n"))
    total = F.sum("bytes").over(Window.partitionBy("store_id"))
    level = F.when(F.col("total") >= budget, "full").when(F.col("total") * 10 >= budget * 8, "near").otherwise("ok")
    made = live.withColumn("total", total).withColumn("level", level)
    return made.join(free, "store_id", "left") if free is not None else made


def usage_rollup(entries: DataFrame) -> DataFrame:
    rows = entries.filter("status_rank <> 4").rollup("store_id", "category_rank").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return rows.select(F.coalesce("store_id", F.lit("all")).alias("store_id"), F.coalesce("category_rank", F.lit(-1)).alias("category_rank"), "bytes", "n")


#: What an entry's ``status_rank`` says: those in use are never evicted, deleted ones take no room.
IN_USE, DELETED = 0, 4


def eviction_plan(entries: DataFrame, target: int, pressure: DataFrame | None = None) -> DataFrame:
    """Entries to evict from each store, in order (failed, stale, ready; then by category and last use), until its bytes are at most ``target``.

    ``pressure`` (``store_id, free_bytes, least_free``) asks for as much as a store's free space lacks, where the target doesn't give that.
    """
    live = entries.filter(F.col("status_rank") != DELETED)
    total = live.withColumn("_all", F.sum("bytes").over(Window.partitionBy("store_id"))).filter(F.col("status_rank") != IN_USE)
    aim = F.lit(target)
    if pressure is not None:
        total = total.join(pressure.select("store_id", (F.col("least_free") - F.col("free_bytes")).alias("_lack")), "store_id", "left")
        aim = F.when(F.col("_lack") > 0, F.least(aim, F.greatest(F.lit(0), F.col("_all") - F.col("_lack")))).otherwise(aim)
    w = Window.partitionBy("store_id").orderBy(F.desc("status_rank"), "category_rank", "last_used", "entry_id")
    gone = F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return total.withColumns({"_gone": gone, "place": F.row_number().over(w)}).filter(F.col("_all") - F.col("_gone") > F.greatest(F.lit(0), aim)).select("store_id", "entry_id", "place", "bytes")


def least_recent(entries: DataFrame, most_bytes: int) -> DataFrame:
    """Entries that don't fit when the most recently used are kept up to a size."""
    w = Window.partitionBy("store_id").orderBy(F.desc("last_used"), "entry_id").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("_run", F.sum("bytes").over(w)).filter(F.col("_run") > most_bytes).select("store_id", "entry_id")


#: Jobs read back in these states were interrupted and count as failed.
INTERRUPTED = ("running", "choosing-destination", "finalizing")


def job_summary(jobs: DataFrame) -> DataFrame:
    """Jobs of each project by status, as they are read back after a stop."""
    status = F.when(F.col("status").isin(*INTERRUPTED), "failed").otherwise(F.col("status"))
    return jobs.withColumn("status", status).groupBy("project_id").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pending", "completed", "failed", "canceled")], F.count(F.lit(1)).alias("n"))


def history_evictions(jobs: DataFrame, most: int = 50) -> DataFrame:
    """Jobs beyond ``most`` of a project: completed ones go first, oldest first, then failed, then canceled; active ones never."""
    n = F.count(F.lit(1)).over(Window.partitionBy("project_id"))
    rank = F.when(F.col("status") == "completed", 0).when(F.col("status") == "failed", 1).when(F.col("status") == "canceled", 2)
    rows = jobs.withColumns({"_n": n, "_rank": rank}).filter("_rank IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("_rank", "enqueued_day", "job_id"))
    return rows.withColumn("place", place).filter(F.col("place") <= F.col("_n") - most).select("project_id", "job_id", "place")


def metric_status(observed: DataFrame, definitions: DataFrame) -> DataFrame:
    """Each definition (``metric, good, bad, higher_is_worse``) with the status of its value; null: not measured."""
    v, sign = F.col("value"), F.when(F.col("higher_is_worse"), 1).otherwise(-1)
    status = F.when(v.isNull(), "not-measured").when(v * sign <= F.col("good") * sign, "ok").when(v * sign <= F.col("bad") * sign, "warn").otherwise("breach")
    return definitions.join(observed, "metric", "left").select("metric", status.alias("status"))


def source_aliases(sources: DataFrame) -> DataFrame:
    """``source-1`` and so on by id in each project."""
    n = F.row_number().over(Window.partitionBy("project_id").orderBy("source_id"))
    return sources.select("project_id", "source_id", F.concat(F.lit("source-"), n).alias("alias"))


def canonical_keys(sources: DataFrame) -> DataFrame:
    """A digest of each source's facts in fixed field order."""
    return sources.select("source_id", F.sha2(F.to_json(F.struct("byte_size", "duration_ms", "file_name", "width")), 256).alias("key"))


def clip_dependency_keys(clips: DataFrame, keys: DataFrame) -> DataFrame:
    """A digest of what a clip's picture depends on: its own times and its source's key (``source_id, key``)."""
    met = clips.join(keys.select("source_id", F.col("key").alias("source")), "source_id")
    return met.select("clip_id", F.sha2(F.to_json(F.struct(F.col("dur_ms").alias("duration_ms"), "in_ms", "source", "start_ms")), 256).alias("key"))


def safe_summaries(sources: DataFrame) -> DataFrame:
    """What may be told of a source: ``source_id, alias, media_kind, container, codecs, duration`` (a bucket), ``status`` (comma-joined codes)."""
    container = F.trim(F.get(F.split(F.get(F.split("mime", ";"), F.lit(0)), "/"), F.lit(1)))
    status = F.array_compact(F.array(F.when(F.col("offline"), "offline"), F.when(F.col("video_fails"), "video-decode-unsupported"), F.when(F.col("audio_fails"), "audio-decode-unsupported")))
    kind = F.when(F.col("offline"), "offline").otherwise(F.coalesce("kind", F.lit("unknown")))
    made = sources.select("source_id", kind.alias("media_kind"), container.alias("container"), F.array_join("codecs", ",").alias("codecs"), duration_bucket(F.col("duration_ms")).alias("duration"), F.when(F.size(status) == 0, "ok").otherwise(F.array_join(status, ",")).alias("status"))
    return made.join(source_aliases(sources).select("source_id", "alias"), "source_id")


def audible_tracks(tracks: DataFrame) -> DataFrame:
    """Unmuted tracks; if any track of the project is solo, only solo ones."""
    solo = F.max("solo").over(Window.partitionBy("project_id"))
    return tracks.withColumn("_any", solo).filter(~F.col("muted") & (~F.col("_any") | F.col("solo"))).select("project_id", "track_no")


def storage_pressure(stores: DataFrame, reserve: int = 0) -> DataFrame:
    """``store_id, used_pct, level, left_s, fits`` from ``bytes, quota, rate`` (bytes a second) and ``need`` (of the next job): whether it fits beside a reserve."""
    pct = F.expr("bytes * 100 div quota")
    level = F.when(pct >= 95, "critical").when(pct >= 80, "high").otherwise("normal")
    return stores.select("store_id", pct.alias("used_pct"), level.alias("level"), F.expr("greatest(0, quota - bytes) div rate").alias("left_s"), (F.col("quota") - F.col("bytes") >= F.col("need") + reserve).alias("fits"))


def parse_bundles(files: DataFrame) -> DataFrame:
    """Bundle manifests (``bundle_id, json``) as asset rows; a manifest without version or assets, and an asset without id or size, is dropped."""
    j = F.from_json("json", "version INT, assets ARRAY<STRUCT<id: STRING, bytes: BIGINT, digest: STRING>>")
    rows = files.select("bundle_id", j.alias("j")).filter("j.version IS NOT NULL").select("bundle_id", F.explode("j.assets").alias("a"))
    return rows.filter("a.id IS NOT NULL AND a.bytes >= 0").select("bundle_id", F.col("a.id").alias("asset_id"), F.col("a.bytes").alias("bytes"), F.coalesce("a.digest", F.lit("")).alias("digest"))

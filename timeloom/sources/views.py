"""Timeline, capture and signal tables as views over the given star-schema tables, for Spark and for plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (what it reads, Spark SQL with {names} as inputs, SQL of the same rows; None where both are alike)
VIEWS: dict[str, tuple[tuple[str, ...], str, str | None]] = {
    "v_clips": (
        ("lineitem",),
        "SELECT l_suppkey AS project_id, l_partkey % 4 AS track_no, ((l_orderkey*100+l_linenumber)*1000000+l_partkey)*10000+l_suppkey AS clip_id, l_partkey AS source_id, CAST(datediff(l_shipdate, DATE'1992-01-01') AS BIGINT)*1000 AS start_ms, CAST(floor(l_quantity) AS BIGINT)*1000 AS dur_ms, CAST(floor(l_extendedprice) AS BIGINT) % 10000 AS in_ms FROM {lineitem}",
        "SELECT l_suppkey AS project_id, l_partkey % 4 AS track_no, ((l_orderkey*100+l_linenumber)*1000000+l_partkey)*10000+l_suppkey AS clip_id, l_partkey AS source_id, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT)*1000 AS start_ms, CAST(floor(l_quantity) AS BIGINT)*1000 AS dur_ms, CAST(floor(l_extendedprice) AS BIGINT) % 10000 AS in_ms FROM lineitem",
    ),
    "v_points": (
        ("orders",),
        "SELECT o_orderkey AS point_id, o_custkey % 100 AS project_id, CAST(datediff(o_orderdate, DATE'1992-01-01') AS BIGINT)*1000 AS t_ms FROM {orders}",
        "SELECT o_orderkey AS point_id, o_custkey % 100 AS project_id, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)*1000 AS t_ms FROM orders",
    ),
    "v_events": (
        ("events",),
        "SELECT event_id, user_id AS session_id, event_type AS kind, unix_micros(CAST(ts AS TIMESTAMP)) AS t_us, CAST(floor(value*100) AS BIGINT) % 1000 AS x_milli, CAST(get_json_object(props,'$.k') AS BIGINT) * 10 % 1000 AS y_milli FROM {events}",
        "SELECT event_id, user_id AS session_id, event_type AS kind, epoch_us(ts) AS t_us, CAST(floor(value*100) AS BIGINT) % 1000 AS x_milli, CAST(json_extract_string(props,'$.k') AS BIGINT) * 10 % 1000 AS y_milli FROM events",
    ),
    "v_pcm": (
        ("embeddings",),
        "SELECT vec_id AS source_id, pos AS i, CAST(floor(CAST(col AS DOUBLE)*1000) AS BIGINT) AS x_milli FROM (SELECT vec_id, posexplode(embedding) FROM {embeddings})",
        "SELECT vec_id AS source_id, CAST(generate_subscripts(embedding,1)-1 AS INTEGER) AS i, CAST(floor(CAST(unnest(embedding) AS DOUBLE)*1000) AS BIGINT) AS x_milli FROM embeddings",
    ),
    "v_chunks": (
        ("embeddings",),
        "SELECT CAST(floor(vec_id / 64) AS BIGINT) AS source_id, CAST(vec_id % 64 AS BIGINT) AS chunk_no, transform(embedding, x -> CAST(x AS DOUBLE)) AS samples FROM {embeddings}",
        "SELECT CAST(floor(vec_id / 64) AS BIGINT) AS source_id, CAST(vec_id % 64 AS BIGINT) AS chunk_no, CAST(embedding AS DOUBLE[]) AS samples FROM embeddings",
    ),
    "v_series": (("v_pcm",), "SELECT CAST(floor(source_id / 64) AS BIGINT) AS source_id, CAST(source_id % 64 * 64 + i AS BIGINT) AS i, CAST(abs(x_milli) AS DOUBLE) / 1000 AS x FROM {v_pcm}", None),
    "v_pixels": (("v_pcm",), "SELECT source_id AS frame_id, CAST(floor(i/8) AS INT) AS y, i % 8 AS x, least(greatest(x_milli+500,0),999) AS v_milli FROM {v_pcm}", None),
    "v_rgb": (("v_pixels",), "SELECT frame_id, y, x, CAST(v_milli AS DOUBLE) * 1.1D / 1000 - 0.03D AS r, CAST(v_milli * 7 % 1000 AS DOUBLE) / 1000 AS g, CAST(v_milli * 3 % 1000 AS DOUBLE) / 1000 AS b FROM {v_pixels}", "SELECT frame_id, y, x, CAST(v_milli AS DOUBLE) * 1.1::DOUBLE / 1000 - 0.03::DOUBLE AS r, CAST(v_milli * 7 % 1000 AS DOUBLE) / 1000 AS g, CAST(v_milli * 3 % 1000 AS DOUBLE) / 1000 AS b FROM v_pixels"),
    "v_segments": (
        ("v_events",),
        "SELECT session_id AS track_id, event_id AS seg_id, CAST(floor(t_us/3600000) AS BIGINT) AS start_ms, CAST(1000 AS BIGINT) AS dur_ms, concat(kind, ' ', CAST(y_milli % 3 AS STRING), '!') AS text FROM {v_events}",
        "SELECT session_id AS track_id, event_id AS seg_id, CAST(floor(t_us/3600000) AS BIGINT) AS start_ms, CAST(1000 AS BIGINT) AS dur_ms, concat(kind, ' ', CAST(y_milli % 3 AS VARCHAR), '!') AS text FROM v_events",
    ),
    "v_cache": (("part",), "SELECT p_partkey AS entry_id, p_brand AS store_id, p_size % 6 AS category_rank, p_partkey % 5 AS status_rank, (p_partkey*7919) % 10007 AS last_used, CAST(floor(p_retailprice*100) AS BIGINT) AS bytes FROM {part}", None),
    "v_jobs": (
        ("orders",),
        "SELECT o_orderkey AS job_id, o_custkey % 100 AS project_id, CASE o_orderstatus WHEN 'O' THEN CASE o_orderkey % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'finalizing' WHEN 2 THEN 'choosing-destination' ELSE 'pending' END WHEN 'F' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'canceled' ELSE 'completed' END ELSE 'failed' END AS status, CAST(datediff(o_orderdate, DATE'1992-01-01') AS BIGINT) AS enqueued_day FROM {orders}",
        "SELECT o_orderkey AS job_id, o_custkey % 100 AS project_id, CASE o_orderstatus WHEN 'O' THEN CASE o_orderkey % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'finalizing' WHEN 2 THEN 'choosing-destination' ELSE 'pending' END WHEN 'F' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'canceled' ELSE 'completed' END ELSE 'failed' END AS status, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS enqueued_day FROM orders",
    ),
    "v_sources": (("part",), "SELECT p_partkey AS source_id, p_brand AS project_id, p_name AS file_name, CAST(floor(p_retailprice*100) AS BIGINT) AS byte_size, CAST(p_size AS BIGINT)*1000 AS duration_ms, p_size*100 AS width, p_partkey % 3 AS fps_code FROM {part}", None),
    "v_descriptors": (("v_sources",), "SELECT source_id, file_name, byte_size, duration_ms, source_id % 3 * 40 AS start_ms, source_id % 4 * 90 AS rotation, CASE WHEN source_id % 6 = 0 THEN NULL ELSE 44100 + source_id % 2 * 3900 END AS sample_rate, CASE WHEN source_id % 6 = 0 THEN NULL ELSE 1 + source_id % 2 END AS channels FROM {v_sources}", None),
    "v_candidates": (("v_descriptors",), "SELECT source_id+1000000 AS cand_id, file_name, byte_size + CASE WHEN source_id % 7 = 0 THEN 1 ELSE 0 END AS byte_size, duration_ms + CASE WHEN source_id % 5 = 0 THEN 400 WHEN source_id % 3 = 0 THEN 200 ELSE 0 END AS duration_ms, start_ms + CASE WHEN source_id % 8 = 0 THEN 60 WHEN source_id % 8 = 1 THEN 50 ELSE 0 END AS start_ms, CASE WHEN source_id % 9 = 0 THEN NULL WHEN source_id % 9 = 1 THEN 180 ELSE rotation END AS rotation, CASE WHEN source_id % 10 = 0 THEN 48000 ELSE sample_rate END AS sample_rate, channels + CASE WHEN source_id % 11 = 0 THEN 1 ELSE 0 END AS channels FROM {v_descriptors}", None),
    "v_tracks": (("v_sources",), "SELECT source_id, 1 AS track_no, 'video' AS kind, CASE WHEN source_id % 13 = 0 THEN 5 ELSE 0 END AS start_ms, source_id % 4 * 90 AS rotation, CASE WHEN fps_code = 0 THEN 'variable' ELSE 'constant' END AS rate_mode, source_id % 17 <> 0 AS can_decode, CASE source_id % 5 WHEN 0 THEN 'vp09.00' WHEN 1 THEN 'hvc1.1' WHEN 2 THEN 'AV01' ELSE 'avc1.64' END AS codec, 0 AS sample_rate FROM {v_sources} WHERE source_id % 10 <> 9 UNION ALL SELECT source_id, 2, 'audio', source_id % 40, 0, '', source_id % 19 <> 0 AND source_id % 17 <> 0, 'mp4a', 48000 FROM {v_sources} UNION ALL SELECT source_id, 3, 'audio', 0, 0, '', source_id % 17 <> 0, 'opus', 44100 + source_id % 2 * 3900 FROM {v_sources} WHERE source_id % 3 = 0", None),
    "v_clips_after": (("v_clips",), "SELECT project_id, CASE WHEN clip_id % 17 = 0 THEN (track_no+1) % 4 ELSE track_no END AS track_no, clip_id, source_id, start_ms + CASE WHEN clip_id % 13 = 0 THEN 500 ELSE 0 END AS start_ms, dur_ms, in_ms FROM {v_clips} WHERE clip_id % 11 <> 0", None),
    "v_detections": (("v_events",), "SELECT CAST(floor(event_id/8) AS BIGINT) AS frame_id, event_id AS det_id, x_milli, y_milli, 300 AS w_milli, 300 AS h_milli, (x_milli*7+y_milli*3) % 1000 AS conf_milli FROM {v_events}", None),
    "v_manifest": (
        ("v_events",),
        """SELECT session_id, event_id AS line_no, CASE WHEN event_id % 17 = 0 THEN '{{"kind":"chunk","fro' WHEN event_id % 5 = 0 THEN concat('{{"kind":"pause","atUs":', t_us, '}}') WHEN event_id % 5 = 1 THEN concat('{{"kind":"resume","atUs":', t_us, '}}')
 WHEN event_id % 101 = 2 THEN concat('{{"kind":"header","version":1,"sessionId":"s","startedAtIso":"2026","epochUs":null,"sources":[{{"sourceId":"a","kind":"screen"}}],"chunkTargetS":2}}') WHEN event_id % 101 = 3 THEN '{{"kind":"header","version":2,"sessionId":"s","startedAtIso":"2026","epochUs":null,"sources":[],"chunkTargetS":2}}' WHEN event_id % 101 = 4 THEN '{{"kind":"header","version":1,"sessionId":"s","startedAtIso":"2026","epochUs":null,"sources":[{{"sourceId":"a","kind":"fax"}}],"chunkTargetS":2}}'
 WHEN event_id % 101 = 7 THEN concat('{{"kind":"epoch","epochUs":', t_us, '}}') WHEN event_id % 101 = 8 THEN '{{"kind":"epoch","epochUs":"soon"}}' WHEN event_id % 101 = 9 THEN '{{"kind":"source-ended","sourceId":"a","reason":"stopped"}}' WHEN event_id % 101 = 12 THEN '{{"kind":"finalize","endedAtIso":"2026","reason":"user"}}' WHEN event_id % 101 = 13 THEN '{{"kind":"finalize","reason":"user"}}'
 WHEN event_id % 101 = 14 THEN concat('{{"kind":"source-added","source":{{"sourceId":"b","kind":"mic","label":"Mic"}},"atUs":', t_us, '}}') WHEN event_id % 101 = 17 THEN concat('{{"kind":"source-added","source":{{"sourceId":"b","kind":"mic"}},"atUs":', t_us, '}}') WHEN event_id % 101 = 18 THEN concat('{{"kind":"source-region-applied","sourceId":"a","mode":"crop","atUs":', t_us, '}}') WHEN event_id % 101 = 19 THEN concat('{{"kind":"source-region-applied","sourceId":"a","mode":"zoom","atUs":', t_us, '}}')
 WHEN event_id % 101 = 22 THEN concat('{{"kind":"scene-switch","sceneId":"x","atUs":', t_us, '}}') WHEN event_id % 101 = 23 THEN '{{"kind":"note","atUs":5}}' WHEN event_id % 101 = 24 THEN concat('{{"kind":"chunk","sourceId":"a","file":"f","byteOffset":0,"byteLength":9,"fromUs":', t_us, ',"toUs":', t_us, ',"keyFrame":1,"preEncodeDrops":0}}')
 ELSE concat('{{"kind":"chunk","sourceId":"s', event_id % 3, '","file":"f', event_id % 7, '","byteOffset":', event_id, ',"byteLength":', x_milli, ',"fromUs":', t_us, ',"toUs":', t_us + 2000000, ',"keyFrame":', CASE WHEN event_id % 4 = 2 THEN 'true' ELSE 'false' END, ',"preEncodeDrops":', event_id % 2, '}}') END AS line FROM {v_events}""",
        None,
    ),
    "v_tight": (("v_clips",), "SELECT project_id, track_no, clip_id, source_id, CAST(coalesce(sum(dur_ms) OVER (PARTITION BY project_id, track_no ORDER BY start_ms, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN track_no = 3 THEN 700 ELSE 0 END AS BIGINT) AS start_ms, dur_ms, in_ms FROM {v_clips}", None),
    "v_regions": (("v_points",), "SELECT point_id, project_id, t_ms * 7 % 700000 AS cut_start, t_ms * 7 % 700000 + 300 + point_id % 4000 AS cut_end FROM {v_points}", None),
    "v_timeline": (("v_clips",), "SELECT project_id, track_no, clip_id, source_id, CAST(coalesce(sum(dur_ms + 1000) OVER (PARTITION BY project_id, track_no ORDER BY start_ms, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms, dur_ms, in_ms FROM {v_clips}", None),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view, or the table of that name, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reads, text, _ = VIEWS[name]
    return spark.sql(text, **{r: view(spark, sf_dir, r) for r in reads})


def sql_with(names: list[str], body: str) -> str:
    """``body`` as plain SQL, after the views that it needs."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in order:
            for r in VIEWS[name][0]:
                need(r)
            order.append(name)

    for name in names:
        need(name)
    parts = []
    for name in order:
        reads, text, plain = VIEWS[name]
        parts.append(f"{name} AS ({plain or text.format(**{r: r for r in reads})})")
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(parts)}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[5:]}" if parts else body
    return f"WITH {', '.join(parts)} {body}" if parts else body

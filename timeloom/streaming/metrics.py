"""Streaming twins of the capture operators.

State is bounded by a watermark, or ends when a session has been idle for ``idle_ms``: what is still open is handed on then,
and the state is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType


def windowed_means(events: DataFrame, time: str, late: str, size: str) -> DataFrame:
    """Mean and count of ``value`` by kind over tumbling windows; rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), "event_type").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "mean", "n")


def activity_sessions(events: DataFrame, time: str, late: str, gap: str) -> DataFrame:
    """Runs of events of a user with gaps under ``gap``."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def chunks_once(chunks: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """Chunk log rows without those delivered again within the watermark."""
    return chunks.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def chunk_totals(chunks: DataFrame, time: str | None = None, late: str = "10 minutes", gap: str = "1 hour") -> DataFrame:
    """Chunks, bytes, drops and times of each source of a session.

    With a ``time`` column a session's totals are final, and its state gone, once nothing came for ``gap`` and ``late`` has
    passed; without one they are running totals (of a bounded replay).
    """
    keys = ["session_id", "source_id"]
    grouped = chunks.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap)) if time else chunks.groupBy(*keys)
    made = grouped.agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("bytes").alias("bytes"), F.sum("drops").alias("drops"), F.min("t_us").alias("first_us"), F.max("to_us").alias("last_us"))
    return made.drop("session_window")


def bounded_intake(events: DataFrame, time: str, late: str, period: str, most: int) -> DataFrame:
    """Events of a session and period beyond the first ``most`` are dropped and counted: ``session_id, start, kept, dropped``."""
    made = events.withWatermark(time, late).groupBy("session_id", F.window(time, period)).agg(F.count(F.lit(1)).alias("n"))
    return made.select("session_id", F.col("window.start").alias("start"), F.least("n", F.lit(most)).alias("kept"), F.greatest(F.col("n") - most, F.lit(0)).alias("dropped"))


class _Newest(StatefulProcessor):
    """Keeps the newest time of a session, and a timer that ends it when nothing has come for a while."""

    def __init__(self, time: str, late_ms: int, idle_ms: int | None, columns: list[str]):
        self.time, self.late_ms, self.idle_ms, self.columns = time, late_ms, idle_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "us long")
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        for part in rows:
            us = part[self.time].astype("datetime64[us]").astype("int64")
            # a row is measured against all that came before it, in this batch and in those before
            before = us.cummax().shift()
            before = before.fillna(newest) if newest is not None else before
            before = before.clip(lower=newest) if newest is not None else before
            late = (before - us > self.late_ms * 1000).fillna(False)
            newest = int(us.max()) if newest is None else max(newest, int(us.max()))
            yield part[self.columns].assign(late=late.to_numpy(bool))
        if newest is not None:
            self.newest.update((newest,))
        if self.idle_ms:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            ends = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(ends)
            self.timer.update((ends,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        self.timer.clear()
        return iter([])

    def close(self) -> None:
        pass


def late_marked(events: DataFrame, time: str, late_ms: int, idle_ms: int | None = 3_600_000) -> DataFrame:
    """All rows of a stream with ``late``: whether they are over ``late_ms`` behind the newest row of their session that came before them, in any batch.

    Rows of a session are taken in the order in which they came. The newest time is state; it goes when a session has been idle for ``idle_ms``
    (None: it stays until a bounded replay ends). Needs the RocksDB state store.
    """
    schema = StructType([*events.schema.fields, StructField("late", BooleanType())])
    return events.groupBy("session_id").transformWithStateInPandas(_Newest(time, late_ms, idle_ms, events.columns), schema, "Append", "ProcessingTime" if idle_ms else "None")


def split_late(in_time: str, late: str):
    """For ``foreachBatch``: appends rows of ``late_marked`` to two Parquet folders, those in time and the late ones.

    A batch that is run again writes its own folder again, so no row is there twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        for flag, path in ((False, in_time), (True, late)):
            batch.filter(F.col("late") == flag).drop("late").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def ring_drains(rows: DataFrame, capacity: int, idle_ms: int | None = 3_600_000) -> DataFrame:
    """What each drain of a ring of ``capacity`` events reads, and what its session has dropped by then: ``session_id, t_us, n_read, dropped``.

    ``rows``: ``session_id, t_us, event_id, drain``. Equal to the batch operator for any split into batches, as long as rows come in order.
    """

    def step(key, frames: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        held, dropped = state.get if state.exists else (0, 0)
        made, last = [], None
        rows = pd.concat(list(frames)).dropna(subset=["t_us"]).sort_values(["t_us", "drain", "event_id"])
        for t, drain in zip(rows.t_us, rows.drain):
            if drain and t != last:
                made.append((key[0], int(t), held, dropped))
                held, last = 0, t
            elif not drain and held < capacity:
                held += 1
            elif not drain:
                dropped += 1
        state.update((held, dropped))
        _idle(state, idle_ms)
        yield pd.DataFrame(made, columns=["session_id", "t_us", "n_read", "dropped"])

    return rows.groupBy("session_id").applyInPandasWithState(step, "session_id long, t_us long, n_read long, dropped long", "held long, dropped long", "append", _timeout(idle_ms))


def _idle(state, idle_ms: int | None) -> None:
    if idle_ms:
        state.setTimeoutDuration(idle_ms)


def _timeout(idle_ms: int | None) -> str:
    """None: a bounded replay, whose state ends with it (a stream that waits for idle sessions never ends by itself)."""
    return "ProcessingTimeTimeout" if idle_ms else "NoTimeout"


def live_rates(samples: DataFrame, idle_ms: int | None = 3_600_000) -> DataFrame:
    """Bits a second between samples of a running counter (``session_id, t_us, total``), the last sample kept as state."""

    def step(key, frames: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["t_us", "total"])
        made = []
        for t, total in zip(rows.t_us, rows.total):
            rate = max(0, int(total) - last[1]) * 8_000_000 // (int(t) - last[0]) if last and t > last[0] else 0
            made.append((key[0], int(t), rate))
            last = (int(t), int(total))
        state.update(last)
        _idle(state, idle_ms)
        yield pd.DataFrame(made, columns=["session_id", "t_us", "bps"])

    return samples.groupBy("session_id").applyInPandasWithState(step, "session_id long, t_us long, bps long", "t_us long, total long", "append", _timeout(idle_ms))


def quiet_regions(blocks: DataFrame, open_below: int, close_at: int, hop: int, least: int, idle_ms: int | None = 3_600_000) -> DataFrame:
    """Hysteresis regions of ``source_id, block, sumsq`` (two hops of energy) with the open region as state.

    Equal to the batch operator for any split into batches, as long as blocks come in order; a region that is still open
    shows once a later block closes it, or with its last block's end when the source has been idle.
    """
    size = 2 * hop

    def step(key, frames: Iterator[pd.DataFrame], state):
        start, peak, last = state.get if state.exists else (-1, 0, -1)
        made = []
        if state.hasTimedOut:
            if start >= 0 and last * hop + size - start >= least:
                made.append((key[0], start, last * hop + size, peak))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("block")
            for block, sumsq in zip(rows.block, rows.sumsq):
                if start < 0 and sumsq < open_below**2 * size:
                    start, peak = int(block) * hop, int(sumsq)
                elif start >= 0 and sumsq >= close_at**2 * size:
                    if int(block) * hop - start >= least:
                        made.append((key[0], start, int(block) * hop, peak))
                    start, peak = -1, 0
                elif start >= 0:
                    peak = max(peak, int(sumsq))
                last = int(block)
            state.update((start, peak, last))
            _idle(state, idle_ms)
        yield pd.DataFrame(made, columns=["source_id", "start_i", "end_i", "peak_sq"])

    return blocks.groupBy("source_id").applyInPandasWithState(step, "source_id long, start_i long, end_i long, peak_sq long", "start long, peak long, last long", "append", _timeout(idle_ms))


def ring(held: list[list[int]], dropped: int, keep_us: int) -> tuple[list[list[int]], int]:
    """The chunks (``t, dur, bytes, video, keyframe``) that a replay buffer keeps, and how many groups it has dropped for being too long.

    It begins at the first keyframe from which no more than ``keep_us`` is held. Where no keyframe does, the oldest group goes
    as a whole and counts as dropped. Without video it is cut by time alone, and loses at least its oldest chunk.
    """
    if not held or held[-1][0] + held[-1][1] - held[0][0] <= keep_us:
        return held, dropped
    end = held[-1][0] + held[-1][1]
    video = any(c[3] for c in held)
    starts = [i for i, c in enumerate(held) if not video or (c[3] and c[4])]
    cut = next((i for i in starts if end - held[i][0] <= keep_us), None)
    if cut is None and not video:
        cut = 1
    if cut is None:
        cut = next((i for i in starts if i), None)
        if cut is None:
            return held, dropped
        dropped += 1
    return held[cut:], dropped


def replay_buffer(chunks: DataFrame, keep_us: int, idle_ms: int | None = 3_600_000) -> DataFrame:
    """The last ``keep_us`` of each session (``session_id, t_us, dur_us, bytes, video, keyframe``) as one row a batch: ``session_id, from_us, to_us, n, bytes, dropped``.

    State holds what the buffer keeps; one whole group longer than ``keep_us`` is held until the next keyframe comes.
    """

    def step(key, frames: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        flat, dropped = state.get if state.exists else ([], 0)
        held = [list(flat[i : i + 5]) for i in range(0, len(flat), 5)]
        for r in pd.concat(list(frames)).sort_values("t_us").itertuples():
            held, dropped = ring([*held, [int(r.t_us), int(r.dur_us), int(r.bytes), int(r.video), int(r.keyframe)]], dropped, keep_us)
        state.update(([int(v) for c in held for v in c], dropped))
        _idle(state, idle_ms)
        yield pd.DataFrame([(key[0], held[0][0], held[-1][0] + held[-1][1], len(held), sum(c[2] for c in held), dropped)], columns=["session_id", "from_us", "to_us", "n", "bytes", "dropped"])

    return chunks.groupBy("session_id").applyInPandasWithState(step, "session_id long, from_us long, to_us long, n long, bytes long, dropped long", "held array<long>, dropped long", "append", _timeout(idle_ms))

"""Streams with state and timers: numbered runs closed by the watermark, and events met by frames.

Both keep one key's open items alone, close them by timers in event time, and write in append mode.
The state store must be RocksDB (``ROCKSDB``), as for every ``transformWithState``. Columns have plain
names inside, as the worker's rows are named tuples, whose names don't begin with an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Pairs of a batch that a task hands on, about.
PAIRS = 500_000
#: Frames of a block, and events that a row names of it, at most.
BLOCK = 2048
#: Blocks that a task hands on at once.
ROWS = 64
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def merged_runs(starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in time order; those whose start is at most ``gap`` after all earlier ends are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends, counts = starts[order], ends[order], counts[order]
    if not len(starts):
        return starts, ends, counts
    reach = np.maximum.accumulate(ends)
    at = np.flatnonzero(np.concatenate([[True], starts[1:] - reach[:-1] > gap]))
    return starts[at], np.maximum.reduceat(ends, at), np.add.reduceat(counts, at)


class _Runs(StatefulProcessor):
    """Open runs of a clip, in microseconds, and how many are closed."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "starts array<long>, ends array<long>, counts array<long>, closed long")

    def _state(self) -> tuple[list[np.ndarray], int]:
        if not self.open.exists():
            return [np.zeros(0, np.int64)] * 3, 0
        *runs, closed = self.open.get()
        return [np.array(r, np.int64) for r in runs], closed

    def _keep(self, runs, closed: int) -> None:
        self.open.update((*[r.tolist() for r in runs], closed))
        if len(runs[0]):
            # The earliest run is final when no sample within the gap after it can come any more.
            self.handle.registerTimer(int(-(-(int(runs[1][0]) + self.gap) // 1000)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs, closed = self._state()
        for part in rows:
            times = part["us"].to_numpy(np.int64)
            joined = [np.concatenate(pair) for pair in zip(runs, (times, times, np.ones(len(times), np.int64)), strict=True)]
            runs = merged_runs(*joined, self.gap)
        self._keep(runs, closed)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs, closed = self._state()
        final = int(np.searchsorted(runs[1] + self.gap, timerValues.getCurrentWatermarkInMs() * 1000, side="right"))
        self._keep([r[final:] for r in runs], closed + final)
        if final:
            starts, ends, counts = (r[:final] for r in runs)
            yield pd.DataFrame({"clip": key[0], "event_no": np.arange(closed + 1, closed + final + 1), "start_us": starts, "end_us": ends, "n_samples": counts})

    def close(self) -> None:
        pass


def candidate_runs(samples: DataFrame, flag: Column, gap: float = 1.0, late: str = "10 seconds", clip: str = "clip_id", time: str = "ts") -> DataFrame:
    """clip (text), event_no, start_time, end_time, n_samples of runs of flagged samples of a stream, in append mode.

    As the batch operator: a run ends where no flagged sample follows within ``gap`` seconds (an equal
    gap joins), and runs of a clip are numbered in time order from 1. A run is written once, when the
    watermark, ``late`` behind the newest sample of any clip, has passed its end and the gap; samples
    behind the watermark are dropped. State: a clip's runs that are not closed yet, and one number.
    Samples without clip or time are left out. Numbers go on as long as the checkpoint lives.
    """
    # The filter asks for the time, else it would move below the watermark, which quiet samples must advance too.
    us = F.when(flag, F.unix_micros(time)).alias("us")
    lean = samples.where(F.col(clip).isNotNull()).withWatermark(time, late).select(F.col(clip).cast("string").alias("clip"), F.col(time).alias("at"), us).where("us is not null")
    fields = "clip string, event_no long, start_us long, end_us long, n_samples long"
    runs = lean.groupBy("clip").transformWithStateInPandas(_Runs(round(gap * 1_000_000)), fields, "append", "eventTime")
    return runs.select(F.col("clip").alias(clip), "event_no", F.timestamp_micros("start_us").alias("start_time"), F.timestamp_micros("end_us").alias("end_time"), "n_samples")


#: State of a clip and time cell: events and frames, each as one Arrow stream, so that it is not handed over a value at a time.
HELD = "events binary, frames binary"
#: Columns of rows held: an event has all, a frame the first two.
COLUMNS = ("id", "us", "until")


def _bytes_of(rows: list[np.ndarray]) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.string() if c == "id" else pa.int64()) for c, x in zip(COLUMNS, rows)], names=COLUMNS[: len(rows)])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _rows_of(data: bytes) -> list[np.ndarray]:
    return [column.to_numpy() for column in pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all().itercolumns()]


class _Met(StatefulProcessor):
    """Events of a clip and time cell that frames can still meet, and frames that events can still begin before.

    Both are lists of arrays: ids and times in microseconds. ``wide``: the cell's length in
    microseconds, if the second part of a key is the cell.
    """

    def __init__(self, wide: int | None = None) -> None:
        self.wide = wide

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def _state(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        if self.held.exists():
            e, f = self.held.get()
            return _rows_of(e), _rows_of(f)
        none = [np.zeros(0, object), np.zeros(0, np.int64)]
        return [*none, none[1]], none

    def _keep(self, e: list[np.ndarray], f: list[np.ndarray], mark: int) -> None:
        """What lies behind the watermark (microseconds) can't be met any more: frames by time, events by their own end."""
        e, f = ([x[rows[-1] > mark] for x in rows] for rows in (e, f))
        ends = [int(rows[-1].min()) for rows in (e, f) if len(rows[0])]
        if not ends:
            self.held.clear()
            return
        self.held.update((_bytes_of(e), _bytes_of(f)))
        self.handle.registerTimer(int(-(-min(ends) // 1000)) + 1)

    def _places(self, e: list[np.ndarray], f: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Frames in time order (ids, times), and events by the first frame that they meet: ids, first place, place after the last."""
        order = np.argsort(f[1], kind="stable")
        frames, at = f[0][order], f[1][order]
        lo, hi = np.searchsorted(at, e[1], "left"), np.searchsorted(at, e[2], "right")
        met = np.flatnonzero(hi > lo)
        met = met[np.argsort(lo[met], kind="stable")]
        return frames, at, e[0][met], lo[met], hi[met]

    def _pairs(self, key, e: list[np.ndarray], f: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        frames, at, events, lo, hi = self._places(e, f)
        for some in _split(hi - lo):
            row, col = _spread(some, lo[some], (hi - lo)[some])
            yield pd.DataFrame({"clip": key[0], "event": events[row], "frame": frames[col], "frame_us": at[col]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        e, f = self._state()
        # All parts first: what is held meets the new rows once, not with every part.
        parts = list(rows)
        is_event, ids, us, until = (np.concatenate([part[c].to_numpy(kind) for part in parts]) for c, kind in (("is_event", bool), ("id", object), ("us", np.int64), ("until", np.int64)))
        new_e, new_f = [x[is_event] for x in (ids, us, until)], [x[~is_event] for x in (ids, us)]
        every = [np.concatenate(pair) for pair in zip(f, new_f)]
        yield from self._pairs(key, e, new_f)
        yield from self._pairs(key, new_e, every)
        self._keep([np.concatenate(pair) for pair in zip(e, new_e)], every, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        if self.wide and (key[1] + 1) * self.wide <= mark:
            self.held.clear()  # the whole cell is behind the watermark: nothing to look through
        else:
            self._keep(*self._state(), mark)
        return iter(())

    def close(self) -> None:
        pass


def _split(n: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of consecutive items that have about ``PAIRS`` of ``n`` together."""
    if len(n):
        yield from np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1)


def _spread(items: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each item ``n`` times, with numbers from ``first`` on."""
    return np.repeat(items, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)


class _MetBlocks(_Met):
    """What ``_Met`` finds, with the frames of a block once and each event's place among them."""

    def _pairs(self, key, e: list[np.ndarray], f: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        frames, at, events, lo, hi = self._places(e, f)
        n = (hi - 1) // BLOCK - lo // BLOCK + 1  # blocks that an event's frames lie in
        for some in _split(n):
            row, block = _spread(some, lo[some] // BLOCK, n[some])
            order = np.argsort(block, kind="stable")
            row, block = row[order], block[order]
            low = np.maximum(lo[row] - block * BLOCK, 0)
            count = np.minimum(hi[row] - block * BLOCK, BLOCK) - low
            # A row has one block and at most BLOCK events.
            first = np.flatnonzero(np.diff(block, prepend=-1))
            nth = np.arange(len(block)) - np.repeat(first, np.diff(first, append=len(block)))
            cuts = np.append(np.flatnonzero(nth % BLOCK == 0), len(block))
            for a in range(0, len(cuts) - 1, ROWS):
                cut = cuts[a : a + ROWS + 1]
                named, whole = [slice(*x) for x in zip(cut[:-1], cut[1:])], [slice(k * BLOCK, (k + 1) * BLOCK) for k in block[cut[:-1]]]
                columns = [[events[row[x]] for x in named], [low[x] for x in named], [count[x] for x in named], [frames[x] for x in whole], [at[x] for x in whole]]
                yield pd.DataFrame({"clip": key[0]} | {name: pd.Series(values, dtype=object) for name, values in zip(("events", "lows", "counts", "frames", "times"), columns)})


class _Group:
    """A group's state with its one timer, in the form in which a ``StatefulProcessor`` asks for both."""

    def __init__(self, state: GroupState) -> None:
        self.state = state

    def getValueState(self, name: str, schema: str) -> _Group:
        return self

    def exists(self) -> bool:
        return self.state.exists

    def get(self) -> tuple:
        return self.state.get

    def update(self, value: tuple) -> None:
        self.state.update(value)

    def clear(self) -> None:
        self.state.remove()

    def registerTimer(self, ms: int) -> None:
        self.state.setTimeoutTimestamp(ms)

    def getCurrentWatermarkInMs(self) -> int:
        return self.state.getCurrentWatermarkMs()


def _cells(events: DataFrame, frames: DataFrame, event: str, frame: str, late: str, clip: str, wide: int):
    """Events and frames as one stream grouped by clip and time cell: an event in all cells that it touches, a frame in its one."""
    e = events.withWatermark("start_time", late).where(F.col(clip).isNotNull() & (F.col("end_time") >= F.col("start_time")))
    e = e.select(F.col(clip).cast("string").alias("clip"), F.col("start_time").alias("at"), F.lit(True).alias("is_event"), F.col(event).cast("string").alias("id"), F.unix_micros("start_time").alias("us"), F.unix_micros("end_time").alias("until"))
    touched = F.sequence(F.floor(F.col("us") / wide), F.floor(F.col("until") / wide))
    e = e.withColumn("cell", F.explode(touched)).withColumn("until", F.least("until", (F.col("cell") + 1) * wide - 1))
    f = frames.withWatermark("frame_time", late).where(F.col(clip).isNotNull() & F.col("frame_time").isNotNull())
    f = f.select(F.col(clip).cast("string").alias("clip"), F.col("frame_time").alias("at"), F.lit(False).alias("is_event"), F.col(frame).cast("string").alias("id"), F.unix_micros("frame_time").alias("us"), F.lit(0).cast("long").alias("until"), F.floor(F.unix_micros("frame_time") / wide).alias("cell"))
    return e.unionByName(f).groupBy("clip", "cell")


def event_frames(events: DataFrame, frames: DataFrame, event: str = "event_id", frame: str = "frame_id", late: str = "1 minute", clip: str = "clip_id", cell: float = 86_400.0) -> DataFrame:
    """clip, event, frame (as text), frame_time of each frame of a stream within an event of another, in append mode.

    Events (start_time, end_time) may be of any length and arrive within ``late`` of their start, frames
    (frame_time) of their time; what is later is dropped. The watermark is that of the slower stream.
    A frame is held until no event can begin before it any more, an event until the watermark has
    passed its own end, so no longest length is asked for. Rows without clip or times are left out, as
    are events that end before they start. A clip's time is cut into cells of ``cell`` seconds, each of
    which is a key: an event stands in all that it touches, a frame in its one.
    """
    wide = round(cell * 1_000_000)
    met = _cells(events, frames, event, frame, late, clip, wide).transformWithStateInPandas(_Met(wide), "clip string, event string, frame string, frame_us long", "append", "eventTime")
    return met.select(F.col("clip").alias(clip), "event", "frame", F.timestamp_micros("frame_us").alias("frame_time"))


def event_blocks(events: DataFrame, frames: DataFrame, event: str = "event_id", frame: str = "frame_id", late: str = "1 minute", clip: str = "clip_id", cell: float = 86_400.0) -> DataFrame:
    """As ``event_frames``, in a form that grows with the events and frames, not with their pairs; ``block_pairs`` gives these.

    A row has frames of a clip in time order (frames, as text, and times in microseconds, ``BLOCK`` at
    most) and events that meet them: for each its id (events, as text), the place of its first frame
    among them (lows, from 0) and how many it meets (counts).
    """
    wide = round(cell * 1_000_000)

    def blocks(key, parts, state):
        group, met = _Group(state), _MetBlocks(wide)
        met.init(group)
        return met.handleExpiredTimer(key, group, None) if state.hasTimedOut else met.handleInputRows(key, parts, group)

    fields = "clip string, events array<string>, lows array<int>, counts array<int>, frames array<string>, times array<long>"
    met = _cells(events, frames, event, frame, late, clip, wide).applyInPandasWithState(blocks, fields, HELD, "append", GroupStateTimeout.EventTimeTimeout)
    return met.withColumnRenamed("clip", clip)


def block_pairs(blocks: DataFrame) -> DataFrame:
    """event and frame of each pair of ``event_blocks``, of a stream or a table of it; no pair is stored for it."""
    each = blocks.select("lows", "counts", "frames", F.posexplode("events").alias("i", "event"))
    low = F.get("lows", F.col("i"))
    places = each.select("event", "frames", F.explode(F.sequence(low, low + F.get("counts", F.col("i")) - 1)).alias("k"))
    return places.select("event", F.get("frames", F.col("k")).alias("frame"))

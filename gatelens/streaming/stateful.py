"""Keyed state of the streams: a reorder buffer released by the watermark, and periods closed by event-time timers.

Lanes are dealt to buckets, and a bucket is one key: reading and writing state costs tens of milliseconds a key, whatever it holds. A processor holds one bucket at
a time: the rows of the batch at hand and those that the watermark has not passed yet, and what is kept of each lane, so its memory is
bounded by the batch size, the allowed delay and the lanes, never by a lane's history. State is kept in RocksDB and checkpointed with the stream;
a lost executor's batch runs again from there. Rows with a null lane or time are left out; rows behind the watermark are dropped
by the engine, whose watermark begins at 1970."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: (what is kept, row) -> (what is kept then, the row's answer or None for none). Rows begin with their time in microseconds and their id.
Fold = Callable[[list[tuple], tuple], tuple[list[tuple], tuple | None]]
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Reordered(StatefulProcessor):
    """Folds each lane's rows by (time, id) though they come in another order. A row is answered in the batch in which it comes; rows that
    are waiting behind an older one that comes later are answered anew, so an id's last answer counts. What the watermark has
    passed is folded into the kept state for good, by the next batch of the lane or by a timer."""

    def __init__(self, fold: Fold, row_schema: str, kept_schema: str, answer: list[str]):
        self.fold, self.row_schema, self.kept_schema, self.answer = fold, row_schema, kept_schema, answer
        self.fields = [part.split()[0] for part in row_schema.split(",")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"lane long, {self.row_schema}")
        self.kept = handle.getListState("kept", f"lane long, {self.kept_schema}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [tuple(map(plain, row)) for part in rows for row in part[["lane", *self.fields]].itertuples(index=False, name=None)]
        yield self.settle(by_lane(fresh), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.settle({}, timerValues)

    def settle(self, fresh: dict[int, list[tuple]], timers) -> pd.DataFrame:
        """The answers of each lane's rows from its first fresh one on."""
        passed = timers.getCurrentWatermarkInMs() * 1000
        before, kept = by_lane(self.waiting.get()), by_lane(self.kept.get())
        waiting, out = [], []
        for lane in sorted({*before, *fresh}):
            since = min((row[:2] for row in fresh.get(lane, [])), default=None)
            rows = sorted([*before.get(lane, []), *fresh.get(lane, [])], key=lambda row: row[:2])
            held, settled = kept.get(lane, []), 0
            final = held
            for i, row in enumerate(rows):
                held, answer = self.fold(held, row)
                if row[0] <= passed:
                    final, settled = held, i + 1
                if since is not None and row[:2] >= since and answer is not None:
                    out.append((row[1], lane, *answer))
            kept[lane] = final
            waiting += [(lane, *row) for row in rows[settled:]]
        replace(self.kept, [(lane, *held) for lane, all_held in kept.items() for held in all_held])
        replace(self.waiting, waiting)
        clear_timers(self.handle)
        if waiting:
            self.handle.registerTimer(-(-min(row[1] for row in waiting) // 1000))
        return pd.DataFrame(out, columns=self.answer)


class Periods(StatefulProcessor):
    """Periods of a lane in which frames follow each other within ``gap`` microseconds. A period is a row once the watermark is ``gap`` past its
    last frame: a timer closes it, whether or not the lane sends anything again. Open ones stay in the state ``open``."""

    FIELDS = "lane long, up_from long, up_to long, frames long, down_from long"

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", self.FIELDS)
        self.closed = handle.getListState("closed", "lane long, up_to long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans = list(self.open.get())
        for part in rows:
            lane, at = part["lane"].to_numpy(dtype=np.int64), part["at"].to_numpy(dtype=np.int64)
            order = np.lexsort((at, lane))
            lane, at = lane[order], at[order]
            cuts = np.flatnonzero((np.diff(lane) != 0) | (np.diff(at) >= self.gap)) + 1
            first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(at)]])
            spans = self.merged(spans + [(int(lane[a]), int(at[a]), int(at[b - 1]), int(b - a), None) for a, b in zip(first, last)])
        yield self.shut(spans, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.shut(list(self.open.get()), timerValues)

    def merged(self, spans: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for lane, low, high, n, _ in sorted(spans, key=lambda s: s[:3]):
            if out and out[-1][0] == lane and low - out[-1][2] < self.gap:
                out[-1] = (lane, out[-1][1], max(out[-1][2], high), out[-1][3] + n, None)
            else:
                out.append((lane, low, high, n, None))
        return out

    def shut(self, spans: list[tuple], timers) -> pd.DataFrame:
        passed = timers.getCurrentWatermarkInMs() * 1000
        closed = dict(self.closed.get())
        ends, done, still = dict(closed), [], []
        for lane, low, high, n, _ in sorted(spans, key=lambda s: s[:3]):  # each with the end of its lane's period before it: the outage lies between
            (done if high + self.gap <= passed else still).append((lane, low, high, n, ends.get(lane)))
            ends[lane] = high
        if done:
            closed |= {span[0]: span[2] for span in done}
            replace(self.closed, list(closed.items()))
        replace(self.open, still)
        clear_timers(self.handle)
        if still:
            self.handle.registerTimer(-(-(min(span[2] for span in still) + self.gap) // 1000))
        out = pd.DataFrame(done, columns=["lane", "up_from", "up_to", "frames", "down_from"])
        return out.astype({"down_from": "Int64"})


def by_lane(rows: Iterable[tuple]) -> dict[int, list[tuple]]:
    """The rows of each lane without the lane, which stands first."""
    lanes: dict[int, list[tuple]] = {}
    for lane, *row in rows:
        lanes.setdefault(lane, []).append(tuple(row))
    return lanes


def plain(value):
    """The value as the state takes it."""
    return value.tolist() if isinstance(value, (np.ndarray, np.generic)) else value


def replace(state, rows: list[tuple]) -> None:
    """The list state with these rows in place of its own."""
    if rows:
        state.put(rows)
    else:
        state.clear()


def clear_timers(handle: StatefulProcessorHandle) -> None:
    for at in list(handle.listTimers()):
        handle.deleteTimer(at)

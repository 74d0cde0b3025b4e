"""The live change feed of workspaces: changes wait until a file is quiet and not the active one, in a room of limited size.

A log has workspace, ts, kind, path, op and mtime. Kind `change` is a change of a file, `focus` says that path is now the active one (null: none).
A change makes its file pending, or replaces the change that is pending; a new file finds no room while MAX_PENDING are
pending, and its change is dropped. A pending change is released when its file has been quiet for DEBOUNCE seconds and is
not active. A deletion is released at once and cancels what was pending.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quillspark.streaming.changes import DEBOUNCE, MAX_PENDING

OUT = "workspace string, path string, op string, mtime double, changed long, released long, n int, fate string"
ARROW_OUT = pa.schema([("workspace", pa.string()), ("path", pa.string()), ("op", pa.string()), ("mtime", pa.float64()), ("changed", pa.int64()), ("released", pa.int64()), ("n", pa.int32()), ("fate", pa.string())])
EVENT = ["us", "kind", "path", "op", "mtime"]


class Feed:
    """The pending files of a workspace, by event time in microseconds."""

    def __init__(self, workspace: str, saved: str | None = None, quiet: int = DEBOUNCE * 1_000_000, most: int = MAX_PENDING):
        s = json.loads(saved) if saved else {}
        self.workspace, self.quiet, self.most = workspace, quiet, most
        self.active = s.get("active")
        #: path -> [time of the last change, op, mtime, number of changes].
        self.pending: dict[str, list] = s.get("pending", {})
        #: Events that are not yet known to be in order.
        self.waiting: list[list] = s.get("waiting", [])

    def saved(self) -> str:
        return json.dumps({"active": self.active, "pending": self.pending, "waiting": self.waiting})

    def _row(self, path: str, at: int, op: str | None, mtime: float | None, released: int, n: int, fate: str) -> dict:
        return {"workspace": self.workspace, "path": path, "op": op, "mtime": mtime, "changed": at, "released": released, "n": n, "fate": fate}

    def due(self, now: int) -> list[dict]:
        """What becomes free by its quiet time up to now, in the order of that time."""
        ready = sorted((at + self.quiet, path) for path, (at, *_) in self.pending.items() if path != self.active and at + self.quiet <= now)
        return [self._release(path, when) for when, path in ready]

    def _release(self, path: str, when: int) -> dict:
        at, op, mtime, n = self.pending.pop(path)
        return self._row(path, at, op, mtime, when, n, "released")

    def take(self, event: list) -> list[dict]:
        """One event, in order; what it sets free or leaves without room."""
        at, kind, path, op, mtime = event
        out = self.due(at)
        if kind == "focus":
            was, self.active = self.active, path
            if was in self.pending and was != path and self.pending[was][0] + self.quiet <= at:
                out.append(self._release(was, at))
        elif op == "delete":
            n = self.pending.pop(path, [0, None, None, 0])[3]
            out.append(self._row(path, at, op, mtime, at, n + 1, "released"))
        elif path in self.pending or len(self.pending) < self.most:
            self.pending[path] = [at, op, mtime, self.pending.get(path, [0, None, None, 0])[3] + 1]
        else:
            out.append(self._row(path, at, op, mtime, at, 1, "dropped"))
        return out

    def advance(self, now: int) -> list[dict]:
        """Take the waiting events up to now in order, then what is due."""
        self.waiting.sort(key=_order)
        ready = [e for e in self.waiting if e[0] <= now]
        self.waiting = self.waiting[len(ready) :]
        return [row for e in ready for row in self.take(e)] + self.due(now)

    def next_time(self) -> int | None:
        """When something may happen without a new event."""
        times = [e[0] for e in self.waiting] + [at + self.quiet for path, (at, *_) in self.pending.items() if path != self.active]
        return min(times, default=None)


def _order(event: list) -> tuple:
    return event[0], event[1] != "focus", event[2] or "", event[3] or "", event[4] or 0.0


def _events(log: DataFrame) -> DataFrame:
    rows = log.where(F.col("workspace").isNotNull() & F.col("ts").isNotNull() & (F.col("kind").eqNullSafe(F.lit("focus")) | F.col("kind").eqNullSafe(F.lit("change")) & F.col("path").isNotNull()))
    return rows.select("workspace", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "kind", "path", "op", F.col("mtime").cast("double").alias("mtime"))


def released_changes(log: DataFrame) -> DataFrame:
    """workspace, path, op, mtime, changed, released (microseconds), n (changes in one), fate (released or dropped) of a whole log; at
    its end all that is not active comes free when it is quiet.

    Events go by time, focus before changes, then by path, op and mtime; equal ones are taken each. Rows without workspace or
    time, or of a change without a path, are left out. A workspace's events come to one task in order, with its pending files in memory only.
    """
    rows = _events(log).select("workspace", *EVENT)
    order = ["us", (F.col("kind") != "focus"), F.coalesce("path", F.lit("")), F.coalesce("op", F.lit("")), F.coalesce("mtime", F.lit(0.0))]
    rows = rows.repartition("workspace").sortWithinPartitions("workspace", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feed = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if feed is None or r["workspace"] != feed.workspace:
                    out += feed.due(1 << 62) if feed else []
                    feed = Feed(r["workspace"])
                out += feed.take([r[c] for c in EVENT])
            yield pa.RecordBatch.from_pylist(out, ARROW_OUT)
        if feed:
            yield pa.RecordBatch.from_pylist(feed.due(1 << 62), ARROW_OUT)

    return rows.mapInArrow(run, OUT)


def released_stream(log: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """The same of a stream whose events may be late by delay: they wait until the watermark has passed them and are then
    taken in order, so micro-batches may cut and shuffle them. Timers by event time free what has become quiet; the state
    survives restarts by the query's checkpoint. Write it in append mode."""
    rows = _events(log).withWatermark("ts", delay)

    def step(key, frames, state):
        feed = Feed(key[0], state.get[0] if state.exists else None)
        now = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for frame in frames:
                frame = frame.astype(object).where(frame.notna(), None)
                feed.waiting += [[int(us), *rest] for us, *rest in zip(*(frame[c] for c in EVENT))]
        out = feed.advance(now)
        state.update((feed.saved(),))
        if (soon := feed.next_time()) is not None:
            state.setTimeoutTimestamp(max(soon // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=ARROW_OUT.names).astype({"mtime": "float64", "changed": "int64", "released": "int64", "n": "int32"})

    return rows.groupBy("workspace").applyInPandasWithState(step, OUT, "saved string", "append", GroupStateTimeout.EventTimeTimeout)

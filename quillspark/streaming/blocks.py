"""Hosts that crash too often: blocked from the crash that fills the sliding window on, released when enough have left it.

A crash counts for so many seconds, its last moment left out. A block begins with the crash that makes `most` of them count
together and lasts until fewer do; crashes during a block prolong it without a change of their own.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.window import Window

from quillspark.streaming.changes import CRASHES

#: Fixed value: seconds that a crash counts.
CRASH_SECONDS = 600


def _crashes(events: DataFrame, key: str, ts: str) -> DataFrame:
    rows = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    return rows.where(F.col("key").isNotNull() & F.col("ts").isNotNull())


def block_changes(events: DataFrame, key: str, ts: str, seconds: int = CRASH_SECONDS, most: int = CRASHES) -> DataFrame:
    """key, change (blocked or released), at: the changes of a whole log; rows without key or time are left out, repeated ones are crashes
    of their own. Windows over a key's crashes in order, without state in Python."""
    rows = _crashes(events, key, ts).withColumn("us", F.unix_micros("ts"))
    by = Window.partitionBy("key").orderBy("us")
    filled = rows.withColumn("until", F.lag("us", most - 1).over(by) + seconds * 1_000_000 if most > 1 else F.col("us") + seconds * 1_000_000)
    filled = filled.where(F.col("us") < F.col("until"))
    after = Window.partitionBy("key").orderBy("us", "until")
    begun = filled.withColumn("begun", F.coalesce(F.col("us") > F.lag("until").over(after), F.lit(True)).cast("int"))
    block = F.sum("begun").over(after.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = begun.withColumn("block", block).groupBy("key", "block").agg(F.min("us").alias("began"), F.max("until").alias("until"))
    change = lambda name, at: F.struct(F.lit(name).alias("change"), F.timestamp_micros(at).alias("at"))
    return blocks.select("key", F.inline(F.array(change("blocked", "began"), change("released", "until"))))


class Host:
    """The crashes of a key that still matter, those that wait for the watermark, and the end of its block."""

    def __init__(self, seconds: int, most: int, saved: str | None = None):
        self.window, self.most = seconds * 1_000_000, most
        self.waiting, self.recent, self.until = json.loads(saved) if saved else ([], [], None)

    def saved(self) -> str:
        return json.dumps([self.waiting, self.recent, self.until])

    def release(self, now: int) -> list[tuple[str, int]]:
        """The end of a block before now: a crash at that very moment prolongs it."""
        if self.until is None or self.until >= now:
            return []
        at, self.until = self.until, None
        return [("released", at)]

    def crash(self, us: int) -> list[tuple[str, int]]:
        out = self.release(us)
        self.recent = [*self.recent, us][-self.most :]
        if len(self.recent) == self.most and us < self.recent[0] + self.window:
            out += [("blocked", us)] if self.until is None else []
            self.until = self.recent[0] + self.window
        return out

    def advance(self, now: int) -> list[tuple[str, int]]:
        """Take the waiting crashes up to now, then release what is over."""
        ready = sorted(t for t in self.waiting if t <= now)
        self.waiting = [t for t in self.waiting if t > now]
        return [c for t in ready for c in self.crash(t)] + self.release(now)

    def next_time(self) -> int | None:
        return min([*self.waiting, *([] if self.until is None else [self.until])], default=None)


def block_stream(events: DataFrame, key: str, ts: str, seconds: int = CRASH_SECONDS, most: int = CRASHES, delay: str = "10 seconds") -> DataFrame:
    """The same of a stream whose crashes may be late by delay: they are counted in order once the watermark has passed them, so
    micro-batches may cut and shuffle them. A timer by event time tells the end of a block without a new crash; a key's state is its
    last crashes and those that wait. Write it in append mode."""
    rows = _crashes(events, key, ts).withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))

    def step(name, frames, state):
        host = Host(seconds, most, state.get[0] if state.exists else None)
        if not state.hasTimedOut:
            for frame in frames:
                host.waiting += frame["us"].tolist()
        passed = state.getCurrentWatermarkMs()
        out = host.advance(passed * 1000)
        state.update((host.saved(),))
        if (soon := host.next_time()) is not None:
            state.setTimeoutTimestamp(max(soon // 1000 + 1, passed + 1))
        yield pd.DataFrame({"key": [name[0]] * len(out), "change": [c for c, _ in out], "at_us": pd.array([t for _, t in out], "int64")})

    kind = dict(rows.dtypes)["key"]
    found = rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, change string, at_us long", "saved string", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("key", "change", F.timestamp_micros("at_us").alias("at"))

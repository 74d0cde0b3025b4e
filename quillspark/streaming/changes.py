"""Change feeds: debounce, late and stale changes, sliding counts, bounded event rings.

The batch forms are plain DataFrame operators over an event table and the oracle of the streaming forms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from quillspark.functions import text as T

#: Fixed values of the feed: quiet seconds, suppressed seconds at the start and their growth by files, pending keys.
DEBOUNCE, SUPPRESS, SUPPRESS_FILES, MAX_SUPPRESS, MAX_PENDING = 3, 10, 500, 120, 50
#: Seconds between saves; crashes that block a host; exits that matter, and among how many.
SAVE_SECONDS, CRASHES, UNCLEAN_EXITS, UNCLEAN_WINDOW = 5, 3, 2, 3


def debounced(events: DataFrame, key: str, ts: str, seconds: int = DEBOUNCE, order: str = "event_id") -> DataFrame:
    """The last event of each burst with n, its events: a burst ends when a key is quiet for so many seconds."""
    by = Window.partitionBy(key).orderBy(ts, order)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(by).cast("timestamp"))
    marked = events.withColumn("_new", F.when(gap.isNull() | (gap >= seconds * 1_000_000), 1).otherwise(0))
    marked = marked.withColumn("_burst", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = marked.groupBy(key, "_burst").agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct(ts, order)).alias("e"), F.count("*").alias("n"))
    return last.select(key, "e.*", "n")


def debounced_stream(events: DataFrame, key: str, ts: str, seconds: int = DEBOUNCE, delay: str = "10 seconds") -> DataFrame:
    """Streaming debounce by session windows: the newest event of a key's burst, emitted once the watermark has passed."""
    rest = F.struct(*events.columns)
    session = F.session_window(ts, f"{seconds} seconds").alias("burst")
    return events.withWatermark(ts, delay).groupBy(session, key).agg(F.max_by(rest, F.col(ts)).alias("event"), F.count("*").alias("n")).select("event.*", "n")


def after_suppression(events: DataFrame, ts: str, start: Column, files: int) -> DataFrame:
    """Events behind the quiet time at the start, which grows with the number of files."""
    return events.where(F.col(ts) > F.timestamp_seconds(F.unix_seconds(start) + min(MAX_SUPPRESS, SUPPRESS + files // SUPPRESS_FILES)))


def newest_changes(changes: DataFrame, key: str, order: Column) -> DataFrame:
    """One change a key, the newest; for use in each micro-batch before it is applied."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in changes.columns if c != key]), order).alias("c")).select(key, "c.*")


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """state (doc_id, path, mtime, chunk_count) after changes (doc_id, op, path, mtime): delete removes, an older or equal
    mtime changes nothing, others set path and mtime and await their chunks (chunk_count 0)."""
    c = newest_changes(changes, "doc_id", F.struct("mtime", "op")).select(F.col("doc_id").alias("_doc"), F.col("op"), F.col("path").alias("_path"), F.col("mtime").alias("_mtime"))
    both = state.join(c, state["doc_id"] == c["_doc"], "full")
    new = F.col("op").isNotNull() & (F.col("doc_id").isNull() | (F.col("_mtime") > F.col("mtime")))
    kept = both.where(~(F.coalesce(F.col("op") == "delete", F.lit(False))))
    pick = lambda a, b: F.when(new, b).otherwise(a)
    return kept.select(F.coalesce("doc_id", "_doc").alias("doc_id"), pick(F.col("path"), F.col("_path")).alias("path"), pick(F.col("mtime"), F.col("_mtime")).alias("mtime"), pick(F.col("chunk_count"), F.lit(0)).alias("chunk_count"))


def recent_counts(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """events with recent: how many of the key lie in the seconds up to each."""
    span = Window.partitionBy(key).orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("recent", F.count("*").over(span)).drop("_us")


def trimmed(events: DataFrame, key: str, ts: str, protected: Column, most: int, order: str = "event_id", low: Column | None = None, size: Column | None = None, budget: int | None = None) -> DataFrame:
    """At most so many events a key, and so many bytes in all: protected ones are kept first, then those that are not low, then
    the low ones (debug, info), each newest first. A last protected event stays whatever its size."""
    rank = F.when(protected, 0).when(F.coalesce(low, F.lit(False)) if low is not None else F.lit(False), 2).otherwise(1)
    by = Window.partitionBy(key).orderBy("_rank", F.desc(ts), F.desc(order))
    rows = events.withColumn("_rank", rank).withColumn("_n", F.row_number().over(by))
    kept = F.col("_n") <= most
    if size is not None and budget is not None:
        rows = rows.withColumn("_bytes", F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        kept = kept & ((F.col("_bytes") <= budget) | ((F.col("_n") == 1) & (F.col("_rank") == 0)))
    return rows.where(kept).drop("_rank", "_n", "_bytes")


def last_of_classes(events: DataFrame, key: str, ts: str, classes: list[Column], order: str = "event_id") -> DataFrame:
    """events with protected: the last of a key in any of the classes."""
    by = Window.partitionBy(key)
    at = F.struct(ts, order)
    last = F.lit(False)
    for c in classes:
        last = last | F.coalesce(at == F.max(F.when(c, at)).over(by), F.lit(False))
    return events.withColumn("protected", last)


def markdown_changes(changes: DataFrame) -> DataFrame:
    """The feed of notes: changes (op, path, old_path) of Markdown files. Creations, changes and deletions of other files are
    left out; a rename counts if either name is a note's, as the end of one or the beginning of the other."""
    note, was = T.is_markdown(F.col("path")), F.coalesce(T.is_markdown(F.col("old_path")), F.lit(False))
    return changes.where(F.col("op").isin("create", "modify", "delete") & note | (F.col("op") == "rename") & (note | was))


def read_changes(spark, folder: str, schema: str = "op string, path string, old_path string, mtime double, ts timestamp") -> DataFrame:
    """A folder of JSON lines as a stream of changes."""
    return markdown_changes(spark.readStream.schema(schema).json(folder))


def released(changes: DataFrame, focus: DataFrame, keys: list[str]) -> DataFrame:
    """changes (path, ts) with released: while a file is the active one of its workspace (keys), its changes wait until the
    focus (path, ts) moves on; null while it has not."""
    by = Window.partitionBy(*keys).orderBy("ts", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.lead("ts").over(Window.partitionBy(*keys).orderBy("ts"))
    spans = focus.withColumn("_until", until).select(*keys, "ts", F.lit(0).alias("_kind"), F.struct(F.col("path").alias("active"), F.col("_until").alias("until")).alias("_focus"), F.lit(None).cast(changes.select(F.struct("*").alias("r")).schema["r"].dataType).alias("_row"))
    rows = changes.select(*keys, "ts", F.lit(1).alias("_kind"), F.lit(None).cast(spans.schema["_focus"].dataType).alias("_focus"), F.struct(*changes.columns).alias("_row"))
    every = spans.unionByName(rows).withColumn("_at", F.last("_focus", ignorenulls=True).over(by)).where("_kind = 1")
    held = F.coalesce(F.col("_at.active") == F.col("_row.path"), F.lit(False))
    return every.select("_row.*", F.when(held, F.col("_at.until")).otherwise(F.col("ts")).alias("released"))


def admitted(changes: DataFrame, pending: DataFrame, keys: list[str], key: str = "path", order: str = "ts", most: int = MAX_PENDING) -> DataFrame:
    """The changes of a micro-batch that find room: a workspace (keys) has at most so many pending files, those of pending
    included; files come in the order of their first change, and once the room is gone all other changes are dropped."""
    known = pending.select(*keys, key).distinct().withColumn("_old", F.lit(True))
    first = changes.groupBy(*keys, key).agg(F.min(order).alias("_first")).join(known, [*keys, key], "left").where("_old IS NULL").drop("_old")
    held = known.groupBy(*keys).agg(F.count("*").alias("_held"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_first", key))
    fresh = first.withColumn("_nth", nth).join(held, keys, "left").where(F.col("_nth") + F.coalesce("_held", F.lit(0)) <= most).select(*keys, key)
    full = held.where(F.col("_held") >= most).select(*keys)
    room = fresh.unionByName(known.drop("_old").join(full, keys, "left_anti"))
    return changes.join(room, [*keys, key], "left_semi")


def renamed(state: DataFrame, renames: DataFrame, excluded: list[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, documents whose vectors go, files to index) after renames (old_path, path). A known note keeps its state under
    the new name with the path it was indexed under, so it shows as outdated; unknown ones are to be indexed. Names that are
    no notes or are excluded only end the old one."""
    r = renames.select("old_path", F.col("path").alias("_new"), (T.is_markdown(F.col("path")) & ~F.coalesce(T.is_excluded(F.col("path"), list(excluded)), F.lit(False))).alias("_note"))
    both = state.join(r, state["doc_id"] == r["old_path"], "left")
    moved = F.col("_new").isNotNull()
    after = both.where(~moved | F.col("_note")).withColumn("path", F.when(moved, F.coalesce("path", "old_path")).otherwise(F.col("path"))).withColumn("doc_id", F.when(moved, F.col("_new")).otherwise(F.col("doc_id")))
    gone = r.where(T.is_markdown(F.col("old_path"))).select(F.col("old_path").alias("doc_id"))
    fresh = r.where("_note").join(state.select(F.col("doc_id").alias("old_path")), "old_path", "left_anti").select(F.col("_new").alias("path"))
    return after.select(state.columns), gone, fresh


def deleted(state: DataFrame, pending: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, pending changes, documents whose vectors go) after deletions (op, path)."""
    gone = changes.where("op = 'delete'").select(F.col("path").alias("doc_id")).distinct()
    return state.join(gone, "doc_id", "left_anti"), pending.join(gone.withColumnRenamed("doc_id", "path"), "path", "left_anti"), gone


def indexed(files: DataFrame, index: Callable[[str], int], stopped: Callable[[], bool] = lambda: False) -> DataFrame:
    """path, status, chunk_count of files: index(path) gives the number of chunks. A file that fails is told so and the
    others go on; once stopped, those that are left are skipped. Tasks are the workers; files of one go in turn."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                if stopped():
                    rows.append((path, "skipped", 0))
                    continue
                try:
                    rows.append((path, "indexed", int(index(path))))
                except Exception:  # noqa: BLE001 - told in the row
                    rows.append((path, "failed", 0))
            yield pd.DataFrame(rows, columns=["path", "status", "chunk_count"])

    return files.select("path").mapInPandas(run, "path string, status string, chunk_count int")


def save_every(changes: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = SAVE_SECONDS, once: bool = False):
    """Start a query that hands the changes to save at most every so many seconds, and what is left when it stops; once: all
    there is, then stop."""
    writer = changes.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def unclean_streaks(exits: DataFrame, keys: list[str], order: str, stages: list[str]) -> DataFrame:
    """exits (stage) with streak and safe: unclean exits in a row of which two of the last three came in the given stages;
    any other begins again at one. safe holds from the first streak of two on."""
    by = Window.partitionBy(*keys).orderBy(order)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = F.sum(F.col("stage").isin(stages).cast("int")).over(by.rowsBetween(1 - UNCLEAN_WINDOW, 0)) >= UNCLEAN_EXITS
    rows = exits.withColumn("_hit", hit).withColumn("_run", F.sum((~F.col("_hit")).cast("int")).over(upto))
    streak = F.sum(F.col("_hit").cast("int")).over(Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) + (F.col("_run") > 0).cast("int")
    rows = rows.withColumn("streak", streak)
    return rows.withColumn("safe", F.max("streak").over(upto) >= UNCLEAN_EXITS).drop("_hit", "_run")


def exit_decisions(events: DataFrame, key: str, ts: str, seconds: int = 600) -> DataFrame:
    """recent_counts() with the decisions: a store host is blocked from three crashes on, safe mode begins at two exits."""
    return recent_counts(events, key, ts, seconds).withColumn("blocked", F.col("recent") >= CRASHES).withColumn("safe_mode", F.col("recent") >= UNCLEAN_EXITS)


def unclean_exits(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """sessions (started_at, status) with unclean: the session before of the same installation (keys) was still running."""
    return sessions.withColumn("unclean", F.coalesce(F.lag("status").over(Window.partitionBy(*keys).orderBy("started_at")) == "running", F.lit(False)))


def exit_windows(events: DataFrame, key: str, ts: str, seconds: int = 600) -> DataFrame:
    """key, ts, count: exits of a key since the first of its window; a window ends so many seconds after its first. The
    anchor depends on what came before, so each key is folded in order by Arrow batches."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        counts, first, n = [], None, 0
        for t in pdf["ts"]:
            if first is None or (t - first).total_seconds() >= seconds:
                first, n = t, 0
            n += 1
            counts.append(n)
        return pdf.assign(count=counts)

    rows = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    return rows.groupBy("key").applyInPandas(fold, f"key {dict(rows.dtypes)['key']}, ts timestamp, count long")


def exit_windows_stream(events: DataFrame, key: str, ts: str, seconds: int = 600) -> DataFrame:
    """The same over a stream, with the window's anchor and count as state."""

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, n = state.get if state.exists else (0, 0)
        times = pd.concat([b["ts"] for b in batches]).sort_values()
        counts = []
        for t in times:
            us = int(t.value // 1000)
            if n == 0 or us - first >= seconds * 1_000_000:
                first, n = us, 0
            n += 1
            counts.append(n)
        state.update((first, n))
        yield pd.DataFrame({"key": name[0], "ts": times, "count": counts})

    rows = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    return rows.groupBy("key").applyInPandasWithState(fold, f"key {dict(rows.dtypes)['key']}, ts timestamp, count long", "first long, n int", "append", GroupStateTimeout.NoTimeout)

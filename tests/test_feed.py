"""The live feed: known cases, a plain version, the stream against the batch."""

import json
import random
from datetime import datetime, timedelta, timezone

from quillspark.streaming import feed
from quillspark.streaming.feed import Feed

SECOND = 1_000_000
LOG = "workspace string, ts timestamp, kind string, path string, op string, mtime double"


def run(*events, most=50):
    f = Feed("w", most=most)
    out = [r for e in events for r in f.take([e[0] * SECOND, *e[1:], *[None] * (5 - len(e))])] + f.due(1 << 62)
    return [(r["path"], r["changed"] // SECOND, r["released"] // SECOND, r["n"], r["fate"]) for r in out]


def test_quiet_hold_and_room():
    assert run((0, "change", "a"), (2, "change", "a"), (9, "change", "b")) == [("a", 2, 5, 2, "released"), ("b", 9, 12, 1, "released")]
    held = run((0, "focus", "a"), (1, "change", "a"), (2, "change", "b"), (9, "focus", "b"), (10, "change", "b"))
    assert held == [("b", 2, 5, 1, "released"), ("a", 1, 9, 1, "released")]  # b is active to the end and stays
    assert run((0, "focus", "a"), (1, "change", "a"), (2, "focus", None)) == [("a", 1, 4, 1, "released")]
    assert run((0, "change", "a"), (1, "change", "b"), (1, "change", "c"), (2, "change", "a"), most=2) == [("c", 1, 1, 1, "dropped"), ("b", 1, 4, 1, "released"), ("a", 2, 5, 2, "released")]
    assert run((0, "change", "a"), (1, "change", "a", "delete")) == [("a", 1, 1, 2, "released")]


def plain(rows):
    """Second by second: what is free at a time is what a reader of the rules would free then."""
    out = []
    for workspace in {r[0] for r in rows}:
        events = sorted((r for r in rows if r[0] == workspace), key=lambda r: (r[1], r[2] != "focus", r[3] or "", r[4] or "", r[5] or 0.0))
        pending, active = {}, None
        for now in range(int(events[-1][1].timestamp()) - int(events[0][1].timestamp()) + 10):
            at = events[0][1] + timedelta(seconds=now)
            for path in sorted(pending):
                if path != active and pending[path][0] + timedelta(seconds=3) <= at:
                    changed, op, mtime, n = pending.pop(path)
                    out.append((workspace, path, op, mtime, changed, max(changed + timedelta(seconds=3), at), n, "released"))
            for _, _, kind, path, op, mtime in (e for e in events if e[1] == at):
                if kind == "focus":
                    was, active = active, path
                    if was in pending and was != path and pending[was][0] + timedelta(seconds=3) <= at:
                        changed, o, m, n = pending.pop(was)
                        out.append((workspace, was, o, m, changed, at, n, "released"))
                elif op == "delete":
                    out.append((workspace, path, op, mtime, at, at, pending.pop(path, (0, 0, 0, 0))[3] + 1, "released"))
                elif path in pending or len(pending) < 50:
                    pending[path] = (at, op, mtime, pending.get(path, (0, 0, 0, 0))[3] + 1)
                else:
                    out.append((workspace, path, op, mtime, at, at, 1, "dropped"))
    return sorted(out, key=str)


def some_log(n, seed, files=70, gaps=(0, 0, 0, 0, 0, 0, 1, 1, 5)):
    rng, start = random.Random(seed), datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows, at = [], 0
    for _ in range(n):
        at += rng.choice(gaps)
        kind = rng.choice(["change"] * 8 + ["focus"])
        path = f"f{rng.randrange(files)}.md" if kind == "change" or rng.random() < 0.8 else None
        rows.append((f"w{rng.randrange(2)}", start + timedelta(seconds=at), kind, path, None if kind == "focus" else rng.choice(["modify", "modify", "modify", "delete"]), None if kind == "focus" else float(rng.randrange(5))))
    return rows


def times(r):
    at = lambda us: datetime.fromtimestamp(us // SECOND, timezone.utc)
    return (r["workspace"], r["path"], r["op"], r["mtime"], at(r["changed"]), at(r["released"]), r["n"], r["fate"])


def test_batch(spark):
    rows = some_log(700, 1, 300, [0] * 70 + [1, 5])
    odd = [(None, rows[0][1], "change", "x", "modify", 0.0), ("w9", None, "change", "x", "modify", 0.0), ("w9", rows[0][1], "change", None, "modify", 0.0), ("w9", rows[0][1], None, "x", "modify", 0.0)]
    got = sorted((times(r) for r in feed.released_changes(spark.createDataFrame(rows + odd, LOG)).collect()), key=str)
    assert got == plain(rows) and {"dropped", "released"} == {r[-1] for r in got}
    assert feed.released_changes(spark.createDataFrame([], LOG)).count() == 0


def test_stream_is_batch(spark, tmp_path):
    """Shuffled within the delay, cut into files, stopped and started again. Last, an event far behind moves the watermark."""
    rows, folder, got = some_log(150, 2, files=6), tmp_path / "log", []
    folder.mkdir()
    far = max(r[1] for r in rows) + timedelta(hours=1)
    late = sorted(rows, key=lambda r: (r[1] + timedelta(seconds=random.Random(str(r)).randrange(9))))
    parts = [late[:60], late[60:110], late[110:], [("end", far, "change", "z", "modify", 0.0)], [("end", far + timedelta(hours=1), "change", "z", "modify", 0.0)]]

    def stream():
        log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(str(folder))
        out = feed.released_stream(log, "30 seconds").writeStream.outputMode("append").foreachBatch(lambda df, n: got.extend(times(r) for r in df.collect()))
        out.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(300)

    for i, part in enumerate(parts):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("workspace", "ts", "kind", "path", "op", "mtime"), (w, t.isoformat(), *rest)))) for w, t, *rest in part) + "\n")
        if i in (1, 4):
            stream()
    want = [r for r in plain(rows)]
    assert sorted((r for r in got if r[0] != "end"), key=str) == want

"""Blocks of hosts: batch, stream and a plain count over time tell the same."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest

from quillspark.streaming import blocks

LOG = "host string, at timestamp, note string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plain(rows, seconds, most):
    """Count at each moment at which the count can change, by definition."""
    out = []
    for host in {h for h, t, _ in rows if h and t}:
        times = sorted(t for h, t, _ in rows if h == host and t)
        window, blocked = timedelta(seconds=seconds), False
        for now in sorted({*times, *(t + window for t in times)}):
            full = sum(t <= now < t + window for t in times) >= most
            if full != blocked:
                out.append((host, "blocked" if full else "released", now))
            blocked = full
    return sorted(out)


def log(n, seed, hosts=3, span=2000):
    rng = random.Random(seed)
    return [(rng.choice(["h0"] * 2 + [f"h{i}" for i in range(hosts)]), START + timedelta(seconds=rng.randrange(span)), "n") for _ in range(n)]



@pytest.mark.parametrize("most, seconds", [(1, 50), (3, 100), (3, 60), (4, 200)])
def test_batch(spark, most, seconds):
    rows = log(150, most * seconds) + [("t", START, "n")] * 5 + [("e", START + timedelta(seconds=s), "n") for s in (0, 1, 2, seconds, seconds + 1, seconds + 2)]
    odd = [(None, START, "n"), ("h0", None, "n")]
    got = blocks.block_changes(spark.createDataFrame(rows + odd, LOG), "host", "at", seconds, most)
    with_utc = sorted((r.key, r.change, datetime.fromtimestamp(r.us / 1e6, timezone.utc)) for r in got.selectExpr("key", "change", "unix_micros(at) AS us").collect())
    assert with_utc == plain(rows, seconds, most) and {c for _, c, _ in with_utc} == {"blocked", "released"}
    assert blocks.block_changes(spark.createDataFrame([], LOG), "host", "at").count() == 0


def test_stream_is_batch(spark, tmp_path):
    """Crashes late by less than the delay, cut into files, stopped and started again."""
    rows, folder, got = log(90, 5), tmp_path / "log", []
    folder.mkdir()
    late = sorted(rows, key=lambda r: (r[1] + timedelta(seconds=random.Random(str(r)).randrange(20))))
    far = START + timedelta(hours=3)
    parts = [late[:30], late[30:60], late[60:], [("end", far, "n")], [("end", far + timedelta(hours=2), "n")]]

    def stream():
        events = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(str(folder))
        out = blocks.block_stream(events, "host", "at", 100, 3, "30 seconds").selectExpr("key", "change", "unix_micros(at) AS us").writeStream.outputMode("append")
        out = out.foreachBatch(lambda df, n: got.extend((r.key, r.change, datetime.fromtimestamp(r.us / 1e6, timezone.utc)) for r in df.collect()))
        out.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(300)

    for i, part in enumerate(parts):
        (folder / f"{i}.json").write_text("\n".join(json.dumps({"host": h, "at": t.isoformat(), "note": n}) for h, t, n in part) + "\n")
        if i in (1, 4):
            stream()
    want = plain(rows, 100, 3)
    assert sorted(got) == want and len(want) > 4

"""Walk sessions: known walks, a plain replay, the stream against the batch."""

import json
import random

from quillspark.streaming import sessions
from quillspark.streaming.sessions import Session


def walk(*actions):
    s = Session()
    for kind, node, *rest in actions:
        s.act(kind, node, rest[0] if rest else None, rest[1] if len(rest) > 1 else None)
        s = Session(s.saved())  # what a stream keeps is all there is
    return s


def test_hiding_cascades():
    s = walk(("root", "a"), ("expand", "a", ["b", "c"]), ("expand", "b", ["d", "c"]), ("focus", "d"), ("hide", "b"))
    assert set(s.nodes) == {"a", "c"} and s.out == {"a": ["c"]} and (s.focus, s.visited, s.hidden) == ("a", ["a"], ["b"])
    s.act("expand", "a", ["b", "e"], None)
    assert set(s.nodes) == {"a", "c", "e"} and s.nodes["e"][0] == 1  # what is hidden stays away
    s.act("hide", "a", None, None)
    assert (s.root, s.focus, s.nodes, s.visited, s.hidden) == (None, None, {}, [], ["b", "a"])


def test_limits_and_states():
    s = walk(("root", "r"), ("expand", "r", [f"n{i}" for i in range(120)]))
    assert len(s.nodes) == 100 and s.warning == "nodes"
    s.act("collapse", "r", None, None)
    assert s.warning is None and s.reach(past_collapsed=False) == {"r"}
    s.act("link", "n1", ["new"], None)
    assert "new" in s.nodes  # only what is seen counts
    s = walk(("root", "r"), ("expand", "r", [f"n{i}" for i in range(60)]), *[("expand", f"n{i}", [f"n{j}" for j in range(60)]) for i in range(3)])
    assert sum(map(len, s.out.values())) == 200 and s.warning == "edges"
    s = walk(("mode", None, None, "precise"), ("exclude", None, None, "true"), ("root", "a"), ("focus", "nowhere"), ("root", "b"))
    assert (s.mode, s.exclude, s.visited) == ("precise", True, ["b"])
    s.act("reset", None, None, None)
    assert (s.mode, s.exclude, s.root) == ("balanced", False, None)
    row = walk(("root", "a"), ("expand", "a", ["b", "c"]), ("focus", "b"), ("link", "b", ["d"]), ("link", "b", ["c"])).row("s")
    assert [(n["node"], n["depth"], n["status"]) for n in row["nodes"]] == [("a", 0, "visited"), ("b", 1, "focus"), ("c", 1, "candidate"), ("d", 2, "candidate")]


def some_log(n, seed):
    rng = random.Random(seed)
    name = lambda: f"n{rng.randrange(8)}"
    rows = []
    for step in range(n):
        kind = rng.choice(["root", "expand", "expand", "expand", "focus", "focus", "link", "collapse", "open", "hide", "mode", "exclude"] + ["reset"] * (step % 9 == 0))
        rows.append((f"s{rng.randrange(5)}", step, kind, None if kind in ("mode", "exclude", "reset") else name(), [name() for _ in range(rng.randrange(4))] if kind in ("expand", "link") else None, rng.choice(["true", "precise"])))
    return rows


def plain(rows):
    by = {}
    for session, _, kind, node, targets, value in sorted(rows, key=lambda r: r[1]):
        by.setdefault(session, Session()).act(kind, node, targets, value)
    return {k: s.row(k) for k, s in by.items()}


def as_dict(r):
    return r.asDict(recursive=True)


def test_batch(spark):
    rows = some_log(300, 1)
    log = spark.createDataFrame(rows, sessions.LOG)
    assert sessions.since_last_start(log).count() < len(rows)
    odd = spark.createDataFrame([(None, 1, "root", "x", None, None), ("odd", 1, None, "x", None, None), ("odd", 2, "fly", "x", None, None), ("odd", 3, "root", None, None, None)], sessions.LOG)
    got = {r.session: as_dict(r) for r in sessions.session_states(log.unionByName(odd)).collect()}
    assert got == plain(rows)
    assert sessions.session_states(log.where("step < 0")).count() == 0


def test_stream_is_batch(spark, tmp_path):
    """In micro-batches of one file each, stopped and started again in the middle."""
    rows, folder, last = some_log(120, 2), tmp_path / "log", {}
    folder.mkdir()
    names = [c.split()[0] for c in sessions.LOG.split(", ")]

    def run():
        log = spark.readStream.schema(sessions.LOG).option("maxFilesPerTrigger", 1).json(str(folder))
        out = sessions.stream_states(log).writeStream.outputMode("update").foreachBatch(lambda df, n: last.update({r.session: as_dict(r) for r in df.collect()}))
        out.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(300)

    for i, cut in enumerate([(0, 50), (50, 90), (90, 120)]):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows[slice(*cut)]) + "\n")
        if i:
            run()
    assert last == plain(rows)

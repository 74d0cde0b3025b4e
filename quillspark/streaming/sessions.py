"""Walk sessions: a fold of a log of actions into the state of each session, in batches and as a stream.

A log has session, step, kind, node, targets and value. Kinds: root (begin anew at node), expand (targets become candidates of
node), link (targets[0] is linked from node), focus, collapse, open, hide (node and what only it led to), mode and exclude (value), reset.
Actions on nodes that are not there change nothing. A state is small by the limits of a walk; the log of a session may be of any length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quillspark.operators.walk import MOST_EDGES, MOST_NODES

LOG = "session string, step long, kind string, node string, targets array<string>, value string"
STATE = "session string, root string, focus string, nodes array<struct<node:string,depth:int,status:string,expanded:boolean,collapsed:boolean>>, edges array<struct<source:string,target:string>>, visited array<string>, hidden array<string>, mode string, exclude boolean, warning string"
FIELDS = [c.split()[0] for c in LOG.split(", ")]


class Session:
    """The state of one session."""

    def __init__(self, saved: str | None = None):
        s = json.loads(saved) if saved else {}
        self.root, self.focus, self.warning = s.get("root"), s.get("focus"), s.get("warning")
        self.mode, self.exclude = s.get("mode", "balanced"), s.get("exclude", False)
        #: node -> [depth, expanded, collapsed], in the order they came; node -> targets.
        self.nodes: dict[str, list] = s.get("nodes", {})
        self.out: dict[str, list[str]] = s.get("out", {})
        self.visited, self.hidden = s.get("visited", []), s.get("hidden", [])
        #: Nodes that were in focus once.
        self.seen = set(s.get("seen", []))

    def saved(self) -> str:
        return json.dumps(self.__dict__ | {"seen": sorted(self.seen)})

    def reach(self, past_collapsed: bool = True) -> set[str]:
        """What the root leads to."""
        found, open_ = set(), [self.root] if self.root in self.nodes else []
        while open_:
            n = open_.pop()
            if n not in found:
                found.add(n)
                if past_collapsed or not self.nodes[n][2]:
                    open_ += [t for t in self.out.get(n, ()) if t in self.nodes]
        return found

    def _add(self, source: str, target: str) -> str | None:
        """Link two nodes, the second of which may be new; which limit keeps it out."""
        if sum(map(len, self.out.values())) >= MOST_EDGES:
            return "edges"
        new = target not in self.nodes
        if new:
            self.nodes[target] = [self.nodes[source][0] + 1, False, False]
        self.out.setdefault(source, []).append(target)
        if len(self.nodes) > MOST_NODES and len(self.reach(past_collapsed=False)) > MOST_NODES:
            self.out[source].pop()
            if new:
                del self.nodes[target]
            return "nodes"
        return None

    def act(self, kind: str, node: str | None, targets: list[str] | None, value: str | None) -> None:
        if kind in ("reset", "root"):
            kept = {} if kind == "reset" else {"mode": self.mode, "exclude": self.exclude}
            self.__init__(json.dumps(kept))
            if kind == "root":
                self.root, self.nodes = node, {node: [0, False, False]}
                self._look_at(node)
        elif kind == "mode":
            self.mode = value
        elif kind == "exclude":
            self.exclude = value == "true"
        elif node in self.nodes:
            getattr(self, f"_{kind}")(node, targets or [])

    def _look_at(self, node: str | None) -> None:
        self.focus = node
        if node is not None:
            self.seen.add(node)
            if node not in self.visited:
                self.visited.append(node)

    def _focus(self, node, _) -> None:
        self._look_at(node)

    def _collapse(self, node, _) -> None:
        self.nodes[node][2], self.warning = True, None

    def _open(self, node, _) -> None:
        self.nodes[node][2], self.warning = False, None

    def _expand(self, node, targets) -> None:
        self.nodes[node][1:], self.warning = [True, False], None
        for t in targets:
            if t != node and t not in self.hidden and t not in self.out.get(node, ()):
                self.warning = self._add(node, t) or self.warning

    def _link(self, node, targets) -> None:
        for t in targets[:1]:
            if t not in self.hidden and t not in self.nodes:
                self.warning = self._add(node, t)

    def _hide(self, node, _) -> None:
        self.warning = None
        if node not in self.hidden:
            self.hidden.append(node)
        del self.nodes[node]
        left = self.reach()
        self.nodes = {n: v for n, v in self.nodes.items() if n in left}
        self.out = {n: [t for t in ts if t in left] for n, ts in self.out.items() if n in left}
        self.visited = [n for n in self.visited if n in left]
        self.seen &= left
        if node == self.root:
            self.root = None
        if self.focus not in left:
            self._look_at(self.root)

    def row(self, session: str) -> dict:
        status = lambda n: "focus" if n == self.focus else "visited" if n in self.seen else "candidate"
        nodes = [{"node": n, "depth": d, "status": status(n), "expanded": e, "collapsed": c} for n, (d, e, c) in self.nodes.items()]
        edges = [{"source": s, "target": t} for s, ts in self.out.items() for t in ts]
        return {"session": session, "root": self.root, "focus": self.focus, "nodes": nodes, "edges": edges, "visited": self.visited, "hidden": self.hidden, "mode": self.mode, "exclude": self.exclude, "warning": self.warning}


def since_last_start(log: DataFrame) -> DataFrame:
    """The actions that still tell: those from a session's last root or reset on, and all that set modes or reset them."""
    starts = log.where(F.col("kind").isin("root", "reset")).groupBy("session").agg(F.max("step").alias("_start"))
    kept = F.col("_start").isNull() | (F.col("step") >= F.col("_start")) | F.col("kind").isin("mode", "exclude", "reset")
    return log.join(starts, "session", "left").where(kept).drop("_start")


def session_states(log: DataFrame) -> DataFrame:
    """The last state of every session of a log: session, root, focus, nodes, edges, visited, hidden, mode, exclude, warning.

    Actions go by step; those of equal step by kind, node and targets. Null sessions, kinds and kinds that are not known are
    left out. Actions before a session's last start are dropped first; the rest comes to a task sorted, and only one
    session's state is held at a time, so a long session costs time and no memory.
    """
    kinds = ("root", "reset", "expand", "link", "focus", "collapse", "open", "hide", "mode", "exclude")
    rows = since_last_start(log.select(FIELDS).where(F.col("session").isNotNull() & F.col("kind").isin(*kinds) & (F.col("node").isNotNull() | F.col("kind").isin("reset", "mode", "exclude"))))
    rows = rows.repartition("session").sortWithinPartitions("session", "step", "kind", "node", "targets")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, session = None, None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["session"] != at:
                    if session is not None:
                        done.append(session.row(at))
                    at, session = r["session"], Session()
                session.act(r["kind"], r["node"], r["targets"], r["value"])
            yield pa.RecordBatch.from_pylist(done, ARROW_STATE)
        if session is not None:
            yield pa.RecordBatch.from_pylist([session.row(at)], ARROW_STATE)

    return rows.mapInArrow(fold, STATE)


_NODE = pa.struct([("node", pa.string()), ("depth", pa.int32()), ("status", pa.string()), ("expanded", pa.bool_()), ("collapsed", pa.bool_())])
ARROW_STATE = pa.schema([("session", pa.string()), ("root", pa.string()), ("focus", pa.string()), ("nodes", pa.list_(_NODE)), ("edges", pa.list_(pa.struct([("source", pa.string()), ("target", pa.string())]))), ("visited", pa.list_(pa.string())), ("hidden", pa.list_(pa.string())), ("mode", pa.string()), ("exclude", pa.bool_()), ("warning", pa.string())])


def stream_states(log: DataFrame) -> DataFrame:
    """The same of a streaming log whose actions come in the order of their steps, in any micro-batches: each gives the new state
    of the sessions it touched. The state survives restarts by the query's checkpoint. Write it in update mode."""

    def step(key, frames, state):
        session = Session(state.get[0] if state.exists else None)
        rows = pd.concat(list(frames))
        rows = rows.assign(_targets=[None if t is None else tuple(t) for t in rows["targets"]]).sort_values(["step", "kind", "node"], kind="stable")
        for kind, node, targets, value in zip(rows["kind"], rows["node"], rows["_targets"], rows["value"]):
            session.act(kind, node, list(targets) if targets is not None else None, value)
        state.update((session.saved(),))
        yield pd.DataFrame([session.row(key[0])])

    return log.select(FIELDS).groupBy("session").applyInPandasWithState(step, STATE, "saved string", "update", GroupStateTimeout.NoTimeout)

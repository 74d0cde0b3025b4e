"""Walking from chunk to chunk: related chunks, reachability, layout gaps.

A walk's graph is two tables, nodes and edges (source, target). Traversals are loops of joins with a visited set, as edges
may form cycles; each round's frontier is small by the limits of a walk.
"""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import rules
from quillspark.operators import search
from quillspark.sources.scratch import scratch_root

#: Limits of a walk.
POOL, MOST_NODES, MOST_EDGES, DEFAULT_LIMIT, MAX_LIMIT = 40, 100, 200, 8, 40
COLUMN_STEP, ROW_STEP = 570, 312
NODE_WIDTH, NODE_HEIGHT = 414, 276


def clamp_limit(limit) -> int:
    try:
        return min(MAX_LIMIT, max(1, int(limit)))
    except (TypeError, ValueError, OverflowError):
        return DEFAULT_LIMIT


def related(records: DataFrame, chunk_id, limit: int = DEFAULT_LIMIT, mode: str = "balanced", other_documents: bool = False, hidden: list = (), valid: Column | None = None, root: DataFrame | None = None) -> DataFrame:
    """Nearest chunks to a stored one, with their band. balanced: two of a document at most.

    valid is what a candidate must meet; it is asked of the pool of nearest ones, so fewer than limit may be left. root holds
    the chunk (id, doc_id, embedding) if it is not stored or has no vector there, as free_text() makes it.
    """
    me = records.where((F.col("id") == chunk_id) & F.col("embedding").isNotNull()).select("embedding", "doc_id").first()
    if me is None and root is not None:
        me = root.where(F.col("id") == chunk_id).select("embedding", "doc_id").first()
    if me is None:
        return search.bands(records.where(F.lit(False)).withColumn("distance", F.lit(0.0)).withColumn("position", F.lit(0)), [])
    pool = search.nearest(search.visible(records, chunk_ids=[chunk_id, *hidden]), me["embedding"], POOL).withColumn("_all", F.lit(1))
    if valid is not None:
        pool = pool.where(F.coalesce(valid, F.lit(False)))
    source = F.col("doc_id").eqNullSafe(F.lit(me["doc_id"])) if other_documents else None
    chosen = search.balanced(pool, ["_all"], clamp_limit(limit), 2 if mode == "balanced" else None, source)
    return search.bands(chosen, ["_all"]).drop("_all")


def reachable(edges: DataFrame, roots: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """node, depth of all nodes that edges (source, target) reach from roots (node); paths don't go on behind the nodes of
    stop. Rounds go on until no node is new. Each is written out, so that plans stay short and lost executors cost one round."""
    spark = edges.sparkSession
    seen = roots.select("node", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in itertools.count(1):
        open_ = frontier.select("node") if stop is None else frontier.select("node").join(stop.select("node"), "node", "left_anti")
        new = edges.join(open_, edges["source"] == open_["node"], "left_semi").select(F.col("target").alias("node")).distinct()
        new = _checkpoint(spark, new.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new
    return seen


def _checkpoint(spark, df: DataFrame) -> DataFrame:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    return df.checkpoint()


def hide(nodes: DataFrame, edges: DataFrame, root, hidden) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the hidden node and what only it led to; hiding the root leaves nothing."""
    left = edges.where((F.col("source") != hidden) & (F.col("target") != hidden))
    kept = reachable(left, nodes.where((F.col("node") == root) & (F.col("node") != hidden)).select("node"))
    names = kept.select("node")
    left = left.join(names, left["source"] == names["node"], "left_semi")
    return nodes.join(names, "node", "left_semi"), left.join(names, left["target"] == names["node"], "left_semi")


def visible(nodes: DataFrame, edges: DataFrame, root) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that a walk shows: what the root reaches (nodes: node, collapsed), not past collapsed nodes."""
    shown = reachable(edges.join(nodes.select(F.col("node").alias("target")), "target", "left_semi").select("source", "target"), nodes.where(F.col("node") == root).select("node"), nodes.where("collapsed")).select("node")
    open_ = shown.join(nodes.where("collapsed").select("node"), "node", "left_anti").withColumnRenamed("node", "source")
    lines = edges.join(open_, "source", "left_semi").join(shown.withColumnRenamed("node", "target"), "target", "left_semi")
    return nodes.join(shown, "node", "left_semi"), lines.select(edges.columns)


def admit(candidates: DataFrame, nodes: int, edges: int, keys: list[str] = ()) -> DataFrame:
    """candidates (position, known, hidden) with admitted and warning: hidden ones are passed over; others get an edge while
    the walk has fewer than its limit, new nodes while there is room for nodes. warning says which limit kept one out."""
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))  # a pool at most
    order = by.orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = ~F.col("hidden")
    fresh = F.sum((counted & ~F.col("known")).cast("int")).over(order)
    nth = F.sum(counted.cast("int")).over(order) - F.greatest(F.lit(0), fresh - max(0, MOST_NODES - nodes))
    room = F.col("known") | (fresh + nodes <= MOST_NODES)
    slot = nth + F.when(room, 0).otherwise(1) + edges <= MOST_EDGES
    warning = F.when(counted & ~slot, "edges").when(counted & ~room, "nodes")
    return candidates.withColumn("admitted", counted & slot & room).withColumn("warning", warning)


def replace_candidates(nodes: DataFrame, edges: DataFrame, visited: DataFrame, root, source) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) before new candidates of source come: its edges go, but for those to visited or expanded nodes and to
    nodes with edges of their own; then what the root no longer reaches. nodes: node, expanded; visited: node."""
    kept = visited.select("node").unionByName(nodes.where("expanded").select("node")).unionByName(edges.select(F.col("source").alias("node"))).distinct()
    left = edges.where(F.col("source") != source).unionByName(edges.where(F.col("source") == source).join(kept, edges["target"] == kept["node"], "left_semi"))
    names = reachable(left, nodes.where(F.col("node") == root).select("node")).select("node")
    left = left.join(names, left["source"] == names["node"], "left_semi")
    return nodes.join(names, "node", "left_semi"), left.join(names, left["target"] == names["node"], "left_semi")


def focus_states(log: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, visited, status of the nodes of a log of focus actions (step, node): in the order of their first visit,
    the last focused one in focus, the others visited."""
    by = Window.partitionBy(*keys)
    seen = log.groupBy(*keys, "node").agg(F.min("step").alias("first"), F.max("step").alias("last"))
    status = F.when(F.col("last") == F.max("last").over(by), "focus").otherwise("visited")
    return seen.withColumn("status", status).withColumn("visited", F.row_number().over(by.orderBy("first"))).select(*keys, "node", "visited", "status")


def hydrate(cached: DataFrame, records: DataFrame) -> DataFrame:
    """Cached candidates (id, distance) with the rows they stand for today; those that have gone are left out."""
    return cached.select("id", "distance").join(records, "id")


def random_chunk(chunks: DataFrame, seed: int, current=None) -> DataFrame:
    """One chunk, but not the current one: a document by chance, each as likely, then one of its chunks. The seed decides."""
    draw = lambda c: F.md5(F.concat(c.cast("string"), F.lit(f"#{seed}")))
    rows = chunks if current is None else chunks.where(~F.col("id").eqNullSafe(F.lit(current)))
    document = rows.select("doc_id").distinct().orderBy(draw(F.col("doc_id")), "doc_id").limit(1)
    return rows.join(F.broadcast(document), "doc_id").orderBy(draw(F.col("id")), "id").limit(1)  # one row


def free_text(text: str, embed, spark) -> DataFrame:
    """A text as a chunk outside the store, with its vector: the root of a walk that begins with it."""
    row = spark.createDataFrame([("transient::chunk-0", "transient", text)], "id string, doc_id string, document string")
    return embed(row, "document")


def restore_offset(restored: DataFrame, occupied: DataFrame, keys: list[str]) -> DataFrame:
    """keys, offset: how far down the automatic nodes of restored (x, y, manual) move so that none is nearer than a row to an
    occupied place (x, y) or to a manual node; the nearer end of the blocked range, upwards if both are as near."""
    placed = occupied.select(*keys, "x", F.col("y").alias("there")).unionByName(restored.where("manual").select(*keys, "x", F.col("y").alias("there")))
    ranges = restored.where("NOT manual").join(placed, [*keys, "x"]).select(*keys, (F.col("there") - F.col("y") - ROW_STEP).alias("low"), (F.col("there") - F.col("y") + ROW_STEP).alias("high"))
    blocked = merged_ranges(ranges, keys, touching=False).where("low < 0 AND high > 0")
    offset = F.when(F.abs("low") <= F.abs("high"), F.col("low")).otherwise(F.col("high"))
    return restored.select(*keys).distinct().join(blocked.select(*keys, offset.alias("offset")), keys, "left").withColumn("offset", F.coalesce("offset", F.lit(0.0)))


def fit(nodes: DataFrame, keys: list[str], width: float, height: float, padding: float = 72.0) -> DataFrame:
    """keys, x, y, zoom of the view that shows all nodes (x, y) of a walk."""
    box = nodes.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + NODE_WIDTH).alias("x1"), F.max(F.col("y") + NODE_HEIGHT).alias("y1"))
    across, down = F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)), F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    zoom = rules.zoom(F.least(F.lit(max(1.0, width - 2 * padding)) / across, F.lit(max(1.0, height - 2 * padding)) / down))
    view = lambda size, low, span: (F.lit(size) - span * F.col("zoom")) / 2 - F.col(low) * F.col("zoom")
    return box.withColumn("zoom", zoom).select(*keys, view(width, "x0", across).alias("x"), view(height, "y0", down).alias("y"), "zoom")


def zoom_at(x: Column, y: Column, zoom: Column, wanted: Column, at_x: Column, at_y: Column) -> list[Column]:
    """The view after a zoom around a point, which stays where it is."""
    new = rules.zoom(wanted)
    return [(at_x - (at_x - x) / zoom * new).alias("x"), (at_y - (at_y - y) / zoom * new).alias("y"), new.alias("zoom")]


def merged_ranges(ranges: DataFrame, keys: list[str], touching: bool = True) -> DataFrame:
    """keys, low, high, n: overlapping ranges (low, high) as one, those that only touch too if wanted."""
    by = Window.partitionBy(*keys).orderBy("low", "high")
    before = F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(before.isNull() | (F.col("low") > before) | (F.lit(not touching) & (F.col("low") == before)), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*keys, "_island").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n")).drop("_island")


def child_places(children: DataFrame, keys: list[str]) -> DataFrame:
    """children (position, parent_x, parent_y) with x, y: a column to the right, rows symmetric around the parent."""
    by = Window.partitionBy(*keys)
    nth = F.row_number().over(by.orderBy("position")) - 1
    y = F.col("parent_y") + (nth - (F.count("*").over(by) - 1) / 2) * ROW_STEP
    return children.withColumn("x", F.col("parent_x") + COLUMN_STEP).withColumn("y", y)


def free_places(children: DataFrame, keys: list[str]) -> DataFrame:
    """child_places() moved to the nearest free row, upwards if two are as near: children also have taken, the rows of other
    nodes in their column. Each place depends on those before it, so a parent's children, a pool at most, are placed in turn."""
    placed = child_places(children, keys).select(*keys, "position", "x", "y", "taken")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        rows = list(pdf["taken"].iloc[0])
        out = []
        for y in pdf["y"]:
            free = lambda at: all(abs(at - r) >= ROW_STEP for r in rows)
            best = y if free(y) else min((c for r in rows for c in (r - ROW_STEP, r + ROW_STEP) if free(c)), key=lambda c: (abs(c - y), c), default=y)
            rows.append(best)
            out.append(best)
        return pdf.assign(y=out)[[*keys, "position", "x", "y"]]

    kinds = dict(placed.dtypes)
    return placed.groupBy(*keys).applyInPandas(place, ", ".join(f"{c} {kinds[c]}" for c in [*keys, "position", "x", "y"]))

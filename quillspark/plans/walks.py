"""Queries of graph walks, change feeds and event logs over the driver's tables.

Orders of a day make a graph of customers; users stand for installations, event types for operations and stages.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators import documents, walk
from quillspark.plans import catalog
from quillspark.plans.catalog import query, records, table
from quillspark.streaming import blocks, changes, feed, sessions

_EDGES = "edges AS (SELECT DISTINCT source, target FROM (SELECT o_custkey AS source, lead(o_custkey) OVER (PARTITION BY o_orderdate::DATE ORDER BY o_orderkey) AS target FROM orders) WHERE target IS NOT NULL)"
_ROOT = "(SELECT min(source) FROM edges)"


def _edges(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("target", F.lead("o_custkey").over(Window.partitionBy(F.to_date("o_orderdate")).orderBy("o_orderkey"))).where("target IS NOT NULL")
    return orders.select(F.col("o_custkey").alias("source"), "target").distinct()


def _nodes(edges):
    return edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()


@query("j10_reachable", f"WITH RECURSIVE {_EDGES}, r AS (SELECT {_ROOT} AS node, 0 AS depth UNION SELECT target, depth + 1 FROM r JOIN edges ON source = node WHERE depth < 40) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def j10(spark, sf_dir):
    """Customers reachable from the first by edges between consecutive orders of a day."""
    edges = _edges(spark, sf_dir)
    return walk.reachable(edges, edges.agg(F.min("source").alias("node")))


@query("r19_visible", f"WITH RECURSIVE {_EDGES}, r AS (SELECT {_ROOT} AS node UNION SELECT target FROM r JOIN edges ON source = node WHERE node % 3 <> 1 OR node = {_ROOT}) SELECT node FROM r")
def r19(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    root = edges.agg(F.min("source")).first()[0]
    nodes = _nodes(edges).withColumn("collapsed", (F.col("node") % 3 == 1) & (F.col("node") != root))
    return walk.visible(nodes, edges, root)[0].select("node")


@query("r20_hide", f"WITH RECURSIVE {_EDGES}, e AS (SELECT * FROM edges WHERE source <> 10 AND target <> 10), r AS (SELECT {_ROOT} AS node UNION SELECT target FROM r JOIN e ON source = node) SELECT source, target FROM e WHERE source IN (SELECT node FROM r)")
def r20(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return walk.hide(_nodes(edges), edges, edges.agg(F.min("source")).first()[0], 10)[1]


@query("r18_replace", f"WITH RECURSIVE {_EDGES}, e AS (SELECT * FROM edges WHERE source % 2 = 0 AND target % 4 <> 0 OR source = {_ROOT}), k AS (SELECT source AS node FROM e UNION SELECT target FROM e WHERE target % 11 = 0 UNION SELECT target FROM e WHERE target % 13 = 0), l AS (SELECT * FROM e WHERE source <> {_ROOT} OR target IN (SELECT node FROM k)), r AS (SELECT {_ROOT} AS node UNION SELECT target FROM r JOIN l ON source = node) SELECT source, target FROM l WHERE source IN (SELECT node FROM r)")
def r18(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    root = edges.agg(F.min("source")).first()[0]
    edges = edges.where((F.col("source") % 2 == 0) & (F.col("target") % 4 != 0) | (F.col("source") == root))
    nodes = _nodes(edges).withColumn("expanded", F.col("node") % 11 == 0)
    return walk.replace_candidates(nodes, edges, nodes.where("node % 13 = 0").select("node"), root, root)[1]


@query("r21_focus", "SELECT user_id, event_type AS node, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id))::INT AS visited, CASE WHEN max(event_id) = max(max(event_id)) OVER (PARTITION BY user_id) THEN 'focus' ELSE 'visited' END AS status FROM events GROUP BY user_id, event_type")
def r21(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("step"), F.col("event_type").alias("node"))
    return walk.focus_states(log, ["user_id"])


@query("r17_admit", "WITH c AS (SELECT user_id, event_id, event_type = 'error' AS hidden, event_type = 'view' AS known FROM events), o AS (SELECT *, sum((NOT hidden AND NOT known)::INT) OVER w AS fresh, sum((NOT hidden)::INT) OVER w AS nth FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)), s AS (SELECT *, nth - greatest(0, fresh - 10) AS slot FROM o) SELECT user_id, event_id, NOT hidden AND slot + 180 <= 200 AND (known OR fresh + 90 <= 100) AS admitted FROM s")
def r17(spark, sf_dir):
    c = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("position"), (F.col("event_type") == "error").alias("hidden"), (F.col("event_type") == "view").alias("known"))
    return walk.admit(c, 90, 180, ["user_id"]).select("user_id", "event_id", "admitted")


@query("r23_restore", "WITH n AS (SELECT label AS walk, vec_id % 3 AS x, (vec_id % 40) * 300.0::DOUBLE AS y, vec_id % 10 = 0 AS occupied FROM embeddings), g AS (SELECT a.walk, b.y - a.y - 312 AS low, b.y - a.y + 312 AS high FROM n a JOIN n b ON a.walk = b.walk AND a.x = b.x AND b.occupied AND NOT a.occupied), m AS (SELECT *, coalesce(low >= max(high) OVER (PARTITION BY walk ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM g), i AS (SELECT *, sum(new) OVER (PARTITION BY walk ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM m), r AS (SELECT walk, min(low) AS low, max(high) AS high FROM i GROUP BY walk, island) SELECT w.walk, coalesce(CASE WHEN abs(low) <= abs(high) THEN low ELSE high END, 0)::DOUBLE AS \"offset\" FROM (SELECT DISTINCT walk FROM n WHERE NOT occupied) w LEFT JOIN r ON r.walk = w.walk AND low < 0 AND high > 0")
def r23(spark, sf_dir):
    nodes = records(spark, sf_dir).select(F.col("doc_id").alias("walk"), (F.col("id") % 3).alias("x"), ((F.col("id") % 40) * 300.0).alias("y"), F.lit(False).alias("manual"), (F.col("id") % 10 == 0).alias("occupied"))
    return walk.restore_offset(nodes.where("NOT occupied"), nodes.where("occupied").select("walk", "x", "y"), ["walk"])


@query("m12_places", "SELECT label AS walk, vec_id AS id, 570.0::DOUBLE AS x, round((row_number() OVER w - 1 - (count(*) OVER (PARTITION BY label) - 1) / 2.0::DOUBLE) * 312, 3) AS y FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)")
def m12(spark, sf_dir):
    children = records(spark, sf_dir).select(F.col("doc_id").alias("walk"), "id", F.col("id").alias("position"), F.lit(0.0).alias("parent_x"), F.lit(0.0).alias("parent_y"))
    return walk.child_places(children, ["walk"]).select("walk", "id", "x", F.round("y", 3).alias("y"))


@query("m14_fit", "WITH n AS (SELECT label AS walk, vec_id * 10.0::DOUBLE AS x, (vec_id % 17) * 50.0::DOUBLE AS y FROM embeddings), b AS (SELECT walk, min(x) AS x0, min(y) AS y0, max(x + 414) AS x1, max(y + 276) AS y1 FROM n GROUP BY walk), z AS (SELECT *, least(greatest(least((1200 - 144) / (x1 - x0), (800 - 144) / (y1 - y0)), 0.4), 1.8) AS zoom FROM b) SELECT walk, round((1200 - (x1 - x0) * zoom) / 2 - x0 * zoom, 6) AS x, round((800 - (y1 - y0) * zoom) / 2 - y0 * zoom, 6) AS y, round(zoom, 6) AS zoom FROM z")
def m14(spark, sf_dir):
    nodes = records(spark, sf_dir).select(F.col("doc_id").alias("walk"), (F.col("id") * 10.0).alias("x"), ((F.col("id") % 17) * 50.0).alias("y"))
    return walk.fit(nodes, ["walk"], 1200.0, 800.0).select("walk", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("zoom", 6).alias("zoom"))


@query("m13_zoom", "SELECT event_id, round(50 - (50 - value) / 2 * z, 9) AS x, round(z, 9) AS zoom FROM (SELECT event_id, value, least(greatest(value / 100, 0.4), 1.8) AS z FROM events)")
def m13(spark, sf_dir):
    v = F.col("value")
    out = table(spark, sf_dir, "events").select("event_id", *walk.zoom_at(v, v, F.lit(2.0), v / 100, F.lit(50.0), F.lit(50.0)))
    return out.select("event_id", F.round("x", 9).alias("x"), F.round("zoom", 9).alias("zoom"))


@query("j09_hydrated", "SELECT vec_id AS id, label AS doc_id, vec_id / 2.0::DOUBLE AS distance FROM embeddings WHERE vec_id % 5 = 0")
def j09(spark, sf_dir):
    rows = records(spark, sf_dir).select("id", "doc_id")
    cached = rows.where("id % 5 = 0").select((F.col("id") / 2).alias("distance"), "id").unionByName(rows.select(F.lit(0.0).alias("distance"), (-F.col("id") - 1).alias("id")))
    return walk.hydrate(cached, rows).select("id", "doc_id", "distance")


@query("t11_random_chunk", "SELECT conv_id AS doc_id, conv_id || ':' || turn AS id FROM conversations WHERE conv_id = (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY md5(conv_id || '#7'), conv_id LIMIT 1) ORDER BY md5(conv_id || ':' || turn || '#7'), id LIMIT 1")
def t11(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat_ws(":", "conv_id", "turn").alias("id"))
    return walk.random_chunk(rows, 7).select("doc_id", "id")


_DRAW = "SELECT conv_id || ':' || turn AS id FROM {t} WHERE conv_id = (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM {t}) ORDER BY md5(conv_id || '#7'), conv_id LIMIT 1) ORDER BY md5(conv_id || ':' || turn || '#7'), id LIMIT 1"


@query("t12_another_chunk", f"WITH c AS ({_DRAW.format(t='conversations')}), o AS (SELECT * FROM conversations WHERE conv_id || ':' || turn <> (SELECT id FROM c)) {_DRAW.format(t='o')}")
def t12(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat_ws(":", "conv_id", "turn").alias("id"))
    current = walk.random_chunk(rows, 7).first()
    return walk.random_chunk(rows, 7, current and current["id"]).select("id")


# Change feeds over events: users are workspaces, event types operations, files are named after the event's number.


def _changes(spark, sf_dir):
    kind = F.col("event_type")
    op = F.when(kind == "signup", "create").when(kind == "error", "delete").when(kind == "purchase", "rename").when(kind == "click", "open").otherwise("modify")
    name = F.concat(F.lit("f"), (F.col("event_id") % 9).cast("string"), F.when(F.col("event_id") % 4 == 0, ".txt").otherwise(".md"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", op.alias("op"), name.alias("path"), F.when(op == "rename", F.concat(F.lit("old"), (F.col("event_id") % 5).cast("string"), F.when(F.col("event_id") % 3 == 0, ".MD").otherwise(".png"))).alias("old_path"))


_CHANGES = "(SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'rename' WHEN 'click' THEN 'open' ELSE 'modify' END AS op, 'f' || (event_id % 9) || CASE WHEN event_id % 4 = 0 THEN '.txt' ELSE '.md' END AS path, CASE WHEN event_type = 'purchase' THEN 'old' || (event_id % 5) || CASE WHEN event_id % 3 = 0 THEN '.MD' ELSE '.png' END END AS old_path FROM events)"


@query("r01_feed", f"SELECT event_id, op FROM {_CHANGES} WHERE op IN ('create', 'modify', 'delete') AND path LIKE '%.md' OR op = 'rename' AND (path LIKE '%.md' OR old_path LIKE '%.MD')")
def r01(spark, sf_dir):
    return changes.markdown_changes(_changes(spark, sf_dir)).select("event_id", "op")


@query("r03_released", f"WITH c AS {_CHANGES}, f AS (SELECT user_id, ts, event_id, path, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS until FROM c WHERE op = 'open'), m AS (SELECT c.event_id, c.ts, c.path, arg_max(struct_pack(p := f.path, u := f.until), f.ts) AS a FROM c LEFT JOIN f ON f.user_id = c.user_id AND f.ts <= c.ts WHERE c.op = 'modify' GROUP BY ALL) SELECT event_id, CASE WHEN a.p = path THEN a.u ELSE ts END AS released FROM m")
def r03(spark, sf_dir):
    rows = _changes(spark, sf_dir)
    focus = rows.where("op = 'open'").select("user_id", "ts", "path")
    return changes.released(rows.where("op = 'modify'").select("event_id", "user_id", "ts", "path"), focus, ["user_id"]).select("event_id", "released")


@query("r04_suppressed", "SELECT event_id FROM events WHERE ts > (SELECT min(ts) FROM events) + INTERVAL 14 SECONDS")
def r04(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    start = events.agg(F.min("ts").cast("timestamp").alias("start"))
    return changes.after_suppression(events.withColumn("ts", F.col("ts").cast("timestamp")).join(F.broadcast(start)), "ts", F.col("start"), 2000).select("event_id")


@query("r05_admitted", f"WITH c AS {_CHANGES}, n AS (SELECT user_id, path, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id), path) AS nth FROM c WHERE path NOT IN ('f1.md') GROUP BY user_id, path) SELECT event_id FROM c LEFT JOIN n USING (user_id, path) WHERE c.path = 'f1.md' OR nth + 1 <= 6")
def r05(spark, sf_dir):
    rows = _changes(spark, sf_dir)
    pending = rows.select("user_id").distinct().withColumn("path", F.lit("f1.md"))
    return changes.admitted(rows, pending, ["user_id"], order="event_id", most=6).select("event_id")


_STATE = "(SELECT doc_id, source || '/' || doc_id || '.md' AS path, n_chars::DOUBLE AS mtime, 3 AS chunk_count FROM documents)"


@query("r06_apply", f"SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'moved' ELSE path END AS path, CASE WHEN doc_id % 4 = 1 THEN mtime + 1 ELSE mtime END AS mtime, CASE WHEN doc_id % 4 = 1 THEN 0 ELSE 3 END AS chunk_count FROM {_STATE} WHERE doc_id % 4 <> 0")
def r06(spark, sf_dir):
    state = catalog._files(spark, sf_dir).withColumn("chunk_count", F.lit(3))
    n = F.col("doc_id") % 4
    fed = state.select("doc_id", F.when(n == 0, "delete").otherwise("modify").alias("op"), F.lit("moved").alias("path"), F.when(n == 1, F.col("mtime") + 1).when(n == 2, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"))
    return changes.apply_changes(state, fed).select("doc_id", "path", "mtime", "chunk_count")


@query("r07_renamed", f"SELECT CASE WHEN doc_id % 3 = 0 THEN 'new/' || path ELSE path END AS doc_id, path FROM {_STATE} WHERE doc_id % 3 <> 1")
def r07(spark, sf_dir):
    state = catalog._files(spark, sf_dir).select(F.col("path").alias("doc_id"), "path", F.col("doc_id").alias("n"))
    renames = state.where("n % 3 <> 2").select(F.col("doc_id").alias("old_path"), F.when(F.col("n") % 3 == 0, F.concat(F.lit("new/"), "path")).otherwise(F.concat("path", F.lit(".txt"))).alias("path"))
    after, gone, fresh = changes.renamed(state, renames)
    return after.select("doc_id", "path")


@query("r08_deleted", "SELECT doc_id FROM documents WHERE doc_id % 5 <> 2")
def r08(spark, sf_dir):
    state = catalog._files(spark, sf_dir)
    fed = state.where("doc_id % 5 = 2").select(F.lit("delete").alias("op"), F.col("doc_id").alias("path"))
    after, _, _ = changes.deleted(state, fed.select("path"), fed)
    return after.select("doc_id")


@query("r09_queue", "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 10 = 3 THEN 'failed' ELSE 'indexed' END AS status, CASE WHEN doc_id % 10 = 3 THEN 0 ELSE doc_id % 10 END::INT AS chunk_count FROM documents")
def r09(spark, sf_dir):
    def index(path: str) -> int:
        if path.endswith("3"):
            raise ValueError("a file that can't be read")
        return int(path) % 10

    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"))
    return changes.indexed(files, index)


@query("r10_cancelled", "SELECT doc_id::VARCHAR AS path, 'skipped' AS status, 0 AS chunk_count FROM documents")
def r10(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"))
    return changes.indexed(files, lambda path: 1, stopped=lambda: True)


@query("r13_unclean", "SELECT event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = 'error', false) AS unclean FROM events")
def r13(spark, sf_dir):
    sessions = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_id").alias("started_at"), F.when(F.col("event_type") == "error", "running").otherwise("ended").alias("status"))
    return changes.unclean_exits(sessions, ["user_id"]).select("event_id", "unclean")


@query("r14_streaks", "WITH h AS (SELECT event_id, user_id, sum((event_type IN ('error', 'view'))::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS hit FROM events), g AS (SELECT *, sum((NOT hit)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM h) SELECT event_id, (sum(hit::INT) OVER (PARTITION BY user_id, run ORDER BY event_id ROWS UNBOUNDED PRECEDING) + (run > 0)::INT)::BIGINT AS streak FROM g")
def r14(spark, sf_dir):
    exits = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("stage"))
    return changes.unclean_streaks(exits, ["user_id"], "event_id", ["error", "view"]).select("event_id", F.col("streak").cast("long").alias("streak"))


@query("w13_decisions", "SELECT event_id, recent >= 3 AS blocked, recent >= 2 AS safe_mode FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTES PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error')")
def w13(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("event_type = 'error'")
    return changes.exit_decisions(events, "event_type", "ts").select("event_id", "blocked", "safe_mode")


@query(
    "w13_blocks",
    """WITH t AS (SELECT user_id, ts, ts + INTERVAL 12 HOURS AS gone FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
m AS (SELECT user_id, moment, sum(step) AS step FROM (SELECT user_id, ts AS moment, 1 AS step FROM t UNION ALL SELECT user_id, gone, -1 FROM t) GROUP BY user_id, moment),
c AS (SELECT user_id, moment, sum(step) OVER (PARTITION BY user_id ORDER BY moment) >= 3 AS held FROM m),
d AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY user_id ORDER BY moment), false) AS was FROM c)
SELECT user_id AS key, CASE WHEN held THEN 'blocked' ELSE 'released' END AS change, moment FROM d WHERE held <> was""",
)
def w13_blocks(spark, sf_dir):
    """Users as hosts, their events as crashes, in half a day."""
    found = blocks.block_changes(table(spark, sf_dir, "events"), "user_id", "ts", 12 * 3600)
    return found.select("key", "change", F.col("at").cast("timestamp_ntz").alias("moment"))


@query("w14_exit_windows", "WITH RECURSIVE t AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (SELECT user_id, event_id, ts, i, ts AS first, 1 AS n FROM t WHERE i = 1 UNION ALL SELECT t.user_id, t.event_id, t.ts, t.i, CASE WHEN t.ts - f.first >= INTERVAL 12 HOURS THEN t.ts ELSE f.first END, CASE WHEN t.ts - f.first >= INTERVAL 12 HOURS THEN 1 ELSE f.n + 1 END FROM f JOIN t ON t.user_id = f.user_id AND t.i = f.i + 1) SELECT user_id AS key, ts, n::BIGINT AS count FROM f")
def w14(spark, sf_dir):
    return changes.exit_windows(table(spark, sf_dir, "events"), "user_id", "ts", 12 * 3600).select("key", F.col("ts").cast("timestamp_ntz").alias("ts"), "count")



@query("t13_budget", "WITH p AS (SELECT *, event_type = 'error' AND (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) AS protected, octet_length(encode(event_type)) + 10 AS size FROM events), r AS (SELECT *, CASE WHEN protected THEN 0 WHEN event_type IN ('view', 'click') THEN 2 ELSE 1 END AS rank FROM p), n AS (SELECT *, row_number() OVER w AS n, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS bytes FROM r WINDOW w AS (PARTITION BY user_id ORDER BY rank, ts DESC, event_id DESC)) SELECT event_id FROM n WHERE n <= 20 AND (bytes <= 200 OR n = 1 AND rank = 0)")
def t13(spark, sf_dir):
    events = changes.last_of_classes(table(spark, sf_dir, "events"), "user_id", "ts", [F.col("event_type") == "error"])
    low = F.col("event_type").isin("view", "click")
    return changes.trimmed(events, "user_id", "ts", F.col("protected"), 20, low=low, size=F.octet_length("event_type") + 10, budget=200).select("event_id")


@query("w12_nearest_gap", "SELECT user_id, count(*) AS ranges FROM (SELECT user_id, low, high, coalesce(low >= max(high) OVER (PARTITION BY user_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM (SELECT user_id, event_id % 500 AS low, event_id % 500 + 5 AS high FROM events)) WHERE new GROUP BY user_id")
def w12(spark, sf_dir):
    low = F.col("event_id") % 500
    ranges = table(spark, sf_dir, "events").select("user_id", low.alias("low"), (low + 5).alias("high"))
    return walk.merged_ranges(ranges, ["user_id"], touching=False).groupBy("user_id").agg(F.count("*").alias("ranges"))


@query("a08_queue_summary", "SELECT count(*) FILTER (WHERE doc_id % 10 <> 3) AS indexed, 0::BIGINT AS skipped, count(*) FILTER (WHERE doc_id % 10 = 3) AS failed, sum(CASE WHEN doc_id % 10 = 3 THEN 0 ELSE doc_id % 10 END)::BIGINT AS chunks FROM documents")
def a08(spark, sf_dir):
    return documents.index_summary(r09(spark, sf_dir))


# Users walk: the kind of an event is an action, its id names the nodes.

_ACTIONS = "SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'root' WHEN 'view' THEN 'expand' WHEN 'click' THEN 'focus' WHEN 'purchase' THEN 'collapse' ELSE 'link' END AS kind, 'n' || (event_id % 5) AS node, CASE WHEN event_type = 'view' THEN ['n' || (event_id % 11), 'n' || (event_id % 13)] ELSE ['n' || (event_id % 19)] END AS targets FROM events"
_FOLD = f"""
WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM ({_ACTIONS})),
f AS (
  SELECT user_id, 0::BIGINT AS n, NULL::VARCHAR AS root, NULL::VARCHAR AS focus, []::VARCHAR[] AS nodes, []::VARCHAR[] AS edges, []::VARCHAR[] AS visited, []::VARCHAR[] AS collapsed FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, n, CASE WHEN kind = 'root' THEN node ELSE root END, CASE WHEN kind = 'root' OR kind = 'focus' AND there THEN node ELSE focus END,
    CASE WHEN kind = 'root' THEN [node] WHEN kind IN ('expand', 'link') AND there THEN nodes || list_filter(list_distinct(targets), lambda t: t <> node AND NOT list_contains(nodes, t)) ELSE nodes END,
    CASE WHEN kind = 'root' THEN [] WHEN kind = 'expand' AND there THEN list_distinct(edges || list_transform(list_filter(targets, lambda t: t <> node), lambda t: node || '>' || t))
      WHEN kind = 'link' AND there AND NOT list_contains(nodes, targets[1]) THEN edges || [node || '>' || targets[1]] ELSE edges END,
    CASE WHEN kind = 'root' THEN [node] WHEN kind = 'focus' AND there AND NOT list_contains(visited, node) THEN visited || [node] ELSE visited END,
    CASE WHEN kind = 'root' THEN [] WHEN kind = 'expand' AND there THEN list_filter(collapsed, lambda c: c <> node) WHEN kind = 'collapse' AND there THEN list_distinct(collapsed || [node]) ELSE collapsed END
  FROM (SELECT a.*, root, focus, nodes, edges, visited, collapsed, list_contains(nodes, node) AS there FROM f JOIN a ON a.user_id = f.user_id AND a.n = f.n + 1))
SELECT user_id::VARCHAR AS session, root, focus, array_to_string(list_sort(nodes), ',') AS nodes, array_to_string(list_sort(edges), ',') AS edges, array_to_string(visited, ',') AS visited, array_to_string(list_sort(collapsed), ',') AS collapsed
FROM f QUALIFY n = max(n) OVER (PARTITION BY user_id)
"""


@query("r16_sessions", _FOLD)
def r16(spark, sf_dir):
    """The last state of every user's walk, all actions of the log folded."""
    name = lambda n: F.concat(F.lit("n"), (F.col("event_id") % n).cast("string"))
    kind = F.when(F.col("event_type") == "signup", "root").when(F.col("event_type") == "view", "expand").when(F.col("event_type") == "click", "focus").when(F.col("event_type") == "purchase", "collapse").otherwise("link")
    targets = F.when(F.col("event_type") == "view", F.array(name(11), name(13))).otherwise(F.array(name(19)))
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("step"), kind.alias("kind"), name(5).alias("node"), targets.alias("targets"), F.lit(None).cast("string").alias("value"))
    joined = lambda c: F.array_join(c, ",")
    edges = F.transform("edges", lambda e: F.concat(e["source"], F.lit(">"), e["target"]))
    collapsed = F.transform(F.filter("nodes", lambda n: n["collapsed"]), lambda n: n["node"])
    return sessions.session_states(log).select("session", "root", "focus", joined(F.array_sort(F.transform("nodes", lambda n: n["node"]))).alias("nodes"), joined(F.array_sort(edges)).alias("edges"), joined("visited").alias("visited"), joined(F.array_sort(collapsed)).alias("collapsed"))


@query("r03_live_feed")
def r03_feed(spark, sf_dir):
    """The feed of every user's events: clicks move the focus, errors delete, all others change a file. A fold with timers; tests
    compare it with a plain version and its stream."""
    click = F.col("event_type") == "click"
    path = F.concat(F.lit("f"), (F.col("event_id") % 9).cast("string"), F.lit(".md"))
    op = F.when(F.col("event_type") == "error", "delete").when(~click, "modify")
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("workspace"), "ts", F.when(click, "focus").otherwise("change").alias("kind"), path.alias("path"), op.alias("op"), F.col("value").alias("mtime"))
    return feed.released_changes(log)

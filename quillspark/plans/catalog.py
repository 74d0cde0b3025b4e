"""Named queries over the driver's tables, each with DuckDB SQL where SQL can express it.

embeddings stand for chunk records: vec_id is id and seq, label the document. conversations stand for chunk metadata,
documents for notes with the path source/doc_id.md, events for a change feed, orders for capacity plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.functions import vector as V
from quillspark.operators import chunking, documents, pivots, search, walk
from quillspark.sources.scratch import scratch_folder

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), F.col("label").alias("doc_id"), F.concat(F.lit("note-"), F.col("label").cast("string"), F.lit(".md")).alias("path"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The vector of a record; the smallest id if it has gone."""
    row = table(spark, sf_dir, "embeddings").orderBy((F.col("vec_id") != vec_id).cast("int"), "vec_id").select("embedding").first()
    return list(row["embedding"]) if row else [0.0]


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("document"))


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.col("conv_id").alias("doc_id"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), (1000 + F.col("conv_id")).cast("double").alias("mtime"),
        F.col("turn").cast("int").alias("chunk_index"), F.count("*").over(Window.partitionBy("conv_id")).cast("int").alias("chunk_count"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text",
    )


_L2 = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
_Q0 = "(SELECT embedding FROM embeddings ORDER BY (vec_id <> 0)::INT, vec_id LIMIT 1) q"
_CHUNKS = "(SELECT conv_id AS doc_id, 'conv/' || conv_id || '.md' AS path, (1000 + conv_id)::DOUBLE AS mtime, turn::INT AS chunk_index, count(*) OVER (PARTITION BY conv_id)::INT AS chunk_count, conv_id * 1000 + turn AS seq, text FROM conversations)"
_FILES = "(SELECT doc_id, source || '/' || doc_id || '.md' AS path, n_chars::DOUBLE AS mtime FROM documents)"


@query("t01_knn_l2", f"SELECT vec_id AS id, label AS doc_id, round({_L2}, 6) AS distance FROM embeddings e, {_Q0} ORDER BY {_L2}, vec_id LIMIT 10")
def t01(spark, sf_dir):
    found = search.nearest(records(spark, sf_dir), query_vector(spark, sf_dir), 10)
    return found.select("id", "doc_id", F.round("distance", 6).alias("distance"))


@query(
    "w01_knn_batch",
    f"""SELECT query_id, seq, rank, round(distance, 6) AS distance FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS seq, {_L2} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_L2}, e.vec_id) AS rank
  FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 10""",
)
def w01(spark, sf_dir):
    rows = records(spark, sf_dir)
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    return search.nearest_batch(rows, asked, 10).select("query_id", "seq", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query(
    "t02_pruned_scan",
    f"""SELECT query_id, seq, rank, round(distance, 6) AS distance FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS seq, {_L2} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_L2}, e.vec_id) AS rank
  FROM embeddings e, (SELECT vec_id, embedding FROM embeddings ORDER BY vec_id LIMIT 16) q) WHERE rank <= 10""",
)
def t02(spark, sf_dir):
    """A request of sixteen vectors against all records, filed around centres."""
    rows = records(spark, sf_dir)
    asked = [(r.id, list(r.embedding)) for r in rows.orderBy("id").select("id", "embedding").limit(16).collect()]
    index = pivots.PivotIndex.build(rows, scratch_folder(spark, "pivots"))
    return index.nearest(asked, 10).select("query_id", "seq", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query("m03_cosine", f"SELECT e.vec_id AS id, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS cosine FROM embeddings e, {_Q0}")
def m03(spark, sf_dir):
    return records(spark, sf_dir).select("id", F.round(V.cosine(F.col("embedding"), V.literal(query_vector(spark, sf_dir))), 6).alias("cosine"))


@query("f09_knn_filtered", f"SELECT vec_id AS id, round({_L2}, 6) AS distance FROM embeddings e, {_Q0} WHERE label NOT IN (3, 7) AND vec_id NOT IN (0, 5) ORDER BY {_L2}, vec_id LIMIT 10")
def f09(spark, sf_dir):
    rows = search.visible(records(spark, sf_dir), muted=["note-3.md"], excluded=["note-7.md"], chunk_ids=[0, 5])
    return search.nearest(rows, query_vector(spark, sf_dir), 10).select("id", F.round("distance", 6).alias("distance"))


_POOL = f"pool AS (SELECT vec_id AS id, label AS doc_id, {_L2} AS d FROM embeddings e, {_Q0} WHERE vec_id <> 0 ORDER BY d, vec_id LIMIT 40)"
_CHOSEN = "chosen AS (SELECT *, row_number() OVER (ORDER BY d, id) AS position FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d, id) AS n FROM pool) WHERE n <= 2 QUALIFY position <= 8)"


@query("w04_related_bands", f"WITH {_POOL}, {_CHOSEN} SELECT id, doc_id, position, round(d, 6) AS distance, CASE WHEN position <= ceil(count(*) OVER () * 0.25) THEN 'strong' WHEN position > count(*) OVER () - ceil(count(*) OVER () * 0.25) THEN 'exploratory' ELSE 'related' END AS band FROM chosen")
def w04(spark, sf_dir):
    found = walk.related(records(spark, sf_dir), 0)
    return found.select("id", "doc_id", F.col("position").cast("long").alias("position"), F.round("distance", 6).alias("distance"), "band")


_BM25_TERMS = ("tion", "the", "ein")


def _bm25_sql(terms) -> str:
    tf = ", ".join(f"(len(string_split(lower(text), '{t}')) - 1)::DOUBLE AS f{i}" for i, t in enumerate(terms))
    idf = lambda i: f"CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END"
    part = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / a))" for i in range(len(terms)))
    stats = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(terms)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"WITH r AS (SELECT doc_id, greatest(length(text) - 2, 0)::DOUBLE AS dl, {tf} FROM documents WHERE text IS NOT NULL), s AS (SELECT count(*) AS n, avg(dl) AS a, {stats} FROM r) SELECT doc_id AS id, round(-({part}), 6) AS score FROM r, s WHERE {some}"


@query("a07_bm25", _bm25_sql(_BM25_TERMS))
def a07(spark, sf_dir):
    return search.bm25(notes(spark, sf_dir), _BM25_TERMS).select("id", F.round("score", 6).alias("score"))


@query("t03_bm25_topn", f"SELECT * FROM ({_bm25_sql(_BM25_TERMS)}) ORDER BY score, id LIMIT 20")
def t03(spark, sf_dir):
    rows = search.bm25(notes(spark, sf_dir), _BM25_TERMS).select("id", F.round("score", 6).alias("score"))
    return rows.orderBy("score", "id").limit(20)


@query("a05_short_terms", "WITH h AS (SELECT * FROM (SELECT doc_id, 0 AS t FROM documents WHERE contains(text, 'ß') ORDER BY doc_id LIMIT 50) UNION ALL SELECT * FROM (SELECT doc_id, 1 FROM documents WHERE contains(text, 'ñ') ORDER BY doc_id LIMIT 50)) SELECT doc_id AS id, count(*)::INT AS hits, row_number() OVER (ORDER BY count(*) DESC, min(t), doc_id)::INT AS rank FROM h GROUP BY doc_id")
def a05(spark, sf_dir):
    return search.short_term_hits(notes(spark, sf_dir), ["ß", "ñ"], 50).select("id", "hits", "rank")


_RRF_LISTS = "l AS (SELECT doc_id AS id, 0 AS list, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, 1.0 AS w FROM documents QUALIFY rank <= 100 UNION ALL SELECT doc_id, 1, row_number() OVER (ORDER BY n_chars % 1000, doc_id) AS rank, 2.0 FROM documents QUALIFY rank <= 100)"


@query("a06_rrf", f"WITH {_RRF_LISTS}, s AS (SELECT id, sum(w / (60 + rank)) AS fused, min((list, rank)) AS f FROM l GROUP BY id) SELECT id, round(fused, 9) AS fused_score, row_number() OVER (ORDER BY round(fused, 12) DESC, f)::INT AS position FROM s")
def a06(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    ranked = lambda *order: docs.orderBy(*order).limit(100).select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"))
    fused = search.fuse([(ranked(F.desc("n_chars"), "id"), 1.0), (docs.withColumn("m", F.col("n_chars") % 1000).orderBy("m", "id").limit(100).select("id", F.row_number().over(Window.orderBy("m", "id")).alias("rank")), 2.0)])
    return fused.select("id", F.round("fused_score", 9).alias("fused_score"), "position")


@query("s19_search_result", f"SELECT row_number() OVER (ORDER BY {_L2}, vec_id)::INT AS rank, 'Untitled' AS title, 'note-' || label || '.md' AS path, round(1 - {_L2} / 2, 4) AS similarity FROM embeddings e, {_Q0} QUALIFY rank <= 5")
def s19(spark, sf_dir):
    found = search.nearest(records(spark, sf_dir), query_vector(spark, sf_dir), 5)
    return found.select(F.row_number().over(Window.orderBy("distance", "seq")).alias("rank"), F.lit("Untitled").alias("title"), "path", F.round(V.similarity(F.col("distance")), 4).alias("similarity"))


@query("s21_index_status", "SELECT count(*) AS chunks, count(DISTINCT conv_id) AS documents FROM conversations")
def s21(spark, sf_dir):
    return chunk_rows(spark, sf_dir).agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"))


@query("f01_get_ids", "SELECT vec_id AS id, label AS doc_id FROM embeddings WHERE vec_id IN (1, 17, 42, 100000000)")
def f01(spark, sf_dir):
    return records(spark, sf_dir).where(F.col("id").isin(1, 17, 42, 100000000)).select("id", "doc_id")


@query("f02_get_document", "SELECT vec_id AS id FROM embeddings WHERE label = 3")
def f02(spark, sf_dir):
    return records(spark, sf_dir).where("doc_id = 3").select("id")


@query("f03_metadata_equality", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS value FROM events WHERE json_type(props, '$.' || json_keys(props)[1]) IN ('BIGINT', 'UBIGINT')")
def f03(spark, sf_dir):
    """Type-strict access to open metadata: rows whose first key holds an integer."""
    ev = table(spark, sf_dir, "events").withColumn("v", F.parse_json("props")).withColumn("k", F.get(F.json_object_keys("props"), F.lit(0)))
    kinds = F.regexp_extract(F.schema_of_variant("v"), r"OBJECT<`?(\w+)`?: (\w+)", 2)
    return ev.where(kinds == "BIGINT").select("event_id", F.expr("variant_get(v, concat('$.', k), 'string')").alias("value"))


@query("f07_excluded_paths", f"SELECT doc_id, path FROM {_FILES} WHERE NOT (path = 'src1' OR starts_with(path, 'src1/') OR path = 'src7' OR starts_with(path, 'src7/'))")
def f07(spark, sf_dir):
    return notes(spark, sf_dir).where(~T.is_excluded(F.col("path"), ["src1", "src7"])).select("doc_id", "path")


@query("f13_size_gates", "SELECT doc_id, CASE WHEN octet_length(encode(text)) > 45000 THEN 'file too large' WHEN length(text) > 15000 THEN 'text too long' END AS reason FROM documents")
def f13(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunking.skip_reason(F.octet_length("text"), F.col("text")).alias("reason"))


@query("f17_relative_path", "SELECT page_id, CASE WHEN NOT (p = '' OR length(p) > 1024 OR starts_with(p, '/') OR list_has_any(string_split(p, '/'), ['', '.', '..'])) THEN p END AS path FROM (SELECT page_id, regexp_extract(url, '://[^/]*/?(.*)$', 1) AS p FROM pages)")
def f17(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.relative_path(F.regexp_extract("url", "://[^/]*/?(.*)$", 1)).alias("path"))


@query("t06_page", "SELECT vec_id AS id FROM embeddings ORDER BY vec_id LIMIT 25 OFFSET 50")
def t06(spark, sf_dir):
    return records(spark, sf_dir).orderBy("seq").offset(50).limit(25).select("id")


@query("t07_recent", f"SELECT path, mtime FROM {_FILES} ORDER BY mtime DESC, path LIMIT 30")
def t07(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("n_chars").cast("double").alias("mtime"))
    return files.orderBy(F.desc("mtime"), "path").limit(30)


@query("a01_count", "SELECT label AS collection, count(*) AS n FROM embeddings GROUP BY label")
def a01(spark, sf_dir):
    return records(spark, sf_dir).groupBy(F.col("doc_id").alias("collection")).agg(F.count("*").alias("n"))


@query("a02_document_entries", f"SELECT doc_id, arg_min(path, seq) AS path, max(mtime) AS mtime, count(*) AS chunk_count, bool_or(chunk_index IS NULL) AS needs_reindex FROM {_CHUNKS} GROUP BY doc_id")
def a02(spark, sf_dir):
    return documents.document_entries(chunk_rows(spark, sf_dir)).drop("first_seq")


@query("a03_migrated_evidence", f"SELECT doc_id, min(path) AS path, max(mtime) AS mtime, count(*) AS chunk_count, count(*) = max(chunk_count) AND count(DISTINCT chunk_index) = count(*) AND min(chunk_index) >= 0 AND max(chunk_index) < max(chunk_count) AS complete FROM {_CHUNKS} GROUP BY doc_id")
def a03(spark, sf_dir):
    return documents.migrated_evidence(chunk_rows(spark, sf_dir))


@query("a04_distinct_documents", "SELECT DISTINCT conv_id AS doc_id FROM conversations")
def a04(spark, sf_dir):
    return chunk_rows(spark, sf_dir).select("doc_id").distinct()


@query("a08_index_summary", "SELECT count(*) FILTER (WHERE s = 'indexed') AS indexed, count(*) FILTER (WHERE s = 'skipped') AS skipped, count(*) FILTER (WHERE s = 'failed') AS failed, sum(c)::BIGINT AS chunks FROM (SELECT CASE WHEN n_chars > 15000 THEN 'skipped' WHEN n_chars < 10 THEN 'failed' ELSE 'indexed' END AS s, n_chars // 900 AS c FROM documents)")
def a08(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    status = F.when(F.col("n_chars") > 15000, "skipped").when(F.col("n_chars") < 10, "failed").otherwise("indexed")
    return documents.index_summary(docs.select(status.alias("status"), F.floor(F.col("n_chars") / 900).alias("chunk_count")))


@query("a09_percentile", "SELECT conv_id, round(quantile_cont(length(text), 0.9), 6) AS p90 FROM conversations GROUP BY conv_id")
def a09(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.round(F.percentile(F.length("text"), 0.9), 6).alias("p90"))


@query("a10_distance_range", f"SELECT label AS doc_id, printf('%.4f..%.4f', min({_L2}), max({_L2})) AS span FROM embeddings e, {_Q0} GROUP BY label")
def a10(spark, sf_dir):
    d = V.squared_l2(F.col("embedding"), V.literal(query_vector(spark, sf_dir)))
    return records(spark, sf_dir).select("doc_id", d.alias("d")).groupBy("doc_id").agg(F.format_string("%.4f..%.4f", F.min("d"), F.max("d")).alias("span"))


@query("a15_recall_mrr", f"WITH r AS (SELECT q.vec_id AS query_id, q.label AS category, e.label = q.label AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_L2}, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id QUALIFY rank <= 10), m AS (SELECT query_id, category, count(*) FILTER (WHERE hit) / 10 AS recall, coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE hit), 0) AS rr FROM r GROUP BY ALL) SELECT coalesce(category::VARCHAR, 'all') AS category, round(avg(recall), 3) AS recall, round(avg(rr), 3) AS mrr, count(*) AS n FROM m GROUP BY ROLLUP (category)")
def a15(spark, sf_dir):
    rows = records(spark, sf_dir)
    labels = rows.select("seq", F.col("doc_id").alias("found"))
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding", F.col("doc_id").alias("category"))
    near = search.nearest_batch(rows, asked, 11).where("query_id <> seq")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("rank <= 10").join(labels, "seq").join(asked.select("query_id", "category"), "query_id")
    return documents.retrieval_metrics(near.select("query_id", "category", F.lit(10).alias("relevant"), F.when(F.col("found") == F.col("category"), F.col("rank")).alias("rank")), 10)


@query("a16_cjk_ratio", "SELECT lang, round(sum(c) / (sum(c) + sum(l) / 4), 6) AS ratio FROM (SELECT lang, len(regexp_extract_all(text, '[一-鿿]')) AS c, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents) GROUP BY lang HAVING sum(c) + sum(l) / 4 >= 200")
def a16(spark, sf_dir):
    cjk, latin = T.script_counts(F.col("text"))
    sums = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(cjk).alias("c"), F.sum(latin).alias("l"))
    return sums.where(F.col("c") + F.col("l") / 4 >= 200).select("lang", F.round(F.col("c") / (F.col("c") + F.col("l") / 4), 6).alias("ratio"))


@query("d05_delete_document", "SELECT vec_id AS id, label AS doc_id FROM embeddings WHERE label NOT IN (2, 4)")
def d05(spark, sf_dir):
    from quillspark.sources import store

    gone = records(spark, sf_dir).select("doc_id").where("doc_id IN (2, 4)").distinct()
    return store.without_documents(records(spark, sf_dir), gone).select("id", "doc_id")


_STATE = "(SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'old/' || doc_id ELSE path END AS path, CASE WHEN doc_id % 5 = 0 THEN mtime - 1 ELSE mtime END AS mtime, 3 AS chunk_count FROM " + _FILES + " WHERE doc_id % 3 <> 0)"


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("n_chars").cast("double").alias("mtime"))


def _state(spark, sf_dir):
    path = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("old/"), F.col("doc_id").cast("string"))).otherwise(F.col("path"))
    mtime = F.when(F.col("doc_id") % 5 == 0, F.col("mtime") - 1).otherwise(F.col("mtime"))
    return _files(spark, sf_dir).where(F.col("doc_id") % 3 != 0).select("doc_id", path.alias("path"), mtime.alias("mtime"), F.lit(3).alias("chunk_count"))


@query("j05_file_status", f"SELECT f.doc_id, CASE WHEN s.doc_id IS NULL THEN 'unindexed' WHEN s.mtime < f.mtime OR s.path <> f.path THEN 'outdated' ELSE 'indexed' END AS status FROM {_FILES} f LEFT JOIN {_STATE} s ON f.doc_id = s.doc_id")
def j05(spark, sf_dir):
    return documents.file_status(_files(spark, sf_dir), _state(spark, sf_dir)).select("doc_id", "status")


@query("j07_verify", f"WITH f AS (SELECT *, doc_id % 4 AS chunk_count FROM {_FILES}), v AS (SELECT f.doc_id, CASE WHEN f.doc_id % 13 = 0 THEN 'no state' WHEN f.doc_id % 17 = 0 THEN 'state differs' WHEN chunk_count > 0 AND f.doc_id % 19 = 0 THEN 'not stored' WHEN chunk_count > 0 AND f.doc_id % 23 = 0 THEN 'store differs' END AS violation FROM f) SELECT * FROM v WHERE violation IS NOT NULL")
def j07(spark, sf_dir):
    selected = _files(spark, sf_dir).withColumn("chunk_count", F.col("doc_id") % 4)
    state = selected.where("doc_id % 13 <> 0").withColumn("mtime", F.when(F.col("doc_id") % 17 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))
    stored = selected.where("chunk_count > 0 AND doc_id % 19 <> 0").withColumn("path", F.when(F.col("doc_id") % 23 == 0, F.lit("moved")).otherwise(F.col("path")))
    return documents.verify(selected, state, stored)


@query("w06_lead_distance", "SELECT vec_id AS id, round(1 - list_sum(list_transform(list_zip(embedding, n), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(n, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS distance FROM (SELECT *, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n IS NOT NULL")
def w06(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("n", F.lead("embedding").over(Window.partitionBy("doc_id").orderBy("seq"))).where("n IS NOT NULL")
    return rows.select("id", F.round(1 - V.cosine(F.col("embedding"), F.col("n")), 6).alias("distance"))


@query("w05_numbering", "SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index, count(*) OVER (PARTITION BY conv_id)::INT AS chunk_count, conv_id || '::chunk-' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS id FROM conversations")
def w05(spark, sf_dir):
    pieces = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    return documents.numbered_chunks(pieces).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_count", "id")


@query("w07_capacity_plan", "SELECT o_orderkey, o_orderpriority = '5-LOW' OR sum((o_orderpriority <> '5-LOW')::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) <= 5 AS allowed FROM orders")
def w07(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("position"), (F.col("o_orderpriority") != "5-LOW").alias("counts"))
    return documents.capacity_plan(rows, indexed=2495, limit=2500, keys=["o_custkey"]).select("o_orderkey", "allowed")


@query("w08_dedupe_paths", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang, n_chars ORDER BY source || '/' || doc_id || '.md', n_chars DESC) = 1")
def w08(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("n_chars").alias("mtime"))
    return documents.first_by_path(files, F.struct("source", "lang", "n_chars")).select("doc_id")


@query("w12_merge_ranges", "WITH r AS (SELECT user_id, event_id, epoch_us(ts) AS low, epoch_us(ts) + 3600000000 AS high FROM events), m AS (SELECT *, coalesce(low > max(high) OVER (PARTITION BY user_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM r), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT user_id, min(low) AS low, max(high) AS high, count(*) AS n FROM i GROUP BY user_id, island")
def w12(spark, sf_dir):
    low = F.unix_micros(F.col("ts").cast("timestamp"))
    return walk.merged_ranges(table(spark, sf_dir, "events").select("user_id", low.alias("low"), (low + 3600000000).alias("high")), ["user_id"])


@query("w13_sliding_exits", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTES PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error'")
def w13(spark, sf_dir):
    from quillspark.streaming import changes

    return changes.recent_counts(table(spark, sf_dir, "events").where("event_type = 'error'"), "user_id", "ts", 600).select("event_id", "recent")


@query("r02_debounce", "WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 3600 SECONDS, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g) SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM s GROUP BY user_id, burst")
def r02(spark, sf_dir):
    from quillspark.streaming import changes

    return changes.debounced(table(spark, sf_dir, "events"), "user_id", "ts", 3600).select("user_id", "event_id", "n")


@query("t13_trim_events", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'error') DESC, ts DESC, event_id DESC) <= 20")
def t13(spark, sf_dir):
    from quillspark.streaming import changes

    return changes.trimmed(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "error", 20).select("event_id")


@query("w09_last_protected", "SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type IN ('error', 'signup') GROUP BY event_type")
def w09(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup"))
    return rows.groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("x17_first_line", "SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS line FROM documents")
def x17(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_line(F.col("text")).alias("line"))


@query("x26_preview", "SELECT doc_id, left(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), 160) AS preview FROM documents")
def x26(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse(F.col("text"), 160).alias("preview"))

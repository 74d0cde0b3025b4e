"""Queries of the store, the keyword index, index state, change feeds and imports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators import documents, keyword, search, walk
from quillspark.plans import catalog
from quillspark.plans.catalog import _L2, _bm25_sql, notes, query, query_vector, records, table
from quillspark.sources.scratch import scratch_folder
from quillspark.streaming import store_changes

_FILES = catalog._FILES
_XOR = "lower(" + " || ".join(f"printf('%08x', coalesce(bit_xor(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT), 0))" for i in range(8)) + ")"


@query("a13_xor_digest", f"SELECT {_XOR} AS digest, count(*) AS n FROM (SELECT sha256(doc_id::VARCHAR) AS h FROM documents)")
def a13(spark, sf_dir):
    return documents.xor_digest(table(spark, sf_dir, "documents"), "doc_id")


@query("a14_selection_digest", f"""SELECT {_XOR} AS digest, count(*) AS n FROM (SELECT sha256('{{"doc_id":' || doc_id || ',"path":"' || path || '","mtime":' || n || '.0}}') AS h FROM (SELECT doc_id, source || '/' || doc_id || '.md' AS path, n_chars AS n FROM documents WHERE n_chars < 1000000))""")
def a14(spark, sf_dir):
    return documents.selection_digest(catalog._files(spark, sf_dir).where("mtime < 1000000"))


@query("a19_source_identity", f"SELECT count(*) AS files, sum(l)::BIGINT AS bytes, max(m) AS newest, {_XOR} AS digest FROM (SELECT n_chars AS l, page_id AS m, sha256(url || chr(0) || n_chars || chr(0) || page_id) AS h FROM (SELECT *, octet_length(encode(html)) AS n_chars FROM pages))")
def a19(spark, sf_dir):
    return documents.source_identity(table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.octet_length("html").alias("length"), F.col("page_id").alias("mtime")))


@query("a20_chunk_totals", "SELECT (SELECT sum(turns)::BIGINT FROM c) AS expected, (SELECT count(*) FROM conversations) AS stored, (SELECT count(*) FROM c) AS documents, true AS equal FROM (SELECT 1) x".replace("SELECT (SELECT sum", "WITH c AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id) SELECT (SELECT sum", 1))
def a20(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return documents.chunk_totals(turns.groupBy("conv_id").agg(F.count("*").alias("chunk_count")), turns)


@query("a18_selected_pages", "SELECT count(DISTINCT doc_id) AS pages FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 1")
def a18(spark, sf_dir):
    items = catalog._files(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 4 == 1, F.concat("path", F.lit(".canvas"))).otherwise(F.upper("path")).alias("path"))
    return documents.selected_pages(items.select(F.col("doc_id").alias("id"), F.lit("file").alias("type"), "path", (F.col("doc_id") % 3 != 0).alias("checked")))


@query("a22_run_agreement", "SELECT avg(o_totalprice) AS avg_ms, avg(CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE) AS agreement FROM (SELECT o_orderkey, round(o_totalprice)::DOUBLE AS o_totalprice FROM orders)")
def a22(spark, sf_dir):
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(F.round("o_totalprice").alias("ms"), F.array(k, k + 1).alias("expected"), F.array(k, F.when(k % 4 == 0, k).otherwise(k + 1)).alias("found"))
    return documents.run_agreement(runs).select("avg_ms", "agreement")


@query("a24_evidence", "SELECT true AS completed, false AS other")
def a24(spark, sf_dir):
    selected = catalog._files(spark, sf_dir).withColumn("chunk_count", F.lit(2))
    digest = documents.selection_digest(selected).first()["digest"]
    made = (documents.is_evidence(selected, selected, selected, digest), documents.is_evidence(selected, selected, selected.where("doc_id > 0"), digest))
    return spark.createDataFrame([made], "completed boolean, other boolean")


@query("w10_systematic_sample", "SELECT i AS position, vec_id AS id FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings) WHERE i % greatest(1, n // 7) = 0 OR i = n - 1 ORDER BY i LIMIT 8")
def w10(spark, sf_dir):
    from quillspark.sources.store import numbered

    return documents.systematic_sample(numbered(records(spark, sf_dir).select("id"), "id", 0, "position"), "position").select("position", "id")


@query("w15_packed", "WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn, length(text) AS s FROM conversations), p AS (SELECT conv_id, i, turn, s, 0 AS batch, 1 AS n, s AS chars FROM t WHERE i = 1 UNION ALL SELECT t.conv_id, t.i, t.turn, t.s, p.batch + (p.n = 4 OR p.chars + t.s > 1800)::INT, CASE WHEN p.n = 4 OR p.chars + t.s > 1800 THEN 1 ELSE p.n + 1 END, CASE WHEN p.n = 4 OR p.chars + t.s > 1800 THEN t.s ELSE p.chars + t.s END FROM p JOIN t ON t.conv_id = p.conv_id AND t.i = p.i + 1) SELECT conv_id, turn AS position, batch FROM p")
def w15(spark, sf_dir):
    texts = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("position"), F.length("text").alias("size"))
    return documents.packed(texts, ["conv_id"]).select("conv_id", "position", "batch")


@query("d15_import_plan", "SELECT CASE i WHEN 0 THEN 'active' ELSE 'older' END || '-' || s AS collection, i = 0 AS required FROM (SELECT DISTINCT source AS s FROM documents), (SELECT unnest([0, 1]) AS i)")
def d15(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(g).alias("generation"), F.lit(n).alias("name")) for r, g, n in (("active", "v2", "active-"), ("previous", "v2", "active-"), ("pending", "v2", "older-"), ("previous", "v1", "old-"), ("pending", "v2", "?"))]))
    return documents.import_plan(sources.select("source", roles.alias("r")).select("r.role", "r.generation", F.concat("r.name", "source").alias("collection")))


@query("s11_batches", "SELECT vec_id AS id, 'text ' || vec_id AS document FROM embeddings")
def s11(spark, sf_dir):
    from quillspark.sources import connect as C

    rows = records(spark, sf_dir).select("doc_id", F.col("id").alias("ids"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("documents"), "embedding")
    packed = rows.groupBy("doc_id").agg(F.array(F.collect_list("ids")).alias("ids"), F.array(F.collect_list("documents")).alias("documents"), F.array(F.collect_list("embedding")).alias("embeddings"))
    return C.unpack_batches(packed.drop("doc_id")).select(F.col("ids").alias("id"), F.col("documents").alias("document"))


@query("s13_duplicate_keys", "SELECT lang || '/' || (n_chars % 50) AS doc_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def s13(spark, sf_dir):
    from quillspark.functions import text as T
    from quillspark.sources import connect as C

    keys = table(spark, sf_dir, "documents").select(T.normalize_path(F.concat("lang", F.when(F.col("doc_id") % 2 == 0, "/").otherwise("\\"), (F.col("n_chars") % 50).cast("string"))).alias("doc_id"))
    return C.duplicates(keys, "doc_id")


@query("s14_legacy_state", "SELECT source AS doc_id, max(n_chars)::DOUBLE AS mtime FROM documents GROUP BY source")
def s14(spark, sf_dir):
    state = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("::"), F.col("doc_id").cast("string")).alias("doc_id"), F.col("source").alias("path"), F.col("n_chars").cast("double").alias("mtime"), F.lit(1).alias("chunk_count"))
    return documents.upgrade_legacy_state(state).select("doc_id", "mtime")


@query("s15_recover", f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE path END AS path, CASE WHEN doc_id % 4 = 0 THEN mtime + 5 ELSE mtime END AS mtime FROM {_FILES}")
def s15(spark, sf_dir):
    state = catalog._files(spark, sf_dir).withColumn("chunk_count", F.lit(3))
    newer = F.col("doc_id") % 4 == 0
    entries = state.select("doc_id", F.when(newer, "new").otherwise("other").alias("path"), F.when(newer, F.col("mtime") + 5).otherwise(F.col("mtime")).alias("mtime"), F.lit(2).alias("chunk_count"))
    return documents.recover_state(state, entries).select("doc_id", "path", "mtime")


@query("s24_manifest", "SELECT page_id, page_id % 5 <> 0 AS current FROM pages WHERE html IS NOT NULL")
def s24(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where("html IS NOT NULL").select(F.col("page_id").alias("path"), F.col("html").cast("binary").alias("content"))
    manifest = pages.select("path", F.octet_length("content").alias("length"), F.when(F.col("path") % 5 == 0, "0").otherwise(F.sha2("content", 256)).alias("sha256"))
    return documents.manifest_status(pages.withColumn("length", F.octet_length("content")), manifest).select(F.col("path").alias("page_id"), "current")


@query("s25_hosts", "SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END NULLS LAST, s_suppkey)::INT AS rank FROM supplier")
def s25(spark, sf_dir):
    hosts = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("latency"), F.col("s_suppkey").alias("position"))
    return documents.by_latency(hosts).select("s_suppkey", F.row_number().over(Window.orderBy(F.col("latency").asc_nulls_last(), "position")).alias("rank"))


@query("f19_path_filter", "SELECT doc_id FROM documents WHERE contains(lower(source || '/' || doc_id || '.md'), 'src1/1')")
def f19(spark, sf_dir):
    return documents.matching_paths(catalog._files(spark, sf_dir), "SRC1/1").select("doc_id")


@query("f21_to_index", f"SELECT f.doc_id, CASE WHEN s.doc_id IS NULL THEN 'unindexed' ELSE 'outdated' END AS status FROM {_FILES} f LEFT JOIN {catalog._STATE} s ON f.doc_id = s.doc_id WHERE s.doc_id IS NULL OR s.mtime < f.mtime OR s.path <> f.path")
def f21(spark, sf_dir):
    return documents.to_index(catalog._files(spark, sf_dir), catalog._state(spark, sf_dir)).select("doc_id", "status")


@query("f22_muted", "SELECT doc_id, doc_id % 6 = 0 OR doc_id % 5 = 0 AS muted FROM documents")
def f22(spark, sf_dir):
    state = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3 == 0).alias("muted"))
    changes = state.where("doc_id % 5 = 0").select("doc_id", F.lit(True).alias("muted")).unionByName(state.where("doc_id % 3 = 0 AND doc_id % 6 <> 0 AND doc_id % 5 <> 0").select("doc_id", F.lit(False).alias("muted")))
    return documents.with_muted(state, changes).select("doc_id", "muted")


@query("u07_purge", "SELECT doc_id, source IN ('src1', 'src4') AS gone FROM documents")
def u07(spark, sf_dir):
    kept, gone = documents.purge_excluded(catalog._files(spark, sf_dir), ["src1", "src4"])
    return kept.select("doc_id", F.lit(False).alias("gone")).unionByName(gone.withColumn("gone", F.lit(True)))


@query("u06_duplicates", "SELECT label AS doc_id, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) > 1")
def u06(spark, sf_dir):
    from quillspark.sources import connect as C

    return C.duplicates(records(spark, sf_dir), "doc_id")


@query("u05_overlap", f"SELECT len(list_intersect(a, b)) > 0 AS overlap FROM (SELECT list(vec_id) AS a FROM (SELECT vec_id FROM embeddings e, {catalog._Q0} ORDER BY {_L2}, vec_id LIMIT 5)), (SELECT list(vec_id) AS b FROM (SELECT vec_id FROM embeddings e, {catalog._Q0} WHERE vec_id % 2 = 0 ORDER BY {_L2}, vec_id LIMIT 5))")
def u05(spark, sf_dir):
    rows, q = records(spark, sf_dir), query_vector(spark, sf_dir)
    top = lambda df, name: search.nearest(df, q, 5).agg(F.collect_list("id").alias(name))  # noqa: E731 - five ids
    return top(rows, "a").join(top(rows.where("id % 2 = 0"), "b")).select(F.arrays_overlap("a", "b").alias("overlap"))


@query("j06_reconcile", f"SELECT coalesce(s.doc_id, m.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'delete' WHEN s.path = m.path AND s.mtime = m.mtime AND m.complete THEN 'keep' ELSE 'reindex' END AS action FROM {_FILES} s FULL JOIN (SELECT CASE WHEN doc_id % 2 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, path, CASE WHEN doc_id % 5 = 0 THEN mtime - 1 ELSE mtime END AS mtime, doc_id % 7 <> 0 AS complete FROM {_FILES}) m ON s.doc_id = m.doc_id")
def j06(spark, sf_dir):
    files = catalog._files(spark, sf_dir)
    migrated = files.select(F.when(F.col("doc_id") % 2 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), "path", F.when(F.col("doc_id") % 5 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"), (F.col("doc_id") % 7 != 0).alias("complete"))
    return documents.reconcile(files, migrated)


@query("j08_candidates", f"SELECT f.doc_id, s.mtime AS indexed FROM {_FILES} f LEFT JOIN {catalog._STATE} s ON f.path = s.path")
def j08(spark, sf_dir):
    from quillspark.functions import text as T

    state = catalog._state(spark, sf_dir).select(T.normalize_path(F.col("path")).alias("path"), F.col("mtime").alias("indexed"))
    return catalog._files(spark, sf_dir).select("doc_id", T.normalize_path(F.col("path")).alias("path")).join(state, "path", "left").select("doc_id", "indexed")


@query("j13_checked_files", f"SELECT f.doc_id FROM {_FILES} f JOIN (SELECT source || '/' || doc_id || '.md' AS path FROM documents WHERE doc_id % 3 = 1) c USING (path)")
def j13(spark, sf_dir):
    files = catalog._files(spark, sf_dir)
    return files.join(files.where("doc_id % 3 = 1").select("path"), "path", "left_semi").select("doc_id")


@query("x18_chunk_views", "SELECT conv_id || '::chunk-' || turn AS id, CASE WHEN conv_id % 3 = 0 THEN conv_id::VARCHAR ELSE 'c' || conv_id END AS doc_id, turn::INT AS chunk_index, CASE WHEN conv_id % 2 = 0 THEN 99 ELSE count(*) OVER (PARTITION BY conv_id) END::INT AS chunk_count, CASE WHEN conv_id % 2 = 0 THEN role ELSE coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') END AS section_label, CASE WHEN conv_id % 2 = 0 THEN 5.0 ELSE 0.0 END::DOUBLE AS mtime, conv_id % 2 <> 0 OR conv_id % 3 = 0 AS needs_reindex FROM conversations")
def x18(spark, sf_dir):
    c, even, named = F.col("conv_id"), F.col("conv_id") % 2 == 0, F.col("conv_id") % 3 != 0
    full = F.create_map(F.lit("chunk_index"), F.col("turn").cast("string"), F.lit("chunk_count"), F.lit("99"), F.lit("section_label"), F.col("role"), F.lit("mtime"), F.lit("5"))
    name = F.create_map(F.lit("doc_id"), F.concat(F.lit("c"), c.cast("string")), F.lit("path"), F.lit("p.md"))
    m = F.map_concat(F.when(even, full).otherwise(F.create_map().cast("map<string,string>")), F.when(named, name).otherwise(F.create_map().cast("map<string,string>")))
    rows = table(spark, sf_dir, "conversations").select(F.concat(c.cast("string"), F.lit("::chunk-"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("document"), m.alias("metadata"))
    return documents.chunk_views(rows).select("id", "doc_id", "chunk_index", "chunk_count", "section_label", "mtime", "needs_reindex")


# The store: each query fills one of its own in the shared scratch folder.


def filled(spark, sf_dir, name: str = "vectors"):
    from quillspark.sources.store import Store

    store = Store(spark, scratch_folder(spark, "store"))
    store.ensure(name)
    rows = records(spark, sf_dir)
    meta = F.concat(F.lit('{"label":'), F.col("doc_id").cast("string"), F.lit(',"text":"'), F.col("doc_id").cast("string"), F.lit('","gone":null}'))
    store.upsert(name, rows.select(F.lpad(F.col("id").cast("string"), 12, "0").alias("id"), F.concat(F.lit("note-"), F.col("doc_id").cast("string")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("document"), meta.alias("metadata"), "embedding"))
    return store


@query("d04_upsert", "SELECT lpad(vec_id::VARCHAR, 12, '0') AS id, CASE WHEN vec_id % 3 = 0 THEN 'moved' ELSE 'note-' || label END AS doc_id, row_number() OVER (ORDER BY vec_id) - 1 AS seq FROM embeddings UNION ALL SELECT 'new-' || lpad(vec_id::VARCHAR, 12, '0'), 'note-' || label, (SELECT count(*) FROM embeddings) + row_number() OVER (ORDER BY vec_id) - 1 FROM embeddings WHERE vec_id % 7 = 0")
def d04(spark, sf_dir):
    store = filled(spark, sf_dir)
    rows = store.read("vectors").drop("seq")
    number = F.col("id").cast("long")
    changed = rows.where(number % 3 == 0).withColumn("doc_id", F.lit("moved"))
    added = rows.where(number % 7 == 0).withColumn("id", F.concat(F.lit("new-"), F.col("id")))
    store.upsert("vectors", changed.unionByName(added), encoded=True)
    return store.read("vectors").select("id", "doc_id", "seq")


@query("d05_store_delete", "SELECT lpad(vec_id::VARCHAR, 12, '0') AS id FROM embeddings WHERE label <> 2")
def d05(spark, sf_dir):
    store = filled(spark, sf_dir)
    store.delete_document("vectors", "note-2")
    return store.read("vectors").select("id")


@query("d05_batches", "SELECT lpad(vec_id::VARCHAR, 12, '0') AS id, CASE WHEN vec_id % 5 = 1 THEN 'second' WHEN vec_id % 3 = 0 THEN 'first' END AS title, vec_id - (SELECT min(vec_id) FROM embeddings) AS seq FROM embeddings WHERE label <> 2 AND (label <> 4 OR vec_id % 5 = 1)")
def d05_batches(spark, sf_dir):
    """Two batches of replacements with deletions between them, on a delta each; a document that is deleted and written again."""
    store = filled(spark, sf_dir)
    rows = store.read("vectors", store.version("vectors"))
    number = F.col("id").cast("long")
    first = rows.where(number % 3 == 0).withColumn("title", F.lit("first"))
    store.upsert("vectors", first.drop("seq"), encoded=True)
    again = rows.where((number % 5 == 1) & (F.col("doc_id") != "note-2")).withColumn("title", F.lit("second"))
    kept = rows.where((F.col("doc_id") == "note-4") & (number % 5 != 1)).select(F.concat(F.col("doc_id"), F.lit("-rest")).alias("doc_id"), *[c for c in rows.columns if c not in ("seq", "doc_id")])
    store.upsert("vectors", kept, encoded=True)
    store.delete_documents("vectors", spark.createDataFrame([("note-2",), ("note-4-rest",)], "doc_id string"))
    store.upsert("vectors", again.drop("seq"), encoded=True)
    store.compact("vectors", whole=True)
    return store.read("vectors").select("id", "title", "seq")


_CHANGES = "SELECT lpad(vec_id::VARCHAR, 12, '0') AS id, 'replaced' AS kind FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT 'new-' || lpad(vec_id::VARCHAR, 12, '0'), 'inserted' FROM embeddings WHERE vec_id % 7 = 0 UNION ALL SELECT lpad(vec_id::VARCHAR, 12, '0'), 'deleted' FROM embeddings WHERE label = 2 AND vec_id % 3 <> 0"


def _changed(spark, sf_dir):
    """A store that got a batch of replaced and new records and lost a document, and the version before that."""
    store = filled(spark, sf_dir)
    since = store.version("vectors")
    rows = store.read("vectors").drop("seq")
    number = F.col("id").cast("long")
    changed = rows.where(number % 3 == 0).withColumn("doc_id", F.lit("moved"))
    added = rows.where(number % 7 == 0).select(F.concat(F.lit("new-"), F.col("id")).alias("id"), F.lit("added").alias("doc_id"), *[c for c in rows.columns if c not in ("id", "doc_id")])
    store.upsert("vectors", changed.unionByName(added), encoded=True)
    store.delete_document("vectors", "note-2")
    return store, since


@query("s07_changes", _CHANGES)
def s07_changes(spark, sf_dir):
    """What the commits after a version did."""
    store, since = _changed(spark, sf_dir)
    return store.changes("vectors", since).select("id", "kind")


@query("s07_change_stream", _CHANGES)
def s07_change_stream(spark, sf_dir):
    """The same as a stream, from the first commit: what came with the first batch is left out behind it."""
    store, since = _changed(spark, sf_dir)
    folder = scratch_folder(spark, "change-stream")
    stream = store_changes.read_changes(spark, store.root, "vectors").select("version", "id", "kind").writeStream.format("parquet")
    stream.option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows").where(F.col("version") > since).select("id", "kind")


@query("d14_resumed_copy", "SELECT lpad(vec_id::VARCHAR, 12, '0') AS id, vec_id - (SELECT min(vec_id) FROM embeddings) AS seq FROM embeddings")
def d14(spark, sf_dir):
    """A copy that broke after its second batch goes on behind it."""
    from quillspark.sources.store import Store, copy_collection

    class Breaking(Store):
        left = 2

        def upsert(self, *args, **options):
            if not self.left:
                raise InterruptedError
            self.left -= 1
            return super().upsert(*args, **options)

    source, folder = filled(spark, sf_dir), scratch_folder(spark, "copy")
    batch = max(1, source.count("vectors") // 4)
    try:
        copy_collection(source, Breaking(spark, folder), "vectors", batch)
    except InterruptedError:
        pass
    target = Store(spark, folder)
    copy_collection(source, target, "vectors", batch, clean=False)
    return target.read("vectors").select("id", "seq")


@query("f03_metadata_types", "SELECT lpad(vec_id::VARCHAR, 12, '0') AS id FROM embeddings WHERE label = 3")
def f03(spark, sf_dir):
    """Equality is strict about types: the label 3 is a number in one field, a text in the other."""
    store = filled(spark, sf_dir)
    assert store.get("vectors", where={"label": "3"}).isEmpty() and store.get("vectors", where={"gone": 0}).isEmpty()
    return store.get("vectors", where={"label": 3, "text": "3"}).select("id")


@query("d03_drop", "SELECT true AS first, false AS again, 1 AS left_over")
def d03(spark, sf_dir):
    store = filled(spark, sf_dir)
    store.ensure("other")
    return spark.createDataFrame([(store.drop("vectors"), store.drop("vectors"), len(store.collections()))], "first boolean, again boolean, left_over int")


@query("d11_meta", "SELECT 'two' AS value, NULL::VARCHAR AS none")
def d11(spark, sf_dir):
    from quillspark.sources.store import Store

    store = Store(spark, scratch_folder(spark, "store"))
    store.set_meta("a key", "one")
    store.set_meta("a key", "two")
    return spark.createDataFrame([(store.get_meta("a key"), store.get_meta("other"))], "value string, none string")


@query("d13_copy", "SELECT count(*) AS source, count(*) AS target, true AS same_ids, 0 AS differing FROM embeddings")
def d13(spark, sf_dir):
    from quillspark.sources.store import Store, copy_collection

    done = copy_collection(filled(spark, sf_dir), Store(spark, scratch_folder(spark, "copy")), "vectors")
    return spark.createDataFrame([(done["source"], done["target"], done["same_ids"], done["differing"])], "source long, target long, same_ids boolean, differing int")


@query("s07_cached_norms", "SELECT lpad(vec_id::VARCHAR, 12, '0') AS id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm2 FROM embeddings")
def s07(spark, sf_dir):
    return filled(spark, sf_dir).cached("vectors").select("id", F.round("norm2", 6).alias("norm2"))


_GRAMS = "(SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS gram FROM (SELECT doc_id, string_split(lower(text), '') AS c FROM documents))"


@query("d08_keyword_index", f"SELECT gram, count(*) AS n FROM {_GRAMS} GROUP BY gram")
def d08(spark, sf_dir):
    return keyword.postings(notes(spark, sf_dir)).groupBy("gram").agg(F.count("*").alias("n"))


def _index(spark, sf_dir):
    """Blocks of postings over the documents, their number and mean length; built once a session and folder."""
    key = f"{id(spark.sparkContext)} {sf_dir}"
    if key not in _INDEXES:
        folder = scratch_folder(spark, "postings")
        rows = notes(spark, sf_dir)
        keyword.write_blocks(keyword.index_blocks(rows), folder)
        _INDEXES[key] = folder, *keyword.lengths(rows).agg(F.count("*"), F.avg("dl")).first()
    folder, n, average = _INDEXES[key]
    return spark.read.parquet(folder), n, average


_INDEXES: dict = {}


@query("a07_indexed", _bm25_sql(catalog._BM25_TERMS))
def a07_indexed(spark, sf_dir):
    """BM25 of all matching documents, from postings alone: a single trigram and words that are phrases of some."""
    index, n, average = _index(spark, sf_dir)
    return keyword.top(index, catalog._BM25_TERMS, n, average).select(F.col("seq").alias("id"), F.round("score", 6).alias("score"))


@query("t03_indexed", f"SELECT * FROM ({_bm25_sql(('the', 'ein', 'qui'))}) ORDER BY score, id LIMIT 20")
def t03_indexed(spark, sf_dir):
    """The best 20 for single trigrams: spans that cannot reach them are not read."""
    index, n, average = _index(spark, sf_dir)
    return keyword.top(index, ("the", "ein", "qui"), n, average, 20).select(F.col("seq").alias("id"), F.round("score", 6).alias("score"))


@query("d09_backfill", "SELECT doc_id AS seq FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 1000")
def d09(spark, sf_dir):
    return keyword.backfill_step(notes(spark, sf_dir), 100, 1 << 60).select("seq")


@query("d10_status", "SELECT source, CASE WHEN min(doc_id) > m THEN 'unavailable' WHEN max(doc_id) <= m THEN 'ready' ELSE 'backfilling' END AS state, count(*) FILTER (WHERE doc_id <= m) AS indexed, count(*) AS total FROM documents, (SELECT floor(median(doc_id))::BIGINT AS m FROM documents) GROUP BY source, m")
def d10(spark, sf_dir):
    """Sources as collections whose index has come as far as the middle of all documents."""
    docs = table(spark, sf_dir, "documents")
    middle = docs.agg(F.floor(F.percentile("doc_id", 0.5)).cast("long").alias("m"))
    sums = docs.crossJoin(F.broadcast(middle)).groupBy("source", "m").agg(F.max("doc_id").alias("target"), F.count_if(F.col("doc_id") <= F.col("m")).alias("indexed"), F.count("*").alias("total"))  # one row
    state = keyword.status(F.col("m"), F.col("target"), F.when(F.col("indexed") == 0, 0).otherwise(F.col("total")))
    return sums.select("source", state.alias("state"), "indexed", "total")


@query("d10_indexed_search", f"SELECT * FROM ({_bm25_sql(('lichkeit', 'mente'))}) ORDER BY score, id LIMIT 20")
def d10_search(spark, sf_dir):
    """BM25 of phrases through the index."""
    index, n, average = _index(spark, sf_dir)
    return keyword.top(index, ["lichkeit", "mente"], n, average, 20).select(F.col("seq").alias("id"), F.round("score", 6).alias("score"))


# Hybrid search: every document has the vector whose id is its own modulo their number.


def _with_vectors(spark, sf_dir):
    vectors = records(spark, sf_dir)
    n = vectors.agg(F.max("id") + 1).first()[0] or 1
    rows = notes(spark, sf_dir).withColumn("_v", F.col("id") % n)
    return rows.join(vectors.select(F.col("id").alias("_v"), "embedding"), "_v", "left").drop("_v")


_DOCS = f"vectors AS MATERIALIZED (SELECT e.vec_id, {_L2} AS distance FROM embeddings e, {catalog._Q0}), docs AS MATERIALIZED (SELECT doc_id AS id, distance FROM documents JOIN vectors ON vec_id = doc_id % (SELECT max(vec_id) + 1 FROM embeddings))"
_NEAR = "near AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY distance, id) AS rank FROM docs QUALIFY rank <= {n})"
_WORDS = f"words AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY score, id) AS rank FROM ({_bm25_sql(('tion', 'the', 'ein')).replace('round(-(', '(-(').replace('), 6) AS score', ')) AS score')}) QUALIFY rank <= {{n}})"
_HYBRID = "l AS (SELECT id, 0 AS list, rank, {a} AS w FROM near UNION ALL SELECT id, 1, rank, {b} FROM words), f AS (SELECT id, sum(w / (60 + rank)) AS fused, min((list, rank)) AS first FROM l GROUP BY id), p AS (SELECT id, fused, row_number() OVER (ORDER BY round(fused, 12) DESC, first) AS position FROM f QUALIFY position <= 10)"


@query("n08_hybrid", f"WITH {_DOCS}, {_NEAR.format(n=50)}, {_WORDS.format(n=50)}, {_HYBRID.format(a='1.0::DOUBLE', b='2.0::DOUBLE')} SELECT p.id, round(distance, 6) AS distance, round(fused, 9) AS fused_score, concat_ws('+', CASE WHEN p.id IN (SELECT id FROM near) THEN 'vector' END, CASE WHEN p.id IN (SELECT id FROM words) THEN 'keyword' END) AS matched_by, position::INT AS position FROM p JOIN docs USING (id)")
def n08(spark, sf_dir):
    found = search.hybrid(_with_vectors(spark, sf_dir), query_vector(spark, sf_dir), "tion the ein", 10, 2.0)
    return found.select("id", F.round("distance", 6).alias("distance"), F.round("fused_score", 9).alias("fused_score"), F.array_join("matched_by", "+").alias("matched_by"), "position")


@query("t16_picker", f"WITH {_DOCS}, {_NEAR.format(n=60)}, {_WORDS.format(n=60)}, {_HYBRID.format(a='1.0::DOUBLE', b='2.0::DOUBLE').replace('position <= 10', 'position <= 12')} SELECT p.id, round(distance, 6) AS distance, (row_number() OVER (ORDER BY distance, position))::INT AS place FROM p JOIN docs USING (id)")
def t16(spark, sf_dir):
    found = search.picked(_with_vectors(spark, sf_dir), query_vector(spark, sf_dir), "tion the ein", 2.0)
    return found.select("id", F.round("distance", 6).alias("distance"), "place")


@query("t17_surplus", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id::VARCHAR DESC) AS n FROM documents) WHERE n > 20 AND doc_id <> 7")
def t17(spark, sf_dir):
    """Documents as files of their source's folder, their length as time."""
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("folder"), F.col("doc_id").cast("string").alias("name"), F.col("n_chars").alias("mtime"), "doc_id")
    return documents.surplus(files, ["folder"], 20, named=["7"]).select("doc_id")


# A table of queries: two words of each benchmark item that do not overlap themselves, and the vector of its number.

_ALONE = "list_filter(w, lambda t, p: list_position(w, t) = p AND len(list_filter(range(1, length(t)), lambda i: t[:i] = t[-i:])) = 0)"
_ASKED = f"asked AS MATERIALIZED (SELECT item_id AS query_id, terms[:2] AS terms, e.embedding FROM (SELECT item_id, {_ALONE} AS terms FROM (SELECT item_id, regexp_extract_all(text, '[a-z]{{4,8}}') AS w FROM benchmark)) b JOIN embeddings e ON e.vec_id = b.item_id % (SELECT max(vec_id) + 1 FROM embeddings) WHERE len(terms) >= 2)"
_BATCH = f"""
WITH {_ASKED},
r AS MATERIALIZED (SELECT doc_id, lower(text) AS low, greatest(length(text) - 2, 0)::DOUBLE AS dl FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, avg(dl) AS a FROM r),
t AS (SELECT DISTINCT unnest(terms) AS term FROM asked),
h AS MATERIALIZED (SELECT term, doc_id, dl, (len(string_split(low, term)) - 1)::DOUBLE AS f FROM r, t WHERE contains(low, term)),
d AS (SELECT term, count(*) AS df FROM h GROUP BY term),
p AS (SELECT term, doc_id, greatest(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END, 0) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a)) AS part FROM h JOIN d USING (term), s),
q AS (SELECT query_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS no FROM asked),
scored AS (SELECT query_id, doc_id AS id, -sum(part ORDER BY no) AS score FROM q JOIN p USING (term) GROUP BY query_id, doc_id),
words AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM scored QUALIFY rank <= 50)"""


@query("j02_keyword_batch", f"{_BATCH} SELECT query_id, id, rank::INT AS rank FROM words WHERE rank <= 10")
def j02_batch(spark, sf_dir):
    """The ten best documents of every query of a table, in one job."""
    index, n, average = _index(spark, sf_dir)
    found = keyword.top_batch(index, _asked(spark, sf_dir), n, average, 50)
    return found.where("rank <= 10").select("query_id", F.col("seq").alias("id"), "rank")


@query("n08_hybrid_batch", f"""{_BATCH},
near AS (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (SELECT query_id, e.vec_id, {_L2} AS distance FROM embeddings e, asked q) QUALIFY rank <= 50),
l AS (SELECT query_id, id, 0 AS list, rank, 1.0::DOUBLE AS w FROM near UNION ALL SELECT query_id, id, 1, rank, 1.0 FROM words),
f AS (SELECT query_id, id, sum(w / (60 + rank)) AS fused, min((list, rank)) AS first FROM l GROUP BY query_id, id)
SELECT query_id, id, round(fused, 9) AS fused_score, (row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, first))::INT AS position FROM f QUALIFY position <= 10""")
def n08_batch(spark, sf_dir):
    """Vectors and words of every query of a table, fused; a record's vector and its document have the same number."""
    index, n, average = _index(spark, sf_dir)
    found = keyword.hybrid_batch(index, records(spark, sf_dir).select("seq", "embedding"), _asked(spark, sf_dir), n, average, 10)
    return found.select("query_id", "id", F.round("fused_score", 9).alias("fused_score"), "position")


def _asked(spark, sf_dir):
    vectors = records(spark, sf_dir)
    top = vectors.agg((F.max("id") + 1).alias("top"))
    own = F.exists(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substring(F.col("t"), F.lit(1), i) == F.substring(F.col("t"), F.length("t") - i + 1, i))
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{4,8}"), F.lit(0)))).alias("at", "t")).where(~own)
    items = words.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("w")).where(F.size("w") >= 2)
    items = items.select(F.col("item_id").alias("query_id"), F.transform(F.slice("w", 1, 2), lambda x: x["t"]).alias("terms")).crossJoin(F.broadcast(top))  # one row
    return items.join(vectors.select(F.col("id").alias("_v"), "embedding"), F.col("_v") == F.col("query_id") % F.col("top")).select("query_id", "terms", "embedding")


@query("n09_tool_fusion", f"WITH {_DOCS}, {_NEAR.format(n=50)}, {_WORDS.format(n=50)}, {_HYBRID.format(a='1.0::DOUBLE', b='1.0::DOUBLE')} SELECT id, round(fused, 9) AS fused_score, position::INT AS position FROM p")
def n09(spark, sf_dir):
    rows = _with_vectors(spark, sf_dir)
    near = keyword.ranked(search.nearest(rows, query_vector(spark, sf_dir), 50), "distance").select("id", "rank")
    words = keyword.ranked(search.bm25(rows, ["tion", "the", "ein"], 50)).select("id", "rank")
    return search.by_tool(near, words, words.where("rank < 0"), 10).select("id", F.round("fused_score", 9).alias("fused_score"), "position")


@query("f11_active", f"SELECT vec_id AS id FROM (SELECT vec_id, label FROM embeddings e, {catalog._Q0} ORDER BY {_L2}, vec_id LIMIT 25) WHERE label <> 4")
def f11(spark, sf_dir):
    """The open document's chunks leave after the limit."""
    return search.without_active(search.nearest(records(spark, sf_dir), query_vector(spark, sf_dir), 25), "note-4.md").select("id")


@query("f20_valid_candidates", f"WITH pool AS (SELECT vec_id, label, {_L2} AS d FROM embeddings e, {catalog._Q0} WHERE vec_id <> (SELECT vec_id FROM embeddings ORDER BY (vec_id <> 0)::INT, vec_id LIMIT 1) ORDER BY d, vec_id LIMIT 40), two AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS nth FROM pool WHERE label <> 4) SELECT vec_id AS id FROM two WHERE nth <= 2 ORDER BY d, vec_id LIMIT 8")
def f20(spark, sf_dir):
    """Related chunks of which the caller finds some not valid."""
    rows = records(spark, sf_dir)
    first = rows.orderBy((F.col("id") != 0).cast("int"), "id").first()["id"]
    return walk.related(rows, first, valid=F.col("doc_id") != 4).select("id")


@query("n07_by_document", f"SELECT vec_id AS id, round({_L2}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE label IS DISTINCT FROM (SELECT label FROM embeddings WHERE vec_id = 3) ORDER BY {_L2}, vec_id LIMIT 10")
def n07(spark, sf_dir):
    rows = records(spark, sf_dir)
    vector = rows.where("id = 3").select("doc_id", "embedding")
    label = vector.first()["doc_id"]
    return search.by_document(rows, vector, label, 10).select("id", F.round("distance", 6).alias("distance"))


@query("t05_backfill", f"SELECT vec_id AS id FROM (SELECT vec_id, label, {_L2} AS d FROM embeddings e, {catalog._Q0} ORDER BY d, vec_id LIMIT 200) WHERE label NOT IN (1, 2, 3) ORDER BY d, vec_id LIMIT 15")
def t05(spark, sf_dir):
    found = search.backfilled(records(spark, sf_dir), query_vector(spark, sf_dir), 15, muted=["note-1.md"], excluded=["note-2.md", "note-3.md"])
    return found.select("id")


@query("s20_vector_tool", f"SELECT vec_id AS id, round({_L2} / 2, 6) AS cosine_distance, round(1 - {_L2} / 2, 4) AS similarity FROM (SELECT * FROM embeddings e, {catalog._Q0} ORDER BY {_L2}, vec_id LIMIT 15) t(vec_id, embedding, label, q), (SELECT t.q AS embedding) q, (SELECT t.embedding AS embedding) e WHERE label <> 4 ORDER BY {_L2}, vec_id LIMIT 5")
def s20(spark, sf_dir):
    found = search.nearest(records(spark, sf_dir), query_vector(spark, sf_dir), 15).where("doc_id <> 4").orderBy("distance", "seq").limit(5)
    return found.select("id", F.round(F.col("distance") / 2, 6).alias("cosine_distance"), F.round(1 - F.col("distance") / 2, 4).alias("similarity"))


@query("t08_recent_samples", f"SELECT doc_id, md5(left(text, 20000)) AS sample_md5 FROM documents ORDER BY n_chars DESC, source || '/' || doc_id || '.md' LIMIT 40")
def t08(spark, sf_dir):
    rows = notes(spark, sf_dir).join(catalog._files(spark, sf_dir).select("doc_id", "mtime"), "doc_id").orderBy(F.desc("mtime"), "path").limit(40)
    return rows.select("doc_id", F.md5(F.substring("document", 1, 20000).cast("binary")).alias("sample_md5"))


@query("t09_document_chunks", "SELECT turn::INT AS chunk_index FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations) ORDER BY turn")
def t09(spark, sf_dir):
    rows = catalog.chunk_rows(spark, sf_dir)
    first = rows.agg(F.min("doc_id").alias("doc_id"))
    return rows.join(F.broadcast(first), "doc_id", "left_semi").orderBy("chunk_index").select("chunk_index")  # one row


_MIXED = "CASE WHEN doc_id % 2 = 0 THEN source ELSE upper(source) END || '/' || doc_id // 4 || '.md'"


@query("t10_ordered_paths", f"SELECT doc_id, rank() OVER (ORDER BY lower(path), path DESC)::INT AS rank FROM (SELECT doc_id, {_MIXED} AS path FROM documents)")
def t10(spark, sf_dir):
    """Paths that differ in case: the locale puts them side by side, small letters first."""
    source = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.upper("source"))
    paths = table(spark, sf_dir, "documents").select("doc_id", F.concat(source, F.lit("/"), F.floor(F.col("doc_id") / 4).cast("string"), F.lit(".md")).alias("path"))
    return paths.select("doc_id", F.rank().over(Window.orderBy(documents.path_order(F.col("path")))).alias("rank"))

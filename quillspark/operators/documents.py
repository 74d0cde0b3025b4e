"""Document-level views, reconciliation, capacity and verification of an index.

Chunk rows have doc_id, path, mtime, chunk_index, chunk_count, seq; files have path, mtime; state has doc_id, path, mtime,
chunk_count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import rules
from quillspark.functions import text as T

#: Fixed value: names of collections.
COLLECTION_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]{2,255}$"


def document_entries(chunks: DataFrame) -> DataFrame:
    """One row a document: its path as first stored, newest mtime, rows, and whether a row lacks chunk metadata."""
    complete = F.col("chunk_index").isNotNull() & F.col("chunk_count").isNotNull() & F.col("mtime").isNotNull()
    rows = chunks.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
    return rows.agg(
        F.coalesce(F.min_by("path", "seq"), F.col("doc_id").cast("string")).alias("path"), F.coalesce(F.max("mtime"), F.lit(0.0)).alias("mtime"),
        F.count("*").alias("chunk_count"), F.bool_or(~complete).alias("needs_reindex"), F.min("seq").alias("first_seq"),
    )


def migrated_evidence(chunks: DataFrame) -> DataFrame:
    """doc_id, path, mtime, chunk_count, complete: whether a document's rows agree and hold every index once."""
    agree = (F.min("path") == F.max("path")) & (F.min("mtime") == F.max("mtime")) & (F.min("chunk_count") == F.max("chunk_count"))
    typed = F.bool_and(F.col("path").isNotNull() & F.col("mtime").isNotNull() & F.col("chunk_index").isNotNull() & F.col("chunk_count").isNotNull())
    whole = (F.count("*") == F.max("chunk_count")) & (F.count_distinct("chunk_index") == F.count("*")) & (F.min("chunk_index") >= 0) & (F.max("chunk_index") < F.max("chunk_count"))
    return chunks.groupBy("doc_id").agg(F.min("path").alias("path"), F.max("mtime").alias("mtime"), F.count("*").alias("chunk_count"), F.coalesce(agree & typed & whole, F.lit(False)).alias("complete"))


def file_status(files: DataFrame, state: DataFrame) -> DataFrame:
    """files with status: unindexed, outdated (older, or known under another path), or indexed."""
    s = state.select(F.col("doc_id").alias("_doc"), F.col("path").alias("_path"), F.col("mtime").alias("_mtime"), F.col("chunk_count").alias("chunk_count"))
    joined = files.join(s, files["doc_id"] == s["_doc"], "left")
    status = F.when(F.col("_doc").isNull(), "unindexed").when((F.col("_mtime") < F.col("mtime")) | ~F.col("_path").eqNullSafe(F.col("path")), "outdated").otherwise("indexed")
    return joined.withColumn("status", status).drop("_doc", "_path", "_mtime")


def reconcile(selected: DataFrame, migrated: DataFrame) -> DataFrame:
    """doc_id, action: keep where path and mtime agree and the rows are complete, delete what nobody selected, reindex the
    rest. selected: doc_id, path, mtime; migrated: the same and complete."""
    s, m = selected.alias("s"), migrated.alias("m")
    same = F.col("s.path").eqNullSafe(F.col("m.path")) & F.col("s.mtime").eqNullSafe(F.col("m.mtime")) & F.col("m.complete")
    action = F.when(F.col("s.doc_id").isNull(), "delete").when(F.coalesce(same, F.lit(False)), "keep").otherwise("reindex")
    return s.join(m, F.col("s.doc_id") == F.col("m.doc_id"), "full").select(F.coalesce("s.doc_id", "m.doc_id").alias("doc_id"), action.alias("action"))


def verify(selected: DataFrame, state: DataFrame, stored: DataFrame) -> DataFrame:
    """doc_id, violation: where the three sides (doc_id, path, mtime, chunk_count) contradict each other. No row: verified.
    Documents of zero chunks may be selected and known to the state, not stored."""
    side = lambda df, name: df.select(F.col("doc_id"), F.struct("path", F.col("mtime").cast("double").alias("mtime"), F.col("chunk_count").cast("long").alias("chunk_count")).alias(name))
    every = side(selected, "a").join(side(state, "b"), "doc_id", "full").join(side(stored, "c"), "doc_id", "full")
    violation = (
        F.when(F.col("a").isNull(), "extra")
        .when(F.col("b").isNull(), "no state")
        .when(~F.col("a").eqNullSafe(F.col("b")), "state differs")
        .when((F.col("a.chunk_count") == 0) & F.col("c").isNotNull(), "stored but empty")
        .when((F.col("a.chunk_count") > 0) & F.col("c").isNull(), "not stored")
        .when((F.col("a.chunk_count") > 0) & ~F.col("a").eqNullSafe(F.col("c")), "store differs")
    )
    return every.withColumn("violation", violation).where(F.col("violation").isNotNull()).select("doc_id", "violation")


def recover_state(state: DataFrame, entries: DataFrame) -> DataFrame:
    """State with what the store knows: an entry wins unless the state has chunks and is at least as new."""
    s, e = state.alias("s"), entries.alias("e")
    keep = F.col("e.doc_id").isNull() | ((F.col("s.chunk_count") > 0) & (F.col("s.mtime") >= F.col("e.mtime")))
    pick = lambda c: F.when(F.coalesce(keep, F.lit(False)), F.col(f"s.{c}")).otherwise(F.col(f"e.{c}")).alias(c)
    return s.join(e, F.col("s.doc_id") == F.col("e.doc_id"), "full").select(F.coalesce("s.doc_id", "e.doc_id").alias("doc_id"), pick("path"), pick("mtime"), pick("chunk_count"))


def upgrade_legacy_state(state: DataFrame) -> DataFrame:
    """Keys of the form path::ctime become the path; the newest row of a path wins."""
    rows = state.withColumn("doc_id", F.substring_index("doc_id", "::", 1))
    rest = [c for c in state.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.max_by(F.struct(*rest), "mtime").alias("r")).select("doc_id", "r.*")


def capacity_plan(candidates: DataFrame, indexed: int, limit: int, keys: list[str] = ()) -> DataFrame:
    """candidates (position, counts) with allowed: in order, those that don't count always pass, others while slots are
    left."""
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    used = F.sum(F.col("counts").cast("int")).over(by.orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return candidates.withColumn("allowed", ~F.col("counts") | (used <= max(0, limit - indexed)))


def first_by_path(files: DataFrame, key: Column) -> DataFrame:
    """One file a normalized path: by path, newest first."""
    order = Window.partitionBy("_key").orderBy("path", F.desc("mtime"))
    return files.withColumn("_key", key).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_key", "_n")


def index_summary(results: DataFrame) -> DataFrame:
    """Counts by status and the sum of chunks."""
    return results.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("indexed", "skipped", "failed")], F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))


def xor_digest(ids: DataFrame, column: str) -> DataFrame:
    """digest, n: the exclusive or of the SHA-256 of all ids, whatever their order; eight lanes of 32 bits."""
    lanes = [F.conv(F.substring(F.sha2(F.col(column).cast("string"), 256), 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)]
    folded = ids.agg(F.count("*").alias("n"), *[F.bit_xor(x).alias(f"l{i}") for i, x in enumerate(lanes)])
    return folded.select(F.lower(F.concat(*[F.lpad(F.hex(F.coalesce(f"l{i}", F.lit(0))), 8, "0") for i in range(8)])).alias("digest"), "n")


def numbered_chunks(pieces: DataFrame) -> DataFrame:
    """pieces (doc_id, position, content) with id, chunk_index and chunk_count."""
    by = Window.partitionBy("doc_id")
    out = pieces.withColumn("chunk_index", F.row_number().over(by.orderBy("position")) - 1).withColumn("chunk_count", F.count("*").over(by).cast("int"))
    return out.withColumn("id", F.concat(F.col("doc_id").cast("string"), F.lit("::chunk-"), F.col("chunk_index").cast("string")))


def retrieval_metrics(rankings: DataFrame, k: int) -> DataFrame:
    """category, recall, mrr, n by category and over all (category all). rankings: query_id, category, relevant (number of
    relevant items), rank (of each found relevant item, null if none)."""
    hit = F.col("rank").isNotNull() & (F.col("rank") <= k)
    each = rankings.groupBy("query_id", "category").agg((F.count_if(hit) / F.max("relevant")).alias("recall"), F.coalesce(1 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("rr"))
    out = each.rollup("category").agg(F.round(F.avg("recall"), 3).alias("recall"), F.round(F.avg("rr"), 3).alias("mrr"), F.count("*").alias("n"), F.grouping("category").alias("g"))
    return out.where((F.col("n") > 0)).select(F.when(F.col("g") == 1, "all").otherwise(F.col("category").cast("string")).alias("category"), "recall", "mrr", "n")


def chunk_views(rows: DataFrame) -> DataFrame:
    """Stored rows (id, document, metadata map<string,string>) as chunks with their defaults: the document by doc_id, path or
    the id's head; index by metadata or the id's end; count by metadata or as many as there are; the section's label or
    the first line; needs_reindex where metadata lack something."""
    m = lambda k: F.try_element_at("metadata", F.lit(k))
    text = lambda k: F.nullif(m(k), F.lit(""))
    whole = F.lit(True)
    for k in ("chunk_index", "chunk_count", "mtime"):
        whole = whole & rules.number(m(k), F.lit(None)).isNotNull()
    whole = whole & text("doc_id").isNotNull() & text("path").isNotNull() & F.map_contains_key("metadata", "section_label")
    out = rows.withColumn("doc_id", F.coalesce(text("doc_id"), text("path"), F.substring_index("id", "::", 1)))
    return out.select(
        "id", "doc_id", F.coalesce(text("path"), F.col("doc_id")).alias("path"), F.coalesce(text("title"), F.col("doc_id")).alias("title"), F.coalesce("document", F.lit("")).alias("content"),
        rules.number(m("chunk_index"), T.legacy_chunk_index(F.col("id"))).cast("int").alias("chunk_index"),
        rules.number(m("chunk_count"), F.count("*").over(Window.partitionBy("doc_id"))).cast("int").alias("chunk_count"),
        F.coalesce(F.nullif(F.trim(m("section_label")), F.lit("")), T.first_line(F.coalesce("document", F.lit("")))).alias("section_label"),
        rules.number(m("mtime"), F.lit(0.0)).alias("mtime"), (~F.coalesce(whole, F.lit(False))).alias("needs_reindex"),
    )


def purge_excluded(state: DataFrame, excluded: list[str]) -> tuple[DataFrame, DataFrame]:
    """(state that stays, documents that go) by excluded paths."""
    bad = F.coalesce(T.is_excluded(F.col("path"), excluded), F.lit(False))
    return state.where(~bad), state.where(bad).select("doc_id")


def with_muted(state: DataFrame, changes: DataFrame) -> DataFrame:
    """state (doc_id, muted) after changes of the flag (doc_id, muted)."""
    c = changes.select("doc_id", F.col("muted").alias("_muted"))
    return state.join(c, "doc_id", "left").withColumn("muted", F.coalesce("_muted", "muted", F.lit(False))).drop("_muted")


def to_index(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files that are not indexed yet or not as they are now."""
    return file_status(files, state).where("status <> 'indexed'")


def chunk_totals(state: DataFrame, stored: DataFrame) -> DataFrame:
    """expected, stored, equal: chunks that the state counts against rows there are; documents: how many the state knows."""
    a = state.agg(F.coalesce(F.sum(F.when(F.col("chunk_count") > 0, F.col("chunk_count"))), F.lit(0)).cast("long").alias("expected"), F.count("*").alias("documents"))
    b = stored.agg(F.count("*").alias("stored"))
    return a.join(F.broadcast(b)).select("expected", "stored", "documents", (F.col("expected") == F.col("stored")).alias("equal"))  # one row each


def source_identity(files: DataFrame) -> DataFrame:
    """files, bytes, newest, digest of files (path, length, mtime), whatever their order."""
    entry = F.concat_ws("\0", "path", F.col("length").cast("string"), F.col("mtime").cast("string"))
    sums = files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("mtime").alias("newest"))
    return sums.join(F.broadcast(xor_digest(files.select(entry.alias("entry")), "entry").select("digest")))  # one row each


def selection_digest(selected: DataFrame) -> DataFrame:
    """digest, n of a selection (doc_id, path, mtime): documents as JSON, in any order."""
    return xor_digest(selected.select(F.to_json(F.struct("doc_id", "path", "mtime")).alias("entry")), "entry")


def is_evidence(selected: DataFrame, state: DataFrame, stored: DataFrame, digest: str) -> bool:
    """Whether nothing contradicts a stored verification: the sides agree and the selection is the one it was made for."""
    return verify(selected, state, stored).isEmpty() and selection_digest(selected).first()["digest"] == digest


def systematic_sample(rows: DataFrame, order: str, most: int = 8) -> DataFrame:
    """Every n-th row and the last, at most so many; order is a gapless number from 0."""
    total = rows.agg((F.max(order) + 1).alias("_total"))
    every = F.greatest(F.lit(1), F.floor(F.col("_total") / (most - 1)))
    at = rows.join(F.broadcast(total)).where((F.col(order) % every == 0) | (F.col(order) == F.col("_total") - 1))  # one row
    return at.orderBy(order).limit(most).drop("_total")


def import_plan(pointers: DataFrame) -> DataFrame:
    """collection, required of pointers (role active, previous or pending; generation; collection): the active collection is
    required, the others are optional; each once, of the current generation and with a valid name."""
    known = pointers.where((F.col("generation") == "v2") & F.coalesce(F.col("collection").rlike(COLLECTION_NAME), F.lit(False)))
    return known.groupBy("collection").agg(F.bool_or(F.col("role") == "active").alias("required"))


def selected_pages(items: DataFrame) -> DataFrame:
    """pages: distinct checked Markdown files of a tree's items (id, type, path, checked)."""
    return items.where((F.col("type") == "file") & F.col("checked") & T.is_markdown(F.col("path"))).agg(F.count_distinct("id").alias("pages"))


def packed(texts: DataFrame, keys: list[str], most: int = 4, chars: int = 1800) -> DataFrame:
    """texts (position, size) with batch: a document's texts in order, a new batch where one is full or the next text would
    not fit; a text that is too long is a batch of its own. Arrays of sizes are folded, texts stay where they are."""
    sizes = texts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", F.col("size").cast("int").alias("size")))).alias("all"))
    zero = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        new = (s["n"] == most) | ((s["n"] > 0) & (s["chars"] + x["size"] > chars))
        b = s["batch"] + new.cast("int")
        return F.struct(b.alias("batch"), F.when(new, 1).otherwise(s["n"] + 1).alias("n"), F.when(new, x["size"]).otherwise(s["chars"] + x["size"]).alias("chars"), F.array_append(s["out"], b).alias("out"))

    folded = sizes.select(*keys, "all", F.aggregate("all", zero, step, lambda s: s["out"]).alias("batches"))
    return folded.select(*keys, F.explode(F.arrays_zip("all", "batches")).alias("x")).select(*keys, "x.all.position", "x.all.size", F.col("x.batches").alias("batch"))


def path_order(path: Column) -> Column:
    """What paths are ordered by: letters before case and accents, as a locale does."""
    return F.collate(path, "UNICODE")


def ordered_paths(entries: DataFrame) -> DataFrame:
    """Documents by path in the order of a locale."""
    return entries.orderBy(path_order(F.col("path")), "path")


def matching_paths(entries: DataFrame, text: str) -> DataFrame:
    return entries.where(F.contains(F.lower("path"), F.lit(text.lower())))


def run_agreement(runs: DataFrame) -> DataFrame:
    """avg_ms, agreement over query runs (ms, expected array, found array): mean time, and the mean share of places at which
    both rankings have the same id."""
    same = F.size(F.filter(F.arrays_zip(F.col("expected").alias("e"), F.col("found").alias("f")), lambda p: p["e"] == p["f"])) / F.greatest(F.size("expected"), F.lit(1))
    return runs.agg(F.avg("ms").alias("avg_ms"), F.avg(same).alias("agreement"))


def manifest_status(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, current: a file is current if its size and its SHA-256 are those of the manifest. files: path, length, content."""
    have = files.select("path", F.col("length").alias("_length"), F.sha2("content", 256).alias("_sha"))
    return manifest.join(have, "path", "left").select("path", F.coalesce((F.col("_length") == F.col("length")) & (F.col("_sha") == F.col("sha256")), F.lit(False)).alias("current"))


def by_latency(hosts: DataFrame) -> DataFrame:
    """hosts (latency, position): fastest first, unreachable ones last."""
    return hosts.orderBy(F.col("latency").asc_nulls_last(), "position")


def surplus(files: DataFrame, keys: list[str], keep: int, named: list[str] = ()) -> DataFrame:
    """The files (keys, name, mtime) to delete: all of a folder (keys) but the newest so many, and but those named. Of equal times
    the greater name is newer, files without a time are the oldest, one without a name is never named."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("mtime"), F.desc_nulls_last("name")))
    over = files.withColumn("_nth", nth).where(F.col("_nth") > keep).drop("_nth")
    return over.where(~F.coalesce(F.col("name").isin(list(named)), F.lit(False))) if named else over


def manifest_sizes(files: DataFrame, key: str) -> DataFrame:
    """key, download, weights, memory of manifests (key, path, size): the bytes of all files of a model, of its weights, and the
    memory that a worker is expected to take. Null sizes count as nothing."""
    size = F.coalesce(F.col("size").cast("long"), F.lit(0))
    weights = F.sum(F.when(F.coalesce(F.col("path").rlike(rules.WEIGHT_FILES), F.lit(False)), size).otherwise(0))
    return files.groupBy(key).agg(F.sum(size).alias("download"), weights.alias("weights")).withColumn("memory", rules.model_memory(F.col("weights")))

"""Queries of text, path, number and rule expressions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import rules as R
from quillspark.functions import text as T
from quillspark.functions import vector as V
from quillspark.operators import chunking, documents
from quillspark.plans.catalog import ORACLES, query, records, table

_PATH = "source || '/' || doc_id || '.md'"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("path", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")))


def md5(c):
    return F.md5(c.cast("binary"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replaced(text: str, steps) -> str:
    for pattern, by in steps:
        text = f"regexp_replace({text}, {_sql_text(pattern)}, {_sql_text(by)}, 'g')"
    return text


def _clean_sql() -> str:
    """The cleaning chain for an engine without back-references: the two kinds of fences as rules of their own."""
    steps = []
    for i, (pattern, by) in enumerate(chunking.CLEANING):
        by = by.replace("$1", "\\1")
        if i == chunking.TABLE_RULE:
            head = _replaced("coalesce(text, '')", steps)
            rows = f"list_transform(string_split({head}, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^\\|.+\\|$') THEN trim(replace(x[2:-2], '|', ' ')) ELSE x END)"
            text, steps = f"array_to_string({rows}, chr(10))", []
        if "\\1" in pattern:
            steps += [("(?m)^`{3,}.*\\n[\\s\\S]*?\\n`{3,}\\s*$", ""), ("(?m)^~{3,}.*\\n[\\s\\S]*?\\n~{3,}\\s*$", "")]
        else:
            steps.append((pattern.replace("(?md)", "(?m)").replace("(?d)", ""), by))
    return _replaced(_replaced(text, steps), [("\\A\\s+|\\s+\\z", "")])


@query("x01_clean_markdown", f"SELECT doc_id, md5({_clean_sql()}) AS cleaned_md5 FROM documents")
def x01(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", md5(chunking.clean(F.coalesce("text", F.lit("")))).alias("cleaned_md5"))


@query("x09_query_text", "SELECT doc_id, md5(left(regexp_replace(regexp_replace(" + _clean_sql() + ", '(?m)^#{1,6}\\s+', '', 'g'), '\\A\\s+|\\s+\\z', '', 'g'), 5000)) AS query_md5 FROM documents")
def x09(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", md5(chunking.search_text(F.coalesce("text", F.lit("")))).alias("query_md5"))


_REDACT = _replaced("text", [(p, b.replace("$1", "\\1").replace("$2", "\\2")) for p, b in T.REDACTIONS])


@query("x22_redact", f"SELECT doc_id, md5(left({_REDACT}, {T.REDACTED_LENGTH})) AS redacted_md5 FROM documents")
def x22(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", md5(T.redact(F.col("text"))).alias("redacted_md5"))


@query("x14_nfc", "SELECT doc_id, md5(nfc_normalize(text)) AS nfc_md5, replace(replace(source, '/', '\\'), '\\', '/') AS source FROM documents")
def x14(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", md5(R.composed(F.col("text"))).alias("nfc_md5"), T.normalize_path(F.replace("source", F.lit("/"), F.lit("\\"))).alias("source"))


@query("x15_ids", f"SELECT doc_id, {_PATH} AS document, {_PATH} || '::' || n_chars AS legacy, {_PATH} || '::chunk-' || (n_chars % 7) AS chunk FROM documents")
def x15(spark, sf_dir):
    p = F.col("path")
    return docs(spark, sf_dir).select("doc_id", p.alias("document"), T.legacy_id(p, F.col("n_chars")).alias("legacy"), T.chunk_id(p, F.col("n_chars") % 7).alias("chunk"))


@query("x16_legacy_index", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE (n_chars % 50)::INT END AS chunk_index FROM documents")
def x16(spark, sf_dir):
    name = F.when(F.col("doc_id") % 3 == 0, F.lit("a::b")).otherwise(T.chunk_id(F.col("path"), F.col("n_chars") % 50))
    return docs(spark, sf_dir).select("doc_id", T.legacy_chunk_index(name).alias("chunk_index"))


_TEMPLATE = "Summarize this.\n{page_content}\nIn short."


@query("x20_prompt", f"SELECT doc_id, md5(replace({_sql_text(_TEMPLATE)}, '{{page_content}}', coalesce(text, ''))) AS filled, md5('Summarize.' || chr(10) || chr(10) || 'content:' || chr(10) || '```' || chr(10) || coalesce(text, '') || chr(10) || '```') AS appended FROM documents")
def x20(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return docs(spark, sf_dir).select("doc_id", md5(R.prompt(_TEMPLATE, t)).alias("filled"), md5(R.prompt("Summarize.", t)).alias("appended"))


@query("x21_strip_fence", "SELECT doc_id, md5(regexp_replace(text, '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g')) AS inner_md5 FROM documents")
def x21(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", md5(T.strip_fence(F.concat(F.lit("```text\n"), F.col("text"), F.lit("\n```")))).alias("inner_md5"))


@query("x19_model_input", "SELECT doc_id, md5(left('passage: ' || text, 1500)) AS input_md5 FROM documents")
def x19(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", md5(R.model_input(F.col("text"), 1500, "passage: ")).alias("input_md5"))


@query("x23_path_hash", f"SELECT doc_id, left(sha256('salt' || {_PATH}), 8) AS hash FROM documents")
def x23(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.path_hash(F.col("path"), "salt").alias("hash"))


@query("x26_title", "SELECT doc_id, CASE WHEN t = '' THEN '搜索' ELSE left(t, 15) END AS title FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS t FROM documents)")
def x26(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", R.tab_title(F.col("text")).alias("title"))


_KEY = "CASE doc_id % 3 WHEN 0 THEN upper(left(md5(doc_id::VARCHAR), 6)) WHEN 1 THEN 'KEY-' || upper(left(md5(doc_id::VARCHAR), 8)) || '-' || (doc_id + 1000) ELSE upper(md5(doc_id::VARCHAR)) END"


@query("x27_mask", f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '****' WHEN 1 THEN 'KEY-****-' || (doc_id + 1000) ELSE left(k, 8) || '****' || right(k, 4) END AS masked FROM (SELECT doc_id, {_KEY} AS k FROM documents)")
def x27(spark, sf_dir):
    h = F.upper(F.md5(F.col("doc_id").cast("string").cast("binary")))
    key = F.when(F.col("doc_id") % 3 == 0, F.left(h, F.lit(6))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("KEY-"), F.left(h, F.lit(8)), F.lit("-"), (F.col("doc_id") + 1000).cast("string"))).otherwise(h)
    return docs(spark, sf_dir).select("doc_id", R.mask_key(F.concat(F.lit(" "), key)).alias("masked"))


_MESSAGES = ["std::bad_alloc in worker", "fetch failed: ECONNRESET", "dlopen failed ERR_DLOPEN_FAILED in lib.dylib", "EACCES: operation not permitted", "Protobuf parsing failed MODEL_HASH_MISMATCH", "request timed out", "HTTP 503 from mirror", "all is well"]
_STAGES = ["worker-start", "native-load", "model-download", "inference"]
_MESSAGE = f"[{', '.join(map(_sql_text, _MESSAGES))}][event_id % {len(_MESSAGES)} + 1]"
_STAGE = f"[{', '.join(map(_sql_text, _STAGES))}][(event_id // 8) % {len(_STAGES)} + 1]"


def _failures(spark, sf_dir):
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", pick(_MESSAGES, F.col("event_id")).alias("message"), pick(_STAGES, F.floor(F.col("event_id") / 8)).alias("stage"))


_M = lambda p: f"regexp_matches(m, {_sql_text(p)})"


@query(
    "x28_failure_codes",
    f"""SELECT event_id, CASE WHEN s = 'worker-start' AND {_M(R.BLOCKED)} THEN 'RUNTIME_EXECUTION_BLOCKED' WHEN {_M(R.OUT_OF_MEMORY)} THEN 'EMBEDDING_MODEL_OOM'
  WHEN s = 'native-load' OR {_M(R.NATIVE)} THEN 'EMBEDDING_NATIVE_LOAD_FAILED' WHEN s = 'model-download' AND {_M(R.NETWORK)} THEN 'EMBEDDING_MODEL_NETWORK_FAILED'
  WHEN {_M(R.CORRUPT)} AND s <> 'inference' THEN 'EMBEDDING_MODEL_CACHE_CORRUPT' WHEN {_M(R.NETWORK)} AND s <> 'inference' THEN 'EMBEDDING_MODEL_NETWORK_FAILED'
  WHEN {_M(R.TIMED_OUT)} THEN 'EMBEDDING_WORKER_TIMEOUT' ELSE 'EMBEDDING_MODEL_WARMUP_FAILED' END AS code,
  CASE WHEN {_M(R.OUT_OF_MEMORY)} THEN 'EMBEDDING_MODEL_OOM' WHEN {_M(R.NATIVE)} OR event_id % 5 = 0 THEN 'EMBEDDING_NATIVE_LOAD_FAILED' ELSE 'EMBEDDING_WORKER_CRASHED' END AS exit_code
FROM (SELECT event_id, {_MESSAGE} AS m, {_STAGE} AS s FROM events)""",
)
def x28(spark, sf_dir):
    signal = F.when(F.col("event_id") % 5 == 0, "SIGILL")
    return _failures(spark, sf_dir).select("event_id", R.failure_code(F.col("message"), F.col("stage")).alias("code"), R.exit_code(F.col("message"), F.lit(1), signal).alias("exit_code"))


@query("x29_evidence", f"SELECT event_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(m, {_sql_text(R.EVIDENCE)}), lambda t: replace(t, ' ', '-')))), '+') AS evidence FROM (SELECT event_id, {_MESSAGE} AS m FROM events)")
def x29(spark, sf_dir):
    return _failures(spark, sf_dir).select("event_id", F.array_join(F.sort_array(R.evidence(F.col("message"))), "+").alias("evidence"))


@query("x30_sizes", "SELECT doc_id, CASE WHEN b >= 1e9 THEN printf('%.1f GB', b / 1e9) ELSE greatest(1, floor(b / 1e6 + 0.5))::BIGINT || ' MB' END AS size, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 900) * 1000000 END AS parameters FROM (SELECT doc_id, n_chars * 250000.0::DOUBLE AS b FROM documents)")
def x30(spark, sf_dir):
    size = F.when(F.col("doc_id") % 2 == 0, F.concat((F.col("doc_id") % 900).cast("string"), F.lit("M"))).otherwise("many")
    return docs(spark, sf_dir).select("doc_id", R.format_bytes(F.col("n_chars") * 250000.0).alias("size"), R.parameter_count(size).alias("parameters"))


@query("a17_manifests", "SELECT source AS model, sum(size)::BIGINT AS download, sum(CASE WHEN kind IN (0, 1) THEN size ELSE 0 END)::BIGINT AS weights, round(188743680 + 3.5::DOUBLE * sum(CASE WHEN kind IN (0, 1) THEN size ELSE 0 END))::BIGINT AS memory FROM (SELECT source, doc_id % 4 AS kind, n_chars * 1000::BIGINT AS size FROM documents) GROUP BY source")
def a17(spark, sf_dir):
    """Documents as files of a model for each source: weights in two forms, and files whose names only hold theirs."""
    ends = F.element_at(F.array(*map(F.lit, (".onnx", ".onnx_data", ".json", ".onnx.txt"))), (F.col("doc_id") % 4 + 1).cast("int"))
    files = docs(spark, sf_dir).select(F.col("source").alias("model"), F.concat("path", ends).alias("path"), (F.col("n_chars") * F.lit(1000).cast("long")).alias("size"))
    return documents.manifest_sizes(files, "model")


@query("x31_folder", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE {_PATH} END AS folder FROM documents")
def x31(spark, sf_dir):
    root = F.lit("/home/me/vault/")
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/home/me/vaults/"), F.col("path"))).otherwise(F.concat(root, F.lit("./"), F.col("path"), F.lit("/")))
    return docs(spark, sf_dir).select("doc_id", R.folder_in(root, path).alias("folder"))


@query("x32_vault_id", f"SELECT doc_id, 'vault-v2-' || left(sha256(nfc_normalize({_PATH})), 16) AS vault, 'vault-v2-' || left(sha256(lower({_PATH})), 16) AS windows FROM documents")
def x32(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", R.vault_id(F.col("path")).alias("vault"), R.vault_id(F.col("path"), windows=True).alias("windows"))


@query("x33_derived_query", f"SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE {_PATH} || chr(10) || chr(10) || coalesce(text, '') END) AS query_md5 FROM documents")
def x33(spark, sf_dir):
    title = F.when(F.col("doc_id") % 2 == 1, F.col("path"))
    return docs(spark, sf_dir).select("doc_id", md5(R.derived_query(title, F.coalesce("text", F.lit("")))).alias("query_md5"))


@query("x34_failure_hash", f"SELECT doc_id, sha256('salt' || chr(0) || {_PATH}) AS hash FROM documents")
def x34(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", R.failure_hash(F.col("path"), "salt").alias("hash"))


@query("m04_normalize", "SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS length, round((embedding[1] * 3)::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: 9 * x::DOUBLE * x::DOUBLE))), 5) AS first FROM embeddings")
def m04(spark, sf_dir):
    unit = V.normalize(F.transform("embedding", lambda x: (x * 3).cast("float")))
    return records(spark, sf_dir).select("id", F.round(V.norm(F.col("embedding")), 5).alias("length"), F.round(F.get(unit, F.lit(0)).cast("double"), 5).alias("first"))


@query("m06_valid", "SELECT vec_id AS id, vec_id % 4 = 0 AS valid FROM embeddings")
def m06(spark, sf_dir):
    e, n = F.col("embedding"), F.col("id") % 4
    made = F.when(n == 1, F.slice(e, 1, 10)).when(n == 2, F.transform(e, lambda x: F.lit(float("nan")).cast("float"))).when(n == 3, F.lit(None).cast("array<float>")).otherwise(e)
    return records(spark, sf_dir).select("id", F.coalesce(V.is_valid(made, 64), F.lit(False)).alias("valid"))


@query("m09_numbers", "SELECT event_id, coalesce(CASE event_id % 3 WHEN 0 THEN round(value, 2) WHEN 1 THEN NULL ELSE 7 END, 0)::DOUBLE AS number FROM events")
def m09(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.round("value", 2).cast("string")).when(F.col("event_id") % 3 == 1, "Infinity").otherwise(" 7 ")
    return table(spark, sf_dir, "events").select("event_id", R.number(text, F.lit(0.0)).alias("number"))


@query("m11_progress", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'downloading' WHEN 2 THEN 'loading' END AS phase, CASE event_id % 4 WHEN 0 THEN 100.0 WHEN 1 THEN least(100, floor((event_id % 1000) / 900.0::DOUBLE * 100 * 100 + 0.5) / 100) ELSE 50.0 END::DOUBLE AS percent FROM events")
def m11(spark, sf_dir):
    kind = F.col("event_id") % 4
    phase = R.phase(F.when(kind == 0, "READY").when(kind == 1, "Progress").when(kind == 2, "done").otherwise("other"))
    loaded = F.when(kind == 1, (F.col("event_id") % 1000).cast("double"))
    return table(spark, sf_dir, "events").select("event_id", phase.alias("phase"), R.percent(F.lit(0.5), loaded, F.lit(900.0), phase).alias("percent"))


@query("n11_recommended", "SELECT lang, CASE WHEN sum(c) / (sum(c) + sum(l) / 4) >= 0.3 THEN 'multilingual' ELSE 'default' END AS model FROM (SELECT lang, len(regexp_extract_all(text, '[一-鿿]')) AS c, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents) GROUP BY lang")
def n11(spark, sf_dir):
    cjk, latin = T.script_counts(F.col("text"))
    sums = docs(spark, sf_dir).groupBy("lang").agg(F.sum(cjk).alias("c"), F.sum(latin).alias("l"))
    return sums.select("lang", R.recommended(F.col("c") / (F.col("c") + F.col("l") / 4), 0.3, "multilingual", "default").alias("model"))


@query("dt1_past", "SELECT o_orderkey, o_orderkey % 5 = 0 OR (o_orderkey % 5 <> 1 AND o_orderdate < TIMESTAMP '1998-01-01') AS past FROM orders")
def dt1(spark, sf_dir):
    kind = F.col("o_orderkey") % 5
    date = F.when(kind == 0, "never").when(kind == 1, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.is_past(date, F.lit("1998-01-01 00:00:00").cast("timestamp")).alias("past"))


@query("dt2_add_days", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS until FROM orders")
def dt2(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(R.add_days(F.col("o_orderdate").cast("timestamp"), 30), "yyyy-MM-dd").alias("until"))


@query("f06_excluded_lists", "SELECT doc_id, source || '|b/' || doc_id AS paths FROM documents")
def f06(spark, sf_dir):
    lists = F.array(F.concat(F.lit(" /"), F.col("source"), F.lit("/ ")), F.lit(""), F.concat(F.lit("b\\"), F.col("doc_id").cast("string")), F.col("source"))
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.normalize_excluded(lists), "|").alias("paths"))


@query("f08_allowed", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')")
def f08(spark, sf_dir):
    return docs(spark, sf_dir).where(T.is_allowed(F.col("path"), ["src1", "src2"])).select("doc_id")


@query("f12_markdown", f"SELECT doc_id FROM documents WHERE doc_id % 2 = 0")
def f12(spark, sf_dir):
    name = F.when(F.col("doc_id") % 2 == 0, F.upper("path")).otherwise(F.concat("path", F.lit(".txt")))
    return docs(spark, sf_dir).where(T.is_markdown(name)).select("doc_id")


@query("f15_validity", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 OR n_chars = 0 THEN 'stale' ELSE 'valid' END AS validity FROM documents")
def f15(spark, sf_dir):
    mtime = F.col("n_chars").cast("double")
    file = F.when(F.col("doc_id") % 5 != 0, F.when(F.col("doc_id") % 7 == 0, mtime + 1).otherwise(mtime))
    return docs(spark, sf_dir).select("doc_id", R.file_validity(file, mtime).alias("validity"))


@query("f18_scope", "SELECT doc_id FROM documents WHERE source = 'src3'")
def f18(spark, sf_dir):
    return docs(spark, sf_dir).where(T.is_under(F.col("path"), F.lit("src3"))).select("doc_id")


@query("f23_models", "SELECT event_type, event_type = 'click' OR count(*) < 2000 AS offered FROM events GROUP BY event_type")
def f23(spark, sf_dir):
    models = table(spark, sf_dir, "events").groupBy("event_type").agg((F.count("*") >= 2000).alias("heavy"))
    return models.select("event_type", R.selectable(F.col("event_type"), F.col("heavy"), 4.0, 8.0, "click").alias("offered"))


@query("f24_context", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'model-download' ELSE 'unknown' END AS stage, least(greatest(floor(value), 0), 100)::BIGINT::VARCHAR AS retries, event_id % 3 = 0 AS has_arch FROM events")
def f24(spark, sf_dir):
    stage, arch = F.when(F.col("event_id") % 2 == 0, "model-download").otherwise("No Stage"), F.when(F.col("event_id") % 3 == 0, "x64").otherwise("sparc")
    made = F.create_map(F.lit("stage"), stage, F.lit("arch"), arch, F.lit("retryCount"), F.col("value").cast("string"), F.lit("secret"), F.lit("s"))
    out = table(spark, sf_dir, "events").withColumn("c", R.setup_context(made))
    return out.select("event_id", F.element_at("c", "stage").alias("stage"), F.element_at("c", "retryCount").alias("retries"), F.map_contains_key("c", "arch").alias("has_arch"))


@query("f25_sensitive", "SELECT event_id, event_id % 2 = 0 AS sensitive FROM events")
def f25(spark, sf_dir):
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("my_Token_"), F.col("event_id").cast("string"))).otherwise("stage")
    return table(spark, sf_dir, "events").select("event_id", T.is_sensitive(name).alias("sensitive"))


@query("f26_collection_names", "SELECT doc_id, doc_id % 3 <> 2 AS valid FROM documents")
def f26(spark, sf_dir):
    tail = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("_"), F.left(md5(F.col("doc_id").cast("string")), F.lit(12)))).otherwise("_new")
    return docs(spark, sf_dir).select("doc_id", R.is_collection_of(F.concat(F.lit("notes_v_m"), tail), "notes", "v", "m").alias("valid"))


@query("u04_unique_paths", "SELECT doc_id, CASE WHEN source = 'src1' THEN 'src1|x' ELSE source || '|src1|x' END AS paths FROM documents")
def u04(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(R.unique_paths(F.array("source", F.lit("src1")), F.array(F.lit(""), F.lit("x"), F.col("source"))), "|").alias("paths"))


@query("s04_vector_codec", "SELECT vec_id AS id, 256 AS bytes, 64 AS numbers, true AS same FROM embeddings")
def s04(spark, sf_dir):
    from quillspark.sources import connect as C

    rows = records(spark, sf_dir).withColumn("blob", C.encode_vector("embedding"))
    return rows.select("id", F.octet_length("blob").alias("bytes"), C.float_size(F.col("blob")).alias("numbers"), (C.decode_vector("blob") == F.col("embedding")).alias("same"))


@query("s05_metadata", "SELECT event_id, len(json_keys(props)) AS keys, len(list_filter(json_keys(props), lambda k: json_type(json_extract(props, '$.\"' || k || '\"')) = 'VARCHAR')) AS texts FROM events")
def s05(spark, sf_dir):
    from quillspark.sources import store

    rows = table(spark, sf_dir, "events").withColumn("m", store.json_scalars(F.col("props"), "string"))
    return rows.where(store.is_valid_metadata(F.col("m"))).select("event_id", F.size("m").cast("long").alias("keys"), F.size(F.filter(F.map_values("m"), lambda v: v.startswith('"'))).cast("long").alias("texts"))


assert ORACLES


# Chunks: the cut as a recursion over pieces, joins as recursions over neighbours.

_S = chunking.SPACE
_TRIM = lambda c: f"regexp_replace({c}, '\\A[{_S}]+|[{_S}]+\\z', '', 'g')"
_CUTS = (f"\n#{{1,3}}[{_S}]", "\n\n", "\n", f"[。！？!?.][{_S}]*")


def _cut_sql(name: str, source: str, limit: int) -> str:
    """Rows (key, text) of source in pieces: (key, path, text), in the order of path."""
    low = "greatest(0, length(text) // 2 - 500)"
    ends = ", ".join(f"length(regexp_extract(middle, '(?s)\\A(.*?(?:{p}))', 1)) AS e{i}" for i, p in enumerate(_CUTS))
    sides = ", ".join(f"{_TRIM(f'text[1:low + e{i}]')} AS a{i}, {_TRIM(f'text[low + e{i} + 1:]')} AS b{i}" for i in range(4))
    pick = "CASE " + " ".join(f"WHEN e{i} > 0 AND a{i} <> '' AND b{i} <> '' THEN [a{i}, b{i}]" for i in range(4)) + " END"
    halves = f"(SELECT key, path, {pick} AS h FROM (SELECT *, {sides} FROM (SELECT *, {ends} FROM (SELECT key, path, text, {low} AS low, text[{low} + 1:length(text) // 2 + 500] AS middle FROM {name}_all WHERE length(text) > {limit}))))"
    return f"""
{name}_all AS (SELECT key, '' AS path, text FROM {source} UNION ALL SELECT key, path || (i - 1)::VARCHAR, h[i] FROM {halves}, (VALUES (1), (2)) t(i) WHERE h IS NOT NULL),
{name}_leaves AS (SELECT * FROM {name}_all a WHERE NOT EXISTS (SELECT 1 FROM {name}_all b WHERE b.key = a.key AND b.path = a.path || '0')),
{name} AS (
  SELECT key, path, text FROM {name}_leaves WHERE length(text) <= {limit}
  UNION ALL SELECT key, path || printf('#%09d', i), text FROM (SELECT key, path, i, {_TRIM(f"text[i * {limit} + 1:(i + 1) * {limit}]")} AS text FROM (SELECT *, unnest(range((length(text) - 1) // {limit} + 1)) AS i FROM {name}_leaves WHERE length(text) > {limit})) WHERE text <> '')"""


_END = "。！？!?.\n"
_CHUNKS = f"""
WITH RECURSIVE cleaned AS (SELECT doc_id, {_clean_sql()} AS text FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, i, line, length(regexp_extract(line, '^(#{{1,3}})[\t\x0b\f\r ]', 1)) AS level FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM cleaned)),
heads AS (
  SELECT *, max(CASE WHEN level > 0 THEN i END) OVER w AS section, max(CASE WHEN level = 1 THEN i END) OVER w AS at1, max(CASE WHEN level IN (1, 2) THEN i END) OVER w AS at2, max(CASE WHEN level > 0 THEN i END) OVER w AS at3
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
titles AS (SELECT doc_id, i, level, trim(regexp_extract(line, '^#{{1,3}}[\t\x0b\f\r ]+(.*)$', 1)) AS title FROM lines WHERE level > 0),
section_rows AS (
  SELECT h.doc_id, coalesce(section, 0) AS section, any_value(at1) AS at1, any_value(at2) AS at2, any_value(at3) AS at3, {_TRIM("string_agg(line, chr(10) ORDER BY h.i) FILTER (WHERE level = 0)")} AS body
  FROM heads h GROUP BY h.doc_id, coalesce(section, 0)),
labelled AS (
  SELECT s.doc_id, s.section, body, concat_ws(' > ', t1.title, CASE WHEN t2.level = 2 THEN t2.title END, CASE WHEN t3.level = 3 THEN t3.title END) AS label
  FROM section_rows s LEFT JOIN titles t1 ON t1.doc_id = s.doc_id AND t1.i = at1 LEFT JOIN titles t2 ON t2.doc_id = s.doc_id AND t2.i = at2 LEFT JOIN titles t3 ON t3.doc_id = s.doc_id AND t3.i = at3
  WHERE body <> ''),
bodies AS (SELECT {{'d': doc_id, 's': section}} AS key, body AS text FROM labelled),
{_cut_sql("part", "bodies", 2000)},
split_parts AS (
  SELECT {{'d': key.d, 's': key.s, 'p': path}} AS key, text, regexp_extract_all(text, '[^{_END}]*[{_END}][{_S}]*|[^{_END}]+\\z') AS pieces FROM part),
said AS (
  SELECT key, text, list_filter(list_transform(pieces, lambda p, i: {{'t': {_TRIM("p")}, 'g': CASE WHEN i = 1 THEN '' ELSE regexp_extract(pieces[i - 1], '[{_S}]*\\z') END}}), lambda s: s.t <> '') AS parts FROM split_parts),
long_parts AS (SELECT key, text FROM said WHERE length(text) > 800 OR len(parts) > 24),
{_cut_sql("slice", "long_parts", 900)},
bags AS (
  SELECT key, parts, list_transform(parts, lambda s: list_distinct(string_split(lower(s.t), ' '))) AS bags FROM said WHERE length(text) <= 800 AND len(parts) BETWEEN 2 AND 24),
far AS (
  SELECT key, parts, list_transform(range(1, len(parts)), lambda i: 1 - len(list_intersect(bags[i], bags[i + 1]))::DOUBLE / len(list_distinct(bags[i] || bags[i + 1]))) AS far FROM bags),
limits AS (
  SELECT *, ascending[floor(pos)::INT + 1] + (ascending[ceil(pos)::INT + 1] - ascending[floor(pos)::INT + 1]) * (pos - floor(pos)) AS most
  FROM (SELECT *, list_sort(far) AS ascending, (len(far) - 1) * 0.9::DOUBLE AS pos FROM far)),
joined AS (
  SELECT key, 1 AS i, 1 AS chunk, parts[1].t AS text FROM limits
  UNION ALL
  SELECT key, i + 1, CASE WHEN apart THEN chunk + 1 ELSE chunk END, CASE WHEN apart THEN said ELSE longer END
  FROM (
    SELECT *, far >= most OR length(longer) > 900 AS apart
    FROM (SELECT j.key, j.i, j.chunk, l.parts[i + 1].t AS said, l.far[i] AS far, l.most, j.text || CASE WHEN regexp_matches(l.parts[i + 1].g, '\n[{_S}]*\n') THEN chr(10) || chr(10) WHEN contains(l.parts[i + 1].g, chr(10)) THEN chr(10) ELSE ' ' END || l.parts[i + 1].t AS longer
      FROM joined j JOIN limits l ON l.key = j.key AND j.i < len(l.parts)))),
pieces AS (
  SELECT key.d AS d, key.s AS s, key.p AS p, printf('%06d', chunk) AS o, arg_max(text, i) AS text FROM joined GROUP BY key, chunk
  UNION ALL SELECT key.d, key.s, key.p, path, text FROM slice
  UNION ALL SELECT key.d, key.s, key.p, '', parts[1].t FROM said WHERE length(text) <= 800 AND len(parts) = 1),
ordered AS (SELECT d, s, row_number() OVER (PARTITION BY d, s ORDER BY p, o) AS n, {_TRIM("text")} AS text FROM pieces WHERE {_TRIM("text")} <> ''),
merged AS (
  SELECT d, s, n, 1 AS chunk, text FROM ordered WHERE n = 1
  UNION ALL
  SELECT m.d, m.s, o.n, CASE WHEN length(m.text) > 50 THEN m.chunk + 1 ELSE m.chunk END, CASE WHEN length(m.text) > 50 THEN o.text ELSE m.text || chr(10) || o.text END
  FROM merged m JOIN ordered o ON o.d = m.d AND o.s = m.s AND o.n = m.n + 1),
made AS (SELECT d, s, chunk, arg_max(text, n) AS text, max(chunk) OVER (PARTITION BY d, s) AS most FROM merged GROUP BY d, s, chunk),
ended AS (
  SELECT d, s, CASE WHEN chunk = most AND length(text) <= 50 AND chunk > 1 THEN chunk - 1 ELSE chunk END AS chunk, string_agg(text, chr(10) ORDER BY chunk) AS text FROM made GROUP BY ALL),
kept AS (SELECT d, text, label, row_number() OVER (PARTITION BY d ORDER BY s, chunk) - 1 AS chunk_index FROM ended JOIN labelled ON doc_id = d AND section = s WHERE length(text) >= 10)
SELECT d || '::chunk-' || chunk_index AS id, d AS doc_id, chunk_index::INT AS chunk_index, (count(*) OVER (PARTITION BY d))::INT AS chunk_count, label AS section_label, md5(text) AS content_md5 FROM kept
"""


@query("x08_chunks", _CHUNKS)
def x08(spark, sf_dir):
    """Chunks of all documents; neighbouring sentences are compared by their words."""
    found = chunking.chunk_documents(table(spark, sf_dir, "documents"), None)
    return found.select("id", "doc_id", "chunk_index", "chunk_count", "section_label", md5(F.col("content")).alias("content_md5"))

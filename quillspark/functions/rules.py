"""Rules as column expressions: failure codes, evidence, masks, names, dates, progress, limits, file states, query texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions import text as T

#: The patterns of failure texts, and of tokens that explain a failure.
BLOCKED = r"(?i)\bEACCES\b|\bEPERM\b|spawn UNKNOWN|operation not permitted|Access is denied|blocked by|quarantine"
OUT_OF_MEMORY = r"(?i)bad_alloc|out of memory|Cannot allocate memory|ENOMEM|Array buffer allocation failed|allocation failed|heap out of memory|Failed to allocate"
NATIVE = (
    r"(?i)ERR_DLOPEN_FAILED|specified module could not be found|specified procedure could not be found|dlopen|Library not loaded|image not found|"
    r"not a valid Win32 application|onnxruntime_binding|Cannot find module ['\"]onnxruntime-node|wrong ELF class|incompatible architecture|Illegal instruction|SIGILL"
)
NETWORK = (
    r"(?i)fetch failed|ENOTFOUND|ECONNRESET|ECONNREFUSED|ETIMEDOUT|EAI_AGAIN|ENETUNREACH|EHOSTUNREACH|UND_ERR|socket hang up|certificate|CERT_|self[- ]signed|"
    r"unable to verify|network|status(?: code)? (?:4|5)\d\d|HTTP (?:4|5)\d\d|DOWNLOAD_[A-Z_]+"
)
CORRUPT = (
    r"(?i)protobuf|Protobuf parsing failed|invalid model|Load model .*failed|ModelProto|corrupt|unexpected end|Unexpected token|in JSON at position|"
    r"Could not locate file|not found locally|ENOENT|no such file|MODEL_FILE_[A-Z_]+|MODEL_HASH_MISMATCH"
)
TIMED_OUT = r"(?i)timed out|timeout"
EVIDENCE = (
    r"\b(?:ERR_[A-Z0-9_]{3,60}|UND_ERR_[A-Z_]{3,40}|E[A-Z]{3,15}|SIG[A-Z]{2,8}|DOWNLOAD_[A-Z_]{3,40}|MODEL_[A-Z_]{3,40})\b|"
    r"\b(?:HTTP|status(?: code)?) ?[1-5]\d\d\b|\b[A-Za-z0-9_.-]{1,40}\.(?:dll|dylib|node|so)\b|\bbad_alloc\b"
)
SAFE_TOKEN, MOST_EVIDENCE = r"^[A-Za-z0-9._:-]{1,40}$", 4
ILLEGAL_INSTRUCTION = 3221225501
CONTEXT_NUMBERS = {"durationMs": 86_400_000, "receivedBytes": 2**53 - 1, "retryCount": 100, "copiedRecords": 2**53 - 1, "totalRecords": 2**53 - 1, "sourceBytes": 2**53 - 1}
WORKER_BYTES, BYTES_PER_WEIGHT = 180 * 1024 * 1024, 3.5
#: Fixed pattern: files that hold weights.
WEIGHT_FILES = r"\.onnx(_data)?$"
LOWEST_ZOOM, HIGHEST_ZOOM = 0.4, 1.8
DOWNLOADING, LOADING = ("progress", "download", "downloading", "initiate"), ("done", "loading", "loaded")


@F.pandas_udf(StringType())
def compose(texts: pd.Series) -> pd.Series:
    """Unicode in composed form (NFC); Spark has no function for it."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(text: Column) -> Column:
    """NFC; texts of ASCII need no change and don't leave the JVM for their value."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(compose(text))


def evidence(text: Column, *extra: Column) -> Column:
    """At most four distinct safe tokens that explain a failure, those of extra first."""
    found = F.concat(F.array(*[e.cast("string") for e in extra]).cast("array<string>"), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EVIDENCE), F.lit(0)))
    tokens = F.transform(F.filter(found, lambda t: t.isNotNull() & (t != "")), lambda t: F.regexp_replace(t, r"\s+", "-"))
    return F.slice(F.array_distinct(F.filter(tokens, lambda t: t.rlike(SAFE_TOKEN))), 1, MOST_EVIDENCE)


def failure_code(text: Column, stage: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (
        F.when((stage == "worker-start") & t.rlike(BLOCKED), "RUNTIME_EXECUTION_BLOCKED")
        .when(t.rlike(OUT_OF_MEMORY), "EMBEDDING_MODEL_OOM")
        .when((stage == "native-load") | t.rlike(NATIVE), "EMBEDDING_NATIVE_LOAD_FAILED")
        .when((stage == "model-download") & t.rlike(NETWORK), "EMBEDDING_MODEL_NETWORK_FAILED")
        .when(t.rlike(CORRUPT) & (stage != "inference"), "EMBEDDING_MODEL_CACHE_CORRUPT")
        .when(t.rlike(NETWORK) & (stage != "inference"), "EMBEDDING_MODEL_NETWORK_FAILED")
        .when(t.rlike(TIMED_OUT), "EMBEDDING_WORKER_TIMEOUT")
        .otherwise("EMBEDDING_MODEL_WARMUP_FAILED")
    )


def exit_code(stderr: Column, code: Column, signal: Column) -> Column:
    native = stderr.rlike(NATIVE) | F.coalesce(signal == "SIGILL", F.lit(False)) | F.coalesce(code == ILLEGAL_INSTRUCTION, F.lit(False))
    return F.when(stderr.rlike(OUT_OF_MEMORY), "EMBEDDING_MODEL_OOM").when(native, "EMBEDDING_NATIVE_LOAD_FAILED").otherwise("EMBEDDING_WORKER_CRASHED")


def mask_key(key: Column) -> Column:
    """A key with its middle hidden."""
    k = F.trim(key)
    parts = F.split(k, "-")
    named = F.concat(F.get(parts, F.lit(0)), F.lit("-****-"), F.element_at(parts, -1))
    return F.when(F.length(k) <= 8, "****").when((F.size(parts) >= 3) & (F.get(parts, F.lit(0)) != ""), named).otherwise(F.concat(F.substring(k, 1, 8), F.lit("****"), F.right(k, F.lit(4))))


def number(value: Column, rest) -> Column:
    """A finite number, else rest."""
    n = value.cast("string").try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")), n).otherwise(rest)


def percent(progress: Column, loaded: Column, total: Column, phase: Column) -> Column:
    """Progress of 0 to 100 with two decimals: bytes count before the stated progress, which may be a fraction."""
    sane = lambda c: F.when((c >= 0) & (c < float("inf")), c)
    p, low, high = sane(progress), sane(loaded), sane(total)
    p = F.when(p <= 1, p * 100).otherwise(p)
    p = F.when(low.isNotNull() & (high > 0), low / high * 100).otherwise(p)
    return F.when(phase == "ready", F.lit(100.0)).otherwise(F.least(F.greatest(F.floor(p * 100 + 0.5) / 100, F.lit(0.0)), F.lit(100.0)))


def phase(status: Column) -> Column:
    s = F.lower(status)
    return F.when(s == "ready", "ready").when(s.isin(*DOWNLOADING), "downloading").when(s.isin(*LOADING), "loading")


def parameter_count(size: Column) -> Column:
    """'270M' or '0.6B' as a number."""
    found = r"(?i)^(\d+(?:\.\d+)?)\s*([MB])$"
    s = F.trim(size)
    unit = F.when(F.upper(F.regexp_extract(s, found, 2)) == "B", 1e9).otherwise(1e6)
    return F.when(s.rlike(found), F.round(F.regexp_extract(s, found, 1).try_cast("double") * unit).cast("long"))


def one_decimal(value: Column) -> Column:
    """A number from 1 with one decimal, rounded by the exact value of the double, a tie to the even digit, as C's printf does; Java rounds its shortest
    decimal form, ties away from zero. The part behind the point is a whole number of 2 ** -52."""
    small = F.when((value >= 1) & (value < 2.0**53), value)  # larger ones have nothing behind the point
    tenfold = ((small - F.floor(small)) * float(1 << 52)).cast("long") * 10
    digit, rest = F.shiftright(tenfold, 52), tenfold.bitwiseAND(F.lit((1 << 52) - 1))
    up = (rest > 1 << 51) | ((rest == 1 << 51) & (digit % 2 == 1))
    tenths = F.floor(small) * 10 + digit + F.when(up, 1).otherwise(0)
    text = tenths.cast("string")
    return F.coalesce(F.concat(F.left(text, F.length(text) - 1), F.lit("."), F.right(text, F.lit(1))), F.format_string("%.1f", value))


def format_bytes(size: Column, unknown: str = "unknown") -> Column:
    mb = F.greatest(F.lit(1), F.floor(size / 1e6 + 0.5)).cast("string")
    return F.when(size.isNull(), unknown).when(size >= 1e9, F.concat(one_decimal(size / 1e9), F.lit(" GB"))).otherwise(F.concat(mb, F.lit(" MB")))


def model_memory(weights: Column) -> Column:
    """Resident bytes of a worker with so many bytes of weights."""
    return F.round(WORKER_BYTES + weights * BYTES_PER_WEIGHT).cast("long")


def selectable(key: Column, heavy: Column, memory_gb: float | None, low_below_gb: float, current: str) -> Column:
    """Whether a model is offered: on devices of little memory heavy ones are hidden, but for the current one."""
    low = memory_gb is not None and memory_gb < low_below_gb
    return (key == current) | F.lit(not low) | ~heavy


def recommended(ratio: Column, share: float, preferred: str, default: str, preferred_fits: bool = True) -> Column:
    """The model for a share of CJK characters."""
    return F.when(F.coalesce(ratio >= share, F.lit(False)) & F.lit(preferred_fits), preferred).otherwise(default)


def is_past(date: Column, now: Column) -> Column:
    """An ISO date before now; empty ones never are, unreadable ones always."""
    return F.when(date.isNull() | (date == ""), F.lit(False)).otherwise(F.coalesce(F.try_to_timestamp(date) < now, F.lit(True)))


def add_days(date: Column, days) -> Column:
    return date + F.make_interval(days=F.lit(days))


def vault_id(path: Column, windows: bool = False) -> Column:
    p = composed(path)
    return F.concat(F.lit("vault-v2-"), F.substring(F.sha2(F.lower(p) if windows else p, 256), 1, 16))


def folder_in(root: Column, path: Column) -> Column:
    """The path below root, with forward slashes; null for the root itself and for what lies outside."""
    clean = lambda p: F.regexp_replace(F.regexp_replace(T.normalize_path(p), r"/(\./)+", "/"), "/+$", "")
    a, b = clean(root), clean(path)
    inside = b.startswith(F.concat(a, F.lit("/"))) & ~b.rlike(r"(^|/)\.\.(/|$)")
    return F.when(inside, F.substr(b, F.length(a) + 2))


def failure_hash(path: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt + "\x00"), composed(path)), 256)


def derived_query(title: Column, content: Column) -> Column:
    """A result as a query: title, blank line, content."""
    return F.when(F.coalesce(title, F.lit("")) == "", content).otherwise(F.concat(title, F.lit("\n\n"), content))


def tab_title(text: Column, length: int = 15, rest: str = "搜索") -> Column:
    t = T.collapse(text, length)
    return F.when(F.coalesce(t, F.lit("")) == "", rest).otherwise(t)


def unique_paths(*lists: Column) -> Column:
    """Lists of paths as one, each once, in order; empty ones go."""
    return F.array_distinct(F.filter(F.concat(*lists), lambda p: p.isNotNull() & (p != "")))


def prompt(template: str, content: Column, mark: str = "{page_content}") -> Column:
    """The template with the content in place of its mark, or behind it in a fence."""
    t = template.strip()
    return F.replace(F.lit(t), F.lit(mark), content) if mark in t else F.concat(F.lit(f"{t}\n\ncontent:\n```\n"), content, F.lit("\n```"))


def model_input(text: Column, limit: int, prefix: str = "") -> Column:
    return F.substring(F.concat(F.lit(prefix), text), 1, limit)


def file_validity(file_mtime: Column, indexed_mtime: Column) -> Column:
    """missing without a file, valid if it is as indexed, else stale."""
    same = F.coalesce((indexed_mtime > 0) & (file_mtime == indexed_mtime), F.lit(False))
    return F.when(file_mtime.isNull(), "missing").when(same, "valid").otherwise("stale")


def is_collection_of(name: Column, prefix: str, vault: str, model: str) -> Column:
    """The name is prefix_vault_model, or that and twelve hexadecimal digits."""
    return name.rlike("^\\Q" + f"{prefix}_{vault}_{model}" + "\\E(_[0-9a-f]{12})?$")


def setup_context(context: Column) -> Column:
    """Allowed fields of a map of strings: numbers cut to their range, names that fit their patterns, the rest left out."""
    numbers = F.create_map(*[x for k, v in CONTEXT_NUMBERS.items() for x in (F.lit(k), F.lit(float(v)))])
    patterns = {"errorCode": "^[A-Z][A-Z0-9_]{2,80}$", "platform": "^(darwin|win32|linux)$", "arch": "^(arm64|x64)$", "runtimeId": "^[a-z0-9][a-z0-9._-]{0,127}$", "stage": "^[a-z0-9-]{1,64}$", "portConflict": "^(true|false)$"}
    rules = F.create_map(*[x for k, v in patterns.items() for x in (F.lit(k), F.lit(v))])
    limit = lambda k: F.try_element_at(numbers, k)
    fits = lambda k, v: F.when(limit(k).isNotNull(), v.try_cast("double").isNotNull() & ~F.isnan(v.try_cast("double"))).otherwise(F.coalesce(F.regexp_like(v, F.try_element_at(rules, k)), F.lit(False)))
    cut = lambda k, v: F.when(limit(k).isNotNull(), F.least(F.greatest(F.floor(v.try_cast("double")).cast("double"), F.lit(0.0)), limit(k)).cast("long").cast("string")).otherwise(v)
    kept = F.transform_values(F.map_filter(context, fits), cut)
    return F.when(F.map_contains_key(kept, "stage"), kept).otherwise(F.map_concat(kept, F.create_map(F.lit("stage"), F.lit("unknown"))))


def zoom(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(LOWEST_ZOOM)), F.lit(HIGHEST_ZOOM))

"""Text expressions: paths, redaction, evidence, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges of CJK characters; the redaction patterns in their order; fields that hold secrets.
CJK = r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff]"
REDACTIONS = (
    (r"(?i)C:\\Users\\[^\\\s]+", "<user-home>"),
    (r"/Users/[^/\s]+", "<user-home>"),
    (r"/home/[^/\s]+", "<user-home>"),
    (r"([A-Za-z]:\\[^\s\"<>|:*?]+|/[^\s\"<>|:*?]+)", "<path>"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"),
    (r"(?i)Bearer\s+[a-zA-Z0-9_\-./=]{8,}", "Bearer <token>"),
    (r"(?i)([?&])(token|api_key|apikey|key|auth|secret|license)=([^&\s]*)", "$1$2=<token>"),
    (r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"),
)
SENSITIVE = ("license", "token", "secret", "password", "apikey", "api_key", "email", "vaultpath", "basepath", "path")
REDACTED_LENGTH = 16384


def normalize_path(path: Column) -> Column:
    """Forward slashes. Unicode composition is left to the reader, as Spark has no function for it."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normalize_excluded(paths: Column) -> Column:
    """Trimmed, forward slashes, no slashes at the ends, no empty or repeated entries, first come first."""
    cleaned = F.transform(paths, lambda p: F.regexp_replace(normalize_path(F.trim(p)), "^/+|/+$", ""))
    return F.array_distinct(F.filter(cleaned, lambda p: p != ""))


def is_under(path: Column, prefix: Column) -> Column:
    """The path is the prefix or lies below it."""
    return (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def is_excluded(path: Column, excluded: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in excluded]).cast("array<string>"), lambda p: is_under(path, p)) if excluded else F.lit(False)


def is_allowed(path: Column, allowed: list[str]) -> Column:
    """An empty list allows all; otherwise a row needs a path under an entry."""
    return F.coalesce(is_excluded(path, allowed), F.lit(False)) if allowed else F.lit(True)


def is_markdown(path: Column) -> Column:
    return F.lower(path).endswith(".md")


def relative_path(path: Column) -> Column:
    """The path with forward slashes, or null if it is not a plain relative one of at most 1024 characters."""
    p = normalize_path(path)
    bad = (F.length(p) == 0) | (F.length(p) > 1024) | F.contains(p, F.lit("\x00")) | p.startswith("/") | p.rlike("^[A-Za-z]:")
    bad = bad | F.exists(F.split(p, "/"), lambda s: s.isin("", ".", ".."))
    return F.when(~bad, p)


def redact(text: Column, salt: str = "", root: str | None = None, license_prefix: str | None = None) -> Column:
    """Known secrets and paths become placeholders; files under root keep a salted hash of their path. license_prefix is
    what a product's keys begin with."""
    out = text
    if license_prefix:
        out = F.regexp_replace(out, "(?i)\\Q" + license_prefix + "\\E-[A-Z0-9_-]{8,}", "<license-key>")
    if root:
        at = F.lit(root.replace("\\", "/"))
        rest = F.regexp_extract(out, "\\Q" + root.replace("\\", "/") + "\\E" + r"([^\s\"'<>|:*?]*)", 1)
        marked = F.when(rest == "", F.lit("<root>")).otherwise(F.concat(F.lit("<root>/<file:"), path_hash(rest, salt), F.lit(">")))
        out = F.when(F.contains(out, at), F.replace(out, F.concat(at, rest), marked)).otherwise(out)
    for pattern, by in REDACTIONS:
        out = F.regexp_replace(out, pattern, by)
    return F.substring(out, 1, REDACTED_LENGTH)


def path_hash(path: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), path), 256), 1, 8)


def is_sensitive(field: Column) -> Column:
    return F.lower(field).rlike("|".join(SENSITIVE))


def truncate_utf8(text: Column, limit: int) -> Column:
    """At most limit bytes of UTF-8, whole characters, and an ellipsis if something went."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, limit)
    # What a cut leaves of a character at the end: a leading byte without all of its followers.
    tail = F.regexp_extract(F.hex(cut), "(?:(?:C|D)[0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-9A-F](?:[89AB][0-9A-F]){0,2})$", 0)
    kept = F.decode(F.substr(cut, F.lit(1), F.octet_length(cut) - (F.length(tail) / 2).cast("int")), "UTF-8")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(kept, F.lit("…")))


def collapse(text: Column, length: int) -> Column:
    """White space as single blanks, cut to a length."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, length)


def first_line(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def legacy_id(path: Column, created: Column) -> Column:
    return F.concat(path, F.lit("::"), created.cast("string"))


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit("::chunk-"), index.cast("string"))


def legacy_chunk_index(chunk_id: Column) -> Column:
    return F.coalesce(F.regexp_extract(chunk_id, r"chunk-(\d+)$", 1).try_cast("int"), F.lit(0))


def script_counts(text: Column) -> tuple[Column, Column]:
    """Characters of CJK scripts and of the Latin alphabet, without code, links and addresses."""
    t = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?|```.*?```|`[^`]*`|https?://\S+", " ")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_count(t, F.lit(CJK)), F.regexp_count(t, F.lit("[A-Za-z]"))


def strip_fence(text: Column) -> Column:
    """What stands inside a fence around the whole text, else the text."""
    inner = F.regexp_extract(F.trim(text), r"(?s)\A(`{3,})[^\n]*\n(.*?)\n?\1\s*\z", 2)
    return F.when(F.trim(text).rlike(r"(?s)\A(`{3,})[^\n]*\n.*\n?\1\s*\z"), F.trim(inner)).otherwise(F.trim(text))

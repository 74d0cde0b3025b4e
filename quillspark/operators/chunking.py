"""From Markdown to chunks: cleaning, sections, sentences, splits by meaning and size, merging of short pieces.

Cleaning is a chain of JVM expressions. The cuts depend on each other from the beginning of a text to its end: they are small functions over one text in
Arrow batches, without a shuffle. Each has a form as an expression too, folds over a stack of pieces, which Spark interprets at some thirty
times the cost. The distance of neighbouring sentences comes from their words or from an encoder, a function
from texts to a matrix, by default a hashing encoder without a model.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quillspark.functions import rules

#: The cleaning rules in their order (Java syntax) and the limits in characters.
CLEANING = (
    (r"\A---\n[\s\S]*?\n---\n?", ""),
    (r"(?md)^(`{3,}|~{3,}).*\n[\s\S]*?\n\1\s*$", ""),
    (r"%%[\s\S]*?%%", ""),
    (r"\$\$[\s\S]*?\$\$", ""),
    (r"(?d)!\[\[.*?\]\]", ""),
    (r"\[\[(?:[^\]|]*?\|)?([^\]]*?)\]\]", "$1"),
    (r"(?s)!\[.*?\]\(.*?\)", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"\[\^[^\]]+\]", ""),
    (r"(?md)^\|[-:\s|]+\|$", ""),
    (r"(?md)^(\s*>)+\s?", ""),
    (r"\[![\w-]+\]", ""),
    (r"(?md)^[-*_]{3,}\s*$", ""),
    (r"(?md)^\s*[-*+]\s+", ""),
    (r"(?md)^\s*\d+\.\s+", ""),
    (r"(?md)^\[\^[^\]]+\]:\s*", ""),
    (r"`([^`]*)`", "$1"),
    (r"\$[^$\n]+\$", ""),
    (r"(?d)</?[^>]+(>|\z)", ""),
    (r"[*_~]{1,3}", ""),
    (r"==", ""),
    (r"https?://[^\s)>\]]+", ""),
    (r"\n{3,}", "\n\n"),
)
TABLE_RULE = 10  # rows of tables are rewritten before this rule
SEMANTIC_LIMIT, CHUNK_LIMIT, SECTION_LIMIT = 800, 900, 2000
MOST_SENTENCES, BREAK_PERCENTILE, SHORT, LEAST = 24, 90, 50, 10
FILE_BYTES, TEXT_CHARS, QUERY_CHARS = 45_000, 15_000, 5_000
#: White space as the texts' editor knows it, for a character class.
SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPLITS = (f"\n#{{1,3}}[{SPACE}]", "\n\n", "\n", f"[。！？!?.][{SPACE}]*")
#: The same, one by one.
SPACES = SPACE.replace("\u2000-\u200a", "".join(map(chr, range(0x2000, 0x200B))))
#: A cut lies this near to the middle.
NEAR_MIDDLE = 500
SENTENCE_END = "。！？!?.\n"

Encoder = Callable[[list[str]], np.ndarray]


def clean(text: Column) -> Column:
    """Markdown without its marks; headings stay."""
    out = text
    for i, (pattern, by) in enumerate(CLEANING):
        if i == TABLE_RULE:
            rows = F.transform(F.split(out, "\n"), lambda x: F.when(x.rlike(r"^\|.+\|$"), F.trim(F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit("|"), F.lit(" ")))).otherwise(x))
            out = F.array_join(rows, "\n")
        out = F.regexp_replace(out, pattern, by)
    return F.regexp_replace(out, r"\A\s+|\s+\z", "")


def search_text(text: Column, limit: int = QUERY_CHARS) -> Column:
    """A document as a query: cleaned, without heading marks, cut to the limit."""
    return F.substring(F.regexp_replace(F.regexp_replace(clean(text), r"(?m)^#{1,6}\s+", ""), r"\A\s+|\s+\z", ""), 1, limit)


def skip_reason(size: Column, text: Column) -> Column:
    return F.when(size > FILE_BYTES, "file too large").when(F.length(text) > TEXT_CHARS, "text too long")


def hashing_encoder(texts: list[str], dimension: int = 64) -> np.ndarray:
    """Unit vectors of hashed words and character trigrams: equal texts are equal, similar ones near."""
    out = np.zeros((len(texts), dimension))
    for row, text in zip(out, texts):
        low = text.lower()
        for token in (*low.split(), *(low[i : i + 3] for i in range(len(low) - 2))):
            h = zlib.crc32(token.encode())
            row[h % dimension] += 1 if h >> 16 & 1 else -1
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length == 0, 1, length)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once, also where use takes it into a fold."""
    return F.transform(F.array(value), use)[0]


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def _texts(*values: Column) -> Column:
    return F.array(*values).cast("array<string>")


def sections(text: Column) -> Column:
    """Array of (label, body): the parts under headings of level 1 to 3 with their breadcrumb; empty bodies are left out."""
    heading = r"\A(#{1,3})[^\S\n]+([^\n]*)"
    parts = F.transform(F.split(text, r"(?m)^(?=#{1,3}[^\S\n])"), lambda p: F.struct(F.length(F.regexp_extract(p, heading, 1)).alias("level"), F.trim(F.regexp_extract(p, heading, 2)).alias("title"), trimmed(F.regexp_replace(p, heading, "")).alias("body")))
    kind = "struct<out:array<struct<label:string,body:string>>,path:array<string>>"

    def step(acc, p):
        # A heading takes the place of its level and clears those below.
        path = F.when(p["level"] == 0, acc["path"]).otherwise(F.transform(acc["path"], lambda t, i: F.when(i == p["level"] - 1, p["title"]).when(i < p["level"] - 1, t)))
        entry = lambda at: F.array(F.struct(F.array_join(F.array_compact(at), " > ").alias("label"), p["body"].alias("body")))
        return let(path, lambda at: F.struct(F.when(p["body"] == "", acc["out"]).otherwise(F.concat(acc["out"], entry(at))).alias("out"), at.alias("path")).cast(kind))

    empty = F.struct(F.array().cast("array<struct<label:string,body:string>>").alias("out"), F.array(*[F.lit(None).cast("string")] * 3).alias("path")).cast(kind)
    return F.aggregate(parts, empty, step, lambda acc: acc["out"])


def sentences(text: Column) -> Column:
    """Array of (sentence, glue): a sentence ends at each end mark; glue is what joins it to the one before, by the white
    space between them: a blank line, a line break or a space."""
    pieces = F.regexp_extract_all(text, F.lit(f"[^{SENTENCE_END}]*[{SENTENCE_END}][{SPACE}]*|[^{SENTENCE_END}]+\\z"), F.lit(0))

    def entry(all_pieces):
        def of(p, i):
            gap = F.when(i > 0, let(F.get(all_pieces, i - 1), lambda q: F.substring(q, F.length(F.rtrim(q, F.lit(SPACES))) + 1, F.length(q)))).otherwise("")
            glue = let(gap, lambda g: F.when(g.rlike(f"\n[{SPACE}]*\n"), "\n\n").when(F.contains(g, F.lit("\n")), "\n").otherwise(" "))
            return F.struct(trimmed(p).alias("text"), glue.alias("glue"))

        return F.filter(F.transform(all_pieces, of), lambda s: s["text"] != "")

    return let(pieces, entry)


def halves(text: Column) -> Column:
    """Two parts of a text, cut behind a separator near the middle: the first of the best kind there that leaves something on
    both sides. Null where there is none."""
    low = F.greatest(F.lit(0), F.floor(F.length(text) / 2) - NEAR_MIDDLE).cast("int")

    def cut(pattern):
        def at(end):
            both = _texts(trimmed(F.substring(text, F.lit(1), end)), trimmed(F.substring(text, end + 1, F.length(text))))
            return let(both, lambda b: F.when(~F.array_contains(b, ""), b))

        middle = F.substring(text, low + 1, (F.floor(F.length(text) / 2) + NEAR_MIDDLE - low).cast("int"))
        # What a split into two leaves behind the first separator tells where it ends.
        return let(middle, lambda m: let(F.split(m, pattern, 2), lambda two: F.when(F.size(two) == 2, at(low + F.length(m) - F.length(two[1])))))

    return F.coalesce(*[cut(p) for p in SPLITS])


def slices(text: Column, limit: int) -> Column:
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / limit).cast("int")), lambda i: trimmed(F.substring(text, i * limit + 1, F.lit(limit))))
    return F.filter(parts, lambda p: p != "")


def within(text: Column, limit: int) -> Column:
    """Array of the pieces of a text, none longer than the limit: halves of halves, slices where no separator is near.

    A fold over a stack: each step takes the first piece, which is done, or gives way to its halves or slices. A separator
    serves one cut at most, so twice their number bounds the steps; those after the last piece do nothing.
    """
    kind = "struct<todo:array<string>,done:array<string>>"
    state = lambda todo, done: F.struct(todo.alias("todo"), done.alias("done")).cast(kind)

    def step(acc, _):
        def of(piece):
            rest = F.slice(acc["todo"], F.lit(2), F.size(acc["todo"]))
            parts = F.when(F.length(piece) > limit, halves(piece))
            return let(parts, lambda h: F.when(h.isNotNull(), state(F.concat(h, rest), acc["done"])).when(F.length(piece) > limit, state(rest, F.concat(acc["done"], slices(piece, limit)))).otherwise(state(rest, F.concat(acc["done"], _texts(piece)))))

        return F.when(F.size(acc["todo"]) == 0, acc).otherwise(let(acc["todo"][0], of))

    def whole(t):
        steps = F.sequence(F.lit(0), 2 * F.regexp_count(t, F.lit("[\n。！？!?.]")) + 1)
        return F.when(F.length(t) <= limit, _texts(t)).otherwise(F.aggregate(steps, state(_texts(t), _texts()), step, lambda acc: acc["done"]))

    return let(text, whole)


def merge_short(pieces: Column) -> Column:
    """Short pieces join what follows; a short end joins what it follows."""
    kind = "struct<out:array<string>,held:string>"
    state = lambda out, held: F.struct(out.alias("out"), held.alias("held")).cast(kind)
    join = lambda a, b: F.concat(a, F.lit("\n"), b)

    def step(acc, piece):
        longer = F.when(acc["held"] == "", piece).otherwise(join(acc["held"], piece))
        return let(longer, lambda h: F.when(F.length(h) > SHORT, state(F.concat(acc["out"], _texts(h)), F.lit(""))).otherwise(state(acc["out"], h)))

    def end(acc):
        last = F.try_element_at(acc["out"], F.lit(-1))
        mended = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), _texts(join(last, acc["held"])))
        return F.when(acc["held"] == "", acc["out"]).when(F.size(acc["out"]) == 0, _texts(acc["held"])).otherwise(mended)

    clean_pieces = F.filter(F.transform(pieces, trimmed), lambda p: p != "")
    return F.aggregate(clean_pieces, state(_texts(), F.lit("")), step, end)


def percentile(values: Column, p: float) -> Column:
    """Linear interpolation between the closest ranks of an array."""
    at = (F.size(values) - 1) * F.lit(p)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    return let(F.array_sort(values), lambda v: F.get(v, low) + (F.get(v, high) - F.get(v, low)) * (at - low))


def is_short(text: Column, parts: Column) -> Column:
    """Whether a text is joined by meaning: not too long, and of 2 to 24 sentences."""
    return (F.length(text) <= SEMANTIC_LIMIT) & F.size(parts).between(2, MOST_SENTENCES)


def by_meaning(text: Column, parts: Column, distances: Column) -> Column:
    """Array of chunks that end where neighbouring sentences are farthest apart or the limit is reached. parts: sentences(text);
    distances: of each sentence to the next. Texts that are too long for this are cut by size."""

    def joined(parts, distances, limit):
        def step(acc, i):
            last, part = F.element_at(acc, -1), F.get(parts, i)
            apart = (F.get(distances, i - 1) >= limit) | (F.length(last) + F.length(part["glue"]) + F.length(part["text"]) > CHUNK_LIMIT)
            return F.when(apart, F.concat(acc, _texts(part["text"]))).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), _texts(F.concat(last, part["glue"], part["text"]))))

        return F.aggregate(F.sequence(F.lit(1), F.size(parts) - 1), _texts(parts[0]["text"]), step)

    def of(r):
        text, parts, far = r["text"], r["parts"], r["far"]
        alone = (F.length(text) <= SEMANTIC_LIMIT) & (F.size(parts) <= 1)
        by_distance = let(percentile(far, BREAK_PERCENTILE / 100), lambda limit: joined(parts, far, limit))
        return F.when(is_short(text, parts), by_distance).when(alone, F.transform(parts, lambda s: s["text"])).otherwise(within(text, CHUNK_LIMIT))

    return let(F.struct(text.alias("text"), parts.alias("parts"), distances.alias("far")), of)


def word_distance(texts: Column) -> Column:
    """Of each text to the next: 1 less the share of their lower-cased words that both have."""
    bag = lambda i: F.array_distinct(F.split(F.lower(F.get(texts, i)), " "))
    far = lambda a, b: 1 - F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.transform(F.sequence(F.lit(0), F.size(texts) - 2), lambda i: far(bag(i), bag(i + 1)))


def neighbours(encode: Encoder | None) -> Callable[[list[str]], list[float]]:
    """The distance of each text to the next: 1 less the cosine of their vectors, or by their words without an encoder."""

    def by_words(texts) -> list[float]:
        bags = [set(t.lower().split(" ")) for t in texts]
        return [1 - len(a & b) / len(a | b) for a, b in zip(bags, bags[1:])]

    def by_vectors(texts) -> list[float]:
        if len(texts) < 2:
            return []
        v = np.asarray(encode(list(texts)))
        length = np.linalg.norm(v[:-1], axis=1) * np.linalg.norm(v[1:], axis=1)
        return (1 - np.where(length == 0, 0, (v[:-1] * v[1:]).sum(1) / np.where(length == 0, 1, length))).tolist()

    return by_words if encode is None else by_vectors


def encoded_distance(encode: Encoder) -> Callable[[Column], Column]:
    """The same by an encoder for the nested arrays of a document, in Arrow batches."""
    of = neighbours(encode)

    @F.pandas_udf("array<array<array<double>>>")
    def run(documents: pd.Series) -> pd.Series:
        return pd.Series([[[of(part) for part in section] for section in document] for document in documents], dtype=object)

    return run


_HEADING = re.compile(r"^(#{1,3})[\t\x0b\f\r ]+([^\n]*)", re.MULTILINE)
_SENTENCE = re.compile(f"[^{SENTENCE_END}]*[{SENTENCE_END}][{SPACE}]*|[^{SENTENCE_END}]+\\Z")
_CUTS = [re.compile(p) for p in SPLITS]
_BLANK_LINE = re.compile(f"\n[{SPACE}]*\n")


def text_sections(text: str) -> list[tuple[str, str]]:
    """sections() of one text."""
    found, path, at, label = [], {}, 0, ""
    for head in (*_HEADING.finditer(text), None):
        if body := text[at : head.start() if head else len(text)].strip(SPACES):
            found.append((label, body))
        if head:
            level, at = len(head[1]), head.end()
            path = {k: v for k, v in path.items() if k < level} | {level: head[2].strip(" ")}
            label = " > ".join(path.values())
    return found


def text_sentences(text: str) -> list[tuple[str, str]]:
    """sentences() of one text."""
    found, gap = [], ""
    for piece in _SENTENCE.findall(text):
        if said := piece.strip(SPACES):
            found.append((said, "\n\n" if _BLANK_LINE.search(gap) else "\n" if "\n" in gap else " "))
        gap = piece[len(piece.rstrip(SPACES)) :]
    return found


def text_within(text: str, limit: int) -> list[str]:
    """within() of one text."""
    todo, done = [text], []
    while todo:
        piece = todo.pop()
        middle = len(piece) // 2
        if len(piece) <= limit:
            done.append(piece)
            continue
        low = max(0, middle - NEAR_MIDDLE)
        for pattern in _CUTS:
            if cut := pattern.search(piece[low : middle + NEAR_MIDDLE]):
                both = piece[: low + cut.end()].strip(SPACES), piece[low + cut.end() :].strip(SPACES)
                if all(both):
                    todo += both[::-1]
                    break
        else:
            done += [p for p in (piece[i : i + limit].strip(SPACES) for i in range(0, len(piece), limit)) if p]
    return done


def text_by_meaning(text: str, far: Callable[[list[str]], list[float]]) -> list[str]:
    """by_meaning() of one text."""
    parts = text_sentences(text) if len(text) <= SEMANTIC_LIMIT else []
    if len(text) > SEMANTIC_LIMIT or len(parts) > MOST_SENTENCES:
        return text_within(text, CHUNK_LIMIT)
    if len(parts) < 2:
        return [said for said, _ in parts]
    distances = far([said for said, _ in parts])
    ascending, at = sorted(distances), (len(distances) - 1) * (BREAK_PERCENTILE / 100)
    low, high = int(at), int(np.ceil(at))
    limit = ascending[low] + (ascending[high] - ascending[low]) * (at - low)
    out = [parts[0][0]]
    for (said, glue), distance in zip(parts[1:], distances):
        if distance >= limit or len(out[-1]) + len(glue) + len(said) > CHUNK_LIMIT:
            out.append(said)
        else:
            out[-1] += glue + said
    return out


def text_merge_short(pieces: list[str]) -> list[str]:
    """merge_short() of some pieces."""
    out, held = [], ""
    for piece in filter(None, (p.strip(SPACES) for p in pieces)):
        held = f"{held}\n{piece}" if held else piece
        if len(held) > SHORT:
            out.append(held)
            held = ""
    if held:
        out[-1:] = [f"{out[-1]}\n{held}"] if out else [held]
    return out


def text_chunks(text: str, far: Callable[[list[str]], list[float]]) -> list[tuple[str, str]]:
    """(section label, content) of the chunks of a cleaned text."""
    out = []
    for label, body in text_sections(text):
        pieces = [c for part in text_within(body, SECTION_LIMIT) for c in text_by_meaning(part, far)]
        out += [(label, c) for c in text_merge_short(pieces) if len(c) >= LEAST]
    return out


#: Documents whose chunks a task hands on at a time.
DOCUMENTS = 256


def chunk_documents(docs: DataFrame, encode: Encoder | None = hashing_encoder) -> DataFrame:
    """docs (doc_id, text) -> doc_id, id, chunk_index, chunk_count, section_label, content. Neighbouring sentences are compared by
    the encoder, or by their words (None). Null texts have no chunks."""
    far = neighbours(encode)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, DOCUMENTS):
                part = whole.slice(lo, DOCUMENTS)
                rows = [(i, n, len(found), *c) for i, t in enumerate(part.column("_text").to_pylist()) for found in [text_chunks(t, far)] for n, c in enumerate(found)]
                at, n, count, label, content = zip(*rows) if rows else [()] * 5
                columns = [part.column("doc_id").take(pa.array(at, pa.int64())), pa.array(n, pa.int32()), pa.array(count, pa.int32()), pa.array(label, pa.string()), pa.array(content, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "chunk_index", "chunk_count", "section_label", "content"])

    rows = docs.where(F.col("text").isNotNull()).select("doc_id", clean(F.col("text")).alias("_text"))
    rows = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, chunk_index int, chunk_count int, section_label string, content string")
    return rows.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("::chunk-"), F.col("chunk_index").cast("string")).alias("id"), "chunk_index", "chunk_count", "section_label", "content")


def packs(texts: list[str], most: int = 4, chars: int = 1800) -> Iterator[list[str]]:
    """The texts in order, in batches that a model takes at once."""
    held: list[str] = []
    for t in texts:
        if held and (len(held) == most or sum(map(len, held)) + len(t) > chars):
            yield held
            held = []
        held.append(t)
    if held:
        yield held


def timed(encode: Encoder, seconds: float | None) -> Encoder:
    """The encoder with a limit of time for each call; TimeoutError beyond it."""
    if seconds is None:
        return encode

    def run(texts: list[str]) -> np.ndarray:
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(encode, texts).result(seconds)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return run


def encode_pack(texts: list[str], encode: Encoder, seconds: float | None = None) -> np.ndarray:
    """Vectors of one batch; if the encoder fails on it, text by text, but not if its time is over. One vector a text, all finite."""
    encode = timed(encode, seconds)
    try:
        out = np.asarray(encode(texts))
    except TimeoutError:
        raise
    except Exception:  # noqa: BLE001 - a single text may be at fault; what fails alone fails the task
        out = np.concatenate([np.asarray(encode([t])) for t in texts])
    if out.ndim != 2 or len(out) != len(texts) or not np.isfinite(out).all():
        raise ValueError(f"the encoder gave {out.shape} for {len(texts)} texts")
    return out


def embed(rows: DataFrame, column: str, encode: Encoder = hashing_encoder, prefix: str = "", limit: int | None = None, most: int = 4, chars: int = 1800, seconds: float | None = None) -> DataFrame:
    """rows with embedding: the unit vector of prefix and text, cut to the encoder's limit, by Arrow batches. A batch that takes
    the encoder more than so many seconds fails."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([v.astype("float32") for pack in packs([t or "" for t in texts], most, chars) for v in encode_pack(pack, encode, seconds)], dtype=object)

    return rows.withColumn("embedding", run(rules.model_input(F.col(column), limit or 1 << 30, prefix)))

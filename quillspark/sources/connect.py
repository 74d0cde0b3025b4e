"""Sources and sinks beside the store: notes in folders, stores behind HTTP, column batches, state files, model services."""

from __future__ import annotations

import io
import json
import os
import struct
import tarfile
import urllib.request
from urllib.parse import unquote, urlparse
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from quillspark.functions import rules
from quillspark.functions import text as T

#: Fixed value: records of a page.
PAGE = 1024


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """path, mtime, size, text of the Markdown files below a folder; texts are read whole, by one row each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(folder)
    return files.select("path", (F.unix_micros("modificationTime") / 1000).alias("mtime"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))


def refuse_links(folder: str) -> None:
    """Fail where a symbolic link lies below a local folder, or is that folder; other stores have none."""
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        return
    root = unquote(parts.path)
    for at, folders, files in os.walk(root):
        for name in (at, *(os.path.join(at, n) for n in (*folders, *files))):
            if os.path.islink(name):
                raise ValueError(f"{name} is a symbolic link")


def list_files(spark: SparkSession, folder: str, links: bool = False) -> DataFrame:
    """path, length, mtime of all files below a folder, without their content. Symbolic links fail unless allowed."""
    if not links:
        refuse_links(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", (F.unix_micros("modificationTime") / 1000).alias("mtime"))


@F.pandas_udf(BinaryType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    """Vectors as packed little-endian floats."""
    return vectors.map(lambda v: np.asarray(v, "<f4").tobytes(), na_action="ignore")


@F.pandas_udf(ArrayType(FloatType()))
def decode_vector(blobs: pd.Series) -> pd.Series:
    """Packed floats as vectors; a length that is no multiple of four fails."""
    return blobs.map(lambda b: np.frombuffer(b, "<f4"), na_action="ignore")


def unpack_batches(batches: DataFrame) -> DataFrame:
    """One row a record from batches of columns (ids, documents, metadatas, embeddings), each an array, or an array of one
    such array. Batches whose columns differ in length fail."""
    flat = [F.flatten(c).alias(c) if kind.startswith("array<array<") and (c != "embeddings" or kind.startswith("array<array<array<")) else F.col(c) for c, kind in batches.dtypes]
    rows = batches.select(*flat)
    first, *rest = rows.columns
    same = F.lit(True)
    for c in rest:
        same = same & (F.size(c) == F.size(first))
    checked = rows.select(F.when(same, F.arrays_zip(*rows.columns)).otherwise(F.raise_error(F.lit("columns of a batch differ in length"))).alias("rows"))
    return checked.select(F.inline("rows"))


def post_json(url: str, body: dict, timeout: float = 60):
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.page, self.fields = options["url"].rstrip("/"), int(options.get("page", PAGE)), options.get("include", "documents,metadatas,embeddings")
        if not 1 <= self.page <= PAGE:
            raise ValueError(f"a page has 1 to {PAGE} records")
        self.where = json.loads(options["where"]) if "where" in options else None
        self.ids = None

    def _get(self, path: str):
        with urllib.request.urlopen(f"{self.url}/{path}", timeout=60) as answer:
            return json.load(answer)

    def pushFilters(self, filters):
        """Filters on the id become the ids of the request; all others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("id",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                asked.discard(None)
                self.ids = asked if self.ids is None else self.ids & asked
            else:
                yield f

    def partitions(self):
        if self.ids is not None:
            ids = sorted(self.ids)
            return [InputPartition(("ids", ids[at : at + self.page])) for at in range(0, len(ids), self.page)] or [InputPartition(("ids", []))]
        if self.where is not None:
            return [InputPartition(("where", None))]
        total = int(self._get("count"))
        return [InputPartition(("page", (at, min(self.page, total - at)))) for at in range(0, total, self.page)]

    def read(self, partition) -> Iterator[tuple]:
        kind, value = partition.value
        if kind == "page":
            at, wanted = value
            got = self._get(f"records?offset={at}&limit={wanted}&include={self.fields}")
            if len(got["ids"]) != wanted:
                raise ValueError(f"the page at {at} has {len(got['ids'])} records, not {wanted}")
            yield from self.rows(got, f"the page at {at}")
        elif kind == "ids":
            if value:
                got = post_json(f"{self.url}/get", {"ids": value, "include": self.fields.split(",")} | ({"where": self.where} if self.where else {}))
                if not set(got["ids"]) <= set(value):
                    raise ValueError("the answer has records that were not asked for")
                yield from self.rows(got, "the answer")
        else:
            at, n = 0, self.page
            while n == self.page:  # what matches isn't counted: the first short page is the last
                got = post_json(f"{self.url}/get", {"where": self.where, "offset": at, "limit": self.page, "include": self.fields.split(",")})
                n = len(got["ids"])
                if n > self.page:
                    raise ValueError(f"the page at {at} has {n} records, more than {self.page}")
                yield from self.rows(got, f"the page at {at}")
                at += n

    def rows(self, got: dict, name: str) -> Iterator[tuple]:
        ids = got["ids"]
        columns = [got.get(c) or [None] * len(ids) for c in ("documents", "metadatas", "embeddings")]
        if any(len(c) != len(ids) for c in columns):
            raise ValueError(f"columns of {name} differ in length")
        for i, d, m, e in zip(ids, *columns):
            yield i, d, None if m is None else json.dumps(m, ensure_ascii=False), e


class PagedSource(DataSource):
    """spark.read.format("paged_vectors").option("url", ...): a vector store behind HTTP. GET count is the number of its
    records, GET records?offset=&limit=&include= a page of columns; each page is a partition, and a short one fails. option("include", "metadatas")
    asks for metadata only.

    Filters on the id are pushed down where spark.sql.python.filterPushdown.enabled is on: POST get with ids, a request a page
    of them, and unknown ids have no row. option("where", ...) is a JSON object of equal metadata fields that the store applies: POST
    get with where, offset and limit, by one task in turn."""

    @classmethod
    def name(cls):
        return "paged_vectors"

    def schema(self):
        return "id string, document string, metadata string, embedding array<float>"

    def reader(self, schema):
        return PagedReader(self.options)


def read_paged(spark: SparkSession, url: str, page: int = PAGE, include: str = "documents,metadatas,embeddings", where: dict | None = None) -> DataFrame:
    """The records of a store behind HTTP. Turns on filters pushed to Python sources in this session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged_vectors").option("url", url).option("page", str(page)).option("include", include)
    return (rows if where is None else rows.option("where", json.dumps(where))).load()


def nearest_remote(queries: DataFrame, url: str, n: int = 5, batch: int = 64, timeout: float = 60) -> DataFrame:
    """query_id, rank, id, document, metadata, distance: what a store behind HTTP finds nearest to each vector of queries
    (query_id, embedding), by POST query with as many vectors a request. Null vectors are not asked about; a missing document is empty,
    missing metadata an empty object, a missing distance 0. An answer for another number of vectors fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for lo in range(0, rows.num_rows, batch):
                part = rows.slice(lo, batch)
                keys, vectors = part.column(0), part.column(1).to_pylist()
                got = post_json(f"{url.rstrip('/')}/query", {"query_embeddings": vectors, "n_results": n, "include": ["documents", "metadatas", "distances"]}, timeout)
                if len(got["ids"]) != len(vectors):
                    raise ValueError(f"{len(got['ids'])} answers for {len(vectors)} vectors")
                counts = [len(i) for i in got["ids"]]
                column = lambda c, missing, form=lambda x: x: [form(x) for x in _answers(got, c, counts, missing)]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(np.repeat(np.arange(len(counts)), counts))), pa.array([r + 1 for m in counts for r in range(m)], pa.int32()), pa.array(column("ids", ""), pa.string()),
                        pa.array(column("documents", ""), pa.string()), pa.array(column("metadatas", {}, lambda m: json.dumps(m, ensure_ascii=False)), pa.string()), pa.array(column("distances", 0.0, float), pa.float64()),
                    ],
                    ["query_id", "rank", "id", "document", "metadata", "distance"],
                )

    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    return asked.mapInArrow(run, f"query_id {asked.schema['query_id'].dataType.simpleString()}, rank int, id string, document string, metadata string, distance double")


def _answers(got: dict, name: str, counts: list[int], missing) -> list:
    """A column of an answer over all its vectors, as long as the ids; what isn't there is the missing value."""
    lists = got.get(name) or []
    out = []
    for i, n in enumerate(counts):
        found = (lists[i] if i < len(lists) else None) or []
        out += [missing if x is None else x for x in (*found[:n], *[None] * (n - len(found)))]
    return out


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, mtime, chunk_count, muted from a JSON object keyed by document. Keys are normalized; two that become one
    fail."""
    kind = "map<string,struct<path:string,mtime:double,chunkCount:int,muted:boolean>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("key", "s"))
    rows = rows.select(rules.composed(T.normalize_path(F.col("key"))).alias("doc_id"), "s.path", "s.mtime", F.col("s.chunkCount").alias("chunk_count"), F.coalesce("s.muted", F.lit(False)).alias("muted"))
    if not duplicates(rows, "doc_id").isEmpty():
        raise ValueError("documents of the state have the same key")
    return rows


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Values of a key that more than one row has, with their number."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def write_state(state: DataFrame, folder: str) -> None:
    """The state as JSON lines; Spark's committer shows the folder's new content as a whole."""
    state.write.mode("overwrite").json(folder)


def stream_lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of JSON lines, such as a service's progress, as a stream; lines that are no JSON are nulls."""
    return spark.readStream.text(folder).select(F.from_json("value", schema).alias("row")).select("row.*")


def archive_entries(spark: SparkSession, path: str, expected: list[str] | None = None) -> DataFrame:
    """archive, entry, size, content of the files in tar.gz and zip archives; other entries than expected fail, as do names
    that lead outside."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                if name.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        found = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
                else:
                    with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
                        found = [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
                names = [n for n, _ in found]
                if any(n.startswith("/") or ".." in n.split("/") for n in names) or expected is not None and sorted(names) != sorted(expected):
                    raise ValueError(f"unexpected entries in {name}")
                yield pa.RecordBatch.from_pydict({"archive": [name] * len(found), "entry": names, "size": pa.array([len(c) for _, c in found], pa.int64()), "content": [c for _, c in found]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "archive string, entry string, size long, content binary")


def http_client(url: str, model: str, timeout: float = 120) -> Callable[[str], str]:
    """A function from a prompt to a service's answer (POST generate)."""

    def ask(prompt: str) -> str:
        body = json.dumps({"model": model, "prompt": prompt, "stream": False}).encode()
        with urllib.request.urlopen(urllib.request.Request(f"{url.rstrip('/')}/api/generate", body, {"Content-Type": "application/json"}), timeout=timeout) as answer:
            return json.load(answer).get("response") or ""

    return ask


def list_models(spark: SparkSession, url: str, timeout: float = 30) -> DataFrame:
    """name, size, modified_at, details (JSON): the models that a service has (GET tags); an answer without a list has none."""
    with urllib.request.urlopen(f"{url.rstrip('/')}/api/tags", timeout=timeout) as answer:
        got = json.load(answer).get("models")
    rows = [(m.get("name"), m.get("size"), m.get("modified_at"), json.dumps(m.get("details"))) for m in got] if isinstance(got, list) else []
    return spark.createDataFrame(rows, "name string, size long, modified_at string, details string")


def show_models(models: DataFrame, url: str, timeout: float = 30) -> DataFrame:
    """name, shown (JSON), error of models (name): what a service tells about each (POST show); one that fails is told so and the
    others go on. Null names are not asked about."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name in pdf["name"]:
                try:
                    out.append((name, json.dumps(post_json(f"{url.rstrip('/')}/api/show", {"model": name}, timeout)), None))
                except Exception as e:  # noqa: BLE001 - told in the row
                    out.append((name, None, str(e)))
            yield pd.DataFrame(out, columns=["name", "shown", "error"])

    return models.where(F.col("name").isNotNull()).select("name").mapInPandas(run, "name string, shown string, error string")


def summarized(docs: DataFrame, ask: Callable[[str], str], template: str, max_chars: int = 20_000, fall_back: bool = True) -> DataFrame:
    """docs (text) with query_text, used_summary, error: the summary a client gives for each text, or the text itself where
    it gives none or fails. Empty texts are not asked about."""
    prompt = rules.prompt(template, F.substring(F.trim(F.col("text")), 1, max_chars))
    rows = docs.withColumn("_prompt", F.when(F.trim("text") != "", prompt))
    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes) + ", _answer string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers, errors = [], []
            for p in pdf["_prompt"]:
                answer = error = None
                if isinstance(p, str):
                    try:
                        answer = ask(p)
                    except Exception as e:  # noqa: BLE001 - told in the row
                        if not fall_back:
                            raise
                        error = str(e)
                answers.append(answer)
                errors.append(error)
            yield pdf.assign(_answer=answers, error=errors)

    out = rows.mapInPandas(run, schema)
    answer = T.strip_fence(F.col("_answer"))
    good = F.coalesce(answer != "", F.lit(False))
    error = F.when(~good & F.col("_prompt").isNotNull(), F.coalesce("error", F.lit("empty summary")))
    return out.select(*docs.columns, F.when(good, answer).otherwise(F.trim("text")).alias("query_text"), good.alias("used_summary"), error.alias("error"))


def write_query_log(entries: DataFrame, folder: str) -> None:
    """Append (at, tool, results): when a tool was asked and how much it found."""
    entries.select("at", "tool", "results").write.mode("append").parquet(folder)


def last_query(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).orderBy(F.desc("at")).limit(1)


def write_events(events: DataFrame, folder: str) -> None:
    """Diagnostic events as JSON lines; the folder's content is replaced as a whole."""
    events.write.mode("overwrite").json(folder)


def float_size(blob: Column) -> Column:
    """Numbers in a packed vector; an error if its length is no multiple of four."""
    return F.when(F.octet_length(blob) % struct.calcsize("<f") == 0, (F.octet_length(blob) / struct.calcsize("<f")).cast("int")).otherwise(F.raise_error(F.lit("a packed vector is cut short")).cast("int"))

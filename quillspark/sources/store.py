"""A store of collections of chunk records: a log of commits over Parquet files that are never rewritten in place.

A write validates first and then writes a delta: the new state of the records that it touches, or marks of those that it deletes. Then it
publishes root/<collection>/commits/<number>, a list of the parts that make up the collection. Readers take the highest
number and merge its parts, the newest row of an id first, so they see all of a write or nothing. A commit appears whole, under a number that
no other has: of two writers of the same number one tries again on the other's result. Small parts are merged as they gather, so
a batch costs what it holds and a share of later merges. root/meta/<key> holds values in the same way.

Metadata are maps of JSON scalars, so filters by equality are strict about types: 1, "1" and true differ.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import vector as V
from quillspark.operators import documents

#: The format's version, names of collections, limits of a batch and of metadata.
FORMAT_VERSION = 1
COLLECTION_NAME = documents.COLLECTION_NAME
MAX_ID, MAX_KEYS, MAX_KEY = 2048, 256, 256
#: New rows are numbered in so many runs of ids.
RUNS = 256
#: Deltas of at most so many records are broadcast to what they replace; files hold so many records.
BROADCAST_RECORDS, FILE_RECORDS = 200_000, 50_000
#: A collection of more parts merges its small ones.
MAX_PARTS = 8
#: How often a writer tries again after another one's commit.
ATTEMPTS = 20
RECORD = "seq long, id string, doc_id string, document string, path string, title string, mtime double, chunk_index int, chunk_count int, section_label string, metadata map<string,string>, embedding array<float>"
COLUMNS = [c.split()[0] for c in re.sub(r"map<[^>]*>", "map", RECORD).split(", ")]


class StoreError(ValueError):
    pass


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by id: replaced rows keep their seq, new ones follow the largest, by id. Columns that only old has are null in
    new rows. Adds replaced."""
    rest = [c for c in new.columns if c not in ("id", "seq")]
    n = new.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in rest])
    both = old.join(n, old["id"] == n["_id"], "full")
    columns = [F.when(F.col("_id").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in rest else F.col(c) for c in old.columns if c not in ("id", "seq")]
    both = both.select(F.coalesce("id", "_id").alias("id"), "seq", *columns, F.col("_id").isNotNull().alias("replaced"))
    top = old.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_top")).first()[0]
    added = numbered(both.where(F.col("seq").isNull()).drop("seq"), "id", top + 1, "seq")
    return both.where(F.col("seq").isNotNull()).unionByName(added)


def numbered(rows: DataFrame, key: str, first: int, into: str) -> DataFrame:
    """rows with their number in the order of a unique key, from first on. Bounds of runs come from a bounded sample by
    hash; each run is numbered by itself, behind the sizes of those before it."""
    bounds = sorted(r[0] for r in rows.where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).select(key).limit(RUNS).collect())
    run = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(key))) if bounds else F.lit(0)
    rows = rows.withColumn("_run", run)
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # RUNS rows at most
    sizes = rows.groupBy("_run").agg(F.count("*").alias("_n")).select("_run", (F.lit(first) + F.coalesce(F.sum("_n").over(before), F.lit(0)) - 1).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_run").orderBy(key))
    return rows.join(F.broadcast(sizes), "_run").withColumn(into, (F.col("_before") + nth).cast("long")).drop("_run", "_before")


def json_scalars(metadata: Column, kind: str) -> Column:
    """Metadata as a map of JSON scalars: from a map of strings, or from the text of a JSON object. Nulls go."""
    if kind == "string":
        typed = F.parse_json(metadata).cast("map<string,variant>")
        return F.transform_values(F.map_filter(typed, lambda k, v: ~F.is_variant_null(v)), lambda k, v: F.to_json(v))
    return F.transform_values(F.map_filter(metadata, lambda k, v: v.isNotNull()), lambda k, v: F.regexp_extract(F.to_json(F.array(v)), r"(?s)^\[(.*)\]$", 1))


def is_valid_metadata(metadata: Column) -> Column:
    """Few enough keys, none too long or empty, and no values but strings, finite numbers and booleans."""
    keys = F.map_keys(metadata)
    return (F.size(keys) <= MAX_KEYS) & F.forall(keys, lambda k: F.length(k).between(1, MAX_KEY)) & F.forall(F.map_values(metadata), lambda v: ~v.rlike(r"^[\[{]|^null$"))


def has_value(metadata: Column, key: str, value) -> Column:
    """Strict equality of a metadata value; an absent key never matches."""
    found = F.try_element_at(metadata, F.lit(key))
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.coalesce(found.rlike("^-?[0-9]") & (found.try_cast("double") == float(value)), F.lit(False))
    return F.coalesce(found == json.dumps(value, ensure_ascii=False), F.lit(False))


def without_documents(records: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Records but those of the documents named in column doc_id."""
    return records.join(doc_ids.select("doc_id"), "doc_id", "left_anti")


def strip_null_metadata(records: DataFrame) -> DataFrame:
    return records.withColumn("metadata", F.map_filter("metadata", lambda k, v: v.isNotNull()))


def newest(parts: DataFrame) -> DataFrame:
    """Of rows with equal id the one of the newest part (column _part)."""
    by = Window.partitionBy("id").orderBy(F.desc("_part"))
    return parts.withColumn("_nth", F.row_number().over(by)).where("_nth = 1").drop("_nth", "_part")


class Store:
    """Collections under a root that Spark can write to. Where a rename never replaces a file (local folders, HDFS) several
    writers may work at a time; on an object store without such a rename one writer a collection."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._cached: dict[str, tuple[int, DataFrame]] = {}
        if self.get_meta("format") is None:
            self.set_meta("format", str(FORMAT_VERSION))
        elif self.get_meta("format") != str(FORMAT_VERSION):
            raise StoreError(f"format {self.get_meta('format')} is not supported")

    # The log.

    def _files(self, folder: str) -> list:
        return list(self._fs.listStatus(self._path(folder))) if self._fs.exists(self._path(folder)) else []

    def _numbers(self, folder: str) -> list[int]:
        """Numbers of the commits. An empty file takes a number and is no commit."""
        return sorted(int(s.getPath().getName()) for s in self._files(folder) if s.getPath().getName().isdigit() and s.getLen() > 0)

    def _next(self, folder: str) -> int:
        return max([int(s.getPath().getName()) for s in self._files(folder) if s.getPath().getName().isdigit()], default=-1) + 1

    def _read(self, path: str) -> str:
        source = self._fs.open(self._path(path))
        try:
            return source.readLine() or ""
        finally:
            source.close()

    def _commit(self, folder: str, number: int, text: str) -> None:
        """Write a file under a name of its own, then give it its number; FileExistsError where another writer has it."""
        part, final = f"{folder}/.{uuid.uuid4().hex}.part", f"{folder}/{number:012d}"
        if self._fs.getScheme() == "file":
            part, final = (self._path(p).toUri().getPath() for p in (part, final))
            os.makedirs(os.path.dirname(part), exist_ok=True)
            with open(part, "w") as out:
                out.write(text)
                out.flush()
                os.fsync(out.fileno())
            try:
                os.link(part, final)
            finally:
                os.unlink(part)
            return
        out = self._fs.create(self._path(part), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        never = self.spark.sparkContext._gateway.new_array(kinds, 1)
        never[0] = kinds.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(final).toUri(), self._conf).rename(self._path(part), self._path(final), never)
        except Exception as e:
            self._fs.delete(self._path(part), False)
            raise FileExistsError(final) if self._fs.exists(self._path(final)) else e

    def _change(self, folder: str, make) -> object:
        """Publish what make(number) gives as (text, result), again while other writers come first; no text, no commit."""
        for _ in range(ATTEMPTS):
            number = self._next(folder)
            text, result = make(number)
            if text is None:
                return result
            try:
                self._commit(folder, number, text)
                return result
            except FileExistsError:
                continue
        raise StoreError(f"{folder}: other writers came first {ATTEMPTS} times")

    def get_meta(self, key: str) -> str | None:
        folder = f"{self.root}/meta/{quote(key, '')}"
        found = self._numbers(folder)
        return self._read(f"{folder}/{found[-1]:012d}") if found else None

    def set_meta(self, key: str, value: str) -> None:
        """Set a value of one line; readers see the old one or the new one. The last two values stay as files."""
        folder = f"{self.root}/meta/{quote(key, '')}"
        self._change(folder, lambda number: (value, None))
        for n in self._numbers(folder)[:-2]:
            self._fs.delete(self._path(f"{folder}/{n:012d}"), False)

    def collections(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._files(self.root) if s.isDirectory() and self.has(s.getPath().getName()))

    def has(self, name: str) -> bool:
        return bool(self._numbers(f"{self.root}/{name}/commits"))

    def open(self, name: str) -> DataFrame | None:
        """An existing collection, never created by asking."""
        return self.read(name) if self.has(name) else None

    def ensure(self, name: str) -> None:
        if not re.match(COLLECTION_NAME, name) or name == "meta":
            raise StoreError(f"not a collection name: {name}")

        def make(number):
            if self.has(name):
                return None, None
            return json.dumps({"parts": [], "delta": None, "top": 0, "before": 0, "dimension": None, "records": 0}), None

        self._change(f"{self.root}/{name}/commits", make)

    def drop(self, name: str) -> bool:
        """Delete a collection with its records; whether there was one."""
        there = self.has(name)
        self._fs.delete(self._path(f"{self.root}/{name}"), True)
        return there

    def version(self, name: str) -> int:
        found = self._numbers(f"{self.root}/{name}/commits")
        if not found:
            raise StoreError(f"no collection {name}")
        return found[-1]

    def state(self, name: str, version: int | None = None) -> dict:
        """What a commit says: parts (data, rows, marks), the delta it added, the next seq (top) and the one before it (before),
        dimension, number of records."""
        version = self.version(name) if version is None else version
        return json.loads(self._read(f"{self.root}/{name}/commits/{version:012d}"))

    # Reading.

    def _part(self, name: str, data: str) -> DataFrame:
        return self.spark.read.schema(f"{RECORD}, gone boolean").parquet(f"{self.root}/{name}/{data}")

    def _merged(self, name: str, parts: list[dict], marks: bool = False) -> DataFrame:
        """The records of parts, oldest first; marks of deleted ones stay if asked for."""
        if not parts:
            return self.spark.createDataFrame([], f"{RECORD}, gone boolean")
        rows = self._part(name, parts[0]["data"])
        if len(parts) > 1:
            later = self._part(name, parts[1]["data"]).withColumn("_part", F.lit(1))
            for i, part in enumerate(parts[2:], 2):
                later = later.unionByName(self._part(name, part["data"]).withColumn("_part", F.lit(i)))
            later = newest(later)
            ids = later.select("id")
            if sum(p["rows"] for p in parts[1:]) <= BROADCAST_RECORDS:
                ids = F.broadcast(ids)
            rows = rows.join(ids, "id", "left_anti").unionByName(later)
        return rows if marks else rows.where("NOT gone")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The records of a collection, as of a version that vacuum has left, or now."""
        return self._merged(name, self.state(name, version)["parts"]).select(COLUMNS)

    def changes(self, name: str, since: int) -> DataFrame:
        """What the commits after a version did, record by record: version, kind (inserted, replaced, deleted) and the
        record; of deleted ones id, seq and doc_id."""
        out = self.spark.createDataFrame([], f"version long, kind string, {RECORD}")
        for n in self._numbers(f"{self.root}/{name}/commits"):
            if n > since and (state := self.state(name, n))["delta"]:
                kind = F.when(F.col("gone"), "deleted").when(F.col("seq") >= state["before"], "inserted").otherwise("replaced")
                out = out.unionByName(self._part(name, state["delta"]).select(F.lit(n).cast("long").alias("version"), kind.alias("kind"), *COLUMNS))
        return out

    # Writing.

    def _write(self, name: str, number: int, rows: DataFrame, most: int) -> dict:
        """Write rows (records with gone) as a part; most bounds their number."""
        data = f"v{number}-{uuid.uuid4().hex}"
        rows.select(*COLUMNS, "gone").coalesce(most // FILE_RECORDS + 1).write.parquet(f"{self.root}/{name}/{data}")
        return {"data": data}

    def _publish(self, name: str, make) -> object:
        """Add what make(number, state) writes, as (part, changes of the state, result), to the parts of the newest commit."""
        folder = f"{self.root}/{name}/commits"

        def attempt(number):
            state = self.state(name)
            part, changes, result = make(number, state)
            if part is None:
                return None, result
            return json.dumps(state | {"before": state["top"]} | changes | {"parts": [*state["parts"], part], "delta": part["data"]}), result

        out = self._change(folder, attempt)
        self.compact(name)
        return out

    def compact(self, name: str, whole: bool = False) -> bool:
        """Merge small parts into one where there are many: the newest ones, back to a part that holds twice as many rows as
        they. Or merge all. Whether anything was merged; another writer's commit meanwhile ends the try."""
        folder = f"{self.root}/{name}/commits"
        state = self.state(name)
        parts = state["parts"]
        first, total = len(parts) - 1, parts[-1]["rows"] if parts else 0
        while first > 0 and (whole or parts[first - 1]["rows"] <= 2 * total):
            first -= 1
            total += parts[first]["rows"]
        if first >= len(parts) - 1 or len(parts) <= MAX_PARTS and not whole:
            return False
        number = self._next(folder)
        part = self._write(name, number, self._merged(name, parts[first:], marks=first > 0), total)
        part["rows"] = self._part(name, part["data"]).count()
        if self.state(name) != state:
            return False
        try:
            self._commit(folder, number, json.dumps(state | {"before": state["top"], "parts": [*parts[:first], part], "delta": None}))
        except FileExistsError:
            return False
        return True

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Delete all commits but the newest, the parts that none of these names, and what failed writers left. A writer that
        works on the next commit is not disturbed."""
        commits = f"{self.root}/{name}/commits"
        kept = self._numbers(commits)[-keep:]
        states = [self.state(name, n) for n in kept]
        live = {p["data"] for s in states for p in s["parts"]} | {s["delta"] for s in states}
        newest_at = max(s.getModificationTime() for s in self._files(commits) if s.getPath().getName() == f"{kept[-1]:012d}")
        for s in self._files(commits):
            file = s.getPath().getName()
            if file.isdigit() and int(file) < kept[-1] and int(file) not in kept or file.endswith(".part") and s.getModificationTime() < newest_at - 3_600_000:
                self._fs.delete(s.getPath(), False)
        for s in self._files(f"{self.root}/{name}"):
            found = re.match(r"v(\d+)-", s.getPath().getName())
            if found and s.getPath().getName() not in live and int(found[1]) <= kept[-1]:
                self._fs.delete(s.getPath(), True)

    def cached(self, name: str) -> DataFrame:
        """The vectors of a collection (id, seq, doc_id, embedding, norm2), kept in memory until a new version appears."""
        v = self.version(name)
        held = self._cached.get(name)
        if held is None or held[0] != v:
            if held:
                held[1].unpersist()
            rows = self.read(name).select("id", "seq", "doc_id", "embedding", V.dot(F.col("embedding"), F.col("embedding")).alias("norm2"))
            self._cached[name] = v, rows.cache()
        return self._cached[name][1]

    def upsert(self, name: str, rows: DataFrame, encoded: bool = False) -> int:
        """Replace rows by id in place and append new ones; all or nothing. Missing columns are null. metadata is a map of
        strings or the text of a JSON object; encoded: the map already holds JSON scalars."""
        kinds = dict(self.spark.createDataFrame([], RECORD).dtypes)
        for c in COLUMNS:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(kinds[c]))
        if not encoded:
            rows = rows.withColumn("metadata", json_scalars(F.col("metadata"), dict(rows.dtypes)["metadata"]))
        bad = ~V.is_valid(F.col("embedding")) | F.col("id").isNull() | ~F.length("id").between(1, MAX_ID)
        bad = bad | ~F.coalesce(is_valid_metadata(F.col("metadata")), F.lit(True))
        size = F.size("embedding")
        seen = rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(bad).alias("bad"), F.min(size).alias("least"), F.max(size).alias("most")).first()
        rows = rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS if c != "seq"])

        def make(number, state):
            wanted = state["dimension"] or seen["least"]
            if seen["bad"] or seen["n"] != seen["ids"] or seen["n"] and not seen["least"] == seen["most"] == wanted:
                raise StoreError(f"{seen['bad']} invalid records, {seen['n'] - seen['ids']} repeated ids, dimensions {seen['least']} to {seen['most']}, not {wanted}")
            if not seen["n"]:
                return None, {}, 0
            few = seen["n"] <= BROADCAST_RECORDS
            small = F.broadcast if few else lambda df: df
            there = self._merged(name, state["parts"]).select("id", "seq").join(small(rows.select("id")), "id", "left_semi")
            met = rows.join(small(there), "id", "left")
            added = numbered(met.where(F.col("seq").isNull()).drop("seq"), "id", state["top"], "seq")
            part = self._write(name, number, met.where(F.col("seq").isNotNull()).unionByName(added).withColumn("gone", F.lit(False)), seen["n"])
            n_new = self._part(name, part["data"]).where(F.col("seq") >= state["top"]).count()
            return part | {"rows": seen["n"]}, {"top": state["top"] + n_new, "records": state["records"] + n_new, "dimension": wanted}, seen["n"]

        return self._publish(name, make)

    def delete_documents(self, name: str, doc_ids: DataFrame) -> int:
        """Delete the records of all documents named in column doc_id; how many there were. Only marks are written."""
        asked = doc_ids.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()

        def make(number, state):
            gone = self._merged(name, state["parts"]).select("id", "seq", "doc_id").join(asked, "doc_id", "left_semi")
            marks = self.spark.createDataFrame([], RECORD).drop("id", "seq", "doc_id")
            marks = gone.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in marks.dtypes], F.lit(True).alias("gone"))
            part = self._write(name, number, marks, state["records"])
            n = self._part(name, part["data"]).count()
            if not n:
                self._fs.delete(self._path(f"{self.root}/{name}/{part['data']}"), True)
                return None, {}, 0
            return part | {"rows": n}, {"records": state["records"] - n}, n

        return self._publish(name, make)

    def delete_document(self, name: str, doc_id: str) -> int:
        return self.delete_documents(name, self.spark.createDataFrame([(doc_id,)], "doc_id string"))

    def count(self, name: str) -> int:
        return self.state(name)["records"]

    def get(self, name: str, ids: list[str] | None = None, where: dict | None = None, documents_: bool = True, embeddings: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Records by id and by equality of columns or metadata, in seq order. A value is a scalar or {'$eq': scalar}."""
        if offset < 0 or limit is not None and limit < 1:
            raise StoreError("pages begin at 0 and have a row at least")
        rows = self.read(name)
        if ids is not None:
            rows = rows.where(F.col("id").isin(ids)) if ids else rows.where(F.lit(False))
        for key, value in (where or {}).items():
            if key.startswith("$") or isinstance(value, dict) and set(value) != {"$eq"}:
                raise StoreError(f"unsupported filter {key}")
            value = value["$eq"] if isinstance(value, dict) else value
            rows = rows.where(F.col(key) == value) if key in COLUMNS else rows.where(has_value(F.col("metadata"), key, value))
        rows = rows.drop(*(() if documents_ else ("document",)), *(() if embeddings else ("embedding",))).orderBy("seq").offset(offset)
        return rows if limit is None else rows.limit(limit)

    def document_entries(self, name: str) -> DataFrame:
        return documents.document_entries(self.read(name))

    def log_query(self, tool: str, results: int) -> None:
        """Note when a tool was last asked and how much it found, never what for."""
        self.set_meta("last query", json.dumps({"tool": tool, "results": results, "at": self.spark.sql("SELECT unix_millis(current_timestamp())").first()[0]}))


#: Records of a batch of a copy.
COPY_BATCH = 100_000


def copy_collection(source: Store, target: Store, name: str, batch: int = COPY_BATCH, clean: bool = True) -> dict:
    """Copy a collection in batches by seq and compare both sides: counts, digests of ids, and rows whose vector or document differs.

    With clean the target's collection is dropped first. Else a copy that broke goes on behind its last whole batch, if it was
    of the same source and version; otherwise it begins anew. Progress is kept in the target's meta; a batch that was
    written but not noted is written again to the same effect. The source is read as of one version throughout.
    """
    key = f"copy {name}"
    noted = json.loads(target.get_meta(key) or "null")
    version, done = source.version(name), 0
    if not clean and noted and noted["source"] == source.root and target.has(name) and noted["version"] in source._numbers(f"{source.root}/{name}/commits"):
        version, done = noted["version"], noted["done"]
    else:
        target.drop(name)
        target.ensure(name)
        target.set_meta(key, json.dumps({"source": source.root, "version": version, "done": 0}))
    rows, top = source.read(name, version), source.state(name, version)["top"]
    while done < top:
        part = rows.where((F.col("seq") >= done) & (F.col("seq") < done + batch))
        target.upsert(name, strip_null_metadata(part).drop("seq"), encoded=True)
        done += batch
        target.set_meta(key, json.dumps({"source": source.root, "version": version, "done": done}))
    a, b = rows, target.read(name)
    differ = a.alias("a").join(b.alias("b"), "id", "full").where(~(F.col("a.document").eqNullSafe(F.col("b.document")) & F.col("a.embedding").eqNullSafe(F.col("b.embedding"))))
    digest = lambda df: documents.xor_digest(df, "id").first()["digest"]
    return {"source": a.count(), "target": b.count(), "same_ids": digest(a) == digest(b), "differing": differ.count()}

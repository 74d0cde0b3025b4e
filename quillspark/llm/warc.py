"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Layout of a file: a skippable frame with magic 0x184D2A5D that holds the dictionary (plain, or itself a Zstandard
frame), then one frame for each record. read_archives() decodes and validates frame by frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import fresh_path, join_small, materialize, utf8
from quillspark.llm.shared_files import write_bytes

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
WARC_VERSION = b"WARC/1.1"
KNOWN_VERSIONS = (b"WARC/1.0", b"WARC/1.1")
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads of at least so many bytes are stored once.
MIN_REVISIT_BYTES = 1000
#: A new archive begins when one holds so many bytes of records.
ARCHIVE_BYTES = 32 << 20
#: The dictionary is trained on at most so many pages and has at most so many bytes.
DICTIONARY_PAGES, DICTIONARY_BYTES = 256, 64 << 10
WRITTEN = "1970-01-01T00:00:00Z"

RECORD_SCHEMA = (
    "archive string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string"
)


MANIFEST = "attempt string, n long"


class WarcError(ValueError):
    pass


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends, from its block headers alone."""
    if len(data) - at < 6:
        raise WarcError("truncated frame header")
    if struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise WarcError("not a Zstandard frame")
    try:
        checksum = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
        pos = at + zstandard.frame_header_size(data[at : at + 18])
    except zstandard.ZstdError as e:
        raise WarcError(f"bad frame header: {e}") from e
    while True:
        if pos + 3 > len(data):
            raise WarcError("truncated block")
        head = data[pos] | data[pos + 1] << 8 | data[pos + 2] << 16
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    pos += 4 * checksum
    if pos > len(data):
        raise WarcError("truncated frame")
    return pos


def load_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary in the leading skippable frame, if there is one, and where the records begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        return None, 0
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    if end > len(data):
        raise WarcError("truncated dictionary")
    held = bytes(data[8:end])
    if held[:4] == struct.pack("<I", FRAME_MAGIC):
        held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
    return zstandard.ZstdCompressionDict(held), end


def _headers(block: bytes) -> dict[str, str]:
    found = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError("malformed header line")
        found[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return found


def parse_record(raw: bytes) -> dict:
    """Validate one decoded record and take it apart. Raises WarcError."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version not in KNOWN_VERSIONS:
        raise WarcError("no WARC version line")
    headers = _headers(lines)
    for name in REQUIRED:
        if not headers.get(name):
            raise WarcError(f"header {name} is missing")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4:
        raise WarcError("content-length does not match the block")
    if rest[-4:] != b"\r\n\r\n":
        raise WarcError("the record does not end with two line breaks")
    block, kind = rest[:-4], headers["warc-type"]
    out = {"record_id": headers["warc-record-id"], "record_type": kind, "target_uri": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to")}
    payload, length = block, len(block)
    if kind in ("response", "revisit") and block.startswith(b"HTTP/"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise WarcError("the HTTP headers do not end")
        length = _headers(http.partition(b"\r\n")[2]).get("content-length")
        if length is None or not length.isdigit() or kind == "response" and int(length) != len(payload):
            raise WarcError("the HTTP content-length does not match the payload")
        length = int(length)
    digest = headers.get("warc-payload-digest")
    if digest is not None:
        if not digest.startswith("sha1:") or len(digest) != 37:
            raise WarcError("unknown payload digest")
        digest = base64.b32decode(digest[5:]).hex()
    if kind == "revisit":
        if digest is None or not out["refers_to"]:
            raise WarcError("a revisit without digest or reference")
        payload = None
    else:
        own = hashlib.sha1(payload).hexdigest()
        if digest not in (None, own):
            raise WarcError("the payload digest does not match")
        digest = own
    return out | {"payload_digest": digest, "payload_bytes": length, "payload": payload}


def parse_archive(data: bytes | memoryview) -> Iterator[dict]:
    """Records of one archive with their offsets. A bad record is a row with an error; after a broken frame, whose end
    can't be known, there is one last such row."""
    data = memoryview(data).cast("B")
    try:
        dictionary, at = load_dictionary(data)
    except (WarcError, zstandard.ZstdError) as e:
        yield {"offset": 0, "error": str(e)}
        return
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at >= 8 and struct.unpack_from("<I", data, at)[0] in SKIPPABLE:
            begin, at = at, at + 8 + struct.unpack_from("<I", data, at + 4)[0]
            if at > len(data):
                yield {"offset": begin, "error": "truncated skippable frame"}
            continue
        try:
            end = frame_end(data, at)
        except WarcError as e:
            yield {"offset": at, "error": str(e)}
            return
        try:
            frame = decoder.decompressobj()
            raw = frame.decompress(data[at:end])
            if not frame.eof:
                raise WarcError("truncated frame")
            yield {"offset": at, "error": None} | parse_record(raw)
        except (WarcError, zstandard.ZstdError, ValueError) as e:
            yield {"offset": at, "error": str(e)}
        at = end


def read_archives(spark: SparkSession, path: str | list[str], payloads: bool = True, strict: bool = True) -> DataFrame:
    """All records of the archives at path (folders, globs), as RECORD_SCHEMA. Spark's reader opens the files, so any
    store will do. strict: a bad record fails the job; else it is a row whose error says why. payloads=False leaves the
    payload null after it has been checked. Revisits have no payload; their payload_bytes are those of the full one."""
    schema = spark.createDataFrame([], RECORD_SCHEMA).schema
    arrow = pa.schema([("archive", pa.string()), ("offset", pa.int64()), *[(c, pa.string()) for c in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")], ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])

    def read(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows, held = [], 0
                for row in parse_archive(memoryview(content.as_buffer())):
                    if strict and row["error"]:
                        raise WarcError(f"{name.as_py()} at {row['offset']}: {row['error']}")
                    if not payloads:
                        row["payload"] = None
                    rows.append({"archive": name.as_py()} | row)
                    held += len(row.get("payload") or b"")
                    if len(rows) == 4096 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, schema)


def train_dictionary(payloads: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; too few samples to train on serve as they are."""
    samples = [p for p in payloads if p]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _line(name: str, value: str) -> bytes:
    return f"{name}: {' '.join(value.split())}\r\n".encode()


def build_record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str = WRITTEN) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + _line("Content-Length", str(len(payload))) + b"\r\n"
    block = http if refers_to else http + payload
    head = WARC_VERSION + b"\r\n" + _line("WARC-Type", "revisit" if refers_to else "response") + _line("WARC-Record-ID", record_id) + _line("WARC-Date", date)
    if url is not None and url.strip():
        head += _line("WARC-Target-URI", url)
    if refers_to:
        head += _line("WARC-Refers-To", refers_to) + _line("WARC-Profile", REVISIT_PROFILE)
    head += _line("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    head += _line("Content-Type", "application/http; msgtype=response") + _line("Content-Length", str(len(block)))
    return head + b"\r\n" + block + b"\r\n\r\n"


def page_record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to. Among payloads that are equal and have min_bytes at least, the largest
    page_id is kept and the others refer to it. Only digests meet in the aggregation; groups of two or more are joined
    back, by broadcast where they are few. Shorter pages have keys of their own, so they never meet in one task."""
    rows = pages.select("page_id", "url", utf8(F.col("html")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("length", F.octet_length("html"))
    kept = rows.where(F.col("length") >= min_bytes).groupBy("digest", "length").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    kept = materialize(kept.select(F.concat_ws(" ", "digest", "length").alias("key"), "kept"), "warc-kept")
    key = F.when(F.col("length") >= min_bytes, F.concat_ws(" ", "digest", "length")).otherwise(F.concat(F.lit("short "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    rows = join_small(rows.withColumn("key", key), kept, ["key"], "left")
    refers = F.when(F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    return rows.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def dictionary_sample(pages: DataFrame, most: int = DICTIONARY_PAGES, size: int = DICTIONARY_BYTES) -> list[bytes]:
    """The heads, size characters at most, of at most so many pages, by hash of their ids. Ids are chosen first, so no
    other page is sent anywhere."""
    some = pages.where(F.col("page_id").isNotNull() & (F.octet_length("html") > 0)).select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    heads = pages.select("page_id", F.substring("html", 1, size).alias("html")).join(F.broadcast(some), "page_id")  # most rows
    return [r["html"].encode() for r in heads.groupBy("page_id").agg(F.max("html").alias("html")).orderBy("page_id").collect()]


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Write a record for every row of pages (page_id, url, html) under folder; returns how many.

    A null html is an empty payload, a null url leaves its header out, a null page_id is the id <urn:page:none> and never
    kept for others unless all of its group are null. Payloads under min_bytes are never revisits; very long ones are one
    record each. Rows repeated with the largest page_id of their group are all responses. An empty table writes no archive.
    Other columns are not read. Each attempt of a task writes under a name of its own; the manifest names those that
    Spark counts, so lost executors and repeated tasks leave one copy of each record. archives() reads it.
    """
    dictionary = train_dictionary(dictionary_sample(pages))

    def write(batches):
        from pyspark import TaskContext

        attempt = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        coder = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
        frames, held, files, n = [], 0, 0, 0

        def flush():
            nonlocal frames, held, files
            if frames:
                write_bytes(f"{attempt}/{files:05d}.warc.zst", lead + b"".join(frames))
                frames, held, files = [], 0, files + 1

        for batch in batches:
            for page_id, url, html, digest, refers in zip(*[batch[c] for c in ("page_id", "url", "html", "digest", "refers_to")]):
                raw = build_record(page_record_id(page_id.as_py()), url.as_py(), html.as_py().encode(), digest.as_py(), page_record_id(refers.as_py()) if refers.is_valid else None)
                frames.append(coder.compress(raw))
                held, n = held + len(raw), n + 1
                if held >= archive_bytes:
                    flush()
        flush()
        yield pa.RecordBatch.from_pydict({"attempt": pa.array([attempt]), "n": pa.array([n], pa.int64())})

    plan_records(pages, min_bytes).mapInArrow(write, MANIFEST).where("n > 0").write.mode("overwrite").parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/_manifest").agg(F.sum("n")).first()[0] or 0


def archives(spark: SparkSession, folder: str) -> list[str]:
    """Where the archives under folder are: one path for each task that wrote any."""
    return [r["attempt"] for r in spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").orderBy("attempt").collect()]


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read the records back, without their payloads."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    if not write_archives(pages, folder):
        return spark.createDataFrame([], RECORD_SCHEMA)
    return read_archives(spark, archives(spark, folder), payloads=False)

"""The changes of a store's collection as a stream: its offsets are commits, its rows inserted, replaced and deleted records.

spark.readStream.format("store_changes").option("root", ...).option("collection", ...) begins with the first commit, or behind
option("since", version). A commit's delta is read by the workers, a file each, as Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quillspark.sources.store import COLUMNS, RECORD

SCHEMA = f"version long, kind string, {RECORD}"
ARROW = pa.schema([
    ("version", pa.int64()), ("kind", pa.string()), ("seq", pa.int64()), ("id", pa.string()), ("doc_id", pa.string()), ("document", pa.string()), ("path", pa.string()), ("title", pa.string()),
    ("mtime", pa.float64()), ("chunk_index", pa.int32()), ("chunk_count", pa.int32()), ("section_label", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("embedding", pa.list_(pa.float32())),
])


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.since = f"{options['root'].rstrip('/')}/{options['collection']}", int(options.get("since", -1))

    def _commits(self) -> list[int]:
        from pyarrow import fs

        store, path = _open(f"{self.folder}/commits")
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(int(f.base_name) for f in found if f.base_name.isdigit() and f.size)

    def initialOffset(self) -> dict:
        return {"version": self.since}

    def latestOffset(self) -> dict:
        return {"version": max(self._commits(), default=self.since)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        from pyarrow import fs

        out, there = [], self._commits()
        if there and start["version"] < there[0] - 1 and there[0] > 0:
            raise ValueError(f"commits up to {there[0] - 1} were vacuumed before the stream at {start['version']} read them")
        for n in there:
            if start["version"] < n <= end["version"]:
                store, path = _open(f"{self.folder}/commits/{n:012d}")
                state = json.loads(store.open_input_stream(path).read().decode().split("\n")[0])
                if state["delta"]:
                    store, path = _open(f"{self.folder}/{state['delta']}")
                    files = store.get_file_info(fs.FileSelector(path))
                    out += [InputPartition((n, state["before"], f"{state['delta']}/{f.base_name}")) for f in files if f.base_name.endswith(".parquet")]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        version, before, file = partition.value
        store, path = _open(f"{self.folder}/{file}")
        with store.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=4096):
                kind = pc.if_else(batch["gone"], "deleted", pc.if_else(pc.greater_equal(batch["seq"], before), "inserted", "replaced"))
                columns = [pa.array([version] * batch.num_rows, pa.int64()), kind, *[batch[c] for c in COLUMNS]]
                yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, ARROW)], schema=ARROW)

    def commit(self, end: dict) -> None:
        pass


class StoreChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "store_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options)


def read_changes(spark: SparkSession, root: str, collection: str, since: int = -1) -> DataFrame:
    """The stream of a collection's changes behind a version."""
    spark.dataSource.register(StoreChanges)
    return spark.readStream.format("store_changes").option("root", root).option("collection", collection).option("since", str(since)).load()

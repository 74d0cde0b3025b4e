"""Exact nearest neighbours over vectors filed in blocks around centres.

A block keeps the least and greatest distance of its vectors to each centre. By the triangle inequality no vector of it is
nearer to a query than the difference of these to the query's own distances, so blocks beyond the k-th result are skipped.
The index also knows, for each centre, the distances of the vectors nearest to it: with the query's distance to the centre
they bound the k-th result before anything is read, so a search is one job, and a task lowers the bound by what it finds.
How many blocks are skipped depends on the vectors: near ones in clusters are found in few blocks; where all vectors are about
equally far from each other, as random ones of many dimensions are, every block is read and the search is the plain scan.

Every search is exact. Vectors that are null, empty or not finite are left out, as are null keys; repeated vectors are
results of their own. Vectors of another dimension than the centres' are filed without bounds and always read for queries of theirs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators import search

#: Centres; vectors they are fitted on, the first by hash; steps of fitting.
CENTRES, SAMPLE, STEPS = 64, 4096, 8
#: Distances that a block and a cell keep of the vectors nearest to their centre.
KEPT = 64
#: Blocks that a refined search asks first, beyond those that k rows fill.
FIRST = 8
#: Bytes of a row group: about a block, so that a filter on bounds skips blocks unread.
GROUP_BYTES = 4 << 20
BLOCKS = "block long, cell int, dimension int, n int, near double, far double, lows array<double>, highs array<double>, reaches array<double>, keys binary, data binary"
CELLS = "cell int, centre array<double>, lows array<double>, highs array<double>, near double, far double, reaches array<double>"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "binary": pa.binary()}
ARROW = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in BLOCKS.split(", ")])


def distances(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of each row of x to each centre; they differ by the rounding."""
    x = x.astype(np.float64)
    scale = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", centres, centres)[None]
    squared, error = scale - 2 * x @ centres.T, 8 * (x.shape[1] + 4) * 2.0**-53 * scale
    return np.sqrt(np.maximum(squared - error, 0)), np.sqrt(np.maximum(squared, 0) + error)


def known_vectors(records: DataFrame) -> DataFrame:
    """seq, embedding of the records that have a distance."""
    rows = records.select(F.col("seq").cast("long").alias("seq"), F.col("embedding").cast("array<float>").alias("embedding"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("seq").isNotNull() & (F.size("embedding") > 0) & finite)


def choose_centres(records: DataFrame, n: int = CENTRES, sample: int = SAMPLE) -> np.ndarray:
    """At most n centres (a row each) by k-means over a bounded sample, the first vectors by hash of the key. The dimension is the
    commonest of the sample, the smaller of two; without vectors there are no centres."""
    some = [r[0] for r in known_vectors(records).orderBy(F.xxhash64("seq"), "seq").limit(sample).select("embedding").collect()]
    lengths, counts = np.unique([len(v) for v in some], return_counts=True)
    if not some:
        return np.zeros((0, 1))
    x = np.array([v for v in some if len(v) == lengths[counts.argmax()]], np.float64)
    _, at = np.unique(x, axis=0, return_index=True)
    centres = x[np.sort(at)[:n]]
    for _ in range(STEPS):
        cell = distances(x, centres)[0].argmin(1)
        centres = np.array([x[cell == i].mean(0) if (cell == i).any() else centres[i] for i in range(len(centres))])
    return centres


def _lists(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return np.asarray(batch.column(column).flatten(), np.float64).reshape(batch.num_rows, -1)


def file_vectors(records: DataFrame, centres: np.ndarray, size: int = search.CORPUS_BLOCK) -> DataFrame:
    """Blocks (BLOCKS) of at most so many vectors of one cell, neighbours by their distance to its centre. Ranges of cell
    and distance are shuffled, so a cell that holds most vectors is many tasks."""

    def place(batches):
        for batch in batches:
            lengths = pc.list_value_length(batch.column("embedding")).to_numpy()
            cell, reach = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            mine = np.flatnonzero(lengths == centres.shape[1]) if len(centres) else []
            if len(mine):
                x = np.asarray(batch.column("embedding").take(pa.array(mine)).flatten(), np.float32).reshape(len(mine), -1)
                far = distances(x, centres)[1]
                cell[mine], reach[mine] = far.argmin(1), far.min(1)
            yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("embedding"), pa.array(cell), pa.array(reach), pa.array(lengths)], ["seq", "embedding", "cell", "reach", "dimension"])

    def pack(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            cells, dimensions = batch.column("cell").to_numpy(), batch.column("dimension").to_numpy()
            edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(dimensions) != 0)) + 1
            for start, end in zip([0, *edges], [*edges, batch.num_rows]):
                for lo in range(start, end, size):
                    part = batch.slice(lo, min(size, end - lo))
                    x = np.asarray(part.column("embedding").flatten(), np.float32).reshape(part.num_rows, -1)
                    cell, lows, highs, reaches = int(cells[lo]), [], [], []
                    if cell >= 0:
                        low, high = distances(x, centres)
                        lows, highs, reaches = low.min(0).tolist(), high.max(0).tolist(), np.sort(high[:, cell])[:KEPT].tolist()
                    row = (block, cell, x.shape[1], len(x), lows[cell] if lows else 0.0, highs[cell] if lows else 0.0, lows, highs, reaches, part.column("seq").to_numpy().astype(np.int64).tobytes(), x.tobytes())
                    yield pa.RecordBatch.from_pydict({f.name: [v] for f, v in zip(ARROW, row)}, ARROW)
                    block += 1

    placed = known_vectors(records).mapInArrow(place, "seq long, embedding array<float>, cell int, reach double, dimension int")
    order = ["cell", "dimension", "reach", "seq"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, BLOCKS)


def any_of(conditions: list[Column]) -> Column:
    """Their disjunction as a balanced tree."""
    while len(conditions) > 1:
        conditions = [reduce(lambda a, b: a | b, conditions[i : i + 2]) for i in range(0, len(conditions), 2)]
    return conditions[0]


def bounds(batch: pa.RecordBatch, reach) -> np.ndarray:
    """The least distance that a vector of each block of a batch can have to each query: blocks by queries."""
    out = np.zeros((batch.num_rows, len(reach[0])))
    at = np.flatnonzero(batch.column("cell").to_numpy() >= 0)
    if len(at) and reach[0].shape[1]:
        some = batch.take(pa.array(at))
        lows, highs = _lists(some, "lows"), _lists(some, "highs")
        for i, (low, high) in enumerate(zip(*reach)):
            out[at, i] = np.maximum(np.maximum(lows - high, low - highs).max(1), 0)
    return out


def summarize(blocks: DataFrame, centres: np.ndarray) -> DataFrame:
    """CELLS of blocks: their bounds to each centre and the KEPT least distances to their own. At most a row a centre."""
    mine = blocks.where(F.col("cell") >= 0)
    each = mine.select("cell", F.posexplode(F.arrays_zip("lows", "highs")).alias("at", "b")).groupBy("cell", "at").agg(F.min("b.lows").alias("low"), F.max("b.highs").alias("high"))
    each = each.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("b"))  # a row a centre
    own = mine.groupBy("cell").agg(F.min("near").alias("near"), F.max("far").alias("far"))
    nth = F.row_number().over(Window.partitionBy("cell").orderBy("reach"))
    least = mine.select("cell", F.explode("reaches").alias("reach")).withColumn("nth", nth).where(F.col("nth") <= KEPT)
    least = least.groupBy("cell").agg(F.sort_array(F.collect_list("reach")).alias("reaches"))
    points = blocks.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    rows = points.join(each, "cell").join(own, "cell").join(least, "cell", "left")
    return rows.select("cell", "centre", F.col("b.low").alias("lows"), F.col("b.high").alias("highs"), "near", "far", "reaches")


@dataclass(frozen=True)
class PivotIndex:
    """Blocks of a folder, their centres, and CELLS rows by cell. A snapshot: it holds the records of its build."""

    blocks: DataFrame
    centres: np.ndarray
    cells: dict

    @staticmethod
    def build(records: DataFrame, folder: str, n: int = CENTRES, sample: int = SAMPLE, size: int = search.CORPUS_BLOCK) -> PivotIndex:
        """File all records (seq, embedding) in a folder that must not hold an index yet. The cells are written last: a folder
        without them is no index."""
        spark, centres = records.sparkSession, choose_centres(records, n, sample)
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{folder}/centres")
        groups = {"parquet.block.size": str(GROUP_BYTES), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1"}
        file_vectors(records, centres, size).write.options(**groups).parquet(f"{folder}/blocks")
        summarize(spark.read.schema(BLOCKS).parquet(f"{folder}/blocks"), centres).coalesce(1).write.parquet(f"{folder}/cells")
        return PivotIndex.open(spark, folder)

    @staticmethod
    def open(spark: SparkSession, folder: str) -> PivotIndex:
        rows = spark.read.schema("cell int, centre array<double>").parquet(f"{folder}/centres").orderBy("cell").collect()  # a row a centre
        cells = {r.cell: r for r in spark.read.schema(CELLS).parquet(f"{folder}/cells").collect()}
        return PivotIndex(spark.read.schema(BLOCKS).parquet(f"{folder}/blocks"), np.array([r.centre for r in rows]) if rows else np.zeros((0, 1)), cells)

    def _reach(self, q: np.ndarray):
        """Bounds of the distances of the queries to the centres; none for another dimension."""
        return distances(q, self.centres) if q.shape[1] == self.centres.shape[1] and len(self.centres) else (np.zeros((len(q), 0)),) * 2

    def _scan(self, blocks: DataFrame, qk: np.ndarray, q: np.ndarray, k: int, limits: np.ndarray) -> DataFrame:
        """The k nearest of each query in the blocks that can hold a vector within its limit, and within what a task has found."""
        reach = self._reach(q)

        def run(batches):
            held, least = [], limits.copy()
            for batch in batches:
                bound = bounds(batch, reach)
                for i in np.argsort(bound.min(1), kind="stable").tolist():
                    open_to = bound[i] <= least
                    if open_to.any():
                        ck = np.frombuffer(batch.column("keys")[i].as_buffer(), np.int64)
                        c = np.frombuffer(batch.column("data")[i].as_buffer(), np.float32).reshape(len(ck), -1)
                        held = [search._best([*held, search.measured(ck, c, np.flatnonzero(open_to), q[open_to], k)], k)]
                        full, n = np.unique(held[0][0], return_counts=True)
                        last = np.sqrt(held[0][2][np.cumsum(n) - 1]) * (1 + 1e-9)
                        least[full[n == k]] = np.minimum(least[full[n == k]], last[n == k])
            if held:
                held = [(qk[held[0][0]], *held[0][1:])]
            if held:
                yield pa.RecordBatch.from_pydict(dict(zip(("query_id", "seq", "distance"), held[0])))

        rows = blocks.where(F.col("dimension") == q.shape[1]).select("cell", "lows", "highs", "keys", "data")
        return search.first_ranks(rows.mapInArrow(run, "query_id long, seq long, distance double"), k)

    def _limits(self, qk: np.ndarray, q: np.ndarray, k: int, refine: bool) -> np.ndarray:
        """For each query a distance that its k-th result does not exceed: by the vectors nearest to the centres, or, refined, by the blocks
        that may be nearest; infinite where those are fewer than k rows."""
        reach = self._reach(q)
        limits = np.full(len(qk), np.inf)
        if reach[1].shape[1]:
            # Vectors have one cell, so the sums are of different vectors and k of them lie within the k-th.
            sums = np.concatenate([reach[1][:, [i]] + np.array(r.reaches)[None] for i, r in self.cells.items()], axis=1)
            if sums.shape[1] >= k:
                limits = np.partition(sums, k - 1, axis=1)[:, k - 1] * (1 + 1e-9)
        return np.minimum(limits, self._refined(qk, q, k)) if refine else limits

    def _refined(self, qk: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        reach, most = self._reach(q), FIRST + k // search.CORPUS_BLOCK

        def best(batches):
            held = []
            for batch in batches:
                bound, of = bounds(batch, reach), batch.column("block").to_numpy()
                n = batch.column("n").to_numpy().astype(np.int64)
                at = np.argsort(bound, axis=0, kind="stable")[:most].ravel(order="F")
                query = np.repeat(np.arange(len(qk)), min(most, len(of)))
                held.append((query, of[at], n[at], bound[at, query]))
                query, block, size, least = (np.concatenate(x) for x in zip(*held))
                order = np.lexsort((block, least, query))
                order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < most]
                held = [(query[order], block[order], size[order], least[order])]
            if held:
                yield pa.RecordBatch.from_pydict(dict(zip(("query", "block", "n", "bound"), held[0])))

        rows = self.blocks.where(F.col("dimension") == q.shape[1]).select("block", "cell", "n", "lows", "highs")
        near = rows.mapInArrow(best, "query long, block long, n long, bound double")
        near = near.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("bound", "block"))).where(F.col("nth") <= most)
        some = {}
        for r in near.orderBy("query", "nth").collect():  # `most` rows a query
            taken = some.setdefault(r.query, [])
            if sum(n for _, n in taken) < k:
                taken.append((r.block, r.n))
        limits = np.full(len(qk), np.inf)
        if some:
            found = self._scan(self.blocks.where(F.col("block").isin(sorted({b for t in some.values() for b, _ in t}))), np.arange(len(qk)), q, k, limits)
            for r in found.where(F.col("rank") == k).collect():  # a row a query
                limits[r.query_id] = np.sqrt(r.distance) * (1 + 1e-9)
        return limits

    def _open(self, q: np.ndarray, limits: np.ndarray) -> DataFrame:
        """The blocks that the bounds of their cell and their distances to its centre do not rule out; the filter reaches the Parquet row groups."""
        low, high = self._reach(q)
        if not low.shape[1] or np.isinf(limits).any():
            return self.blocks
        met = [F.col("cell") == -1]
        for i, r in self.cells.items():
            bound = np.maximum(np.array(r.lows) - high, low - np.array(r.highs)).max(1)
            some = bound <= limits
            if some.any():
                least, most = float((low[some, i] - limits[some]).min()), float((high[some, i] + limits[some]).max())
                met.append((F.col("cell") == i) & (F.col("far") >= least) & (F.col("near") <= most))
        return self.blocks.where(any_of(met))

    def nearest(self, asked: list[tuple[int, list[float]]], k: int, refine: bool = False) -> DataFrame:
        """query_id, seq, distance, rank: the k nearest by (distance, seq) for a few queries (query_id, vector), their ids distinct. A
        refined search asks the blocks that may be nearest in jobs of their own before: worth it where blocks are many."""
        qk, q = search.given(asked)
        limits = self._limits(qk, q, k, refine)
        return self._scan(self._open(q, limits), qk, q, k, limits)

    def share(self, asked: list[tuple[int, list[float]]], k: int, refine: bool = False) -> DataFrame:
        """query_id, blocks, met: how many blocks of its dimension there are and how many its search can't skip."""
        qk, q = search.given(asked)
        limits, reach = self._limits(qk, q, k, refine), self._reach(q)

        def count(batches):
            for batch in batches:
                met = (bounds(batch, reach) <= limits).sum(0)
                yield pa.RecordBatch.from_pydict({"query_id": qk, "blocks": np.full(len(qk), batch.num_rows), "met": met})

        rows = self.blocks.where(F.col("dimension") == q.shape[1]).select("cell", "lows", "highs")
        return rows.mapInArrow(count, "query_id long, blocks long, met long").groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum("met").alias("met"))

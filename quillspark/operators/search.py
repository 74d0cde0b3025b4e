"""Exact nearest neighbours, keyword ranking and their fusion.

Records have id, seq, doc_id, path, title, document, embedding and chunk columns as far as an operator needs them. Every
ranking ends in seq, so results do not depend on partitioning.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.functions import vector as V

#: Fixed values of the ranking.
RRF_K = 60
MAX_WEIGHT, DEFAULT_WEIGHT = 3.0, 1.0
MAX_TERMS, MAX_SHORT_TERMS, MAX_WINDOWS = 32, 8, 24
BM25_K1, BM25_B, BM25_FLOOR = 1.2, 0.75, 1e-6
#: Fixed value: hits of the picker.
PICKER = 12
#: Rows of a block of the batched search.
CORPUS_BLOCK, QUERY_BLOCK = 4096, 512
#: Results that a task of the batched search holds.
HELD = 1_000_000


def nearest(records: DataFrame, vector, k: int) -> DataFrame:
    """The k records nearest to one vector by (distance, seq): a top-k heap in each partition, then their merge. Vectors of
    another dimension and those that are not finite have no distance."""
    known = records.withColumn("distance", V.squared_l2(F.col("embedding"), V.literal(vector)))
    return known.where(F.col("distance") < float("inf")).orderBy("distance", "seq").limit(k)


def packed(rows: DataFrame, key: str, size: int = CORPUS_BLOCK) -> DataFrame:
    """keys, data: vectors (key, embedding) in blocks of at most so many, each a matrix of floats of one dimension. Nulls and
    vectors that are not finite are left out. Keep it (cache, or write it) where the same vectors are searched again."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                keys, lengths = part.column(0).to_numpy().astype(np.int64), pc.list_value_length(part.column(1)).to_numpy()
                values = np.asarray(part.column(1).flatten(), np.float32)
                of = np.repeat(lengths, lengths)
                for n in np.unique(lengths):
                    block, found = values[of == n].reshape(-1, n), keys[lengths == n]
                    finite = np.isfinite(block).all(1)
                    if finite.any():
                        yield pa.RecordBatch.from_pydict({"keys": [found[finite].tobytes()], "data": [block[finite].tobytes()]})

    known = rows.where((F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull()) & F.col(key).isNotNull())
    return known.select(F.col(key).cast("long"), F.col("embedding").cast("array<float>")).mapInArrow(run, "keys binary, data binary")


def _best(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query among several results (query, seq, distance)."""
    q, c, d = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((c, d, q))
    q, c, d = q[order], c[order], d[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], c[keep], d[keep]


def measured(ck: np.ndarray, c: np.ndarray, qk: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, seq, distance) of at least the k nearest of a block of vectors for each query. The product of the matrices is
    rounded; all within twice its error bound, and those that it can't tell, are measured directly in double precision."""
    with np.errstate(over="ignore", invalid="ignore"):
        qq, cc = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", c, c)
        rough = qq[:, None] + cc[None] - 2 * q @ c.T
        error = 4 * (q.shape[1] + 4) * 2.0**-24 * (qq + cc.max()) + 1e-12
        most = min(k, len(ck))
        limit = np.partition(rough, most - 1, axis=1)[:, most - 1] + error
        at, of = np.nonzero(~(rough > limit[:, None]))
    return qk[at], ck[of], ((q[at].astype(np.float64) - c[of]) ** 2).sum(1)


def first_ranks(found: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query with their rank."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "seq")))
    return ranked.where(F.col("rank") <= k)


def given(asked: list[tuple[int, list[float]]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and matrix of the queries of a call; there are at most QUERY_BLOCK, finite and of one dimension."""
    if not 0 < len(asked) <= QUERY_BLOCK or len({len(v) for _, v in asked}) != 1 or not len(asked[0][1]):
        raise ValueError(f"give 1 to {QUERY_BLOCK} vectors of one dimension")
    q = np.array([v for _, v in asked], np.float32)
    if not np.isfinite(q).all():
        raise ValueError("a vector is not finite")
    return np.array([i for i, _ in asked], np.int64), q


def nearest_held(corpus: DataFrame, asked: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """query_id, seq, distance, rank: the k nearest of packed vectors for a few queries (query_id, vector) that the caller
    holds. They go to every task; a task passes on its own k best, so nothing but those is shuffled."""
    qk, q = given(asked)

    def search(batches):
        held = []
        for batch in batches:
            for keys, data in zip(batch.column(0), batch.column(1)):
                ck = np.frombuffer(keys.as_buffer(), np.int64)
                c = np.frombuffer(data.as_buffer(), np.float32).reshape(len(ck), -1)
                if c.shape[1] == q.shape[1]:
                    held = [_best([*held, measured(ck, c, qk, q, k)], k)]
        if held:
            yield pa.RecordBatch.from_pydict(dict(zip(("query_id", "seq", "distance"), held[0])))

    return first_ranks(corpus.select("keys", "data").mapInArrow(search, "query_id long, seq long, distance double"), k)


def nearest_packed(corpus: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, seq, distance, rank: the k nearest of packed vectors for each packed query. A pair of blocks is one matrix
    product; a task keeps the best k of the blocks it has met and passes on only those, and a window keeps the best of all.
    Spark plans the pairs of blocks: it broadcasts a side only below its threshold."""

    def search(batches):
        held, size = [], 0
        for batch in batches:
            for ck, cd, qk, qd in zip(*[batch.column(c) for c in range(4)]):
                ck, qk = np.frombuffer(ck.as_buffer(), np.int64), np.frombuffer(qk.as_buffer(), np.int64)
                c = np.frombuffer(cd.as_buffer(), np.float32).reshape(len(ck), -1)
                q = np.frombuffer(qd.as_buffer(), np.float32).reshape(len(qk), -1)
                if q.shape[1] != c.shape[1]:
                    continue
                held.append(measured(ck, c, qk, q, k))
                size += len(held[-1][0])
                if size > HELD:
                    held = [_best(held, k)]
                    size = len(held[0][0])
                    if size > HELD // 2:  # that many queries: pass them on
                        yield pa.RecordBatch.from_pydict(dict(zip(("query_id", "seq", "distance"), held[0])))
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict(dict(zip(("query_id", "seq", "distance"), _best(held, k))))

    pairs = corpus.select(F.col("keys").alias("ck"), F.col("data").alias("cd")).crossJoin(asked.select(F.col("keys").alias("qk"), F.col("data").alias("qd")))
    found = pairs.mapInArrow(search, "query_id long, seq long, distance double")
    return first_ranks(found, k)


def nearest_batch(records: DataFrame, queries: DataFrame, k: int, corpus_block: int = CORPUS_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, seq, distance, rank: the k nearest of records (seq, embedding) for each row of queries (query_id,
    embedding). Nulls are left out."""
    return nearest_packed(packed(records, "seq", corpus_block), packed(queries, "query_id", query_block), k)


@dataclass(frozen=True)
class KeywordQuery:
    terms: tuple[str, ...]
    short_terms: tuple[str, ...]

    @property
    def match(self) -> str | None:
        """The terms as quoted phrases joined by OR."""
        return " OR ".join('"' + t.replace('"', '""') + '"' for t in self.terms) or None


_CJK_RUN = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff]+")
_WORD = re.compile(r"\w[\w.\-:/#@]*\w|\w")


def keyword_query(text: str | None) -> KeywordQuery:
    """Terms of a query text: CJK runs of three to eight characters and their windows of three, words of three characters
    or more in lower case; pairs of CJK characters are short terms, found by substring."""
    source = unicodedata.normalize("NFKC", text or "")[:2000]
    terms, short = {}, {}
    for run in _CJK_RUN.findall(source):
        if len(run) == 2:
            short[run] = None
        elif len(run) >= 3:
            if len(run) <= 8:
                terms[run] = None
            terms |= dict.fromkeys(run[i : i + 3] for i in range(min(len(run) - 2, MAX_WINDOWS)))
    terms |= dict.fromkeys(w.lower() for w in _WORD.findall(_CJK_RUN.sub(" ", source)) if len(w) >= 3)
    return KeywordQuery(tuple(terms)[:MAX_TERMS], tuple(short)[:MAX_SHORT_TERMS])


def trigram_length() -> Column:
    """The length of a document in trigrams."""
    return F.greatest(F.length("document") - 2, F.lit(0)).cast("double")


def _occurrences(lowered: Column, term: str) -> Column:
    """How often a term occurs, overlaps included. A term that can't overlap itself is counted by what its removal takes."""
    if any(term[:n] == term[-n:] for n in range(1, len(term))):
        return F.regexp_count(lowered, F.lit("(?=\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E)"))
    return ((F.length(lowered) - F.length(F.replace(lowered, F.lit(term), F.lit("")))) / len(term)).cast("int")


def bm25_of(records: DataFrame, sizes: DataFrame, terms, k: int | None = None) -> DataFrame:
    """records with score, best first: BM25 over trigram lengths, negative, so smaller is better. records must hold every
    record with any of the terms; sizes is one row: _n records and their mean length _avg. A term's own frequency is
    counted where it occurs."""
    terms = [t.lower() for t in terms]
    if not terms:
        return records.where(F.lit(False)).withColumn("score", F.lit(0.0))
    low = F.lower("document")
    counted = records.where(F.col("document").isNotNull()).withColumn("_tf", F.array(*[_occurrences(low, t) for t in terms]))
    found = counted.withColumn("_dl", trigram_length()).where(F.exists("_tf", lambda f: f > 0))
    stats = found.agg(F.array(*[F.count_if(F.col("_tf")[i] > 0) for i in range(len(terms))]).alias("_df")).crossJoin(sizes)  # one row
    rows = found.crossJoin(F.broadcast(stats))  # one row
    total = F.lit(0.0)
    for i in range(len(terms)):
        f, n = F.col("_tf")[i], F.col("_df")[i]
        idf = F.log((F.col("_n") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, F.lit(BM25_FLOOR)).otherwise(idf)
        total = total + idf * f * (BM25_K1 + 1) / (f + BM25_K1 * (1 - BM25_B + BM25_B * F.col("_dl") / F.col("_avg")))
    ranked = rows.withColumn("score", -total).drop("_dl", "_tf", "_n", "_avg", "_df").orderBy("score", "seq")
    return ranked if k is None else ranked.limit(k)


def bm25(records: DataFrame, terms, k: int | None = None) -> DataFrame:
    """The same over all records, with their own statistics."""
    return bm25_of(records, records.where(F.col("document").isNotNull()).agg(F.count("*").alias("_n"), F.avg(trigram_length()).alias("_avg")), terms, k)


def short_term_hits(records: DataFrame, terms, k: int) -> DataFrame:
    """id, seq, hits, term, rank: how many short terms a record holds; a term counts for its first k records only."""
    if not terms:
        return records.select("id", "seq", F.lit(0).alias("hits"), F.lit(0).alias("term"), F.lit(0).alias("rank")).where(F.lit(False))
    each = [records.where(F.instr("document", t) > 0).select("id", "seq", F.lit(i).alias("term")).orderBy("seq").limit(k) for i, t in enumerate(terms)]
    hits = each[0]
    for more in each[1:]:
        hits = hits.unionByName(more)
    hits = hits.groupBy("id", "seq").agg(F.count("*").cast("int").alias("hits"), F.min(F.struct("term", "seq")).alias("first"))
    order = Window.orderBy(F.desc("hits"), "first")  # terms * k rows at most
    return hits.select("id", "seq", "hits", F.col("first.term").alias("term"), F.row_number().over(order).alias("rank"))


def clamp_weight(value) -> float:
    try:
        number = float(value)
    except (TypeError, ValueError):
        return DEFAULT_WEIGHT
    return min(MAX_WEIGHT, max(0.0, number)) if number == number and abs(number) != float("inf") else DEFAULT_WEIGHT


def fuse(lists: list[tuple[DataFrame, float]], k: int = RRF_K, keys: list[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion. Each list has id and rank (and keys, which part independent fusions). Returns them with
    fused_score and position; a list without weight brings nothing; ties go to the id that an earlier list, then a better rank, brought first."""
    keys = keys or []
    every = None
    for i, (df, w) in enumerate(lists):
        part = df.select(*keys, "id", F.lit(i).alias("list"), "rank", (F.lit(w) / (F.lit(k) + F.col("rank"))).alias("part"))
        part = part if w > 0 else part.where(F.lit(False))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy(*keys, "id").agg(F.sum("part").alias("fused_score"), F.min(F.struct("list", "rank")).alias("first"))
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy(F.desc(F.round("fused_score", 12)), "first")
    return fused.withColumn("position", F.row_number().over(order)).drop("first")


def candidate_count(k: int) -> int:
    return min(1000, max(3 * k, 50))


def hybrid(records: DataFrame, vector, text: str, k: int, weight: float = DEFAULT_WEIGHT) -> DataFrame:
    """Vector and keyword candidates fused: id, seq, distance, fused_score, matched_by, position of the best k."""
    n, weight, query = candidate_count(k), clamp_weight(weight), keyword_query(text)
    near = nearest(records, vector, n).select("id", "seq", "distance").withColumn("rank", F.row_number().over(Window.orderBy("distance", "seq")))
    if not (weight > 0 and (query.terms or query.short_terms)):
        best = near.where(F.col("rank") <= k)
        return best.select("id", "seq", "distance", (F.lit(1.0) / (RRF_K + F.col("rank"))).alias("fused_score"), F.array(F.lit("vector")).alias("matched_by"), F.col("rank").alias("position"))
    words = bm25(records, query.terms, n).select("id", "seq", F.row_number().over(Window.orderBy("score", "seq")).alias("rank"))
    short = short_term_hits(records, query.short_terms, n).select("id", "seq", "rank")
    fused = fuse([(near, 1.0), (words, weight), (short, weight)]).where(F.col("position") <= k)
    hits = words.select("id").unionByName(short.select("id")).distinct().withColumn("by_keyword", F.lit("keyword"))
    got = near.select("id", F.lit("vector").alias("by_vector"))
    rows = records.select("id", "seq", V.squared_l2(F.col("embedding"), V.literal(vector)).alias("distance")).join(F.broadcast(fused), "id")  # k rows
    rows = rows.join(hits, "id", "left").join(got, "id", "left")
    return rows.select("id", "seq", "distance", "fused_score", F.array_compact(F.array("by_vector", "by_keyword")).alias("matched_by"), "position").orderBy("position")


def picked(records: DataFrame, vector, text: str, weight: float = DEFAULT_WEIGHT) -> DataFrame:
    """hybrid() as a picker lists it: PICKER hits with place, their order by distance, and by the fused position where that is
    equal. The fused order chooses the hits and is otherwise given up."""
    place = F.row_number().over(Window.orderBy("distance", "position"))  # PICKER rows
    return hybrid(records, vector, text, PICKER, weight).withColumn("place", place).orderBy("place")


def by_tool(near: DataFrame, words: DataFrame, short: DataFrame, limit: int) -> DataFrame:
    """id, fused_score, matched_by, position: lists of the tool server (id, rank), each of weight 1; without keyword hits
    the vector list alone."""
    fused = fuse([(near, 1.0), (words, 1.0), (short, 1.0)]).where(F.col("position") <= limit)
    hits = words.select("id").unionByName(short.select("id")).distinct().withColumn("by_keyword", F.lit("keyword"))
    rows = fused.join(near.select("id", F.lit("vector").alias("by_vector")), "id", "left").join(hits, "id", "left")
    return rows.select("id", "fused_score", F.array_compact(F.array("by_vector", "by_keyword")).alias("matched_by"), "position")


def backfilled(records: DataFrame, vector, k: int, muted: list[str] = (), excluded: list[str] = (), chunk_ids: list = (), pool: int | None = 200) -> DataFrame:
    """The k nearest that may be returned, among the pool nearest of all (None: among all). The pool's size is what an
    expanding fetch reaches in the end; a first fetch that is enough gives the same rows."""
    near = records if pool is None else nearest(records, vector, pool)
    return nearest(visible(near, muted, excluded, chunk_ids), vector, k)


def by_document(records: DataFrame, vectors: DataFrame, doc_id, k: int) -> DataFrame:
    """The k nearest records of other documents to a document's own vector. vectors: doc_id, embedding."""
    me = vectors.where(F.col("doc_id") == doc_id).select("embedding").first()
    if me is None:
        return records.where(F.lit(False)).withColumn("distance", F.lit(0.0))
    return nearest(records.where(~F.col("doc_id").eqNullSafe(F.lit(doc_id))), me["embedding"], k)


def visible(records: DataFrame, muted: list[str] = (), excluded: list[str] = (), chunk_ids: list[str] = ()) -> DataFrame:
    """Records that may be returned; filter before a limit, so a search fills up to k."""
    out = records
    if muted:
        out = out.where(~F.coalesce(F.col("path").isin(list(muted)), F.lit(False)))
    if excluded:
        out = out.where(~F.coalesce(T.is_excluded(F.col("path"), list(excluded)), F.lit(False)))
    return out.where(~F.col("id").isin(list(chunk_ids))) if chunk_ids else out


def without_active(results: DataFrame, path: str) -> DataFrame:
    """Results but those of the document that is open. They go after the limit, so fewer than k may be left."""
    return results.where(~F.col("path").eqNullSafe(F.lit(path)))


def shape(results: DataFrame) -> DataFrame:
    """Search results with their defaults."""
    text = lambda c, rest: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(rest))
    return results.select(
        F.col("id").alias("chunk_id"), F.coalesce("doc_id", F.lit("")).alias("doc_id"), F.coalesce("path", F.lit("")).alias("path"), text("title", "Untitled").alias("title"),
        F.coalesce("document", F.lit("")).alias("content"), F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), F.coalesce("chunk_count", F.lit(1)).alias("chunk_count"),
        F.coalesce("section_label", F.lit("")).alias("section_label"), F.coalesce("mtime", F.lit(0.0)).alias("mtime"), "distance", F.col("distance").alias("score"),
    )


def bands(results: DataFrame, keys: list[str]) -> DataFrame:
    """results with band: of each group the nearest quarter is strong, the farthest quarter exploratory, the rest related."""
    by = Window.partitionBy(*keys)
    ranked = results.withColumn("_r", F.row_number().over(by.orderBy("distance", "seq"))).withColumn("_n", F.count("*").over(by))
    quarter = F.ceil(F.col("_n") * 0.25)
    band = F.when(F.col("_r") <= quarter, "strong").when(F.col("_r") > F.col("_n") - quarter, "exploratory").otherwise("related")
    return ranked.withColumn("band", band).drop("_r", "_n")


def balanced(results: DataFrame, keys: list[str], limit: int, per_document: int | None = 2, source: Column | None = None) -> DataFrame:
    """At most per_document rows of a document (null: any number), then at most limit rows a group, by (distance, seq).
    Rows where source holds are left out first, such as those of the document one started from."""
    rows = results if source is None else results.where(~source)
    if per_document is not None:
        rows = rows.withColumn("_d", F.row_number().over(Window.partitionBy(*keys, "doc_id").orderBy("distance", "seq"))).where(F.col("_d") <= per_document).drop("_d")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "seq"))).where(F.col("position") <= limit)

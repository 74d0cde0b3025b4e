"""Line dedup by distinct-site spread.

A HyperLogLog sketch of the sites is kept per line hash and merged by aggregation. Lines whose estimate is near the
threshold get an exact distinct count; lines at or above it are boilerplate and leave every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import SPACES, join_small, materialize, utf8

#: A line found on so many sites is boilerplate.
MIN_SITES = 5
#: HyperLogLog buckets as a power of two: a relative standard error of 1.04 / 2 ** (LG_K / 2).
LG_K = 12
#: The removed lines of all texts are broadcast if they are at most so many hashes, else shuffled with the texts.
BROADCAST_HASHES = 500_000


def line_hashes(text: Column) -> Column:
    """Hash of each line, trimmed of ASCII white space; null for blank lines."""
    return F.transform(F.split(utf8(text), "\n"), lambda x: F.when(F.trim(x, F.lit(SPACES)) != "", F.xxhash64(F.trim(x, F.lit(SPACES)))))


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """docs: text, source -> line_hash of the lines on at least min_sites distinct sources. Null sources are no site."""
    lines = docs.where(F.col("source").isNotNull()).select("source", F.explode(line_hashes(F.col("text"))).alias("line_hash")).where(F.col("line_hash").isNotNull())
    spread = lines.groupBy("line_hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", lg_k)).alias("sites"))
    margin = max(1.0, 4 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    wide = materialize(spread.where(F.col("sites") >= min_sites - margin), "line-spread")
    near = wide.where(F.col("sites") <= min_sites + margin).select("line_hash")
    exact = join_small(lines, near, ["line_hash"], "left_semi").groupBy("line_hash").agg(F.count_distinct("source").alias("sites"))
    sure = wide.where(F.col("sites") > min_sites + margin).select("line_hash")
    return sure.unionByName(exact.where(F.col("sites") >= min_sites).select("line_hash"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """doc_id, source, text (without boilerplate), n_lines, n_removed, for every row of docs.

    n_lines counts lines with a visible character. Lines are compared without the white space around them; blank lines
    are never removed. Null texts count as empty: no lines, an empty text. A null source spreads no line, but its
    documents are cleaned like all others. A line on exactly min_sites sources goes. Repeated rows are each returned, very
    long texts are read whole. An empty table gives no rows; other columns are not read.
    """
    base = docs.select("doc_id", "source", utf8(F.col("text")).alias("text"), F.xxhash64("text").alias("text_hash"))
    common = materialize(boilerplate_lines(docs.select("source", "text"), min_sites, lg_k), "line-common")
    lines = base.select("text_hash", F.explode(line_hashes(F.col("text"))).alias("line_hash"))
    hits = join_small(lines, common, ["line_hash"]).groupBy("text_hash").agg(F.collect_set("line_hash").alias("bad"))
    hits = materialize(hits, "line-hits")
    bad = F.coalesce(F.col("bad"), F.array().cast("array<bigint>"))
    few = (hits.agg(F.sum(F.size("bad"))).first()[0] or 0) <= BROADCAST_HASHES
    rows = base.join(F.broadcast(hits) if few else hits, ["text_hash"], "left").select("doc_id", "source", F.split("text", "\n").alias("lines"), line_hashes(F.col("text")).alias("hashes"), bad.alias("bad"))
    kept = F.filter("lines", lambda x, i: ~F.coalesce(F.array_contains("bad", F.get("hashes", i)), F.lit(False)))
    rows = rows.select("doc_id", "source", "lines", kept.alias("kept"), F.size(F.filter("hashes", lambda h: h.isNotNull())).alias("n_lines"))
    return rows.select("doc_id", "source", F.array_join("kept", "\n").alias("text"), F.col("n_lines").cast("long"), (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"))

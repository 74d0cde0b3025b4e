"""Merkle dataset manifest: a tree of hashes for every source, and a tree over their roots.

Level by level, nodes are numbered, cut into runs by their number divided by the fanout, and each run's digests, in
order, are hashed into a parent. On the way down, a join of each level with its parents' proofs appends the siblings.
Every step is a DataFrame over all nodes of its level, and a level holds a fanout-th of the one below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import ascii_lower, join_small, materialize

FANOUT = 16
#: The columns that a leaf hashes, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The type of a proof: for each level from the leaf up, the digests left and right of the node, as one text each.
PROOF = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """'-' for null, else the UTF-8 byte count, ':' and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(docs: DataFrame, **changed: Column) -> Column:
    """The digest of a row of docs; changed columns are hashed instead of the row's own."""
    return F.sha2(F.concat(*[field(changed.get(c, docs[c])) for c in FIELDS]), 256)


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with their number from 0 in the order of keys, nulls first. Ranges of the keys are numbered by themselves, behind
    the counts of the ranges before them; fully equal keys share a range. Give a materialized frame: it is read twice."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k).asc_nulls_first() for k in keys]
    rows = materialize(rows.repartitionByRange(ranges, *by).withColumn("_range", F.spark_partition_id()), "merkle-ranges")
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ahead = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1
    return rows.withColumn(name, nth).join(F.broadcast(ahead), "_range").withColumn(name, F.col(name) + F.col("_ahead")).drop("_range", "_ahead")


def levels(nodes: DataFrame, payload: list[str], most: int, fanout: int) -> list[DataFrame]:
    """The runs of each level over nodes (tree, idx, n, digest, *payload): tree, idx and n of the parent, its children in order and
    its digest. n counts the nodes of the tree at that level, at most `most`; a tree ends where it has one."""
    found = []
    while most > 1:
        runs = nodes.where("n > 1").groupBy("tree", F.floor(F.col("idx") / fanout).alias("idx"))
        runs = runs.agg(F.ceil(F.first("n") / fanout).alias("n"), F.array_sort(F.collect_list(F.struct("idx", "digest", *payload))).alias("children"))
        digest = F.sha2(F.array_join(F.transform("children", lambda c: c["digest"]), ""), 256)
        found.append(materialize(runs.withColumn("digest", digest), f"merkle-level-{len(found)}"))
        nodes, payload, most = found[-1], [], -(-most // fanout)
    return found


def tree_roots(nodes: DataFrame, above: list[DataFrame]) -> DataFrame:
    """tree, digest of the one node in which each tree ends."""
    ends = [level.where("n = 1").select("tree", "digest") for level in (nodes, *above)]
    out = ends[0]
    for end in ends[1:]:
        out = out.unionByName(end)
    return out


def descend(runs: DataFrame, proofs: DataFrame, kept: list[str], payload: list[str]) -> DataFrame:
    """The children of runs, each with its siblings before the proof of its parent; proofs: tree, idx, proof, *kept."""
    met = runs.select("tree", "idx", "children").join(proofs, ["tree", "idx"])
    met = met.withColumn("digests", F.transform("children", lambda c: c["digest"]))
    met = met.select("tree", "proof", *kept, "digests", F.posexplode("children").alias("at", "child"))
    left = F.array_join(F.slice("digests", F.lit(1), F.col("at")), "")
    right = F.array_join(F.slice("digests", F.col("at") + 2, F.size("digests")), "")
    proof = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("proof"))
    return met.select("tree", "child.idx", proof.alias("proof"), *kept, *[f"child.{c}" for c in payload])


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """The proof of every row of docs: doc_id, leaf, subroot, root, proof, and tampered_leaf for the rows with a tampered text.

    A leaf hashes doc_id, source, lang, n_chars and text. The leaves of a source ascend by doc_id, then by digest, a null doc_id
    first; the subroots ascend by source, bytewise, null first. A lone leaf is its source's subroot, and a lone source's
    subroot the root: their proofs are shorter or empty. tampered is a text for the rows whose leaf shall be made a second
    time, null for others. Rows that repeat whole are leaves of their own. Null, empty and very long texts are hashed as they are, an
    empty table gives no rows, and other columns are not read.
    """
    docs = docs.select(*FIELDS, (F.lit(None).cast("string") if tampered is None else tampered).alias("_tampered"))
    changed = F.when(F.col("_tampered").isNotNull(), leaf_digest(docs, text=F.col("_tampered")))
    rows = materialize(docs.select("doc_id", "source", leaf_digest(docs).alias("digest"), changed.alias("tampered_leaf")), "merkle-leaves")
    ordered = materialize(numbered(rows, ["source", "doc_id", "digest"], "nth"), "merkle-ordered")
    sources = materialize(ordered.groupBy("source").agg(F.min("nth").alias("first"), F.count("*").alias("n")), "merkle-sources")
    sources = materialize(numbered(sources, ["source"], "tree"), "merkle-trees")
    most, n_sources = sources.agg(F.max("n"), F.count("*")).first()
    # The leaves of each source, and the runs above them.
    same = F.col("o.source").eqNullSafe(F.col("s.source"))
    leaves = join_small(ordered.alias("o"), sources.alias("s"), same).select("tree", (F.col("nth") - F.col("first")).alias("idx"), "n", "digest", "doc_id", "tampered_leaf")
    payload = ["doc_id", "digest", "tampered_leaf"]
    runs = levels(leaves, ["doc_id", "tampered_leaf"], most or 0, fanout)
    subroots = materialize(tree_roots(leaves, runs), "merkle-subroots")
    # The tree over the subroots.
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_sources).cast("long").alias("n"), "digest")
    upper = levels(tops, [], n_sources, fanout)
    root = tree_roots(tops, upper).select("tree", F.lit(0).cast("long").alias("idx"), F.array().cast(PROOF).alias("proof"), F.col("digest").alias("root"))
    proofs = root
    for level in reversed(upper):
        proofs = descend(level, proofs, ["root"], [])
    # Down through each source's own levels; a tree joins at the level where it ended.
    proofs = proofs.select(F.col("idx").alias("tree"), "proof", "root").join(subroots.withColumnRenamed("digest", "subroot"), "tree")
    proofs = materialize(proofs, "merkle-subroot-proofs")
    ended = lambda level: join_small(level.where("n = 1").select("tree", "idx"), proofs, ["tree"])
    below = None
    for i, level in reversed(list(enumerate(runs))):
        here = ended(level) if below is None else below.unionByName(ended(level))
        below = descend(level, here, ["subroot", "root"], payload if i == 0 else [])
    alone = join_small(leaves.where("n = 1").drop("n"), proofs, ["tree"])
    whole = alone if below is None else alone.unionByName(below)
    return whole.select("doc_id", F.col("digest").alias("leaf"), "tampered_leaf", "subroot", "root", "proof")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold_case(docs: DataFrame, every: int = 5) -> Column:
    """The lower-cased text of the rows whose doc_id's CRC-32 `every` divides; a null doc_id or text is left alone."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, ascii_lower(docs["text"]))


def verify(proved: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, of the rows of manifest()."""
    folded = fold(F.coalesce("tampered_leaf", "leaf"), F.col("proof"))
    out = proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

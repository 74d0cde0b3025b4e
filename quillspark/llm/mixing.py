"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / weight, u a hash of its id. A source takes whole epochs of all its documents first;
what is left of its target goes to the documents with the smallest keys, as far as the prefix sum of their sizes reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import join_small, materialize, n_words, running, uniform

#: Fixed values of the query: weights of the sources in order, repeating, and the most epochs of a source.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Weights in the sampling by labelled quality; 1 without a label.
QUALITY_WEIGHTS = {0: 0.5, 1: 2.0}
#: Slices of a source by key; only the slice in which the budget ends is sorted.
SLICES = 1 << 16
SEED = 11


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> + target. Sources by code point, null last, take the weights in turn. The total of all
    sizes is shared by weight; a target stops at max_epochs times its source's size and the excess is shared again, which
    ends at min(cap, level * weight) for one common level. Sources may be as many as hosts: both orders run in parts."""
    sizes = running(materialize(sizes, "mix-sources"), [F.col("source").isNull(), F.col("source")], "nth", {})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).drop("nth").withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    ranked = materialize(ranked, "mix-ratios")
    total = ranked.agg(F.sum("source_size").alias("all_sizes"), F.sum("weight").alias("all_weights"))
    order = [F.col("ratio"), F.col("source").isNull(), F.col("source")]
    ranked = running(ranked, order, "nth", {"caps": "cap", "weights": "weight"}).join(F.broadcast(total))  # one row
    ranked = materialize(ranked.withColumn("level", (F.col("all_sizes") - F.col("caps")) / (F.col("all_weights") - F.col("weights"))), "mix-levels")
    #: The first source whose cap is above the level that it and all later ones would share sets the level.
    level = ranked.where(F.col("level") <= F.col("ratio")).agg(F.min(F.struct("nth", "level"))["level"].alias("common"))
    ranked = ranked.join(F.broadcast(level))  # one row
    target = F.when(F.col("ratio") <= F.coalesce("common", F.lit(float("inf"))), F.col("cap")).otherwise(F.col("common") * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight of the labelled documents: by the best of a document's labels; null labels count as none."""
    best = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    weight = F.lit(1.0)
    for quality, w in QUALITY_WEIGHTS.items():
        weight = F.when(F.col("quality") == quality, w).otherwise(weight)
    return best.select("doc_id", weight.alias("weight"))


def sampling_key(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    return -F.log(uniform(doc_id, seed)) / weight


def mix(docs: DataFrame, labels: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """How often the mix takes each row of docs.

    Returns doc_id, text_hash, source, size, source_size, target, times, taken. size counts the text's words; null and
    empty texts have 0 and their taken is 0 however often they are taken. Null sources are one source, the last. A
    null doc_id is a key like any other; very long texts count whole. Rows with equal keys follow by doc_id, size and text hash; fully repeated rows
    are interchangeable. The document in which the budget ends is taken if that brings the source nearer to its target.
    An empty table gives no rows. Other columns are not read.
    """
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", n_words(F.col("text")).alias("size"))
    base = base.join(quality_weights(labels), "doc_id", "left").withColumn("key", sampling_key(F.col("doc_id"), F.coalesce("weight", F.lit(1.0)), seed))
    base = base.withColumn("slice", F.floor((1 - F.exp(-F.col("key"))) * SLICES).cast("int")).drop("weight")
    base = materialize(base, "mix-base")
    slices = materialize(base.groupBy("source", "slice").agg(F.sum("size").alias("size")), "mix-slices")
    targets = source_targets(slices.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # The slice in which a source's budget ends, and what the slices before it hold.
    ended = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = targets.alias("t")
    last = slices.withColumn("before", ended).alias("s").join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).where(F.col("s.before") <= F.col("t.rest"))
    last = last.groupBy("t.source", "t.source_size", "t.target", "t.epochs", "t.rest").agg(F.max(F.struct("s.slice", "s.before")).alias("end"))
    last = materialize(last.select("source", "source_size", "target", "epochs", "rest", F.col("end.slice").alias("end_slice"), F.col("end.before").alias("end_before")), "mix-ends")
    b, e = base.alias("b"), last.alias("e")
    rows = join_small(b, e, F.col("b.source").eqNullSafe(F.col("e.source"))).select("b.*", *[f"e.{c}" for c in last.columns if c != "source"])
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.where(F.col("slice") == F.col("end_slice")).withColumn("before", F.col("end_before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    inside = inside.withColumn("more", (2 * F.col("before") + F.col("size") <= 2 * F.col("rest")).cast("int")).drop("before")
    outside = rows.where(F.col("slice") != F.col("end_slice")).withColumn("more", (F.col("slice") < F.col("end_slice")).cast("int"))
    # At its limit a source has no rest; rows of size 0 would still fit in.
    times = F.least(F.col("epochs") + F.col("more"), F.lit(max_epochs))
    return outside.unionByName(inside).select("doc_id", "text_hash", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def repeat_rows(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of docs, with all their columns, each as often as mix() takes it. Rows equal in doc_id, text and source
    share what the mix takes of them as evenly as can be. Other columns may have any name."""
    taken = mix(docs.select("doc_id", "text", "source"), labels, **parameters)
    keys = taken.groupBy("doc_id", "text_hash", "source").agg(F.sum("times").alias("times"), F.count("*").alias("rows")).alias("k")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("key_text")).alias("d")
    same = (F.col("d.key_text") == F.col("k.text_hash")) & F.col("d.row.doc_id").eqNullSafe(F.col("k.doc_id")) & F.col("d.row.source").eqNullSafe(F.col("k.source"))
    met = join_small(rows, materialize(keys.select("doc_id", "text_hash", "source", "times", "rows").where("times > 0"), "mix-times").alias("k"), same)
    met = met.select("row", "key_text", "k.times", "k.rows")
    alone = met.where("rows = 1").select("row", "times")
    shared = met.where("rows > 1").withColumn("nth", F.row_number().over(Window.partitionBy("key_text", "row.doc_id", "row.source").orderBy("key_text")))
    shared = shared.select("row", (F.floor(F.col("times") / F.col("rows")) + (F.col("nth") <= F.col("times") % F.col("rows")).cast("long")).alias("times"))
    copies = F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))
    return alone.unionByName(shared).select("row", copies.alias("copy")).select("row.*")

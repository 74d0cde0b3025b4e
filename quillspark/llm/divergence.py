"""Source divergence audit: how the words of each source of a language differ from the other sources and the language.

Plain relational: the terms between regex matches are exploded and counted by group, the groups are crossed with the kept vocabulary so that
absent terms count zero, a self-join on language and term compares the sources, and windows rank the sums. Proportions
are integers, so all sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import ascii_lower, join_small, materialize

#: Fixed value: a term is a run of characters other than these, so of ASCII letters and of any characters beyond ASCII.
BETWEEN_TERMS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: A language keeps the terms of so many of its documents.
MIN_DOCS = 10
#: Proportions are counted in such parts, each count raised by ALPHA.
PARTS = 1_000_000_000
ALPHA = 2
#: The terms that a group reports.
TOP_TERMS = 10


def term_counts(rows: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold the term), from lang, source, text without nulls. Each text
    gives all its terms, and each distinct one once more; both are summed before they are shuffled."""
    found = rows.select("lang", "source", F.array_remove(F.split(ascii_lower(F.col("text")), BETWEEN_TERMS), "").alias("terms"))
    kinds = F.array(F.struct(F.lit(0).alias("distinct"), F.col("terms")), F.struct(F.lit(1).alias("distinct"), F.array_distinct("terms").alias("terms")))
    found = found.select("lang", "source", F.explode(kinds).alias("k")).select("lang", "source", "k.distinct", F.explode("k.terms").alias("term"))
    return found.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("distinct")).alias("n"), F.sum("distinct").alias("docs"))


def proportion(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(PARTS * (count + ALPHA) / (total + ALPHA * terms)), in decimals: the product may exceed a long."""
    part = (F.lit(PARTS).cast("decimal(10,0)") * (count + ALPHA).cast("decimal(20,0)")).cast("decimal(38,0)")
    return (F.call_function("div", part, (total + ALPHA * terms).cast("decimal(20,0)")) + 1).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); the square of PARTS fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def proportions(rows: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source), and their dense proportions: lang, source, term, n, p, q, with q the language's proportion."""
    counts = materialize(term_counts(rows), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    kept = materialize(kept, "divergence-kept")
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
    totals = counts.join(kept, ["lang", "term"], "left_semi").groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = materialize(rows.select("lang", "source").distinct(), "divergence-groups")
    sized = groups.join(totals, ["lang", "source"], "left").join(langs, "lang")  # a language without kept terms has no cells
    sized = materialize(sized.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "lang_total", "terms"), "divergence-sizes")
    cells = join_small(kept, sized, ["lang"]).join(counts.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left")
    n = F.coalesce("n", F.lit(0))
    p, q = proportion(n, F.col("total"), F.col("terms")), proportion(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    return groups, materialize(cells.select("lang", "source", "term", n.alias("n"), p.alias("p"), q.alias("q")), "divergence-cells")


def ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    """rows with rank by value, then item; all ranks, or the first."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows if top is None else rows.where(F.col("rank") <= top)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) group of docs.

    Part `pair` has each other source of the language with the divergence summed over all kept terms, part `term` the terms that
    the group has more often than its language, the first top_terms. Null lang, source and text are empty ones. Groups without
    a term are compared like others; in a language that keeps no term all pairs have 0. Each row counts as a document, also
    repeated ones. Equal values rank by item, bytewise. Long texts count whole, an empty table gives no rows, and other columns
    are not read. The report itself holds all ordered pairs of a language's sources; the join makes each pair once a term.
    """
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups, cells = proportions(rows, min_docs)
    one, two = cells.alias("one"), cells.alias("two")
    met = one.join(two, (F.col("one.lang") == F.col("two.lang")) & (F.col("one.term") == F.col("two.term")) & (F.col("one.source") < F.col("two.source")))
    sums = met.groupBy(F.col("one.lang").alias("lang"), F.col("one.source").alias("a"), F.col("two.source").alias("b")).agg(F.sum(divergence(F.col("one.p"), F.col("two.p"))).alias("value"))
    pairs = groups.select("lang", F.col("source").alias("a")).join(groups.select("lang", F.col("source").alias("b")), "lang").where("a < b")
    pairs = materialize(pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "a", "b", F.coalesce("value", F.lit(0).cast("long")).alias("value")), "divergence-pairs")
    pairs = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    terms = cells.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    parts = ranked(pairs).withColumn("part", F.lit("pair")).unionByName(ranked(terms, top_terms).withColumn("part", F.lit("term")))
    return parts.select("lang", "source", "part", "item", "value", "rank")

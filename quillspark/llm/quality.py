"""Quality rules: fixed rules first, then robust multivariate outliers.

For each language and source the minimum-covariance-determinant estimate of location and scatter is found by C-steps: the
three quarters of the rows with the smallest Mahalanobis distances give the next mean and covariance. Several starts are
iterated side by side until no determinant falls any more, and the one of the least determinant is kept. After a reweighting
step, documents beyond a chi-squared quantile are rejected. All steps are aggregations over a narrow table of distinct
vectors of fixed-point statistics with their numbers, summed exactly, so copies cost nothing and the verdict does not depend
on partitioning or order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import BROADCAST_ROWS, SPACES, chi2_cdf, chi2_quantile, join_small, materialize, utf8, words

#: Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Statistics of the vector and the least standard deviation that each is given: the log of the mean word length, of the
#: symbols in 1000 word characters, of the repeated lines, the logit of the repeated words, the log of the words.
DIMENSIONS = (("log_word_length", 0.1), ("log_symbols", 0.5), ("log_dup_lines", 1.0), ("logit_repeats", 1.0), ("log_words", 1.5))
#: Share of the rows that a C-step keeps, and their number.
COVERAGE_4 = 3  # quarters
#: C-steps end when no determinant falls by more than this share; each lowers it, so this many steps mean a fault.
SETTLED, MOST_STEPS = 1e-4, 100
#: Steps after which only the start of the least determinant goes on.
TRIED = 2
#: Starts: medians with deviations, and the halves of the rows with the smaller and larger values of these statistics.
HALVES = ((0, False), (0, True), (4, False), (4, True))
REWEIGHT = 0.975
#: Share of regular rows, were they normal, that a cell may lose.
TAIL = 1e-6
#: A language and source with fewer rows has too few for a covariance of five statistics: it joins the rest of its language;
#: too small a rest joins all others. Fewer rows than LEAST_CELL in all have no estimate.
MIN_CELL, LEAST_CELL = 50, 7
SCALE = 4096
BINS = 64


def text_counts(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of column text. Write the result
    out before filtering by a count: Spark would push the filter down with a copy of the whole expression."""
    visible = F.filter(F.split(utf8(F.col("text")), "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    out = docs.select(
        *carry,
        words(F.col("text")).alias("words"),
        visible.alias("lines"),
        F.length(F.translate(utf8(F.col("text")), SPACES, "")).cast("long").alias("word_chars"),
        (F.length(utf8(F.col("text"))) - F.length(F.translate(utf8(F.col("text")), SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    w, n = F.col("words"), F.size("words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
    out = out.select(*carry, "word_chars", "n_symbols", n.cast("long").alias("n_words"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.sort_array(windows).alias("windows"))
    # Windows that an equal one stands next to in hash order, back in text order.
    s = F.col("windows")
    twice = F.filter(s, lambda x, k: F.coalesce((F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)), F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    out = out.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("windows")
    p = F.col("at")
    reach = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    return out.withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics in fixed point."""
    share = (F.col("n_repeat_words") + 1) / (F.col("n_words") + 2)
    chars, n = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    values = [F.log(chars / n), F.log1p(1000 * F.col("n_symbols") / chars), F.log1p(F.col("n_dup_lines")), F.log(share / (1 - share)), F.log(n)]
    return [F.round(v * SCALE).cast("long").alias(f"q{i}") for i, v in enumerate(values)]


def cells(rows: DataFrame, min_cell: int) -> DataFrame:
    """rows with the cell each is judged in; null where even all rows together are too few."""
    counts = materialize(rows.groupBy("lang", "source").agg(F.count("*").alias("n")), "quality-sizes")
    rests = counts.where(F.col("n") < min_cell).groupBy("lang").agg(F.sum("n").alias("rest"))
    c, r = counts.alias("c"), rests.alias("r")
    counts = materialize(c.join(r, F.col("c.lang").eqNullSafe(F.col("r.lang")), "left").select("c.*", "r.rest"), "quality-rests")
    left = counts.where((F.col("n") < min_cell) & (F.col("rest") < min_cell)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own, rest = F.concat(F.lit("own "), F.to_json(F.struct("lang", "source"))), F.concat(F.lit("rest "), F.to_json(F.struct("lang")))
    cell = F.when(F.col("n") >= min_cell, own).when(F.col("rest") >= min_cell, rest)
    named = materialize(counts.select("lang", "source", cell.otherwise("all" if left >= LEAST_CELL else F.lit(None)).alias("cell")), "quality-cells").alias("c")
    r = rows.alias("r")
    return join_small(r, named, F.col("r.lang").eqNullSafe(F.col("c.lang")) & F.col("r.source").eqNullSafe(F.col("c.source")), "left").select("r.*", "c.cell")


def medians(rows: DataFrame, values: list[Column], names: list[str]) -> DataFrame:
    """Lower medians of the values by cell, from counts of equal values; rows count n times. A cell and statistic has as
    many values as its fixed-point range, whatever the number of its rows."""
    flat = rows.select("cell", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("d"), v.alias("v")) for i, v in enumerate(values)])).alias("x")).groupBy("cell", "x.d", "x.v").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("cell", "d")
    flat = flat.withColumn("upto", F.sum("n").over(by.orderBy("v"))).withColumn("all", F.sum("n").over(by))
    return flat.where(2 * F.col("upto") >= F.col("all")).groupBy("cell").agg(*[F.min(F.when(F.col("d") == i, F.col("v"))).alias(name) for i, name in enumerate(names)])


def scatter(rows: DataFrame, factor: float, keys: list[str], carry: dict[str, Column] = {}) -> DataFrame:
    """Mean, lower Cholesky factor of factor * covariance + floors, and its log determinant, from exact sums of rows (q0..,
    n: how often each counts). carry: other aggregates by name."""
    d = len(DIMENSIONS)
    q = [F.col(f"q{i}").cast("decimal(14,0)") for i in range(d)]
    exact = lambda c: F.sum((c * F.col("n").cast("decimal(12,0)")).cast("decimal(38,0)")).cast("double")
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = rows.groupBy(*keys).agg(*[c.alias(name) for name, c in carry.items()], F.sum("n").cast("double").alias("n"), *[exact(q[i]).alias(f"s{i}") for i in range(d)], *[exact(q[i] * q[j]).alias(f"s{i}_{j}") for i, j in pairs])
    sums = sums.select(*keys, *carry, "n", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(d)], *[(F.col(f"s{i}_{j}") / F.col("n")).alias(f"s{i}_{j}") for i, j in pairs])
    for i, j in pairs:
        floor = (DIMENSIONS[i][1] * SCALE) ** 2 if i == j else 0.0
        c = F.lit(factor) * (F.col(f"s{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}")) + floor
        for k in range(j):
            c = c - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        sums = sums.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(c, F.lit(1.0))) if i == j else c / F.col(f"l{j}_{j}"))
    return sums.select(*keys, *carry, *[f"m{i}" for i in range(d)], *[f"l{i}_{j}" for i, j in pairs], (2 * sum((F.log(f"l{i}_{i}") for i in range(1, d)), F.log("l0_0"))).alias("logdet"))


def distances(rows: DataFrame, estimates: DataFrame, few: bool, how: str = "inner", keep: tuple[str, ...] = ()) -> DataFrame:
    """rows, once for each estimate of their cell, with the squared Mahalanobis distance d2 and the columns keep. few: there
    are at most BROADCAST_ROWS estimates."""
    d = len(DIMENSIONS)
    out = rows.join(F.broadcast(estimates) if few else estimates, "cell", how)  # counted by the caller
    for i in range(d):
        y = F.col(f"q{i}") - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}_{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", y / F.col(f"l{i}_{i}"))
    out = out.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, d)), F.col("y0") * F.col("y0")))
    return out.select(*rows.columns, *keep, "d2")


def nearest(rows: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """cell, start, was, q0.., n of the COVERAGE_4 quarters of each cell's rows with the smallest distances by each estimate
    of the cell, ties by the statistics; was is the estimate's log determinant. Counts by fine logarithmic bins find the bin
    in which the limit falls; only the vectors of that bin are sorted, and the last one counts in part."""
    q = [f"q{i}" for i in range(len(DIMENSIONS))]
    far = distances(rows, estimates, few, keep=("start", "logdet")).withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * BINS).cast("int"))
    by = Window.partitionBy("cell", "start")
    bins = far.groupBy("cell", "start", "bin").agg(F.sum("n").alias("n"))
    bins = bins.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    need = F.ceil(F.col("all") * COVERAGE_4 / 4)
    limits = bins.where(F.col("upto") >= need).groupBy("cell", "start").agg(F.min(F.struct("bin", (need - F.col("upto") + F.col("n")).alias("rest"))).alias("limit"))
    limits = limits.select("cell", "start", F.col("limit.bin").alias("limit"), F.col("limit.rest").alias("rest"))
    far = far.join(F.broadcast(limits) if few else limits, ["cell", "start"])  # as many as estimates
    inside = far.where("bin < limit").select("cell", "start", "logdet", *q, "n")
    before = F.coalesce(F.sum("n").over(by.orderBy("d2", *q).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = far.where("bin = limit").withColumn("n", F.least(F.col("n"), F.col("rest") - before)).where("n > 0").select("cell", "start", "logdet", *q, "n")
    return inside.unionByName(edge).withColumnRenamed("logdet", "was")


def starts(rows: DataFrame) -> DataFrame:
    """Estimates by cell and start: medians with deviations, and mean and covariance of halves of the cell's rows."""
    d = len(DIMENSIONS)
    q = [F.col(f"q{i}") for i in range(d)]
    middle = materialize(medians(rows, q, [f"m{i}" for i in range(d)]), "quality-medians")
    placed = join_small(rows, middle, ["cell"])
    spread = medians(placed, [F.abs(q[i] - F.col(f"m{i}")) for i in range(d)], [f"a{i}" for i in range(d)])
    first = join_small(spread, middle, ["cell"])
    diagonal = [F.greatest(1.4826 * F.col(f"a{i}"), F.lit(DIMENSIONS[i][1] * SCALE)) for i in range(d)]
    first = first.select("cell", F.lit(0).alias("start"), *[F.col(f"m{i}").cast("double").alias(f"m{i}") for i in range(d)], *[(diagonal[i] if i == j else F.lit(0.0)).alias(f"l{i}_{j}") for i in range(d) for j in range(i + 1)], F.lit(float("inf")).alias("logdet"))
    which = F.array_compact(F.array(*[F.when((F.col(f"q{i}") >= F.col(f"m{i}")) if upper else (F.col(f"q{i}") <= F.col(f"m{i}")), k + 1) for k, (i, upper) in enumerate(HALVES)]))
    halves = placed.select("cell", *[f"q{i}" for i in range(d)], "n", F.explode(which).alias("start"))
    halves = scatter(halves, 1.0, ["cell", "start"]).withColumn("logdet", F.lit(float("inf")))
    return materialize(first.unionByName(halves), "quality-starts")


def estimates(rows: DataFrame) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimates by cell. rows: cell, q0..."""
    d = len(DIMENSIONS)
    q = [f"q{i}" for i in range(d)]
    rows = materialize(rows.groupBy("cell", *q).agg(F.count("*").alias("n")), "quality-vectors")
    factor = lambda share: share / chi2_cdf(chi2_quantile(share, d), d + 2)
    found = starts(rows)
    few = found.count() <= BROADCAST_ROWS
    for step in range(MOST_STEPS):
        kept = nearest(rows, found, few)
        new = scatter(kept, factor(COVERAGE_4 / 4), ["cell", "start"], carry={"was": F.first("was")})
        if step == TRIED - 1:
            new = new.groupBy("cell").agg(F.min_by(F.struct(*[c for c in new.columns if c != "cell"]), F.struct("logdet", "start")).alias("e")).select("cell", "e.*")
        found = materialize(new.withColumn("falls", F.col("logdet") < F.col("was") - SETTLED), "quality-step")
        if step >= TRIED and found.where("falls").isEmpty():
            break
    else:
        raise RuntimeError("the C-steps do not settle")
    inside = distances(rows, found, few).where(F.col("d2") <= chi2_quantile(REWEIGHT, d))
    return materialize(scatter(inside, factor(REWEIGHT), ["cell"]), "quality-estimates")


def judge(docs: DataFrame, min_cell: int = MIN_CELL, tail: float = TAIL) -> DataFrame:
    """doc_id, text_hash, the counts, base_failed, d2 and kept for every row of docs.

    Null texts count as empty: no words, so base_failed. Null languages and sources are values of their own. Cells with
    fewer than min_cell rows that pass the fixed rules are pooled by language, then altogether; under LEAST_CELL rows in all,
    d2 is null and the fixed rules decide alone. Rows of equal text, language and source share their verdict; very long
    texts are read whole. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select("doc_id", "text", "lang", "source")
    counts = text_counts(rows.withColumn("text_hash", F.xxhash64("text")), ["doc_id", "text_hash", "lang", "source"])
    counts = counts.withColumn("base_failed", base_failed()).select("*", *vector())
    counts = materialize(counts, "quality-counts")
    sound = materialize(cells(counts.where(~F.col("base_failed")), min_cell), "quality-rows")
    fit = estimates(sound.where(F.col("cell").isNotNull()).select("cell", *[f"q{i}" for i in range(len(DIMENSIONS))]))
    verdict = distances(sound, fit, fit.count() <= BROADCAST_ROWS, "left").withColumn("kept", F.coalesce(F.col("d2") <= chi2_quantile(1 - tail, len(DIMENSIONS)), F.lit(True)))
    columns = ["doc_id", "text_hash", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "kept"]
    failed = counts.where("base_failed").select("*", F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"))
    return failed.select(columns).unionByName(verdict.select(columns))


def keep_sound(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns. Rejected rows are found again by id, text hash,
    language and source, null-safe, so other columns may have any name."""
    verdict = judge(docs.select("doc_id", "text", "lang", "source"), **parameters)
    bad = materialize(verdict.where(~F.col("kept")).select("doc_id", "text_hash", "lang", "source").distinct(), "quality-rejected").alias("b")
    rows = docs.select(F.struct("*").alias("row")).alias("d")
    same = F.col("d.row.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64(F.col("d.row.text")) == F.col("b.text_hash"))
    for c in ("lang", "source"):
        same = same & F.col(f"d.row.{c}").eqNullSafe(F.col(f"b.{c}"))
    return join_small(rows, bad, same, "left_anti").select("row.*")

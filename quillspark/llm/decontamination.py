"""Benchmark decontamination by template canonicalisation.

Numbers, units behind numbers and names become typed placeholders; what is left is lower-cased and loses its ASCII
punctuation. A text has two templates: in one all capitalised words are names, also those that open a sentence; in the other
none are, so it also meets texts in capitals, title case or small letters. Windows of each template are hashed and joined
with those of the benchmark. A number with its unit and a run of names are one token, and English number words are numbers.
Where enough windows of an item lie at one shift, or at neighbouring ones as where a word was put in, the values in the
slots decide, both ways: each value of the item must stand for one value of the document throughout, and no two names of the
item for one name, as in a question whose numbers and names were exchanged. Of the numbers, two may meet in one by chance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import BROADCAST_ROWS, WORD, join_small, materialize, utf8

#: Tokens of a window, and how many of them must be no slots.
WINDOW, MIN_LITERALS = 8, 4
#: Tokens of a window of items with fewer than three windows' tokens.
SHORT = 5
#: Share of an item's windows that must match in one alignment.
MIN_SHARE = 0.5

#: A mark between words of one token and placeholders, which no text has, punctuation that templates lose, units.
JOIN, NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002", "\ue003"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "yd", "yards", "mi", "mile", "miles", "meter", "meters", "metre", "metres",
    "mg", "g", "kg", "t", "oz", "lb", "lbs", "gram", "grams", "pound", "pounds", "ton", "tons", "ml", "cl", "l", "liter", "liters", "litre", "litres",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "percent", "dollar", "dollars", "cent", "cents", "euro", "euros", "usd", "eur", "mph", "kmh", "hz", "khz", "mhz", "w", "kw", "v", "j", "kj", "kcal", "pa", "kpa",
)
#: English number words.
SMALL = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
NUMBER_WORDS = (
    *SMALL, "zero", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
    "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "half", "dozen",
)
#: Numbers of the item that may meet another one in the document.
MAX_MET = 1
_SPACE = r"[\x20\x09-\x0D]"
_EDGE = r"[\p{Punct}£€]*"
_UNIT = "(?:" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + ")"
_NUMBER = r"[0-9](?:[0-9.,:/\-]*[0-9])?"
_START, _END = rf"(?<!{WORD[:-1]}){_EDGE}", rf"(?!{WORD[:-1]})"
#: The edge behind a number stays, as it may end a sentence; templates lose it later. '80 km' is one token, as '80km' is.
NUMBER_TOKEN = rf"{_START}{_NUMBER}({_EDGE}){_END}"
MEASURE_TOKEN = rf"(?i){_START}{_NUMBER}{_EDGE}{_SPACE}?{_UNIT}({_EDGE}){_END}"
#: A number and the space before its unit, which becomes JOIN.
UNIT_SPACE = rf"(?i)({_START}{_NUMBER}{_EDGE}){_SPACE}(?={_UNIT}{_EDGE}{_END})"
_NAME = r"\p{Lu}[\p{L}'’\-]*"
#: By kind of template: runs of names, and the spaces inside them. 'Mary Ann' is one token, as 'Tom' is.
#: Java's loop over a group calls itself for each turn unless it is possessive; so each further name looks ahead to its end.
NAMES = (rf"{_START}{_NAME}(?:[\x20\x09]+{_NAME}+(?={_EDGE}{_END}))*+{_EDGE}{_END}", None)
NAME_SPACES = (rf"((?:{_START}|(?<=[\x20\x09{JOIN}])){_NAME})[\x20\x09]+(?={_NAME}{_EDGE}(?:{_END}|(?=[\x20\x09])))", None)


def join_names(text: Column, kind: int) -> Column:
    return text if NAMES[kind] is None else F.regexp_replace(text, NAME_SPACES[kind], "$1" + JOIN)


def join_units(text: Column) -> Column:
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, UNIT_SPACE, "$1" + JOIN)).otherwise(text)


def with_numbers(rows: DataFrame, text: str, into: str) -> DataFrame:
    """rows with column `into`: the text with its numbers in figures and their units as placeholders."""
    t = F.col(into)
    rows = rows.withColumn(into, utf8(F.col(text)))
    return rows.withColumn(into, F.when(t.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(t, MEASURE_TOKEN, NUMBER + UNIT + "$1"), NUMBER_TOKEN, NUMBER + "$1")).otherwise(t))


def with_template(rows: DataFrame, typed: str, into: str, kind: int, of: Callable[[Column], Column] = lambda w: w) -> DataFrame:
    """rows with array column `into`: the tokens of one kind of template, or what `of` makes of each, from what with_numbers() gives."""
    t = F.col(into)
    rows = rows.withColumn(into, F.col(typed) if NAMES[kind] is None else F.regexp_replace(F.col(typed), NAMES[kind], NAME))
    # PUNCTUATION by a pattern: translate() makes a string of each character.
    rows = rows.withColumn(into, F.regexp_extract_all(F.lower(F.regexp_replace(t, r"\p{Punct}+", "")), F.lit(WORD), F.lit(0)))
    return rows.withColumn(into, F.transform(t, lambda w: of(F.when(w.isin(*NUMBER_WORDS), F.lit(NUMBER)).otherwise(w))))


def raw_tokens(text: Column, kind: int) -> Column:
    """The words behind a template's tokens: those that hold more than punctuation. Joined words are one."""
    words = F.regexp_extract_all(join_names(join_units(utf8(text)), kind), F.lit(WORD), F.lit(0))
    return F.filter(words, lambda w: F.translate(w, PUNCTUATION, "") != "")


def is_slot(token: Column) -> Column:
    return token.startswith(NUMBER) | token.startswith(UNIT) | token.startswith(NAME)


def window_hash(hashes: Column, at: Column, kind: Column, length: int) -> Column:
    """The hash of the window of `length` tokens at a position, from the array of the tokens' hashes; null if it is not whole.
    Use it behind posexplode_outer(), in compiled code: functions of arrays run their lambdas uncompiled, token by token. For
    other generators Spark infers a filter that holds the whole expression of the array once more."""
    return F.when(at + length <= F.size(hashes), F.xxhash64(kind, F.lit(length), *[F.get(hashes, at + k) for k in range(length)]))


def window_length(tokens: Column, window: int) -> Column:
    """Tokens of an item's windows. A changed word in the middle of an item leaves half of its windows only where they are
    shorter than a third of it; so some items have windows of SHORT tokens, down to the least length that gives that."""
    short = tokens.between(3 * SHORT - 1, 3 * window - 2) & F.lit(SHORT < window)
    return F.when(short, F.lit(SHORT)).otherwise(F.least(tokens, F.lit(window)))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, min_literals: int = MIN_LITERALS) -> tuple[DataFrame, DataFrame, list[int]]:
    """(items, windows, lengths): item_key, item_id, kind, template, raw, length; item_key, kind, length, tokens, item_pos, head,
    hash, of; the windows' lengths, ascending. head is the hash of a window's first tokens, of the least length.
    An item with fewer tokens than window is one window of its own length; window_length() has the others. Windows with too few literals are left out."""
    typed = with_numbers(benchmark.select("item_id", F.xxhash64("text").alias("item_key"), "text").distinct(), "text", "typed")
    items = None
    for kind in range(len(NAMES)):
        mine = with_template(typed, "typed", "template", kind).select("item_id", "item_key", F.lit(kind).alias("kind"), "template", raw_tokens(F.col("text"), kind).alias("raw"))
        items = mine if items is None else items.unionByName(mine)
    items = items.where(F.size("template") > 0).withColumn("length", window_length(F.size("template"), window))
    items = materialize(items, "bench-items")
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # window values at most
    windows = None
    for length in lengths:
        mine = items.where(F.col("length") == length).select("item_key", "kind", "length", "template", F.transform("template", lambda w: F.xxhash64(w)).alias("hashes")).distinct()
        mine = mine.select("item_key", "kind", "length", "template", "hashes", F.posexplode_outer("hashes").alias("item_pos", "token"))
        for column, n in (("head", lengths[0]), ("hash", length)):
            mine = mine.withColumn(column, window_hash(F.col("hashes"), F.col("item_pos"), F.col("kind"), n))
        literals = F.size(F.filter(F.slice("template", F.col("item_pos") + 1, length), lambda w: ~is_slot(w)))
        mine = mine.where(F.col("hash").isNotNull() & (literals >= min(min_literals, (length + 1) // 2))).select("item_key", "kind", "length", F.size("template").alias("tokens"), "item_pos", "head", "hash")
        mine = mine.withColumn("of", F.count("*").over(Window.partitionBy("item_key", "kind")))
        windows = mine if windows is None else windows.unionByName(mine)
    if windows is None:
        zero = F.lit(0).cast("long")
        windows = items.select("item_key", "kind", "length", F.lit(0).alias("tokens"), F.lit(0).alias("item_pos"), zero.alias("head"), zero.alias("hash"), zero.alias("of"))
    return items, materialize(windows, "bench-windows"), lengths


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_literals: int = MIN_LITERALS, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, text_hash, item_id, matched, of, slots, changed: one row for each document and item it leaks.

    matched of the item's windows lie in one alignment with the document, the shifts next to it included, by the kind of template that matches best; slots
    of the item's tokens there are placeholders and changed of them stand for another value. Null and empty texts and items
    leak nothing. Repeated rows, and rows of equal doc_id and text, give one row an item; a null doc_id is kept. Equal items
    each are reported, ties included; very long texts are read whole. Items without a window of enough literals can't be
    found. An empty table gives no rows; other columns are not read.
    """
    items, windows, lengths = benchmark_windows(benchmark, window, min_literals)
    if not lengths:
        nothing = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), *[F.lit(0).cast("long").alias(c) for c in ("matched", "of", "slots", "changed")])
        return items.join(nothing, F.lit(False)).select("doc_id", "text_hash", "item_id", "matched", "of", "slots", "changed")
    rows = with_numbers(docs.select(F.xxhash64("text").alias("text_hash"), "text"), "text", "typed").drop("text")
    for kind in range(len(NAMES)):
        rows = with_template(rows, "typed", f"hashes_{kind}", kind, F.xxhash64)
    rows = rows.select("text_hash", F.posexplode_outer(F.array(*[f"hashes_{kind}" for kind in range(len(NAMES))])).alias("kind", "hashes"))
    rows = rows.select("text_hash", "kind", "hashes", F.posexplode_outer("hashes").alias("doc_pos", "token"))
    at = lambda n: window_hash(F.col("hashes"), F.col("doc_pos"), F.col("kind"), n)
    # Few positions have the first tokens of a window; only there the hashes of all lengths are made. Too many heads to broadcast
    # are left out: rows still hold their arrays, which no shuffle should carry.
    heads = windows.select("head").distinct()
    if heads.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = rows.withColumn("head", at(lengths[0])).join(F.broadcast(heads), "head", "left_semi")
    rows = rows.select("text_hash", "doc_pos", F.explode_outer(F.array(*[at(n) for n in lengths])).alias("hash")).where(F.col("hash").isNotNull())
    key = ["text_hash", "item_key", "kind", "length", "of", "tokens"]
    hits = join_small(rows, windows, ["hash"]).select(*key, "item_pos", (F.col("doc_pos") - F.col("item_pos")).alias("shift"))
    # Copies of a text match the same windows; distinct positions count once.
    aligned = hits.groupBy(*key, "shift").agg(F.collect_set("item_pos").alias("positions"))
    aligned = materialize(aligned.withColumn("size", F.size("positions")), "bench-shifts")
    alone = aligned.withColumn("hits", F.transform("positions", lambda p: F.struct(p.alias("i"), (p + F.col("shift")).alias("d")))).select(*key, "hits")
    # Shifts no further apart than half an item are one alignment: what stands between them was put in or left out. Whole
    # copies of an item are further apart. A window that matches at several shifts counts once, at the one with most hits.
    by = Window.partitionBy("text_hash", "item_key", "kind").orderBy("shift")
    apart = F.coalesce(F.col("shift") - F.lag("shift").over(by) > F.greatest(F.lit(1), (F.col("tokens") / 2).cast("int")), F.lit(True))
    near = aligned.withColumn("new", apart.cast("int")).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    near = near.select(*key, "island", "size", "shift", F.explode("positions").alias("i")).groupBy(*key, "island", "i").agg(F.max(F.struct("size", "shift")).alias("at"))
    near = near.groupBy(*key, "island").agg(F.collect_list(F.struct("i", (F.col("i") + F.col("at.shift")).alias("d"))).alias("hits")).select(*key, "hits")
    aligned = alone.unionByName(near).where(F.size("hits") >= F.lit(min_share) * F.col("of"))
    aligned = materialize(aligned.withColumn("hits", F.array_sort("hits")).distinct(), "bench-aligned")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    by_kind = F.when(F.col("kind") == 0, raw_tokens(F.col("text"), 0)).otherwise(raw_tokens(F.col("text"), 1))
    met = join_small(texts, aligned, ["text_hash"]).withColumn("doc_raw", by_kind).drop("text")
    met = join_small(met, items.drop("length"), ["item_key", "kind"])
    # Only what the matched windows cover is held against the slots.
    covered = F.flatten(F.transform("hits", lambda h: F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda k: F.struct((h["i"] + k).alias("i"), (h["d"] + k).alias("d")))))
    met = met.withColumn("both", F.array_distinct(F.filter(covered, lambda x: is_slot(F.get("template", x["i"])))))
    plain = lambda w: F.lower(F.translate(w, PUNCTUATION, ""))
    pair = lambda x: F.struct(plain(F.get("raw", x["i"])).alias("a"), plain(F.get("doc_raw", x["d"])).alias("b"), F.get("template", x["i"]).startswith(NAME).alias("named"))
    met = met.withColumn("pairs", F.transform("both", pair)).withColumn("distinct", F.array_distinct("pairs"))
    values = lambda side, named: F.size(F.array_distinct(F.transform(F.filter("distinct", lambda x: x["named"] == named), lambda x: x[side])))
    functional = (F.size("distinct") == values("a", True) + values("a", False)) & (values("b", True) == values("a", True)) & (values("b", False) >= values("a", False) - MAX_MET)
    changed = F.size(F.filter("pairs", lambda x: x["a"] != x["b"]))
    met = met.where(functional).select("doc_id", "text_hash", "item_id", F.struct((F.size("hits") / F.col("of")).alias("share"), F.size("hits").cast("long").alias("matched"), (-changed).alias("kept"), F.size("pairs").alias("slots"), "of").alias("best"))
    best = met.groupBy("doc_id", "text_hash", "item_id").agg(F.max("best").alias("best"))
    return best.select("doc_id", "text_hash", "item_id", "best.matched", "best.of", F.col("best.slots").cast("long").alias("slots"), (-F.col("best.kept")).cast("long").alias("changed"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of docs, with all their columns, whose text leaks no item. Null and empty texts stay; repeated rows share
    their fate; other columns may have any name."""
    bad = find_leaks(docs.select("doc_id", "text"), benchmark, **parameters).select("text_hash").distinct()
    bad = materialize(bad, "bench-leaks")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("text_hash"))
    return join_small(rows, bad, ["text_hash"], "left_anti").select("row.*")

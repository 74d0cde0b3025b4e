"""URL filters: listed rules first, then association rules mined from labelled URLs.

FP-growth runs over the tokens of the blocked labelled URLs. Each frequent set of tokens is counted among all labelled
URLs; sets that pass support and confidence become rules. Confidence is asked as lift over the share of blocked URLs, so
it means the same at every base rate. A rule is filed under its rarest item, so a URL meets only rules it shares that with.

Tokens that the same labelled URLs hold are one item: sets that differ in them have the same counts, so mining them apart
would only multiply the sets. Tokens that all labelled URLs hold tell nothing and are no items.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import ascii_lower, join_small, materialize, utf8

#: Fixed values of the query.
LISTED_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
MIN_SUPPORT = 0.001
MIN_COUNT = 5
MIN_LIFT = 1.25
RULE_SCHEMA = "rule_id string, items array<string>, hits long, seen long, confidence double"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(utf8(url), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(utf8(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules=LISTED_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, judged in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(judged)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, path segments and query keys; digits of a segment count as one 0."""
    scheme = F.regexp_extract(utf8(url), r"(?s)^(.*?)://", 1)
    query = F.regexp_extract(utf8(url), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    full = lambda parts: F.filter(parts, lambda p: p != "")
    hosts = F.transform(full(F.split(host_of(url), r"\.")), lambda p: F.concat(F.lit("host="), p))
    paths = F.transform(full(F.split(path_of(url), "/")), lambda p: F.concat(F.lit("path="), F.regexp_replace(p, "[0-9]+", "0")))
    keys = F.transform(full(F.split(query, "&")), lambda p: F.concat(F.lit("query="), F.regexp_extract(p, "(?s)^([^=]*)", 1)))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("scheme="), ascii_lower(scheme))), hosts, paths, keys))


def token_items(labelled: DataFrame) -> DataFrame:
    """token, item: tokens with the same holders among the labelled URLs (tokens, weight: rows that have them) have one
    item, named after the first of them; tokens that all or no blocked rows hold are left out."""
    total = labelled.agg(F.sum("weight").alias("all"))
    held = labelled.select(F.explode("tokens").alias("token"), F.xxhash64("tokens").alias("holder"), F.md5(F.concat_ws(" ", "tokens")).alias("name"), "weight", "hits")
    lanes = [F.sum(F.conv(F.substring("name", 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).alias(f"lane{i}") for i in range(2)]
    held = held.groupBy("token").agg(F.sum("weight").alias("seen"), F.sum("hits").alias("hits"), F.bit_xor("holder").alias("holders"), *lanes)
    held = held.join(F.broadcast(total)).where((F.col("seen") < F.col("all")) & (F.col("hits") > 0))  # one row
    first = F.min("token").over(Window.partitionBy("holders", "lane0", "lane1", "seen", "hits"))
    return held.select("token", first.alias("item"))


def with_items(rows: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """keys and items (distinct) of the rows (keys, tokens) that have any."""
    met = join_small(rows.select(*keys, F.explode("tokens").alias("token")), items, ["token"])
    return met.groupBy(*keys).agg(F.sort_array(F.collect_set("item")).alias("items"))


def inverted_index(rules: DataFrame) -> DataFrame:
    """item, rule_items, rule_id: each rule under that of its items which the fewest rules have."""
    spread = rules.select("rule_id", F.col("items").alias("rule_items"), F.explode("items").alias("item"))
    counts = spread.groupBy("item").agg(F.count("*").alias("n"))
    rarest = spread.join(counts, "item").groupBy("rule_id").agg(F.min(F.struct("n", "item")).alias("key"), F.first("rule_items").alias("rule_items"))
    return rarest.select(F.col("key.item").alias("item"), "rule_items", "rule_id")


def matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (items and more) with rule_id of each rule whose items they all have."""
    index = materialize(inverted_index(rules), "url-index")
    met = join_small(rows.withColumn("item", F.explode("items")), index, ["item"])
    return met.where(F.size(F.array_except("rule_items", "items")) == 0).drop("item", "rule_items")


def mine_rules(labelled: DataFrame, min_support=MIN_SUPPORT, min_count=MIN_COUNT, min_lift=MIN_LIFT) -> tuple[DataFrame, DataFrame]:
    """labelled: tokens array<string>, blocked boolean -> rules that imply blocking (RULE_SCHEMA), and the items of tokens.

    A rule holds in at least max(min_support * rows, min_count) blocked URLs, and of the labelled URLs with its items at
    least min_lift times the share of all that are blocked. Rules have any number of items. Without blocked rows there
    are no rules.
    """
    spark = labelled.sparkSession
    grouped = labelled.select(F.sort_array("tokens").alias("tokens"), "blocked").groupBy("tokens").agg(F.count("*").alias("weight"), F.count_if("blocked").alias("hits"))
    grouped = materialize(grouped, "url-labelled")
    rows, blocked = grouped.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum("hits"), F.lit(0))).first()
    items = materialize(token_items(grouped), "url-items")
    if not blocked:
        return spark.createDataFrame([], RULE_SCHEMA), items
    need = max(min_support * rows, min_count)
    known = materialize(with_items(grouped, items, ["tokens", "weight", "hits"]).drop("tokens"), "url-transactions")
    bad = known.where("hits > 0").select("items", F.explode(F.sequence(F.lit(1), "hits")).alias("copy")).select("items")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (need - 1e-6) / blocked), minConfidence=1.0).fit(bad)
    sets = model.freqItemsets.select(F.sort_array("items").alias("items"), F.col("freq").alias("hits"))
    sets = materialize(sets.where(F.col("hits") >= F.lit(need - 1e-6)).withColumn("rule_id", F.array_join("items", " ")), "url-sets")
    seen = matches(known.select("items", "weight"), sets).groupBy("rule_id").agg(F.sum("weight").alias("seen"))
    rules = sets.join(seen, "rule_id").withColumn("confidence", F.col("hits") / F.col("seen")).where(F.col("confidence") >= F.lit(min_lift * blocked / rows))
    return rules.select("rule_id", "items", "hits", "seen", "confidence"), items


def judge_urls(pages: DataFrame, labelled: DataFrame, rules=LISTED_RULES, **mining) -> DataFrame:
    """page_id, url, host, path, rule, verdict, mined_confidence for every row of pages.

    labelled: url, blocked. Listed rules win, the longest first; a URL that none fits is blocked if any mined rule
    matches it, else allowed. mined_confidence is the largest confidence of the mined rules that match, null without any.
    Null urls and urls without :// have an empty host and path; their tokens are those of an empty URL. Null or unlabelled
    rows of labelled are left out of the mining. Repeated urls get the same verdict, also at different or null page_ids;
    very long urls are read whole. An empty table gives no rows; other columns are not read.
    """
    known = labelled.where(F.col("blocked").isNotNull() & F.col("url").isNotNull())
    mined, items = mine_rules(known.select(url_tokens(F.col("url")).alias("tokens"), "blocked"), **mining)
    mined = materialize(mined, "url-rules")
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.xxhash64("url").alias("url_hash"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("listed", verdict)
    urls = pages.select("url").distinct().select(F.xxhash64("url").alias("url_hash"), "url", url_tokens(F.col("url")).alias("tokens"))
    found = matches(with_items(urls, items, ["url_hash", "url"]), mined).join(mined.select("rule_id", "confidence"), "rule_id")
    found = found.groupBy("url_hash", "url").agg(F.max("confidence").alias("mined_confidence")).withColumnRenamed("url", "found_url")
    judged = rows.join(found, (rows["url_hash"] == found["url_hash"]) & rows["url"].eqNullSafe(found["found_url"]), "left")
    by_method = F.when(F.col("mined_confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "url", "host", "path", "rule", F.coalesce("listed", by_method).alias("verdict"), "mined_confidence")

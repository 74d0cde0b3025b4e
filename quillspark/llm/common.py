"""Shared helpers of the training-data operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.sources.scratch import scratch_folder, scratch_root

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A side of at most so many narrow rows may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return scratch_root(spark)


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses; it goes when the application ends."""
    return scratch_folder(spark, tag)


def drop_path(spark: SparkSession, path: str) -> None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, on: Column | list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a side that is expected to be small. It is broadcast only after a count shows at most limit rows;
    otherwise Spark shuffles both sides and splits skewed partitions. Give a materialized side: it is read twice."""
    if small.limit(limit + 1).count() <= limit:
        small = F.broadcast(small)
    return big.join(small, on, how)


#: Runs of a global order that are summed by themselves.
RUNS = 256


def running(rows: DataFrame, order: list[Column], nth: str, before: dict[str, str]) -> DataFrame:
    """rows with their number from 0 (column nth) and the sums over all rows before them (before: column = name), in a total
    order. Bounds of runs come from a bounded sample by hash; each run is windowed by itself, behind the sums of those before
    it. Null and NaN order as Spark orders structs. Give a materialized frame: it is read three times."""
    key = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)])
    rows = rows.withColumn("_key", key)
    some = [r[0] for r in rows.orderBy(F.xxhash64("_key"), "_key").select("_key").limit(RUNS - 1).collect()]
    bounds = rows.sparkSession.createDataFrame([(list(map(tuple, some)),)], rows.select(F.array("_key").alias("b")).schema) if some else None
    rows = rows.crossJoin(F.broadcast(bounds)).withColumn("_run", F.size(F.filter("b", lambda x: x < F.col("_key")))).drop("b") if some else rows.withColumn("_run", F.lit(0))  # one row
    ahead = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # RUNS rows at most
    sizes = rows.groupBy("_run").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in before.values()])
    zero = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0))
    sizes = sizes.select("_run", zero("_n").alias("_first"), *[zero(f"_s_{c}").alias(f"_b_{c}") for c in before.values()])
    by = Window.partitionBy("_run").orderBy("_key")
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(sizes), "_run").withColumn(nth, F.col("_first") + F.row_number().over(by) - 1)
    for name, c in before.items():
        out = out.withColumn(name, F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(upto), F.lit(0)))
    return out.drop("_run", "_key", "_first", *[f"_b_{c}" for c in before.values()])


def utf8(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(utf8(text), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(utf8(text), F.lit(WORD)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that only the key's text and the seed decide; DuckDB's md5 gives the same."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"#{seed}"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def chi2_cdf(x: float, k: int) -> float:
    """Series of the regularized lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high

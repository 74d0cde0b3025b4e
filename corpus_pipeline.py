"""A training corpus from raw documents, by the operators of quillspark.llm.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame. All but the last
return the columns of docs, whatever they are; rows are carried whole, so a column may have any name. Nulls, repeated rows
and empty tables follow the docstrings of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontamination, jaccard_join, mixing, quality, sharding
from quillspark.llm.common import fresh_path, table

SHARDS = 8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that fixed rules and robust outlier limits keep."""
    return quality.keep_sound(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar documents."""
    return jaccard_join.drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that leak no benchmark item. Null and empty texts stay, repeated rows go or stay together; an empty benchmark
    takes nothing away."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.repeat_rows(docs, table(spark, sf_dir, "labels"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: the place of each row in shards of near equal bytes. Null texts count as empty
    ones; repeated rows, as the mix makes them, share a shard and each have a slot; no rows give no rows."""
    return sharding.shard_documents(docs, SHARDS).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: The outlier limits and the shard capacities are found by iteration; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, "stage-" + "".join(c if c.isalnum() else "-" for c in name))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

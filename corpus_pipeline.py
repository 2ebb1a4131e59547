"""The corpus pipeline: language ID, near-dedup, benchmark decontamination, mixing to target weights, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the docs of
the next one. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, language_id, mixing, near_dedup, sharding
from quern.llm.common import materialize

#: A document goes if the tree of its language needs at least as many bits a byte as no model would.
MOST_BITS = 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; the trees are learned from the labelled rows of docs.

    Texts without a letter (null and empty ones too) and texts that no tree codes in fewer than 8 bits a byte go: other
    scripts, code, random characters. Rows that repeat are judged alike. Without a labelled row nothing is known, and
    every text with a letter stays. An empty table stays empty.
    """
    trees = language_id.learn(docs)
    if not trees.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.predictor(trees, spark)(F.col("text"))
    return docs.withColumn("__found", found).where(f"__found.lang_pred <> 'und' and __found.bits_per_byte < {MOST_BITS}").drop("__found")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id, and one row of it if rows repeat.

    Rows without words stay (one for each id, all with a null id); an empty table stays empty.
    """
    return near_dedup.near_deduped(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts stay, rows that repeat are judged alike."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times; those without words go, a null source is one too."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard (0 to 7) and slot, whatever their text and id; rows that repeat get a slot each."""
    return sharding.sharded(docs, 8)


STAGES = [("language_id", language), ("near_dedup", near), ("decontamination", decontaminated), ("mixing", mixture), ("sharding", shards)]

#: Not to be had in SQL: the trees, the seeded order and the alignment; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs

"""Sharding by proportional stratified interleaving: every shard gets the sources in the mixture of the whole.

Within each source (null is a source of its own) rows are shuffled by a seeded hash of the id and ranked without gaps.
Sorted by fractional rank (rank + 1/2) / rows of the source, the sources lie evenly spread, and a cut into equal counts
gives every shard the same mixture; the law is `rows`: counts differ by one at most. Rows that repeat an id are told
apart by their text's checksum; full repeats are interchangeable. No rank needs a global sort or a group in one task:
ranks come from counts of hash ranges and a window within each range. Null text has size 1 and the checksum of no bytes;
null ids are rows like any other. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import below, bits_for, hash_bucket, join_split, materialize, unsigned_order

#: Rows that one window partition holds, about.
RANGE_ROWS = 20_000
#: Copies of one row that one window counts; more are counted in many tasks.
MOST_COPIES = 10_000


def shard(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot for each row of docs; slots count from 0 in each shard."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
    )
    rows = materialize(rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32")), "rows")
    total = rows.count()
    bits = bits_for(total, RANGE_ROWS)
    # Null sources and the text "" stay apart: s is null-safe.
    rows = rows.withColumns({"s": F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")), "hb": hash_bucket(F.col("h"), bits)})
    counts = rows.groupBy("s", "hb").agg(F.count(F.lit(1)).alias("n"))
    of_source = counts.groupBy("s").agg(F.sum("n").alias("n_source"))
    counts = below(counts, ["s"], "hb", "n").join(of_source, "s").select("s", "hb", "n_source", "below")
    ranked = rows.join(counts, ["s", "hb"]).withColumn("rank", F.col("below") + F.row_number().over(Window.partitionBy("s", "hb").orderBy(unsigned_order(F.col("h")), "doc_id", "text_crc32", "size")) - 1)
    # The fractional rank is kept as a whole number of 2^-40, so that all machines sort alike.
    ranked = ranked.withColumn("f", F.floor((F.col("rank") * 2 + 1).cast("decimal(20,0)") * F.lit(2**40).cast("decimal(14,0)") / (F.col("n_source") * 2).cast("decimal(20,0)")).cast("long"))
    ranked = materialize(ranked.select("doc_id", "source", "size", "text_crc32", "s", "f", "h", F.shiftright("f", 40 - bits).cast("int").alias("fb")), "ranked")
    # One row for each range of about RANGE_ROWS rows.
    spans = ranked.groupBy("fb").agg(F.count(F.lit(1)).alias("n"))
    spans = below(spans.withColumn("__all", F.lit(0)), ["__all"], "fb", "n").select("fb", F.col("below").alias("base"))
    place = F.col("base") + F.row_number().over(Window.partitionBy("fb").orderBy("f", "s", unsigned_order(F.col("h")), "doc_id", "text_crc32", "size")) - 1
    placed = ranked.join(spans, "fb").withColumn("place", place)
    placed = placed.withColumn("shard", F.expr(f"int(place * {shards} div {max(1, total)})"))
    first = F.expr(f"(shard * {max(1, total)}L + {shards - 1}) div {shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("place") - first).alias("slot"))


def _numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows of keys that repeat very often, with `__copy`: numbers from 0 within a key, counted in many tasks."""
    rows = materialize(rows, "copies").withColumn("__salt", F.pmod(F.xxhash64("_metadata.file_path", "_metadata.row_index"), F.lit(1 << 12)).cast("int"))
    counts = below(rows.groupBy(*keys, "__salt").agg(F.count(F.lit(1)).alias("__n")), keys, "__salt", "__n").select(*keys, "__salt", "below")
    own = F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*(order or [F.lit(0)])))
    return rows.withColumn("__own", own).join(counts, [*keys, "__salt"]).withColumn("__copy", F.col("below") + F.col("__own") - 1).drop("__salt", "__own", "below")


def sharded(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """docs with shard and slot (columns of these names are replaced). Rows that repeat id and text share out their places.

    Extra columns stay with their rows; an empty table gives an empty result.
    """
    places = materialize(shard(docs, shards, seed).select("doc_id", "text_crc32", "shard", "slot"), "places")
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    keys = ["__id", "__none", "__crc"]
    key = {"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__none": F.col("doc_id").isNull()}
    left = docs.select(*names).withColumns(key | {"__crc": F.crc32(F.coalesce(F.col("text"), F.lit("")))})
    right = places.withColumns(key | {"__crc": F.col("text_crc32")}).select(*keys, "shard", "slot")
    often = materialize(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > MOST_COPIES), "often")
    some = often.limit(1).count() > 0
    copy = lambda *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    few = lambda df: df.join(often, keys, "left_anti") if some else df
    out = few(left).withColumn("__copy", copy(F.lit(0))).join(few(right).withColumn("__copy", copy("shard", "slot")), [*keys, "__copy"])
    if some:
        many = lambda df: join_split(df, often, keys, "__n").drop("__n")
        hot = _numbered(many(left), keys, []).join(_numbered(many(right), keys, ["shard", "slot"]), [*keys, "__copy"])
        out = out.unionByName(hot)
    return out.select(*names, "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 17) -> None:
    """Write docs as folders shard=0.., in ranges of slots."""
    out = sharded(docs, shards, seed)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

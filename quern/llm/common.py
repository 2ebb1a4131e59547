"""Helpers shared by the corpus operators: the shared work folder, written tables, key joins that survive hot keys, seeded order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources.work import fresh_path, materialize, shared_dir

__all__ = ["fresh_path", "materialize", "shared_dir"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word, as every contract here has it: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: At most so many keys are ever treated as hot, which bounds what join_split broadcasts.
HOT_KEYS = 500
#: Keys with fewer rows than this are never hot.
HOT_FLOOR = 1_000

def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. lower() does the same for pure ASCII and is much faster there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def join_split(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of rows with groups, which has one row for each key; weight counts a key's rows.

    Keys that hold more than 1/HOT_KEYS of all rows are at most HOT_KEYS many, so they are broadcast and their rows stay
    where they are. The rest is left to a sort-merge join in which no key stands out. Both inputs are read twice: pass
    written tables.
    """
    total, most = groups.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first()
    least = max(HOT_FLOOR, total / HOT_KEYS)
    if most < least:
        return rows.join(groups, keys)
    hot = F.broadcast(groups.where(F.col(weight) >= least))
    cold = rows.join(F.broadcast(groups.where(F.col(weight) >= least).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(groups.where(F.col(weight) < least), keys))


def bits_for(n: int, each: int) -> int:
    """Bits of a hash that deal n rows into buckets of about `each` rows."""
    return max(0, -(-n // each) - 1).bit_length()


def hash_bucket(h: Column, bits: int) -> Column:
    """The first bits of a 64-bit hash, so that buckets follow the unsigned order of the hash."""
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


def below(counts: DataFrame, own: list[str], at: str, n: str) -> DataFrame:
    """counts with `below`: the sum of n before each `at` (a whole number from 0) within `own`.

    In two levels, so that no window holds more than the square root of what one over all would.
    """
    high = counts.groupBy(*own, F.shiftright(at, 10).alias("__high")).agg(F.sum(n).alias("__n"))
    high = high.select(*own, "__high", (F.sum("__n").over(Window.partitionBy(*own).orderBy("__high")) - F.col("__n")).alias("__base"))
    low = counts.withColumn("__high", F.shiftright(at, 10)).join(high, [*own, "__high"])
    own_window = Window.partitionBy(*own, "__high").orderBy(at)
    return low.withColumn("below", F.col("__base") + F.sum(n).over(own_window) - F.col(n)).drop("__high", "__base")


def unsigned_order(h: Column) -> Column:
    """Sorts as the unsigned value of a 64-bit hash."""
    return h.bitwiseXOR(F.lit(-(2**63)).cast("long"))


#: Bytes that a Python worker gets at a time; a single longer text is a batch by itself.
ARROW_BYTES = 2 << 20


def bounded_arrow(spark: SparkSession) -> None:
    """Python workers get a bounded number of bytes at a time, whatever the texts; rows are bounded by Spark's own setting."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def units(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(id, doc_id, text, n): rows that repeat doc_id and text are one row that stands for n; and whether any do not stand alone.

    A null text counts as empty. id is the doc_id where it occurs once, else (repeated ids, null ids) a hash of doc_id and
    text, so that no two texts share one. If all ids are there and differ (one narrow aggregate tells), nothing is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if not counts.limit(1).count():
        return rows.select(F.col("doc_id").alias("id"), "doc_id", "text", F.lit(1).cast("long").alias("n")), False
    again = materialize(counts.where("doc_id is not null"), "repeated")
    own = rows.where("doc_id is not null").join(again, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), "doc_id", "text", F.lit(1).cast("long").alias("n"))
    rest = rows.where("doc_id is null").unionByName(join_split(rows, again, ["doc_id"], "n").select("doc_id", "text"))
    # Equal rows are counted in each task before they meet; their text is the same.
    hashes = [F.xxhash64(F.lit(i), "text").alias(f"h{i}") for i in (1, 2)]
    rest = rest.groupBy("doc_id", *hashes).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    rest = materialize(rest.select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "h1", "h2").alias("id"), "doc_id", "text", "n"), "units")
    return own.unionByName(rest), True


#: Copies of one row that a task writes out.
COPIES = 10_000


def repeated(rows: DataFrame, n: str) -> DataFrame:
    """Each row n times, without the column n; the copies of one row are made in many tasks."""
    many = rows.where(F.col(n) > 1).withColumn(n, F.explode(F.expr(f"transform(sequence(0L, ({n} - 1) div {COPIES}), i -> least({COPIES}L, {n} - i * {COPIES}))")))
    many = many.repartition(n, F.monotonically_increasing_id()).withColumn(n, F.explode(F.array_repeat(F.lit(1).cast("long"), F.col(n).cast("int"))))
    return rows.where(F.col(n) == 1).unionByName(many).drop(n)

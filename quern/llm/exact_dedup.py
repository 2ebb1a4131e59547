"""Exact dedup: a persistent digest index, bucketed and sorted by digest; new rows meet it in a sort-merge anti-join.

Texts are equal when identical after lower-casing A-Z; a null text counts as empty. A batch is taken in ranges of falling
ids, null ids last: what a range brings that the index lacks (anti-join) is new and keeps its row with the largest doc_id;
what it brings again is only counted. So of the equal texts of one batch the row with the largest doc_id stays, and a text
that an earlier batch has brought keeps its earlier row. Rows that repeat both doc_id and text are one document and carry
one verdict; where a text has null ids alone, keep_id is null and all of them are kept. group_size counts all rows of all
batches up to now. Only (doc_id, digest) pairs are shuffled, never a text. Extra columns do not matter. An empty table
gives an empty result.

Beside the index lies a file with its bucket count and the attempts of each batch. It is replaced atomically after an
append, so that a lost append counts for nothing, and a batch that is run again replaces its earlier attempt.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, join_split, materialize, shared_dir
from quern.sources.catalog import Files

#: Ranges of ids in which a batch is taken.
RANGES = 4
COLUMNS = "digest BINARY, keep_id BIGINT, n BIGINT, new BOOLEAN, attempt STRING"


class DigestIndex:
    """The index at a location: digest, keep_id, n (rows), new, attempt. One at an old location is taken up again.

    Use it in a with statement: the session's catalog names the table only meanwhile.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int = 12):
        self.spark, self.location, self.files = spark, location.rstrip("/"), Files(spark, location)
        text = self.files.read("index.json")
        self.meta = json.loads(text) if text else {"buckets": buckets, "data": f"data-{uuid.uuid4().hex}", "batches": {}}
        self.table = f"quern_digests_{uuid.uuid4().hex}"
        if not text:
            self._save()

    @property
    def buckets(self) -> int:
        """As the index was made; another session's setting does not change it."""
        return self.meta["buckets"]

    @property
    def batches(self) -> list[str]:
        return list(self.meta["batches"])

    def __enter__(self) -> DigestIndex:
        self.spark.sql(f"CREATE TABLE {self.table} ({COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}/{self.meta['data']}'")
        return self

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")  # its files stay

    def _save(self) -> None:
        self.files.make()
        self.files.replace("index.json", json.dumps(self.meta))

    def read(self, but: str | None = None) -> DataFrame:
        """digest, keep_id, group_size, attempt (of the row that is kept): one row a digest, without the batch `but`."""
        live = [a for b, own in self.meta["batches"].items() if b != but for a in own]
        return self._totals(live)

    def _totals(self, attempts: list[str]) -> DataFrame:
        rows = self.spark.table(self.table).where(F.col("attempt").isin(*attempts))
        first = F.max(F.when(F.col("new"), F.struct("new", "keep_id", "attempt")))
        return rows.groupBy("digest").agg(F.sum("n").alias("group_size"), first.alias("k")).where("k is not null").select("digest", "k.keep_id", "group_size", "k.attempt")

    def add(self, docs: DataFrame, batch: str, ranges: int = RANGES) -> DataFrame:
        """Append what is new in docs; return doc_id, digest, keep_id, group_size, kept for every row of docs."""
        text = F.coalesce(F.col("text"), F.lit(""))
        rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(ascii_lower(text), 256)).alias("digest")), "digests")
        # Bounds between ranges; equal ones (few ids) leave ranges empty.
        bounds = sorted(set(rows.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.01)), reverse=True)
        live = [a for b, own in self.meta["batches"].items() if b != batch for a in own]
        own: list[str] = []
        for i in range(len(bounds) + 1):
            low = F.col("doc_id") >= bounds[i] if i < len(bounds) else F.lit(True)
            high = F.lit(True) if i == 0 else F.coalesce(F.col("doc_id") < bounds[i - 1], F.lit(True))
            groups = rows.where(low & high).groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
            groups = groups.repartition(self.buckets, "digest")
            if live or own:
                groups = materialize(groups, "groups")
                known = self._totals(live + own).select("digest")
                fresh = groups.hint("merge").join(known, "digest", "left_anti").withColumn("new", F.lit(True))
                again = groups.hint("merge").join(known, "digest", "left_semi").withColumn("new", F.lit(False))
                groups = fresh.unionByName(again)
            else:
                groups = groups.withColumn("new", F.lit(True))
            attempt = uuid.uuid4().hex
            groups.withColumn("attempt", F.lit(attempt)).write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(self.table)
            own.append(attempt)
        self.meta["batches"][batch] = own
        self._save()
        totals = materialize(self._totals(live + own).withColumn("here", F.col("attempt").isin(*own)), "totals")
        out = join_split(rows, totals.select("digest", "keep_id", "group_size", "here"), ["digest"], "group_size")
        return out.select("doc_id", "digest", "keep_id", "group_size", (F.col("here") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"))

    def compact(self) -> None:
        """Rewrite the index with one row a digest, without attempts that were replaced."""
        data, table = f"data-{uuid.uuid4().hex}", f"quern_digests_{uuid.uuid4().hex}"
        rows = self.read().select("digest", "keep_id", F.col("group_size").alias("n"), F.lit(True).alias("new"), "attempt")
        out = rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet")
        out.option("path", f"{self.location}/{data}").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")
        old, self.meta["data"] = self.meta["data"], data
        self._save()
        self.__exit__()
        self.__enter__()
        self.files.delete(f"{self.location}/{old}")


def exact_dedup(docs: DataFrame, location: str | None = None, batch: str | None = None, ranges: int = RANGES) -> DataFrame:
    """Verdicts for docs against the index at location; without one, against a new index."""
    spark = docs.sparkSession
    where = location or f"{shared_dir(spark)}/quern/index-{uuid.uuid4().hex}"
    with DigestIndex(spark, where, max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))) as index:
        return index.add(docs, batch or uuid.uuid4().hex, ranges)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

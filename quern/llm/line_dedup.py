"""Line dedup: lines that many documents share are taken out of all of them.

A text is split at newlines (null or empty: one empty line). A line's key is the line without blanks at its ends, with
A-Z lower-cased. Keys of at least min_chars code points that stand in at least min_docs documents lose all their lines;
the other lines stay in order. A document is a doc_id: rows that repeat an id count once, and rows that repeat id and
text get the same result. Null ids count as one document. Only hashes (128 bits) and positions are shuffled by line; a
text moves once, to meet the positions that it loses. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import BLANKS, ascii_lower, join_split, materialize


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # th tells a null id from the id 0.
    base = base.withColumns({"id0": F.coalesce("doc_id", F.lit(0)), "th": F.xxhash64(F.col("doc_id").isNull(), "text")})
    # A-Z is lowered once for the whole text: newlines and blanks stay where they are.
    lines = base.select("doc_id", "id0", "th", F.posexplode(F.split(ascii_lower(F.col("text")), "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc_id", "id0", "th", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.char_length("key") >= max(1, min_chars))
    hashed = materialize(lines.select("doc_id", "id0", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2")), "lines")
    often = hashed.groupBy("h1", "h2").agg((F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("n_docs"), F.count(F.lit(1)).alias("n_rows")).where(F.col("n_docs") >= min_docs)
    often = materialize(often.select("h1", "h2", "n_rows"), "often")
    drops = join_split(hashed.drop("doc_id"), often, ["h1", "h2"], "n_rows").groupBy("id0", "th").agg(F.array_sort(F.collect_set("pos")).alias("drops"))
    whole = base.join(drops, ["id0", "th"], "left")
    parts = F.split("text", "\n", -1)
    n = F.coalesce(F.size("drops"), F.lit(0))
    # Between two dropped positions lies one slice of kept lines.
    before = lambda i: F.coalesce(F.get("drops", i - 1), F.lit(-1))
    after = lambda i: F.coalesce(F.get("drops", i), F.size("parts"))
    runs = F.transform(F.sequence(F.lit(0), F.size("drops")), lambda i: F.slice("parts", before(i) + 2, after(i) - before(i) - 1))
    return (
        whole.withColumn("parts", parts)
        .withColumn("kept_text", F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n")))
        .select("doc_id", F.size("parts").cast("long").alias("n_lines"), F.when(F.col("drops").isNull(), 0).otherwise(n).cast("long").alias("n_dropped"), "kept_text")
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), o AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN o ON l.k = o.k GROUP BY doc_id
"""

"""Inverted index and ranked text search: postings, TF-IDF (lnc.ltc) and BM25, all as DataFrames."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.sources.work import fresh_path, materialize

# BM25's parameters.
K1, B = 1.2, 0.75


@dataclass
class TextIndex:
    """postings: term, id, tf; docs: id, length, norm (every document, empty ones too); N and the average length."""

    postings: DataFrame
    docs: DataFrame
    n: int
    average: float
    stemmed: bool = True

    @staticmethod
    def build(df: DataFrame, key: str, column: str, stemmed: bool = True, folder: str | None = None) -> TextIndex:
        """One pass over the texts: rows are dealt by key, so tokens are counted, and lengths and norms summed, where they
        are made; only distinct tokens are stemmed. The index is written to folder, or to the work folder without one."""
        spark, where = df.sparkSession, folder or fresh_path(df.sparkSession, "text-index")
        rows = df.select(F.col(key).alias("id"), F.col(column).alias("text")).repartition("id")
        counts = rows.select("id", F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
        if stemmed:
            counts = materialize(counts, "counts")
            stems = counts.select("token").distinct().withColumn("term", tx.stem_column(F.col("token")))
            counts = counts.join(stems, "token").groupBy("id", "term").agg(F.sum("tf").alias("tf"))
        postings = counts.select(F.col("term" if stemmed else "token").alias("term"), "id", "tf")
        if folder:  # an index that stays is laid out by term, so that a query reads its terms alone
            postings = postings.repartitionByRange("term").sortWithinPartitions("term", "id")
        postings.write.mode("overwrite").parquet(f"{where}/postings")
        postings = spark.read.parquet(f"{where}/postings")
        weight = 1 + F.log10(F.col("tf"))
        sums = postings.groupBy("id").agg(F.sum("tf").alias("length"), F.sqrt(F.sum(weight * weight)).alias("norm"))
        docs = df.select(F.col(key).alias("id")).join(sums, "id", "left").na.fill({"length": 0, "norm": 0.0})
        docs.write.mode("overwrite").parquet(f"{where}/docs")
        return TextIndex.load(spark, where, stemmed)

    @staticmethod
    def load(spark, folder: str, stemmed: bool = True) -> TextIndex:
        postings, docs = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/docs")
        n, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        return TextIndex(postings, docs, n, total / n if n else 0.0, stemmed)

    def scores(self, query: str, scheme: str = "BM25") -> DataFrame:
        """(id, score) of documents with a positive score; any query term is enough."""
        words = tx.query_tokens(query)
        tf = Counter(tx.stem(w) if self.stemmed else w for w in words)
        spark = self.docs.sparkSession
        if not tf:
            return self.docs.select("id", F.lit(0.0).alias("score")).limit(0)
        found = self.postings.where(F.col("term").isin(*tf))
        df = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # the query's terms
        if scheme == "BM25":
            weights = [(t, math.log((self.n - d + 0.5) / (d + 0.5) + 1)) for t, d in df.items()]
            part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / (self.average or 1.0)))
        else:
            raw = {t: (1 + math.log10(tf[t])) * math.log10(self.n / d) for t, d in df.items()}
            size = math.sqrt(sum(w * w for w in raw.values()))
            weights = [(t, w / size) for t, w in raw.items() if size > 0]
            part = F.col("w") * (1 + F.log10("tf")) / F.nullif(F.col("norm"), F.lit(0.0))
        table = spark.createDataFrame(weights or [("", 0.0)], "term string, w double")
        hits = found.join(F.broadcast(table), "term").join(self.docs, "id")  # as many rows as the query has terms
        return hits.groupBy("id").agg(F.sum(part).alias("score")).where("score > 0")

    def search(self, query: str, scheme: str = "BM25", k: int = 10) -> DataFrame:
        return self.scores(query, scheme).orderBy(F.desc("score"), "id").limit(k)


def bm25(df: DataFrame, key: str, column: str, query: str) -> DataFrame:
    """(id, score) by BM25 without an index: one tokenising pass, and no join.

    A word begins like its stem, so a document keeps its length and those tokens alone that begin like a stem of the
    query; that small table is written once. Its distinct tokens are stemmed, and what remains are the surface forms of
    the query's stems: the suffix rules bound how many there can be. Scores are then one expression on each row.
    """
    spark = df.sparkSession
    wanted = sorted({tx.stem(w) for w in tx.query_tokens(query)})
    if not wanted:
        return df.select(F.col(key).alias("id"), F.lit(0.0).alias("score")).limit(0)
    begins = sorted({tx.stem_prefix(w) for w in wanted})
    # Catalyst does not copy the tokeniser into both uses of its array.
    toks = df.select(F.col(key).alias("id"), tx.tokens(F.col(column)).alias("ts"))
    near = F.filter("ts", lambda t: reduce(or_, (t.startswith(p) for p in begins)))
    base = materialize(toks.select("id", F.size("ts").alias("length"), near.alias("near")), "lengths")
    n, total = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tokens = base.select(F.explode("near").alias("token")).distinct().withColumn("term", tx.stem_column(F.col("token")))
    forms: dict[str, list[str]] = {}
    for r in tokens.where(F.col("term").isin(*wanted)).collect():
        forms.setdefault(r["term"], []).append(r["token"])
    terms = [t for t in wanted if t in forms]
    if not terms:
        return base.select("id", F.lit(0.0).alias("score")).limit(0)
    count = lambda words: F.size(F.filter("near", lambda x: x.isin(*words)))
    hits = base.where(F.size("near") > 0).select("id", "length", *(count(forms[t]).alias(f"tf{i}") for i, t in enumerate(terms)))
    dfs = hits.agg(*(F.sum((F.col(f"tf{i}") > 0).cast("long")) for i in range(len(terms)))).first()
    short = K1 * (1 - B + B * F.col("length") / (total / n if total else 1.0))
    parts = [math.log((n - d + 0.5) / (d + 0.5) + 1) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + short) for i, d in enumerate(dfs)]
    return hits.select("id", sum(parts[1:], parts[0]).alias("score")).where("score > 0")


def precision_recall(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Precision, recall and its ceiling at k. ranked: query, id, rank; relevant: query, id."""
    sizes = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = ranked.where(F.col("rank") <= k).join(relevant, ["query", "id"]).groupBy("query").agg(F.count(F.lit(1)).alias("hits"))
    both = sizes.join(hits, "query", "left").na.fill(0, ["hits"])
    return both.select("query", (F.col("hits") / k).alias("precision"), (F.col("hits") / F.col("n_relevant")).alias("recall"), (F.least(F.lit(k), "n_relevant") / F.col("n_relevant")).alias("ceiling"))

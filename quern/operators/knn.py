"""Exact nearest neighbours: one query, or a query table against all rows in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vector

#: Query vectors that meet the rows at a time; a block is broadcast, so this bounds it whatever the number of queries.
BLOCK_QUERIES = 4_096
#: Distances that a task holds at a time.
CELLS = 1 << 22
#: Distances are compared to this many decimals, so that equal vectors tie whatever the order of a sum.
DECIMALS = 12
FOUND = "query long, key long, distance double"


def top_k(df: DataFrame, order: Column, key: str, k: int, descending: bool = False) -> DataFrame:
    """The k first rows by `order`, ties by key: a bounded heap in each task and one merge."""
    return df.orderBy(order.desc() if descending else order.asc(), F.col(key).asc()).limit(k)


def nearest(df: DataFrame, column: str, q: list[float], k: int, key: str, metric: str = "COSENO") -> DataFrame:
    """df with `distance` and `score`, the k nearest rows."""
    d = vector.distance(F.col(column), q, metric)
    return top_k(df.withColumn("distance", d), F.col("distance"), key, k).withColumn("score", vector.similarity(F.col("distance"), metric))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """The vectors of an Arrow list column without nulls, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """All distances, queries by rows, from one matrix product."""
    dot = q @ x.T
    if metric == "PRODUCTO_PUNTO":
        return -dot
    a, b = (q * q).sum(1), (x * x).sum(1)
    if metric == "COSENO":
        n = np.sqrt(a)[:, None] * np.sqrt(b)[None, :]
        return np.where(n == 0, 1.0, 1 - dot / np.where(n == 0, 1.0, n))
    both = a[:, None] + b[None, :]
    d = np.maximum(both - 2 * dot, 0)
    i, j = np.nonzero(d <= 1e-6 * both)  # here the difference of large numbers says too little
    d[i, j] = ((q[i] - x[j]) ** 2).sum(1)
    return np.sqrt(d)


def least(query: np.ndarray, key: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least (distance, key) of each query."""
    order = np.lexsort((key, d, query))
    query, key, d = query[order], key[order], d[order]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[rank < k], key[rank < k], d[rank < k]


def query_blocks(queries: DataFrame, key: str, column: str, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and vectors of the queries, a bounded block at a time; they stream through the driver."""
    held: list = []
    for r in queries.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(column).alias("v")).toLocalIterator():
        held.append(r)
        if len(held) == (size or BLOCK_QUERIES):
            yield np.array([r["k"] for r in held], np.int64), np.array([r["v"] for r in held], np.float64)
            held = []
    if held:
        yield np.array([r["k"] for r in held], np.int64), np.array([r["v"] for r in held], np.float64)


def _pieces(batches: Iterator[pa.RecordBatch], n_queries: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, CELLS // max(1, n_queries))
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            yield part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), matrix(part.column(1), part.num_rows)


def _against(rows: DataFrame, key: str, column: str, run, schema: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(column).alias("v")).mapInArrow(run, schema)


def union_all(frames: list[DataFrame], spark, schema: str) -> DataFrame:
    out = frames[0] if frames else spark.createDataFrame([], schema)
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def batch_nearest(rows: DataFrame, queries: DataFrame, column: str, key: str, query_key: str, k: int, metric: str = "COSENO") -> DataFrame:
    """(query, key, distance, rank) of the k nearest rows of each query; keys are whole numbers.

    Each block of queries meets the rows where they lie: a matrix product, and the k best of a task. Only those, k rows a
    query and task, are shuffled.
    """
    spark, parts = rows.sparkSession, []
    for ids, q in query_blocks(queries, query_key, column):
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            bound = np.full(len(ids), np.inf)
            for keys, x in _pieces(batches, len(ids)):
                d = np.round(distances(q, x, metric), DECIMALS)
                cut = np.minimum(bound, np.partition(d, k - 1, 1)[:, k - 1]) if d.shape[1] > k else bound
                i, j = np.nonzero(d <= cut[:, None])
                best = least(*(np.concatenate(z) for z in zip(best, (i, keys[j], d[i, j]), strict=True)), k)
                n = np.bincount(best[0], minlength=len(ids))
                last = np.cumsum(n) - 1
                bound = np.where(n >= k, best[2][np.maximum(last, 0)] if len(best[2]) else np.inf, np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query", "key", "distance"])

        parts.append(_against(rows, key, column, run, FOUND))
    ranked = Window.partitionBy("query").orderBy("distance", "key")
    return union_all(parts, spark, FOUND).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def distance_range(rows: DataFrame, queries: DataFrame, column: str, key: str, query_key: str, metric: str = "EUCLIDIANA", above: float = 1e-9) -> DataFrame:
    """(query, near, far): the least and the largest distance of each query to a row, those up to `above` left out."""
    spark, parts, schema = rows.sparkSession, [], "query long, near double, far double"
    for ids, q in query_blocks(queries, query_key, column):
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            near, far = np.full(len(ids), np.inf), np.full(len(ids), -np.inf)
            for _, x in _pieces(batches, len(ids)):
                d = distances(q, x, metric)
                near = np.minimum(near, np.where(d > above, d, np.inf).min(1))
                far = np.maximum(far, np.where(d > above, d, -np.inf).max(1))
            ok = np.isfinite(near)
            yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(near[ok]), pa.array(far[ok])], names=["query", "near", "far"])

        parts.append(_against(rows, key, column, run, schema))
    return union_all(parts, spark, schema).groupBy("query").agg(F.min("near").alias("near"), F.max("far").alias("far"))

"""Approximate neighbours: IVF lists by k-means, and HNSW graphs, one for each part of the keys."""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vector
from quern.operators.knn import DECIMALS, FOUND, distances, least, matrix, query_blocks, top_k, union_all

SEED = 2026
# Parameters and their defaults.
IVF_DEFAULTS = {"nlist": 100, "nprobe": 8}
HNSW_DEFAULTS = {"M": 32, "ef_construccion": 40, "ef_busqueda": 64, "umbral": 0.3}
#: Vectors in one graph, about.
GRAPH_ROWS = 20_000
#: k-means reads at most so many vectors a list.
SAMPLE_PER_LIST = 256


@dataclass
class Ivf:
    """Rows with their list, and the lists' centres; cosine works on normalized vectors.

    In a folder: rows/ (one folder a list, so a probe reads its lists alone) and centres/. Rows that come later are put
    into the list of their nearest centre; rows that have gone stay in the files and are masked by the table's keys.
    """

    rows: DataFrame
    centres: np.ndarray
    key: str
    column: str
    metric: str
    current: DataFrame | None = None  # the table, where it lacks rows that are in the lists

    @staticmethod
    def build(df: DataFrame, key: str, column: str, metric: str = "COSENO", nlist: int = 100, folder: str | None = None) -> Ivf:
        unit = vector.normalized(F.col(column)) if metric == "COSENO" else F.col(column)
        feats = df.withColumn("__features", array_to_vector(unit))
        n = df.count()
        sample = feats if n <= nlist * SAMPLE_PER_LIST else feats.sample(nlist * SAMPLE_PER_LIST / n, seed=SEED)
        model = KMeans(k=nlist, seed=SEED, maxIter=25, featuresCol="__features", predictionCol="list").fit(sample.repartition(8))
        rows = model.transform(feats).drop("__features")
        centres = np.array(model.clusterCenters())
        if not folder:
            return Ivf(rows, centres, key, column, metric)
        # A list may hold a large share of the rows: it is written by several tasks.
        rows.repartition(F.col("list"), F.pmod(F.xxhash64(key), F.lit(16))).write.mode("overwrite").partitionBy("list").parquet(f"{folder}/rows")
        table = df.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
        table.coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
        return Ivf.load(df, key, column, metric, folder)

    @staticmethod
    def load(df: DataFrame, key: str, column: str, metric: str, folder: str) -> Ivf:
        spark = df.sparkSession
        centres = np.array([r["centre"] for r in spark.read.parquet(f"{folder}/centres").orderBy("list").collect()])  # nlist rows
        return Ivf(spark.read.parquet(f"{folder}/rows"), centres, key, column, metric, df)

    def insert(self, new: DataFrame, folder: str) -> None:
        """Append rows to the lists of their nearest centres."""
        x = vector.normalized(F.col(self.column)) if self.metric == "COSENO" else F.col(self.column)
        centres = self.centres

        @F.pandas_udf("int")
        def nearest(v: pd.Series) -> pd.Series:
            m = np.stack(v.to_list()).astype(float) if len(v) else np.zeros((0, centres.shape[1]))
            return pd.Series((-2 * m @ centres.T + (centres**2).sum(1)).argmin(1).astype("int32"))

        new.withColumn("list", nearest(x)).write.mode("append").partitionBy("list").parquet(f"{folder}/rows")

    def near_lists(self, q, nprobe: int) -> list[int]:
        v = np.array(q, float)
        if self.metric == "COSENO":
            v = v / (np.linalg.norm(v) or 1)
        far = -(self.centres @ v) if self.metric != "EUCLIDIANA" else ((self.centres - v) ** 2).sum(1)
        return [int(i) for i in np.argsort(far, kind="stable")[:nprobe]]

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows if self.current is None else rows.join(self.current.select(self.key), self.key, "left_semi").select(*rows.columns)

    def search(self, q: list[float], k: int, nprobe: int = 8) -> DataFrame:
        """The k nearest rows of the nprobe nearest lists, with their exact distance."""
        rows = self._live(self.rows.where(F.col("list").isin(*self.near_lists(q, nprobe))).drop("list"))
        return top_k(rows.withColumn("distance", vector.distance(F.col(self.column), q, self.metric)), F.col("distance"), self.key, k)

    def search_many(self, queries: DataFrame, query_key: str, column: str, k: int, nprobe: int = 8) -> DataFrame:
        """(query, key, distance, rank) for a query table: each list meets the queries that probe it, in blocks."""
        spark, parts, metric, rows = self.rows.sparkSession, [], self.metric, self._live(self.rows)
        for ids, q in query_blocks(queries, query_key, column):
            asks: dict[int, list[int]] = {}
            for i, v in enumerate(q):
                for lst in self.near_lists(v, nprobe):
                    asks.setdefault(lst, []).append(i)
            shared = spark.sparkContext.broadcast((ids, q, {lst: np.array(own) for lst, own in asks.items()}))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                ids, q, asks = shared.value
                best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                for batch in batches:
                    keys, x, lists = batch.column(0).to_numpy(), matrix(batch.column(1), batch.num_rows), batch.column(2).to_numpy()
                    for lst in np.unique(lists).tolist():
                        if (own := asks.get(lst)) is not None:
                            at = np.flatnonzero(lists == lst)
                            d = np.round(distances(q[own], x[at], metric), DECIMALS)
                            best = least(*(np.concatenate(z) for z in zip(best, (np.repeat(own, len(at)), np.tile(keys[at], len(own)), d.ravel()), strict=True)), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query", "key", "distance"])

            parts.append(rows.select(F.col(self.key).cast("long").alias("key"), F.col(self.column).alias("v"), F.col("list").cast("int").alias("list")).mapInArrow(run, FOUND))
        return _ranked(union_all(parts, spark, FOUND), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of what tasks have found, k rows a query and task."""
    own = Window.partitionBy("query").orderBy("distance", "key")
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


class HnswGraph:
    """A navigable small-world graph in layers over a matrix; deleted rows stay as waypoints."""

    def __init__(self, m: int = 32, ef: int = 40, metric: str = "COSENO", seed: int = SEED):
        self.m, self.ef, self.metric, self.rng = m, ef, metric, np.random.default_rng(seed)
        self.keys: list[int] = []
        self.x: np.ndarray | None = None
        self.links: list[list[list[int]]] = []
        self.entry, self.gone = -1, set()
        self.place: dict[int, int] = {}

    def _far(self, ids, v: np.ndarray) -> np.ndarray:
        x = self.x[ids]
        return ((x - v) ** 2).sum(1) if self.metric == "EUCLIDIANA" else -(x @ v)

    def _prepared(self, v) -> np.ndarray:
        v = np.array(v, np.float32)
        return v / (np.linalg.norm(v, axis=-1, keepdims=True) + 1e-30) if self.metric == "COSENO" else v

    def _layer(self, v: np.ndarray, starts: list[int], ef: int, level: int) -> list[tuple[float, int]]:
        """The ef best nodes of a layer, by best-first search with a bounded list."""
        seen, d = set(starts), self._far(starts, v)
        todo = [(float(a), i) for a, i in zip(d, starts, strict=True)]
        best = [(-a, i) for a, i in todo]
        heapq.heapify(todo), heapq.heapify(best)
        while todo:
            a, i = heapq.heappop(todo)
            if a > -best[0][0] and len(best) >= ef:
                break
            new = [j for j in self.links[i][level] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for b, j in zip(self._far(new, v).tolist(), new, strict=True):
                if len(best) < ef or b < -best[0][0]:
                    heapq.heappush(todo, (b, j)), heapq.heappush(best, (-b, j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-a, i) for a, i in best)

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that are nearer to the node than to any neighbour already chosen; the nearest others fill up."""
        out: list[int] = []
        for d, i in found:
            if len(out) >= most:
                break
            if not out or d < self._far(out, self.x[i]).min():
                out.append(i)
        return out + [i for _, i in found if i not in out][: most - len(out)]

    def add(self, keys, vectors) -> None:
        vectors = np.atleast_2d(self._prepared(vectors))
        base = len(self.keys)
        self.x = vectors if self.x is None else np.vstack([self.x, vectors])
        self.keys += [int(k) for k in keys]
        self.place |= {k: i for i, k in enumerate(self.keys[base:], base)}
        for i in range(base, len(self.keys)):
            level = int(-math.log(1 - self.rng.random()) / math.log(self.m))
            self.links.append([[] for _ in range(level + 1)])
            if self.entry < 0:
                self.entry = i
                continue
            v, at, top = self.x[i], [self.entry], len(self.links[self.entry]) - 1
            for lev in range(top, level, -1):
                at = [self._layer(v, at, 1, lev)[0][1]]
            for lev in range(min(top, level), -1, -1):
                found = self._layer(v, at, self.ef, lev)
                at = [j for _, j in found]
                most = 2 * self.m if lev == 0 else self.m
                self.links[i][lev] = self._spread(found, self.m)
                for j in self.links[i][lev]:
                    own = self.links[j][lev]
                    own.append(i)
                    if len(own) > most:
                        d = self._far(own, self.x[j])
                        self.links[j][lev] = self._spread(sorted(zip(d.tolist(), own, strict=True)), most)
            if level > top:
                self.entry = i

    def delete(self, keys) -> float:
        """Mark rows as deleted; the share of deleted rows."""
        gone = set(keys)
        self.gone |= {i for i, k in enumerate(self.keys) if k in gone}
        return len(self.gone) / max(1, len(self.keys))

    def rebuilt(self) -> HnswGraph:
        """A graph of the rows that are left."""
        g, live = HnswGraph(self.m, self.ef, self.metric), [i for i in range(len(self.keys)) if i not in self.gone]
        if live:
            g.add([self.keys[i] for i in live], self.x[live])
        return g

    def search(self, q, k: int, ef: int = 64) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        v, at = self._prepared(q), [self.entry]
        for lev in range(len(self.links[self.entry]) - 1, 0, -1):
            at = [self._layer(v, at, 1, lev)[0][1]]
        found = self._layer(v, at, max(ef, k) + len(self.gone), 0)
        return [(d, self.keys[i]) for d, i in found if i not in self.gone][:k]


GRAPHS = "part int, graph binary"


@dataclass
class Hnsw:
    """Graphs of about GRAPH_ROWS rows each, as bytes in a table; a query asks all and keeps the best.

    A key's hash names its graph, so changes meet it there: rows that have gone are masked (and a graph is built anew when
    their share passes a threshold), new rows are inserted. Only graphs with changes are written again.
    """

    graphs: DataFrame
    rows: DataFrame
    key: str
    column: str
    metric: str
    parts: int = 1

    @staticmethod
    def _dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
        return df.withColumn("part", F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(parts)).cast("int"))

    @staticmethod
    def build(df: DataFrame, key: str, column: str, metric: str = "COSENO", m: int = 32, ef: int = 40, folder: str | None = None) -> Hnsw:
        parts = max(1, -(-df.count() // GRAPH_ROWS))

        def graph(batch: pd.DataFrame) -> pd.DataFrame:
            batch, g = batch.sort_values("k"), HnswGraph(m, ef, metric)
            g.add(batch["k"].tolist(), np.stack(batch["v"].to_list()))
            return pd.DataFrame({"part": [int(batch["part"].iloc[0])], "graph": [pickle.dumps(g, protocol=5)]})

        rows = Hnsw._dealt(df, key, parts).select("part", F.col(key).cast("long").alias("k"), F.col(column).alias("v"))
        graphs = rows.groupBy("part").applyInPandas(graph, GRAPHS)
        if not folder:
            return Hnsw(graphs, df, key, column, metric, parts)
        graphs.write.mode("overwrite").parquet(folder)
        return Hnsw.load(df, key, column, metric, [folder], parts)

    @staticmethod
    def load(df: DataFrame, key: str, column: str, metric: str, folders: list[str], parts: int) -> Hnsw:
        """folders: the first build, then the graphs that each change has written again; the last one of a part counts."""
        spark, graphs = df.sparkSession, None
        for folder in folders:
            new = spark.read.schema(GRAPHS).parquet(folder)
            graphs = new if graphs is None else graphs.join(F.broadcast(new.select("part")), "part", "left_anti").unionByName(new)  # at most `parts` numbers
        return Hnsw(graphs, df, key, column, metric, parts)

    def change(self, new: DataFrame, gone: DataFrame, folder: str, threshold: float) -> None:
        """Write the graphs to which new rows (of the table) and keys that have gone belong."""
        m = Hnsw._dealt(new, self.key, self.parts).select("part", F.col(self.key).cast("long").alias("k"), F.col(self.column).alias("v"))
        changes = m.unionByName(Hnsw._dealt(gone, self.key, self.parts).select("part", F.col(self.key).cast("long").alias("k")), allowMissingColumns=True)
        metric = self.metric

        def changed(graphs: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(own):
                return pd.DataFrame({"part": pd.Series([], dtype="int32"), "graph": pd.Series([], dtype="object")})
            g = pickle.loads(graphs["graph"].iloc[0]) if len(graphs) else HnswGraph(metric=metric)
            out, fresh = own[own["v"].isna()], own[own["v"].notna()].sort_values("k")
            if g.delete(out["k"].tolist()) > threshold:
                g = g.rebuilt()
            if len(fresh):
                g.add(fresh["k"].tolist(), np.stack(fresh["v"].to_list()))
            return pd.DataFrame({"part": [int(own["part"].iloc[0])], "graph": [pickle.dumps(g, protocol=5)]})

        self.graphs.groupBy("part").cogroup(changes.groupBy("part")).applyInPandas(changed, GRAPHS).write.mode("overwrite").parquet(folder)

    def search(self, q: list[float], k: int, ef: int = 64) -> DataFrame:
        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for blob in b["graph"]:
                    yield pd.DataFrame(pickle.loads(blob).search(q, k, ef), columns=["d", "k"]).astype({"d": "float64", "k": "int64"})

        # The k best of all graphs (k rows each) are chosen first; the exact distance orders them.
        found = self.graphs.select("graph").mapInPandas(ask, "d double, k long").orderBy("d", "k").limit(k + 8)
        rows = self.rows.join(F.broadcast(found.select(F.col("k").alias(self.key))), self.key, "left_semi")
        return top_k(rows.withColumn("distance", vector.distance(F.col(self.column), q, self.metric)), F.col("distance"), self.key, k)

    def search_many(self, queries: DataFrame, query_key: str, column: str, k: int, ef: int = 64) -> DataFrame:
        """(query, key, distance, rank) for a query table: a graph is read once for each block of queries."""
        spark, parts, metric = self.graphs.sparkSession, [], self.metric
        for ids, q in query_blocks(queries, query_key, column):
            shared = spark.sparkContext.broadcast((ids, q))

            def ask(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                ids, q = shared.value
                for b in batches:
                    for blob in b["graph"]:
                        g = pickle.loads(blob)
                        for i, v in zip(ids.tolist(), q, strict=True):
                            found = g.search(v, k, ef)
                            at = [g.place[key] for _, key in found]
                            d = np.round(distances(v[None, :], g.x[at].astype(float), metric)[0], DECIMALS) if at else []
                            yield pd.DataFrame({"query": i, "key": [key for _, key in found], "distance": d}).astype({"query": "int64", "key": "int64", "distance": "float64"})

            parts.append(self.graphs.select("graph").mapInPandas(ask, FOUND))
        return _ranked(union_all(parts, spark, FOUND), k)


def recall(found: list[int], exact: list[int]) -> float:
    return len(set(found) & set(exact)) / max(1, len(exact))

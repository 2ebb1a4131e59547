"""Registered queries for the dialect's operators and the DuckDB SQL that checks them.

Each query runs over whole tables. Sums of doubles and scores are rounded on both sides, since engines add in different
orders. Decimal literals of the dialect are float32, hence the casts in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import spatial, vector
from quern.operators import ann, apps, media
from quern.operators.knn import batch_nearest, distance_range
from quern.operators.text_rank import TextIndex, precision_recall
from quern.functions.text import ACCENTED, PLAIN, STOPWORDS
from quern.session import Database, Session
from quern.sources.work import fresh_path, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# A fixed query vector of 64 components, and places derived from keys: the tables hold neither.
Q64 = [((i * 37) % 21 - 10) / 10 for i in range(64)]
VECTOR = "VECTOR(" + ", ".join(map(str, Q64)) + ")"
SQLVEC = "[" + ", ".join(f"CAST({x} AS FLOAT)::DOUBLE" for x in Q64) + "]"
LIMA = "POINT(-12.0464, -77.0428)"
PLACES = "(SELECT c_custkey, c_name, c_nationkey, -12000000 - (c_custkey * 7919) % 200000 AS lat, -77000000 - (c_custkey * 104729) % 200000 AS lon FROM customer)"
METRES = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(lat / 1e6) - radians(-12.0464)) / 2), 2) + cos(radians(lat / 1e6)) * cos(radians(-12.0464)) * pow(sin((radians(lon / 1e6) - radians(-77.0428)) / 2), 2))))"
TEXT_QUERY = "apache licenses, version"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def places(spark: SparkSession, sf: str) -> DataFrame:
    lat, lon = -12_000_000 - (F.col("c_custkey") * 7919) % 200_000, -77_000_000 - (F.col("c_custkey") * 104_729) % 200_000
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", spatial.point(lat, lon).alias("ubicacion"))


def session(spark: SparkSession, sf: str) -> Session:
    s = Session(spark, sf)
    s.attach("lugares", places(spark, sf), rtree=("ubicacion", "RTREE"))
    s.attach("documents", table(spark, sf, "documents"), key="doc_id", spimi=("text", "SPIMI"))
    return s


def dialect(name: str, sql: str, oracle: str | None, names: dict[str, str] | None = None, **digits: int) -> None:
    """Register a statement; names: labels that get another name; digits: columns to round (after renaming)."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = session(spark, sf).sql(sql).withColumnsRenamed(names or {})
        return df.withColumns({c: F.round(F.col(c).cast("double"), d) for c, d in digits.items()}) if digits else df

    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# --- scans, projection, filters
dialect("scan_all", "SELECT * FROM customer", "SELECT * FROM customer")
dialect("pk_lookup", "SELECT * FROM orders WHERE o_orderkey = 7", "SELECT * FROM orders WHERE o_orderkey = 7")
dialect("pk_range", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 900", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
dialect("index_eq", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 42", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 42")
dialect("index_range", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey >= 10 AND l_partkey < 20", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey >= 10 AND l_partkey < 20")
dialect("order_by_indexed", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC LIMIT 25", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
dialect("candidates_filter", "SELECT vec_id, label FROM embeddings WHERE vec_id BETWEEN 5 AND 9", "SELECT vec_id, label FROM embeddings WHERE vec_id BETWEEN 5 AND 9")
dialect("project", "SELECT p_name, p_size FROM part", "SELECT p_name, p_size FROM part")
dialect("star", "SELECT * FROM supplier WHERE s_acctbal > 0", "SELECT * FROM supplier WHERE s_acctbal > 0")
dialect("filter_ops", "SELECT p_partkey FROM part WHERE p_size != 3 AND p_size > 1 AND p_size <= 40 AND p_brand >= 'Brand#2'", "SELECT p_partkey FROM part WHERE p_size <> 3 AND p_size > 1 AND p_size <= 40 AND p_brand >= 'Brand#2'")
dialect("filter_float32", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.05", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > CAST(0.05 AS FLOAT)::DOUBLE")
dialect("filter_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
dialect("filter_empty_between", "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 50 AND 10", "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 50 AND 10")
dialect("filter_and", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 500 AND o_totalprice > 100", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 500 AND o_totalprice > 100")
dialect("qualified", "SELECT c.c_custkey, customer.c_name FROM customer AS c WHERE c.c_acctbal > 100 ORDER BY c.c_custkey", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 100")


@query("delete_complement", "SELECT * FROM orders WHERE NOT (o_custkey > 100 AND o_orderstatus = 'O')")
def delete_complement(spark, sf):
    """What DELETE FROM orders WHERE ... leaves: an anti join on the key."""
    from quern.plans.parser import parse

    low = session(spark, sf).lowering(parse("DELETE FROM orders WHERE o_custkey > 100 AND o_orderstatus = 'O'"))
    df = low.sides[0].frame
    return df.join(low.filtered(df, low.s.where).select("o_orderkey"), "o_orderkey", "left_anti")


# --- joins
JOIN = "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"
dialect("join_hash", f"SELECT o.o_orderkey, c.c_name {JOIN}", f"SELECT o_orderkey, c_name {JOIN}")
dialect("join_inl", "SELECT n.n_name, c.c_custkey FROM nation n JOIN customer c ON n.n_nationkey = c.c_nationkey", "SELECT n_name, c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey")
dialect("join_self", "SELECT a.l_orderkey, COUNT(*) AS pares FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey GROUP BY a.l_orderkey", "SELECT a.l_orderkey, count(*) AS pares FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey GROUP BY 1")
dialect("join_filtered", f"SELECT o.o_orderkey, c.c_custkey {JOIN} WHERE o.o_orderstatus = 'F' AND c.c_acctbal > 0", f"SELECT o_orderkey, c_custkey {JOIN} WHERE o_orderstatus = 'F' AND c_acctbal > 0")
dialect("join_group_topk", "SELECT c.c_mktsegment, COUNT(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment ORDER BY n DESC LIMIT 3", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY n DESC, c_mktsegment LIMIT 3")
dialect("join_geo_knn", f"SELECT l.c_custkey, n.n_name FROM lugares l JOIN nation n ON l.c_nationkey = n.n_nationkey ORDER BY distancia(l.ubicacion, {LIMA}) LIMIT 10", f"SELECT c_custkey, n_name FROM {PLACES} JOIN nation ON c_nationkey = n_nationkey ORDER BY {METRES} LIMIT 10")

# --- aggregates
dialect("group_by", "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS cantidad FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS cantidad FROM lineitem GROUP BY 1", cantidad=2)
dialect("agg_count_col", "SELECT o_orderstatus, COUNT(o_custkey) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(o_custkey) AS n FROM orders GROUP BY 1")
dialect("agg_sum", "SELECT o_custkey, SUM(o_totalprice) AS total, SUM(o_orderkey) AS claves FROM orders GROUP BY o_custkey", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total, CAST(sum(o_orderkey) AS BIGINT) AS claves FROM orders GROUP BY 1", total=2)
dialect("agg_avg", "SELECT p_brand, AVG(p_size) AS media FROM part GROUP BY p_brand", "SELECT p_brand, printf('%.2f', avg(p_size)) AS media FROM part GROUP BY 1")
dialect("agg_minmax", "SELECT c_mktsegment, MIN(c_acctbal) AS menor, MAX(c_acctbal) AS mayor FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, min(c_acctbal) AS menor, max(c_acctbal) AS mayor FROM customer GROUP BY 1")
dialect("agg_global", "SELECT COUNT(*) AS n, MIN(o_orderkey) AS a, MAX(o_orderkey) AS b, SUM(o_totalprice) AS s FROM orders", "SELECT count(*) AS n, min(o_orderkey) AS a, max(o_orderkey) AS b, round(sum(o_totalprice), 1) AS s FROM orders", s=1)
dialect("agg_empty", "SELECT COUNT(*) AS n, SUM(o_custkey) AS s, MAX(o_custkey) AS m FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, max(o_custkey) AS m FROM orders WHERE o_orderkey < 0")
dialect("agg_default_labels", "SELECT c_mktsegment, COUNT(*) FROM customer GROUP BY c_mktsegment", 'SELECT c_mktsegment, count(*) AS "COUNT(*)" FROM customer GROUP BY 1')
dialect("distinct_via_group", "SELECT p_type FROM part GROUP BY p_type", "SELECT DISTINCT p_type FROM part")
dialect("agg_multi", "SELECT COUNT(*) AS n, MIN(l_tax) AS a, MAX(l_tax) AS b, AVG(l_quantity) AS m FROM lineitem GROUP BY l_linestatus", "SELECT count(*) AS n, min(l_tax) AS a, max(l_tax) AS b, printf('%.2f', avg(l_quantity)) AS m FROM lineitem GROUP BY l_linestatus")
dialect("group_text_order", "SELECT p_size, COUNT(*) AS n FROM part GROUP BY p_size LIMIT 5", "SELECT p_size, count(*) AS n FROM part GROUP BY 1 ORDER BY CAST(p_size AS VARCHAR) LIMIT 5")


@query("group_point", f"SELECT lat, lon, count(*) AS n FROM {PLACES} GROUP BY 1, 2")
def group_point(spark, sf):
    df = session(spark, sf).sql("SELECT ubicacion, COUNT(*) AS n FROM lugares GROUP BY ubicacion")
    return df.select(F.col("ubicacion.lat_e6").cast("long").alias("lat"), F.col("ubicacion.lon_e6").cast("long").alias("lon"), "n")


# --- order and limit


def numbered(name: str, sql: str, oracle: str) -> None:
    """Register a statement whose rows carry their place, so that the order counts: each task's rows are numbered as they
    come, after the rows of the tasks before it (a global sort leaves them in ranges). The sorted rows are written with
    task and number first: a plan that sorts twice can cut the ranges differently."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = session(spark, sf).sql(sql)
        tagged = materialize(df.withColumn("__at", F.monotonically_increasing_id()), name)  # task << 33 | number in the task
        task = F.shiftright("__at", 33)
        sizes = tagged.groupBy(task.alias("__task")).agg(F.count(F.lit(1)).alias("__n"))
        before = sizes.select("__task", (F.sum("__n").over(Window.orderBy("__task")) - F.col("__n")).alias("__before"))  # one row a task
        own = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
        return tagged.withColumn("__task", task).join(F.broadcast(before), "__task").select(*df.columns, (F.col("__before") + own).alias("place"))

    QUERIES[name], ORACLES[name] = run, oracle


numbered("scan_pk_order", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders")
numbered("order_by", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC", "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer")
dialect("order_hidden", "SELECT p_name FROM part ORDER BY p_retailprice LIMIT 7", "SELECT p_name FROM part ORDER BY p_retailprice, p_partkey LIMIT 7")
dialect("order_alias", "SELECT o_custkey, COUNT(*) AS Veces FROM orders GROUP BY o_custkey ORDER BY veces DESC LIMIT 12", 'SELECT o_custkey, count(*) AS "Veces" FROM orders GROUP BY 1 ORDER BY 2 DESC, CAST(o_custkey AS VARCHAR) LIMIT 12')
dialect("order_avg_text", "SELECT p_brand, AVG(p_size) AS m FROM part GROUP BY p_brand ORDER BY m LIMIT 5", "SELECT p_brand, printf('%.2f', avg(p_size)) AS m FROM part GROUP BY 1 ORDER BY m, p_brand LIMIT 5")
dialect("limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 40", "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 40")
dialect("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0", "SELECT o_orderkey FROM orders LIMIT 0")

# --- places
dialect("geo_radius", f"SELECT c_custkey FROM lugares WHERE distancia(ubicacion, {LIMA}) < 6000", f"SELECT c_custkey FROM {PLACES} WHERE {METRES} < 6000")
dialect("geo_radius_outside", f"SELECT c_custkey FROM lugares WHERE distancia(ubicacion, {LIMA}) >= 15000", f"SELECT c_custkey FROM {PLACES} WHERE {METRES} >= 15000")
dialect("geo_euclidean", f"SELECT c_custkey FROM lugares WHERE distancia(ubicacion, {LIMA}, 'euclidiana') <= 7000", f"SELECT c_custkey FROM {PLACES} WHERE sqrt(pow(radians(lat / 1e6) - radians(-12.0464), 2) + pow(radians(lon / 1e6) - radians(-77.0428), 2)) * 6371000 <= 7000")
dialect("geo_polygon", "SELECT c_custkey FROM lugares WHERE dentro(ubicacion, POLYGON((-12.13 -77.15, -12.13 -77.02, -12.03 -77.02, -12.03 -77.15)))", f"SELECT c_custkey FROM {PLACES} WHERE lat BETWEEN -12130000 AND -12030000 AND lon BETWEEN -77150000 AND -77020000")
# An L: a box without its upper right corner; the inner border belongs to it.
dialect("geo_polygon_concave", "SELECT c_custkey FROM lugares WHERE dentro(ubicacion, POLYGON((-12.19 -77.19, -12.19 -77.01, -12.11 -77.01, -12.11 -77.11, -12.01 -77.11, -12.01 -77.19)))", f"SELECT c_custkey FROM {PLACES} WHERE lat BETWEEN -12190000 AND -12010000 AND lon BETWEEN -77190000 AND -77010000 AND (lat <= -12110000 OR lon <= -77110000)")
dialect("geo_order", f"SELECT c_custkey FROM lugares ORDER BY distancia(ubicacion, {LIMA}) LIMIT 100", f"SELECT c_custkey FROM {PLACES} ORDER BY rint_mm, c_custkey LIMIT 100".replace("rint_mm", f"round({METRES} * 1000)"))
dialect("geo_knn", f"SELECT c_custkey, c_name FROM lugares ORDER BY distancia(ubicacion, {LIMA}) LIMIT 5", f"SELECT c_custkey, c_name FROM {PLACES} ORDER BY {METRES} LIMIT 5")


@query("geo_distance", f"SELECT c_custkey, round({METRES}, 3) AS metres FROM {PLACES}")
def geo_distance(spark, sf):
    return places(spark, sf).select("c_custkey", F.round(spatial.distance_m(F.col("ubicacion"), -12_046_400, -77_042_800), 3).alias("metres"))


# --- vectors
L2 = f"list_distance(embedding::DOUBLE[], {SQLVEC})"
IP = f"-list_inner_product(embedding::DOUBLE[], {SQLVEC})"
COS = f"(1 - list_inner_product(embedding::DOUBLE[], {SQLVEC}) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product({SQLVEC}, {SQLVEC}))))"
dialect("vec_range", f"SELECT vec_id FROM embeddings WHERE distancia(embedding, {VECTOR}, 'coseno') < 0.9", f"SELECT vec_id FROM embeddings WHERE {COS} < CAST(0.9 AS FLOAT)::DOUBLE")
for _name, _metric, _sql in (("l2", "euclidiana", L2), ("ip", "producto_punto", IP), ("cos", "coseno", COS)):
    dialect(f"vec_knn_{_name}", f"SELECT vec_id FROM embeddings ORDER BY distancia(embedding, {VECTOR}, '{_metric}') LIMIT 10", f"SELECT vec_id FROM embeddings ORDER BY CAST({_sql} AS FLOAT), vec_id LIMIT 10")
dialect("vec_order", f"SELECT vec_id FROM embeddings ORDER BY distancia(embedding, {VECTOR}) DESC LIMIT 50", f"SELECT vec_id FROM embeddings ORDER BY CAST({L2} AS FLOAT) DESC, vec_id LIMIT 50")
dialect("vec_knn_filtered", f"SELECT vec_id, label FROM embeddings WHERE label < 5 ORDER BY distancia(embedding, {VECTOR}) LIMIT 8", f"SELECT vec_id, label FROM embeddings WHERE label < 5 ORDER BY CAST({L2} AS FLOAT), vec_id LIMIT 8")
dialect("similar_to", f"SELECT vec_id FROM embeddings WHERE SIMILAR_TO({VECTOR}, k = 6)", f"SELECT vec_id FROM embeddings ORDER BY {COS}, vec_id LIMIT 6")
dialect("similar_prefilter", f"SELECT vec_id, label FROM embeddings WHERE SIMILAR_TO(embedding, {VECTOR}, k = 6) AND label >= 4", f"SELECT vec_id, label FROM embeddings WHERE label >= 4 ORDER BY {COS}, vec_id LIMIT 6")
dialect("similarity_score", f"SELECT vec_id, SIMILARITY_SCORE() FROM embeddings WHERE SIMILAR_TO({VECTOR}, k = 9) WITH METRIC = l2", f"SELECT vec_id, round(1 / (1 + {L2}), 5) AS score FROM embeddings ORDER BY {L2}, vec_id LIMIT 9", score=5)
dialect("similar_then_order", f"SELECT vec_id, SIMILARITY_SCORE() AS s FROM embeddings WHERE SIMILAR_TO({VECTOR}, k = 9) ORDER BY s ASC LIMIT 4", f"SELECT vec_id, round(1 - d, 5) AS s FROM (SELECT vec_id, {COS} AS d FROM embeddings ORDER BY d, vec_id LIMIT 9) ORDER BY d DESC, vec_id LIMIT 4", s=5)
dialect("similar_then_group", f"SELECT label, COUNT(*) AS n FROM embeddings WHERE SIMILAR_TO({VECTOR}, k = 40) GROUP BY label", f"SELECT label, count(*) AS n FROM (SELECT label FROM embeddings ORDER BY {COS}, vec_id LIMIT 40) GROUP BY 1")


@query("vec_normalize", "SELECT vec_id, round(sqrt(list_inner_product(u, u)), 4) AS length FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)")
def vec_normalize(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(vector.norm(vector.normalized(F.col("embedding"))), 4).alias("length"))


@query("ivf_all_lists", f"SELECT vec_id, round({COS}, 5) AS distance FROM embeddings ORDER BY {COS}, vec_id LIMIT 10")
def ivf_all_lists(spark, sf):
    """IVF with every list probed is exact."""
    index = ann.Ivf.build(table(spark, sf, "embeddings"), "vec_id", "embedding", nlist=16)
    return index.search(Q64, 10, nprobe=16).select("vec_id", F.round("distance", 5).alias("distance"))


def _recall(spark, sf, found: DataFrame) -> DataFrame:
    """Whether an index finds nine tenths of the exact ten nearest of every vector whose id is divisible by 50."""
    v = table(spark, sf, "embeddings")
    exact = batch_nearest(v, v.where("vec_id % 50 = 0"), "embedding", "vec_id", "vec_id", 10).select("query", "key")
    both = exact.join(found.select("query", "key", F.lit(1).alias("hit")), ["query", "key"], "left")
    return both.agg(F.count_distinct("query").alias("queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("recall_reached"))


RECALL = "SELECT count(*) AS queries, true AS recall_reached FROM embeddings WHERE vec_id % 50 = 0"


@query("ivf_knn", RECALL)
def ivf_knn(spark, sf):
    v = table(spark, sf, "embeddings")
    index = ann.Ivf.build(v, "vec_id", "embedding", nlist=16, folder=fresh_path(spark, "ivf"))
    return _recall(spark, sf, index.search_many(v.where("vec_id % 50 = 0"), "vec_id", "embedding", 10, nprobe=12))


@query("hnsw_knn", RECALL)
def hnsw_knn(spark, sf):
    v = table(spark, sf, "embeddings")
    index = ann.Hnsw.build(v, "vec_id", "embedding", folder=fresh_path(spark, "hnsw"))
    return _recall(spark, sf, index.search_many(v.where("vec_id % 50 = 0"), "vec_id", "embedding", 10, ef=256))


@query("similar_postfilter", f"SELECT vec_id, label FROM (SELECT vec_id, label FROM embeddings ORDER BY {COS}, vec_id LIMIT 20) WHERE label < 5")
def similar_postfilter(spark, sf):
    """With an index the k nearest come first and the condition after them; all lists are probed, so the answer is exact."""
    s = Session(spark, sf)
    s.attach("embeddings", table(spark, sf, "embeddings"), ivf=("embedding", "IVF"))
    s.table("embeddings").indexes[0].options = {"nlist": "16", "nprobe": "16", "metrica": "COSENO"}
    return s.sql(f"SELECT vec_id, label FROM embeddings WHERE SIMILAR_TO({VECTOR}, k = 20) AND label < 5 USING IVF")


@query("candidates", f"SELECT vec_id, round(1 - {COS}, 5) AS score FROM embeddings WHERE vec_id IN (3, 8, 5, 13) AND label >= 0", )
def candidates(spark, sf):
    s = Session(spark, sf)
    s.attach("embeddings", table(spark, sf, "embeddings"), hnsw=("embedding", "HNSW"))
    s.table("embeddings").indexes[0].options = {"ef_busqueda": "64", "metrica": "COSENO"}
    df = s.sql(f"SELECT vec_id, SIMILARITY_SCORE() FROM embeddings WHERE SIMILAR_TO({VECTOR}, k = 9) AND label >= 0 USING HNSW CANDIDATES (3, 8, 5, 999999, 13)")
    return df.select("vec_id", F.round(F.col("score").cast("double"), 5).alias("score"))


PAIRS = "SELECT q.vec_id AS query, r.vec_id AS key, r.label AS label, 1 - list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(r.embedding::DOUBLE[], r.embedding::DOUBLE[]))) AS d FROM embeddings q JOIN embeddings r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id"
TOP5 = f"SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, key) AS rank FROM ({PAIRS}) QUALIFY rank <= 5"


def _top5(spark, sf) -> DataFrame:
    """The five nearest other vectors of every vector whose id is divisible by 50."""
    v = table(spark, sf, "embeddings")
    found = batch_nearest(v, v.where("vec_id % 50 = 0"), "embedding", "vec_id", "vec_id", 6).where("query <> key")
    again = Window.partitionBy("query").orderBy("distance", "key")
    return found.withColumn("rank", F.row_number().over(again)).where("rank <= 5")


@query("knn_batch", f"SELECT query, key, CAST(rank AS INT) AS rank, round(d, 5) AS distance FROM ({TOP5})")
def knn_batch(spark, sf):
    return _top5(spark, sf).select("query", "key", "rank", F.round("distance", 5).alias("distance"))


@query("segment_vote", f"WITH v AS (SELECT label, query, max(1 - d) AS score FROM ({TOP5}) WHERE 1 - d >= 0.1 GROUP BY 1, 2) SELECT label, count(*) AS segments, round(max(score), 5) AS best FROM v GROUP BY 1 HAVING count(*) >= 2")
def segment_vote(spark, sf):
    songs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), "label")
    matches = _top5(spark, sf).join(songs, "key").select(F.col("query").alias("segment"), "label", (1 - F.col("distance")).alias("score"), "rank")
    return apps.segment_votes(matches, "label", threshold=0.1).select("label", "segments", F.round("best", 5).alias("best"))


@query(
    "dimension_contrast",
    "WITH d AS (SELECT q.vec_id AS query, list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS d FROM embeddings q JOIN embeddings r ON q.vec_id % 50 = 0), c AS (SELECT query, (max(d) - min(d)) / min(d) AS c FROM d WHERE d > 1e-9 GROUP BY 1) SELECT count(*) AS queries, round(median(c), 4) AS contrast FROM c",
)
def dimension_contrast(spark, sf):
    v = table(spark, sf, "embeddings")
    ends = distance_range(v, v.where("vec_id % 50 = 0"), "embedding", "vec_id", "vec_id")
    return media.contrast(ends).select("queries", F.round("contrast", 4).alias("contrast"))


# --- text
_words = ", ".join(f"'{w}'" for w in STOPWORDS)
TOKENS = f"SELECT doc_id, list_filter(list_transform(regexp_extract_all(translate(replace(text, 'ß', 'ss'), '{ACCENTED}', '{PLAIN}'), '[A-Za-z]+'), lambda x: lower(x)), lambda x: x NOT IN ({_words})) AS ts FROM documents"
FORMS = "VALUES ('apache', 'apach'), ('license', 'licens'), ('licenses', 'licens'), ('licensed', 'licens'), ('licensing', 'licens'), ('version', 'version'), ('versions', 'version')"
BM25 = f"""
WITH t AS ({TOKENS}), c AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM t), f(token, term) AS ({FORMS}),
p AS (SELECT doc_id, len(ts) AS l, unnest(ts) AS token FROM t), h AS (SELECT doc_id, l, term, count(*) AS tf FROM p JOIN f USING (token) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM h GROUP BY 1)
SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS score FROM h JOIN d USING (term), c GROUP BY 1
"""
dialect("match_bm25", f"SELECT doc_id, SCORE() FROM documents WHERE MATCH(text, '{TEXT_QUERY}') USING BM25", f"SELECT doc_id, round(score, 3) AS score FROM ({BM25})", score=3)
dialect("match_filtered", f"SELECT doc_id, lang FROM documents WHERE MATCH(text, '{TEXT_QUERY}') AND lang = 'en' USING BM25", f"SELECT doc_id, lang FROM ({BM25}) JOIN documents USING (doc_id) WHERE lang = 'en'")
dialect("match_tfidf", f"SELECT doc_id, SCORE() FROM documents WHERE MATCH(text, '{TEXT_QUERY}') USING TF_IDF", None)


@query(
    "tfidf_nostem",
    f"""WITH t AS ({TOKENS}), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM t) GROUP BY ALL),
    w AS (SELECT doc_id, sqrt(sum(pow(1 + log10(tf), 2))) AS norm FROM p GROUP BY 1), n AS (SELECT count(*) AS n FROM t),
    q AS (SELECT term, log10(n / count(*)) AS w FROM p, n WHERE term IN ('apache', 'license', 'version') GROUP BY term, n)
    SELECT doc_id, round(sum((1 + log10(tf)) / norm * q.w) / (SELECT sqrt(sum(w * w)) FROM q), 5) AS score FROM p JOIN q USING (term) JOIN w USING (doc_id) GROUP BY 1""",
)
def tfidf_nostem(spark, sf):
    index = TextIndex.build(table(spark, sf, "documents"), "doc_id", "text", stemmed=False)
    return index.scores("apache license version", "TF_IDF").select(F.col("id").alias("doc_id"), F.round("score", 5).alias("score"))


@query("postings", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM ({TOKENS})) GROUP BY ALL")
def postings(spark, sf):
    return TextIndex.build(table(spark, sf, "documents"), "doc_id", "text", stemmed=False).postings.select(F.col("id").alias("doc_id"), "term", "tf")


@query("ir_quality", f"WITH r AS (SELECT doc_id FROM ({BM25}) ORDER BY score DESC, doc_id LIMIT 10), g AS (SELECT doc_id FROM documents WHERE lang = 'en' AND text ILIKE '%apache%') SELECT 1 AS query, round((SELECT count(*) FROM r JOIN g USING (doc_id)) / 10.0, 4) AS precision, round((SELECT count(*) FROM r JOIN g USING (doc_id)) / (SELECT count(*)::DOUBLE FROM g), 4) AS recall, round(least(10, (SELECT count(*) FROM g)) / (SELECT count(*)::DOUBLE FROM g), 4) AS ceiling")
def ir_quality(spark, sf):
    docs = table(spark, sf, "documents")
    found = session(spark, sf).text_scores(session(spark, sf).table("documents"), "text", TEXT_QUERY, "BM25").orderBy(F.desc("score"), "id").limit(10)
    ranked = found.select(F.lit(1).alias("query"), "id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))
    relevant = docs.where("lang = 'en' AND text ILIKE '%apache%'").select(F.lit(1).alias("query"), F.col("doc_id").alias("id"))
    return precision_recall(ranked, relevant).select("query", *(F.round(c, 4).alias(c) for c in ("precision", "recall", "ceiling")))


# --- applications
def _lists(spark, sf) -> DataFrame:
    part, out = table(spark, sf, "part"), None
    for name, order in (("price", F.desc("p_retailprice")), ("size", F.desc("p_size")), ("name", F.asc("p_name"))):
        best = part.orderBy(order, "p_partkey").limit(20).select(F.lit(name).alias("source"), F.col("p_partkey").alias("id"), F.row_number().over(Window.orderBy(order, "p_partkey")).alias("rank"))
        out = best if out is None else out.unionByName(best)
    return out


_LISTS = " UNION ALL ".join(f"(SELECT p_partkey AS id, row_number() OVER (ORDER BY {o}, p_partkey) AS rank FROM part ORDER BY {o}, p_partkey LIMIT 20)" for o in ("p_retailprice DESC", "p_size DESC", "p_name"))


@query("rrf", f"SELECT id, round(sum(1.0 / (60 + rank)), 8) AS rrf, CAST(min(rank) AS INT) AS best_rank FROM ({_LISTS}) GROUP BY 1")
def rrf(spark, sf):
    return apps.fuse(_lists(spark, sf)).select("id", F.round("rrf", 8).alias("rrf"), "best_rank")


BASKET = "SELECT DISTINCT o_custkey AS u, l_partkey AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


def _purchases(spark, sf) -> DataFrame:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select("o_custkey", "l_partkey")


@query("also_bought", f"WITH b AS ({BASKET}) SELECT i AS item, count(*) AS buyers FROM b WHERE i <> 1 AND u IN (SELECT u FROM b WHERE i = 1) GROUP BY 1")
def also_bought(spark, sf):
    return apps.also_bought(_purchases(spark, sf), "o_custkey", "l_partkey", 1)


RECOMMEND = f"""
WITH me AS (SELECT * FROM documents WHERE doc_id = 1), b AS ({BASKET}),
l AS (
  SELECT * FROM (SELECT 'text' AS source, doc_id AS id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({BM25}) WHERE score > 0) WHERE rank <= 21
  UNION ALL SELECT * FROM (SELECT 'image', r.vec_id, row_number() OVER (ORDER BY round(1 - list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(r.embedding::DOUBLE[], r.embedding::DOUBLE[]))), 9), r.vec_id) AS rank FROM embeddings q JOIN embeddings r ON q.vec_id = 1) WHERE rank <= 21
  UNION ALL SELECT * FROM (SELECT 'metadata', d.doc_id, row_number() OVER (ORDER BY CASE WHEN d.source = me.source THEN 2 ELSE 0 END + CASE WHEN d.n_chars = me.n_chars THEN 1 ELSE 0 END DESC, d.doc_id) AS rank FROM documents d JOIN me ON d.lang = me.lang AND d.doc_id <> 1) WHERE rank <= 20
  UNION ALL SELECT * FROM (SELECT 'purchases', i, row_number() OVER (ORDER BY count(*) DESC, i) AS rank FROM b WHERE i <> 1 AND u IN (SELECT u FROM b WHERE i = 1) GROUP BY i) WHERE rank <= 20
), c AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY rank, id) AS rank FROM l WHERE id <> 1 QUALIFY rank <= 20)
SELECT CAST(id AS BIGINT) AS id, round(sum(1.0 / (60 + rank)), 8) AS rrf, CAST(min(rank) AS INT) AS best_rank FROM c GROUP BY id ORDER BY sum(1.0 / (60 + rank)) DESC, min(rank), id LIMIT 10
"""


@query("recommend", RECOMMEND)
def recommend(spark, sf):
    """Text, image, metadata and purchases fused for item 1; documents stand for products."""
    docs = table(spark, sf, "documents")
    text = lambda _: session(spark, sf).text_scores(session(spark, sf).table("documents"), "text", TEXT_QUERY, "BM25")
    best, _ = apps.recommender(1, docs, "doc_id", text, table(spark, sf, "embeddings"), "vec_id", "embedding", "lang", "source", "n_chars", _purchases(spark, sf), "o_custkey", "l_partkey")
    return best.select("id", F.round("rrf", 8).alias("rrf"), "best_rank")


@query("catalog_search", f"SELECT doc_id, round(score, 6) AS score, count(*) OVER () AS total FROM ({BM25}) JOIN documents USING (doc_id) WHERE lang = 'en' AND n_chars BETWEEN 200 AND 5000 ORDER BY round(score, 9) DESC, doc_id LIMIT 12 OFFSET 12")
def catalog_search(spark, sf):
    """The second page of a search with a kind and a range; documents stand for products, their size for the price."""
    scores = session(spark, sf).text_scores(session(spark, sf).table("documents"), "text", TEXT_QUERY, "BM25")
    hits, total, _ = apps.catalog_search(table(spark, sf, "documents"), "doc_id", scores, "lang", "n_chars", "en", 200, 5000, 2)
    return hits.join(F.broadcast(total)).select("doc_id", F.round("score", 6).alias("score"), "total")  # total is one row


@query("metadata_rank", "SELECT p_partkey, CAST(CASE WHEN p_brand = (SELECT p_brand FROM part WHERE p_partkey = 1) THEN 2 ELSE 0 END + CASE WHEN p_size = (SELECT p_size FROM part WHERE p_partkey = 1) THEN 1 ELSE 0 END AS INT) AS points FROM part WHERE p_partkey <> 1 AND p_type = (SELECT p_type FROM part WHERE p_partkey = 1)")
def metadata_rank(spark, sf):
    part = table(spark, sf, "part")
    like = part.where("p_partkey = 1").first().asDict()
    return apps.metadata_candidates(part, "p_partkey", like, "p_type", "p_brand", "p_size").select("p_partkey", "points")


@query("facets", "SELECT p_type, count(*) AS n FROM part WHERE p_retailprice < 1500 GROUP BY 1 ORDER BY n DESC, p_type LIMIT 40")
def facets(spark, sf):
    return apps.facets(table(spark, sf, "part").where("p_retailprice < 1500"), "p_type")


@query("catalog_page", "SELECT p_partkey, p_name FROM part WHERE p_size > 10 ORDER BY p_retailprice, p_partkey LIMIT 12 OFFSET 12")
def catalog_page(spark, sf):
    return apps.page(table(spark, sf, "part").where("p_size > 10"), [F.asc("p_retailprice"), F.asc("p_partkey")], 2).select("p_partkey", "p_name")


@query("branches_with_stock", f"SELECT c_custkey AS branch, stock, CAST(round(metres) AS BIGINT) AS metres FROM (SELECT o_custkey, count(*) AS stock FROM orders WHERE o_orderkey % 10 > 2 AND o_custkey % 3 = 1 GROUP BY 1) JOIN (SELECT *, {METRES} AS metres FROM {PLACES}) ON o_custkey = c_custkey ORDER BY round(metres * 1000), branch LIMIT 8")
def branches_with_stock(spark, sf):
    """Customers stand for branches, their key modulo 3 for the product, their orders for its stock."""
    stock = table(spark, sf, "orders").where("o_orderkey % 10 > 2").groupBy(F.col("o_custkey").alias("branch")).agg(F.count(F.lit(1)).alias("stock")).withColumn("product", F.col("branch") % 3)
    branches = places(spark, sf).select(F.col("c_custkey").alias("branch"), F.col("ubicacion").alias("location"))
    return apps.nearest_with_stock(stock, branches, 1, -12_046_400, -77_042_800, 8).select("branch", "stock", F.round("metres").cast("long").alias("metres"))


@query("segment_starts", "WITH t AS (SELECT o_orderkey, (o_orderkey % 60) + 0.25 AS s FROM orders), g AS (SELECT o_orderkey, s, unnest(range(0, greatest(1, CAST(floor((s - 9.5) / 5) AS BIGINT) + 1))) AS i FROM t) SELECT o_orderkey, CAST(i * 5 AS DOUBLE) AS \"start\", CAST(least(i * 5 + 10, s) AS DOUBLE) AS \"end\" FROM g")
def segment_starts(spark, sf):
    tracks = table(spark, sf, "orders").select("o_orderkey", ((F.col("o_orderkey") % 60) + 0.25).alias("s"))
    return apps.segment_starts(tracks, "o_orderkey", "s")


@query("pr_f1", "WITH c AS (SELECT (doc_id * 37) % 101 AS score, quality = 1 AS positive FROM labels), t AS (SELECT unnest(range(50, 100)) AS threshold), m AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND positive) AS tp, count(*) FILTER (WHERE score >= threshold) AS f, count(*) FILTER (WHERE positive) AS p FROM c, t GROUP BY 1) SELECT CAST(threshold AS INT) AS threshold, round(coalesce(tp / nullif(f, 0), 0), 6) AS precision, round(coalesce(tp / nullif(p, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(f + p, 0), 0), 6) AS f1 FROM m")
def pr_f1(spark, sf):
    cases = table(spark, sf, "labels").select(((F.col("doc_id") * 37) % 101).alias("score"), (F.col("quality") == 1).alias("positive"))
    return apps.threshold_curve(cases).select("threshold", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("bow_tfidf", "WITH h AS (SELECT l_orderkey AS id, l_partkey % 256 AS word, count(*) AS n FROM lineitem GROUP BY ALL), d AS (SELECT word, count(*) AS df FROM h GROUP BY 1), c AS (SELECT count(DISTINCT id) AS m FROM h), w AS (SELECT id, word, (1 + ln(n)) * (ln((m + 1) / (df + 1)) + 1) AS w FROM h JOIN d USING (word), c) SELECT id, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 5) AS weight FROM w")
def bow_tfidf(spark, sf):
    h = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 256).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return media.bow_tfidf(h).select("id", "word", F.round("weight", 5).alias("weight"))


@query("codebook_histogram", "SELECT label AS id, count(*) AS descriptors, true AS known_words FROM embeddings GROUP BY 1")
def codebook_histogram(spark, sf):
    """Every descriptor is counted under one of the codebook's words; which ones the codebook has, SQL cannot say."""
    d = table(spark, sf, "embeddings").select(F.col("label").alias("id"), F.col("embedding").alias("descriptor"))
    h = media.quantized(d, media.codebook(d, words=16))
    return h.groupBy("id").agg(F.sum("n").alias("descriptors"), F.bool_and(F.col("word").between(0, 15)).alias("known_words"))


@query("zscore", "SELECT event_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-6), 4) AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def zscore(spark, sf):
    return media.zscored(table(spark, sf, "events"), "event_type", "value").select("event_id", F.round("z", 4).alias("z"))


def _values(name: str, rows: list[tuple]) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) v({name})"


PLAN = [
    "Limit", "  -> Sort", "     Sort Key: o_orderkey", "    -> Hash Join", "       Hash Cond: o.o_custkey = c.c_custkey", "      -> Filter",
    "         Filter: o.o_custkey BETWEEN 3 AND 9", "        -> Seq Scan on orders", "      -> Seq Scan on customer",
]


@query("explain", _values("plan", [(x,) for x in PLAN]))
def explain(spark, sf):
    """The plan of a join, without estimates and timings."""
    out = session(spark, sf).sql(f"EXPLAIN SELECT o.o_orderkey, c.c_name {JOIN} WHERE o.o_custkey BETWEEN 3 AND 9 ORDER BY o_orderkey LIMIT 4")
    return out.where(~F.col("plan").contains("Time:")).select(F.regexp_replace("plan", r"  \(cost=.*\)$", "").alias("plan"))


@query("describe", _values("columna, tipo, clave, indice", [("doc_id", "INT", "PK", ""), ("text", "VARCHAR", "", "spimi (SPIMI)"), ("lang", "VARCHAR", "", ""), ("source", "VARCHAR", "", ""), ("n_chars", "INT", "", "")]))
def describe(spark, sf):
    return session(spark, sf).execute("DESCRIBE documents").df


@query("show_tables", "SELECT 'ciudades' AS tabla, 'BPLUS' AS organizacion, 'id' AS clave, 2 AS columnas, CAST(25 AS BIGINT) AS registros, 'PRIMARY(id), por_nombre(nombre)' AS indices")
def show_tables(spark, sf):
    """A database with one table, loaded from the nations."""
    s = Session(Database(spark, fresh_path(spark, "db")))
    s.execute("CREATE TABLE ciudades (id INT PRIMARY KEY, nombre VARCHAR(25)) USING BPLUS")
    path = fresh_path(spark, "csv")
    table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("nombre")).coalesce(1).write.option("header", True).csv(path)
    s.execute(f"COPY ciudades FROM FILE '{path}'")
    s.execute("CREATE INDEX por_nombre ON ciudades (nombre) USING HASH")
    return s.execute("SHOW TABLES").df.select("tabla", "organizacion", "clave", "columnas", "registros", "indices")


FLAGSHIP = "SELECT y.n_name, COUNT(*) AS n, SUM(x.c_acctbal) AS s FROM customer x JOIN nation y ON x.c_nationkey = y.n_nationkey WHERE x.c_acctbal > 0 GROUP BY y.n_name ORDER BY n DESC LIMIT 10"
dialect("flagship", FLAGSHIP, "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1 ORDER BY n DESC, n_name LIMIT 10", s=2)

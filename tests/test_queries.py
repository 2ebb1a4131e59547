"""Every registered query of the dialect against its DuckDB SQL, and the functions against hand-computed values."""

import math
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import queries
from quern.errors import QuernError
from quern.functions import spatial, text, vector
from quern.functions.numbers import fixed2, float_text
from quern.operators import ann, apps, media
from quern.operators.text_rank import TextIndex

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in queries.ORACLES:
        assert got
        return
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(("word", "expected"), [("cars", "car"), ("running", "run"), ("fast", "fast"), ("ties", "tie"), ("feed", "fe"), ("need", "ne"), ("speed", "spe"), ("caresses", "caress"), ("is", "is")])
def test_stems(word, expected):
    assert text.stem(word) == expected


@pytest.mark.parametrize(("x", "expected"), [(12, "12"), (1e-5, "1e-05"), (350, "350"), (100000, "1e+05"), (0.1, "0.1"), (-3, "-3"), (1e-3, "0.001")])
def test_float_text(x, expected):
    assert float_text(x) == expected


def test_two_decimals_round_the_binary_value(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (None,)], "x double")
    assert [r[0] for r in df.select(fixed2(F.col("x"))).collect()] == ["0.12", "2.67", None]


def test_haversine_golden(spark):
    p = spark.range(1).select(spatial.point(-12_097_700, -77_036_500).alias("p"))
    assert p.select(spatial.distance_m(F.col("p"), -12_046_400, -77_042_800)).first()[0] == pytest.approx(5745.3, abs=0.1)


def test_polygon_against_brute_force(spark):
    ring = [(0, 0), (0, 10), (4, 10), (4, 4), (10, 4), (10, 0)]
    grid = [(a, b) for a in range(-1, 12) for b in range(-1, 12)]
    df = spark.createDataFrame(grid, "a int, b int").where(spatial.inside(spatial.point(F.col("a"), F.col("b")), ring))
    want = {(a, b) for a, b in grid if (0 <= a <= 4 and 0 <= b <= 10) or (0 <= a <= 10 and 0 <= b <= 4)}
    assert {(r["a"], r["b"]) for r in df.collect()} == want


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    for q in ([1.0, 0.0], F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float"))):
        assert [r[0] for r in df.select(vector.distance(F.col("v"), q, "COSENO")).collect()] == pytest.approx([1.0, 0.4])
    assert df.select(vector.distance(F.col("v"), [0.0, 0.0], "COSENO")).first()[0] == 1.0


def test_hnsw_recall_and_deletes():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(800, 16)).astype(np.float32)
    g = ann.HnswGraph(16, 40, "EUCLIDIANA")
    g.add(range(500), x[:500]), g.add(range(500, 800), x[500:])
    exact = lambda q, ids: [int(i) for i in ids[np.argsort(((x[ids] - q) ** 2).sum(1))[:10]]]
    every = np.arange(800)
    assert np.mean([ann.recall([k for _, k in g.search(q, 10, 64)], exact(q, every)) for q in x[:50] + 0.01]) >= 0.9
    assert g.delete(range(100)) == pytest.approx(0.125)
    found = [k for _, k in g.search(x[5], 10, 64)]
    assert min(found) >= 100 and ann.recall(found, exact(x[5], every[100:])) >= 0.8


def test_ivf_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 8)) * 5
    x = [(i, (centres[i % 10] + rng.normal(size=8)).tolist()) for i in range(400)]
    df = spark.createDataFrame(x, "id long, v array<float>")
    index = ann.Ivf.build(df, "id", "v", "EUCLIDIANA", nlist=10)
    q = x[17][1]
    exact = [r["id"] for r in df.orderBy(vector.distance(F.col("v"), q)).limit(10).collect()]
    assert ann.recall([r["id"] for r in index.search(q, 10, 3).collect()], exact) >= 0.9


def test_rank_fusion_by_hand(spark):
    lists = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 1, 3), ("b", 2, 1), ("b", 3, 2)], "source string, id int, rank int")
    got = apps.fuse(lists).collect()
    assert [r["id"] for r in got] == [2, 1, 3] and got[0]["rrf"] == pytest.approx(1 / 62 + 1 / 61) and got[1]["rrf"] == pytest.approx(1 / 61)
    best, notices = apps.recommend({"ok": lambda: lists.where("source = 'a'"), "broken": lambda: 1 / 0}, 2)
    assert [r["id"] for r in best.collect()] == [1] and "broken" in notices


def test_text_index_is_kept_in_files(spark, tmp_path):
    df = spark.createDataFrame([(0, "Cats running"), (1, "a cat"), (2, ""), (3, "perros y gatos")], "id long, t string")
    built = TextIndex.build(df, "id", "t", folder=f"file://{tmp_path}/index")
    again = TextIndex.load(spark, f"file://{tmp_path}/index")
    assert again.n == 4 and again.average == built.average
    assert [r["id"] for r in again.search("cat", "BM25").collect()] == [1, 0]
    assert again.search("the of", "TF_IDF").count() == 0


def test_mfcc_against_plain_sums(spark, tmp_path):
    """A window's coefficients by definition: a transform, triangles in mel and cosines, each as plain sums."""
    import wave

    rng = np.random.default_rng(4)
    t = np.arange(media.RATE // 4) / media.RATE
    x = 0.4 * np.sin(2 * np.pi * 440 * t) + 0.1 * np.sin(2 * np.pi * 3000 * t) + 0.01 * rng.normal(size=len(t))
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(2), f.setsampwidth(2), f.setframerate(media.RATE)
        f.writeframes(np.repeat((x * 32767).astype("<i2"), 2).tobytes())
    (tmp_path / "b.wav").write_bytes(b"no audio")
    rows = media.audio_descriptors(spark, f"file://{tmp_path}/*.wav").collect()
    assert {r["id"].rsplit("/", 1)[1] for r in rows} == {"a.wav"} and len(rows) == 1 + len(x) // media.HOP
    signal = (x * 32767).astype("<i2") / 32768
    padded = np.concatenate([np.zeros(media.FRAME // 2), signal, np.zeros(media.FRAME // 2)])
    n, bins = np.arange(media.FRAME), media.FRAME // 2 + 1
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * n / media.FRAME)
    basis = np.exp(-2j * np.pi * np.outer(np.arange(bins), n) / media.FRAME)
    levels = []
    mel = lambda f: f * 3 / 200 if f < 1000 else 15 + 27 * np.log(f / 1000) / np.log(6.4)
    hertz = lambda m: m * 200 / 3 if m < 15 else 1000 * 6.4 ** ((m - 15) / 27)
    edges = [hertz(mel(media.RATE / 2) * i / (media.BANDS + 1)) for i in range(media.BANDS + 2)]
    for k in range(len(rows)):
        power = np.abs(basis @ (padded[k * media.HOP : k * media.HOP + media.FRAME] * hann)) ** 2
        band = []
        for low, mid, high in zip(edges, edges[1:], edges[2:], strict=False):
            f = np.arange(bins) * media.RATE / media.FRAME
            weight = np.where(f <= mid, (f - low) / (mid - low), (high - f) / (high - mid)).clip(0) * 2 / (high - low)
            band.append(10 * np.log10(max(1e-10, float(weight @ power))))
        levels.append(band)
    levels = np.maximum(levels, np.max(levels) - 80)
    c = np.arange(media.BANDS)
    want = [[sum(row * np.cos(np.pi * j * (c + 0.5) / media.BANDS)) * np.sqrt((1 if j == 0 else 2) / media.BANDS) for j in range(media.COEFFICIENTS)] for row in levels]
    got = np.array([r["descriptor"] for r in rows])
    assert np.abs(got - np.array(want)).max() < 0.01
    assert media.mfcc(np.zeros(0)).shape == (0, media.COEFFICIENTS)


def test_recommender_gives_notices(spark):
    products = spark.createDataFrame([(i, f"kind{i % 2}", f"b{i % 3}", f"c{i % 4}") for i in range(12)], "id long, kind string, brand string, colour string")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 12)], "id long, v array<float>")
    bought = spark.createDataFrame([(u, p) for u in range(4) for p in (0, u + 3, 7)], "u long, p long")
    broken = lambda _: 1 / 0
    best, notices = apps.recommender(0, products, "id", broken, vectors, "id", "v", "kind", "brand", "colour", bought, "u", "p")
    assert set(notices) == {"text", "image"}
    assert 0 not in {r["id"] for r in best.collect()} and best.first()["id"] in (4, 6, 7)
    with pytest.raises(QuernError):
        apps.recommender(99, products, "id", broken, vectors, "id", "v", "kind", "brand", "colour", bought, "u", "p")
    with pytest.raises(QuernError):
        apps.catalog_search(products, "id", None, "kind", "id", low=5, high=2)
    hits, total, kinds = apps.catalog_search(products, "id", None, "kind", "id", of_kind="kind1", low=3, number=1, size=2)
    assert [r["id"] for r in hits.collect()] == [3, 5] and total.first()[0] == 5 and kinds.count() == 2


def test_tfidf_with_stems_against_plain_python(spark):
    """lnc.ltc by hand over the whole table, stems and all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", text.tokens(F.col("text")).alias("ts")).collect()
    counts = {r["doc_id"]: Counter(text.stem(w) for w in r["ts"]) for r in docs}
    df = Counter(t for c in counts.values() for t in c)
    asked = Counter(text.stem(w) for w in text.query_tokens(queries.TEXT_QUERY))
    weight = {t: (1 + math.log10(n)) * math.log10(len(docs) / df[t]) for t, n in asked.items() if df[t]}
    size = math.sqrt(sum(w * w for w in weight.values()))
    want = {}
    for d, c in counts.items():
        norm = math.sqrt(sum((1 + math.log10(n)) ** 2 for n in c.values()))
        if score := sum((1 + math.log10(c[t])) / norm * w / size for t, w in weight.items() if c[t]):
            want[d] = score
    got = {r[0]: r[1] for r in queries.QUERIES["match_tfidf"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=1e-6) and len(got) >= 3


def test_codebook_words_are_the_nearest_centres(spark):
    d = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("descriptor"))
    model = media.codebook(d, words=8)
    centres = np.array(model.clusterCenters())
    got = {r["id"]: r["word"] for r in media.quantized(d, model).collect()}
    for r in d.collect():
        far = ((centres - np.array(r["descriptor"], float)) ** 2).sum(1)
        assert far[got[r["id"]]] == pytest.approx(far.min(), rel=1e-6)


def test_stems_begin_like_their_words(spark):
    """What lets MATCH look at a word's first letters before it is stemmed."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select(F.explode(text.tokens(F.col("text"))).alias("w")).distinct().collect()
    suffixes = [x for x, _ in text.STEP2 + text.STEP3 + text.STEP4] + ["eed", "ed", "ing", "s", "ies", "y", "ies", "edly", "ings"]
    words = [r["w"] for r in rows] + [b + s for b in ("relat", "condit", "valenc", "digit", "hop", "fall", "happ", "sens", "triplic", "adjust", "plast", "confl", "trou") for s in suffixes]
    assert len(words) > 300 and all(w.startswith(text.stem_prefix(text.stem(w))) for w in words)


def test_batch_nearest_against_brute_force(spark, monkeypatch):
    from quern.operators import knn

    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(200, 6)), np.zeros((2, 6)), rng.normal(size=(1, 6)).repeat(5, 0)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(5)
    monkeypatch.setattr(knn, "CELLS", 64)
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 7)
    for metric in ("COSENO", "EUCLIDIANA", "PRODUCTO_PUNTO"):
        got = {(r["query"], r["rank"]): r["key"] for r in knn.batch_nearest(df, df.where("id % 9 = 0"), "v", "id", "id", 4, metric).collect()}
        for q in range(0, len(x), 9):
            one = df.where(F.col("id") == q).first()["v"]
            want = [r["id"] for r in df.orderBy(F.round(vector.distance(F.col("v"), F.array(*(F.lit(float(v)).cast("float") for v in one)), metric), 11), "id").limit(4).collect()]
            assert [got[q, k] for k in range(1, 5)] == want


def test_explained_variance(spark):
    df = spark.createDataFrame([([float(i), 2.0 * i, 0.01 * (-1) ** i],) for i in range(20)], "v array<double>")
    first, second = media.explained_variance(df, "v", 2)
    assert first > 0.99 and first + second == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize("name", ["scan_pk_order", "order_by"])
def test_places_where_ranges_are_joined_by_size(spark, tmp_path, name):
    """Adaptive plans join small ranges by their bytes, which depend on the columns that a branch reads."""
    rows = spark.range(0, 40_000, 1, 6).select(F.pmod(F.col("id") * 7919, F.lit(40_000)).alias("k"))
    rows.select(F.col("k").alias("o_orderkey"), F.md5(F.col("k").cast("string")).alias("o_totalprice")).write.parquet(f"{tmp_path}/orders.parquet")
    rows.select(F.col("k").alias("c_custkey"), (F.col("k") * 31 % 977).cast("double").alias("c_acctbal"), F.lit("n").alias("c_name"), F.lit(1).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").limit(1).write.parquet(f"{tmp_path}/documents.parquet")
    own = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "60k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        got = sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    with duckdb.connect() as c:
        for t in ("orders", "customer"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        assert got == sorted(c.execute(queries.ORACLES[name]).fetchall())

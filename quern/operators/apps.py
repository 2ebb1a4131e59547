"""Recommender and copyright detection: rank fusion, co-purchase, metadata candidates, facets, segment votes, evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.errors import QuernError
from quern.functions import spatial
from quern.operators.knn import nearest

# The fusion constant, candidates a source, matching segments a song, segment length and hop in seconds.
RRF_K, CANDIDATES, MIN_SEGMENTS = 60, 20, 2
SEGMENT_S, HOP_S, TOLERANCE_S = 10.0, 5.0, 0.5
PAGE = 12


def fuse(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (source, id, rank), ranks from 1: (id, rrf, best_rank), best first.

    An id that a list repeats counts once there, at its best rank; ties go to the best single rank, then to the id.
    """
    once = ranked.groupBy("source", "id").agg(F.min("rank").alias("rank"))
    fused = once.groupBy("id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("rrf"), F.min("rank").alias("best_rank"))
    return fused.orderBy(F.desc("rrf"), "best_rank", "id")


def also_bought(purchases: DataFrame, buyer: str, item: str, bought: int) -> DataFrame:
    """(item, buyers): items that buyers of `bought` have too, by distinct buyers."""
    pairs = purchases.select(F.col(buyer).alias("b"), F.col(item).alias("i")).distinct()
    who = pairs.where(F.col("i") == bought).select("b")
    return pairs.where(F.col("i") != bought).join(who, "b", "left_semi").groupBy(F.col("i").alias("item")).agg(F.count(F.lit(1)).alias("buyers"))


def metadata_candidates(products: DataFrame, key: str, like: dict, kind: str, brand: str, colour: str) -> DataFrame:
    """Products of the same type, 2 points for the brand and 1 for the colour."""
    points = F.when(F.col(brand) == like[brand], 2).otherwise(0) + F.when(F.col(colour) == like[colour], 1).otherwise(0)
    return products.where((F.col(kind) == like[kind]) & (F.col(key) != like[key])).withColumn("points", points).orderBy(F.desc("points"), key)


def candidates(ranked: DataFrame, item: int, most: int = CANDIDATES) -> DataFrame:
    """The first `most` distinct ids of each source, without the item itself; ranks are given anew."""
    own = Window.partitionBy("source").orderBy("rank", "id")
    once = ranked.where(F.col("id") != item).groupBy("source", "id").agg(F.min("rank").alias("rank"))
    return once.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= most)


def recommend(sources: dict, item: int, k: int = 10) -> tuple[DataFrame | None, dict[str, str]]:
    """Fuse the sources {name: function giving (id, rank)}; one that fails or is empty is left out, with a notice."""
    lists, notices = None, {}
    for name, source in sources.items():
        try:
            own = source().select(F.lit(name).alias("source"), F.col("id").cast("long").alias("id"), "rank")
            if own.isEmpty():
                notices[name] = "no candidates"
                continue
        except Exception as error:  # a failing source must not take the others with it
            notices[name] = str(error).splitlines()[0]
            continue
        lists = own if lists is None else lists.unionByName(own)
    return (fuse(candidates(lists, item)).limit(k) if lists is not None else None), notices


def facets(hits: DataFrame, column: str, most: int = 40) -> DataFrame:
    return hits.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(most)


def page(hits: DataFrame, order: list[Column], number: int, size: int = PAGE) -> DataFrame:
    return hits.orderBy(*order).offset((number - 1) * size).limit(size)


def catalog_search(products: DataFrame, key: str, scores: DataFrame | None, kind: str, price: str, of_kind: str = "", low: float | None = None, high: float | None = None, number: int = 1, size: int = PAGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A page of a catalogue, the number of all hits, and how many products each kind has.

    scores: (id, score) of a ranked text search, or None. Kind and price bounds filter the hits; a page is ordered by
    score, or by key without a search. The facets count the whole catalogue, so that another kind can be chosen.
    """
    if low is not None and high is not None and low > high:
        raise QuernError("the lowest price is above the highest")
    hits = products
    if of_kind:
        hits = hits.where(F.col(kind) == of_kind)
    if low is not None:
        hits = hits.where(F.col(price) >= low)
    if high is not None:
        hits = hits.where(F.col(price) <= high)
    order = [F.asc(key)]
    if scores is not None:
        hits = hits.join(scores.select(F.col("id").alias(key), "score"), key)
        order = [F.desc(F.round("score", 9)), *order]
    return page(hits, order, number, size), hits.agg(F.count(F.lit(1)).alias("total")), facets(products, kind)


def ranked(df: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """(id, rank) of the first `most` rows: a bounded heap in each task, then ranks of those few."""
    few = df.orderBy(*order, key).limit(most)
    return few.select(F.col(key).alias("id"), F.row_number().over(Window.orderBy(*order, key)).alias("rank"))


def recommender(item: int, products: DataFrame, key: str, text: Callable, vectors: DataFrame, vector_key: str, column: str, kind: str, brand: str, colour: str, purchases: DataFrame, buyer: str, bought: str, k: int = 10, most: int = CANDIDATES) -> tuple[DataFrame | None, dict[str, str]]:
    """What goes with an item, from four sources fused by rank: text, image, metadata and purchases; and a notice for each
    source that failed or has no candidates.

    text: a function of the item's row that gives (id, score). Each source brings the item itself and `most` others at most.
    """
    like = products.where(F.col(key) == item).limit(1).collect()
    if not like:
        raise QuernError(f"there is no product {item}")
    like = like[0].asDict()

    def by_image() -> DataFrame:
        own = vectors.where(F.col(vector_key) == item).select(column).limit(1).collect()
        if not own:
            raise QuernError(f"product {item} has no vector")
        near = nearest(vectors.select(vector_key, column), column, list(own[0][0]), most + 1, vector_key)
        return ranked(near, vector_key, [F.asc(F.round("distance", 9))], most + 1)

    sources = {
        "text": lambda: ranked(text(like), "id", [F.desc(F.round("score", 9))], most + 1),
        "image": by_image,
        "metadata": lambda: ranked(metadata_candidates(products, key, like, kind, brand, colour), key, [F.desc("points")], most),
        "purchases": lambda: ranked(also_bought(purchases, buyer, bought, item), "item", [F.desc("buyers")], most),
    }
    best, notices = recommend(sources, item, k)
    return best, notices


def nearest_with_stock(stock: DataFrame, branches: DataFrame, product: int, lat_e6: int, lon_e6: int, k: int = 3) -> DataFrame:
    """Branches that have a product, nearest first. stock: branch, product, stock; branches: branch, location."""
    have = stock.where((F.col("product") == product) & (F.col("stock") > 0))
    d = spatial.distance_m(F.col("location"), lat_e6, lon_e6)
    return have.join(branches, "branch").withColumn("metres", d).orderBy(F.rint(F.col("metres") * 1000), "branch").limit(k)


def segment_starts(tracks: DataFrame, key: str, seconds: str) -> DataFrame:
    """(key, start, end) of windows of SEGMENT_S every HOP_S; a last one may miss TOLERANCE_S. A short track is one window."""
    n = F.greatest(F.lit(1), (F.floor((F.col(seconds) - SEGMENT_S + TOLERANCE_S) / HOP_S) + 1).cast("int"))
    starts = tracks.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("i") * HOP_S
    return starts.select(key, start.alias("start"), F.least(start + SEGMENT_S, F.col(seconds)).alias("end"))


def segment_votes(matches: DataFrame, song: str, threshold: float = 0.74, top: int = 5) -> DataFrame:
    """Songs with enough matching segments. matches: segment, rank, score and the song of the matched segment.

    A segment votes for a song once, with its best score among the first `top` matches; a song needs min(2, segments) votes.
    """
    total = matches.agg(F.count_distinct("segment").alias("n"))
    good = matches.where((F.col("rank") <= top) & (F.col("score") >= threshold)).groupBy(song, "segment").agg(F.max("score").alias("score"))
    votes = good.groupBy(song).agg(F.count(F.lit(1)).alias("segments"), F.max("score").alias("best"))
    return votes.join(F.broadcast(total)).where(F.col("segments") >= F.least(F.lit(MIN_SEGMENTS), F.col("n"))).drop("n")  # total is one row


def threshold_curve(cases: DataFrame, thresholds: range = range(50, 100)) -> DataFrame:
    """Precision, recall and F1 of (score in percent, positive) cases at each whole threshold.

    Cases are first counted by the highest threshold that they pass, so no case is repeated for every threshold.
    """
    low, high = thresholds[0], thresholds[-1]
    top = F.least(F.lit(high), F.floor("score").cast("int"))
    counts = cases.groupBy(F.when(top >= low, top).otherwise(low - 1).alias("at")).agg(F.sum(F.col("positive").cast("int")).alias("p"), F.count(F.lit(1)).alias("n"))
    grid = cases.sparkSession.range(low - 1, high + 1).select(F.col("id").cast("int").alias("at")).join(F.broadcast(counts), "at", "left").na.fill(0)  # one row a threshold
    down = Window.orderBy(F.desc("at"))
    grid = grid.select("at", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("found"), F.sum("p").over(Window.partitionBy()).alias("positives")).where(F.col("at") >= low)
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0)), F.lit(0.0))
    out = grid.select(F.col("at").alias("threshold"), ratio("tp", "found").alias("precision"), ratio("tp", "positives").alias("recall"))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0)), F.lit(0.0)))

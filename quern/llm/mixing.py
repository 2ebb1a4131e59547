"""Mixing sources to target weights by min-cost flow.

A text can stand in several sources: as copies in rows of different sources, or in rows that name several. The sources in
which it stands are its membership pattern. The flow runs from patterns through cells (a pattern in one of its sources)
to the sources: a pattern's words are given up to MAX_REPEATS times in each cell, each further time over all its cells at
a higher (convex) cost, and a source takes its quota. So sources that share texts fill up from what is theirs alone before
a shared text repeats. What a cell gives becomes whole passes over its rows and one partial pass, in seeded order of the
rows: a row that does not fit is skipped, and the pass goes on until no row behind it fits.

Texts of one source have no choice and never reach the driver: sizes, weights, targets and their quotas are tables. The
driver gets the totals of all overlapping patterns, so its memory follows their number (about 2 KB each), not the rows'.

Null text or no words: size 0, nothing taken. A null source is a source of its own, last in order. Rows that repeat an
id, or id and text, are separate rows, told apart by their place in their file, so any number of them can be taken. Null
ids are ids like any other. Extra columns are kept as they are. An empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD, below, bits_for, hash_bucket, join_split, materialize, unsigned_order

MAX_REPEATS = 3
RANGE_ROWS = 5_000


def targets(sources: DataFrame, most: int = MAX_REPEATS) -> DataFrame:
    """sources (source, size, weight, more columns) with `target`: shares of the total by weight; none above `most` times
    its size, the excess reshared by weight among the rest. Each round is one aggregate, until no source is above."""
    total = sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    share, full = 0.0, F.lit(False)
    while True:
        r = sources.agg(F.sum(F.when(full, F.lit(most) * F.col("size"))).alias("gone"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if not r["w"]:
            break
        before, share = share, (total - (r["gone"] or 0)) / r["w"]
        if share <= before:
            break
        full = F.col("weight") * F.lit(share) > F.lit(most) * F.col("size")
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(float(share)), F.lit(float(most)) * F.col("size")))


def min_cost_flow(capacity: dict, quota: dict, cells: dict, repeats: int = MAX_REPEATS) -> dict:
    """Words that flow through each cell: {(pattern, cell): words}.

    capacity: words of a pattern's texts, each counted once; pass k over them costs k squared. cells: {pattern: {cell:
    words}}, a cell being the tuple of sources that its rows belong to; it gives at most `repeats` times its words, to any
    of them. quota: words of a source. The result is the cheapest of all flows that fill as much of the quotas as can be.

    All cost lies on what leaves the start, and what can leave it together is a polymatroid: so passes are opened from the
    cheapest up, and at each the flow is made as large as it can be, which never takes back what a cheaper one gave.
    """
    start, end = 0, 1
    to, room = array("q"), array("q")
    arcs = [array("q"), array("q")]

    def node() -> int:
        arcs.append(array("q"))
        return len(arcs) - 1

    def arc(x: int, y: int, cap: int) -> int:
        arcs[x].append(len(to)), to.append(y), room.append(cap)
        arcs[y].append(len(to)), to.append(x), room.append(0)
        return len(to) - 2

    source = {s: node() for s in quota}
    first, inner, left = {}, {}, {}
    for p, own in cells.items():
        first[p] = arc(start, at := node(), 0)
        left[p] = repeats * sum(own.values()) if capacity[p] > 0 else 0  # what its cells can take in all passes
        for cell, n in own.items():
            inner[p, cell] = arc(at, inside := node(), repeats * n)
            for s in cell:
                arc(inside, source[s], repeats * n)
    for s, q in quota.items():
        arc(source[s], end, q)

    def fill() -> dict[int, int]:
        """The largest flow that the open arcs allow, by blocking flows in layers; returns what the start still reaches."""
        while True:
            layer, queue = {start: 0}, deque([start])
            while queue and end not in layer:
                x = queue.popleft()
                for e in arcs[x]:
                    if room[e] > 0 and to[e] not in layer:
                        layer[to[e]] = layer[x] + 1
                        queue.append(to[e])
            if end not in layer:
                return layer
            place: dict[int, int] = {}
            path: list[int] = []
            x = start
            while True:
                if x == end:
                    push = min(room[e] for e in path)
                    for e in path:
                        room[e] -= push
                        room[e ^ 1] += push
                    k = next(i for i, e in enumerate(path) if room[e] == 0)
                    x, path = to[path[k] ^ 1], path[:k]
                    continue
                own, i = arcs[x], place.get(x, 0)
                while i < len(own) and not (room[own[i]] > 0 and layer.get(to[own[i]]) == layer[x] + 1):
                    i += 1
                place[x] = i
                if i < len(own):
                    path.append(own[i])
                    x = to[own[i]]
                elif x == start:
                    break
                else:
                    x = to[path.pop() ^ 1]
                    place[x] += 1

    # One pass more of every pattern that has cells to fill. What the start still reaches after a pass never reaches the
    # end again (later paths stay outside it), so those patterns are done. After some passes (texts of many copies), as
    # many are opened at once as all fit: the same as one by one.
    more, passes, step = [p for p in left if left[p] > 0], 0, 1
    while more:
        held = (room[:], {p: left[p] for p in more}) if step > 1 else None
        for p in more:
            n = min(step * capacity[p], left[p])
            room[first[p]] += n
            left[p] -= n
        arcs[start] = array("q", [first[p] for p in more])
        reached = fill()
        if held and len(reached) > 1:
            room[:] = held[0]
            left |= held[1]
            step = 1
            continue
        more = [p for p in more if left[p] > 0 and to[first[p]] not in reached]
        passes += 1
        step = 2 * step if passes > 3 * repeats else 1
    given = {k: room[e ^ 1] for k, e in inner.items()}
    return {k: v for k, v in given.items() if v > 0}


def _located(docs: DataFrame) -> DataFrame:
    """docs with `__tie`, a hash of the row's place in its file: it tells rows apart that are the same otherwise."""
    hidden = docs._jdf.queryExecution().analyzed().metadataOutput().toString()
    if "_metadata#" not in hidden or "row_index" not in docs.select("_metadata").schema[0].dataType.names:
        docs = materialize(docs, "located")  # not read from Parquet files as it stands
    return docs.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("__tie"))


def _keyed(docs: DataFrame, sources: str, seed: int) -> DataFrame:
    """Located docs with __sources, __source (the first), __cell (a hash of all), __size, __text (hash) and __u (seeded order)."""
    kind = dict(docs.dtypes)[sources]
    names = F.array_sort(F.array_distinct(F.col(sources).cast("array<string>"))) if kind.startswith("array") else F.array(F.col(sources).cast("string"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumns({"__sources": F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(None).cast("string"))), "__size": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"), "__text": F.xxhash64(text)})
    number = F.col("doc_id").cast("long")
    return rows.withColumns({"__source": F.col("__sources")[0], "__cell": F.xxhash64(F.size("__sources"), "__sources"), "__u": unsigned_order(F.xxhash64(F.lit(seed), number.isNull(), number, "__text"))})


class Plan:
    """How much of what a mix takes.

    cells: cell, source, source_size, target, passes, steps; one row for each source's own texts (cell is its place in
    the order) and for each cell of an overlapping pattern (below 0). texts: text, r (hash of a row's sources), cell.
    """

    def __init__(self, cells: DataFrame, texts: DataFrame | None, n_cells: int):
        self.cells, self.texts, self.n_cells = cells, texts, n_cells


#: A plan with more cells than this is joined by key, and written, instead of being broadcast.
MOST_BROADCAST = 50_000


def _kept(df: DataFrame, name: str, small: bool) -> DataFrame:
    """df, computed: through the driver if its rows are known to be few, else written."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema) if small else materialize(df, name)


def plan(docs: DataFrame, weights: dict | None = None, sources: str = "source", seed: int = 23) -> Plan:
    """The plan for located docs: a row is taken `passes` times, and once more if it is in one of its cell's steps."""
    spark = docs.sparkSession
    rows = _keyed(docs, sources, seed).select(*(F.col(f"__{c}").alias(a) for c, a in (("sources", "sources"), ("source", "source"), ("cell", "r"), ("size", "size"), ("text", "text"), ("u", "u"), ("tie", "tie"))))
    rows = materialize(rows, "sizes")
    # A source's own size: words of all rows that belong to it; `own` are those of the rows whose first source it is.
    named = rows.select(F.explode("sources").alias("source"), "size", F.lit(0).cast("long").alias("own")).unionByName(rows.select("source", F.lit(0).cast("long").alias("size"), F.col("size").alias("own")))
    named = named.groupBy("source").agg(F.sum("size").alias("size"), F.sum("own").alias("own"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1  # one row for each source
    named = named.withColumn("cell", place.cast("long"))
    weight = (F.col("cell") % 3 + 1).cast("double")
    if weights is not None:
        weight = F.lit(1e-12)
        for s, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w or 1e-12))).otherwise(weight)
    named = materialize(named.withColumn("weight", weight), "sources")
    n_cells = named.count()
    named = targets(named).select("cell", "source", "size", "own", "target", F.round("target").cast("long").alias("quota"))
    cells = named.select("cell", "source", F.col("size").alias("source_size"), "target", F.col("own").alias("words"), F.col("quota").alias("given"))
    texts, changed, extra = _overlapping(rows, named)
    if texts is not None:
        changed = spark.createDataFrame(changed, "cell long, __own long, __flow long")
        cells = cells.join(F.broadcast(changed), "cell", "left").select("cell", "source", "source_size", "target", F.coalesce("__own", "words").alias("words"), F.coalesce("__flow", "given").alias("given"))
        cells = cells.unionByName(spark.createDataFrame(extra, "cell long, source string, source_size long, target double, words long, given long"))
        n_cells += len(extra)
    cells = cells.withColumns({"passes": F.when(F.col("words") > 0, F.expr("given div words")).otherwise(0), "rest": F.when(F.col("words") > 0, F.col("given") % F.col("words")).otherwise(0)})
    small = n_cells <= MOST_BROADCAST
    cells = _kept(cells, "plan", small)
    met = _in_cells(rows.where("size > 0"), named.select("source", "cell"), texts, n_cells, ("source", "text", "r"))
    steps = _steps(met, cells.where("rest > 0").select("cell", F.col("rest").alias("gap")), small)
    own = steps.groupBy("cell").agg(F.collect_list(F.struct("first", "upto", "most", "tie")).alias("steps"))
    none = F.array().cast("array<struct<first:bigint,upto:bigint,most:bigint,tie:bigint>>")
    cells = cells.join(own, "cell", "left").select("cell", "source", "source_size", "target", "passes", F.coalesce("steps", none).alias("steps"))
    return Plan(_kept(cells, "plan", small), texts, n_cells)


def _overlapping(rows: DataFrame, named: DataFrame) -> tuple[DataFrame | None, list[tuple], list[tuple]]:
    """Texts that stand in several sources with their cells; what is left to the sources' own cells (cell, words, given);
    and the cells of the patterns (cell, source, source_size, target, words, given)."""
    spark, some = rows.sparkSession, rows.where("size > 0")
    spread = some.groupBy("text").agg(F.min("source").alias("a"), F.max("source").alias("b"), F.max(F.size("sources")).alias("k"), F.count("source").alias("named"), F.count(F.lit(1)).alias("n"))
    shared = materialize(spread.where("a <> b or k > 1 or (named > 0 and named < n)").select("text", "n"), "shared")
    if not shared.limit(1).count():
        return None, [], []
    own = join_split(some, shared, ["text"], "n").groupBy("text", "r").agg(F.first("sources").alias("sources"), F.sum("size").alias("words"), F.max("size").alias("size"))
    own = materialize(own, "cells")
    member = own.groupBy("text").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("member"), F.max("size").alias("size"))
    member = materialize(member.select("text", "size", F.xxhash64(F.size("member"), "member").alias("pattern")), "members")
    capacity = {r["pattern"]: int(r["size"]) for r in member.groupBy("pattern").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "pattern").collect()}
    texts = materialize(own.join(member.select("text", "pattern"), "text").select("text", "r", "sources", "words", "pattern"), "texts")
    inside: dict = {p: {} for p in capacity}
    hashes = {}
    for r in texts.groupBy("pattern", "r").agg(F.first("sources").alias("sources"), F.sum("words").alias("words")).orderBy("pattern", "r").collect():
        cell = tuple(r["sources"])
        inside[r["pattern"]][cell], hashes[cell] = int(r["words"]), r["r"]
    touched = spark.createDataFrame([(s,) for s in {s for c in inside.values() for cell in c for s in cell}], "__s string")
    of = {r["source"]: r for r in named.join(F.broadcast(touched), F.col("source").eqNullSafe(F.col("__s"))).orderBy("cell").collect()}
    # What such a source has beside these patterns is a pattern of its own.
    left = {s: int(r["own"]) for s, r in of.items()}
    for c in inside.values():
        for cell, n in c.items():
            left[cell[0]] -= n
    flow = min_cost_flow(capacity | {("own", s): n for s, n in left.items()}, {s: int(r["quota"]) for s, r in of.items()}, inside | {("own", s): {(s,): n} for s, n in left.items()})
    extra, pairs = [], []
    for p, c in inside.items():
        for cell, n in c.items():
            r = of[cell[0]]
            pairs.append((p, hashes[cell], -len(pairs) - 1))
            extra.append((-len(pairs), cell[0], int(r["size"]), float(r["target"]), n, flow.get((p, cell), 0)))
    numbers = spark.createDataFrame(pairs, "pattern long, r long, cell long")
    texts = materialize(texts.join(F.broadcast(numbers) if len(pairs) <= MOST_BROADCAST else materialize(numbers, "numbers"), ["pattern", "r"]).select("text", "r", "cell"), "texts")
    return texts, [(int(of[s]["cell"]), n, flow.get((("own", s), (s,)), 0)) for s, n in left.items()], extra


def _in_cells(rows: DataFrame, named: DataFrame, texts: DataFrame | None, n_cells: int, names: tuple[str, str, str]) -> DataFrame:
    """rows with `cell`: that of their text and sources, or of their first source alone. names: columns of source, text, r."""
    small = F.broadcast if n_cells <= MOST_BROADCAST else lambda df: df
    out = rows.join(small(named.select(F.col("source").alias("__s"), F.col("cell").alias("__alone"))), F.col(names[0]).eqNullSafe(F.col("__s"))).drop("__s")
    if texts is None:
        return out.withColumnRenamed("__alone", "cell")
    # Texts that one text's rows share may be many rows: they meet few cells, whose table is dealt with AQE's skew join.
    other = texts.select(F.col("text").alias("__t"), F.col("r").alias("__r"), "cell")
    met = out.join(other, (F.col(names[1]) == F.col("__t")) & (F.col(names[2]) == F.col("__r")), "left")
    return met.withColumn("cell", F.coalesce("cell", "__alone")).drop("__alone", "__t", "__r")


def _steps(rows: DataFrame, gaps: DataFrame, small: bool) -> DataFrame:
    """Steps (cell, first, upto, most, tie) by which each cell's partial pass fills its gap.

    Each round takes all rows no larger than the gap up to the first that overflows it, and goes on behind that one. Rows
    that share their place in the order (the same id and text) are of one size: as many of them are taken as fit, by tie.
    """
    spark = rows.sparkSession
    schema, top = "cell long, first long, upto long, most long, tie long", F.lit(2**63 - 1).cast("long")
    rows = materialize(rows.select("cell", "size", "u", "tie").join((F.broadcast if small else lambda df: df)(gaps.select("cell")), "cell", "left_semi"), "partial")
    bits = bits_for(rows.count(), RANGE_ROWS)
    rows = rows.withColumn("hb", hash_bucket(unsigned_order(F.col("u")), bits))
    out: list[DataFrame] = []
    few = F.broadcast if small else lambda df: df
    open_ = _kept(gaps.select("cell", "gap", F.lit(-(2**63)).cast("long").alias("first")), "open", small)
    while open_.limit(1).count():
        fits = rows.join(few(open_), "cell").where("u >= first and size <= gap")
        sums = fits.groupBy("cell", "gap", "first", "hb").agg(F.sum("size").alias("n"))
        # Where the step ends: first the range of hashes, from totals of all ranges, then the place, within it.
        over = F.col("below") + F.col("n") > F.col("gap")
        sums = below(sums if bits < 10 else materialize(sums, "sums"), ["cell", "gap", "first"], "hb", "n")
        ends = _kept(sums.groupBy("cell", "gap", "first").agg(F.min(F.when(over, F.col("hb"))).alias("cut"), F.min(F.when(over, F.col("below"))).alias("base")), "ends", small)
        at = fits.join(few(ends.where("cut is not null").select("cell", "cut", "base")), "cell").where("hb = cut").groupBy("cell", "gap", "first", "base", "u", "size").agg(F.sum("size").alias("n"))
        at = at.withColumn("upto", F.col("base") + F.sum("n").over(Window.partitionBy("cell").orderBy("u", "size")))
        # The first place that overflows; the rows there are copies, and some of them may still fit.
        cut = at.where("upto > gap").groupBy("cell", "gap", "first").agg(F.min(F.struct("u", F.col("size").alias("z"), (F.col("upto") - F.col("n")).alias("taken"))).alias("c"))
        cut = _kept(cut.select("cell", "gap", "first", "c.*").withColumn("copies", F.expr("(gap - taken) div z")), "cut", small)
        found = [
            ends.where("cut is null").select("cell", "first", top.alias("upto"), F.col("gap").alias("most"), top.alias("tie")),
            cut.where("taken > 0 and u > first").select("cell", "first", (F.col("u") - 1).alias("upto"), F.col("gap").alias("most"), top.alias("tie")),
        ]
        if cut.where("copies > 0").limit(1).count():
            found.append(_copies(rows, few(cut.where("copies > 0"))))
        out.append(_kept(_union(found, schema), "steps", small))
        left = cut.select("cell", (F.col("gap") - F.col("taken") - F.col("copies") * F.col("z")).alias("gap"), "u").where(f"gap > 0 and u < {2**63 - 1}")
        open_ = _kept(left.select("cell", "gap", (F.col("u") + 1).alias("first")), "open", small)
    return _union(out, schema) if out else spark.createDataFrame([], schema)


def _copies(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """The step that takes `copies` of the rows at u: up to the tie of the last one, found in two levels."""
    same = rows.select("cell", F.col("u").alias("__u"), "size", "tie").join(cut.select("cell", "u", "z", "copies"), "cell").where("__u = u and size = z")
    same = same.withColumn("tb", hash_bucket(unsigned_order(F.col("tie")), 12))
    counts = below(same.groupBy("cell", "u", "z", "copies", "tb").agg(F.count(F.lit(1)).alias("n")), ["cell", "u", "z", "copies"], "tb", "n")
    last = counts.where("below < copies and below + n >= copies").select("cell", "tb", (F.col("copies") - F.col("below")).alias("nth"))
    ranked = same.join(last, ["cell", "tb"]).withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("tie")))
    return ranked.where("rank = nth").select("cell", F.col("u").alias("first"), F.col("u").alias("upto"), F.col("z").alias("most"), "tie")


def _union(frames: list[DataFrame], schema: str) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select(*(x.split()[0] for x in schema.split(", ")))


def _taken(docs: DataFrame, weights: dict | None, sources: str, seed: int) -> DataFrame:
    """docs with __sources, __size, __times and the plan's columns; but for texts that overlap, nothing is shuffled."""
    names, docs = docs.columns, _located(docs)
    how = plan(docs, weights, sources, seed)
    own = how.cells.where("cell >= 0").select("source", "cell")
    rows = _in_cells(_keyed(docs, sources, seed).withColumnsRenamed({c: f"__own_{c}" for c in names}), own, how.texts, how.n_cells, ("__source", "__text", "__cell"))
    small = F.broadcast if how.n_cells <= MOST_BROADCAST else lambda df: df
    cells = how.cells.select("cell", *(F.col(c).alias(f"__plan_{c}") for c in ("source_size", "target", "passes", "steps")))
    rows = rows.join(small(cells), "cell")
    partial = F.exists("__plan_steps", lambda x: F.col("__u").between(x["first"], x["upto"]) & (F.col("__size") <= x["most"]) & (F.col("__tie") <= x["tie"]))
    times = F.when(F.col("__size") > 0, F.col("__plan_passes") + partial.cast("long")).otherwise(0)
    return rows.select(*(F.col(f"__own_{c}").alias(c) for c in names), "__sources", "__size", "__plan_source_size", "__plan_target", times.alias("__times"))


def mix(docs: DataFrame, weights: dict | None = None, sources: str = "source", seed: int = 23) -> DataFrame:
    """doc_id, member, size, source_size, target, taken for each row of docs.

    sources: a column with a source's name or an array of names. weights: {source: weight}; without it the sources weigh
    1, 2, 3, repeating, in code point order, null last. source_size and target are those of the row's first source, to
    which its words are counted.
    """
    rows = _taken(docs, weights, sources, seed)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__sources").alias("member"), F.col("__size").alias("size"), F.col("__plan_source_size").alias("source_size"), F.col("__plan_target").alias("target"), (F.col("__size") * F.col("__times")).alias("taken"))


def mixed(docs: DataFrame, weights: dict | None = None, sources: str = "source", seed: int = 23) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken; rows without words go."""
    rows = _taken(docs, weights, sources, seed).where("__size > 0 and __times > 0")
    return rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__times").cast("int")))).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")

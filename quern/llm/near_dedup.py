"""MinHash-style near-dedup on SetSketch registers, with links confirmed on full shingle sets.

A-Z is lower-cased; a document's set is its distinct 5-word shingles, or its whole sequence with fewer words. Documents
without words (or null) link with nothing. Documents link when 100 * intersection >= 75 * union.

1. One pass makes the set's size, a 128-bit fingerprint of the set and the SetSketch registers. Documents with the same
   set become one node, so large groups of copies cost one row each from here on.
2. Nodes that share a band of registers get an edge to the least node of that band (a star: no pairs within a group).
   Components of these candidate edges hold every pair that shares a band.
3. Each component of bounded size is settled in one task with all its texts: exact similarities from one member out,
   others only where the triangle inequality of 1 - J and the likelihood of the registers leave a link possible.
4. A component beyond that bound is compared with one pivot, in blocks over many tasks. What links to the pivot is one
   component. The rest is dealt into chunks, and the members into blocks, by size: linked sets differ in size by a quarter
   at most, so a chunk meets the blocks of its own and the neighbouring classes of size, and those of the pivot's
   component only if it is near enough to the pivot (1 - J of 0.5). No candidate is dropped.
5. Components of the confirmed links give every document the smallest doc_id that it reaches.

Rows that repeat an id are one document through that id, whatever their texts: each has its own set, and what one links
with, all do. Rows that repeat id and text cost one row. A row with a null id joins the group of its links; a group of
null ids alone has component_id null, and its rows count as kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import bounded_arrow, join_split, materialize, repeated, units
from quern.llm.components import components

SHINGLE = 5
#: Links: LINK[0] * intersection >= LINK[1] * union.
LINK = (100, 75)
#: A component of more documents or bytes is dealt over several tasks.
TASK_DOCS, TASK_BYTES = 2_000, 32 << 20
#: Documents and bytes of a large component that one task holds at a time, on either side.
BLOCK_DOCS, BLOCK_BYTES = 1_000, 8 << 20
#: Hashes that are looked up at a time.
LOOKUP = 1 << 18

SIGNATURE = "id long, doc_id long, n long, n_bytes long, n_shingles long, f1 long, f2 long, bands array<long>, regs binary"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from quern.llm import setsketch, textops

    schema = pa.schema([("id", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("n_bytes", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64())), ("regs", pa.binary())])
    for batch in batches:
        data, at = textops.buffers(batch.column(3))
        h, words_at = textops.words(data, at)
        sets = list(textops.shingles(h, words_at, SHINGLE))
        n = np.array([len(s) for s in sets], np.int64)
        f1, f2, bands, regs = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), [None] * len(n), [None] * len(n)
        if n.any():
            x, full = np.concatenate(sets), np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[full]
            f1[full] = np.add.reduceat(x, starts).view(np.int64)
            f2[full] = np.add.reduceat(textops.mixed(x ^ np.uint64(0x5DEECE66D1234567)), starts).view(np.int64)
            r = setsketch.sketch(x, starts)
            for i, b, g in zip(full.tolist(), setsketch.bands(r), r, strict=True):
                bands[i], regs[i] = b, g.tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at)), pa.array(n), pa.array(f1), pa.array(f2), pa.array(bands, pa.list_(pa.int64())), pa.array(regs, pa.binary())], schema=schema)


def _linked(inter: np.ndarray, n_a, n_b) -> np.ndarray:
    return (LINK[0] * inter >= LINK[1] * (n_a + n_b - inter)) & (inter > 0)


def _common(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of one sorted set with many, which are looked up a bounded number of hashes at a time."""
    n = np.array([len(s) for s in sets])
    out, ends, i = np.zeros(len(n), np.int64), np.cumsum(n), 0
    held = lambda x: one[np.minimum(np.searchsorted(one, x), len(one) - 1)] == x
    while i < len(n):
        if n[i] > LOOKUP:
            out[i] = sum(np.count_nonzero(held(sets[i][k : k + LOOKUP])) for k in range(0, len(sets[i]), LOOKUP))
            i += 1
            continue
        j = int(np.searchsorted(ends, ends[i] - n[i] + LOOKUP, "right"))
        out[i:j] = np.add.reduceat(held(np.concatenate(sets[i:j])), np.cumsum(n[i:j]) - n[i:j], dtype=np.int64)
        i = j
    return out


def settle(sets: list[np.ndarray], regs: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all whose components are joined: a spanning forest of the exact link graph of the sets."""
    from quern.llm import setsketch

    n, least = np.array([len(s) for s in sets]), LINK[1] / LINK[0]
    links, rest = [], np.arange(len(sets))
    while len(rest) > 1:
        pivot, rest = int(rest[0]), rest[1:]
        inter = _common(sets[pivot], [sets[i] for i in rest])
        far = np.full(len(sets), 2.0)  # exact distance to the pivot
        far[rest] = 1 - inter / (n[pivot] + n[rest] - inter)
        far[pivot] = 0
        hit = _linked(inter, n[pivot], n[rest])
        queue = rest[hit].tolist()
        links += [(pivot, int(i)) for i in queue]
        rest = rest[~hit]
        while queue and len(rest):
            q = queue.pop()
            near = rest[(far[rest] - far[q] <= 1 - least + 1e-9) & (np.minimum(n[rest], n[q]) * LINK[0] >= LINK[1] * np.maximum(n[rest], n[q]))]
            if len(near):
                near = near[setsketch.may_reach(regs[q], n[q], regs[near], n[near], least)]
            if not len(near):
                continue
            inter = _common(sets[q], [sets[i] for i in near])
            hit = near[_linked(inter, n[q], n[near])]
            links += [(q, int(i)) for i in hit]
            queue += hit.tolist()
            rest = rest[~np.isin(rest, hit)]
    return links


def _settle_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from quern.llm import setsketch, textops

    for group in textops.by_key(batches, ["comp"]):
        ids = group.column("id").to_numpy()
        sets = textops.shingle_sets(group.column("text"), SHINGLE)
        regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), np.uint16).reshape(-1, setsketch.REGISTERS)
        links = settle(sets, regs)
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in links], pa.int64()), pa.array([ids[b] for _, b in links], pa.int64())], names=["a", "b"])


def _against_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from quern.llm import textops

    for group in textops.by_key(batches, ["comp", "block"]):
        own = group.column("is_pivot").to_numpy(zero_copy_only=False).astype(bool)
        ids = group.column("id").to_numpy()
        sets = textops.shingle_sets(group.column("text"), SHINGLE)
        if not own.any() or own.all():
            continue
        one, others = sets[int(np.flatnonzero(own)[0])], np.flatnonzero(~own)
        n = np.array([len(sets[i]) for i in others])
        inter = _common(one, [sets[i] for i in others])
        far = 1 - inter / (len(one) + n - inter)
        k = len(others)
        yield pa.RecordBatch.from_arrays([group.column("comp").combine_chunks().take(pa.array(others)), pa.array(np.full(k, ids[own][0])), pa.array(ids[others]), pa.array(_linked(inter, len(one), n)), pa.array(far), pa.array(size_class(n)), pc.binary_length(group.column("text").combine_chunks()).cast(pa.int64()).take(pa.array(others))], names=["comp", "pivot", "id", "linked", "far", "sc", "n_bytes"])


def size_class(n: np.ndarray) -> np.ndarray:
    """Sets of which the smaller has LINK's share of the larger are in the same class or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(1.01 * LINK[0] / LINK[1])).astype(np.int32)


#: What a chunk and a block have in common: the chunk's class and number, and whether the block's members link to the
#: pivot, their class and number.
MEETING = ["comp", "lsc", "chunk", "tl", "tsc", "block"]


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of documents that the pivot has left over (side 0) with a block of the component's members (side 1)."""
    from quern.llm import setsketch, textops

    least = LINK[1] / LINK[0]
    for group in textops.by_key(batches, MEETING):
        side = group.column("side").to_numpy(zero_copy_only=False)
        ids, far = group.column("id").to_numpy(), group.column("far").to_numpy()
        linked = group.column("linked").to_numpy(zero_copy_only=False).astype(bool)
        sets = textops.shingle_sets(group.column("text"), SHINGLE)
        regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), np.uint16).reshape(-1, setsketch.REGISTERS)
        n = np.array([len(x) for x in sets])
        # Members that link to the pivot are one component, the others start alone.
        root = {int(i): (-1 if k else int(i)) for i, k in zip(ids, linked, strict=True)}

        def find(i, root=root):
            while i in root and root[i] != i:
                i = root[i]
            return i

        links, others = [], np.flatnonzero(side == 1)
        for u in np.flatnonzero(side == 0).tolist():
            near = others[(np.abs(far[others] - far[u]) <= 1 - least + 1e-9) & (np.minimum(n[others], n[u]) * LINK[0] >= LINK[1] * np.maximum(n[others], n[u])) & (ids[others] != ids[u])]
            if len(near):
                near = near[setsketch.may_reach(regs[u], n[u], regs[near], n[near], least)]
            while len(near := np.array([i for i in near if find(int(ids[i])) != find(int(ids[u]))], int)):
                now, near = near[:64], near[64:]
                for i in now[_linked(_common(sets[u], [sets[j] for j in now]), n[u], n[now])].tolist():
                    a, b = find(int(ids[u])), find(int(ids[i]))
                    if a != b:
                        links.append((ids[u], ids[i]))
                        root[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])


def _candidates(reps: DataFrame) -> DataFrame:
    """Star edges (id, lead) between nodes that share a band."""
    rows = reps.select("id", F.explode("bands").alias("key"))
    groups = materialize(rows.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    return join_split(rows, groups, ["key"], "n").where("id <> lead").select("id", "lead")


def _blocks(n: str, n_bytes: str):
    """Blocks of so many documents and bytes."""
    return F.greatest(F.ceil(F.col(n) / BLOCK_DOCS), F.ceil(F.col(n_bytes) / BLOCK_BYTES)).cast("int")


def _dealt(blocks, seed: int):
    """A row's block."""
    return F.pmod(F.xxhash64(F.lit(seed), "id"), blocks).cast("int")


def near_links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Confirmed links (a, b) that join all that are joined. docs: id, text of the nodes; reps: id, n_bytes, bands, regs."""
    parts = max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    comps = materialize(components(_candidates(reps), "id", "lead").withColumnRenamed("component", "comp"), "comps")
    sized = comps.join(reps.select("id", "n_bytes"), "id").groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.sum("n_bytes").alias("bytes"))
    big = materialize(sized.where(((F.col("size") > TASK_DOCS) | (F.col("bytes") > TASK_BYTES)) & (F.col("size") > 2)), "big")
    any_big = big.limit(1).count() > 0
    large = materialize(join_split(comps, big, ["comp"], "size"), "large") if any_big else None
    rows = comps.join(large.select("id"), "id", "left_anti") if any_big else comps
    nodes = rows.join(reps.select("id", "regs"), "id").join(docs, "id")
    nodes = nodes.repartition(parts, "comp").sortWithinPartitions("comp", "id").select("comp", "id", "regs", "text")
    found = materialize(nodes.mapInArrow(_settle_groups, "a long, b long"), "links")
    if not any_big:
        return found
    # One pivot for each large component, against blocks of its members.
    blocks = _blocks("size", "bytes")
    pivots = large.groupBy("comp").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("p"), F.first("size").alias("size"), F.first("bytes").alias("bytes")).select("comp", F.col("p.id").alias("id"), "size", "bytes")
    pivots = materialize(pivots, "pivots")
    members = materialize(large.join(pivots.select("id"), "id", "left_anti").withColumn("block", _dealt(blocks, 3)), "members")
    own = pivots.select("comp", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "id", F.lit(True).alias("is_pivot"))
    sides = members.select("comp", "block", "id", F.lit(False).alias("is_pivot")).unionByName(own).join(docs, "id")
    sides = sides.repartition(parts, "comp", "block").sortWithinPartitions("comp", "block").select("comp", "block", "id", "is_pivot", "text")
    tried = materialize(sides.mapInArrow(_against_pivot, "comp long, pivot long, id long, linked boolean, far double, sc int, n_bytes long"), "tried")
    found = found.unionByName(tried.where("linked").select(F.col("pivot").alias("a"), F.col("id").alias("b")))
    if not tried.where("not linked").limit(1).count():
        return found
    # What it leaves over, in chunks, meets the blocks of near sizes; classes is one row for a component's class of size.
    classes = materialize(tried.groupBy("comp", "linked", "sc").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("b")), "classes")
    classes = classes.withColumn("blocks", _blocks("n", "b")).drop("b")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = join_split(tried, classes, ["comp", "linked", "sc"], "n")
    around = F.explode(F.array(*(F.col("sc") + d for d in (-1, 0, 1))))
    blocks_of = classes.select("comp", F.col("linked").alias("tl"), F.col("sc").alias("tsc"), F.col("blocks").alias("tn"))
    chunks_of = classes.where("not linked").select("comp", F.col("sc").alias("lsc"), F.col("blocks").alias("ln"))
    left = placed.where("not linked").withColumn("chunk", _dealt(F.col("blocks"), 5)).withColumn("tsc", around).join(blocks_of, ["comp", "tsc"]).where(f"not tl or far <= {2 * (1 - LINK[1] / LINK[0]) + 1e-9}")
    left = left.select("comp", F.col("sc").alias("lsc"), "chunk", "tl", "tsc", each("tn").alias("block"), F.lit(0).alias("side"), "id", "far", "linked")
    right = placed.withColumn("block", _dealt(F.col("blocks"), 3)).withColumn("lsc", around).join(chunks_of, ["comp", "lsc"])
    right = right.select("comp", "lsc", each("ln").alias("chunk"), F.col("linked").alias("tl"), F.col("sc").alias("tsc"), "block", F.lit(1).alias("side"), "id", "far", "linked")
    both = left.unionByName(right).join(reps.select("id", "regs"), "id").join(docs, "id")
    both = both.repartition(parts, *MEETING).sortWithinPartitions(*MEETING, "side")
    return found.unionByName(materialize(both.select(*MEETING, "side", "id", "far", "linked", "regs", "text").mapInArrow(_across, "a long, b long"), "across"))


def grouped(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(id, doc_id, n, n_shingles, node, component_id) of the units of docs (see common.units), and whether any stand for
    several rows. Units of one node are one group; units without words have none."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    rows, odd = units(docs)
    sig = materialize(rows.select("id", "doc_id", "n", "text").mapInArrow(_signatures, SIGNATURE), "signatures")
    some = sig.where("n_shingles > 0")
    groups = materialize(some.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("size")), "sets")
    reps = materialize(sig.join(groups.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n_bytes", "bands", "regs"), "reps")
    links = near_links(rows.select("id", "text"), reps)
    owned = some.select("id", "doc_id", "n", "n_shingles", "f1", "f2")
    if odd:  # units with one doc_id are one document
        sets = materialize(join_split(owned, groups, ["f1", "f2"], "size").select("doc_id", "rep").where("doc_id is not null").distinct(), "units_sets")
        first = sets.groupBy("doc_id").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1")
        links = links.unionByName(join_split(sets, materialize(first, "first"), ["doc_id"], "size").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")))
    labels = components(links, "a", "b")
    named = groups.join(labels, groups["rep"] == labels["id"], "left").select("f1", "f2", "size", "low", F.coalesce("component", "rep").alias("node"))
    if odd:  # a node is the least id of its units, not of its documents
        lows = materialize(named.groupBy("node").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("sets")), "lows")
        named = join_split(materialize(named, "named"), lows, ["node"], "sets").select("f1", "f2", "size", "node", "component_id")
    else:
        named = named.select("f1", "f2", "size", "node", F.col("node").alias("component_id"))
    full = join_split(owned, materialize(named, "sets"), ["f1", "f2"], "size").select("id", "doc_id", "n", "n_shingles", "node", "component_id")
    none = sig.where("n_shingles = 0").select("id", "doc_id", "n", "n_shingles", F.lit(None).cast("long").alias("node"), F.col("doc_id").alias("component_id"))
    if odd:  # a row without words goes with the other rows of its id
        also = full.where("id <> doc_id").groupBy("doc_id").agg(F.min("component_id").alias("other"), F.min("node").alias("at"))
        none = none.join(also, "doc_id", "left").select("id", "doc_id", "n", "n_shingles", F.coalesce("node", "at").alias("node"), F.coalesce("other", "component_id").alias("component_id"))
    return full.unionByName(none), odd


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    out, odd = grouped(docs)
    out = (repeated(out, "n") if odd else out).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_deduped(docs: DataFrame) -> DataFrame:
    """docs with one row of each group; rows with a null id and no words are groups by themselves."""
    out, odd = grouped(docs)
    if not odd:
        return docs.join(out.where("doc_id = component_id").select(F.col("doc_id").alias("__kept")), F.col("doc_id") == F.col("__kept"), "left_semi")
    # The survivor of a group: its least document, of several texts of that id the one with words and the least hash.
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", F.col("n_shingles") == 0, "id")
    own = F.coalesce("node", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.col("id")))
    kept = out.groupBy(own.alias("group"), F.col("node").isNull().alias("alone")).agg(F.min_by(F.struct("id", "doc_id", "n_shingles"), rank).alias("k")).select("k.*")
    kept = materialize(kept, "kept")
    plain = docs.join(kept.where("id = doc_id").select(F.col("doc_id").alias("__kept")), F.col("doc_id") == F.col("__kept"), "left_semi")
    # Rows that share id and text with others, and null ids: one row of each unit that is kept, all of empty null ids.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = F.col("doc_id").cast("long")
    unit = F.xxhash64(number.isNull(), number, F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text))
    some = docs.withColumn("__unit", unit).join(kept.where("not id <=> doc_id").select(F.col("id").alias("__unit"), F.col("n_shingles").alias("__n")), "__unit")
    empty = some.where("doc_id is null and __n = 0").select(*docs.columns)
    once = some.where("not (doc_id is null and __n = 0)").groupBy("__unit").agg(F.first(F.struct(*docs.columns)).alias("r")).select("r.*")
    return plain.unionByName(empty).unionByName(once.select(*docs.columns))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN m ON m.x = doc_id LEFT JOIN n USING (doc_id)
"""

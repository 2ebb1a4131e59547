"""Exact dedup, line dedup, mixing and sharding against plain Python."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest

from quern.llm import exact_dedup, line_dedup, mixing, sharding
from quern.llm.common import LOWER, UPPER, join_split

LOWERED = str.maketrans(UPPER, LOWER)


def test_exact_dedup(table, edges):
    got = exact_dedup.exact_dedup(table(edges)).collect()
    groups = defaultdict(list)
    for r in edges:
        groups[(r[1] or "").translate(LOWERED)].append(r[0])
    want = sorted((str(i), max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["digest"].hex()) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert exact_dedup.exact_dedup(table([])).count() == 0


def test_index_remembers_earlier_batches(spark, table, tmp_path):
    where = f"file://{tmp_path}/index"
    assert exact_dedup.exact_dedup(table([(1, "a"), (2, "b")]), where, "one").where("kept").count() == 2
    rows = [(7, "A"), (8, "c"), (9, "C")]
    for _ in range(2):  # a batch that is run again replaces itself
        second = {r["doc_id"]: r for r in exact_dedup.exact_dedup(table(rows), where, "two").collect()}
        assert not second[7]["kept"] and second[7]["keep_id"] == 1 and second[7]["group_size"] == 2
        assert second[9]["kept"] and not second[8]["kept"] and second[9]["group_size"] == 2
    third = exact_dedup.exact_dedup(table([(5, "a")]), where, "three").first()
    assert third["group_size"] == 3 and third["keep_id"] == 1 and not third["kept"]
    with exact_dedup.DigestIndex(spark, where) as index:
        before = sorted(map(str, index.read().drop("attempt").collect()))
        index.compact()
        assert sorted(map(str, index.read().drop("attempt").collect())) == before and len(before) == 3 and index.batches == ["one", "two", "three"]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quern_digests")]


def test_index_keeps_its_buckets(spark, table, tmp_path):
    where, rows = f"file://{tmp_path}/index", [(i, f"text {i}") for i in range(500)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        exact_dedup.exact_dedup(table(rows), where, "one")
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        again = exact_dedup.exact_dedup(table([(1000 + i, t.upper()) for i, t in rows]), where, "two")
        assert again.where("kept").count() == 0 and again.where("group_size = 2").count() == 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_exact_dedup_of_repeated_rows(table):
    rows = [(3, "x")] * 5000 + [(None, "X")] * 1000 + [(i, f"t{i % 50}") for i in range(10, 400)] + [(None, "alone")] * 3
    got = exact_dedup.exact_dedup(table(rows)).collect()
    count = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got)
    assert count[3, 3, 6000, True] == 5000 and count[None, 3, 6000, False] == 1000 and count[None, None, 3, True] == 3
    assert sum(r["kept"] for r in got) == 5000 + 50 + 3 and all(r["keep_id"] >= 350 for r in got if r["doc_id"] and r["doc_id"] >= 10)


def test_hot_keys_split(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 0, id) AS k")
    groups = rows.groupBy("k").count().withColumnRenamed("count", "n")
    out = join_split(rows, groups, ["k"], "n")
    assert "BroadcastHashJoin" in out._jdf.queryExecution().toString()
    assert out.count() == 5000 and out.where("k = 0 AND n = 1667").count() == 1667


@pytest.mark.parametrize("extra", [[], [(20 + i, f"x{i}\n Shared\tLine \nshared\tline\n") for i in range(4)]])
def test_line_dedup(table, edges, extra):
    rows = edges + extra
    got = {(r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.line_dedup(table(rows), min_docs=3).collect()}
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOWERED)
    owners = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            owners[key(line)].add(i)
    drop = {k for k, ids in owners.items() if k and len(ids) >= 3}
    want = set()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in drop]
        want.add((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert got == want
    assert line_dedup.line_dedup(table([])).count() == 0


def test_line_dedup_tells_null_from_zero(table):
    assert line_dedup.line_dedup(table([(0, "x"), (None, "x")]), min_docs=2).agg({"n_dropped": "sum"}).first()[0] == 2
    assert line_dedup.line_dedup(table([(5, "x"), (5, "x")]), min_docs=2).agg({"n_dropped": "sum"}).first()[0] == 0
    rows = [(1, "a\nb")] * 5000 + [(None, "a")] * 1000
    got = line_dedup.line_dedup(table(rows), min_docs=2).groupBy("doc_id", "n_lines", "n_dropped", "kept_text").count().collect()
    assert {tuple(r) for r in got} == {(1, 2, 1, "b", 5000), (None, 1, 1, "", 1000)}


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets(spark):
    def got(sizes, weights):
        df = spark.createDataFrame([(s, n, float(weights[s])) for s, n in sizes.items()], "source string, size long, weight double")
        return {r["source"]: r["target"] for r in mixing.targets(df).collect()}

    out = got({"a": 10, "b": 1000, None: 500}, {"a": 1, "b": 2, None: 3})
    assert out["a"] == 30 and out["b"] == pytest.approx(1480 * 2 / 5) and out[None] == pytest.approx(1480 * 3 / 5)
    assert got({"a": 0}, {"a": 1}) == {"a": 0.0}
    assert got({"a": 5, "b": 0}, {"a": 1, "b": 9}) == {"a": 5.0, "b": 0.0}


def flow_cost(passes, repeats=3):
    return sum(k * k for k in range(1, passes + 1))


def test_flow_is_the_cheapest(spark):
    """Against all integer flows of small cases: unit words, so that passes are whole."""
    rng = random.Random(11)
    for _ in range(25):
        names = ["a", "b", "c"][: rng.randint(2, 3)]
        cells, capacity = {}, {}
        for p in range(rng.randint(1, 3)):
            own = [c for c in [(s,) for s in names] + [tuple(names[:2])] if rng.random() < 0.6] or [(names[0],)]
            cells[p] = {c: 1 for c in own}
            capacity[p] = 1
        quota = {s: rng.randint(0, 4) for s in names}
        flow = mixing.min_cost_flow(capacity, quota, cells)
        arcs = [(p, c, s) for p in cells for c in cells[p] for s in c]
        best = None

        def all_flows(i, left, of_cell, of_pattern):
            if i == len(arcs):
                yield sum(of_pattern.values()), sum(flow_cost(n) for n in of_pattern.values())
                return
            p, c, s = arcs[i]
            for x in range(min(left[s], 3 - of_cell.get((p, c), 0)) + 1):
                yield from all_flows(i + 1, left | {s: left[s] - x}, of_cell | {(p, c): of_cell.get((p, c), 0) + x}, of_pattern | {p: of_pattern.get(p, 0) + x})

        best = min(((-n, cost) for n, cost in all_flows(0, quota, {}, {})))
        of_pattern = Counter()
        for (p, _), v in flow.items():
            of_pattern[p] += v
        assert (-sum(flow.values()), sum(flow_cost(n) for n in of_pattern.values())) == best
        assert all(v <= 3 * cells[p][c] for (p, c), v in flow.items())


def test_mix_balances_texts_of_several_sources(table, prose):
    """Texts that two sources share are repeated less than what a source has alone."""
    rows = [(i, prose(20, i), "en", "a") for i in range(40)] + [(100 + i, prose(20, 500 + i), "en", "b") for i in range(40)]
    rows += [(200 + i, prose(20, 900 + i // 4), "en", "ab"[i % 2]) for i in range(160)]
    got = mixing.mix(table(rows), {"a": 1, "b": 1}).collect()
    taken, shared = Counter(), Counter()
    for r in got:
        taken[r["member"][0]] += r["taken"]
        shared[r["doc_id"] >= 200] += r["taken"]
    # 80 texts stand once, 40 texts four times: with twice as many words as there are texts, each text goes twice.
    assert taken == {"a": 2400, "b": 2400} and shared == {False: 3200, True: 1600}


def test_mix_of_many_sources_and_repeated_rows(table, prose, monkeypatch):
    rows = [(i, prose(5 + i % 7, i), "en", f"s{i}") for i in range(2300)]
    got = mixing.mix(table(rows)).collect()
    assert len(got) == 2300 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    rows = [(7, prose(9, 1), "en", "a")] * 400 + [(None, prose(8, 2), "en", "b")] * 400 + [(900 + i, prose(5 + i % 30, 50 + i), "en", "abc"[i % 3]) for i in range(90)]
    results = []
    for cells, weights in ((mixing.MOST_BROADCAST, {"a": 1, "b": 2, "c": 1}), (mixing.MOST_BROADCAST, {"a": 2, "b": 1, "c": 2}), (1, {"a": 2, "b": 1, "c": 2})):
        monkeypatch.setattr(mixing, "MOST_BROADCAST", cells)
        got = mixing.mix(table(rows), weights).collect()
        taken, target = Counter(), {}
        for r in got:
            taken[r["member"][0]] += r["taken"]
            target[r["member"][0]] = r["target"]
        assert all(abs(taken[s] - target[s]) <= 35 for s in "abc"), (weights, taken, target)
        results.append(sorted(map(str, got)))
    assert results[1] == results[2]  # reruns agree, whether the plan is written or passes through the driver


def test_mix_of_rows_that_name_several_sources(spark, prose):
    rows = [(i, prose(10, i), [["a"], ["b"], ["a", "b"], []][i % 4]) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags array<string>")
    got = mixing.mix(docs, {"a": 1, "b": 1, None: 1}, "tags").collect()
    assert len(got) == 80 and all(0 <= r["taken"] <= 30 for r in got)
    assert sum(r["taken"] for r in got) == pytest.approx(sum(r["target"] for r in {tuple(r["member"]): r for r in got if len(r["member"]) == 1}.values()), abs=30)


def test_mix(table, edges, prose):
    rows = edges + [(100 + i, prose(5 + i % 40, i), "en", f"s{i % 3}") for i in range(300)] + [(900, prose(9, 1), "en", None)]
    got = mixing.mix(table(rows)).collect()
    assert sorted(str((r["doc_id"], r["size"])) for r in got) == sorted(str((r[0], words(r[1]))) for r in rows)
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        taken[r["member"][0]] += r["taken"]
        target[r["member"][0]] = r["target"]
    largest = max(words(t) for _, t, *_ in rows[len(edges):])
    assert all(abs(taken[s] - target[s]) <= largest for s in ("s0", "s2"))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(table(rows)).collect()))
    mixed = Counter(r["doc_id"] for r in mixing.mixed(table(rows)).collect())
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["taken"] // max(1, r["size"])
    assert mixed == +want
    assert mixing.mix(table([])).count() == 0 and mixing.mixed(table([])).count() == 0


@pytest.mark.parametrize("each", [5_000, 9])
def test_mix_fills_sources_with_long_documents(table, edges, prose, each, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", each)
    rows = edges + [(100 + i, prose(5 + i % 40, i), "en", f"s{i % 3}") for i in range(300)]
    rows += [(1000 + i, "word " * (6000 if i % 40 == 7 else 50), "en", "long") for i in range(120)]
    # In seeded order, long documents stand between the others and in front of them.
    for weights in ({"long": 2, "s0": 3, "s1": 3, "s2": 1, None: 1, "": 1}, {"long": 3, "s0": 1, "s1": 1, "s2": 1, None: 1, "": 1}, None):
        taken, left, target = Counter(), defaultdict(list), {}
        got = mixing.mix(table(rows), weights).collect()
        passes = {s: min(r["taken"] // r["size"] for r in got if r["member"][0] == s and r["size"]) for s in ("long", "s0", "s1", "s2")}
        for r in got:
            s = r["member"][0]
            taken[s] += r["taken"]
            target[s] = r["target"]
            if s in passes and r["size"] and r["taken"] == passes[s] * r["size"] < 3 * r["size"]:
                left[s].append(r["size"])
        for s in passes:
            gap = round(target[s]) - taken[s]
            assert gap >= 0 and all(n > gap for n in left[s]), (s, weights, gap, sorted(left[s])[:3])


@pytest.mark.parametrize("each", [20_000, 7])
def test_sharding(table, edges, prose, each, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", each)
    rows = edges + [(100 + i, prose(6, i), "en", f"s{i % 3}") for i in range(120)]
    got = sharding.shard(table(rows), 8).collect()
    assert sorted(str((r["doc_id"], r["source"], r["size"], r["text_crc32"])) for r in got) == sorted(str((r[0], r[3] if len(r) > 3 else None, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()))) for r in rows)
    counts = Counter(r["shard"] for r in got)
    assert len(counts) == 8 and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s])) for s in counts)
    mix = Counter((r["shard"], r["source"]) for r in got if r["source"] in ("s0",))
    assert max(mix.values()) - min(mix.values()) <= 1
    out = sharding.sharded(table(rows), 8)
    assert out.count() == len(rows) and sorted((r["shard"], r["slot"]) for r in out.collect()) == sorted((r["shard"], r["slot"]) for r in got)
    assert sharding.shard(table([])).count() == 0 and sharding.sharded(table([])).count() == 0


def test_sharding_is_the_plain_interleaving(spark, table, prose, monkeypatch):
    """Against one global sort: rank by hash within the source, then by fractional rank."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(sharding, "RANGE_ROWS", 11)
    rows = [(i if i % 50 else None, prose(1 + i % 9, i), "en", ["s0", "s1", "", None][i * i % 7 % 4]) for i in range(230)]
    docs = table(rows)
    crc = F.crc32(F.coalesce("text", F.lit("")))
    plain = [(r["doc_id"], r["source"], r["c"], r["h"] % 2**64) for r in docs.select("doc_id", "source", crc.alias("c"), F.xxhash64(F.lit(17), "doc_id", crc).alias("h")).collect()]
    first = lambda x: (-(2**63) if x is None else x)
    sizes, ranked = Counter(r[1] for r in plain), []
    for s in sizes:
        own = sorted((r for r in plain if r[1] == s), key=lambda r: (r[3], first(r[0]), r[2]))
        ranked += [((2 * k + 1) * 2**40 // (2 * sizes[s]), (s is None, s or ""), r[3], first(r[0]), r[2], r) for k, r in enumerate(own)]
    ranked.sort(key=lambda x: x[:5])
    shard = [k * 8 // len(ranked) for k in range(len(ranked))]
    want = {(x[5][0], x[5][2]): (shard[k], sum(s == shard[k] for s in shard[:k])) for k, x in enumerate(ranked)}
    assert {(r["doc_id"], r["text_crc32"]): (r["shard"], r["slot"]) for r in sharding.shard(docs, 8).collect()} == want


def test_shards_as_folders(spark, table, prose, tmp_path):
    rows = [(i, prose(4, i), "en", f"s{i % 3}") for i in range(100)]
    sharding.write_shards(table(rows), f"file://{tmp_path}/shards", 4)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((r[0], r[1]) for r in rows)
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == {i: 25 for i in range(4)}


def test_sharding_of_repeated_rows(table, monkeypatch):
    rows = [(1, "a")] * 3000 + [(None, "b")] * 1000 + [(i, f"t{i}") for i in range(2, 300)]
    for most in (10_000, 500):
        monkeypatch.setattr(sharding, "MOST_COPIES", most)
        out = sharding.sharded(table(rows), 8).collect()
        assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(rows)
        assert len({(r["shard"], r["slot"]) for r in out}) == len(rows)
        counts = Counter(r["shard"] for r in out)
        assert max(counts.values()) - min(counts.values()) <= 1


def test_mixing_weighs_every_pattern(table):
    """2,100 groups of sources; in each, b has one text alone with a, which has another: b takes it twice and a not at all."""
    n, rows = 2100, []
    for i in range(n):
        alone, shared, third = (" ".join([f"{k}{i}"] * size) for k, size in (("u", 10), ("x", 10), ("v", 30)))
        rows += [(4 * i, alone, "en", f"{i:05d}a"), (4 * i + 1, shared, "en", f"{i:05d}a"), (4 * i + 2, shared, "en", f"{i:05d}b"), (4 * i + 3, third, "en", f"{i:05d}c")]
    taken = {r["doc_id"]: (r["target"], r["taken"]) for r in mixing.mix(table(rows)).collect()}
    assert len(taken) == 4 * n
    assert Counter((k % 4, v) for k, v in taken.items()) == {(0, (10.0, 10)): n, (1, (10.0, 0)): n, (2, (20.0, 20)): n, (3, (30.0, 30)): n}


def test_flow_with_many_copies_beside_many_patterns():
    """A text of 20,000 copies needs as many passes; those of other patterns are over by then."""
    cells = {i: {("a",): 10, ("b",): 10} for i in range(3000)} | {"hot": {("a",): 200_000, ("b",): 10}}
    began = time.time()
    flow = mixing.min_cost_flow({i: 10 for i in cells}, {"a": 600_000, "b": 90_000}, cells)
    assert sum(v for (p, c), v in flow.items() if c == ("a",)) == 600_000 and sum(v for (p, c), v in flow.items() if c == ("b",)) == 90_000
    assert time.time() - began < 60

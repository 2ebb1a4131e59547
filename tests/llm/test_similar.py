"""Near-dedup, substring dedup and decontamination against brute force and planted cases."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import decontaminate, near_dedup, setsketch, substring_dedup, textops
from quern.llm.common import LOWER, UPPER
from quern.llm.components import components

LOWERED = str.maketrans(UPPER, LOWER)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWERED))


def shingle_set(t):
    w = split(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_word_hashes(monkeypatch):
    monkeypatch.setattr(textops, "PIECE", 40)
    texts = ["", "a b", " A  b ", None, "longer words of several pieces " * 9, "x" * 100 + " y", "end"]
    h, at = textops.words(*textops.buffers(pa.array(texts)))
    ids = {}
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        w = split(t)
        assert len(w) == b - a
        for x, y in zip(w, h[a:b].tolist(), strict=True):
            assert ids.setdefault(x, y) == y
    assert len(set(ids.values())) == len(ids)
    assert [len(s) for s in textops.shingles(h, at, 5)] == [len(shingle_set(t)) for t in texts]


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**63, 3000, np.uint64)
    a, b = np.sort(x[:2000]), np.sort(x[500:2500])  # similarity 0.6
    one = lambda s: setsketch.sketch(s, np.array([0]))[0]
    assert (setsketch.merge(one(a), one(b)) == one(np.unique(np.concatenate([a, b])))).all()
    assert (one(a) == one(b)).mean() == pytest.approx(0.6, abs=0.12)
    near = np.sort(np.concatenate([a[:1950], x[2500:2550]]))
    regs = np.stack([one(near), one(b), one(x[2500:])])
    assert setsketch.may_reach(one(a), len(a), regs, np.array([2000, 2000, 500]), 0.75).tolist()[::2] == [True, False]


def brute_components(rows):
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    label = {i: i for i in sets}
    for _ in range(len(label)):
        old = dict(label)
        for i in sets:
            for j in sets:
                n = len(sets[i] & sets[j])
                if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
        if old == label:
            break
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.fixture(scope="module")
def near_rows(prose):
    rng, rows = random.Random(4), []
    for g in range(6):
        words = prose(90, g).split()
        for k in range(14):
            w = list(words)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"edit{rng.randint(0, 9)}"
            rows.append((g * 100 + k, "  ".join(w).upper() if k % 5 == 0 else "\n".join(w)))
    shared = prose(60, 77)
    rows += [(700 + i, f"{shared} {prose(90, 200 + i)}") for i in range(25)]  # alike, but not enough
    return rows + [(900, "one two"), (901, "ONE  two"), (902, "one two three"), (903, ""), (904, " "), (905, None)]


@pytest.mark.parametrize("most", [2000, 5])
def test_near_dedup(table, near_rows, most, monkeypatch):
    monkeypatch.setattr(near_dedup, "TASK_DOCS", most)
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(table(near_rows)).collect()}
    assert got == brute_components(near_rows)


@pytest.mark.parametrize("docs,size", [(1000, 3000), (4, 10**9)])
def test_near_dedup_in_blocks_by_bytes(table, near_rows, docs, size, monkeypatch):
    """Blocks of few documents or few bytes give the same components."""
    monkeypatch.setattr(near_dedup, "TASK_DOCS", 5)
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", docs)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", size)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(table(near_rows)).collect()}
    assert got == brute_components(near_rows)


def test_settling_takes_few_times_its_texts():
    """One-letter words have the most hashes a byte: 4 bytes of them for each byte of text."""
    rng, k = np.random.default_rng(3), 12
    base = rng.integers(97, 123, 300_000).astype(np.uint8)
    texts = []
    for _ in range(k):
        w = np.full(2 * len(base), 32, np.uint8)
        w[::2] = base
        w[2 * rng.integers(0, len(base), 500)] = 97
        texts.append(w.tobytes().decode())
    regs = [setsketch.sketch(x, np.array([0]))[0].tobytes() for t in texts for x in textops.shingles(*textops.words(*textops.buffers(pa.array([t]))), 5)]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * k), pa.array(range(k)), pa.array(regs, pa.binary()), pa.array(texts)], names=["comp", "id", "regs", "text"])
    list(near_dedup._settle_groups(iter([batch])))  # tables of powers are made once
    tracemalloc.start()
    links = sum(b.num_rows for b in near_dedup._settle_groups(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links == k - 1
    assert peak < 8 * sum(map(len, texts)) + 40_000_000


def test_common_counts_sets_of_any_size(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 900, n).astype(np.uint64)) for n in (1, 5, 400, 3, 90, 2000, 7)]
    want = [len(set(sets[4].tolist()) & set(x.tolist())) for x in sets]
    for most in (1, 8, 100, 10**6):
        monkeypatch.setattr(near_dedup, "LOOKUP", most)
        assert near_dedup._common(sets[4], sets).tolist() == want


def test_near_dedup_edges(table, edges):
    got = near_dedup.near_dedup(table(edges)).collect()
    assert len(got) == len(edges)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["component_id"] == 4 and not by[5]["kept"] and by[None]["component_id"] == 4 and not by[None]["kept"]
    assert by[1]["n_shingles"] == 0 and by[1]["kept"] and by[9]["component_id"] == 8
    assert near_dedup.near_dedup(table([])).count() == 0


def test_near_dedup_of_repeated_rows(table, prose):
    """Rows that repeat id and text, ids with several texts, and null ids, thousands of each."""
    one, two, near = prose(60, 41), prose(60, 42), prose(60, 41) + " and more"
    rows = [(7, one)] * 5000 + [(None, two)] * 1000 + [(9, near), (11, two + " end"), (13, prose(50, 43)), (13, one.upper()), (13, ""), (15, prose(50, 43))]
    rows += [(None, "")] * 20 + [(None, None)] * 3 + [(None, prose(20, 44))] * 4 + [(17, " ")] * 6
    docs = table(rows)
    got = near_dedup.near_dedup(docs).groupBy("doc_id", "n_shingles", "component_id", "kept").count().collect()
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]): r["count"] for r in got}
    assert got == {
        (7, 56, 7, True): 5000, (None, 56, 11, False): 1000, (9, 58, 7, False): 1, (11, 57, 11, True): 1, (13, 46, 7, False): 1, (13, 56, 7, False): 1,
        (13, 0, 7, False): 1, (15, 46, 7, False): 1, (None, 0, None, True): 23, (None, 16, None, True): 4, (17, 0, 17, True): 6,
    }
    kept = near_dedup.near_deduped(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(7, one), (11, two + " end"), (17, " "), (None, prose(20, 44))] + [(None, "")] * 20 + [(None, None)] * 3, key=repr)


def test_size_classes_keep_links_near():
    n = np.arange(1, 4000)
    c = near_dedup.size_class(n)
    for i in n.tolist():
        largest = i * 100 // 75  # the largest set that can link with one of i
        assert c[min(largest, len(n)) - 1] - c[i - 1] <= 1


def test_settle_is_exact():
    rng = np.random.default_rng(8)
    hub = rng.integers(0, 2**63, 400, np.uint64)
    sets = [np.unique(np.concatenate([np.delete(hub, rng.choice(400, 50, False)), rng.integers(0, 2**63, 40, np.uint64)])) for _ in range(20)] + [np.unique(hub)]
    regs = np.stack([setsketch.sketch(s, np.array([0]))[0] for s in sets])
    label = list(range(len(sets)))
    find = lambda i: i if label[i] == i else find(label[i])
    for a, b in near_dedup.settle(sets, regs):
        label[find(a)] = find(b)
    assert len({find(i) for i in range(len(sets))}) == 1


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2040)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    label = {x: x for p in pairs for x in p}
    for _ in range(100):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: label[x] for x in touched}


@pytest.fixture(scope="module")
def planted(prose):
    passage, other = prose(60, 500).split(), prose(55, 501).split()
    fuzzy = list(passage)
    fuzzy[20], fuzzy[41] = "changed", "twice"
    del fuzzy[30]
    rows = [(i, f"{prose(40 + i, 600 + i)} {' '.join(passage)} {prose(30, 700 + i)}") for i in range(5)]
    rows += [(10, f"{prose(50, 800)} {' '.join(fuzzy).upper()} {prose(9, 801)}"), (11, f"{prose(15, 802)}\n{' '.join(other)}"), (12, f"{' '.join(other)}\n{prose(200, 803)}")]
    clean = [(50 + i, f"{prose(80, 900 + i)} Licensed under the Apache License, Version 2.0.") for i in range(10)]
    return rows, clean


def test_substring_dedup(table, planted, edges):
    rows, clean = planted
    got = substring_dedup.shared_passages(table(rows + clean + edges)).collect()
    found = {x for r in got for x in (r["doc_id"], r["partner_id"])}
    assert {r[0] for r in rows} <= found and not found & {r[0] for r in clean}
    texts = dict(rows)
    for r in got:
        if r["doc_id"] in texts and r["partner_id"] in texts:
            a, b = split(texts[r["doc_id"]])[r["first_word"] : r["last_word"]], split(texts[r["partner_id"]])[r["partner_first"] : r["partner_last"]]
            assert 45 <= r["n_words"] <= 75 and r["similarity"] >= 0.75 and len(set(a) & set(b)) >= 35
    assert substring_dedup.shared_passages(table([])).count() == 0
    assert substring_dedup.shared_passages(table([(1, None), (2, ""), (None, "a b c d e f")])).count() == 0


def test_chains_rise_on_both_sides():
    rng = random.Random(3)
    anchors = sorted({(i * 6, 100 + i * 6, 4) for i in range(20)} | {(rng.randrange(120), rng.randrange(300), 4) for _ in range(30)})
    out = substring_dedup.chains(anchors)
    best = [anchors[i] for i in out[0]]
    assert len(best) >= 18 and sorted(i for c in out for i in c) == list(range(len(anchors)))
    assert all(x[0] < y[0] and x[1] < y[1] for c in out for x, y in zip([anchors[i] for i in c], [anchors[i] for i in c[1:]], strict=False))


def test_seeds_that_touch_are_one_block():
    pos = np.array([10, 12, 16, 40, 50, 12])
    d, e, p, q, n, seeds = substring_dedup.blocks_of(np.zeros(6, int), np.zeros(6, int), pos, np.array([110, 112, 116, 140, 151, 112]))
    assert list(zip(p, q, n, seeds, strict=True)) == [(10, 110, 10, 4), (40, 140, 4, 1), (50, 151, 4, 1)]


def test_anchors_of_seeds_over_batches():
    rows = [(1, 5, 7), (2, 6, 1), (3, 6, 9), (4, 6, 12), (5, 8, 1), (6, 9, 3), (7, 9, 4)]
    for cuts in range(1 << 6):
        batches, at = [], 0
        for i in range(1, 8):
            if i == 7 or cuts >> (i - 1) & 1:
                batches.append(pa.RecordBatch.from_arrays([pa.array([r[k] << 16 * (k == 1) for r in rows[at:i]], pa.int64()) for k in range(3)], names=["doc_id", "seed", "pos"]))
                at = i
        got = sorted(tuple(r.values()) for b in substring_dedup._meet(iter(batches)) for r in b.to_pylist())
        assert got == [(2, 2, 1, 1), (3, 2, 9, 1), (4, 2, 12, 1), (6, 6, 3, 3), (7, 6, 4, 3)]


def test_substring_dedup_of_pieces_that_short_documents_hold(table, prose):
    """Two long documents share a passage whose pieces are short documents of their own."""
    passage = prose(80, 560).split()
    rows = [(i, f"{prose(120, 570 + i)} {' '.join(passage)} {prose(120, 580 + i)}") for i in range(2)]
    rows += [(10, " ".join(passage[:40])), (11, " ".join(passage[40:])), (12, " ".join(passage[30:50]))]
    got = {(min(r["doc_id"], r["partner_id"]), max(r["doc_id"], r["partner_id"])): (r["first_word"], r["last_word"]) for r in substring_dedup.shared_passages(table(rows)).collect()}
    assert (0, 1) in got and abs(got[0, 1][0] - 120) <= 3 and abs(got[0, 1][1] - 200) <= 3


def test_substring_dedup_with_repeated_rows(table, prose):
    passage = prose(60, 590)
    rows = [(1, f"{prose(50, 591)} {passage}")] * 700 + [(2, f"{passage} {prose(50, 592)}")] + [(3, f"{passage} {prose(20, 593)}"), (3, f"{prose(30, 594)} {passage}")]
    rows += [(None, f"{passage} {prose(10, 595)}")] * 50
    got = substring_dedup.shared_passages(table(rows)).collect()
    pairs = {frozenset((r["doc_id"], r["partner_id"])) for r in got}
    assert len(got) <= 6 and set().union(*pairs) == {1, 2, 3} and all(len(x) == 2 for x in pairs)


def test_substring_dedup_two_passages_apart(table, prose):
    one, two = prose(60, 510), prose(60, 511)
    rows = [(i, f"{prose(50, 520 + i)} {one} {prose(80, 530 + i)} {two} {prose(50, 540 + i)}") for i in range(2)]
    got = sorted((r["first_word"], r["last_word"]) for r in substring_dedup.shared_passages(table(rows)).collect())
    assert len(got) == 2 and all(abs(x - y) <= 3 for r, want in zip(got, [(50, 110), (190, 250)], strict=True) for x, y in zip(r, want, strict=True))


def test_substring_dedup_finds_edited_passages(table, prose):
    rows, want, rng = [], set(), random.Random(6)
    for i in range(80):
        words = prose(60, 2000 + i).split()
        hit = {j for j in range(60) if rng.random() < (0.1, 0.15, 0.18, 0.2)[i % 4]}
        edited = [f"new{i}x{j}" if j in hit else x for j, x in enumerate(words)]
        if len(hit) <= 12:  # a share of 0.8 or more
            want.add(2 * i)
        rows += [(2 * i + k, f"{prose(70, 3000 + 2 * i + k)} {' '.join(w)} {prose(70, 4000 + 2 * i + k)}") for k, w in ((0, words), (1, edited))]
    got = {min(r["doc_id"], r["partner_id"]) for r in substring_dedup.shared_passages(table(rows)).collect()}
    assert len(want & got) >= 0.97 * len(want)


def local_score(a, b):
    """Best local alignment of two number arrays, all cells: equal words +1, others and gaps -2; its score and its span in a."""
    row, begin = np.zeros(len(b) + 1, int), np.zeros(len(b) + 1, int)
    best, ramp = (0, 0, 0), 2 * np.arange(len(b) + 1)
    for i, x in enumerate(a.tolist()):
        diagonal = row[:-1] + np.where(b == x, 1, -2)
        own, start = np.maximum(diagonal, row[1:] - 2), np.where(diagonal >= row[1:] - 2, begin[:-1], begin[1:])
        own, start = np.append(0, np.maximum(own, 0)), np.append(i + 1, np.where(own > 0, start, i + 1))
        # Gaps in a: the running best of score + 2 j.
        run = own + ramp
        lead = np.maximum.accumulate(run)
        where = np.maximum.accumulate(np.where(run == lead, np.arange(len(run)), 0))
        row, begin = lead - ramp, start[where]
        j = int(row.argmax())
        if row[j] > best[0]:
            best = int(row[j]), int(begin[j]), i + 1
    return best


def test_substring_dedup_against_all_pairs(table, prose):
    """Every pair of documents aligned in full: what shares 45 words or more lies within passages that were found."""
    rng, rows = random.Random(9), []
    passages = [prose(rng.randint(70, 140), 7000 + i).split() for i in range(10)]
    for i in range(80):
        words = prose(rng.randint(40, 140), 7100 + i).split()
        for _ in range(rng.randint(1, 2)):
            p = rng.choice(passages)
            cut = p if rng.random() < 0.7 else p[: len(p) // 2] if rng.random() < 0.5 else p[len(p) // 2 :]
            edited = [f"new{rng.randrange(999)}" if rng.random() < 0.05 else w for w in cut if rng.random() > 0.01]
            at = rng.randint(0, len(words))
            words[at:at] = edited
        rows.append((i, " ".join(words) if rng.random() < 0.9 else " ".join(edited)))
    number: dict = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in t.split()]) for _, t in rows]
    found = [set() for _ in docs]
    for r in substring_dedup.shared_passages(table(rows)).collect():
        found[r["doc_id"]] |= set(range(r["first_word"], r["last_word"]))
        found[r["partner_id"]] |= set(range(r["partner_first"], r["partner_last"]))
    wanted = hit = 0
    for i in range(len(docs)):
        for j in range(len(docs)):
            if i != j and (best := local_score(docs[i], docs[j]))[0] >= 45:
                wanted += 1
                hit += len(found[i] & set(range(best[1], best[2]))) >= 0.8 * (best[2] - best[1])
    print("pairs", wanted, "recall", hit / wanted)
    assert wanted > 200 and hit >= 0.95 * wanted


def test_winnowing_keeps_a_seed_in_every_window():
    rng = np.random.default_rng(1)
    runs, at = rng.integers(0, 2**63, 500, np.uint64), np.array([0, 3, 3, 200, 500])
    doc, pos = substring_dedup.winnowed(runs, at)
    for d in range(4):
        kept, n = set(pos[doc == d].tolist()), at[d + 1] - at[d]
        assert all(kept & set(range(s, s + substring_dedup.WINNOW)) for s in range(max(0, n - substring_dedup.WINNOW + 1))) and (n == 0 or kept)


def edit_distance(p, t):
    """Fewest edits of p against any part of t."""
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, table, prose, edges):
    items = [(i, prose(34, 300 + i)) for i in range(6)] + [(6, "short item"), (7, None), (8, ""), (9, "Fourteen words make a medium item here"), (10, "Zwölf Wörter über ein längeres Maß, größer als je, für schöne Übungen 日本語で")]
    typo = lambda s, seed: "".join("#" if random.Random(seed * 1000 + i).random() < 0.03 else c for i, c in enumerate(s))
    docs = [(100 + i, f"{prose(60, 400 + i)}  {items[i][1].upper()}\n{prose(20, 450 + i)}") for i in range(3)]
    docs += [(200 + i, f"{prose(10, 470 + i)} {typo(items[i][1], i)} {prose(200, 480 + i)}") for i in range(6)]
    docs += [(300, "Short  ITEM"), (301, "a short item in a text"), (302, f"xx {items[9][1]}"), (303, "a short items, shorts item")] + [(400 + i, prose(150, 490 + i)) for i in range(8)]
    docs += [(500, f"日本 {items[10][1]} und {prose(30, 499)}"), (501, items[10][1].replace("日本語で", "")), (502, items[10][1].replace("ö", "ŏ").replace("ü", "ŭ").replace("ß", "ş").replace("ä", "ă"))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(table(docs + edges), bench).collect()}
    texts = {i: decontaminate.exact(t) for i, t in docs}
    index = decontaminate.WindowIndex([x for x in items if x[1]])
    exact = {x[0]: decontaminate.exact(x[1] or "") for x in items}
    want = {(300, 6), (301, 6)}
    for w in range(len(index.own)):
        item = index.items[index.own[w]][0]
        piece = exact[item][index.offset[w] : index.offset[w] + index.size[w]]
        want |= {(d, item) for d, t in texts.items() if edit_distance(piece, t) <= index.budget[w]}
    assert set(got) == want and {(100, 0), (101, 1), (102, 2), (200, 0), (302, 9), (500, 10)} <= want and (502, 10) not in want
    r = got[300, 6], got[301, 6]
    assert [(x["first_char"], x["last_char"], x["edits"]) for x in r] == [(0, 10, 0), (2, 12, 0)]
    kept = {r["doc_id"] for r in decontaminate.clean(table(docs + edges), bench).collect()}
    assert kept == {r[0] for r in docs + edges} - {d for d, _ in want}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(table(docs), bench, short=60).collect()} >= {(302, 9)}
    assert decontaminate.matches(table([]), bench).count() == 0 and decontaminate.matches(table(docs), bench.limit(0)).count() == 0


def test_decontamination_finds_excerpts_at_any_offset(prose):
    item = prose(60, 350)[:233].strip().ljust(233, "x")
    index = decontaminate.WindowIndex([(0, prose(40, 351)), (1, item)])
    for size in (118, 75):
        excerpts = [item[i : i + size].strip() for i in range(233 - size + 1)]
        texts = [f"{prose(30, 5000 + i)} {x} {prose(30, 5500 + i)}" for i, x in enumerate(excerpts)]
        assert {(x[0], x[1]) for x in index.search(texts)} == {(i, 1) for i in range(len(texts))}
    assert not index.search([prose(200, 6000 + i) for i in range(50)])


def test_decontamination_in_blocks_and_parts(spark, table, prose, monkeypatch):
    items = [(i, prose(40, 300 + i)) for i in range(5)]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    monkeypatch.setattr(decontaminate, "PIECE", 900)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(decontaminate.blocks(bench))) > 1
    index = decontaminate.WindowIndex(items)
    long = [" ".join([prose(300, 1), items[2][1], prose(900, 2), items[4][1]])]
    assert {(x[0], x[1]) for x in index.search(long)} == {(0, 2), (0, 4)}

"""Language ID, quality and token counts: against brute force, held-out rows and the tokenizer library."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from quern.llm import language_id, quality, token_counts

SF = "/root/testdata/sf0.01"


def code_length(samples, text, order=language_id.ORDER):
    """PPM with escapes (method C), byte by byte."""
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    joined = language_id.START + language_id.START.join(t.lower().encode() for t in samples)
    for i in range(order, len(joined)):
        for k in range(order + 1):
            counts[k][joined[i - k : i]][joined[i]] += 1
    b, bits = language_id.START + text.lower().encode(), 0.0
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            if (c := counts[k].get(b[i - k : i])) is None:
                continue
            n, kinds = sum(c.values()), len(c)
            if b[i] in c:
                bits -= np.log2(c[b[i]] / (n + kinds))
                break
            bits -= np.log2(kinds / (n + kinds))
        else:
            bits += 8
    return bits


def test_code_lengths(prose, monkeypatch):
    monkeypatch.setattr(language_id, "PIECE", 64)
    samples = {"x": [prose(80, 1), "Ärger über Öl"], "y": [prose(60, 2).upper(), "§§ 日本"]}
    trees = language_id.ContextTrees(samples)
    texts = [prose(50, 3), "über", "", "日本 zz \x00", "a"]
    assert trees.bits(texts) == pytest.approx(np.array([[code_length(samples[x], t) for x in trees.langs] for t in texts]), rel=1e-5, abs=1e-4)


def test_language_edges(table, edges):
    docs = table(edges + [(50 + i, f"the cat number {i} sat on the mat", "en") for i in range(9)] + [(70 + i, f"der hund nummer {i} liegt auf dem sofa", "de") for i in range(9)])
    trees = language_id.learn(docs)
    got = {r["doc_id"]: r for r in language_id.language_id(docs, trees).collect()}
    assert got[1]["lang_pred"] == "und" and got[2]["lang_pred"] == "und" and got[3]["score"] == 0 and got[50]["lang_pred"] == "en" and got[71]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = table([])
    assert language_id.language_id(empty, language_id.learn(empty)).count() == 0
    assert language_id.learn(empty).predict(["text"]) == [("und", 0.0, 8.0)]


def test_language_ties(table):
    """Languages learned from the same texts tie; the one that sorts first wins, half each."""
    rows = [(i, f"the cat number {i % 9} sat", ("xx", "aa")[i // 9]) for i in range(18)]
    trees = language_id.learn(table(rows))
    assert trees.langs == ["aa", "xx"]
    assert [(x, round(p, 6)) for x, p, _ in trees.predict(["the cat sat", "THE CAT SAT"])] == [("aa", 0.5)] * 2


def test_texts_in_no_language_cost_more_than_no_model(spark, prose):
    trees = language_id.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    rng = np.random.default_rng(1)
    junk = ["".join(chr(33 + int(x)) for x in rng.integers(0, 90, 600)), "日本語のテキストです。これは長い文章です。" * 10, "0x3fa9b2 c0ffee deadbeef 1a2b3c4d " * 20, "Привет, как дела? " * 9]
    assert all(n > 8 for _, _, n in trees.predict(junk))
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").collect()]
    known = [n for x, _, n in trees.predict(texts) if x != "und"]
    assert np.mean(np.array(known) < 8) >= 0.999


def test_language_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = language_id.op4_language_id(spark, SF).collect()
    assert len(got) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.98


def test_gradients():
    """The gradient of the network against finite differences."""
    net = quality.ByteNet(1)
    texts, y, w = [b"some *** text | with | bars" * 40, b"plain"], np.array([0, 1], np.float32), np.ones(2, np.float32)

    def loss():
        net.pairs = None
        z = np.array([net.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] @ net.p["out"] + net.p["shift"][0] for t in texts], float)
        return float(np.mean(np.log1p(np.exp(np.where(y == 1, -z, z)))) + 0.5e-4 * (net.p["out"] ** 2).sum())

    grads = net._gradients(texts, y, w)
    for name, at in (("out", 3), ("shift", 0), ("bias", 2), ("filters", (1, 2, 5)), ("embed", (ord("*"), 1))):
        old, step = net.p[name][at], 1e-2
        net.p[name][at] = old + step
        up = loss()
        net.p[name][at] = old - step
        down = loss()
        net.p[name][at] = old
        assert (up - down) / (2 * step) == pytest.approx(float(grads[name][at]), abs=2e-3)


def naive_score(net, text):
    """The network byte by byte: one window at each byte, chunks of two blocks, zeros behind the end."""
    n, p = len(text), net.p
    padded = list(text) + [0] * (quality.WIDTH - 1)
    values = [p["bias"] + sum(p["embed"][padded[i + j]] @ p["filters"][j] for j in range(quality.WIDTH)) for i in range(n)]
    blocks = [np.maximum(0, np.max(values[i : i + quality.BLOCK], axis=0)) for i in range(0, n, quality.BLOCK)]
    chunks = [np.maximum(a, b) for a, b in zip(blocks, blocks[1:], strict=False)] or blocks
    f = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) if chunks else np.zeros(2 * quality.FILTERS)
    return 1 / (1 + np.exp(-float(f @ p["out"] + p["shift"][0])))


def test_scores_are_those_of_a_naive_network(prose):
    net = quality.ByteNet(5)
    texts = [b"", b"a", b"abcdef", prose(300, 1).encode(), prose(200, 2).encode()[:1024], prose(400, 3).encode()[:1025], bytes(range(256)) * 3]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert net.score(np.frombuffer(b"".join(texts), np.uint8), at) == pytest.approx([naive_score(net, t) for t in texts], abs=1e-5)


def test_scores_do_not_depend_on_neighbours(prose, monkeypatch):
    net = quality.ByteNet(2)
    texts = [b"", b"ab", prose(700, 1).encode(), prose(90, 2).encode(), b"x" * 511, b"y" * 512, b"z" * 513]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = net.score(np.frombuffer(b"".join(texts), np.uint8), at)
    alone = [net.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    monkeypatch.setattr(quality, "PIECE", 600)
    assert together == pytest.approx(alone) and net.score(np.frombuffer(b"".join(texts), np.uint8), at) == pytest.approx(alone)


def test_quality_edges_and_held_out(spark, table, edges):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    net = quality.learn(docs, labels, ~language_id.held_out(3, 1))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = {r["doc_id"]: r["predicted"] for r in quality.quality(docs, net).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    pairs = [(truth[d], p) for d, p in got.items() if d in truth]
    assert np.mean([a == b for a, b in pairs]) >= 0.9
    edge = quality.quality(table(edges), net).collect()
    assert len(edge) == len(edges) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in edge)
    assert quality.quality(table([]), net).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality(table(edges), quality.learn(docs, none)).collect()} == {0.5}


def test_tokens(table, edges, prose, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        counter = token_counts.PieceCounter(f.read())
    monkeypatch.setattr(token_counts, "HUGE", 300)
    monkeypatch.setattr(token_counts, "CHUNK", 120)
    monkeypatch.setattr(token_counts, "OVERLAP", 16)
    for t in (prose(2000, 1), "ab" * 3000, " " * 3000, "日本語テキスト" * 400, prose(900, 2).replace(" ", ""), "▁x " * 500, "\n\n\t" * 900, "<s></s><unk> <0x41>" * 90, "é" * 2000, ("a" * 700 + " ") * 3):
        assert counter.count(t) == len(counter.model.encode(t))
    got = token_counts.token_counts(table(edges), path, limit=100).collect()
    want = sorted(str((r[0], len((r[1] or "").encode()), len(counter.model.encode(r[1] or "")))) for r in edges)
    assert sorted(str((r["doc_id"], r["n_bytes"], r["n_tokens"])) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert token_counts.token_counts(table([]), path).count() == 0

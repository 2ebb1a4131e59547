"""Language ID by prediction by partial matching (PPM) under frozen statistics.

Each language gets a context tree of bytes: contexts of 3, 2, 1 and 0 bytes with the counts of the bytes that follow.
A byte is coded in the longest known context; if it has not followed there, an escape (method C: distinct followers /
(occurrences + distinct followers)) leads to the next shorter context, at last to 1/256. Statistics are frozen, so the
bits that a byte costs depend on it and the three bytes before it alone: they are tabulated once for every language,
and a text's exact code length is a sum of table entries over all its bytes. The shortest code wins; score is the
share of the winner among 2^-bits of all languages, and bits_per_byte what the winner needs for a byte: a text in no
learned language needs more than the 8 bits of no model at all. Case is folded.

The trees are learned from a bounded sample of the labelled rows: PER_LANG documents a language, MAX_SAMPLE in all,
none above SAMPLE_BYTES bytes, chosen by a hash of the id. Null text or a text without a letter: `und`, score 0. So is
every text if there is nothing to learn from. Ties go to the language that sorts first. Null ids are never learned from.
Repeated rows get equal predictions; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import bounded_arrow

PER_LANG, MAX_SAMPLE, SAMPLE_BYTES = 500, 3_000, 32_768
ORDER = 3
PIECE = 1 << 19
LETTER = re.compile(r"[^\W\d_]")
START = b"\n" * ORDER


class Lookup:
    """Places of 32-bit keys in a sorted array, by open addressing: a probe or two for a whole array of queries."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length() + 1)
        self.keys, self.at = np.zeros(1 << self.bits, np.uint32), np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]
            lost = self.at[slot] != left
            self.keys[slot[~lost]] = keys[left[~lost]]
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, q: np.ndarray) -> np.ndarray:
        slot = self._slot(q)
        out = self.at[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != q))
        while len(open_):
            slot_ = (slot[open_] + 1) & ((1 << self.bits) - 1)
            slot[open_], out[open_] = slot_, self.at[slot_]
            open_ = open_[(out[open_] >= 0) & (self.keys[slot_] != q[open_])]
        return out


def grams(a: np.ndarray) -> np.ndarray:
    """The four bytes up to each place from the fourth on, as one number."""
    a = np.ascontiguousarray(a)
    return np.ndarray((len(a) - 3,), ">u4", a, 0, (1,)).astype(np.uint32)


class ContextTrees:
    """Frozen statistics of all languages; bits(texts) gives code lengths."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        codes = []
        for lang in self.langs:
            joined = START + START.join(t.lower().encode() for t in samples[lang])
            g = grams(np.frombuffer(joined, np.uint8))
            codes.append(np.unique(g, return_counts=True))
        width = len(self.langs)
        tables = {}  # order: (sorted grams, counts by language)
        for k in range(ORDER + 1):
            mask = np.uint32(2 ** (8 * (k + 1)) - 1)
            own = [np.unique(c & mask, return_inverse=True) for c, _ in codes]
            sums = [np.bincount(inv, n) if len(n) else np.zeros(0) for (_, inv), (_, n) in zip(own, codes, strict=True)]
            keys = np.unique(np.concatenate([u for u, _ in own])) if own else np.zeros(0, np.uint32)
            counts = np.zeros((len(keys), width))
            for i, ((u, _), s) in enumerate(zip(own, sums, strict=True)):
                counts[np.searchsorted(keys, u), i] = s
            tables[k] = keys, counts
        self.levels = []
        for k in range(ORDER + 1):
            keys, counts = tables[k]
            ctx, inv = np.unique(keys >> np.uint32(8), return_inverse=True)
            total, kinds = np.zeros((len(ctx), width)), np.zeros((len(ctx), width))
            np.add.at(total, inv, counts)
            np.add.at(kinds, inv, (counts > 0).astype(float))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(counts / (total + kinds)[inv])
            short = keys & np.uint32(2 ** (8 * k) - 1 if k else 0)
            cost = np.where(counts > 0, seen, escape[inv] + self._cost(short, k - 1))
            self.levels.append((Lookup(keys), cost.astype(np.float32), Lookup(ctx), escape.astype(np.float32)))

    def _cost(self, g: np.ndarray, k: int) -> np.ndarray:
        """Bits of the last byte of each gram of k + 1 bytes, by language."""
        if k < 0:
            return np.full((len(g), len(self.langs)), 8.0, np.float32)
        find, cost, contexts, escape = self.levels[k]
        at = find.find(g)
        out = cost[at] if len(cost) else np.zeros((len(g), len(self.langs)), np.float32)
        if len(lost := np.flatnonzero(at < 0)):
            q = g[lost]
            more = self._cost(q & np.uint32(2 ** (8 * k) - 1 if k else 0), k - 1)
            if len(escape):
                c = contexts.find(q >> np.uint32(8))
                more = more + np.where(c[:, None] >= 0, escape[c], 0)
            out[lost] = more
        return out

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        piece, owner, held = [], [], 0
        most = max(4_096, PIECE * 4 // max(4, len(self.langs)))  # what a piece costs grows with the languages

        def flush():
            nonlocal piece, owner, held
            if piece:
                a = np.frombuffer(b"".join(piece), np.uint8)
                sizes = np.array([len(p) for p in piece])
                cost = self._cost(grams(a), ORDER)
                # A part is its own bytes after ORDER bytes of context; what codes the context is left out.
                starts = np.cumsum(sizes) - sizes
                ends = np.stack([starts, np.minimum(starts + sizes - ORDER, len(cost))], 1).ravel()
                sums = np.add.reduceat(np.concatenate([cost, np.zeros((1, cost.shape[1]), np.float32)]), np.minimum(ends, len(cost)), axis=0, dtype=np.float64)[::2]
                np.add.at(out, owner, sums)
            piece, owner, held = [], [], 0

        for i, t in enumerate(texts):
            b = START + t.lower().encode("utf-8", "surrogatepass")
            for a in range(0, len(b) - ORDER, most):
                piece.append(b[a : a + most + ORDER])
                owner.append(i)
                held += len(piece[-1])
                if held >= most:
                    flush()
        flush()
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, score and bits a byte of each text."""
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.langs else []
        out: list[tuple[str, float, float]] = [("und", 0.0, 8.0)] * len(texts)
        if known:
            bits = self.bits([texts[i] for i in known])
            best = bits.argmin(1)
            share = 1 / np.exp2(np.minimum(0, bits.min(1)[:, None] - bits)).sum(1)
            for i, b, p, n in zip(known, best.tolist(), share.tolist(), bits.min(1).tolist(), strict=True):
                out[i] = self.langs[b], p, n / len(texts[i].encode("utf-8", "surrogatepass"))
        return out


def held_out(parts: int, part: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def learn(docs: DataFrame, usable=None) -> ContextTrees:
    """Trees from the sample of the rows with a language (and for which `usable` holds)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES) & (F.octet_length("text") > 0))
    rows = (rows if usable is None else rows.where(usable)).withColumn("hash", F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id"), 1))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_SAMPLE).collect()
    each = min(PER_LANG, MAX_SAMPLE // max(1, len(counts)))
    # Twice the share that is needed, so that each language has enough; what is over is cut by the same order.
    cut = F.lit(0).cast("long")
    for r in counts:
        cut = F.when(F.col("lang") == r["lang"], F.lit(min(2**63 - 1, int(2.0**63 * min(1.0, 2 * max(each, 20) / r["n"]))))).otherwise(cut)
    found = rows.where(F.col("hash") <= cut).select("lang", "text", "hash", "doc_id").orderBy("hash", "doc_id", "text").limit(2 * MAX_SAMPLE).collect() if counts else []
    samples: dict[str, list[str]] = {}
    for r in found:
        if len(own := samples.setdefault(r["lang"], [])) < each:
            own.append(r["text"])
    return ContextTrees(samples)


def predictor(trees: ContextTrees, spark: SparkSession):
    """A column function: text to struct(lang_pred, score, bits_per_byte)."""
    bounded_arrow(spark)
    shared = spark.sparkContext.broadcast(trees)

    @F.arrow_udf("struct<lang_pred:string,score:double,bits_per_byte:double>")
    def predict(text: pa.Array) -> pa.Array:
        found = shared.value.predict(text.to_pylist())
        columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "bits_per_byte"])

    return predict


def language_id(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """docs with lang_pred, score and bits_per_byte; columns of these names are replaced."""
    return docs.withColumn("__found", predictor(trees, docs.sparkSession)(F.col("text"))).withColumns({c: F.col(f"__found.{c}") for c in ("lang_pred", "score", "bits_per_byte")}).drop("__found")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = learn(docs, ~held_out(4, 2))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return language_id(rows, trees).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")

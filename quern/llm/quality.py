"""Quality classifier: a byte-level convolutional network in numpy.

Each byte has a learned vector; learned filters look at WIDTH bytes at a time. A document is covered whole by chunks of
two blocks of BLOCK bytes, each overlapping the next by one block; a filter's largest value in a chunk is the chunk's
feature. The mean and the maximum of the chunks' features are combined into one probability. Null counts as empty; an
empty text gets the score that the bias alone gives.

The network is trained on the driver from a bounded sample of the labelled rows: MAX_SAMPLE documents of at most
SAMPLE_BYTES bytes, chosen by a hash of the id, with a fixed seed. Labels other than 0 and 1 are left out; several
labels of one document all count. Without labels every score is 0.5. Null ids are scored but never learned from, repeated
rows get equal scores, extra columns do not matter, and an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import textops
from quern.llm.common import bounded_arrow
from quern.llm.language_id import held_out

MAX_SAMPLE, SAMPLE_BYTES = 2_400, 6_000
WIDTH, DIM, FILTERS, BLOCK = 6, 8, 16, 512
EPOCHS, BATCH, RATE = 6, 32, 0.01
PIECE = 1 << 16


class ByteNet:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "filters": rng.normal(0, 0.3, (WIDTH, DIM, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "shift": np.zeros(1, np.float32),
        }
        self.rng, self.pairs = rng, None

    def _tables(self) -> list[np.ndarray]:
        """What two neighbouring bytes add to each filter, for each pair of places in the window."""
        if self.pairs is None:
            one = [self.p["embed"] @ self.p["filters"][j] for j in range(WIDTH)]
            self.pairs = [np.ascontiguousarray((one[j + 1][:, None, :] + one[j][None, :, :]).reshape(65536, FILTERS)) for j in range(0, WIDTH, 2)]
            self.pairs[0] = self.pairs[0] + self.p["bias"]
        return self.pairs

    def _windows(self, a: np.ndarray) -> np.ndarray:
        """Filter values of the window at each byte of a; a is followed by WIDTH - 1 further bytes."""
        n = len(a) - WIDTH + 1
        two = np.ndarray((len(a) - 1,), "<u2", a, 0, (1,)).astype(np.int64)
        t = self._tables()
        out = t[0][two[:n]]
        for j in range(1, WIDTH // 2):
            out += t[j][two[2 * j : 2 * j + n]]
        return out

    def features(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean and maximum over the chunks of each document; zeros for an empty one."""
        out = np.zeros((len(at) - 1, 2 * FILTERS), np.float32)
        sizes = np.diff(at)
        blocks = -(-sizes // BLOCK)
        tops = np.empty((int(blocks.sum()), FILTERS), np.float32)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        first = np.cumsum(blocks) - blocks
        begin = at[owner] + (np.arange(len(owner)) - first[owner]) * BLOCK
        end = np.minimum(begin + BLOCK, at[owner + 1]) if len(owner) else begin
        i = 0
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(end, begin[i] + PIECE, "right")))
            a = np.concatenate([data[begin[i] : end[j - 1] + WIDTH - 1], np.zeros(WIDTH - 1, np.uint8)])[: end[j - 1] - begin[i] + WIDTH - 1]
            # Windows that run past their document see zeros, not the next document: the last block's, and those of the
            # block before if the last one is shorter than a window.
            w, stop = self._windows(a), at[owner[i:j] + 1]
            for k in np.flatnonzero(stop - end[i:j] < WIDTH - 1).tolist():
                low = max(int(begin[i + k]), int(stop[k]) - WIDTH + 1)
                tail = self._windows(np.concatenate([data[low : stop[k]], np.zeros(WIDTH - 1, np.uint8)]))
                w[low - begin[i] : end[i + k] - begin[i]] = tail[: end[i + k] - low]
            tops[i:j] = np.maximum.reduceat(w, begin[i:j] - begin[i], axis=0)
            i = j
        if len(tops):
            np.maximum(tops, 0, out=tops)
            chunk = tops.copy()
            more = np.flatnonzero(owner[1:] == owner[:-1])
            chunk[more] = np.maximum(tops[more], tops[more + 1])
            # The last block of a document is a chunk of its own only if it is the only one.
            own = np.ones(len(tops), bool)
            own[1:] = ~((owner[1:] == owner[:-1]) & (np.append(owner[1:], -1)[1:] != owner[1:]))
            chunk, owner = chunk[own], owner[own]
            full = np.flatnonzero(sizes)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[full, FILTERS:] = np.maximum.reduceat(chunk, starts, axis=0)
            out[full, :FILTERS] = np.add.reduceat(chunk, starts, axis=0) / np.diff(np.append(starts, len(chunk)))[:, None]
        return out

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = self.features(data, at) @ self.p["out"] + self.p["shift"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))

    def fit(self, texts: list[bytes], labels: np.ndarray) -> ByteNet:
        if not len(texts) or labels.min() == labels.max():
            self.p["out"][:] = 0
            self.p["shift"][:] = 0 if not len(texts) else (3 if labels.max() else -3)
            return self
        share = labels.mean()
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for epoch in range(EPOCHS):
            order = self.rng.permutation(len(texts))
            for s in range(0, len(order), BATCH):
                grads = self._gradients([texts[i] for i in order[s : s + BATCH]], labels[order[s : s + BATCH]], weight[order[s : s + BATCH]])
                t += 1
                rate = RATE * (0.3 if epoch >= EPOCHS - 2 else 1)
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
                self.pairs = None
        return self

    def _gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        one = [self.p["embed"] @ self.p["filters"][j] for j in range(WIDTH)]
        n, wins, values, feats, spans = len(texts), [], [], np.zeros((len(texts), 2 * FILTERS), np.float32), []
        for i, t in enumerate(texts):
            a = np.frombuffer(t + b"\0" * (WIDTH - 1), np.uint8)
            k = len(t)
            w = self.p["bias"] + sum(one[j][a[j : j + k]] for j in range(WIDTH))
            cuts = range(0, max(1, k - BLOCK), BLOCK)  # chunks of two blocks, a block apart
            tops = np.array([w[c : c + 2 * BLOCK].argmax(0) + c for c in cuts])
            top = np.take_along_axis(w, tops, 0)
            wins.append(a[tops[:, :, None] + np.arange(WIDTH)]), values.append(top)
            act = np.maximum(top, 0)
            feats[i, :FILTERS], feats[i, FILTERS:] = act.mean(0), act.max(0)
            spans.append(act.argmax(0))
        z = feats @ self.p["out"] + self.p["shift"]
        d = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight / n).astype(np.float32)
        g = {k: np.zeros_like(x) for k, x in self.p.items()}
        g["out"], g["shift"] = feats.T @ d + 1e-4 * self.p["out"], np.array([d.sum()], np.float32)
        for i in range(n):
            k = len(values[i])
            up = np.repeat(self.p["out"][None, :FILTERS] * d[i] / k, k, 0)
            up[spans[i], np.arange(FILTERS)] += self.p["out"][FILTERS:] * d[i]
            up *= values[i] > 0
            g["bias"] += up.sum(0)
            emb = self.p["embed"][wins[i]]  # chunk, filter, place, dim
            g["filters"] += np.einsum("cf,cfwd->wdf", up, emb)
            np.add.at(g["embed"], wins[i], np.einsum("cf,wdf->cfwd", up, self.p["filters"]))
        return g


def learn(docs: DataFrame, labels: DataFrame, usable=None) -> ByteNet:
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    rows = (rows if usable is None else rows.where(usable)).select("doc_id", F.col("quality").cast("int").alias("y"))
    # At most MAX_SAMPLE rows: safe to broadcast.
    sample = rows.orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id", "y").limit(MAX_SAMPLE)
    texts = docs.select("doc_id", "text").where(F.octet_length("text").between(1, SAMPLE_BYTES)).join(F.broadcast(sample), "doc_id")
    found = texts.orderBy("doc_id", "y", "text").limit(MAX_SAMPLE).collect()
    return ByteNet().fit([r["text"].encode() for r in found], np.array([r["y"] for r in found], np.float32))


def quality(docs: DataFrame, net: ByteNet) -> DataFrame:
    """docs with score and predicted; columns of these names are replaced."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    shared = spark.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(*textops.buffers(text)), pa.float64())

    return docs.withColumn("score", score(F.col("text"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = learn(docs, labels, ~held_out(3, 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return quality(rows, net).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")

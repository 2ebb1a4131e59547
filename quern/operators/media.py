"""Bags of visual or audio words: MFCC descriptors, codebook, quantization, TF-IDF on histograms, segment normalization.

A descriptor table has (id, descriptor array<float>). WAV files are decoded here; descriptors of images come from a caller.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEED = 2026
# Words, iterations, descriptors the codebook reads at most.
WORDS, ITERATIONS, SAMPLE = 256, 25, 1_000_000

# Samples a second, window and hop, mel bands, coefficients, windows a file and seconds a file.
RATE, FRAME, HOP, BANDS, COEFFICIENTS, MOST_FRAMES, SECONDS = 22_050, 2_048, 512, 128, 13, 1_500, 30.0


def hertz_to_mel(f):
    """Slaney's scale: linear below 1000 Hz, logarithmic above."""
    f = np.asarray(f, float)
    return np.where(f < 1000, f * 3 / 200, 15 + 27 * np.log(np.maximum(f, 1e-9) / 1000) / np.log(6.4))


def mel_to_hertz(m):
    m = np.asarray(m, float)
    return np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))


def mel_filters(rate: int = RATE, frame: int = FRAME, bands: int = BANDS) -> np.ndarray:
    """Triangles of equal area over the bins of a spectrum, evenly spaced in mel."""
    bins = np.fft.rfftfreq(frame, 1 / rate)
    edges = mel_to_hertz(np.linspace(hertz_to_mel(0), hertz_to_mel(rate / 2), bands + 2))
    up = (bins[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - bins[None, :]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mfcc(signal: np.ndarray, rate: int = RATE, coefficients: int = COEFFICIENTS) -> np.ndarray:
    """Cepstral coefficients of each window: Hann, power spectrum, mel bands in decibels (80 below the peak at most), cosines."""
    if not len(signal):
        return np.empty((0, coefficients), np.float32)
    padded = np.concatenate([np.zeros(FRAME // 2), np.asarray(signal, float), np.zeros(FRAME // 2)])
    starts = np.arange(0, len(padded) - FRAME + 1, HOP)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)
    power = np.abs(np.fft.rfft(padded[starts[:, None] + np.arange(FRAME)] * window, axis=1)) ** 2
    level = 10 * np.log10(np.maximum(1e-10, power @ mel_filters(rate).T))
    level = np.maximum(level, level.max() - 80)
    turn = np.cos(np.pi * np.arange(coefficients)[:, None] * (np.arange(BANDS) + 0.5)[None, :] / BANDS) * np.sqrt(2 / BANDS)
    turn[0] /= np.sqrt(2)
    return (level @ turn.T).astype(np.float32)


def wav_samples(content: bytes, seconds: float = SECONDS) -> np.ndarray:
    """One channel at RATE from a PCM WAV file of 8, 16 or 32 bits; channels are averaged, other rates interpolated."""
    with wave.open(io.BytesIO(content)) as f:
        width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
        data = f.readframes(int(seconds * rate))
    kind = {1: np.uint8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}[width]
    x = np.frombuffer(data, kind).astype(float)
    x = ((x - 128) / 128 if width == 1 else x / 2 ** (8 * width - 1)).reshape(-1, channels).mean(1)
    return x if rate == RATE or not len(x) else np.interp(np.arange(int(len(x) * RATE / rate)) * rate / RATE, np.arange(len(x)), x)


def audio_descriptors(spark: SparkSession, path: str, most: int = MOST_FRAMES) -> DataFrame:
    """(id, descriptor) of the WAV files under a path: id is the file's path; a file that is no WAV gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows = mfcc(wav_samples(bytes(content)))[:most]
                except (wave.Error, EOFError, KeyError):
                    continue
                yield pd.DataFrame({"id": name, "descriptor": list(rows)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "id string, descriptor array<float>")


def codebook(descriptors: DataFrame, column: str = "descriptor", words: int = WORDS) -> KMeansModel:
    n = descriptors.count()
    feats = descriptors.select(array_to_vector(column).alias("features"))
    return KMeans(k=words, seed=SEED, maxIter=ITERATIONS).fit(feats if n <= SAMPLE else feats.sample(SAMPLE / n, seed=SEED))


def quantized(descriptors: DataFrame, model: KMeansModel, key: str = "id", column: str = "descriptor") -> DataFrame:
    """(id, word, n): how often each word occurs in each item."""
    feats = descriptors.select(F.col(key).alias("id"), array_to_vector(column).alias("features"))
    return model.transform(feats).groupBy("id", F.col("prediction").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def bow_tfidf(histogram: DataFrame) -> DataFrame:
    """(id, word, weight) from (id, word, n): (1 + ln n) (ln((N + 1) / (df + 1)) + 1), items scaled to length 1."""
    items = histogram.agg(F.count_distinct("id").alias("items"))
    df = histogram.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    raw = histogram.join(df, "word").join(F.broadcast(items))  # one row
    raw = raw.withColumn("w", (1 + F.log("n")) * (F.log((F.col("items") + 1) / (F.col("df") + 1)) + 1))
    return raw.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))).select("id", "word", "weight")


def zscored(frames: DataFrame, key: str, value: str) -> DataFrame:
    """(value - mean) / (deviation + 1e-6) within each key."""
    stats = frames.groupBy(key).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return frames.join(stats, key).withColumn("z", (F.col(value) - F.col("__m")) / (F.col("__s") + 1e-6)).drop("__m", "__s")


def contrast(ends: DataFrame) -> DataFrame:
    """(queries, contrast): the median over the queries of (farthest - nearest) / nearest. ends: query, near, far."""
    return ends.agg(F.count(F.lit(1)).alias("queries"), F.median((F.col("far") - F.col("near")) / F.col("near")).alias("contrast"))


def explained_variance(df: DataFrame, column: str, k: int) -> list[float]:
    """Shares of the variance that the first k principal components carry."""
    return PCA(k=k, inputCol="features", outputCol="out").fit(df.select(array_to_vector(column).alias("features"))).explainedVariance.toArray().tolist()

"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared in a normal form: A-Z lower-cased, runs of blanks as one space; places count its characters. An item
is searched as windows of WINDOW and of BRIEF characters that start every STEP characters (a shorter item is one window),
each with an edit budget of RATE of its length, so that an excerpt of BRIEF + STEP characters is found whatever its
offset. By the q-gram lemma a passage within e edits of a window of m characters shares at least m - q + 1 - q e of its
q-grams, on diagonals at most e apart. So shared q-grams are counted in overlapping diagonal bands, first of whole items
and then of the windows of those items that could reach the bound; bands under it are dropped, and what is left is
verified by a banded alignment with free ends.

Items of fewer than `short` characters (a parameter) have no room for edits and q-grams: they are searched exactly, as
whole words anywhere in a text. Null or empty documents and items match nothing. Repeated rows match alike. Null ids are
carried as null. An empty table, of documents or of items, gives an empty result.

The benchmark is a stated query set: it is searched in blocks of at most BLOCK_BYTES, whatever its size, each block's
index being broadcast; every document meets every block.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import bounded_arrow

Q, WINDOW, RATE, SHORT = 8, 100, 0.06, 24
#: Windows start every STEP characters; those of BRIEF characters find excerpts too short for one of WINDOW.
STEP, BRIEF = 10, 60
BAND = 16
BLOCK_BYTES = 4 << 20
PIECE = 1 << 19
#: Between documents in a piece, so that no band of a window reaches from one into the next.
GAP = b"\0" * (WINDOW + 4 * BAND)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BLANKS = re.compile("[\x20\x09-\x0d]+")


def _wide(error: UnicodeEncodeError) -> tuple[bytes, int]:
    """A byte from 128 up for each character beyond Latin-1."""
    return bytes(128 + ((ord(c) * 40503 >> 4) & 127) for c in error.object[error.start : error.end]), error.end


codecs.register_error("quern-wide", _wide)


def normal(text: str) -> bytes:
    """The normal form, one byte a character. Characters beyond Latin-1 share bytes: what is found there is verified."""
    return b" ".join(text.encode("latin-1", "quern-wide").lower().split())


def exact(text: str) -> str:
    """The normal form as characters; places are those of normal()."""
    low = text.translate({i: i + 32 for i in range(65, 91)})
    return " ".join(x for x in _BLANKS.split(low) if x)


def wide(text: str) -> bool:
    return not text.isascii() and max(text) > "\xff"


def grams(a: np.ndarray) -> np.ndarray:
    """The q characters from each place on, as one number."""
    return np.ndarray((len(a) - Q + 1,), "<u8", a, 0, (1,)).copy()


def fewest_edits(window: str, text: str) -> int:
    """Fewest edits of the window against any part of the text."""
    row = np.zeros(len(text) + 1, np.int64)
    chars, ramp = np.array([ord(c) for c in text]), np.arange(len(text) + 1)
    for i, c in enumerate(window, 1):
        step = np.append(i, np.minimum(row[:-1] + (chars != ord(c)), row[1:] + 1))
        row = np.minimum.accumulate(step - ramp) + ramp
    return int(row.min())


class WindowIndex:
    """The q-grams of a block's items, and their windows."""

    def __init__(self, items: list[tuple[int, str]], short: int = SHORT):
        self.items: list[tuple[int, bytes]] = []
        self.real: dict[int, str] = {}  # exact forms of items with characters that share bytes
        self.brief: dict[str, list[int]] = {}
        for item, text in items:
            b = normal(text)
            if not b:
                continue
            if len(b) < max(short, Q):
                self.brief.setdefault(f" {exact(text)} ", []).append(item)
                continue
            if wide(text):
                self.real[len(self.items)] = exact(text)
            self.items.append((item, b))
        self.words = None
        windows = []  # item, offset, size
        for k, (_, b) in enumerate(self.items):
            for size in (WINDOW, BRIEF):
                if size == WINDOW or len(b) > size:
                    windows += [(k, i, min(size, len(b))) for i in sorted({*range(0, max(1, len(b) - size), STEP), max(0, len(b) - size)})]
        windows.sort()
        self.own, self.offset, self.size = (np.array([w[i] for w in windows], np.int64) for i in range(3))
        self.first_window = np.searchsorted(self.own, np.arange(len(self.items) + 1))
        self.budget = (self.size * RATE).astype(np.int64)
        self.least = self.size - Q + 1 - Q * self.budget
        self.least_item = np.minimum.reduceat(self.least, self.first_window[:-1]) if self.items else np.zeros(0, np.int64)
        self.chars = np.zeros((len(windows), WINDOW), np.uint8)
        for k, (i, at, n) in enumerate(windows):
            self.chars[k, :n] = np.frombuffer(self.items[i][1][at : at + n], np.uint8)
        g = [grams(np.frombuffer(b, np.uint8)) for _, b in self.items]
        codes = np.concatenate(g) if g else np.zeros(0, np.uint64)
        order = np.argsort(codes, kind="stable")
        self.codes, first = np.unique(codes[order], return_index=True)
        self.first = np.append(first, len(codes))
        self.item = np.repeat(np.arange(len(g), dtype=np.int64), [len(x) for x in g])[order]
        self.place = np.concatenate([np.arange(len(x)) for x in g])[order] if g else np.zeros(0, np.int64)
        self.longest = max((len(b) for _, b in self.items), default=0)
        self.bits = max(16, int(16 * len(self.codes)).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.codes)] = True

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * _MUL) >> np.uint64(64 - self.bits)

    def _bands(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and bands (by first diagonal) with enough shared q-grams; diagonals are places in a less places in a window."""
        g = grams(a)
        at = np.flatnonzero(self.seen[self._slot(g)])
        g = g[at]
        k = np.searchsorted(self.codes, g)
        ok = self.codes[np.minimum(k, len(self.codes) - 1)] == g
        at, k = at[ok], k[ok]
        n = self.first[k + 1] - self.first[k]
        hit = np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        band = (np.repeat(at, n) - self.place[hit] + self.longest) // BAND  # never negative
        key = (self.item[hit] << 32) | band
        order = np.argsort(key, kind="stable")
        key, place = key[order], self.place[hit][order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        key, stop = key[start], np.append(start[1:], len(key))[: len(start)]
        n = stop - start
        # A band has two halves: each half with the next one, and the one before where that had no hit.
        next_to = np.diff(key) == 1
        both = n + np.append(np.where(next_to, n[1:], 0), 0)[: len(n)]
        upto = np.where(np.append(next_to, False)[: len(n)], np.append(stop[1:], 0)[: len(n)], stop)
        lone = np.insert(~next_to, 0, True)[: len(n)]
        key, both, start, upto = np.append(key, key[lone] - 1), np.append(both, n[lone]), np.append(start, start[lone]), np.append(upto, stop[lone])
        found: list[np.ndarray] = []
        diagonals: list[np.ndarray] = []
        for i in np.flatnonzero(both >= self.least_item[key >> 32]).tolist():
            own = int(key[i] >> 32)
            w = np.arange(self.first_window[own], self.first_window[own + 1])
            places = np.sort(place[start[i] : upto[i]])
            count = np.searchsorted(places, self.offset[w] + self.size[w] - Q, "right") - np.searchsorted(places, self.offset[w])
            w = w[count >= self.least[w]]
            found.append(w)
            diagonals.append(int(key[i] & 0xFFFFFFFF) * BAND - self.longest + self.offset[w])
        return (np.concatenate(found), np.concatenate(diagonals)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _align(self, a: np.ndarray, w: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fewest edits of each window in its band, and where that alignment ends; many at a time."""
        slack = int(self.budget.max(initial=0)) + 1
        width = 2 * BAND + 2 * slack
        before = slack + 2 * BAND + WINDOW
        text = np.concatenate([np.zeros(before, np.uint8), a, np.zeros(2 * WINDOW + width, np.uint8)])
        region = text[np.maximum(0, diagonal - slack + before)[:, None] + np.arange(width + WINDOW)]
        ramp = np.arange(width, dtype=np.int16)
        row = np.zeros((len(w), width), np.int16)
        for i in range(int(self.size[w].max(initial=0))):
            live = self.size[w] > i
            step = row + (region[:, i : i + width] != self.chars[w, i][:, None])
            step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
            step = np.minimum.accumulate(step - ramp, 1) + ramp
            row = step if live.all() else np.where(live[:, None], step, row)
        end = row.argmin(1)
        return row[np.arange(len(w)), end].astype(np.int64), diagonal - slack + end + self.size[w]

    def _brief(self, text: str) -> list[tuple[int, int, int]]:
        """Items below `short` in a text: item, first character, last character + 1."""
        if self.words is None:
            self.words = ahocorasick.Automaton()
            for x, own in self.brief.items():
                self.words.add_word(x, (len(x) - 2, own))
            self.words.make_automaton()
        return [(item, end - n, end) for end, (n, own) in self.words.iter(f" {exact(text)} ") for item in own for end in (end - 1,)]

    def __getstate__(self):
        return self.__dict__ | {"words": None}  # made anew where it is needed

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first character, last character + 1, edits) of the verified windows, places in the normal form."""
        out: list[tuple[int, int, int, int, int]] = []
        pieces, starts, held, at = [], [], [], 0

        def really(own: int, k: int, first: int, last: int) -> int:
            """Edits of window k by characters where some share bytes; more than its budget if they differ too much."""
            i, o, n = int(self.own[k]), int(self.offset[k]), int(self.size[k])
            item = self.real.get(i) or self.items[i][1].decode("latin-1")
            return fewest_edits(item[o : o + n], exact(texts[own])[max(0, first - n) : last + n])

        def flush():
            nonlocal pieces, starts, held, at
            if pieces and self.items:
                a = np.frombuffer(b"".join(pieces), np.uint8)
                w, d = self._bands(a)
                for i in range(0, len(w), 4096):
                    edits, end = self._align(a, w[i : i + 4096], d[i : i + 4096])
                    good = np.flatnonzero(edits <= self.budget[w[i : i + 4096]])
                    for j in good.tolist():
                        k = int(np.searchsorted(starts, end[j] - 1, "right")) - 1
                        if k < 0:
                            continue
                        (own, first), window, e = held[k], int(w[i + j]), int(edits[j])
                        a0, a1 = int(max(0, end[j] - self.size[window] - starts[k]) + first), int(end[j] - starts[k] + first)
                        if int(self.own[window]) in self.real or wide(texts[own]):
                            e = really(own, window, a0, a1)
                        if e <= self.budget[window]:
                            out.append((own, self.items[int(self.own[window])][0], a0, a1, e))
            pieces, starts, held, at = [], [], [], 0

        for i, t in enumerate(texts):
            if t and self.brief:
                out += [(i, item, first, last, 0) for item, first, last in self._brief(t)]
            b = normal(t) if t else b""
            # A long document is searched in parts that overlap by more than any match.
            for s in range(0, max(1, len(b) - 2 * WINDOW), PIECE - 2 * WINDOW) if len(b) >= Q else ():
                part = b[s : s + PIECE]
                starts.append(at)
                held.append((i, s))
                pieces += [part, GAP]
                at += len(part) + len(GAP)
                if at >= PIECE:
                    flush()
        flush()
        return out


def blocks(benchmark: DataFrame, short: int = SHORT) -> Iterator[WindowIndex]:
    """The benchmark's items in blocks of bounded size; it streams through the driver."""
    held, size = [], 0
    for r in benchmark.where("text is not null and item_id is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        held.append((int(r["item_id"]), r["text"]))
        size += len(r["text"].encode())
        if size >= BLOCK_BYTES:
            yield WindowIndex(held, short)
            held, size = [], 0
    if held:
        yield WindowIndex(held, short)


MATCH = "doc_id long, item_id long, first_char long, last_char long, windows int, edits int"


def matches(docs: DataFrame, benchmark: DataFrame, short: int = SHORT) -> DataFrame:
    """One row for each row of docs and item that meet: the span, the windows found in it, the fewest edits of one."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], MATCH)
    for index in blocks(benchmark, short):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, best = batch.column(0).to_pylist(), {}
                for i, item, first, last, edits in shared.value.search(batch.column(1).to_pylist()):
                    best.setdefault((i, item), []).append((first, last, edits))
                rows = [(ids[i], item, min(x[0] for x in m), max(x[1] for x in m), len({x[1] // BAND for x in m}), min(x[2] for x in m)) for (i, item), m in best.items()]
                types = [pa.int64()] * 4 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(6)], names=[x.split()[0] for x in MATCH.split(", ")])

        out = out.unionByName(rows.mapInArrow(run, MATCH))
    return out


def _hit(spark: SparkSession, index: WindowIndex):
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf("boolean")
    def hit(text: pa.Array) -> pa.Array:
        found = np.zeros(len(text), bool)
        found[[m[0] for m in shared.value.search(text.to_pylist())]] = True
        return pa.array(found)

    return hit


def clean(docs: DataFrame, benchmark: DataFrame, short: int = SHORT) -> DataFrame:
    """docs without the rows that meet any item; nothing is shuffled."""
    bounded_arrow(docs.sparkSession)
    for index in blocks(benchmark, short):
        docs = docs.where(~_hit(docs.sparkSession, index)(F.col("text")))
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

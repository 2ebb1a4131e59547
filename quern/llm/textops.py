"""Vectorised word and shingle hashes over Arrow text columns; blanks are the six ASCII ones, A-Z count as lower case."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes hashed at a time; temporary arrays take some thirty times as much.
PIECE = 1 << 20

_rng = np.random.default_rng(20240229)
NONBLANK = np.ones(256, bool)
NONBLANK[[9, 10, 11, 12, 13, 32]] = False
_CODES = _rng.integers(1, 2**64, 256, np.uint64, endpoint=False)
_CODES[65:91] = _CODES[97:123]
_CODES[~NONBLANK] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACES = _rng.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))[at[0] : at[-1]], at - at[0]


def _hashes(a: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a piece; docs: where documents begin."""
    global _powers
    word = NONBLANK[a]
    first = word.copy()
    first[1:] &= ~word[:-1]
    docs = docs[docs < len(a)]
    first[docs] = word[docs]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    if len(_powers) < len(a):
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(len(a), PIECE) - 1, _STEP, np.uint64)]), dtype=np.uint64)
    a = a[starts[0] :]
    place = np.arange(len(a)) - np.repeat(starts - starts[0], np.diff(np.append(starts - starts[0], len(a))))
    return mixed(np.add.reduceat(_CODES[a] * _powers[place], starts - starts[0])), starts


def _long(a: np.ndarray) -> np.ndarray:
    """Word hashes of one document of more than PIECE bytes, a piece at a time; a word beyond PIECE bytes is hashed by itself."""
    out, at, none = [], 0, np.zeros(1, np.int64)
    while at < len(a):
        piece = a[at : at + PIECE]
        blanks = np.flatnonzero(~NONBLANK[piece])
        if at + PIECE >= len(a):
            end = len(a)
        elif len(blanks):
            end = at + int(blanks[-1]) + 1
        else:
            end = at
            while end < len(a) and not len(blanks := np.flatnonzero(~NONBLANK[a[end : end + PIECE]])):
                end += PIECE
            end = min(len(a), end + (int(blanks[0]) if len(blanks) else 0))
            out.append(np.array([xxhash.xxh64_intdigest(a[at:end].tobytes().lower())], np.uint64))
            at = end
            continue
        out.append(_hashes(a[at:end], none)[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all documents in order, and the offsets of each document's words."""
    out, counts, i, n = [], np.zeros(len(at), np.int64), 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        if at[j] - at[i] > PIECE:
            h = _long(data[at[i] : at[j]])
            counts[j] = len(h)
        else:
            h, starts = _hashes(data[at[i] : at[j]], at[i:j] - at[i])
            counts[i + 1 : j + 1] = np.diff(np.searchsorted(starts, at[i : j + 1] - at[i]))
        out.append(h)
        i = j
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.cumsum(counts)


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words, by its first word; the last k - 1 are those of runs that end early."""
    out = np.empty(len(h), np.uint64)
    for at in range(0, len(h), PIECE // 4):
        part = h[at : at + PIECE // 4 + k - 1]
        run = np.zeros(min(PIECE // 4, len(h) - at), np.uint64)
        for j in range(min(k, len(part))):
            n = min(len(run), len(part) - j)
            run[:n] += part[j : j + n] * _PLACES[j]
        out[at : at + len(run)] = mixed(run)
    return out


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of k-word shingles of each document; with fewer words, one for the whole sequence."""
    runs = runs_of(h, k)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            s = np.sort(runs[a : b - k + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        else:
            yield runs_of(h[a:b], k)[:1]


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sets of all texts of a column; beside them, memory goes to one piece of the texts at a time."""
    data, at = buffers(column)
    out: list[np.ndarray] = []
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        out += shingles(*words(data[at[i] : at[j]], at[i : j + 1] - at[i]), k)
        i = j
    return out


def by_key(batches: Iterator[pa.RecordBatch], names: list[str], most: int = 0) -> Iterator[pa.Table]:
    """Runs of equal keys from batches that are sorted by them, one table for each run."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = np.zeros(batch.num_rows, bool)
        for name in names:
            col = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            cut[1:] |= col[1:] != col[:-1]
        new = bool(held) and any(held[-1].column(held[-1].schema.get_field_index(x))[-1] != batch.column(batch.schema.get_field_index(x))[0] for x in names)
        if new:
            yield pa.Table.from_batches(held)
            held = []
        at = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
        for a, b in zip(at[:-1], at[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)

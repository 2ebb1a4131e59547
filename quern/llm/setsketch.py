"""SetSketch registers: exponentially spaced truncated minima of a set, mergeable by maximum and locality-sensitive.

Register i is floor(1 - log_b(e_i)), cut to 0 .. Q + 1, where e_i is the least of exponential values (rate A) that the
set's elements draw for i. The least exponential value belongs to the least uniform hash, so only minima of hashes are
kept while a set is read.
"""

from __future__ import annotations

import numpy as np

BASE, RATE, Q = 1.001, 20.0, 2**16 - 2
#: 48 bands of 5 registers: a pair at similarity 0.75 shares no band with probability 2e-6.
BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS

_rng = np.random.default_rng(4111)
_MUL = _rng.integers(0, 2**63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, REGISTERS, np.uint64)
_BAND = _rng.integers(0, 2**63, (BANDS, ROWS + 1), np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers (sets x REGISTERS) of the sets that begin at starts in x; none is empty."""
    low = np.empty((REGISTERS, len(starts)), np.uint64)
    ends, i = np.append(starts[1:], len(x)), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 40_000, "right")))
        part, own = x[starts[i] : ends[j - 1]], starts[i:j] - starts[i]
        h = np.empty_like(part)
        for r in range(REGISTERS):
            np.multiply(part, _MUL[r], out=h)
            h += _ADD[r]
            low[r, i:j] = np.minimum.reduceat(h, own)
        i = j
    e = -np.log1p(-(low.astype(np.float64) + 0.5) * 2.0**-64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(e, 1e-300)) / np.log(BASE)), 0, Q + 1).astype(np.uint16).T


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def bands(registers: np.ndarray) -> np.ndarray:
    """A key for each band of each set, as signed 64-bit numbers; keys of different bands differ."""
    from quern.llm.textops import mixed

    r = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(_BAND[:, ROWS], r.shape[:2]).copy()
    for j in range(ROWS):
        key = mixed(key ^ (r[:, :, j] + np.uint64(1)) * _BAND[:, j])
    return key.view(np.int64)


def may_reach(a: np.ndarray, n_a: int, b: np.ndarray, n_b: np.ndarray, least: float, slack: float = 18.0) -> np.ndarray:
    """False for sets in b whose similarity to a is below `least` beyond doubt, by the joint likelihood of the registers.

    With known cardinalities the counts of larger, smaller and equal registers follow a multinomial law in the one
    unknown J. A set is ruled out if no J from `least` up comes within `slack` (natural log) of the best one.
    """
    above, below = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[0] - above - below
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    ll = sum(c[:, None] * np.log(np.maximum(q, 1e-12)) for c, q in ((above, up), (below, down), (same, 1 - up - down)))
    reach = np.where(grid >= least - 0.005, ll, -np.inf).max(1)
    return reach >= ll.max(1) - slack

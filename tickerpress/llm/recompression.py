"""Recompression of word sequences: runs and pairs become symbols, round by round.

The name of a symbol is a hash of what it stands for, so every task gives a run or
pair the same name without asking another.  Round by round, a run of equal symbols
is one symbol, then every left symbol followed by a right symbol is one symbol;
the side of a symbol is a bit of its name.  Whether a symbol arises at a place
depends on few words around it: its interval.  Equal stretches of words hold equal
symbols wherever the interval lies inside the stretch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
#: Rounds of pair naming; later rounds' intervals seldom fit into a window of 20 words.
ROUNDS = 4
_ODD1, _ODD2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


_BYTES = mix(np.arange(1, 64 * 256 + 1, dtype=U) * U(_ODD1))


def word_names(words: list[bytes]) -> np.ndarray:
    """A 64-bit name per word (at least one word): summed random values of (position, byte)."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size) - size
    at = np.arange(len(raw)) - np.repeat(start, size)
    value = _BYTES[(at & 63) * 256 + raw]
    if size.max() > 64:  # positions repeat from here on: tell the laps apart
        value = np.where(at < 64, value, mix(value + (at >> 6).astype(U)))
    return mix(np.add.reduceat(value, start) + size.astype(U))


class Spans:
    """Hashes of arbitrary stretches of a name sequence, from prefix sums (polynomial, mod 2**64)."""

    def __init__(self, names: np.ndarray, base: int = _ODD1):
        n = len(names) + 1
        with np.errstate(over="ignore"):
            up = np.full(n, base, dtype=U)
            up[0] = 1
            down = np.full(n, pow(base, -1, 1 << 64), dtype=U)
            down[0] = 1
            self.down = np.cumprod(down, dtype=U)
            self.sums = np.r_[U(0), np.cumsum(names * np.cumprod(up, dtype=U)[:-1], dtype=U)]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


def spans(names: np.ndarray) -> tuple[Spans, Spans]:
    """Two hashes that do not follow from each other."""
    return Spans(names), Spans(mix(names ^ U(_ODD2)), _ODD2)


@dataclass
class Level:
    """Symbols of a round in order; ``left`` and ``right`` bound their intervals."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray


def levels(names: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    """Symbols of all rounds, round 0 being the words, for sequences laid end to end.

    The end of a sequence is no word, so a symbol that depends on it gets an interval
    that reaches out of the sequence and fits into no window.
    """
    n = len(names)
    last, owner = np.cumsum(counts), np.repeat(np.arange(len(counts)), counts)
    first = last - counts
    start = np.arange(n)
    now = Level(names, start, start + 1, start, start + 1)
    out = [now]
    for r in range(rounds):
        if r == 0:  # equal pairs of later rounds stay apart, which costs length and no consistency
            now, owner = _runs(now, owner, first, last)
        now, owner = _pairs(now, owner, first, last, r)
        out.append(now)
    return out


def _runs(x: Level, owner, first, last):
    n = len(x.name)
    new = np.r_[True, (x.name[1:] != x.name[:-1]) | (owner[1:] != owner[:-1])]
    a = np.flatnonzero(new)
    z = np.r_[a[1:], n] - 1
    length, own = z - a + 1, owner[a]
    before, after = np.maximum(a - 1, 0), np.minimum(z + 1, n - 1)
    left = np.where((a > 0) & (owner[before] == own), x.left[before], first[own] - 1)
    right = np.where((z + 1 < n) & (owner[after] == own), x.right[after], last[own] + 1)
    name = np.where(length > 1, mix(x.name[a] * U(3) + length.astype(U)), x.name[a])
    return Level(name, x.start[a], x.end[z], left, right), own


def _pairs(x: Level, owner, first, last, r: int):
    n = len(x.name)
    leftish = mix(x.name + U(7919 * r + 13)) >> U(63) == 1
    joined = np.r_[leftish[:-1] & ~leftish[1:] & (owner[1:] == owner[:-1]), False]
    keep = np.flatnonzero(~np.r_[False, joined[:-1]])
    p, side, own = joined[keep], leftish[keep], owner[keep]
    after, before = np.minimum(keep + 1, n - 1), np.maximum(keep - 1, 0)
    has_after = (keep + 1 < n) & (owner[after] == own)
    has_before = (keep > 0) & (owner[before] == own)
    # A pair depends on itself, a lone left symbol on the next one, a lone right one on the one before.
    right = np.where(p, x.right[after], np.where(side, np.where(has_after, x.right[after], last[own] + 1), x.right[keep]))
    left = np.where(p | side, x.left[keep], np.where(has_before, x.left[before], first[own] - 1))
    name = np.where(p, mix(x.name[keep] * U(_ODD1) + mix(x.name[after] + U(r + 1))), x.name[keep])
    return Level(name, x.start[keep], np.where(p, x.end[after], x.end[keep]), left, right), own


def anchors(names: np.ndarray, counts: np.ndarray, window: int):
    """For every window the symbol that stands for it, chosen by the window's words alone.

    It is the symbol of least mixed name in the highest round that has one whose
    interval lies in the window.  Returns, for runs of neighbouring windows with
    the same symbol: first window, number of windows, interval start and end, round.
    """
    n = len(names)
    last = np.repeat(np.cumsum(counts), counts)
    at = np.arange(n)
    open_ = at + window <= last
    rnd, left, right = np.full(n, -1), np.full(n, -1), np.full(n, -1)
    for k, x in reversed(list(enumerate(levels(names, counts)))):
        w = at[open_]
        lo = np.searchsorted(x.left, w, "left")
        hi = np.searchsorted(x.right, w + window, "right")
        some = hi > lo
        w, lo, hi = w[some], lo[some], hi[some]
        if len(w):
            best = _argmin(mix(x.name + U(k)), lo, hi)
            rnd[w], left[w], right[w] = k, x.left[best], x.right[best]
            open_[w] = False
    w = np.flatnonzero(rnd >= 0)
    if not len(w):
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none, none
    new = np.r_[True, (w[1:] != w[:-1] + 1) | (left[w[1:]] != left[w[:-1]]) | (right[w[1:]] != right[w[:-1]])
                | (rnd[w[1:]] != rnd[w[:-1]]) | (last[w[1:]] != last[w[:-1]])]
    a = np.flatnonzero(new)
    head = w[a]
    return head, np.diff(np.r_[a, len(w)]), left[head], right[head], rnd[head]


def _argmin(value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the least value in each [lo, hi), the first of equal ones."""
    table, width = [np.arange(len(value))], 1
    most = int((hi - lo).max())
    while 2 * width <= most:
        t = table[-1]
        a, b = t[:-width], t[width:]
        table.append(np.where(value[b] < value[a], b, a))
        width *= 2
    power = np.frexp((hi - lo).astype(float))[1] - 1
    best = np.empty(len(lo), dtype=np.int64)
    for k, t in enumerate(table):
        mine = power == k
        a, b = t[lo[mine]], t[hi[mine] - (1 << k)]
        best[mine] = np.where(value[b] < value[a], b, a)
    return best

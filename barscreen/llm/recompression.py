"""Run-length grammars by recompression, and longest common extensions on them: the part of run detection in a task.

A sequence of symbols is compressed in rounds. A round of blocks replaces each maximal stretch of one symbol by a symbol
of its own; a round of pairs splits the symbols into left and right ones and replaces each left symbol followed by a
right one. Both decide by the symbols alone, so equal stretches are compressed alike but for their ends, and a symbol
names one text. Rounds go on until one symbol is left. Only each round's symbols and their parents are kept.

``extend`` answers many questions at once: how far two places agree, in O(log n) steps. It climbs while the places agree,
stepping over the rest of a symbol that began earlier, and descends to the first word that differs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Level:
    """One round: ``symbols``, the place of each one's parent in the next round, and the first place of each parent."""

    symbols: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    blocks: bool

    def backwards(self) -> Level:
        """The same round read from its end."""
        n, m = len(self.symbols), len(self.first) - 1
        return Level(self.symbols[::-1], (m - 1 - self.parent)[::-1], (n - self.first)[::-1], self.blocks)


def _names(keys: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """A number from 0 for each distinct key (of so many bits), in order of the keys."""
    n = len(keys)
    place = max(1, n - 1).bit_length()
    if bits + place <= 63:  # the key and its place in one number: a plain sort is faster than one that keeps places
        both = np.sort(keys << place | np.arange(n))
        order, keys = both & ((1 << place) - 1), both >> place
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    new = np.r_[True, keys[1:] != keys[:-1]]
    names = np.empty(n, np.int64)
    names[order] = np.cumsum(new) - 1
    return names, int(new.sum())


def _keys(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """One number for each pair of numbers, and its bits."""
    low = int(b.max()).bit_length()
    high = int(a.max()).bit_length()
    if low + high > 62:
        raise ValueError("too many symbols for one block")
    return a << low | b, low + high


def grammar(symbols: np.ndarray) -> list[Level]:
    """The rounds from ``symbols`` (non-negative int64) to a single symbol; the last round has no parents."""
    levels, now, used, seed = [], symbols, int(symbols.max()) + 1, 0
    while len(now) > 1:
        # blocks
        change = np.r_[True, now[1:] != now[:-1]]
        if not change.all():
            first = np.flatnonzero(change)
            length = np.diff(np.r_[first, len(now)])
            levels.append(Level(now, np.cumsum(change) - 1, np.r_[first, len(now)], True))
            now = now[first].copy()
            long = np.flatnonzero(length > 1)
            names, count = _names(*_keys(now[long], length[long]))
            now[long] = used + names
            used += count
            if len(now) == 1:
                break
        # pairs: the side of a symbol is a bit of its hash, of the two directions the one with more pairs
        seed += 1
        side = ((now.astype(np.uint64) + np.uint64(seed)) * ODD >> np.uint64(17 + seed % 31)).astype(np.uint8) & 1
        up, down = (side[:-1] < side[1:]), (side[:-1] > side[1:])
        pair = up if up.sum() >= down.sum() else down
        if not pair.any():
            continue
        left = np.flatnonzero(pair)
        starts = np.ones(len(now), bool)
        starts[left + 1] = False
        first = np.flatnonzero(starts)
        levels.append(Level(now, np.cumsum(starts) - 1, np.r_[first, len(now)], False))
        names, count = _names(*_keys(now[left], now[left + 1]))
        joined = now[first].copy()
        joined[levels[-1].parent[left]] = used + names
        now = joined
        used += count
    levels.append(Level(now, np.zeros(0, np.int64), np.zeros(1, np.int64), False))
    return levels


def extend(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols agree from places ``i`` and ``j`` (i < j) on. A symbol that occurs once must follow ``j``."""
    out = np.empty(len(i), np.int64)
    a, b, who = i, j, np.arange(len(i))
    stopped = []
    for level in levels[:-1]:
        if not len(who):
            break
        same = level.symbols[a] == level.symbols[b]
        # the rest of a symbol of the next round that began before either place
        at = np.flatnonzero(same)
        pa, pb = level.parent[a[at]], level.parent[b[at]]
        inside = (level.first[pa] != a[at]) | (level.first[pb] != b[at])
        step = np.where(inside, np.minimum(level.first[pa + 1] - a[at], level.first[pb + 1] - b[at]), 0)
        a, b = a.copy(), b.copy()
        a[at] += step
        b[at] += step
        same[at] = level.symbols[a[at]] == level.symbols[b[at]]
        stopped.append((who[~same], a[~same], b[~same]))
        up = np.flatnonzero(same)
        a, b, who = level.parent[a[up]], level.parent[b[up]], who[up]
    # one symbol is left at the top: two places can't both be there
    a, b, who = a[:0], b[:0], who[:0]
    for k in reversed(range(len(stopped))):
        level = levels[k]
        a, b = level.first[a], level.first[b]  # the first symbols of two that differ
        same = level.symbols[a] == level.symbols[b]
        if level.blocks:
            pa, pb = level.parent[a], level.parent[b]
            step = np.where(same, np.minimum(level.first[pa + 1] - a, level.first[pb + 1] - b), 0)
        else:
            step = same.astype(np.int64)
        w, x, y = stopped[k]
        a, b, who = np.r_[a + step, x], np.r_[b + step, y], np.r_[who, w]
    out[who] = a - i[who]
    return out


#: Pairs of places that are looked at together.
CANDIDATES = 1 << 21


def runs(symbols: np.ndarray, starts: np.ndarray, least: int = 24, repeats: int = 3) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of every maximal run of ``repeats`` periods and ``least`` symbols at least.

    ``symbols`` are texts one after another, each between symbols that occur once; ``starts`` has the place of each
    text's first symbol, and one more for the end (the place after the last text's closing symbol). The period is the
    smallest one. Ordered by text, start, period.

    The grid of a period has its multiples for places (those of ``least // repeats`` for a shorter one), and a run holds
    one place and two grids more. All grids of a text of n symbols have about n log n places. Those whose next symbols
    allow a run are extended both ways, which is exact.
    """
    nothing = tuple(np.zeros(0, np.int64) for _ in range(4))
    sizes = np.diff(starts) - 1
    most = sizes // repeats
    # texts by periods: all grid places of one period of many texts, or of many periods of one text, in a chunk
    texts = np.flatnonzero(sizes >= least)
    if not len(texts):
        return nothing
    text = np.repeat(texts, most[texts])
    ends = np.cumsum(most[texts])
    period = np.arange(1, ends[-1] + 1) - np.repeat(ends - most[texts], most[texts])
    grid = np.maximum(period, least // repeats)
    places = np.maximum(0, (sizes[text] - 1 - 2 * grid) // grid + 1)  # two grids further on is still in the text
    reach = np.cumsum(places)
    cuts = np.unique(np.r_[0, np.searchsorted(reach, np.arange(CANDIDATES, reach[-1], CANDIDATES)), len(text)])
    kept = []
    for x, y in zip(cuts[:-1], cuts[1:]):
        n = places[x:y]
        which = np.repeat(np.arange(x, y), n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        p, g = period[which], grid[which]
        i = starts[text[which]] + step * g
        # from the first grid place of a run on, all places agree with those p further on up to two grids less p
        for on in (lambda g: 0, lambda g: 1, lambda g: g // 2, lambda g: g):
            at = i + on(g)
            fit = np.flatnonzero(symbols[at] == symbols[at + p])
            i, p, g, which = i[fit], p[fit], g[fit], which[fit]
        kept.append((text[which], i, p, g))
    owner, i, p, g = (np.concatenate(c) for c in zip(*kept))
    if not len(i):
        return nothing
    levels = grammar(symbols)
    back = [level.backwards() for level in levels]
    found = []
    last = len(symbols) - 1
    for at in range(0, len(i), CANDIDATES):
        o, s, q, h = (c[at : at + CANDIDATES] for c in (owner, i, p, g))
        wanted = np.maximum(least, repeats * q)
        ahead = extend(levels, s, s + q)
        fit = h + q + ahead > wanted  # a run begins less than a grid before its first grid place
        o, s, q, h, ahead, wanted = (c[fit] for c in (o, s, q, h, ahead, wanted))
        # read from the end, the place before s + q comes first
        behind = extend(back, last - (s + q - 1), last - (s - 1))
        length = behind + q + ahead
        fit = (length >= wanted) & (behind < h)
        found.append(np.stack([o[fit], (s - behind)[fit] - starts[o[fit]], length[fit], q[fit]]))
    rows = np.unique(np.concatenate(found, axis=1), axis=1)  # by text, start, length, period
    if not rows.shape[1]:
        return nothing
    # a stretch with several periods: the smallest
    rows = rows[:, np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)]]
    return tuple(rows[:, np.lexsort((rows[3], rows[1], rows[0]))])

"""Bit-sliced Hamming search inside buckets of fingerprints: the part of SimHash that runs in a task.

Fingerprints are stored by bit plane: word ``k`` of plane ``b`` holds bit ``b`` of rows ``64 k`` to ``64 k + 63``.
One pass compares every row with the row ``shift`` places after it, 64 pairs to a word. Differing bits are counted
in vertical counters by carry-save adders, eight planes at a time, and blocks of 64 pairs are given up as soon as
all their pairs exceed the radius.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(rows, words) of uint64 as (bits, rows / 64 + 2): two words of padding serve the shifted reads."""
    n, words = fps.shape
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, words * 8), axis=1, bitorder="little")
    wide = np.zeros((words * 64, (n + 63) // 64 * 8 + 16), np.uint8)
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


def _save(a, b, c):
    """Carry-save adder: three words of equal weight give a sum word and a carry word."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _above(number: list, radius: int):
    """Lanes of a vertical number, lowest bit first, that exceed the radius."""
    over, tied = np.zeros_like(number[0]), ~np.zeros_like(number[0])
    for k in reversed(range(max(len(number), radius.bit_length()))):
        x = number[k] if k < len(number) else np.zeros_like(over)
        if radius >> k & 1:
            tied &= x
        else:
            over |= tied & x
            tied &= ~x
    return over


def close_lanes(planes: np.ndarray, lanes: np.ndarray, shift: int, radius: int) -> np.ndarray:
    """Which of the wanted lanes (bits of ``lanes``) differ from the lane ``shift`` further on in ``radius`` bits at most."""
    at = np.flatnonzero(lanes)
    alive = lanes[at]
    q, r = shift // 64, np.uint64(shift % 64)
    zero = np.zeros_like(alive)
    ones = twos = fours = zero
    high: list = []
    for p in range(0, len(planes), 8):
        part = planes[p : p + 8]
        other = part[:, at + q]
        if r:
            other = (other >> r) | (part[:, at + q + 1] << (np.uint64(64) - r))
        d = part[:, at] ^ other
        ones, a = _save(ones, d[0], d[1])
        ones, b = _save(ones, d[2], d[3])
        twos, e = _save(twos, a, b)
        ones, a = _save(ones, d[4], d[5])
        ones, b = _save(ones, d[6], d[7])
        twos, f = _save(twos, a, b)
        fours, carry = _save(fours, e, f)
        for k in range(len(high)):
            high[k], carry = high[k] ^ carry, high[k] & carry
        if carry.any():
            high.append(carry)
        if p % 32 == 24 or p + 8 >= len(planes) or len(planes) <= 64:
            alive = alive & ~_above([ones, twos, fours, *high], radius)
            left = np.flatnonzero(alive)
            if not len(left):
                break
            if 4 * len(left) < 3 * len(alive):
                at, alive, ones, twos, fours = at[left], alive[left], ones[left], twos[left], fours[left]
                high = [x[left] for x in high]
    out = np.zeros_like(lanes)
    out[at] = alive
    return out


def _packed(mask: np.ndarray, words: int) -> np.ndarray:
    wide = np.zeros(words * 8, np.uint8)
    packed = np.packbits(mask, bitorder="little")
    wide[: len(packed)] = packed
    return wide.view(np.uint64)


def links(bucket: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs of rows of one bucket, within the radius, that connect whatever all such pairs would connect.

    ``bucket`` is sorted. A pair whose rows are connected already isn't compared again, and a bucket that is
    wholly connected is left: a group of n near copies costs a few passes and gives n - 1 pairs, not n squared.
    """
    parent = np.arange(len(bucket))
    found: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    rows, shift, planes = np.arange(len(bucket)), 0, None
    while True:
        shift += 1
        if len(rows) <= shift:
            break
        b, tag = bucket[rows], parent[rows]
        starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        sizes = np.diff(np.r_[starts, len(b)])
        open_ = (sizes > shift) & (np.minimum.reduceat(tag, starts) != np.maximum.reduceat(tag, starts))
        keep = np.repeat(open_, sizes)
        if not keep.any():
            break
        if planes is None or 2 * keep.sum() < len(rows):
            rows, b, tag = rows[keep], b[keep], tag[keep]
            planes, keep = bit_planes(fps[rows]), np.ones(len(rows), bool)
        wanted = np.zeros(len(rows), bool)
        wanted[:-shift] = keep[:-shift] & (b[:-shift] == b[shift:]) & (tag[:-shift] != tag[shift:])
        words = planes.shape[1] - 2
        lanes = _packed(wanted, words)
        if not lanes.any():
            continue
        # reads past the last word reach padding only for lanes that aren't wanted
        q = shift // 64
        padded = planes if q == 0 else np.pad(planes, ((0, 0), (0, q)))
        near = close_lanes(padded, lanes, shift, radius)
        hits = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")[: len(rows)])
        for i, j in zip(rows[hits].tolist(), rows[hits + shift].tolist()):
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((i, j))
        if len(hits):
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent[:] = up
    return found

"""Hamming joins inside blocks: bit planes stored vertically, carry-save counters, abandoned word ranges."""

from __future__ import annotations

import numpy as np

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Planes compared between two looks at which words can be abandoned; ``_counted`` takes as many.
STEP = 16


def planes_of(rows: np.ndarray) -> np.ndarray:
    """(n, w) words of 64 bits as (64 * w, words) bit planes: lane i of a plane is that bit of row i."""
    n, w = rows.shape
    bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8).reshape(n, 8 * w), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    out = np.zeros((64 * w, 8 * (-(-n // 64) + 2)), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def _add(a, b, c):
    """Carry-save adder: three planes, or stacks of planes, of one weight make one of it and one of twice it."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _counted(x: np.ndarray) -> list[np.ndarray]:
    """Sixteen planes as the five planes of their count in each lane."""
    s, c = _add(x[0:5], x[5:10], x[10:15])
    t, d = _add(s[0:2], s[2:4], np.stack([s[4], x[15]]))
    one, e = t[0] ^ t[1], t[0] & t[1]
    s, f = _add(c[0:2], c[2:4], np.stack([c[4], e]))  # twos: c, d and e
    t, g = _add(s[0], s[1], d[0])
    two, h = t ^ d[1], t & d[1]
    s, i = _add(f[0], f[1], g)  # fours: f, g and h
    four, j = s ^ h, s & h
    return [one, two, four, i ^ j, i & j]


def within(planes: np.ndarray, shift: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Lanes i of ``valid`` (packed words) whose distance to lane i + shift is at most ``radius``.

    Sixteen planes at a time are counted by carry-save adders and added to counter planes, which start so high that
    radius + 1 differences carry out of the last one. A word leaves once all of its lanes have carried out.
    """
    words = np.flatnonzero(valid)
    left = valid[words]
    k = max(1, int(radius).bit_length())
    first = (1 << k) - 1 - radius
    counters = [np.full(len(words), ALL if first >> j & 1 else 0, np.uint64) for j in range(k)]
    over = np.zeros(len(words), np.uint64)
    q, r = divmod(shift, 64)
    for p in range(0, len(planes), STEP):
        part = planes[p : p + STEP]
        far = part[:, words + q]
        if r:
            far = (far >> np.uint64(r)) | (part[:, words + q + 1] << np.uint64(64 - r))
        far ^= part[:, words]
        bits = _counted(far)
        carry = None
        for j in range(k):
            if j < len(bits):
                if carry is None:
                    counters[j], carry = counters[j] ^ bits[j], counters[j] & bits[j]
                else:
                    counters[j], carry = _add(counters[j], bits[j], carry)
            else:
                counters[j], carry = counters[j] ^ carry, counters[j] & carry
        over |= carry
        for b in bits[k:]:
            over |= b
        alive = (left & ~over) != 0
        if not alive.all():
            words, left, over = words[alive], left[alive], over[alive]
            counters = [c[alive] for c in counters]
            if not len(words):
                return np.empty(0, np.int64)
    lanes = np.unpackbits((left & ~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(lanes)
    return words[at] * 64 + lane


class Forest:
    """Union-find over row numbers that tells which pairs joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            rr = self.up[r]
            if np.array_equal(rr, r):
                return r
            r = rr

    def join(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Positions of the pairs that were needed to link what they link."""
        apart = np.flatnonzero(self.roots(a) != self.roots(b))
        up, used = self.up, []
        for i in apart.tolist():
            x, y = int(a[i]), int(b[i])
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            if x != y:
                up[max(x, y)] = min(x, y)
                used.append(i)
        return used


def linked_pairs(group: np.ndarray, rows: np.ndarray, radii: tuple[int, ...], small: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that span, within each group, the graph of rows at the last radius or nearer.

    ``group``: a number per row, equal numbers adjacent. Smaller radii come first, so the tree prefers close pairs. Groups
    of at most ``small`` rows give all of their pairs within the last radius instead of a tree.
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(group)])
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 1]  # large groups first: those that a shift still reaches are a prefix
    if not len(order):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts, sizes = starts[order], sizes[order]
    ends = np.cumsum(sizes)
    index = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])
    place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    room = np.repeat(sizes, sizes) - place  # lanes i with room > d have a partner at i + d
    planes = planes_of(rows[index])
    big = int(sizes[sizes > small].sum())  # lanes of groups that give a tree
    forest, left, right = Forest(len(index)), [], []
    for radius in radii:
        for d in range(1, int(sizes[0])):
            reach = int(ends[np.searchsorted(-sizes, -d, side="left") - 1])
            if radius != radii[-1]:
                reach = min(reach, big)
            if not reach:
                break
            valid = np.packbits(room[:reach] > d, bitorder="little")
            padded = np.zeros(8 * -(-reach // 64), np.uint8)
            padded[: len(valid)] = valid
            a = within(planes, d, padded.view(np.uint64), radius)
            if len(a):
                tree = a[a < big]
                used = np.concatenate([tree[forest.join(tree, tree + d)], a[a >= big]])
                left.append(index[used])
                right.append(index[used + d])
    return np.concatenate([*left, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*right, np.empty(0, np.int64)]).astype(np.int64)

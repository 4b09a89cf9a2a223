"""Signature trees over sets of shingles, and their dual traversal."""

from __future__ import annotations

import numpy as np

FAN_OUT = 8
#: Bits of a signature; sets with more shared shingles are folded to this and checked exactly.
MOST_BITS = 1 << 15
#: Pairs of signatures that are compared at once.
CHUNK = 1 << 13
PIVOTS = 8


class SignatureTree:
    """Leaves are sets, in order of size; a node has the OR of its leaves' token bitmaps and their range of sizes.

    Only tokens of two sets or more get a bit, since others are in no intersection. Where
    all of them have a bit of their own, the AND of two leaves counts the intersection.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.order = np.argsort([len(s) for s in sets], kind="stable")
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        tokens, inverse, counts = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(counts > 1) - 1
        n_shared = int((counts > 1).sum())
        bits = max(64, min(MOST_BITS, -(-n_shared // 64) * 64))
        self.exact = n_shared <= bits
        leaf = np.repeat(np.arange(len(sets)), self.sizes)
        held = counts[inverse] > 1
        leaf, bit = leaf[held], shared[inverse[held]] % bits
        maps = np.zeros((len(sets), bits // 8), np.uint8)
        np.bitwise_or.at(maps, (leaf, bit >> 3), np.left_shift(1, bit & 7).astype(np.uint8))
        maps = maps.view(np.uint64)
        # shared tokens of a set that fell on a bit it has already
        slack = np.bincount(leaf, minlength=len(sets)) - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, self.sizes, self.sizes, slack)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, slack = self.levels[-1]
            at = np.arange(0, len(maps), FAN_OUT)
            self.levels.append(
                (np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at))
            )

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which pairs of nodes can hold sets x, y with den * |x & y| >= num * |x | y|."""
        maps, low, high, slack = self.levels[level]
        ok = (den * np.minimum(high[a], high[b]) >= num * np.maximum(low[a], low[b])).copy()
        at = np.flatnonzero(ok)
        for k in range(0, len(at), CHUNK):
            i = at[k : k + CHUNK]
            most = np.bitwise_count(maps[a[i]] & maps[b[i]]).sum(axis=1, dtype=np.int64) + np.minimum(slack[a[i]], slack[b[i]])
            most = np.minimum(most, np.minimum(high[a[i]], high[b[i]]))
            ok[i] = (den + num) * most >= num * (low[a[i]] + low[b[i]])
        return ok

    def linked(self, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which pairs of leaves link."""
        ok = self.may_link(0, a, b, num, den)
        if not self.exact:
            for k in np.flatnonzero(ok):
                x, y = self.sets[a[k]], self.sets[b[k]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok[k] = (den + num) * common >= num * (len(x) + len(y))
        return ok

    def links(self, labels: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
        """Links that join all sets connected by links, where sets of equal ``labels`` are joined already.

        Some pivots are compared with all sets first, as copies of one text then become one
        class. The dual traversal from the root leaves out node pairs of one class, and those whose
        largest possible overlap is too small; so every pair of two classes is decided.
        """
        label = np.unique(np.asarray(labels)[self.order], return_inverse=True)[1]
        n, found = len(label), []

        def join(a: np.ndarray, b: np.ndarray) -> None:
            for x, y in zip(a.tolist(), b.tolist()):
                if label[x] != label[y]:
                    label[label == label[y]] = label[x]
                    found.append((int(self.order[x]), int(self.order[y])))

        every = np.arange(n)
        for pivot in dict.fromkeys(np.linspace(0, n - 1, min(PIVOTS, n)).astype(int).tolist()):
            apart = every[label != label[pivot]]
            hit = apart[self.linked(np.full(len(apart), pivot), apart, num, den)]
            join(np.full(len(hit), pivot), hit)
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            step = FAN_OUT**level
            low, high = np.minimum.reduceat(label, np.arange(0, n, step)), np.maximum.reduceat(label, np.arange(0, n, step))
            apart = (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])
            a, b = a[apart], b[apart]
            if not level:
                hit = self.linked(a, b, num, den)
                join(a[hit], b[hit])
                continue
            ok = self.may_link(level, a, b, num, den)
            a, b = a[ok], b[ok]
            width = len(self.levels[level - 1][0])
            i, j = np.divmod(np.arange(FAN_OUT * FAN_OUT), FAN_OUT)
            x = (a[:, None] * FAN_OUT + i).ravel()
            y = (b[:, None] * FAN_OUT + j).ravel()
            keep = (x < width) & (y < width) & ((x < y) if level == 1 else (x <= y))
            x, y = x[keep], y[keep]
            stack += [(level - 1, x[k : k + CHUNK], y[k : k + CHUNK]) for k in range(0, len(x), CHUNK)]
        return found

"""Signature trees over sets of hashes, and the dual traversal of two of them.

A leaf is one set: its size and its token bitmap. A node above has the OR of its children's bitmaps and
the range of their sizes. A traversal goes down two trees at once, a level at a time, and leaves out
pairs of nodes whose largest possible overlap can't reach the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN = 8
#: Node pairs that are worked on at once, and words of bitmaps that are compared at once.
MOST_PAIRS, MOST_WORDS = 1 << 18, 1 << 22


def bitmap(own: np.ndarray) -> bytes:
    """Token bitmap, of twice as many bits as tokens at least (to 65536); a power of two, so that it folds."""
    size = min(65536, max(64, 1 << (2 * len(own) - 1).bit_length()))
    bits = np.zeros(size, dtype=np.uint8)
    bits[(own & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def common_bits(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many bits rows i of a and rows j of b share."""
    out = np.empty(len(i), np.int64)
    step = max(1, MOST_WORDS // max(1, a.shape[1]))
    for k in range(0, len(i), step):
        out[k : k + step] = np.bitwise_count(a[i[k : k + step]] & b[j[k : k + step]]).sum(axis=1, dtype=np.int64)
    return out


def leaves(n: np.ndarray, bits: np.ndarray, own: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    return n, n, bits, own, n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64), group, group


class Tree:
    """Signature tree over rows in their order; levels[0] are the rows, the last level is one node.

    A level has least size, largest size, bitmaps, signatures of what brought the rows here, the largest
    number of tokens that share a bit with others, and the range of the rows' classes.
    """

    def __init__(self, n: np.ndarray, bits: np.ndarray, own: np.ndarray, group: np.ndarray) -> None:
        level = leaves(n, bits, own, group)
        self.levels = [level]
        while len(level[0]) > 1:
            at = np.arange(0, len(level[0]), FAN)
            reduced = (np.minimum, np.maximum, np.bitwise_or, np.bitwise_or, np.maximum, np.minimum, np.maximum)
            level = tuple(f.reduceat(x, at, axis=0) for f, x in zip(reduced, level, strict=True))
            self.levels.append(level)

    def level(self, k: int) -> tuple[np.ndarray, ...]:
        return self.levels[min(k, len(self.levels) - 1)]

    def below(self, k: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(children, which of them there are) of nodes i of level k, a row each."""
        if k >= len(self.levels):  # above the root: the root stands for itself
            return i[:, None], np.ones((len(i), 1), dtype=bool)
        c = i[:, None] * FAN + np.arange(FAN)
        return c, c < len(self.levels[k - 1][0])


def _survivors(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node pairs that may hold a pair of rows which reaches the similarity, with their largest possible overlaps."""
    most = np.minimum(a[1][i], b[1][j])
    ok = (100 * b[1][j] >= percent * a[0][i]) & (100 * a[1][i] >= percent * b[0][j])
    ok &= ~((a[5][i] == a[6][i]) & (a[5][i] == b[5][j]) & (a[5][i] == b[6][j]) & (a[5][i] >= 0))
    i, j, most = i[ok], j[ok], most[ok]
    if len(i):
        ok = (a[3][i] & b[3][j]).any(axis=1)
        i, j, most = i[ok], j[ok], most[ok]
    if len(i):
        most = np.minimum(most, common_bits(a[2], i, b[2], j) + np.minimum(a[4][i], b[4][j]))
        ok = (100 + percent) * most >= percent * (a[0][i] + b[0][j])
        i, j, most = i[ok], j[ok], most[ok]
    return i, j, most


def possible(u: Tree, v: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of u, rows of v) that may reach the similarity; each pair once when u is v.

    Rows of one class (from 0) are not paired: a pair of nodes that are wholly of one class is left out.
    """
    zero = np.zeros(1, dtype=np.int64)
    stack = [(max(len(u.levels), len(v.levels)) - 1, zero, zero, False)]
    while stack:
        k, i, j, tested = stack.pop()
        if not tested:
            if u is v and k == 0:
                i, j = i[i < j], j[i < j]
            i, j, _ = _survivors(u.level(k), v.level(k), i, j, percent)
        if not len(i):
            continue
        if k == 0:
            yield i, j
            continue
        most = MOST_PAIRS // FAN**2
        if len(i) > most:
            stack.append((k, i[most:], j[most:], True))
            i, j = i[:most], j[:most]
        (c, has_c), (d, has_d) = u.below(k, i), v.below(k, j)
        both = has_c[:, :, None] & has_d[:, None, :]
        if u is v:
            both &= c[:, :, None] <= d[:, None, :]
        c, d = np.broadcast_arrays(c[:, :, None], d[:, None, :])
        stack.append((k - 1, c[both], d[both], False))


def candidates(n: np.ndarray, bits: list[bytes], own: np.ndarray, lead: np.ndarray, group: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of rows that may reach the similarity, of percent 50 or more; with two sides, of one and the other.

    Sizes fall into bands by the length of their bitmap, each band is a tree over its rows by lead and
    size, and a band meets itself and the next one, whose bitmaps are folded.
    """
    size = np.array([len(x) * 8 for x in bits], dtype=np.int64)
    sides = [side == s for s in np.unique(side)]
    for length in np.unique(size):
        trees: dict[tuple[int, int], tuple[np.ndarray, Tree]] = {}
        for s, mine in enumerate(sides):
            for folds in (1, 2):
                rows = np.flatnonzero(mine & (size == length * folds))
                if len(rows):
                    rows = rows[np.lexsort((n[rows], lead[rows]))]
                    m = np.frombuffer(b"".join([bits[r] for r in rows]), dtype=np.uint64).reshape(len(rows), -1)
                    if folds == 2:
                        m = m[:, : m.shape[1] // 2] | m[:, m.shape[1] // 2 :]
                    trees[s, folds] = rows, Tree(n[rows], m, own[rows], group[rows])
        meets = [((0, 1), (0, 1)), ((0, 1), (0, 2))] if len(sides) == 1 else [((0, 1), (1, 1)), ((0, 1), (1, 2)), ((0, 2), (1, 1))]
        for x, y in meets:
            if x in trees and y in trees:
                (r, u), (q, v) = trees[x], trees[y]
                for i, j in possible(u, v, percent):
                    yield r[i], q[j]


class Classes:
    """Rows that hang together; a class is named by its first row."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def _top(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def names(self) -> np.ndarray:
        out = np.array(self.up, dtype=np.int64)
        while len(out) and ((higher := out[out]) != out).any():
            out = higher
        return out

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        at = self.names()
        apart = at[i] != at[j]
        for x, y in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            x, y = self._top(x), self._top(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def hang_together(n: np.ndarray, bits: list[bytes], own: np.ndarray, lead: np.ndarray, group: np.ndarray, side: np.ndarray, percent: int) -> Classes:
    """Classes of rows that may be linked, directly or by others; rows of one group (from 0) are one from the start.

    Rows that follow each other by lead and size are tried first: most of a crowd of near copies is one
    class then, and the traversal leaves its nodes out.
    """
    out = Classes(len(n))
    order = np.argsort(group, kind="stable")
    known = order[group[order] >= 0]
    same = group[known][1:] == group[known][:-1]
    out.join(known[:-1][same], known[1:][same])
    if len(np.unique(side)) == 1 and len(n) > FAN:
        size = np.array([len(x) for x in bits])
        for length in np.unique(size):
            rows = np.flatnonzero(size == length)
            rows = rows[np.lexsort((n[rows], lead[rows]))]
            m = np.frombuffer(b"".join([bits[r] for r in rows]), dtype=np.uint64).reshape(len(rows), -1)
            flat = leaves(n[rows], m, own[rows], np.full(len(rows), -1))
            for step in (1, 2, 5):
                i, j, _ = _survivors(flat, flat, np.arange(max(0, len(rows) - step)), np.arange(step, max(step, len(rows))), percent)
                out.join(rows[i], rows[j])
    for i, j in candidates(n, bits, own, lead, out.names(), side, percent):
        out.join(i, j)
    return out

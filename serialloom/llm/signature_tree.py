"""Signature trees: similar sets found by dual traversal of OR-combined bitmaps.

A set of 64-bit tokens has a bitmap with one bit per token (the token's low bits). Sets
are sorted by size; leaves hold a few neighbours, and each node above holds the OR of its
members' bitmaps, the range of their sizes, and the largest slack, that is how many more
tokens than bits a member has. For x under node A and y under node B

    |x & y| <= popcount(OR_A & OR_B) + min(slack_A, slack_B)

and a link needs |x & y| >= t / (1 + t) * (|x| + |y|) and sizes within the factor t. Node
pairs that can't reach this are left with all their pairs; so are pairs of nodes whose
members all belong to one component already. Pairs of sets that remain get the same test,
then the exact intersection.
"""

import numpy as np

LEAF, FAN = 16, 8


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of uint64 words per set; as many bits as the largest set needs to stay sparse."""
    bits = 1 << max(8, int(np.ceil(np.log2(max(1, 3 * max(map(len, sets)))))))
    out = np.empty((len(sets), bits // 8), np.uint8)
    # a byte per bit for one set at a time
    row = np.zeros(bits, bool)
    for k, tokens in enumerate(sets):
        at = tokens.view(np.uint64) & np.uint64(bits - 1)
        row[at] = True
        out[k] = np.packbits(row)
        row[at] = False
    return out.view(np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Tokens in both of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


class Tree:
    """Levels of nodes over sets in order of size; level 0 are the leaves."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray):
        slack = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        starts = np.arange(0, len(sizes), LEAF)
        self.levels = []
        low, high = sizes, sizes
        while True:
            maps = np.bitwise_or.reduceat(maps, starts, axis=0)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            slack = np.maximum.reduceat(slack, starts)
            self.levels.append((maps, low, high, slack))
            if len(starts) == 1:
                return
            starts = np.arange(0, len(starts), FAN)

    def below(self, level: int, i: int) -> range:
        return range(i * FAN, min((i + 1) * FAN, len(self.levels[level - 1][1])))

    def rows(self, level: int, i: int, n: int) -> tuple[int, int]:
        width = LEAF * FAN**level
        return i * width, min((i + 1) * width, n)


def links(sets: list[np.ndarray], groups: np.ndarray, percent: int, cross: np.ndarray | None = None):
    """Pairs (i, j) of linked sets, enough of them to connect what is connected.

    ``groups`` numbers the components known before; pairs inside one are not looked at.
    With ``cross`` (booleans), only pairs of one set that has it with one that hasn't are.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sets, sizes = [sets[i] for i in order], sizes[order]
    label = np.unique(groups[order], return_inverse=True)[1].astype(np.int64)
    side = None if cross is None else cross[order]
    maps = bitmaps(sets)
    tree, found, n = Tree(sizes, maps), [], len(sets)
    slack = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)

    def one(level, i, j):
        """Whether all below both nodes is one component, or all on one side."""
        (a, b), (c, d) = tree.rows(level, i, n), tree.rows(level, j, n)
        first = label[a]
        if (label[a:b] == first).all() and (label[c:d] == first).all():
            return True
        return side is not None and (side[a:b] == side[a]).all() and (side[c:d] == side[a]).all()

    def possible(level, i, j):
        """May a set below one node link to a set below the other?"""
        m, low, high, extra = tree.levels[level]
        i_low, i_high, j_low, j_high = low[i], high[i], low[j], high[j]
        if 100 * i_high < percent * j_low or 100 * j_high < percent * i_low:
            return False
        most = int(np.bitwise_count(m[i] & m[j]).sum()) + min(extra[i], extra[j])
        return (100 + percent) * min(most, i_high, j_high) >= percent * (i_low + j_low)

    def leaf(i, j):
        (a, b), (c, d) = tree.rows(0, i, n), tree.rows(0, j, n)
        both = np.bitwise_count(maps[a:b, None] & maps[None, c:d]).sum(axis=2, dtype=np.int64)
        most = both + np.minimum(slack[a:b, None], slack[None, c:d])
        most = np.minimum(most, np.minimum(sizes[a:b, None], sizes[None, c:d]))
        fits = (100 + percent) * most >= percent * (sizes[a:b, None] + sizes[None, c:d])
        fits &= label[a:b, None] != label[None, c:d]
        if side is not None:
            fits &= side[a:b, None] != side[None, c:d]
        for x, y in zip(*np.nonzero(fits), strict=True):
            x, y = a + int(x), c + int(y)
            if x < y and label[x] != label[y]:
                shared = overlap(sets[x], sets[y])
                if 100 * shared >= percent * (sizes[x] + sizes[y] - shared):
                    found.append((int(order[x]), int(order[y])))
                    label[label == label[y]] = label[x]

    todo = [(len(tree.levels) - 1, 0, 0)]
    while todo:
        level, i, j = todo.pop()
        if one(level, i, j) or not possible(level, i, j):
            continue
        if not level:
            leaf(i, j)
            continue
        mine, other = tree.below(level, i), tree.below(level, j)
        todo += [(level - 1, p, q) for p in mine for q in other if i != j or p <= q]
    return found

"""Suffix trees of number sequences: Ukkonen's construction, common extensions by lowest common ancestors, Lyndon words."""

from __future__ import annotations

import numpy as np


def ukkonen(s: list[int]) -> tuple[list[int], list[int], dict[int, int]]:
    """Begin and end in ``s`` of each node's edge, and the nodes below a node: node * (max(s) + 1) + first number of the edge -> node.

    Node 0 is the root. The last number of ``s`` must occur nowhere else in it,
    so that every suffix ends in a leaf.
    """
    n, width = len(s), max(s) + 1
    begin, end, link, below = [0], [0], [0], {}
    node = edge = length = left = 0
    for i, c in enumerate(s):
        left += 1
        last = 0
        while left:
            if not length:
                edge = i
            key = node * width + s[edge]
            down = below.get(key)
            if down is None:
                below[key] = len(begin)
                begin.append(i)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = node
                    last = 0
            else:
                size = end[down] - begin[down]
                if length >= size:  # walk down
                    edge, length, node = edge + size, length - size, down
                    continue
                at = begin[down] + length
                if s[at] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                split, leaf = len(begin), len(begin) + 1
                begin += (begin[down], i)
                end += (at, n)
                link += (0, 0)
                begin[down] = at
                below[key] = split
                below[split * width + s[at]] = down
                below[split * width + c] = leaf
                if last:
                    link[last] = split
                last = split
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - left + 1
    return begin, end, below


class SuffixTree:
    """The tree of ``s`` with its Euler tour; ``extension`` answers in constant time.

    Numbers below ``marks`` are ends of stretches; each must occur once, and
    ``s`` must end in one, so that common extensions never cross them.
    """

    def __init__(self, s: list[int], marks: int):
        self.n, width = len(s), max(s) + 1
        begin, end, below = ukkonen(s)
        keys, child = np.fromiter(below.keys(), np.int64, len(below)), np.fromiter(below.values(), np.int64, len(below))
        self.parent, self.first = keys // width, keys % width
        order = np.lexsort((self.first, self.parent))
        self.parent, self.first, self.child = self.parent[order], self.first[order], child[order]
        self.nodes, self.marks = len(begin), marks
        self.size = np.array(end) - np.array(begin)
        self.begin = begin
        self.tour()

    def children(self, backward: bool) -> list[list[int]]:
        """Of each node, by the first number of their edges; ``backward`` from the greatest on, but marks still first."""
        first = np.where(self.first < self.marks, self.first, -self.first + (1 << 40)) if backward else self.first
        order = np.lexsort((first, self.parent))
        ends = np.searchsorted(self.parent, np.arange(1, self.nodes))
        return [x.tolist() for x in np.split(self.child[order], ends)]

    def tour(self) -> None:
        """The Euler tour's string depths as a sparse table of minima, and where it first meets each suffix's leaf."""
        under, size, begin, n = self.children(False), self.size.tolist(), self.begin, self.n
        depths, met, ranked = [], [0] * n, []
        stack = [(0, 0, iter(under[0]))]
        depths.append(0)
        while stack:
            _, depth, rest = stack[-1]
            for child in rest:
                deeper = depth + size[child]
                below = under[child]
                if below:
                    stack.append((child, deeper, iter(below)))
                    depths.append(deeper)
                    break
                suffix = begin[child] - depth
                met[suffix] = len(depths)
                ranked.append(suffix)
                depths += (deeper, depth)
            else:
                stack.pop()
                if stack:
                    depths.append(stack[-1][1])
        self.met, self.ranked = np.array(met), ranked
        table = [np.array(depths, np.int32)]
        while 2 << (len(table) - 1) <= len(depths):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self.table = table

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at ``a`` and ``b`` (unlike places): the depth of their leaves' lowest common ancestor."""
        x, y = self.met[a], self.met[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.table[k]
            out[at] = np.minimum(row[low[at]], row[high[at] + 1 - (1 << int(k))])
        return out

    def order(self, backward: bool) -> list[int]:
        """The suffixes in their order; ``backward`` with the order of all numbers but the marks turned round."""
        if not backward:
            return self.ranked
        under, begin, size, found = self.children(True), self.begin, self.size.tolist(), []
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            below = under[node]
            if below:
                deeper = depth + size[node]
                stack.extend((x, deeper) for x in reversed(below))
            else:
                found.append(begin[node] - depth)
        return found

    def lyndon(self, backward: bool) -> np.ndarray:
        """Length of the longest Lyndon word that begins at each place: as far as the next smaller suffix."""
        rank = [0] * self.n
        for i, suffix in enumerate(self.order(backward)):
            rank[suffix] = i
        rank.append(-1)
        after = [self.n] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            j, own = i + 1, rank[i]
            while rank[j] > own:
                j = after[j]
            after[i] = j
        return np.array(after[:-1]) - np.arange(self.n)


def runs_of(s: list[int], marks: int, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of ``s`` of ``least`` numbers and ``exponent`` (2 or more) periods at least.

    ``s`` is made of stretches, each ended by a number below ``marks`` of its
    own; runs lie within a stretch. The Lyndon root of a run is the longest
    Lyndon word at its place under the order of the numbers or its reverse, so
    these are the candidates; common extensions to the right come from the tree
    of ``s``, those to the left from that of its reversal.
    """
    n = len(s)
    right = SuffixTree(s, marks)
    # the reversal of the stretches: their marks must still come last
    left = SuffixTree(s[-2::-1] + [s[-1]], marks)
    root = np.array(s) >= marks
    found = np.zeros((0, 3), np.int64)
    for backward in (False, True):
        period = right.lyndon(backward)
        start = np.flatnonzero(root & (np.arange(n) + period < n))
        q = period[start]
        ahead = right.extension(start, start + q)
        back = np.zeros(len(start), np.int64)
        inner = np.flatnonzero(start > 0)
        # place i of s is place n - 2 - i of the reversal
        back[inner] = left.extension(n - 1 - start[inner], n - 1 - start[inner] - q[inner])
        length = back + q + ahead
        good = (length >= least) & (length >= exponent * q)
        found = np.concatenate((found, np.stack((start - back, length, q), 1)[good]))
    found = np.unique(found, axis=0)
    return found[:, 0], found[:, 1], found[:, 2]

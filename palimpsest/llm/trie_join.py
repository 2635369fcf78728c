"""Links within one block of sets, by traversal of a prefix tree.

The sets of a block, their members in one global order, are stored in a tree
whose edges are runs of members.  A probe walks the tree once: the overlap of a
run is counted once for all sets below it, and a subtree is left as soon as
neither what remains of its longest set nor what remains of the probe can lift
the overlap to what its smallest set needs.
"""

from __future__ import annotations

import numpy as np


def needed(a: int, b: int, percent: int) -> int:
    """The least overlap with which sets of ``a`` and ``b`` members link."""
    return -(-percent * (a + b) // (100 + percent))


class Node:
    __slots__ = ("run", "depth", "children", "ends", "longest", "least", "most")

    def __init__(self, run, depth, ends, longest, least, most):
        self.run, self.depth, self.ends, self.longest, self.least, self.most = run, depth, ends, longest, least, most
        self.children: list[Node] = []


def build(codes: list[np.ndarray], sizes: np.ndarray) -> Node:
    """The tree of all sequences; ``ends`` of a node are those that end there."""
    order = sorted(range(len(codes)), key=lambda i: codes[i].astype(">u4").tobytes())
    shared = np.zeros(len(order) + 1, np.int64)
    for k in range(1, len(order)):
        a, b = codes[order[k - 1]], codes[order[k]]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        shared[k] = differ[0] if len(differ) else m
    length = np.array([len(codes[i]) for i in order])
    size = sizes[order]
    root = Node(codes[order[0]][:0], 0, [], int(length.max()), int(size.min()), int(size.max()))
    todo = [(root, 0, len(order), 0)]
    while todo:
        above, lo, hi, depth = todo.pop()
        # Sequences lo to hi share their first ``depth`` members: one child for each next member.
        if above is root:
            cuts = [lo, *(k for k in range(lo + 1, hi) if shared[k] == 0), hi]
        else:
            k = lo
            while k < hi and length[k] == depth:
                above.ends.append(order[k])
                k += 1
            cuts = [k, *(j for j in range(k + 1, hi) if shared[j] == depth), hi] if k < hi else []
        for a, b in zip(cuts, cuts[1:]):
            end = int(length[a]) if b - a == 1 else int(min(shared[a + 1 : b].min(), length[a]))
            child = Node(codes[order[a]][depth:end], end, [], int(length[a:b].max()), int(size[a:b].min()), int(size[a:b].max()))
            above.children.append(child)
            todo.append((child, a, b, end))
    return root


class Groups:
    """Union of what is linked."""

    def __init__(self, n: int):
        self.above = list(range(n))

    def root(self, i: int) -> int:
        while self.above[i] != i:
            self.above[i] = self.above[self.above[i]]
            i = self.above[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.above[max(i, j)] = min(i, j)
        return i != j


def links(sets: list[np.ndarray], sizes: list[int], percent: int, known: list | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j) that link and that hold the groups of the block together.

    ``sizes`` are those of the whole sets; ``sets`` may leave out members that
    no other set has.  Rows of one group in ``known`` count as linked already.
    Empty sets link with nothing, equal sets with each other; a block of one
    row, or of none with members, has no links.
    """
    found: list[tuple[int, int]] = []
    groups = Groups(len(sets))
    open_groups = len(sets)
    if known is not None:
        first: dict = {}
        for i, k in enumerate(known):
            open_groups -= groups.join(first.setdefault(k, i), i)
    some = [i for i in range(len(sets)) if len(sets[i])]
    if open_groups <= 1 or len(some) < 2:
        return found
    vocabulary, flat = np.unique(np.concatenate([sets[i] for i in some]), return_inverse=True)
    bounds = np.cumsum([0, *(len(sets[i]) for i in some)])
    codes = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
    size = np.array([sizes[i] for i in some], np.int64)
    tree = build(codes, size)
    held = np.zeros(len(vocabulary), bool)
    for x in np.argsort(size, kind="stable").tolist():
        nx, lx, me = int(size[x]), len(codes[x]), some[x]
        held[codes[x]] = True
        todo = [(tree, 0)]
        while todo:
            node, overlap = todo.pop()
            overlap += int(np.count_nonzero(held[node.run]))
            for y in node.ends:
                if y != x and overlap >= needed(nx, int(size[y]), percent) and groups.join(me, some[y]):
                    found.append((me, some[y]))
                    open_groups -= 1
            for child in node.children:
                if child.most * 100 < percent * nx or child.least * percent > 100 * nx:
                    continue
                if overlap + min(child.longest - node.depth, lx - overlap) >= needed(nx, max(child.least, -(-percent * nx // 100)), percent):
                    todo.append((child, overlap))
        held[codes[x]] = False
        if open_groups == 1:
            break
    return found

"""Cover trees of blocks of unit vectors, and what two of them say about all pairs within an angle."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np

#: Levels have halving radii, from one ball around all unit vectors down; below the last are the vectors.
RADII = (2.0, 1.0, 0.5, 0.25, 0.125)
#: What rounding may add to a distance. Pairs nearer than this to a bound are compared themselves.
MARGIN = 1e-7
#: Distances worked on together.
AT_ONCE = 1 << 20
#: Radii up to each of these are bounded together.
STEPS = (0.0, 0.125, 0.25, 0.5, 0.75)


class CoverTree:
    """Nested nets: the centers of a level are vectors more than its radius apart, each node's vectors lie within
    the radius of its center, and a node's children split its vectors with half the radius.

    Vectors are put in the order of the tree, so that a node is a range. ``radius`` is a node's true covering
    radius, which is what pairs are pruned by.
    """

    def __init__(self, ids: np.ndarray, unit: np.ndarray):
        self.ids, self.unit, self.levels = ids, unit, []
        order = self.order = np.arange(len(ids))
        if not len(ids):
            return
        parents = [(0, len(ids))]
        for radius in RADII:
            nodes, children = [], []
            for begin, end in parents:
                first = len(nodes)
                for members, center, reach in self._net(order[begin:end].copy(), radius):
                    order[begin : begin + len(members)] = members
                    nodes.append((center, reach, begin, begin + len(members)))
                    begin += len(members)
                children.append((first, len(nodes)))
            self.levels.append([np.array(c) for c in zip(*nodes, strict=True)])
            if len(self.levels) > 1:
                self._children(len(self.levels) - 2, children)
            parents = [(n[2], n[3]) for n in nodes]
        self._children(len(self.levels) - 1, parents)
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        for level in self.levels:
            level[0] = place[level[0]]
        self.ids, self.unit = ids[order], np.ascontiguousarray(unit[order])
        self._vectors()

    def _vectors(self) -> None:
        """The level below the last: each vector is its own."""
        every = np.arange(len(self.ids))
        self.levels.append([every, np.zeros(len(every)), every, every + 1, every, every])

    def _children(self, level: int, ranges: list[tuple[int, int]]) -> None:
        self.levels[level] += [np.array(c) for c in zip(*ranges, strict=True)]

    def _net(self, members: np.ndarray, radius: float):
        """Splits vectors into balls around centers more than ``radius`` apart, greedily in their order."""
        if len(members) == 1:
            yield members, members[0], 0.0
            return
        while len(members):
            center = members[0]
            far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.unit[members] @ self.unit[center])))
            far[0] = 0.0
            inside = far <= radius
            yield members[inside], center, float(far[inside].max())
            members = members[~inside]

    def packed(self, vectors: np.ndarray) -> bytes:
        """The tree with the vectors it was made of, which take less than those of length one if they were singles."""
        levels = [[x if x.dtype.kind == "f" else x.astype(np.int32) for x in level] for level in self.levels[:-1]]
        return pickle.dumps((self.ids, vectors[self.order], levels), protocol=5)

    @classmethod
    def unpacked(cls, data: bytes, unit: Callable[[np.ndarray], np.ndarray]) -> CoverTree:
        """``unit`` gives the vectors length one again, as it did before."""
        tree = cls(np.zeros(0, np.int64), np.zeros((0, 0)))
        tree.ids, vectors, levels = pickle.loads(data)
        tree.unit, tree.levels = unit(vectors), [[x if x.dtype.kind == "f" else x.astype(np.int64) for x in level] for level in levels]
        if len(tree.ids):
            tree._vectors()
        return tree


def first_reached(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of so many nodes the smallest that the edges from ``a`` to ``b`` connect it with."""
    root = np.arange(nodes)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def added_up(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``Links.rows`` of several pairs of trees as one: a row for each vector, with all its links and the smallest id
    that those of all rows connect it with."""
    ids, n, to = (np.concatenate(column) for column in zip(*rows, strict=True))
    every, at = np.unique(np.concatenate([ids, to]), return_inverse=True)
    count = np.zeros(len(every), np.int64)
    np.add.at(count, at[: len(ids)], n)
    return every, count, every[first_reached(len(every), at[: len(ids)], at[len(ids) :])]


class Links:
    """Links between the vectors of one or two trees: how many each vector has, and which are connected."""

    def __init__(self, a: CoverTree, b: CoverTree):
        self.same, self.shift = a is b, 0 if a is b else len(a.ids)
        self.ids = a.ids if self.same else np.concatenate([a.ids, b.ids])
        self.steps = np.zeros(len(self.ids) + 1, np.int64)
        self.pairs: list[np.ndarray] = []

    def add(self, first, second) -> None:
        """Links all vectors of the first nodes to all of the second; nodes are (center, begin, end) arrays.
        Within one tree each pair comes in both orders and counts for its first node."""
        (ca, ba, ea), (cb, bb, eb) = first, second
        if self.same:
            size = eb - bb - (ba == bb)
            np.add.at(self.steps, ba, size)
            np.add.at(self.steps, ea, -size)
            inner = (ba == bb) & (size > 0)
            for c, low, high in zip(ca[inner].tolist(), ba[inner].tolist(), ea[inner].tolist(), strict=True):
                self.pairs.append(np.stack([np.full(high - low, c), np.arange(low, high)]))
        else:
            np.add.at(self.steps, ba, eb - bb)
            np.add.at(self.steps, ea, bb - eb)
            # the second tree's ranges lie behind the first's, whose last end they share nothing with
            np.add.at(self.steps, bb + self.shift, ea - ba)
            np.add.at(self.steps, eb + self.shift, ba - ea)
        self.pairs.append(np.stack([ca, cb + self.shift]))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, links, id of the first connected vector) of each vector with a link."""
        count = np.cumsum(self.steps[:-1])
        root = first_reached(len(self.ids), *np.concatenate(self.pairs, axis=1)) if self.pairs else np.arange(len(self.ids))
        on = np.flatnonzero((count > 0) | (root != np.arange(len(root))))
        return self.ids[on], count[on], self.ids[root[on]]


def _slack(unit: np.ndarray) -> float:
    """More than a cosine worked out in single precision can be too small."""
    return MARGIN + unit.shape[1] * 2.0**-22


def _reaching(left: np.ndarray, right: np.ndarray, radii: np.ndarray, others: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in ``left``, places in ``right``, cosines) of the pairs that are no farther apart than ``reach`` and both
    radii, a bounded list at a time. Nodes of about the same radius are compared in single precision, which leaves
    out what the largest radii and its rounding cannot bring near; what is left is worked out in double precision."""
    slack = _slack(left)
    few = [x.astype(np.float32) for x in (left, right)]
    kinds = [[np.flatnonzero(np.searchsorted(STEPS, r) == k) for k in range(len(STEPS) + 1)] for r in (radii, others)]
    for i in kinds[0]:
        for j in kinds[1]:
            if not len(i) or not len(j):
                continue
            least = np.float32(1.0 - min(reach + radii[i].max() + others[j].max(), 2.0) ** 2 / 2.0 - slack)
            beside, step = few[1][j].T, max(1, AT_ONCE // len(j))
            for at in range(0, len(i), step):
                rows = i[at : at + step]
                found = np.flatnonzero((few[0][rows] @ beside >= least).ravel())
                x, y = rows[found // len(j)], j[found % len(j)]
                if 16 * len(found) > len(rows) * len(j):
                    cos = (left[rows] @ right[j].T).ravel()[found]
                else:
                    cos = np.einsum("ij,ij->i", left[x], right[y])
                kept = cos >= 1.0 - np.minimum(reach + radii[x] + others[y], 2.0) ** 2 / 2.0 - MARGIN
                if kept.any():
                    yield x[kept], y[kept], cos[kept]


def dual(a: CoverTree, b: CoverTree, cosine: float) -> Links:
    """All pairs of two trees (or of one with itself) of at least ``cosine``, by going down both at once.

    A pair of nodes is dropped when its centers are farther apart than the distance plus both covering radii,
    and linked as a whole when they are nearer than the distance less both; else its children are paired.
    Single vectors are compared by their cosine in double precision.
    """
    links, reach = Links(a, b), np.sqrt(2.0 - 2.0 * cosine)
    if not len(a.ids) or not len(b.ids):
        return links
    last, slack = len(a.levels) - 1, _slack(a.unit)
    few_a = a.unit.astype(np.float32)
    few_b = few_a if a is b else b.unit.astype(np.float32)

    def judge(level: int, i: np.ndarray, j: np.ndarray, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links or drops node pairs; returns those to go down from."""
        la, lb = a.levels[level], b.levels[level]
        single = (la[3][i] - la[2][i] == 1) & (lb[3][j] - lb[2][j] == 1)
        far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))
        radii = la[1][i] + lb[1][j]
        near = np.where(single, cos >= cosine, far + radii < reach - MARGIN)
        if links.same:
            near &= ~(single & (la[2][i] == lb[2][j]))
        if near.any():
            links.add((la[0][i[near]], la[2][i[near]], la[3][i[near]]), (lb[0][j[near]], lb[2][j[near]], lb[3][j[near]]))
        rest = ~single & ~near & (far <= reach + radii + MARGIN)
        return i[rest], j[rest]

    top = np.zeros(1, int)
    cos = (a.unit[a.levels[0][0][:1]] * b.unit[b.levels[0][0][:1]]).sum(axis=1)
    i, j = judge(0, top, top, cos)
    for level in range(last):
        nexts_i, nexts_j = [], []
        la, lb, na, nb = a.levels[level], b.levels[level], a.levels[level + 1], b.levels[level + 1]
        wide_a, wide_b = la[5][i] - la[4][i], lb[5][j] - lb[4][j]
        big = wide_a * wide_b >= 4096
        for p, q in zip(i[big].tolist(), j[big].tolist(), strict=True):
            rows, cols = np.arange(la[4][p], la[5][p]), np.arange(lb[4][q], lb[5][q])
            for x, y, cos in _reaching(a.unit[na[0][rows]], b.unit[nb[0][cols]], na[1][rows], nb[1][cols], reach + MARGIN):
                down = judge(level + 1, rows[x], cols[y], cos)
                nexts_i.append(down[0])
                nexts_j.append(down[1])
        i, j, wide_a, wide_b = i[~big], j[~big], wide_a[~big], wide_b[~big]
        sizes = np.cumsum(wide_a * wide_b)
        at = 0
        while at < len(i):
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + AT_ONCE // 16, "right")))
            part = slice(at, to)
            n = wide_a[part] * wide_b[part]
            which = np.repeat(np.arange(to - at), n)
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            x = la[4][i[part]][which] + inner // wide_b[part][which]
            y = lb[4][j[part]][which] + inner % wide_b[part][which]
            # in single precision first, as most are too far apart
            bound = np.minimum(reach + MARGIN + na[1][x] + nb[1][y], 2.0)
            kept = np.einsum("ij,ij->i", few_a[na[0][x]], few_b[nb[0][y]]) >= 1.0 - bound**2 / 2.0 - slack
            x, y = x[kept], y[kept]
            down = judge(level + 1, x, y, np.einsum("ij,ij->i", a.unit[na[0][x]], b.unit[nb[0][y]]))
            nexts_i.append(down[0])
            nexts_j.append(down[1])
            at = to
        i = np.concatenate(nexts_i) if nexts_i else np.zeros(0, int)
        j = np.concatenate(nexts_j) if nexts_j else np.zeros(0, int)
    return links

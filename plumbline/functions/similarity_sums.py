"""Sums of the similarity over all pairs of many short texts, for use inside tasks.

The blend of ``similarity`` is a sum of three ratios, so each is summed on its own. Common subsequences are
counted bit-parallel as there, but for whole grids of texts at once: what the texts of one side (or their
windows) begin or end with is walked once for all that share it, each step against a row of many texts of the
other side in machine words no wider than these need. Ratios are whole numbers, so the sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from plumbline.functions.similarity import PLAIN, WINDOW, WORD_BITS, WORDS, Records, Texts

#: Texts of one side whose beginnings are walked together.
BLOCK = 512
#: Words of a step of the walk; so many stay in a processor's cache.
STEP = 1 << 17
#: Pairs with a text beyond a machine word that are listed at once.
LISTED = 200_000


@dataclass
class Side:
    """Texts in the order of their lengths, then of their rows: letters by place (0 beyond the end), forwards and
    backwards, lengths, rows each stands for, and the ranks of these rows."""

    forward: np.ndarray
    backward: np.ndarray
    size: np.ndarray
    n: np.ndarray
    rank: np.ndarray

    def __len__(self) -> int:
        return len(self.size)

    def take(self, at: np.ndarray | slice) -> Side:
        width = max(int(self.size[at].max(initial=0)), 1)
        return Side(self.forward[at, :width], self.backward[at, :width], self.size[at], self.n[at], self.rank[at])

    def classes(self) -> list[tuple[int, Side]]:
        """The texts of each length."""
        sizes, first = np.unique(self.size, return_index=True)
        return [(int(m), self.take(slice(a, b))) for m, a, b in zip(sizes, first, [*first[1:], len(self)])]

    def masks(self, backwards: bool, letters: int) -> tuple[np.ndarray, np.ndarray]:
        """For each letter and text the places that hold it, and for each text all its places, as bits."""
        codes = self.backward if backwards else self.forward
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if 8 * np.dtype(k).itemsize >= codes.shape[1])
        places, kept, rows = np.zeros((letters, len(self)), kind), np.zeros(len(self), kind), np.arange(len(self))
        for j in range(codes.shape[1]):
            places[codes[:, j], rows] |= kind(1 << j)
            kept |= np.where(self.size > j, kind(1 << j), kind(0))
        return places, kept


def sides(texts: Sequence[str], n: np.ndarray, rank: np.ndarray, *groups: np.ndarray) -> tuple[int, list[Side]]:
    """The number of letters (one more than there are) and the texts at each of some lists of places."""
    size = np.array([len(t) for t in texts], np.int64)
    width = max(int(size.max(initial=0)), 1)
    place = np.arange(width)
    points = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width).astype(np.int64)
    known, codes = np.unique(np.append(np.where(place < size[:, None], points + 1, 0), 0), return_inverse=True)
    codes = codes[:-1].reshape(len(texts), width)
    from_end = size[:, None] - 1 - place
    backward = np.where(from_end >= 0, np.take_along_axis(codes, np.maximum(from_end, 0), axis=1), 0)
    every = Side(codes, backward, size, np.asarray(n, np.float64), rank)
    return len(known), [every.take(at[np.lexsort((rank[at], size[at]))]) for at in groups]


@dataclass
class Tree:
    """The distinct beginnings (or ends) of some texts, a level for each length: their parents and last letters;
    and the place of each text in the level it ends in."""

    levels: list[tuple[np.ndarray, np.ndarray]]
    node: np.ndarray
    backwards: bool

    def nodes(self) -> int:
        return sum(len(parents) for parents, _ in self.levels)

    def columns(self) -> int:
        """How many texts the other side may have at once."""
        return max(64, min(4096, STEP // max([len(parents) for parents, _ in self.levels] + [1])))

    def walk(self, places: np.ndarray) -> Iterator[np.ndarray]:
        """The state of each beginning against all texts of the other side, level by level."""
        state = np.full((1, places.shape[1]), ~places.dtype.type(0))
        yield state
        for parents, letters in self.levels:
            state, hit = state[parents], places[letters]
            hit &= state
            rest = state ^ hit
            state += hit
            state |= rest
            yield state


def _tree(codes: np.ndarray, size: np.ndarray, letters: int, backwards: bool) -> Tree:
    levels, node, active = [], np.zeros(len(codes), np.int64), np.arange(len(codes))
    for j in range(codes.shape[1]):
        active = active[size[active] > j]
        if not len(active):
            break
        found, node[active] = _numbered(node[active] * letters + codes[active, j])
        levels.append((found // letters, found % letters))
    return Tree(levels, node, backwards)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each key among them."""
    most = int(keys.max()) + 1
    if most > 64 * len(keys):
        return np.unique(keys, return_inverse=True)
    met = np.zeros(most, bool)
    met[keys] = True
    found = np.flatnonzero(met)
    number = np.empty(most, np.int64)
    number[found] = np.arange(len(found))
    return found, number[keys]


def tree(forward: np.ndarray, backward: np.ndarray, size: np.ndarray, letters: int) -> Tree:
    """The smaller tree: common subsequences are the same backwards."""
    both = [_tree(codes, size, letters, backwards) for codes, backwards in ((forward, False), (backward, True))]
    return min(both, key=Tree.nodes)


@lru_cache(maxsize=None)
def _ratios(total: int) -> bytes:
    """The ratio by the number of common characters of two texts of ``total`` characters; they have no more than half."""
    return Texts._ratio(np.minimum(np.arange(256), total // 2), np.full(256, total)).astype(np.uint8).tobytes()


def _ratio(common: np.ndarray, total: int) -> np.ndarray:
    return np.frombuffer(common.tobytes().translate(_ratios(total)), np.uint8).reshape(common.shape)


def _weighed(grid: np.ndarray, n_rows: np.ndarray, n_columns: np.ndarray) -> float:
    if (n_rows == 1).all():
        return float(grid.sum(axis=0, dtype=np.uint32) @ n_columns)
    return float(n_rows @ (grid.astype(np.float64) @ n_columns))


def _ratio_sum(x: Side, y: Side, letters: int) -> float:
    """The sum of the ratios of all texts of ``x`` and all of ``y``."""
    total, masks = 0.0, {}
    for size, rows in y.classes():
        for at in range(0, len(rows), BLOCK * 2):
            block = rows.take(slice(at, at + BLOCK * 2))
            walked = tree(block.forward, block.backward, block.size, letters)
            if walked.backwards not in masks:
                masks[walked.backwards] = x.masks(walked.backwards, letters)
            places, kept = masks[walked.backwards]
            step = walked.columns()
            weights = np.bincount(walked.node, block.n)
            for begin in range(0, len(x), step):
                part = slice(begin, begin + step)
                *_, state = walked.walk(places[:, part])
                common = np.bitwise_count(~state & kept[part])
                sizes, first = np.unique(x.size[part], return_index=True)
                for m, a, b in zip(sizes.tolist(), first, [*first[1:], common.shape[1]]):
                    total += _weighed(_ratio(common[:, a:b], m + size), weights, x.n[part][a:b])
    return total


def _best_windows(
    short: Side, begin: int, end: int, block: Side, letters: int, masks: dict
) -> Iterator[tuple[slice, np.ndarray]]:
    """The best ratio of texts of one length, those from ``begin`` to ``end``, against any window of the texts of
    ``block``, of one length as well, for ranges of the former. ``masks`` are kept for all of them."""
    if begin == end:
        return
    m, size, rows = int(short.size[0]), int(block.size[0]), len(block)
    cut = {}

    def windows(starts: range) -> Tree:
        """Of all texts of the block, for one start after the other."""
        length = np.repeat([min(m, size - s) for s in starts], rows)
        forward, backward = (np.zeros((len(length), m), np.int64) for _ in range(2))
        for i, s in enumerate(starts):
            span = min(m, size - s)
            forward[i * rows : (i + 1) * rows, :span] = block.forward[:, s : s + span]
            backward[i * rows : (i + 1) * rows, :span] = block.forward[:, s : s + span][:, ::-1]
        return tree(forward, backward, length, letters)

    def raise_to(best: np.ndarray, walked: Tree, starts: range, part: slice) -> None:
        if walked.backwards not in masks:
            masks[walked.backwards] = short.masks(walked.backwards, letters)
        places, kept = masks[walked.backwards]
        ends: dict[int, list[int]] = {}
        for i, s in enumerate(starts):
            ends.setdefault(min(m, size - s), []).append(i)
        for span, state in enumerate(walked.walk(places[:, part])):
            if span in ends:
                ratio = _ratio(np.bitwise_count(~state & kept[part]), m + span)
                for i in ends[span]:
                    np.maximum(best, ratio[walked.node[i * rows : (i + 1) * rows]], out=best)

    whole = range(size - m + 1)
    walked = windows(whole)
    step = walked.columns()
    for at in range(begin, end, step):
        part = slice(at, min(at + step, end))
        best = np.zeros((rows, part.stop - at), np.uint8)
        raise_to(best, walked, whole, part)
        # windows cut off at the end: one cannot share more than it holds, and later ones hold no more
        least = int(best.min())
        hopeful = sum(_ratios(m + span)[span] > least for span in range(1, m))
        if hopeful:
            later = range(size - m + 1, size - m + 1 + hopeful)
            if hopeful not in cut:
                cut[hopeful] = windows(later)
            raise_to(best, cut[hopeful], later, part)
        yield part, best


def _window_sum(short: Side, long: Side, letters: int) -> float:
    """The sum of the window ratios of all pairs whose first text is shorter, or as long and of an earlier row."""
    total, shorter = 0.0, [(m, texts, {}) for m, texts in short.classes()]
    for size, rows in long.classes():
        for at in range(0, len(rows), BLOCK):
            block = rows.take(slice(at, at + BLOCK))
            for m, texts, masks in shorter:
                if m > size:
                    break
                before, among = len(texts), 0
                if m == size:
                    before, among = np.searchsorted(texts.rank, block.rank[[0, -1]]).tolist()
                for part, best in _best_windows(texts, 0, before, block, letters, masks):
                    total += _weighed(best, block.n, texts.n[part])
                for part, best in _best_windows(texts, before, max(before, among), block, letters, masks):
                    total += _weighed(best * (texts.rank[part] < block.rank[:, None]), block.n, texts.n[part])
    return total


def similarity_sum(
    texts: Sequence[Sequence[str]], words: Sequence[Sequence[str]], n: np.ndarray, ids: np.ndarray,
    left: np.ndarray, right: np.ndarray | None = None,
) -> float:
    """The sum of ``n * n * similarity`` over all pairs of the records at ``left`` and at ``right``, or of all pairs
    of those at ``left``. ``texts`` and ``words`` have a list for each column; of two texts equally long the one of
    the smaller id is looked for in the windows of the other."""
    n, rank = np.asarray(n, np.float64), np.empty(len(ids), np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    long = np.zeros(len(ids), bool)
    for column in (*texts, *words):
        long |= np.array([len(t) > WORD_BITS for t in column])
    total = _listed_sum(texts, words, n, rank, long, left, right) if long.any() else 0.0
    sides_of = [at[~long[at]] for at in ((left,) if right is None else (left, right))]
    kept = [np.array(t, dtype=object) for t in (*texts, *words)]
    for text, word in zip(kept[: len(texts)], kept[len(texts) :]):
        filled = np.array([t != "" for t in text])
        empty = [at[~filled[at]] for at in sides_of]
        full = [at[filled[at]] for at in sides_of]
        alike = 100 * _pairs(n, *empty)
        blend = 0.0
        if all(len(at) for at in full):
            blend += round(10 * WORDS) * _ratios_of(word, n, rank, full)
            blend += round(10 * PLAIN) * _ratios_of(text, n, rank, full)
            every, places = np.concatenate(full), np.cumsum([0, *map(len, full)])
            letters, found = sides(
                text[every].tolist(), n[every], rank[every], *[np.arange(a, b) for a, b in zip(places, places[1:])]
            )
            windows = _window_sum(found[0], found[-1], letters)
            if len(found) == 2:
                windows += _window_sum(found[1], found[0], letters)
            blend += round(10 * WINDOW) * windows
        total += (alike + blend / 10) / len(texts)
    return total


def _pairs(n: np.ndarray, left: np.ndarray, right: np.ndarray | None = None) -> float:
    if right is not None:
        return float(n[left].sum() * n[right].sum())
    return float((n[left].sum() ** 2 - (n[left] ** 2).sum()) / 2)


def _ratios_of(text: np.ndarray, n: np.ndarray, rank: np.ndarray, groups: list[np.ndarray]) -> float:
    """The sum of the ratios, from the distinct texts of each side."""
    distinct, weights, places = [], [], [0]
    for at in groups:
        known: dict[str, int] = {}
        weights.append(np.bincount([known.setdefault(t, len(known)) for t in text[at]], n[at]))
        distinct += known
        places.append(len(distinct))
    letters, of = sides(
        distinct, np.concatenate(weights), np.arange(len(distinct)), *[np.arange(a, b) for a, b in zip(places, places[1:])]
    )
    total = _ratio_sum(of[0], of[-1], letters)
    return total if len(groups) == 2 else (total - 100 * float((n[groups[0]] ** 2).sum())) / 2


def _listed_sum(texts, words, n, rank, long, left, right) -> float:
    """The same sum over the pairs with a text beyond a machine word, a bounded list at a time."""
    records, total = Records(texts, words), 0.0
    for i in left:
        others = right if right is not None else left[rank[left] > rank[i]]
        others = others if long[i] else others[long[others]]
        for at in range(0, len(others), LISTED):
            j = others[at : at + LISTED]
            i_all = np.full(len(j), i)
            flip = rank[i_all] > rank[j]
            kept, score = records.similar(np.where(flip, j, i_all), np.where(flip, i_all, j), None)
            total += float(n[i] * (n[j[kept]] @ score))
    return total

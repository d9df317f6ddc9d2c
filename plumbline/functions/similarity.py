"""Similarity of many pairs of short texts at once, for use inside tasks.

A ratio is ``round(100 * 2 * L / (len1 + len2))`` with L the length of the longest common subsequence.
The blend of a column weighs the ratio of the sorted words by one half, the best ratio of the shorter
text against any equally long (at the end: shorter) window of the longer by 0.3, and the plain ratio by
0.2; several columns are averaged. L is counted bit-parallel, one machine word per pair; for longer texts
the windows of a pair are counted together, in time that goes with the product of the two lengths.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import sorted_tokens, text_of

# The weights of sorted-word, window and plain ratio.
WORDS, WINDOW, PLAIN = 0.5, 0.3, 0.2

WORD_BITS = 64
SLICE = 16_000
_BUCKETS = 32
_SLACK = 1e-9


class Texts:
    """Distinct texts prepared for counting common subsequences."""

    def __init__(self, texts: Sequence[str]):
        self.texts = np.array(texts, dtype=object)
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.histogram = np.zeros((len(texts), _BUCKETS), dtype=np.int32)
        short = [t if len(t) <= WORD_BITS else "" for t in texts]
        alphabet = {ch: i + 1 for i, ch in enumerate(sorted(set("".join(short))))}
        width = max([len(t) for t in short] + [1])
        self.codes = np.zeros((width, len(texts)), dtype=np.int64)  # by place in the text, then by text
        self.places = np.zeros((len(texts), len(alphabet) + 1), dtype=np.uint64)
        for row, (text, kept) in enumerate(zip(texts, short)):
            np.add.at(self.histogram[row], [ord(ch) % _BUCKETS for ch in text], 1)
            self.codes[: len(kept), row] = [alphabet[ch] for ch in kept]
        rows = np.arange(len(texts))
        for j in range(width):
            code = self.codes[j]
            self.places[rows, code] |= np.where(code > 0, np.uint64(1) << np.uint64(j), np.uint64(0))

    def ratio_bound(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """No ratio exceeds this: characters in common, order ignored."""
        common = np.minimum(self.histogram[a], self.histogram[b]).sum(axis=1)
        return self._ratio(common, self.size[a] + self.size[b])

    def ratio(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._ratio(self.common(a, b), self.size[a] + self.size[b])

    def window_bound(self, a: np.ndarray, b: np.ndarray, common: np.ndarray) -> np.ndarray:
        """No window ratio exceeds this: a window shares no more than the whole texts do, nor than it holds."""
        return self._ratio(common, np.minimum(self.size[a], self.size[b]) + common)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common subsequence lengths of the whole texts."""
        common = np.zeros(len(a), dtype=np.int64)
        fits = (self.size[a] <= WORD_BITS) & (self.size[b] <= WORD_BITS)
        common[fits] = self._common(a[fits], b[fits], 0, self.size[b[fits]])
        for i in np.flatnonzero(~fits):
            common[i] = _common_long(self.texts[a[i]], self.texts[b[i]])
        return common

    def window_ratio(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        swap = self.size[a] > self.size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)  # a is the shorter
        best = np.zeros(len(a))
        fits = np.flatnonzero(self.size[b] <= WORD_BITS)
        for start in range(int(self.size[b[fits]].max(initial=0))):
            size, span = self.size[a[fits]], np.minimum(self.size[a[fits]], self.size[b[fits]] - start)
            # a window cannot share more than it holds, and later windows hold no more
            hopeful = (span > 0) & (self._ratio(np.minimum(size, span), size + span) > best[fits])
            fits, size, span = fits[hopeful], size[hopeful], span[hopeful]
            if not len(fits):
                break
            common = self._common(a[fits], b[fits], start, span)
            best[fits] = np.maximum(best[fits], self._ratio(common, size + span))
        for i in np.flatnonzero((self.size[b] > WORD_BITS) & (self.size[a] > 0)):
            short, long = self.texts[a[i]], self.texts[b[i]]
            if short in long:
                best[i] = 100.0
                continue
            spans = np.minimum(len(short), len(long) - np.arange(len(long)))
            best[i] = self._ratio(_common_of_windows(short, long), len(short) + spans).max()
        both_empty = (self.size[a] == 0) & (self.size[b] == 0)
        return np.where(both_empty, 100.0, best)

    def _common(self, a: np.ndarray, b: np.ndarray, start: int, span: np.ndarray) -> np.ndarray:
        """Common subsequence lengths of texts ``a`` and ``span`` characters of texts ``b`` from ``start``."""
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        state = np.full(len(a), full)
        row, places, shortest = a * self.places.shape[1], self.places.ravel(), int(span.min(initial=WORD_BITS))
        for j in range(int(span.max(initial=0))):
            code = self.codes[start + j].take(b)
            if j >= shortest:
                code = np.where(j < span, code, 0)
            hit = state & places.take(row + code)
            state = (state + hit) | (state - hit)
        size = self.size[a].astype(np.uint64)
        room = np.uint64(WORD_BITS) - np.maximum(size, np.uint64(1))
        kept = np.where(size > 0, full >> room, np.uint64(0))
        return np.bitwise_count(~state & kept).astype(np.int64)

    @staticmethod
    def _ratio(common, total):
        total = np.asarray(total)
        return np.where(total == 0, 100.0, np.rint(100.0 * (2.0 * common / np.maximum(total, 1))))


def _common_long(a: str, b: str) -> int:
    """The same count for texts of any length, on Python integers."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & places.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def _common_of_windows(short: str, long: str) -> np.ndarray:
    """For each start in ``long`` the common subsequence length of ``short`` and the window of its length, cut
    off at the end, all from one pass (semi-local comparison by combing).

    Strands enter the comparison grid at its left and upper edge. Two that meet part again without crossing
    where characters are equal or where they have crossed before. A window shares as many characters as it
    has columns, less the strands that both enter and leave within it. Cells of a diagonal are independent.
    """
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (short[::-1], long))
    m, n = len(a), len(b)
    rows, columns = np.arange(m, dtype=np.int32), np.arange(m, m + n, dtype=np.int32)
    for d in range(m + n - 1):
        first, last = max(0, d - m + 1), min(n, d + 1)
        at = slice(first - d + m - 1, last - d + m - 1)
        left, top = rows[at], columns[first:last]
        swap = (left ^ top) * ((a[at] == b[first:last]) | (left > top))
        left ^= swap
        top ^= swap
    leave = np.flatnonzero(columns >= m)
    enter, least = columns[leave] - m, np.maximum(leave - m + 1, 0)
    inside = enter >= least
    change = np.bincount(least[inside], minlength=n + 1) - np.bincount(enter[inside] + 1, minlength=n + 1)
    return np.minimum(m, n - np.arange(n)) - np.cumsum(change)[:n]


class Records:
    """Rows of lower-cased texts, one list per column, with their sorted words."""

    def __init__(self, texts: Sequence[Sequence[str]], words: Sequence[Sequence[str]]):
        self.columns = [(Texts(t), Texts(w)) for t, w in zip(texts, words)]

    def similar(self, a: np.ndarray, b: np.ndarray, threshold: float | None) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the pairs whose similarity reaches ``threshold`` (all without one), and their
        similarities. Pairs are dropped early only on bounds that no similarity can exceed."""
        kept, scores = [], []
        for begin in range(0, len(a), SLICE):
            at, score = self._slice(a[begin : begin + SLICE], b[begin : begin + SLICE], threshold)
            kept.append(at + begin)
            scores.append(score)
        if not kept:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        return np.concatenate(kept), np.concatenate(scores)

    def _slice(self, a, b, threshold):
        least = -np.inf if threshold is None else threshold - _SLACK
        at = np.arange(len(a))
        if threshold is not None:
            bound = [
                self._settled(text, a, b, WORDS * word.ratio_bound(a, b) + WINDOW * 100 + PLAIN * text.ratio_bound(a, b))
                for text, word in self.columns
            ]
            at = at[np.mean(bound, axis=0) >= least]
        words = [word.ratio(a[at], b[at]) for _, word in self.columns]
        common = [text.common(a[at], b[at]) for text, _ in self.columns]
        plain = [text._ratio(c, text.size[a[at]] + text.size[b[at]]) for (text, _), c in zip(self.columns, common)]
        bound = [
            self._settled(text, a[at], b[at], w * WORDS + text.window_bound(a[at], b[at], c) * WINDOW + p * PLAIN)
            for (text, _), c, w, p in zip(self.columns, common, words, plain)
        ]
        alive = np.mean(bound, axis=0) >= least
        at = at[alive]
        blended = [
            self._settled(text, a[at], b[at], w[alive] * WORDS + text.window_ratio(a[at], b[at]) * WINDOW + p[alive] * PLAIN)
            for (text, _), w, p in zip(self.columns, words, plain)
        ]
        score = np.mean(blended, axis=0)
        good = np.ones(len(at), dtype=bool) if threshold is None else score >= threshold
        return at[good], score[good]

    @staticmethod
    def _settled(text: Texts, a, b, value):
        """Two empty texts are alike, an empty and a non-empty one are not, whatever the ratios."""
        empty_a, empty_b = text.size[a] == 0, text.size[b] == 0
        return np.where(empty_a & empty_b, 100.0, np.where(empty_a | empty_b, 0.0, value))


@F.pandas_udf(T.DoubleType())
def _blend(text_a: pd.Series, text_b: pd.Series, words_a: pd.Series, words_b: pd.Series) -> pd.Series:
    place, pairs = {}, []
    for pair in zip(text_a, words_a), zip(text_b, words_b):
        pairs.append(np.array([place.setdefault(key, len(place)) for key in pair], dtype=np.int64))
    texts, words = zip(*place) if place else ((), ())
    _, score = Records([texts], [words]).similar(pairs[0], pairs[1], None)
    return pd.Series(score)


def text_similarity(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Mean similarity (0 to 100) of pairs of values, one pair per compared column."""
    blends = []
    for a, b in pairs:
        a, b = F.lower(text_of(a)), F.lower(text_of(b))
        blends.append(_blend(a, b, sorted_tokens(a), sorted_tokens(b)))
    total = blends[0]
    for other in blends[1:]:
        total = total + other
    return total / len(blends)

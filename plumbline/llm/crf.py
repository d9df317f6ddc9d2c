"""A linear-chain conditional random field over word shapes: training on a small labelled table, Viterbi in batches."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np

#: Neighbours whose features count for a word.
OFFSETS = (-2, -1, 0, 1, 2)
EDGE = ("edge",)
#: Letters below U+0250 by their case, and digits: what words of one shape have in common, found by one translation.
_CLASSES = {c: "X" if chr(c).isupper() else "x" if chr(c).islower() else "0" for c in range(0x250) if chr(c).isupper() or chr(c).islower() or chr(c) in "0123456789"}
_SMALL = re.compile("x{3,}|X{3,}|0{19,}")
_STRIP = "\"'<>[](){}.,;:!?*|"
_RUNS = re.compile(r"([Xx]+)|(0+)|(.)\3*", re.S)


def shape(word: str) -> str:
    """A word's shape: runs of letters as X, Xx or x, runs of up to four digits by their length, longer ones as
    0+, other signs once a run."""
    kinds = "".join("0" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word[:64])
    out = []
    for match in _RUNS.finditer(kinds):
        run = match[0]
        if match[1]:
            out.append(run if len(run) == 1 else run[0] + ("x" if "x" in run[1:] else "X" if run[0] == "X" else ""))
        elif match[2]:
            out.append(run if len(run) <= 4 else "0+")
        else:
            out.append(run[0])
    return "".join(out) + ("~" if len(word) > 64 else "")


def features(word: str) -> tuple[str, ...]:
    """What the field sees of one word."""
    if word.isalpha():
        case = "lower" if word.islower() else "upper" if word.isupper() else "title" if word.istitle() else "mixed"
        return ("alpha", case, "w:" + word.lower())
    core = word.strip(_STRIP)
    digits = sum(c.isdigit() for c in core)
    size = digits if digits < 5 else 5 if digits < 7 else 7 if digits < 9 else 9 if digits < 12 else 12 if digits < 16 else 16
    out = [f"s:{shape(word)}", f"c:{shape(core)}", f"digits:{size}", f"dashes:{min(core.count('-'), 4)}", f"dots:{min(core.count('.'), 4)}"]
    if core.isalpha():
        out += ["alpha", "lower" if core.islower() else "upper" if core.isupper() else "title" if core.istitle() else "mixed", "w:" + core.lower()]
    elif digits and not any(c.isalpha() for c in core):
        out.append("number")
    elif digits:
        out.append("letters and digits")
    if not core:
        out.append("signs")
    if word[-1] in ".!?":
        out.append("stop")
    elif word[-1] in ",;:":
        out.append("comma")
    if word[0] in "([<":
        out.append("open")
    if "@" in word:
        out.append("@")
    return tuple(out)


@dataclass(frozen=True)
class Field:
    """The trained field: labels (the first is "outside"), a number for each feature, weights of features by
    offset (offset, feature, label), and of transitions (from, to)."""

    labels: tuple[str, ...]
    known: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    def scores_of(self, seen: tuple[str, ...]) -> np.ndarray:
        """What a word with these features adds to the scores of the labels at each offset."""
        rows = [self.known[f] for f in seen if f in self.known]
        return self.weights[:, rows].sum(axis=1)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def gradient(
    words: np.ndarray, labels: np.ndarray, lengths: np.ndarray, seen: np.ndarray, weights: np.ndarray, moves: np.ndarray, keep: float
) -> tuple[float, np.ndarray, np.ndarray]:
    """The loss (negative log likelihood and ``keep`` times half the squared weights) with its gradients.

    ``words`` (sequence, place) are rows of ``seen`` (word, feature), padded with -1; row 0 is the edge."""
    n, most = words.shape
    k = weights.shape[2]
    inside = np.arange(most)[None, :] < lengths[:, None]
    padded = np.zeros((n, most + 4), np.int64)  # row 0 of seen: the edge
    padded[:, 2 : most + 2] = np.where(inside, words, 0)
    scores = sum((seen @ weights[o])[padded[:, 2 + off : 2 + off + most]] for o, off in enumerate(OFFSETS))
    forward = np.zeros((n, most, k))
    backward = np.zeros((n, most, k))
    forward[:, 0] = scores[:, 0] + moves[0]
    for t in range(1, most):
        step = _logsumexp(forward[:, t - 1, :, None] + moves[None], 1) + scores[:, t]
        forward[:, t] = np.where(inside[:, t, None], step, forward[:, t - 1])
    backward[np.arange(n), lengths - 1] = moves[:, 0]
    for t in range(most - 2, -1, -1):
        step = _logsumexp(moves[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where((t < lengths - 1)[:, None], step, backward[:, t])
    total = _logsumexp(forward[np.arange(n), lengths - 1] + moves[:, 0], 1)
    at = np.exp(forward + backward - total[:, None, None]) * inside[..., None]
    gold = np.zeros_like(at)
    rows, places = np.nonzero(inside)
    gold[rows, places, labels[rows, places]] = 1
    off_by = at - gold
    loss = total.sum() - (scores * gold).sum()
    by_weight = np.zeros_like(weights)
    for o, off in enumerate(OFFSETS):
        by_word = np.zeros((len(seen), k))
        np.add.at(by_word, padded[:, 2 + off : 2 + off + most], off_by)
        by_weight[o] = seen.T @ by_word
    by_move = np.zeros_like(moves)
    by_move[0] += off_by[:, 0].sum(axis=0)
    by_move[:, 0] += off_by[np.arange(n), lengths - 1].sum(axis=0)
    loss -= (moves[0] * gold[:, 0].sum(axis=0)).sum() + (moves[:, 0] * gold[np.arange(n), lengths - 1].sum(axis=0)).sum()
    for t in range(1, most):
        on = inside[:, t]
        pair = forward[on, t - 1, :, None] + moves[None] + (scores[on, t] + backward[on, t])[:, None, :] - total[on, None, None]
        by_move += np.exp(pair).sum(axis=0)
        np.add.at(by_move, (labels[on, t - 1], labels[on, t]), -1)
        loss -= moves[labels[on, t - 1], labels[on, t]].sum()
    loss += keep / 2 * ((weights**2).sum() + (moves**2).sum())
    return loss, by_weight + keep * weights, by_move + keep * moves


def train(rows: list[tuple[list[str], list[str]]], outside: str = "O", keep: float = 0.05, rounds: int = 120, least: int = 2) -> Field:
    """A field from labelled rows (words, labels). Features seen in fewer than ``least`` words do not count.
    Weights move by their signs' agreement (resilient steps), the same way in every run."""
    rows = [(w, l) for w, l in rows if w]
    labels = (outside, *sorted({x for _, l in rows for x in l} - {outside}))
    counts = Counter(f for words, _ in rows for w in words for f in features(w))
    known = {f: i for i, f in enumerate([*EDGE, *sorted(f for f, n in counts.items() if n >= least)])}
    numbers: dict[tuple, int] = {EDGE: 0}
    most = max((len(w) for w, _ in rows), default=1)
    words, gold = np.full((len(rows), most), -1), np.zeros((len(rows), most), np.int64)
    for r, (own, own_labels) in enumerate(rows):
        for t, (word, label) in enumerate(zip(own, own_labels, strict=True)):
            words[r, t] = numbers.setdefault(features(word), len(numbers))
            gold[r, t] = labels.index(label)
    seen = np.zeros((len(numbers), len(known)))
    for kinds, number in numbers.items():
        seen[number, [known[f] for f in kinds if f in known]] = 1
    weights, moves = np.zeros((len(OFFSETS), len(known), len(labels))), np.zeros((len(labels), len(labels)))
    lengths = np.array([len(w) for w, _ in rows], np.int64)
    state = [[x, np.full(x.shape, 0.05), np.zeros_like(x)] for x in (weights, moves)]
    for _ in range(rounds if rows else 0):
        _, *slopes = gradient(words, gold, lengths, seen, weights, moves, keep)
        for part, slope in zip(state, slopes, strict=True):
            value, step, before = part
            same = np.sign(slope * before)
            np.clip(step * np.where(same > 0, 1.2, np.where(same < 0, 0.5, 1.0)), 1e-6, 1.0, out=step)
            slope = np.where(same < 0, 0.0, slope)
            value -= np.sign(slope) * step
            part[2] = slope
    return Field(labels, known, weights, moves)


def viterbi(runs: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """The best labels of many runs of scores (place, label), each between two outside words, the lowest label
    among equals. Runs of like length are worked on together, place by place."""
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(runs)
    order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
    lengths = np.array([len(runs[i]) for i in order])
    if not len(lengths) or not lengths[0]:
        return out
    if len(lengths) > 1 and lengths[0] > 4 * lengths[len(lengths) // 2] + 64:  # a few long ones apart
        cut = int(np.searchsorted(-lengths, -(4 * lengths[len(lengths) // 2] + 64)))
        for part in (order[:cut], order[cut:]):
            for i, found in zip(part, viterbi([runs[i] for i in part], moves), strict=True):
                out[i] = found
        return out
    n, most, k = len(order), int(lengths[0]), len(moves)
    scores = np.zeros((most, n, k))
    for r, i in enumerate(order):
        scores[: lengths[r], r] = runs[i]
    came = np.zeros((most, n, k), np.int8)
    best = scores[0] + moves[0]
    for t in range(1, most):
        on = int(np.searchsorted(-lengths, -t))  # runs longer than t
        ways = best[:on, :, None] + moves[None]
        came[t, :on] = ways.argmax(axis=1)
        best[:on] = ways.max(axis=1) + scores[t, :on]
    label = (best + moves[:, 0]).argmax(axis=1)
    labels = np.zeros((most, n), np.int8)
    for t in range(most - 1, -1, -1):
        on = int(np.searchsorted(-lengths, -t))
        labels[t, :on] = label[:on]
        if t:
            label[:on] = came[t, np.arange(on), label[:on]]
    for r, i in enumerate(order):
        out[i] = labels[: lengths[r], r]
    return out


def _short(run: re.Match) -> str:
    return run[0][0] * (19 if run[0][0] == "0" else 2)


class Decoder:
    """Labels of many word sequences by one field. Words are looked up once; those with the same known features
    share a row of scores."""

    #: Distinct words whose features are kept.
    KEPT = 500_000

    def __init__(self, field: Field):
        self.field = field
        self.rows: dict[tuple, int] = {}
        self.words: dict[str, int] = {}
        self.shapes: dict[str, int] = {}
        self.cues = {f[2:] for f in field.known if f.startswith("w:")}
        self.scores = np.zeros((0, len(OFFSETS), len(field.labels)))
        self.new: list[np.ndarray] = []
        self._row(EDGE)
        moves = field.moves
        # what any label can gain by its two transitions over the outside one
        gain = moves[:, 1:, None] + moves[None, 1:, :] - moves[:, :1, None] - moves[None, :1, :]
        self.gain = float(gain.max()) if gain.size else 0.0

    def _row(self, seen: tuple) -> int:
        known = tuple(f for f in seen if f in self.field.known)
        if known not in self.rows:
            self.rows[known] = len(self.rows)
            self.new.append(self.field.scores_of(known))
        return self.rows[known]

    def rows_of(self, words: list[str]) -> list[int]:
        if len(self.words) + len(self.shapes) > self.KEPT:
            self.words.clear()
            self.shapes.clear()
        known = self.words
        for word in set(words).difference(known):
            if word.strip(_STRIP).lower() in self.cues or len(word) > 64:
                known[word] = self._row(features(word))
                continue
            # words that differ in their letters alone, or in the length of longer runs of them, have the same features
            like = _SMALL.sub(_short, word.translate(_CLASSES))
            if like not in self.shapes:
                self.shapes[like] = self._row(features(word))
            known[word] = self.shapes[like]
        return list(map(known.__getitem__, words))

    def decode(self, sequences: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, labels) of the words of each sequence that are not outside.

        A word whose score as an outside word is ahead of any other by more than transitions can make good is
        outside in every best path; the chain is cut there, which changes no result, and the runs between such
        words are decoded together."""
        edge = [0, 0]
        rows, starts = [0, 0], []
        for words in sequences:
            starts.append(len(rows))
            rows += self.rows_of(words)
            rows += edge
        if self.new:
            self.scores = np.concatenate([self.scores, np.array(self.new)])
            self.new = []
        rows = np.array(rows + edge, np.int64)
        n = len(rows) - 4
        total = sum(self.scores[rows[2 + off : 2 + off + n], o] for o, off in enumerate(OFFSETS))
        ahead = total[:, 0] - (total[:, 1:].max(axis=1) if total.shape[1] > 1 else 0)
        open_ = ahead <= self.gain + 1e-9
        inside = np.zeros(n, bool)
        for start, words in zip(starts, sequences, strict=True):
            inside[start - 2 : start - 2 + len(words)] = True
        open_ &= inside
        change = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
        first, last = change[::2], change[1::2]
        labels = np.zeros(n, np.int8)
        for a, b, found in zip(first.tolist(), last.tolist(), viterbi([total[a:b] for a, b in zip(first, last, strict=True)], self.field.moves), strict=True):
            labels[a:b] = found
        hits = np.flatnonzero(labels)
        out = []
        for start, words in zip(starts, sequences, strict=True):
            a, b = np.searchsorted(hits, [start - 2, start - 2 + len(words)])
            places = hits[a:b]
            out.append((places - (start - 2), labels[places]))
        return out

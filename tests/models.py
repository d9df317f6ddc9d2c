"""Plain Python models of single semantics, written from their definitions, to test against."""

from __future__ import annotations

import re


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by the textbook table."""
    line = [0] * (len(b) + 1)
    for x in a:
        above = line[:]
        for j, y in enumerate(b, 1):
            line[j] = above[j - 1] + 1 if x == y else max(above[j], line[j - 1])
    return line[-1]


def ratio(a: str, b: str) -> int:
    return 100 if a == b else round(100 * (2 * common(a, b) / (len(a) + len(b))))


def window_ratio(a: str, b: str) -> int:
    if a == b:
        return 100
    a, b = sorted((a, b), key=len)
    if not a:
        return 0
    return max((ratio(a, b[i : i + len(a)]) for i in range(len(b))), default=0)


def words(text: str) -> str:
    kept = "".join(ch for ch in text if not 128 <= ord(ch) <= 255)
    return " ".join(sorted(re.sub(r"\W", " ", kept).lower().split()))


def alike(a: str, b: str) -> float:
    a, b = a.lower(), b.lower()
    if not a or not b:
        return 100.0 if a == b else 0.0
    return ratio(words(a), words(b)) * 0.5 + window_ratio(a, b) * 0.3 + ratio(a, b) * 0.2


def alike_rows(a, b) -> float:
    return sum(alike(x or "", y or "") for x, y in zip(a, b)) / len(a)


def block(row) -> str:
    return "_".join(v.lower()[:3] for v in row if v)


def greedy_groups(rows: list[tuple], threshold: float) -> dict[int, int]:
    """Row position to leader position, scanning each block in order."""
    leader: dict[int, int] = {}
    for i, row in enumerate(rows):
        if i in leader:
            continue
        leader[i] = i
        for j in range(i + 1, len(rows)):
            if j not in leader and block(row) == block(rows[j]) and alike_rows(row, rows[j]) >= threshold:
                leader[j] = i
    return leader


def phonetic(text: str) -> str:
    upper = text.upper()
    kept = upper[:1] + "".join(ch for ch in upper[1:] if ch not in "AEIOU")
    for old, new in (("PH", "F"), ("GH", "F"), ("CK", "K"), ("C", "K"), ("Z", "S")):
        kept = kept.replace(old, new)
    return re.sub(r"(.)\1+", r"\1", kept, flags=re.S)[:6]

"""XXH64 of many slices of a byte string at once."""

from __future__ import annotations

import numpy as np

# fixed values of the public XXH64 specification
P1, P2, P3, P4, P5 = (
    np.uint64(p)
    for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)
#: Slices worked on together, so that all columns stay in the processor's cache.
AT_ONCE = 16_384


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def xxh64_slices(data: bytes, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start:end] for every pair of arrays, as unsigned 64-bit numbers."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    words = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    halves = np.ndarray((len(data) + 1,), "<u4", padded.data, 0, (1,))
    out = np.empty(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(start), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            out[part] = _hash(padded, halves, words, start[part], end[part] - start[part], np.uint64(seed))
    return out


def _hash(octets: np.ndarray, halves: np.ndarray, words: np.ndarray, start: np.ndarray, size: np.ndarray, seed: np.uint64) -> np.ndarray:
    order = np.argsort(size, kind="stable")
    at, size = start[order].astype(np.int64), size[order].astype(np.int64)
    n = len(at)
    acc = np.full(n, seed + P5, np.uint64)
    long = int(np.searchsorted(size, 32))
    if long < n:  # stripes of four lanes
        lanes = [np.full(n - long, seed + c, np.uint64) for c in (P1 + P2, P2, np.uint64(0), -P1)]
        stripes = size[long:] // 32
        for s in range(int(stripes[-1])):
            on = int(np.searchsorted(stripes, s + 1))
            for i in range(4):
                lanes[i][on:] = _round(lanes[i][on:], words[at[long + on :] + 32 * s + 8 * i])
        mixed = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
        for lane in lanes:
            mixed = (mixed ^ _round(np.zeros_like(lane), lane)) * P1 + P4
        acc[long:] = mixed
        at[long:] += 32 * stripes
    acc += size.astype(np.uint64)
    rest = size % 32
    for step in range(3):
        on = np.flatnonzero(rest >= 8 * (step + 1))
        if not len(on):
            break
        lane = _round(np.zeros(len(on), np.uint64), words[at[on] + 8 * step])
        acc[on] = _turn(acc[on] ^ lane, 27) * P1 + P4
    at += rest // 8 * 8
    rest %= 8
    on = np.flatnonzero(rest >= 4)
    acc[on] = _turn(acc[on] ^ (halves[at[on]].astype(np.uint64) * P1), 23) * P2 + P3
    at[on] += 4
    rest[on] -= 4
    for step in range(3):
        on = np.flatnonzero(rest > step)
        acc[on] = _turn(acc[on] ^ (octets[at[on] + step].astype(np.uint64) * P5), 11) * P1
    acc = (acc ^ (acc >> np.uint64(33))) * P2
    acc = (acc ^ (acc >> np.uint64(29))) * P3
    out = np.empty(n, np.uint64)
    out[order] = acc ^ (acc >> np.uint64(32))
    return out

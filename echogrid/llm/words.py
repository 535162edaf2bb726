"""Words of many texts at once: byte classes, word borders and 64-bit word hashes as numpy arrays."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_RNG = np.random.default_rng(7)
BYTE_VALUES = _RNG.integers(1, 2**62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
SPAN = 1 << 20

# Fixed byte classes: True where a byte belongs to a word.
NOT_SPACE = np.array([b not in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D) for b in range(256)])
ALPHANUMERIC = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words(NamedTuple):
    """`bytes` is all texts, a space after each; `first` its text offsets; words by start, end, hash; `counts` per text."""

    bytes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def words(texts: list[str], is_word: np.ndarray = NOT_SPACE, lower: bool = True) -> Words:
    """Words are the longest runs of word bytes. Spans of 1 MiB, cut at word ends, bound the memory of very long texts."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(encoded) + b" ", dtype=np.uint8)
    if lower:
        data = LOWER[data]
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(e) + 1 for e in encoded], out=first[1:])
    inside = is_word[data]
    power, inverse = _powers(BASE, 2), _powers(INVERSE, 2)
    starts, ends, hashes, at = [], [], [], 0
    while at < len(data):
        to = min(at + SPAN, len(data))
        while to < len(data) and inside[to - 1]:
            gap = np.flatnonzero(~inside[to:to + SPAN])
            to = to + int(gap[0]) + 1 if len(gap) else min(to + SPAN, len(data))
        n = to - at
        if len(power) < n + 1:
            power, inverse = _powers(BASE, n + 1), _powers(INVERSE, n + 1)
        flag = np.zeros(n + 2, dtype=np.int8)
        flag[1:-1] = inside[at:to]
        step = np.diff(flag)
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[data[at:to]] * power[:n], out=total[1:])
        hashes.append(mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64)))
        starts.append(begin + at)
        ends.append(end + at)
        at = to
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    bounds = np.searchsorted(start, first)
    return Words(data, first, start, np.concatenate(ends) if ends else start, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.diff(bounds))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each text's distinct k-word windows, sorted; a text of fewer words, but one, is one window."""
    offset = np.concatenate([[0], np.cumsum(w.counts)])
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    n_windows = np.maximum(w.counts - k + 1, 0)
    owner = np.repeat(np.arange(len(w.counts)), n_windows)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + offset[owner]
    value = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        value = mix(value + w.hashes[at + j] if len(at) else value)
    tail = np.zeros(len(short), dtype=np.uint64)
    for j in range(k - 1):
        has = w.counts[short] > j
        tail[has] = mix(tail[has] + w.hashes[offset[short[has]] + j])
    owner, value = np.concatenate([owner, short]), np.concatenate([value, mix(tail + np.uint64(1))])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.ones(len(owner), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[fresh], value[fresh]

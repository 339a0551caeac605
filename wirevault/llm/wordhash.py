"""64-bit hashes of words and word windows, computed on whole byte arrays."""

from __future__ import annotations

import re

import numpy as np

_PIECE = 1 << 20
_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        have = _powers[base] = np.multiply.accumulate(table)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(pattern: bytes) -> np.ndarray:
    """Which bytes a one-byte pattern matches."""
    return np.array([re.fullmatch(pattern, bytes([b]), re.S) is not None for b in range(256)])


# Bytes that part words, by the two definitions in use.
BLANK = byte_class(rb"[\x20\x09-\x0D]")
NOT_WORD = byte_class(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def _pieces(data: bytes, gap: np.ndarray):
    """Parts of about `_PIECE` bytes that end where a word ends."""
    if len(data) <= _PIECE:
        yield data
        return
    start = 0
    while start < len(data):
        end = min(len(data), start + _PIECE)
        while end < len(data) and not gap[data[end]]:
            end += 1
        yield data[start:end]
        start = end


def word_hashes(text: str | None, gap: np.ndarray = BLANK) -> np.ndarray:
    """A hash of every word of the text, in order; A-Z count as a-z."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    found = []
    for piece in _pieces(text.encode().lower(), gap):
        b = np.frombuffer(piece, dtype=np.uint8)
        between = np.empty(len(b) + 2, dtype=np.int8)
        between[0] = between[-1] = 1
        between[1:-1] = gap[b]
        edge = np.diff(between)
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(first):
            continue
        total = np.empty(len(b) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_BYTES[b] * _power_table(_BASE, len(b))[: len(b)], out=total[1:])
        found.append(mix((total[last] - total[first]) * _power_table(_INVERSE, len(b) + 1)[first]))
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` words; of all words if there are fewer; none without words."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(_BASE) + words[k : n - width + 1 + k]
    return mix(out)

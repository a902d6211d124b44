"""Hashes of words and word sequences in numpy, the same on every machine."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

U = np.uint64
STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
BACK = pow(STEP, -1, 1 << 64)
CHUNK = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(STEP))
_power = {STEP: np.ones(1, U), BACK: np.ones(1, U)}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64, for i below n."""
    table = _power[base]
    while len(table) < n:
        table = np.concatenate([table, table * U(pow(base, len(table), 1 << 64))])
    if n <= 4 * CHUNK:
        _power[base] = table
    return table[:n]


def _chunks(data: bytes) -> Iterator[bytes]:
    """Pieces of about ``CHUNK`` bytes that end where a word ends."""
    at = 0
    while at < len(data):
        stop = at + CHUNK
        if stop < len(data):
            found = _SPACE.search(data, stop)
            stop = found.start() if found else len(data)
        yield data[at:stop]
        at = stop


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text, in order."""
    parts = []
    for chunk in _chunks(data):
        raw = np.frombuffer(chunk, np.uint8)
        word = np.concatenate([[False], ~_BLANK[raw], [False]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        total = np.zeros(len(raw) + 1, U)
        np.cumsum(_BYTE[raw] * powers(STEP, len(raw)), out=total[1:])
        sums = (total[ends] - total[starts]) * powers(BACK, len(raw) + 1)[starts]
        parts.append(mix(sums + (ends - starts).astype(U) * U(BACK)))
    return np.concatenate(parts) if parts else np.zeros(0, U)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of every ``n`` consecutive words; fewer words have none."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, U)
    if n <= 8:
        total = np.zeros(count, U)
        for i in range(n):
            total += words[i : i + count] * U(pow(STEP, i, 1 << 64))
    else:
        # Sums of prefixes, in pieces, so that the table of powers stays small.
        total = np.empty(count, U)
        for at in range(0, count, CHUNK):
            some = words[at : at + CHUNK + n - 1]
            prefix = np.zeros(len(some) + 1, U)
            np.cumsum(some * powers(STEP, len(some)), out=prefix[1:])
            m = len(some) - n + 1
            total[at : at + m] = (prefix[n:] - prefix[:-n]) * powers(BACK, len(some))[:m]
    return mix(total + U(n * BACK & (1 << 64) - 1))

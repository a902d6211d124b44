"""Suffix sorting against plain sorting, with queues small enough to write runs."""

import random
from collections import Counter

import numpy as np
import pytest

from wattframe.llm.induced import repeats, suffix_order


def text(n, symbols, seed):
    draw = random.Random(seed)
    return np.array([draw.randint(1, symbols) for _ in range(n)] + [0], np.uint8)


@pytest.mark.parametrize("buffer", [16, 64, 1 << 17])
@pytest.mark.parametrize("symbols", [1, 2, 3, 20, 250])
def test_order(symbols, buffer):
    for n in (0, 1, 2, 37, 300, 900):
        some = text(n, symbols, n)
        raw = some.tobytes()
        assert suffix_order(some, buffer).tolist() == sorted(range(n + 1), key=lambda i: raw[i:])


def test_runs_on_disk_in_every_level():
    some = np.append(np.tile(text(700, 3, 1)[:-1], 12), 0).astype(np.uint8)
    raw = some.tobytes()
    assert suffix_order(some, 128).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


@pytest.mark.parametrize("length", [3, 8, 10, 16])
def test_repeats(length):
    some = text(400, 2, length)
    raw = some.tobytes()
    starts = np.arange(400 - length)
    count = Counter(raw[i : i + length] for i in starts)
    want = [i for i in starts if count[raw[i : i + length]] > 1]
    assert repeats(some, starts, length, 64).tolist() == want


def test_only_given_starts_count():
    some = np.array([5, 6, 7, 5, 6, 7, 0], np.uint8)
    assert repeats(some, np.array([0]), 3).tolist() == []
    assert repeats(some, np.array([0, 3]), 3).tolist() == [0, 3]

"""Suffix sorting by induction, with queues that live on disk.

The suffixes of a shard are sorted by recursive induction. A suffix is falling if it is greater than the
next one, else rising; a rising one after a falling one is a seed. Sorted seeds induce the order of the
falling suffixes, and those that of the rising ones: whoever is taken from the queue in turn puts its left
neighbour in, with its own rank behind the neighbour's symbol. A first pass, in which seeds are ranked by
their symbol alone, ranks the strings between seeds; equal strings get equal ranks. These ranks are the
symbols of a text a third as long or shorter, whose suffixes are sorted in the same way and seed the second
pass.

Entries are taken from the queue in blocks: all that come before whatever the block itself induces.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Entries that a queue holds in memory before it writes a sorted run, and of these the next ones.
BUFFER, NEAR = 1 << 17, 1 << 12
_LAST = np.uint64(2**64 - 1)


def scratch_folder() -> str | None:
    """Where Spark lets this task spill; files there have no name and vanish with the task."""
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None


def scratch(n: int, dtype) -> np.ndarray:
    """An array on disk."""
    with tempfile.TemporaryFile(dir=scratch_folder()) as file:
        file.truncate(max(1, n) * np.dtype(dtype).itemsize)
        return np.asarray(np.memmap(file, dtype, "r+", shape=(max(1, n),)))[:n]


class Entries:
    """Keys and positions, in order of the keys. Entries with one key are interchangeable."""

    def __init__(self, key: np.ndarray, pos: np.ndarray):
        self.key, self.pos = key, pos

    def __len__(self) -> int:
        return len(self.key)

    @staticmethod
    def none() -> Entries:
        return Entries(np.empty(0, np.uint64), np.empty(0, np.uint32))

    @staticmethod
    def of(parts: list[tuple[np.ndarray, np.ndarray]]) -> Entries:
        if not parts:
            return Entries.none()
        key, pos = (np.concatenate(column) for column in zip(*parts))
        order = np.argsort(key)
        return Entries(key[order], pos[order])

    def merged(self, some: Entries) -> Entries:
        if not len(some):
            return self
        place = np.searchsorted(self.key, some.key, "right") + np.arange(len(some))
        rest = np.ones(len(self) + len(some), bool)
        rest[place] = False
        key, pos = np.empty(len(rest), np.uint64), np.empty(len(rest), np.uint32)
        key[place], pos[place] = some.key, some.pos
        key[rest], pos[rest] = self.key, self.pos
        return Entries(key, pos)

    def split(self, bound: int) -> tuple[Entries, Entries]:
        """Those up to the bound, and the others."""
        n = np.searchsorted(self.key, np.uint64(bound), "right")
        return self.cut(n)

    def cut(self, n: int) -> tuple[Entries, Entries]:
        return Entries(self.key[:n], self.pos[:n]), Entries(self.key[n:], self.pos[n:])


class DiskQueue:
    """Priority queue of (key, pos). Sorted runs are on disk, their least entries in memory.

    Everything up to ``edge`` is in ``front``, in order, and everything up to ``bound`` there, in ``held`` or,
    without order, in ``late``. A new entry is put in order when its turn is near, so it costs no copy of all.
    """

    def __init__(self, buffer: int = BUFFER):
        self.buffer, self.edge, self.bound = buffer, -1, -1
        self.near = max(1, min(NEAR, buffer // 4))
        self.front, self.held = Entries.none(), Entries.none()
        self.late: list[tuple] = []
        self.fresh: list[tuple] = []
        self.n_late = self.n_fresh = 0
        self.runs: list[list] = []  # file, entries taken, entries

    def push(self, key: np.ndarray, pos: np.ndarray) -> None:
        if self.edge >= 0 and len(key):
            near = key <= np.uint64(self.edge)
            if near.any():
                self.front = self.front.merged(Entries.of([(key[near], pos[near])]))
                key, pos = key[~near], pos[~near]
            near = key <= np.uint64(self.bound)
            if near.any():
                self.late.append((key[near], pos[near]))
                self.n_late += len(self.late[-1][0])
                key, pos = key[~near], pos[~near]
                if self.n_late >= self.buffer:
                    self._order_late()
        for at in range(0, len(key), self.buffer):
            self.fresh.append((key[at : at + self.buffer], pos[at : at + self.buffer]))
            self.n_fresh += len(self.fresh[-1][0])
            if self.n_fresh >= self.buffer:
                self._spill(self._take_fresh())

    def _order_late(self) -> None:
        self.held = self.held.merged(Entries.of(self.late))
        self.late, self.n_late = [], 0
        if len(self.held) > 2 * self.buffer:
            # More has come than memory is meant for: the greater ones go to disk.
            bound = int(self.held.key[self.buffer])
            keep, rest = self.held.split(bound)
            if len(rest):
                self.held, self.bound = keep, bound
                self._spill(rest)

    def _take_fresh(self) -> Entries:
        entries = Entries.of(self.fresh)
        self.fresh, self.n_fresh = [], 0
        return entries

    def _spill(self, entries: Entries) -> None:
        files = [tempfile.TemporaryFile(dir=scratch_folder()) for _ in range(2)]
        for file, column in zip(files, (entries.key, entries.pos)):
            file.write(column.tobytes())
        self.runs.append([files, 0, len(entries)])

    def _load(self) -> bool:
        """Fill ``held`` from the heads of all runs; False if nothing is left."""
        share = max(1 << 13, self.buffer // (len(self.runs) + 1))
        fresh = self._take_fresh()
        heads, ends = [fresh.cut(share)[0]], [len(fresh) <= share]
        for files, taken, count in self.runs:
            size, columns = min(share, count - taken), []
            for file, kind in zip(files, (np.dtype(np.uint64), np.dtype(np.uint32))):
                file.seek(taken * kind.itemsize)
                columns.append(np.frombuffer(file.read(size * kind.itemsize), kind))
            heads.append(Entries(*columns))
            ends.append(taken + size == count)
        lasts = [int(h.key[-1]) for h, end in zip(heads, ends) if not end]
        full = [int(h.key[-1]) for h in heads if len(h)]
        if not full:
            return False
        self.bound = min(lasts) if lasts else max(full)
        heads = [h.split(self.bound)[0] for h in heads]
        rest = fresh.cut(len(heads[0]))[1]
        if len(rest):
            self.fresh, self.n_fresh = [(rest.key, rest.pos)], len(rest)
        for run, head in zip(self.runs, heads[1:]):
            run[1] += len(head)
        for run in [r for r in self.runs if r[1] == r[2]]:
            for file in run[0]:
                file.close()
            self.runs.remove(run)
        self.held = Entries.of([(h.key, h.pos) for h in heads])
        return True

    def refill(self) -> bool:
        """Fill an empty front with the next entries; False if nothing is left."""
        self._order_late()
        if not len(self.held) and not self._load():
            return False
        self.edge = int(self.held.key[min(self.near, len(self.held)) - 1])
        self.front, self.held = self.held.split(self.edge)
        return True


def rising_suffixes(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one, a single least symbol, is."""
    n = len(text)
    out = scratch(n, bool)
    after = True
    for stop in range(n, 0, -BUFFER):
        start = max(0, stop - BUFFER)
        here = text[start : min(stop + 1, n)].astype(np.int64)
        less, same = here[:-1] < here[1:], here[:-1] == here[1:]
        if stop == n:
            less, same = np.append(less, True), np.append(same, False)
        # Equal neighbours take the type of the next place at which they differ.
        place = np.where(same, len(less), np.arange(len(less)))
        place = np.minimum.accumulate(place[::-1])[::-1]
        out[start:stop] = np.append(less, after)[place]
        after = bool(out[start])
    return out


def induce(text, top: int, rising, want: bool, seeds, ranks, buffer: int):
    """(pos, rank) in order of the suffixes whose ``rising`` is ``want``, induced by the seeds.

    ``want`` True goes through the order from its end, symbols counted down from ``top``. Ties share a rank.
    """
    def symbol(pos):
        value = text[pos].astype(np.uint64)
        return np.uint64(top) - value if want else value

    queue = DiskQueue(buffer)
    for at in range(0, len(seeds), buffer):
        some = seeds[at : at + buffer]
        key = symbol(some) << np.uint64(33) | np.uint64(1 << 32) | ranks[at : at + buffer].astype(np.uint64)
        queue.push(key, some.astype(np.uint32))
    places, classes = scratch(len(text), np.uint32), scratch(len(text), np.uint32)
    n_out, rank, last, look = 0, 0, -1, 64
    while len(queue.front) or queue.refill():
        key, pos = queue.front.key[:look], queue.front.pos[:look].astype(np.int64)
        new = np.empty(len(key), bool)
        new[0], new[1:] = int(key[0]) != last, key[1:] != key[:-1]
        own = rank + np.cumsum(new)
        left = np.maximum(pos - 1, 0)
        does = (pos > 0) & (rising[left] == want)
        made = np.where(does, symbol(left) << np.uint64(33) | own.astype(np.uint64), _LAST)
        late = np.flatnonzero(key[1:] > np.minimum.accumulate(made)[:-1])
        n = int(late[0]) + 1 if len(late) else len(key)
        look = min(max(64, 2 * n), 1 << 20)
        got = (key[:n] >> np.uint64(32)) & np.uint64(1) == 0
        m = int(got.sum())
        places[n_out : n_out + m], classes[n_out : n_out + m] = pos[:n][got], own[:n][got]
        n_out += m
        rank, last = int(own[n - 1]), int(key[n - 1])
        queue.front = queue.front.cut(n)[1]
        chosen = does[:n]
        queue.push(made[:n][chosen], left[:n][chosen].astype(np.uint32))
    return places[:n_out], classes[:n_out]


def _both(text, top, rising, seeds, ranks, buffer):
    falling, order = induce(text, top, rising, False, seeds, ranks, buffer)
    turn = (falling > 0) & rising[np.maximum(falling.astype(np.int64) - 1, 0)]
    most = int(order.max(initial=0))
    back, back_order = induce(
        text, top, rising, True, falling[turn].astype(np.int64), most - order[turn].astype(np.int64), buffer
    )
    return falling, back, back_order


def suffix_order(text: np.ndarray, buffer: int = BUFFER) -> np.ndarray:
    """Starts of all suffixes in order; ``text`` ends with its only 0 and is shorter than 2 ** 31."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.uint32)
    top = int(text.max())
    rising = rising_suffixes(text)
    seeds = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    _, back, back_order = _both(text, top, rising, seeds, np.zeros(len(seeds), np.int64), buffer)
    # Names of the strings between seeds, in their order; the end is the least.
    name = scratch(n, np.uint32)
    name[back.astype(np.int64)] = int(back_order.max(initial=0)) + 1 - back_order
    name[n - 1] = 0
    kinds, names = np.unique(name[seeds], return_inverse=True)
    if len(kinds) < len(seeds):
        short = scratch(len(seeds), np.uint32)
        short[:] = names
        seeds = seeds[suffix_order(short, buffer)]
    else:
        seeds = seeds[np.argsort(names)]
    falling, back, _ = _both(text, top, rising, seeds, np.arange(len(seeds)), buffer)
    # Within a symbol, falling suffixes come first.
    order = np.concatenate([np.array([n - 1], np.uint32), falling, back[::-1]])
    lead = text[order].astype(np.int64) * 2 + rising[order]
    return order[np.argsort(lead, kind="stable")]


def repeats(text: np.ndarray, starts: np.ndarray, length: int, buffer: int = BUFFER) -> np.ndarray:
    """Those of ``starts`` whose next ``length`` symbols also begin at another of them, by suffix order.

    ``text`` ends with its only 0; every start has ``length`` symbols before that.
    """
    usable = scratch(len(text), bool)
    usable[starts] = True
    order = suffix_order(text, buffer)
    order = order[usable[order]].astype(np.int64)
    # Neighbours with a common prefix of the length.
    same = np.arange(1, len(order))
    for step in range(length):
        same = same[text[order[same] + step] == text[order[same - 1] + step]]
    hit = np.zeros(len(order), bool)
    hit[same] = hit[same - 1] = True
    return np.sort(order[hit])

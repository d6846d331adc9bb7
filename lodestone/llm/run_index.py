"""A run-length index of a text: its Burrows-Wheeler transform as runs, sampled where runs begin and end.

Of the suffix order only two text positions of each run are kept. Where a run goes on, the suffix before a position in
order is the one before its predecessor in the text, one further: a step backwards within a run keeps neighbours
neighbours. So neighbours and their matches stream along the text from the samples, a stretch between two samples at a
time, and a repetitive text has few runs.
"""

from __future__ import annotations

import numpy as np


def packed(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, first byte highest; zeros follow the end."""
    key = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        key = (key[:-width] << np.uint64(8 * width)) | key[width:]
    return key[: len(text) + 1]


def suffix_order(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """All suffixes in order, by doubling from eight bytes on; what is alone in its group isn't sorted again."""
    n, key = len(text), key[: len(text)]
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n + 1, np.int64)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = start
    rank[n] = -1
    depth = 8
    alone = new & np.append(new[1:], True)
    todo = np.flatnonzero(~alone)  # places in the order
    while len(todo):
        at = order[todo]
        second = rank[np.minimum(at + depth, n)] + 1
        sub = np.argsort(rank[at].astype(np.uint64) << np.uint64(32) | second.astype(np.uint64))
        at, second, first = at[sub], second[sub], rank[at[sub]]
        order[todo] = at
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[at] = todo[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        todo = todo[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


class RunIndex:
    """The runs of the transform of ``text``: each one's byte and length, and the text positions of its first and last place.

    The suffix order is dropped once the runs are read off it.
    """

    def __init__(self, text: np.ndarray):
        n = len(text)
        key = packed(text)
        order = suffix_order(text, key)
        last = text[order - 1]
        head = np.ones(n, bool)
        head[1:] = last[1:] != last[:-1]
        whole = np.flatnonzero(order == 0)  # nothing stands before the whole text: a run of its own
        head[whole] = True
        head[whole[whole + 1 < n] + 1] = True
        heads = np.flatnonzero(head)
        self.size = n
        self.bytes, self.lengths = last[heads], np.diff(np.append(heads, n))
        self.firsts, self.lasts = order[heads], order[heads + self.lengths - 1]
        del order, last
        # the samples in order of the text: where a run's first place lies, what the run before ends with, and how much they share
        along = np.argsort(self.firsts)
        self.at = self.firsts[along]
        self.before = np.concatenate([[-1], self.lasts[:-1]])[along]
        self.shared = np.zeros(len(along), np.int64)
        some = self.before >= 0
        self.shared[some] = self._common(key, self.at[some], self.before[some])

    def _common(self, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b share, compared eight at a time."""
        words, out, active = key.byteswap(), np.zeros(len(a), np.int64), np.arange(len(a))
        while len(active):
            x, y = a[active] + out[active], b[active] + out[active]
            most = self.size - np.maximum(x, y)
            differ = words[np.minimum(x, self.size)] ^ words[np.minimum(y, self.size)]
            lowest = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.bitwise_count(lowest - np.uint64(1)) >> 3).astype(np.int64)
            same = np.minimum(same, most)
            out[active] += same
            active = active[same == 8]
        return out

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text position the suffix before it in order (-1: none), and how long a match both have.

        Only sampled positions were compared. From one sample to the next, the suffix before moves along with the
        position, and its match gets shorter by one.
        """
        gap = np.diff(np.append(self.at, self.size))
        step = np.arange(self.size) - np.repeat(self.at, gap)
        match = np.maximum(np.repeat(self.shared, gap) - step, 0)
        return np.where(match > 0, np.repeat(self.before, gap) + step, -1), match

    def earlier(self, key: np.ndarray, least: int) -> np.ndarray:
        """Whether a position's first ``least`` bytes also stand at a position of lower key.

        Positions whose match reaches ``least`` follow their suffix before to the first one of all that begin alike.
        """
        before, match = self.matching_statistics()
        to = np.arange(self.size)
        todo = np.flatnonzero(match >= least)
        to[todo] = before[todo]
        del before, match
        met = todo
        while len(todo):  # each goes on from where its place has gone: chains get half as long
            further = to[to[todo]]
            moved = further != to[todo]
            to[todo] = further
            todo = todo[moved]
        out = np.zeros(self.size, bool)
        if len(met):
            every = np.union1d(met, to[met])
            low = np.full(self.size, np.iinfo(np.int64).max)
            np.minimum.at(low, to[every], key[every])
            out[every] = key[every] > low[to[every]]
        return out

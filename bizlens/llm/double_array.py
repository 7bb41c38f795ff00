"""A double-array trie over sequences of 8-bit symbols, built and walked with NumPy (used by ``phrase_mining``).

A state is a slot; the child of state ``s`` by symbol ``x`` is slot ``base[s] + x``
if ``check`` there is ``s``. State 0 is dead: it is no state's parent, so a
position that has left the trie stays out of it. Free slots' ``check`` is -1.
"""

from __future__ import annotations

import numpy as np

SYMBOLS = 256
WIDE = 24               # states with more children get a range of slots of their own
SPARE = 4               # slots for each node among which the others are placed
TRIES = 64


class DoubleArray:
    """The trie of the rows of ``keys`` (sequences of equal length); ``end[i]`` is the state of row ``i``."""

    def __init__(self, keys: np.ndarray):
        self.rng = np.random.default_rng(12345)
        rows, length = keys.shape
        self.base, self.check = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self._grow(max(1024, SPARE * rows))
        self.root = 1
        self.check[:2] = -2             # dead state and root: taken, and no state's children
        state = np.full(rows, self.root, np.int64)
        for j in range(length):
            state = self._level(state, keys[:, j].astype(np.int64))
        self.end = state
        del self.rng

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next state of every position; 0 where the trie has none."""
        slot = self.base[state] + symbol
        return np.where(self.check[slot] == state, slot, 0)

    def _grow(self, slots: int) -> None:
        self.base = np.concatenate([self.base, np.zeros(slots, np.int32)])
        self.check = np.concatenate([self.check, np.full(slots, -1, np.int32)])

    def _level(self, parent: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        edge, inverse = np.unique(parent * SYMBOLS + symbol, return_inverse=True)
        above, by = edge // SYMBOLS, edge % SYMBOLS
        start = np.flatnonzero(np.r_[True, above[1:] != above[:-1]])
        size = np.diff(np.r_[start, len(edge)])
        states = above[start]
        for i in np.flatnonzero(size > WIDE).tolist():
            self._alone(states[i], by[start[i]:start[i] + size[i]])
        left = np.flatnonzero(size <= WIDE)
        for _ in range(TRIES):
            if not len(left):
                break
            left = left[~self._try(states[left], start[left], size[left], by)]
        for i in left.tolist():
            self._alone(states[i], by[start[i]:start[i] + size[i]])
        return (self.base[above] + by)[inverse]

    def _alone(self, state: int, symbols: np.ndarray) -> None:
        at = len(self.base)
        self._grow(SYMBOLS)
        self.base[state] = at
        self.check[at + symbols] = state

    def _try(self, states: np.ndarray, start: np.ndarray, size: np.ndarray, by: np.ndarray) -> np.ndarray:
        """A random base for each state; says for which of them all slots were free and none was wanted twice."""
        first = np.cumsum(size) - size
        symbol = by[np.repeat(start - first, size) + np.arange(int(size.sum()))]
        base = self.rng.integers(2, len(self.base) - SYMBOLS, len(states))
        slot = np.repeat(base, size) + symbol
        owner = np.repeat(states, size)
        free = np.logical_and.reduceat(self.check[slot] == -1, first)
        wanted = np.repeat(free, size)
        self.check[slot[wanted]] = owner[wanted]            # of several, one is left
        got = free & np.logical_and.reduceat(self.check[slot] == owner, first)
        back = np.repeat(free & ~got, size)
        mine = slot[back][self.check[slot[back]] == owner[back]]
        self.check[mine] = -1
        self.base[states[got]] = base[got]
        return got

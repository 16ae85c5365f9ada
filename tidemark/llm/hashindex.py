"""A lookup table over 64-bit keys in numpy arrays: open addressing with linear probing, filled and read in bulk."""

from __future__ import annotations

import numpy as np

#: An odd multiplier spreads neighbouring keys over the slots.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class HashIndex:
    """``keys`` are distinct and not negative; at most a quarter of the slots is used, so chains stay short."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, values.dtype)
        keys = keys.astype(np.int64)
        todo, slot = np.arange(len(keys)), self._slots(keys)
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            at, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[at], self.values[at] = keys[won], values[won]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SPREAD) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, missing: int | float) -> np.ndarray:
        """The values of ``keys``, ``missing`` where there is none."""
        keys = np.ascontiguousarray(keys, np.int64)
        slot = self._slots(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], self.values.dtype.type(missing))
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

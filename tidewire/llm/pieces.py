"""A bounded cache of pieces of text and their token ids, for encoders that cut texts into pieces and encode each piece by itself.

Pieces are places in the bytes of a block of texts and are told by 64 bits of hash over their bytes and length, so
a block is looked up with numpy: no string is made but for pieces that aren't known. With 500,000 pieces held, two different ones share
their bits about once in 3 * 10**13 looked up.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import common


class PieceTable:
    """What was used since the last change of age, and in the age before.

    encode: for a list of pieces, the ids of each, and whether each needs a closer look.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[list[np.ndarray], np.ndarray]], dtype: np.dtype, most: int = 500_000):
        self.encode, self.dtype, self.most = encode, dtype, most
        self.now, self.old = self._empty(), self._empty()

    def _empty(self) -> tuple[np.ndarray, ...]:
        """Hashes in order; for each: where its ids start, how many there are, a closer look; and all ids on end."""
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, self.dtype)

    @staticmethod
    def _find(table: tuple[np.ndarray, ...], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of h are in a table, and where those stand."""
        keys = table[0]
        at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        known = keys[at] == h if len(keys) else np.zeros(len(h), bool)
        return known, at[known]

    @staticmethod
    def _gather(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        ends = np.cumsum(size)
        return ids[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def _learn(self, h: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        known, at = self._find(self.old, h)
        _, start, size, odd, ids = self.old
        strange = np.flatnonzero(~known)
        made, doubt = self.encode([raw[a:b].tobytes().decode() for a, b in zip(starts[strange].tolist(), ends[strange].tolist(), strict=True)])
        hashes, sizes = np.concatenate([h[known], h[strange]]), np.concatenate([size[at], np.array([len(m) for m in made], np.int64)])
        more = np.concatenate([self._gather(ids, start[at], size[at]), *made])
        keys, start_, size_, odd_, ids_ = self.now
        first = len(ids_) + np.cumsum(sizes) - sizes
        keys, start_, size_, odd_ = np.concatenate([keys, hashes]), np.concatenate([start_, first]), np.concatenate([size_, sizes]), np.concatenate([odd_, odd[at], doubt])
        order = np.argsort(keys)
        self.now = keys[order], start_[order], size_[order], odd_[order], np.concatenate([ids_, more])

    def lookup(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of each text, and whether it holds a piece that needs a closer look. starts, ends: the pieces' places in raw; first: each text's first piece, and the end."""
        if len(self.now[0]) > self.most:
            self.old, self.now = self.now, self._empty()
        h = common.mix(common.byte_hashes(raw, starts, ends) + (ends - starts).astype(np.uint64))
        order = np.argsort(h)
        new = np.ones(len(h), bool)
        new[1:] = h[order[1:]] != h[order[:-1]]
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        one = order[new]  # a place of each distinct piece
        known, _ = self._find(self.now, h[one])
        if not known.all():
            strange = one[~known]
            self._learn(h[strange], raw, starts[strange], ends[strange])
        _, at = self._find(self.now, h[one])
        _, start, size, odd, ids = self.now
        start, size = start[at][which], size[at][which]
        found = self._gather(ids, start, size)
        bounds = np.concatenate([[0], np.cumsum(size)])[first].tolist()
        doubt = np.concatenate([[0], np.cumsum(odd[at][which])])
        return [found[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)], doubt[first[1:]] > doubt[first[:-1]]

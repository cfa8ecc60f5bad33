"""A bounded cache from word hashes to token ids, probed and read for whole batches with numpy.

Words are known by 64-bit hashes of their bytes; two of a million words share one with a
probability of about 1e-7. When the cache has ``most`` words or 16 ids for each of them, it starts
anew.
"""

from __future__ import annotations

import numpy as np

from .bytewords import SAME, U, placed_words


class WordIds:
    def __init__(self, most: int = 1_000_000):
        self.most = most
        self.bits = (2 * most).bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, U)
        self.slot = np.zeros(1 << self.bits, np.int32)
        self.n, self.used = 0, 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, "<u4")

    def _probe(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        keys = np.maximum(hashes, U(1))
        out = np.full(len(keys), -1, np.int64)
        at, open_ = self._probe(keys), np.arange(len(keys))
        while open_.size:
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.slot[at[hit]]
            on = ~hit & (there != 0)
            open_, at = open_[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, hashes: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """Store the ids (little-endian unsigned 32-bit) of distinct new hashes; their entries."""
        size = np.array([len(x) // 4 for x in ids], np.int32)
        total, n = int(size.sum()), len(ids)
        while self.n + n > len(self.start):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        entry = np.arange(self.n, self.n + n)
        self.flat[self.used : self.used + total] = np.frombuffer(b"".join(ids), "<u4")
        self.start[entry] = self.used + np.cumsum(size) - size
        self.size[entry] = size
        self.n, self.used = self.n + n, self.used + total
        keys = np.maximum(hashes, U(1))
        at, open_ = self._probe(keys), np.arange(n)
        while open_.size:
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[open_[free]]
            # Of several that meet in a free place one stays.
            won = free & (self.keys[at] == keys[open_])
            self.slot[at[won]] = entry[open_[won]]
            open_, at = open_[~won], (at[~won] + 1) & ((1 << self.bits) - 1)
        return entry

    def encode(self, buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray, missing) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids and the n + 1 offsets of each text's. ``missing`` gives the ids of a
        list of distinct words (bytes)."""
        hashes, counts, starts, ends = placed_words(buf, offsets, separators, SAME)
        entry = self.find(hashes)
        new = np.flatnonzero(entry < 0)
        if new.size:
            key, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            if self.n + len(key) > self.most or self.used > 16 * self.most:
                self.clear()
                key, first, back = np.unique(hashes, return_index=True, return_inverse=True)
                new = np.arange(len(hashes))
            raw, first = buf.tobytes() if len(buf) < 1 << 26 else buf, new[first]
            words = [bytes(raw[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            entry[new] = self.add(key, missing(words))[back]
        size = self.size[entry]
        upto = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        at = np.repeat(self.start[entry] - upto[:-1], size) + np.arange(upto[-1])
        return self.flat[at], upto[np.concatenate(([0], np.cumsum(counts)))]

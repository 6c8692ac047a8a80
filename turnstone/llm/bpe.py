"""A byte-level BPE vocabulary file read for counting, and a cache of bounded size over hashed pre-tokens."""

from __future__ import annotations

import heapq
import json

import numpy as np


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary files of this kind.

    Printable characters of Latin-1 stand for themselves; the others, in order, get the points from 256 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeTable:
    """Merges by pair of symbols, and the counting of what is left of a pre-token after all merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        vocabulary = said["model"]["vocab"]
        symbols = byte_symbols()
        self.of_byte = [vocabulary[symbols[b]] for b in range(256)]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in said["model"]["merges"])
        # A pair's number -> its rank and the number of the merged symbol.
        self.merges = {vocabulary[a] << 20 | vocabulary[b]: rank << 20 | vocabulary[a + b] for rank, (a, b) in enumerate(pairs)}
        self.special = [t["content"].encode() for t in said["added_tokens"] if t["special"]]

    def count(self, word: bytes) -> int:
        """Symbols left of ``word``: those it starts with, less one for each merge.

        The heap holds a rank and the place of the pair's left symbol; the linked list (``after``, ``before``)
        joins the symbols that are left. Equal ranks merge from the left. An entry whose pair has
        changed meanwhile is passed over.
        """
        merges = self.merges
        symbol = [self.of_byte[b] for b in word]
        n = len(symbol)
        heap = []
        for i in range(n - 1):
            found = merges.get(symbol[i] << 20 | symbol[i + 1])
            if found is not None:
                heap.append((found >> 20, i))
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            rank, i = heapq.heappop(heap)
            a = symbol[i]
            if a < 0 or (j := after[i]) >= n:
                continue
            found = merges.get(a << 20 | symbol[j])
            if found is None or found >> 20 != rank:
                continue
            symbol[i], symbol[j] = found & 0xFFFFF, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get(symbol[i] << 20 | symbol[k])
                if found is not None:
                    heapq.heappush(heap, (found >> 20, i))
            h = before[i]
            if h >= 0:
                found = merges.get(symbol[h] << 20 | symbol[i])
                if found is not None:
                    heapq.heappush(heap, (found >> 20, h))
        return left


class HashCache:
    """Values by 64-bit hash in a table of fixed size; a new key takes the place of the one in its slot."""

    def __init__(self, bits: int = 20):
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int64)

    def look_up(self, hashes: np.ndarray, make) -> np.ndarray:
        """The value of each hash; ``make(positions)`` gives those of keys that aren't in the table, one place each."""
        slots = (hashes >> self.shift).astype(np.int64)
        values = self.values[slots]
        missing = np.flatnonzero(self.keys[slots] != hashes)
        if len(missing):
            keys, first, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
            made = np.asarray(make(missing[first]), np.int64)
            values[missing] = made[inverse]
            slots = (keys >> self.shift).astype(np.int64)
            self.keys[slots] = keys
            self.values[slots] = 0
            # Of several keys with one slot the last stays, in both arrays.
            last = np.ones(len(slots), bool)
            last[:-1] = slots[1:] != slots[:-1]
            self.keys[slots[last]] = keys[last]
            self.values[slots[last]] = made[last]
        return values

"""Open-addressed interning of byte strings in numpy.

The strings are slices of one buffer. Their keys are xxhash64 of their
bytes; a table at most half full is probed linearly, for all strings at
once, and a slot is shared only by strings whose bytes are equal, so equal
keys of different strings do no harm.
"""

from __future__ import annotations

import numpy as np
import xxhash

from faresight.llm.words import Words

# xxhash64's five primes (fixed values)
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_SHORT = 32               # bytes; longer strings are hashed one by one
_LANES = 8                # lanes of 8 bytes compared at once; longer strings one by one


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


class Slices:
    """Byte strings ``buf[start:start + size]``."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.buf = np.concatenate([buf, np.zeros(8, np.uint8)])
        self.start, self.size = start, size
        self._lane = np.ndarray((len(self.buf) - 7,), "<u8", self.buf, strides=(1,))

    def __len__(self) -> int:
        return len(self.start)

    def bytes(self, i: int) -> bytes:
        a = self.start[i]
        return self.buf[a:a + self.size[i]].tobytes()

    def keys(self) -> np.ndarray:
        """xxhash64 (seed 0) of each string."""
        size = self.size
        h = size.astype(np.uint64) + _P5
        for k in range(_SHORT // 8 - 1):
            m = np.flatnonzero(size >= 8 * (k + 1))
            lane = _rotl(self._lane[self.start[m] + 8 * k] * _P2, 31) * _P1
            h[m] = _rotl(h[m] ^ lane, 27) * _P1 + _P4
        at, left = self.start + (size & ~7), size & 7
        m = np.flatnonzero(left >= 4)
        h[m] = _rotl(h[m] ^ (self._lane[at[m]] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
        at, left = at + (left & 4), left & 3
        for k in range(3):
            m = np.flatnonzero(left > k)
            h[m] = _rotl(h[m] ^ self.buf[at[m] + k].astype(np.uint64) * _P5, 11) * _P1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
        for i in np.flatnonzero(size >= _SHORT).tolist():
            h[i] = xxhash.xxh64_intdigest(self.bytes(i))
        return h

    def equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether strings i and j have the same bytes, pair by pair."""
        same = self.size[i] == self.size[j]
        for k in range(_LANES):
            m = np.flatnonzero(same & (self.size[i] > 8 * k))
            if not len(m):
                return same
            a, b = i[m], j[m]
            diff = self._lane[self.start[a] + 8 * k] ^ self._lane[self.start[b] + 8 * k]
            spare = np.maximum(8 * (k + 1) - self.size[a], 0).astype(np.uint64)
            same[m] = (diff << (np.uint64(8) * spare)) == 0
        for m in np.flatnonzero(same & (self.size[i] > 8 * _LANES)).tolist():
            same[m] = self.bytes(i[m]) == self.bytes(j[m])
        return same


def intern(strings: Slices) -> tuple[np.ndarray, np.ndarray]:
    """(owner, slot): the string that holds each table slot (-1: none), and
    the slot of each string. Equal strings, and only those, share a slot."""
    key = strings.keys()
    last = (1 << max(4, (2 * len(key) - 1).bit_length())) - 1
    owner = np.full(last + 1, -1, np.int64)
    slot = (key & np.uint64(last)).astype(np.int64)
    todo = np.arange(len(key))
    while len(todo):
        s = slot[todo]
        free = owner[s] < 0
        owner[s[free]] = todo[free]
        held = owner[s]
        same = held == todo
        maybe = np.flatnonzero(~same & (key[held] == key[todo]))
        same[maybe] = strings.equal(todo[maybe], held[maybe])
        todo = todo[~same]
        slot[todo] = (slot[todo] + 1) & last
    return owner, slot


def spaced(words: Words, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, sizes) of words i to j - 1 joined by single spaces."""
    start, size = words.start[i:j], words.end[i:j] - words.start[i:j]
    at = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    word = np.repeat(np.arange(len(size)), size)
    byte = np.arange(len(word))                                  # of the words' bytes, without the spaces
    out[byte + word] = words.low[byte + np.repeat(start - (at - np.arange(len(size))), size)]
    return out, at, size


def distinct_words(words: Words) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of a batch, and the number of each word in that list."""
    strings = Slices(words.low, words.start, words.end - words.start)
    owner, slot = intern(strings)
    used = np.flatnonzero(owner >= 0)
    number = np.zeros(len(owner), np.int64)
    number[used] = np.arange(len(used))
    first, raw = owner[used], words.low.tobytes()
    return [raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist())], number[slot]

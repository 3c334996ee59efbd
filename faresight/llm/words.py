"""Words of UTF-8 texts as numpy arrays.

The word classes used here split at ASCII bytes only, so whole batches are
cut into words on bytes: no per-word Python. A word's 64-bit fingerprint is
a polynomial of its bytes, taken from running sums; callers that must be
exact compare the bytes again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)
_PIECE = 1 << 19          # bytes hashed at a time
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_class(keep) -> np.ndarray:
    """256 entries: 0 for separators, else the byte with A-Z lower-cased.
    ``keep`` tells for an ASCII code whether it belongs to words; all bytes
    of other characters do."""
    t = np.zeros(256, np.uint8)
    for b in range(256):
        if b >= 0x80 or keep(b):
            t[b] = b + 32 if 0x41 <= b <= 0x5A else b
    t[0] = 0
    return t


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
#: [^\x20\x09-\x0D]+ after lower-casing A-Z; the zero byte is a word byte here
SPACED = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
SPACED[0] = 0xFF          # 0xFF occurs in no UTF-8 text


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    kind = np.int64 if wide else np.int32
    if len(arr) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offs = np.frombuffer(off, kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0]:offs[-1]], offs - offs[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = _PIECE
    while size < n + 1:
        size *= 2
    if size not in _POWERS:
        out = []
        for base in (_B, _BINV):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS.clear()
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Words:
    """Words of a batch: ``start``/``end`` byte positions, ``first[i]`` to
    ``first[i + 1]`` the words of text i, ``low`` the lower-cased bytes."""

    def __init__(self, arr: pa.Array, kind: np.ndarray, cuts=None):
        """``cuts`` tells, of the bytes, positions where a word ends and the next one begins."""
        buf, offs = utf8(arr)
        self.low = low = kind[buf]
        n = len(low)
        w = low != 0
        cut = np.zeros(n + 1, bool)
        cut[offs] = True                       # texts start here
        if cuts is not None:
            cut[cuts(buf)] = True
        prev = np.zeros(n + 1, bool)
        prev[1:] = w
        edge = np.ones(n + 1, bool)
        edge[:n] = ~w
        self.start = np.flatnonzero(w & (~prev[:n] | cut[:n]))
        self.end = np.flatnonzero(prev[1:] & (edge[1:] | cut[1:])) + 1
        self.first = np.searchsorted(self.start, offs).astype(np.int64)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit fingerprint of each word."""
        out = np.empty(len(self.start), np.uint64)
        i, n = 0, len(self.start)
        while i < n:
            a = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, a + _PIECE, "right")))
            b = self.end[j - 1]
            power, inverse = _powers(int(b - a))
            p = np.zeros(b - a + 1, np.uint64)
            np.cumsum((self.low[a:b].astype(np.uint64) + np.uint64(1)) * power[:b - a], out=p[1:])
            s, e = self.start[i:j] - a, self.end[i:j] - a
            out[i:j] = (p[e] - p[s]) * inverse[s]
            i = j
        return mix(out)

    def word(self, i: int) -> bytes:
        return self.low[self.start[i]:self.end[i]].tobytes()

    def joined(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by single spaces."""
        return b" ".join(self.word(k) for k in range(i, j))


def sequence_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of each run of n consecutive word fingerprints; entry i
    is that of words i to i + n - 1 (runs across texts are the caller's to
    leave out)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[k:len(h) - n + 1 + k]
    return mix(out + np.uint64(n))

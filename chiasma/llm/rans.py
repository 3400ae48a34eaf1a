"""Static range asymmetric numeral system over token ids, vectorised over interleaved lanes.

Token i of a segment belongs to lane i mod L; the lanes share one stream of 32-bit words. States are 64-bit, in
[2^31, 2^63); frequencies sum to 2^BITS. A segment is: lanes (u32), tokens (u32), the lanes' final states (u64 each), the
words in the order the decoder reads them (u32 each); all little-endian.
"""

from __future__ import annotations

import numpy as np

BITS = 20
LOW = np.uint64(1 << 31)
_MASK, _U32, _SHIFT = np.uint64((1 << BITS) - 1), np.uint64(32), np.uint64(BITS)
LANES, PER_LANE = 1024, 64


class Table:
    """Frequencies of ids, and what encoding and decoding look up. freq: one number per id, summing to 2^BITS."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self._slots = None

    @classmethod
    def of(cls, ids: np.ndarray, size: int) -> Table:
        """The table of these ids' own counts: every id that occurs has at least 1."""
        n = np.bincount(ids, minlength=size).astype(np.int64)
        if not len(ids):
            n[0] = 1
        f = np.where(n > 0, np.maximum(1, n * (1 << BITS) // n.sum()), 0)
        over = int(f.sum()) - (1 << BITS)
        if over < 0:
            f[np.argmax(f)] -= over
        while over > 0:  # taken from the largest, where it costs least
            k = np.argsort(-f, kind="stable")[:64]
            cut = np.minimum(over // len(k) + 1, np.maximum(f[k] - 1, 0))
            cut = np.minimum(cut, np.maximum(0, over - (np.cumsum(cut) - cut)))
            f[k] -= cut
            over -= int(cut.sum())
        return cls(f)

    def pack(self) -> bytes:
        """Gaps between the ids that occur and their frequencies, as u32 pairs, compressed."""
        import zlib

        ids = np.flatnonzero(self.freq)
        return zlib.compress(np.concatenate([np.diff(ids, prepend=0), self.freq[ids]]).astype("<u4").tobytes(), 6)

    @classmethod
    def unpack(cls, data: bytes) -> Table:
        import zlib

        a = np.frombuffer(zlib.decompress(data), "<u4")
        ids = np.cumsum(a[: len(a) // 2].astype(np.int64))
        f = np.zeros(int(ids[-1]) + 1, np.uint64)
        f[ids] = a[len(a) // 2 :]
        return cls(f)

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode(ids: np.ndarray, t: Table) -> bytes:
    n = len(ids)
    lanes = max(1, min(LANES, n // PER_LANE))
    x, words = np.full(lanes, LOW, np.uint64), []
    f_all, c_all = t.freq[ids], t.start[ids]
    top_all = f_all << np.uint64(63 - BITS)
    for k in range((n - 1) // lanes * lanes if n else -1, -1, -lanes):
        f, c, top = f_all[k : k + lanes], c_all[k : k + lanes], top_all[k : k + lanes]
        y = x[: len(f)]
        if (big := y >= top).any():
            words.append(y[big].astype("<u4"))  # the low halves
            y[big] >>= _U32
        q = y // f
        y[:] = (q << _SHIFT) + (y - q * f) + c
    return np.array([lanes, n], "<u4").tobytes() + x.astype("<u8").tobytes() + (np.concatenate(words[::-1]).tobytes() if words else b"")


def decode(data: bytes, t: Table) -> np.ndarray:
    lanes, n = (int(v) for v in np.frombuffer(data, "<u4", 2))
    x = np.frombuffer(data, "<u8", lanes, 8).astype(np.uint64)
    words, at = np.frombuffer(data, "<u4", offset=8 + 8 * lanes), 0
    out = np.empty(n, np.uint32)
    for k in range(0, n, lanes):
        y = x[: n - k]
        slot = y & _MASK
        s = t.slots[slot]
        out[k : k + lanes] = s
        y[:] = t.freq[s] * (y >> _SHIFT) + slot - t.start[s]
        low = y < LOW
        if m := int(np.count_nonzero(low)):
            y[low] = (y[low] << _U32) | words[at : at + m]
            at += m
    if at != len(words) or (x != LOW).any():
        raise ValueError("damaged rANS segment")
    return out

"""Outlines of sets of 64-bit numbers: bits from which a set's likeness to others is bounded from above.

A set's outline has a power of two of bits, at least four for each of its numbers; bit b tells whether the numbers equal to b modulo
that power are odd in count. A number that only one of two sets holds changes one bit, so outlines differ in as many
bits as numbers differ, or in fewer: sets whose outlines differ too much are never alike enough. The longer of two
outlines is folded to the length of the other one.
"""

from __future__ import annotations

import numpy as np

#: Bits of an outline for each number of its set, and bits at least.
BITS, LEAST_BITS = 4, 256


def outline(s: np.ndarray) -> bytes:
    bits = max(LEAST_BITS, 1 << (BITS * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(x: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words, cut to so many words a row."""
    return x if x.shape[1] == words else np.bitwise_xor.reduce(x.reshape(len(x), -1, words), axis=1)


class Outlines:
    """Many outlines, by length and by the size of their sets."""

    def __init__(self, sizes: np.ndarray, outlines: list[bytes]) -> None:
        length = np.fromiter(map(len, outlines), np.int64, len(outlines))
        self.of_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            at = at[np.argsort(sizes[at], kind="stable")]
            words = np.frombuffer(b"".join([outlines[k] for k in at.tolist()]), np.uint64).reshape(len(at), n // 8)
            self.of_length[n // 8] = (at, sizes[at], words)
        self.cut: dict[tuple[int, int], np.ndarray] = {}

    def near(self, size: int, told: bytes, percent: int) -> np.ndarray:
        """Places of all sets whose Jaccard similarity with this one can be percent / 100 or more; few others."""
        own = np.frombuffer(told, np.uint64)[None, :]
        found = [np.zeros(0, np.int64)]
        for n, (at, sizes, rows) in self.of_length.items():
            lo, hi = np.searchsorted(sizes, -(-percent * size // 100), "left"), np.searchsorted(sizes, 100 * size // percent, "right")
            if lo >= hi:
                continue
            words = min(n, own.shape[1])
            if words < n:
                if (n, words) not in self.cut:
                    self.cut[n, words] = _folded(rows, words)
                rows = self.cut[n, words]
            apart = np.bitwise_count(rows[lo:hi] ^ _folded(own, words)).sum(axis=1, dtype=np.int64)
            found.append(at[lo:hi][(100 + percent) * apart <= (100 - percent) * (size + sizes[lo:hi])])
        return np.concatenate(found)

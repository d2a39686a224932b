"""Words and word shingles of many texts at once, as 64-bit numbers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# odd numbers: multiplication by them can be undone modulo 2**64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93
_SHORT = 0xA0761D6478BD642F

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def scrambled(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers that leaves no pattern (splitmix64's last steps)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    out = []
    for b in (_BASE, _INVERSE):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of texts (UTF-8), in order: where each begins and ends in `raw`, its text, its number."""

    def __init__(self, texts: list[bytes]) -> None:
        self.raw = b"\n".join([*texts, b""])
        byte = np.frombuffer(self.raw, np.uint8)
        space = _IS_SPACE[byte] if len(byte) else np.ones(0, bool)
        edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
        self.begin = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        #: where each text begins in raw
        self.at = np.concatenate([[0], np.cumsum(size)[:-1]]) if texts else np.zeros(0, np.int64)
        #: first word of each text, and the number of words
        self.first = np.searchsorted(self.begin, self.at)
        self.n_words = np.diff(np.append(self.first, len(self.begin)))
        power, inverse = _powers(1 << max(20, int(len(byte)).bit_length()))
        upto = np.zeros(len(byte) + 1, np.uint64)
        np.cumsum((byte.astype(np.uint64) + np.uint64(1)) * power[: len(byte)], out=upto[1:])
        self.number = scrambled((upto[self.end] - upto[self.begin]) * inverse[self.begin])

    def runs(self, width: int) -> np.ndarray:
        """The number of each run of `width` words; those that cross a text's end are to be left out."""
        n = len(self.number) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        x = np.zeros(n, np.uint64)
        for k in range(width):
            x *= np.uint64(_STEP)
            x += self.number[k : k + n]
        return scrambled(x)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles, ascending. Fewer words than `width`: all of them as one; no words: none."""
    w = Words(texts)
    runs = w.runs(width)
    out = []
    for a, n in zip(w.first.tolist(), w.n_words.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(runs[a : a + n - width + 1]))
        elif n:
            x = np.uint64(_SHORT)
            with np.errstate(over="ignore"):
                for v in w.number[a : a + n]:
                    x = x * np.uint64(_STEP) + v
            out.append(scrambled(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

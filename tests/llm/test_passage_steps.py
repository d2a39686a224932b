"""Steps of op9 over many texts at once, against plain loops."""

import random

import numpy as np
import pyarrow as pa

from gleanspark.llm.passages import _APART, SEED_WORDS, WINDOW, _gap, _inside, _spans, _within, all_minima, minima, seed_pairs


def test_minima_of_many_texts():
    rng = np.random.default_rng(3)
    for top in (1, 2, 1000):
        n = rng.integers(-4, 12, 200)
        first = np.cumsum(np.maximum(n, 0) + SEED_WORDS - 1) - np.maximum(n, 0)
        x = rng.integers(0, top, first[-1] + 20).astype(np.uint64)
        plain = [f + minima(x[f : f + k], WINDOW) for f, k in zip(first.tolist(), n.tolist(), strict=True) if k > 0]
        assert all_minima(x, first, n).tolist() == np.concatenate(plain).tolist()


def test_pairs_keep_to_their_patch_and_covers_to_their_text():
    patch = lambda starts, ends: {"starts": starts, "ends": ends}
    kind = pa.list_(pa.struct([("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]))
    patches = pa.array([[patch([0, 6], [4, 9])], [], [patch([20, 30], [25, 33]), patch([2, 5], [3, 5])]], kind)
    of = np.repeat([0, 1, 2], [4, 2, 6])
    word = np.array([0, 3, 5, 9, 1, 2, 2, 4, 5, 20, 26, 31])
    i, segment, mine = _inside(of, word, patches)
    assert list(zip(i.tolist(), segment.tolist(), mine.tolist(), strict=True)) == [(0, 0, 0), (1, 0, 0), (3, 1, 0), (9, 2, 1), (11, 3, 1), (6, 4, 2), (8, 5, 2)]
    u, v = seed_pairs(np.arange(len(i)), word[i] + mine * _APART, segment)
    assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == [(0, 2), (1, 2), (3, 4), (5, 6)]
    covers = pa.array([[{"s": 2, "e": 4}, {"s": 0, "e": 9}], None, [{"s": 4, "e": 8}]], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
    at = np.array([0, 0, 1, 2, 2])
    assert _within(at, np.array([3, 3, 3, 4, 3]), np.array([9, 10, 4, 8, 5]), _spans(covers, "s", "e")).tolist() == [True, False, False, True, False]


def test_gap_is_the_longest_common_subsequence():
    def plain(x, y):
        row = [0] * (len(y) + 1)
        for w in x:
            last = 0
            for k, v in enumerate(y):
                last, row[k + 1] = row[k + 1], last + 1 if w == v else max(row[k + 1], row[k])
        return row[-1]

    rng = random.Random(4)
    for _ in range(500):
        x, y = ([b"%d" % rng.randrange(4) for _ in range(rng.randrange(70))] for _ in range(2))
        assert _gap(x, y) == plain(x, y)

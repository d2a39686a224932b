"""Nearest neighbours, hard negatives and vector codes against brute force."""

import math
import random

import numpy as np
import pytest

from gleanspark.llm import codes as C
from gleanspark.llm import negatives as M
from gleanspark.llm import neighbours as N
from gleanspark.llm import vector_blocks as B

SCHEMA = "vec_id long, embedding array<double>, label int, score int, key string, v string, cell int, shard string, grp long, ids string"


def table(spark, rows, schema=SCHEMA):
    """vec_id, embedding, label, and columns named like those that operators make."""
    return spark.createDataFrame([(i, v, y, 1, "x", "y", 7, "z", 3, "w") for i, v, y in rows], schema).repartition(5)


def made(seed=5, n=700, width=8):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = [(i, [c + r.gauss(0, 0.3) for c in centres[i % 6]], r.randrange(4)) for i in range(n)]
    same = [0.5] * width
    rows += [(n + i, same, i % 3) for i in range(400)]
    at = n + 400
    rows += [(at, None, 1), (at + 1, [None] * width, 1), (at + 2, [float("nan")] * width, 2), (at + 3, [], 0), (at + 4, [0.0] * width, 0), (at + 5, [math.inf] * width, 1), (at + 6, [1.0, -2.0], 3), (None, same, 1), (at + 7, same, None)]
    return rows


def fit(v, zero=True):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def wide(v, width=8):
    return list(v) + [0.0] * (width - len(v))


def nearest_by_force(rows, k=10, every=100):
    whole = sorted((i, wide(v)) for i, v, _ in rows if i is not None and fit(v, zero=False))
    ids, x = np.array([i for i, _ in whole]), np.array([v for _, v in whole])
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        d = N.distances(x, x[q])
        at = [j for j in np.lexsort((ids, d)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(d[j])) for j in at]
    return out


def found(df):
    out = {}
    for x in sorted(df.collect(), key=lambda x: (x["query_id"], x["rank"])):
        out.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
        assert x["rank"] == len(out[x["query_id"]])
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    """Many shards, cells, groups and blocks from few rows."""
    monkeypatch.setattr(B, "MOST_ROWS", 100)
    monkeypatch.setattr(N, "LEAF_ROWS", 8)
    monkeypatch.setattr(M, "LEAF_ROWS", 8)
    monkeypatch.setattr(M, "GROUP_ROWS", 400)


def test_factor_one_is_exact(spark, small_blocks):
    rows = made()
    df = table(spark, rows)
    assert found(N.nearest(df, factor=1.0)) == nearest_by_force(rows)
    assert N.nearest(df.limit(0)).count() == 0
    assert N.nearest(df.where("vec_id = 100")).count() == 0
    few = found(N.nearest(df.where("vec_id in (100, 3, 200)"), factor=1.0))
    assert {q: len(x) for q, x in few.items()} == {100: 2, 200: 2}


def test_repeated_ids_and_far_vectors(spark, small_blocks):
    rows = [(i, [float(i), 1.0], 0) for i in range(60)] + [(7, [0.5, 1.0], 1), (7, [0.5, 1.0], 0), (100, [1e300, 1.0], 0), (101, [-1e300, 1.0], 0), (102, [1.7e308, -1.7e308], 1)]
    stands = min([[7.0, 1.0], [0.5, 1.0]], key=lambda v: np.array(v, "<f8").tobytes())
    single = [r for r in rows if r[0] != 7] + [(7, stands, 0)]
    got = found(N.nearest(table(spark, rows), factor=1.0, query_every=7))
    want = {q: x for q, x in nearest_by_force([(i, v, y) for i, v, y in single], every=7).items()}
    assert {q: [(i, s) for i, s in x] for q, x in got.items()} == {q: [(i, s) for i, s in x] for q, x in ((q, x) for q, x in want.items())}


def recall(got, want):
    return sum(len({i for i, _ in want[q]} & {i for i, _ in got.get(q, [])}) for q in want) / sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["even", "clusters", "curved"])
def test_recall_of_the_default_factor(spark, small_blocks, kind):
    r = np.random.default_rng(3)
    if kind == "even":
        x = r.normal(size=(2000, 32))
    elif kind == "clusters":
        x = r.normal(size=(20, 32))[r.integers(20, size=2000)] + 0.3 * r.normal(size=(2000, 32))
    else:
        x = np.tanh(r.normal(size=(2000, 5)) @ r.normal(size=(5, 32)) * 0.4) + 0.05 * r.normal(size=(2000, 32))
    rows = [(i, v, 0) for i, v in enumerate(x.tolist())]
    got, want = found(N.nearest(table(spark, rows), query_every=20)), nearest_by_force([(i, wide(v, 32), y) for i, v, y in rows], every=20)
    assert recall(got, want) >= 0.9
    of = {i: v for i, v, _ in rows}
    for q, answer in got.items():
        assert len(answer) == 10 and answer == sorted(answer, key=lambda a: (a[1], a[0]))
        assert all(math.isclose(s, math.dist(of[q], of[i]), rel_tol=1e-12) for i, s in answer)
        # what is missed is not nearer than the last one found over the factor
        assert all(i in {a for a, _ in answer} or s * N.FACTOR >= answer[-1][1] for i, s in want[q])


def test_pruned_search_looks_at_less():
    r = np.random.default_rng(1)
    x = np.tanh(r.normal(size=(4000, 4)) @ r.normal(size=(4, 16)) * 0.4)
    nodes, order = N.grow(x)
    seen = []

    class Counting(N.Search):
        def _leaf(self, node, at):
            seen.append(len(at))
            super()._leaf(node, at)

    q = x[::100]
    looked = {}
    for factor in (1.0, 2.0):
        seen.clear()
        Counting(nodes, x[order], [[int(i)] for i in order], q, np.full(len(q), np.inf), 10, factor)
        looked[factor] = sum(seen) / len(q) / (nodes["vantage"] < 0).sum()
    assert looked[2.0] < looked[1.0] < 0.5


def negatives_by_force(rows, scale=256):
    whole = [(i, [math.floor(x) * scale if abs(x) >= 2**53 else math.floor(scale * x) for x in wide(v, max(len(w) for _, w, _ in rows if w))], y) for i, v, y in rows if i is not None and y is not None and fit(v)]
    top, out = (1 << 63) - 1, []
    for a, q, y in whole:
        if a % 50:
            continue
        scored = sorted((-max(-top - 1, min(top, sum(s * t for s, t in zip(q, v, strict=True)))), i, z) for i, v, z in whole if i != a)
        for s, p, _ in [x for x in scored if x[2] == y][:5]:
            hard = [(-t, i) for t, i, z in scored if z != y and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, k + 1, i, -s, t) for k, (t, i) in enumerate(hard)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark, small_blocks):
    rows = made(seed=9)
    df = table(spark, rows)
    got = sorted(map(tuple, M.hard_negatives(df).collect()))
    assert got == negatives_by_force(rows) and len(got) > 100
    assert M.hard_negatives(df.limit(0)).count() == 0
    assert M.hard_negatives(df.where("vec_id = 100")).count() == 0
    assert M.hard_negatives(df.withColumn("label", df.label * 0)).count() == 0


def test_hard_negatives_with_many_labels_and_large_components(spark, small_blocks):
    r = random.Random(2)
    rows = [(i, [r.random() * 10.0 ** r.randrange(0, 9), r.gauss(0, 1)], r.randrange(60) - 30) for i in range(900)]
    rows += [(1000, [1e300, 1.0], 1), (1001, [1e300, -1.0], 1), (1002, [3e17, 0.0], 2), (1050, [-4.0, 1e16], 5), (1051, [0.0, 0.0], 5), (1053, [0.0, 1e15], 6)]
    assert sorted(map(tuple, M.hard_negatives(table(spark, rows)).collect())) == negatives_by_force(rows)


def test_a_node_is_passed_over_only_if_it_cannot_matter():
    r = np.random.default_rng(4)
    x = np.floor(256 * r.normal(size=(1500, 6)))
    nodes, centres, order = M.grow(x, np.zeros(1500, np.int64))
    y, q = x[order], x[:40]
    least, most, _ = M.reach(q, centres, nodes["radius"])
    for k in np.flatnonzero(nodes["left"] < 0).tolist():
        s = q @ y[nodes["start"][k] : nodes["stop"][k]].T
        assert (least[:, k] <= s.min(1)).all() and (s.max(1) <= most[:, k]).all()


def codes_by_force(rows, size=256, rounds=4, scale=1024):
    kept = [(i, v, y) for i, v, y in rows if fit(v)]
    width = -(-max(len(v) for _, v, _ in kept) // 4) * 4
    m = width // 4
    exact = lambda x: math.floor(x) * scale if abs(x) >= 2**53 else math.floor(scale * x)
    whole = [(i, [exact(x) for x in wide(v, width)], y, v) for i, v, y in kept]
    first = sorted(whole, key=lambda x: (x[0] is None, x[0] or 0, np.array(x[3], "<f8").tobytes()))[:size]
    books = [[x[1][p * m : (p + 1) * m] for x in first] for p in range(4)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            of = {}
            for x in whole:
                v = x[1][p * m : (p + 1) * m]
                of.setdefault(near(v, books[p])[1], []).append(v)
            books[p] = [[sum(c) // len(of[j]) for c in zip(*of[j], strict=True)] if j in of else b for j, b in enumerate(books[p])]
    out, total = [], {}
    for i, v, y, _ in whole:
        got = [near(v[p * m : (p + 1) * m], books[p]) for p in range(4)]
        out.append((i, "".join(f"{j:02x}" for _, j in got), sum(d for d, _ in got), y))
        total[y] = total.get(y, 0) + out[-1][2]
    top = (1 << 63) - 1
    return [(i, c, min(e, top), min(total[y], top)) for i, c, e, y in out], C.fingerprint(books)


def same_codes(spark, rows):
    want, books = codes_by_force(rows)
    got = C.compressed(table(spark, rows)).collect()
    assert sorted([(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got], key=lambda x: (x[0] is None, str(x))) == sorted(want, key=lambda x: (x[0] is None, str(x)))
    assert {r["codebooks_sha256"] for r in got} == {books}


def test_codes_equal_brute_force(spark):
    r = random.Random(6)
    rows = [x for x in made(seed=7, n=500) if x[0] != 1106]
    rows += [(3, [r.gauss(0, 1) for _ in range(8)], None), (3, [r.gauss(0, 1) for _ in range(8)], 1), (-5, [0.25] * 8, 9), (2000, [1.0] * 5, 2)]
    same_codes(spark, rows)
    assert C.compressed(table(spark, rows).limit(0)).count() == 0


def test_codes_of_few_and_of_large_vectors(spark):
    r = random.Random(8)
    same_codes(spark, [(i, [float(i % 3), 1.0, 2.0, 3.0], i % 2) for i in range(20)])
    same_codes(spark, [(i, [r.choice([1, -1]) * r.random() * 10.0 ** r.randrange(0, 12) for _ in range(4)], 0) for i in range(60)])
    same_codes(spark, [(i, [r.gauss(0, 1) * 1e300, r.gauss(0, 1), 5e18, 0.0], 0) for i in range(40)])


def test_screening_leaves_every_nearest_entry():
    r = np.random.default_rng(2)
    for size in (3, 1000, 1 << 20, 1 << 27):
        book = r.integers(-size, size, (256, 16))
        x = np.concatenate([r.integers(-size, size, (300, 16)), book[:50], (book[:50] + book[50:100]) // 2])
        best, error, again = C.nearest(x, book)
        d = ((x[:, None, :] - book[None]) ** 2).sum(2)
        assert (best == d.argmin(1)).all() and (error == d.min(1)).all()
    far = book + (1 << 28)  # float32 alone can't tell these apart
    near = far[:100] + r.integers(-2, 3, (100, 16))
    best, _, again = C.nearest(near, far)
    assert (best == ((near[:, None, :] - far[None]) ** 2).sum(2).argmin(1)).all()

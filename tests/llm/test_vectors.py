import math
import random

from gleanspark.llm.vectors import top_k


def brute(rows, k=10, every=100):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, v in whole:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in whole if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def test_top_k_equals_brute_force(spark):
    r = random.Random(8)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, 0.2) for c in r.choice(centres)]) for i in range(900)]
    same = [0.5] * 8
    rows += [(900 + i, same) for i in range(500)]
    rows += [(1400, None), (1401, [None] * 8), (1402, [float("nan")] * 8), (1403, []), (1404, [1.0, 2.0]), (1500, [0.0] * 8), (1600, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for x in sorted(top_k(df).collect(), key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    assert got == brute(rows)
    assert top_k(df.limit(0)).count() == 0
    assert top_k(df.where("vec_id = 100")).count() == 0


def test_large_components_are_exact(spark):
    top = (1 << 63) - 1
    rows = [(0, [1e13, 0.0]), (1, [1 / 1024, 0.0]), (2, [-3e18, 1e-3]), (3, [1e300, -1e300]), (4, [0.0, 5.0]), (100, [1.7e308, 1.7e308]), (101, [123456789.5, 987654321.25]), (200, [0.0, 1.0])]
    r = random.Random(4)
    rows += [(300 + i, [r.choice([1, -1]) * r.random() * 10.0 ** r.randrange(-3, 16), r.random() * 10.0 ** r.randrange(0, 12)]) for i in range(300)]
    exact = lambda x: math.floor(x) * 1024 if abs(x) >= 2**53 else math.floor(1024 * x)
    whole = [(i, [exact(x) for x in v]) for i, v in rows]
    got = {}
    for x in sorted(top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    for q, v in whole:
        if q % 100 == 0:
            scored = sorted((-max(-top - 1, min(top, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in whole if i != q)[:10]
            assert got[q] == [(i, -s) for s, i in scored], q
    small = top_k(spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>")).collect()
    assert [(x["vec_id"], x["score"]) for x in small] == [(1, 10240000000000000)]

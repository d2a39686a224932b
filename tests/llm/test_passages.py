import random

from llm_docs import documents

from gleanspark.llm.passages import align, chains, minima, repeated_passages


def test_minima_cover_each_window():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (1, 3, 16, 17, 200):
        x = r.integers(0, 50, n).astype(np.uint64)
        at = set(minima(x, 16).tolist())
        for k in range(max(1, n - 15)):
            w = x[k : k + 16]
            assert any(k <= i < k + 16 and x[i] == w.min() for i in at)


def test_chains_equal_plain_dynamic_programming():
    r = random.Random(3)
    for _ in range(200):
        pairs = sorted({(r.randrange(40), r.randrange(40)) for _ in range(r.randrange(1, 14))})
        cost = 5 / 128
        best = [0.0] * len(pairs)
        for i, (a, b) in enumerate(pairs):
            best[i] = 5 + max([0.0, *(best[j] - cost * (a - c + b - d) for j, (c, d) in enumerate(pairs[:i]) if c < a and d < b)])
        got = chains(pairs)
        assert sorted(i for c in got for i in c) == list(range(len(pairs)))
        top = got[0]
        value = 5 * len(top) - cost * sum(pairs[y][0] - pairs[x][0] + pairs[y][1] - pairs[x][1] for x, y in zip(top, top[1:], strict=False))
        assert abs(value - max(best)) < 1e-9


def test_align_steps_over_changed_words():
    x = [b"w%d" % i for i in range(60)]
    y = [*x[:20], b"NEW", *x[21:40], *x[42:]]
    a, ae, b, be, same = align(x, y, [(8, 8), (44, 42)])
    assert (a, ae, b, be) == (0, 60, 0, 58) and same == 57


def test_planted_passages_are_found_and_others_left_alone(spark):
    r = random.Random(5)
    word = lambda: f"v{r.randrange(5000)}"
    text = lambda n: [word() for _ in range(n)]
    exact, fuzzy, short = text(60), text(90), text(30)
    texts = []
    for k in range(60):
        w = text(r.randrange(0, 200))
        p = {0: exact, 1: [x if r.random() > 0.04 else word() for x in fuzzy], 2: short}.get(k % 5, [])
        at = r.randrange(len(w) + 1)
        texts.append((r.choice([" ", "\n"])).join(w[:at] + p + w[at:]))
    texts += [None, "", "é " * 400, "é " * 400]
    rows = repeated_passages(documents(spark, texts)).collect()
    hit = {x["doc_id"] for x in rows} | {x["partner_id"] for x in rows}
    assert {k for k in range(60) if k % 5 == 0} <= hit
    assert sum(k in hit for k in range(60) if k % 5 == 1) >= 11
    assert not any(k in hit for k in range(60) if k % 5 > 1)
    for x in rows:
        if x["doc_id"] % 5 == 0 and x["doc_id"] < 60:
            got = texts[x["doc_id"]].split()[x["start_word"] : x["end_word"]]
            assert got == exact == texts[x["partner_id"]].split()[x["partner_start_word"] : x["partner_end_word"]]
    assert repeated_passages(documents(spark, texts).limit(0)).count() == 0


def test_a_verbatim_passage_is_found_whatever_holds_its_parts(spark):
    w = [f"w{i}" for i in range(60)]
    own = lambda k: [f"d{k}x{i}" for i in range(30)]
    texts = ["", " ".join(own(1) + w[:35]), " ".join(w[25:] + own(2))] + [" ".join(own(k) + w + own(-k)) for k in range(3, 20)]
    rows = [x for x in repeated_passages(documents(spark, texts)).collect() if x["partner_id"] == 3]
    assert sorted(x["doc_id"] for x in rows) == list(range(4, 20))
    assert all((x["start_word"], x["end_word"], x["n_equal"]) == (30, 90, 60) for x in rows)


def test_each_place_of_a_passage_is_found_and_repeated_lines_too(spark):
    w, line = [f"w{i}" for i in range(60)], [f"l{i}" for i in range(10)]
    own = lambda k, n=40: [f"d{k}x{i}" for i in range(n)]
    texts = [w, own(1) + w + own(2) + w + own(3), own(4) + line * 10 + own(5), own(6, 20) + line * 10 + own(7)]
    rows = repeated_passages(documents(spark, [" ".join(t) for t in texts])).collect()
    assert sorted((x["start_word"], x["end_word"]) for x in rows if x["doc_id"] == 1) == [(40, 100), (140, 200)]
    assert (20, 120, 40, 140) in {(x["start_word"], x["end_word"], x["partner_start_word"], x["partner_end_word"]) for x in rows if x["doc_id"] == 3}


def test_recall_of_passages_with_changed_words(spark):
    r = random.Random(9)
    text = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    texts, kinds = [], []
    for n in (50, 60, 100):
        for percent in (10, 15, 20):
            for _ in range(60):
                p = text(n)
                q = list(p)
                for i in r.sample(range(1, n - 1), n * percent // 100):
                    q[i] = text(1)[0]
                texts += [" ".join(text(30) + p + text(30)), " ".join(text(20) + q + text(40))]
                kinds.append((n, percent))
    hit = {x["doc_id"] // 2 for x in repeated_passages(documents(spark, texts)).collect()}
    got = {k: sum(i in hit for i, x in enumerate(kinds) if x == k) / 60 for k in set(kinds)}
    print(sorted(got.items()))
    assert all(v >= {10: 0.95, 15: 0.9, 20: 0.75}[k[1]] for k, v in got.items()), got


def test_every_verbatim_window_is_covered_as_brute_force_says(spark):
    r = random.Random(17)
    whole = [f"p{i}" for i in range(150)]
    line = [f"l{i}" for i in range(7)]
    texts = []
    for k in range(90):
        w = [f"d{k}x{i}" for i in range(r.randrange(0, 30))]
        for j in range(r.randrange(0, 5)):
            a = r.randrange(0, 140)
            piece = whole[a : a + r.choice([12, 25, 40, 49, 50, 51, 70])]
            w += r.choice([piece, piece, line * r.randrange(1, 12), []]) + [f"d{k}y{j}x{i}" for i in range(r.choice([0, 0, 1, 20]))]
        texts.append(w)
    rows = repeated_passages(documents(spark, [" ".join(w) for w in texts])).collect()
    by = {}
    for x in rows:
        by.setdefault(x["doc_id"], []).append(x)
        a, b = texts[x["doc_id"]][x["start_word"] : x["end_word"]], texts[x["partner_id"]][x["partner_start_word"] : x["partner_end_word"]]
        assert x["partner_id"] < x["doc_id"] and x["n_words"] == max(len(a), len(b)) >= 50 and 100 * x["n_equal"] >= 80 * x["n_words"]
        row = [0] * (len(b) + 1)  # as many words are equal in order as the row says, at least
        for u in a:
            last = 0
            for i, v in enumerate(b):
                last, row[i + 1] = row[i + 1], last + 1 if u == v else max(row[i + 1], row[i])
        assert row[-1] >= x["n_equal"]
    seen, missed, there = {}, [], 0
    for d, w in enumerate(texts):
        own = [tuple(w[i : i + 53]) for i in range(len(w) - 52)]
        for i, window in enumerate(own):
            if window in seen:
                there += 1
                # all of it, but for the words before the run's first seed and as many behind it
                if not any(x["start_word"] <= i + 3 and i + 50 <= x["end_word"] for x in by.get(d, [])):
                    missed.append((d, i))
        for window in own:
            seen.setdefault(window, d)
    assert there > 300 and not missed, (there, missed[:5])

import random

import numpy as np
from llm_docs import documents
from test_minhash import corpus, plain

from gleanspark.llm import minhash
from gleanspark.llm.outlines import Outlines, outline


def test_outlines_leave_no_alike_pair_out():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = []
    for n in (1, 2, 9, 10, 60, 63, 64, 65, 250, 300, 2000, 3000):
        for share in (0, 0.02, 0.08, 0.1, 0.12, 0.2, 0.5):
            own = r.integers(0, 1 << 63, round(share * n)).astype(np.uint64)
            sets.append(np.unique(np.concatenate([base[: n - len(own)], own])))
    sizes, told = np.array([len(s) for s in sets]), [outline(s) for s in sets]
    for percent in (30, 80, 95):
        found = [set(Outlines(sizes, told).near(int(n), t, percent).tolist()) for n, t in zip(sizes, told, strict=True)]
        both = [[len(np.intersect1d(a, b, assume_unique=True)) for b in sets] for a in sets]
        alike = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if 100 * both[i][j] >= percent * (sizes[i] + sizes[j] - both[i][j])}
        open_ = {(i, j) for i, f in enumerate(found) for j in f}
        assert alike <= open_
        if percent == 80:
            assert len(open_) < 1.2 * len(alike)


def test_documents_that_share_only_lines_get_no_second_look(spark, monkeypatch):
    r = random.Random(3)
    lines = [" ".join(f"common{k}x{i}" for i in range(14)) for k in range(4)]
    texts = []
    for i in range(160):
        own = " ".join(f"own{i}x{j}" for j in range(r.randrange(8, 30)))
        texts.append("\n".join([*r.sample(lines, r.randrange(1, 3)), own]))
    texts += [t + " more" for t in texts[:10]]
    looked = []
    second = minhash._second_look
    monkeypatch.setattr(minhash, "_second_look", lambda nodes, *a: looked.append(nodes.count()) or second(nodes, *a))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(documents(spark, texts), width=2).collect()}
    assert got == plain(texts, 2)
    assert sum(looked) < len(texts) / 4  # all of them are chained by their buckets


def test_small_packs_give_the_same(spark, monkeypatch):
    for k, v in (("FEW", 1500), ("MANY", 3000), ("FEW_BYTES", 200), ("MANY_BYTES", 400)):
        monkeypatch.setattr(minhash, k, v, raising=False)
    texts = corpus(5)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(documents(spark, texts), width=5).collect()}
    assert got == plain(texts, 5)


def test_texts_of_a_repeated_id_are_one_document(spark):
    for seed in (7, 8):
        texts = corpus(seed) + ["", " ", None]
        r = random.Random(seed)
        ids = [r.randrange(2 * len(texts) // 3) for _ in texts]
        up = {i: i for i in ids}

        def root(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for k, (_, first) in plain(texts, 5).items():
            x, y = sorted((root(ids[k]), root(ids[first])))
            up[y] = x
        rows = minhash.near_duplicates(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"), width=5).collect()
        assert sorted((x["doc_id"], x["component_id"], x["kept"]) for x in rows) == sorted((i, root(i), i == root(i)) for i in ids)

import random

import numpy as np
from llm_docs import documents
from pyspark.sql import functions as F

from gleanspark.llm.quality_model import classify, features, fit_logistic, site_rates, train, FEATURES


def labelled(spark, n=400):
    r = random.Random(6)
    words = [f"{a}{b}" for a in "the of and ti on er".split() for b in "ab cd ef gh ij kl mn".split()]
    texts, rows = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randrange(60, 200))]
        low, toxic = i % 5 == 0, i % 7 == 0
        if low:
            w = [x + "###" for x in w]
        if toxic:
            w[r.randrange(len(w))] = "nastyword"
        texts.append(" ".join(w).capitalize() + ".")
        rows.append((i, 0 if low else 1, 1 if toxic else 0))
    return documents(spark, texts, [r.choice(["a", "b", "c", None]) for _ in texts]), spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_is_high_and_clean_documents_stay(spark):
    docs, labels = labelled(spark)
    got = {x["doc_id"]: x["kept"] for x in classify(docs, labels.where("doc_id % 2 = 0")).collect()}
    assert len(got) == 400
    for i in range(1, 400, 2):
        assert got[i] == (i % 5 > 0 and i % 7 > 0)


def test_without_labels_all_is_kept_and_empty_tables_pass(spark):
    docs, labels = labelled(spark, 40)
    assert classify(docs, labels.limit(0)).where("not kept").count() == 0
    assert classify(docs, labels.withColumn("quality", F.lit(None).cast("int"))).where("not kept").count() == 0
    assert classify(docs.limit(0), labels).count() == 0


def test_training_is_bounded(spark):
    docs, labels = labelled(spark, 60)
    assert train(docs, labels, max_training=30).quality is not None


def test_features_of_any_text():
    for t in ("", " ", "x", "<p>a</p> http://x", "日本 " * 500, "\n" * 50):
        f = features(t)
        assert len(f) == len(FEATURES) and np.isfinite(f).all()


def test_logistic_separates():
    r = np.random.default_rng(1)
    x = np.c_[np.ones(300), r.normal(size=(300, 3))]
    y = (x @ [0.3, 2, -1, 0] > 0).astype(float)
    assert ((x @ fit_logistic(x, y) > 0) == y).mean() > 0.97


def test_sites_are_shrunk_by_their_size(spark):
    rows = [(f"h{k % 20}", "p", -4.0) for k in range(2000)] + [("bad", "p", 4.0)] * 100 + [("tiny", "p", 4.0)]
    got = {x["host"]: x["shift"] for x in site_rates(spark.createDataFrame(rows, "host string, path string, odds double"), "odds").collect()}
    assert got["bad"] > got["tiny"] > got["h0"] and got["bad"] > 3


def test_rare_toxic_words_are_learnt(spark):
    r = random.Random(11)
    words, bad = [f"w{i}" for i in range(400)], [f"nasty{i}" for i in range(60)]
    texts, rows = [], []
    for i in range(3000):
        w = [r.choice(words) for _ in range(80)]
        toxic = i % 5 == 0
        if toxic:
            for x in r.sample(bad, 2):
                w[r.randrange(80)] = x
        texts.append(" ".join(w))
        rows.append((i, 1, int(toxic)))
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["kept"] for x in classify(documents(spark, texts), labels.where("doc_id < 2400")).collect()}
    held = range(2400, 3000)
    assert sum(not got[i] for i in held if i % 5 == 0) > 110 and all(got[i] for i in held if i % 5)

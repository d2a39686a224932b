import random

from llm_docs import documents
from test_minhash import plain
from test_quality import labelled

import corpus_pipeline
from gleanspark.llm.pii import find


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    docs, labels = labelled(spark, 120)
    r = random.Random(2)
    kept = [x["text"] for x in docs.where("doc_id % 5 <> 0 and doc_id % 7 <> 0").orderBy("doc_id").collect()]
    texts = [x["text"] for x in docs.orderBy("doc_id").collect()] + kept[:6] + [kept[8] + " mail a@b.co now", kept[9] + " " + "new words here " * 40]
    all_docs = documents(spark, texts, [r.choice(["a", "b", None]) for _ in texts])
    all_docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert out.columns == all_docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = at.collect()
    good = [i for i in range(120) if i % 5 and i % 7]
    assert set(good) <= {x["doc_id"] for x in seen["quality"]} and not {0, 5, 7} & {x["doc_id"] for x in seen["quality"]}
    before = sorted((x["doc_id"], x["text"]) for x in seen["quality"])
    want = plain([t for _, t in before], 5)
    assert {x["doc_id"] for x in seen["near_dedup"]} == {before[i][0] for i, v in want.items() if v[1] == i}
    assert all(not any(find(x["text"])) for x in seen["personal_data"]) and len(seen["personal_data"]) == len(seen["near_dedup"])
    assert sorted(x["doc_id"] for x in seen["mixing"]) == sorted(x["doc_id"] for x in seen["personal_data"])
    assert {x["doc_id"] for x in seen["packing"]} == {x["doc_id"] for x in seen["mixing"]}
    # the mixed order decides the sequences' order
    place = {x["doc_id"]: k for k, x in enumerate(seen["mixing"])}
    per = {}
    for x in seen["packing"]:
        per.setdefault(x["sequence_id"], []).append((place[x["doc_id"]], x["piece"]))
    assert sorted(per) == list(range(len(per)))
    assert all(any(a < b for a in per[k] for b in per[k + 1]) for k in range(len(per) - 1))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_repeated_ids_leave_one_row(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 13)] * 3 + [(2, "other words in here now", "en", "s", 9), (None, "a b c d e f g", "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted((x["doc_id"] or 0) for x in got.collect()) == [0, 1, 2]

from llm_docs import documents

from gleanspark.llm.passages import repeated_passages


def test_a_changed_passage_is_found_whose_parts_others_hold_first(spark):
    w = [f"w{i}" for i in range(66)]
    own = lambda k: [f"d{k}x{i}" for i in range(30)]
    changed = lambda k, at: [f"c{k}y{i}" if i in at else x for i, x in enumerate(w)]
    parts = [own(k) + w[a : a + 20] + own(-k) for k, a in enumerate((0, 15, 30, 45, 60), 1)]
    holders = [own(k) + p + own(-k) for k, p in enumerate((changed(6, {12, 40}), changed(7, {22, 53}), changed(8, {12, 27, 47})), 6)]
    rows = repeated_passages(documents(spark, [" ".join(t) for t in [[], *parts, *holders]])).collect()
    assert {x["doc_id"] for x in rows} == {7, 8}
    for x in rows:
        assert x["partner_id"] in (6, 7) and x["n_words"] >= 60 and 100 * x["n_equal"] >= 80 * x["n_words"]

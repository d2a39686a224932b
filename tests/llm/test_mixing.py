import random

from llm_docs import documents

from gleanspark.llm.mixing import in_order, mixed, one_period, schedule, whole_weights


def test_no_deadline_is_missed_and_no_source_strays_by_a_block():
    for w in ({"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 1}, {"a": 97, "b": 2, "c": 1}, {f"s{i}": i + 1 for i in range(20)}):
        period, slots = sum(w.values()), one_period(w)
        assert sorted(t for s in slots.values() for t in s) == list(range(period))
        for s, at in slots.items():
            assert all(i * period // w[s] <= t < -(-(i + 1) * period // w[s]) for i, t in enumerate(at))
            for t in range(period + 1):
                assert abs(sum(x < t for x in at) - t * w[s] / period) < 1


def test_schedule_serves_every_block_once():
    blocks, w = {"a": 40, "b": 3, "c": 11}, {"a": 1, "b": 2, "c": 2}
    seen = []
    for s, _, first, until, base, p, q, slots in schedule(blocks, w):
        seen += [(base + (i // p) * q + slots[i % p], s) for i in range(until - first)]
    assert sorted(t for t, _ in seen) == list(range(54))
    assert {s: sum(x == s for _, x in seen) for s in blocks} == blocks


def test_whole_weights():
    assert whole_weights({"a": 2, "b": 4}) == {"a": 1, "b": 2}
    assert whole_weights({"a": 0.5, "b": 0.25, "c": 0.25}) == {"a": 2, "b": 1, "c": 1}


def test_mixing_keeps_all_rows_and_follows_the_weights(spark):
    r = random.Random(4)
    texts = ["x" * r.randrange(0, 300) for _ in range(600)] + [None, ""]
    sources = [r.choice("aaaabc") for _ in range(600)] + [None, "a"]
    docs = documents(spark, texts, sources)
    rows = in_order(mixed(docs, weights={"a": 1, "b": 1, "c": 2}, block_bytes=500)).collect()
    assert sorted(x["doc_id"] for x in rows) == list(range(602))
    assert [x["mix_slot"] for x in rows] == sorted(x["mix_slot"] for x in rows)
    by = {}
    for x in rows:
        assert x["mix_release"] <= x["mix_slot"] < x["mix_deadline"] or x["mix_phase"] > 0
        by.setdefault(x["mix_slot"], set()).add(x["mix_source"])
    assert all(len(s) == 1 for s in by.values())
    assert mixed(docs.limit(0)).count() == 0


def test_every_prefix_is_less_than_a_block_off_its_weights(spark):
    r = random.Random(6)
    weights = {"a": 5, "b": 3, "c": 1.5}
    texts, sources = ["y" * r.randrange(0, 120) for _ in range(900)], [r.choice("aaabbbcd") for _ in range(900)]
    rows = mixed(documents(spark, texts, sources), weights=weights, block_bytes=200).collect()
    seen = {(x["mix_slot"], x["mix_source"], x["mix_block"], x["mix_phase"]) for x in rows}
    n_blocks = {s: -(-sum(len(t) + 1 for t, v in zip(texts, sources, strict=True) if v == s) // 200) for s in "abcd"}
    # texts are shorter than a block, so a text begins in each block but, at times, a source's last one
    lacking = set(range(sum(n_blocks.values()))) - {x[0] for x in seen}
    assert len(seen) + len(lacking) == sum(n_blocks.values()) and len(lacking) <= 4
    whole = {s: weights.get(s, 1) for s in "abcd"}
    first = [x for x in sorted(seen) if x[3] == 0]
    count = dict.fromkeys("abcd", 0)
    for t, (slot, source, block, _) in enumerate(first):
        assert slot == t and block == count[source]
        count[source] += 1
        assert all(abs(count[s] - (t + 1) * whole[s] / sum(whole.values())) < 1 for s in "abcd")


def test_many_sources_share_a_group(spark):
    r = random.Random(7)
    sources = [f"s{r.randrange(40)}" for _ in range(1500)] + ["big"] * 200
    texts = ["z" * r.randrange(20, 90) for _ in sources]
    rows = mixed(documents(spark, texts, sources), weights={"big": 10, "s1": 4, "s2": 0.5}, block_bytes=100, single=3).collect()
    assert sorted(x["doc_id"] for x in rows) == list(range(len(texts)))
    by = {}
    for x in rows:
        by.setdefault(x["mix_slot"], set()).add((x["mix_source"], x["mix_block"]))
    n_blocks = {s: -(-sum(len(t) + 1 for t, v in zip(texts, sources, strict=True) if v == s) // 100) for s in set(sources)}
    assert all(len(v) == 1 for v in by.values()) and max(by) < sum(n_blocks.values())
    order = [next(iter(by[t])) for t in sorted(by)]
    for s in n_blocks:
        assert [b for v, b in order if v == s] in (list(range(n_blocks[s])), list(range(n_blocks[s] - 1)))
    # while all go on, the heavy ones keep their weight, and in the group sources go by their own deadlines
    total = 10 + 4 + 0.5 + 38
    assert abs(sum(v == "big" for v, _ in order[:100]) - 100 * 10 / total) < 1.1
    top = {x["mix_source"] for x in rows if x["mix_source"] in ("big", "s1")} | {max((s for s in n_blocks if s not in ("big", "s1", "s2")), key=lambda s: sum(len(t) + 1 for t, v in zip(texts, sources, strict=True) if v == s))}
    inner = [((b + 1) / (0.5 if v == "s2" else 1), v, b) for v, b in order if v not in top]
    assert inner == sorted(inner)


def test_clashing_names_repeated_keys_and_nulls(spark):
    rows = [(1, "a", "s", 5, "k"), (1, "a", "s", 6, "k"), (None, None, None, 7, "k"), (None, "b", None, 8, "k"), (2, "x", "t", 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size long, _mix_k0 string")
    out = mixed(docs)
    assert out.columns == ["doc_id", "text", "source", "mix_size", "_mix_k0", "mix_source", "mix_block", "mix_phase", "mix_release", "mix_deadline", "mix_slot"]
    got = out.collect()
    assert sorted((x["mix_size"], x["text"] or "", x["mix_source"]) for x in got) == [(5, "a", "s"), (6, "a", "s"), (7, "", ""), (8, "b", ""), (9, "x", "t")]

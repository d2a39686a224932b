import bisect
import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
import zlib
from llm_docs import documents
from tokenizers import Tokenizer

from gleanspark.llm.host_rules import host_rules, host_verdicts
from gleanspark.llm.packing import WordIds, best_fit, pack, sweep
from gleanspark.llm.packing import default_tokenizer as default_word_tokenizer
from gleanspark.llm.sharding import longest_first, shard
from gleanspark.llm.token_count import CountTransducer, default_tokenizer, token_counts


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts_equal_the_library(docs, empty, texts):
    t = Tokenizer.from_file(default_tokenizer())
    want = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    for size in (65_536, 1000, 17):
        got = by_id(token_counts(docs, chunk_chars=size))
        assert [got[i]["n_tokens"] for i in range(len(texts))] == want
        assert all(got[i]["n_bytes"] == len((x or "").encode()) and got[i]["over_limit"] == (want[i] > 512) for i, x in enumerate(texts))
    assert token_counts(empty).count() == 0


def test_transitions_add_up_to_the_library_s_counts():
    t, library = CountTransducer(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    rng = np.random.default_rng(8)
    words = [x.replace("\u0120", " ") for x in list(library.get_vocab())[::9]]
    odd = [chr(c) for c in (0x1c, 0x1f, 0x85, 0xA0, 0x200B, 0x2028, 0x3000, 0x660, 0x963, 0x1F600, 0xAD, 0x301, 0x2167, 0xB2)]
    texts = []
    for size in (1, 2, 4, 30, 400):
        for _ in range(300 if size < 400 else 30):
            texts.append("".join(rng.choice(words if rng.random() < 0.8 else odd) for _ in range(size)))
            texts.append("".join(map(chr, rng.integers(97, 101, size))))
            texts.append("".join(rng.choice([" ", "\n", "'", "'s", "a", "7", "=", "-", "\t"]) for _ in range(size)))
    texts += ["=" * 5000, " " * 5000, "a" * 5000, "ab" * 3000, "\n" * 77 + "x", "<|endoftext|>" * 3 + "y"]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = t.counts(texts)
    assert [(x, a, b) for x, a, b in zip(texts, got, want, strict=True) if a != b] == []
    assert 0 < len(t.about) < 100_000 and min(n for a in t.after for _, n in a.values()) < 0  # merges take back what was counted


def test_all_characters_have_the_library_s_classes():
    t, library = CountTransducer(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    texts = [chr(c) + "'m1" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 16 == 0 or 0xA000 <= c < 0xAC00 or 0xFA00 <= c < 0x13000)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [(x, a, b) for x, a, b in zip(texts, t.counts(texts), want, strict=True) if a != b] == []


def test_state_maps_compose_in_any_way(texts):
    t, library = CountTransducer(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    for x in texts[5:25]:
        x = x or ""
        whole = len(library.encode(x, add_special_tokens=False).ids)
        for size in (1, 2, 3, 7):
            maps = [t.state_map(x[k : k + size]) for k in range(0, max(1, len(x)), size)]
            assert t.total(maps) == whole
            m = maps[0]
            for n in maps[1:]:
                m = t.compose(m, n)
            assert t.total([m]) == whole


def test_measures_equal_plain_ones(docs, empty, texts):
    got = by_id(host_rules(docs))
    for i, x in enumerate(texts):
        x = x or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        hit = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)} if len(words) < 2000 else None
        lines = x.split("\n")
        dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", w)) and w in lines[:k] for k, w in enumerate(lines))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", x)), dup)
        if hit is not None:
            assert r["n_repeat_words"] == len(hit)
        assert r["base_failed"] == (len(words) < 50 or 100 * r["n_repeat_words"] > 50 * len(words))
        assert not (r["kept"] and r["base_failed"])
    assert host_rules(empty).count() == 0


def test_a_bad_host_falls_and_a_sparse_one_is_shrunk(spark):
    rows = [(f"good{h}", k % 20 == 0) for h in range(30) for k in range(40)] + [("bad", k % 20 != 0) for k in range(400)] + [("sparse", True)]
    v = {r["host"]: r for r in host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean"), max_rate=0.8).collect()}
    assert v["bad"]["host_rejected"] and not v["good0"]["host_rejected"]
    assert v["sparse"]["host_rate"] < 1 and abs(v["bad"]["host_rate"] - 0.95) < 0.01


def test_longest_first_is_the_plain_heap():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = sorted({int(x) for x in rng.integers(1, 60, 12)}, reverse=True)
        items = [(s, int(rng.integers(1, 90))) for s in sizes]
        load = [0] * 8
        want = []
        for s, n in items:
            got = [0] * 8
            for _ in range(n):
                i = min(range(8), key=lambda i: (load[i], i))
                load[i] += s
                got[i] += 1
            want.append(got)
        got = longest_first(items, 8)
        assert sorted(sum(s * g[i] for (s, _), g in zip(items, got, strict=True)) for i in range(8)) == sorted(load)
        assert [sum(g) for g in got] == [n for _, n in items]


def test_shards(docs, empty, texts):
    got = by_id(shard(docs))
    assert len(got) == len(texts)
    where, slots, loads = {}, {}, [0] * 8
    for i, x in enumerate(texts):
        r = got[i]
        raw = (x or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert where.setdefault(x, r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for x in texts:
        groups[x] = groups.get(x, 0) + len((x or "").encode()) + 1
    want = longest_first([(n, 1) for n in sorted(groups.values(), reverse=True)], 8)
    plain = [sum(n * w[i] for n, w in zip(sorted(groups.values(), reverse=True), want, strict=True)) for i in range(8)]
    assert sorted(plain) == sorted(loads)
    assert shard(empty).count() == 0


def plain_best_fit(lengths, cap):
    gaps = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, n)
        bisect.insort(gaps, (gaps.pop(k) if k < len(gaps) else cap) - n)
    return len(gaps)


def test_supersteps_need_as_few_sequences_as_plain_best_fit(spark):
    rng = np.random.default_rng(5)
    for lengths, cap in [(rng.integers(1, 51, 120), 50), (np.minimum(2048, rng.lognormal(6, 1, 6000).astype(int) + 1), 2048), (np.repeat([700, 90, 1], [900, 100, 500]), 2048), (np.array([3] * 40), 2)]:
        lengths = np.minimum(lengths, cap).tolist()
        items = spark.createDataFrame(list(enumerate(lengths)), "id long, length int")
        got = {r["id"]: r["bin"] for r in best_fit(items, cap).collect()}
        assert sorted(got) == list(range(len(lengths)))
        load = {}
        for i, b in got.items():
            load[b] = load.get(b, 0) + lengths[i]
        assert max(load.values()) <= cap
        assert len(load) <= plain_best_fit(lengths, cap) * 1.01 + 1


def test_a_sweep_gives_each_piece_the_smallest_gap_left(spark):
    r = np.random.default_rng(4)
    for _ in range(4):
        lengths, gaps = r.integers(33, 65, 25).tolist(), r.integers(20, 64, 25).tolist()
        items = spark.createDataFrame(list(enumerate(lengths)), "id long, length int")
        holes = spark.createDataFrame([(100 + i, g) for i, g in enumerate(gaps)], "bin long, gap int")
        rows = [x for x in sweep(items, holes, high=64, low=32, slots=9, chunks=int(r.integers(1, 4))).collect() if x["kind"] == 1]
        left, want = sorted(g for g in gaps if g > 32), []
        for n in sorted(lengths, reverse=True):
            k = bisect.bisect_left(left, n)
            want.append((n, left.pop(k) if k < len(left) else None))
        key = lambda x: (x[0], x[1] or 0)
        assert sorted(((x["size"], gaps[x["mate"] - 100] if x["mate"] is not None else None) for x in rows), key=key) == sorted(want, key=key)
        assert sorted(-x["level"] for x in rows if x["mate"] is None) == list(range(sum(b is None for _, b in want)))


def test_ids_are_the_library_s():
    words, rng = WordIds(default_word_tokenizer()), np.random.default_rng(3)
    texts = ["".join(rng.choice(list("aAzZ09'’-_.,!éÉßÿ÷ªºµÀİσΣς́ﬁ<|> €½²")) for _ in range(12)) for _ in range(8000)]
    want = words.library.encode_batch(texts, add_special_tokens=False)
    assert [t for t, got, w in zip(texts, words.ids(texts), want, strict=True) if got != np.array(w.ids, "<u4").tobytes()] == []


def test_ids_of_letters_with_marks():
    words, rng = WordIds(default_word_tokenizer()), np.random.default_rng(5)
    marks = [chr(c) for c in range(0x300, 0x370)]
    letters = [chr(c) for c in range(65, 91)] + list("thwyjaAÉß ")
    texts = ["".join(rng.choice(letters) + "".join(rng.choice(marks, rng.integers(0, 3))) for _ in range(6)) for _ in range(5000)]
    texts += [a + m for a in map(chr, range(65, 91)) for m in marks]
    want = words.library.encode_batch(texts, add_special_tokens=False)
    assert [t for t, got, w in zip(texts, words.ids(texts), want, strict=True) if got != np.array(w.ids, "<u4").tobytes()] == []


def test_many_short_pieces_fill_their_sequences(spark):
    rng = np.random.default_rng(6)
    for lengths in ([10] * 20_000, rng.integers(1, 65, 20_000).tolist(), [257] * 3000, (rng.integers(200, 300, 4000)).tolist()):
        items = spark.createDataFrame(list(enumerate(lengths)), "id long, length int").repartition(4)
        load = {}
        for r in best_fit(items, 2048).collect():
            load[r["bin"]] = load.get(r["bin"], 0) + lengths[r["id"]]
        assert max(load.values()) <= 2048 and sum(load.values()) == sum(lengths)
        assert len(load) <= plain_best_fit(lengths, 2048) * 1.01 + 1


def test_packing_is_whole_and_tight(docs, empty, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = pack(docs, capacity=128).collect()
    seqs, per = {}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        per.setdefault(r["doc_id"], []).append(r)
    for s in seqs.values():
        end = 0
        for at, n in sorted(s):
            assert at == end
            end += n
        assert end <= 128
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(per[i], key=lambda r: r["piece"])
        assert [r["length"] for r in mine] == [len(ids[a : a + 128]) for a in range(0, len(ids), 128)]
        assert all(r["start"] == 128 * r["piece"] and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)
    assert len(seqs) <= -(-sum(r["length"] for r in rows) // 128) * 1.05 + 1
    assert pack(empty).count() == 0
    # numbered in the order of the rows whose pieces opened the sequences
    rows = pack(docs.withColumn("at", 1000 - F.col("doc_id")), capacity=128, order_column="at").collect()
    number = {}
    for r in rows:
        number.setdefault(r["sequence_id"], []).append((1000 - r["doc_id"], r["piece"]))
    assert sorted(number) == list(range(len(seqs)))
    assert all(any(a <= b for a in number[k] for b in number[k + 1]) for k in range(len(seqs) - 1))


def test_verdicts_on_hosts_equal_plain_ones(spark):
    rng = np.random.default_rng(12)
    texts, sources = [], []
    for h in range(25):
        for _ in range(int(rng.integers(1, 60))):
            bad = rng.random() < (0.7 if h % 5 == 0 else 0.04)
            texts.append(" ".join(f"w{x}" for x in rng.integers(0, 10**6, 10 if bad else 80)))
            sources.append(f"h{h}" if h else None)
    got = by_id(host_rules(documents(spark, texts, sources)))
    host = {}
    for i, s in enumerate(sources):
        n, k = host.get(s or "", (0, 0))
        host[s or ""] = n + 1, k + got[i]["base_failed"]
    n = sum(a for a, _ in host.values())
    m = sum(k for _, k in host.values()) / n
    within = m * (1 - m)
    between = sum(a * (k / a) ** 2 for a, k in host.values()) - n * m * m - (len(host) - 1) * within
    spread = max(0.0, between) / max(1.0, n - sum(a * a for a, _ in host.values()) / n)
    strength = max(0.0, within / spread - 1)
    rejected = {h for h, (a, k) in host.items() if (k + m * strength) / (a + strength) > 0.25}
    assert 3 <= len(rejected) <= 8
    assert all(got[i]["kept"] == (not got[i]["base_failed"] and (s or "") not in rejected) for i, s in enumerate(sources))
    assert sum(not got[i]["base_failed"] and not got[i]["kept"] for i in range(len(texts))) > 10

import random
import re

from llm_docs import documents, odd_texts

from gleanspark.llm.components import components
from gleanspark.llm.minhash import near_duplicates


def plain(texts, width, percent=80):
    """n_shingles and component by brute force."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = odd_texts(seed)[:-1]
    for share in (0.005, 0.01, 0.03, 0.06):
        base = [r.choice(words) for _ in range(120)]
        for _ in range(25):
            out.append(" ".join(r.choice(words) if r.random() < share else w for w in base))
        out += out[-2:]
    base = [r.choice(words) for _ in range(100)]
    for _ in range(30):  # a chain: each a little further from the first
        base[r.randrange(100)] = r.choice(words)
        out.append(" ".join(base).upper())
    r.shuffle(out)
    return out


def test_components_equal_brute_force(spark):
    for width, seed in ((2, 1), (5, 2)):
        texts = corpus(seed)
        got = {x["doc_id"]: x for x in near_duplicates(documents(spark, texts), width=width).collect()}
        want = plain(texts, width)
        assert len(set(v[1] for v in want.values())) < len(texts) - 40
        for i in want:
            assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (*want[i], want[i][1] == i)


def test_rows_without_id_and_empty_tables(spark, empty):
    df = spark.createDataFrame([(None, "a b c"), (None, None), (3, "a b c"), (3, "a b c"), (4, "A b c")], "doc_id long, text string")
    got = sorted(((x["doc_id"] or -1, x["component_id"], x["kept"]) for x in near_duplicates(df, width=2).collect()), key=str)
    assert got == sorted([(-1, None, True), (-1, None, True), (3, 3, True), (3, 3, True), (4, 3, False)], key=str)
    assert near_duplicates(empty).count() == 0


def test_components_of_a_long_chain(spark):
    r = random.Random(1)
    ids = list(range(60))
    r.shuffle(ids)
    links = list(zip(ids, ids[1:], strict=False)) + [(100, 101), (101, 102), (7, 7)]
    got = {x["id"]: x["root"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100, 102: 100}

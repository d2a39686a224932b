import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, key string, mix_slot long, bytes string, length double"


def documents(spark, texts, sources=None):
    """Documents with these texts, and columns named like those that operators make."""
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], len(t or ""), i % 3, "x", i, None, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def odd_texts(seed=1):
    r = random.Random(seed)
    words = "the of and ti on er Café naïve 日本 x!! it's they'll 42 007 a.b@c.de 10.0.0.1 -- …".split()
    out = [None, "", " ", "\n\n", "one", "two words", "a\tb\x0bc\x0cd\re", "tail \n", "  lead", "a  b   c", "<|endoftext|> x <|endoftext|>", "x<|ENDOFTEXT|>y", "non break   wide", "odd\x1cchar \x1f", "İstanbul ΣΣ ß ﬁ", "é ́x", "\U0001f600 smile \U0001f600"]
    for _ in range(40):
        out.append(r.choice([" ", "\n", "  "]).join(r.choice(words) for _ in range(r.randrange(1, 200))))
    out += [out[-1], out[-1], out[-2], "same same same same same same", "l\nl\nl\n m\nl"]
    out.append(" ".join(r.choice(words) for _ in range(9000)))
    return out

"""Ids by parts of words are the library's, whatever of them is kept; each part goes to the library's merges once."""

import random

import numpy as np

from gleanspark.llm import packing
from gleanspark.llm.packing import WordIds, default_tokenizer

BITS = ["word", "Wort", "straße", "ẞ", "Äpfel", "don't", "x1.5", "...", "é", "İ", "K", "Å", "<|", "<|endoftext|>", "中文", "\U0001f600", "\xa0", "\x85", "\x1c", "Σ", "-", "#", "a" * 70]
GAPS = [" ", "\n", "\t", "\r\n", "", "", "\x0b", "  "]


def _texts(seed, n, bits):
    rng = random.Random(seed)
    return ["".join(rng.choice(bits) + rng.choice(GAPS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_part_ids_equal_library(monkeypatch):
    w = WordIds(default_tokenizer())
    assert w.by_word
    monkeypatch.setattr(packing, "KEPT_BYTES", 4000)
    for seed, bits in enumerate([BITS, BITS[:5] + BITS[6:8], BITS]):
        texts = _texts(seed, 300, bits)
        told = [np.array(e.ids, "<u4").tobytes() for e in w.library.encode_batch(texts, add_special_tokens=False)]
        assert [x for k in range(0, 300, 50) for x in w.ids(texts[k : k + 50])] == told


def test_parts_are_merged_once_and_long_ones_not_kept(monkeypatch):
    w = WordIds(default_tokenizer())
    asked = []

    class Counted:
        def __init__(self, model):
            self.model = model

        def tokenize(self, part):
            asked.append(part)
            return self.model.tokenize(part)

    class Library:
        model = Counted(w.library.model)

    w.library = Library()
    w.ids(["One word, two word. WORD! " + "b" * 70])
    w.ids(["word; one"])
    assert sorted(asked) == sorted(["one", "word", ",", "two", ".", "!", "b" * 70, ";"])
    monkeypatch.setattr(packing, "KEPT_BYTES", 0)
    w.ids(["word. two? One"])
    assert asked.count("word") == asked.count("two") == asked.count("one") == 1
    assert "b" * 70 not in w.known and w.size == sum(200 + len(x) for x in w.known)

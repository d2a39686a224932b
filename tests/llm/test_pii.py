import hashlib
import random
import re
import time

from llm_docs import documents

from gleanspark.llm.pii import detect, find, mask, masked, personal_data, rewrite

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def test_detectors_equal_the_patterns():
    r = random.Random(2)
    alphabet = ["a", "b.", "@", "a@b.co", "@@", ".", "-", "+", "(", ")", " ", "1", "23", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", "10.0.0.1", "0010.1.1.1", "é", "\n", "+1 (555) 123-4567", "_", "%"]
    for _ in range(20_000):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(1, 14)))
        assert detect(t) == plain(t), t


def test_disguises_map_back_to_their_source():
    for text, kind, piece in (
        ("mail jane [at] example [dot] com now", "email", "jane [at] example [dot] com"),
        ("mail jane at example dot com now", "email", "jane at example dot com"),
        ("mail jane(at)example.com now", "email", "jane(at)example.com"),
        ("mail jаne@exаmple.com now", "email", "jаne@exаmple.com"),
        ("host １０.０.０.１ up", "ip", "１０.０.０.１"),
        ("host one nine two dot one six eight dot one dot seven up", "ip", "one nine two dot one six eight dot one dot seven"),
        ("pay four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
        ("call plus four four two zero seven nine four six zero nine five eight ok", "phone", "plus four four two zero seven nine four six zero nine five eight"),
        ("card 4111​1111​1111​1111 ok", "card", "4111​1111​1111​1111"),
    ):
        base, added = find(text)
        assert [(k, text[a:b]) for k, a, b in added] == [(kind, piece)], (text, base, added)
    assert find("meet at noon, dot your eyes, one two three") == ([], [])


def test_rewriting_keeps_places():
    text = "x jаne [at] ex dot com ７ ​end"
    plain_text, begin, end = rewrite(text)
    assert len(plain_text) == len(begin) == len(end)
    assert all(a < b for a, b in zip(begin, end, strict=True)) and begin == sorted(begin)


def test_query_rows_and_masks(spark):
    texts = [None, "", "a@b.co and 10.0.0.1, +1 555 123 4567", "x" * 300_000 + "@", "1" * 100_000, "." * 1000, "a.b@c-d.ef " * 3]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in personal_data(docs).collect()}
    for i, t in enumerate(texts):
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in (detect(t) if t else []))
        assert got[i]["spans"] == want and got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert (got[2]["n_email"], got[2]["n_ip"], got[2]["n_card"], got[2]["n_phone"]) == (1, 1, 0, 1)
    out = {r["doc_id"]: r["text"] for r in masked(docs).collect()}
    assert out[2] == "<EMAIL> and <IP>, <PHONE>" and out[0] is None
    assert masked(docs).columns == docs.columns
    assert mask("abcdef", [("card", 1, 4), ("phone", 3, 5)]) == "a<CARD>f"
    assert personal_data(docs.limit(0)).count() == 0


def test_a_plain_fragment_does_not_hide_the_disguised_whole():
    for text, kind in (("jаne@example.com", "email"), ("jane@example.cоm", "email"), ("+44 20 7946 ００００", "phone")):
        base, added = find(text)
        assert len(base) == 1 and added == [(kind, 0, len(text))], (text, base, added)
        assert mask(text, base + added) == f"<{kind.upper()}>"


def test_few_spelled_digits_are_rewritten():
    for text, kind in (("4111 1111 1111 1 one one one", "card"), ("+1 four 1 five 5 five 0 one 2 three 4", "phone")):
        assert find(text) == ([], [(kind, 0, len(text))]), text


def test_whatever_rewriting_reveals_is_found():
    r = random.Random(8)
    alphabet = ["one", "SIX", "ſix", "oh", "tone", " ", " ", "-", " dot ", "Point", "[", "(", " at ", "]", ")", "a", "7", "é", "о", "\u00ad", "plus ", "７", "\n", "@", "_at_", "[.]", "4111 1111 1111 111", "+1 555 123"]
    for _ in range(20_000):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(1, 12)))
        plain_text, begin, end = rewrite(t)
        base, added = find(t)
        assert base == detect(t)
        for kind, a, b in detect(plain_text):
            span = (kind, begin[a], end[b - 1])
            assert span in added or any(k == kind and x <= span[1] and span[2] <= y for k, x, y in base), t


def test_disguises_of_one_sign_or_digit_only():
    for text, kind, piece in (
        ("call +1 555 one 23 4567 ok", "phone", "+1 555 one 23 4567"),
        ("card 4111 1111 1111 111one", "card", "4111 1111 1111 111one"),
        ("to jane_at_example_dot_com", "email", "jane_at_example_dot_com"),
        ("to jane @ example . com now", "email", "jane @ example . com"),
        ("to jane@exampⅼe.com", "email", "jane@exampⅼe.com"),
        ("to jane -at- mail -dot- example -dot- org.", "email", "jane -at- mail -dot- example -dot- org"),
        ("to jane@example dot com", "email", "jane@example dot com"),
        ("host 10[.]0[.]0[.]1", "ip", "10[.]0[.]0[.]1"),
        ("pay 4111\u00a01111\u20091111–1111", "card", "4111\u00a01111\u20091111–1111"),
    ):
        base, added = find(text)
        assert [(k, text[a:b]) for k, a, b in added] == [(kind, piece)], (text, base, added)
    for text in ("we met at noon. at example.com we", "look at example.com now", "photo_at_night.jpg", "x@y and at a dot", "two plus one dot two", "(at) home [dot]"):
        assert find(text) == ([], []), (text, find(text))


def test_long_texts_take_time_in_proportion():
    for piece in ("x dot" + " " * 999_990 + "y", "at dot " * 150_000, "x-at-" * 200_000, "[ " * 500_000, "a at b." * 150_000, "@ " * 500_000, "one, " * 200_000, "a_at_" * 200_000, "o\u00ad" * 400_000):
        start = time.process_time()
        find(piece)
        whole = time.process_time() - start
        start = time.process_time()
        find(piece[: len(piece) // 8])
        assert whole < 24 * (time.process_time() - start) + 0.5, piece[:10]

"""Token counts by a compiled finite-state transducer.

The merges of a byte-level BPE tokenizer are compiled into a deterministic transducer over bytes. A state says how far
the bytes read reach into the tokens (the longest suffix that begins one) and which token would end at each place
there; a transition adds the difference that its byte makes to the number of tokens, which may be negative where bytes
merge. This is exact, as a sequence of tokens is what the merges give if each two neighbours are what the merges give
for these two alone. States are made when they are first reached, so that only those that texts lead to exist.

A text longer than `chunk_chars` is cut into chunks that are counted apart, on any executor. White space that follows
anything else always begins a new word of the tokenizer: there the transducer starts anew whatever came before. A
chunk's state map is (what precedes its first such place, tokens between, what follows its last one): all that the
chunk does to any state that enters it. Maps compose associatively; a text's chunks are composed by a scan of pairs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import parcels, prepared, text_of

MAX_TOKENS = 512
CHUNK_CHARS = 65_536
#: Bounds on a worker's memory, not on what is counted: states, and bytes of words (with the space before them) whose
#: counts are kept, and as many of those met before that.
KEPT_STATES = 120_000
KEPT_BYTES = 40 << 20
KEPT_WORD_CHARS = 64

# What the tokenizer takes for white space, and its pattern of words (fixed values).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _words(letters: str, numbers: str) -> regex.Pattern:
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{_SPACE}{letters}{numbers}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


_ASCII_WORDS = _words("A-Za-z", "0-9")
_SYNC = re.compile(rf"(?<=[^{_SPACE}])[{_SPACE}]")
#: What lies between two places where the transducer starts anew.
_UNITS = re.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_TWO_SPACES = re.compile(rf"[{_SPACE}][{_SPACE}]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _byte_of() -> dict[str, int]:
    """The byte that a character of the vocabulary stands for: printable ones themselves, the others by 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def character_classes() -> tuple[str, str]:
    """What the library takes for letters and for numbers, as ranges of a pattern: its tables may be of another Unicode version than others'."""
    from tokenizers import Regex, pre_tokenizers

    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every, out = "".join(map(chr, points)), []
    for kind in "LN":
        # the places of all other characters; what lies between them are runs of the class, cut where the surrogates are
        others = [at for _, at in pre_tokenizers.Split(Regex(rf"\p{{{kind}}}+"), "removed").pre_tokenize_str(every)]
        ends = [(a[1], b[0]) for a, b in zip([(0, 0), *others], [*others, (len(points), 0)], strict=True) if a[1] < b[0]]
        cut = [x for a, b in ends for x in ([(a, b)] if not a < 0xD800 < b else [(a, 0xD800), (0xD800, b)])]
        out.append("".join(f"\\U{points[a]:08x}-\\U{points[b - 1]:08x}" for a, b in cut))
    return out[0], out[1]


class CountTransducer:
    """Counts tokens as the library does for a byte-level BPE tokenizer without normalizer."""

    def __init__(self, path: str, classes: tuple[str, str] | None = None) -> None:
        self.words = _words(*(classes or character_classes()))
        told = json.loads(Path(path).read_text())
        model, pre = told["model"], told["pre_tokenizer"] or {}
        if told["normalizer"] or model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level BPE without normalizer and prefix space is compiled")
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("a model option is not supported")
        of = _byte_of()
        raw = lambda token: bytes(of[c] for c in token)
        self.special = [t["content"] for t in told["added_tokens"]]
        if any(_SYNC.search(f"x{s}") or t["lstrip"] or t["rstrip"] or t["single_word"] for s, t in zip(self.special, told["added_tokens"], strict=True)):
            raise ValueError("a special string with white space or conditions can't be cut out")
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.tokens = {raw(t) for t in model["vocab"] if t not in self.special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        #: by token its merge: rank, left part, right part
        self.made = {a + b: (k, a, b) for (a, b), k in self.rank.items()}
        self.prefixes = {t[:k] for t in self.tokens for k in range(1, len(t) + 1)}
        self.own: dict[bytes, bool] = {}
        self.known: dict[str, int] = {}
        self.before: dict[str, int] = {}
        self.size = 0
        self._clear()

    def _clear(self) -> None:
        """Only the start state: nothing read, no token ends there, no tokens counted."""
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.ends: dict[bytes, tuple[int, list[bytes]]] = {}
        start = (b"", (b"",), (0,))
        self.states = {start: 0}
        self.about = [start]
        self.after: list[dict[int, tuple[int, int]]] = [{}]

    def merged(self, raw: bytes) -> list[bytes]:
        """The tokens that the merges make of a few bytes."""
        parts = [raw[k : k + 1] for k in range(len(raw))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), len(self.rank)))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _fit(self, a: bytes, b: bytes) -> bool:
        """Whether the merges of a + b never cross from a to b, for two tokens that the merges make of their bytes.

        Seen backwards in time: what stands on both sides of the border is taken apart, the later merge first. A merge of
        both sides prevents it if its rank comes before the one that took a side away (equal ranks go from the left).
        """
        found = self.fits.get((a, b))
        if found is not None:
            return found
        x, y, limit = a, b, len(self.rank)
        byte = (-1, b"", b"")
        while (rank := self.rank.get((x, y))) is None or rank >= limit:
            of_x, of_y = self.made.get(x, byte), self.made.get(y, byte)
            if of_x[0] < 0 and of_y[0] < 0:
                self.fits[a, b] = True
                return True
            if of_x[0] > of_y[0]:
                limit, x = of_x[0], of_x[2]
            else:
                limit, y = of_y[0] + 1, of_y[1]
        self.fits[a, b] = False
        return False

    def _reach(self, grown: bytes) -> tuple[int, list[bytes]]:
        """How many last bytes begin a token, and the tokens that end here, longest first."""
        reach = len(grown)
        while reach and grown[-reach:] not in self.prefixes:
            reach -= 1
        ends = []
        for n in range(reach, 0, -1):
            if (token := grown[-n:]) in self.tokens:
                if token not in self.own:
                    self.own[token] = self.merged(token) == [token]
                if self.own[token]:
                    ends.append(token)
        self.ends[grown] = reach, ends
        return reach, ends

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state by a byte: the next state, and the tokens it adds."""
        suffix, last, count = self.about[state]
        grown = suffix + bytes([byte])
        reach, ends = self.ends.get(grown) or self._reach(grown)
        # last[k] ends, and count[k] tokens (compared with now) stand, before the k-th byte of the suffix
        for token in ends:
            before = last[len(grown) - len(token)]
            if not before or self._fit(before, token):
                break
        else:
            raise ValueError(f"no token for byte {byte}")
        now = count[len(grown) - len(token)] + 1
        at = len(grown) - reach
        new = (grown[at:], (*last[at:], token), (*[c - now for c in count[at:]], 0))
        to = self.states.get(new)
        if to is None:
            to = self.states[new] = len(self.about)
            self.about.append(new)
            self.after.append({})
        self.after[state][byte] = (to, now)
        return to, now

    def walk(self, word: str) -> int:
        """Tokens of one word of the tokenizer."""
        if len(self.about) > KEPT_STATES:
            self._clear()
        state = n = 0
        after = self.after
        for byte in word.encode("utf-8", "replace"):
            step = after[state].get(byte)
            state, more = step if step is not None else self._compile(state, byte)
            n += more
        return n

    def _unit(self, unit: str) -> int:
        n = self.before.get(unit, -1)
        if n < 0:
            n = sum(map(self.walk, (_ASCII_WORDS if unit.isascii() else self.words).findall(unit)))
        if len(unit) <= KEPT_WORD_CHARS:
            self.known[unit] = n
            self.size += 150 + len(unit)
        return n

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings: its units are counted apart."""
        if _TWO_SPACES.search(text):
            units = _UNITS.findall(text)
        else:
            first, *rest = text.split(" ")
            units = [" " + x for x in rest]
            if first:
                units.append(first)
        known = self.known
        try:
            return sum(map(known.__getitem__, units))
        except KeyError:
            return sum(known[u] if u in known else self._unit(u) for u in units)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a special string is one token."""
        if self.size > KEPT_BYTES:
            self.before, self.known, self.size = self.known, {}, 0
        out = []
        for t in texts:
            if self.cut and any(s in t for s in self.special):
                parts = self.cut.split(t)
                out.append(len(parts) - 1 + sum(map(self._plain, parts)))
            else:
                out.append(self._plain(t))
        return out

    def state_map(self, chunk: str) -> tuple[str, int, str | None]:
        """(head, tokens between, tail); tail None if no place synchronises and the head is all."""
        # the special strings hold no white space (checked when compiled), so no synchronising place is inside one
        first = _SYNC.search(chunk)
        if not first:
            return chunk, 0, None
        begin = first.start()
        last = begin
        for m in _SYNC.finditer(chunk, max(begin, len(chunk) - 4096)):
            last = m.start()
        if last == begin and len(chunk) - begin > 4096:
            for m in _SYNC.finditer(chunk, begin):
                last = m.start()
        return chunk[:begin], self.counts([chunk[begin:last]])[0] if last > begin else 0, chunk[last:]

    def compose(self, a: tuple[str, int, str | None], b: tuple[str, int, str | None]) -> tuple[str, int, str | None]:
        """The map of a's chunk followed by b's."""
        if a[2] is None and b[2] is None:
            return self._resync(a[0] + b[0])
        if a[2] is None:
            x = self._resync(a[0] + b[0])
            return (x[0], b[1], b[2]) if x[2] is None else (x[0], x[1] + self.counts([x[2]])[0] + b[1], b[2])
        if b[2] is None:
            x = self._resync(a[2] + b[0], started=True)
            return a[0], a[1] + x[1], x[2]
        return a[0], a[1] + self.counts([a[2] + b[0]])[0] + b[1], b[2]

    def _resync(self, text: str, started: bool = False) -> tuple[str, int, str | None]:
        """The map of joined fragments; started: their first character is a synchronising place."""
        if not started:
            return self.state_map(text)
        cut = [m.start() for m in _SYNC.finditer(text)]
        return ("", self.counts([text[: cut[-1]]])[0], text[cut[-1] :]) if cut else ("", 0, text)

    def total(self, maps: list[tuple[str, int, str | None]]) -> int:
        """Scan the maps of a text's chunks, pair by pair, and close both ends."""
        maps = list(maps)
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        head, n, tail = maps[0]
        return sum(self.counts([head, tail or ""])) + n


@lru_cache(maxsize=2)
def transducer(path: str, classes: tuple[str, str]) -> CountTransducer:
    return CountTransducer(path, classes)


def token_counts(docs: DataFrame, *, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, chunk_chars: int = CHUNK_CHARS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    Null and empty texts have 0 bytes and 0 tokens; texts of any length are counted whole; repeated rows and null ids are
    counted row by row; other columns are not looked at; an empty table gives no rows. tokenizer: path of a byte-level
    BPE file that the executors can read too.
    """
    prepared(docs.sparkSession)
    path, classes = tokenizer or default_tokenizer(), character_classes()
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(docs, text_column).alias("text"))
    size = F.octet_length("text").cast("long")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path, classes)
        for b in batches:
            n = list(chain.from_iterable(map(t.counts, parcels(b.column(1)))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in enumerate(b.column(3)):
                t = x.as_py()
                n = -(-len(t) // chunk_chars)
                for a in range(0, n, 16):
                    k = range(a, min(n, a + 16))
                    at = pa.array([i] * len(k), pa.int64())
                    chunks = pa.array([t[j * chunk_chars : (j + 1) * chunk_chars] for j in k], pa.string())
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in range(3)), pa.array(k, pa.int32()), chunks], names=["row", "doc_id", "n_bytes", "k", "chunk"])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path, classes)
        for b in batches:
            m = [t.state_map(x.as_py()) for x in b.column(4)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array([x[0] for x in m], pa.string()), pa.array([x[1] for x in m], pa.int64()), pa.array([x[2] for x in m], pa.string())],
                names=["row", "doc_id", "n_bytes", "k", "head", "n", "tail"],
            )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path, classes)
        for b in batches:
            n = [t.total([(x["head"], x["n"], x["tail"]) for x in sorted(row, key=lambda x: x["k"])]) for row in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    out = "doc_id long, n_bytes long, n_tokens long"
    small = rows.where(F.char_length("text") <= chunk_chars).select("doc_id", "text", size.alias("n_bytes")).mapInArrow(short, out)
    # chunks of long texts go to as many tasks as there are; their maps are small and meet again by row
    whole = rows.where(F.char_length("text") > chunk_chars).select(F.monotonically_increasing_id().alias("row"), "doc_id", size.alias("n_bytes"), "text")
    chunks = whole.mapInArrow(cut, "row long, doc_id long, n_bytes long, k int, chunk string").repartition("row", "k")
    mapped = chunks.mapInArrow(maps, "row long, doc_id long, n_bytes long, k int, head string, n long, tail string")
    long = mapped.groupBy("row", "doc_id", "n_bytes").agg(F.collect_list(F.struct("k", "head", "n", "tail")).alias("maps")).select("doc_id", "n_bytes", "maps").mapInArrow(scan, out)
    return small.unionByName(long).withColumn("over_limit", F.col("n_tokens") > max_tokens)

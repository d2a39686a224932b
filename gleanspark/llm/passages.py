"""Passages that repeat across documents, also where a few words differ.

Seeds are five-word shingles at each of their places: of any four in a row the smallest one (a minimizer), so every
eight words that two documents share hold a seed of both. A seed that several documents hold is matched with the first
place in the first of them (smallest id) only, never in pairs. For each document and partner, matches that ascend in
both are chained, gaps at a cost, by a Fenwick tree; chains are then aligned word by word, and those of enough aligned
words are passages.

First holders can differ along a passage, so that no partner's chain covers it. Therefore, where all seeds of a
stretch of words are shared but no passage found covers them, runs of min_words that begin with a seed are matched with
the run's own first holder, and these matches are aligned too. As a seed is at most three words away, each verbatim
passage of min_words + 3 has a row for all but three words at its ends; shorter ones have one if some first holder of
their seeds holds them.

Passages that aren't verbatim have no such runs. Where seeds of different first holders stand near each other (a
patchwork), pairs of them are keys as well: a document that holds only a part doesn't hold the pair, so that its first
holder is one that goes on with the passage. Places of pairs that no passage covers are matched and aligned like runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.llm.common import few_rows_a_batch, materialize, parcels, prepared, text_of
from gleanspark.llm.shingles import Words, scrambled

SEED_WORDS = 5
MIN_WORDS = 50
MIN_PERCENT = 80
MAX_GAP = 64
#: Bytes looked at beyond a chain's seeds at first; where an alignment goes on to their end, MORE times as many.
MARGIN = 640
MORE = 8
BROADCAST_IDS = 1_000_000
PART_BYTES = 64 << 20
#: A bucket of places stands for so many bytes of text at least.
BUCKET_BYTES = 256 << 10
#: Of so many seeds in a row the smallest one is kept.
WINDOW = 4
#: A chain is aligned if it has two seeds and spans so many words, or if a seed of it repeats nearby.
LEAST_SPAN = 10
#: Of seeds in one unbroken row, one for so many words goes into a chain, besides the ends.
EVERY = 32
#: A number with so many places in one chunk of seeds is matched there, and only its first place is sent on.
HOT = 16
#: Each seed of a patchwork makes keys with so many seeds of other first holders, those of the smallest numbers in reach.
PAIRED = 2


def minima(x: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest number of each window (the last of equal ones), each once; shorter arrays are one window."""
    n = len(x)
    if n <= width:
        return np.array([n - 1 - int(np.argmin(x[::-1]))] if n else [], np.int64)
    view = np.lib.stride_tricks.sliding_window_view(x, width)
    return np.unique(np.arange(n - width + 1) + width - 1 - view[:, ::-1].argmin(1))


def all_minima(x: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """`minima` of WINDOW numbers for each text, whose n numbers begin at `first`; ascending."""
    picked = np.zeros(len(x), bool)
    if len(x) >= WINDOW:
        m = len(x) - WINDOW + 1
        least = x[:m]
        for k in range(1, WINDOW):
            least = np.minimum(least, x[k : k + m])
        # windows within one text, until their place is found
        edge = np.zeros(len(x) + 1, np.int8)
        long = n >= WINDOW
        np.add.at(edge, first[long], 1)
        np.add.at(edge, first[long] + n[long] - WINDOW + 1, -1)
        within = np.cumsum(edge[:m], dtype=np.int8).view(bool)
        for k in reversed(range(WINDOW)):
            here = within & (x[k : k + m] == least)
            picked[k : k + m] |= here
            within = within & ~here
    for k in np.flatnonzero((n > 0) & (n < WINDOW)).tolist():
        picked[first[k] + minima(x[first[k] : first[k] + n[k]], WINDOW)] = True
    return np.flatnonzero(picked)


def seeds_of(texts: list[bytes], run: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Words]:
    """All seeds of all texts: number of the run of words that begins there (0 if it crosses the text's end), text, word, byte."""
    w = Words(texts)
    seeds = w.runs(SEED_WORDS)
    i = all_minima(seeds, w.first, w.n_words - SEED_WORDS + 1)
    of = np.repeat(np.arange(len(texts)), w.n_words)[i]
    word = i - w.first[of]
    number = seeds if run == SEED_WORDS else w.runs(run)
    whole = word + run <= w.n_words[of]
    out = np.zeros(len(i), np.int64)
    out[whole] = number[i[whole]].view(np.int64)
    return out, of, word, w.begin[i] - w.at[of], w


#: Columns of packed places (number, document, word, byte, whether a match is wanted) and of packed matches (document, partner, words, bytes).
_PLACE = (np.int64, np.int64, np.int32, np.int32, np.int8)
_MATCH = (np.int64, np.int64, np.int32, np.int32, np.int32, np.int32)
_CHUNK = 1_000_000
_COLUMNS = tuple(f"c{k}" for k in range(max(len(_PLACE), len(_MATCH))))
_SCHEMA = "kind int, bucket int, " + ", ".join(f"{c} binary" for c in _COLUMNS)


def _packed(kind: int, bucket: np.ndarray, cols: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each bucket: the columns' numbers, in order, as the bytes of their differences, first bytes first (so they compress)."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    raw: list[list[bytes | None]] = [[] for _ in _COLUMNS]
    ends = [*edge[1:].tolist(), len(bucket)]
    for x, to in zip(cols, raw, strict=False):
        x = x[order]
        for i, j in zip(edge.tolist(), ends, strict=False):
            d = np.diff(x[i:j], prepend=x.dtype.type(0))
            to.append(d.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())
    for to in raw[len(cols) :]:
        to.extend([None] * len(edge))
    at = bucket[edge].astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), *(pa.array(x, pa.binary()) for x in raw)], names=["kind", "bucket", *_COLUMNS])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Places and matches."""
    kinds = (_PLACE, _MATCH)
    parts: tuple[list[list[np.ndarray]], ...] = tuple([[np.zeros(0, t)] for t in kind] for kind in kinds)
    for b in batches:
        of = b.column(0).to_pylist()
        for c in range(len(_COLUMNS)):
            for kind, raw in zip(of, b.column(c + 2), strict=True):
                if c < len(kinds[kind]):
                    t = kinds[kind][c]
                    d = np.frombuffer(raw.as_buffer(), np.uint8).reshape(np.dtype(t).itemsize, -1).T
                    parts[kind][c].append(np.cumsum(np.ascontiguousarray(d).view(t).ravel(), dtype=t))
    return tuple([np.concatenate(p) for p in part] for part in parts)


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return (scrambled(x.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _with_first(places: list[np.ndarray]) -> list[np.ndarray]:
    """_MATCH columns of all wanted places of numbers that several documents hold, the first one's own among them."""
    order = np.lexsort((places[2], places[1], places[0]))
    number, doc, word, at, wanted = (x[order] for x in places)
    edge = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(number)))
    shared = np.repeat(doc[edge] != doc[edge + size - 1], size) & (wanted > 0)
    first = np.repeat(edge, size)[shared]
    return [doc[shared], doc[first], word[shared], word[first], at[shared], at[first]]


def _hot(places: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Places to be sent on, and matches of the others: those of numbers that are frequent here, with their first holder here."""
    _, back, size = np.unique(places[0], return_inverse=True, return_counts=True)
    often = size[back] >= HOT
    if not often.any():
        return places, [np.zeros(0, t) for t in _MATCH]
    hot = [x[often] for x in places]
    order = np.lexsort((hot[2], hot[1], hot[0]))
    hot = [x[order] for x in hot]
    # of a document that holds the number first here all places go on
    edge = np.flatnonzero(np.concatenate([[True], hot[0][1:] != hot[0][:-1]]))
    first = np.repeat(hot[1][edge], np.diff(np.append(edge, len(hot[0]))))
    on = hot[1] == first
    return [np.concatenate([x[~often], y[on]]) for x, y in zip(places, hot, strict=True)], _with_first(hot)


def _stretches(match: list[np.ndarray], least: int) -> tuple[np.ndarray, ...]:
    """document, first and end word, whether it holds all seeds first: stretches of at least so many words with shared seeds only."""
    order = np.lexsort((match[2], match[0]))
    doc, partner, word = (match[k][order] for k in (0, 1, 2))
    if not len(doc):
        return doc, word, word, doc.astype(bool)
    begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] - word[:-1] > WINDOW)]))
    end = np.append(begin[1:], len(doc)) - 1
    own = np.logical_and.reduceat(doc == partner, begin)
    s, e = word[begin], word[end] + SEED_WORDS
    long = e - s >= least
    return doc[begin][long], s[long], e[long], own[long]


def _patchworks(match: list[np.ndarray], least: int) -> Iterator[tuple[int, int, int, list[int], list[int]]]:
    """document, first and end word, and first and last seeds of segments: seeds near each other whose first holders change.

    A segment's seeds have one first holder, in whose text they stand near each other too.
    """
    order = np.lexsort((match[2], match[0]))
    doc, partner, word, p_word = (match[k][order] for k in range(4))
    if not len(doc):
        return
    apart = (doc[1:] != doc[:-1]) | (word[1:] - word[:-1] > MAX_GAP)
    turn = apart | (partner[1:] != partner[:-1]) | (np.abs(p_word[1:] - word[1:] - (p_word[:-1] - word[:-1])) > MAX_GAP)
    begin = np.flatnonzero(np.concatenate([[True], turn]))
    end = np.append(begin[1:], len(doc)) - 1
    whole = np.flatnonzero(np.concatenate([[True], apart])[begin])
    for i, j in zip(whole.tolist(), [*whole[1:].tolist(), len(begin)], strict=True):
        s, e = int(word[begin[i]]), int(word[end[j - 1]]) + SEED_WORDS
        if j - i > 1 and e - s >= least:
            yield int(doc[begin[i]]), s, e, word[begin[i:j]].tolist(), word[end[i:j]].tolist()


def seed_pairs(number: np.ndarray, word: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of seeds that are keys: at most MAX_GAP words apart, in different segments.

    Of the seeds in reach those of the PAIRED smallest numbers are taken, so that texts that differ in some take the same others.
    """
    n = len(word)
    rank = scrambled(number.view(np.uint64))
    most = np.iinfo(np.uint64).max
    best, at = np.full((PAIRED, n), most, np.uint64), np.full((PAIRED, n), -1)
    for d in range(1, n):
        near = word[d:] - word[:-d] <= MAX_GAP
        if not near.any():
            break
        x = np.where(near & (segment[d:] != segment[:-d]), rank[d:], most)
        y = np.arange(d, n)
        for k in range(PAIRED):
            less = x < best[k, : n - d]
            best[k, : n - d], x = np.where(less, x, best[k, : n - d]), np.where(less, best[k, : n - d], x)
            at[k, : n - d], y = np.where(less, y, at[k, : n - d]), np.where(less, at[k, : n - d], y)
    i = np.tile(np.arange(n), PAIRED)
    j = at.ravel()
    return i[j >= 0], j[j >= 0]


#: More than any number of words in a text.
_APART = 1 << 32


def _inside(of: np.ndarray, word: np.ndarray, patches: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the seeds (text, word; ascending) in segments of the texts' patches, with numbers of the segments and patches."""
    each = pc.list_flatten(patches)
    starts, ends = (pc.struct_field(each, name) for name in ("starts", "ends"))
    text = pc.list_parent_indices(patches).to_numpy().astype(np.int64) * _APART
    patch = pc.list_parent_indices(starts).to_numpy().astype(np.int64)
    start, end = (pc.list_flatten(x).to_numpy().astype(np.int64) for x in (starts, ends))
    edge = np.searchsorted(patch, np.arange(len(each) + 1))
    place = of * _APART + word
    first, last = np.searchsorted(place, text + start[edge[:-1]]), np.searchsorted(place, text + end[edge[1:] - 1], "right")
    n = last - first
    i = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    mine = np.repeat(np.arange(len(each)), n)
    segment = np.searchsorted(patch * _APART + start, mine * _APART + word[i], "right") - 1
    fits = word[i] <= end[segment]
    return i[fits], segment[fits], mine[fits]


def _spans(lists: pa.Array, start: str, end: str, but: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of the spans in the texts' lists, without those marked by `but`."""
    each = pc.list_flatten(lists)
    if but:
        keep = pc.invert(pc.struct_field(each, but))
        return tuple(x.filter(keep).to_numpy().astype(np.int64) for x in (pc.list_parent_indices(lists), pc.struct_field(each, start), pc.struct_field(each, end)))
    return tuple(x.to_numpy().astype(np.int64) for x in (pc.list_parent_indices(lists), pc.struct_field(each, start), pc.struct_field(each, end)))


def _within(of: np.ndarray, begin: np.ndarray, end: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether words [begin, end) of a text lie within one of its spans."""
    text, start, stop = spans
    if not len(text):
        return np.zeros(len(of), bool)
    start, stop = text * _APART + start, text * _APART + stop
    order = np.argsort(start, kind="stable")
    reach = np.maximum.accumulate(stop[order])
    last = np.searchsorted(start[order], of * _APART + begin, "right") - 1
    return (last >= 0) & (reach[last] >= of * _APART + end)


class PrefixMax:
    """A Fenwick tree over places 0 to n - 1: the best (value, item) at or before a place."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, place: int, value: tuple[float, int]) -> None:
        place += 1
        while place < len(self.best):
            if value > self.best[place]:
                self.best[place] = value
            place += place & -place

    def upto(self, place: int) -> tuple[float, int]:
        """Over places below `place`."""
        found = (float("-inf"), -1)
        while place > 0:
            if self.best[place] > found:
                found = self.best[place]
            place -= place & -place
        return found


def chains(pairs: list[tuple[int, int]], weight: float = SEED_WORDS, max_gap: int = MAX_GAP) -> list[list[int]]:
    """Items of disjoint chains of matches (a, b) that ascend in both; best first.

    A chain gains `weight` for each match and pays for the words between matches on both sides, so much that a gap of
    max_gap on both costs one match. That cost adds up along the chain, so a match needs only the best earlier value
    among smaller b.
    """
    cost = weight / (2 * max_gap)
    order = sorted(range(len(pairs)), key=lambda i: (pairs[i][0], -pairs[i][1]))
    place = {b: k for k, b in enumerate(sorted({b for _, b in pairs}))}
    tree = PrefixMax(len(place))
    score, before = [0.0] * len(pairs), [-1] * len(pairs)
    waiting: list[int] = []
    for i in order:
        a, b = pairs[i]
        if waiting and pairs[waiting[0]][0] < a:  # matches at the same a never follow one another
            for j in waiting:
                tree.put(place[pairs[j][1]], (score[j] + cost * sum(pairs[j]), j))
            waiting.clear()
        best, j = tree.upto(place[b])
        gain = best - cost * (a + b)
        score[i], before[i] = (weight + gain, j) if gain > 0 else (weight, -1)
        waiting.append(i)
    used = [False] * len(pairs)
    out = []
    for end in sorted(range(len(pairs)), key=lambda i: (-score[i], pairs[i])):
        run, i = [], end
        while i >= 0 and not used[i]:
            used[i] = True
            if run and max(pairs[run[-1]][0] - pairs[i][0], pairs[run[-1]][1] - pairs[i][1]) > max_gap:
                out.append(run[::-1])
                run = []
            run.append(i)
            i = before[i]
        if run:
            out.append(run[::-1])
    return out


def _gap(x: list[bytes], y: list[bytes]) -> int:
    """Most words of x and y that align in order (longest common subsequence)."""
    a, most = 0, min(len(x), len(y))
    while a < most and x[a] == y[a]:
        a += 1
    z = 0
    while z < most - a and x[-1 - z] == y[-1 - z]:
        z += 1
    x, y = x[a : len(x) - z], y[a : len(y) - z]
    # a row of the table as bits: a bit is clear where the row goes up by one
    at: dict[bytes, int] = {}
    for k, w in enumerate(x):
        at[w] = at.get(w, 0) | 1 << k
    row = full = (1 << len(x)) - 1
    for w in y:
        if up := row & at.get(w, 0):
            row = (row + up | row - up) & full
    return len(x) - row.bit_count() + a + z


#: Steps over unequal words, on either side, in the order in which they are tried: few words first, alike on both sides.
_STEPS = tuple((a, skip - a) for skip in range(1, 9) for a in sorted(range(max(0, skip - 4), min(4, skip) + 1), key=lambda a, skip=skip: abs(2 * a - skip)))


def _outward(x: list[bytes], y: list[bytes]) -> tuple[int, int, int]:
    """How far an alignment goes on from here: words of x, of y, matched. It ends with a match.

    It steps over up to four unequal words on either side if an equal one follows with two more among the next four,
    and ends where two for each equal word, less one for each unequal one, add up to the most.
    """
    i = j = same = 0
    best = (0, 0, 0, 0)
    while True:
        while i < len(x) and j < len(y) and x[i] == y[j]:
            i, j, same = i + 1, j + 1, same + 1
        # an equal word gains 1, an unequal one on the longer side costs 4 at 80 percent
        score = 5 * same - 4 * max(i, j)
        if score >= best[0] - 20:
            best = max(best, (score, i, j, same)) if score > best[0] else best
        else:
            return best[1:]
        for a, c in _STEPS:
            if i + a < len(x) and j + c < len(y) and x[i + a] == y[j + c]:
                u, v = x[i + a : i + a + 5], y[j + c : j + c + 5]
                if sum(map(bytes.__eq__, u, v)) >= min(3, len(u), len(v)):
                    break
        else:
            return best[1:]
        i, j = i + a, j + c


def align(x: list[bytes], y: list[bytes], matches: list[tuple[int, int]]) -> tuple[int, int, int, int, int]:
    """The passage around a chain: first and end word in x and in y, and its words that are equal in order."""
    (i, j), same = matches[0], 0
    back = _outward(x[:i][::-1], y[:j][::-1])
    begin = i - back[0], j - back[1]
    same += back[2]
    for a, b in [*matches, (-1, -1)]:
        if a < 0:
            on = _outward(x[i:], y[j:])
            return begin[0], i + on[0], begin[1], j + on[1], same + on[2]
        # overlapping seeds share words: what is aligned already is left out
        over = max(0, i - a, j - b)
        same += _gap(x[i:a], y[j:b]) if a > i and b > j else 0
        same += max(0, SEED_WORDS - over)
        i, j = max(i, a + SEED_WORDS), max(j, b + SEED_WORDS)
    raise AssertionError


def _evens(x: list[bytes], y: list[bytes], most: int) -> list[tuple[int, int]]:
    """Steps on, in x and y alike, that end with an equal word, and how many equal ones they take; at first none."""
    out = [(0, 0)]
    for k, (u, v) in enumerate(zip(x[:most], y[:most], strict=False)):
        if u == v:
            out.append((k + 1, len(out)))
    return out


def stretched(x: list[bytes], y: list[bytes], found: tuple[int, int, int, int, int], min_words: int, percent: int) -> tuple[int, int, int, int, int]:
    """An alignment that is short of min_words, with the fewest words more at its ends that make it a passage, if any do."""
    a, ae, c, ce, same = found
    n = max(ae - a, ce - c)
    if n >= min_words:
        return found
    back = _evens(x[max(0, a - min_words) : a][::-1], y[max(0, c - min_words) : c][::-1], min_words)
    on = _evens(x[ae : ae + min_words], y[ce : ce + min_words], min_words)
    fit = [(k + m, k, m, e + f) for k, e in back for m, f in on if n + k + m >= min_words and 100 * (same + e + f) >= percent * (n + k + m)]
    if not fit:
        return found
    _, k, m, more = min(fit)
    return a - k, ae + m, c - k, ce + m, same + more


def repeated_passages(docs: DataFrame, *, min_words: int = MIN_WORDS, percent: int = MIN_PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, start_word, end_word, partner_id, partner_start_word, partner_end_word, n_words, n_equal.

    A row says that words [start, end) of a document repeat words of an earlier one (smaller id), with n_equal of the
    n_words words (the longer side's) equal in order: `percent` of them at least, and at least min_words. Words are
    `[^\\x20\\x09-\\x0D]+`, compared as they are. A passage's first document has no row of its own but is the others' partner (parts of a
    passage may have different ones, also where a passage that isn't verbatim has no partner for all of it). Each place where a
    document repeats a passage has rows of its own. Null and empty texts and rows without an id have no passages. Rows that repeat an id are one document:
    passages within it don't count. An empty table gives no rows; other columns are not looked at.
    """
    spark = prepared(docs.sparkSession)
    rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc_id"), text_of(docs, text_column).alias("text"))

    # so many parts that the places of one take about 64 MB (24 bytes a seed)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * size // PART_BYTES + 1)
    # packed rows are of some size also where partitions are many and texts few: their number grows with the texts
    buckets = min(4 * parts, size // BUCKET_BYTES + 1)
    run_words = min_words

    def sent(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        places, match = _hot([np.concatenate(x) for x in zip(*held, strict=True)])
        yield _packed(0, _bucket(places[0], buckets), places)
        if len(match[0]):
            yield _packed(1, _bucket(match[0], buckets), match)

    def in_chunks(found: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        many = 0
        for cols in found:
            held.append(cols)
            many += len(cols[0])
            if many >= _CHUNK:
                yield from sent(held)
                held, many = [], 0
        if many:
            yield from sent(held)

    def sow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[list[np.ndarray]]:
            for b in batches:
                ids, k = b.column(0).to_numpy(), 0
                for part in parcels(b.column(1)):
                    number, of, word, at, _ = seeds_of([t.encode("utf-8", "replace") for t in part])
                    yield [number, ids[k + of], word.astype(np.int32), at.astype(np.int32), np.ones(len(of), np.int8)]
                    k += len(part)

        yield from in_chunks(found())

    def sow_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs that begin with a seed, in stretches; wanted if no passage covers them."""

        def found() -> Iterator[list[np.ndarray]]:
            for b in batches:
                ids, k = b.column(0).to_numpy(), 0
                for part in parcels(b.column(1)):
                    stretches, covers = (b.column(c).slice(k, len(part)) for c in (2, 3))
                    number, of, word, at, w = seeds_of([t.encode("utf-8", "replace") for t in part], run_words)
                    end = word + run_words
                    whole = end <= w.n_words[of]
                    inside = whole & _within(of, word, end - WINDOW + 1, _spans(stretches, "s", "e"))
                    wanted = whole & _within(of, word, end - WINDOW + 1, _spans(stretches, "s", "e", "own")) & ~_within(of, word, end, _spans(covers, "start_word", "end_word"))
                    yield [number[inside], ids[k + of[inside]], word[inside].astype(np.int32), at[inside].astype(np.int32), wanted[inside].astype(np.int8)]
                    k += len(part)

        yield from in_chunks(found())

    def sow_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Both places of pairs of seeds in patchworks; wanted if no passage covers them."""

        def found() -> Iterator[list[np.ndarray]]:
            for b in batches:
                ids, k = b.column(0).to_numpy(), 0
                for part in parcels(b.column(1)):
                    patches, covers = (b.column(c).slice(k, len(part)) for c in (2, 3))
                    number, of, word, at, _ = seeds_of([t.encode("utf-8", "replace") for t in part])
                    i, segment, patch = _inside(of, word, patches)
                    # the words of different patches are far apart, so that no pair has seeds of two
                    u, v = (i[side] for side in seed_pairs(number[i], word[i] + patch * _APART, segment))
                    wanted = ~_within(of[u], word[u], word[v] + SEED_WORDS, _spans(covers, "start_word", "end_word"))
                    key = scrambled(number[u].view(np.uint64)) * np.uint64(3) + scrambled(number[v].view(np.uint64))
                    for role, side in enumerate((u, v)):
                        named = scrambled(key + np.uint64(role)).view(np.int64)
                        yield [named, ids[k + of[side]], word[side].astype(np.int32), at[side].astype(np.int32), wanted.astype(np.int8)]
                    k += len(part)

        yield from in_chunks(found())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, known = _unpacked(batches)
        match = [np.concatenate(x) for x in zip(known, _with_first(places), strict=True)]
        for k in range(0, len(match[0]), _CHUNK):
            cut = [x[k : k + _CHUNK] for x in match]
            yield _packed(1, _bucket(cut[0], buckets), cut)

    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["doc", "partner", "a0", "a1", "b0", "b1", "words", "p_words"]
    schema = "doc long, partner long, a0 int, a1 int, b0 int, b1 int, words array<int>, p_words array<int>"

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], k) for c, k in enumerate(kinds)], names=names)

    def linked(match: list[np.ndarray], single: bool) -> Iterator[pa.RecordBatch]:
        """Chains; single: a match alone is one as well."""
        other = match[0] != match[1]
        doc, partner, word, p_word, at, p_at = (x[other] for x in match)
        if not len(doc):
            return
        # a seed that stands more than once nearby (in a repeated line, say): the first of its places stands for them
        order = np.lexsort((word, p_word, partner, doc))
        doc, partner, word, p_word, at, p_at = (x[order] for x in (doc, partner, word, p_word, at, p_at))
        near = (doc[1:] == doc[:-1]) & (partner[1:] == partner[:-1]) & (p_word[1:] == p_word[:-1]) & (word[1:] - word[:-1] <= MAX_GAP)
        stands = np.concatenate([near, [False]]) & ~np.concatenate([[False], near])
        if single:
            stands = np.ones(len(doc), bool)
        order = np.lexsort((word, p_word - word, partner, doc))
        doc, partner, word, p_word, at, p_at, stands = (x[order] for x in (doc, partner, word, p_word, at, p_at, stands))
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (partner[1:] != partner[:-1])])
        same = ~new[1:] & (p_word[1:] - word[1:] == p_word[:-1] - word[:-1])
        again = np.concatenate([[False], same & (word[1:] == word[:-1])])
        group = np.cumsum(new) - 1
        alone = (np.bincount(group[~again], minlength=group[-1] + 1) == 1)[group]
        keep = ~again & (~alone | stands)
        doc, partner, word, p_word, at, p_at, stands = (x[keep] for x in (doc, partner, word, p_word, at, p_at, stands))
        if not len(doc):
            return
        # along a diagonal the ends of runs and some between stand for all
        step = (doc[1:] == doc[:-1]) & (partner[1:] == partner[:-1]) & (p_word[1:] - word[1:] == p_word[:-1] - word[:-1]) & (word[1:] - word[:-1] <= WINDOW)
        inner = np.concatenate([[False], step]) & np.concatenate([step, [False]]) & ~stands
        inner[1:] &= word[1:] // EVERY == word[:-1] // EVERY
        if single:
            inner = np.concatenate([[False], step])
        doc, partner, word, p_word, at, p_at, stands = (x[~inner] for x in (doc, partner, word, p_word, at, p_at, stands))
        edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (partner[1:] != partner[:-1])]))
        out: list[tuple] = []
        for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(doc)], strict=True):
            pairs = list(zip(word[i:j].tolist(), p_word[i:j].tolist(), strict=True))
            for run in [[0]] if len(pairs) == 1 else chains(pairs):
                u, v = i + run[0], i + run[-1]
                if stands[[i + x for x in run]].any() or (u < v and min(word[v] - word[u], p_word[v] - p_word[u]) + SEED_WORDS >= LEAST_SPAN):
                    out.append((int(doc[i]), int(partner[i]), int(at[u]), int(at[v]), int(p_at[u]), int(p_at[v]), [pairs[x][0] for x in run], [pairs[x][1] for x in run]))
            if len(out) >= 10_000:
                yield rows_of(out)
                out.clear()
        if out:
            yield rows_of(out)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chains, and stretches with shared seeds only (without a partner; a0, a1: first and end word; b0: 1 if it holds all first) and patchworks (b0: 2)."""
        _, match = _unpacked(batches)
        doc, s, e, own = _stretches(match, min_words - 2 * (WINDOW - 1))
        for k in range(0, len(doc), 10_000):
            yield rows_of([(d, None, x, y, int(o), None, None, None) for d, x, y, o in zip(*(c[k : k + 10_000].tolist() for c in (doc, s, e, own)), strict=True)])
        patches = [(d, None, x, y, 2, None, u, v) for d, x, y, u, v in _patchworks(match, min_words // 2)]
        for k in range(0, len(patches), 10_000):
            yield rows_of(patches[k : k + 10_000])
        yield from linked(match, False)

    def link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from linked(_unpacked(batches)[1], True)

    def matched(places: DataFrame) -> DataFrame:
        """Packed matches, those of a document in one task."""
        return places.repartition(parts, "bucket").mapInArrow(meet, _SCHEMA).repartition(parts, "bucket")

    with few_rows_a_batch(spark, 500):
        once = materialize(matched(rows.mapInArrow(sow, _SCHEMA)).mapInArrow(link, schema), "passage-linked")
    found = materialize(once.where("partner is not null").withColumn("k", F.monotonically_increasing_id()), "passage-chains")
    stretches = once.where("partner is null and b0 < 2").select("doc", F.col("a0").alias("s"), F.col("a1").alias("e"), (F.col("b0") == 1).alias("own"))
    involved = materialize(once.select(F.col("doc").alias("doc_id")).union(once.where("partner is not null").select("partner")).distinct(), "passage-ids")
    few = involved.count() <= BROADCAST_IDS
    texts = materialize(rows.join(F.broadcast(involved) if few else involved, "doc_id", "left_semi"), "passage-texts")

    def around(text: str, a: str, b: str, to: str, margin: int) -> list:
        begin, until = F.greatest(F.lit(0), F.col(a) - margin), F.col(b) + 2 * margin
        return [F.substring(F.col(text).cast("binary"), begin + 1, until - begin).alias(to), begin.alias(f"{to}_from"), (F.octet_length(text) <= until).alias(f"{to}_ends")]

    def cut_out(chains: DataFrame, margin: int) -> DataFrame:
        of_doc = chains.join(texts.withColumnsRenamed({"doc_id": "doc", "text": "t"}), "doc").select(*chains.columns, *around("t", "a0", "a1", "x", margin))
        return of_doc.join(texts.withColumnsRenamed({"doc_id": "partner", "text": "t"}), "partner").select(*of_doc.columns, *around("t", "b0", "b1", "y", margin))

    def part(raw: bytes, begin: int, at: int, word: int) -> tuple[list[bytes], int]:
        """The words of a cut-out, and the first one's number, given that the one at byte `at` has the number `word`."""
        before = raw[: at - begin].split()
        if begin and raw and not raw[:1].isspace() and before:
            before = before[1:]  # it may be cut
        return before + raw[at - begin :].split(), word - len(before)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                x, nx = part(r["x"], r["x_from"], r["a0"], r["words"][0])
                y, ny = part(r["y"], r["y_from"], r["b0"], r["p_words"][0])
                at = [(i - nx, j - ny) for i, j in zip(r["words"], r["p_words"], strict=True)]
                # texts of rows that share an id, or seeds that are equal by chance only, don't fit together
                at = [(i, j) for i, j in at if 0 <= i and 0 <= j and x[i : i + SEED_WORDS] == y[j : j + SEED_WORDS] and len(x[i : i + SEED_WORDS]) == SEED_WORDS]
                if not at:
                    continue
                a, ae, c, ce, same = core = align(x, y, at)
                n = max(ae - a, ce - c)
                near = max(2 * SEED_WORDS, min_words - n)
                if (r["x_from"] and a < near) or (r["y_from"] and c < near) or (not r["x_ends"] and ae > len(x) - near) or (not r["y_ends"] and ce > len(y) - near):
                    out.append((*[None] * 8, r["k"]))
                    continue
                a, ae, c, ce, same = stretched(x, y, core, min_words, percent)
                n = max(ae - a, ce - c)
                if n >= min_words and 100 * same >= percent * n:
                    out.append((r["doc"], a + nx, ae + nx, r["partner"], c + ny, ce + ny, n, same, None))
            names = ["doc_id", "start_word", "end_word", "partner_id", "partner_start_word", "partner_end_word", "n_words", "n_equal", "again"]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(9)], names=names)

    settled_schema = "doc_id long, start_word long, end_word long, partner_id long, partner_start_word long, partner_end_word long, n_words long, n_equal long, again long"

    def aligned(left: DataFrame) -> DataFrame:
        """The passages of chains; where an alignment reaches the end of what was cut out, more is cut out."""
        done, margin = None, MARGIN
        while True:
            with few_rows_a_batch(spark, 500):
                now = materialize(cut_out(left, margin).mapInArrow(settle, settled_schema), "passage-rows")
            done = now if done is None else done.union(now)
            again = now.where("again is not null").select(F.col("again").alias("k"))
            if again.isEmpty():
                return done.where("again is null").drop("again")
            left, margin = materialize(left.join(again, "k", "left_semi"), "passage-again"), margin * MORE

    settled = aligned(found)
    # stretches that no passage covers but for the words at their ends that no seed stands for
    cover = settled.select("doc_id", "start_word", "end_word")
    span = WINDOW - 1
    of_stretch = (cover.doc_id == stretches.doc) & (cover.start_word <= stretches.s + span) & (cover.end_word >= stretches.e - span)
    if not stretches.where("not own").join(cover, of_stretch, "left_anti").isEmpty():
        per_doc = stretches.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("s", "e", "own")).alias("stretches"))
        covers = cover.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("covers"))
        open_docs = texts.join(per_doc, "doc_id").join(covers, "doc_id", "left").select("doc_id", "text", "stretches", "covers")
        with few_rows_a_batch(spark, 500):
            runs = materialize(matched(open_docs.mapInArrow(sow_runs, _SCHEMA)).mapInArrow(link_runs, schema), "passage-runs")
        settled = settled.union(aligned(materialize(runs.withColumn("k", F.monotonically_increasing_id()), "passage-chains")))
    patches = once.where("partner is null and b0 = 2").select(F.col("doc").alias("doc_id"), F.col("a0").alias("s"), F.col("a1").alias("e"), F.col("words").alias("starts"), F.col("p_words").alias("ends"))
    cover = settled.select("doc_id", "start_word", "end_word")
    of_patch = (cover.doc_id == patches.doc_id) & (cover.start_word <= patches.s + span) & (cover.end_word >= patches.e - span)
    if not patches.join(cover, of_patch, "left_anti").isEmpty():
        per_doc = patches.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e", "starts", "ends")).alias("patches"))
        covers = cover.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("covers"))
        open_docs = texts.join(per_doc, "doc_id").join(covers, "doc_id", "left").select("doc_id", "text", "patches", "covers")
        with few_rows_a_batch(spark, 500):
            pairs = materialize(matched(open_docs.mapInArrow(sow_pairs, _SCHEMA)).mapInArrow(link_runs, schema), "passage-pairs")
        settled = settled.union(aligned(materialize(pairs.withColumn("k", F.monotonically_increasing_id()), "passage-chains")))
    # what lies within another passage with the same partner says nothing more
    before = Window.partitionBy("doc_id", "partner_id").orderBy("start_word", F.desc("end_word"), F.desc("n_equal"), "partner_start_word").rowsBetween(Window.unboundedPreceding, -1)
    whole = settled.distinct().withColumn("_reach", F.max("end_word").over(before))
    return whole.where("_reach is null or end_word > _reach").drop("_reach")

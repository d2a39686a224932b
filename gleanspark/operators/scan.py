"""Scans of texts by many patterns at once."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product
from math import prod
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanspark.functions.columns import java_pattern
from gleanspark.session import literal, ship_package

# Subtype, confidence, severity, flags, group, pattern.
CONTACTS = (
    ("email", 85.0, "MEDIUM", "", 0, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("phone", 70.0, "LOW", "", 0, r"(?<!\d)(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?)?\d{3}[\s.-]?\d{3,4}[\s.-]?\d{3,4}(?!\d)"),
    ("username", 72.0, "LOW", "i", 1, r"(?:username|user_name|developer|author|maintainer)\s*[:=]\s*['\"]([^'\"]{2,64})['\"]"),
    ("application-name", 68.0, "LOW", "i", 1, r"(?:app(?:lication)?[_-]?name|product[_-]?name)\s*[:=]\s*['\"]([^'\"]{2,64})['\"]"),
    ("environment-name", 76.0, "MEDIUM", "i", 1, r"(?:NODE_ENV|APP_ENV|ENVIRONMENT|DEPLOY_ENV)\s*[:=]\s*['\"]([^'\"]{2,32})['\"]"),
    ("external-url", 75.0, "LOW", "i", 0, r"https?://[^\s\"'<>]+"),
    ("internal-url", 88.0, "MEDIUM", "i", 0, r"https?://(?:localhost|127\.0\.0\.1|0\.0\.0\.0|10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3})[^\s\"'<>]*"),
    ("domain", 65.0, "LOW", "i", 0, r"\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}\b"),
    ("hostname", 80.0, "MEDIUM", "i", 0, r"\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:local|internal|corp|lan)\b"),
    ("subdomain", 78.0, "MEDIUM", "i", 0, r"\b(?:dev|staging|test|qa|uat|preview|sandbox)\.[a-z0-9.-]+\.[a-z]{2,}\b"),
    ("ipv4", 82.0, "MEDIUM", "", 0, r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d{1,2})\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d{1,2})\b"),
    ("ipv6", 85.0, "MEDIUM", "", 0, r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
    ("uuid", 90.0, "LOW", "", 0, r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b"),
    ("guid", 88.0, "LOW", "", 0, r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
)
CONTACT_BY_NAME = {c[0]: c for c in CONTACTS}
#: What a match of a contact's pattern must hold.
CONTACT_NEEDS = {
    "email": ("@",),
    "username": ("user", "developer", "author", "maintainer"),
    "application-name": ("app", "product"),
    "environment-name": ("env",),
    "external-url": ("://",),
    "internal-url": ("://",),
    "domain": (".",),
    "hostname": (".local", ".internal", ".corp", ".lan"),
    "subdomain": ("dev.", "staging.", "test.", "qa.", "uat.", "preview.", "sandbox."),
    "ipv4": (".",),
    "ipv6": (":",),
    "uuid": ("-",),
    "guid": ("-",),
}


# Fixed value: an assignment whose value may be a secret, to be judged by its entropy.
ENTROPY_ASSIGNMENT = r"(?:token|secret|password|key)\s*[:=]\s*['\"]([A-Za-z0-9+/=_\-]{24,})['\"]"
ENTROPY_THRESHOLD = 3.5


@dataclass(frozen=True)
class Rule:
    """A pattern to scan for; group: the part of a match that is its value."""

    rule_id: str
    pattern: str
    flags: str = ""
    group: int = 0
    #: A match holds one of these, in any case; none: the pattern is always tried.
    needs: tuple[str, ...] = ()

    def compiled(self) -> re.Pattern[str]:
        on = 0
        for f in self.flags:
            on |= {"i": re.I, "m": re.M, "s": re.S}[f]
        return re.compile(self.pattern, on)


Clauses = list[tuple[str, ...]]
#: So many texts at most are told apart in one clause, and so many choices from the branches of a pattern.
MOST_TEXTS, MOST_CHOICES = 24, 8


def _finite(op: int, value: object) -> set[str] | None:
    """All texts that one item of a parsed pattern matches, lower-cased; None if they are many or not ASCII."""
    if op is K.LITERAL:
        return {chr(value).lower()} if value < 128 else None
    if op is K.IN and all(o is K.LITERAL and v < 128 for o, v in value):
        return {chr(v).lower() for _, v in value}
    if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
        return {""}
    if op is K.SUBPATTERN:
        return _all_of(value[3])
    if op is K.BRANCH:
        parts = [_all_of(b) for b in value[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is K.MAX_REPEAT and value[1] == 1:
        one = _all_of(value[2])
        return None if one is None else one | ({""} if value[0] == 0 else set())
    return None


def _all_of(items: Sequence[tuple]) -> set[str] | None:
    out = {""}
    for op, value in items:
        one = _finite(op, value)
        if one is None or len(out) * len(one) > MOST_TEXTS:
            return None
        out = {a + b for a, b in product(out, one)}
    return out


def _telling(clause: tuple[str, ...]) -> tuple[int, int]:
    """More for clauses that fewer texts hold."""
    return min(map(len, clause)), -len(clause)


def _clauses(items: Sequence[tuple]) -> Clauses:
    out: Clauses = []
    run = {""}

    def ended() -> None:
        if "" not in run and (min(map(len, run)) > 1 or len(run) <= 4):
            out.append(tuple(sorted(run)))

    for op, value in items:
        one = _finite(op, value)
        if one is not None and len(run) * len(one) <= MOST_TEXTS:
            run = {a + b for a, b in product(run, one)}
            continue
        ended()
        run = one if one is not None and len(one) <= MOST_TEXTS else {""}
        if run != {""}:
            continue
        if op is K.SUBPATTERN:
            out += _clauses(value[3])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and value[0] > 0:
            out += _clauses(value[2])
        elif op is K.BRANCH:
            each = [_clauses(b) for b in value[1]]
            # a match holds what one of the branches needs: with few clauses, any choice of one from each
            few = prod(map(len, each)) <= MOST_CHOICES
            best = product(*each) if few else [[max(c, key=_telling, default=None) for c in each]]
            out += [tuple(sorted(set().union(*b))) for b in best if None not in b]
    ended()
    return out


def needed(pattern: str) -> Clauses:
    """What each match of a pattern holds, in any case: of each clause one text at least."""
    return _clauses(_parser.parse(pattern))


def folded(text: str) -> str:
    """The text as texts of `needed` are looked for in it: capital and dotless i match i where case means nothing."""
    return text.casefold() if text.isascii() else text.replace("\u0130", "i").replace("\u0131", "i").casefold()


#: Bytes looked at in one step of a sieve, and in texts sieved together; slots that parts of texts are hashed to.
SIEVE_BYTES, SLOTS = 1 << 18, 1 << 16
#: Parts with few of these letters are rare in texts.
COMMON_LETTERS = frozenset("etaoinsrhldcu")


def _slots(data: bytes, n: int) -> np.ndarray:
    """The slot of each part of n bytes, 3 or 4."""
    x = np.frombuffer(data, np.uint8)
    size = max(0, len(x) - n + 1)
    code = x[:size].astype(np.uint32)
    for i in range(1, n):
        code |= x[i : i + size].astype(np.uint32) << np.uint32(8 * i)
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def sieve(needs: Sequence[Clauses]) -> Callable[[Sequence[str]], list[list[int]]]:
    """For folded texts, the rules (by their place in needs) that may match each: no other one does.

    A text is asked once for all rules, for a part of three or four letters of each text of a rule's most telling clause;
    rules without such a clause may always match. What is asked for by hash may be absent, so needs are still to be tested.
    """
    always: set[int] = set()
    by_slot: dict[int, dict[int, set[int]]] = {3: defaultdict(set), 4: defaultdict(set)}
    for rule, clauses in enumerate(needs):
        clause = max(clauses, key=_telling, default=("",))
        if min(map(len, clause)) < 3:
            always.add(rule)
            continue
        for told in clause:
            n = min(4, len(told))
            part = min((told[i : i + n] for i in range(len(told) - n + 1)), key=lambda w: sum(c in COMMON_LETTERS for c in w))
            by_slot[n][int(_slots(part.encode()[:n], n)[0])].add(rule)
    tables = {}
    for n, slots in by_slot.items():
        tables[n] = np.zeros(SLOTS, bool)
        tables[n][list(slots)] = True

    def may_match(texts: Sequence[str]) -> list[list[int]]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raw])
        data = b"\0".join(raw)
        found = [set(always) for _ in texts]
        for at in range(0, len(data), SIEVE_BYTES):
            for n, table in tables.items():
                slots = _slots(data[at : at + SIEVE_BYTES + n - 1], n)
                places = np.flatnonzero(table[slots])
                for pair in np.unique(np.searchsorted(ends, places + at, "right") * SLOTS + slots[places]).tolist():
                    found[pair // SLOTS] |= by_slot[n][pair % SLOTS]
        return [sorted(f) for f in found]

    return may_match


def contact_rules() -> list[Rule]:
    return [Rule(c[0], c[5], c[3], c[4], CONTACT_NEEDS.get(c[0], ())) for c in CONTACTS]


def values(text: Column, pattern: str, flags: str = "", group: int = 0) -> Column:
    """All matches of one pattern, where only values are needed: a native expression."""
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern, flags)), F.lit(group))


HIT = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("snippet", T.StringType()),
    ]
)


def hits_of(text: str, rules: Sequence[tuple[Rule, re.Pattern[str], Clauses]], margin: int = 40, low: str | None = None) -> Iterator[tuple]:
    """Matches of rules in a text; low: the folded text, if it is at hand."""
    low = folded(text) if low is None else low
    ends: list[int] | None = None  # places of line ends, looked up by bisection
    for rule, pattern, needs in rules:
        if not all(any(n in low for n in one) for one in needs):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if ends is None:
                ends = [e.start() for e in re.finditer("\n", text)]
            line = bisect_left(ends, a)
            yield rule.rule_id, m.group(rule.group), a, b, line + 1, a - (ends[line - 1] if line else -1), text[max(0, a - margin) : b + margin].strip()


def dealt(texts: DataFrame, text_column: str) -> DataFrame:
    """texts dealt evenly over tasks if they come in fewer files than tasks run at once: a file's rows may all be in one group."""
    if texts.isStreaming or len(texts.inputFiles()) >= texts.sparkSession.sparkContext.defaultParallelism:
        return texts
    return texts.repartition(F.xxhash64(text_column, *(f.name for f in texts.schema if isinstance(f.dataType, T.AtomicType))))


def _parcels(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts, nulls as empty, in lists of SIEVE_BYTES characters or little more, each with the place of its first one."""
    part, size, first = [], 0, 0
    for i, x in enumerate(texts):
        part.append(x.as_py() or "")
        size += len(part[-1]) + 1
        if size >= SIEVE_BYTES:
            yield first, part
            part, size, first = [], 0, i + 1
    if part:
        yield first, part


def scanned(texts: DataFrame, rules: Sequence[Rule], text_column: str = "text", margin: int = 40) -> DataFrame:
    """The other columns of texts, and for each match of any rule its rule_id, value, start, end, line, col, snippet.

    One pass of one function over each text for all rules: no product of texts and rules is made, and nothing but the
    texts of few files is shuffled. Offsets count code points. Null texts have no matches.
    """
    ship_package(texts.sparkSession)
    rest = [c for c in texts.columns if c != text_column]
    schema = T.StructType([texts.schema[c] for c in rest] + list(HIT.fields))
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    # most texts lack what most patterns need, so that few patterns are tried on a text
    needs = [needed(r.pattern) + ([r.needs] if r.needs else []) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r, r.compiled(), n) for r, n in zip(rules, needs, strict=True)]
        may_match = sieve(needs)
        for b in batches:
            at: list[int] = []
            found: list[tuple] = []
            for first, part in _parcels(b.column(len(rest))):
                low = [folded(t) for t in part]
                for i, some in enumerate(may_match(low)):
                    for h in hits_of(part[i], [compiled[k] for k in some], margin, low[i]):
                        at.append(first + i)
                        found.append(h)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns[: len(rest)]), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))], names=[*rest, *HIT.names])

    return dealt(texts.select(*rest, text_column), text_column).mapInArrow(run, schema)


def contact_hits(texts: DataFrame, text_column: str = "text") -> DataFrame:
    """Contacts and identifiers with their place, confidence and severity."""
    found = scanned(texts, contact_rules(), text_column, margin=30)
    about = literal(texts.sparkSession, [(c[0], c[1], c[2]) for c in CONTACTS], "rule_id string, confidence double, severity string")
    return found.join(F.broadcast(about), "rule_id")


def contact_counts(texts: DataFrame, kind: str, id_column: str, text_column: str = "text") -> DataFrame:
    """value, n, n_docs of one kind of contact: native, with partial aggregation before the only shuffle."""
    _, _, _, flags, group, pattern = CONTACT_BY_NAME[kind]
    found = texts.select(F.col(id_column).alias("id"), F.explode(values(F.col(text_column), pattern, flags, group)).alias("value"))
    per = found.groupBy("value", "id").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("value").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_docs"))

"""Document quality by hierarchical empirical Bayes.

Two logistic classifiers (low quality, toxicity) are fitted on a bounded sample of labelled documents and give each
document its evidence. Evidence is averaged by path and by host. A host's rate is shrunk toward the whole corpus's, a
path's toward its host's, with strengths taken from how much the rates differ beyond chance, so that sites with few
documents say little. A document's posterior is its own log-odds, shifted by how its path's rate differs from the
corpus's.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import materialize, parcels, prepared, text_of
from gleanspark.llm.host_rules import duplicate_lines, repeated_words
from gleanspark.llm.minhash import near_duplicates

#: Labelled documents to learn from, at most, picked by a hash of their ids.
MAX_TRAINING = 10_000
#: Words of the lexicon of toxic words, at most, by evidence.
MAX_LEXICON = 5000
#: Toxic documents (near copies count once) that hold a toxic word, at least.
MIN_SUPPORT = 4
#: Documents at the training set's rate of toxicity that are added to a word's own, so that few say less.
PRIOR_DOCUMENTS = 2.0
#: A posterior beyond it rejects a document.
REJECT = 0.5
BROADCAST_SITES = 100_000

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_MARKS = b"#*$%&|<>"
_STOPS = b".,;:"
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TAG = re.compile(rb"</?[a-zA-Z][^<>]*>")
_LINK = re.compile(rb"https?://|www\.")

FEATURES = (
    "one words log2_words mean_word long_words short_words upper marks stops bangs bars digits non_ascii letters distinct top_word "
    "repeat_windows dup_lines lines first_upper tags links marked_words"
).split()


def _without(raw: bytes, some: bytes) -> int:
    return len(raw) - len(raw.translate(None, some))


def features(text: str) -> list[float]:
    """FEATURES of a whole text; shares lie between 0 and 1."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    k = max(1, n)
    count = Counter(words)
    letters = _without(raw, _LETTERS)
    lines = raw.count(b"\n") + 1
    return [
        1.0,
        min(n, 100) / 100,
        math.log2(n + 1) / 16,
        min(20.0, sum(map(len, words)) / k) / 20,
        sum(len(w) > 15 for w in words) / k,
        sum(len(w) < 3 for w in words) / k,
        _without(raw, _UPPER) / max(1, letters),
        _without(raw, _MARKS) / size * 4,
        _without(raw, _STOPS) / k,
        _without(raw, b"!") / k / 2,
        _without(raw, b"|") / k,
        _without(raw, _DIGITS) / size,
        (len(raw) - len(text)) / size,
        letters / size,
        len(count) / k,
        max(count.values(), default=0) / k,
        repeated_words(words) / k,
        duplicate_lines(raw) / lines,
        min(1.0, lines / k),
        sum(w[:1].isupper() for w in words) / k,
        min(1.0, len(_TAG.findall(raw)) / k * 4) if b"<" in raw else 0.0,
        min(1.0, len(_LINK.findall(raw)) / k * 4),
        sum(w[-1:] in (b"#", b"*", b"$", b"%", b"&", b"!") for w in words) / k,
    ]


def plain_words(text: str) -> set[bytes]:
    """The text's distinct words, A-Z lower-cased, without marks at their ends."""
    return {w for w in (x.strip(_EDGE) for x in set(text.encode("utf-8", "replace").lower().split())) if w}


def toxic_features(words: set[bytes], lexicon: dict[bytes, float]) -> list[float]:
    hit = [lexicon[w] for w in words & lexicon.keys()]
    return [1.0, float(bool(hit)), min(3, len(hit)) / 3, min(10.0, max(hit, default=0.0)) / 10]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 60) -> np.ndarray:
    """Weights by Newton's method, with a ridge on all but the first."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + keep * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    quality: np.ndarray | None
    toxic: np.ndarray | None
    lexicon: dict[bytes, float]

    def log_odds(self, text: str) -> tuple[float, float]:
        """Of low quality and of toxicity; what nothing was learnt about is far from it."""
        q = float(np.clip(np.dot(features(text), self.quality), -30, 30)) if self.quality is not None else -30.0
        t = float(np.clip(np.dot(toxic_features(plain_words(text), self.lexicon), self.toxic), -30, 30)) if self.toxic is not None else -30.0
        return q, t


def train(docs: DataFrame, labels: DataFrame, *, max_training: int = MAX_TRAINING, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Labels: doc_id, quality (0: low), toxic (1: toxic). Ids that repeat count once; null labels teach nothing.

    A kind whose labels are all alike isn't learnt. At most max_training documents' figures, and as many documents'
    counts of words, come to the driver.
    """
    prepared(docs.sparkSession)
    picked = labels.where(F.col(id_column).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()).orderBy(F.xxhash64(id_column), id_column).limit(max_training)
    picked = picked.groupBy(F.col(id_column).cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    known = materialize(
        docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(docs, text_column).alias("text")).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]), "quality-training"
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t) for p in parcels(b.column(1)) for t in p]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(f, pa.list_(pa.float64()))], names=["doc_id", "quality", "toxic", "f"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for toxic, t in zip(b.column(3).to_pylist(), b.column(1), strict=True):
                w = list(plain_words(t.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array([toxic] * len(w), pa.int32())], names=["word", "toxic"])

    rows = known.mapInArrow(measure, "doc_id long, quality int, toxic int, f array<double>").orderBy("doc_id").collect()
    if not rows:
        return Model(None, None, {})
    x = np.array([r["f"] for r in rows])
    low = np.array([r["quality"] == 0 for r in rows], float)
    bad = np.array([r["toxic"] == 1 for r in rows], float)
    quality = fit_logistic(x, low) if 0 < low.mean() < 1 else None
    if not 0 < bad.mean() < 1:
        return Model(quality, None, {})
    # near copies of a text count once: in the words' frequencies, not in the fit
    own = [near_duplicates(known.where(c).select("doc_id", "text")).where("kept").select("doc_id") for c in ("toxic = 1", "toxic <> 1")]
    once = materialize(known.join(F.broadcast(own[0].union(own[1])), "doc_id", "left_semi").select(*known.columns), "quality-once")
    n_bad, n = once.where("toxic = 1").count(), once.count()
    rate = n_bad / n
    # words more frequent among toxic documents than chance explains: by likelihood ratio, for as many words as are tried
    seen = materialize(once.mapInArrow(spell, "word binary, toxic int").groupBy("word").agg(F.sum("toxic").alias("b"), F.sum(1 - F.col("toxic")).alias("g")), "quality-words")
    tried = math.log(max(1, seen.where(F.col("b") >= MIN_SUPPORT).count())) + 3
    b, g = F.col("b"), F.col("g")
    proof = b * F.log(b / ((b + g) * rate)) + F.when(g > 0, g * F.log(g / ((b + g) * (1 - rate)))).otherwise(0.0)
    odds = F.log((b + PRIOR_DOCUMENTS * rate) / (g + PRIOR_DOCUMENTS * (1 - rate))) - math.log(rate / (1 - rate))
    top = seen.where(b >= MIN_SUPPORT).withColumns({"odds": odds, "proof": proof}).where((F.col("odds") > 1) & (F.col("proof") > tried)).orderBy(F.desc("proof"), "word").limit(MAX_LEXICON).collect()
    lexicon = {bytes(r["word"]): float(r["odds"]) for r in top}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [toxic_features(plain_words(t.as_py()), lexicon) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(f, pa.list_(pa.float64()))], names=["doc_id", "toxic", "f"])

    rows = known.mapInArrow(hits, "doc_id long, toxic int, f array<double>").orderBy("doc_id").collect()
    return Model(quality, fit_logistic(np.array([r["f"] for r in rows]), np.array([r["toxic"] for r in rows], float)), lexicon)


def evidence(docs: DataFrame, model: Model, *, host_column: str = "source", path_column: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, host, path, low_odds, toxic_odds (log-odds from the text alone) of each row."""
    prepared(docs.sparkSession)

    def site(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), site(host_column).alias("host"), site(path_column).alias("path"), text_of(docs, text_column).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.log_odds(t) for p in parcels(b.column(3)) for t in p]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([x[0] for x in s], pa.float64()), pa.array([x[1] for x in s], pa.float64())], names=["doc_id", "host", "path", "low_odds", "toxic_odds"])

    return rows.mapInArrow(score, "doc_id long, host string, path string, low_odds double, toxic_odds double")


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, rate: Column, mean: Column, n: Column) -> DataFrame:
    """One row: by moments, how many documents a site's prior is worth; null if sites differ no more than by chance."""
    s = sites.agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("h"), F.sum(n * n).alias("nn"), F.sum(n * (rate - mean) * (rate - mean)).alias("between"), F.sum(n * mean * (1 - mean)).alias("within"))
    within = F.col("within") / F.col("n")
    spread = (F.col("between") - (F.col("h") - 1) * within) / F.greatest(F.lit(1.0), F.col("n") - F.col("nn") / F.col("n"))
    return s.select(F.when(spread > 0, F.greatest(F.lit(1.0), within / spread - 1)).alias("strength"))


def site_rates(scored: DataFrame, odds: str) -> DataFrame:
    """host, path, shift: the log-odds by which a path's shrunken rate of this kind differs from the corpus's."""
    p = _sigmoid(F.col(odds))
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("k"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    whole = hosts.agg((F.sum("hk") / F.sum("hn")).alias("m"))
    n, k, m, host_rate = F.col("n"), F.col("k"), F.col("m"), F.col("host_rate")
    hosts = hosts.join(F.broadcast(whole))
    at_host = _strength(hosts, F.col("hk") / F.col("hn"), m, F.col("hn")).withColumnRenamed("strength", "hs")
    hosts = hosts.join(F.broadcast(at_host)).select("host", "m", F.when(F.col("hs").isNull(), m).otherwise((F.col("hk") + m * F.col("hs")) / (F.col("hn") + F.col("hs"))).alias("host_rate"))
    paths = paths.join(hosts, "host")
    at_path = _strength(paths, k / n, host_rate, n).withColumnRenamed("strength", "ps")
    rate = F.when(F.col("ps").isNull(), host_rate).otherwise((k + host_rate * F.col("ps")) / (n + F.col("ps")))
    return paths.join(F.broadcast(at_path)).select("host", "path", (_logit(rate) - _logit(m)).alias("shift"))


def classify(docs: DataFrame, labels: DataFrame, *, reject: float = REJECT, max_training: int = MAX_TRAINING, host_column: str = "source", path_column: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, low_posterior, toxic_posterior, kept (both are at most `reject`) of each row.

    Null and empty texts are judged as texts without words; a null host or path is one named ''; rows that repeat are
    judged each; an empty table gives no rows; other columns are not looked at. Without labels all is kept.
    """
    model = train(docs, labels, max_training=max_training, id_column=id_column, text_column=text_column)
    scored = materialize(evidence(docs, model, host_column=host_column, path_column=path_column, id_column=id_column, text_column=text_column), "quality-scored")
    low = site_rates(scored, "low_odds").withColumnRenamed("shift", "low_shift")
    toxic = site_rates(scored, "toxic_odds").withColumnRenamed("shift", "toxic_shift")
    sites = materialize(low.join(toxic, ["host", "path"]), "quality-sites")
    few = sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES
    out = scored.join(F.broadcast(sites) if few else sites, ["host", "path"], "left")
    out = out.select("doc_id", _sigmoid(F.col("low_odds") + F.col("low_shift")).alias("low_posterior"), _sigmoid(F.col("toxic_odds") + F.col("toxic_shift")).alias("toxic_posterior"))
    return out.withColumn("kept", (F.col("low_posterior") <= reject) & (F.col("toxic_posterior") <= reject))

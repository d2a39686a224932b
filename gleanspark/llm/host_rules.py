"""Quality rules for documents, and verdicts on their hosts.

Each document is measured and held against rules. The failures are summed by host; a beta prior fitted to all hosts'
rates by moments shrinks the rate of each host, sparse hosts most; a host whose shrunken rate is too high is rejected,
and its verdict is joined back to its documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import materialize, parcels, prepared, text_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
#: A host is rejected when, after shrinkage, more than so large a share of its documents fails.
MAX_HOST_RATE = 0.25
#: Hosts' verdicts are broadcast up to so many hosts; beyond it they are joined by a shuffle with skew handling.
BROADCAST_HOSTS = 100_000

_SYMBOLS = b"#*$%&|<>"
_SPACE = b"\t\n\x0b\x0c\r "
_KEEP_NO_WORD = bytes(range(256)).translate(None, _SYMBOLS)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words which the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    if len(set(windows)) == n:
        return 0
    count = Counter(windows)
    total, covered = 0, 0  # covered: end of the words counted so far
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + width - max(i, covered)
            covered = i + width
    return total


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    solid = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
    return len(words), solid, len(raw) - len(raw.translate(None, _SYMBOLS)), duplicate_lines(raw), repeated_words(words)


def document_measures(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", host_column: str | None = "source") -> DataFrame:
    """doc_id, host, the measures of `measures` and base_failed for each row."""
    prepared(docs.sparkSession)
    host = F.coalesce(F.col(host_column).cast("string"), F.lit("")) if host_column and host_column in docs.columns else F.lit("")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), host.alias("host"), text_of(docs, text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = [measures(t) for part in parcels(b.column(2)) for t in part]
            cols = [pa.array([x[k] for x in m], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    found = rows.mapInArrow(run, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def host_verdicts(measured: DataFrame, *, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, host_docs, host_failed, host_rate (shrunken), host_rejected.

    Prior: beta(a, b) with the mean m of all documents and a + b = m (1 - m) / v - 1, v the variance of the hosts'
    rates beyond what chance gives their documents; without such variance the hosts are alike and all have the rate m.
    """
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    n, k, rate = F.col("host_docs"), F.col("host_failed"), F.col("host_failed") / F.col("host_docs")
    # one row: sums over the hosts, weighted by their documents
    total = hosts.agg(F.sum(n).alias("n"), F.sum(k).alias("k"), F.count(F.lit(1)).alias("h"), F.sum(n * n).alias("nn"), F.sum(n * rate * rate).alias("nrr")).select(
        F.col("n"), (F.col("k") / F.col("n")).alias("m"), F.col("h"), F.col("nn"), F.col("nrr")
    )
    m = F.col("m")
    within = m * (1 - m)
    spread = F.greatest(F.lit(0.0), F.col("nrr") - F.col("n") * m * m - (F.col("h") - 1) * within) / F.greatest(F.lit(1.0), F.col("n") - F.col("nn") / F.col("n"))
    prior = total.select(m, F.when(spread > 0, F.greatest(F.lit(0.0), within / spread - 1)).alias("strength"))
    shrunken = F.when(F.col("strength").isNull(), m).otherwise((k + m * F.col("strength")) / (n + F.col("strength")))
    return hosts.join(F.broadcast(prior)).select("host", n, k, shrunken.alias("host_rate"), (shrunken > max_rate).alias("host_rejected"))


def host_rules(docs: DataFrame, *, max_rate: float = MAX_HOST_RATE, id_column: str = "doc_id", text_column: str = "text", host_column: str | None = "source") -> DataFrame:
    """Measures, base_failed, the host's figures and kept (false if the document or its host is rejected) by row.

    Null texts are empty and fail (no words); a null host is the host ''; repeated rows are judged row by row; an
    empty table gives no rows; other columns are not looked at.
    """
    measured = materialize(document_measures(docs, id_column=id_column, text_column=text_column, host_column=host_column), "host-rules")
    verdicts = host_verdicts(measured, max_rate=max_rate)
    few = verdicts.select("host").limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = measured.join(F.broadcast(verdicts) if few else verdicts, "host", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False)))

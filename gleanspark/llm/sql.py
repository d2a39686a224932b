"""DuckDB SQL with the same results as the queries, where SQL can express them.

Shards by a heap, token counts by a library, packing, schedules, classifiers, chains, disguises and approximate search
are beyond SQL; their tests compare them with brute force.
"""

from __future__ import annotations

from gleanspark.llm.host_rules import MAX_HOST_RATE, MAX_REPEAT_PERCENT, MIN_WORDS

_SPACE = r"\x20\x09-\x0D"

_NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{_SPACE}]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM words)
    UNION SELECT doc_id, w[1] AS s FROM words WHERE len(w) = 1
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), met AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), pairs AS (
    SELECT x, y FROM met JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n + b.n - common)
), links AS (
    SELECT x, y FROM pairs UNION SELECT y, x FROM pairs
), reached AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
), components AS (
    SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN components USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

_HOST_RULES = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), words AS (
    SELECT r, regexp_extract_all(t, '[^{_SPACE}]+') AS w FROM docs
), windows AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS n FROM (
        SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(w[: len(w) - 2]) AS x, unnest(w[2 : len(w) - 1]) AS y, unnest(w[3:]) AS z FROM words WHERE len(w) > 2
    )
), repeats AS (
    SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM windows WHERE n > 1) GROUP BY r
), lines AS (
    SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '[^{_SPACE}]') GROUP BY r
), measured AS (
    SELECT doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(l.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
    FROM docs JOIN words USING (r) LEFT JOIN repeats p USING (r) LEFT JOIN lines l USING (r)
), judged AS (
    SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM measured
), hosts AS (
    SELECT host, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS k FROM judged GROUP BY host
), whole AS (
    SELECT sum(n) AS n, sum(k) / sum(n) AS m, count(*) AS h, sum(n * n) AS nn, sum(k * k / n) AS nrr FROM hosts
), prior AS (
    SELECT m, m * (1 - m) AS within, greatest(0, nrr - n * m * m - (h - 1) * m * (1 - m)) / greatest(1, n - nn / n) AS spread FROM whole
), verdicts AS (
    SELECT host, CASE WHEN spread > 0 THEN (k + m * greatest(0, within / spread - 1)) / (n + greatest(0, within / spread - 1)) ELSE m END > {MAX_HOST_RATE} AS rejected FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM judged JOIN verdicts USING (host)
"""

_TOP_K = """
WITH whole AS (
    SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT) for x in embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([coalesce(q.v[i], 0) * coalesce(c.v[i], 0) for i in range(1, greatest(len(q.v), len(c.v)) + 1)]) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""


_HARD_NEGATIVES = """
WITH whole AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT) for x in embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum([coalesce(a.v[i], 0) * coalesce(c.v[i], 0) for i in range(1, greatest(len(a.v), len(c.v)) + 1)]) AS BIGINT) AS score
    FROM whole a JOIN whole c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), met AS (
    SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM positives JOIN scored s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM met WHERE rank <= 3
"""


def _codes() -> str:
    """The rounds of assignment and averages one after the other, all parts against all entries."""
    assigned = """near{k} AS (
    SELECT r, p, c.j, list_sum([(a.v[i] - c.v[i]) * (a.v[i] - c.v[i]) for i in range(1, len(a.v) + 1)]) AS d, a.v FROM parts a JOIN book{k} c USING (p)
    QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, c.j) = 1
)"""
    improved = """sums{k} AS (
    SELECT p, j, i, sum(x) AS s, count(*) AS n FROM (SELECT p, j, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM near{k}) GROUP BY ALL
), means{k} AS (
    SELECT p, j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM sums{k} GROUP BY p, j
), book{next} AS (
    SELECT p, j, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m USING (p, j)
)"""
    steps = [x.format(k=k, next=k + 1) for k in range(4) for x in (assigned, improved)]
    return f"""
WITH whole AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT) for x in embedding] AS v FROM embeddings
    WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), parts AS (
    SELECT r, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS v FROM whole, range(4) t(p)
), book0 AS (
    SELECT p, r - 1 AS j, v FROM parts WHERE r <= 256
), {", ".join(steps)}, {assigned.format(k=4)}, coded AS (
    SELECT r, string_agg(lpad(lower(to_hex(j)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near4 GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, j)) FROM book4) AS codebooks_sha256
FROM whole JOIN coded USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_duplicates": _NEAR_DUPLICATES, "op4_host_rules": _HOST_RULES, "op8_top_k": _TOP_K, "op12_hard_negatives": _HARD_NEGATIVES, "op13_codes": _codes()}

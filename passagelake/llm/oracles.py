"""The same results in DuckDB's SQL, where SQL can express them on whole tables."""

from __future__ import annotations

from passagelake.llm import quality

_WORDS = "list_filter(regexp_split_to_array({0}, '[ \\t-\\r]+'), lambda w: w <> '')"

#: Sets of shingles, all pairs with a common one, and the closure of the links.
NEAR_DUP = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words
    FROM documents),
grams AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(len(words) - 4), lambda i: array_to_string(words[i + 1 : i + 5], ' ')) END) AS gram FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common c JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c.n >= 75 * (a.n + b.n - c.n)),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.least AS component_id, r.least = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT doc_id, min(other) AS least FROM reached GROUP BY doc_id) r USING (doc_id)"""

#: Every string of 100 bytes in hexadecimal, the first of each kind, and the bytes that no later one covers.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, unnest(range(length(h) // 2 - 99)) AS pos, h FROM d WHERE length(h) >= 200),
cut AS (SELECT doc_id, pos, md5(substr(h, 2 * pos + 1, 200)) AS s FROM strings),
later AS (SELECT doc_id, pos FROM cut QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) > 1),
edges AS (SELECT doc_id, pos, pos > 100 + lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) OR lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) IS NULL AS begins FROM later),
numbered AS (SELECT doc_id, pos, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM edges),
spans AS (SELECT doc_id, span, min(pos) AS a, max(pos) + 100 AS b FROM numbered GROUP BY ALL),
gaps AS (SELECT doc_id, span, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY span), 0) AS a, a AS b FROM spans
         UNION ALL SELECT doc_id, 1 + max(span), max(b), 1000000000 FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY span) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
counted AS (SELECT doc_id, sum(b - a) AS n, count(*) AS c FROM spans GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _quality() -> str:
    """The rules with quartiles of the binned ratios."""
    ratios = list(quality.UPPER)
    levels = []
    for level, keys in ((0, "lang, source"), (1, "lang"), (3, "'all'")):
        quartiles = ", ".join(
            f"list_sort(list(b_{r}))[({k} * count(*) + 3) // 4] / {quality.UNIT} AS q{k}_{r}" for r in ratios for k in (1, 2, 3)
        )
        names = {0: "lang AS g_lang, source AS g_source", 1: "lang AS g_lang, NULL AS g_source", 3: "NULL AS g_lang, NULL AS g_source"}[level]
        levels.append(f"SELECT {level} AS level, {names}, count(*) AS n, {quartiles} FROM m WHERE NOT base_failed GROUP BY {keys}")
    fences = ", ".join(
        [f"greatest(q3_{r} + {t} * (q3_{r} - q1_{r}), q2_{r} + {least}) AS hi_{r}" for r, (t, least) in quality.UPPER.items()]
        + [f"least(q1_{r} - {t} * (q3_{r} - q1_{r}), q2_{r} - {least}) AS lo_{r}" for r, (t, least) in quality.LOWER.items()]
    )
    units = ", ".join(f"({n} * {quality.UNIT}) // greatest({d}, 1) AS u_{r}" for r, (n, d) in quality.PARTS.items())
    bins = ", ".join(f"u_{r} - u_{r} % (1::BIGINT << greatest(length(bin(u_{r})) - {quality.BITS}, 0)) AS b_{r}" for r in ratios)
    inside = " AND ".join([f"{r} <= f.hi_{r}" for r in quality.UPPER] + [f"{r} >= f.lo_{r}" for r in quality.LOWER])
    return f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS.format("text")} AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \\t-\\r]')) AS lines FROM t),
grams AS (SELECT row, unnest(range(len(words) - 2)) AS i, unnest(list_transform(range(len(words) - 2), lambda i: words[i + 1 : i + 3])) AS g FROM w WHERE len(words) > 2),
again AS (SELECT row, i FROM grams QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row),
counts AS (SELECT row, doc_id, lang, source, len(words) AS n_words, length(regexp_replace(text, '[ \\t-\\r]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(lines) AS n_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (row)),
u AS (SELECT *, {units} FROM counts),
m AS (SELECT *, {bins}, n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
    n_repeat_words / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS word_length,
    n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM u),
q AS ({" UNION ALL ".join(levels)}),
f AS (SELECT level, g_lang, g_source, n, {fences} FROM q),
chosen AS (SELECT m.*, f.* FROM m LEFT JOIN f ON f.level = 3 OR f.n >= {quality.MIN_GROUP} AND m.lang IS NOT DISTINCT FROM g_lang
    AND (f.level = 1 OR m.source IS NOT DISTINCT FROM g_source) QUALIFY row_number() OVER (PARTITION BY row ORDER BY f.level) = 1)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND {inside.replace("f.", "")} AS kept, n AS group_docs FROM chosen"""


def _ngram_join() -> str:
    """As for near-duplicates, with shingles of four words and a similarity of 0.85."""
    body = NEAR_DUP.replace("len(words) < 5", "len(words) < 4").replace("len(words) - 4", "len(words) - 3").replace("i + 5]", "i + 4]")
    return body.replace(">= 75 *", ">= 85 *").replace(", r.least = d.doc_id AS kept", "")


def _centroids() -> str:
    """Three rounds of means, and the last assignment."""
    steps = [
        """v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x) AND abs(x) < 2097152)) = 64)""",
        """c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, p) - 1 AS INT) AS k, p FROM
    (SELECT p, sha256('1:' || vec_id) AS h FROM v WHERE vec_id IS NOT NULL ORDER BY h, p LIMIT 16))""",
    ]
    for r in range(4):
        steps.append(f"""a{r} AS (SELECT row, vec_id, v.p, k, list_sum(list_transform(list_zip(v.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM v, c{r} c QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, k) = 1)""")
        if r < 3:
            steps.append(f"""m{r} AS (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(range(64)) AS i, unnest(p) AS x FROM a{r}) GROUP BY ALL)""")
            steps.append(f"""c{r + 1} AS (SELECT c.k, coalesce(q.p, c.p) AS p FROM c{r} c LEFT JOIN
    (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS p FROM m{r} GROUP BY k) q USING (k))""")
    return f"""
WITH {", ".join(steps)},
sums AS (SELECT k, CAST(sum(d) AS BIGINT) AS s FROM a3 GROUP BY k)
SELECT vec_id, k AS cluster, CAST(d AS BIGINT) AS distance, s AS cluster_inertia, (SELECT CAST(sum(s) AS BIGINT) FROM sums) AS inertia,
       sha256(array_to_string(c3.p, ',')) AS centroid_sha256
FROM a3 JOIN sums USING (k) JOIN c3 USING (k)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_near_dup": NEAR_DUP, "op8_quality_rules": _quality(), "op9_suffix_dedup": SUFFIX_DEDUP,
        "op12_ngram_join": _ngram_join(), "op13_centroids": _centroids(),
    }

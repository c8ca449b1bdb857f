"""SQL twins of the text queries that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

from tidemark.llm.license_scan import templates_of
from tidemark.llm.quality_rules import RULES, START_BAD, START_GOOD, START_PRIOR

#: Words of texts: A-Z in lower case, then runs of what the pattern doesn't exclude.
_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATE = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, {_WORDS} AS ws FROM documents
), i AS (
  SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, least(len(ws), 8) AS n, array_to_string(ws[k:k + 7], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 7, 1) + 1)) AS k FROM i WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)
), hits AS MATERIALIZED (
  SELECT dw.doc_id, dw.n, dw.k, iw.item_id FROM dw JOIN iw USING (n, w)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM d WHERE len(ws) > 0)
), sets AS (
  SELECT doc_id, md5(string_agg(shingle, '|' ORDER BY shingle)) AS c, count(*) AS n FROM s GROUP BY doc_id
), classes AS MATERIALIZED (
  SELECT c, min(doc_id) AS class_id, min(n) AS n FROM sets GROUP BY c
), cs AS MATERIALIZED (
  SELECT class_id, classes.n, shingle FROM classes JOIN s ON s.doc_id = class_id
), edges AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.class_id AS a, y.class_id AS b, count(*) AS shared, min(x.n) + min(y.n) AS total
    FROM cs x JOIN cs y USING (shingle) WHERE x.class_id <> y.class_id GROUP BY 1, 2)
  WHERE 9 * shared >= 4 * total
), reach(a, b) AS (
  SELECT class_id, class_id FROM classes
  UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b
), grouped AS (
  SELECT a AS class_id, min(b) AS group_id FROM reach GROUP BY a
), linked AS (
  SELECT a AS class_id, count(*) AS n_links FROM edges GROUP BY a
)
SELECT d.doc_id, classes.class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(group_id, d.doc_id) AS group_id
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN classes USING (c)
  LEFT JOIN linked ON linked.class_id = classes.class_id LEFT JOIN grouped ON grouped.class_id = classes.class_id
"""

LINES = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p
  FROM documents WHERE text IS NOT NULL
), sums AS (
  SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS v
  FROM lines
), bounds AS (
  SELECT doc_id, p AS q, v FROM sums
  UNION ALL SELECT doc_id, max(p) + 1, sum(length(line)) FROM lines GROUP BY doc_id
), reached AS (
  SELECT doc_id, q,
    min(q) OVER (PARTITION BY doc_id ORDER BY v RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS e,
    max(q) OVER (PARTITION BY doc_id ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
  FROM bounds
), units AS (
  SELECT doc_id, q AS p, e - q AS n FROM reached WHERE e IS NOT NULL
  UNION SELECT doc_id, b, q - b FROM reached WHERE b IS NOT NULL
), worded AS (
  SELECT u.doc_id, u.p, u.n, string_agg(l.line, chr(10) ORDER BY l.p) AS run
  FROM units u JOIN lines l ON l.doc_id = u.doc_id AND l.p >= u.p AND l.p < u.p + u.n
  GROUP BY u.doc_id, u.p, u.n
), copies AS (
  SELECT doc_id, p, n FROM (SELECT *, row_number() OVER (PARTITION BY n, run ORDER BY doc_id, p) AS r FROM worded) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(p, p + n - 1)) AS p FROM copies
), marked AS (
  SELECT l.doc_id, l.p, l.line, g.p IS NOT NULL AS gone, lag(g.p IS NOT NULL, 1, false) OVER (PARTITION BY l.doc_id ORDER BY l.p) AS before
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.p = l.p
), digests AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_runs,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN digests USING (doc_id)
"""

#: Bytes are pairs of hexadecimal digits.
SUFFIXES = """
WITH d AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS MATERIALIZED (
  SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 100)) AS w
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d WHERE length(h) >= 100)
), gone AS (
  SELECT w.doc_id, w.p FROM w JOIN (SELECT w, min(doc_id) AS first FROM w GROUP BY w HAVING min(doc_id) < max(doc_id)) f ON f.w = w.w WHERE f.first < w.doc_id
), spans AS MATERIALIZED (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM (
    SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (
      SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM gone))
  GROUP BY doc_id, g
), parts AS (
  SELECT s.doc_id, s.a, z, substr(h, 2 * coalesce(lag(z) OVER (PARTITION BY s.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(z) OVER (PARTITION BY s.doc_id ORDER BY a), 0))) AS before
  FROM spans s JOIN d USING (doc_id)
), kept AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(before, '' ORDER BY a) AS head, max(z) AS z FROM parts GROUP BY doc_id
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substr(h, 2 * z + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


#: Templates come from the operator's own files and names, as rows; k-grams are compared as words.
LICENSES = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents
), t AS MATERIALIZED (
  SELECT t, label, {_WORDS} AS ws FROM (VALUES {{templates}}) v(t, label, text)
), tg AS MATERIALIZED (
  SELECT t, q, array_to_string(ws[q + 1:q + 4], ' ') AS g FROM (SELECT t, ws, unnest(range(0, len(ws) - 3)) AS q FROM t WHERE len(ws) >= 4)
), votes AS MATERIALIZED (
  SELECT doc_id, t, p, q, p - q AS diagonal
  FROM (SELECT doc_id, p, array_to_string(ws[p + 1:p + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 3)) AS p FROM d WHERE len(ws) >= 4)) JOIN tg USING (g)
), diagonals AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= 3 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT doc_id, t, diagonal FROM votes) WINDOW w AS (PARTITION BY doc_id, t ORDER BY diagonal)
), banded AS (
  SELECT doc_id, t, diagonal, sum(new) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS band FROM diagonals
), spans AS (
  SELECT doc_id, t, band, min(p) AS first, max(p) + 4 AS z, count(DISTINCT word) AS words
  FROM (SELECT v.doc_id, v.t, band, p, unnest(range(q, q + 4)) AS word FROM votes v JOIN banded b ON b.doc_id = v.doc_id AND b.t = v.t AND b.diagonal = v.diagonal) GROUP BY ALL
), shares AS (
  SELECT doc_id, label, words / len(ws) AS share, len(ws) AS n FROM spans JOIN t USING (t) WHERE z - first <= 2 * len(ws) + 3
), method AS (
  SELECT doc_id, max(share) AS score, list(DISTINCT label) FILTER (share >= CASE WHEN n < 12 THEN 1 ELSE 0.6::DOUBLE END) AS found FROM shares GROUP BY doc_id
), places AS (
  SELECT doc_id, p, CASE WHEN ws[p + 1] = 'mit' AND ws[p + 2] = 'license' THEN 'mit' WHEN ws[p + 1] = 'apache' AND ws[p + 2] = 'license' THEN 'apache'
    WHEN ws[p + 1] = 'general' AND ws[p + 2] = 'public' AND ws[p + 3] = 'license' THEN 'gpl' END AS label
  FROM (SELECT doc_id, ws, unnest(range(0, len(ws))) AS p FROM d)
), base AS (
  SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(DISTINCT label) AS labels FROM places WHERE label IS NOT NULL GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(found, [])))), ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN method USING (doc_id)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licenses() -> str:
    rows = ", ".join(f"({t}, {_quoted(label)}, {_quoted(wording)})" for t, (label, wording) in enumerate(templates_of()))
    return LICENSES.replace("{templates}", rows)


def _state() -> str:
    return "prior, " + ", ".join(f"g{k}, b{k}" for k in range(len(RULES)))


def quality() -> str:
    """The rules' counts and votes, EM as a recursion over the table of patterns, and the verdict."""
    n = len(RULES)
    votes = ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS v{k}" for k, r in enumerate(RULES))
    each = ", ".join(f"v{k}" for k in range(n))
    logit = "ln(prior / (1 - prior)) + " + " + ".join(f"CASE v{k} WHEN 1 THEN ln(g{k} / (1 - b{k})) WHEN -1 THEN ln((1 - g{k}) / b{k}) ELSE 0 END" for k in range(n))
    p = f"1 / (1 + exp(-greatest(-500, least(500, {logit}))))"
    good = {k: f"greatest(0.001, least(0.999, (sum(CASE WHEN v{k} > 0 THEN m * p ELSE 0 END) + {START_GOOD * 100}) / (sum(CASE WHEN v{k} <> 0 THEN m * p ELSE 0 END) + 100)))" for k in range(n)}
    bad = {k: f"greatest(0.001, 1 - {good[k]}, least(0.999, (sum(CASE WHEN v{k} < 0 THEN m * (1 - p) ELSE 0 END) + {START_BAD * 100}) / (sum(CASE WHEN v{k} <> 0 THEN m * (1 - p) ELSE 0 END) + 100)))" for k in range(n)}
    new = ", ".join(f"{good[k]}, {bad[k]}" for k in range(n))
    start = f"{START_PRIOR}::DOUBLE, " + ", ".join(f"{START_GOOD}::DOUBLE, {START_BAD}::DOUBLE" for _ in range(n))
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), grams AS (
  SELECT doc_id, k, w, count(*) OVER (PARTITION BY doc_id, w) AS n FROM (SELECT doc_id, k, ws[k:k + 2] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS k FROM d WHERE len(ws) >= 3))
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 3)) AS p FROM grams WHERE n >= 2) GROUP BY doc_id
), f AS MATERIALIZED (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) AS n_lines, len(list_distinct(list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS distinct_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(x, '[^\p{{Lu}}]', '', 'g')) AS n_upper, length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) AS n_letters,
    len(list_filter(ws, lambda w: regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]'))) AS n_alpha_words,
    len(list_filter(ls, lambda l: regexp_matches(l, '[.!?:;"'')…»”][\x20\x09-\x0D]*$'))) AS n_ended_lines, length(regexp_replace(x, '[^!?]', '', 'g')) AS n_marks, len(list_distinct(ws)) AS n_distinct
  FROM d LEFT JOIN repeats r USING (doc_id)
), v AS MATERIALIZED (
  SELECT *, {votes} FROM (SELECT *, (n_lines - distinct_lines)::BIGINT AS n_dup_lines FROM f)
), pat AS MATERIALIZED (
  SELECT {each}, count(*) AS m FROM v GROUP BY ALL
), em(i, {_state()}) AS (
  SELECT 0, {start}
  UNION ALL
  SELECT any_value(i) + 1, greatest(0.001, least(0.999, (sum(m * p) + {START_PRIOR * 100}) / (sum(m) + 100))), {new}
  FROM (SELECT *, {p} AS p FROM em, pat WHERE i < 200) HAVING count(*) > 0
), last AS (
  SELECT * FROM em WHERE i = 200
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept, round(p, 6) AS posterior
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {p} AS p FROM v, last)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality(), "op4_decontaminate": DECONTAMINATE, "op5_line_dedup": LINES, "op6_suffix_dedup": SUFFIXES,
        "op9_jaccard_join": JACCARD, "op10_license_scan": licenses(),
    }

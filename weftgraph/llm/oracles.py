"""The contracts of operators 4, 5, 6, 8, 12 and 13 as brute force in SQL, for small tables."""

from __future__ import annotations

from .quality import LEAST_WORDS, REPEAT_PERCENT, STOP_WORDS, TABLE, WINDOW

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SHINGLES = "CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END"

CONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWERED}, {_LETTERS}) AS w FROM documents),
i AS MATERIALIZED (SELECT coalesce(item_id::VARCHAR, '') AS id, regexp_extract_all({_LOWERED}, {_LETTERS}) AS w FROM benchmark WHERE text IS NOT NULL),
windows AS MATERIALIZED (SELECT DISTINCT id, least(len(w), 13) AS n, unnest([array_to_string(w[k:k + 12], ' ') FOR k IN range(1, greatest(len(w) - 12, 1) + 1)]) AS s FROM i WHERE len(w) > 0),
runs AS MATERIALIZED (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS pos, unnest([array_to_string(w[k:k + n - 1], ' ') FOR k IN range(1, len(w) - n + 2)]) AS s FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
found AS MATERIALIZED (SELECT rid, n, pos, id FROM runs JOIN windows USING (n, s)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + n)) AS p FROM found) GROUP BY rid),
names AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, id FROM found) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN names USING (rid)"""

_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS))) + "]"


def _verdict() -> str:
    out = []
    for t in TABLE:
        ratio = f"{t.top}::DOUBLE / nullif({t.bottom}, 0)"
        tests = [f"coalesce({ratio} {sign} {bound}, true)" for sign, bound in ((">=", t.low), ("<=", t.high)) if bound is not None]
        out.append(f"(n_words < {t.least} OR ({' AND '.join(tests)}))")
    return " AND ".join(out)


QUALITY = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w,
  [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, {_SPACED})] AS l FROM documents),
runs AS MATERIALIZED (SELECT rid, unnest(range(1, len(w) - {WINDOW - 2})) AS pos, unnest([array_to_string(w[k:k + {WINDOW - 1}], ' ') FOR k IN range(1, len(w) - {WINDOW - 2})]) AS s FROM d WHERE len(w) >= {WINDOW}),
twice AS (SELECT rid, pos FROM runs JOIN (SELECT rid, s FROM runs GROUP BY rid, s HAVING count(*) > 1) USING (rid, s)),
again AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(pos, pos + {WINDOW})) AS p FROM twice) GROUP BY rid),
c AS MATERIALIZED (SELECT rid, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len([x FOR x IN w IF list_contains({_STOP}, lower(x))]) AS n_stop_words,
  len([x FOR x IN l IF left(ltrim(x, ' '), 1) IN ('-', '*', '•')]) AS n_bullet_lines, len([x FOR x IN l IF ends_with(rtrim(x, ' '), '...') OR ends_with(rtrim(x, ' '), '…')]) AS n_ellipsis_lines FROM d),
f AS (SELECT *, coalesce(n, 0)::BIGINT AS n_repeat_words, n_words < {LEAST_WORDS} OR 100 * coalesce(n, 0) > {REPEAT_PERCENT} * n_words AS base_failed FROM c LEFT JOIN again USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_verdict()} AS kept FROM f"""

LINES = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
u AS MATERIALIZED (SELECT rid, doc_id, unnest(l) AS line, unnest(range(len(l))) AS unit FROM d),
k AS MATERIALIZED (SELECT *, array_to_string(regexp_extract_all({_LOWERED.replace('text', 'line')}, {_SPACED}), ' ') AS key FROM u),
f AS MATERIALIZED (SELECT key, min((doc_id, unit)) AS pos, string_split(key, ' ') AS w FROM k WHERE key <> '' AND doc_id IS NOT NULL GROUP BY key),
s AS MATERIALIZED (SELECT DISTINCT key, pos, unnest({_SHINGLES}) AS s FROM f),
n AS MATERIALIZED (SELECT key, count(*) AS n FROM s GROUP BY key),
p AS MATERIALIZED (SELECT a.key AS x, b.key AS y, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.pos > b.pos GROUP BY 1, 2),
late AS MATERIALIZED (SELECT DISTINCT x AS key FROM p JOIN n a ON a.key = x JOIN n b ON b.key = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
gone AS (SELECT rid, unit FROM k JOIN f USING (key) WHERE (doc_id, unit) > pos OR key IN (SELECT key FROM late)),
g AS (SELECT rid, list(unit) AS units FROM gone GROUP BY rid)
SELECT doc_id, coalesce(len(l), 0)::INT AS n_lines, coalesce(len(units), 0)::INT AS n_removed,
  CASE WHEN units IS NULL THEN text ELSE array_to_string([l[i + 1] FOR i IN range(len(l)) IF NOT list_contains(units, i)], chr(10)) END AS text
FROM d LEFT JOIN g USING (rid)"""

NEAR = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWERED}, {_SPACED}) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, unnest({_SHINGLES}) AS s FROM d WHERE len(w) > 0),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS MATERIALIZED (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.rid <> b.rid GROUP BY 1, 2),
step AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
near(rid, label) USING KEY (rid) AS (SELECT rid, doc_id FROM d UNION SELECT step.y, min(near.label) FROM near JOIN step ON step.x = near.rid JOIN recurring.near AS known ON known.rid = step.y WHERE near.label < known.label GROUP BY step.y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, label AS component_id FROM d LEFT JOIN n USING (rid) JOIN near USING (rid)"""

_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')]), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

TRIE = f"""
WITH t AS MATERIALIZED (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS x,
  len(regexp_extract_all(coalesce(text, ''), {_SPACED})) AS w FROM conversations WHERE conv_id IS NOT NULL),
h AS MATERIALIZED (SELECT c, {_CRC} % 4 AS h, c - c % 20 AS host FROM (SELECT DISTINCT c FROM t)),
r AS MATERIALIZED (SELECT h.c, 0 AS own, pos, x, w FROM h JOIN t ON t.c = host AND pos <= h UNION ALL SELECT c, 1, pos, x, w FROM t JOIN h USING (c) WHERE pos > h),
p AS MATERIALIZED (SELECT c, w, row_number() OVER s AS d, md5(string_agg(x, '') OVER s) AS k FROM r WINDOW s AS (PARTITION BY c ORDER BY own, pos)),
m AS MATERIALIZED (SELECT c, w, d, k, coalesce(lag(k) OVER (PARTITION BY c ORDER BY d), '') AS up FROM p UNION ALL SELECT c, 0, 0, '', NULL FROM h),
ends AS (SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(k, d) AS k FROM m GROUP BY c) GROUP BY k),
n AS MATERIALIZED (SELECT k, any_value(d) AS d, any_value(up) AS up, any_value(w) AS w, min(c) AS c, count(*) AS n FROM m GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT m.k, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n - 1) * n.w)::BIGINT AS saved FROM n LEFT JOIN kids USING (k) JOIN m ON m.c = n.c AND m.d <= n.d GROUP BY m.k)
SELECT n.c AS conv_id, n.d AS depth, parent.c AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN below USING (k) LEFT JOIN kids USING (k) LEFT JOIN ends USING (k) LEFT JOIN n parent ON parent.k = n.up"""

_SCORE = "(1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT"

PHRASES = f"""
WITH p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM p
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM p) GROUP BY ALL HAVING count(*) >= 10),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.k, cut, a, l.f AS l, r.f AS r FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
scored AS (SELECT lang, phrase, k, a, l, r, {_SCORE} AS score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY {_SCORE}, cut) = 1),
over AS (SELECT lang, phrase, max(a) AS whole FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT scored.* FROM scored LEFT JOIN over USING (lang, phrase) WHERE whole IS NULL OR 100 * whole < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000"""

SQL = {"op4_decontamination": CONTAMINATION, "op5_quality_rules": QUALITY, "op6_line_dedup": LINES, "op8_ngram_jaccard": NEAR, "op12_prefix_trie": TRIE, "op13_phrases": PHRASES}

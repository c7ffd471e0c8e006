"""SQL texts of corpus queries, for DuckDB."""

from __future__ import annotations

SPACE = r"\x20\x09-\x0D"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY_RULES = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines FROM documents),
windows AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n > 1)
  CROSS JOIN (SELECT unnest(range(3)) AS k) GROUP BY doc_id),
measured AS (
  SELECT doc_id, text, lines, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         4 * n_symbols > n_words OR 100 * n_dup_lines > 50 * len(lines)
         OR word_chars < 2 * n_words OR word_chars > 15 * n_words
         OR 2 * (length(text) - length(regexp_replace(text, '\p{{L}}+', '', 'g'))) < word_chars
         OR 10 * (length(text) - length(replace(text, '!', ''))) > 5 * n_words
         OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) > 9 * len(lines)
         OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(…|\.\.\.)[ \t\r]*$'))) > 3 * len(lines) AS rejected
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR rejected) AS kept FROM judged"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^{SPACE}]+') AS words FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
    ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingles FROM split),
members AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
WITH items AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({LOWER}, '{WORD}') AS words FROM benchmark),
texts AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS words FROM documents),
item_windows AS (
  SELECT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS w FROM (
    SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
    FROM (SELECT *, least(13, len(words)) AS n FROM items WHERE len(words) > 0))),
known AS (SELECT n, w, list(DISTINCT item_id) AS ids FROM item_windows GROUP BY n, w),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS w FROM (
    SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
    FROM texts CROSS JOIN (SELECT DISTINCT n FROM item_windows))),
found AS (SELECT doc_id, i, n, ids FROM doc_windows JOIN known USING (n, w)),
hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS listed
  FROM (SELECT doc_id, unnest(ids) AS id FROM found) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM texts LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""

REPEATED_PASSAGES = rf"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS words FROM documents),
windows AS (
  SELECT doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM split)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS least FROM windows) WHERE least < doc_id),
places AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM split),
judged AS (
  SELECT doc_id, i, word, coalesce(i - max(l.i) OVER (PARTITION BY doc_id ORDER BY i) < 50, false) AS gone
  FROM places LEFT JOIN late l USING (doc_id, i)),
kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM judged GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)"""

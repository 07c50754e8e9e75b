"""DuckDB SQL for the queries that SQL can express on whole tables."""

_WORD = r"[^\x20\x09-\x0D]+"

OP1 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), g AS (
  SELECT doc_id, p, words[p:p + 4] AS five FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS p FROM w)
), r AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, five) AS n FROM g) WHERE n > 1
), c AS (
  SELECT doc_id, sum(least(5, coalesce(next_p - p, 5))) AS n_repeat_words
  FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS next_p FROM r) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         ((length(text) - length(replace(text, '!!', ''))) // 2)::BIGINT AS n_shouts
  FROM w LEFT JOIN c USING (doc_id)
), f AS (
  SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
    + 8 * (word_chars < 2 * n_words OR word_chars > 25 * n_words)::INT + 16 * (2 * n_shouts > n_words)::INT
    + 32 * (10 * n_dup_lines > 6 * n_lines)::INT)::BIGINT AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM f
"""

OP2 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1]::BIGINT AS weight FROM s
), r AS (
  SELECT *, sum(source_size) OVER () AS every, coalesce(sum(source_size) OVER k, 0) AS clamped,
         sum(weight) OVER () - coalesce(sum(weight) OVER k, 0) AS weight_left
  FROM w WINDOW k AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), o AS (
  SELECT *, (every * 150 - clamped * 200) * weight <= source_size * 200 * weight_left AS open FROM r
), l AS (
  SELECT clamped, weight_left FROM o WHERE open ORDER BY source_size / weight, source ASC NULLS LAST LIMIT 1
), t AS (
  SELECT o.source, o.source_size,
         CASE WHEN l.clamped IS NULL OR (o.clamped < l.clamped AND NOT o.open) THEN (o.source_size * 2)::DOUBLE
              ELSE ((o.every * 150 - l.clamped * 200) * o.weight)::DOUBLE / (l.weight_left * 100)::DOUBLE END AS target
  FROM o LEFT JOIN l ON true
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS wanted,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (wanted // greatest(source_size, 1))
        + greatest(0, least(size, wanted - (wanted // greatest(source_size, 1)) * source_size - ahead)))::BIGINT AS taken
FROM p
"""

OP4 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[p:p + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS p FROM d WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 75 * (a.n + b.n - shared)
), r AS (
  SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON r.doc_id = l.x
)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root)::BIGINT AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS passage
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM d)
), s AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY passage) AS least FROM w) WHERE least < doc_id
), c AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(p, p + 13)) AS p FROM s)
), x AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d
), k AS (
  SELECT x.doc_id, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE c.p IS NULL) AS kept
  FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p GROUP BY x.doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

ORACLE = {"op1_quality_rules": OP1, "op2_mixing": OP2, "op4_jaccard_join": OP4, "op5_substring_dedup": OP5}

"""DuckDB SQL for those of ``webloom.llm.queries`` that SQL can express."""

OP1 = r"""
WITH m AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY src) AS pos FROM m GROUP BY src),
w AS (SELECT *, ((pos - 1) % 3 + 1)::BIGINT AS w FROM s),
c AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(w) OVER ()::BIGINT AS all_w,
        coalesce(sum(3 * source_size) OVER o, 0)::BIGINT AS most_before, coalesce(sum(w) OVER o, 0)::BIGINT AS w_before
      FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, 3 * source_size * (all_w - w_before) <= w * (total - most_before) AS stops FROM c),
e AS (SELECT *, (total - coalesce(sum(CASE WHEN stops THEN 3 * source_size END) OVER (), 0))::DOUBLE AS left_,
        (coalesce(sum(CASE WHEN NOT stops THEN w END) OVER (), 0))::DOUBLE AS left_w FROM d),
t AS (SELECT src, source_size, CASE WHEN stops THEN (3 * source_size)::DOUBLE ELSE (w * left_) / left_w END AS target FROM e),
n AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM t),
p AS (SELECT *, target - epochs * source_size AS need FROM n),
g AS (SELECT src, h, sum(size)::BIGINT AS g FROM m WHERE size > 0 GROUP BY src, h),
r AS (SELECT g.src, h, g, sum(g) OVER (PARTITION BY g.src ORDER BY h) AS cum, need FROM g JOIN p USING (src)),
k AS (SELECT src, h FROM r WHERE cum <= need OR (cum - g <= need AND 2 * (need - (cum - g)) >= g))
SELECT m.doc_id, m.size, p.source_size, p.target,
       m.size * CASE WHEN m.size > 0 THEN epochs + (k.h IS NOT NULL)::BIGINT ELSE 0 END AS taken,
       (CASE WHEN m.size > 0 THEN epochs + (k.h IS NOT NULL)::BIGINT ELSE 0 END)::INTEGER AS copies
FROM m JOIN p USING (src) LEFT JOIN k ON k.src = m.src AND k.h = m.h
"""

OP3 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
w AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 11), lambda i: {'i': i, 'k': md5(array_to_string(words[i:i+12], ' '))})) AS x FROM d WHERE len(words) >= 13),
f AS (SELECT doc_id, x.i AS i, min(doc_id) OVER (PARTITION BY x.k) AS first FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM f WHERE first < doc_id),
l AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
k AS (SELECT l.doc_id, count(*)::BIGINT AS n_words, count(g.i)::BIGINT AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY l.i) AS kept
      FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

OP4 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key),
j AS (SELECT k.*, coalesce(d.n >= 5 AND k.doc_id <> d.top, FALSE) AS gone FROM k LEFT JOIN d ON d.key = k.key AND length(k.key) >= 40)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INTEGER)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

OP6 = r"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
u AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 6), lambda i: {'i': i, 'w': array_to_string(words[i:i+7], ' ')})) AS x
      FROM d WHERE len(words) >= 8),
v AS (SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.w) AS n FROM u),
s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM v WHERE n > 1),
r AS (SELECT doc_id, sum(least(8, i - coalesce(p, i - 8)))::BIGINT AS n_repeat_words FROM s GROUP BY doc_id),
m AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
b AS (SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (2 * n_symbols > n_words)::BIGINT
        + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed,
       CASE failed WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'repeated_lines' WHEN 16 THEN 'short_words' WHEN 32 THEN 'long_words' END AS lone_rule,
       CASE WHEN failed IN (1, 2, 4, 8, 16, 32) THEN count(*) OVER (PARTITION BY failed) ELSE 0 END::BIGINT AS lone_docs
FROM b
"""

#: Personalised PageRank by a recursive table: 130 rounds, after which 0.85 to that power moves nothing that is shown.
OP8 = r"""
WITH RECURSIVE u AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, html, coalesce(lower(regexp_extract(rest, '^[^/?#]*')), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT *, CASE
        WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p),
v AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS by_rule FROM r),
h AS (SELECT host, count(*) AS n, count(*) FILTER (by_rule = 'allow') AS allowed, count(*) FILTER (by_rule = 'block') AS blocked FROM v WHERE host <> '' GROUP BY host),
t AS (SELECT host AS src, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
        lambda x: lower(regexp_extract(x, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))), lambda x: x <> ''))) AS dst FROM v WHERE host <> ''),
l AS (SELECT src, dst, count(*) AS n FROM t WHERE src <> dst GROUP BY src, dst),
e AS (SELECT 'trust' AS kind, src, dst, n::DOUBLE / sum(n) OVER (PARTITION BY src) AS share FROM l
      UNION ALL SELECT 'distrust', dst, src, n::DOUBLE / sum(n) OVER (PARTITION BY dst) FROM l),
s AS (SELECT 'trust' AS kind, host, 1.0::DOUBLE / count(*) OVER () AS score FROM h WHERE 2 * allowed > n
      UNION ALL SELECT 'distrust', host, 1.0::DOUBLE / count(*) OVER () FROM h WHERE 2 * blocked > n),
w(k, kind, host, score) AS (
  SELECT 0, kind, host, score FROM s
  UNION ALL
  (SELECT w.k + 1, w.kind, e.dst, 0.85 * sum(w.score * e.share) FROM w JOIN e ON e.kind = w.kind AND e.src = w.host WHERE w.k < 130 GROUP BY w.k, w.kind, e.dst)),
f AS (SELECT kind, host, 0.15 * sum(score) AS score FROM w GROUP BY kind, host),
g AS (SELECT host, sum(score) FILTER (kind = 'trust') AS trust, sum(score) FILTER (kind = 'distrust') AS distrust FROM f GROUP BY host)
SELECT page_id, v.host, path, rule,
       coalesce(by_rule, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) AND distrust >= 0.1 / (SELECT count(*) FROM h) THEN 'block' ELSE 'allow' END) AS verdict,
       round(coalesce(trust, 0), 6) AS trust, round(coalesce(distrust, 0), 6) AS distrust
FROM v LEFT JOIN g ON g.host = v.host
"""

SQL = {"op1_source_mixing": OP1, "op3_substring_dedup": OP3, "op4_line_dedup": OP4, "op6_exact_top_k": OP6, "op8_url_filter": OP8, "op9_quality_rules": OP9}

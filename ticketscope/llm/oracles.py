"""DuckDB twins of the training-data queries that SQL can express, written on their own."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH d AS (
  SELECT doc_id, source, len({WORDS.format(text='text')})::BIGINT AS size,
         md5('20:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM s),
r AS (
  SELECT *, CASE turn WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, source_size * 2e0 AS room FROM w),
v AS (
  SELECT *, (sum(source_size) OVER () * 1.5e0
             - coalesce(sum(room) OVER (ORDER BY room / weight, source NULLS LAST
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
            / sum(weight) OVER (ORDER BY room / weight, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
f AS (SELECT arg_min(level, room / weight) FILTER (WHERE room > level * weight) AS level FROM v),
t AS (
  SELECT v.source, v.source_size, v.turn,
         least(v.room, coalesce(f.level, v.room / v.weight) * v.weight) AS target
  FROM v, f),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.turn,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, (greatest(least(size, floor(target)::BIGINT - start), 0)
             + greatest(least(size, floor(target)::BIGINT - source_size - start), 0))::BIGINT AS taken,
         start / target AS share
  FROM c),
p AS (  -- the three schedules: times and factors at the ends of their pieces
  SELECT * FROM (VALUES (0, 0e0, 0.8e0, 0.5e0, 1e0), (0, 0.8e0, 1e0, 1e0, 2e0), (1, 0e0, 1e0, 1e0, 1e0),
                        (2, 0e0, 0.6e0, 1.5e0, 1e0), (2, 0.6e0, 1e0, 1e0, 0.25e0)) AS x(turn, t0, t1, a, b)),
q AS (
  SELECT *, sum((t1 - t0) * (a + b) / 2) OVER (PARTITION BY turn) AS whole,
         coalesce(sum((t1 - t0) * (a + b) / 2) OVER (PARTITION BY turn ORDER BY t0
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before
  FROM p),
u AS (SELECT turn, t0, t1 - t0 AS dt, a / whole AS a, b / whole AS b, before / whole AS done FROM q),
m AS (
  SELECT k.doc_id, k.size, k.source_size, k.target, k.taken, k.share - u.done AS need, u.t0, u.dt, u.a, u.b
  FROM k JOIN u ON k.turn = u.turn AND (u.done <= k.share OR (u.t0 = 0 AND isnan(k.share)))
  QUALIFY row_number() OVER (PARTITION BY k.doc_id ORDER BY u.done DESC) = 1)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN least(t0 + CASE WHEN need <= 0 THEN 0e0 ELSE
            2 * need / (a + sqrt(greatest(a * a + 2 * ((b - a) / dt) * need, 0e0))) END, 1e0) END AS position
FROM m
"""

OP4 = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
                        ('allow', 'org', '/fr/')) AS x(action, h, p))
SELECT u.page_id, u.host, u.path, arg_max(r.h || r.p, len(r.h || r.p)) AS rule,
       coalesce(arg_max(r.action, len(r.h || r.p)), 'allow') AS verdict
FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
GROUP BY u.page_id, u.host, u.path
"""

OP7 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (
  SELECT k.doc_id, k.i, k.line, (s.key IS NOT NULL AND k.doc_id <> s.first_doc) AS gone
  FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP8 = r"""
WITH h AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
c AS (
  SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, 5 * i::INT + 1, 5))::BIGINT) AS parts,
         min(page_id) OVER (PARTITION BY hex) AS first_id FROM h)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(parts, lambda n:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 10) & 31) + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 5) & 31) + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM c
"""

_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = rf"""
WITH b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_CLASS}') AS w FROM benchmark),
items AS (
  SELECT item_id, unnest(list_transform(range(greatest(len(w) - 12, 1)), lambda i:
           array_to_string(w[i + 1:i + 13], ' '))) AS grams
  FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, grams AS gram, len(string_split(grams, ' ')) AS n FROM items),
sizes AS (SELECT DISTINCT n FROM grams),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_CLASS}') AS w FROM documents),
spots AS (
  SELECT doc_id, n, unnest(range(len(w) - n + 1)) AS i, unnest(list_transform(range(len(w) - n + 1), lambda i:
           array_to_string(w[i + 1:i + n], ' '))) AS gram
  FROM d, sizes WHERE len(w) >= n),
found AS (SELECT s.doc_id, s.i, g.n, g.item_id FROM spots s JOIN grams g ON s.gram = g.gram AND s.n = g.n),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id),
same AS (  -- equal words of a document and an item; runs of them along a diagonal are verbatim matches
  SELECT doc_id, item_id, i, i - j AS diagonal
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d)
  JOIN (SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS j FROM b) USING (word)),
runs AS (
  SELECT doc_id, item_id::VARCHAR AS item, min(i) AS place, count(*) AS n
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i) AS run FROM same)
  GROUP BY doc_id, item_id, diagonal, run),
longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place, item) = 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated,
       coalesce(n, 0)::BIGINT AS longest_words, coalesce(place, -1)::BIGINT AS longest_at, item AS longest_item
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

_STEP = "ln(1.01e0 / 0.99e0)"
#: rate: numerator, denominator, added to it, least spread, lower fence
_RATES = (("symbols_per_word", "n_symbols", "n_words", 20, 0.04, False), ("dup_lines_per_line", "n_dup_lines", "n_lines", 15, 0.03, False),
          ("repeats_per_word", "n_repeat_words", "n_words", 100, 0.05, False), ("chars_per_word", "word_chars", "n_words", 0, 0.4, True),
          ("shouts_per_word", "n_shouts", "n_words", 20, 0.06, False), ("marks_per_word", "n_marks", "n_words", 20, 0.06, False))
_RATE_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, {i} AS nr, '{n}' AS rate, CASE WHEN {b} > 0 THEN {a}::DOUBLE / ({b} + {m}) ELSE 0e0 END AS v, "
    f"{sp}e0 AS spread, {str(both).lower()} AS two_sided FROM m" for i, (n, a, b, m, sp, both) in enumerate(_RATES))

OP1 = rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS.format(text='text')} AS w,
         string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
g AS (
  SELECT doc_id, unnest(range(len(w) - 7)) AS i, unnest(list_transform(range(len(w) - 7), lambda i: w[i + 1:i + 8])) AS gram
  FROM d WHERE len(w) > 8),
r AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS place FROM g
    QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_shouts,
         length(text) - length(replace(text, '!', '')) AS n_marks
  FROM d LEFT JOIN r USING (doc_id)),
v AS ({_RATE_ROWS}),
x AS (SELECT *, CASE WHEN v < 1e-4 THEN -1000000 ELSE ceil(ln(v) / {_STEP})::INTEGER END AS bucket FROM v),
c AS (SELECT lang, source, rate, bucket, count(*)::HUGEINT AS n FROM x GROUP BY lang, source, rate, bucket),
cl AS (SELECT lang, rate, bucket, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang, rate) AS size FROM c GROUP BY lang, rate, bucket),
ca AS (SELECT rate, bucket, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY rate) AS size FROM c GROUP BY rate, bucket),
gr AS (SELECT DISTINCT c.lang, c.source, c.rate, cl.size AS size_l, ca.size AS size_a
       FROM c JOIN cl ON c.rate = cl.rate AND c.lang IS NOT DISTINCT FROM cl.lang JOIN ca ON c.rate = ca.rate),
wt AS (  -- the source's own rows, and 200 rows' worth of its language and of all rows, in whole numbers
  SELECT gr.*, c.bucket, c.n * size_l * size_a AS w
  FROM gr JOIN c ON gr.rate = c.rate AND gr.lang IS NOT DISTINCT FROM c.lang AND gr.source IS NOT DISTINCT FROM c.source
  UNION ALL SELECT gr.*, cl.bucket, 200 * cl.n * size_a FROM gr JOIN cl ON gr.rate = cl.rate AND gr.lang IS NOT DISTINCT FROM cl.lang
  UNION ALL SELECT gr.*, ca.bucket, 200 * ca.n * size_l FROM gr JOIN ca ON gr.rate = ca.rate),
up AS (
  SELECT lang, source, rate, bucket, sum(sum(w)) OVER (PARTITION BY lang, source, rate ORDER BY bucket) AS upto,
         sum(sum(w)) OVER (PARTITION BY lang, source, rate) AS total
  FROM wt GROUP BY lang, source, rate, bucket),
qb AS (
  SELECT lang, source, rate, min(bucket) FILTER (WHERE 4 * upto >= total) AS b1, min(bucket) FILTER (WHERE 4 * upto >= 3 * total) AS b3
  FROM up GROUP BY lang, source, rate),
f AS (
  SELECT *, CASE WHEN b1 = -1000000 THEN 0e0 ELSE exp(b1 * {_STEP}) * 0.99e0 END AS q1,
         CASE WHEN b3 = -1000000 THEN 0e0 ELSE exp(b3 * {_STEP}) * 0.99e0 END AS q3 FROM qb),
j AS (
  SELECT v.doc_id, v.nr, v.rate, v.v > f.q3 + 4e0 * greatest(q3 - q1, spread)
         OR (two_sided AND v.v < f.q1 - 4e0 * greatest(q3 - q1, spread)) AS outside
  FROM v JOIN f ON v.rate = f.rate AND f.lang IS NOT DISTINCT FROM v.lang AND f.source IS NOT DISTINCT FROM v.source),
b AS (
  SELECT doc_id, coalesce(string_agg(rate, ',' ORDER BY nr) FILTER (WHERE outside), '') AS broken
  FROM j GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND broken = '' AS kept, broken
FROM m JOIN b USING (doc_id)
"""

OP11 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.v, b.v, true), lambda z: z[1]::HUGEINT * z[2])), 0)::BIGINT AS score
  FROM e a CROSS JOIN e b
  WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, p.other_id AS positive_id,
       row_number() OVER (PARTITION BY anchor_id, p.other_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
       s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""

OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_CLASS}') AS w FROM documents),
n AS (SELECT r, doc_id, w, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM n),
m AS (SELECT r, doc_id, 100 - 75 + (75 * n * docs) // words AS m FROM n, total),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM n) GROUP BY r, term),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
i AS (
  SELECT i, item_id, term, count(*)::BIGINT AS times
  FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all({_LOWER}, '{_CLASS}')) AS term FROM benchmark)
  GROUP BY i, item_id, term),
w AS (
  SELECT i, item_id, term, times * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
  FROM i JOIN f USING (term), total),
s AS (
  SELECT i, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM w JOIN p USING (term) JOIN m USING (r)
  GROUP BY i, item_id, r, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY rank <= 10
"""

ORACLES = {"op1_quality_rules": OP1, "op2_mixing": OP2, "op4_url_filter": OP4, "op7_line_dedup": OP7, "op8_warc": OP8,
           "op9_decontaminate": OP9, "op11_hard_negatives": OP11, "op12_lexical_search": OP12}

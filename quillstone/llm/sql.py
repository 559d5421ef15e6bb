"""SQL for the corpus queries that SQL can express."""

#: doc_id, n_shingles, component_id, kept: all pairs through an inverted list of shingles, then their closure.
NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS node,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, node,
         CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words
), items AS (
  SELECT node, len(s) AS n, hash(unnest(s)) AS h FROM sets
), links AS (
  SELECT x.node AS a, y.node AS b
  FROM items x JOIN items y ON x.h = y.h AND x.node <> y.node
  GROUP BY x.node, y.node, x.n, y.n
  HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach AS (
  SELECT node AS a, node AS b FROM sets
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT r.a, min(s.doc_id) AS component_id FROM reach r JOIN sets s ON r.b = s.node GROUP BY r.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN least l ON s.node = l.a
"""

#: lang, rank, phrase, a, l, r, n, score: every phrase of up to four words counted, then cut, covered and ranked.
PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), every AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, CAST(s AS BIGINT) AS s, count(*) AS f
  FROM places CROSS JOIN range(1, 5) x(s)
  WHERE i + s - 1 <= len(w)
  GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM every WHERE s = 1 GROUP BY lang
), often AS (
  SELECT lang, phrase, s, f, string_split(phrase, ' ') AS w FROM every WHERE f >= 30
), cuts AS (
  SELECT lang, phrase, s, f, w, unnest(range(1, s)) AS k FROM often WHERE s > 1
), scores AS (
  SELECT c.lang, c.phrase, c.s, c.f AS a, x.f AS l, y.f AS r, c.k,
         CAST((CAST(2000000 AS HUGEINT) * c.f) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts c
  JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
), best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, f, w, s, unnest(range(2, s)) AS size FROM often WHERE s > 2
), covers AS (
  SELECT lang, array_to_string(w[p:p + size - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, f, w, size, unnest(range(1, s - size + 2)) AS p FROM inner_parts)
  GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN covers c ON c.lang = b.lang AND c.phrase = b.phrase
  WHERE c.longer IS NULL OR CAST(100 AS HUGEINT) * c.longer < CAST(80 AS HUGEINT) * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT r.lang, CAST(r.rank AS BIGINT) AS rank, r.phrase, CAST(r.a AS BIGINT) AS a, CAST(r.l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r, t.n, r.score
FROM ranked r JOIN totals t ON t.lang = r.lang
WHERE r.rank <= 2000
"""

#: part, filter_order, step and counters: every filter told of every document, then all orders of the five.
FILTER_AUDIT = r"""
WITH texts AS (
  SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS text FROM documents
), least AS (
  SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text
), cut AS (
  SELECT t.part, t.doc_id, t.text, l.first_id, regexp_extract_all(t.text, '[^\x20\x09-\x0D]+') AS w
  FROM texts t JOIN least l ON l.text = t.text
), fails AS (
  SELECT c.part, c.doc_id,
         [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
          100 * len(regexp_replace(c.text, '[^A-Z]', '', 'g')) > 10 * len(c.text),
          regexp_matches(c.text, '[#$%&*|]'), coalesce(c.doc_id > c.first_id, false)] AS f
  FROM cut c
), said AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), rows_of AS (
  SELECT f.part, f.f, coalesce(s.good, false) AS good, coalesce(s.toxic, false) AS toxic, count(*) AS n
  FROM fails f LEFT JOIN said s ON s.doc_id = f.doc_id GROUP BY ALL
), letters AS (
  SELECT unnest(range(1, 6)) AS i
), orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT o, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, unnest(range(1, 6)) AS step FROM orders
), told AS (
  SELECT r.part, s.filter_order, s.step, s.o[s.step] AS i, r.n, r.good, r.toxic,
         r.f[s.o[s.step]] AS own,
         len(list_filter(s.o[1:s.step - 1], lambda x: r.f[x])) > 0 AS earlier,
         len(list_filter(r.f, lambda x: x)) AS failed
  FROM rows_of r CROSS JOIN steps s
), summed AS (
  SELECT part, filter_order, step, i,
         sum(CASE WHEN NOT own AND NOT earlier THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN own AND NOT earlier THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN own AND earlier THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN own AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN own AND NOT earlier AND good THEN n ELSE 0 END) AS good_lost,
         sum(CASE WHEN own AND NOT earlier AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM told GROUP BY ALL
), shares AS (
  SELECT part, i, sum(removed) AS shapley FROM summed GROUP BY part, i
)
SELECT s.part, s.filter_order, CAST(s.step AS INTEGER) AS step,
       CAST(s.kept AS BIGINT) AS kept, CAST(s.removed AS BIGINT) AS removed, CAST(s.redundant AS BIGINT) AS redundant,
       CAST(s.unique_fails AS BIGINT) AS unique_fails, CAST(s.good_lost AS BIGINT) AS good_lost,
       CAST(s.toxic_lost AS BIGINT) AS toxic_lost, CAST(h.shapley AS BIGINT) AS shapley
FROM summed s JOIN shares h ON h.part = s.part AND h.i = s.i
"""

#: page_id, payload_bytes, payload_digest, record_type, refers_to; SHA-1 in base32 is put together from five bits at a time.
WARC_PAGES = r"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), largest AS (
  SELECT html, max(page_id) AS last_id FROM payloads GROUP BY html
), bits AS (
  SELECT hex, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', substr(hex, i, 1)) - 1) + 1, 4)), '') AS b
  FROM (SELECT DISTINCT hex FROM payloads)
), digests AS (
  SELECT hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(1, 6), lambda k: CAST(substr(b, 5 * i + k, 1) AS INTEGER) * (1 << (5 - k)))) AS BIGINT), 1)), '') AS payload_digest
  FROM bits
)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, d.payload_digest,
       CASE WHEN l.last_id IS NULL OR p.page_id = l.last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN l.last_id IS NULL OR p.page_id = l.last_id THEN NULL ELSE l.last_id END AS refers_to
FROM payloads p JOIN largest l ON l.html = p.html JOIN digests d ON d.hex = p.hex
"""

"""SQL that gives the rows of op4, op9, op10, op11 and op13 on whole tables, for comparison.

NEAR_DUPLICATES joins all pairs of documents that share a shingle, SUFFIXES makes a row of every byte, RUNS joins all
pairs of equal stretches of 16 words of a document (any run has such a pair at the distance of its period): they are for small tables.
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(g) AS g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), comp(node, component) USING KEY (node) AS (
  SELECT DISTINCT a AS node, a AS component FROM ways
  UNION (SELECT e.a, min(x.component) FROM comp x JOIN ways e ON e.b = x.node JOIN recurring.comp o ON o.node = e.a WHERE x.component < o.component GROUP BY e.a)
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON node = d.doc_id
"""

SUFFIXES = r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents
), w AS (
  SELECT doc_id, p, md5(array_slice(b, p + 1, p + 100)) AS g FROM (SELECT doc_id, b, unnest(range(0, n_bytes - 99)) AS p FROM d WHERE n_bytes >= 100)
), r AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM w) WHERE k > 1
), t AS (
  SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS new FROM r
), u AS (
  SELECT doc_id, p, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM t
), spans AS (
  SELECT doc_id, span, min(p) AS lo, max(p) + 100 AS hi FROM u GROUP BY ALL
), gaps AS (
  SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b, hi - lo AS n, true AS removed FROM spans
  UNION ALL SELECT doc_id, max(hi), NULL, 0, false FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(hex(array_slice(d.b, a + 1, coalesce(gaps.b, n_bytes))), '' ORDER BY a) AS k, CAST(sum(n) AS BIGINT) AS n_removed, count(*) FILTER (removed) AS n_spans FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(sha256(unhex(k)), sha256(b)) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

WARC = r"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS INTEGER) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
"""

EXACT = r"""
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, row_number() OVER (t ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))
"""

RUNS = r"""
WITH b AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0, list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(CAST(doc_id AS VARCHAR), '.'), lambda c: CAST(unicode(c) AS BIGINT))) AS bytes FROM documents
), h AS (
  SELECT doc_id, w0, len(w0) AS n, xor(list_reduce(bytes, lambda c, v: list_reduce(list_prepend(xor(c, v), CAST(range(0, 8) AS BIGINT[])), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS h FROM b
), g AS (
  SELECT *, h // 10 AS g, CASE WHEN n > 0 AND h % 10 = 0 THEN (h // 10) % n END AS a FROM h
), d AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w0 ELSE list_transform(range(0, n), lambda i: w0[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) END AS w FROM g
), grams AS (
  SELECT doc_id, n, i, md5(array_to_string(w[i + 1:i + 16], ' ')) AS gram FROM (SELECT *, unnest(range(0, n - 15)) AS i FROM d WHERE n >= 24)
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON y.doc_id = x.doc_id AND y.gram = x.gram AND y.i > x.i WHERE 3 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, q, min(i) AS s, max(i) + 16 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs) GROUP BY doc_id, q, k
), runs AS (
  SELECT doc_id, s AS start, e - s AS length, min(q) AS period FROM islands WHERE e - s >= greatest(24, 3 * q) GROUP BY doc_id, s, e
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    arg_min({'start': start, 'length': length, 'period': period}, (-CAST(length AS DOUBLE) / period, start, period)) AS r FROM runs GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM d) ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, r.start AS start, r.length AS length, r.period AS period, CAST(1000 * r.length // r.period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

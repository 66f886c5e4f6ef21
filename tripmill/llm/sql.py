"""What some of the queries must return, as DuckDB SQL."""

from __future__ import annotations

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: the digits of base 32

#: SHA-1 in base 32, five hexadecimal digits at a time; the page with the smallest id of each payload is the response.
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p),
n AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT)) AS five FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(five, lambda x: substr('{_DIGITS}', (x >> 15) + 1, 1) || substr('{_DIGITS}', ((x >> 10) & 31) + 1, 1)
    || substr('{_DIGITS}', ((x >> 5) & 31) + 1, 1) || substr('{_DIGITS}', (x & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM n"""

#: Bytes are pairs of hexadecimal digits; a window is the digest of 400 of them.
REPEATED_BYTES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, x, CAST(length(x) // 2 AS BIGINT) AS n FROM d),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS key FROM s, unnest(range(greatest(0, n - 399))) t(i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY key) AS times FROM w),
r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c WHERE times > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
u AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM u),
e AS (SELECT k.doc_id, count(*) AS spans, sum(b - a) AS removed, max(b) AS last,
  string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM k JOIN s USING (doc_id) GROUP BY k.doc_id)
SELECT s.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN e.doc_id IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM s LEFT JOIN e USING (doc_id)"""

#: A window is its 50 words joined by spaces.
REPEATED_WORDS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS key FROM d, unnest(range(1, greatest(1, len(w) - 48))) t(i)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key) AS first FROM p) WHERE doc_id > first),
g AS (SELECT DISTINCT doc_id, j FROM f, unnest(range(i, i + 50)) t(j)),
a AS (SELECT doc_id, j, w[j] AS word FROM d, unnest(range(1, len(w) + 1)) t(j)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM a ANTI JOIN g USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs by common shingles; components by all that is reachable.
NEAR_SETS = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS x
  FROM d, unnest(range(1, greatest(2, len(w)))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT u, v FROM c JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
r(doc_id, place) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.place),
f AS (SELECT doc_id, min(place) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM f LEFT JOIN n USING (doc_id)"""


def _crc(hex_bytes: str) -> str:
    """SQL for the CRC-32 of the bytes written as hexadecimal digits in ``hex_bytes``; ``crc_of`` has a value for each byte."""
    byte = f"CAST('0x' || substr({hex_bytes}, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)"
    listed = f"list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length({hex_bytes}) // 2), lambda i: {byte}))"
    return f"xor(list_reduce({listed}, lambda a, b: xor(a >> 8, crc_of[CAST(xor(a & 255, b) AS BIGINT) + 1])), CAST(4294967295 AS BIGINT))"


#: CRC-32 from its polynomial, 3988292384 (fixed value). Words one symbol apart meet by the word without that symbol and its place.
SPELLING = rf"""
WITH RECURSIVE t0(i, c, k) AS (SELECT i, CAST(i AS BIGINT), 0 FROM range(256) r(i) UNION ALL
  SELECT i, xor(c >> 1, CASE WHEN c & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END), k + 1 FROM t0 WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS crc_of FROM t0 WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
kinds AS (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY doc_id, run),
keyed AS (SELECT run, times, hex(encode(doc_id || ':' || run)) AS x FROM kinds),
hashed AS (SELECT run, times, {_crc('x')} AS h FROM keyed, tab),
spoilt AS (SELECT times, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) r(i)),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, v.word, v.n FROM less l JOIN v ON v.word = l.rest UNION SELECT v.word, l.word, l.n FROM less l JOIN v ON v.word = l.rest),
best AS (SELECT word, count(*) AS n_near, arg_max(other, (m, -place)) AS other, max(m) AS m
  FROM (SELECT *, row_number() OVER (ORDER BY encode(other)) AS place FROM pairs) GROUP BY word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM formed WHERE form IS NULL
  UNION ALL SELECT f.word, c.root FROM chain c JOIN formed f ON f.form = c.word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN chain USING (word)"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: Scores of all documents that share a term with an item.
RANKED = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
g AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
p AS (SELECT row, doc_id, n, unnest(t) AS term FROM (SELECT row_number() OVER () AS row, doc_id, t, len(t) AS n FROM d)),
f AS (SELECT row, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY row, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, g GROUP BY term, docs),
s AS (SELECT item_id, row, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
  FROM f JOIN w USING (term) JOIN q USING (term), g GROUP BY item_id, row, doc_id),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10"""

"""DuckDB SQL for the registered queries of this subpackage that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op2_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w),
k AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 19], ' ')) AS h FROM g),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS rn FROM k),
gone AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(s, s + 20)) AS i FROM f WHERE rn > 1) GROUP BY doc_id),
r AS (SELECT w.doc_id, ws, coalesce(gone, []::BIGINT[]) AS gone FROM w LEFT JOIN gone USING (doc_id)),
e AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
x AS (SELECT doc_id, unnest(gone) AS i FROM gone),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM e ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT r.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM r LEFT JOIN t USING (doc_id)
"""

ORACLE["op7_benchmark_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
n AS (SELECT item_id, ws, least(13, len(ws)) AS k FROM b WHERE len(ws) > 0),
i AS (SELECT DISTINCT item_id, k, array_to_string(ws[s:s + k - 1], ' ') AS h FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM n)),
sizes AS (SELECT DISTINCT k FROM i),
w AS (SELECT doc_id, k, s, array_to_string(ws[s:s + k - 1], ' ') AS h FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, sizes)),
m AS (SELECT doc_id, s, w.k, item_id FROM w JOIN i ON w.k = i.k AND w.h = i.h),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLE["op3_line_dedup"] = r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, r.top IS NOT NULL AND r.top <> doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

ORACLE["op6_url_filter"] = r"""
WITH b AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM b),
rules(rule, h, q, action) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
m AS (SELECT page_id, rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, length(h) DESC) AS rn
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND rn = 1
"""

ORACLE["op9_warc"] = r"""
WITH f AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY body) AS top FROM f)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes < 1000 OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < 1000 OR page_id = top THEN NULL ELSE top END AS refers_to
FROM g
"""

ORACLE["op1_embedding_dedup"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, id = component_id AS kept FROM comp LEFT JOIN n ON id = a
"""

ORACLE["op10_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 5, 0) + 2)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 10 * c >= 8 * (na.n + nb.n - c)),
reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
k AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT id AS doc_id, coalesce(n_links, 0) AS n_links, component_id, id = component_id AS kept FROM comp LEFT JOIN k ON id = a
"""

# A crc32 is the exclusive or of one number per byte and its distance from the end, and one for the length.
ORACLE["op12_spelling_variants"] = r"""
WITH RECURSIVE t(x, i, v) AS (SELECT b, 0, b FROM (SELECT unnest(range(0, 256)) AS b) UNION ALL SELECT x, i + 1, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END) FROM t WHERE i < 8),
base AS (SELECT x, v FROM t WHERE i = 8),
far(x, k, v) AS (SELECT x, 0, v FROM base UNION ALL SELECT far.x, k + 1, xor(base.v, far.v >> 8) FROM far JOIN base ON base.x = far.v & 255 WHERE k < 120),
empty(k, v) AS (SELECT 0, 4294967295 UNION ALL SELECT k + 1, xor(base.v, empty.v >> 8) FROM empty JOIN base ON base.x = empty.v & 255 WHERE k < 120),
low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
r AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z\x{C0}-\x{FF}]{6,}')) AS w FROM low) GROUP BY ALL),
m AS (SELECT row_number() OVER () AS i, w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS h FROM r),
b AS (SELECT i, len(h) // 2 AS size, unnest(range(0, len(h) // 2)) AS p, h FROM m),
c AS (SELECT i, size, bit_xor(far.v) AS v FROM b JOIN far ON far.x = CAST('0x' || substr(h, 2 * p + 1, 2) AS BIGINT) AND far.k = size - 1 - p GROUP BY i, size),
d AS (SELECT w, n, xor(xor(c.v, empty.v), 4294967295) AS h FROM m JOIN c USING (i) JOIN empty ON empty.k = size),
k AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM d),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM k WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
pair AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT cut.word, v.word FROM cut JOIN v ON cut.rest = v.word UNION SELECT v.word, cut.word FROM cut JOIN v ON cut.rest = v.word),
near AS (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, encode(b)) AS nth, count(*) OVER (PARTITION BY a) AS n_near FROM pair JOIN v ON b = word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near.n >= 5 * v.n THEN b END AS form, CASE WHEN near.n >= 5 * v.n THEN near.n END AS form_n FROM v LEFT JOIN near ON a = v.word AND nth = 1),
chain(word, last, deep) AS (SELECT word, word, 0 FROM f UNION ALL SELECT chain.word, form, deep + 1 FROM chain JOIN f ON last = f.word WHERE form IS NOT NULL),
ends AS (SELECT word, arg_max(last, deep) AS root FROM chain GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""

# The pages of the driver tables keep their main text in one article; the operator doesn't know that.
ORACLE["op11_html_main_text"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(p|br|h1)>', ' ', 'g'), '</?b>', '', 'g') AS body FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(body, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS body FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(body, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""

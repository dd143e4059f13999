"""DuckDB SQL of the queries in ``more_queries``."""

from __future__ import annotations

from .functions import fixed_values as fv
from .more_queries import ID_TEXT, OTP_TEXT, PLEA
from .oracle import FP, FRENCH, HOSTS, JUNK, LINKS, ORACLE, SEEN, THREATS, TPLS


def _masked(lead: str, digits: int, mask: str) -> str:
    number = f"lpad(((doc_id + 1) % {10**digits})::VARCHAR, {digits}, '7')"
    return f"CASE WHEN doc_id % 3 = 0 THEN 'Nr ' || {number} ELSE '{lead}{mask}' END || ' xin cảm ơn'"


ORACLE["otp_masks"] = f"SELECT doc_id, {_masked(OTP_TEXT, 6, '<OTP>')} AS text FROM documents"
ORACLE["masked_sink"] = ORACLE["otp_masks"]
ORACLE["id_masks"] = f"SELECT doc_id, {_masked(ID_TEXT, 12, '<ID>')} AS text FROM documents"
ORACLE["listed_domains"] = f"WITH {HOSTS} SELECT DISTINCT parent AS domain FROM hosts WHERE lang <> 'fr'"
ORACLE["threat_matches"] = f"""WITH {THREATS} SELECT r.msg_id, CASE WHEN blocked THEN f.host ELSE '' END AS blocked_hosts,
CASE WHEN list_contains(reasons, 'url_brand_impersonation') THEN r.url ELSE '' END AS brand_links, array_to_string(reasons, ',') AS url_reasons
FROM ri r JOIN fixed f ON f.msg_id = r.msg_id"""
ORACLE["csv_round_trip"] = "SELECT doc_id, md5(text) AS digest, '' AS note FROM documents"
ORACLE["source_registry"] = f"""SELECT 's' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'rss' ELSE 'domain_list' END AS kind,
CASE WHEN s_suppkey % 5 = 0 THEN 7 ELSE {fv.INTEL_MAX_ITEMS} END::BIGINT AS max_items, 0::BIGINT AS keywords FROM supplier WHERE s_suppkey % 3 <> 0"""
ORACLE["row_shapes"] = """SELECT 'msg_' || lpad(doc_id::VARCHAR, 6, '0') AS key, CASE WHEN lang = 'de' THEN 'extra_cells' ELSE 'missing_cells' END AS rule
FROM documents JOIN labels USING (doc_id) WHERE lang = 'de' OR toxic = 1"""
ORACLE["submitted_domains"] = rf"WITH {LINKS} SELECT msg_id AS ord, regexp_replace(host, '^www\.', '') AS domain, 'form' AS source_url FROM fixed"
ORACLE["submitted_texts"] = f"""WITH {LINKS}, q AS (SELECT msg_id, 'please open Check ' || raw || ' now' AS inside FROM fixed)
SELECT msg_id AS ord, 0::BIGINT AS part, 'They wrote “' || inside || '” to me' AS text FROM q UNION ALL SELECT msg_id, 1, inside FROM q"""
ORACLE["training_texts"] = f"SELECT doc_id AS id, {_masked(OTP_TEXT, 6, '<OTP>')} AS text, (doc_id % 3)::BIGINT AS label_id FROM documents"
ORACLE["prediction_checks"] = f"SELECT id, true AS known, true AS whole FROM ({ORACLE['stratified_split']}) WHERE split = 'test'"
ORACLE["rejected_before"] = f"""WITH {HOSTS}, {TPLS}, f AS (SELECT id, {FP} AS fp FROM b WHERE len({FP}) > 0),
n AS (SELECT DISTINCT x.id FROM f x JOIN f y ON substr(y.id, 5)::BIGINT % 2 = 0
    AND len(list_intersect(x.fp, y.fp)) >= 0.8 * len(list_distinct(list_concat(x.fp, y.fp))))
SELECT 'blocked_domains' AS "table", parent AS key, 'rejected_before' AS rule FROM (SELECT DISTINCT parent FROM hosts WHERE lang = 'fr')
UNION ALL SELECT 'scam_templates', id, 'rejected_before' FROM n"""
# Each half of the pages is scored with the tables of its time; the second version lists the French domains too.
_second = ORACLE["score_without_model"].replace(JUNK, JUNK.replace("junk AS (", "junk1 AS (", 1) + ", junk AS (SELECT domain FROM junk1 UNION SELECT domain FROM french)")
_second = _second.replace(f", {FRENCH}", "", 1).replace(JUNK.replace("junk AS (", "junk1 AS (", 1), FRENCH + ", " + JUNK.replace("junk AS (", "junk1 AS (", 1), 1)
ORACLE["stream_scores_by_version"] = f"""SELECT * FROM (SELECT *, 1::BIGINT AS intel_version FROM ({ORACLE["score_without_model"]}) WHERE msg_id % 2 = 0)
UNION ALL BY NAME SELECT *, 2::BIGINT AS intel_version FROM ({_second}) WHERE msg_id % 2 = 1"""
ORACLE["stream_fresh_texts"] = """WITH RECURSIVE o AS (SELECT user_id AS client, event_id, event_type || ' ' || (length(props) // 8) AS key,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s(client, n, event_id, fresh, held) AS (SELECT client, n, event_id, true, [key] FROM o WHERE n = 1
  UNION ALL SELECT o.client, o.n, o.event_id, NOT list_contains(held, key),
    CASE WHEN list_contains(held, key) THEN held WHEN len(held) >= 2 THEN list_append(held[2:], key) ELSE list_append(held, key) END
  FROM s JOIN o ON o.client = s.client AND o.n = s.n + 1)
SELECT client, event_id, fresh FROM s"""
ORACLE["client_windows"] = """WITH RECURSIVE s(client, t) AS (SELECT user_id, min(ts) FROM events GROUP BY 1
  UNION ALL SELECT s.client, min(e.ts) FROM s JOIN events e ON e.user_id = s.client AND e.ts >= s.t + INTERVAL 1 DAY GROUP BY s.client),
w AS (SELECT user_id AS client, event_id, ts, (SELECT max(t) FROM s WHERE s.client = user_id AND s.t <= ts) AS start FROM events)
SELECT client, event_id, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS window_start, row_number() OVER (PARTITION BY client, start ORDER BY ts, event_id) > 3 AS refused FROM w"""
ORACLE["stream_client_windows"] = ORACLE["client_windows"]

# quotes in the pages' own paragraphs, beside the one the queries add
_block = """trim(regexp_replace(replace(replace(regexp_replace(x, '</?b>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'))"""
OWN_QUOTES = f"""qz AS (SELECT page_id, CAST(sum(len(regexp_extract_all(t, '[“"«]([^”"»]{{30,600}})[”"»]'))) AS BIGINT) AS own FROM (SELECT page_id, {_block} AS t FROM
    (SELECT page_id, unnest(regexp_split_to_array(replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<br>', ' '), '</?(p|h1)>')) AS x FROM pages))
    WHERE length(t) >= {fv.MIN_PARAGRAPH_CHARS} GROUP BY 1)"""
_read = SEEN.replace(HOSTS, HOSTS + ", h AS (SELECT * FROM hosts WHERE NOT contains(url, '#top'))", 1).replace("FROM hosts GROUP BY 1, 2, 3", "FROM h GROUP BY 1, 2, 3", 1)
ORACLE["intel_update"] = f"""WITH {_read}, {OWN_QUOTES}, per AS (SELECT lang AS source, count(*) FILTER (NOT contains(url, '#top')) AS articles,
    count(DISTINCT CASE WHEN NOT contains(url, '#top') THEN parent END) AS domains, CAST(coalesce(sum(1 + coalesce(own, 0)) FILTER (NOT contains(url, '#top') AND lang IN ('en', 'de')), 0) AS BIGINT) AS texts,
    count(*) FILTER (contains(url, '#top')) AS errors FROM hosts LEFT JOIN qz USING (page_id) GROUP BY 1),
tot AS (SELECT sum(articles) AS articles, sum(errors) AS errors, coalesce(max(1) FILTER (source = 'en' AND articles > 0), 0) AS en, coalesce(max(1) FILTER (source = 'de' AND articles > 0), 0) AS de FROM per),
cnt AS (SELECT count(*) FILTER (outcome = 'new') AS new, count(*) FILTER (outcome = 'allowed') AS allowed, count(*) FILTER (outcome = 'rejected') AS rejected FROM oc)
SELECT 'domain' AS kind, source, domain AS name, 1::BIGINT AS n FROM oc WHERE outcome = 'new'
UNION ALL SELECT 'template', 'en', 'tpl_000008', 1 FROM tot WHERE en = 1
UNION ALL SELECT 'report', source, u.name, u.n FROM per, LATERAL (VALUES ('articles', articles), ('domains', domains), ('texts', texts), ('errors', errors)) u(name, n)
UNION ALL SELECT 'counter', '', u.name, u.n::BIGINT FROM tot, cnt, LATERAL (VALUES ('articles', tot.articles), ('errors', tot.errors), ('new_domains', new), ('skipped_allowed', allowed),
    ('new_templates', en), ('skipped_rejected', rejected + de)) u(name, n)"""
ORACLE["source_collection"] = f"""WITH {HOSTS}, {OWN_QUOTES}, p AS (SELECT lang AS source, ascii(lang) AS o, page_id, parent, contains(url, '#top') AS failed, length(parent) % 2 = 0 AS barred FROM hosts),
q AS (SELECT source, o, page_id, substr(parent, 1, 4) AS w FROM p WHERE NOT failed AND NOT barred AND source <> 'fr'),
f AS (SELECT source, w, min(page_id) AS first FROM q GROUP BY 1, 2),
c AS (SELECT q.source, count(*) FILTER (page_id = first) AS added, count(*) FILTER (page_id <> first) AS duplicate FROM q JOIN f USING (source, w) GROUP BY 1),
per AS (SELECT source, count(*) FILTER (NOT failed AND NOT barred) AS articles, count(*) FILTER (failed AND NOT barred) + count(DISTINCT CASE WHEN barred THEN parent END) AS errors,
    count(*) FILTER (barred) AS barred_pages, count(*) FILTER (failed AND NOT barred) AS failed_pages,
    CAST(coalesce(sum(own) FILTER (NOT failed AND NOT barred AND source <> 'fr'), 0) AS BIGINT) AS invalid FROM p LEFT JOIN qz USING (page_id) GROUP BY 1)
SELECT 'report' AS kind, source, u.name, u.n FROM per LEFT JOIN c USING (source), LATERAL (VALUES ('articles', articles), ('added', coalesce(added, 0)), ('duplicate', coalesce(duplicate, 0)), ('name', 0), ('invalid', invalid), ('errors', errors)) u(name, n)
UNION ALL SELECT 'counter', '', u.name, u.n FROM (SELECT coalesce(sum(added), 0)::BIGINT AS a, coalesce(sum(duplicate), 0)::BIGINT AS b FROM c), (SELECT sum(barred_pages)::BIGINT AS x, sum(failed_pages)::BIGINT AS y, sum(invalid)::BIGINT AS z FROM per),
    LATERAL (VALUES ('added', a), ('duplicate', b), ('name', 0), ('invalid', z), ('barred_pages', x), ('failed_pages', y)) u(name, n)"""

ORACLE["numeric_hosts"] = """WITH n AS (SELECT page_id, (page_id * 2654435761) % 4294967296 AS n FROM pages)
SELECT page_id, concat_ws('.', (n >> 24) & 255, (n >> 16) & 255, (n >> 8) & 255, n & 255) AS host FROM n"""
ORACLE["header_findings"] = """SELECT lang || '.csv' AS "table", 'header' AS rule FROM (SELECT DISTINCT lang FROM documents WHERE lang IN ('fr', 'de')) UNION ALL SELECT 'none.csv', 'missing_file'"""

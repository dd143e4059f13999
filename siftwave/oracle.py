"""DuckDB SQL for the registered queries, written from the rules and not from the Spark plans.

RE2 has no look-around, so the number masks have no SQL here; they are covered by
golden cases in the tests. Unicode word characters are spelled out as classes.
"""

from __future__ import annotations

from .functions import fixed_values as fv

ORACLE: dict[str, str] = {}

WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}"
SPACE = r"[\s\v\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HIDDEN = r"[\x{ad}\x{200b}-\x{200d}\x{2060}\x{feff}]"
TAIL = r"""[.,;:!?)\]}"'']+$"""
URL = rf"(?i:https?://|www\.)[^\s<>\"]+"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(nfc_normalize({c}), '{HIDDEN}', '', 'g'), '{SPACE}+', ' ', 'g'))"


def fold(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '{SPACE}+', ' ', 'g')))"


def key(c: str) -> str:
    return f"substr(sha256({fold(c)}), 1, 16)"


def tokens(c: str) -> str:
    return (
        f"list_transform(regexp_extract_all(nfc_normalize({c}), '<[A-Z]+>|[{WORD}]+'), "
        "lambda t: CASE WHEN t[1] = '<' THEN t ELSE lower(t) END)"
    )


def shingle_cte(name: str, table: str, id_sql: str, text_sql: str) -> str:
    """CTE ``name(id, sh)`` with the distinct word trigrams."""
    return f"""{name}_t AS (SELECT {id_sql} AS id, {tokens(text_sql)} AS w FROM {table}),
{name} AS (SELECT id, CASE
    WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS sh FROM {name}_t)"""


DOCS = shingle_cte("d", "documents", "doc_id", "text")
TPLS = shingle_cte("b", "benchmark", "printf('tpl_%06d', item_id)", "text")


def covered(threshold: float) -> str:
    return f"""WITH {DOCS}, {TPLS},
reps AS (SELECT min(id) AS id, any_value(list_sort(sh)) AS sh FROM b WHERE len(sh) > 0 GROUP BY list_sort(sh)),
dx AS (SELECT id, unnest(sh) AS s FROM d), bx AS (SELECT id, len(sh) AS n, unnest(sh) AS s FROM reps),
m AS (SELECT dx.id AS doc_id, bx.id AS tpl_id, count(*) / any_value(bx.n)::DOUBLE AS coverage
      FROM dx JOIN bx USING (s) GROUP BY 1, 2 HAVING count(*) / any_value(bx.n)::DOUBLE >= {threshold})"""


ORACLE["template_best_match"] = covered(0.6) + """
SELECT doc_id, tpl_id, round(coverage, 9) AS coverage FROM m
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY coverage DESC, tpl_id) = 1"""
ORACLE["template_coverage"] = covered(0.3) + " SELECT doc_id, tpl_id, round(coverage, 9) AS coverage FROM m"

NEAR = """r AS (SELECT min(id) AS id, any_value(sh) AS sh FROM d WHERE len(sh) > 0 GROUP BY list_sort(sh)),
x AS (SELECT id, len(sh) AS n, unnest(sh) AS s FROM r),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m
      FROM x a JOIN x b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
e AS (SELECT id_a, id_b, c / (n + m - c)::DOUBLE AS jaccard FROM p WHERE c / (n + m - c)::DOUBLE >= 0.8)"""
REPS = f"{DOCS}, {NEAR}"
WALK = """linked AS (SELECT id, row_number() OVER (ORDER BY id) AS k
           FROM (SELECT id_a AS id FROM e UNION SELECT id_b FROM e)),
near AS (SELECT l.k, l.id, list(e.id_a) FILTER (e.id_a IS NOT NULL) AS before
         FROM linked l LEFT JOIN e ON e.id_b = l.id GROUP BY 1, 2),
walk(k, kept) AS (
    SELECT 0::BIGINT, []::BIGINT[]
    UNION ALL
    SELECT near.k, CASE WHEN list_has_any(walk.kept, coalesce(near.before, []::BIGINT[])) THEN walk.kept ELSE list_append(walk.kept, near.id) END
    FROM walk JOIN near ON near.k = walk.k + 1)"""
ORACLE["near_duplicate_pairs"] = f"WITH {REPS} SELECT id_a, id_b, round(jaccard, 9) AS jaccard FROM e"
ORACLE["copy_groups"] = f"""WITH {DOCS}
SELECT id, min(id) OVER (PARTITION BY list_sort(sh)) AS rep FROM d WHERE len(sh) > 0"""
ORACLE["greedy_dedup"] = f"""WITH RECURSIVE {REPS}, {WALK}
SELECT id FROM r WHERE id NOT IN (SELECT id FROM linked)
UNION ALL SELECT unnest(kept) FROM (SELECT kept FROM walk ORDER BY k DESC LIMIT 1)
UNION ALL SELECT id FROM d WHERE len(sh) = 0"""
FP = "list_sort(list_distinct(list_transform(sh, lambda s: substr(sha256(s), 1, 12))))"
ORACLE["fingerprints"] = f"""WITH {DOCS}, f AS (SELECT id, {FP} AS fp FROM d)
SELECT id AS doc_id, len(fp) AS n, md5(array_to_string(fp, ' ')) AS digest FROM f"""
ORACLE["rejected_near_copies"] = f"""WITH {DOCS}, f AS (SELECT id, {FP} AS fp FROM d),
x AS (SELECT id, len(fp) AS n, unnest(fp) AS h FROM f),
t AS (SELECT x.* FROM x JOIN labels l ON l.doc_id = x.id AND l.toxic = 1),
p AS (SELECT x.id, t.id AS k, count(*) AS c, any_value(x.n) AS n, any_value(t.n) AS m FROM x JOIN t USING (h) GROUP BY 1, 2)
SELECT DISTINCT id AS doc_id FROM p WHERE c / (n + m - c)::DOUBLE >= 0.8"""
TURNS = shingle_cte("c", "conversations", "(conv_id, turn)", "text")
ORACLE["turn_similarity"] = f"""WITH {TURNS},
q AS (SELECT a.id[1] AS conv_id, a.id[2] AS turn, len(list_intersect(a.sh, b.sh)) AS c, len(a.sh) AS n, len(b.sh) AS m
      FROM c a JOIN c b ON b.id[1] = a.id[1] AND b.id[2] = a.id[2] + 1)
SELECT conv_id, turn, round(CASE WHEN n + m - c > 0 THEN c / (n + m - c)::DOUBLE ELSE 0 END, 9) AS jaccard,
       round(CASE WHEN n > 0 THEN c / n::DOUBLE ELSE 0 END, 9) AS coverage FROM q"""
ORACLE["token_counts"] = f"""WITH {DOCS} SELECT d.id AS doc_id, len(w) AS n_tokens, len(sh) AS n_shingles
FROM d JOIN d_t USING (id)"""
ORACLE["neighbour_words"] = """WITH t AS (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations),
p AS (SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: {'a': w[i], 'b': w[i+1]})) AS x FROM t WHERE len(w) > 1)
SELECT x.a AS a, x.b AS b, true AS near FROM p WHERE damerau_levenshtein(x.a, x.b) <= 1"""

# --- text ---------------------------------------------------------------------------
ORACLE["normalize_text"] = f"SELECT doc_id, length({norm('text')}) AS n, md5({norm('text')}) AS digest FROM documents"
ORACLE["message_errors"] = f"""SELECT doc_id, CASE WHEN NOT regexp_matches(text, '[^\\s]') THEN 'classification.empty_text'
ELSE 'classification.text_too_long' END AS error FROM documents
WHERE NOT regexp_matches(text, '[^\\s]') OR length({norm('text')}) > 2000"""
ORACLE["text_keys"] = f"SELECT doc_id, {key('text')} AS key FROM documents"
ORACLE["repeated_texts"] = f"""WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {fold('text')}) AS first FROM documents)
SELECT doc_id::VARCHAR AS doc_id, first::VARCHAR AS first_id FROM f WHERE doc_id <> first"""
EMAIL = rf"[{WORD}_.+-]+@[{WORD}_-]+(?:\.[{WORD}_-]+)+"
ORACLE["mask_email"] = f"""WITH m AS (SELECT doc_id, regexp_replace(text, '{EMAIL}', '<EMAIL>', 'g') AS t FROM documents)
SELECT doc_id, md5(t) AS digest, len(regexp_extract_all(t, '<EMAIL>')) AS n FROM m"""
ORACLE["email_texts"] = f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{EMAIL}')"
LINKS = """links AS (SELECT page_id AS msg_id, url AS page_url,
    replace(replace(url, '.example.com', '-vietcornbank.xyz'), '.example.net', '[.]example[.]net') AS raw FROM pages),
fixed AS (SELECT msg_id, page_url, raw, replace(raw, '[.]', '.') AS url, contains(raw, '[.]') AS hidden,
    regexp_extract(replace(raw, '[.]', '.'), '^https?://([^/?#]+)', 1) AS host FROM links)"""
ORACLE["refang_text"] = f"WITH {LINKS} SELECT msg_id, 'Check ' || url || ' now' AS text FROM fixed"
ORACLE["restore_links"] = ORACLE["refang_text"]
ORACLE["mask_links"] = f"WITH {LINKS} SELECT msg_id, 'Check <URL> now' AS text FROM fixed"
ORACLE["mask_keeping_links"] = f"WITH {LINKS} SELECT msg_id, 'Check ' || regexp_replace(url, '[?#].*$', '') || ' now' AS text FROM fixed"
ORACLE["links_present"] = "SELECT page_id AS msg_id, true AS has_url FROM pages"
ORACLE["name_candidates"] = """SELECT conv_id, turn FROM conversations
WHERE regexp_matches(text, '^\\p{Lu}') AND regexp_matches(text, '^\\p{L}')"""
ORACLE["keyword_texts"] = "SELECT doc_id FROM documents WHERE contains(lower(text), 'und ') OR contains(lower(text), 'para ')"
ORACLE["quoted_passages"] = """WITH q AS (SELECT doc_id, regexp_extract_all('“' || replace(text, chr(10), '” “') || '”', '[“"«]([^”"»]{30,600})[”"»]', 1) AS l FROM documents)
SELECT doc_id, p.o - 1 AS pos, md5(regexp_replace(p.v, '^\\s+|\\s+$', '', 'g')) AS digest FROM q, unnest(l) WITH ORDINALITY AS p(v, o)"""
ORACLE["page_blocks"] = f"SELECT conv_id, turn FROM conversations WHERE length(trim(regexp_replace(text, '{SPACE}+', ' ', 'g'))) BETWEEN 20 AND 2000"
ORACLE["parsed_codes"] = """SELECT doc_id, CASE WHEN toxic = 1 THEN 'scam' WHEN quality = 1 THEN 'normal' END AS label,
CASE WHEN toxic = 1 THEN 'telegram' END AS channel FROM labels"""

# --- links and hosts ----------------------------------------------------------------
ORACLE["url_hosts"] = "SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages"
ORACLE["literal_links"] = """SELECT page_id, 0::BIGINT AS pos, url FROM pages UNION ALL SELECT page_id, 1, 'www.x.vn/a' FROM pages"""
LINK = "regexp_replace(url, '[?#].*$', '')"
ORACLE["inspectable_links"] = f"SELECT page_id, {LINK} AS link FROM pages"
ORACLE["distinct_links"] = f"SELECT DISTINCT {LINK} AS link FROM pages"
ORACLE["unwrapped_redirects"] = "SELECT page_id, url AS target FROM pages"
ORACLE["normalized_domains"] = r"SELECT page_id, regexp_replace(regexp_extract(lower(url), '^https?://([^/?#:]+)', 1), '^www\.', '') AS domain FROM pages"
ORACLE["text_domains"] = rf"WITH {LINKS} SELECT msg_id, regexp_replace(host, '^www\.', '') AS domain FROM fixed"


def skeleton(c: str) -> str:
    return f"translate(replace(replace(lower({c}), 'rn', 'm'), 'vv', 'w'), '01i345', 'olleas')"


HOSTS = r"""hosts AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS lang,
    regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
    regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^(www|m|blog)\.', '') AS parent FROM pages)"""
JUNK = "junk AS (SELECT DISTINCT parent AS domain FROM hosts WHERE contains(parent, '-'))"
FRENCH = "french AS (SELECT DISTINCT parent AS domain FROM hosts WHERE lang = 'fr')"
ORACLE["skeletons"] = f"""WITH {HOSTS}, t AS (SELECT DISTINCT unnest(regexp_split_to_array(host, '[.-]')) AS token FROM hosts)
SELECT token, {skeleton('token')} AS skeleton FROM t"""


def parents(host: str, fewest: int) -> str:
    return (
        f"list_transform(range(1, len(string_split({host}, '.')) + {2 - fewest}), "
        f"lambda i: array_to_string(string_split({host}, '.')[i:], '.'))"
    )


ORACLE["blocked_links"] = f"""WITH {HOSTS}, {JUNK} SELECT DISTINCT page_id, host FROM hosts
WHERE list_has_any({parents('host', 2)}, (SELECT list(domain) FROM junk))"""
ORACLE["not_allowed_links"] = f"""WITH {HOSTS}, {FRENCH} SELECT DISTINCT page_id, host FROM hosts
WHERE NOT list_has_any({parents('host', 1)}, (SELECT list(domain) FROM french))"""
BRAND = f"""kw AS (SELECT k, {skeleton('k')} AS s FROM unnest([{quoted(fv.BRAND_KEYWORDS)}]) AS t(k)),
brands AS (SELECT host, bool_or(coalesce({skeleton('tok')} = s OR (length(k) >= 5 AND contains({skeleton('tok')}, s))
        OR (length(k) >= 8 AND damerau_levenshtein({skeleton('tok')}, s) <= 1), false)) AS brand
    FROM (SELECT DISTINCT host, unnest(regexp_split_to_array(host, '[._-]')) AS tok FROM fixed) CROSS JOIN kw
    WHERE tok <> '' GROUP BY host)"""
ORACLE["brand_imitations"] = f"""WITH {LINKS}, {BRAND} SELECT host, brand FROM brands"""
BY_HOST = f"""list_filter([CASE WHEN hidden THEN 'url_obfuscated' END,
    CASE WHEN list_contains([{quoted(fv.SHORTENER_HOSTS)}], host) THEN 'url_shortener' END,
    CASE WHEN regexp_matches(host, '(^|\\.)xn--') THEN 'url_punycode' END,
    CASE WHEN list_contains([{quoted(fv.SUSPICIOUS_TLDS)}], string_split(host, '.')[-1]) THEN 'url_suspicious_tld' END],
    lambda r: r IS NOT NULL)"""
ORACLE["url_findings"] = f"WITH {LINKS} SELECT msg_id, 0::BIGINT AS pos, url, unnest({BY_HOST}) AS reason FROM fixed"
ORACLE["described_reasons"] = f"""WITH {LINKS}, f AS (SELECT DISTINCT msg_id, unnest({BY_HOST}) AS reason FROM fixed),
t AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in fv.REASON_DESCRIPTIONS.items())}) AS v(code, text))
SELECT reason, msg_id, coalesce(t.text, reason) AS description FROM f LEFT JOIN t ON t.code = reason"""
TRUST = "CASE r " + " ".join(f"WHEN '{k}' THEN 1 - {v}" for k, v in fv.REASON_WEIGHTS.items()) + " ELSE 1 END"


def risk(reasons: str) -> str:
    return f"(1 - list_aggregate(list_append(list_transform(list_distinct({reasons}), lambda r: ({TRUST})::DOUBLE), 1::DOUBLE), 'product'))"


ORACLE["url_risk"] = f"WITH {LINKS} SELECT msg_id, round({risk(BY_HOST)}, 9) AS risk FROM fixed"
THREATS = f"""{LINKS}, {BRAND}, {HOSTS}, {JUNK}, {FRENCH},
th AS (SELECT f.msg_id, f.url, list_has_any({parents('f.host', 2)}, (SELECT list(domain) FROM junk)) AS blocked,
    list_concat({BY_HOST.replace('host', 'f.host')}, CASE WHEN b.brand
        AND NOT list_has_any({parents('f.host', 2)}, (SELECT list(domain) FROM junk))
        AND NOT list_has_any({parents('f.host', 2)}, (SELECT list(domain) FROM french)) THEN ['url_brand_impersonation'] ELSE [] END) AS reasons
    FROM fixed f JOIN brands b ON b.host = f.host),
ri AS (SELECT *, {risk('reasons')} AS risk, CASE WHEN blocked THEN ['url_blocklisted'] ELSE [] END AS listed FROM th)"""
ORACLE["link_verdicts"] = f"""WITH {THREATS} SELECT msg_id AS link_id,
CASE WHEN blocked OR risk >= 0.7 - 1e-9 THEN 'dangerous' WHEN len(reasons) > 0 THEN 'suspicious' ELSE 'safe' END AS verdict,
array_to_string(list_concat(listed, reasons), ',') AS reasons FROM ri"""
ORACLE["link_request_errors"] = """WITH t AS (SELECT user_id || '/' || event_type AS request_id, count(*) AS n, max(event_type) AS k FROM events GROUP BY 1)
SELECT request_id, CASE WHEN n > 50 THEN 'link_inspection.too_many_links' ELSE 'link_inspection.invalid_link' END AS error
FROM t WHERE n > 50 OR k = 'error'"""

# --- decision -----------------------------------------------------------------------


def fuse(normal: str, spam: str, scam: str, risk_sql: str, reasons: str) -> tuple[str, str, str]:
    """Label, confidence and reasons of the fusion rule."""
    p = f"(1 - (1 - {scam}) * (1 - {risk_sql}))"
    scam_case = f"{p} >= 0.7 - 1e-9"
    kept = f"(CASE WHEN {spam} > {normal} THEN {spam} ELSE {normal} END)"
    label = f"CASE WHEN {scam_case} THEN 'scam' WHEN {spam} > {normal} THEN 'spam' ELSE 'normal' END"
    confidence = f"CASE WHEN {scam_case} THEN {p} ELSE {kept} END"
    why = f"""CASE WHEN {scam_case} THEN list_concat(CASE WHEN {scam} >= 0.7 - 1e-9 THEN ['model_predicted_scam'] ELSE [] END, {reasons})
ELSE list_concat(list_concat(CASE WHEN {spam} > {normal} THEN ['model_predicted_spam'] ELSE [] END,
     CASE WHEN {p} > {kept} THEN ['scam_probability_below_threshold'] ELSE [] END), {reasons}) END"""
    return label, confidence, why


PREDICTED = """pr AS (SELECT page_id AS msg_id, (length(url) * 7) % 50 / 100.0::DOUBLE AS a, (length(url) * 3) % 50 / 100.0::DOUBLE AS b,
    (length(url) * 11) % 100 / 100.0::DOUBLE AS c FROM pages)"""
_l, _c, _w = fuse("a", "b", "c", "risk", "reasons")
ORACLE["score_link_messages"] = f"""WITH {THREATS}, {PREDICTED} SELECT msg_id, 'ok' AS status,
CASE WHEN blocked THEN 'scam' ELSE {_l} END AS label, round(CASE WHEN blocked THEN 0.99 ELSE {_c} END, 9) AS confidence,
array_to_string(CASE WHEN blocked THEN list_concat(listed, reasons) ELSE {_w} END, ',') AS reasons FROM ri JOIN pr USING (msg_id)"""
ORACLE["score_without_model"] = f"""WITH {THREATS}, s AS (SELECT *, blocked OR risk >= 0.7 - 1e-9 AS sure FROM ri)
SELECT msg_id, CASE WHEN sure THEN 'ok' ELSE 'classification.model_unavailable' END AS status, CASE WHEN sure THEN 'scam' END AS label,
round(CASE WHEN blocked THEN 0.99 WHEN sure THEN risk END, 9) AS confidence,
CASE WHEN sure THEN array_to_string(list_concat(listed, reasons), ',') END AS reasons FROM s"""
ORACLE["stream_scores"] = ORACLE["score_without_model"]
ORACLE["model_queue"] = f"WITH {THREATS} SELECT msg_id, 'Check <URL> now' AS masked FROM ri WHERE NOT blocked"
_r = """list_filter([CASE WHEN toxic = 1 THEN 'url_suspicious_tld' END, CASE WHEN quality = 0 THEN 'url_shortener' END], lambda r: r IS NOT NULL)"""
_l, _c, _w = fuse("a", "b", "c", risk("rs"), "rs")
ORACLE["fused_labels"] = f"""WITH q AS (SELECT doc_id, (n_chars % 40 / 100.0)::DOUBLE AS a, (n_chars % 30 / 100.0)::DOUBLE AS b, (n_chars % 100 / 100.0)::DOUBLE AS c,
{_r} AS rs FROM documents JOIN labels USING (doc_id))
SELECT doc_id, {_l} AS label, round({_c}, 9) AS confidence, array_to_string({_w}, ',') AS reasons FROM q"""
ORACLE["fallback_predictions"] = f"""WITH {PREDICTED} SELECT msg_id, CASE WHEN c >= 0.5 THEN a ELSE 1 END::DOUBLE AS normal,
CASE WHEN c >= 0.5 THEN b ELSE 0 END::DOUBLE AS spam, CASE WHEN c >= 0.5 THEN c ELSE 0 END::DOUBLE AS scam FROM pr"""
THIRDS = ", ".join(f"list_sum(list_transform(list_filter(range(1, len(embedding) + 1), lambda i: i % 3 = {k % 3}), lambda i: embedding[i]::DOUBLE)) AS {x}" for k, x in ((1, "a"), (2, "b"), (3, "c")))
ORACLE["softmax_scores"] = f"""WITH t AS (SELECT vec_id, {THIRDS} FROM embeddings), e AS (SELECT vec_id, exp(a) AS a, exp(b) AS b, exp(c) AS c FROM t)
SELECT vec_id, round(a / (a + b + c), 9) AS normal, round(b / (a + b + c), 9) AS spam, round(c / (a + b + c), 9) AS scam FROM e"""
ORACLE["argmax_labels"] = f"""WITH t AS (SELECT vec_id, {THIRDS} FROM embeddings)
SELECT vec_id, CASE WHEN a >= b AND a >= c THEN 'normal' WHEN b >= c THEN 'spam' ELSE 'scam' END AS label FROM t"""
ORACLE["llm_verdicts"] = """WITH v AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'scam' WHEN 'view' THEN 'spam' ELSE 'normal' END AS l,
least(greatest(value / 10, 0.5), 1) AS c FROM events WHERE event_type <> 'error')
SELECT event_id, round(CASE WHEN l = 'normal' THEN c ELSE (1 - c) / 2 END, 9) AS normal, round(CASE WHEN l = 'spam' THEN c ELSE (1 - c) / 2 END, 9) AS spam,
round(CASE WHEN l = 'scam' THEN c ELSE (1 - c) / 2 END, 9) AS scam FROM v"""

# --- dataset quality, split, evaluation -----------------------------------------------
LABELLED = """la AS (SELECT d.doc_id AS ord, 'msg_' || lpad(d.doc_id::VARCHAR, 6, '0') AS id, d.text,
    CASE WHEN l.toxic = 1 THEN 'scam' WHEN l.quality = 1 THEN 'normal' ELSE 'spam' END AS label,
    CASE WHEN l.toxic = 1 THEN 'job_scam' WHEN d.lang = 'fr' THEN 'other' ELSE '' END AS scam_type,
    CASE WHEN d.lang = 'de' THEN 'fax' ELSE 'sms' END AS channel, CASE WHEN d.source = 'src0' THEN 'synthetic' ELSE 'collected' END AS source,
    CASE WHEN d.lang = 'es' THEN '2026-02-30' ELSE '2026-02-28' END AS collected_at, CASE WHEN d.source = 'src1' THEN '' ELSE 'a1' END AS annotator
    FROM documents d JOIN labels l USING (doc_id))"""


def finding(rule: str, detail: str, where: str) -> str:
    return f"SELECT 'dataset' AS \"table\", id AS key, '{rule}' AS rule, 'error' AS severity, {detail} AS detail FROM la WHERE {where}"


ORACLE["category_findings"] = f"WITH {LABELLED} " + " UNION ALL ".join(
    [
        finding("scam_type_without_scam", "scam_type", "label <> 'scam' AND scam_type <> ''"),
        finding("channel", "channel", "channel = 'fax'"),
    ]
)
ORACLE["metadata_findings"] = f"WITH {LABELLED} " + " UNION ALL ".join(
    [finding("collected_at", "collected_at", "collected_at = '2026-02-30'"), finding("annotator", "''", "annotator = ''")]
)
REPEATED = """u AS (SELECT ord, id, first_value(ord) OVER (PARTITION BY id ORDER BY ord) AS fo,
      first_value(ord) OVER t AS ft, first_value(id) OVER t AS fid FROM s WINDOW t AS (PARTITION BY f ORDER BY ord))"""
ORACLE["uniqueness_findings"] = f"""WITH {LABELLED}, s AS (SELECT ord, substr(id, 1, 8) AS id, {fold('text')} AS f FROM la), {REPEATED}
SELECT id AS key, 'duplicate_id' AS rule, id AS detail FROM u WHERE ord <> fo
UNION ALL SELECT id, 'duplicate_text', fid FROM u WHERE ord <> ft"""
ORACLE["label_shares"] = f"""WITH {LABELLED} SELECT v.label, count(la.id) AS n, round(count(la.id) / (SELECT count(*) FROM la)::DOUBLE, 9) AS share
FROM (VALUES ('normal'), ('spam'), ('scam')) AS v(label) LEFT JOIN la ON la.label = v.label GROUP BY 1"""
ORACLE["distribution_findings"] = f"""WITH {LABELLED}, c AS (SELECT v.label, count(la.id) / (SELECT count(*) FROM la)::DOUBLE AS share
FROM (VALUES ('normal'), ('spam'), ('scam')) AS v(label) LEFT JOIN la ON la.label = v.label GROUP BY 1)
SELECT label AS key, 'label_share' AS rule, 'warning' AS severity FROM c WHERE share < 0.15
UNION ALL SELECT 'synthetic', 'synthetic_share', 'warning' FROM la HAVING avg(CASE WHEN source = 'synthetic' THEN 1.0 ELSE 0 END) > 0.2"""
ORACLE["repeated_ids"] = f"WITH {LABELLED} SELECT substr(id, 1, 9) AS key, count(*)::VARCHAR AS detail FROM la GROUP BY 1 HAVING count(*) > 1"
ORACLE["blocked_domain_findings"] = f"""WITH {HOSTS}, {FRENCH}, g AS (SELECT parent, min(lang) AS lang FROM hosts GROUP BY 1),
r AS (SELECT CASE WHEN lang = 'de' THEN upper(parent) ELSE parent END AS domain, lang FROM g)
SELECT domain AS key, 'not_canonical' AS rule FROM r WHERE lang = 'de'
UNION ALL SELECT domain, 'source_missing' FROM r WHERE lang = 'es'
UNION ALL SELECT domain, 'allowlisted' FROM r WHERE list_has_any({parents('domain', 1)}, (SELECT list(domain) FROM french))"""
NAMED_DOCS = shingle_cte("c", "documents", "printf('tpl_%06d', doc_id)", "text")
ORACLE["near_template_findings"] = f"""WITH {NAMED_DOCS},
g AS (SELECT id, min(id) OVER (PARTITION BY list_sort(sh)) AS rep, sh FROM c WHERE len(sh) > 0),
x AS (SELECT id, len(sh) AS n, unnest(sh) AS s FROM g WHERE id = rep),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m FROM x a JOIN x b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)
SELECT rep AS key, id AS detail FROM g WHERE id <> rep UNION ALL SELECT id_a, id_b FROM p WHERE c / (n + m - c)::DOUBLE >= 0.8"""
ORACLE["source_findings"] = f"""WITH {HOSTS} SELECT parent AS key, 'kind' AS rule FROM hosts WHERE lang = 'fr'
UNION ALL SELECT parent, 'https' FROM hosts WHERE NOT starts_with(url, 'https://')
UNION ALL SELECT parent, 'duplicate_name' FROM hosts GROUP BY parent HAVING count(*) > 1"""
ORACLE["allowlist_findings"] = rf"WITH {HOSTS} SELECT DISTINCT host AS key, 'not_canonical' AS rule FROM hosts WHERE starts_with(host, 'www.')"


def ranked(name: str, source: str, where: str, seed: str) -> str:
    return f"""{name} AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('{seed}:' || id)) AS k,
    count(*) OVER (PARTITION BY label) AS size FROM {source} WHERE {where})"""


ORACLE["stratified_split"] = f"""WITH {LABELLED}, tot AS (SELECT label, count(*) AS total FROM la GROUP BY 1),
{ranked('re', 'la', "source <> 'synthetic'", '42-test')},
te AS (SELECT re.id FROM re JOIN tot USING (label) WHERE re.k <= round_even(tot.total * 0.15, 0)),
{ranked('rest', 'la', 'id NOT IN (SELECT id FROM te)', '42-train-val')}
SELECT id, CASE WHEN k <= round_even(size * (0.15::DOUBLE / 0.85::DOUBLE), 0) THEN 'val' ELSE 'train' END AS split FROM rest
UNION ALL SELECT id, 'test' FROM te"""
ORACLE["split_with_fixed_test"] = f"""WITH {LABELLED}, {ranked('rest', 'la', "label <> 'scam' OR source = 'synthetic'", '42-train-val')}
SELECT id, CASE WHEN k <= round_even(size * (0.15::DOUBLE / 0.85::DOUBLE), 0) THEN 'val' ELSE 'train' END AS split FROM rest
UNION ALL SELECT id, 'test' FROM la WHERE label = 'scam' AND source <> 'synthetic'"""
ORACLE["fixed_test_errors"] = f"""WITH {LABELLED} SELECT id || 'x' AS id, 'missing' AS error FROM la WHERE channel = 'fax'
UNION ALL SELECT id, CASE WHEN source <> 'synthetic' THEN 'changed' ELSE 'synthetic' END FROM la
WHERE channel <> 'fax' AND (source = 'synthetic' OR label = 'spam')"""
ORACLE["labels_without_test"] = f"WITH {LABELLED} SELECT DISTINCT label FROM la WHERE label <> 'scam'"
ORACLE["label_metrics"] = """WITH s AS (SELECT l, count(*) FILTER (quality = l AND toxic = l) AS tp, count(*) FILTER (toxic = l) AS p, count(*) FILTER (quality = l) AS e
FROM labels, (VALUES (0), (1), (2)) AS v(l) GROUP BY l),
f AS (SELECT l, CASE WHEN tp = 0 THEN 0 ELSE 2.0 * (tp / p::DOUBLE) * (tp / e::DOUBLE) / (tp / p::DOUBLE + tp / e::DOUBLE) END AS f1 FROM s)
SELECT round(avg(f1), 9) AS macro_f1, round(max(f1) FILTER (l = 2), 9) AS scam_f1, (SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0 END), 9) FROM labels) AS accuracy FROM f"""
ORACLE["confusion_counts"] = "SELECT quality AS expected, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2"
ORACLE["largest_logit_gap"] = "SELECT round(max(abs(x::DOUBLE - x::DOUBLE * 0.75)), 9) AS max_abs_diff FROM (SELECT unnest(embedding) AS x FROM embeddings)"

# --- threat table update --------------------------------------------------------------
SEEN = f"""{HOSTS}, seen AS (SELECT lang AS source, ascii(lang) AS o, parent AS domain, min(page_id) AS ord, arg_min(url, page_id) AS source_url,
    arg_min(host, page_id) AS evidence FROM hosts GROUP BY 1, 2, 3),
ex AS (SELECT parent AS domain, min(url) AS source_url FROM hosts WHERE host LIKE 'm.%' GROUP BY 1),
al AS (SELECT DISTINCT parent AS domain FROM hosts WHERE url LIKE '%.html%'), rj AS (SELECT DISTINCT parent AS domain FROM hosts WHERE url LIKE '%utm_source%'),
oc AS (SELECT *, CASE WHEN domain IN (SELECT domain FROM ex) THEN 'known' WHEN domain IN (SELECT domain FROM rj) THEN 'rejected'
    WHEN list_has_any({parents('domain', 1)}, (SELECT list(domain) FROM al)) THEN 'allowed'
    WHEN row_number() OVER (PARTITION BY domain ORDER BY o, source) > 1 THEN 'duplicate' ELSE 'new' END AS outcome FROM seen)"""
ORACLE["domain_outcomes"] = f"WITH {SEEN} SELECT source, domain, ord, outcome FROM oc"
ORACLE["merged_domains"] = f"""WITH {SEEN} SELECT domain, 'old' AS source, source_url, '2025-01-01' AS first_seen, '' AS evidence FROM ex
UNION ALL SELECT domain, source, source_url, '2026-01-01', evidence FROM oc WHERE outcome = 'new'"""
ORACLE["domain_counters"] = f"""WITH {SEEN} SELECT count(*) FILTER (outcome = 'new') AS new_domains, count(*) FILTER (outcome = 'allowed') AS skipped_allowed,
count(*) FILTER (outcome = 'rejected') AS skipped_rejected FROM oc"""
ORACLE["rejected_domains"] = f"""WITH {SEEN}, ask AS (SELECT DISTINCT parent AS domain FROM hosts WHERE lang = 'fr')
SELECT domain, 'active' AS place FROM ex WHERE domain NOT IN (SELECT domain FROM ask)
UNION ALL SELECT domain, 'rejected' FROM rj UNION ALL SELECT domain, 'rejected' FROM ask WHERE domain IN (SELECT domain FROM ex)
UNION ALL SELECT domain, 'unknown_domain' FROM ask WHERE domain NOT IN (SELECT domain FROM ex)"""
ORACLE["rejected_templates"] = f"""WITH {TPLS}, f AS (SELECT id, {FP} AS fp FROM b)
SELECT md5(array_to_string(fp, ' ')) AS digest, 'not a fraud text' AS reason, '2026-01-02' AS rejected_at
FROM f JOIN labels l ON f.id = printf('tpl_%06d', l.doc_id) WHERE l.toxic = 1"""
ORACLE["warned_page_domains"] = rf"""WITH {LINKS}, n AS (SELECT msg_id, regexp_replace(host, '^www\.', '') AS domain,
    regexp_replace(regexp_extract(page_url, '^https?://([^/?#]+)', 1), '^www\.', '') AS own FROM fixed)
SELECT msg_id AS page_id, domain FROM n WHERE domain <> own"""
ORACLE["list_page_domains"] = rf"""WITH {LINKS}, n AS (SELECT msg_id, regexp_replace(host, '^www\.', '') AS domain,
    regexp_replace(regexp_extract(page_url, '^https?://([^/?#]+)', 1), '^www\.', '') AS own FROM fixed)
SELECT msg_id AS page_id, domain FROM n WHERE domain <> own UNION ALL SELECT msg_id, 'shop.example.org' FROM n"""
ORACLE["crawl_report"] = f"""WITH {HOSTS} SELECT lang AS source, count(*) AS articles, count(DISTINCT parent) AS domains,
count(*) FILTER (url LIKE '%html%') AS texts, count(*) FILTER (url LIKE '%#top') AS errors FROM hosts GROUP BY 1"""
ORACLE["domain_list_entries"] = rf"""WITH {HOSTS} SELECT page_id::VARCHAR AS source, regexp_replace(host, '^www\.', '') AS domain FROM hosts
UNION ALL SELECT page_id::VARCHAR, 'shop.vn' FROM hosts WHERE NOT starts_with(url, 'https')"""

# --- pages, feeds, robots --------------------------------------------------------------
ATTR = r"""(?:[^>"'']|"[^"]*"|''[^'']*'')*"""


def without(c: str, tags: list[str]) -> str:
    for tag in tags:
        c = f"regexp_replace({c}, '(?is)<{tag}(?:[\\s/]{ATTR})?>.*?(?:</{tag}\\s*>|\\z)', ' ', 'g')"
    return c


def decoded(c: str) -> str:
    for name, value in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = f"replace({c}, '{name}', '{value}')"
    return c


BODY = without(f"regexp_replace({without('html', ['script', 'style'])}, '(?s)<!--.*?(?:-->|\\z)', '', 'g')", fv.SKIPPED_TAGS[2:])
ANY_TAG = f"<[/a-zA-Z!?]{ATTR}>"
ORACLE["page_texts"] = f"""WITH t AS (SELECT page_id, trim(regexp_replace({decoded(f"regexp_replace({BODY}, '{ANY_TAG}', ' ', 'g')")}, '{SPACE}+', ' ', 'g')) AS x FROM pages)
SELECT page_id, length(x) AS n, md5(x) AS digest FROM t"""
ORACLE["page_anchors"] = rf"""WITH a AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*') AS origin,
    list_transform(regexp_extract_all(regexp_replace({without('html', ['script', 'style'])}, '(?s)<!--.*?(?:-->|\z)', '', 'g'), '<a\s[^>]*?href="([^"]+)"', 1), lambda h: {decoded('h')}) AS l FROM pages),
u AS (SELECT page_id, p.o, CASE WHEN starts_with(p.v, '/') THEN origin || p.v ELSE p.v END AS link FROM a, unnest(l) WITH ORDINALITY AS p(v, o)),
f AS (SELECT page_id, link, min(o) AS o FROM u GROUP BY 1, 2)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS pos, link FROM f"""
_cut = "|".join(fv.CONTENT_TAGS)
_blocks = f"regexp_replace(regexp_replace(regexp_replace({BODY}, '(?i)</?(?:{_cut})(?:[\\s/]{ATTR})?>', chr(1), 'g'), '(?i)<br(?:[\\s/]{ATTR})?>', ' ', 'g'), '{ANY_TAG}', '', 'g')"
ORACLE["page_block_paragraphs"] = f"""WITH s AS (SELECT page_id, list_filter(list_transform(string_split({_blocks}, chr(1)),
    lambda b: trim(regexp_replace({decoded('b')}, '{SPACE}+', ' ', 'g'))), lambda b: length(b) >= 20) AS l FROM pages)
SELECT page_id, p.o - 1 AS pos, md5(p.v) AS digest FROM s, unnest(l) WITH ORDINALITY AS p(v, o)"""
_quoted = lambda names: ", ".join(f"'{n}'" for n in names)
_signed = "CASE WHEN tok[2] = '/' THEN -1 WHEN ends_with(tok, '/>') THEN 0 ELSE 1 END"
ORACLE["page_paragraphs"] = rf"""WITH t AS (SELECT page_id, unnest(l) AS tok, generate_subscripts(l, 1) AS i FROM (SELECT page_id,
    regexp_extract_all(html, '(?is)<!--.*?(?:-->|\z)|<script(?:[\s/]{ATTR})?>.*?(?:</script\s*>|\z)|<style(?:[\s/]{ATTR})?>.*?(?:</style\s*>|\z)|</?[a-z][^\s/>]*{ATTR}>|<[!?][^>]*>|[^<]+|<') AS l FROM pages)),
n AS (SELECT *, CASE WHEN regexp_matches(tok, '(?i)^<(?:script|style)[\s/>]') THEN '' ELSE lower(regexp_extract(tok, '^</?([a-zA-Z][^\s/>]*)', 1)) END AS name FROM t),
s AS (SELECT *, sum(CASE WHEN name IN ({_quoted(fv.CONTENT_TAGS)}) THEN {_signed} ELSE 0 END) OVER w AS c, sum(CASE WHEN name IN ({_quoted(fv.SKIPPED_TAGS)}) THEN {_signed} ELSE 0 END) OVER w AS k
    FROM n WINDOW w AS (PARTITION BY page_id ORDER BY i)),
f AS (SELECT *, c - least(0, min(c) OVER w) AS depth, k - least(0, min(k) OVER w) AS skipped FROM s WINDOW w AS (PARTITION BY page_id ORDER BY i)),
e AS (SELECT *, CASE WHEN depth = 0 AND lag(depth, 1, 0) OVER w > 0 THEN 1 ELSE 0 END AS ends FROM f WINDOW w AS (PARTITION BY page_id ORDER BY i)),
r AS (SELECT *, sum(ends) OVER (PARTITION BY page_id ORDER BY i) - ends AS region, sum(ends) OVER (PARTITION BY page_id) AS regions FROM e),
j AS (SELECT page_id, region, string_agg(CASE WHEN name = 'br' THEN ' ' ELSE tok END, '' ORDER BY i) AS x FROM r
    WHERE region < regions AND depth > 0 AND skipped = 0 AND (name = 'br' OR NOT regexp_matches(tok, '^<[a-zA-Z/!?]')) GROUP BY 1, 2),
p AS (SELECT page_id, region, trim(regexp_replace({decoded('x')}, '{SPACE}+', ' ', 'g')) AS paragraph FROM j)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY region) - 1 AS pos, paragraph FROM p WHERE length(paragraph) >= 20"""
ORACLE["feed_items"] = "SELECT page_id::VARCHAR AS source, 'News & more' AS title, url AS link, 'Cảnh báo' AS summary FROM pages"
ITEMS = f"""{HOSTS}, it AS (SELECT lang AS source, page_id AS pos, CASE WHEN starts_with(url, 'https') THEN url ELSE '' END AS link FROM hosts
    WHERE contains(host, 'example.com') OR contains(host, 'example.net'))"""
ORACLE["feed_articles"] = f"""WITH {ITEMS}, k AS (SELECT * FROM it QUALIFY row_number() OVER (PARTITION BY source ORDER BY pos) <= 7) SELECT * FROM k WHERE link <> ''"""
ORACLE["feed_articles_training"] = f"WITH {ITEMS} SELECT * FROM it WHERE link <> '' QUALIFY row_number() OVER (PARTITION BY source ORDER BY pos) <= 7"
ORACLE["robots_policy"] = f"""WITH {HOSTS}, j AS (SELECT page_id::VARCHAR AS host, starts_with(url, 'http:') AS sig,
    CASE lang WHEN 'fr' THEN 'gptbot' WHEN 'de' THEN 'ccbot' ELSE '' END AS bot FROM hosts)
SELECT host, NOT sig AND bot = '' AS allowed, CASE WHEN sig THEN 'content_signal' WHEN bot <> '' THEN 'agents_barred' ELSE 'unrestricted' END AS reason,
CASE WHEN sig THEN '' ELSE bot END AS agents FROM j"""

# --- curation and reports ---------------------------------------------------------------
ORACLE["known_text_keys"] = f"""SELECT {key('text')} AS key FROM documents UNION SELECT {key('text')} FROM conversations UNION SELECT {key('text')} FROM benchmark"""
CAND = f"""{LABELLED}, ca AS (SELECT 'cand_' || lpad(ord::VARCHAR, 6, '0') AS id, text, CASE WHEN channel = 'fax' THEN 'radio' ELSE 'news' END AS origin, source,
    CASE WHEN label = 'spam' THEN '' ELSE label END AS label, scam_type, channel FROM la),
se AS (SELECT *, CASE WHEN label = '' THEN 'label' WHEN label <> 'scam' AND scam_type <> '' THEN 'scam_type_without_scam' WHEN channel = 'fax' THEN 'channel' END AS error FROM ca)"""
ORACLE["suggestion_errors"] = f"""WITH {CAND} SELECT id || '?' AS id, 'unknown_id' AS error FROM se WHERE source = 'synthetic'
UNION ALL SELECT id, error FROM se WHERE source <> 'synthetic' AND error IS NOT NULL"""
ORACLE["capped_sources"] = f"""WITH {LABELLED}, o AS (SELECT la.ord, substr(d.source, 4)::INTEGER AS source_ord, CASE WHEN label = 'normal' THEN 'added' ELSE 'duplicate' END AS outcome
    FROM la JOIN documents d ON d.doc_id = la.ord),
n AS (SELECT source_ord, coalesce(sum(count(*) FILTER (outcome = 'added')) OVER (ORDER BY source_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o GROUP BY 1)
SELECT ord, source_ord, outcome FROM o WHERE source_ord IN (SELECT source_ord FROM n WHERE before < 100)"""
ORACLE["first_items_per_source"] = "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= length(source) * 2"
ORACLE["applied_suggestions"] = """SELECT conv_id::VARCHAR AS id, CASE WHEN arg_max(role, turn) = 'user' THEN 'normal' ELSE 'spam' END AS suggested_label,
'seen in turn ' || max(turn) AS note FROM conversations GROUP BY 1"""
ORACLE["unlabelled_candidates"] = f"WITH {CAND} SELECT id FROM ca WHERE label = '' ORDER BY id LIMIT 40"
REV = f"""{LABELLED}, rv AS (SELECT 'cand_' || lpad(ord::VARCHAR, 6, '0') AS candidate_id, text, source, label, ord,
    source = 'collected' AS judged, source = 'collected' AND annotator <> '' AND channel <> 'fax' AS accepted FROM la)"""
ORACLE["accepted_messages"] = f"""WITH {REV} SELECT candidate_id, label, CASE WHEN label = 'scam' THEN 'job_scam' ELSE '' END AS scam_type, 'other' AS channel,
source, 'a7' AS annotator FROM rv WHERE accepted"""
ORACLE["reviewed_keys"] = f"""WITH {REV} SELECT {key('text')} AS key, CASE WHEN accepted THEN 'accepted' ELSE 'rejected' END AS decision, '2026-01-01' AS decided_at FROM rv WHERE judged"""
ORACLE["remaining_candidates"] = f"WITH {REV} SELECT candidate_id AS id FROM rv WHERE NOT judged"
ORACLE["appended_messages"] = f"""WITH {REV}, top AS (SELECT max(ord) AS m FROM la WHERE label = 'scam')
SELECT id, label, annotator FROM la WHERE label = 'scam'
UNION ALL SELECT 'msg_' || lpad(((SELECT m FROM top) + row_number() OVER (ORDER BY candidate_id))::VARCHAR, 6, '0'), label, 'a7' FROM rv WHERE accepted"""
ORACLE["sequential_ids"] = """SELECT doc_id, 'msg_' || lpad(((SELECT max(doc_id) FROM labels) + row_number() OVER (ORDER BY source, doc_id))::VARCHAR, 6, '0') AS id FROM documents"""
ORACLE["next_id_number"] = "SELECT max(doc_id) + 1 AS next FROM labels"
ORACLE["label_mapped_rows"] = """SELECT md5(text) AS digest, CASE lang WHEN 'en' THEN 'normal' WHEN 'fr' THEN 'spam' ELSE '' END AS hint_label, 'sms' AS hint_channel FROM documents"""
REPORTS = """rq AS (SELECT event_id, event_type || ' ' || props AS masked_text, CASE WHEN event_type = 'view' THEN 'spam' ELSE 'scam' END AS reported_label,
    CASE WHEN event_type = 'click' THEN 'telegram' ELSE 'api' END AS channel, ts, lpad(lower(to_hex(epoch_us(ts) // 1000)), 12, '0') AS ms FROM events WHERE event_type <> 'error'),
rh AS (SELECT *, sha256(event_id::VARCHAR || chr(31) || masked_text) AS h FROM rq),
rp AS (SELECT *, substr(ms, 1, 8) || '-' || substr(ms, 9, 4) || '-7' || substr(h, 1, 3) || '-8' || substr(h, 4, 3) || '-' || substr(h, 7, 12) AS id FROM rh)"""
STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS created_at"
ORACLE["submitted_reports"] = f"WITH {REPORTS} SELECT id, masked_text, reported_label, channel, {STAMP} FROM rp"
ORACLE["stream_reports"] = ORACLE["submitted_reports"]
ORACLE["listed_reports"] = f"WITH {REPORTS} SELECT id, {STAMP} FROM rp WHERE ts >= TIMESTAMP '2024-01-15' ORDER BY ts, id LIMIT 500"
ORACLE["review_file_rows"] = f"""WITH {REPORTS} SELECT id AS report_id, masked_text AS text, reported_label AS label, '' AS scam_type,
CASE WHEN channel = 'telegram' THEN 'telegram' ELSE 'other' END AS channel, 'contributed' AS source, strftime(ts, '%Y-%m-%d') AS collected_at, '' AS annotator FROM rp"""
ORACLE["requests_over_limit"] = """SELECT user_id AS client, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, count(*) - 3 AS refused
FROM events GROUP BY user_id, date_trunc('day', ts) HAVING count(*) > 3"""
ORACLE["refused_requests"] = "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) > 3"
ORACLE["stream_first_texts"] = f"SELECT DISTINCT {key("event_type || ' ' || props")} AS key FROM events"
ORACLE["stream_newest_texts"] = f"""WITH f AS (SELECT min(doc_id) AS ord, {key('text')} AS key FROM documents GROUP BY 2) SELECT ord, key FROM f ORDER BY ord DESC LIMIT 10"""

# --- masked texts ---------------------------------------------------------------------
# RE2 has no look-around: the character before and after a number is taken into the match
# and put back, and each step runs twice for numbers that share such a character. Amounts
# of money are fenced with chr(1) first. The documents hold no OTP and no ID keyword.
PHONE = (
    r"(^|[^\d.,/])((?:\(\+?84\)|\+?84|0)[ .\-]?(?:\d{9,10}|\d{2,4}(?:[ .\-]\d{3,4}){2,3}|\d(?:[ .\-]\d{2}){4})"
    r"|\(0\d{1,3}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4})($|[^\d.,/]|[.,/]$|[.,/][^\d])"
)
MONEY = r"(^|[^\d\x01])(\d{9,19}\s?(?i:đồng|dong|vnđ|vnd|đ|d)(?:[^\p{L}\p{M}]|$))"
ACCOUNT = r"(^|[^\d\x01])(?:\d{4}(?:[ .\-]\d{4}){2,3}(?:[ .\-]\d{1,3})?|\d{9,19})($|[^\d])"


def twice(c: str, pattern: str, to: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '{pattern}', '{to}', 'g'), '{pattern}', '{to}', 'g')"


def sql_email(c: str) -> str:
    return f"regexp_replace({c}, '{EMAIL}', '<EMAIL>', 'g')"


def sql_phone(c: str) -> str:
    return twice(c, PHONE, r"\1<PHONE>\3")


def sql_account(c: str) -> str:
    fenced = twice(c, MONEY, r"\1" + "' || chr(1) || '" + r"\2")
    return f"replace({twice(fenced, ACCOUNT, chr(92) + '1<ACCOUNT>' + chr(92) + '2')}, chr(1), '')"


def sql_mask(c: str) -> str:
    return sql_account(sql_phone(sql_email(c)))


def mask_steps(name: str, select: str) -> str:
    """CTEs ending in ``name`` with the text after each step; ``select`` gives ``t0`` and other columns."""
    return (
        f"{name}0 AS ({select}), {name}1 AS (SELECT *, {sql_email('t0')} AS t1 FROM {name}0), "
        f"{name}2 AS (SELECT *, {sql_phone('t1')} AS t2 FROM {name}1), {name} AS (SELECT *, {sql_account('t2')} AS t3 FROM {name}2)"
    )


KINDS = """list_filter([CASE WHEN t1 <> t0 THEN 'email' END, CASE WHEN t2 <> t1 THEN 'phone' END, CASE WHEN t3 <> t2 THEN 'account' END], lambda k: k IS NOT NULL)"""
NAMED = rf"""list_bool_or(list_append(list_transform(regexp_extract_all(t3, '(?:^|[^{WORD}_])(?i:anh|chị|chi|em|ông|ong|bà|cô|chú|chu|bác|bac|bạn|ban|mr|mrs|ms)\.?\s+([\p{{L}}\p{{M}}]+)', 1),
    lambda w: w[1] <> lower(w[1])), false))"""
BARE = rf"(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?\.)+(?:{fv.URL_TLDS}|{fv.URL_TLDS.upper()})($|[^{WORD}_])"
MASKED = mask_steps("m", f"SELECT doc_id, source, {norm('text')} AS t0 FROM documents")

ORACLE["mask_documents"] = f"WITH {MASKED} SELECT doc_id, md5(t3) AS digest, length(t3) AS n FROM m"
ORACLE["pii_kind_counts"] = f"WITH {MASKED} SELECT kind, count(*) AS rows FROM (SELECT unnest({KINDS}) AS kind FROM m) GROUP BY 1"
ORACLE["evidence_excerpts"] = f"WITH {MASKED} SELECT doc_id, CASE WHEN length(t3) <= 240 THEN t3 ELSE substr(t3, 1, 239) || '…' END AS evidence FROM m"
ORACLE["anonymized_rows"] = f"""WITH {MASKED} SELECT 'msg_' || lpad((row_number() OVER (ORDER BY doc_id))::VARCHAR, 6, '0') AS id,
'normal' AS label, source, CASE WHEN regexp_matches(t3, '{BARE}') THEN 'true' ELSE 'false' END AS has_url, md5(t3) AS digest FROM m"""
OUTCOMES = f"""{MASKED}, pr AS (SELECT doc_id AS ord, source, t3, {key('t3')} AS key, CASE WHEN NOT length(t3) BETWEEN 5 AND 2000 THEN 'invalid' WHEN {NAMED} THEN 'name' END AS problem FROM m),
oc AS (SELECT *, CASE WHEN problem IS NOT NULL THEN problem WHEN ord = min(ord) FILTER (problem IS NULL) OVER (PARTITION BY key)
    AND key NOT IN (SELECT {key('text')} FROM benchmark) THEN 'added' ELSE 'duplicate' END AS outcome FROM pr)"""
ORACLE["collected_texts"] = f"WITH {OUTCOMES} SELECT ord, key, outcome FROM oc"
ORACLE["collection_report"] = f"""WITH {OUTCOMES} SELECT source AS source_name, count(*) FILTER (outcome = 'added') AS added, count(*) FILTER (outcome = 'duplicate') AS duplicate,
count(*) FILTER (outcome = 'name') AS name, count(*) FILTER (outcome = 'invalid') AS invalid FROM oc GROUP BY 1"""
ORACLE["new_candidate_rows"] = f"""WITH {OUTCOMES}, so AS (SELECT *, substr(source, 4)::INTEGER AS so FROM oc),
n AS (SELECT so, coalesce(sum(count(*) FILTER (outcome = 'added')) OVER (ORDER BY so ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM so GROUP BY 1),
k AS (SELECT so.*, row_number() OVER (ORDER BY so.so, ord) AS r FROM so JOIN n USING (so) WHERE before < 300 AND outcome = 'added')
SELECT 'cand_' || lpad(((SELECT max(doc_id) FROM labels) + r)::VARCHAR, 6, '0') AS id, source, md5(t3) AS digest FROM k WHERE r <= 300"""
FRAUD = mask_steps("fr", f"SELECT doc_id AS ord, source, 'Quý khách vui lòng truy cập ' || array_to_string({tokens('text')}, ' ') || ' để xác minh tài khoản' AS t0 FROM documents")
ORACLE["template_candidate_texts"] = f"WITH {FRAUD} SELECT ord, md5(t3) AS digest FROM fr WHERE length(t3) <= 600"
ORACLE["template_additions"] = f"""WITH RECURSIVE {FRAUD}, ok AS (SELECT ord, source, t3 FROM fr WHERE length(t3) <= 600),
{shingle_cte('d', 'ok', 'ord', 't3')}, {NEAR}, {WALK},
stay AS (SELECT id FROM r WHERE id NOT IN (SELECT id FROM linked) UNION ALL SELECT unnest(kept) FROM (SELECT kept FROM walk ORDER BY k DESC LIMIT 1))
SELECT 'tpl_' || lpad((row_number() OVER (ORDER BY ord))::VARCHAR, 6, '0') AS id, md5(t3) AS digest, source FROM ok JOIN stay ON stay.id = ok.ord"""
ORACLE["synthetic_candidates"] = f"""WITH {FRAUD}, pf AS (SELECT ord, t3, {key('t3')} AS key FROM fr WHERE length(t3) BETWEEN 5 AND 2000 AND NOT coalesce({NAMED}, false)),
g AS (SELECT min(ord) AS ord, key FROM pf GROUP BY 2)
SELECT 'cand_' || lpad(((SELECT max(doc_id) FROM labels) + row_number() OVER (ORDER BY pf.ord))::VARCHAR, 6, '0') AS id, 'scam' AS suggested_label, md5(t3) AS digest
FROM pf JOIN g USING (ord) WHERE g.key NOT IN (SELECT {key('text')} FROM benchmark)"""
ORACLE["score_documents"] = f"""WITH {MASKED}, {shingle_cte('d', 'm', 'doc_id', 't3')}, {TPLS},
bx AS (SELECT id, len(sh) AS n, unnest(sh) AS s FROM b), dx AS (SELECT id, unnest(sh) AS s FROM d),
c AS (SELECT dx.id, bx.id AS tpl, count(*) / any_value(bx.n)::DOUBLE AS cov FROM dx JOIN bx USING (s) GROUP BY 1, 2),
best AS (SELECT id, max(cov) AS cov FROM c WHERE cov >= 0.6 GROUP BY 1)
SELECT doc_id AS msg_id, CASE WHEN length(t0) > 2000 THEN 'classification.text_too_long' WHEN cov IS NULL THEN 'classification.model_unavailable' ELSE 'ok' END AS status,
CASE WHEN length(t0) <= 2000 AND cov IS NOT NULL THEN 'scam' END AS label, CASE WHEN length(t0) <= 2000 THEN round(cov, 9) END AS confidence,
CASE WHEN length(t0) <= 2000 AND cov IS NOT NULL THEN 'matches_known_scam_template' END AS reasons FROM m LEFT JOIN best ON best.id = m.doc_id"""
ORACLE["candidate_findings"] = f"""WITH {CAND}, {mask_steps('cm', "SELECT *, text AS t0 FROM se")}
SELECT id AS key, 'origin' AS rule FROM se WHERE origin = 'radio' UNION ALL SELECT id, 'suggestion' FROM se WHERE label <> '' AND error IS NOT NULL
UNION ALL SELECT id, 'text_pii' FROM cm WHERE len({KINDS}) > 0"""
_trimmed = f"length(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g'))"
ORACLE["dataset_findings"] = f"""WITH {LABELLED}, {mask_steps('lm', "SELECT id, text AS t0 FROM la")},
kinds AS (SELECT id, unnest({KINDS}) AS k FROM lm), s AS (SELECT ord, id, {fold('text')} AS f FROM la), {REPEATED}
{" UNION ALL ".join([
    finding('text_length', f'{_trimmed}::VARCHAR', f'NOT {_trimmed} BETWEEN 5 AND 2000'),
    "SELECT 'dataset', id, 'text_pii', 'error', k FROM kinds",
    finding('scam_type_without_scam', 'scam_type', "label <> 'scam' AND scam_type <> ''"),
    finding('channel', 'channel', "channel = 'fax'"),
    finding('has_url', "'true'", f"regexp_matches(text, '{BARE}')"),
    finding('collected_at', 'collected_at', "collected_at = '2026-02-30'"),
    finding('annotator', "''", "annotator = ''"),
    "SELECT 'dataset', id, 'duplicate_text', 'error', fid FROM u WHERE ord <> ft",
])}
UNION ALL SELECT 'dataset', label, 'label_share', 'error', round(share, 4)::VARCHAR FROM (
    SELECT v.label, count(la.id) / (SELECT count(*) FROM la)::DOUBLE AS share FROM (VALUES ('normal'), ('spam'), ('scam')) AS v(label) LEFT JOIN la ON la.label = v.label GROUP BY 1) WHERE share < 0.15"""
ORACLE["template_findings"] = f"""SELECT 'scam_templates' AS "table", printf('tpl_%06d', item_id) AS key, 'not_a_candidate' AS rule, 'error' AS severity, '' AS detail FROM benchmark
UNION ALL SELECT 'scam_templates', printf('tpl_%06d', item_id), 'not_normalized', 'error', '' FROM benchmark WHERE {norm('text')} <> text"""
ORACLE["page_ads"] = f"""SELECT page_id, 0 AS pos, trim(regexp_replace({decoded("regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)")}, '[ \\t\\r]+', ' ', 'g')) AS text FROM pages
WHERE regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) <> ''"""
ORACLE["stream_over_limit"] = ORACLE["requests_over_limit"]

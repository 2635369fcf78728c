"""SQL that says the same as the queries, for an engine that reads the same tables.

Left out: what needs stems, cover density or a sequence matcher; those are
tested against plain restatements.
"""

from __future__ import annotations

from palimpsest.functions import citations

_CH = "regexp_extract(source, '[0-9]+')"
_NODES = f"""
 sections AS (SELECT d.doc_id AS node_id, lang AS source, {_CH} || '.' || d.doc_id AS path, {_CH} AS parent_path,
   split_part(text, chr(10), 1) AS heading, coalesce(toxic, 0) = 1 AS is_repealed
   FROM documents d LEFT JOIN labels USING (doc_id)),
 tops AS (SELECT DISTINCT lang AS source, {_CH} AS path FROM documents),
 nodes AS (SELECT * FROM sections UNION ALL SELECT NULL, source, path, NULL, 'Chapter ' || path, false FROM tops)"""
_VERSIONS = """
 versions AS (SELECT d.doc_id AS version_id, d.doc_id AS node_id, text AS body, DATE '2024-01-01' + CAST(d.doc_id % 365 AS INT) AS effective_from,
   CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' ELSE 'pending' END AS review_status, sha256(text) AS content_hash
   FROM documents d LEFT JOIN labels USING (doc_id)),
 shown AS (SELECT v.*, s.source, s.path, s.parent_path, s.heading, s.is_repealed FROM versions v JOIN sections s USING (node_id) WHERE review_status = 'approved')"""
_HISTORIES = """
 turns AS (SELECT conv_id * 100 + turn AS version_id, conv_id AS node_id, text AS body, DATE '2024-01-01' + CAST(turn * 30 AS INT) AS effective_from,
   CASE WHEN conv_id % 10 = 0 THEN 'rejected' WHEN turn % 4 = 3 THEN 'pending' ELSE 'approved' END AS review_status FROM conversations),
 histories AS (SELECT *, lead(effective_from) OVER (PARTITION BY node_id ORDER BY effective_from) AS effective_to FROM turns)"""
_BRIEFS = f"""
 briefs AS (SELECT doc_id AS text_id, lang AS source, {_CH} AS chapter, text,
   'See chapter ' || {_CH} || ' and section ' || {_CH} || '.' || doc_id || ', "' || substr(text, 11, 60) || '". Not over 30 days, nor section 999.' || doc_id || '. ' || text AS body
   FROM documents)"""
#: The shape of a citation, with the word characters of any script spelled out.
_FREE = "(?i)" + citations.FREE_TEXT.replace(r"\w", r"[\pL\pN_]")
_CITED = rf"""
 lists AS (SELECT text_id, source, regexp_extract_all(body, '{_FREE}') AS l FROM briefs),
 raws AS (SELECT text_id, source, unnest(l) AS raw, unnest(range(len(l))) AS pos FROM lists),
 cited AS (SELECT text_id, source, pos, trim(raw) AS raw, regexp_extract(raw, '(?i)\d+[A-Z]?(?:\.[\pL\pN_]+)?') AS path, regexp_extract(raw, '(?i)\d+[A-Z]?') AS chapter,
   NOT regexp_matches(trim(raw), '(?i)^\d') AS signed FROM raws WHERE length(trim(raw)) >= 2),
 resolved AS (SELECT c.*, contains(c.path, '.') AS is_section, n.node_id, n.path AS found, n.is_repealed, v.version_id
   FROM cited c LEFT JOIN nodes n ON n.source = c.source AND n.path = c.path
   LEFT JOIN versions v ON v.node_id = n.node_id AND v.review_status = 'approved'),
 near AS (SELECT source, parent_path AS chapter, string_agg(path, ',' ORDER BY path) AS candidates FROM
   (SELECT *, row_number() OVER (PARTITION BY source, parent_path ORDER BY path) AS k FROM sections) WHERE k <= 5 GROUP BY ALL),
 checked AS (SELECT r.*, CASE WHEN found IS NULL THEN 'not_found' WHEN is_repealed OR (is_section AND version_id IS NULL) THEN 'repealed' ELSE 'valid' END AS status FROM resolved r)"""
_SNAPSHOT = f"""
 base AS (SELECT doc_id, lang AS source, {_CH} || '.' || CASE WHEN doc_id % 13 = 0 THEN doc_id + 10000000 ELSE doc_id END AS path, {_CH} AS chapter,
   split_part(text, chr(10), 1) AS heading, CASE WHEN doc_id % 7 = 0 THEN 'AMENDED ' || text ELSE text END AS body
   FROM documents WHERE doc_id % 10 <> 0),
 snapshot AS (SELECT source, path, chapter, heading, body FROM base UNION ALL SELECT source || '2', path, chapter, heading, body FROM base WHERE doc_id % 17 = 0),
 covered AS (SELECT source, path AS chapter FROM tops WHERE NOT contains(path, '3') UNION ALL SELECT source || '2', path FROM tops WHERE NOT contains(path, '3')),
 both_sides AS (SELECT coalesce(p.source, s.source) AS source, coalesce(p.path, s.path) AS path, p.path IS NULL AS missing, s.path IS NULL AS new, s.is_repealed, sha256(p.body) AS content_hash, v.content_hash AS prior_hash
   FROM snapshot p FULL JOIN (sections s JOIN versions v USING (node_id)) ON p.path = s.path AND p.source = s.source),
 changes AS (SELECT source, path, CASE WHEN missing THEN 'repealed' WHEN new THEN 'added' WHEN content_hash = prior_hash THEN 'unchanged' ELSE 'amended' END AS kind, content_hash
   FROM both_sides WHERE NOT missing OR (NOT is_repealed AND EXISTS (SELECT 1 FROM covered c WHERE c.source = both_sides.source AND c.chapter = split_part(both_sides.path, '.', 1))))"""
_ISSUES = """
 issues AS (
 SELECT 'error' AS severity, 'missing_heading' AS code FROM snapshot WHERE trim(heading) = ''
 UNION ALL SELECT 'error', 'duplicate_path' FROM snapshot GROUP BY source, path HAVING count(*) > 1
 UNION ALL SELECT 'error', 'unannounced_repeal_wave' FROM changes HAVING count(*) FILTER (WHERE kind = 'repealed') > 0.1 * count(*)
 {0})"""
_COSINE = """
 near AS (SELECT a.vec_id AS query_id, b.vec_id AS version_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
   FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"""
_JUDGED = (
    _COSINE
    + """,
 top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, version_id) AS k FROM near) WHERE k <= 5),
 want AS (SELECT a.vec_id AS query_id, b.vec_id AS version_id, a.label FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 200 WHERE a.vec_id % 20 = 0),
 judged AS (SELECT w.query_id, any_value(w.label) AS label, count(*) AS n_available, count(t.version_id) AS n_matched
   FROM want w LEFT JOIN top5 t USING (query_id, version_id) GROUP BY w.query_id),
 scores AS (SELECT *, n_matched / 5.0 AS precision, n_matched / n_available AS recall, n_matched > 0 AS hit FROM judged)"""
)
_TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
_TURNS = """
 last_user AS (SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS question FROM conversations GROUP BY conv_id),
 turns AS (SELECT conv_id AS turn_id, question, conv_id % 5 > 0 AS searched, conv_id % 3 > 0 AS has_hits,
   CASE WHEN conv_id % 2 = 0 THEN 'see § ' || conv_id ELSE 'nothing' END AS answer, CASE WHEN conv_id % 4 = 0 THEN 'out_of_scope' ELSE 'question' END AS kind FROM last_user),
 found AS (SELECT *, CASE WHEN searched AND has_hits THEN [CAST(turn_id AS VARCHAR), CAST(turn_id + 1 AS VARCHAR)] ELSE [] END AS paths FROM turns),
 cited AS (SELECT *, list_filter(paths, lambda p: contains(answer, p)) AS used FROM found),
 turn_scores AS (SELECT turn_id, kind, CASE WHEN turn_id % 4 > 0 AND turn_id % 2 = 1 THEN list_contains(paths, CAST(turn_id AS VARCHAR)) END AS retrieval_hit,
   CASE WHEN turn_id % 4 > 0 AND turn_id % 2 = 1 THEN list_contains(used, CAST(turn_id AS VARCHAR)) END AS cite_hit,
   CASE WHEN turn_id % 4 = 0 THEN len(used) = 0 END AS abstained FROM cited)"""
#: A cell of a Markdown table.
_CELL = r"replace(replace(replace({0}, '|', '\|'), chr(10), ' '), chr(13), ' ')"
#: The rules beyond 2.1 of each document's book.
_FURTHER = """
WITH books AS (SELECT doc_id, coalesce(lang, '') AS lang, doc_id % 3 AS k, CAST(doc_id % 6 IN (1, 5) AS INT) AS b FROM documents),
 further AS (SELECT doc_id, lang, k, b, unnest(range(1, k + 1)) AS j, CASE b WHEN 1 THEN 'DIVISION III' ELSE 'DIVISION II' END AS division FROM books)"""
#: What counts as blank in Unicode.
_BLANKS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_STRIP = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"


def _with(*parts: str) -> str:
    recursive = ""
    return f"WITH{recursive}{','.join(parts)}\n"


SQL: dict[str, str] = {
    "a6_links_in_order": """
WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS s FROM pages), e AS (SELECT page_id, unnest(s) AS slug, unnest(range(len(s))) AS pos FROM l),
 f AS (SELECT slug, min((page_id, pos)) AS spot FROM e GROUP BY slug)
SELECT slug, row_number() OVER (ORDER BY spot) AS place FROM f""",
    "a6_first_links": """
WITH found AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS slugs FROM pages),
 each AS (SELECT page_id, unnest(slugs) AS slug, unnest(range(len(slugs))) AS pos FROM found)
SELECT slug, min(page_id) AS page_id, arg_min(pos, page_id * 1000000 + pos) AS pos FROM each GROUP BY slug""",
    "a1_code_sections": r"""
SELECT CAST(doc_id AS VARCHAR) AS chapter, doc_id || '.1A' AS path, '1A' AS ordinal, lang AS heading, sha256(regexp_replace(text, '\s+$', '')) AS content_hash, '[C' || doc_id || ']' AS history FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id || '.2', '2', lang, sha256(regexp_replace(text, '\s+$', '')), '[C' || doc_id || ']' FROM documents WHERE doc_id % 3 = 0""",
    "a1_skipped_sections": """
SELECT CAST(doc_id AS VARCHAR) AS chapter, (doc_id + doc_id % 3) || '.2' AS number, 'number belongs to another chapter' AS reason FROM documents WHERE doc_id % 3 > 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id || '-3', 'number has no right shape' FROM documents""",
    "a1_code_chapters": "SELECT CAST(doc_id AS VARCHAR) AS chapter, 'Title ' || lang AS title, 2026 AS year FROM documents",
    "a2_rules": r"""
SELECT CAST(doc_id AS VARCHAR) AS chapter, doc_id || ':1.2' AS path, '1.2' AS ordinal, rpad('Head ', 300, 'x') AS heading, lang AS division,
 sha256(regexp_replace('Form 1 ' || rpad(lang, 300, 'y') || chr(10) || chr(10) || text, '\s+$', '') || chr(10) || chr(10) || 'Comment' || chr(10) || chr(10) || lang) AS content_hash FROM documents""",
    "a2_rule_chapters": "SELECT CAST(doc_id AS VARCHAR) AS chapter, lang AS title, doc_id % 5 = 0 AS reserved, DATE '2026-04-01' AS edition, 1 AS n_rules FROM documents",
    "a4_chapter_heads": "SELECT doc_id AS path, CAST(doc_id AS VARCHAR) AS chapter, upper(lang) || ' LAW ' || doc_id % 7 AS title FROM documents",
    "a5_rich_sections": rf"""
WITH t AS (SELECT doc_id, {_STRIP.format(r"regexp_replace(regexp_replace(text, '[\[\]§]', '', 'g'), '\s+', ' ', 'g')")} AS one FROM documents)
SELECT doc_id AS path, doc_id || '.1' AS number, 'Theft defined' AS heading, sha256(CASE one WHEN '' THEN '' ELSE one || chr(10) || chr(10) END || 'End.') AS body_hash, 'C51, §1' AS history, '714.2|714.3' AS referred FROM t
UNION ALL SELECT doc_id, doc_id || '.2', 'Degrees', sha256('Text.'), '', '' FROM documents""",
    "a9_content_lines": "SELECT CAST(doc_id AS VARCHAR) AS chapter, 25 + 3 * (doc_id % 3) + CAST(doc_id % 6 IN (1, 5) AS INT) AS n_lines, 6 + 2 * (doc_id % 3) AS n_heads, 8 + CAST(doc_id % 6 IN (1, 5) AS INT) AS n_banners FROM documents",
    "a9_pdf_lines": r"""
WITH rows AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
 bare AS (SELECT doc_id, len(l) AS n, list_filter(list_transform(l, lambda x: trim(regexp_replace(x, '""" + _BLANKS + r"""', ' ', 'g'))), lambda x: x <> '') AS l FROM rows)
SELECT CAST(doc_id AS VARCHAR) AS path, (n + 49) // 50 AS n_pages, len(l) AS n_lines, sha256(array_to_string(l, chr(10))) AS lines_hash, 0 AS n_issues FROM bare""",
    "a10_index": _FURTHER + """
SELECT CAST(doc_id AS VARCHAR) AS chapter, doc_id || ':' || r.rule AS rule, r.role AS role, r.n + CASE r.role WHEN 'body' THEN k + b ELSE 0 END AS n FROM books,
 (VALUES ('1.0', 'contents', 4), ('1.1', 'contents', 6), ('2.1', 'contents', 9), ('1.0', 'body', 12), ('1.1', 'body', 17), ('2.1', 'body', 23)) r(rule, role, n)
UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id || ':3.' || j, 'contents', 9 + b + j FROM further
UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id || ':3.' || j, 'body', 25 + k + b + 2 * (j - 1) FROM further""",
    "a11_contents": _FURTHER + """
SELECT CAST(doc_id AS VARCHAR) AS chapter, doc_id || ':' || r.rule AS rule, r.heading AS heading, r.division AS division FROM documents,
 (VALUES ('1.0', 'Terms and how they are used', 'GENERAL'), ('1.1', 'Competence', 'GENERAL'), ('2.1', 'Advisor', 'DIVISION II')) r(rule, heading, division)
UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id || ':3.' || j, trim('Extra ' || j || ' ' || lang), division FROM further""",
    "a13_rule_bodies": _FURTHER + """,
 t AS (SELECT doc_id, trim('text ' || array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ')) AS prose FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS chapter, doc_id || ':1.0' AS rule, 'TERMS AND HOW' AS heading, sha256('a term is a word.') AS prose_hash, '' AS comment, '[Court Order April 20, 2005; September 1, 2010]' AS history FROM t
UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id || ':1.1', 'Competence', sha256('A lawyer shall be competent. ' || prose), '[1] First reason goes on.' || chr(10) || chr(10) || '[2] Second reason.', '' FROM t
UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id || ':2.1', 'ADVISOR', sha256('a lawyer advises.'), '', '' FROM t
UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id || ':3.' || j, 'EXTRA ' || j, sha256('it says ' || j || ' in ' || lang || '.'), '', '' FROM further""",
    "a14_rule_notes": _FURTHER + """
SELECT CAST(doc_id AS VARCHAR) AS chapter, doc_id || ':' || r.rule AS rule, r.note AS note FROM documents,
 (VALUES ('1.0', 'parsed under GENERAL', 2), ('1.1', 'parsed under GENERAL', 2), ('2.1', 'parsed under DIVISION II', 0), ('2.1', 'in contents only', 1)) r(rule, note, odd) WHERE r.odd = 2 OR r.odd = doc_id % 2
UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id || ':3.' || j, 'parsed under ' || division FROM further""",
    "a17_new_blobs": """
WITH d AS (SELECT sha256(text) AS content_hash, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS storage_path, strlen(text) AS byte_size, doc_id FROM documents)
SELECT content_hash, min(storage_path) AS storage_path, any_value(byte_size) AS byte_size FROM d WHERE content_hash NOT IN (SELECT content_hash FROM d WHERE doc_id % 3 = 0) GROUP BY content_hash""",
    "a18_code_sink": r"SELECT '2026' AS code_year, CAST(doc_id AS VARCHAR) AS chapter, doc_id || '.1A' AS number, sha256(regexp_replace(text, '\s+$', '')) AS body_hash FROM documents",
    "a18_rules_sink": "SELECT '2026-04-01' AS edition_date, CAST(doc_id AS VARCHAR) AS chapter, 3 + doc_id % 3 AS rule_count, doc_id || ':1.0,' || doc_id || ':1.1,' || doc_id || ':2.1' || CASE WHEN doc_id % 3 > 0 THEN ',' || doc_id || ':3.1' ELSE '' END || CASE doc_id % 3 WHEN 2 THEN ',' || doc_id || ':3.2' ELSE '' END AS numbers, '' AS notes FROM documents",
    "a17_blob_store": "SELECT DISTINCT sha256(coalesce(text, '')) AS content_hash, strlen(coalesce(text, '')) AS byte_size, true AS whole FROM documents",
    "a19_reconciled": """
SELECT 'documents' AS "table", (SELECT count(*) FROM documents) AS n_source, (SELECT count(*) FROM documents) AS n_dump, true AS equal
UNION ALL SELECT 'labels', (SELECT count(*) FROM labels), 0, (SELECT count(*) FROM labels) = 0 UNION ALL SELECT 'events', (SELECT count(*) FROM events), (SELECT count(*) FROM events), true""",
    "b1_visible_versions": _with(_NODES, _VERSIONS) + "SELECT version_id, node_id FROM versions WHERE review_status = 'approved'",
    "b2_one_source": _with(_NODES, _VERSIONS) + "SELECT version_id, path FROM shown WHERE source = 'en'",
    "b3_chapter_prefix": _with(_NODES) + "SELECT node_id, path FROM sections WHERE starts_with(path, '1.')",
    "b4_contains": "SELECT doc_id AS version_id FROM documents WHERE contains(lower(text), 'the and')",
    "b5_normalized_bodies": r"""
WITH raw AS (SELECT doc_id, replace(text || '; ; eferred to in §1.2, §3' || chr(13) || chr(10) || 'See also  ' || chr(10), chr(13) || chr(10), chr(10)) AS t FROM documents),
 trimmed AS (SELECT doc_id, regexp_replace(t, '\s+$', '') AS t FROM raw)
SELECT doc_id, sha256(regexp_replace(regexp_replace(t, '(?:\n\s*|\s*(?:;\s*)+)eferred to in [^\n]*', '', 'g'), '\s+$', '')) AS code_hash, sha256(t) AS rules_hash FROM trimmed""",
    "b8_combined_text": "SELECT doc_id, length(CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || chr(10) || 'Comment' || chr(10) || chr(10) || lang ELSE text END) AS n FROM documents",
    "b9_numbers_and_paths": _with(_NODES) + "SELECT node_id, path AS number, parent_path AS chapter, CAST(node_id AS VARCHAR) AS ordinal FROM sections WHERE node_id > 0",
    "b12_natural_order": _with(_NODES) + "SELECT node_id, row_number() OVER (PARTITION BY source, parent_path ORDER BY node_id) AS place FROM sections",
    "b15_urls": _with(_NODES)
    + """, urls AS (SELECT node_id, CASE source WHEN 'en' THEN 'https://law.example/2026/' || path || '.pdf' ELSE '' END AS url FROM sections WHERE node_id > 0)
SELECT node_id, url, CASE url WHEN '' THEN 'none' ELSE url END AS first_url FROM urls""",
    "b18_snippets": rf"""
WITH t AS (SELECT doc_id, replace({_STRIP.format("text")}, chr(10), ' ') AS one, regexp_replace(text, '\s+$', '') AS body FROM documents),
 c AS (SELECT *, substr(body, 1, 800) AS cut, instr(reverse(substr(body, 1, 800)), ' ') AS gap FROM t)
SELECT doc_id, CASE WHEN length(one) <= 280 THEN one ELSE regexp_replace(substr(one, 1, 279), '\s+$', '') || '…' END AS snippet,
 CASE WHEN length(body) <= 800 THEN body ELSE regexp_replace(CASE WHEN gap > 0 AND 800 - gap > 720 THEN substr(cut, 1, 800 - gap) ELSE cut END, '\s+$', '') || '…' END AS excerpt FROM c""",
    "b19_search_snippets": r"""
WITH o AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS one, instr(lower(one), 'the') AS a, instr(lower(one), 'und') AS b FROM documents),
 s AS (SELECT *, CASE WHEN a > 0 THEN a WHEN b > 0 THEN b END - 1 AS p, greatest(0, p - 80) AS lo, least(length(one), lo + 240) AS hi, substr(one, lo + 1, hi - lo) AS piece FROM o),
 l AS (SELECT *, CASE WHEN lo > 0 THEN '…' || regexp_replace(piece, '^[^ ]* ', '') ELSE piece END AS led FROM s)
SELECT doc_id, CASE WHEN length(one) <= 240 THEN one WHEN p IS NULL THEN rtrim(regexp_replace(substr(one, 1, 239), ' [^ ]*$', '')) || '…'
 ELSE trim(CASE WHEN hi < length(one) THEN regexp_replace(led, ' [^ ]*$', '') || '…' ELSE led END) END AS snippet FROM l""",
    "b21_excerpts": """
WITH t AS (SELECT doc_id, text, instr(lower(text), 'and the') - 1 AS a FROM documents),
 s AS (SELECT *, greatest(0, a - 100) AS lo, least(length(text), a + 107) AS hi FROM t)
SELECT doc_id, CASE WHEN a < 0 THEN 'And the' ELSE (CASE WHEN lo > 0 THEN '…' ELSE '' END) || substr(text, lo + 1, hi - lo) || (CASE WHEN hi < length(text) THEN '…' ELSE '' END) END AS excerpt FROM s""",
    "b22_collapsed": r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents",
    "b27_banners": r"""
WITH l AS (SELECT doc_id, unnest(str_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) FILTER (WHERE len(regexp_extract_all(line, '\p{L}')) >= 3 AND len(regexp_extract_all(line, '\p{L}')) = len(regexp_extract_all(line, '\p{Lu}'))) AS n_banners FROM l GROUP BY doc_id""",
    "c1_current_versions": _with(_HISTORIES)
    + """, opened AS (SELECT *, CASE WHEN node_id % 2 = 0 THEN effective_to END AS until FROM histories)
SELECT node_id, arg_max(version_id, effective_from) AS version_id FROM opened WHERE until IS NULL AND review_status = 'approved' GROUP BY node_id""",
    "c2_history": _with(_HISTORIES) + "SELECT node_id, version_id, row_number() OVER (PARTITION BY node_id ORDER BY effective_from DESC, version_id DESC) AS place FROM histories WHERE review_status = 'approved'",
    "c3_versions_at": _with(_HISTORIES)
    + """, probes AS (SELECT DISTINCT conv_id AS node_id, unnest([DATE '2023-12-31', DATE '2024-01-15', DATE '2024-03-01', DATE '2024-12-31']) AS day FROM conversations)
SELECT node_id, day, arg_max(version_id, effective_from) AS version_id FROM probes JOIN histories USING (node_id)
WHERE review_status = 'approved' AND effective_from <= day AND (effective_to IS NULL OR effective_to > day) GROUP BY node_id, day""",
    "c4_recent_amendments": _with(_HISTORIES)
    + """, top AS (SELECT * FROM histories WHERE review_status = 'approved' AND effective_from >= DATE '2024-02-01' ORDER BY effective_from DESC, version_id DESC LIMIT 100)
SELECT version_id, CAST(node_id AS VARCHAR) AS path, CASE WHEN node_id % 7 = 0 AND effective_to IS NOT NULL THEN 'repealed'
 WHEN EXISTS (SELECT 1 FROM histories h WHERE h.node_id = top.node_id AND h.effective_from < top.effective_from) THEN 'amended' ELSE 'new' END AS kind FROM top""",
    "c5_diff": _with(_NODES, _VERSIONS, _SNAPSHOT) + "SELECT source, path, kind FROM changes",
    "c7_summary": _with(_NODES, _VERSIONS, _SNAPSHOT)
    + """SELECT count(*) FILTER (WHERE kind = 'added') AS n_added, count(*) FILTER (WHERE kind = 'amended') AS n_amended, count(*) FILTER (WHERE kind = 'repealed') AS n_repealed,
 count(*) FILTER (WHERE kind = 'unchanged') AS n_unchanged, count(*) FILTER (WHERE kind <> 'unchanged') = 0 AS is_empty FROM changes""",
    "c8_applied_versions": _with(_NODES, _VERSIONS, _SNAPSHOT)
    + """SELECT v.content_hash, effective_from, CASE WHEN kind IN ('amended', 'repealed') THEN DATE '2026-01-01' END AS effective_to, review_status, CAST(NULL AS VARCHAR) AS enacted_by
 FROM versions v JOIN sections s USING (node_id) LEFT JOIN changes c ON c.path = s.path AND c.source = s.source
UNION ALL SELECT sha256(body), DATE '2026-01-01', NULL, 'pending', '' FROM snapshot JOIN changes USING (source, path) WHERE kind IN ('added', 'amended')""",
    "c8_run": _with(_NODES, _VERSIONS, _SNAPSHOT, _ISSUES.format(""))
    + """SELECT CASE WHEN count(*) FILTER (WHERE severity = 'error') > 0 THEN 'failed' ELSE 'applied' END AS status, (SELECT count(*) FROM changes WHERE kind = 'added') AS n_added, (SELECT count(*) FROM changes WHERE kind = 'amended') AS n_amended,
 (SELECT count(*) FROM changes WHERE kind = 'repealed') AS n_repealed, (SELECT count(*) FROM changes WHERE kind = 'unchanged') AS n_unchanged, count(*) FILTER (WHERE severity = 'error') AS n_errors, count(*) FILTER (WHERE severity = 'warning') AS n_warnings FROM issues""",
    "c9_applied_nodes": _with(_NODES, _VERSIONS, _SNAPSHOT)
    + """, moved AS (SELECT s.* FROM snapshot s JOIN changes c USING (source, path) WHERE kind IN ('added', 'amended')),
 wanted AS (SELECT source, path, chapter, heading, false AS flag FROM moved UNION ALL SELECT source, chapter, NULL, 'Title ' || chapter, contains(chapter, '2') FROM covered),
 merged AS (SELECT coalesce(n.source, w.source) AS source, coalesce(n.path, w.path) AS path, coalesce(n.parent_path, w.chapter) AS parent_path, coalesce(w.heading, n.heading) AS heading, coalesce(w.flag, n.is_repealed, false) AS flag
   FROM nodes n FULL JOIN wanted w ON n.path = w.path AND n.source = w.source)
SELECT m.source, m.path, parent_path, coalesce(c.kind = 'repealed', flag) AS is_repealed, sha256(heading) AS heading_hash FROM merged m LEFT JOIN (SELECT * FROM changes WHERE kind = 'repealed') c ON c.path = m.path AND c.source = m.source""",
    "c11_review": _with(_NODES, _VERSIONS)
    + """SELECT CASE WHEN version_id % 3 = 0 AND review_status = 'pending' THEN 'approved' ELSE review_status END AS review_status,
 CASE WHEN version_id % 3 = 0 THEN CASE WHEN review_status = 'pending' THEN 'changed' ELSE 'skipped' END END AS review_outcome, count(*) AS n FROM versions GROUP BY ALL""",
    "c12_issues": _with(_NODES, _VERSIONS, _SNAPSHOT, _ISSUES.format("UNION ALL SELECT 'warning', 'unresolved_cross_reference' FROM snapshot WHERE source || ' ' || chapter || '.1' NOT IN (SELECT source || ' ' || path FROM snapshot)"))
    + "SELECT severity, code, count(*) AS n FROM issues GROUP BY ALL",
    "d1_postings": f"""
WITH w AS (SELECT doc_id, unnest({_WORDS.format("text")}) AS lexeme FROM documents)
SELECT lexeme, count(DISTINCT doc_id) AS df, count(*) AS tf FROM w GROUP BY lexeme""",
    "d1_index": f"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN lang ELSE '' END AS heading, text FROM documents WHERE doc_id % 7 <> 0),
 w AS (SELECT doc_id, unnest({_WORDS.format("heading")}) AS lexeme, 1 AS h FROM t UNION ALL SELECT doc_id, unnest({_WORDS.format("text")}), 0 FROM t)
SELECT lexeme, count(DISTINCT doc_id) AS df, count(*) AS tf, sum(h)::BIGINT AS in_headings FROM w GROUP BY lexeme""",
    # The score of one word is the sum of its weights: 1 in a heading, 0.4 in a body.
    "d2_word_ranks": _with(_NODES, _VERSIONS)
    + f""", q AS (SELECT doc_id AS query_id, {_WORDS.format("text")}[1] AS lexeme FROM documents WHERE doc_id % 20 = 0),
 w AS (SELECT version_id, unnest({_WORDS.format("heading")}) AS lexeme, 10 AS tenths FROM shown UNION ALL SELECT version_id, unnest({_WORDS.format("body")}), 4 FROM shown),
 s AS (SELECT version_id, lexeme, sum(tenths) AS s FROM w GROUP BY ALL),
 r AS (SELECT query_id, version_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, version_id) AS rank FROM q JOIN s USING (lexeme) WHERE lower(lexeme) <> 'or')
SELECT query_id, version_id, round(s / 10.0::DOUBLE, 6) AS score, rank FROM r WHERE rank <= 50""",
    "d2_simple_match": _with(_NODES, _VERSIONS)
    + rf""", docs AS (SELECT version_id, list_concat({_WORDS.format("heading")}, {_WORDS.format("body")}) AS w FROM shown)
SELECT 0 AS query_id, version_id FROM docs WHERE list_contains(w, 'the') AND list_contains(w, 'that')
UNION ALL SELECT 1, version_id FROM docs WHERE list_contains(w, 'the') OR list_contains(w, 'with')
UNION ALL SELECT 2, version_id FROM docs WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')
UNION ALL SELECT 3, version_id FROM docs WHERE list_contains(w, 'and') AND NOT list_contains(w, 'the')""",
    "d3_trigram": _with(_NODES, _VERSIONS)
    + f""", queries AS (SELECT doc_id AS query_id, array_to_string({_WORDS.format("text")}[1:3], ' ') AS query FROM documents WHERE doc_id % 20 = 0),
 q AS (SELECT query_id, {_TRIGRAMS.format("query")} AS a FROM queries), d AS (SELECT version_id, {_TRIGRAMS.format("heading")} AS b FROM shown),
 s AS (SELECT query_id, version_id, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS score FROM q, d),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, version_id) AS rank FROM s WHERE score >= 0.1)
SELECT query_id, version_id, round(score, 6) AS score, rank FROM r WHERE rank <= 20""",
    "d4_vector": _with(_COSINE) + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, version_id) AS k FROM near) SELECT query_id, version_id, round(score, 6) AS score FROM r WHERE k <= 10",
    # Whatever the index chooses, nine of ten true neighbours must be among it.
    "d4_recall": """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 20 = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
 d AS (SELECT count(*) AS n FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0)
SELECT count(*) AS n_queries, sum(least(10, d.n))::BIGINT AS n_wanted, true AS enough FROM q, d""",
    "d5_fusion": _with(_NODES, _VERSIONS)
    + f""", queries AS (SELECT unnest([0, 1, 2, 3]) AS query_id, unnest(['the and of', 'der die und', 'de la que', 'erst']) AS query),
 q AS (SELECT query_id, {_TRIGRAMS.format("query")} AS a FROM queries), d AS (SELECT version_id, {_TRIGRAMS.format("heading")} AS b, {_TRIGRAMS.format("body")} AS c FROM shown),
 s AS (SELECT query_id, version_id, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS h, len(list_intersect(a, c)) / (len(a) + len(c) - len(list_intersect(a, c))) AS t FROM q, d),
 one AS (SELECT query_id, version_id, row_number() OVER (PARTITION BY query_id ORDER BY h DESC, version_id) AS k FROM s WHERE h >= 0.1),
 two AS (SELECT query_id, version_id, row_number() OVER (PARTITION BY query_id ORDER BY t DESC, version_id) AS k FROM s WHERE t > 0),
 a AS (SELECT * FROM one WHERE k <= 30), b AS (SELECT * FROM two WHERE k <= 30),
 f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.version_id, b.version_id) AS version_id, coalesce(1.0::DOUBLE / (60 + a.k), 0) + coalesce(1.0::DOUBLE / (60 + b.k), 0) AS score,
   CASE WHEN a.k IS NULL THEN 1 ELSE 0 END AS list, coalesce(a.k, b.k) AS k FROM a FULL JOIN b ON a.query_id = b.query_id AND a.version_id = b.version_id)
SELECT query_id, version_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list, k, version_id) AS rank FROM f""",
    "d7_pending_embeddings": "SELECT doc_id AS version_id FROM documents WHERE doc_id % 3 <> 0",
    "d8_embeddings": _with(_NODES, _VERSIONS)
    + f""", texts AS (SELECT version_id, {_STRIP.format("heading || chr(10) || chr(10) || body")} AS s FROM shown),
 hashes AS (SELECT version_id, i, sha256(i || ':' || s) AS x FROM texts, range(128) r(i)),
 parts AS (SELECT version_id, i * 8 + j AS k, CAST('0x' || substr(x, 8 * j + 7, 2) || substr(x, 8 * j + 5, 2) || substr(x, 8 * j + 3, 2) || substr(x, 8 * j + 1, 2) AS BIGINT) / 4294967295 * 2 - 1 AS y FROM hashes, range(8) q(j)),
 sizes AS (SELECT version_id, sqrt(sum(y * y)) AS l FROM parts GROUP BY version_id)
SELECT version_id, 1024 AS width, round(sum(y / l * (y / l)), 4) AS norm, round(max(y / l) FILTER (WHERE k = 0), 4) AS "first", round(max(y / l) FILTER (WHERE k = 1023), 4) AS "last", CAST(NULL AS VARCHAR) AS error
FROM parts JOIN sizes USING (version_id) GROUP BY version_id""",
    "e1_parse": _with(_NODES)
    + """SELECT node_id, CASE WHEN o THEN parent_path ELSE path END AS path, parent_path AS chapter, o AS chapter_only, CASE WHEN o THEN '' ELSE '2/a' END AS subdivisions,
 CASE WHEN o THEN 'Iowa Code ch. ' || parent_path ELSE 'Iowa Code § ' || path || '(2)(a)' END AS long, CASE WHEN o THEN 'I.C. ch. ' || parent_path ELSE 'I.C. § ' || path || '(2)(a)' END AS short,
 CASE WHEN o THEN parent_path ELSE path || '(2)(a)' END AS bare FROM (SELECT *, node_id % 6 = 5 AS o FROM sections WHERE node_id > 0)""",
    "e2_find_all": _with(_BRIEFS) + f", raws AS (SELECT text_id, unnest(regexp_extract_all(body, '{_FREE}')) AS raw FROM briefs) SELECT text_id, raw, count(*) AS n FROM raws GROUP BY ALL",
    # A span begins where its text next occurs behind the one before.
    "e3_spans": f"""WITH RECURSIVE {_BRIEFS.strip()},
 lists AS (SELECT text_id, body, regexp_extract_all(body, '{_FREE}') AS l FROM briefs),
 spans AS (SELECT text_id, 1 AS k, instr(body, l[1]) - 1 AS a, length(l[1]) AS n FROM lists WHERE len(l) > 0
   UNION ALL SELECT s.text_id, k + 1, a + n + instr(substr(body, a + n + 1), l[k + 1]) - 1, length(l[k + 1]) FROM spans s JOIN lists USING (text_id) WHERE k < len(l))
SELECT text_id, CAST(a AS INT) AS start, CAST(a + n AS INT) AS "end", l[k] AS raw, regexp_extract(l[k], '(?i)\\d+[A-Z]?(?:\\.[\\pL\\pN_]+)?') AS path FROM spans JOIN lists USING (text_id) WHERE length(trim(l[k])) >= 2""",
    "e6_lookup": _with(_NODES, _VERSIONS)
    + """, near AS (SELECT source, parent_path, string_agg(path, ',' ORDER BY path) AS candidates FROM (SELECT *, row_number() OVER (PARTITION BY source, parent_path ORDER BY path) AS k FROM sections) WHERE k <= 5 GROUP BY ALL),
 sized AS (SELECT source, parent_path, count(*) FILTER (WHERE NOT is_repealed) AS n FROM sections GROUP BY ALL)
SELECT s.node_id AS query_id, CASE s.node_id % 4 WHEN 0 THEN CASE WHEN h.version_id IS NULL THEN 'no_version' ELSE 'section' END WHEN 1 THEN 'missing' WHEN 2 THEN 'chapter' ELSE 'parse_error' END AS outcome,
 CASE WHEN s.node_id % 4 = 0 THEN h.version_id END AS version_id, CASE WHEN s.node_id % 4 = 2 THEN z.n ELSE 0 END AS n_sections, CASE WHEN s.node_id % 4 = 1 THEN near.candidates ELSE '' END AS candidates
FROM sections s LEFT JOIN shown h USING (node_id) JOIN near ON near.source = s.source AND near.parent_path = s.parent_path JOIN sized z ON z.source = s.source AND z.parent_path = s.parent_path WHERE s.node_id > 0""",
    "e6_chapter_sections": _with(_NODES) + "SELECT source, parent_path AS chapter, path FROM sections s WHERE NOT is_repealed AND EXISTS (SELECT 1 FROM sections q WHERE q.source = s.source AND q.parent_path = s.parent_path AND q.node_id > 0 AND q.node_id % 4 = 2)",
    "e7_lookup_any_source": _with(_NODES, _VERSIONS)
    + """, first AS (SELECT min(lang) AS s FROM documents), tops_of AS (SELECT path, min(source) AS s FROM tops GROUP BY path)
SELECT s.node_id AS query_id, CASE s.node_id % 4 WHEN 0 THEN CASE WHEN h.version_id IS NULL THEN first.s ELSE s.source END WHEN 2 THEN tops_of.s ELSE first.s END AS source,
 CASE s.node_id % 4 WHEN 0 THEN CASE WHEN h.version_id IS NOT NULL THEN 'section' WHEN s.source = first.s THEN 'no_version' ELSE 'missing' END WHEN 1 THEN 'missing' WHEN 2 THEN 'chapter' ELSE 'parse_error' END AS outcome
FROM sections s LEFT JOIN shown h USING (node_id) JOIN tops_of ON tops_of.path = s.parent_path CROSS JOIN first WHERE s.node_id > 0""",
    "e8_links": _with(_NODES, _VERSIONS, _BRIEFS, _CITED) + "SELECT DISTINCT text_id * 3 AS node_id, raw, path AS target_path FROM checked WHERE status = 'valid' AND (is_section OR signed) AND coalesce(node_id, -1) <> text_id * 3",
    "e9_edges": _with(_NODES, _VERSIONS, _BRIEFS, _CITED) + "SELECT DISTINCT text_id AS from_version, checked.path AS to_path FROM checked JOIN shown h ON h.version_id = text_id WHERE status = 'valid' AND (is_section OR signed) AND coalesce(checked.node_id, -1) <> text_id",
    "e10_references": _with(_NODES, _VERSIONS)
    + """SELECT 'outgoing' AS direction, CAST(1 AS BIGINT) AS version_id, node_id FROM versions WHERE node_id % 11 = 0 AND EXISTS (SELECT 1 FROM shown WHERE version_id = 1)
UNION ALL SELECT 'incoming', version_id, node_id FROM shown WHERE version_id % 5 = 0""",
    "f1_citations": _with(_NODES, _VERSIONS, _BRIEFS, _CITED) + "SELECT text_id, raw, c.path, status, CASE WHEN status = 'not_found' THEN coalesce(candidates, '') ELSE '' END AS candidates FROM checked c LEFT JOIN near n ON n.source = c.source AND n.chapter = c.chapter",
    "f1_report": _with(_NODES, _VERSIONS, _BRIEFS, _CITED)
    + """SELECT text_id, count(*) AS n_citations, count(*) FILTER (WHERE status = 'valid') AS n_valid, count(*) FILTER (WHERE status = 'repealed') AS n_repealed,
 count(*) FILTER (WHERE status = 'not_found') AS n_not_found, CAST(0 AS BIGINT) AS n_parse_error FROM checked GROUP BY text_id""",
    "f5_audit": _with(_NODES, _VERSIONS, _BRIEFS, _CITED) + "SELECT DISTINCT text_id, version_id, v.effective_from FROM checked JOIN versions v USING (version_id) WHERE v.effective_from >= DATE '2024-06-01'",
    "f6_audit_tables": _with(_NODES, _VERSIONS, _BRIEFS, _CITED)
    + f""", three AS (SELECT source, parent_path AS chapter, string_agg(path, ', ' ORDER BY path) AS first_ones FROM (SELECT *, row_number() OVER (PARTITION BY source, parent_path ORDER BY path) AS k FROM sections) WHERE k <= 3 GROUP BY ALL),
 cells AS (SELECT c.*, {_CELL.format("coalesce(n.heading, '')")} AS heading, coalesce('https://law.example/' || n.path, '') AS url, n.path AS node_path FROM checked c LEFT JOIN nodes n ON n.source = c.source AND n.path = c.path),
 of_cites AS (SELECT text_id, string_agg('| ' || status || ' | ' || {_CELL.format("raw")} || ' | ' || c.chapter || ' | ' || CASE WHEN is_section THEN path ELSE '' END || ' | ' || heading || ' | ' || url || ' | ' || CASE WHEN status = 'not_found' THEN coalesce(first_ones, '') ELSE '' END || ' |', chr(10) ORDER BY pos) AS rows
   FROM cells c LEFT JOIN three t ON t.source = c.source AND t.chapter = c.chapter GROUP BY text_id),
 fresh AS (SELECT DISTINCT text_id, node_path, heading, url, v.effective_from AS day FROM cells JOIN versions v USING (version_id) WHERE v.effective_from >= DATE '2024-06-01'),
 of_fresh AS (SELECT text_id, string_agg('| ' || node_path || ' | ' || heading || ' | ' || day || ' | ' || url || ' |', chr(10) ORDER BY node_path) AS rows FROM fresh GROUP BY text_id)
SELECT text_id, sha256(CASE WHEN c.rows IS NULL THEN '_No items._' ELSE '| Status | As cited | Chapter | Section | Heading | Official URL | Candidates (if missing) |' || chr(10) || '|---|---|---|---|---|---|---|' || chr(10) || c.rows END) AS citations_hash,
 sha256(CASE WHEN f.rows IS NULL THEN '_No cited sections amended since 2024-06-01._' ELSE '| Section | Heading | Effective from | Official URL |' || chr(10) || '|---|---|---|---|' || chr(10) || f.rows END) AS amended_hash
FROM briefs LEFT JOIN of_cites c USING (text_id) LEFT JOIN of_fresh f USING (text_id)""",
    "f8_payloads": _with(_NODES, _VERSIONS, _BRIEFS, _CITED)
    + r""", cut AS (SELECT version_id, rtrim(body, chr(32)||chr(9)||chr(10)||chr(13)) AS t, instr(reverse(substr(t, 1, 800)), ' ') AS gap FROM versions),
 sized AS (SELECT version_id, CASE WHEN length(t) <= 800 THEN length(t) ELSE 1 + length(regexp_replace(substr(t, 1, CASE WHEN gap > 0 AND 800 - gap > 720 THEN 800 - gap ELSE 800 END), '\s+$', '')) END AS n FROM cut)
SELECT text_id, CAST(NULL AS VARCHAR) AS error, count(*) AS n_citations, string_agg(path || ':' || status || ':' || coalesce(n, 0), ',' ORDER BY pos) AS citations FROM checked LEFT JOIN sized USING (version_id) GROUP BY text_id""",
    "f7_definitions": _with(_NODES, _VERSIONS)
    + """, first AS (SELECT * FROM shown ORDER BY source, path LIMIT 25)
SELECT node_id, '"Fast reason"' AS term, 'body ' || node_id || '.' AS definition FROM first""",
    "g1_sources": _with(_NODES) + "SELECT source, count(*) FILTER (WHERE parent_path IS NULL) AS n_chapters, count(*) FILTER (WHERE parent_path IS NOT NULL AND NOT is_repealed) AS n_sections FROM nodes GROUP BY source",
    "g1_typed_sources": _with(_NODES)
    + """, typed AS (SELECT source, is_repealed, CASE WHEN parent_path IS NULL THEN CASE source WHEN 'de' THEN 'title' ELSE 'chapter' END WHEN node_id % 2 = 0 THEN 'section' ELSE 'rule' END AS t FROM nodes)
SELECT source, CASE source WHEN 'de' THEN 'title' WHEN 'en' THEN 'chapter' WHEN 'fr' THEN 'chapter' END AS top_type, count(*) FILTER (WHERE source IN ('de', 'en', 'fr') AND t IN ('title', 'chapter')) AS n_chapters,
 count(*) FILTER (WHERE NOT is_repealed AND (source = 'de' AND t IN ('rule', 'section') OR source = 'en' AND t = 'section')) AS n_sections, CASE source WHEN 'de' THEN 'Rules' WHEN 'en' THEN 'Sections' ELSE 'Entries' END AS entry_label FROM typed GROUP BY source""",
    "g2_chapters": _with(_NODES)
    + """, n AS (SELECT source, parent_path, count(*) FILTER (WHERE NOT is_repealed) AS n_sections FROM sections GROUP BY ALL)
SELECT t.source, t.path, n_sections, row_number() OVER (PARTITION BY t.source ORDER BY CAST(t.path AS INT)) AS place FROM tops t JOIN n ON n.source = t.source AND n.parent_path = t.path""",
    "g3_chapter": _with(_NODES) + "SELECT path, row_number() OVER (ORDER BY node_id) AS place, 'Code § ' || path AS citation, CASE WHEN node_id % 2 = 0 THEN 'Division I' ELSE '' END AS division FROM sections WHERE source = 'en' AND parent_path = '1' AND NOT is_repealed",
    "g4_nodes": _with(_NODES, _VERSIONS)
    + """SELECT s.node_id, s.path, 'Chapter ' || s.parent_path AS chapter_heading, h.version_id, CASE WHEN h.version_id IS NULL THEN 0 ELSE 1 END AS n_versions, CASE WHEN h.version_id % 5 = 0 THEN 1 ELSE 0 END AS n_links
FROM sections s LEFT JOIN shown h USING (node_id) WHERE s.node_id > 0""",
    "h1_scores": _with(_JUDGED) + "SELECT query_id, n_available, n_matched, round(precision, 6)::DOUBLE AS precision, round(recall, 6) AS recall, hit FROM scores",
    "h2_summary": _with(_JUDGED)
    + """, tagged AS (SELECT NULL AS tag, * FROM scores UNION ALL SELECT 'all', * FROM scores UNION ALL SELECT 'label' || label, * FROM scores)
SELECT tag, count(*) AS n, round(avg(precision::DOUBLE), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall, count(*) FILTER (WHERE hit) AS n_hits FROM tagged GROUP BY tag""",
    "h3_traces": _with(_TURNS)
    + """SELECT turn_id, CASE WHEN searched THEN question ELSE '' END AS queries, CASE WHEN searched THEN 1 ELSE 0 END AS num_searches,
 CASE WHEN searched AND has_hits THEN contains(answer, CAST(turn_id AS VARCHAR)) END AS top_result_used FROM turns""",
    "h6_retrieved_paths": _with(_TURNS) + "SELECT turn_id, array_to_string(paths, ',') AS paths FROM found",
    "h7_turn_scores": _with(_TURNS) + "SELECT turn_id, retrieval_hit, cite_hit, abstained FROM turn_scores",
    "h7_by_kind": _with(_TURNS) + "SELECT kind, count(*) AS n, count(*) FILTER (WHERE retrieval_hit) AS n_retrieval_hit, count(*) FILTER (WHERE cite_hit) AS n_cite_hit, count(*) FILTER (WHERE abstained) AS n_abstained FROM turn_scores GROUP BY kind",
    "h8_daily_quota": """
WITH u AS (SELECT event_id AS call_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS used FROM events)
SELECT call_id, used, used <= 2 AS allowed, greatest(2 - used, 0) AS remaining FROM u""",
    "h8_usage": """
WITH u AS (SELECT user_id AS key, CAST(ts AS DATE) AS day, count(*) AS used, CASE user_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 5000 WHEN 2 THEN 50000 END AS quota FROM events GROUP BY ALL)
SELECT key, day, used, CASE WHEN quota IS NULL THEN 0 ELSE greatest(used - quota, 0) END AS n_refused, CASE WHEN quota IS NOT NULL THEN greatest(quota - used, 0) END AS remaining FROM u""",
    "h9_features": """
SELECT event_id AS call_id, CASE user_id % 4 WHEN 0 THEN event_id % 3 = 0 WHEN 1 THEN event_id % 3 < 2 WHEN 2 THEN true ELSE false END AS allowed FROM events""",
    "h10_chat_caps": """
WITH r AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, row_number() OVER (PARTITION BY date_trunc('month', ts) ORDER BY ts, event_id) AS m,
 row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS d FROM events)
SELECT month, CASE WHEN m > 3000 THEN 503 WHEN d > 2 THEN 429 ELSE 200 END AS code, count(*) AS n FROM r GROUP BY ALL""",
    "h12_footers": _with(_TURNS) + "SELECT turn_id, array_to_string(CASE WHEN len(used) > 0 THEN used ELSE paths END, ',') AS footer FROM cited",
    "h16_event_folds": """
WITH e AS (SELECT user_id AS run_id, event_id AS seq, ['tool_start', 'delta', 'delta', 'done', 'error', 'tool_start'][event_id % 6 + 1] AS type, event_type AS text FROM events),
 stops AS (SELECT run_id, min(seq) FILTER (WHERE type IN ('done', 'error')) AS stop FROM e GROUP BY run_id),
 k AS (SELECT e.* FROM e JOIN stops USING (run_id) WHERE stop IS NULL OR seq <= stop),
 g AS (SELECT run_id, count(*) FILTER (WHERE type = 'tool_start') AS n_steps, string_agg(text, '' ORDER BY seq) FILTER (WHERE type = 'delta') AS answer, max(seq) FILTER (WHERE type = 'tool_start') AS started,
   min(seq) FILTER (WHERE type = 'delta') AS told, any_value(text) FILTER (WHERE type = 'error') AS failure, bool_or(type = 'error') AS failed, bool_or(type = 'done') AS done FROM k GROUP BY run_id)
SELECT run_id, CASE WHEN failed THEN 'The request failed: ' || coalesce(failure, '') WHEN answer IS NOT NULL THEN answer WHEN done THEN '(no answer returned)' ELSE '' END AS answer, n_steps,
 CASE WHEN failed AND n_steps > 0 AND NOT coalesce(told > started, false) THEN 1 ELSE 0 END AS n_failed, CASE WHEN failed THEN 'failed' WHEN done THEN 'success' ELSE 'running' END AS state FROM g""",
}

SQL["c8_in_place"] = SQL["c8_applied_versions"]
# A brief quotes its own document behind the number of its section.
SQL["f2_exact_quotes"] = (
    _with(_NODES, _VERSIONS)
    + f""", quoted AS (SELECT doc_id AS text_id, substr(text, 11, 60) AS raw, {_STRIP.format("substr(text, 11, 60)")} AS quote FROM documents)
SELECT text_id, sha256(quote) AS quote_hash, path, 1.0::DOUBLE AS score FROM quoted JOIN shown ON version_id = text_id WHERE length(raw) >= 6 AND quote <> ''"""
)
SQL["h8_streamed_quota"] = SQL["h8_daily_quota"]
SQL["c6_colon_diff"] = _with(_NODES, _VERSIONS, _SNAPSHOT) + "SELECT source, replace(path, '.', ':') AS path, kind FROM changes"
SQL["c13_bare_chapters"] = (
    _with(_NODES, _VERSIONS, _SNAPSHOT)
    + """SELECT 'warning' AS severity, 'unparsed_content_chapter' AS code, chapter AS path, 'chapter ' || chapter || ' has no rules' AS message
FROM covered c WHERE NOT contains(chapter, '2') AND NOT EXISTS (SELECT 1 FROM snapshot s WHERE s.source = c.source AND s.chapter = c.chapter)"""
)
SQL["c14_dry_run"] = f"SELECT kind AS what, count(*) AS n FROM ({SQL['c5_diff']}) GROUP BY kind UNION ALL SELECT code, n FROM ({SQL['c12_issues']})"
# The place of a match is where its text next occurs behind the one before.
SQL["f3_nearest_citations"] = (
    f"""WITH RECURSIVE {_BRIEFS.strip()},
 lists AS (SELECT text_id, body, 'w' AS kind, regexp_extract_all(body, '(?i)\\b(?:section|chapter)\\b') AS l FROM briefs UNION ALL SELECT text_id, body, 'n', regexp_extract_all(body, '[0-9]{{3,}}') FROM briefs),
 steps AS (
  SELECT text_id, body, kind, l, 0 AS k, 0::BIGINT AS start, 0::BIGINT AS stop FROM lists
  UNION ALL
  SELECT text_id, body, kind, l, k + 1, stop + instr(substr(body, stop + 1), l[k + 1]) - 1, stop + instr(substr(body, stop + 1), l[k + 1]) - 1 + length(l[k + 1]) FROM steps WHERE k < len(l)),
 spans AS (SELECT text_id, kind, start, stop, l[k] AS raw FROM steps WHERE k > 0),
 pairs AS (SELECT n.text_id, n.start, n.stop AS "end", w.start AS r_start, lower(w.raw) AS word, greatest(n.start - w.stop, w.start - n.stop, 0) AS distance
   FROM spans n JOIN spans w ON w.text_id = n.text_id AND n.kind = 'n' AND w.kind = 'w')
SELECT text_id, start, "end", r_start, word, distance FROM pairs WHERE distance <= 400 QUALIFY row_number() OVER (PARTITION BY text_id, start, "end" ORDER BY distance, r_start) = 1"""
)
SQL["g3_hierarchy"] = """WITH RECURSIVE n AS (
  SELECT doc_id AS node_id, CASE doc_id % 100 WHEN 61 THEN doc_id + 2 WHEN 63 THEN doc_id - 2 ELSE CASE WHEN doc_id > 0 THEN doc_id // 2 END END AS parent_id, CASE WHEN doc_id % 4 = 0 THEN lang END AS v FROM documents),
 linked AS (SELECT n.node_id, p.node_id AS parent_id, n.v FROM n LEFT JOIN n p ON p.node_id = n.parent_id),
 walk AS (
  SELECT node_id, 0::BIGINT AS depth, node_id::VARCHAR AS breadcrumb, v AS inherited, [node_id] AS line FROM linked WHERE parent_id IS NULL
  UNION ALL
  SELECT l.node_id, depth + 1, breadcrumb || '/' || l.node_id, coalesce(l.v, inherited), list_append(line, l.node_id) FROM walk JOIN linked l ON l.parent_id = walk.node_id),
 below AS (SELECT node_id, count(*) AS k FROM (SELECT unnest(line[1:len(line) - 1]) AS node_id FROM walk) GROUP BY node_id)
SELECT n.node_id, w.node_id IS NULL AS cyclic, depth, breadcrumb, inherited, CASE WHEN w.node_id IS NOT NULL THEN coalesce(k, 0) END AS n_below
FROM n LEFT JOIN walk w USING (node_id) LEFT JOIN below USING (node_id)"""

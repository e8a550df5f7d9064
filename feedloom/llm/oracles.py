"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others use hashes, models or encodings that DuckDB lacks; tests compare them with brute force.
"""

from __future__ import annotations

HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PATH = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2)"

URL_FILTER = f"""
WITH rules(host, path, verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
        ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), urls AS (
    SELECT page_id, html, {HOST} AS host, {PATH} AS path FROM pages
), listed AS (
    SELECT DISTINCT host || path AS entry FROM urls
    WHERE contains(html, 'CC BY-NC') AND host || path != ''
)
SELECT page_id, u.host, u.path, r.host || r.path AS rule,
    coalesce(r.verdict, CASE WHEN l.entry IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
    l.entry IS NOT NULL AS listed
FROM urls u
LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
LEFT JOIN listed l ON l.entry = u.host || u.path
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) = 1
"""

EXACT_DEDUP = r"""
WITH rows AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS digest
    FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    doc_id = min(doc_id) OVER w AS kept, digest AS text_sha256
FROM rows WINDOW w AS (PARTITION BY digest)
"""

WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

DECONTAMINATION = f"""
WITH item_words AS (SELECT item_id, {WORDS} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS t
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item_words WHERE len(w) > 0)
),
doc_words AS (SELECT doc_id, {WORDS} AS w FROM documents),
spans AS (
    SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t
    FROM (
        SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc_words, (SELECT DISTINCT n FROM windows)
        WHERE len(w) >= n
    )
),
hits AS (SELECT doc_id, i, s.n, item_id FROM spans s JOIN windows USING (t)),
places AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
),
items AS (
    SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(len(ids), 0)::BIGINT AS n_items,
    sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

REPEATED_LINES = r"""
WITH lines AS (
    SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
),
words AS (
    SELECT doc_id, line_no, list_filter(
        string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
        lambda x: x != ''
    ) AS w FROM lines
),
firsts AS (
    SELECT array_to_string(w, ' ') AS name, min((doc_id, line_no)) AS first, any_value(w) AS w
    FROM words WHERE len(w) > 0 GROUP BY 1
),
tokens AS (
    SELECT name, first, list_distinct(CASE WHEN len(w) < 5 THEN [name]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS t
    FROM firsts
),
each AS (SELECT name, first, len(t) AS n, unnest(t) AS token FROM tokens),
near AS (
    SELECT DISTINCT b.name
    FROM each a JOIN each b ON a.token = b.token AND a.first < b.first
    GROUP BY a.name, b.name, a.n, b.n
    HAVING 9 * count(*) >= 4 * (a.n + b.n)
),
gone AS (
    SELECT w.doc_id, w.line_no
    FROM words w JOIN firsts f ON f.name = array_to_string(w.w, ' ')
    WHERE len(w.w) > 0 AND ((w.doc_id, w.line_no) != f.first OR f.name IN (SELECT name FROM near))
),
removed AS (
    SELECT doc_id, count(*) AS n, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS numbers
    FROM (SELECT DISTINCT * FROM gone) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines,
    coalesce(n, 0)::BIGINT AS n_removed, coalesce(numbers, '') AS removed
FROM documents d LEFT JOIN removed r USING (doc_id)
"""

TERMS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

LEXICAL_SEARCH = f"""
WITH doc_terms AS (SELECT doc_id, {TERMS} AS w FROM documents),
lengths AS (SELECT doc_id, len(w)::BIGINT AS n FROM doc_terms WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
item_terms AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
counts AS (
    SELECT doc_id, term, count(*)::BIGINT AS tf
    FROM (SELECT doc_id, unnest(w) AS term FROM doc_terms)
    WHERE term IN (SELECT term FROM item_terms)
    GROUP BY doc_id, term
),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM counts, totals GROUP BY term
),
scores AS (
    SELECT item_id, doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
    FROM counts JOIN weights USING (term) JOIN lengths USING (doc_id) JOIN item_terms USING (term), totals
    GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 10
"""

NGRAM_JOIN = r"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, list_filter(
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
        lambda x: x != ''
    ) AS w FROM documents
),
tokens AS MATERIALIZED (
    SELECT doc_id, unnest(list_distinct(list_transform(
        range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')
    ))) AS token
    FROM words WHERE len(w) > 0
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id != b.doc_id
    JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, m.n, n.n
    HAVING 100 * count(*) >= 80 * (m.n + n.n - count(*))
),
reach(a, b) AS (
    SELECT doc_id, doc_id FROM sizes
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op2_url_filter": URL_FILTER,
    "op4_exact_dedup": EXACT_DEDUP,
    "op5_decontamination": DECONTAMINATION,
    "op10_line_dedup": REPEATED_LINES,
    "op12_lexical_search": LEXICAL_SEARCH,
    "op13_ngram_join": NGRAM_JOIN,
}

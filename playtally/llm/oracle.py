"""DuckDB twins of the queries that SQL can express."""

LINE_DEDUP = r"""
WITH texts AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), every AS (
    SELECT doc_id, i - 1 AS line, list_filter(regexp_split_to_array(ls[i], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM texts, unnest(range(1, len(ls) + 1)) AS t(i) WHERE length(text) > 0
), able AS (
    SELECT doc_id, line, array_to_string(ws, ' ') AS words, ws FROM every WHERE len(ws) >= 1
), alike AS (
    SELECT words, any_value(ws) AS ws, min(row(doc_id, line)) AS first FROM able GROUP BY words
), cut AS (
    SELECT words, first, md5(array_to_string(list_concat(ws[:i - 1], ws[i + 1:]), ' ')) AS without,
        md5(array_to_string(list_concat(ws[:i - 1], [chr(7)], ws[i + 1:]), ' ')) AS hole
    FROM alike, unnest(range(1, len(ws) + 1)) AS t(i) WHERE len(ws) >= 5
), holes AS (
    SELECT hole, min(first) AS first FROM cut GROUP BY hole HAVING count(*) > 1
), near AS (
    SELECT c.words FROM cut c JOIN holes h ON c.hole = h.hole AND h.first < c.first
    UNION SELECT c.words FROM cut c JOIN alike a ON c.without = md5(a.words) AND len(a.ws) >= 5 AND a.first < c.first
    UNION SELECT a.words FROM cut c JOIN alike a ON c.without = md5(a.words) AND len(a.ws) >= 5 AND c.first < a.first
), gone AS (
    SELECT b.doc_id, b.line FROM able b JOIN alike a USING (words)
    WHERE row(b.doc_id, b.line) > a.first OR b.words IN (SELECT words FROM near)
), lists AS (
    SELECT doc_id, list(line) AS gone FROM gone GROUP BY doc_id
)
SELECT t.doc_id, CASE WHEN length(text) > 0 THEN len(ls) ELSE 0 END AS n_lines,
    coalesce(len(gone), 0) AS n_removed,
    sha256(coalesce(CASE WHEN gone IS NULL THEN text ELSE array_to_string(
        list_transform(list_filter(range(len(ls)), lambda i: NOT list_contains(gone, i)), lambda i: ls[i + 1]), chr(10)) END, '')
    ) AS kept_sha256
FROM texts t LEFT JOIN lists USING (doc_id)
"""

RANKED_SEARCH = r"""
WITH kinds AS (
    SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS term,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS capital, 'abcdefghijklmnopqrstuvwxyz' AS small
), found AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, capital, small), term)) AS term FROM documents, kinds
), counted AS (
    SELECT doc_id, term, count(*) AS tf FROM found GROUP BY ALL
), sizes AS (
    SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id
), totals AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM counted, totals GROUP BY term
), asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, capital, small), kinds.term)) AS term
    FROM benchmark, kinds
), times AS (
    SELECT item_id, term, count(*) AS q FROM asked GROUP BY ALL
), scores AS (
    SELECT item_id, doc_id,
        sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
    FROM times JOIN counted USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals
    GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""

ORACLE_SQL = {"op6_line_dedup": LINE_DEDUP, "op11_ranked_search": RANKED_SEARCH}

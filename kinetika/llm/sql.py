"""DuckDB SQL that gives the rows of the queries which SQL can express."""

OP5 = r"""
WITH words AS (
    SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), item_words AS (
    SELECT row_number() OVER () AS i, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL
), shingles AS (
    SELECT DISTINCT d, doc_id, array_to_string(w[p : p + 4], ' ') AS s FROM words, range(1, greatest(len(w) - 3, 2)) t(p) WHERE len(w) > 0
), item_shingles AS (
    SELECT DISTINCT i, item_id, array_to_string(w[p : p + 4], ' ') AS s FROM item_words, range(1, greatest(len(w) - 3, 2)) t(p) WHERE len(w) > 0
), sizes AS (
    SELECT i, count(*) AS n FROM item_shingles GROUP BY i
)
SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS shared, CAST(n AS INTEGER) AS item_shingles, count(*) / CAST(n AS DOUBLE) AS containment
FROM shingles JOIN item_shingles USING (s) JOIN sizes USING (i)
GROUP BY d, doc_id, i, item_id, n HAVING count(*) >= 0.8 * n
"""

OP8 = r"""
WITH lines AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), windows AS (
    SELECT doc_id, i AS pos, md5(l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2]) AS w FROM lines, range(1, len(l) - 1) t(i) WHERE len(l) >= 3
), later AS (
    SELECT doc_id, pos FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) > 1
), covered AS (
    SELECT doc_id, list(DISTINCT p) AS gone FROM later, range(pos, pos + 3) t(p) GROUP BY doc_id
)
SELECT doc_id,
    CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(gone, i)), lambda i: l[i]), chr(10)), '') END AS text,
    CAST(coalesce(len(gone), 0) AS BIGINT) AS removed_lines
FROM lines LEFT JOIN covered USING (doc_id)
"""

OP2 = r"""
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), parts AS (
    SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(x, CAST(5 * i + 1 AS INTEGER), 5) AS INTEGER)) AS fives FROM payloads
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(fives, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
    CASE WHEN page_id = max(page_id) OVER (PARTITION BY x) THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = max(page_id) OVER (PARTITION BY x) THEN NULL ELSE max(page_id) OVER (PARTITION BY x) END AS refers_to
FROM parts
"""

ORACLE_SQL: dict[str, str] = {"op2_warc": OP2, "op5_decontamination": OP5, "op8_line_dedup": OP8}

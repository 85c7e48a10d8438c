"""DuckDB's SQL for those queries of this folder that SQL can express: whole tables, the same columns."""

from __future__ import annotations

#: Words as the operator takes them, of a column of text.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {WORDS} AS w FROM benchmark),
sized AS (SELECT item, w, least(8, len(w)) AS m FROM items WHERE len(w) > 0),
starts AS (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS pos FROM sized),
patterns AS (SELECT DISTINCT item, m, array_to_string(list_slice(w, pos, pos + m - 1), ' ') AS pattern FROM starts),
docs AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, {WORDS} AS w FROM documents),
places AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS pos FROM docs, (SELECT DISTINCT m FROM patterns) WHERE len(w) >= m),
windows AS (SELECT r, m, pos, array_to_string(list_slice(w, pos, pos + m - 1), ' ') AS pattern FROM places),
found AS (SELECT r, m, pos, item FROM windows JOIN patterns USING (m, pattern)),
hit AS (SELECT r, COUNT(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos, pos + m)) AS p FROM (SELECT DISTINCT r, m, pos FROM found)) GROUP BY r),
named AS (SELECT r, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

VECTOR_SEARCH = """
WITH usable AS (
    SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
),
scored AS (
    SELECT q.id AS query_id, c.id AS vec_id, list_inner_product(q.v, c.v) AS score
    FROM usable AS q JOIN usable AS c ON len(q.v) = len(c.v) AND q.id <> c.id WHERE q.id % 20 = 0
),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM scored)
SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 20
"""

SQL = {"op7_decontamination": DECONTAMINATION, "op10_vector_search": VECTOR_SEARCH}

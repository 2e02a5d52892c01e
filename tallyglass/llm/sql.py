"""DuckDB SQL for the corpus queries that SQL can express."""

SQL = {
    "op4_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm)
    """,
    "op7_decontaminate": r"""
        WITH dw AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        iw AS (
            SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, array_to_string(w[s : s + 9], ' ') AS phrase, least(len(w), 10) AS n
            FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM iw WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM win),
        dwin AS (
            SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS phrase
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
        hit AS (SELECT dwin.doc_id, dwin.s, win.n, win.item_id FROM dwin JOIN win USING (phrase, n)),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
        far AS (
            SELECT DISTINCT item_id, list_sort(list_distinct(w[s : s + 9])) AS terms
            FROM (SELECT item_id, w, unnest(list_distinct(list_append(range(1, greatest(1, len(w) - 9) + 1, 10), greatest(1, len(w) - 9)))) AS s FROM iw WHERE len(w) > 0)),
        sets AS (SELECT terms, row_number() OVER () AS k FROM (SELECT DISTINCT terms FROM far)),
        post AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM dw) WHERE w[p] IN (SELECT unnest(terms) FROM sets)),
        slots AS (SELECT k, len(terms) AS n, unnest(terms) AS word FROM sets),
        hold AS (SELECT doc_id, k FROM post JOIN slots USING (word) GROUP BY doc_id, k, n HAVING count(DISTINCT word) = n),
        here AS (SELECT post.doc_id, k, n, p, word FROM post JOIN slots USING (word) JOIN hold USING (doc_id, k)),
        close AS (SELECT DISTINCT a.doc_id, a.k FROM here a JOIN here b ON a.doc_id = b.doc_id AND a.k = b.k AND b.p BETWEEN a.p AND a.p + 19 GROUP BY a.doc_id, a.k, a.n, a.p HAVING count(DISTINCT b.word) = a.n),
        nr AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM close JOIN sets USING (k) JOIN far USING (terms) GROUP BY 1),
        it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
        SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
        FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nr USING (doc_id)
    """,
}

"""SQL for DuckDB that gives the same rows as those pN_ queries that SQL can express.

The others are tested against brute force: p2 (sequential acceptance), p3 (trained
classifiers), p8 (no single right packing, only whether one is right), and some of the reports
beside the pN_found queries.
"""

from __future__ import annotations

_BLANK = r"[\s\x{00A0}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]+"
_NAME = rf"regexp_replace(regexp_replace(regexp_replace(lower(%s), '{_BLANK}', '', 'g'), '^(https?://)?([a-z0-9-]+\.)+[a-z]{{2,}}/+', ''), '^@+|[/?#].*$', '', 'g')"
_OWNED = f"""
    u AS (SELECT {_NAME % 'username'} AS c, max(avg_value_score) AS a FROM uiux_creators GROUP BY 1),
    o AS (SELECT row_no, nullif({_NAME % 'fields.owner'}, '') AS c, fields.value_score AS v FROM canonical_records),
    r AS (SELECT row_no, o.c AS contributor, coalesce(v, a, 0)::DOUBLE AS quality FROM o LEFT JOIN u ON u.c = o.c),
    k AS (SELECT *, row_number() OVER (PARTITION BY contributor ORDER BY quality DESC, row_no) AS n FROM r)"""
_RECORD_WORDS = r"regexp_extract_all(lower(concat_ws(chr(10), fields.caption, fields.transcript, fields.summary)), '[\p{L}\p{N}]+')"

SQL: dict[str, str] = {
    "p1_found": """SELECT DISTINCT 'chunks' AS item_table, chunk_id AS item_key FROM chunks WHERE length(text) > 2000
        UNION SELECT DISTINCT 'canonical_records', row_no::VARCHAR FROM canonical_records WHERE length(fields.transcript) > 2000""",
    "p1_rebuilt": """SELECT 'chunks' AS item_table, chunk_id AS item_key, TRUE AS whole FROM chunks WHERE length(text) > 2000
        UNION ALL SELECT 'canonical_records', row_no::VARCHAR, TRUE FROM canonical_records WHERE length(fields.transcript) > 2000""",
    "p7_links": f"""
        WITH w AS (SELECT row_no, {_RECORD_WORDS} AS t FROM canonical_records),
        c AS (SELECT row_no, t, min(row_no) OVER (PARTITION BY t) AS class_id FROM w WHERE len(t) > 0),
        s AS (SELECT DISTINCT row_no, array_to_string(t[i : i + 4], ' ') AS g FROM (SELECT row_no, t, unnest(range(1, greatest(len(t) - 4, 1) + 1)) AS i FROM c WHERE class_id = row_no)),
        n AS (SELECT row_no, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.row_no AS a, b.row_no AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.row_no <> b.row_no GROUP BY 1, 2),
        l AS (SELECT a AS class_id, count(*) AS n_links FROM p JOIN n x ON x.row_no = a JOIN n y ON y.row_no = b WHERE shared::DOUBLE / (x.n + y.n - shared) >= 0.8 GROUP BY 1)
        SELECT w.row_no, coalesce(c.class_id, w.row_no) AS class_id, coalesce(n_links, 0) AS n_links FROM w LEFT JOIN c ON c.row_no = w.row_no LEFT JOIN l ON l.class_id = c.class_id""",
    "p8_covered": "SELECT doc_id, TRUE AS covered FROM documents",
    "p10_shares": r"""
        WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), []) AS t FROM documents),
        g AS (SELECT doc_id, i, array_to_string(t[i : i + 7], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 6)) AS i FROM w WHERE len(t) >= 8)),
        b AS (SELECT doc_id, i FROM (SELECT *, min(i) OVER (PARTITION BY doc_id, g) AS first FROM g) WHERE i > first),
        c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM b, (SELECT unnest(range(0, 8)) AS k) GROUP BY 1)
        SELECT w.doc_id, len(t) AS n_words, coalesce(n, 0) AS n_repeated, round(CASE WHEN len(t) > 0 THEN coalesce(n, 0) / len(t) ELSE 0.0 END, 6) AS repeated_share FROM w LEFT JOIN c ON c.doc_id = w.doc_id""",
    "p4_found": """
        WITH s AS (SELECT run_id, backend AS list, record_id, score FROM hits UNION ALL SELECT run_id, retriever, record_id, score FROM ranked_hits),
        b AS (SELECT run_id, list, record_id, max(score) AS score FROM s WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2, 3),
        k AS (SELECT *, rank() OVER (PARTITION BY run_id, list ORDER BY score DESC) + (count(*) OVER (PARTITION BY run_id, list, score) - 1) / 2 AS r, count(*) OVER (PARTITION BY run_id, list) AS n FROM b),
        l AS (SELECT run_id, count(DISTINCT list) AS lists FROM b GROUP BY 1),
        f AS (SELECT run_id, record_id, round(sum(1 - (r - 1) / n) / any_value(lists), 12) AS score FROM k JOIN l USING (run_id) GROUP BY 1, 2)
        SELECT run_id, record_id FROM f QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY score DESC, record_id) = 1""",
    # The first principal component by power iteration over DuckDB's own correlations of the rank-transformed lists.
    "p4_ranking": """
        WITH RECURSIVE s AS (SELECT run_id, backend AS list, record_id, score FROM hits UNION ALL SELECT run_id, retriever, record_id, score FROM ranked_hits),
        b AS (SELECT run_id, list, record_id, max(score) AS score FROM s WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2, 3),
        k AS (SELECT *, 1 - (rank() OVER (PARTITION BY run_id, list ORDER BY score DESC) + (count(*) OVER (PARTITION BY run_id, list, score) - 1) / 2 - 1) / count(*) OVER (PARTITION BY run_id, list) AS v FROM b),
        names AS (SELECT list, row_number() OVER (ORDER BY list) AS i FROM (SELECT DISTINCT list FROM s)),
        there AS (SELECT DISTINCT run_id, list FROM b),
        recs AS (SELECT DISTINCT run_id, record_id FROM b),
        t AS (SELECT r.run_id, r.record_id, i, coalesce(k.v, 0)::DOUBLE AS v FROM recs r JOIN there USING (run_id) JOIN names USING (list) LEFT JOIN k ON k.run_id = r.run_id AND k.list = there.list AND k.record_id = r.record_id),
        c AS (SELECT x.i AS i, y.i AS j, corr(x.v, y.v) AS r FROM t x JOIN t y USING (run_id, record_id) GROUP BY 1, 2),
        m AS (SELECT list(row ORDER BY i) AS m FROM (SELECT i, list(CASE WHEN i = j THEN 1.0::DOUBLE ELSE coalesce(r, 0) END ORDER BY j) AS row FROM c GROUP BY 1)),
        it AS (SELECT 0 AS n, list_transform(m, lambda x: 1.0::DOUBLE) AS l FROM m UNION ALL
               SELECT n + 1, list_transform(list_transform(m, lambda x: list_dot_product(x, l)), lambda z: z / sqrt(list_dot_product(list_transform(m, lambda x: list_dot_product(x, l)), list_transform(m, lambda x: list_dot_product(x, l))))) FROM it, m WHERE n < 400),
        l AS (SELECT l FROM it ORDER BY n DESC LIMIT 1),
        f AS (SELECT run_id, record_id, round(sum(l.l[i] * v) / sum(l.l[i]), 12) AS score FROM t, l GROUP BY 1, 2)
        SELECT run_id, record_id, round(score, 6) AS score, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, record_id) AS position FROM f""",
    "p5_found": """
        WITH e AS (SELECT DISTINCT key, embedding::DOUBLE[] AS v, split_part(key, '::', 2) || '::' || split_part(key, '::', 3) AS space FROM embed_cache
                   WHERE embedding IS NOT NULL AND list_max(list_transform(embedding, lambda x: abs(x))) > 0)
        SELECT a.key AS key_a, b.key AS key_b FROM e a JOIN e b ON a.space = b.space AND a.key < b.key AND list_cosine_similarity(a.v, b.v) >= 0.9""",
    "p6_found": f"WITH {_OWNED} SELECT row_no FROM k WHERE contributor IS NOT NULL AND n > 10",
    "p6_kept": f"WITH {_OWNED} SELECT row_no, contributor, quality FROM k WHERE contributor IS NULL OR n <= 10",
    "p6_share": f"""
        WITH {_OWNED},
        c AS (SELECT contributor, count(*) AS n FROM r WHERE contributor IS NOT NULL GROUP BY 1),
        f AS (SELECT g.cap, sum(least(c.n, g.cap)) + (SELECT count(*) FROM r WHERE contributor IS NULL) AS total FROM c, (SELECT unnest(range(1, (SELECT max(n) FROM c) + 1)) AS cap) g GROUP BY 1),
        best AS (SELECT max(cap) AS cap FROM f WHERE cap <= 0.02 * total + 1e-9)
        SELECT row_no, contributor, quality FROM k, best WHERE contributor IS NULL OR n <= coalesce(best.cap, (SELECT min(n) FROM c))""",
    "p7_found": f"""
        WITH w AS (SELECT row_no, {_RECORD_WORDS} AS t FROM canonical_records),
        s AS (SELECT DISTINCT row_no, array_to_string(t[i : i + 2], ' ') AS g FROM (SELECT row_no, t, unnest(range(1, greatest(len(t) - 2, 1) + 1)) AS i FROM w WHERE len(t) > 0)),
        n AS (SELECT row_no, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.row_no AS a, b.row_no AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.row_no < b.row_no GROUP BY 1, 2)
        SELECT a AS row_no_a, b AS row_no_b FROM p JOIN n x ON x.row_no = a JOIN n y ON y.row_no = b WHERE shared::DOUBLE / (x.n + y.n - shared) >= 0.5""",
    "p9_found": r"""
        WITH d AS (SELECT doc_id::VARCHAR AS id, FALSE AS item, text FROM documents UNION ALL SELECT item_id, TRUE, text FROM eval_items),
        w AS (SELECT id, item, regexp_extract_all(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[\p{Mn}\p{Me}\p{Cf}]', '', 'g'), '[a-z0-9]+') AS t FROM d WHERE text IS NOT NULL),
        g AS (SELECT DISTINCT id, item, array_to_string(t[i : i + 12], ' ') AS g FROM (SELECT id, item, t, unnest(range(1, len(t) - 11)) AS i FROM w WHERE len(t) >= 13))
        SELECT DISTINCT a.id::BIGINT AS doc_id, b.id AS item_id FROM g a JOIN g b ON a.g = b.g WHERE NOT a.item AND b.item""",
    "p10_found": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents WHERE text IS NOT NULL),
        p AS (SELECT doc_id, len(t) AS n, unnest(range(1, len(t) + 1)) AS i, t FROM w),
        g AS (SELECT doc_id, n, i, CASE WHEN i <= n - 7 THEN md5(array_to_string(t[i : i + 7], ' ')) END AS g FROM p),
        b AS (SELECT doc_id, n, i, g IS NOT NULL AND i > min(i) OVER (PARTITION BY doc_id, g) AS again FROM g),
        c AS (SELECT doc_id, n, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM b)
        SELECT doc_id FROM c GROUP BY 1 HAVING sum(covered) / any_value(n) >= 0.3""",
}

"""SQL for DuckDB that gives the same rows as the queries of ``catalog``."""

from __future__ import annotations

_SEARCH = ("summary", "transcript", "workflow_steps", "tips", "caption", "concepts", "tools_apps", "tags")
_LISTS = ("workflow_steps", "tips", "concepts", "tools_apps", "tags", "domains")
_FIELDS = ("post_id", "shortcode", "url", "owner", "content_type", "domains", "is_educational", "value_score", "gated_content", "summary", "transcript", "workflow_steps", "tips", "caption", "concepts", "tools_apps", "tags", "extraction_status", "is_promo")
_BLANKS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _part_list(f: str) -> str:
    items = f"fields.{f}" if f in _LISTS else f"[fields.{f}]"
    return f"coalesce(list_filter({items}, lambda x: x IS NOT NULL AND regexp_replace(x, '\\s', '', 'g') <> ''), []::VARCHAR[])"


def _joined(f: str) -> str:
    return f"array_to_string({_part_list(f)}, chr(10))"


_STORE = "(SELECT * FROM canonical_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_no DESC) = 1)"

_CHUNK_COLUMNS = "id || '::' || c.f || '::' || idx AS chunk_id, id AS record_id, c.f AS chunk_field, idx::INT AS chunk_idx, length(c.t)::INT AS chars, md5(c.t) AS text_md5, provenance.media_ref AS media_ref"


def _texts(entries: str, records: str) -> str:
    return f"""SELECT id || '::' || c.f || '::' || idx AS chunk_id, id AS record_id, NULL AS content_type, c.t AS text FROM (
      SELECT id, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS idx FROM (SELECT id, list_filter({entries}, lambda x: x.t <> '') AS l FROM {records}))"""


def _chunks(entries: str) -> str:
    return f"""
    WITH e AS (SELECT id, provenance, list_filter({entries}, lambda x: x.t <> '') AS l FROM canonical_records),
    u AS (SELECT id, provenance, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS idx FROM e)
    SELECT {_CHUNK_COLUMNS} FROM u"""


_BY_FIELD = "[" + ", ".join(f"{{'f': '{f}', 't': {_joined(f)}}}" for f in _SEARCH) + "]"
_BY_SIZE = "flatten([" + ", ".join(
    f"CASE WHEN length({_joined(f)}) > 0 THEN list_transform(range(0, ceil(greatest(length({_joined(f)}) - 500, 0) / 400)::BIGINT + 1), lambda i: {{'f': '{f}', 't': substring({_joined(f)}, (i * 400 + 1)::BIGINT, 500)}}) ELSE [] END"
    for f in ("summary", "transcript", "caption")
) + "])"

_QUESTIONS = "SELECT question_id AS qid, question FROM gold_questions"
_FIXED = "SELECT * FROM (VALUES ('a', 'eye-can rest rest'), ('b', 'fonts-load-late — poster')) v(qid, question)"


_CHUNKS = "SELECT DISTINCT chunk_id, record_id, json_extract_string(metadata, '$.content_type') AS content_type, text FROM chunks"


def _bm25(tail: str, questions: str = _QUESTIONS, chunks: str = _CHUNKS) -> str:
    return rf"""
    WITH ch AS ({chunks}),
    tk AS (SELECT chunk_id, record_id, content_type, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{{L}}\p{{N}}]+') AS toks FROM ch),
    st AS (SELECT count(*)::DOUBLE AS n_all, avg(len(toks)) AS avgdl FROM tk),
    pos AS (SELECT chunk_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM tk),
    q AS ({questions}),
    parts AS (SELECT qid, unnest(list_filter(regexp_split_to_array(question, '\s+'), lambda x: x <> '')) AS part FROM q),
    ph AS (SELECT qid, regexp_extract_all(strip_accents(lower(part)), '[\p{{L}}\p{{N}}]+') AS toks, count(*) AS times FROM parts GROUP BY 1, 2),
    asked AS (SELECT * FROM ph WHERE len(toks) > 0),
    found AS (
      SELECT p.toks, pos.chunk_id, count(*) AS f FROM (SELECT DISTINCT toks FROM asked) p JOIN pos ON pos.tok = p.toks[1] JOIN tk ON tk.chunk_id = pos.chunk_id
      WHERE tk.toks[pos.i : pos.i + len(p.toks) - 1] = p.toks GROUP BY 1, 2),
    n AS (SELECT toks, count(*) AS n FROM found GROUP BY 1),
    w AS (SELECT qid, a.toks, times, greatest(ln((n_all - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)), 1e-6::DOUBLE) AS idf, avgdl FROM asked a JOIN n USING (toks), st),
    m AS (
      SELECT w.qid, found.chunk_id, round(sum(times * idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(tk.toks) / avgdl))), 9) AS score, count(*) AS met
      FROM found JOIN w USING (toks) JOIN tk USING (chunk_id) GROUP BY 1, 2),
    need AS (SELECT qid, count(*) AS needed FROM ph GROUP BY 1),
    hits AS (SELECT m.qid, m.chunk_id, record_id, content_type, score, met = needed AS complete, max((met = needed)::INT) OVER (PARTITION BY m.qid) AS strict
             FROM m JOIN need USING (qid) JOIN tk USING (chunk_id)),
    ok AS (SELECT * FROM hits WHERE complete OR strict = 0)
    {tail}"""


def _ranked(source: str, k: int, where: str = "TRUE") -> str:
    return f"SELECT qid, record_id, chunk_id, content_type, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM {source} WHERE {where} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) <= {k}"


_OUT = "SELECT qid AS question_id, record_id, chunk_id, round(score, 6) AS score, rank::INT AS rank"

_LISTED = """
    h AS (SELECT DISTINCT run_id, backend AS list, record_id, chunk_id, score FROM hits WHERE score IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_id, list ORDER BY score DESC, record_id, chunk_id) AS rank FROM h)"""

_SERVED = f"""
    WITH {_LISTED},
    m AS (SELECT run_id, record_id, max(score) AS score FROM r WHERE list = 'memory' GROUP BY 1, 2),
    j AS (SELECT m.run_id, m.record_id, s.fields.value_score AS value_score, s.fields.owner AS owner FROM m JOIN {_STORE} s ON s.id = m.record_id
          WHERE s.fields.value_score >= 3 AND s.fields.content_type IN ('reel', 'carousel', 'post') AND list_has_any(s.fields.domains, ['motion', 'typography', 'ui_ux'])),
    o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value_score DESC NULLS LAST, owner ASC NULLS LAST, record_id) AS rank FROM j)"""


def _dedupe(order: str, slot: bool) -> str:
    seq = "min(row_no) OVER (PARTITION BY id, fields.owner)" if slot else "row_no"
    return f"SELECT {seq} AS seq, row_no, id FROM canonical_records QUALIFY row_number() OVER (PARTITION BY id, fields.owner ORDER BY {order} row_no) = 1"


def _outer(col: str) -> str:
    return f"unnest(CASE WHEN len({col}) > 0 THEN {col} ELSE [NULL] END)"


_EVAL = """
    h AS (SELECT * FROM ranked_hits WHERE retriever = 'hybrid' AND score IS NOT NULL),
    f AS (SELECT question_id, min(run_id) AS run_id FROM h GROUP BY 1),
    b AS (SELECT question_id, record_id, max(score) AS score FROM h JOIN f USING (question_id, run_id) GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, record_id) AS rank FROM b),
    ids AS (SELECT fields.shortcode AS raw_id, min(id) AS gold_id FROM canonical_records WHERE fields.shortcode IS NOT NULL GROUP BY 1),
    t AS (SELECT question_id, rank, coalesce(gold_id, record_id) AS rid FROM k LEFT JOIN ids ON raw_id = record_id WHERE rank <= 10),
    x AS (SELECT g.question_id, g.mode, len(g.expected) AS e, t.rank, t.rid, list_contains(g.expected, t.rid) AS hit FROM gold_questions g LEFT JOIN t USING (question_id)),
    m AS (
      SELECT question_id, any_value(mode) AS mode, count(rank)::INT AS n_hits,
        CASE WHEN any_value(e) > 0 THEN count(DISTINCT CASE WHEN hit AND rank <= 5 THEN rid END) / any_value(e) ELSE 0.0 END AS recall_5,
        CASE WHEN any_value(e) > 0 THEN count(DISTINCT CASE WHEN hit THEN rid END) / any_value(e) ELSE 0.0 END AS recall_10,
        CASE WHEN any_value(e) > 0 THEN coalesce(sum(CASE WHEN hit THEN 1 / log2(rank + 1) END), 0) / list_sum(list_transform(range(1, least(any_value(e), 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0.0 END AS ndcg_10,
        coalesce(1.0 / min(CASE WHEN hit THEN rank END), 0.0) AS mrr
      FROM x GROUP BY 1)"""

_STOP = str("a an and are as at be but by for from has have how i in is it its of on or that the this to was what when where which who why will with you your do does did can could should would".split())

_DOC_TEXT = "regexp_replace(array_to_string(flatten([" + ", ".join(_part_list(f) for f in ("summary", "workflow_steps", "tips", "caption", "concepts", "tools_apps")) + "]), chr(10)), '^\\s+|\\s+$', '', 'g')"

_SIGNALS = "+".join(f"contains(lower(coalesce(text, '')), '{s}')::INT" for s in ("font", "poster", "prototype", "keyframe", "newsletter", "client", "freelanc", "checklist"))

def _embedded(key: str, text: str, source: str, kind: str) -> str:
    """``key, v``: the 16 buckets of each text at unit length, held as ``kind``."""
    return rf"""
    SELECT x.k AS key, list((coalesce(n / size, 0.0))::{kind}::DOUBLE ORDER BY b) AS v FROM (SELECT {key} AS k, unnest(range(16)) AS b FROM {source}) x
    LEFT JOIN (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY k)) AS size FROM (
      SELECT k, ('0x' || substr(md5(tok), 17, 16))::UBIGINT % 16 AS bucket, count(*)::DOUBLE AS n FROM (
        SELECT {key} AS k, unnest(list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '{_BLANKS}'), lambda x: x <> '')) AS tok FROM {source}) GROUP BY 1, 2)) c ON c.k = x.k AND c.bucket = x.b
    GROUP BY 1"""


_SEARCH_TEXT = "regexp_replace(array_to_string(flatten([" + ", ".join(_part_list(f) for f in _SEARCH) + "]), chr(10)), '^\\s+|\\s+$', '', 'g')"


def _dense(score: str, wide: int, also: str = "", k: int | None = None) -> str:
    empty = "list_max(list_transform({0}.v, lambda x: abs(x))) = 0"
    score = f"CASE WHEN {empty.format('d')} OR {empty.format('q')} THEN 0.0 ELSE {score} END" if "cosine" in score else score
    chunk = "record_id || '::__document__::0' AS chunk_id, " if k is None else ""
    return f"""WITH d AS ({_embedded('id', _SEARCH_TEXT, _STORE, 'FLOAT')}), q AS ({_embedded('question_id', 'question', 'gold_questions', 'DOUBLE')}),
        s AS (SELECT q.key AS question_id, d.key AS record_id, round({score}, 9) AS score FROM d, q),
        w AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, record_id || '::__document__::0') AS place FROM s),
        r AS (SELECT * FROM w WHERE place <= {wide})
        SELECT question_id, record_id, {chunk}round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY place)::INT AS rank FROM r {also.format(s=_STORE)} QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY place) <= {k or wide}"""


SQL: dict[str, str] = {
    "map_transforms": """
        SELECT o_orderkey, o_orderkey::VARCHAR AS key_text, try_cast(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority, try_cast(o_orderpriority AS BIGINT) IS NULL AS word_fails,
          CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT END AS whole_price, o_totalprice <> floor(o_totalprice) AS price_fails,
          CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS flag, o_orderstatus NOT IN ('F', 'O') AS flag_fails,
          'https://orders.example/' || o_orderkey || '/' AS url, o_orderstatus || '/' || o_orderpriority AS path, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END::INT AS listed,
          try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority_float FROM orders""",
    "json_path_props": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
    "content_hash": "SELECT doc_id, sha256(text) AS hash, sha256(text) || '::hash-embed::16' AS cache_key FROM documents",
    "record_hash": """SELECT doc_id, sha256('{' || concat_ws(',', CASE WHEN lang IS NOT NULL THEN '"lang":"' || lang || '"' END, '"n_chars":' || n_chars,
        CASE WHEN owner IS NOT NULL THEN '"owner":"' || owner || '"' END) || '}') AS hash FROM documents""",
    "envelope_gaps": r"""SELECT row_no, CASE WHEN id IS NULL OR trim(id) = '' THEN 'missing_id'
        WHEN regexp_replace(coalesce(fields.summary, ''), '\s', '', 'g') = '' AND coalesce(provenance.media_ref, '') = '' THEN 'no_retrievable_text' ELSE 'ok' END AS reason FROM canonical_records""",
    "coverage_stats": " UNION ALL ".join(f"SELECT '{f}' AS field, count(fields.{f})::BIGINT AS present FROM canonical_records" for f in _FIELDS),
    "namespaced_versions": """SELECT row_no AS seq, CASE WHEN n > 1 THEN 'ns:' || id || '#v' || n ELSE 'ns:' || id END AS id
        FROM (SELECT row_no, id, row_number() OVER (PARTITION BY id ORDER BY row_no) AS n FROM canonical_records)""",
    "dedupe_keep_first": _dedupe("", False),
    "dedupe_newest": _dedupe("coalesce(provenance.timestamp, '') DESC,", True),
    "dedupe_highest_confidence": _dedupe("coalesce(provenance.confidence, 0.0) DESC,", True),
    "dedupe_version_append": """SELECT row_no AS seq, row_no, CASE WHEN n > 1 THEN id || '#v' || n ELSE id END AS id
        FROM (SELECT row_no, id, row_number() OVER (PARTITION BY id, fields.owner ORDER BY row_no) AS n FROM canonical_records)""",
    # What an id has is the hash of its row before: of batch 0 the last, then row by row.
    "hash_skip": """WITH r AS (SELECT row_no, batch_no, coalesce(content_hash, '') AS h, lag(coalesce(content_hash, '')) OVER (PARTITION BY id ORDER BY row_no) AS before FROM canonical_records)
        SELECT row_no, CASE WHEN before = h THEN 'skipped' ELSE 'added' END AS state FROM r WHERE batch_no > 0""",
    "hash_revert": """SELECT n::INT AS delivery, doc_id::VARCHAR AS id, CASE WHEN n = 0 OR doc_id % 2 = 0 THEN 'added' ELSE 'skipped' END AS state FROM documents, (SELECT unnest([0, 1, 2]) AS n)""",
    "reference_order": f"""WITH p AS (SELECT id, min(row_no) AS place FROM canonical_records GROUP BY 1)
        SELECT s.id, s.row_no, row_number() OVER (ORDER BY place) AS position FROM {_STORE} s JOIN p ON p.id = s.id""",
    "reconcile": """WITH a AS (SELECT id FROM canonical_records), b AS (SELECT DISTINCT record_id AS id FROM chunks)
        SELECT id, 'missing' AS side FROM (SELECT id FROM a EXCEPT ALL SELECT id FROM b) UNION ALL SELECT id, 'extra' AS side FROM (SELECT id FROM b EXCEPT ALL SELECT id FROM a)""",
    "carry_forward": """WITH p AS (SELECT id, fields.owner AS owner, fields.value_score AS value_score FROM canonical_records WHERE batch_no = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_no DESC) = 1)
        SELECT r.row_no AS seq, r.id, p.owner, p.value_score FROM canonical_records r JOIN p ON p.id = r.id WHERE r.batch_no > 0""",
    "merge_sources": """WITH f AS (SELECT fields.owner AS username, count(*) AS post_count FROM canonical_records WHERE fields.owner IS NOT NULL GROUP BY 1)
        SELECT coalesce(c.username, f.username) AS username, coalesce(f.post_count, c.post_count)::BIGINT AS post_count, round(c.avg_value_score, 6) AS avg_value_score
        FROM uiux_creators c FULL JOIN f ON c.username = f.username""",
    "record_store": f"SELECT id, row_no, provenance.source AS source FROM {_STORE}",
    "chunk_by_field": _chunks(_BY_FIELD),
    "chunk_by_size": _chunks(_BY_SIZE),
    "document_text": f"SELECT row_no, length({_DOC_TEXT})::INT AS chars, md5({_DOC_TEXT}) AS text_md5 FROM canonical_records",
    "bm25_search": _bm25(f"{_OUT} FROM ({_ranked('ok', 10)})"),
    "bm25_filtered": _bm25(f"{_OUT} FROM ({_ranked('ok', 5, chr(39).join(['content_type = ', 'reel', '']))})"),
    "bm25_overfetch": _bm25(f", wide AS ({_ranked('ok', 25)}) {_OUT} FROM ({_ranked('wide', 5, chr(39).join(['content_type = ', 'reel', '']))})"),
    "bm25_best_per_record": _bm25(f""", top AS ({_ranked('ok', 20)}), b AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY qid, record_id ORDER BY rank) = 1)
        SELECT qid AS question_id, record_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY rank)::INT AS rank FROM b"""),
    "bm25_phrases": _bm25("SELECT qid AS question_id, chunk_id, round(score, 6) AS score, complete FROM hits", _FIXED),
    "token_counts": r"SELECT doc_id, len(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+'))::INT AS n_tokens FROM documents",
    "hash_embed": rf"""
        WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_BLANKS}'), lambda x: x <> '')) AS tok FROM documents),
        c AS (SELECT doc_id, (('0x' || substr(md5(tok), 17, 16))::UBIGINT % 16)::INT AS bucket, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2),
        s AS (SELECT doc_id, sqrt(sum(n * n)) AS size FROM c GROUP BY 1)
        SELECT d.doc_id, b.bucket::INT AS bucket, round(coalesce(c.n / s.size, 0.0), 6) AS weight FROM documents d CROSS JOIN (SELECT unnest(range(16)) AS bucket) b
        LEFT JOIN c ON c.doc_id = d.doc_id AND c.bucket = b.bucket LEFT JOIN s ON s.doc_id = d.doc_id""",
    "embed_cache_misses": """SELECT DISTINCT sha256(text) || '::kb-embed-2::64' AS key FROM chunks
        WHERE sha256(text) || '::kb-embed-2::64' NOT IN (SELECT key FROM embed_cache WHERE embedding IS NOT NULL)""",
    "embed_cache_hits": rf"""
        WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
        t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '{_BLANKS}'), lambda x: x <> '')) AS tok FROM d),
        c AS (SELECT doc_id, ('0x' || substr(md5(tok), 17, 16))::UBIGINT % 16 AS bucket, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2),
        s AS (SELECT doc_id, sqrt(sum(n * n)) AS size FROM c GROUP BY 1),
        v AS (SELECT doc_id, sum((n / size)::FLOAT::DOUBLE) AS total FROM c JOIN s USING (doc_id) GROUP BY 1)
        SELECT d.doc_id, d.text IN (SELECT text FROM d WHERE doc_id % 3 = 0) AS hit, round(coalesce(total, 0.0), 4) AS total FROM d LEFT JOIN v USING (doc_id)""",
    "embed_cached": """SELECT count(*)::BIGINT AS asked, count(e.key)::BIGINT AS hits, (count(*) - count(e.key))::BIGINT AS misses FROM documents d
        LEFT JOIN (SELECT DISTINCT key FROM embed_cache WHERE embedding IS NOT NULL) e ON e.key = sha256(d.text) || '::hash-embed::16'""",
    "embed_cost": """WITH o AS (SELECT length(text) AS n FROM chunks WHERE sha256(text) || '::kb-embed-2::64' NOT IN (SELECT key FROM embed_cache)),
        s AS (SELECT count(*)::BIGINT AS billable, coalesce(sum(n // 4 + 1), 0)::BIGINT AS tokens FROM o)
        SELECT (SELECT count(*) FROM chunks)::BIGINT AS texts, billable, tokens, round(tokens / 1e6::DOUBLE * 0.15::DOUBLE, 8) AS cost FROM s""",
    "vector_topk": """SELECT q.vec_id AS qid, v.vec_id AS vec_id, round(round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9), 6) AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, v.vec_id)::INT AS rank
        FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q QUALIFY rank <= 10""",
    "vector_topk_filtered": """SELECT q.vec_id AS qid, v.vec_id AS vec_id, round(round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9), 6) AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, v.vec_id)::INT AS rank
        FROM (SELECT * FROM embeddings WHERE label = 1) v, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q QUALIFY rank <= 5""",
    "rrf_fusion": f"""WITH {_LISTED}, b AS (SELECT run_id, list, record_id, min(rank) AS rank, arg_min(chunk_id, rank) AS chunk_id FROM r GROUP BY 1, 2, 3)
        SELECT run_id, record_id, arg_min(chunk_id, list) AS chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM b GROUP BY 1, 2""",
    "hybrid_topk": f"""WITH {_LISTED}, b AS (SELECT run_id, list, record_id, min(rank) AS rank FROM r WHERE list IN ('fts5', 'vec0') GROUP BY 1, 2, 3),
        s AS (SELECT run_id, record_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM b GROUP BY 1, 2)
        SELECT run_id, record_id, round(score, 9) AS score, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, record_id)::INT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY s.score DESC, record_id) <= 10""",
    "gate_retrieval": _bm25(f""", b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS place FROM ok),
        f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY qid, record_id ORDER BY place) = 1)
        SELECT qid AS question_id, record_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY place)::INT AS rank FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY place) <= 10""", _QUESTIONS, _texts(_BY_FIELD, _STORE)),
    "gate_metrics": """
        WITH b AS (SELECT run_id, retriever, question_id, record_id, max(score) AS score FROM ranked_hits WHERE score IS NOT NULL GROUP BY 1, 2, 3, 4),
        k AS (SELECT *, row_number() OVER (PARTITION BY run_id, retriever ORDER BY score DESC, record_id) AS rank FROM b),
        a AS (SELECT DISTINCT run_id, retriever, k.question_id, g.expected, len(g.expected) AS e FROM k JOIN gold_questions g USING (question_id)),
        x AS (SELECT a.*, k.rank, k.record_id, list_contains(a.expected, k.record_id) AS hit FROM a LEFT JOIN k ON k.run_id = a.run_id AND k.retriever = a.retriever AND k.question_id = a.question_id AND k.rank <= 10)
        SELECT question_id || '|' || run_id || '|' || retriever AS question_id, count(rank)::INT AS n_hits,
          round(CASE WHEN any_value(e) > 0 THEN count(CASE WHEN hit AND rank <= 5 THEN 1 END) / any_value(e) ELSE 0.0 END, 6) AS recall_5,
          round(CASE WHEN any_value(e) > 0 THEN count(CASE WHEN hit THEN 1 END) / any_value(e) ELSE 0.0 END, 6) AS recall_10,
          round(CASE WHEN any_value(e) > 0 THEN coalesce(sum(CASE WHEN hit THEN 1 / log2(rank + 1) END), 0) / list_sum(list_transform(range(1, least(any_value(e), 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0.0 END, 6) AS ndcg_10,
          round(coalesce(1.0 / min(CASE WHEN hit THEN rank END), 0.0), 6) AS mrr FROM x GROUP BY run_id, retriever, x.question_id""",
    "dense_documents": _dense("list_cosine_similarity(d.v, q.v)", 10),
    "dense_overfetch": _dense("1 - list_distance(d.v, q.v)", 25, "JOIN (SELECT id FROM {s} WHERE fields.content_type = 'reel') ok ON ok.id = r.record_id", 5),
    "bm25_metadata": _bm25(f"{_OUT} FROM ({_ranked('ok', 5, 'content_type IS NOT NULL')})", _QUESTIONS, """SELECT chunk_id, record_id, CASE WHEN json_extract_string(metadata, '$.content_type') = 'reel'
        AND list_has_any(coalesce(from_json(json_extract(metadata, '$.domains'), '["VARCHAR"]'), []), ['motion', 'typography']) THEN 'reel' END AS content_type, text FROM (SELECT DISTINCT chunk_id, record_id, metadata, text FROM chunks)"""),
    "view_served": f"SELECT domains, count(*) AS post_count, round(avg(v), 6) AS avg_value_score, '1' AS schema_version FROM (SELECT {_outer('fields.domains')} AS domains, fields.value_score AS v FROM canonical_records) GROUP BY 1",
    "view_provenance_rows": "SELECT fields.owner AS owner, row_no AS seq, id AS record_id, provenance.source AS source, provenance.media_ref AS media_ref FROM canonical_records WHERE fields.extraction_status = 'ok'",
    "view_seeded_pairs": """WITH g AS (SELECT fields.content_type AS content_type, fields.owner AS owner, count(*) AS post_count FROM canonical_records
          WHERE fields.content_type IN ('reel', 'hologram') AND fields.owner IN ('nobody.here', 'noone.there') GROUP BY 1, 2)
        SELECT *, '1' AS schema_version FROM g UNION ALL SELECT v, NULL, 0, '1' FROM (SELECT unnest(['reel', 'hologram']) AS v) WHERE v NOT IN (SELECT content_type FROM g)
        UNION ALL SELECT NULL, v, 0, '1' FROM (SELECT unnest(['nobody.here', 'noone.there']) AS v) WHERE v NOT IN (SELECT owner FROM g)""",
    "serve_filters_sort": f"{_SERVED} SELECT run_id, record_id, value_score, owner, rank::INT AS rank FROM o",
    "serve_page2": f"{_SERVED} SELECT run_id, record_id, rank::INT AS rank FROM o WHERE rank BETWEEN 6 AND 10",
    "serve_list_filters": f"""SELECT id, coalesce(fields.domains = ['motion', 'ui_ux'], FALSE) AS equal, coalesce(list_has_any(fields.domains, ['motion', 'ui_ux']), FALSE) AS overlaps,
        coalesce(fields.value_score BETWEEN 5 AND 7, FALSE) AS "between" FROM {_STORE}""",
    "serve_get": f"SELECT w.id, s.row_no, s.content_hash FROM (SELECT DISTINCT unnest(expected) AS id FROM gold_questions) w LEFT JOIN {_STORE} s ON s.id = w.id",
    "serve_abstain": _bm25(rf""", top AS ({_ranked('ok', 2)}),
        qt AS (SELECT qid, list_filter(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+'), lambda x: NOT list_contains({_STOP}, x)) AS t FROM q),
        b AS (SELECT qid, score AS s1, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS doc FROM top JOIN ch USING (chunk_id) WHERE rank = 1),
        s AS (SELECT qid, score AS s2 FROM top WHERE rank = 2),
        v AS (SELECT qid, s1, CASE WHEN len(t) = 0 THEN 1.0::DOUBLE WHEN doc IS NULL THEN 0.0::DOUBLE ELSE len(list_filter(t, lambda x: list_contains(doc, x)))::DOUBLE / len(t) END AS coverage,
                     CASE WHEN s2 IS NULL THEN 1.0::DOUBLE WHEN s1 = 0 THEN 0.0::DOUBLE ELSE (s1 - s2) / abs(s1) END AS margin FROM qt LEFT JOIN b USING (qid) LEFT JOIN s USING (qid))
        SELECT qid AS question_id, round(coverage, 4) AS coverage, round(margin, 4) AS margin, s1 IS NULL OR coverage < 0.6 OR margin < 0.15 AS abstained FROM v"""),
    "view_top_creators": """SELECT fields.owner AS owner, count(*) AS post_count, round(avg(fields.value_score), 6) AS avg_value_score, round(avg(fields.is_educational::INT), 6) AS educational_share, '1' AS schema_version
        FROM canonical_records WHERE fields.extraction_status = 'ok' GROUP BY 1""",
    "view_tools": f"SELECT tools_apps, count(*) AS post_count, '1' AS schema_version FROM (SELECT {_outer('fields.tools_apps')} AS tools_apps FROM canonical_records) GROUP BY 1",
    "view_by_domain": f"SELECT domains, count(*) AS post_count, round(avg(v), 6) AS avg_value_score, '1' AS schema_version FROM (SELECT {_outer('fields.domains')} AS domains, fields.value_score AS v FROM canonical_records) GROUP BY 1",
    "view_multi_key": f"""SELECT content_type, domains, tools_apps, count(*) AS post_count, '1' AS schema_version FROM (
        SELECT content_type, domains, {_outer('ta')} AS tools_apps FROM (SELECT fields.content_type AS content_type, {_outer('fields.domains')} AS domains, fields.tools_apps AS ta FROM canonical_records)) GROUP BY 1, 2, 3""",
    "view_seeded": """WITH g AS (SELECT fields.content_type AS content_type, count(*) AS n, round(avg(fields.value_score), 6) AS a FROM canonical_records WHERE fields.content_type IN ('reel', 'carousel', 'hologram') GROUP BY 1),
        s AS (SELECT unnest(['reel', 'carousel', 'hologram']) AS content_type)
        SELECT coalesce(g.content_type, s.content_type) AS content_type, coalesce(n, 0)::BIGINT AS post_count, a AS avg_value_score, '1' AS schema_version FROM s FULL JOIN g ON g.content_type = s.content_type""",
    "view_ranged": """SELECT fields.content_type AS content_type, count(*) AS post_count, '1' AS schema_version FROM canonical_records
        WHERE fields.value_score BETWEEN 4 AND 8 AND list_contains(fields.domains, 'typography') GROUP BY 1""",
    "view_provenance": f"""SELECT domains, count(*) AS post_count, round(avg(v), 6) AS avg_value_score, string_agg(concat_ws('|', id, source, media_ref), ';' ORDER BY row_no) AS provenance, '1' AS schema_version FROM (
        SELECT {_outer('fields.domains')} AS domains, fields.value_score AS v, id, provenance.source AS source, provenance.media_ref AS media_ref, row_no FROM canonical_records) GROUP BY 1""",
    "eval_questions": f"WITH {_EVAL} SELECT question_id, n_hits, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10, round(ndcg_10, 6) AS ndcg_10, round(mrr, 6) AS mrr FROM m",
    "eval_summary": f"""WITH {_EVAL} SELECT count(CASE WHEN mode = 'search' THEN 1 END)::BIGINT AS n_search, {', '.join(f"round(avg(CASE WHEN mode = 'search' THEN {c} END), 6) AS {c}" for c in ('recall_5', 'recall_10', 'ndcg_10', 'mrr'))},
        round(avg(CASE WHEN mode = 'abstain' THEN (n_hits = 0)::INT END), 6) AS abstention_rate FROM m""",
    "triage_signals": f"SELECT doc_id, n AS n_signals, CASE WHEN n >= 4 THEN 'strong' ELSE 'medium' END AS bucket FROM (SELECT doc_id, ({_SIGNALS})::INT AS n FROM documents) WHERE n >= 2",
}

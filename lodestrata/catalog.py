"""All registered queries of the core engine: whole tables through the engine's operators.

``oracle.py`` holds the SQL that must give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .contract import Corpus, parse_corpus
from .functions import transforms
from .functions.text import index_tokens
from .operators import chunk, evaluate, ingest, lexical, rank, vector, views
from .plans import gate, retrieve, serve
from .plans.params import Filter, SortKey, serve_condition
from .session import new_path
from .sources import adapters
from .sources.adapters import latest_by_id, merged_posts

#: The contract of the test corpus.
CONTRACT = {
    "schema": {
        "schema_version": "1",
        "id_field": "post_id",
        "fields": {
            "post_id": {"type": "string"}, "shortcode": {"type": "string"}, "url": {"type": "url"}, "owner": {"type": "string", "role": ["filter", "facet", "sort"]},
            "content_type": {"type": "string", "role": ["filter", "facet"]}, "domains": {"type": "list[string]", "role": ["filter", "facet"]}, "is_educational": {"type": "bool", "role": ["filter"]},
            "value_score": {"type": "int", "role": ["metric"]}, "gated_content": {"type": "bool", "role": ["filter"]}, "summary": {"type": "text", "role": ["search"]}, "transcript": {"type": "text", "role": ["search"]},
            "workflow_steps": {"type": "list[text]", "role": ["search"]}, "tips": {"type": "list[text]", "role": ["search"]}, "caption": {"type": "text", "role": ["search"]}, "concepts": {"type": "list[string]", "role": ["search"]},
            "tools_apps": {"type": "list[string]", "role": ["search", "filter", "facet"]}, "tags": {"type": "list[string]", "role": ["search"]}, "extraction_status": {"type": "string", "role": ["filter", "facet"]}, "is_promo": {"type": "bool", "role": ["filter"]},
        },
    },
    "index": {"chunker": {"mode": "by_field"}, "retrieval": {"default": "bm25", "strategies": {"bm25": {}, "dense": {}, "hybrid": {}}}},
    "materialize": {
        "freshness": "24h",
        "views": [
            {"name": "top_creators", "group_by": ["owner"], "metrics": [{"post_count": "count"}, {"avg_value_score": "mean(value_score)"}, {"educational_share": "mean(is_educational)"}], "filters": {"extraction_status": {"op": "eq", "value": "ok"}}},
            {"name": "tools", "group_by": ["tools_apps"], "metrics": [{"post_count": "count"}]},
            {"name": "by_domain", "group_by": ["domains"], "metrics": [{"post_count": "count"}, {"avg_value_score": "mean(value_score)"}]},
            {"name": "multi_key", "group_by": ["content_type", "domains", "tools_apps"], "metrics": [{"post_count": "count"}]},
            {"name": "seeded", "group_by": ["content_type"], "metrics": [{"post_count": "count"}, {"avg_value_score": "mean(value_score)"}], "filters": {"content_type": ["reel", "carousel", "hologram"]}},
            {"name": "seeded_pairs", "group_by": ["content_type", "owner"], "metrics": [{"post_count": "count"}], "filters": {"content_type": ["reel", "hologram"], "owner": ["nobody.here", "noone.there"]}},
            {"name": "ranged", "group_by": ["content_type"], "metrics": [{"post_count": "count"}], "filters": {"value_score": {"op": "between", "value": [4, 8]}, "domains": "typography"}},
        ],
    },
}


def corpus() -> Corpus:
    return parse_corpus("posts", CONTRACT)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "canonical_records")


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_by_id(_records(spark, sf_dir), "row_no")


# --- transforms, envelope, hashes -----------------------------------------------------------


def map_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders")
    text, number, real = T.StringType(), T.LongType(), T.DoubleType()
    first = transforms.apply("coerce_int", F.substring("o_orderpriority", 1, 1), text)
    word = transforms.apply("coerce_int", F.col("o_orderpriority"), text)
    price = transforms.apply("coerce_int", F.col("o_totalprice"), real)
    flag = transforms.apply("coerce_bool", F.when(F.col("o_orderstatus") == "F", " Yes ").when(F.col("o_orderstatus") == "O", "0").otherwise(F.col("o_orderstatus")), text)
    return orders.select(
        "o_orderkey", transforms.apply("coerce_str", F.col("o_orderkey"), number).value.alias("key_text"), first.value.alias("priority"), word.error.isNotNull().alias("word_fails"),
        price.value.alias("whole_price"), price.error.isNotNull().alias("price_fails"), flag.value.alias("flag"), flag.error.isNotNull().alias("flag_fails"),
        transforms.apply("template", F.col("o_orderkey"), number, "https://orders.example/{value}/").value.alias("url"),
        transforms.apply("path_join", F.array("o_orderstatus", F.lit(None), F.lit(""), "o_orderpriority"), T.ArrayType(text)).value.alias("path"),
        F.size(transforms.apply("list", F.nullif(F.col("o_orderstatus"), F.lit("P")), text).value).alias("listed"),
        transforms.apply("coerce_float", F.substring("o_orderpriority", 1, 1), text).value.alias("priority_float"),
    )


def json_path_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    parsed = e.withColumn("props", F.from_json("props", "k bigint"))
    col, _ = ingest.dotted(parsed.schema, "props.k")
    return parsed.select("event_id", col.alias("k"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", vector.text_hash(F.col("text")).alias("hash"), vector.cache_key(F.col("text"), "hash-embed", 16).alias("cache_key"))


def record_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", ingest.content_hash({c: F.col(c) for c in ("lang", "owner", "n_chars")}).alias("hash"))


def envelope_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without id, text or media, found by the ingest's own checks."""
    c = corpus()
    raw = _records(spark, sf_dir).select(F.col("row_no").alias("seq"), F.nullif(F.col("id"), F.lit("")).alias("post_id"), "fields.owner", "fields.summary", "fields.caption", "provenance.media_ref", "provenance.timestamp")
    spec = parse_corpus("gaps", CONTRACT | {"sources": [{"name": "s", "mapping": {"post_id": {"from": "post_id"}, "owner": {"from": "owner"}, "summary": {"from": "summary"}}, "provenance": {"source": "canonical", "media_ref": "media_ref", "timestamp_field": "timestamp"}}]}).sources[0]
    mapped = ingest.map_records(raw.drop("caption"), c, spec)
    return mapped.select(F.col("seq").alias("row_no"), F.coalesce("reason", F.lit("ok")).alias("reason"))


def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.coverage(_records(spark, sf_dir), list(corpus().fields))


def namespaced_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.namespaced(_records(spark, sf_dir).select(F.col("row_no").alias("seq"), "id"), "ns")
    return ingest.dedupe(rows, [F.col("id")], "version_append").select("seq", "id")


def _deduped(policy: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _records(spark, sf_dir).select(F.col("row_no").alias("seq"), "row_no", "id", F.col("fields.owner").alias("owner"), "provenance")
        won = ingest.dedupe(rows, [F.col("id"), F.col("owner")], policy, timestamp=F.col("provenance.timestamp"), confidence=F.col("provenance.confidence"))
        return won.select("seq", "row_no", "id")

    return run


def hash_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later batches against the state that batch 0 left, row by row."""
    r = _records(spark, sf_dir).select("row_no", "batch_no", "id", F.coalesce("content_hash", F.lit("")).alias("content_hash"))
    state = ingest.current_hashes(r.limit(0), r.where("batch_no = 0"), "row_no")
    added, skipped = ingest.split_known(r.where("batch_no > 0"), state, "row_no")
    return added.select("row_no", F.lit("added").alias("state")).unionByName(skipped.select("row_no", F.lit("skipped").alias("state")))


def hash_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deliveries of all documents: as they are, every second one changed, as they were."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    state, out = spark.createDataFrame([], "id string, content_hash string"), None
    for n in range(3):
        text = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")) if n == 1 else F.col("text")
        rows = d.select("id", F.lit(n).alias("delivery"), F.lit(n).alias("seq"), vector.text_hash(text).alias("content_hash"))
        added, skipped = ingest.split_known(rows, state)
        state = ingest.current_hashes(state, rows)
        told = added.select("delivery", "id", F.lit("added").alias("state")).unionByName(skipped.select("delivery", "id", F.lit("skipped").alias("state")))
        out = told if out is None else out.unionByName(told)
    return out


def reference_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record store, reconciled against the ids as delivered and put into their order."""
    r = _records(spark, sf_dir).select("id", F.col("row_no").alias("seq"))
    final = ingest.in_reference_order(ingest.reconciled(r.select("id").distinct(), _store(spark, sf_dir).select("id", "row_no")), r)
    numbered = adapters.numbered(final.join(r.groupBy("id").agg(F.min("seq").alias("place")), "id"), ["place"])
    return numbered.select("id", "row_no", F.col("seq").alias("position"))


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    return ingest.reconcile(r.select("id"), _t(spark, sf_dir, "chunks").select(F.col("record_id").alias("id")).distinct(), ["id"])


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir).select(F.col("row_no").alias("seq"), "batch_no", "id", F.col("fields.owner").alias("owner"), F.col("fields.value_score").alias("value_score"))
    previous = latest_by_id(r.where("batch_no = 0"), "seq").select("id", "owner", "value_score")
    again = r.where("batch_no > 0").join(previous.select("id"), "id", "left_semi")
    return ingest.carried_forward(again, previous).select("seq", "id", "owner", "value_score")


def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _records(spark, sf_dir).where("fields.owner is not null").groupBy(F.col("fields.owner").alias("username")).agg(F.count(F.lit(1)).alias("post_count"))
    kept = _t(spark, sf_dir, "uiux_creators").select("username", "post_count", F.round("avg_value_score", 6).alias("avg_value_score"))
    return merged_posts(kept, found, "username", overwrite=("post_count",)).select("username", "post_count", "avg_value_score")


def record_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).select("id", "row_no", F.col("provenance.source").alias("source"))


# --- chunks -----------------------------------------------------------------------------------


def _brief(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "record_id", "chunk_field", "chunk_idx", F.length("text").alias("chars"), F.md5("text").alias("text_md5"), "media_ref")


def chunk_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brief(chunk.Chunker.of(corpus()).chunks(_records(spark, sf_dir)))


def chunk_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brief(chunk.Chunker(("summary", "transcript", "caption"), "by_size", 500, 100).chunks(_records(spark, sf_dir)))


def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    text = chunk.document_text(r, ["summary", "workflow_steps", "tips", "caption", "concepts", "tools_apps"])
    return r.select("row_no", F.length(text).alias("chars"), F.md5(text).alias("text_md5"))


# --- lexical --------------------------------------------------------------------------------


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "gold_questions").select(F.col("question_id").alias("qid"), "question")


def _lexical(spark: SparkSession, sf_dir: str) -> lexical.LexicalIndex:
    chunks = _t(spark, sf_dir, "chunks").select("chunk_id", "record_id", "chunk_field", F.get_json_object("metadata", "$.content_type").alias("content_type"), "text")
    return lexical.LexicalIndex.build(chunks, keep=True)


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6)).withColumnRenamed("qid", "question_id")


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_lexical(spark, sf_dir).search(_questions(spark, sf_dir), 10))


def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_lexical(spark, sf_dir).search(_questions(spark, sf_dir), 5, F.col("content_type") == "reel", prefilter=True))


def bm25_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_lexical(spark, sf_dir).search(_questions(spark, sf_dir), 5, F.col("content_type") == "reel"))


def bm25_best_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rank.best_per_record(_lexical(spark, sf_dir).search(_questions(spark, sf_dir), 20), ["qid"]))


def bm25_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All phrase matches (AND and OR) of two fixed questions with hyphens and repeated words."""
    asked = spark.createDataFrame([("a", "eye-can rest rest"), ("b", "fonts-load-late — poster")], "qid string, question string")
    hits = _lexical(spark, sf_dir).matches(asked)
    return hits.select(F.col("qid").alias("question_id"), "chunk_id", F.round("score", 6).alias("score"), "complete")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(index_tokens(F.col("text"))).alias("n_tokens"))


# --- vectors ----------------------------------------------------------------------------------


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(vector.hash_embedding(F.col("text"), 16)).alias("bucket", "weight"))
    return d.select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


def embed_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _t(spark, sf_dir, "chunks").select(vector.cache_key(F.col("text"), "kb-embed-2", 64).alias("key"))
    return vector.asked_keys(keyed, _t(spark, sf_dir, "embed_cache")).where("not hit").select("key")


def embed_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, cache = _t(spark, sf_dir, "documents").select("text"), _t(spark, sf_dir, "embed_cache").select("key", "embedding")
    return vector.embed_cached(texts, cache, vector.hash_embedder(16)).counts


def embed_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a cache that holds every third one: which are hits, and the vectors' sums."""
    d = _t(spark, sf_dir, "documents").where("text is not null")
    embedder = vector.hash_embedder(16)
    cache = embedder.embed(d.where("doc_id % 3 = 0").select("text")).select(vector.cache_key(F.col("text"), embedder.model, embedder.dims).alias("key"), F.col("embedding").cast("array<float>").alias("embedding"))
    out = vector.embed_cached(d.select("doc_id", "text"), cache, embedder)
    added = out.added.select("key", F.lit(True).alias("added"))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return out.vectors.join(added, "key", "left").select("doc_id", F.col("added").isNull().alias("hit"), F.round(total, 4).alias("total"))


def embed_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, cache = _t(spark, sf_dir, "chunks").select("text"), _t(spark, sf_dir, "embed_cache").select("key", "embedding")
    return vector.embedding_cost(texts, cache, vector.Embedder("kb-embed-2", 64, lambda df: df, 0.15)).withColumn("cost", F.round("cost", 8))


def _vector_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = _t(spark, sf_dir, "embeddings")
    return v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vector_queries(spark, sf_dir)
    return vector.vector_search_many(v, q, 10, key="vec_id").select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vector_queries(spark, sf_dir)
    return vector.vector_search_many(v.where("label = 1"), q, 5, key="vec_id").select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


# --- fusion, serving ----------------------------------------------------------------------------


def _ranked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _t(spark, sf_dir, "hits").where("score is not null").select("run_id", F.col("backend").alias("list"), "record_id", "chunk_id", "score")
    order = Window.partitionBy("run_id", "list").orderBy(F.col("score").desc(), "record_id", "chunk_id")
    return h.distinct().withColumn("rank", F.row_number().over(order))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = rank.reciprocal_rank_fusion(_ranked_lists(spark, sf_dir), ["run_id"])
    return fused.select("run_id", "record_id", "chunk_id", F.round("score", 9).alias("score"))


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _ranked_lists(spark, sf_dir).withColumnRenamed("run_id", "qid")
    fused = retrieve.hybrid_ranked(lists.where("list = 'fts5'"), lists.where("list = 'vec0'"), 10)
    return fused.select(F.col("qid").alias("run_id"), "record_id", F.round("score", 9).alias("score"), "rank")


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of the memory backend as one request: filters, sorting, positions."""
    hits = _ranked_lists(spark, sf_dir).where("list = 'memory'").groupBy("run_id", "record_id").agg(F.max("score").alias("score"))
    filters = (Filter("value_score", "gte", 3), Filter("content_type", "in", ["reel", "carousel", "post"]), Filter("domains", "in", ["motion", "typography", "ui_ux"]))
    return serve.filtered(corpus(), hits, filters, (SortKey("value_score", "desc"), SortKey("owner", "asc")), _store(spark, sf_dir), ("run_id",))


def serve_filters_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _served(spark, sf_dir).select("run_id", "record_id", F.col("fields.value_score").alias("value_score"), F.col("fields.owner").alias("owner"), F.col("position").alias("rank"))


def serve_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.page(_served(spark, sf_dir), 5, 5).select("run_id", "record_id", F.col("position").alias("rank"))


def serve_list_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _store(spark, sf_dir)
    eq = serve_condition(Filter("domains", "eq", ["motion", "ui_ux"]), True, F.col("fields.domains"))
    overlap = serve_condition(Filter("domains", "in", ["motion", "ui_ux"]), True, F.col("fields.domains"))
    between = serve_condition(Filter("value_score", "between", [5, 7]), False, F.col("fields.value_score"))
    return r.select("id", eq.alias("equal"), overlap.alias("overlaps"), between.alias("between"))


def serve_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookups of all expected ids of the gold questions."""
    wanted = _t(spark, sf_dir, "gold_questions").select(F.explode("expected").alias("id"))
    return serve.get_many(wanted, _store(spark, sf_dir)).select("id", "row_no", "content_hash")


def serve_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each question by its best chunk, margin of its two best scores, decision."""
    q = _questions(spark, sf_dir)
    top = _lexical(spark, sf_dir).search(q, 2)
    texts = _t(spark, sf_dir, "chunks").select("chunk_id", "text").dropDuplicates(["chunk_id"])
    rows = q.join(top, "qid", "left").join(texts, "chunk_id", "left").withColumn("position", F.coalesce("rank", F.lit(1)))
    told = serve.judged(rows, F.col("question"), F.col("text"), serve.ServeConfig(), ("qid",)).where("position = 1")
    return told.select(F.col("qid").alias("question_id"), F.round("coverage", 4).alias("coverage"), F.round("margin", 4).alias("margin"), "abstained")


def gate_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate evaluates: the index rebuilt from the record store, ten records a question."""
    ranked = gate.retrieved(corpus(), _store(spark, sf_dir), _t(spark, sf_dir, "gold_questions"))
    return ranked.select("question_id", "record_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every run and retriever against the questions' expected ids."""
    r = _t(spark, sf_dir, "ranked_hits").where("score is not null").groupBy("run_id", "retriever", "question_id", "record_id").agg(F.max("score").alias("score"))
    hits = r.withColumn("rank", F.row_number().over(Window.partitionBy("run_id", "retriever").orderBy(F.col("score").desc(), "record_id")))
    key = F.concat_ws("|", "question_id", F.col("run_id").cast("string"), "retriever")
    gold = _t(spark, sf_dir, "gold_questions")
    asked = hits.select("run_id", "retriever", "question_id").distinct().join(gold, "question_id").withColumn("question_id", key)
    m = evaluate.question_metrics(asked, hits.withColumn("question_id", key))
    return m.select("question_id", "n_hits", *(F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "ndcg_10", "mrr")))


def _document_vectors(spark: SparkSession, sf_dir: str) -> retrieve.VectorIndex:
    return retrieve.VectorIndex.of_documents(_store(spark, sf_dir), corpus(), vector.hash_embedder(16))


def dense_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector a record, the ten nearest to each question."""
    hits = _document_vectors(spark, sf_dir).search(_questions(spark, sf_dir), 10)
    return hits.select(F.col("qid").alias("question_id"), "record_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def dense_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by distance, filtered after five times as many were taken."""
    hits = _document_vectors(spark, sf_dir).search(_questions(spark, sf_dir), 5, F.col("content_type") == "reel", "distance", prefilter=False)
    return hits.select(F.col("qid").alias("question_id"), "record_id", F.round("score", 6).alias("score"), "rank")


def bm25_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search under a metadata filter, taken before ranking."""
    chunks = _t(spark, sf_dir, "chunks").select("chunk_id", "record_id", F.from_json("metadata", "owner string, content_type string, domains array<string>").alias("metadata"), "text")
    keep = lexical.metadata_filter({"content_type": "reel", "domains": ["motion", "typography"]}, kinds={"domains": "list"})
    return _rounded(lexical.LexicalIndex.build(chunks, keep=True).search(_questions(spark, sf_dir), 5, keep, prefilter=True))


# --- views --------------------------------------------------------------------------------------


def _view(name: str, provenance: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        view = next(v for v in views.parse_views(corpus()) if v.name == name)
        rows = _records(spark, sf_dir).withColumn("seq", F.col("row_no"))
        out = views.materialize(view, rows, provenance=provenance)
        if provenance:
            out = out.withColumn("provenance", F.array_join(F.transform("provenance", lambda p: F.concat_ws("|", p["record_id"], p["source"], p["media_ref"])), ";"))
        means = [m.name for m in view.metrics if m.kind == "mean"]
        for m in means:
            out = out.withColumn(m, F.round(m, 6))
        return out.select(*view.group_by, *(m.name for m in view.metrics), *(["provenance"] if provenance else []), "schema_version")

    return run


def view_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view stored by the manager and served while it is fresh."""
    manager = views.ViewManager(spark, corpus(), new_path(spark, "views"))
    manager.refresh(_records(spark, sf_dir), "by_domain", provenance=False)
    return manager.serve("by_domain").select("domains", "post_count", F.round("avg_value_score", 6).alias("avg_value_score"), "schema_version")


def view_provenance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = next(v for v in views.parse_views(corpus()) if v.name == "top_creators")
    rows = views.provenance_rows(view, _records(spark, sf_dir).withColumn("seq", F.col("row_no")))
    return rows.select("owner", "seq", "record_id", "source", "media_ref")


# --- evaluation -----------------------------------------------------------------------------------


def _eval_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid list of each question's first run, best hit of a record, ranked by score."""
    h = _t(spark, sf_dir, "ranked_hits").where("retriever = 'hybrid' and score is not null")
    first = h.groupBy("question_id").agg(F.min("run_id").alias("run_id"))
    best = h.join(first, ["question_id", "run_id"]).groupBy("question_id", "record_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("score").desc(), "record_id")))


def _eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _records(spark, sf_dir).where("fields.shortcode is not null").groupBy(F.col("fields.shortcode").alias("raw_id")).agg(F.min("id").alias("gold_id"))
    return evaluate.question_metrics(_t(spark, sf_dir, "gold_questions"), _eval_hits(spark, sf_dir), ids)


def eval_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _eval_metrics(spark, sf_dir)
    return m.select("question_id", "n_hits", *(F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "ndcg_10", "mrr")))


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.summary(_eval_metrics(spark, sf_dir))
    return s.select("n_search", *(F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "ndcg_10", "mrr", "abstention_rate")))


SIGNALS = ["font", "poster", "prototype", "keyframe", "newsletter", "client", "freelanc", "checklist"]


def triage_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.triage(_t(spark, sf_dir, "documents"), F.col("text"), SIGNALS).select("doc_id", "n_signals", "bucket")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_search(spark, sf_dir)


_PLAIN = (
    map_transforms, json_path_props, content_hash, record_hash, envelope_gaps, coverage_stats, namespaced_versions, hash_skip, reconcile, carry_forward, merge_sources, record_store,
    hash_revert, reference_order, embed_cache_hits, gate_retrieval, gate_metrics, dense_documents, dense_overfetch, bm25_metadata, view_served, view_provenance_rows,
    chunk_by_field, chunk_by_size, document_text, bm25_search, bm25_filtered, bm25_overfetch, bm25_best_per_record, bm25_phrases, token_counts, hash_embed, embed_cache_misses, embed_cached, embed_cost,
    vector_topk, vector_topk_filtered, rrf_fusion, hybrid_topk, serve_filters_sort, serve_page2, serve_list_filters, serve_get, serve_abstain, eval_questions, eval_summary, triage_signals,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f.__name__: f for f in _PLAIN}
    out |= {f"dedupe_{p}": _deduped(p) for p in ingest.POLICIES}
    out |= {f"view_{v}": _view(v) for v in ("top_creators", "tools", "by_domain", "multi_key", "seeded", "seeded_pairs", "ranged")}
    return out | {"view_provenance": _view("by_domain", provenance=True)}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)

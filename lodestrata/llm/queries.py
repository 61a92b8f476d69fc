"""Queries pN_... of the training-data operators over the test tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fits_broadcast
from . import capping, history, knn, leakage, neardup, packing, pieces, pii, ranking, repetition


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "canonical_records").select(F.col("row_no").alias("id"), neardup.record_text().alias("text"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("item_table"), F.col("chunk_id").alias("item_key"), "text")
    records = _table(spark, sf_dir, "canonical_records").select(F.lit("canonical_records").alias("item_table"), F.col("row_no").cast("string").alias("item_key"), F.col("fields.transcript").alias("text"))
    return chunks.unionByName(records)


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_oversized(_items(spark, sf_dir), limit=2000, overlap=200)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oversized(spark, sf_dir).where("n_pieces > 1").select("item_table", "item_key").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oversized(spark, sf_dir).select("item_table", "item_key", "piece_no", "n_pieces", "start_char", "end_char", "overlap_chars", "piece")


def p1_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each oversized row whether its pieces keep limit and overlap, follow each other and give the text again."""
    rows = _items(spark, sf_dir).select("*", F.monotonically_increasing_id().alias("at"))
    cut = pieces.split_oversized(rows, limit=2000, overlap=200)
    own = F.struct("piece_no", "start_char", "end_char", "overlap_chars", "piece")
    all_ = cut.groupBy("item_table", "item_key", "at").agg(F.array_sort(F.collect_list(own)).alias("p"), F.first("text").alias("text"))
    kept = F.forall("p", lambda x: (F.length(x["piece"]) <= 2000) & (x["overlap_chars"] <= 200))
    again = F.array_join(F.transform("p", lambda x: F.substring(x["piece"], x["overlap_chars"] + 1, F.lit(2000))), "")
    return all_.select("item_table", "item_key", (kept & (again == F.col("text"))).alias("whole"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch 0 begins the history; every later batch of the table is one arrival, all are appended.

    Rows come by batch and then by number, so a batch may hold smaller numbers than one before it."""
    rows = _table(spark, sf_dir, "canonical_records").select("batch_no", F.col("row_no").alias("id"), F.col("id").alias("record_id"), "content_hash", neardup.record_text().alias("text"))
    batches = sorted(r[0] for r in rows.select("batch_no").distinct().collect() if r[0])  # one number for each delivery
    h = history.start(spark, rows.where("batch_no = 0"), threshold=0.5, words=3, growing=False)
    decided = [history.admit(h, rows.where(F.col("batch_no") == b)) for b in batches] or [history.admit(h, rows.limit(0))]
    h.close()
    return functools.reduce(DataFrame.unionByName, decided)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).where("not accepted").select(F.col("kept_id").alias("kept_row_no"), F.col("id").alias("row_no"))


def p2_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select(F.col("id").alias("row_no"), "accepted", F.col("kept_id").alias("kept_row_no"), "known_id")


def _personal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "canonical_records")
    both = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"fields.{f}").alias("text")) for f in ("caption", "transcript")))
    return rows.select(F.col("row_no").alias("id"), F.explode(both).alias("x")).select("id", "x.field", "x.text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.occurrences(pii.personal_spans(_personal_texts(spark, sf_dir)))
    return found.select(F.col("id").alias("row_no"), F.col("field").alias("field_name"), "pii_type", "pii_no")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _personal_texts(spark, sf_dir)
    clean = pii.redacted(texts, pii.personal_spans(texts)).where("text is not null")
    return clean.select(F.col("id").alias("row_no"), F.col("field").alias("field_name"), "redacted")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _table(spark, sf_dir, "hits").select(F.col("run_id").alias("run"), F.col("backend").alias("list"), F.col("record_id").alias("record"), "score")
    ranked = _table(spark, sf_dir, "ranked_hits").select(F.col("run_id").alias("run"), F.col("retriever").alias("list"), F.col("record_id").alias("record"), "score")
    return hits.unionByName(ranked)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.winners(_scores(spark, sf_dir)).select(F.col("run").alias("run_id"), F.col("record").alias("record_id"))


def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.fused_ranking(_scores(spark, sf_dir)).select(F.col("run").alias("run_id"), F.col("record").alias("record_id"), F.round("score", 6).alias("score"), "position")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.similar_pairs(_table(spark, sf_dir, "embed_cache"), least=0.9).select("key_a", "key_b")


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.nearest(_table(spark, sf_dir, "embed_cache"), k=10)


def _owned(spark: SparkSession, sf_dir: str, most_creators: int = 200_000) -> DataFrame:
    rows = _table(spark, sf_dir, "canonical_records").select("row_no", capping.contributor_name(F.col("fields.owner")).alias("contributor"), F.col("fields.value_score").alias("value_score"))
    creators = _table(spark, sf_dir, "uiux_creators").select(capping.contributor_name(F.col("username")).alias("contributor"), "avg_value_score")
    creators = creators.where("contributor is not null").groupBy("contributor").agg(F.max("avg_value_score").alias("avg_value_score"))
    if fits_broadcast(creators, most_creators):
        creators = F.broadcast(creators)
    return rows.join(creators, "contributor", "left").select("row_no", "contributor", F.coalesce("value_score", "avg_value_score", F.lit(0.0)).cast("double").alias("quality"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capping.over_cap(_owned(spark, sf_dir), "contributor", "quality", "row_no", cap=10).where("over_cap").select("row_no")


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capping.cap_records(_owned(spark, sf_dir), "contributor", "quality", "row_no", cap=10)


def p6_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capping.cap_records(_owned(spark, sf_dir), "contributor", "quality", "row_no", share=0.02)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_record_texts(spark, sf_dir), threshold=0.5, words=3)
    return neardup.expanded(found).select(F.col("a").alias("row_no_a"), F.col("b").alias("row_no_b"))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_record_texts(spark, sf_dir), threshold=0.8, words=5)
    return neardup.grouped(found).select(F.col("id").alias("row_no"), "class_id", "group_id", "n_links")


def p7_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each row its class of equal texts and the number of other texts that are similar."""
    return p7_groups(spark, sf_dir).select("row_no", "class_id", "n_links")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), capacity=2048).withColumnRenamed("id", "doc_id")


def p8_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document whether its pieces cover it once, in containers that are not overfull, split only where it must be."""
    p = p8_containers(spark, sf_dir)
    load = p.groupBy("container_id").agg((F.sum("n_tokens") <= 2048).alias("fits"))
    parts = p.join(load, "container_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("token_start", "token_end"))).alias("s"), F.min("fits").alias("fits"))
    follow = F.forall(F.sequence(F.lit(1), F.size("s")), lambda i: F.when(i == 1, F.element_at("s", 1)["token_start"] == 0).otherwise(F.element_at(F.col("s"), i)["token_start"] == F.element_at(F.col("s"), F.greatest(i - 1, F.lit(1)))["token_end"]))
    total = F.element_at("s", -1)["token_end"]
    return parts.select("doc_id", (F.col("fits") & follow & (F.size("s") == F.greatest(F.ceil(total / 2048), F.lit(1)))).alias("covered"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("id"), "text")
    return leakage.leaks(_documents(spark, sf_dir), items, passage=13, words=5)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id", "leaked_words", "item_words", "item_from_word")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the posterior holds repetitive, checked against the defined share."""
    rated = repetition.repetition(_documents(spark, sf_dir), run=8)
    return rated.where("p_repetitive >= 0.5").where("repeated_share >= 0.3").select(F.col("id").alias("doc_id")).distinct()


def p10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = repetition.repetition(_documents(spark, sf_dir), run=8)
    return rated.select(F.col("id").alias("doc_id"), "n_words", "n_repeated", F.round("repeated_share", 6).alias("repeated_share"), F.round("p_repetitive", 6).alias("p_repetitive"))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_repetition(spark, sf_dir).select("doc_id", "n_words", "n_repeated", "repeated_share")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)

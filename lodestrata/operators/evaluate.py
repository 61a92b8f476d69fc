"""Retrieval metrics over ranked lists: recall, nDCG, reciprocal rank, abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP_K = 10


def recall_at(ranked: Column, expected: Column, k: int) -> Column:
    """Distinct expected ids among the first k, over the length of expected; 0 without any."""
    return F.when(F.size(expected) > 0, F.size(F.array_intersect(F.slice(ranked, 1, k), expected)) / F.size(expected)).otherwise(0.0)


def ndcg_at(ranked: Column, expected: Column, k: int) -> Column:
    gains = F.transform(F.slice(ranked, 1, k), lambda x, i: F.when(F.array_contains(expected, x), 1 / F.log2(i.cast("double") + 2)).otherwise(0.0))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(expected), F.lit(k)), F.lit(1))), lambda i: 1 / F.log2(i.cast("double") + 1)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(expected) > 0, F.aggregate(gains, F.lit(0.0), lambda s, x: s + x) / ideal).otherwise(0.0)


def reciprocal_rank(ranked: Column, expected: Column) -> Column:
    """1 / first relevant rank over the whole list."""
    first = F.array_min(F.filter(F.transform(ranked, lambda x, i: F.when(F.array_contains(expected, x), i + 1)), lambda x: x.isNotNull()))
    return F.coalesce(1 / first, F.lit(0.0))


def question_metrics(questions: DataFrame, hits: DataFrame, id_map: DataFrame | None = None, top_k: int = TOP_K) -> DataFrame:
    """One row for each question: ``question_id, mode, n_hits, recall_5, recall_10, ndcg_10, mrr``.

    ``questions``: question_id, mode, expected; ``hits``: question_id, record_id, rank.
    ``id_map`` (raw_id, gold_id) turns record ids into gold ids; others stay as they are.
    """
    named = hits.where(F.col("rank") <= top_k)
    if id_map is not None:
        named = named.join(id_map.dropDuplicates(["raw_id"]), F.col("record_id") == F.col("raw_id"), "left").withColumn("record_id", F.coalesce("gold_id", "record_id"))
    lists = named.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "record_id"))).alias("l")).select("question_id", F.col("l.record_id").alias("ranked"))
    rows = questions.select("question_id", "mode", F.coalesce("expected", F.array().cast("array<string>")).alias("expected")).join(lists, "question_id", "left")
    rows = rows.withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>")))
    r, e = F.col("ranked"), F.col("expected")
    return rows.select("question_id", "mode", F.size("ranked").alias("n_hits"), recall_at(r, e, 5).alias("recall_5"), recall_at(r, e, 10).alias("recall_10"), ndcg_at(r, e, 10).alias("ndcg_10"), reciprocal_rank(r, e).alias("mrr"))


def summary(metrics: DataFrame) -> DataFrame:
    """Means over the questions of mode search, and the share of abstain questions without hits."""
    search = F.col("mode") == "search"
    return metrics.agg(
        F.count(F.when(search, 1)).alias("n_search"), *(F.avg(F.when(search, F.col(m))).alias(m) for m in ("recall_5", "recall_10", "ndcg_10", "mrr")),
        F.avg(F.when(F.col("mode") == "abstain", (F.col("n_hits") == 0).cast("double"))).alias("abstention_rate"),
    )


def triage(posts: DataFrame, text: Column, signals: list[str], least: int = 2, strong: int = 4) -> DataFrame:
    """Rows with at least ``least`` distinct signals in their lower-cased text: ``n_signals, bucket``,
    most signals first."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = sum((F.contains(low, F.lit(s)).cast("int") for s in dict.fromkeys(signals)), F.lit(0))
    return posts.withColumn("n_signals", count).where(F.col("n_signals") >= least).withColumn("bucket", F.when(F.col("n_signals") >= strong, "strong").otherwise("medium"))

"""Ranking helpers: top-k of groups, best hit of a record, reciprocal rank fusion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their 1-based ``rank``.

    The order should be total. Spark limits groups before the shuffle (WindowGroupLimit), so a
    large group sends at most ``k`` rows from each partition.
    """
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def best_per_record(hits: DataFrame, keys: list[str], record: str = "record_id", rank: str = "rank") -> DataFrame:
    """Of each record its first hit, ranks renumbered."""
    first = top_per_group(hits.withColumnRenamed(rank, "_was"), [*keys, record], [F.col("_was")], 1).drop("rank")
    return first.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy("_was"))).drop("_was") if keys else first.withColumn(rank, F.row_number().over(Window.orderBy("_was"))).drop("_was")


def reciprocal_rank_fusion(hits: DataFrame, keys: list[str], list_column: str = "list", record: str = "record_id", k: int = RRF_K) -> DataFrame:
    """``keys, record, chunk_id, score, rank`` from ranked lists (columns keys, list, record,
    chunk_id, rank): the sum of 1 / (k + best rank) over the lists.

    Ranks count all positions of a list. The chunk is the best one of the first list that has
    the record; ties are ordered by record.
    """
    best = hits.groupBy(*keys, list_column, record).agg(F.min(F.struct("rank", "chunk_id")).alias("b"))
    fused = best.groupBy(*keys, record).agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("b.rank"))), 12).alias("score"), F.min_by(F.col("b.chunk_id"), F.col(list_column)).alias("chunk_id"))
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col(record)) if keys else Window.orderBy(F.col("score").desc(), F.col(record))
    return fused.withColumn("rank", F.row_number().over(order))


class BestRows:
    """Executor side: the best ``k`` rows of each of several questions, over blocks of scores.

    Order: ``first`` (true before false), the larger score, the smaller key."""

    def __init__(self, questions: int, k: int):
        self.k, self.n = k, questions
        self.q = np.empty(0, np.int64)
        self.first, self.score, self.key = np.empty(0, bool), np.empty(0), None

    def add(self, scores: np.ndarray, keys: np.ndarray, valid: np.ndarray | None = None, first: np.ndarray | None = None) -> None:
        """A block: ``scores`` (questions x rows), the rows' keys, which pairs count, which come first."""
        if not scores.size:
            return
        low = scores if valid is None else np.where(valid, scores, -np.inf)
        if first is not None:  # one order for both: what comes first is lifted above all else
            top = float(np.abs(np.where(np.isfinite(low), low, 0)).max()) + 1.0
            low = np.where(first & np.isfinite(low), low + 2 * top, low)
        keep = np.isfinite(low)
        if low.shape[1] > self.k:
            least = np.partition(low, low.shape[1] - self.k, axis=1)[:, low.shape[1] - self.k]
            keep &= low >= least[:, None]
        q, r = np.nonzero(keep)
        flag = first[q, r] if first is not None else np.zeros(len(q), bool)
        own = np.asarray(keys)[r]
        self.q, self.first, self.score = np.concatenate((self.q, q)), np.concatenate((self.first, flag)), np.concatenate((self.score, scores[q, r]))
        self.key = own if self.key is None else np.concatenate((self.key, own))
        if len(self.q) > 4 * self.k * self.n:
            self._cut()

    def _cut(self) -> None:
        order = np.lexsort((self.key, -self.score, ~self.first, self.q))
        q = self.q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order = order[place < self.k]
        self.q, self.first, self.score, self.key = self.q[order], self.first[order], self.score[order], self.key[order]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Question, key, score, first."""
        if self.key is None:
            return self.q, np.empty(0, np.str_), self.score, self.first
        self._cut()
        return self.q, self.key, self.score, self.first

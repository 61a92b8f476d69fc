"""Retrievers over a corpus: ranked records of many questions in one plan each.

``VectorIndex`` embeds chunks, or one text for each record (chunk field ``__document__``), once and
keeps the vectors as a table; ``lexical_ranked``, ``dense_ranked`` and ``hybrid_ranked`` give the
best records of each question with their best chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import Corpus
from ..errors import EngineError
from ..operators.chunk import document_text
from ..operators.lexical import LexicalIndex
from ..operators.rank import RRF_K, best_per_record, reciprocal_rank_fusion, top_per_group
from ..operators.vector import Embedder, embed_cached, vector_search_many
from ..session import staged

#: Fixed value: the chunk field of a record's single vector.
DOCUMENT_FIELD = "__document__"
OVERFETCH = 5


def _embedded(rows: DataFrame, embedder: Embedder, cache: DataFrame | None) -> DataFrame:
    if cache is None:
        return embedder.embed(rows).withColumn("embedding", F.col("embedding").cast("array<float>"))
    return embed_cached(rows, cache, embedder).vectors.drop("key")


@dataclass(frozen=True)
class VectorIndex:
    """``vectors``: chunk_id, record_id, embedding and the columns to filter on."""

    vectors: DataFrame
    embedder: Embedder

    @staticmethod
    def of_chunks(chunks: DataFrame, embedder: Embedder, cache: DataFrame | None = None) -> VectorIndex:
        """One vector for each chunk_id (chunk_id, record_id, text and what else the chunks have)."""
        once = chunks.dropDuplicates(["chunk_id"])
        return VectorIndex(staged(_embedded(once, embedder, cache).drop("text"), "chunk-vectors"), embedder)

    @staticmethod
    def of_documents(records: DataFrame, corpus: Corpus, embedder: Embedder, cache: DataFrame | None = None, fields: list[str] | None = None) -> VectorIndex:
        """One vector for each record, of its search fields' text; filter and facet fields are kept beside it.

        A record without text has the vector of the empty text, as it is stored too."""
        names = fields if fields is not None else corpus.with_role("search")
        if not names:
            raise EngineError("a document index needs search fields")
        have = set(records.schema["fields"].dataType.names)
        beside = [F.col(f"fields.{f}").alias(f) for f in corpus.with_role("filter", "facet") if f in have]
        rows = records.select(F.concat_ws("::", "id", F.lit(DOCUMENT_FIELD), F.lit("0")).alias("chunk_id"), F.col("id").alias("record_id"), F.lit(DOCUMENT_FIELD).alias("chunk_field"), document_text(records, names).alias("text"), *beside)
        return VectorIndex.of_chunks(rows, embedder, cache)

    def search(self, questions: DataFrame, top_k: int, keep_if: Column | None = None, score: str = "cosine", prefilter: bool = True) -> DataFrame:
        """``qid, record_id, chunk_id, score, rank`` of the questions (qid, question).

        ``score`` is ``cosine``, or ``distance`` (1 less the Euclidean distance). ``keep_if`` filters
        before scoring, or without ``prefilter`` after the best ``5 * top_k`` were taken.
        """
        asked = self.embedder.embed(questions.select("qid", F.col("question").alias("text"))).select("qid", F.col("embedding").alias("query"))
        rows = self.vectors if keep_if is None or not prefilter else self.vectors.where(keep_if)
        late = keep_if is not None and not prefilter
        hits = vector_search_many(rows, asked, top_k * OVERFETCH if late else top_k, score=score)
        named = hits.join(self.vectors.select("chunk_id", "record_id", (keep_if if late else F.lit(True)).alias("_keep")), "chunk_id")
        if late:
            named = top_per_group(named.where("_keep").drop("rank"), ["qid"], [F.col("score").desc(), F.col("chunk_id")], top_k)
        return named.select("qid", "record_id", "chunk_id", "score", "rank")


def ranked_records(search: Callable[[int], DataFrame], top_k: int) -> DataFrame:
    """The best chunk of each of the ``top_k`` best records of every question.

    ``search(n)`` gives the best n chunks of each question; more are asked for until every question
    has so many records or no chunk is left."""
    asked = top_k
    while True:
        hits = staged(search(asked), "ranked")
        counts = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("records"))
        if counts.where((F.col("records") < top_k) & (F.col("n") >= asked)).isEmpty():
            return best_per_record(hits, ["qid"]).where(F.col("rank") <= top_k)
        asked *= 4


def lexical_ranked(index: LexicalIndex, questions: DataFrame, top_k: int) -> DataFrame:
    return ranked_records(lambda n: index.search(questions, n), top_k)


def dense_ranked(index: VectorIndex, questions: DataFrame, top_k: int, keep_if: Column | None = None) -> DataFrame:
    return ranked_records(lambda n: index.search(questions, n, keep_if), top_k)


def hybrid_ranked(lexical: DataFrame, dense: DataFrame | None, top_k: int, k: int = RRF_K) -> DataFrame:
    """Both ranked lists fused by reciprocal ranks; the lexical one alone without a dense one."""
    if dense is None:
        return lexical
    cols = ["qid", "record_id", "chunk_id", "score", "rank"]
    both = lexical.select(*cols, F.lit(0).alias("list")).unionByName(dense.select(*cols, F.lit(1).alias("list")))
    return reciprocal_rank_fusion(both, ["qid"], k=k).where(F.col("rank") <= top_k)

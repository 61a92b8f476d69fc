"""Lexical search: postings, phrases, BM25, one plan for any number of questions.

A question is split at blanks; each part is a phrase of index tokens. Chunks that have all
phrases answer it; only where there are none, chunks that have any. Scores are

    sum over phrases of idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * D / avgdl)),
    idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6

over chunks; a phrase asked twice counts twice. ``search`` lays out the frequencies of the asked
phrases by chunk once and scores blocks of chunks against all questions, so no row is made for a
question and a chunk; ``matches`` gives every such row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import index_tokens
from ..session import fits_broadcast, ship, staged
from .rank import BestRows, top_per_group

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
MAX_SENT_TOKENS = 200_000


@dataclass(frozen=True)
class LexicalIndex:
    """``tokens``: chunk_id, record_id, toks, size; ``stats``: chunks and avgdl in one row."""

    tokens: DataFrame
    stats: DataFrame

    @staticmethod
    def build(chunks: DataFrame, keep: bool = False) -> LexicalIndex:
        """From chunk_id, record_id, text (other columns are carried); rows of one chunk_id count
        once. ``keep`` writes the tokens to the shared folder for many searches."""
        once = chunks.dropDuplicates(["chunk_id"])
        tokens = once.withColumn("toks", index_tokens(F.col("text"))).drop("text").withColumn("size", F.size("toks"))
        tokens = staged(tokens, "lexical-index") if keep else tokens
        return LexicalIndex(tokens, tokens.agg(F.count(F.lit(1)).alias("chunks"), F.avg("size").alias("avgdl")))

    def phrases(self, questions: DataFrame) -> DataFrame:
        """``qid, toks, times`` of the questions' phrases; phrases without a token have none."""
        flat = questions.select("qid", F.explode(F.filter(F.split("question", r"\s+"), lambda x: x != "")).alias("part"))
        return flat.select("qid", index_tokens(F.col("part")).alias("toks")).groupBy("qid", "toks").agg(F.count(F.lit(1)).alias("times"))

    def matches(self, questions: DataFrame, keep_if: Column | None = None) -> DataFrame:
        """``qid, chunk_id, score, complete, keep``: complete tells whether all phrases are there.

        Phrase frequencies are laid out by chunk once; the weights of all questions (bounded by
        the questions) are sent there, so a question's score for a chunk is summed up in place.
        """
        phrases = staged(self.phrases(questions).withColumn("pid", F.xxhash64("toks")), "phrases")
        asked = phrases.where(F.size("toks") > 0)
        words = asked.select(F.explode("toks").alias("tok")).distinct()
        small = fits_broadcast(phrases, MAX_SENT_TOKENS)
        sent = F.broadcast if small else (lambda df: df)
        keep = F.coalesce(keep_if, F.lit(False)) if keep_if is not None else F.lit(True)
        placed = self.tokens.select("chunk_id", "size", keep.alias("keep"), F.posexplode("toks").alias("pos", "tok")).join(sent(words), "tok", "left_semi")
        distinct = asked.select("pid", "toks").distinct()
        single = distinct.where(F.size("toks") == 1).select("pid", F.col("toks")[0].alias("tok"))
        counts = placed.groupBy("chunk_id", "size", "keep", "tok").agg(F.count(F.lit(1)).alias("f")).join(sent(single), "tok").select("chunk_id", "size", "keep", "pid", "f")
        several = distinct.where(F.size("toks") > 1).select("pid", F.size("toks").alias("length"), F.posexplode("toks").alias("at", "tok"))
        runs = placed.join(sent(several), "tok").groupBy("chunk_id", "size", "keep", "pid", "length", (F.col("pos") - F.col("at")).alias("begin")).agg(F.count(F.lit(1)).alias("there")).where("there = length")
        found = staged(counts.unionByName(runs.groupBy("chunk_id", "size", "keep", "pid").agg(F.count(F.lit(1)).alias("f"))), "phrase-matches")
        n = found.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
        needed = phrases.groupBy("qid").agg(F.count(F.lit(1)).alias("needed"))  # one without a token is never met
        idf = F.greatest(F.log((F.col("chunks") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(LEAST_IDF))
        weights = asked.join(n, "pid").crossJoin(F.broadcast(self.stats)).join(needed, "qid").select("qid", "pid", (F.col("times") * idf).alias("weight"), "avgdl", "needed")  # stats is one row
        weights = staged(weights, "phrase-weights")
        part = F.col("weight") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("size") / F.col("avgdl")))
        scored = found.repartition("chunk_id").join(sent(weights), "pid")
        return scored.groupBy("qid", "chunk_id", "keep", "needed").agg(F.round(F.sum(part), 9).alias("score"), F.count(F.lit(1)).alias("met")).select("qid", "chunk_id", "score", (F.col("met") == F.col("needed")).alias("complete"), "keep")

    def _in_place(self, phrases: DataFrame, top_k: int, keep_if: Column | None, prefilter: bool) -> DataFrame:
        """The best chunks of each question (``qid, chunk_id, score, complete, kept``) without a row for
        each question and chunk.

        One pass counts the asked phrases in each chunk, a summary gives their document frequencies,
        and a second pass scores blocks of chunks against all questions as matrix products; every task
        sends on its best rows only. Questions and phrases are at most ``MAX_SENT_TOKENS``.
        """
        spark = phrases.sparkSession
        ship(spark)
        asked = phrases.select("qid", "toks", "times").collect()  # at most MAX_SENT_TOKENS
        names = sorted({r["qid"] for r in asked})
        of = {tuple(r["toks"]): None for r in asked if r["toks"]}
        pids = {t: i for i, t in enumerate(of)}
        schema = T.StructType([T.StructField("qid", phrases.schema["qid"].dataType), T.StructField("chunk_id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("complete", T.BooleanType()), T.StructField("kept", T.BooleanType())])
        if not pids or not names:
            return spark.createDataFrame([], schema)
        keep = F.coalesce(keep_if, F.lit(False)) if keep_if is not None else F.lit(True)
        counted = self.tokens.select("chunk_id", "size", keep.alias("keep"), "toks").mapInArrow(_phrase_counts(list(pids)), "chunk_id string, size int, keep boolean, pids array<int>, fs array<int>")
        found = staged(counted, "phrase-counts")
        n = np.zeros(len(pids))
        for r in found.select(F.explode("pids").alias("p")).groupBy("p").count().collect():  # one row for each phrase
            n[r["p"]] = r["count"]
        chunks, avgdl = self.stats.first()
        idf = np.maximum(np.log((chunks - n + 0.5) / (n + 0.5)), LEAST_IDF)
        place = {q: i for i, q in enumerate(names)}
        weights: list[dict[int, float]] = [{} for _ in names]
        needed = np.zeros(len(names), np.int64)
        for r in asked:
            needed[place[r["qid"]]] += 1
            if r["toks"]:
                p = pids[tuple(r["toks"])]
                weights[place[r["qid"]]][p] = r["times"] * idf[p]
        ids = spark.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("q", T.IntegerType()), schema["qid"]]))
        rows = found.mapInArrow(_scored(weights, needed, len(pids), float(avgdl or 1.0), top_k, prefilter), "q int, chunk_id string, score double, complete boolean, kept boolean")
        return rows.join(F.broadcast(ids), "q").select("qid", "chunk_id", "score", "complete", "kept")

    def search(self, questions: DataFrame, top_k: int, keep_if: Column | None = None, prefilter: bool = False) -> DataFrame:
        """``qid, record_id, chunk_id, score, rank``: the best chunks of each question.

        ``keep_if`` filters on the index's other columns: after the best ``5 * top_k`` were
        taken, or before with ``prefilter`` (never fewer hits).
        """
        if top_k <= 0:
            return self.tokens.select(F.lit("").alias("qid"), "record_id", "chunk_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        order = [F.col("complete").desc(), F.col("score").desc(), F.col("chunk_id")]
        wide = top_k * 5 if keep_if is not None and not prefilter else top_k
        phrases = staged(self.phrases(questions), "phrases")
        if fits_broadcast(phrases, MAX_SENT_TOKENS):
            hits = self._in_place(phrases, wide, keep_if, keep_if is not None and prefilter)
        else:
            hits = self.matches(questions, keep_if).withColumnRenamed("keep", "kept")
        if keep_if is not None and prefilter:
            hits = staged(hits, "lexical-hits")
            strict = hits.where("complete").select("qid").distinct().withColumn("strict", F.lit(True))
            rows = hits.where("kept").join(strict, "qid", "left").where("complete or strict is null")
            best = top_per_group(rows, ["qid"], order, top_k)
        else:
            # Complete answers come first, so the head of the ranking tells whether there are any.
            best = top_per_group(hits, ["qid"], order, wide)
            strict = F.max("complete").over(Window.partitionBy("qid"))
            best = best.withColumn("strict", strict).where("complete or not strict")
        best = staged(best, "lexical-best")
        chunks = best.select("chunk_id").distinct()
        keep = F.coalesce(keep_if, F.lit(False)) if keep_if is not None else F.lit(True)
        named = self.tokens.select("chunk_id", "record_id", keep.alias("keep")).join(F.broadcast(chunks) if fits_broadcast(chunks, MAX_SENT_TOKENS) else chunks, "chunk_id", "left_semi")
        rows = best.join(named, "chunk_id")
        if keep_if is not None and not prefilter:
            rows = top_per_group(rows.where("keep").drop("rank"), ["qid"], order, top_k)
        return rows.select("qid", "record_id", "chunk_id", "score", "rank")


def _phrase_counts(phrases: list[tuple[str, ...]]):
    """``chunk_id, size, keep, pids, fs``: how often each phrase is in each chunk that has any."""
    words = list(dict.fromkeys(t for p in phrases for t in p))
    number = {w: i for i, w in enumerate(words)}
    single = np.full(len(words), -1)
    several = []
    for i, p in enumerate(phrases):
        if len(p) == 1:
            single[number[p[0]]] = i
        else:
            several.append((i, [number[t] for t in p]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.array(words, pa.string())
        for batch in batches:
            toks = batch.column(3)
            sizes = pc.list_value_length(toks).fill_null(0).to_numpy(zero_copy_only=False)
            at = pc.index_in(toks.flatten(), value_set=listed).fill_null(-1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            here = np.flatnonzero(at >= 0)
            own = single[at[here]]
            one = own >= 0
            rows, pids = [row[here][one]], [own[one]]
            for i, seq in several:
                begin = here[at[here] == seq[0]]
                begin = begin[begin + len(seq) <= len(at)]
                for k, t in enumerate(seq[1:], 1):
                    begin = begin[(at[begin + k] == t) & (row[begin + k] == row[begin])]
                rows.append(row[begin])
                pids.append(np.full(len(begin), i))
            pair, count = np.unique(np.concatenate(rows) * len(phrases) + np.concatenate(pids), return_counts=True)
            r, p = pair // len(phrases), pair % len(phrases)
            have, first = np.unique(r, return_index=True)
            ends = pa.array(np.append(first, len(r)).astype(np.int32))
            keep = pa.array(have)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(keep), batch.column(1).take(keep), batch.column(2).take(keep), pa.ListArray.from_arrays(ends, pa.array(p.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int32)))],
                names=["chunk_id", "size", "keep", "pids", "fs"],
            )

    return run


def _scored(weights: list[dict[int, float]], needed: np.ndarray, phrases: int, avgdl: float, top_k: int, prefilter: bool):
    """Scores of blocks of chunks for blocks of questions; the best rows of each question and task."""
    block = max(1, min(len(weights), 4_000_000 // max(phrases, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for b in range(0, len(weights), block):
            part = weights[b : b + block]
            used = np.array(sorted({p for w in part for p in w}), np.int64)
            at = {int(p): i for i, p in enumerate(used)}
            m = np.zeros((len(part), len(used)))
            for q, w in enumerate(part):
                for p, x in w.items():
                    m[q, at[p]] = x
            slot = np.full(phrases, -1)
            slot[used] = np.arange(len(used))
            blocks.append((b, m, (m > 0).astype(np.float32), slot, BestRows(len(part), top_k), BestRows(len(part), top_k) if prefilter else None))
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                n = part.num_rows
                keys, size, keep = np.array(part.column(0).to_pylist(), dtype=np.str_), part.column(1).to_numpy(), part.column(2).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(n), pc.list_value_length(part.column(3)).to_numpy())
                p, f = part.column(3).flatten().to_numpy(), part.column(4).flatten().to_numpy().astype(float)
                c = f * (K1 + 1) / (f + K1 * (1 - B + B * size[row] / avgdl))
                for b, m, there, slot, best, kept in blocks:
                    s = slot[p]
                    ok = s >= 0
                    grid = np.zeros((m.shape[1], n))
                    grid[s[ok], row[ok]] = c[ok]
                    score = np.round(m @ grid, 9)
                    met = np.rint(there @ (grid > 0).astype(np.float32)).astype(np.int64)
                    complete = met == needed[b : b + len(m), None]
                    best.add(score, keys, met > 0, complete)
                    if kept is not None:
                        kept.add(score, keys, (met > 0) & keep[None, :], complete)
        held = []
        for b, *_, best, kept in blocks:
            for found, of_kept in ((best, False), (kept, True)):
                if found is not None:
                    q, key, score, first = found.rows()
                    held.append((q + b, key, score, first, of_kept))
        for q, key, score, first, of_kept in held:
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(key.tolist(), pa.string()), pa.array(score), pa.array(first), pa.array(np.full(len(q), of_kept))], names=["q", "chunk_id", "score", "complete", "kept"])

    return run


def metadata_filter(filters: dict, metadata: str = "metadata", kinds: dict | None = None) -> Column:
    """All entries hold: a wanted scalar equals the value, or is among a list's values; a wanted
    list overlaps a list and never meets a scalar. ``kinds`` tells which entries are lists."""
    out = F.lit(True)
    for name, want in filters.items():
        col = F.col(f"{metadata}.{name}")
        wanted = want if isinstance(want, list) else [want]
        if (kinds or {}).get(name) == "list":
            out = out & F.coalesce(F.arrays_overlap(col, F.array(*map(F.lit, wanted))), F.lit(False))
        else:
            out = out & (F.lit(False) if isinstance(want, list) else F.coalesce(col == F.lit(want), F.lit(False)))
    return out

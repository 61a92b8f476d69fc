"""Filling fixed-capacity containers with texts: a grouping genetic algorithm (problem 8).

1. Sizes are tokens of a public tokenizer (a rank file whose path is a parameter). Only a text
   above the capacity is split, into full containers and a rest.
2. Pieces are spread by hash over shards of about ``shard_items``; the number of shards follows
   the input, so no task holds an unbounded group.
3. Several islands evolve packings of each shard. A packing is an individual whose genes are
   whole containers. Crossover injects well-filled containers of one parent into the other,
   removes the containers that hold any of their pieces, and puts displaced pieces back by best
   fit. Mutation empties the worst-filled containers. An island stops early when its packing
   needs no more containers than the total size demands.
4. Between epochs each island's elite migrates to the next island of its shard, as table rows.
5. Containers below ``consolidate`` of the capacity, from all shards, are opened and their
   pieces packed once more in shards of their own.

Defined cases: null and empty texts have 0 tokens and are put into some container of their
shard; equal sizes are told apart by id and piece; a repeated id is an error of the input
(ids are unique); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, staged

TOKENIZER = os.environ.get("LODESTRATA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the published pattern that splits text before the merges of such a rank file.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TokenCounter:
    """Counts tokens; the counts of up to ``keep`` distinct pre-tokens are remembered."""

    def __init__(self, path: str, keep: int = 500_000):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})
        self.split, self.keep, self.known = regex.compile(PRETOKENS).findall, keep, {}

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        if len(known) > self.keep:
            known.clear()
        for t in self.split(text):
            n = known.get(t)
            if n is None:
                n = known[t] = len(self.encoding.encode_ordinary(t))
            total += n
        return total


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``id, n_tokens`` of whole texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or TokenCounter(path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t) for t in batch.column(1).to_pylist()], pa.int64())], names=["id", "n_tokens"])

    return docs.select(F.col("id").cast("bigint"), "text").mapInArrow(run, "id bigint, n_tokens bigint")


def best_fit(order: np.ndarray, sizes: np.ndarray, assign: np.ndarray, free: list[int], capacity: int) -> None:
    """Put the pieces of ``order`` into the fullest container that has room, in place."""
    room = sorted((f, b) for b, f in enumerate(free) if f > 0)
    for i in order:
        s = int(sizes[i])
        k = bisect_left(room, (s, -1))
        if k < len(room):
            f, b = room.pop(k)
        else:
            f, b = capacity, len(free)
            free.append(capacity)
        assign[i] = b
        free[b] = f - s
        if f > s:
            insort(room, (f - s, b))


def _rebuilt(assign: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Containers numbered without gaps, and their free room; -1 stays unassigned."""
    out = np.full(len(assign), -1)
    placed = assign >= 0
    _, out[placed] = np.unique(assign[placed], return_inverse=True)
    load = np.bincount(out[placed], weights=sizes[placed])
    return out, [int(x) for x in capacity - load]


def fitness(assign: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Mean squared filling of the containers: fewer and fuller ones are better."""
    load = np.bincount(assign, weights=sizes)
    return float(np.mean((load / capacity) ** 2)) if len(load) else 0.0


def _descending(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return rows[np.argsort(-sizes[rows], kind="stable")]


def crossover(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    load = np.bincount(two, weights=sizes)
    count = max(1, int(len(load) * rng.uniform(0.1, 0.4)))
    chosen = rng.choice(len(load), min(count, len(load)), replace=False, p=(load + 1) ** 4 / ((load + 1) ** 4).sum())
    injected = np.isin(two, chosen)
    broken = np.unique(one[injected])
    child = np.where(np.isin(one, broken), -1, one)
    child[injected] = two[injected] + len(one) + 1
    lost = np.flatnonzero(child < 0)
    child, free = _rebuilt(child, sizes, capacity)
    best_fit(_descending(lost, sizes), sizes, child, free, capacity)
    return child


def mutation(one: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    load = np.bincount(one, weights=sizes)
    worst = np.argsort(load)[: max(2, int(rng.integers(2, 6)))]
    lost = np.flatnonzero(np.isin(one, worst))
    child, free = _rebuilt(np.where(np.isin(one, worst), -1, one), sizes, capacity)
    rng.shuffle(lost)
    best_fit(lost, sizes, child, free, capacity)
    return child


def evolve(sizes: np.ndarray, capacity: int, seeds: list[np.ndarray], population: int, generations: int, rng: np.random.Generator) -> np.ndarray:
    """The best packing (container number of each piece) of one island's epoch."""
    n = len(sizes)
    least = max(1, -(-int(sizes.sum()) // capacity))
    pool = list(seeds)
    while len(pool) < population:
        order = _descending(np.arange(n), sizes) if not pool else rng.permutation(n)
        new, free = np.full(n, -1), []
        best_fit(order, sizes, new, free, capacity)
        pool.append(new)
        if new.max(initial=-1) + 1 <= least:
            return new
    score = [fitness(p, sizes, capacity) for p in pool]
    for _ in range(generations):
        for _ in range(max(1, population // 2)):
            i, j = (max(rng.choice(len(pool), 2, replace=False), key=lambda x: score[x]) for _ in range(2))
            child = crossover(pool[i], pool[j], sizes, capacity, rng) if i != j else mutation(pool[i], sizes, capacity, rng)
            if rng.random() < 0.3:
                child = mutation(child, sizes, capacity, rng)
            value, worst = fitness(child, sizes, capacity), int(np.argmin(score))
            if value > score[worst]:
                pool[worst], score[worst] = child, value
            if child.max(initial=-1) + 1 <= least:
                return child
    return pool[int(np.argmax(score))]


def _island(capacity: int, population: int, generations: int, epoch: int, seed: int):
    def run(key: tuple, items: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["id", "piece"])
        if not len(items):
            return pd.DataFrame({"shard": [], "island": [], "fitness": [], "packing": []})
        sizes = items["size"].to_numpy(np.int64)
        shard, island = int(key[0]), int(key[1])
        seeds = [np.frombuffer(p, np.int32).astype(np.int64) for p in elites.sort_values(["fitness", "packing"])["packing"]]
        best = evolve(sizes, capacity, seeds, population, generations, np.random.default_rng([seed, epoch, shard, island]))
        return pd.DataFrame({"shard": [shard], "island": [island], "fitness": [fitness(best, sizes, capacity)], "packing": [best.astype(np.int32).tobytes()]})

    return run


def _unfold(items: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
    items = items.sort_values(["id", "piece"])
    if not len(items):
        return items[["id", "piece", "size", "shard"]].assign(bin=[])
    return items[["id", "piece", "size", "shard"]].assign(bin=np.frombuffer(best["packing"].iloc[0], np.int32).astype(np.int64))


def _packed(items: DataFrame, capacity: int, shard_items: int, islands: int, epochs: int, population: int, generations: int, seed: int) -> DataFrame:
    """``id, piece, size, shard, bin`` of items of at most the capacity."""
    count = items.count()
    shards = max(1, -(-count // shard_items))
    spread = staged(items.withColumn("shard", F.pmod(F.xxhash64("id", "piece", F.lit(seed)), F.lit(shards)).cast("bigint")), "packing-items")
    on_islands = spread.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(islands - 1).cast("bigint"))).alias("island"))
    shape = "shard bigint, island bigint, fitness double, packing binary"
    elites = spread.sparkSession.createDataFrame([], shape)
    for epoch in range(epochs):
        # An elite stays on its island and goes to the next one.
        here = elites.select("shard", F.explode(F.array_distinct(F.array("island", (F.col("island") + 1) % islands))).alias("island"), "fitness", "packing")
        elites = on_islands.groupBy("shard", "island").cogroup(here.groupBy("shard", "island")).applyInPandas(_island(capacity, population, generations, epoch, seed), shape)
        elites = staged(elites, "elites")
    best = elites.groupBy("shard").agg(F.max_by("packing", F.struct("fitness", -F.col("island"))).alias("packing"))
    return spread.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(_unfold, "id bigint, piece int, size bigint, shard bigint, bin bigint")


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str = TOKENIZER, shard_items: int = 1024, islands: int = 2, epochs: int = 2, population: int = 8, generations: int = 6, consolidate: float = 0.98, seed: int = 5) -> DataFrame:
    """``id, piece_no, n_pieces, token_start, token_end, n_tokens, container_id`` for every text.

    ``docs`` has a unique ``id bigint`` and ``text``. Pieces of a text above the capacity are
    token ranges; every other text is one piece.
    """
    sized = staged(token_counts(docs, tokenizer), "token-counts")
    pieces = sized.withColumn("n_pieces", F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("int"))
    pieces = pieces.select("id", "n_pieces", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
    pieces = pieces.withColumn("token_start", F.col("piece").cast("bigint") * capacity).withColumn("token_end", F.least(F.col("token_start") + capacity, "n_tokens")).withColumn("size", F.col("token_end") - F.col("token_start"))
    full = pieces.where(F.col("size") == capacity).select("id", "piece", F.concat(F.lit("full-"), "id", F.lit("-"), "piece").alias("container_id"))
    part = pieces.where(F.col("size") < capacity).select("id", "piece", "size")
    once = staged(_packed(part, capacity, shard_items, islands, epochs, population, generations, seed), "packed")
    fill = once.groupBy("shard", "bin").agg((F.sum("size") / capacity).alias("fill"))
    marked = once.join(fill, ["shard", "bin"])
    good = marked.where(F.col("fill") >= consolidate).select("id", "piece", F.concat_ws("-", F.lit("a"), "shard", "bin").alias("container_id"))
    again = _packed(marked.where(F.col("fill") < consolidate).select("id", "piece", "size"), capacity, shard_items, islands, epochs, population, generations, seed + 1)
    again = again.select("id", "piece", F.concat_ws("-", F.lit("b"), "shard", "bin").alias("container_id"))
    placed = full.unionByName(good).unionByName(again)
    return pieces.join(placed, ["id", "piece"]).select("id", (F.col("piece") + 1).alias("piece_no"), "n_pieces", "token_start", "token_end", F.col("size").alias("n_tokens"), "container_id")

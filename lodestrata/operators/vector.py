"""Vectors: the hash embedder in SQL functions, an embedding cache, cosine top-k."""

from __future__ import annotations

import hashlib
import importlib.util
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EmbeddingError
from ..session import ship, staged
from .rank import BestRows, top_per_group

CHARS_PER_TOKEN = 4
#: As many query vectors at most are sent to all executors at once.
QUERY_BLOCK = 10_000


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_key(text: Column, model: str, dims: int) -> Column:
    return F.concat_ws("::", text_hash(text), F.lit(model), F.lit(str(dims)))


def hash_embedding(text: Column, dims: int = 16) -> Column:
    """Counts of tokens by bucket, at unit length; a text without tokens stays zero.

    An Arrow UDF: the built-in equivalent (MD5 halves modulo ``dims`` in higher-order functions) is
    interpreted for each token and bucket and took several times as long.
    """

    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        out = []
        for t in texts:
            counts = np.zeros(dims)
            for token in (t or "").lower().split():
                bucket = known.get(token)
                if bucket is None:
                    bucket = known[token] = int(hashlib.md5(token.encode()).hexdigest(), 16) % dims
                counts[bucket] += 1
            size = np.sqrt(counts @ counts)
            out.append(counts / size if size else counts)
        return pd.Series(out)

    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


@dataclass(frozen=True)
class Embedder:
    """A model: ``embed`` adds the column ``embedding`` to a frame with the column ``text``."""

    model: str
    dims: int
    embed: Callable[[DataFrame], DataFrame]
    price_per_million: float = 0.0


def hash_embedder(dims: int = 16, model: str = "hash-embed") -> Embedder:
    return Embedder(model, dims, lambda df: df.withColumn("embedding", hash_embedding(F.col("text"), dims)))


def provider_embedder(model: str, dims: int, call: Callable[[list[str]], list[list[float]]] | None, batch: int = 25, price_per_million: float = 0.0) -> Embedder:
    """An outside model called in batches on the executors; ``call`` is built by the caller and
    must find its own key. Without one it fails before any work."""

    def embed(df: DataFrame) -> DataFrame:
        if call is None:
            raise EmbeddingError(f"no client for {model}")
        schema = df.drop("embedding").schema.add("embedding", T.ArrayType(T.DoubleType()))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                texts, vectors = frame["text"].tolist(), []
                for at in range(0, len(texts), batch):
                    vectors += call(texts[at : at + batch])
                yield frame.assign(embedding=vectors)

        return df.drop("embedding").mapInPandas(run, schema)

    return Embedder(model, dims, embed, price_per_million)


def _gemini(model: str, dims: int, key: str) -> Callable[[list[str]], list[list[float]]]:
    def call(texts: list[str]) -> list[list[float]]:
        from google import genai

        got = genai.Client(api_key=os.environ[key]).models.embed_content(model=model, contents=texts, config={"output_dimensionality": dims})
        return [list(e.values) for e in got.embeddings]

    return call


def _voyage(model: str, dims: int, key: str) -> Callable[[list[str]], list[list[float]]]:
    def call(texts: list[str]) -> list[list[float]]:
        import voyageai

        return voyageai.Client(api_key=os.environ[key]).embed(texts, model=model, output_dimension=dims).embeddings

    return call


#: Package, environment variable of the key, and call of each provider.
PROVIDERS = {"gemini": ("google.genai", "GEMINI_API_KEY", _gemini), "voyage": ("voyageai", "VOYAGE_API_KEY", _voyage)}


def named_embedder(provider: str, model: str, dims: int, batch: int = 25, price_per_million: float = 0.0) -> Embedder:
    """A provider's model. Packages are imported on the executors, when rows are embedded; each finds
    the key in its own environment. Without package or key on the driver it fails before any work."""
    if provider not in PROVIDERS:
        raise EmbeddingError(f"unknown provider {provider!r}")
    package, key, make = PROVIDERS[provider]

    def embed(df: DataFrame) -> DataFrame:
        if not os.environ.get(key):
            raise EmbeddingError(f"{provider}: {key} is not set")
        try:
            found = importlib.util.find_spec(package)
        except ModuleNotFoundError:
            found = None
        if found is None:
            raise EmbeddingError(f"{provider}: the package {package} is not installed")
        return provider_embedder(model, dims, make(model, dims, key), batch, price_per_million).embed(df)

    return Embedder(model, dims, embed, price_per_million)


@dataclass(frozen=True)
class Embedded:
    """``vectors``: the asked rows with embedding; ``added``: new cache rows; counts as one row."""

    vectors: DataFrame
    added: DataFrame
    counts: DataFrame


def asked_keys(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """``key, hit`` of each distinct asked key. Keys meet keys; no vector is read."""
    have = cache.where("embedding is not null").select("key").distinct()
    return keyed.select("key").distinct().join(have.withColumn("_hit", F.lit(True)), "key", "left").select("key", F.coalesce("_hit", F.lit(False)).alias("hit"))


def embed_cached(texts: DataFrame, cache: DataFrame, embedder: Embedder) -> Embedded:
    """Look up by (text hash, model, dims); embed each distinct missing text once.

    ``texts`` has the column text, ``cache`` has key and embedding. Cached vectors are floats.
    """
    keyed = texts.withColumn("key", cache_key(F.col("text"), embedder.model, embedder.dims))
    wanted = staged(asked_keys(keyed, cache), "wanted-keys")
    first = keyed.select("key", "text").join(wanted.where("not hit").select("key"), "key", "left_semi").dropDuplicates(["key"])
    added = staged(embedder.embed(first).select("key", F.col("embedding").cast("array<float>").alias("embedding")), "embedded")
    hits = cache.where("embedding is not null").join(wanted.where("hit").select("key"), "key", "left_semi").groupBy("key").agg(F.first("embedding").alias("embedding"))
    vectors = keyed.join(hits.unionByName(added), "key", "left")
    missed = keyed.join(wanted.where("not hit").select("key"), "key", "left_semi")
    counts = keyed.agg(F.count(F.lit(1)).alias("asked")).crossJoin(missed.agg(F.count(F.lit(1)).alias("misses"))).select("asked", (F.col("asked") - F.col("misses")).alias("hits"), "misses")
    return Embedded(vectors, added, counts)


def embedding_cost(texts: DataFrame, cache: DataFrame, embedder: Embedder) -> DataFrame:
    """``texts, billable, tokens, cost``: a token for every four characters begun."""
    keyed = texts.withColumn("key", cache_key(F.col("text"), embedder.model, embedder.dims))
    open_ = keyed.join(cache.select("key").distinct(), "key", "left_anti")
    tokens = F.coalesce(F.sum(F.floor(F.length("text") / CHARS_PER_TOKEN) + 1), F.lit(0)).cast("bigint")
    billed = open_.agg(F.count(F.lit(1)).alias("billable"), tokens.alias("tokens"))
    return keyed.agg(F.count(F.lit(1)).alias("texts")).crossJoin(billed).withColumn("cost", F.col("tokens") / 1e6 * embedder.price_per_million)  # both sides are one row


def vector_search(vectors: DataFrame, query: list[float], top_k: int, keep_if: Column | None = None, key: str = "chunk_id", vector: str = "embedding", dims: int | None = None) -> DataFrame:
    """``key, score``: the most similar rows to one query vector, filtered before scoring; none
    for ``top_k`` below 1 or a query of another length."""
    if top_k <= 0 or dims is not None and len(query) != dims:
        return vectors.select(key, F.lit(0.0).alias("score")).limit(0)
    rows = vectors if keep_if is None else vectors.where(keep_if)
    q = F.array(*(F.lit(float(x)) for x in query))
    others = [c for c in vectors.columns if c not in (key, vector)]
    scored = rows.where(F.size(vector) == len(query)).select(key, *others, F.round(cosine(F.col(vector), q), 9).alias("score"))
    return scored.orderBy(F.col("score").desc(), key).limit(top_k)


def _nearest_in_batches(queries: np.ndarray, top_k: int, distance: bool):
    """Best rows of each query over the batches of a task, as matrix products."""
    sizes = np.sqrt((queries * queries).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = BestRows(len(queries), top_k), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for part in (batch.slice(at, 2000) for at in range(0, batch.num_rows, 2000)):
                vectors = part.column(1)
                fits = (pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False) == queries.shape[1]) & np.asarray(part.column(0).is_valid())
                if not fits.any():
                    continue
                rows = part.filter(pa.array(fits))
                x = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, queries.shape[1])
                length = np.sqrt((x * x).sum(axis=1))
                scale = sizes[:, None] * length[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    if distance:
                        score = 1 - np.sqrt(np.maximum((sizes**2)[:, None] + (length**2)[None, :] - 2 * (queries @ x.T), 0.0))
                    else:
                        score = np.where(scale > 0, (queries @ x.T) / scale, 0.0)
                best.add(np.round(score, 9), np.array(rows.column(0).to_pylist()), np.isfinite(score) & np.isfinite(length)[None, :])
        if kind is not None:
            q, key, score, _ = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(key.tolist(), kind), pa.array(score)], names=["q", "key", "score"])

    return run


def vector_search_many(vectors: DataFrame, queries: DataFrame, top_k: int, key: str = "chunk_id", vector: str = "embedding", score: str = "cosine") -> DataFrame:
    """``qid, key, score, rank`` for a stated set of query vectors (qid, query) against all rows.

    Every task multiplies its rows with a block of at most ``QUERY_BLOCK`` queries and sends on its
    ``top_k`` best of each; more queries are taken block by block. Null vectors, those of another
    length, null keys and not-finite values are in no result; a zero vector has cosine 0. ``score`` is
    ``cosine`` or ``distance`` (1 less the Euclidean distance).
    """
    ship(vectors.sparkSession)
    asked = queries.select("qid", "query").where("query is not null")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    kinds = f"q int, key {vectors.schema[key].dataType.simpleString()}, score double"
    out = None
    for block in range(blocks):
        held = (asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block) if blocks > 1 else asked).toArrow()  # about QUERY_BLOCK rows
        of_size: dict[int, list[int]] = {}
        for i, n in enumerate(pc.list_value_length(held.column("query")).to_pylist()):
            of_size.setdefault(n, []).append(i)
        ids = queries.sparkSession.createDataFrame([(i, q) for i, q in enumerate(held.column("qid").to_pylist())], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("qid", queries.schema["qid"].dataType)]))
        for size, at in of_size.items():
            m = np.array(held.column("query").take(pa.array(at)).to_pylist(), dtype=np.float64).reshape(len(at), size)
            place = F.element_at(F.array(*(F.lit(i) for i in at)), F.col("q") + 1) if at != list(range(len(at))) else F.col("q")
            found = vectors.select(key, vector).mapInArrow(_nearest_in_batches(m, top_k, score == "distance"), kinds).withColumn("q", place)
            named = found.join(F.broadcast(ids), "q").select("qid", F.col("key").alias(key), "score")
            out = named if out is None else out.unionByName(named)
    if out is None or top_k <= 0:
        return vectors.crossJoin(queries.select("qid").limit(0)).select("qid", key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    return top_per_group(out, ["qid"], [F.col("score").desc(), F.col(key)], top_k)

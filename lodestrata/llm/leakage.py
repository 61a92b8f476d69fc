"""Held-out passages inside a corpus (problem 9): a prefix-filtered set join.

A document leaks an item if it has at least ``passage`` (13) consecutive words of it. Both
sides are taken as sets of five-word shingles; a window of 13 words has nine of them, all of
which a leaking document must contain, so it must contain the rarest.

1. One pass over the corpus keeps of each document the positions at which a shingle of any
   item begins (everything else cannot matter), as arrays in one row for each document.
2. Their document frequencies over the whole corpus order the shingles by rarity; the rarest
   of each item window is that window's prefix token. A window with a shingle that occurs
   nowhere is dropped.
3. Documents meet items on prefix tokens only. A meeting fixes the shift between both texts;
   shifts at which no window fits into the document (length and position bounds) are dropped.
4. Each (document, item, shift) is verified exactly over the item-sized window: the longest
   run of consecutive equal shingles must cover the passage.

The shingles of the items go to the tasks as one sorted array only while there are at most
``MAX_SHIPPED``; beyond that corpus shingles meet them in a shuffled join.

Words here are runs of a-z and 0-9 after lower-casing, dropping accents and invisible
characters, and writing ß as ss. Defined cases: null, blank and shorter texts leak nothing;
items shorter than the passage are found nowhere; repeated items are each reported; other
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fits_broadcast, ship, staged
from .shingles import WordHasher, shingle_hashes

_ASCII_WORD = re.compile("[a-z0-9]+")
MAX_SHIPPED = 2_000_000
#: Item windows and items that are sent to all executors at most.
MAX_SENT_WINDOWS, MAX_SENT_ITEMS = 200_000, 20_000
_DROPPED = {"Mn", "Me", "Cf"}


class _Fold(dict):
    """Maps code points for str.translate, remembering each answer."""

    def __missing__(self, c: int) -> str:
        out = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if unicodedata.category(x) not in _DROPPED)
        self[c] = out
        return out


_FOLD = _Fold({ord("ß"): "ss", ord("ẞ"): "ss"})


def folded_words(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    return _ASCII_WORD.findall(text if text.isascii() else text.translate(_FOLD).lower())


def _positions(wanted: np.ndarray | None, size: int):
    """Rows (id, n_words, pos, hash) of the shingles that are wanted (all, if None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        keep = wanted.value if hasattr(wanted, "value") else wanted
        for batch in batches:
            ids, ns, ps, hs = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = folded_words(text)
                if len(words) < size:
                    continue
                h = shingle_hashes(hasher(words), size).view(np.int64)
                if keep is None:
                    at = np.arange(len(h))
                else:
                    slot = np.searchsorted(keep, h)
                    slot[slot == len(keep)] = 0
                    at = np.flatnonzero(keep[slot] == h)
                    if not len(at):
                        continue
                ids.append(i)
                ns.append(len(words))
                ps.append(at.astype(np.int32))
                hs.append(h[at])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(ns, pa.int32()), pa.array(ps, pa.list_(pa.int32())), pa.array(hs, pa.list_(pa.int64()))], names=["id", "n_words", "pos", "hash"])

    return run


def _runs(need: int):
    """Longest run of equal shingles at the row's shift; rows below ``need`` are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, lengths, begins = [], [], []
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("shift", "pos", "hash", "item_hash")]
            for r in range(batch.num_rows):
                shift = cols[0][r].as_py()
                pos, h, item = (c[r].values.to_numpy(zero_copy_only=False) for c in cols[1:])
                at = pos - shift
                ok = (at >= 0) & (at < len(item))
                at, h = at[ok], h[ok]
                at = np.sort(at[item[at] == h])
                if len(at) < need:
                    continue
                breaks = np.flatnonzero(np.diff(at) != 1)
                first = np.concatenate(([0], breaks + 1))
                length = np.diff(np.concatenate((first, [len(at)])))
                k = int(np.argmax(length))
                if length[k] >= need:
                    keep.append(r)
                    lengths.append(int(length[k]))
                    begins.append(int(at[first[k]]))
            rows = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(begins, pa.int32()), pa.array(lengths, pa.int32())], names=["doc_id", "item_id", "item_from", "run"])

    return run


def leaks(docs: DataFrame, items: DataFrame, passage: int = 13, words: int = 5) -> DataFrame:
    """``doc_id, item_id, leaked_words, item_words, item_from_word`` for each leaking pair.

    ``docs`` has ``id bigint, text``; ``items`` has a unique ``id string`` and ``text``.
    ``leaked_words`` is the longest run of consecutive words that both have.
    """
    spark = docs.sparkSession
    ship(spark)
    need = passage - words + 1
    shape = "n_words int, pos array<int>, hash array<bigint>"
    own = staged(items.select(F.col("id").cast("string"), "text").mapInArrow(_positions(None, words), f"id string, {shape}").where(F.col("n_words") >= passage), "item-shingles")
    distinct = own.select(F.explode("hash").alias("h")).distinct()
    few = distinct.limit(MAX_SHIPPED + 1).count()
    texts = docs.select(F.col("id").cast("bigint"), "text")
    if few <= MAX_SHIPPED:
        array = np.sort(np.array(distinct.toArrow().column(0).to_numpy(), dtype=np.int64)) if few else np.empty(0, np.int64)
        if not few:
            return spark.createDataFrame([], "doc_id bigint, item_id string, leaked_words int, item_words int, item_from_word int")
        hits = texts.mapInArrow(_positions(spark.sparkContext.broadcast(array), words), f"id bigint, {shape}")
    else:
        every = texts.mapInArrow(_positions(None, words), f"id bigint, {shape}")
        hits = (
            every.select("id", "n_words", F.explode(F.arrays_zip("pos", "hash")).alias("x")).select("id", "n_words", "x.pos", "x.hash")
            .join(distinct, F.col("hash") == F.col("h"), "left_semi")
            .groupBy("id", "n_words").agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("x")).select("id", "n_words", F.col("x.pos").alias("pos"), F.col("x.hash").alias("hash"))
        )
    hits = staged(hits, "item-shingles-in-corpus")
    frequency = hits.select(F.explode(F.array_distinct("hash")).alias("h")).groupBy("h").count()

    places = own.select("id", "n_words", F.posexplode("hash").alias("at", "h"))
    rated = places.join(frequency, "h", "left").select("id", "n_words", "at", "h", "count")
    # Each shingle lies in the windows that begin at most need - 1 words before it.
    window = rated.select("id", "n_words", "at", "h", "count", F.explode(F.sequence(F.greatest(F.col("at") - (need - 1), F.lit(0)), F.least("at", F.col("n_words") - passage))).alias("begin"))
    prefix = staged(
        window.groupBy("id", "begin", "n_words").agg(F.count("count").alias("there"), F.min(F.struct("count", "h", "at")).alias("m")).where(F.col("there") == need)
        .select(F.col("id").alias("item_id"), "begin", F.col("m.h").alias("h"), F.col("m.at").alias("at")), "prefix-tokens",
    )
    # The prefix tokens of the items go to the documents while they are few, so no document row moves
    # and a token that most documents have is no hot key; beyond that the join is split by AQE.
    met = (
        hits.select("id", "n_words", F.explode(F.arrays_zip("pos", "hash")).alias("x"))
        .join(F.broadcast(prefix) if fits_broadcast(prefix, MAX_SENT_WINDOWS) else prefix, F.col("x.hash") == F.col("h"))
        .select(F.col("id").alias("doc_id"), "item_id", (F.col("x.pos") - F.col("at")).alias("shift"), "n_words", "begin")
        .where((F.col("shift") + F.col("begin") >= 0) & (F.col("shift") + F.col("begin") + passage <= F.col("n_words")))
        .select("doc_id", "item_id", "shift").distinct()
    )
    # Of the document only what lies inside the item-sized window is carried on.
    end = F.col("shift") + F.col("item_words") - (words - 1)
    inside = F.filter(F.arrays_zip("pos", "hash"), lambda x: (x["pos"] >= F.col("shift")) & (x["pos"] < end))
    sizes, item_hashes = own.select(F.col("id").alias("item_id"), F.col("n_words").alias("item_words")), own.select(F.col("id").alias("item_id"), F.col("hash").alias("item_hash"))
    few_items = fits_broadcast(own, MAX_SENT_ITEMS)
    sent = F.broadcast if few_items and few <= MAX_SENT_WINDOWS else (lambda df: df)
    ready = (
        met.join(sent(sizes), "item_id").join(hits.select(F.col("id").alias("doc_id"), "pos", "hash"), "doc_id")
        .select("doc_id", "item_id", "shift", inside.alias("x")).where(F.size("x") >= need)
        .join(sent(item_hashes), "item_id")
        .select("doc_id", "item_id", "shift", F.col("x.pos").alias("pos"), F.col("x.hash").alias("hash"), "item_hash")
    )
    found = ready.mapInArrow(_runs(need), "doc_id bigint, item_id string, item_from int, run int")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("run", "item_from")).alias("b"))
    return best.join(own.select(F.col("id").alias("item_id"), F.col("n_words").alias("item_words")), "item_id").select("doc_id", "item_id", (F.col("b.run") + (words - 1)).alias("leaked_words"), "item_words", F.col("b.item_from").alias("item_from_word"))

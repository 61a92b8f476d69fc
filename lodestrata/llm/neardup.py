"""Near-duplicate grouping with a min-hash LSH forest (problem 7).

Plan
----
1. One pass over the texts (Arrow batches, numpy) gives each row a digest of its word
   sequence, its number of distinct shingles, one label of ``DEPTH`` min-hash bytes for each
   tree of the forest, and a sketch of two bits from each min-hash.
2. Rows of the same word sequence form a class; only one representative of a class goes on,
   so a group of copies of any size costs one row.
3. The forest: every tree is the trie of all labels, met as rows sorted by (tree, prefix). The
   texts that share a prefix of ``begin`` bytes are compared first. Then the matched prefix is
   shortened byte by byte, each time meeting the pairs that share exactly so much, until the
   recall that is measured on the links found reaches the target: a link of similarity s is
   found with probability p(s) = 1 - (1 - s ** depth) ** trees, so the links that exist are
   estimated by the sum of 1 / p(s) over those found.
4. Nodes with one text drop out before anything but keys is shuffled. A node that more than
   ``CROWD`` texts share is cut into blocks of texts, and each pair of blocks is one key, so no
   task holds a crowded node and no pair of it is left out.
5. Neighbours are compared by size and sketch in one equi-join on the node; the few survivors
   are verified exactly on their shingle sets.

Defined cases: null fields are left out of a text; a text without words is in no pair and
forms a class of its own; a text of one or two words counts as one shingle; repeated rows are
members of one class; an empty table gives empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fits_broadcast, ship, staged
from .shingles import WordHasher, minhashes, sequence_digest, shingle_hashes, sketch_words, words_of

SKETCH = 256
#: Min-hash bytes of a label.
DEPTH = 8
#: Texts of a trie node above which it is met block by block.
CROWD = 4096
#: As many ids (8 bytes each) at most are sent to all executors; beyond that ids and texts are shuffled.
MAX_SENT_IDS = 500_000
#: Standard deviations below its mean at which a sketch still passes: one true pair in 300,000 fails.
SIGMAS = 4.5


@dataclass(frozen=True)
class Forest:
    """``trees`` tries of labels of ``DEPTH`` min-hash bytes, first met at ``begin`` bytes.

    The prefix is shortened to ``end`` bytes at most, by which a link of exactly the threshold
    has the target recall too."""

    trees: int
    begin: int
    end: int
    threshold: float
    words: int = 3
    target: float = 0.999

    def recall(self, similarity: float, depth: int) -> float:
        return 1 - (1 - similarity**depth) ** self.trees

    @property
    def functions(self) -> int:
        return max(self.trees * DEPTH, SKETCH // 2)

    @property
    def most_differing_bits(self) -> int:
        """Two bits differ in one place of two on average where min-hashes differ, and never where they agree."""
        q, n = 1 - self.threshold, SKETCH // 2
        return math.ceil(n * q + SIGMAS * math.sqrt(n * (1.5 * q - q * q)))


def plan_forest(threshold: float = 0.5, recall: float = 0.999, words: int = 3, trees: int = 24) -> Forest:
    """The forest for a threshold: ``begin`` is the longest prefix at which a link of the threshold
    is found in three cases of four, ``end`` the longest at which it is found with ``recall``."""
    deep = [d for d in range(1, DEPTH + 1) if 1 - (1 - threshold**d) ** trees >= recall]
    end = max(deep, default=1)
    if not deep:
        trees = math.ceil(math.log(1 - recall) / math.log(1 - threshold))
    begin = max((d for d in range(end, DEPTH + 1) if 1 - (1 - threshold**d) ** trees >= 0.75), default=end)
    return Forest(trees, begin, end, threshold, words, recall)


def record_text(fields: str = "fields") -> Column:
    """Caption, transcript and summary joined by line breaks, nulls left out."""
    return F.concat_ws("\n", *(F.col(f"{fields}.{x}") for x in ("caption", "transcript", "summary")))


def _sign(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        sketches = ("s0", "s1", "s2", "s3")
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                rows: dict[str, list] = {k: [] for k in ("digest", "n", "labels", *sketches)}
                for text in part.column(1).to_pylist():
                    words = words_of(text)
                    distinct = np.unique(shingle_hashes(hasher(words), forest.words))
                    rows["digest"].append(sequence_digest(words) if words else None)
                    rows["n"].append(len(distinct))
                    if not len(distinct):
                        for k in ("labels", *sketches):
                            rows[k].append(None)
                        continue
                    mins = minhashes(distinct, forest.functions)
                    rows["labels"].append(mins[: forest.trees * DEPTH].astype(np.uint8).view(">i8").astype(np.int64))
                    for k, v in zip(sketches, sketch_words(mins, SKETCH)):
                        rows[k].append(v)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(rows["digest"], pa.binary()), pa.array(rows["n"], pa.int32()), pa.array(rows["labels"], pa.list_(pa.int64())), *(pa.array(rows[k], pa.int64()) for k in sketches)],
                    names=["id", *rows],
                )

    return run


SIGNATURE = "id bigint, digest binary, n int, labels array<bigint>, s0 bigint, s1 bigint, s2 bigint, s3 bigint"


def signatures(docs: DataFrame, forest: Forest) -> DataFrame:
    """Signature rows of ``docs`` (columns ``id bigint`` and ``text string``)."""
    ship(docs.sparkSession)
    return docs.select(F.col("id").cast("bigint"), "text").mapInArrow(_sign(forest), SIGNATURE)


def _shingle_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            sets = [np.unique(shingle_hashes(hasher(words_of(t)), words)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return run


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """The distinct 64-bit shingle hashes of each text."""
    ship(docs.sparkSession)
    return docs.select(F.col("id").cast("bigint"), "text").mapInArrow(_shingle_sets(words), "id bigint, shingles array<bigint>")


def _node(depth: int) -> Column:
    """The trie node of a label at a depth: its first bytes and the tree's number, as one number."""
    return F.xxhash64(F.lit(depth), "tree", F.shiftrightunsigned("label", 8 * (DEPTH - depth)))


def in_blocks(df: DataFrame, key: str, crowded: DataFrame, limit: int) -> DataFrame:
    """``df`` once for each pair of blocks of its key that it is in: ``key``, ``lo``, ``hi``, ``blk``.

    ``crowded`` holds ``key`` and ``m``, the rows of each key above ``limit``. A key of m rows has
    ceil(m / limit) blocks; other keys have one. Two rows of a key meet exactly once, under
    (lo, hi) of their blocks (see ``meets_once``)."""
    sized = df.join(F.broadcast(crowded) if fits_broadcast(crowded, 100_000) else crowded, key, "left")
    nb = F.ceil(F.coalesce("m", F.lit(1)) / F.lit(limit)).cast("int")
    placed = sized.withColumn("_nb", nb).withColumn("blk", F.pmod(F.xxhash64("id"), F.col("_nb")).cast("int"))
    each = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return each.withColumn("lo", F.least("blk", "_o")).withColumn("hi", F.greatest("blk", "_o")).drop("_o", "_nb", "m")


def meets_once(p: str, q: str, key: str) -> Column:
    c = lambda x, n: F.col(f"{x}.{n}")
    return (c(p, key) == c(q, key)) & (c(p, "lo") == c(q, "lo")) & (c(p, "hi") == c(q, "hi")) & (c(p, "id") < c(q, "id")) & ((c(p, "blk") != c(q, "blk")) | (c(p, "lo") == c(p, "hi")))


def met_at(heads: DataFrame, forest: Forest, depth: int, new_only: bool, crowd: int = CROWD) -> DataFrame:
    """Pairs ``a, b`` whose labels share ``depth`` bytes in some tree and whose sizes and sketches fit.

    With ``new_only`` those that share more in that tree are left out: they met before."""
    flat = heads.where("n > 0").select("id", F.posexplode("labels").alias("tree", "label")).select("id", "tree", "label", _node(depth).alias("node"))
    nodes = staged(flat.groupBy("node").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "shared-nodes")
    keys = nodes.select("node")
    shared = flat.join(F.broadcast(keys) if fits_broadcast(keys, MAX_SENT_IDS) else keys, "node", "left_semi")
    # What a text carries is added only for the entries that meet another.
    carried = shared.join(heads.select("id", "n", "s0", "s1", "s2", "s3"), "id")
    cut = in_blocks(carried, "node", nodes.where(F.col("m") > crowd), crowd)
    condition = meets_once("p", "q", "node") & sketch_condition("p", "q", forest)
    if new_only:
        condition &= F.shiftrightunsigned("p.label", 8 * (DEPTH - depth - 1)) != F.shiftrightunsigned("q.label", 8 * (DEPTH - depth - 1))
    return cut.alias("p").join(cut.alias("q"), condition).select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()


def sketch_condition(a: str, b: str, forest: Forest) -> Column:
    """Whether sizes and sketches leave the threshold possible."""
    differ = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(1, 4)), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (na >= forest.threshold * nb) & (nb >= forest.threshold * na) & (differ <= forest.most_differing_bits)


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids``; texts are not shuffled while the ids are few."""
    return docs.join(F.broadcast(ids) if fits_broadcast(ids, MAX_SENT_IDS) else ids, "id", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, forest: Forest) -> DataFrame:
    """``a, b, similarity`` of the candidate pairs that reach the threshold exactly.

    Only texts that are in a candidate pair are read into shingle sets and shuffled.
    """
    ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidate-ids")
    sets = staged(shingle_sets(only(docs, ids), forest.words), "shingle-sets")
    both = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        .withColumn("common", F.size(F.array_intersect("x", "y")))
    )
    return both.select("a", "b", (F.col("common") / (F.size("x") + F.size("y") - F.col("common"))).alias("similarity")).where(F.col("similarity") >= forest.threshold)


@dataclass(frozen=True)
class NearDuplicates:
    """``members``: id, class_id (smallest id of the same words; null without words).
    ``pairs``: a, b, similarity between class representatives, a < b.
    ``depth`` and ``recall``: the prefix at which the search ended, and the recall measured there."""

    members: DataFrame
    pairs: DataFrame
    depth: int
    recall: float


def near_duplicates(docs: DataFrame, threshold: float = 0.5, words: int = 3, recall: float = 0.999, forest: Forest | None = None) -> NearDuplicates:
    """Classes of equal texts and the links of at least ``threshold`` between different texts.

    ``docs`` has a unique ``id bigint`` and ``text string``. Prefixes are shortened until the
    measured recall of all links is at least ``recall``; none is reported below the threshold.
    """
    forest = forest or plan_forest(threshold, recall, words)
    signed = staged(signatures(docs, forest), "signatures")
    first = signed.where("n > 0").groupBy("digest").agg(F.min("id").alias("class_id"))
    members = signed.select("id", "digest").join(first, "digest", "left").select("id", "class_id")
    heads = only(signed, staged(first.select(F.col("class_id").alias("id")), "heads"))
    links, seen, depth = None, None, forest.begin
    while True:
        pairs = met_at(heads, forest, depth, new_only=links is not None)
        pairs = staged(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "candidates")
        more = verified(pairs, docs, forest)
        links = staged(more if links is None else links.unionByName(more), "links")
        miss = F.pow(1 - F.pow("similarity", F.lit(depth)), F.lit(forest.trees))
        found, there = links.agg(F.count(F.lit(1)), F.sum(1 / (1 - miss))).first()
        measured = found / there if found else 0.0
        if depth <= forest.end or measured >= forest.target:
            return NearDuplicates(members, links, depth, measured)
        seen = pairs if seen is None else staged(seen.unionByName(pairs), "met")
        depth -= 1


def expanded(found: NearDuplicates, limit: int = CROWD) -> DataFrame:
    """All pairs of ids (a < b) that the classes and links stand for. Only where all are asked for.

    Pairs inside a class are made block by block, so no task holds a large class."""
    m = found.members.where("class_id is not null")
    sizes = m.groupBy("class_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    cut = in_blocks(m.join(sizes.select("class_id"), "class_id", "left_semi"), "class_id", sizes.where(F.col("m") > limit), limit)
    same = cut.alias("p").join(cut.alias("q"), meets_once("p", "q", "class_id")).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))
    linked = (
        found.pairs.select(F.col("a").alias("ca"), F.col("b").alias("cb"))
        .join(m.select(F.col("class_id").alias("ca"), F.col("id").alias("i")), "ca")
        .join(m.select(F.col("class_id").alias("cb"), F.col("id").alias("j")), "cb")
        .select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    )
    return same.unionByName(linked)


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, group_id`` (smallest id) of each id in a link, by alternating large and small stars.

    Runs on tables in the shared folder; the number of rounds grows with the logarithm of the
    longest chain. Ends when a round changes nothing.
    """
    edges = staged(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        m = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(m, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = staged(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(tops.select("id", F.col("id").alias("group_id")))


def grouped(found: NearDuplicates) -> DataFrame:
    """One row per id: ``id, class_id, group_id, n_links``.

    ``n_links`` counts the other texts (classes) that the row's text is linked with; copies of
    the same text are the rows of the same class_id.
    """
    ends = found.pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    parts = components(found.pairs).withColumnRenamed("id", "class_id")
    return (
        found.members.join(ends, "class_id", "left").join(parts, "class_id", "left")
        .select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("group_id", "class_id", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    )

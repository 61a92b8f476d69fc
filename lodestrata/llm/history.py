"""Checking new batches for duplicates against everything accepted so far (problem 2).

A ``History`` holds three tables in the shared folder, each bucketed on its key:

``known``       the exact keys (normalised content hash, digest of the word sequence, record id)
                of accepted rows, with the smallest accepted row id;
``paragraphs``  a 64-bit hash of each normalised paragraph of each accepted text;
``texts``       the accepted texts by row id, read to verify candidates.

A paragraph is the word sequence between two line breaks or sentence ends; one of more than
12 words is cut again after words whose own hash says so (finer above 24 words), so that an edit
in a transcript of one paragraph leaves the pieces around it as they were.

``admit`` decides on one arrival and appends the keys of the rows it accepts:

1. One pass over the arrival's texts gives digests and paragraph hashes.
2. Semi-joins, bucket by bucket, find full copies (``known``) and shared paragraphs
   (``paragraphs``). Only the arrival is shuffled; the history is never hashed, tokenised or
   shuffled again.
3. Shared-paragraph coverage: a candidate must share paragraphs of at least ``coverage`` of the
   arriving text's words. So a row may leave out its most frequent paragraphs, as long as they
   hold at most ``spare`` of its words (a prefix filter over document frequencies); a paragraph
   that a third of all rows have then pairs nobody, and what a pair shares besides must make up
   the rest. A paragraph that still has more than
   ``block`` accepted rows meets them in blocks of growing ids, and a row goes on to the next
   block only while no smaller accepted row has been found for it.
4. Candidates are verified exactly by the similarity of their word shingles.
5. Within the arrival, rows that nothing in the history refuses are met in the same way. If
   their candidate pairs were too many (a family of edited copies that arrives at once), the
   arrival is cut in two by id: the first part is settled and appended, then refuses the rest.

Order: arrivals are taken as they come, the rows of one by ``id``, which must grow from arrival to
arrival unless the history is told that ids are only unique (``growing``). A row is refused if an
accepted earlier row has the same content hash, the same words, or three-word similarity of at
least the threshold; the smallest id of such rows is reported.

Defined cases: a null or malformed content hash is no key; a row without words and without
hash is always accepted; repeated rows of one arrival refuse each other in order; an empty
arrival or history gives empty tables; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, fits_broadcast, new_path, ship, staged
from .neardup import MAX_SENT_IDS
from .shingles import WORD, WordHasher, _mix, sequence_digest, shingle_hashes

_BREAKS = "\r.!?…。！？;؟।"
#: Words above which a paragraph is cut, one word in how many ends a piece, the least words of a piece.
CUTS = ((24, 3, 3), (12, 6, 4))
#: Threads that submit independent jobs side by side.
_SIDE = ThreadPoolExecutor(3, "history")
#: Open rows with relations that one task may settle in order; beyond that rounds run as joins until fewer are open.
MAX_IN_ONE_TASK = 200_000
#: Meetings of an arrival's rows up to which one task decides on all of it.
MAX_PAIRS_IN_ONE_TASK = 4_000_000
SIGNED = "id bigint, chash binary, rid string, text string, digest binary, w int, keys array<bigint>, lens array<int>"


def normal_hash(value: Column) -> Column:
    """The 32 bytes of a SHA-256 in any notation (case, ``sha256:`` prefix, blanks); else null."""
    h = F.regexp_extract(F.lower(value), r"^\s*(?:sha-?256\s*[:=]\s*)?(?:0x)?([0-9a-f]{64})\s*$", 1)
    return F.when(h != "", F.unhex(h))


def normal_id(value: Column) -> Column:
    """A record id without namespace prefix and version suffix."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), r"^[A-Za-z_]+:", ""), r"#v\d+$", "")


def _id_key(rid: Column) -> Column:
    return F.when(rid.isNotNull(), F.unhex(F.md5(F.concat(F.lit("id:"), rid))))


def paragraphs(text: str, hasher: WordHasher) -> tuple[list[str], dict[int, int]]:
    """The words of a text, and the hashes of its distinct paragraphs with their words."""
    words, parts = [], []
    text = text.lower()
    for c in _BREAKS:
        text = text.replace(c, "\n")
    for part in text.split("\n"):
        w = WORD.findall(part)
        if not w:
            continue
        words += w
        every, least = next(((e, m) for long, e, m in CUTS if len(w) > long), (0, 0))
        if not every:
            parts.append(w)
            continue
        last = 0
        for cut in [*(np.flatnonzero(_mix(hasher(w)) % np.uint64(every) == 0) + 1).tolist(), len(w)]:
            if cut - last >= least or cut == len(w) > last:
                parts.append(w[last:cut])
                last = cut
    long = [p for p in parts if len(p) >= 3] or ([words] if words else [])
    return words, {xxhash.xxh3_64_intdigest(" ".join(p).encode("utf-8", "surrogatepass")): len(p) for p in long}


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
            digests, ws, keys, lens, ends = [], [], [], [], [0]
            for text in part.column(3).to_pylist():
                words, of = paragraphs(text or "", hasher)
                digests.append(sequence_digest(words) if words else None)
                ws.append(sum(of.values()))
                keys.extend(of)
                lens.extend(of.values())
                ends.append(len(keys))
            ends = pa.array(ends, pa.int32())
            flat = pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(lens, pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digests, pa.binary()), pa.array(ws, pa.int32()), *(pa.ListArray.from_arrays(ends, x) for x in flat)], names=[c.split()[0] for c in SIGNED.split(", ")])


def _similar(shingle: int, threshold: float):
    """The pairs (a, b, x, y, old) of texts whose shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known, held = WordHasher(), {}, 0
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                keep = []
                for r, (a, b, x, y) in enumerate(zip(*(c.to_pylist() for c in part.columns[:4]))):
                    if held > 8_000_000:
                        known, held = {}, 0
                    for i, text in ((a, x), (b, y)):
                        if i not in known:
                            known[i] = np.unique(shingle_hashes(hasher(WORD.findall(text.lower())), shingle))
                            held += len(known[i])
                    common = len(np.intersect1d(known[a], known[b], assume_unique=True))
                    if common >= threshold * (len(known[a]) + len(known[b]) - common):
                        keep.append(r)
                rows = pa.array(keep, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(c).take(rows) for c in (0, 1, 4)], names=["a", "b", "old"])

    return run


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settles nodes in order: taken unless a group it looks at has a taken member (the least is reported)."""
    taken: dict[str, int] = {}
    for batch in batches:
        nodes, kept = batch.column(0).to_pylist(), []
        for node, groups, looks in zip(nodes, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            by = [taken[g] for g in (*groups, *(looks or ())) if g in taken]
            kept.append(min(by) if by else None)
            if not by:
                taken.update(dict.fromkeys(groups, node))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(kept, pa.int64())], names=["node", "kept"])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decisions on one arrival: rows (0), exact keys (1), nearest accepted (2) and links (3) of its classes."""
    rows, old, near, links = [], {}, {}, {}
    for batch in batches:
        for kind, i, k1, k2, k3, other in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                rows.append((i, k1, k2, k3))
            elif kind == 1:
                old[k1] = i
            elif kind == 2:
                near[i] = other
            else:
                links.setdefault(i, []).append(other)
                links.setdefault(other, []).append(i)
    rows.sort(key=lambda r: r[0])
    classes: dict[bytes, int] = {}
    for i, words, _, _ in rows:
        if words is not None:
            classes.setdefault(words, i)
    by_class, by_hash, names, kept_ids, known = {}, {}, set(), [], []
    for i, words, digest, name in rows:
        c = classes.get(words)
        by = [old.get(words), old.get(digest), near.get(c), by_class.get(c), by_hash.get(digest), *(by_class.get(x) for x in links.get(c, ()))]
        kept = min((x for x in by if x is not None), default=None)
        kept_ids.append(kept)
        known.append(name is not None and (name in old or name in names))
        if kept is None:
            if c is not None:
                by_class[c] = i
            if digest is not None:
                by_hash[digest] = i
            if name is not None:
                names.add(name)
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([k is None for k in kept_ids], pa.bool_()), pa.array(kept_ids, pa.int64()), pa.array(known, pa.bool_())], names=["id", "accepted", "kept_id", "known_id"])


def _decided_at_once(signed: DataFrame, exact: DataFrame, near: DataFrame, links: DataFrame) -> DataFrame:
    """All decisions on an arrival of bounded size by one task, from narrow tables without any join."""
    none = F.lit(None).cast("binary")
    nobody = F.lit(None).cast("bigint").alias("other")
    rows = signed.select(F.lit(0).alias("kind"), "id", F.col("digest").alias("k1"), F.col("chash").alias("k2"), _id_key(F.col("rid")).alias("k3"), nobody)
    keys = exact.select(F.lit(1), F.col("old"), F.col("key"), none, none, nobody)
    olds = near.select(F.lit(2), "id", none, none, none, "old")
    pairs = links.select(F.lit(3), "a", none, none, none, "b")
    return rows.union(keys).union(olds).union(pairs).repartition(1).mapInArrow(_decide, "id bigint, accepted boolean, kept_id bigint, known_id boolean")


@dataclass
class History:
    """The accepted rows' tables and the parameters of every later decision."""

    spark: SparkSession
    threshold: float = 0.5
    words: int = 3
    coverage: float = 0.15
    spare: float = 0.08
    block: int = 4096
    pairs_per_row: int = 200
    pairs_floor: int = 1_000_000
    buckets: int = 0
    growing: bool = True
    path: str = ""
    name: str = field(default_factory=lambda: f"history_{uuid.uuid4().hex[:12]}")

    def __post_init__(self):
        self.path = self.path or new_path(self.spark, "history")
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.spare = min(self.spare, self.coverage)
        self.last_id: int | None = None
        self.admitted_pairs: list[int] = []
        self._scratch: list[str] = []

    def _append(self, table: str, key: str, df: DataFrame) -> None:
        (
            df.repartition(self.buckets, key)
            .write.bucketBy(self.buckets, key)
            .mode("append").option("path", f"{self.path}/{table}").saveAsTable(f"{self.name}_{table}")
        )

    def table(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}")

    def hold(self, df: DataFrame, name: str) -> DataFrame:
        """A staged table that lives as long as the arrival that needs it."""
        self._scratch.append(path := f"{self.path}/scratch/{name}-{len(self._scratch)}-{uuid.uuid4().hex[:6]}")
        return staged(df, name, path)

    def release(self) -> None:
        """Delete what the arrival needed. Its shuffle files and broadcasts are removed by Spark when the
        driver collects its garbage, which many small plans would not make it do for long."""
        while self._scratch:
            discard(self.spark, self._scratch.pop())
        self.spark.sparkContext._jvm.System.gc()

    def append(self, signed: DataFrame, firsts: DataFrame, last_id: int) -> None:
        """Take accepted rows in; of rows of the same words the paragraphs and text of the first (``firsts``)."""
        keys = signed.select("id", F.explode(F.array("digest", "chash", _id_key(F.col("rid")))).alias("key")).where("key is not null")
        parts = (
            ("known", "key", keys.groupBy("key").agg(F.min("id").alias("id"))),
            ("paragraphs", "key", firsts.select("id", F.explode("keys").alias("key"))),
            ("texts", "id", firsts.select("id", "w", "keys", "text")),
        )
        list(_SIDE.map(lambda part: self._append(*part), parts))  # three independent jobs
        self.last_id = last_id if self.last_id is None else max(self.last_id, last_id)

    def close(self) -> None:
        """Drop the tables and their files. Decisions that were returned stay readable."""
        self.release()
        for t in ("known", "paragraphs", "texts"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{t}")
        discard(self.spark, self.path)


def _heads(signed: DataFrame) -> DataFrame:
    """Of rows of the same words the first; rows without words are left out. Only ids and digests are shuffled."""
    told = signed.where("digest is not null").select("id", "digest")
    groups = told.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    later = told.join(groups, "digest").where("id > first").select("id")
    return signed.where("digest is not null").join(F.broadcast(later) if fits_broadcast(later, MAX_SENT_IDS) else later, "id", "left_anti")


def _first_of_words(narrow: DataFrame) -> DataFrame:
    """Like ``_heads``, for rows without their texts: one shuffle, of which each task sends one row of the same words."""
    w = Window.partitionBy("digest").orderBy("id")
    return narrow.where("digest is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _signed(h: History, accepted: DataFrame) -> DataFrame:
    ship(h.spark)
    full = accepted.select(F.col("id").cast("bigint"), normal_hash(F.col("content_hash")).alias("chash"), normal_id(F.col("record_id")).alias("rid"), "text")
    return h.hold(full.mapInArrow(_sign, SIGNED), "signed")


def start(spark: SparkSession, accepted: DataFrame, threshold: float = 0.5, words: int = 3, **kw) -> History:
    """A history of rows that are accepted whole.

    Columns: ``id``, ``record_id``, ``content_hash``, ``text``. Further parameters are those of
    ``History``: ``coverage`` (the share of a text's words in paragraphs that a near-duplicate
    shares at least), ``spare`` (the share that a row leaves out in its most frequent ones),
    ``block`` (accepted rows of one paragraph that are met at once),
    ``pairs_per_row`` and ``pairs_floor`` (meetings within an arrival, for each paragraph of
    its open rows and at least, above which it is cut), ``growing`` (whether ids must grow from
    arrival to arrival; else they must be unique).
    """
    h = History(spark, threshold, words, **kw)
    signed = _signed(h, accepted)
    last = signed.agg(F.max("id")).first()[0]
    h.append(signed, _heads(signed), -(1 << 63) if last is None else last)
    h.release()
    return h


def _covered(h: History, pairs: DataFrame, signed: DataFrame, others: DataFrame, old: bool) -> DataFrame:
    """Pairs ``a, b`` with their texts ``x, y`` that share enough paragraphs; ``others`` holds the b and stays where it lies.
    ``old`` says whether the b are the history's."""
    carry = signed.select(F.col("id").alias("a"), "w", "keys", "lens").join(pairs.hint("shuffle_hash"), "a")
    met = others.select(F.col("id").alias("_b"), F.col("w").alias("_w"), F.col("keys").alias("_keys")).join(carry.hint("shuffle_hash"), F.col("_b") == F.col("b"))
    shared = F.aggregate(F.arrays_zip("keys", "lens"), F.lit(0), lambda s, p: s + F.when(F.array_contains("_keys", p["keys"]), p["lens"]).otherwise(0))
    left = met.where(shared >= h.coverage * F.greatest("w", "_w")).select("a", "b")
    full = signed.select(F.col("id").alias("_a"), F.col("text").alias("x")).join(left.hint("shuffle_hash"), F.col("_a") == F.col("a")).select("a", "b", "x")
    return others.select(F.col("id").alias("_b"), F.col("text").alias("y")).join(full.hint("shuffle_hash"), F.col("_b") == F.col("b")).select("a", "b", "x", "y", F.lit(old).alias("old"))


def _verified(h: History, texts: DataFrame) -> DataFrame:
    return texts.mapInArrow(_similar(h.words, h.threshold), "a bigint, b bigint, old boolean")


def _wanted(h: History, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The paragraphs by which each head must be looked for, and the history's rows that have them.

    ``wanted``: id, key, len, before (accepted rows with it), beside (heads with it), need (words to be
    shared in wanted paragraphs that are not crowded, if all others were shared)."""
    flat = heads.select("id", "w", F.explode(F.arrays_zip("keys", "lens")).alias("p")).select("id", "w", F.col("p.keys").alias("key"), F.col("p.lens").alias("len"))
    asked = flat.select("key").distinct().hint("shuffle_hash")
    met = h.hold(h.table("paragraphs").join(asked, "key").select("key", "id"), "met-paragraphs")
    before = met.groupBy("key").agg(F.count(F.lit(1)).alias("before"))
    beside = flat.groupBy("key").agg(F.count(F.lit(1)).alias("beside"))
    rated = flat.join(beside.join(before, "key", "left"), "key").select("*", (F.col("beside") + F.coalesce("before", F.lit(0))).alias("df"))
    order = Window.partitionBy("id").orderBy(F.col("df").desc(), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_id = Window.partitionBy("id")
    left_out, crowded = F.col("run") <= h.spare * F.col("w"), F.coalesce("before", F.lit(0)) > h.block
    told = rated.withColumn("run", F.sum("len").over(order)).select("*", F.sum(F.when(left_out | crowded, F.col("len")).otherwise(0)).over(by_id).alias("apart"))
    kept = told.where(~left_out & (F.col("df") > 1))
    return h.hold(kept.select("id", "key", "len", F.coalesce("before", F.lit(0)).alias("before"), "beside", (h.coverage * F.col("w") - F.col("apart")).alias("need")), "wanted"), met


def _shared(rows: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of rows (a, b, len, need) whose shared words do not fall short already: what ``a``
    leaves out, and its crowded paragraphs, may be shared too."""
    return rows.groupBy("a", "b").agg(F.sum("len").alias("shared"), F.max("need").alias("need")).where("shared >= need").select("a", "b")


def _beside(wanted: DataFrame) -> DataFrame:
    """Pairs ``a, b`` (b first) of heads, one of them open, that share a wanted paragraph."""
    p = wanted.where("beside > 1").select("key", F.col("id").alias("b"), F.col("open").alias("_b"))
    return p.join(p.select("key", F.col("b").alias("a"), F.col("_b").alias("_a")), "key").where("b < a and (_a or _b)").select("a", "b").distinct()


def _blocks_of_ids(h: History, wanted: DataFrame, met: DataFrame, signed: DataFrame, most: int, old: DataFrame) -> DataFrame:
    """``id, old`` after crowded paragraphs were met beyond their first block of ids."""
    crowd = wanted.where(F.col("before") > h.block)
    keys = crowd.select("key").distinct()
    ranked = met.join(keys, "key", "left_semi").withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("id")))
    low = h.block
    while low < most:
        block = h.hold(ranked.where(F.col("at") <= low * 8).where(F.col("at") > low), "crowded-block")
        begins = block.groupBy("key").agg(F.min("id").alias("begins"))
        open_ = h.hold(crowd.where(F.col("before") > low).join(begins, "key").join(old, "id", "left").where("old is null or begins < old").select("id", "key", "old"), "open-crowded")
        if open_.isEmpty():
            break
        more = open_.join(block.select("key", F.col("id").alias("b")), "key").where(F.expr("old is null or b < old")).select(F.col("id").alias("a"), "b").distinct()
        found = _verified(h, _covered(h, h.hold(more, "candidates"), signed, h.table("texts"), True)).select(F.col("a").alias("id"), F.col("b").alias("old"))
        old = h.hold(old.unionByName(found).groupBy("id").agg(F.min("old").alias("old")), "older")
        low *= 8
    return old


def _groups() -> Column:
    """The groups of a node (class, chash): its class, and its content hash."""
    group_c, group_h = F.concat(F.lit("c"), F.col("class").cast("string")), F.concat(F.lit("h"), F.hex("chash"))
    return F.filter(F.array(group_c, group_h), lambda g: g.isNotNull())


def _around(links: DataFrame) -> DataFrame:
    """Of each class the groups of the classes that are similar to it: ``class, g``."""
    either = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    return links.select(either.alias("e")).select(F.col("e.x").alias("class"), F.concat(F.lit("c"), F.col("e.y").cast("string")).alias("g"))


def _mates(rivals: DataFrame, taken: DataFrame, links: DataFrame) -> DataFrame:
    """``node, mate``: of nodes that the history refuses the least taken node that they duplicate too."""
    least = taken.select("node", F.explode(_groups()).alias("g")).groupBy("g").agg(F.min("node").alias("mate"))
    looks = rivals.select("node", F.explode(_groups()).alias("g")).unionByName(rivals.join(_around(links), "class").select("node", "g"))
    return looks.join(least, "g").groupBy("node").agg(F.min("mate").alias("mate"))


def _in_order(h: History, nodes: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """``node, kept`` of open nodes (node, class, chash): the least taken node that refuses it, or null.

    ``links`` has the pairs of similar classes, ``rows`` is a bound of the nodes' number. As many as
    ``MAX_IN_ONE_TASK`` nodes are settled in order by one task. Of more, those without any
    relation are taken at once, and rounds of joins settle the others (a node waits while an
    earlier relative is open) until so few are left.
    """
    groups, around = _groups(), _around(links)
    if rows <= MAX_IN_ONE_TASK:
        lists = nodes.join(around.groupBy("class").agg(F.collect_set("g").alias("looks")), "class", "left")
        return lists.select("node", groups.alias("groups"), "looks").repartition(1).sortWithinPartitions("node").mapInArrow(_greedy, "node bigint, kept bigint")
    member = nodes.select("node", F.explode(groups).alias("g"))
    looks = h.hold(member.unionByName(nodes.join(around, "class").select("node", "g")), "looks")
    tied = h.hold(looks.join(looks.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("g"), "g", "left_semi").select("node").distinct(), "tied")
    looks, member = looks.join(tied, "node", "left_semi"), h.hold(member.join(tied, "node", "left_semi"), "member")
    state = tied.select("node", F.lit(0).alias("state"))
    while True:
        waiting = state.where("state = 0")
        n = waiting.limit(MAX_IN_ONE_TASK + 1).count()
        settled = state.where("state = 1").join(member, "node").select("g").distinct()
        if n <= MAX_IN_ONE_TASK:
            shut = looks.join(waiting, "node").join(settled, "g", "left_semi").select("node").distinct()
            rest = waiting.join(shut, "node", "left_anti")
            lists = member.join(rest, "node").groupBy("node").agg(F.collect_set("g").alias("groups")).join(looks.join(rest, "node").groupBy("node").agg(F.collect_set("g").alias("looks")), "node")
            solved = lists.repartition(1).sortWithinPartitions("node").mapInArrow(_greedy, "node bigint, kept bigint").select("node", F.when(F.col("kept").isNull(), 1).otherwise(2).alias("state"))
            state = h.hold(state.where("state <> 0").unionByName(shut.select("node", F.lit(2).alias("state"))).unionByName(solved), "state")
            break
        of_group = member.join(state, "node").groupBy("g").agg(F.min(F.when(F.col("state") == 1, F.col("node"))).alias("taken"), F.min(F.when(F.col("state") == 0, F.col("node"))).alias("open"))
        verdict = (
            looks.join(waiting, "node").join(of_group, "g")
            .groupBy("node").agg(F.max(F.coalesce(F.col("taken") < F.col("node"), F.lit(False))).alias("refused"), F.max(F.coalesce(F.col("open") < F.col("node"), F.lit(False))).alias("waits"))
            .select("node", F.when(F.col("refused"), 2).when(F.col("waits"), 0).otherwise(1).alias("next"))
        )
        state = h.hold(state.join(verdict, "node", "left").select("node", F.coalesce("next", "state").alias("state")), "state")
    taken = member.join(state.where("state = 1"), "node").groupBy("g").agg(F.min("node").alias("taken"))
    kept = looks.join(state.where("state = 2").select("node"), "node", "left_semi").join(taken, "g").groupBy("node").agg(F.min("taken").alias("kept"))
    return nodes.select("node").join(kept, "node", "left")


def _settle(h: History, signed: DataFrame, rows: int, last_id: int) -> DataFrame:
    """Decisions on ``rows`` signed rows, ``id, accepted, kept_id, known_id``; accepted rows are appended."""
    asked = signed.select(F.explode(F.array("digest", "chash", _id_key(F.col("rid")))).alias("key")).where("key is not null").distinct().hint("shuffle_hash")
    known = h.table("known").join(asked, "key").groupBy("key").agg(F.min("id").alias("old"))
    copies = _SIDE.submit(h.hold, known, "exact")
    wanted, met = _wanted(h, _first_of_words(signed.select("id", "digest", "w", "keys", "lens")))
    exact = copies.result()
    most, meetings, entries = wanted.agg(F.max("before"), F.sum(F.col("beside") - 1), F.count(F.lit(1))).first()
    most, meetings, limit = most or 0, meetings or 0, max(h.pairs_floor, h.pairs_per_row * entries)
    few = meetings // 2 <= limit  # then all pairs of the arrival are met at once

    texts = h.table("texts")
    usual = wanted.where((F.col("before") > 0) & (F.col("before") <= h.block)).join(met.withColumnRenamed("id", "b"), "key")
    usual = _shared(usual.select(F.col("id").alias("a"), "b", "len", "need"))
    if most > h.block:
        crowd = wanted.where(F.col("before") > h.block)
        first = met.join(crowd.select("key").distinct(), "key", "left_semi").withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("at") <= h.block)
        usual = usual.unionByName(crowd.join(first.select("key", F.col("id").alias("b")), "key").select(F.col("id").alias("a"), "b")).distinct()
    pairs = _covered(h, usual, signed, texts, True)
    if few:
        pairs = pairs.unionByName(_covered(h, _beside(wanted.withColumn("open", F.lit(True))), signed, signed, False))
        h.admitted_pairs.append(meetings // 2)
    linked = h.hold(_verified(h, pairs), "linked")
    near = linked.where("old").groupBy(F.col("a").alias("id")).agg(F.min("b").alias("old"))
    if most > h.block:
        near = _blocks_of_ids(h, wanted, met, signed, most, near)

    links = linked.where("not old")
    if few and rows <= MAX_IN_ONE_TASK and meetings <= MAX_PAIRS_IN_ONE_TASK:
        return _taken_in(h, signed, staged(_decided_at_once(signed, exact, near, links), "decided"), last_id)
    firsts = signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("class"))
    nodes = signed.where("digest is not null or chash is not null").groupBy("digest", "chash").agg(F.min("id").alias("node")).join(firsts, "digest", "left")
    nodes = (
        nodes.join(exact.select(F.col("key").alias("digest"), F.col("old").alias("old_t")), "digest", "left")
        .join(exact.select(F.col("key").alias("chash"), F.col("old").alias("old_h")), "chash", "left")
        .join(near.select(F.col("id").alias("class"), F.col("old").alias("old_n")), "class", "left")
        .select("node", "class", "digest", "chash", F.least("old_t", "old_h", "old_n").alias("old"))
    )
    nodes = h.hold(nodes, "nodes")
    open_ = nodes.where("old is null")
    rivals = None if h.growing else nodes.where(F.col("old") > F.lit(open_.agg(F.min("node")).first()[0]).cast("bigint"))  # a mate may have a smaller id than the history's row
    if not few:
        heads = open_.select(F.col("class").alias("id"), F.lit(True).alias("open"))
        if rivals is not None:
            heads = heads.unionByName(rivals.select(F.col("class").alias("id"), F.lit(False).alias("open")))
        inner = wanted.where("beside > 1").join(heads.groupBy("id").agg(F.max("open").alias("open")), "id")
        ahead = int(inner.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("o")).agg(F.sum(F.expr("o * (o - 1) div 2 + o * (n - o)"))).first()[0] or 0)
        if ahead > limit:
            cut = open_.approxQuantile("node", [0.125], 0.01)[0]
            if open_.where(F.col("node") > cut).limit(1).count():
                head, tail = (h.hold(signed.where(side), "signed") for side in (F.col("id") <= cut, F.col("id") > cut))
                n = head.count()
                return _settle(h, head, n, int(cut)).unionByName(_settle(h, tail, rows - n, last_id))
        h.admitted_pairs.append(ahead)
        links = h.hold(_verified(h, _covered(h, _beside(inner), signed, signed, False)), "links")
    kept = _in_order(h, open_.select("node", "class", "chash"), links, rows)
    mate = F.lit(None).cast("bigint").alias("mate")
    verdicts = nodes.join(kept, "node", "left")
    if rivals is not None:
        kept = h.hold(kept, "kept")
        taken = open_.join(kept.where("kept is null").select("node"), "node", "left_semi")
        verdicts, mate = nodes.join(kept, "node", "left").join(_mates(rivals, taken, links), "node", "left"), "mate"
    verdicts = verdicts.select(F.col("digest").alias("d"), F.col("chash").alias("c"), "node", F.coalesce("old", "kept").alias("kept"), mate)
    told = signed.select("id", "digest", "chash", "rid").join(verdicts, F.col("digest").eqNullSafe(F.col("d")) & F.col("chash").eqNullSafe(F.col("c")), "left")
    by = F.least("kept", F.when(F.col("mate") < F.col("id"), F.col("mate")))
    decided = told.select("id", "rid", F.coalesce(by, F.when(F.col("node") < F.col("id"), F.col("node"))).alias("kept_id")).withColumn("accepted", F.col("kept_id").isNull())
    # A record id is known if it was accepted before, in the history or earlier in this arrival.
    decided = decided.withColumn("key", _id_key(F.col("rid"))).join(exact.select("key", F.lit(True).alias("old_rid")), "key", "left")
    earlier = F.min(F.when(F.col("accepted") & F.col("rid").isNotNull(), F.col("id"))).over(Window.partitionBy(F.coalesce("rid", F.col("id").cast("string"))))
    known_id = F.coalesce("old_rid", F.lit(False)) | F.coalesce(earlier < F.col("id"), F.lit(False))
    return _taken_in(h, signed, staged(decided.select("id", "accepted", "kept_id", known_id.alias("known_id")), "decided"), last_id)


def _taken_in(h: History, signed: DataFrame, decided: DataFrame, last_id: int) -> DataFrame:
    """Appends the rows that ``decided`` accepts; gives the decisions."""
    good = signed.join(decided.where("accepted").select("id"), "id", "left_semi")
    h.append(good, good.where("digest is not null"), last_id)  # accepted rows have different words
    return decided


def admit(h: History, arrival: DataFrame) -> DataFrame:
    """Decide on an arrival and append what is accepted: ``id, accepted, kept_id, known_id``.

    ``kept_id`` is the smallest id among the accepted rows that a refused row duplicates;
    ``known_id`` tells whether its record id was accepted before (which refuses nothing).
    Rows are taken by id; every id must be larger than those already accepted, unless ``growing``
    is off.
    """
    signed = _signed(h, arrival)
    least, last, rows = signed.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    if not rows:
        return h.spark.createDataFrame([], "id bigint, accepted boolean, kept_id bigint, known_id boolean")
    if h.growing and h.last_id is not None and least <= h.last_id:
        raise ValueError(f"id {least} is not larger than the accepted id {h.last_id}")
    decisions = _settle(h, signed, rows, last)
    h.release()
    return decisions

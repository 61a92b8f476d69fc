"""Most similar vectors for every vector: a forest of random-projection trees (problem 5).

1. Vectors are put to unit length; equal vectors (keys stored twice, copies under other keys)
   become one class before anything is shuffled by leaf, so a group of copies costs one row.
2. On the driver a forest is fitted to a bounded sample of at most ``sample`` classes of each
   space (model and dimensions): a node's direction joins two random points, its threshold is
   the median, and nodes are split until a leaf would hold about ``leaf`` of all vectors.
   Where the sample is too small for leaves of that size, a crowded leaf grows trees of its own
   where it is searched.
3. Every vector of the table is indexed in its leaf of each tree. Searching goes down all
   trees at once with one priority queue for the whole forest, ordered by how far the vector
   lies on the wrong side of the planes passed; the ``probes`` best leaves are searched.
4. In each leaf queries meet members in blocks of matrix products, and candidates are reranked
   exactly; all pairs above the threshold remain.

The k nearest of every key are searched in cells instead: centres fitted to the sample, every
vector a member of the cell of its nearest centre. The numbers of cells and of cells searched
are planned for each space: the true neighbours of held-out vectors are found by one exact pass
over the table, and the cheapest plan that keeps ``target`` of them is taken, at any size. In
the limit that plan is one cell, which is brute force.

Recall is measured against brute force in the tests and in the README.

Defined cases: null embeddings, embeddings of another length than the key says, NaN and
all-zero vectors are in no result; a key stored twice counts once; equal vectors are
neighbours at similarity 1; a space with one vector has no neighbours; ties are ordered by key;
other columns are ignored. Ids are 64-bit hashes of keys and vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, staged
from .neardup import CROWD, in_blocks, meets_once

MAX_SPACES = 256
_BLOCK = 1024
_ROW = 2000
_ASKING = 150_000
_LOCAL_SAMPLE = 50_000
#: Vectors of all spaces together that the driver fits forests and cells to (twice as many at most are fetched).
TOTAL_SAMPLE = 400_000


@dataclass
class Tree:
    """Inner nodes: normal, threshold, children. A child below 0 is the leaf ``-1 - child``."""

    normals: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    leaves: int


def grow(points: np.ndarray, leaf: float, rng: np.random.Generator) -> Tree:
    """A tree over sample points that splits until a leaf has at most ``leaf`` of them."""
    normals, thresholds, children, leaves = [], [], [], 0

    def node(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) <= max(leaf, 2):
            leaves += 1
            return -leaves
        for _ in range(4):
            a, b = points[rng.choice(rows, 2, replace=False)]
            normal = a - b
            size = np.linalg.norm(normal)
            if size > 1e-9:
                break
        else:
            normal, size = rng.standard_normal(points.shape[1]), 1.0
        normal = (normal / max(size, 1e-9)).astype(np.float32)
        side = points[rows] @ normal
        middle = float(np.median(side))
        left = side < middle
        if not left.any() or left.all():
            leaves += 1
            return -leaves
        here = len(normals)
        normals.append(normal)
        thresholds.append(middle)
        children.append([0, 0])
        children[here] = [node(rows[left]), node(rows[~left])]
        return here

    root = node(np.arange(len(points)))
    if root < 0:
        return Tree(np.zeros((1, points.shape[1]), np.float32), np.zeros(1, np.float32), np.array([[-1, -1]]), 1)
    return Tree(np.array(normals, np.float32), np.array(thresholds, np.float32), np.array(children), leaves)


@dataclass
class Index:
    """The trees of one space as one array of nodes; leaves are numbered through."""

    normals: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    roots: np.ndarray
    leaves: int

    @staticmethod
    def of(trees: list[Tree]) -> Index:
        nodes, leaves, children, roots = 0, 0, [], []
        for t in trees:
            children.append(np.where(t.children < 0, t.children - leaves, t.children + nodes))
            roots.append(nodes)
            nodes, leaves = nodes + len(t.normals), leaves + t.leaves
        return Index(np.concatenate([t.normals for t in trees]), np.concatenate([t.thresholds for t in trees]), np.concatenate(children), np.array(roots), leaves)

    def search(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the ``probes`` leaves first in the shared queue, and their penalties.

        The queue is cut to its ``2 * probes`` best entries at each level. A penalty of 0 marks
        the row's own leaf; where there are fewer leaves, -1 fills up.
        """
        n, width = len(x), max(2 * probes, len(self.roots))
        at = np.tile(self.roots, (n, 1))
        penalty = np.zeros(at.shape, np.float32)
        rows = np.arange(n)[:, None]
        while (at >= 0).any():
            inner = at >= 0
            safe = np.where(inner, at, 0)
            margin = np.einsum("nbd,nd->nb", self.normals[safe], x, optimize=False) - self.thresholds[safe]
            left, right = self.children[safe, 0], self.children[safe, 1]
            gone = np.float32(np.inf)
            low = np.where(inner, np.maximum(penalty, np.maximum(margin, 0)), penalty)
            high = np.where(inner, np.maximum(penalty, np.maximum(-margin, 0)), gone)
            # On the plane itself (margin 0) the right side is the row's own.
            low = np.where(inner & (margin == 0), np.maximum(low, np.float32(1e-12)), low)
            at = np.concatenate([np.where(inner, left, at), np.where(inner, right, -1)], axis=1)
            penalty = np.concatenate([low, high], axis=1)
            if at.shape[1] > width:
                best = np.argpartition(penalty, width - 1, axis=1)[:, :width]
                at, penalty = at[rows, best], penalty[rows, best]
        if at.shape[1] > probes:
            best = np.argpartition(penalty, probes - 1, axis=1)[:, :probes]
            at, penalty = at[rows, best], penalty[rows, best]
        return np.where(np.isfinite(penalty), -1 - at, -1), penalty


def _unit(batches: Iterator[pa.RecordBatch], half: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, keep = [], []
        for r, v in enumerate(batch.column(2)):
            x = np.asarray(v.values, np.float64)
            size = float(np.sqrt(x @ x))
            if np.isfinite(size) and size > 0:
                keep.append(r)
                out.append((x / size).astype(np.float16 if half else np.float32).tobytes())
        rows = pa.array(keep, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(out, pa.binary())], names=["v", "space", "unit"])


def _route(indexes, probes: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = indexes.value
        for batch in batches:
            spaces = np.array(batch.column(1).to_pylist())
            ids, units = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for s in np.unique(spaces):
                number, index = known[s]
                where = np.flatnonzero(spaces == s)
                for at in range(0, len(where), 2048):
                    rows = where[at : at + 2048]
                    x = np.frombuffer(b"".join(units[r] for r in rows), kind).reshape(len(rows), -1).astype(np.float32)
                    leaf, penalty = index.search(x, probes)
                    r, c = np.nonzero(leaf >= 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((np.int64(number) << 40) + leaf[r, c]), pa.array(ids[rows][r]), pa.array(penalty[r, c] == 0), pa.array([units[i] for i in rows[r]], pa.binary())],
                        names=["leaf", "v", "member", "unit"],
                    )

    return run


def _inside_leaf(ids: np.ndarray, x: np.ndarray, names: np.ndarray, inside: np.ndarray, least: float, leaf: int, trees: int, probes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a crowded leaf by a forest of its own members, fitted where the leaf is."""
    rng = np.random.default_rng(len(names))
    points = inside[rng.choice(len(inside), min(len(inside), _LOCAL_SAMPLE), replace=False)]
    index = Index.of([grow(points, max(8.0, leaf * len(points) / len(inside)), rng) for _ in range(trees)])

    def routed(rows: np.ndarray, n: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
        leaves, at = [], []
        for begin in range(0, len(rows), 2048):
            found, penalty = index.search(rows[begin : begin + 2048], n)
            r, c = np.nonzero((penalty == 0) if own else (found >= 0))
            leaves.append(found[r, c])
            at.append(r + begin)
        leaves, at = np.concatenate(leaves), np.concatenate(at)
        order = np.argsort(leaves, kind="stable")
        return leaves[order], at[order]

    of, members = routed(inside, trees, True)
    asked, queries = routed(x, probes, False)
    for number in np.unique(of):
        m = members[np.searchsorted(of, number) : np.searchsorted(of, number, "right")]
        q = queries[np.searchsorted(asked, number) : np.searchsorted(asked, number, "right")]
        for at in range(0, len(q), _BLOCK):
            block = q[at : at + _BLOCK]
            for to in range(0, len(m), 8 * _BLOCK):
                part = m[to : to + 8 * _BLOCK]
                score = x[block] @ inside[part].T
                r, c = np.nonzero((score >= least) & (ids[block][:, None] != names[part][None, :]))
                yield ids[block][r], names[part][c], score[r, c]


def _search_leaf(k: int, least: float, kind: str, leaf: int = 0, trees: int = 4, probes: int = 8):
    """Queries of a leaf or cell against its members: pairs ``a, b, similarity``.

    With ``leaf`` a leaf of more than four times as many members is searched through a forest of its
    own, so the work for a vector does not grow with the table however small the fitted sample."""

    def run(table: pa.Table) -> pa.Table:
        ids, member = table.column("v").to_numpy(), table.column("member").to_numpy()
        asks = table.column("asks").to_numpy() if "asks" in table.column_names else np.ones(len(ids), bool)
        x = np.frombuffer(b"".join(table.column("unit").to_pylist()), kind).reshape(len(ids), -1).astype(np.float32)
        order = np.lexsort((~member, ids))  # one row for each id, the member's if there is one
        first = np.ones(len(order), bool)
        first[1:] = ids[order][1:] != ids[order][:-1]
        order = order[first]
        ids, member, asks, x = ids[order], member[order], asks[order], x[order]
        inside, names, ids, x = x[member], ids[member], ids[asks], x[asks]
        a, b, s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float32)]
        crowded = bool(leaf) and least > -1 and len(names) > 4 * leaf
        for i, j, score in _inside_leaf(ids, x, names, inside, least, leaf, trees, probes) if crowded and len(ids) else ():
            a.append(i)
            b.append(j)
            s.append(score)
        for at in range(0, len(ids) if len(names) and not crowded else 0, _BLOCK):
            own = ids[at : at + _BLOCK]
            score = x[at : at + _BLOCK] @ inside.T
            place = np.minimum(np.searchsorted(names, own), len(names) - 1)
            self_ = np.flatnonzero(names[place] == own)
            score[self_, place[self_]] = -2
            if least > -1:
                r, c = np.nonzero(score >= least)
            else:
                top = np.argpartition(score, len(names) - k, axis=1)[:, -k:] if len(names) > k else np.tile(np.arange(len(names)), (len(own), 1))
                r, c = np.repeat(np.arange(len(own)), top.shape[1]), top.ravel()
                ok = score[r, c] > -2
                r, c = r[ok], c[ok]
            a.append(own[r])
            b.append(names[c])
            s.append(score[r, c])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "similarity": np.concatenate(s)})

    return run


@dataclass
class Cells:
    """The cells of one space: centres, cells searched for a vector, parts each cell's queries are split in."""

    centres: np.ndarray
    probes: int
    parts: np.ndarray
    recall: float = 1.0


def centres_of(points: np.ndarray, cells: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from random points; an empty cell begins again at another point."""
    centres = points[rng.choice(len(points), cells, replace=False)]
    for _ in range(rounds if cells > 1 else 0):
        total = np.zeros_like(centres)
        count = np.zeros(cells)
        for at in range(0, len(points), 4096):
            x = points[at : at + 4096]
            own = np.argmax(x @ centres.T, axis=1)
            order = np.argsort(own, kind="stable")
            used, begin = np.unique(own[order], return_index=True)
            total[used] += np.add.reduceat(x[order], begin, axis=0)
            count += np.bincount(own, minlength=cells)
        size = np.linalg.norm(total, axis=1)
        lost = (count == 0) | (size < 1e-9)
        total[lost] = points[rng.integers(len(points), size=int(lost.sum()))]
        size[lost] = 1.0
        centres = (total / size[:, None]).astype(np.float32)
    return centres


def planned(points: np.ndarray, count: int, asked: np.ndarray, true: np.ndarray, of: np.ndarray, target: float, leaf: int, rng: np.random.Generator) -> Cells:
    """The cheapest cells that keep ``target`` of the true neighbours ``true`` of the held-out vectors.

    ``of`` is the row of ``asked`` that each row of ``true`` belongs to. Tried are cells of about
    ``leaf`` vectors, of four times as many, and so on to one cell.
    """
    best, least = None, np.inf
    cells = min(max(1, round(count / leaf)), max(1, len(points) // 8), max(1, round(4 * count**0.5)))
    while best is None or cells >= 1:
        centres = centres_of(points, cells, rng)
        near = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
        rank = np.empty_like(near)
        np.put_along_axis(rank, near, np.broadcast_to(np.arange(cells), near.shape).copy(), axis=1)
        home = np.argmax(true @ centres.T, axis=1)
        needed = np.sort(rank[of, home]) + 1
        probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) if len(needed) else 1
        # A row that is sent costs about as much as _ROW products.
        cost = _ROW * probes + count * probes / cells
        if cost < least:
            held = np.bincount(np.concatenate([np.argmax(points[at : at + 4096] @ centres.T, axis=1) for at in range(0, len(points), 4096)]), minlength=cells) * (count / len(points))
            best, least = Cells(centres, probes, np.maximum(1, np.ceil(held * probes / _ASKING)).astype(np.int64), float((needed <= probes).mean()) if len(needed) else 1.0), cost
        if cells == 1:
            break
        cells = max(1, cells // 4)
    return best


def _exact(held, k: int):
    """Of each held-out vector the k most similar rows of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best = held.value, {}
        for batch in batches:
            spaces = np.array(batch.column(1).to_pylist())
            ids, units = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for s in np.unique(spaces):
                own, asked = known[s]
                rows = np.flatnonzero(spaces == s)
                x = np.frombuffer(b"".join(units[r] for r in rows), np.float32).reshape(len(rows), -1)
                score = asked @ x.T
                score[own[:, None] == ids[rows][None, :]] = -2
                top = np.argsort(-score, axis=1)[:, :k]
                new = (np.take_along_axis(score, top, axis=1), ids[rows][top], x[top])
                old = best.get(s)
                if old is not None:
                    new = tuple(np.concatenate([p, q], axis=1) for p, q in zip(old, new))
                    top = np.argsort(-new[0], axis=1)[:, :k]
                    new = (np.take_along_axis(new[0], top, axis=1), np.take_along_axis(new[1], top, axis=1), np.take_along_axis(new[2], top[:, :, None], axis=1))
                best[s] = new
        for s, (score, ids, x) in best.items():
            r, c = np.nonzero(score > -2)
            yield pa.RecordBatch.from_arrays(
                [pa.array([str(s)] * len(r), pa.string()), pa.array(r.astype(np.int32)), pa.array(ids[r, c]), pa.array(score[r, c]), pa.array([v.tobytes() for v in x[r, c]], pa.binary())],
                names=["space", "q", "b", "similarity", "unit"],
            )

    return run


def _send(plans):
    """Each vector to its cell as a member (to all parts of the cell) and to the cells it searches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = plans.value
        for batch in batches:
            spaces = np.array(batch.column(1).to_pylist())
            ids, units = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for s in np.unique(spaces):
                number, plan = known[s]
                where = np.flatnonzero(spaces == s)
                for at in range(0, len(where), 1024):
                    rows = where[at : at + 1024]
                    x = np.frombuffer(b"".join(units[r] for r in rows), np.float32).reshape(len(rows), -1)
                    score = x @ plan.centres.T
                    home = np.argmax(score, axis=1)
                    score[np.arange(len(rows)), home] = np.inf
                    cells = np.argpartition(-score, plan.probes - 1, axis=1)[:, : plan.probes]
                    part = (ids[rows][:, None] % plan.parts[cells]).ravel()
                    r, cell = np.repeat(np.arange(len(rows)), plan.probes), cells.ravel()
                    member = cell == home[r]
                    asks = np.ones(len(r), bool)
                    copies = plan.parts[home] - 1  # the parts of its cell in which it is a member only
                    if copies.any():
                        extra = np.repeat(np.arange(len(rows)), copies)
                        nth = np.arange(len(extra)) - np.repeat(np.cumsum(copies) - copies, copies)
                        mine = ids[rows][extra] % plan.parts[home[extra]]
                        r, cell, part = np.concatenate([r, extra]), np.concatenate([cell, home[extra]]), np.concatenate([part, nth + (nth >= mine)])
                        member, asks = np.concatenate([member, np.ones(len(extra), bool)]), np.concatenate([asks, np.zeros(len(extra), bool)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((np.int64(number) << 40) + (cell << 16) + part), pa.array(ids[rows][r]), pa.array(member), pa.array(asks), pa.array([units[i] for i in rows[r]], pa.binary())],
                        names=["leaf", "v", "member", "asks", "unit"],
                    )

    return run


def vector_rows(df: DataFrame, key: str = "key", embedding: str = "embedding") -> DataFrame:
    """``key, space, v, embedding``: v is a hash of space and vector; unusable rows are dropped."""
    parts = F.split(F.col(key), "::")
    space = F.concat_ws("::", F.element_at(parts, -2), F.element_at(parts, -1))
    dims = F.expr("try_cast(element_at(split(`%s`, '::'), -1) as int)" % key)
    rows = df.where(F.col(embedding).isNotNull() & F.col(key).isNotNull() & (F.size(parts) >= 3)).where(F.size(embedding) == dims)
    rows = rows.where(F.exists(embedding, lambda x: x != 0) & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x)))
    return rows.select(F.col(key).alias("key"), space.alias("space"), F.xxhash64(space, F.col(embedding)).alias("v"), F.col(embedding).alias("embedding"))


def _units(rows: DataFrame, half: bool) -> tuple[DataFrame, list[tuple[str, int]]]:
    """The unit vectors of all classes, and the spaces with their numbers of classes."""
    ship(rows.sparkSession)
    units = rows.select("v", "space", "embedding").mapInArrow(lambda b: _unit(b, half), "v bigint, space string, unit binary")
    units = staged(units.groupBy("v", "space").agg(F.first("unit").alias("unit")), "unit-vectors")
    sizes = units.groupBy("space").count().limit(MAX_SPACES + 1).collect()  # bounded
    if len(sizes) > MAX_SPACES:
        raise ValueError(f"more than {MAX_SPACES} models and dimensions")
    return units, sorted(tuple(r) for r in sizes)


def _sampled(units: DataFrame, space: str, count: int, sample: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most about ``sample`` classes of a space, chosen by hash."""
    part = units.where(F.col("space") == space)
    step = max(1, -(-count // sample))
    part = part.where(F.pmod(F.xxhash64("v"), F.lit(step)) == 0) if step > 1 else part
    held = part.select("v", "unit").limit(2 * sample).toArrow()
    return held.column(0).to_numpy(), np.frombuffer(b"".join(held.column(1).to_pylist()), kind).reshape(held.num_rows, -1).astype(np.float32)


def class_pairs(rows: DataFrame, least: float, trees: int = 4, leaf: int = 1024, probes: int = 8, sample: int = 100_000, seed: int = 11) -> DataFrame:
    """``a, b, similarity`` of vector classes of at least that similarity found by the forest,
    each once or twice. Vectors are carried in half precision."""
    spark = rows.sparkSession
    units, sizes = _units(rows, True)
    indexes = {}
    sample = min(sample, max(1000, TOTAL_SAMPLE // max(1, len(sizes))))
    for number, (space, count) in enumerate(sizes):
        _, points = _sampled(units, space, count, sample, "<f2")
        rng = np.random.default_rng([seed, number])
        small = max(8.0, leaf * len(points) / count)
        indexes[space] = (number, Index.of([grow(points, small, rng) for _ in range(trees)]))
    if not indexes:
        return spark.createDataFrame([], "a bigint, b bigint, similarity float")
    routed = units.mapInArrow(_route(spark.sparkContext.broadcast(indexes), probes, "<f2"), "leaf bigint, v bigint, member boolean, unit binary")
    return routed.groupBy("leaf").applyInArrow(_search_leaf(0, least, "<f2", leaf, trees, probes), "a bigint, b bigint, similarity float")


def plans_of(units: DataFrame, sizes: list[tuple[str, int]], k: int, target: float, leaf: int, sample: int, queries: int, seed: int) -> dict[str, tuple[int, Cells]]:
    """The planned cells of each space; ``queries`` vectors of each are held out of the fit."""
    fitted, held = {}, {}
    sample = min(sample, max(1000, TOTAL_SAMPLE // max(1, len(sizes))))
    for number, (space, count) in enumerate(sizes):
        ids, points = _sampled(units, space, count, sample, "<f4")
        order = np.lexsort((np.arange(len(ids)), ids))
        ids, points = ids[order], points[order]
        rng = np.random.default_rng([seed, number])
        out = rng.permutation(len(ids))[: min(queries, len(ids) // 2)]
        kept = np.setdiff1d(np.arange(len(ids)), out)
        held[space], fitted[space] = (ids[out], points[out]), (points[kept], rng)
    best = Window.partitionBy("space", "q").orderBy(F.col("similarity").desc(), "b")
    true = units.mapInArrow(_exact(units.sparkSession.sparkContext.broadcast(held), k), "space string, q int, b bigint, similarity float, unit binary")
    true = true.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("space", "q", "unit").toArrow()  # at most k * queries for each space
    names, of, near = np.array(true.column(0).to_pylist()), true.column(1).to_numpy(), true.column(2).to_pylist()
    out = {}
    for number, (space, count) in enumerate(sizes):
        (points, rng), own = fitted[space], np.flatnonzero(names == space)
        x = np.frombuffer(b"".join(near[i] for i in own), np.float32).reshape(len(own), points.shape[1])
        out[space] = (number, planned(points, count, held[space][1], x, of[own], target, leaf, rng))
    return out


def cell_pairs(rows: DataFrame, k: int, target: float = 0.95, leaf: int = 512, sample: int = 100_000, queries: int = 256, seed: int = 11) -> DataFrame:
    """``a, b, similarity``: the k best of each vector class in each cell it searches."""
    spark = rows.sparkSession
    units, sizes = _units(rows, False)
    if not sizes:
        return spark.createDataFrame([], "a bigint, b bigint, similarity float")
    plans = plans_of(units, sizes, k, target, leaf, sample, queries, seed)
    sent = units.mapInArrow(_send(spark.sparkContext.broadcast(plans)), "leaf bigint, v bigint, member boolean, asks boolean, unit binary")
    return sent.groupBy("leaf").applyInArrow(_search_leaf(k, -1.0, "<f4"), "a bigint, b bigint, similarity float")


def similar_pairs(df: DataFrame, least: float, trees: int = 4, leaf: int = 1024, probes: int = 8, **kw) -> DataFrame:
    """``key_a, key_b, similarity`` of all pairs found with at least that cosine similarity.

    Candidates come from half-precision vectors with a margin of 0.002 and are verified on the
    stored vectors in double precision.
    """
    rows = vector_rows(df)
    found = class_pairs(rows, least - 0.002, trees, leaf, probes, **kw)
    pairs = staged(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "similar-candidates")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    same = rows.groupBy("v").agg(F.min("key").alias("k0"), F.max("key").alias("k1")).where("k0 <> k1").select("v")
    wanted = staged(ids.unionByName(same).distinct(), "similar-ids")
    mine = staged(rows.join(wanted, "v", "left_semi").select("v", "key", F.transform("embedding", lambda x: x.cast("double")).alias("e")), "similar-vectors")
    one = mine.groupBy("v").agg(F.first("e").alias("e"))

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)

    both = pairs.join(one.select(F.col("v").alias("a"), F.col("e").alias("x")), "a").join(one.select(F.col("v").alias("b"), F.col("e").alias("y")), "b")
    exact = both.select("a", "b", (dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y"))).alias("similarity")).where(F.col("similarity") >= least)
    names = mine.select("v", "key").distinct()
    apart = exact.join(names.select(F.col("v").alias("a"), F.col("key").alias("i")), "a").join(names.select(F.col("v").alias("b"), F.col("key").alias("j")), "b").select(F.least("i", "j").alias("key_a"), F.greatest("i", "j").alias("key_b"), "similarity")
    sizes = names.groupBy("v").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    cut = in_blocks(names.select("v", F.col("key").alias("id")).join(sizes.select("v"), "v", "left_semi"), "v", sizes.where(F.col("m") > CROWD), CROWD)
    equal = cut.alias("p").join(cut.alias("q"), meets_once("p", "q", "v")).select(F.col("p.id").alias("key_a"), F.col("q.id").alias("key_b"), F.lit(1.0).alias("similarity"))
    return apart.unionByName(equal).where("similarity >= %r" % float(least))


def nearest(df: DataFrame, k: int = 10, target: float = 0.95, leaf: int = 512, **kw) -> DataFrame:
    """``key, neighbour, similarity, position``: the k most similar other keys of each key.

    ``target`` is the share of true neighbours the plan keeps of held-out vectors.
    """
    rows = vector_rows(df)
    found = cell_pairs(rows, k, target, leaf, **kw)
    first = Window.partitionBy("a").orderBy(F.col("similarity").desc(), F.col("b"))
    best = staged(found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).drop("r"), "nearest-classes")
    names = staged(rows.select("v", "key").distinct(), "vector-keys")
    # Of a class of equal vectors k + 1 keys are enough for everyone's k neighbours.
    few = names.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("key"))).where(F.col("r") <= k + 1).drop("r")
    near = best.select("a", "b", "similarity").unionByName(names.select(F.col("v").alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(1.0).cast("float").alias("similarity")))
    options = near.join(few.select(F.col("v").alias("b"), F.col("key").alias("neighbour")), "b")
    ordered = Window.partitionBy("a").orderBy(F.col("similarity").desc(), F.col("neighbour"))
    top = options.withColumn("r", F.row_number().over(ordered)).where(F.col("r") <= k + 1).select("a", "neighbour", "similarity")
    each = names.join(top, names["v"] == top["a"]).where("key <> neighbour").select("key", "neighbour", "similarity")
    return each.withColumn("position", F.row_number().over(Window.partitionBy("key").orderBy(F.col("similarity").desc(), "neighbour"))).where(F.col("position") <= k)

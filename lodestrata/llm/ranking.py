"""One ranking from lists of differently scaled scores (problem 4).

Each list (backend or retriever) of a run is rank-transformed: the best record has 1, the
worst of n has 1 / n, a record that the list lacks has 0. Ranks have the same range in every
list, so no list weighs more by the size of its scores. The correlation matrix of the lists is
one distributed aggregation over all rows. Its first principal component, with signs turned to
the declared directions, gives the loadings, and records are sorted by their projection, over
the lists present in the run.

The scores are shuffled once, by run: best score of a record, ranks and the wide table (one
column for each list) need no other partitioning. The wide table is written to the shared
folder; correlation and projection read it. Runs above ``HOT_ROWS`` rows are ranked apart, in
ranges of their values.

Defined cases: null and NaN scores do not count; a record repeated in a list has its best
score; equal scores share the mean of their ranks; a list missing from a run is left out
there; a run without any score has no ranking; ties of the projection are ordered by record;
where every correlation is undefined (a single list, constant ranks) all lists weigh the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

MAX_LISTS = 64
HOT_ROWS = 500_000


def ranks_in_groups(df: DataFrame, keys: list[str], value: str, ties: str | None = None, hot_rows: int = 500_000, parts: int = 256) -> DataFrame:
    """``df`` with ``rank_in_group``: 1 for the largest value. With ``ties`` rows of equal value
    are ordered by that column, else they share their mean rank.

    Groups above ``hot_rows`` are cut into value ranges by approximate percentiles, ranked range
    by range and shifted by the sizes of the ranges above, so that none is sorted in one task.
    """
    order = [F.col(value).desc(), *([F.col(ties).asc()] if ties else [])]

    def ranked(x: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        if ties:
            return x.withColumn("rank_in_group", F.row_number().over(w).cast("double"))
        same = Window.partitionBy(*by, value)
        return x.withColumn("rank_in_group", F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2)

    sizes = df.groupBy(*keys).count().where(F.col("count") > hot_rows)
    if sizes.isEmpty():
        return ranked(df, keys)
    hot = sizes.select(*keys)
    many = df.join(hot, keys, "left_semi")
    cuts = many.groupBy(*keys).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10_000).alias("_cuts"))
    cut = many.join(F.broadcast(cuts) if hot.limit(1001).count() <= 1000 else cuts, keys).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    above = cut.groupBy(*keys, "_part").count().withColumn("_above", F.coalesce(F.sum("count").over(Window.partitionBy(*keys).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    slow = ranked(cut, [*keys, "_part"]).join(above, [*keys, "_part"]).withColumn("rank_in_group", F.col("rank_in_group") + F.col("_above")).drop("_part", "_above")
    return ranked(df.join(hot, keys, "left_anti"), keys).unionByName(slow.select(*df.columns, "rank_in_group"))


def _spread(ranks: DataFrame, names: list[str]) -> DataFrame:
    """``run, record, v0, v1, ...``: 0 where the list lacks the record, null where the run lacks the list."""
    wide = ranks.groupBy("run", "record").agg(*(F.max(F.when(F.col("list") == n, F.col("value"))).alias(f"v{i}") for i, n in enumerate(names)))
    run = Window.partitionBy("run")
    return wide.select("run", "record", *(F.coalesce(f"v{i}", F.when(F.max(f"v{i}").over(run).isNotNull(), 0.0)).alias(f"v{i}") for i in range(len(names))))


def rank_table(scores: DataFrame, names: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rank-transformed lists side by side, one row for each run and record."""
    given = scores.where("score is not null and not isnan(score) and list is not null").select("run", "list", "record", (F.col("score") + F.lit(0.0)).alias("score"))  # -0.0 is 0.0
    hot = given.groupBy("run").count().where(F.col("count") > hot_rows).select("run")
    crowded = [r[0] for r in hot.limit(1001).collect()]
    usual = given.where(~F.col("run").isin(crowded) | F.col("run").isNull()) if 0 < len(crowded) <= 1000 else given.join(hot, "run", "left_anti") if crowded else given
    best = usual.repartition("run").groupBy("run", "list", "record").agg(F.max("score").alias("score"))
    of_list = Window.partitionBy("run", "list")
    down, up = of_list.orderBy(F.col("score").desc()), of_list.orderBy("score")
    # The mean rank of equal scores is halfway between the first from above and the last from below.
    n = F.count(F.lit(1)).over(of_list)
    value = 1 - ((F.rank().over(down) + n + 1 - F.rank().over(up)) / 2 - 1) / n
    table = _spread(best.select("run", "list", "record", value.alias("value")), names)
    if crowded:
        many = given.join(hot, "run", "left_semi").groupBy("run", "list", "record").agg(F.max("score").alias("score"))
        sizes = many.groupBy("run", "list").agg(F.count(F.lit(1)).alias("n"))
        ranked = ranks_in_groups(many, ["run", "list"], "score", hot_rows=hot_rows).join(sizes, ["run", "list"])
        ranks = ranked.select("run", "list", "record", (1 - (F.col("rank_in_group") - 1) / F.col("n")).alias("value"))
        wide = ranks.groupBy("run", "record").agg(*(F.max(F.when(F.col("list") == x, F.col("value"))).alias(f"v{i}") for i, x in enumerate(names)))
        there = ranks.groupBy("run").agg(*(F.max(F.col("list") == x).alias(f"p{i}") for i, x in enumerate(names)))
        apart = wide.join(there, "run").select("run", "record", *(F.coalesce(f"v{i}", F.when(F.col(f"p{i}"), 0.0)).alias(f"v{i}") for i in range(len(names))))
        table = table.unionByName(apart)
    return table


def correlation(table: DataFrame, k: int) -> np.ndarray:
    """Correlations of the columns v0, v1, ... over the rows where neither is null."""
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    out = np.eye(k)
    if pairs:
        row = table.agg(*(F.corr(f"v{i}", f"v{j}") for i, j in pairs)).first()
        for (i, j), c in zip(pairs, row):
            out[i, j] = out[j, i] = 0.0 if c is None or np.isnan(c) else c
    return out


def loadings(matrix: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """First principal component; the sign of each loading is turned to its declared direction, so a list
    that disagrees with the others weighs less or more, but never against what was declared."""
    k = len(matrix)
    m = matrix * np.outer(directions, directions)
    if np.allclose(m, np.eye(k), atol=1e-12):
        return np.full(k, k**-0.5) * directions  # every direction is a component
    values, vectors = np.linalg.eigh(m)
    return np.abs(vectors[:, int(np.argmax(values))]) * directions


def projected(scores: DataFrame, directions: dict[str, int] | None = None) -> DataFrame:
    """``run, record, score`` (the projection) from ``run, list, record, score``.

    ``directions`` declares +1 (higher is better, the default) or -1 for a list.
    """
    directions = directions or {}
    names = [r[0] for r in scores.select("list").where("list is not null").distinct().limit(MAX_LISTS + 1).collect()]  # bounded
    if len(names) > MAX_LISTS:
        raise ValueError(f"more than {MAX_LISTS} lists")
    names = sorted(names)
    if not names:
        return scores.select("run", "record", F.lit(0.0).alias("score")).limit(0)
    turned = scores.withColumn("score", F.col("score") * F.coalesce(*(F.when(F.col("list") == n, d) for n, d in directions.items()), F.lit(1))) if directions else scores
    table = staged(rank_table(turned, names), "rank-table")
    # Ranks already point upwards, so all declared directions are +1 from here.
    load = loadings(correlation(table, len(names)), np.ones(len(names)))
    total = sum((F.when(F.col(f"v{i}").isNotNull(), F.lit(float(abs(a)))).otherwise(0.0) for i, a in enumerate(load)), F.lit(0.0))
    value = sum((F.lit(float(a)) * F.coalesce(F.col(f"v{i}"), F.lit(0.0)) for i, a in enumerate(load)), F.lit(0.0))
    return table.select("run", "record", F.round(value / total, 12).alias("score"))


def fused_ranking(scores: DataFrame, directions: dict[str, int] | None = None) -> DataFrame:
    """``run, record, score, position``: all records of each run, the best at position 1."""
    p = projected(scores, directions)
    return ranks_in_groups(p, ["run"], "score", ties="record").withColumn("position", F.col("rank_in_group").cast("bigint")).drop("rank_in_group")


def winners(scores: DataFrame, directions: dict[str, int] | None = None) -> DataFrame:
    """``run, record``: the first place of each run, without sorting the rest."""
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("record").alias("r")))
    return projected(scores, directions).groupBy("run").agg(best.alias("b")).select("run", F.col("b.r").alias("record"))

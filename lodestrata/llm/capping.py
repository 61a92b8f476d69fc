"""Limiting each contributor to a count or a share of the rows (problem 6).

``cap_records`` keeps each contributor's best rows. The rows above the cap are found against
one threshold for each contributor. Up to ``TOP`` rows are kept: the best rows of salted parts,
then the best of these, give the last row that is kept; rows meet their threshold by contributor
and salt. Above that a contributor of more than ``HOT_ROWS`` rows is cut into ranges of quality,
the range with the last kept row is found from the ranges' counts, and (where it holds one quality
only) cut again into ranges of the order; only that last range is sorted. So a contributor with a
third of all rows is spread over all tasks in every step.

``share_cap`` solves a share limit by water-filling: with cap c the output has
f(c) = sum(min(n_i, c)) rows, and c is the largest number with c <= share * f(c). Between two
neighbouring contributor counts f is linear, so each segment is solved in closed form over
the histogram of counts, which has at most sqrt(2 N) rows for N input rows.

Defined cases: rows without contributor are never capped; null quality counts as the lowest;
at equal quality the smaller order value is kept; repeated rows all count; empty tables give
empty results; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fits_broadcast, staged

SALTS = 32
#: Caps up to this are found by salted top rows.
TOP = 1000
HOT_ROWS = 500_000
_PARTS = 256


def contributor_name(owner: Column) -> Column:
    """The user name behind the spellings of an owner: case, blanks, ``@``, profile addresses."""
    blank = r"[\s   -‏    ⁠　﻿]+"
    name = F.regexp_replace(F.lower(owner), blank, "")
    name = F.regexp_replace(name, r"^(?:https?://)?(?:[a-z0-9-]+\.)+[a-z]{2,}/+(?=[^/])", "")
    name = F.regexp_replace(name, r"^@+|[/?#].*$", "")
    return F.when(name != "", name)


def share_cap(df: DataFrame, contributor: str, share: float) -> int:
    """The largest count by which no contributor holds more than ``share`` of the output.

    Where fewer than 1 / share contributors exist no positive cap can reach the share; then
    all are levelled to the smallest contributor's count (0 for an empty table).
    """
    counts = df.where(F.col(contributor).isNotNull()).groupBy(contributor).agg(F.count(F.lit(1)).alias("n"))
    bars = counts.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    up = Window.orderBy("n")  # over the histogram: at most sqrt(2 N) rows
    free = df.where(F.col(contributor).isNull()).count()
    seg = (
        bars.withColumn("below", F.coalesce(F.sum(F.col("n") * F.col("m")).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.lit(free))
        .withColumn("above", F.sum("m").over(up.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("low", F.coalesce(F.lag("n").over(up), F.lit(0)))
    )
    room = 1 - F.lit(share) * F.col("above")
    best = F.when(room <= 0, F.col("n")).otherwise(F.least(F.col("n"), F.floor(F.lit(share) * F.col("below") / room + 1e-9)))
    row = seg.select(F.max(F.when(best >= F.col("low"), best)).alias("cap"), F.min("n").alias("least")).first()
    return int(row["cap"] or row["least"] or 0)


def _ranges(rows: DataFrame, value: str, down: bool) -> DataFrame:
    """``rows`` with ``_part``: ranges of a value within each ``_c``, the best range has the lowest number.

    Ranges lie between approximate percentiles; the rows of a percentile's own value have a range
    to themselves, so a value that many rows share is not mixed with others."""
    cuts = rows.groupBy("_c").agg(F.percentile_approx(value, [i / _PARTS for i in range(1, _PARTS)], 10_000).alias("_cuts"))
    better = (lambda c: c > F.col(value)) if down else (lambda c: c < F.col(value))
    part = F.size(F.filter("_cuts", better)) * 2 + F.array_contains("_cuts", F.col(value)).cast("int")
    return rows.join(F.broadcast(cuts) if fits_broadcast(cuts, 2000) else cuts, "_c").withColumn("_part", part).drop("_cuts")


def _last_range(parted: DataFrame, left: Column) -> DataFrame:
    """``_c, _edge, _left``: the range in which the last kept row lies and how many of it are kept."""
    sizes = parted.groupBy("_c", "_left", "_part").agg(F.count(F.lit(1)).alias("_n"))
    above = F.coalesce(F.sum("_n").over(Window.partitionBy("_c").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("_above", above).where((F.col("_above") < left) & (left <= F.col("_above") + F.col("_n"))).select("_c", F.col("_part").alias("_edge"), (left - F.col("_above")).alias("_left"))


def _limits_by_ranges(named: DataFrame, cap: int) -> DataFrame:
    """``_c, _tq, _to``: the last kept row of each contributor of ``named`` (_c, _q, _o)."""
    small = lambda df: F.broadcast(df) if fits_broadcast(df, 2000) else df
    parted = staged(_ranges(named.withColumn("_left", F.lit(cap)), "_q", True), "quality-ranges")
    edge = staged(_last_range(parted, F.col("_left")), "quality-edge")
    inside = parted.drop("_left").join(small(edge), "_c").where("_part = _edge").select("_c", "_q", "_o", "_left")
    inside = staged(inside, "quality-inside")
    same = inside.groupBy("_c").agg(F.min("_q").alias("a"), F.max("_q").alias("b")).where("a = b").select("_c")
    ordered = dict(inside.dtypes)["_o"] in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp")
    rest = inside
    if ordered:
        tied = staged(_ranges(inside.join(small(same), "_c", "left_semi"), "_o", False), "order-ranges")
        last = staged(_last_range(tied, F.col("_left")), "order-edge")
        rest = inside.join(small(same), "_c", "left_anti").unionByName(tied.drop("_left").join(small(last), "_c").where("_part = _edge").select("_c", "_q", "_o", "_left"))
    w = Window.partitionBy("_c").orderBy(F.col("_q").desc(), F.col("_o").asc())
    return rest.withColumn("_r", F.row_number().over(w)).where("_r = _left").select("_c", F.col("_q").alias("_tq"), F.col("_o").alias("_to"))


def over_cap(df: DataFrame, contributor: str, quality: str, order: str, cap: int, salts: int = SALTS, top: int = TOP, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with the boolean ``over_cap``: true for the rows after each contributor's ``cap`` best.

    ``order`` is unique; the smaller value is kept at a tie of quality.
    """
    rows = df.withColumn("_q", F.coalesce(F.col(quality).cast("double"), F.lit(float("-inf")))).withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    named = rows.where(F.col(contributor).isNotNull()).select(F.col(contributor).alias("_c"), "_salt", "_q", F.col(order).alias("_o"))
    best = [F.col("_q").desc(), F.col("_o").asc()]
    pick = lambda x: x.withColumn("_r", F.row_number().over(Window.partitionBy("_c").orderBy(*best))).where(F.col("_r") == cap).select("_c", F.col("_q").alias("_tq"), F.col("_o").alias("_to"))
    if cap <= top:
        last = pick(named.withColumn("_r", F.row_number().over(Window.partitionBy("_c", "_salt").orderBy(*best))).where(F.col("_r") <= cap))
    else:
        sizes = staged(named.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cap), "contributors-over-cap")
        usual, hot = (sizes.where(c).select("_c") for c in (F.col("_n") <= hot_rows, F.col("_n") > hot_rows))
        last = pick(named.join(usual, "_c", "left_semi"))
        if not hot.isEmpty():
            last = last.unionByName(_limits_by_ranges(named.join(F.broadcast(hot) if fits_broadcast(hot, 100_000) else hot, "_c", "left_semi").select("_c", "_q", "_o"), cap))
        last = staged(last, "cap-limits")
    limits = last.select("_c", "_tq", "_to", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("_s"))
    joined = rows.join(limits, (rows[contributor] == limits["_c"]) & (rows["_salt"] == limits["_s"]), "left")
    worse = (F.col("_q") < F.col("_tq")) | ((F.col("_q") == F.col("_tq")) & (F.col(order) > F.col("_to")))
    return joined.withColumn("over_cap", F.coalesce(worse, F.lit(False)) if cap > 0 else F.col(contributor).isNotNull()).drop("_q", "_salt", "_c", "_tq", "_to", "_s")


def cap_records(df: DataFrame, contributor: str, quality: str, order: str, cap: int | None = None, share: float | None = None) -> DataFrame:
    """The rows that stay below a maximum count, a maximum share, or both."""
    limits = [x for x in (cap, share_cap(df, contributor, share) if share is not None else None) if x is not None]
    if not limits:
        raise ValueError("a cap or a share is needed")
    return over_cap(df, contributor, quality, order, min(limits)).where("not over_cap").drop("over_cap")

"""Closed integer intervals: binned joins, clipping and as-of look-ups.

A pure range predicate makes Spark compare every pair. Here intervals are dealt to bins, joined on
equal (key, bin) and tested again, so both sides can be large; an overlap is reported in one bin only.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.operators.scans import carried, in_parts
from helixloom.sources.storage import stored

BIN = 1000
#: Bins of a level are so many times wider than those of the level below.
WIDER = 16
#: Levels, narrowest bins first; the last holds intervals of any length.
LEVELS = 7


def _level(length, bin_size: int):
    """The first level whose bins are at least as wide as the interval is long."""
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        out = F.when(length <= bin_size * WIDER**k, k).otherwise(out)
    return out


#: A side of at most so many rows is sent to all tasks (two bins on each level, whatever the other side holds).
FEW_ROWS = 10_000
#: A bin of more rows of one side is cut in slices of as many; with it, at most so many bins are cut.
HOT_ROWS, HOT_BINS = 4_000_000, 10_000


def _binned(df: DataFrame, st: str, ed: str, bin_size: int, own: list[int], others: list[int], mark: str) -> DataFrame:
    """A row for each bin in which it lies, two at most on a level: at its own level (one of ``own``), where it meets what is not longer, and at those above that the other side has."""
    level = _level(F.col(ed) - F.col(st) + 1, bin_size)
    div = lambda c, k: F.floor(F.col(c) / F.lit(bin_size * WIDER**k)).cast("long")
    spot = lambda k, b: F.struct(F.lit(k).alias("k"), b.alias("b"))
    rows = df.withColumn(mark, level)
    if own == [0] and st == ed:  # points: one bin on each level that the other side has
        spots = [spot(k, div(st, k)) for k in others]
        rows = rows.withColumn("_bin", spots[0] if len(spots) == 1 else F.explode(F.array(*spots)))
        return rows.withColumns({"_k": F.col("_bin.k"), "_b": F.col("_bin.b")}).drop("_bin")
    if len({*own, *others}) == 1 and own[0] < LEVELS - 1:  # one level: the bin of the start and, where that is another, of the end
        return rows.withColumns({"_k": F.lit(own[0]), "_b": F.explode(F.sequence(div(st, own[0]), div(ed, own[0])))})
    wanted = lambda k: F.col(mark) <= k if k in others else F.col(mark) == k
    spots, last = [], LEVELS - 1
    for k in sorted({*own, *others}):
        if k < last:
            spots += [F.when(wanted(k), spot(k, div(st, k))), F.when(wanted(k) & (div(st, k) != div(ed, k)), spot(k, div(ed, k)))]
    bins = F.array_compact(F.array(*spots)) if spots else F.array().cast("array<struct<k:int,b:bigint>>")
    if last in own or last in others:  # these may be longer than a bin
        bins = F.concat(bins, F.when(wanted(last), F.transform(F.sequence(div(st, last), div(ed, last)), lambda b: spot(last, b))).otherwise(F.array().cast("array<struct<k:int,b:bigint>>")))
    return rows.withColumn("_bin", F.explode(bins)).withColumns({"_k": F.col("_bin.k"), "_b": F.col("_bin.b")}).drop("_bin")


#: Groups, dealt by hash, in which rows are counted before single bins are.
GROUPS = 65_536


def _crowded(sides: list[tuple[DataFrame, str]], on: list[str], width: int, most: int) -> bool:
    """Whether a bin of at most ``width`` may hold more than ``most`` rows of a side (rows, their start), none of them longer than width.

    Such rows begin in the bin of that width around it or in the one before, so if no group of such bins has more than half of most, none does. Counting groups reads each row once, as it is, and shuffles GROUPS rows a task at most.
    """
    groups = [df.select(F.pmod(F.xxhash64(*on, F.floor(F.col(st) / width)), F.lit(GROUPS)).alias("g"), F.lit(i).alias("side")) for i, (df, st) in enumerate(sides)]
    sizes = functools.reduce(DataFrame.unionByName, groups).groupBy("g", "side").count()
    return bool(sizes.where(f"count > {most // 2}").limit(1).collect())


def _sliced(a: DataFrame, b: DataFrame, on: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with _s and _t: the rows of a bin that has more than ``most`` of a side are dealt to slices of that side, and each row meets all slices of the other."""
    place = [*on, "_k", "_b"]
    counts = a.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("m"))
    counts = counts.unionByName(b.groupBy(*place).agg(F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("m"))).where(f"n > {most} or m > {most}")
    hot = counts.groupBy(*place).agg(F.max("n").alias("n"), F.max("m").alias("m"))
    pieces = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / most)).cast("int")
    hot = F.broadcast(hot.select(*place, pieces("n").alias("_n"), pieces("m").alias("_m")))  # at most rows / most of them, see _meet

    def dealt(side: DataFrame, own: str, other: str, own_slice: str, other_slice: str) -> DataFrame:
        n, m = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        rows = side.join(hot, place, "left")
        spread = F.pmod(F.xxhash64(*[c for c in side.columns if c not in place]), n).cast("int")
        return rows.select(*side.columns, spread.alias(own_slice), F.explode(F.sequence(F.lit(0), m - 1)).alias(other_slice))

    return dealt(a, "_n", "_m", "_s", "_t"), dealt(b, "_m", "_n", "_t", "_s")


def _meet(a: DataFrame, b: DataFrame, on: list[str], a_ends: tuple[str, str], b_ends: tuple[str, str], bin_size: int = BIN, points: bool = False) -> DataFrame:
    """Pairs of rows with equal ``on`` whose closed intervals overlap; but for ``on`` the sides have no column in common.

    Bins come in levels, each WIDER times as wide, and a pair meets in a bin of the longer interval's level. One small aggregate of a side tells its levels and the number of its rows. A side of few rows, counted, is broadcast, and the
    other is read once. Else both (points only where they may be cut) are read for the levels and for the join, so costly ones should be stored tables; with more than HOT_ROWS, bins that hold more than HOT_ROWS of a side (or a HOT_BINS-th of all rows, so that the list of
    them stays short) are cut in slices where one count of rows, not of bins, leaves room for such a bin (_crowded), and neither an amplified locus nor a wide bin full of short rows is one task's.
    """
    every = list(range(LEVELS))

    def tally(df: DataFrame, ends: tuple[str, str]) -> tuple[list[int], int]:
        rows = df.groupBy(_level(F.col(ends[1]) - F.col(ends[0]) + 1, bin_size).alias("k")).count().collect()  # LEVELS rows at most
        return sorted(r["k"] for r in rows), sum(r["count"] for r in rows)

    place = [*on, "_k", "_b"]
    b_levels, b_rows = tally(b, b_ends)
    if not b_rows:
        b_levels = [0]
    if b_rows <= FEW_ROWS:
        a_own, a_levels, a_rows = ([0] if points else every), ([0] if points else every), None
    else:
        a_levels, a_rows = ([0], b_rows) if points else tally(a, a_ends)  # points are the shortest, and need no look
        a_own = a_levels
    most = max(HOT_ROWS, (a_rows + b_rows) // HOT_BINS) if a_rows is not None else 0
    wide = max(*a_levels, *b_levels)
    sliced = a_rows is not None and min(a_rows, b_rows) > FEW_ROWS and a_rows + b_rows > HOT_ROWS and (wide == LEVELS - 1 or _crowded([(a, a_ends[0]), (b, b_ends[0])], on, bin_size * WIDER**wide, most))
    a, b = _binned(a, *a_ends, bin_size, a_own, b_levels, "_x"), _binned(b, *b_ends, bin_size, b_levels, a_levels, "_y")
    if a_rows is None:
        b = F.broadcast(b)
    elif a_rows <= FEW_ROWS:
        a = F.broadcast(a)
    else:
        if sliced:
            a, b = _sliced(a, b, on, most)
            place += ["_s", "_t"]
        b = b.hint("merge")  # counted, and more than a few: no estimate from the size of files may broadcast it
    first = F.floor(F.greatest(a_ends[0], b_ends[0]) / (F.lit(bin_size) * F.pow(F.lit(float(WIDER)), F.col("_k")))).cast("long")
    overlap = (F.col(a_ends[0]) <= F.col(b_ends[1])) & (F.col(b_ends[0]) <= F.col(a_ends[1]))
    # most candidates fail the plain test of overlap, so the costlier one of bins comes last
    return a.join(b, place).where(overlap & (F.col("_k") == F.greatest("_x", "_y")) & (F.col("_b") == first)).drop("_k", "_b", "_x", "_y", "_s", "_t")


def interval_join(left: DataFrame, right: DataFrame, on: list[str], bin_size: int | None = None, how: str = "inner") -> DataFrame:
    """Pairs of rows with equal ``on`` and overlapping [st, ed]; right's st and ed come as r_st, r_ed. how: inner, left_semi (distinct rows of left).

    Any lengths and any crowding are fine (see _meet); bin_size sets the narrowest bins. A null st or ed overlaps nothing.
    """
    b = right.withColumnsRenamed({"st": "r_st", "ed": "r_ed"})
    hit = _meet(left, b, on, ("st", "ed"), ("r_st", "r_ed"), bin_size or BIN)
    return hit if how == "inner" else hit.select(*left.columns).distinct()


def point_join(points: DataFrame, intervals: DataFrame, on: list[str], pos: str = "pos", bin_size: int = BIN, how: str = "inner") -> DataFrame:
    """Points with the intervals that hold them, of whatever length; how: inner, or left (points without an interval stay once each, with nulls)."""
    rest = [c for c in intervals.columns if c not in on]
    b = intervals.withColumnsRenamed({c: f"_i_{c}" for c in rest})
    hit = _meet(points, b, on, (pos, pos), ("_i_st", "_i_ed"), bin_size, points=True)
    if how == "left":
        same = functools.reduce(operator.and_, [points[c].eqNullSafe(F.col(f"_p_{c}")) for c in points.columns])
        found = hit.select(*[F.col(c).alias(f"_p_{c}") for c in points.columns]).distinct()
        hit = hit.unionByName(points.join(found, same, "left_anti"), allowMissingColumns=True)
    return hit.select(*points.columns, *[F.col(f"_i_{c}").alias(c) for c in rest])


def clip(intervals: DataFrame, st, ed) -> DataFrame:
    """Intersect with [st, ed] (columns or values); what is left empty goes."""
    st, ed = (x if hasattr(x, "alias") else F.lit(x) for x in (st, ed))
    return intervals.withColumns({"st": F.greatest("st", st), "ed": F.least("ed", ed)}).where("st <= ed")


def nearest_key(queries: DataFrame, keys: DataFrame, on: list[str], key: str = "len", payload: str = "val") -> DataFrame:
    """Each query's (``q``) nearest key: the exact one, else the nearest; a tie goes to the smaller, beyond the end to the largest; null where ``on`` has no keys at all.

    A union along which the last and the next key are carried, instead of an inequality join: linear in both sides, and a frequent ``on`` is spread over many tasks.
    """
    cols = [*on, F.col(key).alias("_k"), F.lit(0).alias("_q"), F.struct(F.col(key).alias("_key"), F.col(payload).alias("_val")).alias("_pair")]
    both = keys.select(*cols)
    asked = queries.select(*on, F.col("q").alias("_k")).distinct().select(*on, "_k", F.lit(1).alias("_q"), F.lit(None).cast(both.schema["_pair"].dataType).alias("_pair"))
    cut = in_parts(stored(both.unionByName(asked), "look-ups"), on, "_k")
    both = carried(carried(cut, on, "_k", "_q", "_pair", "lo"), on, "_k", "_q", "_pair", "hi", ahead=True).where("_q = 1")
    lower = F.col("hi").isNull() | (F.col("lo").isNotNull() & (F.col("_k") - F.col("lo._key") <= F.col("hi._key") - F.col("_k")))
    best = F.when(lower, F.col("lo")).otherwise(F.col("hi"))
    return both.select(*on, F.col("_k").alias("q"), best["_key"].alias(key), best["_val"].alias(payload))

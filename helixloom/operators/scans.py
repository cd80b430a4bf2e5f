"""Running sums and carried values along an order, where one key may hold most rows.

A key's rows are cut, in order, into parts by its own approximate quantiles. Windows run inside parts; what goes from one part to the next is one row a part, so no task sorts a whole key.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a key, and copies of its cut points, over which its rows are dealt while they look these up.
PARTS, SALTS = 128, 16


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys meet each other; right's keys go."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = functools.reduce(operator.and_, [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys])
    return left.join(other, cond, how).drop(*[f"_r_{k}" for k in keys])


def in_parts(rows: DataFrame, keys: list[str], by: str, parts: int = PARTS) -> DataFrame:
    """rows with _part, which rises with ``by`` (a number) within keys; equal values share a part."""
    cuts = rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(by, [(i + 1) / parts for i in range(parts - 1)], 50 * parts)).alias("_cuts"))
    cuts = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    part = F.size(F.filter("_cuts", lambda c: c < F.col(by)))
    return join_on(dealt, cuts, [*keys, "_salt"]).withColumn("_part", part).drop("_salt", "_cuts")


def running_total(rows: DataFrame, keys: list[str], by: str, value: str, parts: int = PARTS) -> DataFrame:
    """rows, whose ``by`` differ within keys, with _upto: the sum of value up to the row, and _total: that of all rows of the keys."""
    cut = in_parts(rows, keys, by, parts)
    line = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    sums = sums.select(*keys, "_part", F.coalesce(F.sum("_sum").over(line), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy(*keys)).alias("_total"))
    inside = Window.partitionBy(*keys, "_part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return join_on(cut, sums, [*keys, "_part"]).select(*rows.columns, (F.col("_before") + F.sum(value).over(inside)).alias("_upto"), "_total")


def carried(cut: DataFrame, keys: list[str], by: str, tie: str, value: str, name: str, ahead: bool = False) -> DataFrame:
    """Rows from in_parts with ``name``: the last value that is not null, up to the row in order of (by, tie); with ahead the next one, in order of (falling by, tie)."""
    order = [F.desc(by) if ahead else F.asc(by), F.col(tie)]
    place = F.when(F.col(value).isNotNull(), F.struct(F.col(by), F.col(tie)))
    best = F.min_by(value, place) if ahead else F.max_by(value, place)
    line = Window.partitionBy(*keys).orderBy(F.desc("_part") if ahead else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy(*keys, "_part").agg(best.alias("_end"))
    ends = ends.select(*keys, "_part", F.last("_end", True).over(line).alias("_come"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return join_on(cut, ends, [*keys, "_part"]).select(*cut.columns, F.coalesce(F.last(value, True).over(inside), "_come").alias(name))

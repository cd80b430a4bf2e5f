"""Empirical length distributions and look-ups in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixloom.operators.intervals import nearest_key
from helixloom.operators.scans import carried, in_parts, join_on, running_total
from helixloom.sources.storage import stored


def ecdf(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """keys, len, cnt, prob: cumulative probability up to each length, six digits. Rows (keys.., len, cnt) of one length add up."""
    rows = stored(lengths.groupBy(*keys, "len").agg(F.sum("cnt").alias("cnt")), "lengths")
    return running_total(rows, keys, "len", "cnt").select(*keys, "len", "cnt", F.round(F.col("_upto") / F.col("_total"), 6).alias("prob"))


def ratio_profile(ratios: DataFrame, keys: list[str]) -> DataFrame:
    """keys, len, ratio, weight: how often each cover ratio stands among at most 100 draws of its length."""
    total = F.sum("cnt").over(Window.partitionBy(*keys, "len"))
    weight = F.floor(F.col("cnt") * F.least(total, F.lit(100)) / total)
    return ratios.select(*keys, "len", "ratio", weight.cast("long").alias("weight"))


def quantile_grid(cdf: DataFrame, keys: list[str], bins: int = 10_000) -> DataFrame:
    """keys, bin, len: for each probability bin its smallest length; a gap takes the bin before it, the head the first filled bin."""
    have = cdf.select(*keys, F.floor(F.col("prob") * bins + 1e-9).cast("long").alias("bin"), "len").groupBy(*keys, "bin").agg(F.min("len").alias("len"))
    grid = cdf.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins).cast("long"))))
    w = Window.partitionBy(*keys).orderBy("bin")
    both = grid.join(have, [*keys, "bin"], "left")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    first = F.first("len", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return both.select(*keys, "bin", F.coalesce(F.last("len", True).over(back), first).alias("len"))


def nearest_length(queries: DataFrame, table: DataFrame, keys: list[str], payload: str) -> DataFrame:
    return nearest_key(queries, table, keys, "len", payload)


def mass_between(spans: DataFrame, cdf: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lo, hi, mass: probability from the last length <= lo (0 without one) to the first length >= hi (1 without one); 1000 / lo where keys have
    no distribution. As-of look-ups by a union and carried values, no range join."""
    have = cdf.select(*keys, F.col("len").alias("x"), F.col("prob").cast("double").alias("p"), F.lit(0).alias("q"))

    def ask(c: str, ahead: bool) -> DataFrame:
        asked = spans.select(*keys, F.col(c).alias("x")).distinct().select(*keys, "x", F.lit(None).cast("double").alias("p"), F.lit(1).alias("q"))
        cut = in_parts(stored(have.unionByName(asked), "look-ups"), keys, "x")
        return carried(cut, keys, "x", "q", "p", f"p{c}", ahead).where("q = 1").select(*keys, F.col("x").alias(c), f"p{c}")

    known = cdf.select(*keys).distinct().withColumn("_known", F.lit(True))
    out = join_on(join_on(join_on(spans, ask("lo", False), [*keys, "lo"], "left"), ask("hi", True), [*keys, "hi"], "left"), known, keys, "left")
    mass = F.coalesce("phi", F.lit(1.0)) - F.coalesce("plo", F.lit(0.0))
    return out.select(*keys, "lo", "hi", F.when(F.col("_known"), mass).otherwise(F.expr("try_divide(1000D, lo)")).alias("mass"))

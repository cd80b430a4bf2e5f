"""Combinations of walks, their expected links, and their rank by correlation with observed links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixloom.operators.scans import join_on, running_total
from helixloom.sources.storage import stored


#: Combinations that one row is unfolded to at a time.
RANGE = 1 << 16


def _unfolded(walks: DataFrame, most: int | None = None) -> DataFrame:
    """sample, group_id, solution, block, combo, cut, allele, walk: a row for each allele of each combination, walk holding what its row of walks has.

    A solution's walks are one row, sent once to each range of its numbers, so nothing is looked up for single combinations and they meet no shuffle; they lie by solution and block.
    """
    sol = ["sample", "group_id", "solution"]
    held = F.array_sort(F.collect_list(F.struct("map_no", *[c for c in walks.columns if c not in (*sol, "allele", "map_no")])))
    per = walks.dropna(subset=[*sol, "allele"]).groupBy(*sol, "allele").agg(F.count(F.lit(1)).alias("n"), held.alias("walks"))
    before = Window.partitionBy(*sol).orderBy("allele").rowsBetween(Window.unboundedPreceding, -1)
    times = F.aggregate(F.collect_list("n").over(before), F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))
    per = per.select(*sol, "allele", "n", "walks", times.alias("stride"))
    digits = F.collect_list(F.struct("allele", "n", F.col("stride").alias("stride"), "walks"))
    total = per.groupBy(*sol).agg(F.max(F.col("stride") * F.col("n")).alias("total"), digits.alias("digits"))
    wanted = F.col("total") if most is None else F.least(F.col("total"), F.lit(most).cast("decimal(38,0)"))
    fits = F.when(wanted <= 1 << 62, wanted.cast("long")).otherwise(F.raise_error(F.lit("a solution has more than 2 ** 62 combinations")).cast("long"))
    many = total.select(*sol, "digits", (F.col("total") > wanted).alias("cut"), fits.alias("many"))
    blocks = many.select(*sol, "digits", "cut", "many", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(many - 1) div {RANGE}"))).alias("block"))
    blocks = blocks.repartition(*sol, "block")
    combos = blocks.select(*sol, "block", "digits", "cut", F.explode(F.sequence(F.col("block") * RANGE, F.least((F.col("block") + 1) * RANGE, "many") - 1)).alias("combo"))
    picked = combos.select(*sol, "block", "cut", "combo", F.explode("digits").alias("d"))
    return picked.select(*sol, "block", "combo", "cut", F.col("d.allele").alias("allele"), F.expr("get(d.walks, cast(combo div cast(d.stride as bigint) % d.n as int))").alias("walk"))


def walk_combinations(walks: DataFrame, most: int | None = None) -> DataFrame:
    """sample, group_id, solution, combo, allele, map_no: every way to take one walk of each allele.

    A combination's number is read as digits, one for each allele, so combinations are made by a sequence and arithmetic, not by cross joins. Numbers are dealt in
    ranges of RANGE, which many tasks unfold, so a solution may have any number up to 2 ** 62 (beyond that an error is raised). With ``most``, a solution that has more (the product of its walks)
    gets its first ``most`` and ``cut`` is true; without it all are made.
    """
    sol = ["sample", "group_id", "solution"]
    return _unfolded(walks.select(*sol, "allele", "map_no"), most).select(*sol, "combo", "allele", F.col("walk.map_no").alias("map_no"), "cut")


def combination_names(combos: DataFrame) -> DataFrame:
    """sample, group_id, solution, combo, name: ``AL1.LM2,AL2.LM1``, the walk of each allele in order."""
    part = F.transform(F.array_sort(F.collect_list(F.struct("allele", "map_no"))), lambda x: F.concat(F.lit("AL"), x["allele"].cast("string"), F.lit(".LM"), x["map_no"].cast("string")))
    return combos.groupBy("sample", "group_id", "solution", "combo").agg(F.array_join(part, ",").alias("name"))


def combination_weights(combos: DataFrame, alleles: DataFrame) -> DataFrame:
    """combos with weight = length * allele CN over the sum for the solution, which uses each allele's first walk.

    alleles: sample, group_id, solution, allele, map_no, length, cn."""
    sol = ["sample", "group_id", "solution"]
    first = alleles.groupBy(*sol, "allele").agg(F.min_by(F.col("length") * F.col("cn"), "map_no").alias("v"))
    total = first.groupBy(*sol).agg(F.sum("v").alias("total"))
    return combos.join(alleles, [*sol, "allele", "map_no"]).join(total, sol).withColumn("weight", F.expr("try_divide(length * cn, total)")).drop("total", "length", "cn")


def expected_links(weighted: DataFrame, links: DataFrame) -> DataFrame:
    """sample, group_id, solution, combo, pair_id, expected: sum over alleles of round(links * weight, 2); links: .., allele, map_no, pair_id, links."""
    sol = ["sample", "group_id", "solution"]
    both = weighted.join(links, [*sol, "allele", "map_no"])
    return both.groupBy(*sol, "combo", "pair_id").agg(F.round(F.sum(F.round(F.col("links") * F.col("weight"), 2)), 2).alias("expected"))


def combination_links(alleles: DataFrame, links: DataFrame) -> DataFrame:
    """sample, group_id, solution, block, combo, pair_id, expected: expected_links of all combinations of the walks in alleles (as for combination_weights).

    What a walk gives to a pair does not depend on its combination, so it is weighted and rounded once, before combinations are made. These are added up where they are unfolded;
    grouping by solution, block and combo needs no shuffle either (block: the range of the combination's number).
    """
    sol = ["sample", "group_id", "solution"]
    first = alleles.groupBy(*sol, "allele").agg(F.min_by(F.col("length") * F.col("cn"), "map_no").alias("v"))
    weight = alleles.join(first.groupBy(*sol).agg(F.sum("v").alias("total")), sol).select(*sol, "allele", "map_no", F.expr("try_divide(length * cn, total)").alias("weight"))
    gives = weight.join(links, [*sol, "allele", "map_no"]).groupBy(*sol, "allele", "map_no")
    gives = gives.agg(F.collect_list(F.struct("pair_id", F.round(F.col("links") * F.col("weight"), 2).alias("share"))).alias("gives"))
    walks = alleles.select(*sol, "allele", "map_no").join(gives, [*sol, "allele", "map_no"], "left")
    each = _unfolded(walks).select(*sol, "block", "combo", F.explode("walk.gives").alias("g"))
    return each.groupBy(*sol, "block", "combo", F.col("g.pair_id").alias("pair_id")).agg(F.round(F.sum("g.share"), 2).alias("expected"))


def average_ranks(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with each column as its rank within keys, ties at their mean: a value's rows are counted once, and the counts run on over parts of a key."""
    for c in columns:
        counts = stored(rows.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_cnt")), "values")
        ranks = running_total(counts, keys, c, "_cnt").select(*keys, c, (F.col("_upto") - (F.col("_cnt") - 1) / 2).alias("_rank"))
        rows = join_on(rows, ranks, [*keys, c]).drop(c).withColumnRenamed("_rank", c)
    return rows


def correlation(rows: DataFrame, keys: list[str], a: str = "a", b: str = "b", method: str = "pearson") -> DataFrame:
    """keys, n, corr (9 digits): null where a side has one value only. spearman correlates average ranks."""
    if method == "spearman":
        rows = average_ranks(stored(rows.select(*keys, a, b), "pairs"), keys, [a, b])
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    r = F.when(varied, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(r, 9).alias("corr"))


def rank_combinations(scored: DataFrame, keys: list[str], combo: str = "combo", best: int | None = None) -> DataFrame:
    """scored with place: falling correlation, undefined last, ties by id. With ``best`` the first so many of each key, which tasks choose before they meet."""
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("corr").desc_nulls_last(), combo)))
    return ranked if best is None else ranked.where(F.col("place") <= best)

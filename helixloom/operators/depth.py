"""Depth: coverage of intervals, piecewise windows, robust window means, admixture arithmetic.

Definitions that the literature leaves open (window numbers, trimming, smoothing across breakpoints) are this library's
own and stand in the docstrings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixloom.operators.intervals import interval_join, point_join
from helixloom.sources.storage import stored

#: Control depth of a baseline region up to which no ratio is defined.
LEAST_BASELINE_DEPTH = 5.0


#: Width of the bins in which coverage is summed up.
COVERAGE_BIN = 16_384


def coverage(intervals: DataFrame, keys: list[str], min_baseq: int = 5, min_mapq: int = 10, bin_size: int = COVERAGE_BIN) -> DataFrame:
    """keys, st, ed, depth: maximal runs of equal depth (above zero) of intervals that pass both quality cut-offs.

    Starts and ends add up within bins first; a bin's depth at its start is a running sum over one row a bin, so no
    window holds more than a bin's positions, however long a reference is. That depth stands in front of its bin's
    positions as a row of their own, so positions are shuffled to bins and sorted once and never joined.
    """
    good = intervals.where(f"baseq >= {min_baseq} and mapq >= {min_mapq} and st <= ed")
    change = F.explode(F.array(F.struct(F.col("st").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("ed") + 1).alias("pos"), F.lit(-1).alias("d"))))
    steps = good.select(*keys, change.alias("c")).groupBy(*keys, "c.pos").agg(F.sum("c.d").alias("d")).where("d <> 0")
    steps = steps.withColumn("bin", F.expr(f"pos div {bin_size}"))
    bins = steps.groupBy(*keys, "bin").agg(F.sum("d").alias("t"), F.min("pos").alias("p0"))
    order = Window.partitionBy(*keys).orderBy("bin")
    before = F.coalesce(F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = bins.select(*keys, "bin", F.lit(None).cast("long").alias("pos"), before.alias("d"), F.lead("p0").over(order).alias("next_pos"))
    inside = Window.partitionBy(*keys, "bin").orderBy(F.col("pos").asc_nulls_first())
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.select(*keys, "bin", F.col("pos").cast("long").alias("pos"), "d", F.lit(None).cast("long").alias("next_pos")).unionByName(heads)
    runs = rows.select(*keys, F.col("pos").alias("st"), (F.coalesce(F.lead("pos").over(inside), F.first("next_pos").over(upto)) - 1).alias("ed"), F.sum("d").over(upto).alias("depth"))
    return runs.where("st is not null and depth > 0")


def positions(runs: DataFrame) -> DataFrame:
    """Runs spread to one row a position (pos, depth as double); for small regions only, the operators below work on runs."""
    rest = [c for c in runs.columns if c not in ("st", "ed", "depth")]
    return runs.select(*rest, F.explode(F.sequence("st", "ed")).alias("pos"), F.col("depth").cast("double").alias("depth"))


def window_layout(resol: DataFrame) -> DataFrame:
    """resol rows (refseg, st, ed, res) with ``before``: the number of windows of earlier rows. A row has ceil(length / res) windows."""
    n = F.ceil((F.col("ed") - F.col("st") + 1) / F.col("res"))
    earlier = Window.partitionBy("refseg").orderBy("st").rowsBetween(Window.unboundedPreceding, -1)
    return resol.select("refseg", "st", "ed", "res", n.alias("n"), F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias("before"))


def assign_windows(points: DataFrame, resol: DataFrame) -> DataFrame:
    """points with win (from 1), win_st, win_ed and res of the window that holds them; points outside go."""
    hit = points.join(window_layout(resol), "refseg").where("pos between st and ed")
    k = F.expr("(pos - st) div res")
    return hit.select(
        *points.columns, (F.col("before") + k + 1).alias("win"), (F.col("st") + k * F.col("res")).alias("win_st"),
        F.least(F.col("st") + (k + 1) * F.col("res") - 1, "ed").alias("win_ed"), "res",
    )


def cut_windows(runs: DataFrame, resol: DataFrame) -> DataFrame:
    """runs cut at the borders of windows: each piece with win, win_st, win_ed and res of its window. What lies outside the layout goes. Bases are never
    spread: a run gives as many rows as windows that it touches."""
    rest = [c for c in runs.columns if c not in ("st", "ed")]
    lay = window_layout(resol).select("refseg", F.col("st").alias("l_st"), F.col("ed").alias("l_ed"), "res", "before")
    hit = runs.join(lay, "refseg").where("st <= l_ed and l_st <= ed")
    k = F.explode(F.sequence(F.expr("(greatest(st, l_st) - l_st) div res"), F.expr("(least(ed, l_ed) - l_st) div res"))).alias("k")
    hit = hit.select("*", k).select("*", F.expr("l_st + k * res").alias("win_st"), F.expr("least(l_st + (k + 1) * res - 1, l_ed)").alias("win_ed"))
    return hit.select(*rest, F.greatest("st", "win_st").alias("st"), F.least("ed", "win_ed").alias("ed"), F.expr("before + k + 1").alias("win"), "win_st", "win_ed", "res")


def windows_of(resol: DataFrame) -> DataFrame:
    """Every window of the layout: refseg, win, st, ed, res."""
    lay = window_layout(resol).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    return lay.select("refseg", (F.col("before") + F.col("k") + 1).alias("win"), (F.col("st") + F.col("k") * F.col("res")).alias("st"), F.least(F.col("st") + (F.col("k") + 1) * F.col("res") - 1, "ed").alias("ed"), "res")


def auto_resolution(region: DataFrame, pixels: int) -> DataFrame:
    """refseg, res: the resolution at which all of a reference's regions take ``pixels`` windows."""
    return region.groupBy("refseg").agg(F.ceil(F.sum(F.col("ed") - F.col("st") + 1) / pixels).alias("res"))


#: Width of the bins in which runs meet ranges.
RANGE_BIN = 4096


def prior_ratio(runs: DataFrame, ranges: DataFrame, bin_size: int = RANGE_BIN) -> DataFrame:
    """runs cut at the borders of ranges (refseg, st, ed, ratio; those of a reference must not overlap), with ratio: the known copy ratio inside, 1 elsewhere.

    Runs and ranges are cut at the borders of bins too, and a bin's ranges, fewer than its bases, come to each of its runs as one sorted array, of which the gaps follow. Any number of ranges may lie on a reference.
    """
    rest = [c for c in runs.columns if c not in ("st", "ed")]

    def cut(df: DataFrame) -> DataFrame:
        rows = df.withColumn("_bin", F.explode(F.sequence(F.expr(f"st div {bin_size}"), F.expr(f"ed div {bin_size}"))))
        return rows.withColumns({"st": F.greatest("st", F.col("_bin") * bin_size), "ed": F.least("ed", (F.col("_bin") + 1) * bin_size - 1)})

    lists = cut(ranges).groupBy("refseg", "_bin").agg(F.array_sort(F.collect_list(F.struct("st", "ed", "ratio"))).alias("ranges"))
    met = cut(runs).join(lists, ["refseg", "_bin"], "left")
    met = met.select(*rest, "st", "ed", F.filter(F.coalesce("ranges", F.expr("array()").cast("array<struct<st:bigint,ed:bigint,ratio:double>>")), lambda r: (r["st"] <= F.col("ed")) & (r["ed"] >= F.col("st"))).alias("r"))
    known = F.transform("r", lambda r: F.struct(F.greatest(r["st"], F.col("st")).alias("st"), F.least(r["ed"], F.col("ed")).alias("ed"), r["ratio"].alias("ratio")))
    gap = F.transform(
        F.sequence(F.lit(0), F.size("r")),
        lambda i: F.struct(
            F.when(i == 0, F.col("st")).otherwise(F.get("r", i - 1)["ed"] + 1).alias("st"), F.when(i == F.size("r"), F.col("ed")).otherwise(F.get("r", i)["st"] - 1).alias("ed"), F.lit(1.0).alias("ratio")
        ),
    )
    pieces = F.explode(F.filter(F.concat(known, gap), lambda p: p["st"] <= p["ed"])).alias("p")
    return met.select(*rest, pieces).select(*rest, "p.st", "p.ed", "p.ratio")


def stable_positions(runs: DataFrame, ranges: DataFrame, mean: float, tolerance: float, keys: list[str] | None = None) -> DataFrame:
    """keys, st, ed: stretches of the control whose depth lies in mean * (1 -+ tolerance) * ratio, both ends included. keys (sample and refseg) say whose control it is."""
    ctrl = prior_ratio(runs.where("tissue = 'ctrl'"), ranges)
    return ctrl.where(f"depth between {mean} * (1 - {tolerance}) * ratio and {mean} * (1 + {tolerance}) * ratio").select(*(keys or ["sample", "refseg"]), "st", "ed")


def keep_stable(pieces: DataFrame, stable: DataFrame, from_res: int = 10, keys: list[str] | None = None) -> DataFrame:
    """The parts of both tissues' pieces that are stable in their sample, and all of windows finer than from_res."""
    pieces = stored(pieces, "pieces")  # the coarse ones are read for their lengths and for the join, the others once
    coarse = interval_join(pieces.where(f"res >= {from_res}"), stored(stable, "stable"), keys or ["sample", "refseg"])
    coarse = coarse.withColumns({"st": F.greatest("st", "r_st"), "ed": F.least("ed", "r_ed")}).select(*pieces.columns)
    return coarse.unionByName(pieces.where(f"res < {from_res}"))


def window_mean(pieces: DataFrame, keys: list[str], mode: str = "plain", trim: float = 0.0) -> DataFrame:
    """keys, mean, n (bases) of pieces of even depth, each weighted by its length. plain: all bases; trim: floor(|t| * n) bases go at both ends, or for t < 0 at
    the high end only; sd3: bases within mean -+ 3 population standard deviations, no trimming. Sums stay exact for whole depths.

    Pieces go to their window once, and equal depths need not meet first: pieces of runs do not overlap, so a window has no more of them than bases."""
    rows = pieces.select(*keys, F.col("depth").cast("double").alias("depth"), (F.col("ed") - F.col("st") + 1).alias("_w"))
    part = Window.partitionBy(*keys)
    if mode == "trim" and trim:
        upto = F.sum("_w").over(part.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.select("*", upto.alias("_u"), F.sum("_w").over(part).alias("_n"))
        cut = F.floor(F.col("_n") * abs(trim))
        low = cut if trim > 0 else F.lit(0)
        rows = rows.withColumn("_w", F.least("_u", F.col("_n") - cut) - F.greatest(F.col("_u") - F.col("_w"), low)).where("_w > 0")
    elif mode == "sd3":
        n, total, squares = (F.sum(x).over(part) for x in (F.col("_w"), F.col("_w") * F.col("depth"), F.col("_w") * F.col("depth") * F.col("depth")))
        rows = rows.select("*", n.alias("_n"), total.alias("_t"), squares.alias("_q"))
        sd = F.sqrt(F.greatest(F.lit(0.0), F.col("_n") * F.col("_q") - F.col("_t") * F.col("_t"))) / F.col("_n")
        rows = rows.where(F.abs(F.col("depth") - F.col("_t") / F.col("_n")) <= 3 * F.round(sd, 9) + 1e-9)
    return rows.groupBy(*keys).agg((F.sum(F.col("_w") * F.col("depth")) / F.sum("_w")).alias("mean"), F.sum("_w").alias("n"))


def admixture(purity: Column, ploidy_t: Column, ploidy_n: Column) -> dict[str, Column]:
    """Tumour and normal parts of the mixed DNA and their ratios; zero or missing purity counts as 1, ploidy as 2."""
    p = F.coalesce(F.nullif(purity, F.lit(0.0)), F.lit(1.0))
    t = p * F.coalesce(F.nullif(ploidy_t, F.lit(0.0)), F.lit(2.0))
    n = (1 - p) * F.coalesce(F.nullif(ploidy_n, F.lit(0.0)), F.lit(2.0))
    return {"t_part": t, "n_part": n, "t_ratio": t / (t + n), "n_ratio": n / (t + n)}


def subtract_admixture(count: Column, mean: Column, n_ratio: Column, copy_ratio: Column) -> Column:
    """What is left of a count without the admixed normal cells."""
    return count - mean * n_ratio * copy_ratio


def single_copy_depth(mean: Column, purity: Column, ploidy_t: Column, ploidy_n: Column) -> Column:
    a = admixture(purity, ploidy_t, ploidy_n)
    return mean / (a["t_part"] + a["n_part"])


def sample_cn_ratio(mean: Column, purity: Column, ploidy_t: Column, ploidy_n: Column) -> Column:
    """Copies for each unit of pure depth: 1 / purity / depth of a single copy."""
    p = F.coalesce(F.nullif(purity, F.lit(0.0)), F.lit(1.0))
    return F.lit(1.0) / p / single_copy_depth(mean, purity, ploidy_t, ploidy_n)


def adjust_depth(means: DataFrame, facts: DataFrame, ratio: str | None = None) -> DataFrame:
    """means (sample, tissue, mean) with ``adj``: the case without its normal part, the control at the tumour-equivalent level. facts has one row a sample: mean_case,
    mean_ctrl, purity, ploidy_t, ploidy_n. Without a case mean (or facts) nothing changes."""
    a = admixture(F.col("purity"), F.col("ploidy_t"), F.col("ploidy_n"))
    prior = F.col(ratio) if ratio else F.lit(1.0)
    case = subtract_admixture(F.col("mean"), F.col("mean_case"), a["n_ratio"], prior)
    ctrl = F.col("mean") * F.col("mean_case") * a["t_ratio"] / F.col("mean_ctrl")
    both = means.join(facts.select("sample", "mean_case", "mean_ctrl", "purity", "ploidy_t", "ploidy_n"), "sample", "left")
    adj = F.when(F.col("mean_case").isNull(), F.col("mean")).when(F.col("tissue") == "case", case).otherwise(ctrl)
    return both.select(*means.columns, adj.alias("adj"))


#: Windows that one task smooths together.
SMOOTH_WINDOWS = 4096


def smooth(windows: DataFrame, breaks: DataFrame, k: int = 2, value: str = "adj", block: int = SMOOTH_WINDOWS) -> DataFrame:
    """windows (sample, tissue, refseg, win) with ``show``: the mean over the windows at most k away that lie in the same stretch between
    the sample's breakpoint windows (sample, refseg, win); a breakpoint window begins a stretch. k = 0 leaves values as they are.

    Blocks of windows, with the k next ones on either side, are smoothed on their own, so that no task holds a whole reference.
    """
    if k == 0:
        return windows.withColumn("show", F.col(value))
    keys = ["sample", "tissue", "refseg"]
    spots = breaks.select("sample", "refseg", "win").distinct().withColumn("_b", F.lit(1))
    marked = windows.join(spots, ["sample", "refseg", "win"], "left")
    own = F.expr(f"win div {block}")
    marked = marked.select("*", own.alias("_own"), F.explode(F.array_distinct(F.array(F.expr(f"(win - {k}) div {block}"), own, F.expr(f"(win + {k}) div {block}")))).alias("_block"))
    line = Window.partitionBy(*keys, "_block").orderBy("win").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("barrier", F.sum(F.coalesce("_b", F.lit(0))).over(line))
    near = Window.partitionBy(*keys, "_block", "barrier").orderBy("win").rangeBetween(-k, k)
    return marked.withColumn("show", F.avg(value).over(near)).where("_own = _block").select(*windows.columns, "show")


def depth_extent(windows: DataFrame, value: str = "show", keys: list[str] | None = None) -> DataFrame:
    return windows.groupBy(*(keys or ["sample", "tissue", "refseg"])).agg(F.max(value).alias("max_depth"), F.max("win").alias("max_win"))


def baseline_cn_ratio(windows: DataFrame, baseline: DataFrame, breakpoints: DataFrame, least: float = LEAST_BASELINE_DEPTH) -> DataFrame:
    """sample, refseg, depth, ratio: copies for each unit of depth from a baseline (sample, refseg, st, ed, cn, tissue) that holds no breakpoint of its sample
    (sample, refseg, pos) strictly inside. cn missing or up to 0.5 counts as 2; a depth up to ``least`` gives no ratio. A tissue that is not given is the control of samples that have one, else the case;
    a baseline without windows has neither depth nor ratio."""
    on = ["sample", "refseg"]
    cut = point_join(breakpoints.select(*on, "pos"), baseline.select(*on, "st", "ed"), on).where("pos > st and pos < ed").select(*on, "st", "ed").distinct()
    controls = windows.where("tissue = 'ctrl'").select("sample").distinct().withColumn("_own", F.lit("ctrl"))
    base = baseline.join(cut, [*on, "st", "ed"], "left_anti").join(controls, "sample", "left").withColumn("tissue", F.coalesce("tissue", "_own", F.lit("case"))).drop("_own")
    base = stored(base.select(*on, "st", "ed", "cn", "tissue"), "baselines")
    hit = interval_join(stored(windows.select(*on, "tissue", "st", "ed", "adj"), "baseline-windows"), base, [*on, "tissue"])
    mean = hit.groupBy(*on, "tissue", F.col("r_st").alias("st"), F.col("r_ed").alias("ed")).agg(F.avg("adj").alias("depth"))
    both = base.join(mean, [*on, "tissue", "st", "ed"], "left")
    cn = F.when(F.col("cn") > 0.5, F.col("cn")).otherwise(F.lit(2.0))
    return both.select(*on, "depth", F.when(F.col("depth") > least, cn / F.col("depth")).alias("ratio"))

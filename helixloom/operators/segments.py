"""Breakpoints, segmentation and copy-number tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixloom.operators.cycles import shared_keys
from helixloom.operators.depth import subtract_admixture
from helixloom.operators.intervals import interval_join, point_join
from helixloom.sources.storage import stored



def two_digits(x):
    """Rounded to two digits, halves away from zero, as the double stands."""
    return F.signum(x) * F.floor(F.abs(x) * 100 + 0.5) / 100


def mean_two_digits(column):
    """The mean, rounded to two digits with halves away from zero. Values are summed as whole millionths, so that neither order nor partitions show."""
    total, n = F.sum(F.round(F.col(column) * 1_000_000).cast("long")), F.count(column)
    whole = F.floor(F.try_divide((2 * F.abs(total) + n * 10_000).cast("decimal(38,0)"), (2 * n * 10_000).cast("decimal(38,0)"))).cast("double")
    return F.signum(total) * whole / 100


def breakends(junctions: DataFrame, region: DataFrame | None = None) -> DataFrame:
    """sample, junc_no, side, refseg, pos, strd: two rows for each junction; with a region (refseg, st, ed) only those inside."""
    sides = F.explode(F.array(*[
        F.struct(F.lit(s).alias("side"), F.col(f"refseg_{s}").alias("refseg"), F.col(f"bkpos_{s}").alias("pos"), F.col(f"strd_{s}").alias("strd")) for s in ("5p", "3p")
    ]))
    ends = junctions.select("sample", "junc_no", sides.alias("e")).select("sample", "junc_no", "e.*")
    if region is None:
        return ends
    return point_join(ends, region.select("refseg", "st", "ed"), ["refseg"]).drop("st", "ed")


#: Width of the bins in which a junction's ends look up the region.
REGION_BIN = 65_536


def classify_junctions(junctions: DataFrame, region: DataFrame) -> DataFrame:
    """junctions with kind: intra-SV if both ends lie in the region, else inter-SV/vitg; those with no end inside go.

    A bin's regions come as one list, so both ends are looked up in the junction's own row and nothing is grouped or joined again by junction.
    """
    spots = region.where("st <= ed").select("refseg", "st", "ed", F.explode(F.sequence(F.floor(F.col("st") / REGION_BIN), F.floor(F.col("ed") / REGION_BIN))).alias("_bin"))
    lists = spots.groupBy("refseg", "_bin").agg(F.collect_set(F.struct("st", "ed")).alias("_spots"))
    rows = junctions
    for side in ("5p", "3p"):
        pos = F.col(f"bkpos_{side}")
        rows = rows.withColumn("_bin", F.floor(pos / REGION_BIN)).join(lists.withColumnRenamed("refseg", f"refseg_{side}"), [f"refseg_{side}", "_bin"], "left")
        hit = F.coalesce(F.exists("_spots", lambda r: pos.between(r["st"], r["ed"])), F.lit(False))  # noqa: B023
        rows = rows.withColumn(f"_in_{side}", hit).drop("_bin", "_spots")
    rows = rows.where("_in_5p or _in_3p")
    return rows.select(*junctions.columns, F.when(F.expr("_in_5p and _in_3p"), "intra-SV").otherwise("inter-SV/vitg").alias("kind"))


def breakpoint_windows(ends_in_windows: DataFrame) -> DataFrame:
    """sample, refseg, win, pos: one breakpoint for each window, that of the last junction (3' after 5')."""
    order = F.struct("junc_no", F.when(F.col("side") == "3p", 1).otherwise(0), "pos")
    return ends_in_windows.groupBy("sample", "refseg", "win").agg(F.max_by("pos", order).alias("pos"))


def segment_by_breakends(region: DataFrame, ends: DataFrame) -> DataFrame:
    """sample, refseg, seg_no, st, ed: the region cut at breakends. (5', +) and (3', -) end a segment at pos, the other two
    at pos - 1; the region's end closes the last; segments are numbered from left to right. A reference on which a sample has no
    breakend gives no segment of that sample."""
    shift = F.when((F.col("side") == "5p") == (F.col("strd") == "+"), F.col("pos")).otherwise(F.col("pos") - 1)
    cuts = ends.select("sample", "refseg", shift.alias("cut")).join(region.select("refseg", F.col("st").alias("r_st"), F.col("ed").alias("r_ed")), "refseg")
    # an end gives its own cut and the region's, so ends are made and read once
    both = F.explode(F.array(F.when(F.col("cut").between(F.col("r_st"), F.col("r_ed")), F.col("cut")), F.col("r_ed"))).alias("ed")
    every = cuts.select("sample", "refseg", both, "r_st").where("ed is not null").distinct()
    w = Window.partitionBy("sample", "refseg").orderBy("ed")
    return every.select("sample", "refseg", F.row_number().over(w).alias("seg_no"), (F.coalesce(F.lag("ed").over(w), F.col("r_st") - 1) + 1).alias("st"), "ed")


def name_segments(segments: DataFrame, mode: str = "H") -> DataFrame:
    """segments with seg. ``u[:C]``: capitals from C (A), ``l[:c]``: small letters from c (a), ``prefix[:n]``: prefix and number from
    n (1). Past Z or z there is no name (null), which violations() reports."""
    head, _, start = mode.partition(":")
    no = F.col("seg_no")
    if head in ("u", "l"):
        first = ord(start or ("A" if head == "u" else "a"))
        last = ord("Z" if head == "u" else "z")
        name = F.when(first + no - 1 <= last, F.expr(f"char({first} + seg_no - 1)"))
    else:
        name = F.concat(F.lit(head), (no - 1 + int(start or 1)).cast("string"))
    return segments.withColumn("seg", name)


def map_breakends_to_segments(ends: DataFrame, segments: DataFrame) -> DataFrame:
    """ends with seg: (5', +) and (3', -) meet a segment's end, the others its start, exactly; the first in order; null if none."""
    at_end = (F.col("side") == "5p") == (F.col("strd") == "+")
    keyed = ends.withColumn("edge", F.when(at_end, "ed").otherwise("st"))
    edge = F.explode(F.array(F.struct(F.lit("ed").alias("edge"), F.col("ed").alias("pos")), F.struct(F.lit("st").alias("edge"), F.col("st").alias("pos"))))
    by = segments.select("sample", "refseg", "seg", "seg_no", edge.alias("e")).select("sample", "refseg", "seg", "seg_no", "e.edge", "e.pos")
    by = by.groupBy("sample", "refseg", "edge", "pos").agg(F.min_by("seg", "seg_no").alias("seg"))
    return keyed.join(by, ["sample", "refseg", "edge", "pos"], "left").drop("edge")


def segment_cn(segments: DataFrame, windows: DataFrame, ratio, value: str = "adj") -> DataFrame:
    """segments with depth (mean of ``value`` over the windows of the same sample that overlap, 2 digits) and cn = depth * ratio (2 digits, ratio a column of segments or
    a value); null without windows."""
    on = ["sample", "refseg"]
    # both sides are computed once: the join first looks at their lengths
    segments = stored(segments, "segments")
    means = interval_join(stored(windows.select(*on, "st", "ed", value), "segment-windows"), segments.select(*on, "seg_no", "st", "ed"), on)
    means = means.groupBy(*on, "seg_no").agg(mean_two_digits(value).alias("depth"))
    return segments.join(means, [*on, "seg_no"], "left").withColumn("cn", two_digits(F.col("depth") * ratio))


def feature_cn(features: DataFrame, ratio, depth: str = "depth") -> DataFrame:
    return features.withColumn("cn", two_digits(F.col(depth) * ratio))


def junction_cn(junctions: DataFrame, ratio, mean, n_ratio) -> DataFrame:
    """junctions with pure (reads without the admixed part, truncated toward zero) and cn = pure * ratio (2 digits)."""
    pure = subtract_admixture(F.col("jr_count").cast("double"), mean, n_ratio, F.coalesce(F.col("ncpr").cast("double"), F.lit(0.0))).cast("long")
    return junctions.withColumn("pure", pure).withColumn("cn", two_digits(F.col("pure") * ratio))


def source_sink(segments: DataFrame) -> DataFrame:
    return segments.groupBy("sample", "refseg").agg(F.min_by("seg", "seg_no").alias("source"), F.max_by("seg", "seg_no").alias("sink"))


def feature_chain(features: DataFrame) -> DataFrame:
    """sample, refseg, chain: ``V1+,V2+,...`` in order of seg_no."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "seg"))), lambda x: F.concat(x["seg"], F.lit("+")))
    return features.groupBy("sample", "refseg").agg(F.array_join(ordered, ",").alias("chain"))


def adjacency(segments: DataFrame) -> DataFrame:
    """segments with next_seg (the next one downstream on the refseg) and touches (it begins just after this one ends)."""
    w = Window.partitionBy("sample", "refseg").orderBy("st", "ed", "seg_no")
    return segments.select("*", F.lead("seg").over(w).alias("next_seg"), (F.lead("st").over(w) == F.col("ed") + 1).alias("touches"))


def allele_scenarios(samples: DataFrame) -> DataFrame:
    """sample, code, major, minor, dropped, tag: ``TmM`` has M minor copies and T - M major ones; either can carry the integration. The major
    case is left out where there is no minor allele or both are alike."""
    t, m = (F.regexp_extract("code", r"^(\d+)m(\d+)$", g).try_cast("int") for g in (1, 2))
    rows = samples.select("sample", "code", (t - m).alias("major"), m.alias("minor")).where("major is not null")
    rows = rows.select("*", F.explode(F.array(F.lit("Major"), F.lit("minor"))).alias("dropped"))
    rows = rows.where("not (dropped = 'Major' and (minor = 0 or minor = major))")
    tag = F.when(F.col("minor") == 0, "LOH").when(F.col("minor") == F.col("major"), "vItg").when(F.col("dropped") == "Major", "vItg_on_minor").otherwise("vItg_on_Major")
    return rows.withColumn("tag", tag)


def violations(segments: DataFrame, junctions: DataFrame, cycles: DataFrame, tokens: DataFrame, **more: DataFrame) -> DataFrame:
    """sample, rule, key, detail: one row for each broken rule. All tables have a sample, or none has (and then the result has none); names and places of different samples never meet.

    segments(seg, refseg, st, ed, group_id), junctions(junc_id, seg5, seg3), cycles(cycle_id), tokens(cycle_id, seg). Rules: overlapping
    segments on one refseg, segments without a name (names ran out) or with one of a wrong form, ids given twice, unknown segments, host segments without a group,
    groups that do not agree. Where they are given, also: pairs(anchor_a, anchor_b) twice or with an unknown junction; counts(owner, cycle_id) of an unknown cycle;
    baselines(refseg, st, ed) with a breakpoint of breakpoints(refseg, pos) inside; ratios(len, ratio) outside 0 to 1.
    """
    on = shared_keys(["sample"], segments)
    found = []

    def broken(rows: DataFrame, rule: str, key: str, detail: str) -> None:
        found.append(rows.selectExpr(*on, f"'{rule}' as rule", f"cast({key} as string) as key", f"cast({detail} as string) as detail"))

    def twice(rows: DataFrame, rule: str, key: str) -> None:
        broken(rows.groupBy(*on, key).count().where("count > 1"), rule, key, "count")

    # a name's segments are counted once, and whatever uses names meets them once
    names = stored(segments.groupBy(*on, "seg").agg(F.count(F.lit(1)).alias("count"), F.min("group_id").alias("g"), F.max("group_id").alias("h")), "segment-names")
    uses = junctions.select(*on, F.lit(True).alias("in_junction"), F.col("junc_id").cast("string").alias("user"), F.explode(F.array("seg5", "seg3")).alias("seg"))
    uses = uses.unionByName(tokens.select(*on, F.lit(False).alias("in_junction"), F.col("cycle_id").cast("string").alias("user"), "seg"))
    uses = stored(uses.join(names.hint("merge"), [*on, "seg"], "left"), "segment-uses")
    a = segments.select(*on, "seg", "refseg", "st", "ed")
    broken(interval_join(a, a.withColumnRenamed("seg", "other"), [*on, "refseg"]).where("seg < other"), "overlap", "seg", "other")
    broken(segments.where("not seg rlike '^[HV][0-9]+$'"), "segment id", "seg", "refseg")
    broken(segments.where("seg is null"), "names ran out", "concat(refseg, ':', st, '-', ed)", "refseg")
    broken(names.where("seg is not null and count > 1"), "segment twice", "seg", "count")
    twice(cycles, "cycle twice", "cycle_id")
    broken(uses.where("not in_junction and count is null").select(*on, "user", "seg").distinct(), "unknown segment", "user", "seg")
    broken(uses.where("in_junction and count is null"), "junction without segment", "user", "seg")
    broken(segments.where("seg like 'H%' and group_id is null"), "no group", "seg", "refseg")
    groups = uses.where("in_junction and g is not null").groupBy(*on, "user").agg(F.min("g").alias("g"), F.max("h").alias("h"))
    broken(groups.where("g <> h"), "group mismatch", "user", "concat(g, ',', h)")
    if "pairs" in more:
        a, b = F.col("anchor_a"), F.col("anchor_b")
        pair = F.when(a.isNull() | b.isNull(), F.coalesce(a, b, F.lit(""))).otherwise(F.concat(F.least(a, b), F.lit(";"), F.greatest(a, b)))
        twice(more["pairs"].select(*on, pair.alias("pair")), "pair twice", "pair")
        anchor = more["pairs"].select(*on, F.explode(F.array("anchor_a", "anchor_b")).alias("junc_id"), F.lit(False).alias("known")).where("junc_id like 'JUNC%'")
        anchor = anchor.unionByName(junctions.select(*on, "junc_id", F.lit(True).alias("known"))).groupBy(*on, "junc_id").agg(F.max("known").alias("known"))
        broken(anchor.where("not known"), "unknown junction", "junc_id", "null")
    if "counts" in more:
        lost = more["counts"].select(*on, "owner", "cycle_id").distinct().join(cycles.select(*on, "cycle_id").distinct(), [*on, "cycle_id"], "left_anti")
        broken(lost, "unknown cycle", "cycle_id", "owner")
    if "baselines" in more:
        place = [*on, "refseg"]
        cut = point_join(more["breakpoints"].select(*place, "pos"), more["baselines"].select(*place, "st", "ed"), place).where("pos > st and pos < ed")
        broken(cut.groupBy(*place, "st", "ed").agg(F.min("pos").alias("pos")), "baseline with breakpoint", "concat(refseg, ':', st, '-', ed)", "pos")
    if "ratios" in more:
        broken(more["ratios"].where("not ratio between 0 and 1"), "ratio out of range", "len", "ratio")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out

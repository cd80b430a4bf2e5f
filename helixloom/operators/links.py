"""Anchors and links: inner and terminal anchors, shared markers, places on walks, co-coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixloom.functions.tokens import flip, segment_of, strand_of
from helixloom.operators.cycles import shared_keys
from helixloom.operators.intervals import BIN, point_join
from helixloom.sources.storage import stored


def inner_anchors(segments: DataFrame, n: int = 1) -> DataFrame:
    """sample, group_id, seg, refseg, nth, pos, unit: n even positions inside each host segment (is_end false); a segment shorter than n + 1 has none."""
    host = segments.where("seg like 'H%' and not is_end").withColumn("unit", F.expr(f"(ed - st + 1) div {n + 1}")).where("unit > 0")
    spot = host.withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return spot.select("sample", "group_id", "seg", "refseg", "st", "ed", "nth", (F.col("st") + F.col("nth") * F.col("unit") - 1).alias("pos"), "unit")


def edge_filter(anchors: DataFrame, least: int = 100) -> DataFrame:
    """Anchors at least ``least`` bases from both ends of their segment."""
    return anchors.where(f"pos - st >= {least} and ed - pos >= {least}")


def terminal_anchors(segments: DataFrame, inner: DataFrame, least: int = 100) -> DataFrame:
    """seg, pos of the source (before its end) and the sink (after its start), set off by the mean unit of a sample's inner anchors, at least ``least``, at most half
    the segment; none where a sample has no inner anchor. segments has ``role`` (source, sink or null)."""
    mean = inner.groupBy("sample").agg(F.greatest(F.avg("unit").cast("long"), F.lit(least)).alias("avg_unit"))
    ends = segments.where("role is not null").join(mean, "sample")
    shift = F.least("avg_unit", F.expr("(ed - st + 1) div 2"))
    return ends.select("sample", "group_id", "seg", "refseg", "st", "ed", "role", F.when(F.col("role") == "source", F.col("ed") - shift).otherwise(F.col("st") + shift).alias("pos"))


def anchor_markers(anchors: DataFrame, reads: DataFrame, junction_markers: DataFrame | None = None) -> DataFrame:
    """sample, anchor, marker (text): one index of both kinds of anchors. A position anchor (sample, anchor, refseg, pos) has the molecules of the
    sample's intervals (sample, refseg, st, ed, molecule) that cover it; a junction anchor those of its list (sample, anchor, marker). Tables of a single sample may do without the column."""
    on = shared_keys(["sample"], anchors)
    hit = point_join(anchors.select(*on, "anchor", "refseg", "pos"), reads.select(*on, "refseg", "st", "ed", "molecule"), [*on, "refseg"])
    found = hit.select(*on, "anchor", F.col("molecule").cast("string").alias("marker"))
    if junction_markers is not None:
        found = found.unionByName(junction_markers.select(*on, "anchor", F.col("marker").cast("string").alias("marker")))
    return found.distinct()


#: Anchors that one row of a marker's list holds; a longer list is paired slice by slice.
SLICE = 256


def shared_marker_links(markers: DataFrame, segment_of_anchor: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """anchor_a < anchor_b, links: distinct markers that both have; pairs of position anchors in one segment (anchor, seg) are left out, junction anchors have none. With pairs (anchor_a < anchor_b)
    exactly those, zeros included; else those that share a marker, as all others have zero. All tables may have a sample: markers and anchors of different samples never meet.

    Each marker first becomes sorted lists of its anchors; equal lists are grouped with a count, so what many markers share is paired once. A very frequent marker is many
    slices, and each pair of slices is a row of its own.
    """
    on = shared_keys(["sample"], markers)
    rows = stored(markers.select(*on, "anchor", "marker").distinct(), "markers")  # read for their counts and for the lists
    many = rows.groupBy(*on, "marker").agg(F.count(F.lit(1)).alias("n"))
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    dealt = rows.join(many, [*on, "marker"]).select(*on, "marker", "anchor", slices.alias("of"), F.pmod(F.hash("anchor"), slices).alias("slice"))
    lists = dealt.groupBy(*on, "marker", "of", "slice").agg(F.array_sort(F.collect_list("anchor")).alias("s"))
    # slice i meets slices i, i + 1, ..: two lists a row, one where a slice meets itself
    other = F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other")
    met = lists.select(*on, "marker", "slice", "s", other).select(*on, "marker", F.least("slice", "other").alias("x"), F.greatest("slice", "other").alias("y"), "slice", "s")
    met = met.groupBy(*on, "marker", "x", "y").agg(F.array_sort(F.collect_set(F.struct("slice", "s"))).alias("l"))
    met = met.where("x = y or size(l) = 2").select(*on, F.get("l", F.lit(0))["s"].alias("a"), F.get("l", F.lit(1))["s"].alias("b"))
    met = stored(met.groupBy(*on, "a", "b").agg(F.count(F.lit(1)).alias("n")), "marker-lists")  # read for pairs within a list and across two
    inner = met.where("b is null").select(*on, "n", F.posexplode("a").alias("i", "p"), "a").select(*on, "n", "p", F.explode(F.slice("a", F.col("i") + 2, F.size("a"))).alias("q"))
    cross = met.where("b is not null").select(*on, "n", F.explode("a").alias("p"), "b").select(*on, "n", "p", F.explode("b").alias("q"))
    both = inner.unionByName(cross).select(*on, F.least("p", "q").alias("anchor_a"), F.greatest("p", "q").alias("anchor_b"), "n")
    key = [*on, "anchor_a", "anchor_b"]
    got = both.groupBy(*key).agg(F.sum("n").alias("links"))
    if pairs is not None:
        got = pairs.select(*key).join(got, key, "left").select(*key, F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    if segment_of_anchor is not None:
        s = segment_of_anchor
        got = got.join(s.select(*on, F.col("anchor").alias("anchor_a"), F.col("seg").alias("sa")), [*on, "anchor_a"], "left").join(s.select(*on, F.col("anchor").alias("anchor_b"), F.col("seg").alias("sb")), [*on, "anchor_b"], "left")
        got = got.where("sa is null or sb is null or sa <> sb")
    return got.select(*key, "links")


def pair_matrix(links: DataFrame, names: list[str]) -> DataFrame:
    """Symmetric wide form: one row (of each sample, if there is one) and one column for each anchor; zero stays 0, the diagonal is null."""
    on = shared_keys(["sample"], links)
    both = links.unionByName(links.select(*on, F.col("anchor_b").alias("anchor_a"), F.col("anchor_a").alias("anchor_b"), "links"))
    return both.groupBy(*on, F.col("anchor_a").alias("anchor")).pivot("anchor_b", names).agg(F.max("links"))


def pair_key(a, b):
    return F.concat_ws(";", F.array_sort(F.array(a, b)))


def pair_groups(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """pairs with group_id and problem: the group (anchor, group_id) that one side has or both agree on; else ``conflict`` or ``no group``."""
    g = lambda c, n: groups.select(F.col("anchor").alias(c), F.col("group_id").alias(n))
    out = pairs.join(g("anchor_a", "ga"), "anchor_a", "left").join(g("anchor_b", "gb"), "anchor_b", "left")
    problem = F.when(F.coalesce("ga", "gb").isNull(), "no group").when(F.col("ga") != F.col("gb"), "conflict")
    return out.select(*pairs.columns, F.when(problem.isNull(), F.coalesce("ga", "gb")).alias("group_id"), problem.alias("problem"))


def walk_offsets(walks: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ord, token, seg, orit, len, before: each token with the length that stands before it on the walk; segments (seg, st, ed and any of the keys)."""
    on = [*shared_keys(keys, segments), "seg"]
    long = walks.select(*keys, F.posexplode("walk").alias("ord", "token"))
    long = long.select("*", segment_of(F.col("token")).alias("seg"), strand_of(F.col("token")).alias("orit")).join(segments.select(*on, F.expr("ed - st + 1 as len")), on)
    w = Window.partitionBy(*keys).orderBy("ord")
    return long.select(*keys, "ord", "token", "seg", "orit", "len", F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("token").over(w).alias("next_token"))


def anchor_positions(offsets: DataFrame, positions: DataFrame, junctions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, anchor, at: places of position anchors (anchor, seg, to5, to3) and of junction anchors (anchor, link) on walks; a junction stands at the
    end of its first token, forward or as its reverse complement."""
    pos = offsets.join(positions, [*shared_keys(keys, positions), "seg"]).select(*keys, "anchor", (F.col("before") + F.when(F.col("orit") == "+", F.col("to5")).otherwise(F.col("to3"))).alias("at"))
    sides = F.split("link", ",")
    rc = F.concat(flip(F.element_at(sides, 2)), F.lit(","), flip(F.element_at(sides, 1)))
    both = junctions.select("anchor", F.explode(F.array_distinct(F.array("link", rc))).alias("pair"))
    hit = offsets.where("next_token is not null").select(*keys, (F.col("before") + F.col("len")).alias("at"), F.concat("token", F.lit(","), "next_token").alias("pair"))
    return pos.unionByName(hit.join(both, "pair").select(*keys, "anchor", "at"))


def anchor_distances(places: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, anchor_a, anchor_b, distance: the least length between the two anchors of a pair on a walk."""
    a = places.withColumnsRenamed({"anchor": "anchor_a", "at": "pa"})
    b = places.withColumnsRenamed({"anchor": "anchor_b", "at": "pb"})
    return a.join(pairs.select("anchor_a", "anchor_b"), "anchor_a").join(b, [*keys, "anchor_b"]).groupBy(*keys, "anchor_a", "anchor_b").agg(F.min(F.abs(F.col("pa") - F.col("pb"))).alias("distance"))


def co_coverage(molecules: DataFrame, places: DataFrame, pairs: DataFrame, keys: list[str], biend: bool = False, rlen: int = 150, bin_size: int = BIN) -> DataFrame:
    """keys, anchor_a, anchor_b, links: sum of cover ratios over molecules (keys.., mol, st, ed, covr) that hold an occurrence of both; each pair of
    occurrences counts. biend also wants the left one within rlen of the start and the right one within rlen of the end. Pairs that no molecule of the keys holds are left out: with_zeros adds them.

    Occurrences are joined by pair and molecule, so only wanted pairs arise.
    """
    hit = point_join(places, stored(molecules.select(*keys, "mol", "st", "ed", "covr"), "molecules"), keys, "at", bin_size).select(*keys, "mol", "anchor", "at", "st", "ed", "covr")
    a = hit.join(pairs.select(F.col("anchor_a").alias("anchor"), "anchor_b"), "anchor").withColumnsRenamed({"anchor": "anchor_a", "at": "pa"})
    b = hit.join(pairs.select("anchor_a", F.col("anchor_b").alias("anchor")), "anchor").select(*keys, "mol", "anchor_a", F.col("anchor").alias("anchor_b"), F.col("at").alias("pb"))
    both = a.join(b, [*keys, "mol", "anchor_a", "anchor_b"])
    if biend:
        both = both.where(f"least(pa, pb) - st <= {rlen} and ed - greatest(pa, pb) <= {rlen}")
    return both.groupBy(*keys, "anchor_a", "anchor_b").agg(F.sum("covr").alias("links"))


def with_zeros(links: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """links for every wanted row (keys.., anchor_a, anchor_b), zero where there are none."""
    on = [*keys, "anchor_a", "anchor_b"]
    return wanted.select(*on).join(links, on, "left").select(*on, F.coalesce("links", F.lit(0.0)).alias("links"))

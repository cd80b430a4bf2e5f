"""Cycle and walk algebra on tables: cycles(keys.., cycle_id, cnt, tokens), walks(keys.., map_no, walk)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixloom.functions.tokens import (
    composition_signature,
    flip,
    pair_key,
    reverse_complement,
    segment_of,
    strand_of,
    usage,
    walk_signature,
)
from helixloom.sources.storage import stored, stored_by_size


def expand_walk(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, walk: flatten nodes(keys.., ord, tokens, count) in order, each node's tokens as often as its count."""
    unit = F.struct("ord", F.flatten(F.array_repeat("tokens", F.col("count").cast("int"))).alias("t"))
    ordered = F.array_sort(F.collect_list(unit))
    return nodes.groupBy(*keys).agg(F.flatten(F.transform(ordered, lambda x: x["t"])).alias("walk"))


def _read_blocks(nodes: DataFrame, keys: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """(units, held): nested nodes with what they read out as (walk) and how many levels of blocks that has (height), and for each level of depth,
    from the deepest up, what its blocks hold: keys, path, once, height."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    units = nodes.select(
        *keys, "parent", "path", "depth", "cnt", "token", F.when(F.col("token").isNotNull(), F.array("token")).alias("walk"), F.when(F.col("token").isNotNull(), 0).alias("height")
    )
    levels = []
    for level in range(deepest, 0, -1):
        held = units.where(F.col("depth") == level).groupBy(*keys, F.col("parent").alias("path"))
        held = held.agg(F.array_sort(F.collect_list(F.struct("path", "walk"))).alias("in"), (F.max("height") + 1).alias("inner"))
        held = held.select(*keys, "path", F.flatten(F.transform("in", lambda x: x["walk"])).alias("once"), "inner")
        levels.append(held)
        units = units.where(F.col("depth") < level).join(held, [*keys, "path"], "left")
        often = F.flatten(F.array_repeat("once", F.col("cnt").cast("int")))
        fresh = F.col("token").isNull() & F.col("once").isNotNull()
        units = units.select(
            *keys, "parent", "path", "depth", "cnt", "token", F.when(fresh, often).otherwise(F.col("walk")).alias("walk"), F.when(fresh, F.col("inner")).otherwise(F.col("height")).alias("height")
        )
    return units, levels


def expand_nested(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, walk: read out nested nodes(keys.., parent, path, token, cnt, depth), each block's nodes as often as its count.

    A token node has a token; a block has none and holds the nodes whose parent is its path, in order of theirs; the root is the block without a parent, at
    depth 0. Blocks are read from the deepest up, one grouped list a level.
    """
    return _read_blocks(nodes, keys)[0].where("parent is null").select(*keys, "walk")


def nested_units(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, unit_id, level, unit: what the blocks of nested nodes, but for the root, read out as once; level 1 holds no other block. Equal units of one
    level are one."""
    _, levels = _read_blocks(nodes, keys)
    root = nodes.where("parent is null").select(*keys, "path")
    units = reduce(DataFrame.unionByName, levels) if levels else root.select(*keys, "path", F.array().cast("array<string>").alias("once"), F.lit(0).alias("inner")).limit(0)
    units = units.join(root, [*keys, "path"], "left_anti").select(*keys, F.col("inner").alias("level"), F.col("once").alias("unit")).distinct()
    return units.select(*keys, F.sha2(F.array_join("unit", " "), 256).alias("unit_id"), "level", "unit")


def tokens_long(cycles: DataFrame, keys: list[str], column: str = "tokens") -> DataFrame:
    """keys, ord (from 0), token, seg, orit."""
    long = cycles.select(*keys, F.posexplode(column).alias("ord", "token"))
    return long.select("*", segment_of(F.col("token")).alias("seg"), strand_of(F.col("token")).alias("orit"))


def shared_keys(keys: list[str], segments: DataFrame) -> list[str]:
    """The keys that a table of segments has too (such as sample), by which it is joined beside seg."""
    return [k for k in keys if k in segments.columns]


def cycle_stats(cycles: DataFrame, segments: DataFrame, keys: list[str], column: str = "tokens") -> DataFrame:
    """keys, n_tokens, length, n_segments, first_seg, last_seg. Segments (seg, st, ed and any of the keys) without a known length count 0."""
    on = [*shared_keys(keys, segments), "seg"]
    long = tokens_long(cycles, keys, column).join(segments.select(*on, F.expr("ed - st + 1 as len")), on, "left")
    return long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tokens"), F.sum(F.coalesce("len", F.lit(0))).alias("length"), F.countDistinct("seg").alias("n_segments"),
        F.min_by("seg", "ord").alias("first_seg"), F.max_by("seg", "ord").alias("last_seg"),
    )


def nested_stats(nodes: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_tokens, length, n_blocks, structure_depth of nested nodes: lengths and tokens by how often they are read (times), levels of blocks with the root's."""
    on = [*shared_keys(keys, segments), "seg"]
    rows = nodes.withColumn("seg", segment_of(F.col("token"))).join(segments.select(*on, F.expr("ed - st + 1 as len")), on, "left")
    token, block = F.col("token").isNotNull(), F.col("token").isNull()
    return rows.groupBy(*keys).agg(
        F.sum(F.when(token, F.col("times")).otherwise(0)).alias("n_tokens"), F.sum(F.when(token, F.col("times") * F.coalesce("len", F.lit(0))).otherwise(0)).alias("length"),
        F.sum(F.when(block & F.col("parent").isNotNull(), 1).otherwise(0)).alias("n_blocks"), (F.max(F.when(block, F.col("depth"))) + 1).alias("structure_depth"),
    )


def segment_counts(cycles: DataFrame, keys: list[str], column: str = "tokens") -> DataFrame:
    return tokens_long(cycles, keys, column).groupBy(*keys, "seg", "orit").agg(F.count(F.lit(1)).alias("n"))


def locate_segment(cycles: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seg, ord: the first place of a wanted segment (keys.., seg, avoid) in each cycle whose id is not to be avoided."""
    long = tokens_long(cycles, [*keys, "cycle_id"])
    hit = long.join(wanted, [*keys, "seg"]).where("avoid is null or avoid <> cycle_id")
    return hit.groupBy(*keys, "cycle_id", "seg").agg(F.min("ord").alias("ord"))


def locate_in_blocks(nodes: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seg, block, ord: the first place of a wanted segment (keys.., seg, count, avoid) in nested nodes: at top level (block null) or, where that has none, in the
    first block below it that stands ``count`` times (any, if null) and is not of the cycle to avoid. Places count tokens and blocks from 0."""
    place = Window.partitionBy(*keys, "parent").orderBy("path")
    rows = nodes.where("parent is not null").withColumn("ord", F.row_number().over(place) - 1)
    tokens = rows.where("token is not null").select(*keys, "parent", "ord", segment_of(F.col("token")).alias("seg")).join(wanted, [*keys, "seg"])
    top = tokens.where("size(parent) = 0").select(*keys, "seg", F.lit(None).cast("int").alias("block"), "ord")
    blocks = rows.where("token is null and size(parent) = 0").select(*keys, F.col("path").alias("parent"), F.col("ord").alias("block"), "cnt", "cycle_id")
    inner = tokens.join(blocks, [*keys, "parent"]).where("(count is null or count = cnt) and (avoid is null or avoid <> cycle_id)").select(*keys, "seg", "block", "ord")
    best = top.unionByName(inner).groupBy(*keys, "seg").agg(F.min(F.struct("block", "ord")).alias("p"))  # null, the top level, sorts first
    return best.select(*keys, "seg", "p.block", "p.ord")


def select_backbone(cycles: DataFrame, segments: DataFrame, keys: list[str], source: str = "source", sink: str = "sink", ends: DataFrame | None = None) -> DataFrame:
    """keys, cycle_id, tokens: of the cycles with count 1 from source to sink the longest (smallest id of equals). source and sink are segments, or with
    ends (any of the keys, source, sink) each group's own."""
    if ends is not None:
        known = cycles.join(ends, shared_keys(keys, ends))
        a, b = F.col("source"), F.col("sink")
    else:
        known, a, b = cycles, F.lit(source), F.lit(sink)
    fit = known.where((F.col("cnt") == 1) & (segment_of(F.element_at("tokens", 1)) == a) & (segment_of(F.element_at("tokens", -1)) == b)).select(*cycles.columns)
    sized = fit.join(cycle_stats(fit, segments, [*keys, "cycle_id"]).select(*keys, "cycle_id", "length"), [*keys, "cycle_id"])
    best = F.min_by(F.struct("cycle_id", "tokens", "length"), F.struct(-F.col("length"), "cycle_id"))
    return sized.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def choose_anchors(cycles: DataFrame, backbone: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cycle_id, anchor: the first host segment of the backbone that the cycle holds, else its first host, then virus, segment that
    another cycle of the keys holds; null if no cycle shares a segment with it."""
    rest = cycles.join(backbone.select(*keys, "cycle_id"), [*keys, "cycle_id"], "left_anti")
    long = tokens_long(rest, [*keys, "cycle_id"])
    line = tokens_long(backbone, keys).where("seg like 'H%'").groupBy(*keys, "seg").agg(F.min("ord").alias("at"))
    direct = long.join(line, [*keys, "seg"]).groupBy(*keys, "cycle_id").agg(F.min_by("seg", "at").alias("direct"))
    holders = tokens_long(cycles, [*keys, "cycle_id"]).groupBy(*keys, "seg").agg(F.min("cycle_id").alias("c0"), F.max("cycle_id").alias("c1"))
    other = long.join(holders, [*keys, "seg"]).where("c0 <> cycle_id or c1 <> cycle_id")
    order = F.struct(F.when(F.col("seg").startswith("H"), 0).otherwise(1), "ord")
    indirect = other.groupBy(*keys, "cycle_id").agg(F.min_by("seg", order).alias("indirect"))
    ids = rest.select(*keys, "cycle_id")
    out = ids.join(direct, [*keys, "cycle_id"], "left").join(indirect, [*keys, "cycle_id"], "left")
    return out.select(*keys, "cycle_id", F.coalesce("direct", "indirect").alias("anchor"))


def reachable_cycles(cycles: DataFrame, backbone: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cycle_id, hops: cycles that shared segments connect with the backbone (hops 0). Rounds go on until none is new; they grow with cycles in a row, not with rows."""
    long = stored(tokens_long(cycles, [*keys, "cycle_id"]).select(*keys, "cycle_id", "seg").distinct(), "cycle-segments")
    front = stored(backbone.select(*keys, "cycle_id").withColumn("hops", F.lit(0)), "cycle-front")
    seen, hop = front, 0
    while True:
        hop += 1
        segs = front.select(*keys, "cycle_id").join(long, [*keys, "cycle_id"]).select(*keys, "seg").distinct()
        front = long.join(segs, [*keys, "seg"], "left_semi").select(*keys, "cycle_id").distinct().join(seen, [*keys, "cycle_id"], "left_anti").withColumn("hops", F.lit(hop))
        front = stored(front, "cycle-front")
        if front.isEmpty():
            return seen
        seen = stored(seen.unionByName(front), "cycle-seen")


def fold_repeats(walks: DataFrame, keys: list[str], units: DataFrame, on: list[str] | None = None) -> DataFrame:
    """keys, unit_id, start, times: maximal runs of a unit (keys.., unit_id, unit) repeated back to back at least twice. Units are those of equal keys, or of
    equal values of some keys (on)."""
    both = walks.join(units, on or keys)
    n, u = F.size("walk"), F.size("unit")
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - u, F.lit(0))), lambda i: F.slice("walk", i + 1, u) == F.col("unit"))
    hit = both.where(u > 0).select(*keys, "unit_id", u.alias("u"), F.explode(at).alias("i"))
    w = Window.partitionBy(*keys, "unit_id", F.col("i") % F.col("u")).orderBy("i")
    hit = hit.withColumn("isle", F.col("i") - F.col("u") * F.row_number().over(w)).withColumn("phase", F.col("i") % F.col("u"))
    runs = hit.groupBy(*keys, "unit_id", "phase", "isle").agg(F.min("i").alias("start"), F.count(F.lit(1)).alias("times"))
    return runs.where("times >= 2").select(*keys, "unit_id", "start", "times")


def fold_items(walks: DataFrame, keys: list[str], units: DataFrame, on: list[str] | None = None) -> DataFrame:
    """keys, walk: walks in which each folded stretch is one item, ``(H3+ V1-)x5``, among the others.

    From left to right: of the runs that begin first the one that covers most items (then the smallest unit id) is folded, runs that overlap it are passed over."""
    on = on or keys
    sized = fold_repeats(walks, keys, units, on).join(units.select(*on, "unit_id", F.size("unit").alias("u")), [*on, "unit_id"])
    order = F.struct("start", (-F.col("times") * F.col("u")).alias("less"), F.col("unit_id").cast("string").alias("unit_id"), "u", F.col("times").cast("int").alias("times"))
    runs = walks.select(*keys, "walk").join(sized.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("runs")), keys, "left")
    span = "struct<a:int,u:int,times:int>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("taken"))

    def step(acc, r):
        one = F.struct(r["start"].alias("a"), r["u"].alias("u"), r["times"].alias("times"))
        return F.when(r["start"] >= acc["at"], F.struct((r["start"] + r["u"] * r["times"]).alias("at"), F.array_append(acc["taken"], one).alias("taken"))).otherwise(acc)

    none = F.expr("array()").cast("array<struct<start:int,less:bigint,unit_id:string,u:int,times:int>>")
    out = runs.select(*keys, "walk", F.aggregate(F.coalesce("runs", none), begin, step).alias("f")).select(*keys, "walk", "f.at", "f.taken")

    def folded(r, i):
        before = F.get("taken", i - 1)
        done = F.coalesce(before["a"] + before["u"] * before["times"], F.lit(0))
        text = F.concat(F.lit("("), F.array_join(F.slice("walk", r["a"] + 1, r["u"]), " "), F.lit(")x"), r["times"].cast("string"))
        return F.concat(F.slice("walk", done + 1, r["a"] - done), F.array(text))

    rest = F.slice("walk", F.col("at") + 1, F.size("walk") - F.col("at"))
    return out.select(*keys, F.concat(F.flatten(F.transform("taken", folded)), rest).alias("walk"))


def _as_text(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.select(*keys, F.array_join("walk", " ").alias("text"), F.size(F.filter("walk", lambda p: F.startswith(p, F.lit("(")))).alias("height"))


def fold_walks(walks: DataFrame, keys: list[str], units: DataFrame) -> DataFrame:
    """keys, text, height: walks with repeated units folded into counts, ``H1+ (H3+ V1-)x5 H4+``, and the number of folded stretches, as fold_items takes them."""
    return _as_text(fold_items(walks, keys, units), keys)


def fold_nested(walks: DataFrame, keys: list[str], units: DataFrame) -> DataFrame:
    """keys, text, height: as fold_walks with units (keys.., unit_id, level, unit) of several levels, ``((H3+ V1-)x2 H2-)x3``; height counts outermost stretches.

    Units are folded from the lowest level up: those of a level into the walks and into all units above it, which then repeat as items with counts.
    Rounds grow with the levels of blocks, not with walks. Where lower units leave a copy of a higher one with another count, at its edge, that copy stands beside the fold.
    """
    # each round reads its walks and units several times, so both are made once and kept from round to round
    todo = stored_by_size(units.select(*keys, "unit_id", "level", "unit"), "fold-units")
    deepest = todo.agg(F.max("level")).first()[0] or 0
    walks = stored_by_size(walks.select(*keys, "walk"), "fold-walks") if deepest else walks.select(*keys, "walk")
    for level in range(1, deepest + 1):
        now = todo.where(F.col("level") == level).select(*keys, "unit_id", "unit")
        walks = stored_by_size(fold_items(walks, keys, now), "fold-walks")
        if level == deepest:
            break
        above = todo.where(F.col("level") > level).select(*keys, F.col("unit_id").alias("outer_id"), "level", F.col("unit").alias("walk"))
        above = fold_items(above, [*keys, "outer_id", "level"], now, keys)
        todo = stored_by_size(above.select(*keys, F.col("outer_id").alias("unit_id"), "level", F.col("walk").alias("unit")), "fold-units")
    return _as_text(walks, keys)


def walk_signatures(walks: DataFrame) -> DataFrame:
    return walks.select("*", walk_signature(F.col("walk")).alias("md5_walk"), composition_signature(F.col("walk")).alias("md5_composition"))


def dedup_walks(walks: DataFrame, keys: list[str]) -> DataFrame:
    """Of walks (.., map_no, height, walk) with one signature in keys the lowest stays; ties keep the earliest."""
    w = Window.partitionBy(*keys, "_sig").orderBy("height", "map_no")
    return walks.withColumn("_sig", walk_signature(F.col("walk"))).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_sig", "_r")


def motif_pattern(motif):
    """A regular expression for a motif such as ``H2,V1+``: a missing sign is any sign; matched on the walk joined by ';'."""
    parts = F.transform(F.split(motif, ","), lambda t: F.when(t.rlike("[+-]$"), F.concat(segment_of(t), F.lit("["), strand_of(t), F.lit("]"))).otherwise(F.concat(t, F.lit("[+-]"))))
    return F.concat(F.lit("(^|;)"), F.array_join(parts, ";"), F.lit(";"))


def require_motifs(walks: DataFrame, motifs: list[str], keys: list[str], single: DataFrame | None = None) -> DataFrame:
    """Walks that hold every motif forward or as its reverse complement; with no motif all walks. Motifs are a user's short list, so each is a filter of the scan and
    nothing is joined. Alleles of one cycle (single: some of the keys) are exempt."""
    text = F.concat(F.array_join("walk", ";"), F.lit(";"))
    ok = F.lit(True)
    for m in motifs:
        back = F.array_join(F.transform(F.reverse(F.split(F.lit(m), ",")), lambda t: F.when(t.rlike("[+-]$"), flip(t)).otherwise(t)), ",")
        ok = ok & (F.regexp(text, motif_pattern(F.lit(m))) | F.regexp(text, motif_pattern(back)))
    if single is None:
        return walks.where(ok)
    on = shared_keys(keys, single)
    return walks.where(ok).unionByName(walks.where(~ok).join(single.select(*on).distinct(), on, "left_semi"))


def inversion_variants(walks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, j, variant: where tokens i - 1 and j + 1 are one segment on opposite strands, the walk with i..j turned round (i < j)."""
    long = tokens_long(walks, keys, "walk")
    a = long.select(*keys, "seg", F.col("ord").alias("p"), F.col("orit").alias("po"))
    b = long.select(*keys, "seg", F.col("ord").alias("q"), F.col("orit").alias("qo"))
    spots = a.join(b, [*keys, "seg"]).where("po <> qo and q >= p + 3").select(*keys, (F.col("p") + 1).alias("i"), (F.col("q") - 1).alias("j"))
    part = F.slice("walk", F.col("i") + 1, F.col("j") - F.col("i") + 1)
    whole = F.concat(F.slice("walk", F.lit(1), F.col("i")), reverse_complement(part), F.slice("walk", F.col("j") + 2, F.size("walk") - F.col("j") - 1))
    return walks.join(spots, keys).select(*keys, "i", "j", whole.alias("variant"))


def select_solutions(solutions: DataFrame, include: DataFrame | None, exclude: DataFrame | None, key: str = "solution") -> DataFrame:
    """Included solutions (all, without a list), less the excluded ones: exclusion wins."""
    out = solutions if include is None else solutions.join(include.select(key), key, "left_semi")
    return out if exclude is None else out.join(exclude.select(key), key, "left_anti")


def propagate_validity(alleles: DataFrame) -> DataFrame:
    """sample, group_id, solution, valid, group_valid from alleles (.., allele, n_walks): an allele without a walk makes its solution invalid, a group
    is valid with one valid solution."""
    sol = alleles.groupBy("sample", "group_id", "solution").agg(F.expr("bool_and(coalesce(n_walks, 0) > 0)").alias("valid"))
    grp = sol.groupBy("sample", "group_id").agg(F.expr("bool_or(valid)").alias("group_valid"))
    return sol.join(grp, ["sample", "group_id"])


def solution_accounting(cycles: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seg, expected, cn, residual: copies of each segment that cycles (.., cnt, tokens) add up to, against segments (seg, cn and any of the keys)."""
    use = tokens_long(cycles, [*keys, "cnt", "cycle_id"]).groupBy(*keys, "seg").agg(F.sum("cnt").alias("expected"))
    on = [*shared_keys(keys, segments), "seg"]
    return use.join(segments.select(*on, "cn"), on, "left").select(*keys, "seg", "expected", "cn", F.expr("try_divide(expected - cn, cn)").alias("residual"))


def junction_accounting(cycles: DataFrame, junctions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, link, expected, cn, residual: how often cycles (.., cnt, tokens) pass each junction, against junctions (link ``H1+,H3+``, cn and any of the keys).

    Neighbours on a ring count, the last token with the first included, and a junction counts on either strand. Junctions that a group of cycles does not pass stand with 0, if they share a key;
    pairs that are no junctions (neighbours on the reference, the backbone's closing) are left out. Rows of one link, on either strand, add their cn up. Like segments, junctions are written as given.
    """
    on = shared_keys(keys, junctions)
    side = lambda i: F.element_at(F.split("link", ","), i)
    known = junctions.withColumn("_pair", pair_key(side(1), side(2))).groupBy(*on, "_pair").agg(F.min("link").alias("link"), F.sum("cn").alias("cn"))
    n = F.size("tokens")
    ring = cycles.where(n > 0).select(*keys, "cnt", F.explode(F.transform("tokens", lambda t, i: pair_key(t, F.get("tokens", (i + 1) % n)))).alias("_pair"))
    use = ring.groupBy(*keys, "_pair").agg(F.sum("cnt").alias("expected"))
    if not on:
        both = use.join(known, "_pair")
    else:
        wanted = cycles.select(*keys).distinct().join(known, on)
        both = wanted.join(use, [*keys, "_pair"], "left").withColumn("expected", F.coalesce("expected", F.lit(0)))
    return both.select(*keys, "link", F.col("expected").cast("long").alias("expected"), "cn", F.expr("try_divide(expected - cn, cn)").alias("residual"))


def usage_strings(cycles: DataFrame, keys: list[str]) -> DataFrame:
    return cycles.groupBy(*keys).agg(usage(F.collect_list(F.struct(F.col("cycle_id").alias("id"), F.col("cnt").alias("n")))).alias("usage"))


def visible_segments(segments: DataFrame) -> DataFrame:
    """group_id, seg: each group's own segments, and those without a group (virus) in every group of their sample."""
    groups = segments.where("group_id is not null").select("sample", "group_id").distinct()
    free = segments.where("group_id is null").select("sample", "seg")
    return segments.where("group_id is not null").select("sample", "group_id", "seg").unionByName(free.join(groups, "sample").select("sample", "group_id", "seg"))

"""Splice all cycle copies of an allele into one source-to-sink walk, by rounds of table operations over all alleles at once.

A walk under construction is a table of blocks: each holds the tokens of one cycle and is repeated. A block is known by its ``path``, an
array of numbers that sorts in reading order and begins with the path of the block around it, so inserting, splitting and reading out need neither
renumbering nor recursion; a token's path follows from its place in its block. A round joins the copies that are left with the tokens that have their
anchor, keeps the best site of each allele by one grouped minimum, and writes the blocks that this adds or changes, under the round's number: the last
version of a block counts. What is written so grows with the sites taken, not with rounds times walks. Rounds grow with the cycles of one allele, not with
the number of alleles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.functions.tokens import canonical_start, reanchor, reverse_complement, segment_of
from helixloom.operators.cycles import cycle_stats, choose_anchors, expand_nested, select_backbone
from helixloom.sources.storage import Log, stored_by_size

#: Later copies of a split block come nearer to it: their path ends with this number less the round.
FAR = 1 << 40
ROOT = "cast(array() as array<bigint>)"


#: Fields of a block beside keys and path, the round that wrote it first.
BLOCK = ("no", "parent", "cycle_id", "base", "cnt", "times", "depth")


def _root(spine: DataFrame, keys: list[str]) -> DataFrame:
    """The only block of a fresh walk, which stands once and holds the backbone's tokens."""
    return spine.select(
        *keys, F.expr(ROOT).alias("path"), F.lit(0).cast("long").alias("no"), F.expr("cast(null as array<bigint>)").alias("parent"), F.col("cycle_id").cast("string").alias("cycle_id"),
        F.col("tokens").alias("base"), F.lit(1).cast("long").alias("cnt"), F.lit(1).cast("long").alias("times"), F.lit(0).alias("depth"),
    )


def _latest(versions: DataFrame, keys: list[str]) -> DataFrame:
    return versions.groupBy(*keys, "path").agg(F.max(F.struct(*BLOCK)).alias("now")).select(*keys, "path", "now.*")


def _place(i) -> F.Column:
    """The path of the i-th token (from 0) of the block with the column ``path``; there is room before and behind it."""
    zero = F.lit(0).cast("long")
    return F.concat("path", F.array(i.cast("long"), zero, zero))


def _nodes(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks and their tokens as nested nodes; times: how often the whole walk reads one."""
    tokens = blocks.select(*keys, "path", "times", "depth", F.posexplode("base").alias("i", "token"))
    tokens = tokens.select(
        *keys, F.col("path").alias("parent"), _place(F.col("i")).alias("path"), "token", F.lit(None).cast("string").alias("cycle_id"), F.lit(None).cast("array<string>").alias("base"),
        F.lit(None).cast("long").alias("cnt"), "times", (F.col("depth") + 1).alias("depth"),
    )
    return blocks.select(*keys, "parent", "path", F.lit(None).cast("string").alias("token"), "cycle_id", "base", "cnt", "times", "depth").unionByName(tokens)


#: Fields of a site, in the order in which sites are preferred.
SITE = ("rank", "cycle_id", "way", "turn", "unit", "kind", "unlike", "block", "at", "tokens", "token", "k", "share", "times", "used")


def _best(sites: DataFrame, keys: list[str]) -> DataFrame:
    return sites.select(*keys, F.struct(*SITE).alias("best")).groupBy(*keys).agg(F.min("best").alias("best"))


def _spots(blocks: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Where the asked segments (keys.., cycle_id, tokens, seg, turn, left, rank) fit.

    A block holds an anchor at its first token of that segment. Blocks are asked in reading order, the root first: for a token of their own (kind 0), then for one in an inner
    block of another cycle (kind 1), best one that stands as often as copies are due.
    """
    first = blocks.select(*keys, "path", F.posexplode("base").alias("i", "token")).groupBy(*keys, "path", segment_of(F.col("token")).alias("seg"))
    first = first.agg(F.min(F.struct("i", "token")).alias("spot"))
    first = first.select(*keys, "seg", F.col("path").alias("block"), F.struct(_place(F.col("spot.i")).alias("path"), "spot.token").alias("spot"))
    held = blocks.select(*keys, F.col("path").alias("block"), F.col("parent").alias("outer"), F.col("cycle_id").alias("owner"), F.col("cnt").alias("k"), "times")
    site = asked.join(first, [*keys, "seg"]).join(held, [*keys, "block"])
    ways = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("block").alias("unit"), F.expr("left div times").alias("share"), F.col("times").alias("m")),
        F.when(F.expr("outer is not null and owner <> cycle_id"), F.struct(F.lit(1).alias("kind"), F.col("outer").alias("unit"), F.expr("left div (times div k)").alias("share"), F.expr("times div k").alias("m"))),
    )
    site = site.select("*", F.explode(F.array_compact(ways)).alias("w")).select("*", "w.*").where("share > 0")
    unlike = F.when((F.col("kind") == 1) & (F.col("k") != F.col("share")), 1).otherwise(0)
    used = F.when((F.col("kind") == 0) | (F.col("k") > F.col("share")), F.col("share") * F.col("m")).otherwise(F.expr("share div k * k * m"))
    return site.select(*keys, "rank", "cycle_id", F.lit(1).alias("way"), "turn", "unit", "kind", unlike.alias("unlike"), "block", F.col("spot.path").alias("at"), "tokens", F.col("spot.token").alias("token"), "k", "share", "times", used.alias("used"))


def _sites(blocks: DataFrame, open_: DataFrame, keys: list[str]) -> DataFrame:
    """keys, best: the place that the next copies of each walk go to, by their anchors. Cycles are tried by falling need (``rank``, then id)."""
    asked = open_.select("*", F.lit(0).alias("turn"), segment_of(F.element_at("tokens", 1)).alias("seg"))
    return _best(_spots(blocks, asked, keys), keys)


def _late_sites(blocks: DataFrame, open_: DataFrame, keys: list[str]) -> DataFrame:
    """As _sites, where no anchor fits anywhere: an equal block that holds no other is repeated more often (kind 2), or a cycle is turned to another of its segments."""
    turns = F.posexplode(F.array_distinct(F.transform("tokens", segment_of))).alias("turn", "seg")
    asked = open_.select("*", turns).where("turn > 0")
    turned = _spots(blocks, asked.withColumn("tokens", reanchor(F.col("tokens"), F.col("seg"))), keys)
    inner = blocks.select(*keys, F.col("parent").alias("path")).where("path is not null").distinct()
    plain = blocks.where("parent is not null").join(inner, [*keys, "path"], "left_anti")
    plain = plain.select(*keys, F.col("path").alias("block"), F.col("parent").alias("unit"), F.col("cnt").alias("k"), "times", "base")
    twin = open_.join(plain, keys).where((F.col("base") == F.col("tokens")) | (F.col("base") == reverse_complement(F.col("tokens"))))
    twin = twin.withColumn("share", F.expr("left div (times div k)")).where("share > 0")
    longer = twin.select(*keys, "rank", "cycle_id", F.lit(0).alias("way"), F.lit(0).alias("turn"), "unit", F.lit(2).alias("kind"), F.lit(0).alias("unlike"), "block", F.col("block").alias("at"), "tokens", F.lit(None).cast("string").alias("token"), "k", "share", "times", F.expr("share * (times div k)").alias("used"))
    return _best(turned.unionByName(longer), keys)


def _changes(blocks: DataFrame, sites: DataFrame, keys: list[str]) -> DataFrame:
    """The blocks that are new or other when each walk's best site (sites: keys, best, no of the round) is taken."""
    both = blocks.drop("no").join(sites, keys)
    split, longer = F.expr("best.kind = 1 and best.k > best.share"), F.expr("best.kind = 2")
    mine = F.col("path") == F.col("best.block")
    touched = both.where((split | longer) & (F.slice("path", F.lit(1), F.size("best.block")) == F.col("best.block")))
    # a split block and all in it are read as often as there are copies; a longer one so many times more
    copies = F.when(split, F.col("best.share")).otherwise(F.expr("best.k + best.share"))
    now = touched.select(
        *keys, "path", "no", "parent", "cycle_id", "base", F.when(mine, copies).otherwise(F.col("cnt")).alias("cnt"), (F.expr("times div best.k") * copies).alias("times"), "depth",
    )
    # the repetitions of a split block that get no copy follow as a block of their own
    spot = F.array(F.lit(FAR) - F.col("no"))
    behind = lambda p: F.concat(F.col("best.block"), spot, F.slice(p, F.size("best.block") + 1, F.size(p)))
    rest = touched.where(split).select(
        *keys, behind(F.col("path")).alias("path"), "no", F.when(mine, F.col("parent")).otherwise(behind(F.col("parent"))).alias("parent"), "cycle_id", "base",
        F.when(mine, F.col("cnt") - F.col("best.share")).otherwise(F.col("cnt")).alias("cnt"), F.expr("times div best.k * (best.k - best.share)").alias("times"), "depth",
    )
    each = F.expr("case when best.kind = 0 then best.share when best.k > best.share then 1 else best.share div best.k end")
    times = F.when(split, F.expr("best.times div best.k * best.share")).otherwise(F.col("best.times"))
    same = F.col("best.token") == F.element_at("best.tokens", 1)
    at = F.concat(F.slice("best.at", F.lit(1), F.size("best.at") - 2), F.when(same, F.array(F.lit(-1).cast("long"), F.col("no"))).otherwise(F.array(F.lit(1).cast("long"), -F.col("no"))))
    turned = F.when(same, F.col("best.tokens")).otherwise(reverse_complement(F.col("best.tokens")))
    new = both.where(mine & F.expr("best.kind < 2")).select(
        *keys, at.alias("path"), "no", F.col("path").alias("parent"), F.col("best.cycle_id").alias("cycle_id"), turned.alias("base"), each.cast("long").alias("cnt"),
        (times * each).cast("long").alias("times"), (F.col("depth") + 1).alias("depth"),
    )
    return now.unionByName(rest).unionByName(new)


#: Every so many rounds it is seen whether half of the walks are done or stuck, and these leave the tables.
RETIRE = 8


def splice(spine: DataFrame, pending: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, left) from spine(keys.., cycle_id, tokens) and pending(keys.., cycle_id, tokens turned to the anchor, left, weight, draw): the finished node
    tables, and for every key the copies that found no place.

    In each round a walk takes one site. Rounds by anchors go on until no walk has such a site; then walks with copies left take a late one, and so on.
    The copies left are those at first less the copies used by all sites so far. Blocks and sites are logs, to which a round adds its own.
    """
    log = Log(_root(spine, keys), "walk-blocks")
    pending = stored_by_size(pending.withColumn("cycle_id", F.col("cycle_id").cast("string")).withColumnRenamed("left", "due"), "walk-pending")
    used = Log(pending.select(*keys, "cycle_id", F.col("due").alias("used")).where("false"), "walk-used")
    rank = F.when(F.col("draw").isNull(), F.col("weight") * F.col("left")).otherwise(F.col("draw")).alias("rank")
    done, begun, no = [], None, 0

    def left() -> DataFrame:
        spent = used.rows().groupBy(*keys, "cycle_id").agg(F.sum("used").alias("used"))
        return pending.join(spent, [*keys, "cycle_id"], "left").withColumn("left", F.col("due") - F.coalesce("used", F.lit(0))).drop("due", "used")

    while True:
        no += 1
        open_ = left().where("left > 0").select("*", rank)
        blocks = _latest(log.rows(), keys)
        # the round's number goes on as a column, so that the code that Spark generates for a round serves all rounds
        sites = stored_by_size(_sites(blocks, open_, keys).withColumn("no", F.lit(no).cast("long")), "walk-sites")
        if sites.isEmpty():
            sites = stored_by_size(_late_sites(blocks, open_, keys).withColumn("no", F.lit(no).cast("long")), "walk-sites")
            if sites.isEmpty():
                break
        log.add(_changes(blocks, sites, keys))
        used.add(sites.select(*keys, F.col("best.cycle_id").alias("cycle_id"), F.col("best.used").alias("used")))
        if no % RETIRE == 0:
            live = stored_by_size(left().where("left > 0").select(*keys).distinct(), "walk-live")
            count = live.count()
            begun = spine.count() if begun is None else begun
            if 2 * count <= begun:
                blocks = _latest(log.rows(), keys)
                done.append(stored_by_size(blocks.join(live, keys, "left_anti"), "walk-done"))
                log, begun = Log(blocks.join(live, keys, "left_semi"), "walk-blocks"), count
    blocks = _latest(log.rows(), keys)
    for x in done:
        blocks = blocks.unionByName(x)
    return stored_by_size(_nodes(blocks, keys), "walk-nodes"), left().groupBy(*keys).agg(F.sum("left").alias("left"))


def walk_nodes(cycles: DataFrame, segments: DataFrame, keys: list[str], source="source", sink="sink", ends: DataFrame | None = None, replicates: int = 1, seed: int = 0):
    """(nodes, state): the node tables of all walks by keys and map_no, and for each of these whether it is valid."""
    cycles = stored_by_size(cycles.select(*keys, "cycle_id", "cnt", "tokens"), "walk-input")
    backbone = stored_by_size(select_backbone(cycles, segments, keys, source, sink, ends), "walk-backbone")
    anchors = choose_anchors(cycles, backbone, keys)
    sizes = cycle_stats(cycles, segments, [*keys, "cycle_id"]).select(*keys, "cycle_id", "length")
    turned = reanchor(canonical_start(F.col("tokens")), F.col("anchor"))
    rest = cycles.join(anchors, [*keys, "cycle_id"]).join(sizes, [*keys, "cycle_id"])
    rest = stored_by_size(rest.select(*keys, "cycle_id", F.col("cnt").cast("long").alias("left"), F.col("length").alias("weight"), "anchor", turned.alias("tokens")), "walk-cycles")
    maps = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("map_no")
    loose = rest.where("anchor is null").select(*keys).distinct()
    spine = stored_by_size(backbone.join(loose, keys, "left_anti").select(*keys, maps, "cycle_id", "tokens"), "walk-spines")
    draw = F.when(F.col("map_no") > 1, F.xxhash64(F.lit(seed), F.col("map_no"), F.col("cycle_id").cast("string")))
    pending = rest.where("anchor is not null").select(*keys, maps, "cycle_id", "tokens", "left", "weight").withColumn("draw", draw)
    by = [*keys, "map_no"]
    nodes, left = splice(spine, pending.join(spine.select(*by), by, "left_semi"), by)
    state = cycles.select(*keys).distinct().select(*keys, maps).join(spine.select(*by, F.lit(True).alias("begun")), by, "left").join(left, by, "left")
    return nodes, stored_by_size(state.select(*by, (F.coalesce("begun", F.lit(False)) & (F.coalesce("left", F.lit(0)) == 0)).alias("valid")), "walk-state")


def assemble_walks(cycles: DataFrame, segments: DataFrame, keys: list[str], source="source", sink="sink", ends: DataFrame | None = None, replicates: int = 1, seed: int = 0) -> DataFrame:
    """keys, map_no, valid, walk: for each key with a backbone the walk that uses all copies of its cycles (keys.., cycle_id, cnt, tokens).

    source and sink name the end segments of all keys, or ends (some of the keys, source, sink) those of each. map_no runs to ``replicates``: the first
    takes cycles by length times copies left, the others in an order drawn from the seed. A key without a backbone, with a cycle that shares no segment, or with
    copies that find no place is invalid and has a null walk. Of equal choices the smaller id (as text) goes first. segments may have some of the keys.
    """
    nodes, state = walk_nodes(cycles, segments, keys, source, sink, ends, replicates, seed)
    by = [*keys, "map_no"]
    good = nodes.join(state.where("valid"), by, "left_semi")
    # written, so that these joins are planned by measured sizes too
    return stored_by_size(state.join(expand_nested(good, by), by, "left").select(*by, "valid", "walk"), "walks")

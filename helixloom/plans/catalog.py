"""Registered queries of the interval, copy-number and walk operators, with their SQL.

Every query runs over whole tables by way of the views in views.py; the SQL states the same result plainly,
without the operators' binning or running sums.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixloom.functions import tokens as T
from helixloom.operators import assemble, best, cycles, depth, distributions, intervals, links, ranking, segments, tracks
from helixloom.plans import views as V
from helixloom.plans.views import duck
from helixloom.sources import readers, writers
from helixloom.sources.storage import measured_broadcasts, new_folder, stored

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = ""):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = duck(views, sql)
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{new_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- depth -----------------------------------------------------------------------------------------------

KEY = ["sample", "tissue", "refseg"]
RUNS = """isles as (select *, pos - row_number() over (partition by sample, tissue, refseg, depth order by pos) as isle from v_depth)"""


@query(f"with {RUNS} select sample, tissue, refseg, min(pos)::bigint as st, max(pos)::bigint as ed, depth::bigint as depth from isles group by sample, tissue, refseg, depth, isle", "v_depth")
def c1_coverage(spark, d):
    return V.v_depth(spark, d)


@query("select sample, tissue, refseg, sum(depth)::bigint as bases, count(*)::bigint as covered, max(depth)::bigint as deepest from v_depth group by all", "v_depth")
def c1_coverage_totals(spark, d):
    runs = V.v_depth(spark, d).withColumn("n", F.expr("ed - st + 1"))
    return runs.groupBy(*KEY).agg(F.sum(F.col("depth") * F.col("n")).alias("bases"), F.sum("n").alias("covered"), F.max("depth").alias("deepest"))


LAYOUT = """lay as (select *, ((ed - st + 1 + res - 1) // res) as n, coalesce(sum((ed - st + 1 + res - 1) // res) over (partition by refseg order by st rows between unbounded preceding and 1 preceding), 0)::bigint as before from v_resol),
win as (select v.*, before + (pos - st) // res + 1 as win, st + ((pos - st) // res) * res as win_st, least(st + ((pos - st) // res + 1) * res - 1, ed) as win_ed, res from v_depth v join lay using (refseg) where pos between st and ed)"""
MEANS = LAYOUT + ",\nmeans as (select sample, tissue, refseg, win, win_st as st, win_ed as ed, sum(depth) / count(*) as mean, count(*)::bigint as n from win group by all)"
FACTS = """facts as (select *, pp * tt as t_part, (1 - pp) * nn as n_part from (select *, coalesce(nullif(purity, 0), 1) as pp, coalesce(nullif(ploidy_t, 0), 2) as tt, coalesce(nullif(ploidy_n, 0), 2) as nn from v_facts))"""
ADJUST = (
    MEANS
    + f""", {FACTS},
adjusted as (select m.*, case when f.mean_case is null then mean when tissue = 'case' then mean - f.mean_case * (n_part / (t_part + n_part)) * 1.0 else mean * f.mean_case * (t_part / (t_part + n_part)) / f.mean_ctrl end as adj from means m left join facts f using (sample))"""
)


def windowed(spark, d):
    return depth.cut_windows(V.v_depth(spark, d), V.v_resol(spark, d))


def window_means(spark, d):
    rows = windowed(spark, d)
    return depth.window_mean(rows, [*KEY, "win", "win_st", "win_ed"]).withColumnsRenamed({"win_st": "st", "win_ed": "ed"})


def adjusted(spark, d):
    return depth.adjust_depth(window_means(spark, d), V.v_facts(spark, d))


@query(
    f"with {LAYOUT} select sample, tissue, refseg, win::bigint as win, win_st::bigint as win_st, win_ed::bigint as win_ed, res::bigint as res, count(*)::bigint as bases, sum(depth * pos)::bigint as moment from win group by all",
    "v_depth v_resol",
)
def c2_assign_windows(spark, d):
    """Pieces of runs by window, added up so that every base and its place count."""
    place = F.expr("sum(depth * ((st + ed) * (ed - st + 1) div 2))").alias("moment")
    return windowed(spark, d).groupBy(*KEY, "win", "win_st", "win_ed", "res").agg(F.expr("sum(ed - st + 1) as bases"), place)


@query("select refseg, ceil((ed - st + 1) / 64)::bigint as res from v_region union all select sample || refseg, ceil(sum(ed - st + 1) / 64)::bigint from v_reads group by sample || refseg", "v_region v_reads")
def c3_auto_resolution(spark, d):
    reads = V.v_reads(spark, d).selectExpr("sample || refseg as refseg", "st", "ed")
    return depth.auto_resolution(V.v_region(spark, d).unionByName(reads), 64)


PRIOR = "prior(refseg, st, ed, ratio) as (values ('S0', 1::bigint, 300::bigint, 1.5::double), ('S1', 50, 250, 0.5), ('S1', 260, 265, 0.25))"


def prior(spark):
    return spark.createDataFrame([("S0", 1, 300, 1.5), ("S1", 50, 250, 0.5), ("S1", 260, 265, 0.25)], "refseg string, st long, ed long, ratio double")


@query(
    f"with {PRIOR} select sample, tissue, v.refseg, coalesce(ratio, 1.0)::double as ratio, count(*)::bigint as bases, sum(pos * depth)::bigint as moment from v_depth v left join prior p on v.refseg = p.refseg and pos between st and ed group by all",
    "v_depth",
)
def c4_prior_ratio(spark, d):
    pieces = depth.prior_ratio(V.v_depth(spark, d), prior(spark))
    return pieces.groupBy(*KEY, "ratio").agg(F.expr("sum(ed - st + 1) as bases"), F.expr("sum(depth * ((st + ed) * (ed - st + 1) div 2))").alias("moment"))


@query(
    f"""with {LAYOUT}, {PRIOR},
stable as (select sample, v.refseg, pos from v_depth v left join prior p on v.refseg = p.refseg and pos between st and ed where tissue = 'ctrl' and depth between 2 * (1 - 0.4) * coalesce(ratio, 1) and 2 * (1 + 0.4) * coalesce(ratio, 1))
select sample, tissue, refseg, win::bigint as win, count(*)::bigint as n from win where res < 25 or exists (select 1 from stable s where s.sample = win.sample and s.refseg = win.refseg and s.pos = win.pos) group by all""",
    "v_depth v_resol",
)
def c5_stable_positions(spark, d):
    runs = stored(V.v_depth(spark, d), "runs")  # coverage is summed up once, for the windows and for the control
    stable = depth.stable_positions(runs, prior(spark), 2.0, 0.4)
    return depth.keep_stable(depth.cut_windows(runs, V.v_resol(spark, d)), stable, 25).groupBy(*KEY, "win").agg(F.expr("sum(ed - st + 1) as n"))


@query(f"with {MEANS} select sample, tissue, refseg, win::bigint as win, mean, n from means", "v_depth v_resol")
def c6_window_mean(spark, d):
    return window_means(spark, d).select(*KEY, "win", "mean", "n")


@query(
    f"""with {LAYOUT}, r as (select *, row_number() over w as i, count(*) over (partition by sample, tissue, refseg, win) as n from win window w as (partition by sample, tissue, refseg, win order by depth, pos))
select sample, tissue, refseg, win::bigint as win, sum(depth) / count(*) as mean, count(*)::bigint as n from r where i > floor(n * 0.2) and i <= n - floor(n * 0.2) group by all""",
    "v_depth v_resol",
)
def c6_window_mean_trim(spark, d):
    return depth.window_mean(windowed(spark, d), [*KEY, "win"], "trim", 0.2)


@query(
    f"""with {LAYOUT}, r as (select *, avg(depth) over w as m, round(sqrt(greatest(0, count(*) over w * sum(depth * depth) over w - sum(depth) over w * sum(depth) over w)) / count(*) over w, 9) as s from win window w as (partition by sample, tissue, refseg, win))
select sample, tissue, refseg, win::bigint as win, sum(depth) / count(*) as mean, count(*)::bigint as n from r where abs(depth - m) <= 3 * s + 1e-9 group by all""",
    "v_depth v_resol",
)
def c6_window_mean_sd3(spark, d):
    return depth.window_mean(windowed(spark, d), [*KEY, "win"], "sd3")


@query(f"with {ADJUST} select sample, tissue, refseg, win::bigint as win, round(adj, 6) as adj from adjusted", "v_depth v_resol v_facts")
def c7_adjust_depth(spark, d):
    return adjusted(spark, d).select(*KEY, "win", F.round("adj", 6).alias("adj"))


ENDS = """ends as (
  select sample, junc_no, '5p' as side, refseg_5p as refseg, bkpos_5p as pos, strd_5p as strd from v_junc
  union all select sample, junc_no, '3p', refseg_3p, bkpos_3p, strd_3p from v_junc),
inside as (select e.* from ends e join v_region r on r.refseg = e.refseg and pos between st and ed)"""
BREAKS = "breaks as (select distinct i.sample, i.refseg, before + (pos - st) // res + 1 as win from inside i join lay l on l.refseg = i.refseg and pos between st and ed)"


def inside(spark, d):
    return segments.breakends(V.v_junc(spark, d), V.v_region(spark, d))


@query(
    f"""with {ADJUST}, {ENDS}, {BREAKS},
marked as (select a.*, sum(case when b.win is null then 0 else 1 end) over (partition by a.sample, tissue, a.refseg order by a.win) as barrier from adjusted a left join breaks b on b.sample = a.sample and b.refseg = a.refseg and b.win = a.win)
select sample, tissue, refseg, win::bigint as win, round(avg(adj) over (partition by sample, tissue, refseg, barrier order by win range between 2 preceding and 2 following), 6) as show from marked""",
    "v_depth v_resol v_facts v_junc v_region",
)
def c8_smooth(spark, d):
    breaks = depth.assign_windows(inside(spark, d), V.v_resol(spark, d)).select("sample", "refseg", "win")
    return depth.smooth(adjusted(spark, d), breaks, 2).select(*KEY, "win", F.round("show", 6).alias("show"))


@query(f"with {ADJUST} select sample, tissue, refseg, round(max(adj), 6) as max_depth, max(win)::bigint as max_win from adjusted group by all", "v_depth v_resol v_facts")
def c9_depth_extent(spark, d):
    return depth.depth_extent(adjusted(spark, d), "adj").select(*KEY, F.round("max_depth", 6).alias("max_depth"), "max_win")


PURITY = """s as (select o_orderkey as sample, (o_orderkey % 11) / 10.0 as purity, (o_orderkey % 5)::double as pt, (o_orderkey % 3)::double as pn, o_totalprice as mean from orders),
a as (select *, coalesce(nullif(purity, 0), 1) as p, coalesce(nullif(purity, 0), 1) * coalesce(nullif(pt, 0), 2) as t, (1 - coalesce(nullif(purity, 0), 1)) * coalesce(nullif(pn, 0), 2) as n from s)"""


def purities(spark, d):
    return V.table(spark, d, "orders").selectExpr("o_orderkey as sample", "cast((o_orderkey % 11) / 10.0 as double) as purity", "cast(o_orderkey % 5 as double) as pt", "cast(o_orderkey % 3 as double) as pn", "o_totalprice as mean")


@query(f"with {PURITY} select sample, round(t, 6) as t_part, round(n, 6) as n_part, round(t / (t + n), 6) as t_ratio, round(n / (t + n), 6) as n_ratio from a")
def c10_admixture(spark, d):
    a = depth.admixture(F.col("purity"), F.col("pt"), F.col("pn"))
    return purities(spark, d).select("sample", *[F.round(v, 6).alias(k) for k, v in a.items()])


@query(f"with {PURITY} select sample, round(mean - 100 * (n / (t + n)) * 0.5, 9) as pure, round(mean / (t + n), 9) as single, round(1 / p / (mean / (t + n)), 11) as ratio from a")
def c11_c13_sample_ratios(spark, d):
    a = depth.admixture(F.col("purity"), F.col("pt"), F.col("pn"))
    pure = depth.subtract_admixture(F.col("mean"), F.lit(100.0), a["n_ratio"], F.lit(0.5))
    cols = [F.col(c) for c in ("mean", "purity", "pt", "pn")]
    return purities(spark, d).select("sample", F.round(pure, 9).alias("pure"), F.round(depth.single_copy_depth(*cols), 9).alias("single"), F.round(depth.sample_cn_ratio(*cols), 11).alias("ratio"))


BASELINE = "base as (select sample, t.* from v_facts, (values ('S0', 20::bigint, 60::bigint, 2.0::double, null::varchar), ('S1', 100, 140, 0.3, null), ('S2', 1, 250, 3.0, 'ctrl'), ('S3', 700, 720, 2.0, 'case'), ('S4', 400, 450, 1.0, null)) t(refseg, st, ed, cn, tissue))"


def baselines(spark, d):
    rows = [("S0", 20, 60, 2.0, None), ("S1", 100, 140, 0.3, None), ("S2", 1, 250, 3.0, "ctrl"), ("S3", 700, 720, 2.0, "case"), ("S4", 400, 450, 1.0, None)]
    text = ", ".join(f"struct('{r}' as refseg, {a}L as st, {b}L as ed, {c}D as cn, {'cast(null as string)' if t is None else repr(t)} as tissue)" for r, a, b, c, t in rows)
    return V.v_facts(spark, d).selectExpr("sample", f"inline(array({text}))")


@query(
    f"""with {ADJUST}, {ENDS}, {BASELINE},
good as (select * from base b where not exists (select 1 from inside i where i.sample = b.sample and i.refseg = b.refseg and pos > st and pos < ed)),
own as (select * from adjusted where tissue = 'case' or substr(sample, 2)::int % 5 <> 0),
told as (select g.* exclude (tissue), coalesce(g.tissue, case when g.sample in (select sample from own where tissue = 'ctrl') then 'ctrl' else 'case' end) as tissue from good g),
m as (select g.sample, g.refseg, g.st, g.ed, g.cn, avg(adj) as dep from told g left join own a on a.sample = g.sample and a.refseg = g.refseg and a.tissue = g.tissue and a.st <= g.ed and g.st <= a.ed group by all)
select sample, refseg, round(dep, 6) as depth, round(case when dep > 1 then (case when cn > 0.5 then cn else 2 end) / dep end, 8) as ratio from m""",
    "v_depth v_resol v_facts v_junc v_region",
)
def c14_baseline_ratio(spark, d):
    """Every fifth sample has no control."""
    own = adjusted(spark, d).where("tissue = 'case' or cast(substring(sample, 2) as int) % 5 <> 0")
    out = depth.baseline_cn_ratio(own, baselines(spark, d), inside(spark, d), 1.0)
    return out.select("sample", "refseg", F.round("depth", 6).alias("depth"), F.round("ratio", 8).alias("ratio"))


# --- segments --------------------------------------------------------------------------------------------

@query(f"with {ENDS} select * from inside", "v_junc v_region")
def d1_breakends(spark, d):
    return inside(spark, d).select("sample", "junc_no", "side", "refseg", "pos", "strd")


@query(f"with {ENDS} select sample, junc_no, case when count(*) = 2 then 'intra-SV' else 'inter-SV/vitg' end as kind from inside where refseg <> 'S4' group by all", "v_junc v_region")
def d2_classify_junctions(spark, d):
    return segments.classify_junctions(V.v_junc(spark, d), V.v_region(spark, d).where("refseg <> 'S4'")).select("sample", "junc_no", "kind")


@query(
    f"""with {LAYOUT}, {ENDS}, w as (select i.*, before + (pos - st) // res + 1 as win from inside i join lay l on l.refseg = i.refseg and pos between st and ed)
select sample, refseg, win::bigint as win, arg_max(pos, (junc_no, (side = '3p')::int, pos)) as pos from w group by all""",
    "v_depth v_resol v_junc v_region",
)
def d3_breakpoint_windows(spark, d):
    return segments.breakpoint_windows(depth.assign_windows(inside(spark, d), V.v_resol(spark, d)))


SEGS = f"""{ENDS},
cuts as (select distinct i.sample, i.refseg, case when (side = '5p') = (strd = '+') then pos else pos - 1 end as ed from inside i),
every as (select c.sample, c.refseg, c.ed from cuts c join v_region r on r.refseg = c.refseg and c.ed between r.st and r.ed union select distinct c.sample, c.refseg, r.ed from cuts c join v_region r on r.refseg = c.refseg),
segs as (select sample, refseg, row_number() over w as seg_no, coalesce(lag(ed) over w, 0) + 1 as st, ed from every window w as (partition by sample, refseg order by ed))"""


def cut(spark, d):
    return segments.segment_by_breakends(V.v_region(spark, d), inside(spark, d))


@query(f"with {SEGS} select sample, refseg, seg_no::bigint as seg_no, st::bigint as st, ed from segs", "v_junc v_region")
def d4_segment_by_breakends(spark, d):
    return cut(spark, d).select("sample", "refseg", F.col("seg_no").cast("long").alias("seg_no"), "st", "ed")


@query(f"with {SEGS} select sample, refseg, seg_no::bigint as seg_no, case when seg_no <= 26 then chr(64 + seg_no::int) end as upper, case when seg_no <= 24 then chr(98 + seg_no::int) end as lower, 'H' || (seg_no + 4) as named from segs", "v_junc v_region")
def d5_name_segments(spark, d):
    s = segments.name_segments(cut(spark, d), "u").withColumnRenamed("seg", "upper")
    s = segments.name_segments(s, "l:c").withColumnRenamed("seg", "lower")
    return segments.name_segments(s, "H:5").select("sample", "refseg", F.col("seg_no").cast("long").alias("seg_no"), "upper", "lower", F.col("seg").alias("named"))


@query(
    f"""with {SEGS} select i.sample, junc_no, side, i.refseg, pos, strd, min(s.seg_no)::bigint as seg_no from inside i left join segs s on s.sample = i.sample and s.refseg = i.refseg
and (case when (side = '5p') = (strd = '+') then s.ed else s.st end) = pos group by all""",
    "v_junc v_region",
)
def d6_map_breakends(spark, d):
    named = cut(spark, d).withColumn("seg", F.col("seg_no").cast("long"))
    return segments.map_breakends_to_segments(inside(spark, d), named).select("sample", "junc_no", "side", "refseg", "pos", "strd", F.col("seg").alias("seg_no"))


HALF_UP = "sign({x}) * floor(abs({x}) * 100 + 0.5) / 100"
CN = f"""sums as (select s.sample, s.refseg, s.seg_no, sum(round(a.adj * 1000000)::bigint) as t, count(*) as n from segs s join adjusted a on a.tissue = 'case' and a.sample = s.sample and a.refseg = s.refseg and a.st <= s.ed and s.st <= a.ed group by all),
ratio as (select sample, 1.0 / pp / (mean_case / (t_part + n_part)) as ratio, mean_case * (n_part / (t_part + n_part)) as normal from facts),
cn as (select s.*, sign(t) * ((2 * abs(t)::hugeint + n * 10000) // (2 * n * 10000))::double / 100 as depth, ratio from segs s left join sums using (sample, refseg, seg_no) left join ratio using (sample)),
jc as (select sample, junc_no, trunc(jr_count - normal * ncpr)::bigint as pure, ratio from v_junc left join ratio using (sample))"""


@query(
    f"""with {ADJUST}, {SEGS}, {CN}
select sample, 'segment' as kind, refseg as refseg, seg_no::bigint as id, st::bigint as st, ed as ed, depth as value, {HALF_UP.format(x="(depth * ratio)")} as cn from cn
union all select sample, 'junction', null, junc_no, null, null, pure::double, {HALF_UP.format(x="(pure * ratio)")} from jc""",
    "v_depth v_resol v_facts v_junc v_region",
)
def segment_copy_number(spark, d):
    """D7, D9 with C1, C2, C6, C7, C10-C13, D1, D4: copy number of each segment and junction of each sample."""
    case = adjusted(spark, d).where("tissue = 'case'")
    facts = V.v_facts(spark, d)
    ratio = depth.sample_cn_ratio(*(F.col(k) for k in ("mean_case", "purity", "ploidy_t", "ploidy_n")))
    a = depth.admixture(F.col("purity"), F.col("ploidy_t"), F.col("ploidy_n"))
    facts = facts.select("sample", "mean_case", ratio.alias("ratio"), a["n_ratio"].alias("n_ratio"))
    seg = segments.segment_cn(cut(spark, d).join(facts, "sample", "left"), case, F.col("ratio"))
    junc = segments.junction_cn(V.v_junc(spark, d).join(facts, "sample", "left"), F.col("ratio"), F.col("mean_case"), F.col("n_ratio"))
    left = seg.selectExpr("sample", "'segment' as kind", "refseg", "cast(seg_no as bigint) as id", "st", "ed", "depth as value", "cn")
    return left.unionByName(junc.selectExpr("sample", "'junction' as kind", "cast(null as string) as refseg", "junc_no as id", "cast(null as bigint) as st", "cast(null as bigint) as ed", "cast(pure as double) as value", "cn"))


@query("select p_partkey as seg, sign(p_retailprice) * floor(abs(p_retailprice * 0.25) * 100 + 0.5) / 100 as cn from part")
def d8_feature_cn(spark, d):
    return segments.feature_cn(V.table(spark, d, "part").select(F.col("p_partkey").alias("seg"), "p_retailprice"), F.lit(0.25), "p_retailprice").select("seg", "cn")


@query(f"with {SEGS} select sample, refseg, 'H' || min(seg_no) as source, 'H' || max(seg_no) as sink from segs group by all", "v_junc v_region")
def d10_source_sink(spark, d):
    return segments.source_sink(segments.name_segments(cut(spark, d)))


@query(f"with {SEGS} select sample, refseg, string_agg('V' || seg_no || '+', ',' order by seg_no) as chain from segs group by sample, refseg", "v_junc v_region")
def d11_feature_chain(spark, d):
    return segments.feature_chain(segments.name_segments(cut(spark, d), "V"))


@query(f"with {SEGS} select s.sample, s.refseg, s.seg_no::bigint as seg_no, count(*)::bigint as n, sum(least(s.ed, r.ed) - greatest(s.st, r.st) + 1)::bigint as bases from segs s join v_reads r on r.sample = s.sample and r.refseg = s.refseg and r.st <= s.ed and s.st <= r.ed group by all", "v_junc v_region v_reads")
def d12_overlaps(spark, d):
    segs = stored(cut(spark, d).select("sample", "refseg", "seg_no", "st", "ed"), "segments")  # read three times
    hit = intervals.interval_join(V.v_reads(spark, d).select("sample", "refseg", "st", "ed"), segs, ["sample", "refseg"])
    return hit.groupBy("sample", "refseg", F.col("seg_no").cast("long").alias("seg_no")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("least(ed, r_ed) - greatest(st, r_st) + 1")).alias("bases"))


@query("select refseg, greatest(st, 100)::bigint as st, least(ed, 180)::bigint as ed, molecule from v_reads where greatest(st, 100) <= least(ed, 180)", "v_reads")
def d13_clip(spark, d):
    return intervals.clip(V.v_reads(spark, d), F.lit(100).cast("long"), F.lit(180).cast("long")).select("refseg", "st", "ed", "molecule")


VIOL = """gs as (select 's' || (l_linenumber % 3) as sample, case when l_partkey % 97 = 0 then 'X' else 'H' end || l_orderkey || l_suppkey as seg, 'S' || (l_suppkey % 5) || '_' || (l_orderkey // 100) as refseg, l_partkey as st, l_partkey + 3 as ed,
  case when l_linenumber = 7 then null else l_orderkey // 100 end as group_id from lineitem),
gj as (select 's' || (l_linenumber % 3) as sample, 'JUNC' || l_orderkey || '_' || l_suppkey as junc_id, 'H' || l_orderkey || l_suppkey as seg5, 'H' || (l_orderkey + 32) || l_suppkey as seg3 from lineitem),
gc as (select 's' || (event_id % 3) as sample, user_id % 40 as cycle_id, 'H' || event_id as seg from events),
gp as (select 's' || (l_linenumber % 3) as sample, 'JUNC' || l_orderkey || '_' || (l_suppkey + l_partkey % 2) as a, 'n' || l_quantity::bigint as b from lineitem),
gn as (select distinct 's' || (c_custkey % 4) as sample, c_custkey as owner, c_custkey % 60 as cycle_id from customer),
gb as (select 's' || (p_partkey % 3) as sample, 'S' || (p_partkey % 5) as refseg, p_partkey as st, p_partkey + 9 as ed from part),
gk as (select 's' || (l_linenumber % 3) as sample, 'S' || (l_suppkey % 5) as refseg, l_partkey * 3 as pos from lineitem),
gr as (select 's' || (l_linenumber % 3) as sample, l_quantity::bigint as len, (l_linenumber - 2) / 4.0::double as ratio from lineitem)"""


@query(
    f"""with {VIOL}, sides as (select sample, junc_id, unnest([seg5, seg3]) as seg from gj)
select a.sample, 'overlap' as rule, a.seg as key, b.seg as detail from gs a join gs b on a.sample = b.sample and a.refseg = b.refseg and a.st <= b.ed and b.st <= a.ed and a.seg < b.seg
union all select sample, 'segment id', seg, refseg from gs where not regexp_matches(seg, '^[HV][0-9]+$')
union all select sample, 'segment twice', seg, count(*)::varchar from gs group by sample, seg having count(*) > 1
union all select sample, 'cycle twice', cycle_id::varchar, count(*)::varchar from gc group by sample, cycle_id having count(*) > 1
union all select distinct sample, 'unknown segment', cycle_id::varchar, seg from gc where (sample, seg) not in (select sample, seg from gs)
union all select sample, 'junction without segment', junc_id, seg from sides where (sample, seg) not in (select sample, seg from gs)
union all select sample, 'no group', seg, refseg from gs where seg like 'H%' and group_id is null
union all select sample, 'group mismatch', junc_id, min(group_id) || ',' || max(group_id) from sides join gs using (sample, seg) where group_id is not null group by sample, junc_id having min(group_id) <> max(group_id)
union all select sample, 'pair twice', k, count(*)::varchar from (select sample, least(a, b) || ';' || greatest(a, b) as k from gp) group by sample, k having count(*) > 1
union all select distinct sample, 'unknown junction', a, null from gp where (sample, a) not in (select sample, junc_id from gj)
union all select sample, 'unknown cycle', cycle_id::varchar, owner::varchar from gn where (sample, cycle_id) not in (select sample, cycle_id from gc)
union all select gb.sample, 'baseline with breakpoint', gb.refseg || ':' || st || '-' || ed, min(pos)::varchar from gb join gk on gk.sample = gb.sample and gk.refseg = gb.refseg and pos > st and pos < ed group by gb.sample, gb.refseg, st, ed
union all select sample, 'ratio out of range', len::varchar, ratio::varchar from gr where ratio < 0 or ratio > 1"""
)
def d14_violations(spark, d):
    line = V.table(spark, d, "lineitem").withColumn("sample", F.expr("concat('s', l_linenumber % 3)"))
    s = line.selectExpr("sample", "concat(if(l_partkey % 97 = 0, 'X', 'H'), l_orderkey, l_suppkey) as seg", "concat('S', l_suppkey % 5, '_', l_orderkey div 100) as refseg", "l_partkey as st", "l_partkey + 3 as ed", "if(l_linenumber = 7, null, l_orderkey div 100) as group_id")
    j = line.selectExpr("sample", "concat('JUNC', l_orderkey, '_', l_suppkey) as junc_id", "concat('H', l_orderkey, l_suppkey) as seg5", "concat('H', l_orderkey + 32, l_suppkey) as seg3")
    c = V.table(spark, d, "events").selectExpr("concat('s', event_id % 3) as sample", "user_id % 40 as cycle_id", "concat('H', event_id) as seg")
    pairs = line.selectExpr("sample", "concat('JUNC', l_orderkey, '_', l_suppkey + l_partkey % 2) as anchor_a", "concat('n', cast(l_quantity as bigint)) as anchor_b")
    counts = V.table(spark, d, "customer").selectExpr("concat('s', c_custkey % 4) as sample", "c_custkey as owner", "c_custkey % 60 as cycle_id")
    baselines = V.table(spark, d, "part").selectExpr("concat('s', p_partkey % 3) as sample", "concat('S', p_partkey % 5) as refseg", "p_partkey as st", "p_partkey + 9 as ed")
    breakpoints = line.selectExpr("sample", "concat('S', l_suppkey % 5) as refseg", "l_partkey * 3 as pos")
    ratios = line.selectExpr("sample", "cast(l_quantity as bigint) as len", "cast((l_linenumber - 2) / 4 as double) as ratio")
    return segments.violations(s, j, c.select("sample", "cycle_id"), c, pairs=pairs, counts=counts, baselines=baselines, breakpoints=breakpoints, ratios=ratios)


@query(f"with {SEGS} select sample, refseg, seg_no::bigint as seg_no, lead(seg_no) over w::bigint as next_no, (lead(st) over w = ed + 1) as touches from segs window w as (partition by sample, refseg order by st)".replace("lead(seg_no) over w::bigint", "(lead(seg_no) over w)::bigint"), "v_junc v_region")
def d15_adjacency(spark, d):
    s = cut(spark, d).withColumn("seg", F.col("seg_no").cast("long"))
    return segments.adjacency(s).select("sample", "refseg", F.col("seg").alias("seg_no"), F.col("next_seg").alias("next_no"), "touches")


@query(
    """with s as (select c_custkey as sample, (c_custkey % 5) || 'm' || (c_custkey % 3) as code from customer),
p as (select *, regexp_extract(code, '^(\\d+)m', 1)::int - regexp_extract(code, 'm(\\d+)$', 1)::int as major, regexp_extract(code, 'm(\\d+)$', 1)::int as minor from s),
e as (select *, unnest(['Major', 'minor']) as dropped from p)
select *, case when minor = 0 then 'LOH' when minor = major then 'vItg' when dropped = 'Major' then 'vItg_on_minor' else 'vItg_on_Major' end as tag from e where not (dropped = 'Major' and (minor = 0 or minor = major))"""
)
def d16_allele_scenarios(spark, d):
    return segments.allele_scenarios(V.table(spark, d, "customer").selectExpr("c_custkey as sample", "concat(c_custkey % 5, 'm', c_custkey % 3) as code"))


# --- tracks ----------------------------------------------------------------------------------------------

@query("select t.refseg, gene, tid, greatest(t.st, 50)::bigint as st, least(t.ed, 150)::bigint as ed from v_track t where t.st <= 150 and t.ed >= 50", "v_track")
def e1_track_in_region(spark, d):
    region = V.v_region(spark, d).selectExpr("refseg", "50L as st", "150L as ed")
    return tracks.track_in_region(V.v_track(spark, d), region).select("refseg", "gene", "tid", "st", "ed")


@query("select refseg, gene, tid, st, ed from v_track where gene in (3, 7, 11)", "v_track")
def e2_track_allowlist(spark, d):
    return tracks.track_allowlist(V.v_track(spark, d), [3, 7, 11])


@query(
    """with best as (select refseg, gene, arg_min(tid, (case tid when '001' then 0 when '201' then 1 else 2 end, tid)) as tid from v_track group by all)
select t.* from v_track t join best using (refseg, gene, tid)""",
    "v_track",
)
def e3_representative_transcript(spark, d):
    return tracks.representative_transcript(V.v_track(spark, d)).select("refseg", "gene", "tid", "st", "ed")


@query(
    """with p as (select 'S' || (p_partkey % 5) as refseg, 'part' || p_partkey as gene, unnest([1, 2]) as i, p_partkey as k from part)
select refseg, gene, i::varchar as tid, greatest(case i when 1 then k else k + 20 end, 10)::bigint as st, least(case i when 1 then k + 9 else k + 20 + k % 7 end, 900)::bigint as ed from p
where greatest(case i when 1 then k else k + 20 end, 10) <= least(case i when 1 then k + 9 else k + 20 + k % 7 end, 900)"""
)
def e4_user_regions(spark, d):
    specs = V.table(spark, d, "part").selectExpr("concat('S', p_partkey % 5) as refseg", "concat('part', p_partkey, ':', p_partkey, '-', p_partkey + 9, ',', p_partkey + 20, '-', p_partkey + 20 + p_partkey % 7) as spec")
    region = V.v_region(spark, d).selectExpr("refseg", "10L as st", "900L as ed")
    return tracks.track_in_region(tracks.user_regions(specs), region).select("refseg", "gene", "tid", "st", "ed")


# --- cycles and walks ------------------------------------------------------------------------------------

TOKS = """ct as (select sample, allele, cycle_id, cnt, unnest(tokens) as token, unnest(range(len(tokens))) as ord from v_cycles),
cs as (select *, left(token, len(token) - 1) as seg, right(token, 1) as orit from ct)"""
FLIP = "left(x, len(x) - 1) || translate(right(x, 1), '+-', '-+')"
TURNS = "list_transform(range(len({t})), lambda k: list_concat(list_slice({t}, k + 1, len({t})), list_slice({t}, 1, k)))"


@query("select allele, cycle_id, tokens, list_transform(list_reverse(tokens), lambda x: " + FLIP + ") as rc from v_cycles", "v_cycles")
def f1_f4_parse_and_reverse(spark, d):
    text = F.concat_ws(";", "tokens", F.element_at("tokens", 1))  # closed by its first token
    c = V.v_cycles(spark, d).select("allele", "cycle_id", "tokens", T.parse_cycle(text).alias("parsed"))
    tokens = F.when(F.element_at("tokens", 1) == F.element_at("tokens", -1), F.col("tokens")).otherwise(F.col("parsed"))
    return c.select("allele", "cycle_id", tokens.alias("tokens"), T.reverse_complement(F.col("tokens")).alias("rc"))


@query(
    """with h as (select allele, cycle_id, tokens, len(tokens) as n, list_transform(tokens, lambda x: x[1] = 'H') as host, list_transform(tokens, lambda x: x[2]::int) as no from v_cycles),
k as (select *, list_filter(list_transform(range(n), lambda i: (n - i) % n), lambda k: host[k + 1] and not (host[(k + n - 1) % n + 1] and no[(k + n - 1) % n + 1] < no[k + 1]))[1] as k from h)
select allele, cycle_id, case when k is null then tokens else list_concat(list_slice(tokens, k + 1, n), list_slice(tokens, 1, k)) end as tokens from k""",
    "v_cycles",
)
def f2_canonical_start(spark, d):
    return V.v_cycles(spark, d).select("allele", "cycle_id", T.canonical_start(F.col("tokens")).alias("tokens"))


@query(
    """with p as (select *, list_position(list_transform(tokens, lambda x: left(x, len(x) - 1)), 'H3') as p, len(tokens) as n from v_cycles)
select allele, cycle_id, case when p > 1 then list_concat(list_slice(tokens, p, n), list_slice(tokens, 1, p - 1)) else tokens end as tokens from p""",
    "v_cycles",
)
def f3_reanchor(spark, d):
    return V.v_cycles(spark, d).select("allele", "cycle_id", T.reanchor(F.col("tokens"), F.lit("H3")).alias("tokens"))


@query(
    """with u as (select allele, cycle_id, repeat(array_to_string(tokens, ';') || ';', cnt::int) as t from v_cycles)
select allele, string_agg(t, '' order by cycle_id) as walk from u group by allele""",
    "v_cycles",
)
def f5_expand_walk(spark, d):
    nodes = V.v_cycles(spark, d).select("allele", F.col("cycle_id").alias("ord"), "tokens", F.col("cnt").alias("count"))
    return cycles.expand_walk(nodes, ["allele"]).select("allele", F.concat(F.array_join("walk", ";"), F.lit(";")).alias("walk"))


def nested(spark, d):
    """Each allele as nested nodes: a root of cycles by id, in which each stands cnt times and holds, after its first token, the next one's tokens twice."""
    zero = F.lit(0).cast("long")
    w = Window.partitionBy("allele").orderBy("cycle_id")
    c = V.v_cycles(spark, d).select("sample", "allele", "cycle_id", "cnt", "tokens", (F.row_number().over(w) - 1).cast("long").alias("n"), F.lead("tokens").over(w).alias("next"))
    root = c.select("sample", "allele").distinct().selectExpr("sample", "allele", "cast(null as array<bigint>) as parent", "cast(array() as array<bigint>) as path", "cast(null as string) as token", "cast(null as bigint) as cycle_id", "1L as cnt", "1L as times", "0 as depth")
    block = c.select("sample", "allele", F.expr(assemble.ROOT).alias("parent"), F.array("n", zero, zero).alias("path"), F.lit(None).cast("string").alias("token"), "cycle_id", F.col("cnt").cast("long").alias("cnt"), F.col("cnt").cast("long").alias("times"), F.lit(1).alias("depth"))
    inner = c.where("next is not null").select("sample", "allele", F.array("n", zero, zero).alias("parent"), F.array(F.col("n"), zero, zero, zero, F.lit(1).cast("long"), zero).alias("path"), F.lit(None).cast("string").alias("token"), (F.col("cycle_id") + 1).alias("cycle_id"), F.lit(2).cast("long").alias("cnt"), (F.col("cnt") * 2).cast("long").alias("times"), F.lit(2).alias("depth"))

    def leaves(rows, tokens, path, times, depth):
        long = rows.select("sample", "allele", path.alias("parent"), times.alias("times"), F.posexplode(tokens).alias("i", "token"))
        return long.select("sample", "allele", "parent", F.concat("parent", F.array(F.col("i").cast("long"), zero, zero)).alias("path"), "token", F.lit(None).cast("long").alias("cycle_id"), F.lit(None).cast("long").alias("cnt"), F.col("times").cast("long").alias("times"), F.lit(depth).alias("depth"))

    own = leaves(c, "tokens", F.array("n", zero, zero), F.col("cnt"), 2)
    other = leaves(c.where("next is not null"), "next", F.array(F.col("n"), zero, zero, zero, F.lit(1).cast("long"), zero), F.col("cnt") * 2, 3)
    return root.unionByName(block).unionByName(inner).unionByName(own).unionByName(other)


NESTED = """nx as (select *, row_number() over (partition by allele order by cycle_id) - 1 as n, lead(tokens) over (partition by allele order by cycle_id) as nxt from v_cycles),
once as (select *, list_concat(list_concat(tokens[1:1], list_concat(coalesce(nxt, []), coalesce(nxt, []))), tokens[2:]) as t from nx),
flat as (select sample, allele, n, cnt, t, repeat(array_to_string(t, ';') || ';', cnt::int) as text from once)"""


@query(f"with {NESTED} select allele, string_agg(text, '' order by n) as walk from flat group by allele", "v_cycles")
def f5_expand_nested(spark, d):
    return cycles.expand_nested(nested(spark, d), ["allele"]).select("allele", F.concat(F.array_join("walk", ";"), F.lit(";")).alias("walk"))


@query(
    f"""with {NESTED}, tk as (select f.sample, allele, n, cnt, unnest(t) as token from flat f)
select allele, sum(cnt)::bigint as n_tokens, sum(cnt * (v.ed - v.st + 1))::bigint as length,
  (select count(*) + count(nxt) from nx where nx.allele = tk.allele)::bigint as n_blocks, (select case when count(nxt) > 0 then 3 else 2 end from nx where nx.allele = tk.allele)::int as structure_depth
from tk join v_seg v on v.sample = tk.sample and v.seg = left(token, len(token) - 1) group by allele""",
    "v_cycles v_seg",
)
def f6_nested_stats(spark, d):
    out = cycles.nested_stats(nested(spark, d), V.v_seg(spark, d), ["sample", "allele"])
    return out.select("allele", "n_tokens", "length", F.col("n_blocks").cast("long").alias("n_blocks"), "structure_depth")


@query(
    """with w as (select distinct allele, unnest(['H2', 'V1', 'H9']) as seg from v_cycles),
nx as (select *, row_number() over (partition by allele order by cycle_id) - 1 as n, lead(tokens) over (partition by allele order by cycle_id) as nxt from v_cycles),
spot as (select allele, cycle_id, cnt, n, nxt, unnest(range(len(tokens))) as i, unnest(tokens) as token from nx)
select w.allele, w.seg, arg_min(n, (n, i))::bigint as block, arg_min(case when i = 0 or nxt is null then i else i + 1 end, (n, i))::bigint as ord
from w join spot s on s.allele = w.allele and left(token, len(token) - 1) = w.seg where cnt = 2 and cycle_id <> -1 group by w.allele, w.seg""",
    "v_cycles",
)
def f8_locate_in_blocks(spark, d):
    n = nested(spark, d)
    want = n.select("sample", "allele").distinct().selectExpr("sample", "allele", "explode(array('H2', 'V1', 'H9')) as seg", "2L as count", "-1L as avoid")
    out = cycles.locate_in_blocks(n, want, ["sample", "allele"])
    return out.select("allele", "seg", F.col("block").cast("long").alias("block"), F.col("ord").cast("long").alias("ord"))


@query(
    f"""with {TOKS} select allele, cycle_id, count(*)::bigint as n_tokens, sum(v.ed - v.st + 1)::bigint as length, count(distinct cs.seg)::bigint as n_segments, arg_min(cs.seg, ord) as first_seg, arg_max(cs.seg, ord) as last_seg
from cs join v_seg v on v.sample = cs.sample and v.seg = cs.seg group by all""",
    "v_cycles v_seg",
)
def f6_cycle_stats(spark, d):
    return cycles.cycle_stats(V.v_cycles(spark, d), V.v_seg(spark, d), ["sample", "allele", "cycle_id"]).drop("sample")


@query("with a as (select allele, cycle_id, tokens, list_transform(list_reverse(tokens), lambda x: " + FLIP + ") as rc from v_cycles) select x.allele, x.cycle_id, y.cycle_id as other, case when x.tokens = y.tokens then 1 when x.tokens = y.rc then -1 else 0 end as same from a x join a y on x.allele = y.allele and x.cycle_id < y.cycle_id", "v_cycles")
def f7_same_or_rc(spark, d):
    c = V.v_cycles(spark, d).select("allele", "cycle_id", "tokens")
    o = c.withColumnsRenamed({"cycle_id": "other", "tokens": "others"})
    return c.join(o, "allele").where("cycle_id < other").select("allele", "cycle_id", "other", T.same_or_rc(F.col("tokens"), F.col("others")).alias("same"))


@query(
    "with a as (select allele, cycle_id, tokens as t, list_transform(list_reverse(tokens), lambda x: " + FLIP + ") as r from v_cycles) select allele, cycle_id, list_sort(list_concat(" + TURNS.format(t="t") + ", " + TURNS.format(t="r") + "))[1] as key from a",
    "v_cycles",
)
def f7b_equivalence_key(spark, d):
    return V.v_cycles(spark, d).select("allele", "cycle_id", T.equivalence_key(F.col("tokens")).alias("key"))


@query(f"with {TOKS} select allele, cycle_id, seg, min(ord)::bigint as ord from cs where seg in ('V1', 'H2') and cycle_id <> (allele // 1000) * 100000 + (allele % 1000) * 5 group by all", "v_cycles")
def f8_locate_segment(spark, d):
    c = V.v_cycles(spark, d)
    want = c.select("allele").distinct().selectExpr("allele", "explode(array('V1', 'H2')) as seg", "(allele div 1000) * 100000 + (allele % 1000) * 5 as avoid")
    return cycles.locate_segment(c, want, ["allele"]).select("allele", "cycle_id", "seg", F.col("ord").cast("long").alias("ord"))


BACKBONE = f"""{TOKS}, len_ as (select allele, cycle_id, sum(v.ed - v.st + 1) as length from cs join v_seg v on v.sample = cs.sample and v.seg = cs.seg group by all),
fit as (select c.allele, c.cycle_id, c.tokens, l.length, row_number() over (partition by c.allele order by l.length desc, c.cycle_id) as r from v_cycles c join len_ l on l.allele = c.allele and l.cycle_id = c.cycle_id
  where cnt = 1 and left(tokens[1], 2) = 'H1' and left(tokens[-1], 2) = 'H4'),
back as (select allele, cycle_id, tokens, length::bigint as length from fit where r = 1)"""


@query(f"with {BACKBONE} select * from back", "v_cycles v_seg")
def f9_select_backbone(spark, d):
    return cycles.select_backbone(V.v_cycles(spark, d), V.v_seg(spark, d), ["sample", "allele"], "H1", "H4").drop("sample")


ANCHOR = f"""{BACKBONE}, rest as (select cs.* from cs join back b on b.allele = cs.allele where b.cycle_id <> cs.cycle_id),
line as (select allele, left(t, 2) as seg, min(i) as at from (select allele, unnest(tokens) as t, unnest(range(len(tokens))) as i from back) where t like 'H%' group by all),
direct as (select r.allele, r.cycle_id, arg_min(r.seg, l.at) as anchor from rest r join line l on l.allele = r.allele and l.seg = r.seg group by all),
indirect as (select r.allele, r.cycle_id, arg_min(r.seg, ((r.seg not like 'H%')::int, r.ord)) as anchor from rest r where exists (select 1 from cs o where o.allele = r.allele and o.seg = r.seg and o.cycle_id <> r.cycle_id) group by all)"""


@query(f"with {ANCHOR} select distinct r.allele, r.cycle_id, coalesce(d.anchor, i.anchor) as anchor from rest r left join direct d on d.allele = r.allele and d.cycle_id = r.cycle_id left join indirect i on i.allele = r.allele and i.cycle_id = r.cycle_id", "v_cycles v_seg")
def f10_choose_anchors(spark, d):
    c = V.v_cycles(spark, d)
    return cycles.choose_anchors(c, cycles.select_backbone(c, V.v_seg(spark, d), ["sample", "allele"], "H1", "H4"), ["sample", "allele"]).drop("sample")


@query(
    f"""with recursive {BACKBONE}, reach as (
  select allele, cycle_id, 0 as hops from back
  union select s.allele, s.cycle_id, r.hops + 1 from reach r join cs a on a.allele = r.allele and a.cycle_id = r.cycle_id join cs s on s.allele = a.allele and s.seg = a.seg where r.hops < 4)
select allele, cycle_id, min(hops)::bigint as hops from reach group by all""".replace("with recursive ", "with ", 1),
    "v_cycles v_seg",
)
def f10_reachable_cycles(spark, d):
    c = V.v_cycles(spark, d)
    out = cycles.reachable_cycles(c, cycles.select_backbone(c, V.v_seg(spark, d), ["sample", "allele"], "H1", "H4"), ["sample", "allele"])
    return out.select("allele", "cycle_id", F.col("hops").cast("long").alias("hops"))


_SQL["f10_reachable_cycles"] = _SQL["f10_reachable_cycles"].replace("with ", "with recursive ", 1)


def walks(spark, d):
    w = assemble.assemble_walks(V.v_cycles(spark, d), V.v_seg(spark, d), ["sample", "allele"], "H1", "H4")
    return w.where("valid").select("sample", "allele", "map_no", "walk")


@query(
    f"""with {BACKBONE}, reach as (
  select allele, cycle_id from back
  union select s.allele, s.cycle_id from reach r join cs a on a.allele = r.allele and a.cycle_id = r.cycle_id join cs s on s.allele = a.allele and s.seg = a.seg),
whole as (select allele from back where allele not in (select c.allele from v_cycles c left join reach r on r.allele = c.allele and r.cycle_id = c.cycle_id where r.cycle_id is null))
select allele, seg, sum(n)::bigint as n from (
  select cs.allele, cs.seg, sum(cnt) as n from cs join back b on b.allele = cs.allele where b.cycle_id <> cs.cycle_id group by all
  union all select allele, left(t, 2), count(*) from (select allele, unnest(tokens) as t from back) group by all) where allele in (select allele from whole) group by all""",
    "v_cycles v_seg",
)
def f11_assemble_walks(spark, d):
    """The walk of every allele whose cycles all hang together, by its conserved segment counts."""
    return cycles.segment_counts(walks(spark, d).select("allele", "walk"), ["allele"], "walk").groupBy("allele", "seg").agg(F.sum("n").alias("n"))


_SQL["f11_assemble_walks"] = _SQL["f11_assemble_walks"].replace("with ", "with recursive ", 1)


@query()
def f11_walk_text(spark, d):
    return walks(spark, d).select("allele", F.array_join("walk", " ").alias("walk"))


WALK2 = """w as (select allele, list_concat(list_concat(tokens, tokens), tokens) as walk, cycle_id from v_cycles where cycle_id >= 0)"""


def tripled(spark, d):
    return V.v_cycles(spark, d).where("cycle_id >= 0").select("allele", "cycle_id", F.concat("tokens", "tokens", "tokens").alias("walk"))


@query(
    f"""with {WALK2}, u as (select w.*, c.tokens as unit, c.cycle_id as unit_id from w join v_cycles c on c.allele = w.allele and c.cycle_id = w.cycle_id),
m as (select allele, cycle_id, unit_id, len(unit) as k, unnest(list_filter(range(len(walk) - len(unit) + 1), lambda i: list_slice(walk, i + 1, i + len(unit)) = unit)) as i from u),
g as (select *, i - k * row_number() over (partition by allele, cycle_id, unit_id, i % k order by i) as isle from m)
select allele, cycle_id, unit_id, min(i)::bigint as start, count(*)::bigint as times from g group by allele, cycle_id, unit_id, i % k, isle having count(*) >= 2""",
    "v_cycles",
)
def f12_fold_repeats(spark, d):
    units = V.v_cycles(spark, d).where("cycle_id >= 0").select("allele", "cycle_id", F.col("cycle_id").alias("unit_id"), F.col("tokens").alias("unit"))
    out = cycles.fold_repeats(tripled(spark, d), ["allele", "cycle_id"], units)
    return out.select("allele", "cycle_id", "unit_id", F.col("start").cast("long").alias("start"), "times")


@query(
    """with w as (select allele, cycle_id, tokens as u, array_to_string(tokens, ' ') as t, len(tokens) as n from v_cycles where cycle_id >= 0)
select allele, cycle_id, 'H9+ (' || t || ')x3 H9-' as text, 1::int as height from w""",
    "v_cycles",
)
def f12_fold_walks(spark, d):
    c = V.v_cycles(spark, d).where("cycle_id >= 0")
    w = c.select("allele", "cycle_id", F.concat(F.array(F.lit("H9+")), "tokens", "tokens", "tokens", F.array(F.lit("H9-"))).alias("walk"))
    return cycles.fold_walks(w, ["allele", "cycle_id"], c.select("allele", "cycle_id", F.col("cycle_id").alias("unit_id"), F.col("tokens").alias("unit")))


def doubled(spark, d):
    """Each cycle as nested nodes: H9+, three times (twice the cycle, then V9+), H9-."""
    c = V.v_cycles(spark, d).where("cycle_id >= 0").select("allele", "cycle_id", "tokens")
    at = lambda *p: F.array(*[F.lit(x).cast("long") for x in p]) if p else F.array().cast("array<bigint>")
    node = lambda parent, path, token, cnt, depth: F.struct(
        parent.alias("parent"), path.alias("path"), F.lit(token).cast("string").alias("token"), F.lit(cnt).cast("long").alias("cnt"), F.lit(depth).alias("depth")
    )
    fixed = F.array(
        node(F.lit(None).cast("array<bigint>"), at(), None, 1, 0), node(at(), at(0), "H9+", None, 1), node(at(), at(1), None, 3, 1), node(at(), at(2), "H9-", None, 1),
        node(at(1), at(1, 0), None, 2, 2), node(at(1), at(1, 1), "V9+", None, 2),
    )
    inner = F.transform("tokens", lambda t, i: F.struct(at(1, 0).alias("parent"), F.concat(at(1, 0), F.array(i.cast("long"))).alias("path"), t.alias("token"), F.lit(None).cast("long").alias("cnt"), F.lit(3).alias("depth")))
    return c.select("allele", "cycle_id", F.explode(F.concat(fixed, inner)).alias("n")).select("allele", "cycle_id", "n.*")


@query(
    """select allele, cycle_id, 'H9+ ((' || array_to_string(tokens, ' ') || ')x2 V9+)x3 H9-' as text, 1::int as height from v_cycles where cycle_id >= 0""",
    "v_cycles",
)
def f12_fold_nested(spark, d):
    n, keys = stored(doubled(spark, d), "nested-nodes"), ["allele", "cycle_id"]  # read for the walks and for the units
    with measured_broadcasts(spark):
        return cycles.fold_nested(cycles.expand_nested(n, keys), keys, cycles.nested_units(n, keys))


SIG = "select allele, cycle_id, md5(array_to_string(tokens, ';') || ';') as md5_walk, md5(regexp_replace(array_to_string(list_sort(tokens), ';'), '[+-]', '', 'g')) as md5_composition from v_cycles"


@query(SIG, "v_cycles")
def f13_walk_signatures(spark, d):
    return cycles.walk_signatures(V.v_cycles(spark, d).select("allele", "cycle_id", F.col("tokens").alias("walk"))).select("allele", "cycle_id", "md5_walk", "md5_composition")


@query(
    """with w as (select allele % 3 as grp, allele as map_no, cycle_id, tokens as walk, cnt as height from v_cycles)
select grp, map_no, cycle_id, height, walk from (select *, row_number() over (partition by grp, walk order by height, map_no * 10000000000 + cycle_id) as r from w) where r = 1""",
    "v_cycles",
)
def f14_dedup_walks(spark, d):
    w = V.v_cycles(spark, d).selectExpr("allele % 3 as grp", "allele as first", "cycle_id", "allele * 10000000000 + cycle_id as map_no", "tokens as walk", "cnt as height")
    return cycles.dedup_walks(w, ["grp"]).selectExpr("grp", "first as map_no", "cycle_id", "height", "walk")


@query(
    """with t as (select *, array_to_string(tokens, ';') || ';' as t from v_cycles)
select allele, cycle_id from t where len(tokens) = 1 or (regexp_matches(t, '(^|;)H2[+-];H1[+];') or regexp_matches(t, '(^|;)H1[-];H2[+-];')) and (regexp_matches(t, '(^|;)V1[+-];'))""",
    "v_cycles",
)
def f15_require_motifs(spark, d):
    w = V.v_cycles(spark, d).select("allele", "cycle_id", F.col("tokens").alias("walk"))
    single = w.where("size(walk) = 1").select("allele", "cycle_id")
    return cycles.require_motifs(w, ["H2,H1+", "V1"], ["allele", "cycle_id"], single).select("allele", "cycle_id")


@query(
    f"""with {TOKS}, s as (select a.allele, a.cycle_id, a.ord + 1 as i, b.ord - 1 as j from cs a join cs b on a.allele = b.allele and a.cycle_id = b.cycle_id and a.seg = b.seg and a.orit <> b.orit and b.ord >= a.ord + 3)
select s.allele, s.cycle_id, i::bigint as i, j::bigint as j, list_concat(list_concat(list_slice(tokens, 1, i), list_transform(list_reverse(list_slice(tokens, i + 1, j + 1)), lambda x: {FLIP})), list_slice(tokens, j + 2, len(tokens))) as variant
from s join v_cycles c on c.allele = s.allele and c.cycle_id = s.cycle_id""",
    "v_cycles",
)
def f16_inversion_variants(spark, d):
    w = V.v_cycles(spark, d).select("allele", "cycle_id", F.col("tokens").alias("walk"))
    out = cycles.inversion_variants(w, ["allele", "cycle_id"])
    return out.select("allele", "cycle_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "variant")


@query("select allele, cycle_id from v_cycles where allele in (select o_orderkey * 1000 from orders where o_orderkey % 2 = 0) and allele not in (select o_orderkey * 1000 from orders where o_orderkey % 3 = 0)", "v_cycles")
def f17_select_solutions(spark, d):
    o = V.table(spark, d, "orders").selectExpr("o_orderkey * 1000 as allele", "o_orderkey as k")
    return cycles.select_solutions(V.v_cycles(spark, d).select("allele", "cycle_id"), o.where("k % 2 = 0"), o.where("k % 3 = 0"), "allele")


@query(
    """with a as (select 's' as sample, c_nationkey as group_id, o_custkey as solution, o_orderkey as allele, (o_totalprice > 5000)::int as n from orders join customer on o_custkey = c_custkey),
s as (select sample, group_id, solution, bool_and(n > 0) as valid from a group by all)
select *, bool_or(valid) over (partition by sample, group_id) as group_valid from s"""
)
def f18_propagate_validity(spark, d):
    o, c = V.table(spark, d, "orders"), V.table(spark, d, "customer")
    a = o.join(c, o["o_custkey"] == c["c_custkey"]).selectExpr("'s' as sample", "c_nationkey as group_id", "o_custkey as solution", "o_orderkey as allele", "cast(o_totalprice > 5000 as int) as n_walks")
    return cycles.propagate_validity(a)


@query(f"with {TOKS}, e as (select sample, allele, seg, sum(cnt) as expected from cs group by all) select allele, e.seg, expected::bigint as expected, (v.ed - v.st)::double / 20 as cn, (expected - (v.ed - v.st)::double / 20) / ((v.ed - v.st)::double / 20) as residual from e join v_seg v on v.sample = e.sample and v.seg = e.seg", "v_cycles v_seg")
def f19_solution_accounting(spark, d):
    return cycles.solution_accounting(V.v_cycles(spark, d), V.v_seg(spark, d).selectExpr("sample", "seg", "cast(ed - st as double) / 20 as cn"), ["sample", "allele"]).drop("sample")


LINKS = "lk as (select 's' || (l_orderkey % 7) as sample, (['H1', 'H2', 'H3', 'H4', 'V1'])[1 + l_suppkey % 5] || case when l_returnflag = 'R' then '-' else '+' end as a, (['H1', 'H2', 'H3', 'H4', 'V1'])[1 + l_partkey % 5] || case when l_linestatus = 'O' then '+' else '-' end as b, l_quantity / 100 as cn from lineitem)"
TURN = "(substr({x}, 1, len({x}) - 1) || translate(right({x}, 1), '+-', '-+'))"


@query(
    f"""with {LINKS}, known as (select sample, least(a || ',' || b, {TURN.format(x="b")} || ',' || {TURN.format(x="a")}) as pair, min(a || ',' || b) as link, round(sum(cn), 6) as cn from lk group by all),
ring as (select sample, allele, cnt, unnest(tokens) as a, unnest(list_concat(tokens[2:], tokens[1:1])) as b from v_cycles),
used as (select sample, allele, least(a || ',' || b, {TURN.format(x="b")} || ',' || {TURN.format(x="a")}) as pair, sum(cnt)::bigint as expected from ring group by all),
wanted as (select c.allele, k.* from (select distinct sample, allele from v_cycles) c join known k using (sample))
select w.sample, w.allele, link, coalesce(expected, 0)::bigint as expected, cn, round((coalesce(expected, 0) - cn) / cn, 6) as residual from wanted w left join used u on u.sample = w.sample and u.allele = w.allele and u.pair = w.pair""",
    "v_cycles",
)
def f19_junction_accounting(spark, d):
    name = "element_at(array('H1', 'H2', 'H3', 'H4', 'V1'), cast(1 + {x} % 5 as int))"
    link = f"concat({name.format(x='l_suppkey')}, if(l_returnflag = 'R', '-', '+'), ',', {name.format(x='l_partkey')}, if(l_linestatus = 'O', '+', '-')) as link"
    j = V.table(spark, d, "lineitem").selectExpr("concat('s', l_orderkey % 7) as sample", link, "l_quantity / 100 as cn")
    out = cycles.junction_accounting(V.v_cycles(spark, d), j, ["sample", "allele"]).withColumn("cn", F.round("cn", 6))
    return out.select("sample", "allele", "link", "expected", "cn", F.round(F.expr("(expected - cn) / cn"), 6).alias("residual"))


@query("select allele, string_agg(cycle_id || ':' || cnt, ',' order by cycle_id || ':' || cnt) as usage from v_cycles group by allele", "v_cycles")
def f20_usage_strings(spark, d):
    return cycles.usage_strings(V.v_cycles(spark, d), ["allele"])


@query(
    """with s as (select 's' || (s_suppkey % 4) as sample, case when s_suppkey % 10 = 0 then null else s_nationkey end as group_id, s_suppkey as seg from supplier)
select sample, group_id, seg from s where group_id is not null union all select f.sample, g.group_id, f.seg from s f join (select distinct sample, group_id from s where group_id is not null) g on g.sample = f.sample where f.group_id is null"""
)
def f21_visible_segments(spark, d):
    s = V.table(spark, d, "supplier").selectExpr("concat('s', s_suppkey % 4) as sample", "if(s_suppkey % 10 = 0, null, s_nationkey) as group_id", "s_suppkey as seg")
    return cycles.visible_segments(s)


# --- anchors and links -----------------------------------------------------------------------------------

GSEG = f"""{SEGS}, gseg as materialized (select sample, 1 as group_id, refseg, 'H' || seg_no as seg, seg_no, st, ed, case when seg_no = 1 then 'source' when ed = max(ed) over (partition by sample, refseg) then 'sink' end as role from segs)"""


def grouped(spark, d):
    s = segments.name_segments(cut(spark, d))
    role = F.expr("case when seg_no = 1 then 'source' when ed = max(ed) over (partition by sample, refseg) then 'sink' end")
    s = s.select("sample", F.lit(1).alias("group_id"), "refseg", "seg", "seg_no", "st", "ed", role.alias("role"))
    return s.withColumn("is_end", F.col("role").isNotNull())


INNER = "inn as (select *, (ed - st + 1) // 3 as unit, st + n * ((ed - st + 1) // 3) - 1 as pos from gseg, (values (1), (2)) k(n) where role is null and (ed - st + 1) // 3 > 0)"


@query(f"with {GSEG}, {INNER} select sample, refseg, seg, n::bigint as nth, pos::bigint as pos from inn where pos - st >= 10 and ed - pos >= 10", "v_junc v_region")
def g1_g3_inner_anchors(spark, d):
    a = links.edge_filter(links.inner_anchors(grouped(spark, d), 2), 10)
    return a.select("sample", "refseg", "seg", F.col("nth").cast("long").alias("nth"), "pos")


@query(
    f"""with {GSEG}, {INNER}, m as (select sample, greatest(floor(avg(unit))::bigint, 20) as u from inn group by sample)
select g.sample, refseg, seg, role, (case when role = 'source' then ed - least(u, (ed - st + 1) // 2) else st + least(u, (ed - st + 1) // 2) end)::bigint as pos from gseg g join m using (sample) where role is not null""",
    "v_junc v_region",
)
def g2_terminal_anchors(spark, d):
    s = grouped(spark, d)
    return links.terminal_anchors(s, links.inner_anchors(s, 2), 20).select("sample", "refseg", "seg", "role", "pos")


ANCHORS = "anc as (select 's' || ((p_partkey * 7 + i) % 500) as sample, 'a' || p_partkey as anchor, 'S' || (p_partkey % 5) as refseg, p_partkey as pos from part, range(5) t(i))"


@query(
    f"""with {ANCHORS} select distinct anc.sample, anchor, molecule::varchar as marker from anc join v_reads r on r.sample = anc.sample and r.refseg = anc.refseg and pos between st and ed
union select 's' || (l_orderkey % {V.SAMPLES}), 'JUNC' || l_linenumber, l_orderkey::varchar from lineitem""",
    "v_reads",
)
def g4_anchor_markers(spark, d):
    """The same names of anchors in several samples, and the lists of junctions beside them."""
    a = V.table(spark, d, "part").selectExpr("explode(sequence(0, 4)) as i", "p_partkey").selectExpr("concat('s', (p_partkey * 7 + i) % 500) as sample", "concat('a', p_partkey) as anchor", "concat('S', p_partkey % 5) as refseg", "p_partkey as pos")
    j = V.table(spark, d, "lineitem").selectExpr(f"concat('s', l_orderkey % {V.SAMPLES}) as sample", "concat('JUNC', l_linenumber) as anchor", "l_orderkey as marker")
    return links.anchor_markers(a, V.v_reads(spark, d), j)


SHARED = """shared as (select a.sample, a.anchor as anchor_a, b.anchor as anchor_b, count(*)::bigint as links from v_markers a join v_markers b on a.sample = b.sample and a.marker = b.marker and a.anchor < b.anchor group by all)"""
ASKED = "asked as (select distinct sample, least(a.p_brand, b.p_brand) as anchor_a, greatest(a.p_brand, b.p_brand) as anchor_b from part a join part b on b.p_partkey = a.p_partkey + 1, (values ('s0'), ('s1'), ('s2'), ('none')) t(sample) where a.p_brand <> b.p_brand)"


@query(
    f"""with {SHARED}, {ASKED} select a.sample, a.anchor_a, a.anchor_b, coalesce(links, 0)::bigint as links from asked a left join shared s on s.sample = a.sample and s.anchor_a = a.anchor_a and s.anchor_b = a.anchor_b
where right(a.anchor_a, 1) <> right(a.anchor_b, 1) or a.sample = 'none'""",
    "v_markers",
)
def g5_shared_marker_links(spark, d):
    m = V.v_markers(spark, d)
    part = V.table(spark, d, "part").select("p_partkey", "p_brand")
    near = part.alias("a").join(part.selectExpr("p_partkey - 1 as p_partkey", "p_brand as other"), "p_partkey").where("p_brand <> other")
    asked = near.selectExpr("explode(array('s0', 's1', 's2', 'none')) as sample", "least(p_brand, other) as anchor_a", "greatest(p_brand, other) as anchor_b").distinct()
    return links.shared_marker_links(m, m.select("sample", "anchor").distinct().withColumn("seg", F.right("anchor", F.lit(1))), asked)


@query(
    f"""with {SHARED}, b as (select * from shared union all select sample, anchor_b, anchor_a, links from shared)
select sample, anchor_a as anchor, max(links) filter (where anchor_b = 'Brand#11') as b11, max(links) filter (where anchor_b = 'Brand#23') as b23, max(links) filter (where anchor_b = 'Brand#55') as b55 from b group by sample, anchor_a""",
    "v_markers",
)
def g6_pair_matrix(spark, d):
    m = links.pair_matrix(links.shared_marker_links(V.v_markers(spark, d)), ["Brand#11", "Brand#23", "Brand#55"])
    return m.select("sample", "anchor", F.col("`Brand#11`").alias("b11"), F.col("`Brand#23`").alias("b23"), F.col("`Brand#55`").alias("b55"))


PAIRG = """pr as (select o_orderkey as id, 'n' || (o_orderkey % 37) as anchor_a, 'n' || (o_custkey % 41) as anchor_b from orders),
gr as (select 'n' || n_nationkey as anchor, n_regionkey as group_id from nation where n_nationkey % 4 <> 0)"""


@query(
    f"""with {PAIRG} select id, case when anchor_a < anchor_b then anchor_a || ';' || anchor_b else anchor_b || ';' || anchor_a end as pair_id,
  case when a.group_id = b.group_id or a.group_id is null or b.group_id is null then coalesce(a.group_id, b.group_id) end as group_id,
  case when coalesce(a.group_id, b.group_id) is null then 'no group' when a.group_id <> b.group_id then 'conflict' end as problem
from pr left join gr a on a.anchor = anchor_a left join gr b on b.anchor = anchor_b"""
)
def g7_g8_pair_groups(spark, d):
    pairs = V.table(spark, d, "orders").selectExpr("o_orderkey as id", "concat('n', o_orderkey % 37) as anchor_a", "concat('n', o_custkey % 41) as anchor_b")
    groups = V.table(spark, d, "nation").where("n_nationkey % 4 <> 0").selectExpr("concat('n', n_nationkey) as anchor", "n_regionkey as group_id")
    out = links.pair_groups(pairs, groups)
    return out.select("id", links.pair_key(F.col("anchor_a"), F.col("anchor_b")).alias("pair_id"), "group_id", "problem")


PLACES = f"""{TOKS}, off as (select cs.sample, cs.allele, cs.cycle_id, ord, token, cs.seg, orit, v.ed - v.st + 1 as len, coalesce(sum(v.ed - v.st + 1) over (partition by allele, cycle_id order by ord rows between unbounded preceding and 1 preceding), 0) as before,
  lead(token) over (partition by allele, cycle_id order by ord) as nxt from cs join v_seg v on v.sample = cs.sample and v.seg = cs.seg),
pa(anchor, seg, to5, to3) as (values ('P1', 'H2', 50::bigint, 99::bigint), ('P2', 'V1', 30, 49)),
ja(anchor, pair) as (values ('JUNC1', 'H2+,H1+'), ('JUNC1', 'H1-,H2-'), ('JUNC2', 'H1+,H3-'), ('JUNC2', 'H3+,H1-')),
places as (select allele, cycle_id, anchor, (before + case when orit = '+' then to5 else to3 end)::bigint as "at" from off join pa using (seg)
  union all select allele, cycle_id, anchor, (before + len)::bigint from off join ja on ja.pair = token || ',' || nxt),
pairs(anchor_a, anchor_b) as (values ('JUNC1', 'P1'), ('JUNC1', 'P2'), ('P1', 'P2'), ('JUNC2', 'P1'))"""


def offsets(spark, d):
    return links.walk_offsets(V.v_cycles(spark, d).select("allele", "cycle_id", F.col("tokens").alias("walk"), "sample"), V.v_seg(spark, d), ["sample", "allele", "cycle_id"])


def places(spark, d):
    pos = spark.createDataFrame([("P1", "H2", 50, 99), ("P2", "V1", 30, 49)], "anchor string, seg string, to5 long, to3 long")
    junc = spark.createDataFrame([("JUNC1", "H2+,H1+"), ("JUNC2", "H1+,H3-")], "anchor string, link string")
    return links.anchor_positions(offsets(spark, d), pos, junc, ["sample", "allele", "cycle_id"]).drop("sample")


def anchor_pairs(spark):
    return spark.createDataFrame([("JUNC1", "P1"), ("JUNC1", "P2"), ("P1", "P2"), ("JUNC2", "P1")], "anchor_a string, anchor_b string")


@query(f'with {PLACES} select allele, cycle_id, anchor, "at" from places', "v_cycles v_seg")
def g9_anchor_positions(spark, d):
    return places(spark, d)


@query(f'with {PLACES} select a.allele, a.cycle_id, anchor_a, anchor_b, min(abs(a."at" - b."at"))::bigint as distance from pairs p join places a on a.anchor = anchor_a join places b on b.anchor = anchor_b and b.allele = a.allele and b.cycle_id = a.cycle_id group by all', "v_cycles v_seg")
def g10_anchor_distance(spark, d):
    return links.anchor_distances(places(spark, d), anchor_pairs(spark), ["allele", "cycle_id"])


MOLS = "mols as (select allele, cycle_id, event_id as mol, (event_id % 700)::bigint as st, (event_id % 700 + 200 + event_id % 300)::bigint as ed, 0.25 * (event_id % 4 + 1) as covr from v_tok)"


def molecules(spark, d):
    return V.v_tok(spark, d).selectExpr("allele", "cycle_id", "event_id as mol", "event_id % 700 as st", "event_id % 700 + 200 + event_id % 300 as ed", "cast(0.25 * (event_id % 4 + 1) as double) as covr")


def _co(biend: str) -> str:
    return f"""with {PLACES}, {MOLS}, hit as (select p.allele, p.cycle_id, anchor, "at", mol, m.st, m.ed, covr from places p join mols m on m.allele = p.allele and m.cycle_id = p.cycle_id and "at" between m.st and m.ed),
got as (select a.allele, a.cycle_id, anchor_a, anchor_b, sum(a.covr) as n from pairs p join hit a on a.anchor = anchor_a join hit b on b.anchor = anchor_b and b.allele = a.allele and b.cycle_id = a.cycle_id and b.mol = a.mol {biend} group by all)
select k.allele, k.cycle_id, p.anchor_a, p.anchor_b, coalesce(n, 0)::double as links from (select distinct allele, cycle_id, anchor from places) k join pairs p on p.anchor_a = k.anchor left join got g on g.allele = k.allele and g.cycle_id = k.cycle_id and g.anchor_a = p.anchor_a and g.anchor_b = p.anchor_b"""


def co_covered(spark, d, *how):
    """Links of the pairs whose first anchor stands on the walk, zeros included."""
    keys = ["allele", "cycle_id"]
    spots = places(spark, d)
    wanted = spots.select(*keys, F.col("anchor").alias("anchor_a")).distinct().join(anchor_pairs(spark), "anchor_a")
    return links.with_zeros(links.co_coverage(molecules(spark, d), spots, anchor_pairs(spark), keys, *how), wanted, keys)


@query(_co(""), "v_cycles v_seg")
def g11_co_coverage(spark, d):
    return co_covered(spark, d)


@query(_co("where least(a.at, b.at) - a.st <= 150 and a.ed - greatest(a.at, b.at) <= 150"), "v_cycles v_seg")
def g11_co_coverage_biend(spark, d):
    return co_covered(spark, d, True, 150)


# --- distributions ---------------------------------------------------------------------------------------

LEN = "lens as (select l_suppkey % 7 as key, l_quantity::bigint * 100 as len, count(*)::bigint as cnt from lineitem group by all)"
ECDF = f"{LEN}, cdf as (select key, len, cnt, round(sum(cnt) over (partition by key order by len) / sum(cnt) over (partition by key), 6) as prob from lens)"


def lengths(spark, d):
    return V.table(spark, d, "lineitem").selectExpr("l_suppkey % 7 as key", "cast(l_quantity as bigint) * 100 as len").groupBy("key", "len").agg(F.count(F.lit(1)).alias("cnt"))


@query(f"with {ECDF} select key, len, cnt, prob::double as prob from cdf")
def g12_ecdf(spark, d):
    return distributions.ecdf(lengths(spark, d), ["key"])


@query(
    """with r as (select l_suppkey % 7 as key, l_quantity::bigint as len, round(l_discount, 2) as ratio, count(*) as cnt from lineitem group by all)
select key, len, ratio, floor(cnt * least(sum(cnt) over (partition by key, len), 100) / sum(cnt) over (partition by key, len))::bigint as weight from r"""
)
def g13_ratio_profile(spark, d):
    r = V.table(spark, d, "lineitem").selectExpr("l_suppkey % 7 as key", "cast(l_quantity as bigint) as len", "round(l_discount, 2) as ratio").groupBy("key", "len", "ratio").agg(F.count(F.lit(1)).alias("cnt"))
    return distributions.ratio_profile(r, ["key"])


@query(
    f"""with {ECDF}, have as (select key, floor(prob * 200 + 1e-9)::bigint as bin, min(len) as len from cdf group by all),
grid as (select key, i::bigint as bin from (select distinct key from cdf), range(201) t(i))
select g.key, g.bin, coalesce((select arg_max(len, h.bin) from have h where h.key = g.key and h.bin <= g.bin), (select arg_min(len, h.bin) from have h where h.key = g.key)) as len from grid g"""
)
def g14_quantile_grid(spark, d):
    return distributions.quantile_grid(distributions.ecdf(lengths(spark, d), ["key"]), ["key"], 200)


SPANS = "spans as (select distinct o_orderkey % 8 as key, (o_custkey * 7) % 6000 + 1 as lo, (o_custkey * 7) % 6000 + 1 + o_orderkey % 900 as hi from orders)"


def spans(spark, d):
    return V.table(spark, d, "orders").selectExpr("o_orderkey % 8 as key", "(o_custkey * 7) % 6000 + 1 as lo", "(o_custkey * 7) % 6000 + 1 + o_orderkey % 900 as hi").distinct()


@query(
    f"""with {ECDF}, {SPANS}, q as (select distinct key, lo as q from spans)
select q.key, q.q, arg_min(c.len, (abs(c.len - q.q), c.len)) as len, arg_min(c.cnt, (abs(c.len - q.q), c.len)) as cnt from q left join cdf c on c.key = q.key group by all"""
)
def g15_nearest_key(spark, d):
    """Key 7 has no distribution and gets nulls."""
    return distributions.nearest_length(spans(spark, d).select("key", F.col("lo").alias("q")).distinct(), lengths(spark, d), ["key"], "cnt")


@query(
    f"""with {ECDF}, {SPANS}
select s.key, lo, hi, round(case when s.key in (select key from cdf) then coalesce((select arg_min(prob, len) from cdf c where c.key = s.key and c.len >= s.hi), 1) - coalesce((select arg_max(prob, len) from cdf c where c.key = s.key and c.len <= s.lo), 0)
  else 1000.0 / lo end, 6)::double as mass from spans s"""
)
def g16_mass_between(spark, d):
    out = distributions.mass_between(spans(spark, d), distributions.ecdf(lengths(spark, d), ["key"]), ["key"])
    return out.select("key", "lo", "hi", F.round("mass", 6).alias("mass"))


# --- ranking ---------------------------------------------------------------------------------------------

WALKS = """wk as (select distinct 's' as sample, 1 as group_id, o_custkey as solution, o_orderkey % 3 as allele, o_orderkey % 4 as map_no from orders),
dig as (select *, row_number() over (partition by sample, group_id, solution, allele order by map_no) - 1 as digit from wk),
per as (select sample, group_id, solution, allele, count(*) as n from wk group by all),
st as (select *, coalesce((select product(b.n) from per b where b.solution = a.solution and b.allele < a.allele), 1)::bigint as stride from per a),
tot as (select sample, group_id, solution, max(stride * n)::bigint as total from st group by all),
co as (select sample, group_id, solution, unnest(range(total)) as combo from tot),
pick as (select c.sample, c.group_id, c.solution, c.combo::bigint as combo, d.allele, d.map_no from co c join st s on s.solution = c.solution join dig d on d.solution = s.solution and d.allele = s.allele and d.digit = (c.combo // s.stride) % s.n)"""


def solution_walks(spark, d):
    return V.table(spark, d, "orders").selectExpr("'s' as sample", "1 as group_id", "o_custkey as solution", "o_orderkey % 3 as allele", "o_orderkey % 4 as map_no").distinct()


@query(f"with {WALKS} select * from pick")
def g17_walk_combinations(spark, d):
    return ranking.walk_combinations(solution_walks(spark, d)).select("sample", "group_id", "solution", "combo", "allele", "map_no")


WEIGHTS = f"""{WALKS}, al as (select *, (1000 + map_no * 250 + solution % 100) as length, allele + 1 as cn from wk),
fst as (select sample, group_id, solution, allele, arg_min(length * cn, map_no) as v from al group by all),
tt as (select solution, sum(v) as total from fst group by all),
wt as (select p.*, (length * cn)::double / total as weight from pick p join al using (sample, group_id, solution, allele, map_no) join tt using (solution)),
lk as (select w.sample, w.group_id, w.solution, w.allele, w.map_no, 'p' || i as pair_id, ((w.solution * 13 + w.allele * 7 + w.map_no * 5 + i * 11) % 50)::double + 0.7310585 as links from wk w, range(4) t(i)),
ex as (select sample, group_id, solution, combo, pair_id, round(sum(round(links * weight, 2)), 2) as expected from wt join lk using (sample, group_id, solution, allele, map_no) group by all)"""


def walk_sizes(spark, d):
    return solution_walks(spark, d).selectExpr("*", "1000 + map_no * 250 + solution % 100 as length", "allele + 1 as cn")


def weighted(spark, d):
    return ranking.combination_weights(ranking.walk_combinations(solution_walks(spark, d)), walk_sizes(spark, d))


def walk_links(spark, d):
    pair = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")
    return solution_walks(spark, d).select("*", pair).selectExpr("sample", "group_id", "solution", "allele", "map_no", "concat('p', i) as pair_id", "cast((solution * 13 + allele * 7 + map_no * 5 + i * 11) % 50 as double) + 0.7310585D as links")


def expected(spark, d):
    return ranking.combination_links(walk_sizes(spark, d), walk_links(spark, d))


@query(f"with {WEIGHTS} select sample, group_id, solution, combo, allele, map_no, round(weight, 9) as weight from wt")
def g18_combination_weights(spark, d):
    return weighted(spark, d).select("sample", "group_id", "solution", "combo", "allele", "map_no", F.round("weight", 9).alias("weight"))


@query(f"with {WEIGHTS} select sample, group_id, solution, combo, pair_id, expected from ex")
def g19_expected_links(spark, d):
    return expected(spark, d).drop("block")


@query("select key, count(*)::bigint as n, round(corr(a, b), 9) as corr from v_pairs group by key", "v_pairs")
def g20_pearson(spark, d):
    return ranking.correlation(V.v_pairs(spark, d), ["key"])


@query(
    """with r as (select key, rank() over (partition by key order by a) + (count(*) over (partition by key, a) - 1) / 2.0 as a, rank() over (partition by key order by b) + (count(*) over (partition by key, b) - 1) / 2.0 as b from v_pairs)
select key, count(*)::bigint as n, round(corr(a, b), 9) as corr from r group by key""",
    "v_pairs",
)
def g20_spearman(spark, d):
    return ranking.correlation(V.v_pairs(spark, d), ["key"], method="spearman")


@query(
    """with c as (select o_custkey as solution, o_orderkey as combo, case when o_orderkey % 6 = 0 then null else o_orderkey % 5 end as corr from orders)
select *, row_number() over (partition by solution order by corr desc nulls last, combo)::bigint as place from c"""
)
def g21_rank_combinations(spark, d):
    c = V.table(spark, d, "orders").selectExpr("o_custkey as solution", "o_orderkey as combo", "if(o_orderkey % 6 = 0, null, o_orderkey % 5) as corr")
    return ranking.rank_combinations(c, ["solution"]).withColumn("place", F.col("place").cast("long"))


@query(
    f"""with {WEIGHTS}, ob as (select *, ((solution * 17 + substr(pair_id, 2)::int * 29) % 60)::double as observed from ex),
sc as (select sample, group_id, solution, combo, case when min(expected) < max(expected) and min(observed) < max(observed) then round(covar_pop(expected, observed) / (stddev_pop(expected) * stddev_pop(observed)), 9) end as corr from ob group by all)
select sample, group_id, solution, combo, corr, row_number() over (partition by sample, group_id, solution order by corr desc nulls last, combo)::bigint as place from sc"""
)
def solution_ranking(spark, d):
    """G17-G21 in a row: combinations ranked by the correlation of expected with observed links."""
    e = expected(spark, d).withColumn("observed", F.expr("cast((solution * 17 + cast(substring(pair_id, 2) as int) * 29) % 60 as double)"))
    keys = ["sample", "group_id", "solution"]
    scored = ranking.correlation(e, [*keys, "block", "combo"], "expected", "observed")
    return ranking.rank_combinations(scored, keys).select(*keys, "combo", "corr", F.col("place").cast("long").alias("place"))


@query(
    f"""with {WEIGHTS}, nm as (select sample, group_id, solution, combo, string_agg('AL' || allele || '.LM' || map_no, ',' order by allele) as name from pick group by all),
ob as (select *, ((solution * 17 + substr(pair_id, 2)::int * 29) % 60)::double as observed from ex where not (solution % 3 = 0 and pair_id = 'p2')),
sc as (select sample, group_id, solution, combo, case when min(expected) < max(expected) and min(observed) < max(observed) then round(covar_pop(expected, observed) / (stddev_pop(expected) * stddev_pop(observed)), 9) end as corr from ob group by all),
pl as (select *, row_number() over (partition by sample, group_id, solution order by corr desc nulls last, combo)::bigint as place from sc)
select pl.*, name from pl join nm using (sample, group_id, solution, combo) where place <= 5"""
)
def g21_best_combinations(spark, d):
    """G17-G21 without a row for each combination: the five best of each solution. Not all pairs of every third solution were observed."""
    w = solution_walks(spark, d)
    alleles = w.selectExpr("*", "1000 + map_no * 250 + solution % 100 as length", "allele + 1 as cn")
    seen = w.select("sample", "group_id", "solution").distinct().selectExpr("*", "explode(sequence(0, 3)) as i").selectExpr("sample", "group_id", "solution", "concat('p', i) as pair_id", "cast((solution * 17 + i * 29) % 60 as double) as observed")
    out = best.best_combinations(alleles, walk_links(spark, d), seen.where("not (solution % 3 = 0 and pair_id = 'p2')"), 5)
    return out.withColumn("place", F.col("place").cast("long"))


# --- sources and sinks: what a writer leaves is what the reader gives back ---------------------------------

def _text(df: DataFrame, column: str, name: str) -> str:
    path = scratch(df.sparkSession, name)
    df.select(F.col(column).alias("value")).write.text(path)
    return path


@query("select refseg, pos, sum(depth)::double as depth from v_depth where refseg <> 'S3' group by all", "v_depth")
def a1_read_depth(spark, d):
    # samples are added up as runs, so that a position is spread once and not once a sample
    wide = depth.positions(V.v_depth(spark, d, ["tissue", "refseg"])).groupBy("refseg", "pos").pivot("tissue", ["case", "ctrl"]).agg(F.sum("depth"))
    row = F.concat_ws(" ", "refseg", F.col("pos").cast("string"), *[F.coalesce(F.col(c), F.lit(0.0)).cast("string") for c in ("case", "ctrl")])
    return readers.read_depth(spark, _text(wide.select(row.alias("t")), "t", "depth")).where("refseg <> 'S3'")


JUNC8 = ["refseg_5p", "bkpos_5p", "strd_5p", "refseg_3p", "bkpos_3p", "strd_3p", "jr_count"]


@query("select junc_no, refseg_5p, bkpos_5p, strd_5p, refseg_3p, bkpos_3p, strd_3p, jr_count, ncpr::double as ncpr from v_junc", "v_junc")
def a2_read_junctions(spark, d):
    """Numbered rows in compressed files of any size."""
    path = scratch(spark, "junctions")
    V.v_junc(spark, d).select("junc_no", *JUNC8, F.expr("nullif(ncpr, 0)").alias("ncpr")).write.csv(path, sep="\t", compression="gzip")
    return readers.read_junctions(spark, path, numbered=True)


@query("select row_number() over (partition by sample order by junc_no)::bigint as junc_no, refseg_5p, bkpos_5p, strd_5p, refseg_3p, bkpos_3p, strd_3p, jr_count, ncpr::double as ncpr from v_junc", "v_junc")
def a2_read_junction_files(spark, d):
    """A file of eight columns for each sample, as callers write them; numbers follow from the order of lines."""
    path = scratch(spark, "junction-files")
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in JUNC8], F.when(F.col("ncpr") != 0, F.col("ncpr").cast("string")))
    texts = V.v_junc(spark, d).groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("junc_no", line.alias("line")))).alias("l"))
    head = F.lit("#refseg_5p\tbkpos_5p\tstrd_5p\trefseg_3p\tbkpos_3p\tstrd_3p\tJR_count\tNormalCellCopyRatio\n")
    texts = texts.select("sample", F.concat(head, F.array_join("l.line", "\n")).alias("value"))
    texts.repartition("sample").write.partitionBy("sample").text(path)
    return readers.read_junctions(spark, f"{path}/*/").drop("sample")


@query("select 'V' || p_partkey as seg, p_brand as refseg, p_partkey as st, p_partkey + p_size as ed, p_retailprice as depth from part")
def a3_read_feature_segments(spark, d):
    path = scratch(spark, "features")
    V.table(spark, d, "part").selectExpr("concat('V', p_partkey) as seg", "p_brand as refseg", "p_partkey as st", "p_partkey + p_size as ed", "p_retailprice as depth").write.csv(path, sep="\t")
    return readers.read_feature_segments(spark, path)


@query("select refseg, st, ed, res from v_resol union all select 'P' || p_partkey, p_partkey, p_partkey + p_size, p_size from part", "v_resol")
def a4_read_resolution(spark, d):
    path = scratch(spark, "resolution")
    own = V.table(spark, d, "part").selectExpr("concat('P', p_partkey) as refseg", "p_partkey as st", "p_partkey + p_size as ed", "p_size as res")
    V.v_resol(spark, d).unionByName(own).write.csv(path, sep="\t")
    return readers.read_resolution(spark, path)


def config(spark: SparkSession, d: str) -> DataFrame:
    """Tagged text from the tables, read again."""
    part = V.table(spark, d, "part")
    seg = part.selectExpr("concat('@', if(p_partkey % 10 = 0, 'V', 'H'), 'SEG\tID=', if(p_partkey % 10 = 0, 'V', 'H'), p_partkey, if(p_partkey % 10 = 0, '', concat(';GROUP=', p_size)), ';INTERVAL=', p_brand, ':', p_partkey, '-', p_partkey + p_size, ';CN_ALT=', if(p_partkey % 7 = 0, 'N/A', cast(p_size as string)), ';LP_OFFSET%=', p_size, '%;') as t")
    junc = part.selectExpr("concat('@JUNC\tID=JUNC', p_partkey, ';SEGLINK=', if(p_partkey % 10 = 0, 'V', 'H'), p_partkey, '+,', if((p_partkey + 3) % 10 = 0, 'V', 'H'), p_partkey + 3, '-;CN_ALT=', p_size) as t")
    cyc = V.v_cycles(spark, d).selectExpr("concat('@UCYC\tID=U', allele, '_', cycle_id, ';SEGSTR=', array_join(tokens, ','), ',', tokens[0]) as t")
    sol = V.v_cycles(spark, d).groupBy("allele").agg(cycles.usage(F.collect_list(F.struct(F.col("cycle_id").alias("id"), F.col("cnt").alias("n")))).alias("u"))
    sol = sol.selectExpr("concat('SOLUTION\tNO=', allele, ';GROUP=1;SOLUTION_UCYC=', u, ';ALLELE_NO=1;ALLELE_CN=2;ALLELE_UCYC=', u, ';ALLELE_FVGM_UCYC=N/A') as t")
    doc = V.table(spark, d, "nation").selectExpr("explode(array(concat('@DOC\t', if(n_nationkey % 5 = 0, 'OTHER', 'SAMPLE_ID'), '=', n_name), '# a comment\twith a tab')) as t")
    lines = doc.unionByName(seg).unionByName(junc).unionByName(cyc).unionByName(sol)
    return readers.read_tagged_config(spark, _text(lines, "t", "config")).drop("file").withColumn("file", F.lit("f"))


CSEG = """cseg as (select case when p_partkey % 10 = 0 then 'V' else 'H' end || p_partkey as seg, case when p_partkey % 10 = 0 then null else p_size end as group_id, p_brand as refseg, p_partkey as st, p_partkey + p_size as ed,
 case when p_partkey % 7 = 0 then null else p_size::double end as cn_alt, p_size::double as lp_offset_pct from part)"""


@query("select case when n_nationkey % 5 = 0 then 'NULL' else n_name end as sample_id from nation")
def a5a_config_documents(spark, d):
    return readers.config_documents(config(spark, d)).select("sample_id")


@query(f"with {CSEG} select *, (ed - st + 1)::bigint as length from cseg")
def a5b_config_segments(spark, d):
    return readers.config_segments(config(spark, d)).select("seg", "group_id", "refseg", "st", "ed", "cn_alt", "lp_offset_pct", "length")


@query(
    f"""with {CSEG}, j as (select p_partkey as k, case when p_partkey % 10 = 0 then 'V' else 'H' end || p_partkey as seg5, case when (p_partkey + 3) % 10 = 0 then 'V' else 'H' end || (p_partkey + 3) as seg3 from part)
select 'JUNC' || k as junc_id, seg5, seg3, seg5 || '+,' || seg3 || '-' as link, seg3 || '+,' || seg5 || '-' as link_rc, coalesce(a.group_id, b.group_id) as group_id from j left join cseg a on a.seg = seg5 left join cseg b on b.seg = seg3"""
)
def a5c_config_junctions(spark, d):
    c = config(spark, d)
    return readers.config_junctions(c, readers.config_segments(c)).select("junc_id", "seg5", "seg3", "link", "link_rc", "group_id")


@query("select 'U' || allele || '_' || cycle_id as cycle_id, tokens from v_cycles", "v_cycles")
def a5d_config_cycles(spark, d):
    return readers.config_cycles(config(spark, d)).select("cycle_id", "tokens")


@query("select allele::int as solution, cycle_id::varchar as id, cnt from v_cycles", "v_cycles")
def a5e_a6_config_solutions(spark, d):
    return readers.explode_counts(readers.config_solutions(config(spark, d)), "allele_cycles", ["solution"])


@query("select l_quantity::bigint as len, least(1, round(l_discount * 20, 2))::double as ratio, count(*)::bigint as cnt from lineitem group by all")
def a7_read_length_distribution(spark, d):
    r = V.table(spark, d, "lineitem").selectExpr("cast(l_quantity as bigint) as len", "round(l_discount * 20, 2) as ratio").groupBy("len", "ratio").agg(F.count(F.lit(1)).alias("n"))
    line = r.groupBy("len").agg(F.sum("n").alias("n"), F.array_join(F.collect_list(F.concat("ratio", F.lit("("), "n", F.lit(")"))), ",").alias("l"))
    path = _text(line.select(F.concat_ws("\t", F.col("len").cast("string"), F.col("n").cast("string"), "l").alias("t")), "t", "lengths")
    return readers.read_length_distribution(spark, path).select("len", "ratio", "cnt")


PLINK = """pl as (select 'JUNC' || o_orderkey as anchor_a, case when o_custkey % 9 = 0 then '?' || o_custkey else 'H' || (o_custkey % 50) || ',chr2:' || o_custkey end as anchor_b, o_orderkey % 17 as links from orders)"""


@query(f"with {PLINK} select anchor_a, 'JUNC' as type_a, anchor_b, case when anchor_b like 'H%' then 'POS' end as type_b, links from pl")
def a8_b4_pair_links(spark, d):
    path = scratch(spark, "pairs")
    p = V.table(spark, d, "orders").selectExpr("concat('JUNC', o_orderkey) as anchor_a", "if(o_custkey % 9 = 0, concat('?', o_custkey), concat('H', o_custkey % 50, ',chr2:', o_custkey)) as anchor_b", "o_orderkey % 17 as links")
    writers.write_pair_links(p, path)
    return readers.read_pair_links(spark, path)


@query("select p_brand as anchor, l_orderkey::varchar as marker, count(*)::bigint as n from lineitem join part on l_partkey = p_partkey group by all")
def a9_read_marker_lists(spark, d):
    line, part = V.table(spark, d, "lineitem"), V.table(spark, d, "part")
    m = line.join(part, line["l_partkey"] == part["p_partkey"]).groupBy("p_brand", F.expr("l_orderkey div 100").alias("g")).agg(F.array_join(F.collect_list(F.col("l_orderkey").cast("string")), ",").alias("l"))
    path = _text(m.select(F.concat("p_brand", F.lit("\t"), F.regexp_replace("l", "1,", "1;")).alias("t")), "t", "markers")
    return readers.read_marker_lists(spark, path)


@query("select refseg, gene, tid, st, ed from v_track where refseg in ('S1', 'S2') and st <= 120 and ed >= 40", "v_track")
def a10_read_track(spark, d):
    path = scratch(spark, "track")
    writers.write_track(V.v_track(spark, d), path)
    region = V.v_region(spark, d).where("refseg in ('S1', 'S2')").selectExpr("refseg", "40L as st", "120L as ed")
    return readers.read_track(spark, path, region).select("refseg", "gene", "tid", "st", "ed")


_SQL["a10_read_track"] = duck("v_track", "select distinct refseg, gene, tid, st, ed from v_track where refseg in ('S1', 'S2') and st <= 120 and ed >= 40")


@query(
    """with s as (select 's' || s_nationkey as sample, s_suppkey as no, (s_suppkey % 5 + 0.125)::double as depth, case when s_suppkey % 3 = 0 then null else (s_suppkey % 4)::double + 0.5 end as cn from supplier),
head as (select sample, unnest(['##VERSION=v1.1', '##_please_find_HEADER_in_online_demo_', 'SAMPLE' || chr(9) || sample, 'PLOIDY' || chr(9) || '2m0', 'SOURCE' || chr(9) || 'H1', 'SINK' || chr(9) || '_please_fix_me_', 'FVGM' || chr(9) || 'ID=FVGM1;SEGSTR=_please_fix_me_']) as line, unnest(range(7)) as ord from (select distinct sample from s))
select sample, 0 as section, ord, line from head
union all select sample, 1, no, 'SEG' || chr(9) || 'ID=H' || no || ';CN_ORIG=' || coalesce(printf('%.2f', cn), 'N/A') || ';W=1;INTERVAL=S0:' || no || '-' || (no + 9) || ';PTDP=' || printf('%.2f', depth + 0.005) from s
union all select sample, 2, no, 'SEG' || chr(9) || 'ID=V' || no || ';CN_ORIG=' || coalesce(printf('%.2f', cn), 'N/A') || ';W=1;INTERVAL=VIR:' || no || '-' || (no + 9) || ';RAWDP=' || depth from s
union all select sample, 3, no, 'JUNC' || chr(9) || 'ID=JUNC' || no || ';SEGLINK=H1+,H' || no || '-;CN_ORIG=' || coalesce(printf('%.2f', cn), 'N/A') || ';W=1;REFSEG_5P=S0;BKPOS_5P=' || no || ';STRD_5P=+;REFSEG_3P=VIR;BKPOS_3P=' || (no + 9)
  || ';STRD_3P=-;NCPR=' || (no % 2) || ';RAWJRC=' || (no * 2) || ';PTJRC=' || no from s"""
)
def b1_cn_table_lines(spark, d):
    rows = V.table(spark, d, "supplier").selectExpr("concat('s', s_nationkey) as sample", "s_suppkey as seg_no", "s_suppkey as st", "s_suppkey + 9 as ed", "s_suppkey % 5 + 0.125D as depth", "if(s_suppkey % 3 = 0, null, s_suppkey % 4 + 0.5D) as cn")
    host = rows.selectExpr("*", "concat('H', seg_no) as seg", "'S0' as refseg").withColumn("depth", F.expr("depth + 0.005D"))
    virus = rows.selectExpr("*", "concat('V', seg_no) as seg", "'VIR' as refseg")
    j = rows.selectExpr(
        "sample", "seg_no as junc_no", "concat('H1+,H', seg_no, '-') as link", "'S0' as refseg_5p", "st as bkpos_5p", "'+' as strd_5p", "'VIR' as refseg_3p", "ed as bkpos_3p", "'-' as strd_3p",
        "cast(seg_no % 2 as double) as ncpr", "seg_no * 2 as jr_count", "seg_no as pure", "cn",
    )
    facts = rows.select("sample").distinct().selectExpr("sample", "'2m0' as ploidy", "'H1' as source", "cast(null as string) as sink", "cast(null as string) as chain")
    return writers.cn_lines(host, virus, j, facts)


@query(
    """with w as (select sample, allele, cycle_id, tokens, array_to_string(tokens, ';') || ';' as t, array_to_string(tokens, ' ') as u from v_cycles where cycle_id >= 0),
m as (select sample, allele, 1 + cycle_id % 100000 as map_no, 'LOCALMAP' || chr(9) || 'NO=' || (1 + cycle_id % 100000) || ';RANDPROB=0;SOLUTION_NO=1;GROUP=N/A;ALLELE_NO=' || allele || ';ALLELE_CN=2;FVGMUSED=N/A;SEGSTRMD5=' || md5(t || t || t)
  || ';SORTSEGSTRMD5=' || md5(regexp_replace(array_to_string(list_sort(list_concat(list_concat(tokens, tokens), tokens)), ';'), '[+-]', '', 'g')) || ';STRUDEPTH=2;' as head, 'STRUCTURE:' || chr(9) || '(' || u || ')x3' as body from w)
select sample, 0 as section, 0::bigint as allele_no, 0::bigint as map_no, (row_number() over (partition by sample order by seg) - 1)::bigint as ord, '@SEG' || chr(9) || 'ID=' || seg as line from v_seg
union all select distinct sample, 1, allele, 0, 0, 'SOLUTION' || chr(9) || 'NO=1;ALLELE_NO=' || allele from w
union all select sample, 1, allele, map_no, 1, head from m union all select sample, 1, allele, map_no, 2, body from m""",
    "v_cycles v_seg",
)
def b2_walk_file(spark, d):
    c = V.v_cycles(spark, d).where("cycle_id >= 0").selectExpr("sample", "allele", "1 + cycle_id % 100000 as map_no", "tokens", "1 as solution", "2 as allele_cn", "2 as depth")
    w = c.withColumn("walk", F.concat("tokens", "tokens", "tokens"))
    keys = ["sample", "allele"]
    folds = cycles.fold_walks(w, [*keys, "map_no"], c.select(*keys, "map_no", F.lit(1).alias("unit_id"), F.col("tokens").alias("unit")))
    lines = writers.walk_lines(w, folds, keys)
    order = Window.partitionBy("sample").orderBy("seg")
    header = V.v_seg(spark, d).select("sample", (F.row_number().over(order) - 1).alias("ord"), F.concat(F.lit("@SEG\tID="), "seg").alias("line"))
    solutions = c.select(*keys).distinct().select(*keys, F.col("allele").alias("allele_no"), F.concat(F.lit("SOLUTION\tNO=1;ALLELE_NO="), "allele").alias("line"))
    return writers.walk_file(header, solutions, lines, keys)


@query(
    f"""with {WEIGHTS}, nm as (select sample, group_id, solution, combo, string_agg('AL' || allele || '.LM' || map_no, ',' order by allele) as name from pick group by all),
rk as (select *, row_number() over (partition by sample, group_id, solution order by combo)::bigint as place from nm),
body as (select r.*, e.pair_id, e.expected, row_number() over (partition by r.sample, r.group_id, r.solution, r.combo order by e.pair_id) + 1 as ord from rk r join ex e using (sample, group_id, solution, combo))
select sample, group_id, solution, place, 0::bigint as ord, '#Group:' || group_id || chr(9) || 'Solution:' || solution || chr(9) || name || chr(9) || 'SpearmanCorr=' || case when combo % 2 = 0 then 'N/A' else (combo % 9)::varchar end as line from rk
union all select sample, group_id, solution, place, 1, '#anchor_a' || chr(9) || 'anchor_b' || chr(9) || 'userLC' || chr(9) || 'simuLC' from rk
union all select sample, group_id, solution, place, ord, 'a' || pair_id || chr(9) || 'b' || pair_id || chr(9) || (combo % 5) || chr(9) || round(expected * 4)::bigint from body"""
)
def b3_rank_lines(spark, d):
    keys = ["sample", "group_id", "solution"]
    names = ranking.combination_names(ranking.walk_combinations(solution_walks(spark, d)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("combo")).cast("long")
    ranked = names.select(*keys, F.col("combo").alias("number"), F.col("name").alias("combo"), F.expr("if(combo % 2 = 0, null, cast(combo % 9 as double))").alias("corr"), place.alias("place"))
    e = expected(spark, d).withColumnRenamed("combo", "number").join(ranked.select(*keys, "number", "combo"), [*keys, "number"])
    rows = e.select(*keys, "combo", "pair_id", F.concat(F.lit("a"), "pair_id").alias("anchor_a"), F.concat(F.lit("b"), "pair_id").alias("anchor_b"), (F.col("number") % 5).alias("observed"), F.round(F.col("expected") * 4, 0).alias("expected"))
    return writers.rank_lines(ranked.drop("number"), rows, "Spearman")


@query(_SQL["g6_pair_matrix"])
def b5_pair_matrix(spark, d):
    path = scratch(spark, "matrix")
    writers.write_pair_matrix(g6_pair_matrix(spark, d), path)
    return spark.read.csv(path, sep="\t", header=True, nullValue="-", schema="sample string, anchor string, b11 long, b23 long, b55 long")


@query("select sample, anchor, marker from v_markers", "v_markers")
def b6_anchor_markers(spark, d):
    path = scratch(spark, "anchor-markers")
    writers.write_anchor_markers(V.v_markers(spark, d), path)
    return spark.read.csv(path, sep="\t", schema="sample string, anchor string, marker long")

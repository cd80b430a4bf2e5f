"""Logical views of the driver's tables, once as DataFrames and once as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples that share all segment names; every order belongs to one.
SAMPLES = 500
SEGMENTS = (("H1", "S0", 1, 100), ("H2", "S0", 101, 250), ("H3", "S0", 251, 300), ("H4", "S0", 301, 420), ("V1", "VIR", 1, 80))
EVENT_SEGMENT = {"click": "H1", "view": "H2", "signup": "H3", "purchase": "H4", "error": "V1"}
MIN_BASEQ, MIN_MAPQ = 2, 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_reads(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        f"concat('s', l_orderkey % {SAMPLES}) as sample", "concat('S', l_suppkey % 5) as refseg", "l_partkey + 1 as st", "l_partkey + cast(l_quantity as bigint) as ed",
        "cast(round(l_tax * 100) as int) as mapq", "l_linenumber as baseq", "l_orderkey as molecule",
    )


def v_facts(spark, d):
    """sample, mean_case, mean_ctrl, purity, ploidy_t, ploidy_n of each sample; some have no case mean, some a purity of zero."""
    i = table(spark, d, "orders").selectExpr(f"o_orderkey % {SAMPLES} as i").distinct()
    return i.selectExpr(
        "concat('s', i) as sample", "if(i % 11 = 5, null, 30.0D + i % 7) as mean_case", "30.2D as mean_ctrl", "cast(i % 10 as double) / 10 as purity", "2.0D + i % 3 as ploidy_t", "2.0D as ploidy_n",
    )


def v_region(spark, d):
    end = table(spark, d, "part").selectExpr("max(p_partkey) + 100 as ed")
    return end.selectExpr("explode(array('S0', 'S1', 'S2', 'S3', 'S4')) as refseg", "1L as st", "ed")


def v_resol(spark, d):
    rows = "explode(array(struct(1L as st, 700L as ed, 10L as res), struct(701L as st, 1400L as ed, 25L as res), struct(1401L as st, 9223372036854775807L as ed, 50L as res))) as r"
    out = v_region(spark, d).selectExpr("refseg", "ed as last", rows)
    return out.selectExpr("refseg", "r.st as st", "least(r.ed, last) as ed", "r.res as res").where("st <= ed")


def v_junc(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        f"concat('s', l_orderkey % {SAMPLES}) as sample",
        "l_orderkey * 1000 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax) as junc_no",
        "concat('S', l_suppkey % 5) as refseg_5p", "l_partkey + 1 as bkpos_5p", "if(l_returnflag = 'R', '-', '+') as strd_5p",
        "concat('S', (l_suppkey + l_linenumber) % 5) as refseg_3p", "(l_partkey * 7 + l_linenumber * 131) % 2000 + 1 as bkpos_3p",
        "if(l_linestatus = 'O', '+', '-') as strd_3p", "cast(l_quantity as bigint) as jr_count", "cast(l_discount >= 0.05 as int) as ncpr",
    )


def v_markers(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    line = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).selectExpr("concat('s', l_suppkey % 3) as sample", "p_brand as anchor", "l_orderkey as marker").distinct()


def v_pairs(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).selectExpr("c_nationkey as key", "o_totalprice as a", "c_acctbal as b")


def v_track(spark, d):
    return v_reads(spark, d).selectExpr("refseg", "molecule % 100 as gene", "lpad(cast(baseq as string), 3, '0') as tid", "st", "ed")


def v_seg(spark, d):
    """sample, seg, refseg, st, ed: the same names in every sample, with lengths of its own."""
    rows = ", ".join(f"struct('{s}' as seg, '{r}' as refseg, {a}L as st, {b}L as ed)" for s, r, a, b in SEGMENTS)
    own = table(spark, d, "events").selectExpr("user_id % 7 as k").distinct()
    return own.selectExpr("k", f"explode(array({rows})) as s").selectExpr("concat('s', k) as sample", "s.seg as seg", "s.refseg as refseg", "s.st as st", "s.ed + k * 10 as ed")


def v_tok(spark, d):
    """sample, allele, cycle_id, event_id, rn (from 1 in its cycle), token: each user's events, eight to a cycle, five cycles to an allele."""
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in EVENT_SEGMENT.items())
    ev = table(spark, d, "events").selectExpr("user_id", "ts", "event_id", f"concat(case event_type {cases} end, if(value >= 30, '+', '-')) as token")
    ranked = ev.selectExpr("*", "row_number() over (partition by user_id order by ts, event_id) - 1 as n")
    return ranked.selectExpr("concat('s', user_id % 7) as sample", "user_id * 1000 + n div 40 as allele", "user_id * 100000 + n div 8 as cycle_id", "event_id", "n % 8 + 1 as rn", "token")


def v_cycles(spark, d):
    """sample, allele, cycle_id, cnt, tokens: every event in a cycle, and one backbone for each allele."""
    cycles = v_tok(spark, d).groupBy("sample", "allele", "cycle_id").agg(F.expr("transform(array_sort(collect_list(struct(rn, token))), x -> x.token) as tokens"))
    cycles = cycles.selectExpr("sample", "allele", "cycle_id", "1 + cycle_id % 3 as cnt", "tokens")
    back = cycles.select("sample", "allele").distinct().selectExpr("sample", "allele", "-1L as cycle_id", "1L as cnt", "array('H1+', 'H2+', 'H3+', 'H4+') as tokens")
    return cycles.unionByName(back)


def v_depth(spark, d, keys=("sample", "tissue", "refseg")):
    """sample, tissue, refseg, st, ed, depth: runs of even depth; with fewer keys that of all their reads together."""
    from helixloom.operators.depth import coverage

    reads = v_reads(spark, d).selectExpr("*", "if(baseq % 2 = 0, 'case', 'ctrl') as tissue")
    return coverage(reads, list(keys), MIN_BASEQ, MIN_MAPQ)


_case = " ".join(f"when '{k}' then '{v}'" for k, v in EVENT_SEGMENT.items())
DUCK = {
    "v_reads": f"""select 's' || (l_orderkey % {SAMPLES}) as sample, 'S' || (l_suppkey % 5) as refseg, l_partkey + 1 as st, l_partkey + l_quantity::bigint as ed,
  round(l_tax * 100)::int as mapq, l_linenumber as baseq, l_orderkey as molecule from lineitem""",
    "v_facts": f"""select 's' || i as sample, case when i % 11 = 5 then null else 30.0::double + i % 7 end as mean_case, 30.2::double as mean_ctrl, (i % 10)::double / 10 as purity, 2.0::double + i % 3 as ploidy_t, 2.0::double as ploidy_n
  from (select distinct o_orderkey % {SAMPLES} as i from orders)""",
    "v_region": "select 'S' || i as refseg, 1::bigint as st, (select max(p_partkey) + 100 from part) as ed from range(5) t(i)",
    "v_resol": """select refseg, r.st as st, least(r.ed, g.ed) as ed, r.res as res from v_region g,
  (values (1::bigint, 700::bigint, 10::bigint), (701, 1400, 25), (1401, 9223372036854775807, 50)) r(st, ed, res) where r.st <= g.ed""",
    "v_junc": f"""select 's' || (l_orderkey % {SAMPLES}) as sample, l_orderkey * 1000 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax) as junc_no,
  'S' || (l_suppkey % 5) as refseg_5p, l_partkey + 1 as bkpos_5p, if(l_returnflag = 'R', '-', '+') as strd_5p,
  'S' || ((l_suppkey + l_linenumber) % 5) as refseg_3p, (l_partkey * 7 + l_linenumber * 131) % 2000 + 1 as bkpos_3p,
  if(l_linestatus = 'O', '+', '-') as strd_3p, l_quantity::bigint as jr_count, (l_discount >= 0.05)::int as ncpr
  from lineitem""",
    "v_markers": "select distinct 's' || (l_suppkey % 3) as sample, p_brand as anchor, l_orderkey as marker from lineitem join part on l_partkey = p_partkey",
    "v_pairs": "select c_nationkey as key, o_totalprice as a, c_acctbal as b from orders join customer on o_custkey = c_custkey",
    "v_track": "select refseg, molecule % 100 as gene, lpad(baseq::varchar, 3, '0') as tid, st, ed from v_reads",
    "v_seg": "select 's' || k as sample, seg, refseg, st, ed + k * 10 as ed from (select distinct user_id % 7 as k from events), (values "
    + ", ".join(f"('{s}', '{r}', {a}::bigint, {b}::bigint)" for s, r, a, b in SEGMENTS)
    + ") t(seg, refseg, st, ed)",
    "v_tok": f"""select 's' || (user_id % 7) as sample, user_id * 1000 + n // 40 as allele, user_id * 100000 + n // 8 as cycle_id, event_id, n % 8 + 1 as rn, token
  from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as n, (case event_type {_case} end) || if(value >= 30, '+', '-') as token from events)""",
    "v_cycles": """select sample, allele, cycle_id, 1 + cycle_id % 3 as cnt, list(token order by rn) as tokens from v_tok group by all
  union all select distinct sample, allele, -1::bigint, 1::bigint, ['H1+', 'H2+', 'H3+', 'H4+'] from v_tok""",
    "v_depth": f"""select sample, if(baseq % 2 = 0, 'case', 'ctrl') as tissue, refseg, pos, count(*)::double as depth
  from (select *, unnest(range(st, ed + 1)) as pos from v_reads where baseq >= {MIN_BASEQ} and mapq >= {MIN_MAPQ}) group by all""",
}
NEEDS = {"v_resol": ["v_region"], "v_track": ["v_reads"], "v_cycles": ["v_tok"], "v_depth": ["v_reads"]}


def duck(names: str, body: str) -> str:
    """DuckDB SQL with the views that body needs in front; body may begin with further ``name as (...)`` parts and a comma."""
    want: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in want:
            want.append(n)

    for n in names.split():
        add(n)
    head = ",\n".join(f"{n} as ({DUCK[n]})" for n in want)
    body = body.strip()
    if body.startswith("with "):
        return f"with {head},\n{body[5:]}" if head else body
    return f"with {head}\n{body}" if head else body

"""Every registered query with SQL against DuckDB on the smallest tables, and the plans of those with two large sides."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import readwriter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from helixloom.operators.depth import positions  # noqa: E402
from helixloom.plans import catalog  # noqa: E402
from helixloom.plans import views as V  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    result = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    assert got == want


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that a query writes on its way; each is kept before it is written."""
    kept, write = [], readwriter.DataFrameWriter.parquet

    def parquet(self, *args, **options):
        kept.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **options)

    monkeypatch.setattr(readwriter.DataFrameWriter, "parquet", parquet)
    return kept


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_nested_loops(spark, plans, name):
    """Nothing that a query runs, last or on its way, compares all pairs of rows or runs Python row by row."""
    last = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    for plan in [*plans, last]:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BatchEvalPython" not in plan and "Pandas" not in plan


def test_walk_rounds(spark):
    """The tables of one round of walks are joined on keys alone."""
    from helixloom.operators import assemble

    spine = spark.createDataFrame([("a", "back", ["H1+", "H2+"])], "allele string, cycle_id string, tokens array<string>")
    pending = spark.createDataFrame([("a", "b", ["H2+"], 2, 3, None)], "allele string, cycle_id string, tokens array<string>, left long, weight long, draw long").withColumn("rank", F.col("weight"))
    blocks = assemble._latest(assemble._root(spine, ["allele"]), ["allele"])
    sites = assemble._sites(blocks, pending, ["allele"])
    for df in (sites, assemble._late_sites(blocks, pending, ["allele"]), assemble._changes(blocks, sites.withColumn("no", F.lit(1).cast("long")), ["allele"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


def test_walks_use_only_pairs_of_their_cycles(spark):
    """Every pair of neighbours on a walk is one of a cycle (or turned round), the backbone, or a splice at the anchor."""
    from helixloom.plans import views as V

    walks = {r.allele: r.walk.split(" ") for r in catalog.queries()["f11_walk_text"](spark, DATA).collect()}
    cycles = V.v_cycles(spark, DATA).collect()
    flip = {"+": "-", "-": "+"}
    for allele, walk in walks.items():
        pairs = set()
        for c in cycles:
            if c.allele == allele:
                t = list(c.tokens)
                ring = list(zip(t, t[1:] + t[:1]))
                pairs |= set(ring) | {(b[:-1] + flip[b[-1]], a[:-1] + flip[a[-1]]) for a, b in ring}
        assert all(p in pairs for p in zip(walk, walk[1:]))


def test_read_depth_spreads_a_position_once_a_tissue(spark):
    """Samples are added up before runs are spread, so rows grow with positions and not with reads."""
    runs = V.v_depth(spark, DATA, ["tissue", "refseg"])
    rows, own = positions(runs).count(), positions(V.v_depth(spark, DATA)).count()
    assert rows == positions(V.v_depth(spark, DATA)).select("tissue", "refseg", "pos").distinct().count() < own
    seen, spread = [], catalog.depth.positions
    with pytest.MonkeyPatch.context() as m:
        m.setattr(catalog.depth, "positions", lambda r: seen.append(spread(r)) or seen[-1])
        catalog.queries()["a1_read_depth"](spark, DATA)
    assert seen[0].count() == rows


def test_lineitem_is_read_once_for_runs_and_for_cuts(spark, plans):
    """Coverage is summed up once for windows and for stable stretches, and breakends are made once for cuts and for region ends."""
    last = catalog.queries()["c5_stable_positions"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert sum("lineitem.parquet" in p for p in [*plans, last]) == 1
    cuts = catalog.queries()["d4_segment_by_breakends"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert cuts.count("lineitem.parquet") == 1


@pytest.mark.parametrize("name, table", [("f12_fold_nested", "events"), ("g5_shared_marker_links", "lineitem")])
def test_tables_read_once(spark, plans, name, table):
    """What a query's later steps share is made once and kept."""
    last = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    scans = {"f12_fold_nested": 2, "g5_shared_marker_links": 3}  # cycles and their backbones; markers and the segments of either anchor
    assert sum(p.count(f"{table}.parquet") for p in [*plans, last]) <= scans[name]


def test_junctions_are_classified_in_their_rows(spark):
    """Both ends are looked up beside each other: junctions are numbered by one shuffle and never grouped or joined again."""
    plan = catalog.queries()["d2_classify_junctions"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and "SortMergeJoin" not in plan


def test_violations_meet_names_once(spark, plans):
    """Junctions and cycles meet the names of segments in one join, and pairs meet junctions in one aggregate."""
    last = catalog.queries()["d14_violations"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "array_join" not in last and last.count("LeftAnti") == 1

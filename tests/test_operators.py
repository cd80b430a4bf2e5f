"""Worked case of the copy-number, cycle and walk operators, and small fixtures for the edges."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixloom.functions import tokens as T
from helixloom.operators import assemble, best, cycles, depth, distributions, intervals, links, ranking, scans, segments, tracks
from helixloom.sources import readers, storage, writers

JUNCTIONS = [
    ("s", 1, "chr2", 141759732, "+", "chr2", 141790205, "+", 20, 0.0),
    ("s", 2, "chr2", 141759733, "-", "chr2", 141790205, "+", 139, 0.0),
    ("s", 3, "HPV16", 4648, "+", "chr2", 141802259, "-", 102, 0.0),
    ("s", 4, "chr2", 141790204, "+", "HPV16", 6532, "+", 140, 0.0),
]
JUNC_SCHEMA = "sample string, junc_no long, refseg_5p string, bkpos_5p long, strd_5p string, refseg_3p string, bkpos_3p long, strd_3p string, jr_count long, ncpr double"
HOST = {"H1": (141740000, 141759732, 29.56, 1.97), "H2": (141759733, 141790204, 149.47, 9.96), "H3": (141790205, 141802259, 181.66, 12.11), "H4": (141802260, 141806500, 28.86, 1.92)}


@pytest.fixture(scope="module")
def junctions(spark):
    return spark.createDataFrame(JUNCTIONS, JUNC_SCHEMA)


@pytest.fixture(scope="module")
def region(spark):
    return spark.createDataFrame([("chr2", 141740000, 141806500)], "refseg string, st long, ed long")


def ratio():
    return depth.sample_cn_ratio(F.lit(30.0), F.lit(1.0), F.lit(2.0), F.lit(2.0))


def test_segments_of_the_worked_case(spark, junctions, region):
    s = segments.name_segments(segments.segment_by_breakends(region, segments.breakends(junctions, region)))
    assert {r.seg: (r.st, r.ed) for r in s.collect()} == {k: v[:2] for k, v in HOST.items()}
    ends = segments.source_sink(s).first()
    assert (ends.source, ends.sink) == ("H1", "H4")
    mapped = {(r.junc_no, r.side): r.seg for r in segments.map_breakends_to_segments(segments.breakends(junctions, region), s).collect()}
    assert mapped == {(1, "5p"): "H1", (1, "3p"): "H3", (2, "5p"): "H2", (2, "3p"): "H3", (3, "3p"): "H3", (4, "5p"): "H2"}
    kinds = {r.junc_no: r.kind for r in segments.classify_junctions(junctions, region).collect()}
    assert kinds == {1: "intra-SV", 2: "intra-SV", 3: "inter-SV/vitg", 4: "inter-SV/vitg"}


def test_copy_numbers_of_the_worked_case(spark, junctions):
    rows = spark.createDataFrame([(k, v[2]) for k, v in HOST.items()] + [("V1", 147.54), ("V2", 0.12), ("V3", 146.65)], "seg string, depth double")
    got = {r.seg: r.cn for r in segments.feature_cn(rows, ratio()).collect()}
    assert got == {**{k: v[3] for k, v in HOST.items()}, "V1": 9.84, "V2": 0.01, "V3": 9.78}
    a = depth.admixture(F.lit(1.0), F.lit(2.0), F.lit(2.0))
    j = {r.junc_no: (r.pure, r.cn) for r in segments.junction_cn(junctions, ratio(), F.lit(30.0), a["n_ratio"]).collect()}
    assert j == {1: (20, 1.33), 2: (139, 9.27), 3: (102, 6.80), 4: (140, 9.33)}


def test_purity_zero_counts_as_one_and_negative_reads_truncate(spark):
    one = spark.range(1).select(depth.admixture(F.lit(0.0), F.lit(0.0), F.lit(2.0))["t_part"].alias("t")).first().t
    assert one == 2.0
    row = spark.createDataFrame([("s", 1, 1, 0.5)], "sample string, junc_no long, jr_count long, ncpr double")
    assert segments.junction_cn(row, F.lit(1.0), F.lit(10.0), F.lit(0.5)).first().pure == -1


def test_one_base_segment(spark):
    j = spark.createDataFrame([("s", 1, "c", 10, "+", "c", 10, "+", 1, 0.0)], JUNC_SCHEMA)
    region = spark.createDataFrame([("c", 1, 20)], "refseg string, st long, ed long")
    got = [(r.st, r.ed) for r in segments.segment_by_breakends(region, segments.breakends(j, region)).orderBy("seg_no").collect()]
    assert got == [(1, 9), (10, 10), (11, 20)]


def test_walk_of_the_worked_case(spark):
    seg = spark.createDataFrame([(k, v[0], v[1]) for k, v in HOST.items()] + [("V1", 1, 4648), ("V2", 4649, 6531), ("V3", 6532, 7906)], "seg string, st long, ed long")
    text = spark.createDataFrame([("a", "UCYC1", 1, "H1+,H3+,H4+,H1+"), ("a", "UCYC2", 5, "H3+,V1-,V3-,H2-,H3+")], "allele string, cycle_id string, cnt long, t string")
    c = text.select("allele", "cycle_id", "cnt", T.parse_cycle(F.col("t")).alias("tokens"))
    assert c.where("cycle_id = 'UCYC2'").select(T.canonical_start(F.col("tokens")).alias("t")).first().t == ["H2-", "H3+", "V1-", "V3-"]
    got = assemble.assemble_walks(c, seg, ["allele"], "H1", "H4")
    row = cycles.walk_signatures(got).first()
    assert row.valid and row.walk == ["H1+", *["H3+", "V1-", "V3-", "H2-"] * 5, "H3+", "H4+"]
    assert row.md5_walk == "87350327d49d4af849548eaedaed32ff" and row.md5_composition == "02363cc6bbacdbf94d2b09338c13d669"
    account = {r.seg: r.expected for r in cycles.solution_accounting(c.withColumn("cnt", F.col("cnt") * 2), spark.createDataFrame([("H1", 2.0)], "seg string, cn double"), ["allele"]).collect()}
    assert account == {"H1": 2, "H2": 10, "H3": 12, "H4": 2, "V1": 10, "V3": 10}
    units = spark.createDataFrame([("a", "u", ["H3+", "V1-", "V3-", "H2-"])], "allele string, unit_id string, unit array<string>")
    fold = cycles.fold_repeats(got, ["allele"], units).collect()
    assert [(r.start, r.times) for r in fold] == [(1, 5)]


def spliced(spark, back, cycles_):
    """The walk from a backbone and (id, tokens turned to the anchor, copies, length); None if copies are left over."""
    spine = spark.createDataFrame([("a", "back", back)], "allele string, cycle_id string, tokens array<string>")
    schema = "allele string, cycle_id string, tokens array<string>, left long, weight long, draw long"
    nodes, left = assemble.splice(spine, spark.createDataFrame([("a", c, t, n, x, None) for c, t, n, x in cycles_], schema), ["allele"])
    return None if left.first().left else cycles.expand_nested(nodes, ["allele"]).first().walk


def test_nested_cycles(spark):
    back = ["H1+", "H2+", "H4+"]
    # 3 in 6: divides; the second cycle attaches only inside the first
    walk = spliced(spark, back, [("b", ["H2+", "V1+"], 3, 10), ("c", ["V1+", "V2+"], 6, 10)])
    assert walk.count("V2+") == 6 and walk.count("V1+") == 9
    assert walk == ["H1+", *["H2+", *["V1+", "V2+"] * 2, "V1+"] * 3, "H2+", "H4+"]
    # opposite strand: the reverse complement goes after the token
    assert spliced(spark, back, [("b", ["H2-", "V1+"], 1, 5)]) == ["H1+", "H2+", "V1-", "H2+", "H4+"]
    # fewer copies than repetitions: the block is split
    walk = spliced(spark, back, [("b", ["H2+", "V1+"], 6, 1), ("c", ["V1+", "V2+"], 4, 100)])
    assert walk == ["H1+", *["H2+", "V1+", "V2+", "V1+"] * 4, *["H2+", "V1+"] * 2, "H2+", "H4+"]
    # 1 in 5 is left over by the first pass and takes one repetition; copies that do not divide go on to a second site
    walk = spliced(spark, back, [("b", ["H2+", "V1+"], 2, 1), ("c", ["V1+", "V2+"], 5, 100)])
    assert walk.count("V2+") == 5 and walk.count("V1+") == 7
    assert spliced(spark, back, [("b", ["V7+", "V8+"], 1, 5)]) is None


def test_log_writes_what_is_added(spark, monkeypatch):
    """Twenty rounds of one row write each row twice at most (eight tables become one), and a read opens few of them."""
    sizes, write = [], storage.written

    def count(df, name):
        sizes.append(df.count())
        return write(df, name)

    monkeypatch.setattr(storage, "written", count)
    log = storage.Log(spark.range(1), "test-log")
    for i in range(1, 20):
        log.add(spark.range(i, i + 1))
    assert sorted(r.id for r in log.rows().collect()) == list(range(20))
    assert sum(sizes) == 20 + 16 and sorted(map(len, log.levels)) == [2, 4]


def test_rounds_write_only_changed_blocks(spark, monkeypatch):
    """A walk of one cycle does not write another walk's blocks, nor its own that stay as they are; walks that are done retire and come back."""
    back = [f"H{i}+" for i in range(1, 31)]
    spine = spark.createDataFrame([(k, "back", back) for k in ("a", "b", "c")], "allele string, cycle_id string, tokens array<string>")
    schema = "allele string, cycle_id string, tokens array<string>, left long, weight long, draw long"
    rows = [("a", f"x{i:02}", [f"H{i}+", f"V{i}+"], 2, 10, None) for i in range(1, 21)] + [("b", "y", ["H2+", "V2+"], 1, 10, None)]
    blocks, write = [], storage.written

    def count(df, name):
        if name == "walk-blocks":
            blocks.append(df.count())
        return write(df, name)

    monkeypatch.setattr(storage, "written", count)
    nodes, left = assemble.splice(spine, spark.createDataFrame(rows, schema), ["allele"])
    assert max(r.left for r in left.collect()) == 0
    walks = {r.allele: r.walk for r in cycles.expand_nested(nodes, ["allele"]).collect()}
    want = [t for i in range(1, 31) for t in ([f"H{i}+", f"V{i}+"] * 2 if i < 21 else []) + [f"H{i}+"]]
    assert walks == {"a": want, "b": [*back[:1], "H2+", "V2+", *back[1:]], "c": back}
    assert blocks[0] == 3 and blocks[1] == 2 and sum(blocks) < 4 * 24  # not 20 rounds times 24 blocks


def test_replicates_and_ends_of_groups(spark):
    """Each replicate is a walk of all copies; groups have their own source and sink; reruns agree."""
    seg = spark.createDataFrame([(s, f"H{i}", 1, 10 * i) for s in ("a", "b") for i in range(1, 6)], "sample string, seg string, st long, ed long")
    rows = [("a", 0, 1, ["H1+", "H2+", "H3+"]), ("a", 1, 2, ["H2+", "H4+"]), ("a", 2, 3, ["H2-", "H5+"]), ("b", 0, 1, ["H3+", "H2+", "H5-"]), ("b", 1, 1, ["H5+", "H1+"])]
    c = spark.createDataFrame(rows, "sample string, cycle_id int, cnt long, tokens array<string>")
    ends = spark.createDataFrame([("a", "H1", "H3"), ("b", "H3", "H5")], "sample string, source string, sink string")
    runs = [sorted((r.sample, r.map_no, r.valid, tuple(r.walk)) for r in assemble.assemble_walks(c.repartition(n), seg, ["sample"], ends=ends, replicates=4, seed=3).collect()) for n in (1, 3)]
    assert runs[0] == runs[1] and len(runs[0]) == 8
    for sample, _, valid, walk in runs[0]:
        want = sorted(t[:-1] for s, i, n, ts in rows if s == sample for t in ts * n)
        assert valid and sorted(t[:-1] for t in walk) == want


def test_nodes_give_depth_and_places(spark):
    seg = spark.createDataFrame([("H1", 1, 10), ("H2", 1, 20), ("H3", 1, 30), ("V1", 1, 5)], "seg string, st long, ed long")
    rows = [("a", 0, 1, ["H1+", "H2+", "H3+"]), ("a", 1, 5, ["H2+", "V1+"])]
    nodes, state = assemble.walk_nodes(spark.createDataFrame(rows, "allele string, cycle_id int, cnt long, tokens array<string>"), seg, ["allele"], "H1", "H3")
    got = cycles.nested_stats(nodes, seg, ["allele", "map_no"]).first()
    assert state.first().valid and (got.n_tokens, got.length, got.n_blocks, got.structure_depth) == (13, 60 + 5 * 25, 1, 2)
    want = spark.createDataFrame([("a", s, n, v) for s, n, v in (("H3", None, None), ("V1", 5, None), ("V1", 4, None))], "allele string, seg string, count long, avoid string")
    found = {(r.seg, r.block, r.ord) for r in cycles.locate_in_blocks(nodes, want, ["allele"]).collect()}
    assert found == {("H3", None, 3), ("V1", 1, 1)}


def test_folded_walks(spark):
    walk = ["H1+", *["H3+", "V1-", "V3-", "H2-"] * 5, "H3+", "H4+"]
    w = spark.createDataFrame([("a", walk), ("b", ["H1+", "H2+"]), ("c", ["V1+"] * 7)], "allele string, walk array<string>")
    u = spark.createDataFrame([("a", "u", walk[1:5]), ("a", "x", walk[2:6]), ("c", "y", ["V1+"]), ("c", "z", ["V1+", "V1+"])], "allele string, unit_id string, unit array<string>")
    got = {r.allele: (r.text, r.height) for r in cycles.fold_walks(w, ["allele"], u).collect()}
    assert got == {"a": ("H1+ (H3+ V1- V3- H2-)x5 H3+ H4+", 1), "b": ("H1+ H2+", 0), "c": ("(V1+)x7", 1)}


def test_nested_folds(spark):
    """Counts of counts, from the blocks of nested nodes; flanking copies join a block's count; walks that lack the units stay."""
    ab, abc = ["A1+", "B1-"], ["A1+", "B1-", "A1+", "B1-", "C1+"]
    walks = [("n", ["H1+", *abc * 3, "H2+"]), ("deep", [*((abc * 2 + ["D1+"]) * 2), "H2+"]), ("edge", [*ab, *abc * 3]), ("flat", ["H1+", "A1+"]), ("none", []), ("twin", [*ab * 4, "C1+", *abc])]
    w = spark.createDataFrame(walks, "allele string, walk array<string>")
    units = [("ab", 1, ab), ("abc", 2, abc), ("abcd", 3, abc * 2 + ["D1+"])]
    u = spark.createDataFrame([(a, *x) for a, _ in walks for x in units], "allele string, unit_id string, level int, unit array<string>")
    got = {r.allele: (r.text, r.height) for r in cycles.fold_nested(w, ["allele"], u).collect()}
    assert got == {
        "n": ("H1+ ((A1+ B1-)x2 C1+)x3 H2+", 1), "deep": ("(((A1+ B1-)x2 C1+)x2 D1+)x2 H2+", 1), "edge": ("(A1+ B1-)x3 C1+ ((A1+ B1-)x2 C1+)x2", 2),
        "flat": ("H1+ A1+", 0), "none": ("", 0), "twin": ("(A1+ B1-)x4 C1+ (A1+ B1-)x2 C1+", 2),
    }
    nodes = [(None, [], None, 1, 0), ([], [0], "H1+", None, 1), ([], [1], None, 3, 1), ([], [2], "A1+", None, 1), ([1], [1, 0], None, 2, 2), ([1], [1, 1], "C1+", None, 2), ([1, 0], [1, 0, 0], "A1+", None, 3), ([1, 0], [1, 0, 1], "B1-", None, 3)]
    n = spark.createDataFrame([("n", *x) for x in nodes], "allele string, parent array<long>, path array<long>, token string, cnt long, depth int")
    units = cycles.nested_units(n, ["allele"])
    assert sorted((r.level, r.unit) for r in units.collect()) == [(1, ab), (2, abc)]
    walk = cycles.expand_nested(n, ["allele"])
    assert walk.first().walk == ["H1+", *abc * 3, "A1+"]
    assert cycles.fold_nested(walk, ["allele"], units).first().text == "H1+ ((A1+ B1-)x2 C1+)x3 A1+"
    assert cycles.fold_nested(walk, ["allele"], units.limit(0)).first().text == " ".join(walk.first().walk)


def test_walk_file_of_the_worked_case(spark):
    walk = ["H1+", *["H3+", "V1-", "V3-", "H2-"] * 5, "H3+", "H4+"]
    w = spark.createDataFrame([("s", 1, walk, 1, 1, 1, 2, 2)], "sample string, map_no int, walk array<string>, solution int, group_id int, allele int, allele_cn int, depth int")
    u = spark.createDataFrame([("s", 1, "u", walk[1:5])], "sample string, map_no int, unit_id string, unit array<string>")
    lines = writers.walk_lines(w, cycles.fold_walks(w, ["sample", "map_no"], u), ["sample"])
    head = spark.createDataFrame([("s", 0, "@DOC\tSAMPLE_ID=s")], "sample string, ord int, line string")
    sol = spark.createDataFrame([("s", 1, "SOLUTION\tNO=1")], "sample string, allele_no int, line string")
    out = writers.walk_file(head, sol, lines, ["sample"]).orderBy("section", "allele_no", "map_no", "ord")
    assert [r.line for r in out.collect()] == [
        "@DOC\tSAMPLE_ID=s", "SOLUTION\tNO=1",
        "LOCALMAP\tNO=1;RANDPROB=0;SOLUTION_NO=1;GROUP=1;ALLELE_NO=1;ALLELE_CN=2;FVGMUSED=N/A;SEGSTRMD5=87350327d49d4af849548eaedaed32ff;SORTSEGSTRMD5=02363cc6bbacdbf94d2b09338c13d669;STRUDEPTH=2;",
        "STRUCTURE:\tH1+ (H3+ V1- V3- H2-)x5 H3+ H4+",
    ]


def test_junction_file_of_the_worked_case(spark, tmp_path):
    rows = ["#refseg_5p\tbkpos_5p\tstrd_5p\trefseg_3p\tbkpos_3p\tstrd_3p\tJR_count\tNormalCellCopyRatio"] + ["\t".join(str(x) for x in j[2:9]) + "\t0" for j in JUNCTIONS]
    (tmp_path / "j.txt").write_text("\n".join(rows) + "\n")
    got = readers.read_junctions(spark, str(tmp_path / "j.txt")).orderBy("junc_no").collect()
    assert [tuple(r) for r in got] == [j[1:] for j in JUNCTIONS]


def test_reachability_goes_on_to_the_end(spark):
    rows = [("a", i, 1, [f"H{i}+", f"H{i + 1}+"]) for i in range(24)]
    c = spark.createDataFrame(rows, "allele string, cycle_id int, cnt long, tokens array<string>")
    got = cycles.reachable_cycles(c, c.where("cycle_id = 0"), ["allele"])
    assert {r.cycle_id: r.hops for r in got.collect()} == {i: i for i in range(24)}


def test_single_cycle_alleles_need_no_motif(spark):
    w = spark.createDataFrame([("a", ["H1+", "H2+"]), ("b", ["H2-", "H1-"]), ("c", ["H3+"]), ("d", ["H3+"])], "allele string, walk array<string>")
    single = spark.createDataFrame([("d",)], "allele string")
    assert {r.allele for r in cycles.require_motifs(w, ["H1+,H2"], ["allele"], single).collect()} == {"a", "b", "d"}
    assert cycles.require_motifs(w, [], ["allele"]).count() == 4


def test_samples_that_share_segment_names(spark):
    """Depths, lengths and copy numbers stay with their sample."""
    seg = spark.createDataFrame([("a", "c", 1, "H1", 1, 10), ("b", "c", 1, "H1", 1, 20)], "sample string, refseg string, seg_no int, seg string, st long, ed long")
    win = spark.createDataFrame([("a", "c", 1, 10, 10.0), ("b", "c", 1, 10, 30.0)], "sample string, refseg string, st long, ed long, adj double")
    assert {r.sample: r.depth for r in segments.segment_cn(seg, win, F.lit(1.0)).collect()} == {"a": 10.0, "b": 30.0}
    c = spark.createDataFrame([("a", 1, ["H1+"]), ("b", 1, ["H1+"])], "sample string, cycle_id int, tokens array<string>")
    assert {r.sample: (r.n_tokens, r.length) for r in cycles.cycle_stats(c, seg, ["sample", "cycle_id"]).collect()} == {"a": (1, 10), "b": (1, 20)}


def test_two_digits_round_halves_away_from_zero(spark):
    rows = spark.createDataFrame([(1.0049999995,), (-0.125,), (0.125,), (0.0,)], "x double")
    assert [r.y for r in rows.select(segments.two_digits(F.col("x")).alias("y")).collect()] == [1.0, -0.13, 0.13, 0.0]
    mean = spark.createDataFrame([("a", 0.12), ("a", 0.13), ("b", -0.12), ("b", -0.13)], "k string, x double").groupBy("k").agg(segments.mean_two_digits("x").alias("m"))
    assert {r.k: r.m for r in mean.collect()} == {"a": 0.13, "b": -0.13}


def test_more_violations(spark):
    s = spark.createDataFrame([(None, "c", 1, 9, 1), ("H1", "c", 20, 29, 1)], "seg string, refseg string, st long, ed long, group_id int")
    j = spark.createDataFrame([("JUNC1", "H1", "H1")], "junc_id string, seg5 string, seg3 string")
    c = spark.createDataFrame([("U1",)], "cycle_id string")
    t = spark.createDataFrame([], "cycle_id string, seg string")
    more = {
        "pairs": spark.createDataFrame([("JUNC1", "x"), ("x", "JUNC1"), ("JUNC7", "y")], "anchor_a string, anchor_b string"),
        "counts": spark.createDataFrame([("s1", "U1"), ("s1", "U2")], "owner string, cycle_id string"),
        "baselines": spark.createDataFrame([("c", 1, 5), ("c", 20, 29)], "refseg string, st long, ed long"),
        "breakpoints": spark.createDataFrame([("c", 5), ("c", 25)], "refseg string, pos long"),
        "ratios": spark.createDataFrame([(10, 0.5), (11, 1.5)], "len long, ratio double"),
    }
    got = {(r.rule, r.key) for r in segments.violations(s, j, c, t, **more).collect()}
    assert got == {("names ran out", "c:1-9"), ("pair twice", "JUNC1;x"), ("unknown junction", "JUNC7"), ("unknown cycle", "U2"), ("baseline with breakpoint", "c:20-29"), ("ratio out of range", "11")}


def test_interval_join_over_lengths_far_apart(spark):
    rng = random.Random(7)
    make = lambda n: [("c", s := rng.randint(1, 10**6), s + rng.choice([0, 5, 900, 40_000, 3_000_000]), i) for i in range(n)]
    a, b = make(70), make(70)
    x, y = (spark.createDataFrame(r, f"refseg string, st long, ed long, {n} int") for r, n in ((a, "i"), (b, "j")))
    got = sorted((r.i, r.j) for r in intervals.interval_join(x, y, ["refseg"]).collect())
    assert got == sorted((p[3], q[3]) for p in a for q in b if p[1] <= q[2] and q[1] <= p[2])


def test_depth_on_runs_equals_depth_on_bases(spark):
    """Pieces, means in three ways, prior ratios and stable stretches against a base-by-base count."""
    rng = random.Random(5)
    runs, at = [], 1
    while at < 260:
        n = rng.randint(1, 30)
        if rng.random() < 0.8:
            runs.append(("s", "ctrl", "c", at, at + n - 1, rng.choice([1, 2, 2, 3, 9])))
        at += n
    df = spark.createDataFrame(runs, "sample string, tissue string, refseg string, st long, ed long, depth long")
    resol = spark.createDataFrame([("c", 1, 100, 30), ("c", 101, 250, 40)], "refseg string, st long, ed long, res long")
    bases = {p: d for *_, a, b, d in runs for p in range(a, b + 1)}
    window = lambda p: (p - 1) // 30 + 1 if p <= 100 else 4 + (p - 101) // 40 + 1
    held = {}
    for p, d in bases.items():
        if p <= 250:
            held.setdefault(window(p), []).append(d)
    pieces = depth.cut_windows(df, resol)
    for mode, t in (("plain", 0.0), ("trim", 0.2), ("trim", -0.2), ("sd3", 0.0)):
        want = {}
        for k, v in held.items():
            v, cut = sorted(v), int(len(v) * abs(t))
            if mode == "trim":
                v = v[cut if t > 0 else 0 : len(v) - cut]
            if mode == "sd3":
                m = sum(v) / len(v)
                s = (sum((x - m) ** 2 for x in v) / len(v)) ** 0.5
                v = [x for x in v if abs(x - m) <= 3 * s + 1e-9]
            want[k] = (round(sum(v) / len(v), 9), len(v))
        assert {r.win: (round(r.mean, 9), r.n) for r in depth.window_mean(pieces, ["win"], mode, t).collect()} == want
    prior = spark.createDataFrame([("c", 10, 60, 2.0), ("c", 61, 70, 0.5), ("c", 200, 999, 3.0)], "refseg string, st long, ed long, ratio double")
    ratio = lambda p: 2.0 if 10 <= p <= 60 else 0.5 if 61 <= p <= 70 else 3.0 if p >= 200 else 1.0
    got = {p: r.ratio for r in depth.prior_ratio(df, prior).collect() for p in range(r.st, r.ed + 1)}
    assert got == {p: ratio(p) for p in bases}
    stable = depth.stable_positions(df, prior, 2.0, 0.25)
    assert sorted(p for r in stable.collect() for p in range(r.st, r.ed + 1)) == sorted(p for p, d in bases.items() if 1.5 * ratio(p) <= d <= 2.5 * ratio(p))
    kept = depth.keep_stable(pieces.select("sample", "tissue", "refseg", "st", "ed", "win", "res"), stable, 35)
    want = {p for p in bases if p <= 100} | {p for p, d in bases.items() if 100 < p <= 250 and 1.5 * ratio(p) <= d <= 2.5 * ratio(p)}
    assert sorted(p for r in kept.collect() for p in range(r.st, r.ed + 1)) == sorted(want)


def test_smoothing_in_blocks(spark):
    rng = random.Random(2)
    rows = [("s", "case", "c", w, float(rng.randint(0, 50))) for w in range(1, 60) if rng.random() < 0.85]
    win = spark.createDataFrame(rows, "sample string, tissue string, refseg string, win long, adj double")
    breaks = spark.createDataFrame([("s", "c", 7), ("s", "c", 8), ("s", "c", 30), ("t", "c", 20)], "sample string, refseg string, win long")
    stretch = lambda w: sum(b <= w for b in (7, 8, 30))
    want = {}
    for *_, w, _v in rows:
        near = [v for *_, x, v in rows if abs(x - w) <= 3 and stretch(x) == stretch(w)]
        want[w] = round(sum(near) / len(near), 9)
    assert {r.win: round(r.show, 9) for r in depth.smooth(win, breaks, 3, block=8).collect()} == want


def test_shared_markers_in_slices(spark, monkeypatch):
    monkeypatch.setattr(links, "SLICE", 4)
    rng = random.Random(6)
    rows = [(f"a{i:02d}", "hot") for i in range(23)] + [(f"a{rng.randrange(23):02d}", f"m{rng.randrange(30)}") for _ in range(90)]
    held = {}
    for a, m in set(rows):
        held.setdefault(a, set()).add(m)
    want = {(a, b): len(held[a] & held[b]) for a in held for b in held if a < b and held[a] & held[b]}
    got = links.shared_marker_links(spark.createDataFrame(rows, "anchor string, marker string"))
    assert {(r.anchor_a, r.anchor_b): r.links for r in got.collect()} == want and got.count() == len(want)


def test_combinations_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE", 7)
    w = spark.createDataFrame([("s", 1, 1, a, m) for a in range(3) for m in range(4)], "sample string, group_id int, solution int, allele int, map_no int")
    got = {}
    for r in ranking.walk_combinations(w).collect():
        got.setdefault(r.combo, {})[r.allele] = r.map_no
    assert sorted(got) == list(range(64)) and len({tuple(sorted(v.items())) for v in got.values()}) == 64


def test_unreachable_and_missing_backbone_are_invalid(spark):
    seg = spark.createDataFrame([("H1", 1, 10), ("H2", 11, 20), ("V1", 1, 5), ("V2", 6, 9)], "seg string, st long, ed long")
    rows = [(1, 1, 1, ["H1+", "H2+"]), (1, 2, 1, ["V1+", "V2+"]), (2, 1, 1, ["V1+", "H1+"])]
    got = {r.allele: r.valid for r in assemble.assemble_walks(spark.createDataFrame(rows, "allele int, cycle_id int, cnt long, tokens array<string>"), seg, ["allele"], "H1", "H2").collect()}
    assert got == {1: False, 2: False}


def test_equivalence_key_is_invariant(spark):
    rng = random.Random(3)
    flip = {"+": "-", "-": "+"}
    rows = []
    for i in range(20):
        t = [rng.choice(["H1", "H2", "V1"]) + rng.choice("+-") for _ in range(rng.randint(1, 6))]
        k = rng.randrange(len(t))
        rc = [x[:-1] + flip[x[-1]] for x in reversed(t)]
        rows += [(i, t), (i, t[k:] + t[:k]), (i, rc[k:] + rc[:k])]
    got = spark.createDataFrame(rows, "i int, t array<string>").groupBy("i").agg(F.countDistinct(T.equivalence_key(F.col("t"))).alias("n"))
    assert {r.n for r in got.collect()} == {1}


def test_coverage_and_windows(spark):
    reads = spark.createDataFrame([("c", 5, 12, 20, 30), ("c", 8, 2003, 20, 30), ("c", 8, 9, 1, 30)], "refseg string, st long, ed long, mapq int, baseq int")
    runs = depth.coverage(reads, ["refseg"])
    assert [(r.st, r.ed, r.depth) for r in runs.orderBy("st").collect()][:2] == [(5, 7, 1), (8, 12, 2)]
    assert runs.agg(F.sum(F.expr("(ed - st + 1) * depth"))).first()[0] == 8 + 1996
    resol = spark.createDataFrame([("c", 1, 25, 10), ("c", 26, 100, 25)], "refseg string, st long, ed long, res long")
    points = spark.createDataFrame([("c", 25), ("c", 26), ("c", 100), ("c", 101)], "refseg string, pos long")
    got = {r.pos: (r.win, r.win_st, r.win_ed) for r in depth.assign_windows(points, resol).collect()}
    assert got == {25: (3, 21, 25), 26: (4, 26, 50), 100: (6, 76, 100)}
    assert depth.windows_of(resol).count() == 6


def test_interval_join_reports_each_pair_once(spark):
    rng = random.Random(1)
    a = [("c", s := rng.randint(1, 300), s + rng.randint(0, 80), i) for i in range(60)]
    b = [("c", s := rng.randint(1, 300), s + rng.randint(0, 80), i) for i in range(60)]
    x, y = (spark.createDataFrame(r, f"refseg string, st long, ed long, {n} int") for r, n in ((a, "i"), (b, "j")))
    got = sorted((r.i, r.j) for r in intervals.interval_join(x, y, ["refseg"], 16).collect())
    assert got == sorted((p[3], q[3]) for p in a for q in b if p[1] <= q[2] and q[1] <= p[2])
    plan = intervals.interval_join(x, y, ["refseg"], 16)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_constant_links_have_no_correlation(spark):
    rows = spark.createDataFrame([("k", 1.0, 2.0), ("k", 2.0, 2.0), ("m", 1.0, 3.0), ("m", 2.0, 5.0)], "key string, a double, b double")
    got = {r.key: r["corr"] for r in ranking.correlation(rows, ["key"]).collect()}
    assert got == {"k": None, "m": 1.0}


def test_two_alleles_two_walks(spark):
    w = spark.createDataFrame([("s", 1, 1, a, m) for a in (1, 2) for m in (1, 2)], "sample string, group_id int, solution int, allele int, map_no int")
    combos = ranking.walk_combinations(w)
    assert combos.count() == 8 and not combos.where("cut").count()
    assert ranking.walk_combinations(w, most=3).where("cut").select("combo").distinct().count() == 3
    al = w.selectExpr("*", "100 * map_no as length", "3 - allele as cn")
    got = ranking.combination_weights(combos, al).groupBy("combo").agg(F.round(F.sum("weight"), 6).alias("w"))
    assert {r.combo: r.w for r in got.collect()}[0] == 1.0


def test_distribution_lookups(spark):
    lens = spark.createDataFrame([("k", 10, 1), ("k", 20, 3)], "key string, len long, cnt long")
    cdf = distributions.ecdf(lens, ["key"])
    assert [r.prob for r in cdf.orderBy("len").collect()] == [0.25, 1.0]
    q = spark.createDataFrame([("k", 15), ("k", 16), ("k", 99), ("k", 1)], "key string, q long")
    assert {r.q: r.len for r in distributions.nearest_length(q, lens, ["key"], "cnt").collect()} == {15: 10, 16: 20, 99: 20, 1: 10}
    s = spark.createDataFrame([("k", 10, 20), ("x", 500, 600)], "key string, lo long, hi long")
    assert {r.key: r.mass for r in distributions.mass_between(s, cdf, ["key"]).collect()} == {"k": 0.75, "x": 2.0}


def test_shared_markers_with_a_frequent_marker(spark):
    rows = [(f"a{i}", "hot") for i in range(5)] + [("a0", "m1"), ("a1", "m1"), ("a9", "m2")]
    got = {(r.anchor_a, r.anchor_b): r.links for r in links.shared_marker_links(spark.createDataFrame(rows, "anchor string, marker string")).collect()}
    assert got[("a0", "a1")] == 2 and len(got) == 10
    asked = spark.createDataFrame([("a0", "a1"), ("a0", "a9")], "anchor_a string, anchor_b string")
    got = {(r.anchor_a, r.anchor_b): r.links for r in links.shared_marker_links(spark.createDataFrame(rows, "anchor string, marker string"), None, asked).collect()}
    assert got == {("a0", "a1"): 2, ("a0", "a9"): 0}


def test_tracks(spark):
    t = spark.createDataFrame([("c", "g", "201", 1, 5), ("c", "g", "300", 1, 9), ("c", "h", "777", 3, 4), ("c", "h", "555", 3, 4)], "refseg string, gene string, tid string, st long, ed long")
    assert {(r.gene, r.tid) for r in tracks.representative_transcript(t).collect()} == {("g", "201"), ("h", "555")}
    assert tracks.track_allowlist(t, []).count() == 4
    r = spark.createDataFrame([("c", "X:1-5,9-8,20-30")], "refseg string, spec string")
    assert [(x.st, x.ed) for x in tracks.user_regions(r).orderBy("st").collect()] == [(1, 5), (20, 30)]


def test_tagged_config(spark, tmp_path):
    lines = [
        "@DOC\tSAMPLE_ID=s;", "@HSEG\tID=H1;GROUP=1;INTERVAL=chr2:10-20;CN_ALT=1.97;CN_ALT_LP=2;LP_OFFSET%=1.52%;NOTES=SOURCE;", "@VSEG\tID=V2;INTERVAL=HPV16:5-9;CN_ALT=0.00;CN_ALT_LP=N/A;",
        "@JUNC\tID=JUNC4;SEGLINK=H1+,V2+;CN_ALT=9.33;CN_ALT_LP=10;", "@UCYC\tID=UCYC1;SEGSTR=H1+,V2+,H1+;", "SOLUTION\tNO=1;GROUP=1;SOLUTION_UCYC=UCYC1:2,UCYC2:10;ALLELE_NO=1;ALLELE_CN=2;ALLELE_UCYC=UCYC1:1;ALLELE_FVGM_UCYC=N/A;", "#no\tK=V",
    ]
    (tmp_path / "c.txt").write_text("\n".join(lines))
    c = readers.read_tagged_config(spark, str(tmp_path / "c.txt"))
    seg = {r.seg: r for r in readers.config_segments(c).collect()}
    assert seg["H1"].length == 11 and seg["H1"].lp_offset_pct == 1.52 and seg["V2"].cn_alt == 0.0 and seg["V2"].cn_alt_lp is None
    j = readers.config_junctions(c, readers.config_segments(c)).first()
    assert (j.link, j.link_rc, j.group_id) == ("H1+,V2+", "V2-,H1-", 1)
    assert readers.config_cycles(c).first().tokens == ["H1+", "V2+"]
    sol = readers.config_solutions(c)
    assert sol.first().allele_free is None
    assert {(r.id, r.cnt) for r in readers.explode_counts(sol, "solution_cycles", ["solution"]).collect()} == {("UCYC1", 2), ("UCYC2", 10)}


CN_TABLE = """##VERSION=v1.1
##_please_find_HEADER_in_online_demo_
SAMPLE	s
PLOIDY	2m0
SOURCE	H1
SINK	H4
FVGM	ID=FVGM1;SEGSTR=V1+,V2+,V3+
SEG	ID=H1;CN_ORIG=1.97;W=1;INTERVAL=chr2:141740000-141759732;PTDP=29.56
SEG	ID=H2;CN_ORIG=9.96;W=1;INTERVAL=chr2:141759733-141790204;PTDP=149.47
SEG	ID=H3;CN_ORIG=12.11;W=1;INTERVAL=chr2:141790205-141802259;PTDP=181.66
SEG	ID=H4;CN_ORIG=1.92;W=1;INTERVAL=chr2:141802260-141806500;PTDP=28.86
SEG	ID=V1;CN_ORIG=9.84;W=1;INTERVAL=HPV16:1-4648;RAWDP=147.54
SEG	ID=V2;CN_ORIG=0.01;W=1;INTERVAL=HPV16:4649-6531;RAWDP=0.12
SEG	ID=V3;CN_ORIG=9.78;W=1;INTERVAL=HPV16:6532-7906;RAWDP=146.65
JUNC	ID=JUNC1;SEGLINK=H1+,H3+;CN_ORIG=1.33;W=1;REFSEG_5P=chr2;BKPOS_5P=141759732;STRD_5P=+;REFSEG_3P=chr2;BKPOS_3P=141790205;STRD_3P=+;NCPR=0;RAWJRC=20;PTJRC=20
JUNC	ID=JUNC2;SEGLINK=H2-,H3+;CN_ORIG=9.27;W=1;REFSEG_5P=chr2;BKPOS_5P=141759733;STRD_5P=-;REFSEG_3P=chr2;BKPOS_3P=141790205;STRD_3P=+;NCPR=0;RAWJRC=139;PTJRC=139
JUNC	ID=JUNC3;SEGLINK=V1+,H3-;CN_ORIG=6.80;W=1;REFSEG_5P=HPV16;BKPOS_5P=4648;STRD_5P=+;REFSEG_3P=chr2;BKPOS_3P=141802259;STRD_3P=-;NCPR=0;RAWJRC=102;PTJRC=102
JUNC	ID=JUNC4;SEGLINK=H2+,V3+;CN_ORIG=9.33;W=1;REFSEG_5P=chr2;BKPOS_5P=141790204;STRD_5P=+;REFSEG_3P=HPV16;BKPOS_3P=6532;STRD_3P=+;NCPR=0;RAWJRC=140;PTJRC=140
""".splitlines()  # the form and values of the worked case, fixed


def test_copy_number_table_of_the_worked_case(spark, junctions, region, tmp_path):
    """From junctions and depths to the file that the solver reads, line by line."""
    ends = segments.breakends(junctions, region)
    host = segments.name_segments(segments.segment_by_breakends(region, ends))
    dp = spark.createDataFrame([(k, v[2]) for k, v in HOST.items()], "seg string, depth double")
    host = segments.feature_cn(host.join(dp, "seg"), ratio())
    virus = spark.createDataFrame([("s", "V1", 1, "HPV16", 1, 4648, 147.54), ("s", "V2", 2, "HPV16", 4649, 6531, 0.12), ("s", "V3", 3, "HPV16", 6532, 7906, 146.65)], "sample string, seg string, seg_no int, refseg string, st long, ed long, depth double")
    virus = segments.feature_cn(virus, ratio())
    both = host.select("sample", "refseg", "seg", "seg_no", "st", "ed").unionByName(virus.select("sample", "refseg", "seg", "seg_no", "st", "ed"))
    sides = segments.map_breakends_to_segments(segments.breakends(junctions), both).groupBy("sample", "junc_no")
    link = sides.agg(F.concat(F.max(F.when(F.col("side") == "5p", F.concat("seg", "strd"))), F.lit(","), F.max(F.when(F.col("side") == "3p", F.concat("seg", "strd")))).alias("link"))
    a = depth.admixture(F.lit(1.0), F.lit(2.0), F.lit(2.0))
    juncs = segments.junction_cn(junctions, ratio(), F.lit(30.0), a["n_ratio"]).join(link, ["sample", "junc_no"])
    facts = segments.source_sink(host).join(segments.feature_chain(virus).select("sample", "chain"), "sample").withColumn("ploidy", F.lit("2m0"))
    lines = writers.cn_lines(host, virus, juncs, facts)
    assert [r.line for r in lines.orderBy("section", "ord").collect()] == CN_TABLE
    writers.write_lines(lines, str(tmp_path / "o"), ["section", "ord"])
    assert [r.value for r in spark.read.text(str(tmp_path / "o" / "sample=s")).collect()] == CN_TABLE


def test_rank_report(spark):
    combos = spark.createDataFrame([("s", 1, 1, 0, 1, 2), ("s", 1, 1, 0, 2, 1)], "sample string, group_id int, solution int, combo long, allele int, map_no int")
    name = ranking.combination_names(combos)
    ranked = name.selectExpr("sample", "group_id", "solution", "name as combo", "1L as place", "0.5D as corr")
    ranked = ranked.unionByName(ranked.selectExpr("sample", "group_id", "solution", "'AL1.LM1,AL2.LM1' as combo", "2L as place", "cast(null as double) as corr"))
    pairs = spark.createDataFrame([("s", 1, 1, "AL1.LM2,AL2.LM1", p, f"a{p}", f"b{p}", 12, x) for p, x in (("p2", 3.0), ("p1", 0.73))], "sample string, group_id int, solution int, combo string, pair_id string, anchor_a string, anchor_b string, observed long, expected double")
    got = [r.line for r in writers.rank_lines(ranked, pairs).orderBy("place", "ord").collect()]
    names = "#anchor_a\tanchor_b\tuserLC\tsimuLC"
    assert got == ["#Group:1\tSolution:1\tAL1.LM2,AL2.LM1\tPearsonCorr=0.5", names, "ap1\tbp1\t12\t0.73", "ap2\tbp2\t12\t3", "#Group:1\tSolution:1\tAL1.LM1,AL2.LM1\tPearsonCorr=N/A", names]


def test_written_table_keeps_zero(spark, tmp_path):
    s = spark.createDataFrame([("s", "H1", 1, "c", 1, 9, 0.0, 0.0), ("s", "H2", 2, "c", 10, 12, None, None)], "sample string, seg string, seg_no int, refseg string, st long, ed long, depth double, cn double")
    j = spark.createDataFrame([], "sample string, junc_no long, link string, refseg_5p string, bkpos_5p long, strd_5p string, refseg_3p string, bkpos_3p long, strd_3p string, ncpr double, jr_count long, pure long, cn double")
    f = spark.createDataFrame([("s", None, "H1", "H1", None)], "sample string, ploidy string, source string, sink string, chain string")
    writers.write_lines(writers.cn_lines(s, s.limit(0), j, f), str(tmp_path / "o"), ["section", "ord"])
    got = [r.value for r in spark.read.text(str(tmp_path / "o" / "sample=s")).collect()]
    assert got[3] == "PLOIDY\t_please_fix_me_" and got[6] == "FVGM\tID=FVGM1;SEGSTR=_please_fix_me_"
    assert got[7].startswith("SEG\tID=H1;CN_ORIG=0.00;") and got[8] == "SEG\tID=H2;CN_ORIG=N/A;W=1;INTERVAL=c:10-12;PTDP=N/A"


def test_key_of_a_long_cycle(spark):
    """A hundred thousand tokens, of which most rotations begin alike."""
    n = 100_000
    rows = spark.range(1).selectExpr(f"transform(sequence(1, {n}), i -> if(i = 70000, 'H0+', if(i % 1000 = 0, 'H2+', 'H1+'))) as t")
    turned = rows.select(F.explode(F.array("t", T.rotate(F.col("t"), F.lit(31_415)), T.reverse_complement(F.col("t")))).alias("t"))
    keys = turned.select(T.equivalence_key(F.col("t")).alias("k")).distinct().collect()
    assert len(keys) == 1 and len(keys[0].k) == n and keys[0].k[0] == "H0+"
    odd = spark.createDataFrame([(["H1+"],), (["H1+", "H1+", "H1+"],), (["H2-", "H1+", "H2-", "H1+"],), ([],)], "t array<string>")
    assert [r.k for r in odd.select(T.equivalence_key(F.col("t")).alias("k")).collect()] == [["H1+"], ["H1+"] * 3, ["H1+", "H2-"] * 2, []]


def test_junction_accounting_of_the_worked_case(spark):
    """What the two cycles make of the four junctions; each holds on either strand."""
    c = spark.createDataFrame([("s", 1, 2, ["H1+", "H3+", "H4+"]), ("s", 2, 10, ["H3+", "V1-", "V3-", "H2-"])], "sample string, cycle_id int, cnt long, tokens array<string>")
    j = spark.createDataFrame([("s", "H1+,H3+", 1.33), ("s", "H2-,H3+", 9.27), ("s", "V1+,H3-", 6.80), ("s", "H2+,V3+", 9.33), ("s", "H9+,H8+", 1.0), ("t", "H1+,H3+", 5.0)], "sample string, link string, cn double")
    got = {r.link: (r.expected, round(r.residual, 4)) for r in cycles.junction_accounting(c, j, ["sample"]).collect()}
    assert got == {"H1+,H3+": (2, 0.5038), "H2-,H3+": (10, 0.0787), "V1+,H3-": (10, 0.4706), "H2+,V3+": (10, 0.0718), "H9+,H8+": (0, -1.0)}
    one = cycles.junction_accounting(c.drop("sample"), j.where("sample = 's'").drop("sample"), ["cycle_id"])
    assert {(r.cycle_id, r.link): r.expected for r in one.collect()} == {(1, "H1+,H3+"): 2, (2, "H2-,H3+"): 10, (2, "V1+,H3-"): 10, (2, "H2+,V3+"): 10}
    alone = spark.createDataFrame([("s", 1, 3, ["H1+"]), ("s", 2, 1, [])], "sample string, cycle_id int, cnt long, tokens array<string>")
    loop = spark.createDataFrame([("s", "H1-,H1-", 3.0)], "sample string, link string, cn double")
    assert [(r.link, r.expected) for r in cycles.junction_accounting(alone, loop, ["sample"]).collect()] == [("H1-,H1-", 3)]


def test_anchors_of_samples_that_share_all_names(spark):
    anchors = spark.createDataFrame([(s, a, "c", p) for s in ("s1", "s2") for a, p in (("H1,c:5", 5), ("H1,c:9", 9), ("H2,c:50", 50))], "sample string, anchor string, refseg string, pos long")
    reads = spark.createDataFrame([("s1", "c", 1, 60, 7), ("s1", "c", 4, 6, 8), ("s2", "c", 1, 6, 7), ("s2", "c", 45, 60, 8)], "sample string, refseg string, st long, ed long, molecule long")
    lists = spark.createDataFrame([("s1", "JUNC1", "7"), ("s1", "JUNC2", "7"), ("s2", "JUNC1", "8")], "sample string, anchor string, marker string")
    m = links.anchor_markers(anchors, reads, lists)
    held = {}
    for r in m.collect():
        held.setdefault((r.sample, r.anchor), set()).add(r.marker)
    assert held == {
        ("s1", "H1,c:5"): {"7", "8"}, ("s1", "H1,c:9"): {"7"}, ("s1", "H2,c:50"): {"7"}, ("s1", "JUNC1"): {"7"}, ("s1", "JUNC2"): {"7"},
        ("s2", "H1,c:5"): {"7"}, ("s2", "H2,c:50"): {"8"}, ("s2", "JUNC1"): {"8"},
    }
    seg = anchors.select("sample", "anchor", F.substring("anchor", 1, 2).alias("seg"))
    got = {(r.sample, r.anchor_a, r.anchor_b): r.links for r in links.shared_marker_links(m, seg).collect()}
    assert got == {
        ("s1", "H1,c:5", "H2,c:50"): 1, ("s1", "H1,c:9", "H2,c:50"): 1, **{("s1", a, j): 1 for a in ("H1,c:5", "H1,c:9", "H2,c:50") for j in ("JUNC1", "JUNC2")}, ("s1", "JUNC1", "JUNC2"): 1,
        ("s2", "H2,c:50", "JUNC1"): 1,
    }
    wide = {(r.sample, r.anchor): r.JUNC1 for r in links.pair_matrix(links.shared_marker_links(m, seg), ["JUNC1"]).collect()}
    assert wide[("s2", "H2,c:50")] == 1 and wide[("s1", "JUNC2")] == 1 and ("s2", "H1,c:5") not in wide


def test_violations_of_samples_that_share_names(spark):
    s = spark.createDataFrame([("s1", "H1", "c", 1, 100, 1), ("s2", "H1", "c", 1, 40, 1), ("s2", "H2", "c", 50, 100, 2)], "sample string, seg string, refseg string, st long, ed long, group_id int")
    j = spark.createDataFrame([("s1", "JUNC1", "H1", "H2"), ("s2", "JUNC1", "H1", "H2")], "sample string, junc_id string, seg5 string, seg3 string")
    c = spark.createDataFrame([("s1", "U1"), ("s2", "U1")], "sample string, cycle_id string")
    t = spark.createDataFrame([("s1", "U1", "H2"), ("s2", "U1", "H2")], "sample string, cycle_id string, seg string")
    more = {
        "pairs": spark.createDataFrame([("s1", "JUNC1", "x"), ("s2", "JUNC1", "x")], "sample string, anchor_a string, anchor_b string"),
        "counts": spark.createDataFrame([("s1", "o", "U1"), ("s3", "o", "U1")], "sample string, owner string, cycle_id string"),
        "baselines": spark.createDataFrame([("s1", "c", 1, 9)], "sample string, refseg string, st long, ed long"),
        "breakpoints": spark.createDataFrame([("s2", "c", 5)], "sample string, refseg string, pos long"),
    }
    got = {(r.sample, r.rule, r.key) for r in segments.violations(s, j, c, t, **more).collect()}
    assert got == {("s1", "unknown segment", "U1"), ("s1", "junction without segment", "JUNC1"), ("s2", "group mismatch", "JUNC1"), ("s3", "unknown cycle", "U1")}


def test_baselines_of_samples_without_control(spark):
    w = spark.createDataFrame([("a", "case", "c", 1, 10, 20.0), ("b", "case", "c", 1, 10, 20.0), ("b", "ctrl", "c", 1, 10, 40.0), ("d", "case", "c", 500, 510, 9.0)], "sample string, tissue string, refseg string, st long, ed long, adj double")
    base = spark.createDataFrame([(s, "c", 1, 10, 2.0, None) for s in "abd"] + [("b", "c", 2, 9, None, "case")], "sample string, refseg string, st long, ed long, cn double, tissue string")
    none = spark.createDataFrame([], "sample string, refseg string, pos long")
    got = sorted(((r.sample, r.depth, r.ratio) for r in depth.baseline_cn_ratio(w, base, none).collect()), key=str)
    assert got == [("a", 20.0, 0.1), ("b", 20.0, 0.1), ("b", 40.0, 0.05), ("d", None, None)]


def test_correlation_at_any_scale(spark):
    rows = spark.createDataFrame([("tiny", i * 1e-7, 3 * i * 1e-7) for i in range(10)] + [("flat", 1e9, float(i)) for i in range(9)] + [("far", 1e12 + i, -i * 1e-3) for i in range(5)], "key string, a double, b double")
    for method in ("pearson", "spearman"):
        assert {r.key: r["corr"] for r in ranking.correlation(rows, ["key"], method=method).collect()} == {"tiny": 1.0, "flat": None, "far": -1.0}


def test_one_key_runs_in_many_parts(spark):
    """Running sums, carried values and ranks of one key that has all rows, and of null keys, against plain loops."""
    rng = random.Random(11)
    rows = [("k", v, rng.randrange(1, 9)) for v in rng.sample(range(100_000), 3000)] + [(None, 5, 2), (None, 1, 3)]
    df = spark.createDataFrame(rows, "key string, len long, cnt long")
    got = {(r.key, r.len): (r._upto, r._total) for r in scans.running_total(df, ["key"], "len", "cnt", 16).collect()}
    for key in ("k", None):
        mine, run = sorted(r[1:] for r in rows if r[0] == key), 0
        for v, c in mine:
            run += c
            assert got.pop((key, v)) == (run, sum(x[1] for x in mine))
    assert not got
    parts = scans.in_parts(df, ["key"], "len", 16).where("key = 'k'").groupBy("_part").count().collect()
    assert len(parts) >= 14 and max(r["count"] for r in parts) < 600
    asked = [rng.randrange(-10, 100_100) for _ in range(500)]
    q = spark.createDataFrame([("k", x) for x in asked] + [("x", 1)], "key string, q long")
    near = {(r.key, r.q): (r.len, r.cnt) for r in intervals.nearest_key(q, df, ["key"], "len", "cnt").collect()}
    held = {v: c for k, v, c in rows if k == "k"}
    for x in asked:
        best = min(held, key=lambda v: (abs(v - x), v))
        assert near[("k", x)] == (best, held[best])
    assert near[("x", 1)] == (None, None)
    pairs = [("k", float(rng.randrange(40)), float(rng.randrange(40))) for _ in range(900)]
    ranks = lambda xs: [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]
    a, b = ranks([p[1] for p in pairs]), ranks([p[2] for p in pairs])
    mean = (len(a) + 1) / 2
    want = sum((x - mean) * (y - mean) for x, y in zip(a, b)) / (sum((x - mean) ** 2 for x in a) * sum((y - mean) ** 2 for y in b)) ** 0.5
    assert round(want, 8) == round(ranking.correlation(spark.createDataFrame(pairs, "key string, a double, b double"), ["key"], method="spearman").first()["corr"], 8)


def test_best_combinations(spark):
    rows = spark.createDataFrame([("k", i, None if i % 7 == 0 else float(i % 5)) for i in range(50)], "key string, combo int, corr double")
    all_ = sorted((r.place, r.combo) for r in ranking.rank_combinations(rows, ["key"]).collect())
    assert sorted((r.place, r.combo) for r in ranking.rank_combinations(rows, ["key"], best=6).collect()) == all_[:6]


def test_joins_at_a_hot_locus(spark, monkeypatch):
    """Half of all reads at one place, and intervals of all lengths: the same rows whether a side is broadcast, bins are whole, or cut in slices."""
    rng = random.Random(4)
    reads = [(i, "c", 5_000, 5_010 + i % 30) for i in range(300)] + [(i, "c", p, p + rng.choice([3, 900, 40_000, 5_000_000])) for i in range(300, 600) for p in [rng.randrange(3_000_000)]] + [(9999, None, 1, 9), (9998, "c", None, 9)]
    segs = [(i, "c", p, p + rng.choice([0, 50, 2_000, 70_000, 300_000_000_000])) for i in range(200) for p in [rng.choice([4_990, 5_005, rng.randrange(3_000_000)])]]
    a = spark.createDataFrame(reads, "a int, refseg string, st long, ed long")
    b = spark.createDataFrame(segs, "b int, refseg string, st long, ed long")
    want = sorted((x[0], y[0]) for x in reads for y in segs if x[1] == "c" and x[2] is not None and x[2] <= y[3] and y[2] <= x[3])
    points = a.where("st is not null").selectExpr("a", "refseg", "st as pos")
    inside = sorted((x[0], y[0]) for x in reads for y in segs if x[1] == "c" and x[2] is not None and y[2] <= x[2] <= y[3])
    for few, hot in ((10_000, 10**9), (0, 10**9), (0, 20), (250, 20)):
        monkeypatch.setattr(intervals, "FEW_ROWS", few)
        monkeypatch.setattr(intervals, "HOT_ROWS", hot)
        assert sorted((r.a, r.b) for r in intervals.interval_join(a, b, ["refseg"]).collect()) == want
        assert sorted((r.a, r.b) for r in intervals.point_join(points, b, ["refseg"]).collect()) == inside
    left = intervals.point_join(points, b.where("st > 4000000"), ["refseg"], how="left")
    assert sorted(r.a for r in left.where("b is null").collect()) == sorted(x[0] for x in reads if x[2] is not None)
    x, y = (intervals._binned(d, "st", "ed", 1000, [0, 1, 2, 3, 6], [0, 1, 2, 3, 6], m) for d, m in ((a, "_x"), (b.toDF("b", "refseg", "st", "ed"), "_y")))
    cells = intervals._sliced(x, y, ["refseg"], 20)[0].groupBy("refseg", "_k", "_b", "_s").count().where("_k = 0").agg(F.max("count")).first()[0]
    assert cells <= 200  # of the 300 reads in one bin, with as many copies as the other side has slices


def test_lines_are_numbered_in_any_splits(spark, tmp_path):
    for name, n in (("a", 400), ("b", 3)):
        rows = "".join(f"c\t{i}\t+\td\t{i + 7}\t-\t{i % 9}\n" + ("# note\n\n" if i % 5 == 0 else "") for i in range(1, n + 1))
        (tmp_path / f"{name}.txt").write_text("# head\n" + rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = readers.read_junctions(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        assert sorted((r.junc_no, r.bkpos_5p) for r in got.collect()) == sorted([(i, i) for i in range(1, 401)] + [(i, i) for i in range(1, 4)])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_tracks_read_only_files_of_the_region(spark, tmp_path):
    rows = spark.range(4000).selectExpr("concat('HLA*0', id % 2, ':01') as refseg", "id % 7 as gene", "'t' as tid", "id * 10 as st", "id * 10 + 25 as ed")
    writers.write_track(rows, str(tmp_path / "t"), 16)
    region = spark.createDataFrame([("HLA*01:01", 20_000, 20_100)], "refseg string, st long, ed long")
    got = readers.read_track(spark, str(tmp_path / "t"), region)
    want = rows.where("refseg = 'HLA*01:01' and st <= 20100 and ed >= 20000")
    assert sorted(map(str, got.select(*rows.columns).collect())) == sorted(map(str, want.collect())) and want.count() > 3
    assert len(got.inputFiles()) <= 2 < len(spark.read.parquet(str(tmp_path / "t")).inputFiles())
    none = region.withColumn("st", F.lit(10**9)).withColumn("ed", F.lit(10**9 + 1))
    assert readers.read_track(spark, str(tmp_path / "t"), none).count() == 0


def test_many_ranges_on_one_reference(spark):
    n = 20_000
    ranges = spark.range(n).selectExpr("'c' as refseg", "id * 10 + 3 as st", "id * 10 + 7 as ed", "cast(id % 5 as double) / 2 as ratio")
    runs = spark.createDataFrame([("s", "ctrl", "c", 0, 10 * n - 1, 4.0), ("s", "ctrl", "d", 5, 9, 1.0)], "sample string, tissue string, refseg string, st long, ed long, depth double")
    got = depth.prior_ratio(runs, ranges).groupBy("refseg", "ratio").agg(F.sum(F.expr("ed - st + 1")).alias("n"))
    want = {("c", k / 2): n for k in (0, 1, 3, 4)} | {("c", 1.0): n + 5 * n, ("d", 1.0): 5}
    assert {(r.refseg, r.ratio): r.n for r in got.collect()} == want


def test_best_combinations_equal_all(monkeypatch):
    """Blocks of halves against a plain product, with and without pairs that some walks lack."""
    rng = np.random.default_rng(1)
    for trial in range(40):
        pairs, alleles = int(rng.integers(1, 7)), []
        for _ in range(int(rng.integers(1, 5))):
            n = int(rng.integers(1, 7))
            has = np.ones((n, pairs)) if trial % 2 else (rng.random((n, pairs)) < 0.7).astype(float)
            alleles.append((np.round(rng.random((n, pairs)) * 9, 2) * has, has))
        y, want = np.round(rng.random(pairs) * 9), []
        strides = np.cumprod([1] + [len(x) for x, _ in alleles])
        for digits in itertools.product(*[range(len(x)) for x, _ in alleles]):
            held = np.max([h[i] for (_, h), i in zip(alleles, digits)], axis=0) > 0
            x, seen = np.round(sum(a[i] for (a, _), i in zip(alleles, digits)), 2)[held], y[held]
            flat = len(x) == 0 or x.min() == x.max() or seen.min() == seen.max()
            want.append((best.UNDEFINED if flat else round(float(np.corrcoef(x, seen)[0, 1]), 9), int(sum(i * s for i, s in zip(digits, strides)))))
        want.sort(key=lambda t: (-t[0], t[1]))
        for block in (4, 1024):
            monkeypatch.setattr(best, "BLOCK", block)
            assert [n for _, n in best.best_of(alleles, y, 5)] == [n for _, n in want[:5]]
            met = sorted(sum((best.best_of(alleles, y, 5, p, 3) for p in range(3)), []), key=lambda t: (-t[0], t[1]))
            assert [n for _, n in met[:5]] == [n for _, n in want[:5]]


def test_best_of_a_thousand_million_combinations(spark):
    """Nine alleles of ten walks; what was observed is one combination's sum, so that is the best."""
    rng = random.Random(2)
    a = spark.createDataFrame([("s", 1, 1, x, m, 100, 1) for x in range(9) for m in range(10)], "sample string, group_id int, solution int, allele int, map_no int, length int, cn int")
    links_ = [("s", 1, 1, x, m, f"p{i}", round(rng.random() * 450)) for x in range(9) for m in range(10) for i in range(20)]
    seen = [("s", 1, 1, f"p{i}", sum(v for *_, x, m, p, v in links_ if p == f"p{i}" and m == (x * 7) % 10)) for i in range(20)]
    got = best.best_combinations(a, spark.createDataFrame(links_, "sample string, group_id int, solution int, allele int, map_no int, pair_id string, links long"), spark.createDataFrame(seen, "sample string, group_id int, solution int, pair_id string, observed long"))
    got = got.orderBy("place").collect()
    assert len(got) == 10 and got[0].name == ",".join(f"AL{x}.LM{(x * 7) % 10}" for x in range(9)) and got[0]["corr"] > 0.999 > got[1]["corr"] >= got[9]["corr"]


def test_crowded_sides_are_not_broadcast_by_the_size_of_their_files(spark, monkeypatch):
    """Few rows in the file, many after exploding: what was counted decides, not the estimate."""
    monkeypatch.setattr(intervals, "FEW_ROWS", 100)
    a = storage.stored(spark.range(300), "few").selectExpr("explode(sequence(0, 4)) as i", "id").selectExpr("'S' as refseg", "id * 5 + i as pos")
    b = storage.stored(spark.range(200).selectExpr("'S' as refseg", "id * 3 as st", "id * 3 + 1 as ed"), "spans")
    hit = intervals.point_join(a, b, ["refseg"])
    assert "Broadcast" not in hit._jdf.queryExecution().executedPlan().toString()
    assert hit.count() == 2 * 200


def test_walk_tables_are_not_broadcast_by_the_size_of_their_files(spark):
    """A column of one value takes a few bytes of a file; the static estimate broadcasts it, measured broadcasts wait for the rows."""
    one = storage.stored(spark.range(50_000).selectExpr("id", "repeat('H1+', 50) as t"), "one")
    plan = lambda: one.join(one.withColumnRenamed("t", "u"), "id")._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan()
    seen, write = [], storage.written
    with pytest.MonkeyPatch.context() as m:
        m.setattr(storage, "written", lambda df, name: seen.append(plan()) or write(df, name))
        assert storage.stored_by_size(one, "two").count() == 50_000
        storage.Log(one, "log").add(one)
    assert len(seen) == 3 and not any("BroadcastHashJoin" in p for p in seen)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None


def test_combination_links_need_no_shuffle_of_combinations(spark):
    """As the plain steps give; what is unfolded is added up where it lies, also over several ranges of numbers."""
    rng = random.Random(5)
    sol = "sample string, group_id int, solution int, allele int, map_no int"
    rows = [("s", 1, x, a, m) for x in range(3) for a in range(3) for m in range(rng.randint(1, 4))]
    alleles = spark.createDataFrame([(*r, rng.randint(50, 90), 1 + r[3]) for r in rows], sol + ", length int, cn int")
    links_ = spark.createDataFrame([(*r, f"p{i}", rng.random() * 9) for r in rows for i in range(3) if r[4] != 1 or i], sol + ", pair_id string, links double")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ranking, "RANGE", 4)
        got = ranking.combination_links(alleles, links_)
        plain = ranking.expected_links(ranking.combination_weights(ranking.walk_combinations(alleles.select("sample", "group_id", "solution", "allele", "map_no")), alleles), links_)
        assert sorted(got.drop("block").collect()) == sorted(plain.collect())
        assert got.where("block > 0").count()
    plan = ranking.correlation(got.withColumn("y", F.lit(1.0)), ["sample", "group_id", "solution", "block", "combo"], "expected", "y")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("combo")] and plan.index("explode(sequence") < plan.index("Exchange")


def test_coverage_shuffles_positions_to_bins_once(spark):
    """A bin's depth at its start comes as a row of its own: positions are not joined with their bins, and runs across bins stay whole."""
    reads = [("a", 1, 30, 9, 60), ("a", 31, 64, 9, 60), ("a", 40, 40, 9, 60), ("a", 100, 399, 9, 60), ("b", 15, 16, 9, 60)]
    df = spark.createDataFrame(reads, "refseg string, st long, ed long, baseq int, mapq int")
    runs = depth.coverage(df, ["refseg"], bin_size=16)
    assert sorted(map(tuple, runs.select("refseg", "st", "ed", "depth").collect())) == [("a", 1, 39, 1), ("a", 40, 40, 2), ("a", 41, 64, 1), ("a", 100, 399, 1), ("b", 15, 16, 1)]
    assert "Join" not in runs._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("mode", ["plain", "trim", "sd3"])
def test_window_means_shuffle_pieces_once(spark, mode):
    pieces = spark.createDataFrame([(1, 1, 9, 2.0), (1, 10, 10, 99.0), (2, 11, 14, 3.0), (1, 5, 5, 2.0)], "win int, st long, ed long, depth double").repartition(2)
    means = depth.window_mean(pieces, ["win"], mode, 0.1)
    assert means._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.win: r.n for r in means.collect()} == {1: {"plain": 11, "trim": 9, "sd3": 10}[mode], 2: 4}


def test_bins_are_counted_only_where_they_may_be_crowded(spark, monkeypatch):
    """Rows that lie apart are joined without slices; a hot place still gives them."""
    monkeypatch.setattr(intervals, "FEW_ROWS", 0)
    monkeypatch.setattr(intervals, "HOT_ROWS", 100)
    called, sliced = [], intervals._sliced
    monkeypatch.setattr(intervals, "_sliced", lambda *x: called.append(1) or sliced(*x))
    apart = spark.range(300).selectExpr("id as a", "'c' as refseg", "id * 5000 as st", "id * 5000 + 40 as ed")
    other = spark.range(300).selectExpr("id as b", "'c' as refseg", "id * 5000 + 20 as st", "id * 5000 + 60 as ed")
    assert intervals.interval_join(apart, other, ["refseg"]).count() == 300 and not called
    crowd = spark.range(300).selectExpr("id as b", "'c' as refseg", "990L as st", "1010L as ed")
    assert intervals.interval_join(crowd, apart.union(spark.sql("select 1L, 'c', 1000L, 1001L")), ["refseg"]).count() == 300 and called


def test_best_combinations_come_in_the_batches_of_their_solutions(spark, monkeypatch):
    """Solutions of a batch leave as one batch, not one each."""
    import pyarrow as pa

    kind = type(spark.range(1))
    seen, plain = [], kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema: seen.append((self, f)) or plain(self, f, schema))
    alleles = spark.range(6).selectExpr("'s' as sample", "1 as group_id", "id div 2 as solution", "0L as allele", "id % 2 as map_no", "10L as length", "1L as cn")
    links_ = alleles.selectExpr("sample", "group_id", "solution", "allele", "map_no", "explode(array('p', 'q')) as pair_id", "cast(map_no + 1 as double) as links")
    observed = spark.range(3).selectExpr("'s' as sample", "1 as group_id", "id as solution", "explode(array('p', 'q')) as pair_id").selectExpr("*", "if(pair_id = 'p', 1D, 2D) as observed")
    assert best.best_combinations(alleles, links_, observed, 2).count() == 6
    rows, search = seen[0]
    batches = list(search(pa.Table.from_batches(rows.toArrow().combine_chunks().to_batches()).to_batches()))
    assert [b.num_rows for b in batches] == [6]


def test_best_combinations_score_the_solutions_of_a_batch_together(spark, monkeypatch):
    """Small solutions never come to the search one by one, and meet what they need in one shuffle without joins; both ways give what ranking all combinations gives."""
    kind = type(spark.range(1))
    seen, plain = [], kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema: seen.append((self, f)) or plain(self, f, schema))
    rng = random.Random(5)
    alleles, links_, observed = [], [], []
    for s in range(60):
        pairs = [f"p{i}" for i in range(rng.randint(1, 6))]
        observed += [("s", s % 3, s, p, float(rng.randint(0, 9))) for p in pairs if rng.random() < 0.9] + [("s", s % 3, s, "alone", 5.0), ("s", s % 3, s, "none", None)]
        for a in rng.sample(range(9), rng.randint(1, 4)):
            for m in rng.sample(range(20), rng.randint(1, 4)):
                alleles.append(("s", s % 3, s, a, m, rng.randint(1, 8) * 100, rng.randint(1, 2)))
                links_ += [("s", s % 3, s, a, m, p, rng.randint(0, 300) / 8) for p in [*pairs, "other"] if s % 2 or rng.random() < 0.7]
        links_ += [("s", s % 3, s, 77, 1, pairs[0], 50.0), ("s", s % 3, s, None, 1, pairs[0], 50.0)]
    alleles = spark.createDataFrame(alleles, "sample string, group_id int, solution int, allele int, map_no int, length int, cn int")
    links_ = spark.createDataFrame(links_, "sample string, group_id int, solution int, allele int, map_no int, pair_id string, links double")
    observed = spark.createDataFrame(observed, "sample string, group_id int, solution int, pair_id string, observed double")
    keys = ["sample", "group_id", "solution"]
    both = ranking.combination_links(alleles, links_).join(observed.dropna(), [*keys, "pair_id"])
    scored = ranking.correlation(both, [*keys, "combo"], "expected", "observed").where("corr is not null")
    names = ranking.combination_names(ranking.walk_combinations(alleles))
    top = ranking.rank_combinations(scored, keys, best=4).join(names, [*keys, "combo"])
    want = sorted((r.solution, r.combo, r["corr"], r.name) for r in top.collect())
    got = best.best_combinations(alleles, links_, observed, 4)
    assert sorted((r.solution, r.combo, r["corr"], r.name) for r in got.where("corr is not null").collect()) == want and len(want) > 100
    rows, search = seen[0]
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    batches = rows.toArrow().combine_chunks().to_batches()
    first = lambda found: sorted((r["solution"], r["combo"], r["corr"], r["name"]) for b in found for r in b.to_pylist() if r["corr"] is not None)
    alone, one = [], best.best_of
    monkeypatch.setattr(best, "best_of", lambda *a: alone.append(a) or one(*a))
    assert first(search(iter(batches))) == want and not alone
    monkeypatch.setattr(best, "FEW", 0)
    assert first(search(iter(batches))) == want and len(alone) == 60


def test_parts_are_rounded_as_spark_rounds(spark):
    """Halves by the printed decimal, away from zero."""
    rng = random.Random(6)
    values = [0.0, -0.0, 0.125, -0.125, 1.005, 2.675, 0.285, 1.115, 0.005, 0.0049999999999999, 1e-9, 4503599627370495.5, 9007199254740993.0, 1e300, 1.7e308, float("inf"), -1e17, 1e15 + 0.125, 1e15 - 0.125, 99999999999999.985, 123456789012.345, 0.615, 0.145]
    values += [round(rng.randint(0, 10**6) / 1000 + 0.005, 3) for _ in range(3000)] + [rng.random() * 10 ** rng.randint(-3, 12) for _ in range(3000)] + [rng.randint(0, 4000) / 16 * rng.choice((1, -1)) for _ in range(2000)]
    want = [r.r for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").selectExpr("i", "round(v, 2) as r").orderBy("i").collect()]
    assert best._hundredths(np.array(values)).tolist() == want

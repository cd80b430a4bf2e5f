"""Readers of the text formats; each gives a typed DataFrame. Compressed files are read like plain ones (gzip cannot be split)."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixloom.functions.tokens import flip, parse_cycle, segment_of, strand_of
from helixloom.operators.intervals import interval_join
from helixloom.sources.writers import TRACK_INDEX

JUNCTIONS = "refseg_5p string, bkpos_5p long, strd_5p string, refseg_3p string, bkpos_3p long, strd_3p string, jr_count long, ncpr double"


def read_depth(spark: SparkSession, path: str, refseg: str | None = None) -> DataFrame:
    """refseg, pos, depth from white-space rows ``refseg pos d1 [d2 ..]``: depth is the sum of the rest of the row."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')").select(f.alias("f"))
    total = F.aggregate(F.slice("f", F.lit(3), F.greatest(F.size("f") - 2, F.lit(0))), F.lit(0.0), lambda a, x: a + F.coalesce(x.try_cast("double"), F.lit(0.0)))
    rows = rows.select(F.get("f", 0).alias("refseg"), F.get("f", 1).try_cast("long").alias("pos"), total.alias("depth"))
    return rows if refseg is None else rows.where(F.col("refseg") == refseg)


def numbered_lines(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """file, no (from 1), line: the lines of each file that are neither blank nor comments, counted in their order. A file may be read in any number of splits: lines count
    within their split, and what earlier splits of the file hold is added, one number a split."""
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select(*meta, F.col("value").alias("line")).where((F.trim("line") != "") & ~F.startswith("line", F.lit(comment)))
    lines = lines.withColumn("at", F.monotonically_increasing_id())  # rises with the place in a split
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return lines.withColumn("own", own).join(before, ["file", "block"]).select("file", (F.col("before") + F.col("own")).cast("long").alias("no"), "line")


def read_junctions(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """Tab-separated junctions, 8 columns; # begins a comment; a missing normal copy ratio is 0. numbered: a number stands before them as a column of its own. Else junc_no
    counts the lines of a file that are no comments, in their order, however the file is split.
    """
    if numbered:
        rows = spark.read.csv(path, sep="\t", comment="#", schema="junc_no long, " + JUNCTIONS)
    else:
        read = F.from_csv("line", F.lit(JUNCTIONS.replace("long", "bigint")), {"sep": "\t"})
        rows = numbered_lines(spark, path).select(F.col("no").alias("junc_no"), read.alias("r")).select("junc_no", "r.*")
    return rows.withColumn("ncpr", F.coalesce("ncpr", F.lit(0.0)))


def read_feature_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema="seg string, refseg string, st long, ed long, depth double")


def read_resolution(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema="refseg string, st long, ed long, res long")


def read_tagged_config(spark: SparkSession, path: str) -> DataFrame:
    """file, tag, fields (map) from lines ``TAG<tab>K=V;K=V``; tags keep no leading @; comments go."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where("not startswith(value, '#') and instr(value, '\t') > 0")
    part = F.split("value", "\t", 2)
    return lines.select("file", F.regexp_replace(F.get(part, 0), "^@", "").alias("tag"), F.str_to_map(F.regexp_replace(F.get(part, 1), r"[;\s]+$", ""), F.lit(";"), F.lit("=")).alias("fields"))


def _text(name: str):
    return F.nullif(F.try_element_at("fields", F.lit(name)), F.lit("N/A"))


def config_documents(config: DataFrame) -> DataFrame:
    """file, sample_id: NULL (the word) where it is absent."""
    return config.where("tag = 'DOC'").select("file", F.coalesce(_text("SAMPLE_ID"), F.lit("NULL")).alias("sample_id"))


def config_segments(config: DataFrame) -> DataFrame:
    """seg, spec, no, group_id, refseg, st, ed, length, cn_*, lp_*, note; N/A is null."""
    iv = _text("INTERVAL")
    num = lambda n, t="double": _text(n).try_cast(t)
    at = lambda g: F.regexp_extract(iv, r"^(.*):(\d+)-(\d+)$", g)
    seg = _text("ID")
    out = config.where("tag in ('HSEG', 'VSEG', 'SEG')").select(
        "file", seg.alias("seg"), F.substring(seg, 1, 1).alias("spec"), F.regexp_extract(seg, r"(\d+)$", 1).try_cast("int").alias("no"), num("GROUP", "int").alias("group_id"),
        at(1).alias("refseg"), at(2).try_cast("long").alias("st"), at(3).try_cast("long").alias("ed"), num("CN_ORIG").alias("cn_orig"), num("CN_REF").alias("cn_ref"),
        num("CN_ALT").alias("cn_alt"), num("CN_ALT_LP").alias("cn_alt_lp"), num("LP_WEIGHT").alias("lp_weight"), F.regexp_replace(_text("LP_OFFSET%"), "%$", "").try_cast("double").alias("lp_offset_pct"), _text("NOTES").alias("note"),
    )
    return out.withColumn("length", F.col("ed") - F.col("st") + 1)


def config_junctions(config: DataFrame, segments: DataFrame) -> DataFrame:
    """junc_id, seg5, orit5, seg3, orit3, link, link_rc, group_id (of the host side; null where both are virus), cn_alt, cn_alt_lp."""
    side = lambda g: F.get(F.split(_text("SEGLINK"), ","), g)
    rows = config.where("tag = 'JUNC'").select("file", _text("ID").alias("junc_id"), side(0).alias("a"), side(1).alias("b"), _text("CN_ALT").try_cast("double").alias("cn_alt"), _text("CN_ALT_LP").try_cast("double").alias("cn_alt_lp"))
    rows = rows.select(
        "file", "junc_id", segment_of(F.col("a")).alias("seg5"), strand_of(F.col("a")).alias("orit5"), segment_of(F.col("b")).alias("seg3"), strand_of(F.col("b")).alias("orit3"),
        F.concat("a", F.lit(","), "b").alias("link"), F.concat(flip(F.col("b")), F.lit(","), flip(F.col("a"))).alias("link_rc"), "cn_alt", "cn_alt_lp",
    )
    g = segments.select("file", "seg", "group_id")
    rows = rows.join(g.withColumnsRenamed({"seg": "seg5", "group_id": "g5"}), ["file", "seg5"], "left").join(g.withColumnsRenamed({"seg": "seg3", "group_id": "g3"}), ["file", "seg3"], "left")
    return rows.withColumn("group_id", F.coalesce("g5", "g3")).drop("g5", "g3")


def config_cycles(config: DataFrame) -> DataFrame:
    return config.where("tag = 'UCYC'").select("file", _text("ID").alias("cycle_id"), parse_cycle(_text("SEGSTR")).alias("tokens"), _text("FVGM_ID").alias("fvgm_id"))


def config_solutions(config: DataFrame) -> DataFrame:
    """file, solution, group_id, allele, allele_cn, solution_cycles, allele_cycles, allele_free (count lists as text)."""
    return config.where("tag = 'SOLUTION'").select(
        "file", _text("NO").try_cast("int").alias("solution"), _text("GROUP").try_cast("int").alias("group_id"), _text("ALLELE_NO").try_cast("int").alias("allele"),
        _text("ALLELE_CN").try_cast("int").alias("allele_cn"), _text("SOLUTION_UCYC").alias("solution_cycles"), _text("ALLELE_UCYC").alias("allele_cycles"), _text("ALLELE_FVGM_UCYC").alias("allele_free"),
    )


def explode_counts(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """keep, id, cnt from a list such as ``U1:2,U2:10``; a part without a count is left out."""
    part = rows.select(*keep, F.explode(F.split(column, "[,;]")).alias("part"))
    out = part.select(*keep, F.regexp_extract("part", r"^(.+):(\d+)$", 1).alias("id"), F.regexp_extract("part", r"^(.+):(\d+)$", 2).try_cast("long").alias("cnt"))
    return out.where("cnt is not null")


def read_length_distribution(spark: SparkSession, path: str) -> DataFrame:
    """len, ratio, cnt, len_cnt from ``length count ratio(count),..`` (default 1(1)); ratios have two digits and are 1 at most."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')").select(F.get(f, 0).try_cast("long").alias("len"), F.get(f, 1).try_cast("long").alias("len_cnt"), F.coalesce(F.get(f, 2), F.lit("1(1)")).alias("list"))
    part = rows.select("len", "len_cnt", F.explode(F.split("list", ",")).alias("p"))
    got = lambda g: F.regexp_extract("p", r"^([0-9.]+)\((\d+)\)$", g)
    part = part.select("len", "len_cnt", F.least(F.lit(1.0), F.round(got(1).try_cast("double"), 2)).alias("ratio"), got(2).try_cast("long").alias("n"))
    return part.groupBy("len", "len_cnt", "ratio").agg(F.sum("n").alias("cnt"))


def read_pair_links(spark: SparkSession, path: str) -> DataFrame:
    """anchor_a, type_a, anchor_b, type_b, links: an anchor is a junction id (JUNC) or ``segment,chr:pos`` (POS); other forms have a null type."""
    kind = lambda c: F.when(F.col(c).rlike(r"^JUNC\d+$"), "JUNC").when(F.col(c).rlike(r"^[HV]\d+,[^:]+:\d+$"), "POS")
    rows = spark.read.csv(path, sep="\t", comment="#", schema="anchor_a string, anchor_b string, links long")
    return rows.select("anchor_a", kind("anchor_a").alias("type_a"), "anchor_b", kind("anchor_b").alias("type_b"), "links")


def read_marker_lists(spark: SparkSession, path: str) -> DataFrame:
    """anchor, marker, n from ``anchor<tab>m1,m2;m3``."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema="anchor string, markers string")
    return rows.select("anchor", F.explode(F.split("markers", "[,;]+")).alias("marker")).where("marker <> ''").groupBy("anchor", "marker").agg(F.count(F.lit(1)).alias("n"))


def read_track(spark: SparkSession, path: str, region: DataFrame | None = None) -> DataFrame:
    """A track that write_track left; with a region (refseg, st, ed) its rows that overlap it, read only from the files whose span does."""
    if region is None:
        return spark.read.parquet(path)
    try:
        spans = spark.read.parquet(f"{path}/{TRACK_INDEX}")
    except AnalysisException:  # written without an index: all files are read
        track = spark.read.parquet(path)
    else:
        hit = interval_join(spans, region.select("refseg", "st", "ed"), ["refseg"]).select("file").distinct().collect()  # names of files only
        files = [unquote(r["file"]) for r in hit]
        track = spark.read.option("basePath", path).parquet(*files) if files else spark.read.parquet(path).where("false")
    return interval_join(track, region.select("refseg", "st", "ed"), ["refseg"], how="left_semi")

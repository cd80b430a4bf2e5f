"""Writers: Parquet for tables, and the text forms beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixloom.functions.tokens import composition_signature, walk_signature

FIX_ME = "_please_fix_me_"


def field(name: str, column, missing: str = "N/A"):
    return F.concat(F.lit(name + "="), F.coalesce(column.cast("string"), F.lit(missing)))


def plain(column):
    """A number as it would be typed: 0, 12, 0.5."""
    return F.regexp_replace(column.cast("string"), r"\.0$", "")


def cents(column):
    """A number with two digits behind the point; none of nothing."""
    return F.when(column.isNotNull(), F.format_string("%.2f", column.cast("double")))


#: Fixed lines at the head of the copy-number table.
CN_HEAD = ("##VERSION=v1.1", "##_please_find_HEADER_in_online_demo_")


def cn_lines(segments: DataFrame, features: DataFrame, junctions: DataFrame, facts: DataFrame) -> DataFrame:
    """sample, section, ord, line: the copy-number table in the form that cycle solvers read.

    Two fixed lines; SAMPLE, PLOIDY, SOURCE, SINK and FVGM (the free virus genome); host SEG lines with the pure depth (PTDP), virus SEG lines with the raw depth (RAWDP), JUNC lines. segments and
    features (virus): sample, seg, seg_no, refseg, st, ed, depth, cn; junctions: sample, junc_no, link, refseg_5p .. strd_3p, ncpr, jr_count, pure, cn; facts: sample, ploidy, source, sink, chain. A missing
    fact asks to be filled in, an undefined copy number is N/A, every weight is 1.
    """
    line = lambda tag, *fields: F.concat(F.lit(tag + "\t"), F.concat_ws(";", *fields))
    fact = lambda tag, c: F.concat(F.lit(tag + "\t"), F.coalesce(F.col(c).cast("string"), F.lit(FIX_ME)))
    chain = F.concat(F.lit("FVGM\tID=FVGM1;SEGSTR="), F.coalesce(F.nullif("chain", F.lit("")), F.lit(FIX_ME)))
    lines = F.array(*[F.lit(x) for x in CN_HEAD], fact("SAMPLE", "sample"), fact("PLOIDY", "ploidy"), fact("SOURCE", "source"), fact("SINK", "sink"), chain)
    out = facts.select("sample", F.lit(0).alias("section"), F.posexplode(lines).alias("ord", "line")).withColumn("ord", F.col("ord").cast("long"))
    weight = F.lit("W=1")
    place = F.concat("refseg", F.lit(":"), "st", F.lit("-"), "ed")
    for section, rows, shown in ((1, segments, field("PTDP", cents(F.col("depth")))), (2, features, field("RAWDP", plain(F.col("depth"))))):
        seg = line("SEG", field("ID", F.col("seg")), field("CN_ORIG", cents(F.col("cn"))), weight, field("INTERVAL", place), shown)
        out = out.unionByName(rows.select("sample", F.lit(section).alias("section"), F.col("seg_no").cast("long").alias("ord"), seg.alias("line")))
    ends = [field(f"{n}_{s}".upper(), F.col(f"{n}_{s}")) for s in ("5p", "3p") for n in ("refseg", "bkpos", "strd")]
    counts = [field("NCPR", plain(F.col("ncpr"))), field("RAWJRC", F.col("jr_count")), field("PTJRC", F.col("pure"))]
    junc = line("JUNC", field("ID", F.concat(F.lit("JUNC"), F.col("junc_no"))), field("SEGLINK", F.col("link")), field("CN_ORIG", cents(F.col("cn"))), weight, *ends, *counts)
    return out.unionByName(junctions.select("sample", F.lit(3).alias("section"), F.col("junc_no").cast("long").alias("ord"), junc.alias("line")))


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Text in order, one folder for each sample: sorted inside each sample's partition, no global sort."""
    lines.repartition("sample").sortWithinPartitions("sample", *order).select("sample", F.col("line").alias("value")).write.partitionBy("sample").text(path)


def walk_lines(walks: DataFrame, folds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, map_no, line: attributes of each walk and its run-length text.

    walks(keys.., map_no, walk, depth and, where they are known, solution, group_id, allele, allele_cn, free, draw), folds(keys.., map_no, text) from fold_walks; a walk without one is
    written token by token.
    """
    have = lambda c: F.col(c) if c in walks.columns else F.lit(None).cast("string")
    attributes = F.concat_ws(
        ";", field("NO", F.col("map_no")), field("RANDPROB", F.coalesce(have("draw").cast("string"), F.lit("0"))), field("SOLUTION_NO", have("solution")), field("GROUP", have("group_id")), field("ALLELE_NO", have("allele")),
        field("ALLELE_CN", have("allele_cn")), field("FVGMUSED", have("free")), field("SEGSTRMD5", walk_signature(F.col("walk"))), field("SORTSEGSTRMD5", composition_signature(F.col("walk"))), field("STRUDEPTH", have("depth")),
    )
    both = walks.select(*keys, "map_no", "walk", F.concat(F.lit("LOCALMAP\t"), attributes, F.lit(";")).alias("head")).join(folds, [*keys, "map_no"], "left")
    text = F.concat(F.lit("STRUCTURE:\t"), F.coalesce("text", F.array_join("walk", " ")))
    return both.select(*keys, "map_no", F.posexplode(F.array("head", text)).alias("ord", "line"))


def walk_file(header: DataFrame, solutions: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """sample, section, allele_no, map_no, ord, line: the whole walk file of each sample. header(sample, ord, line) is the configuration as it was read; then for each allele its solution
    line, copied, from solutions(sample, keys.., allele_no, line), and its lines from walk_lines (keys.., map_no, ord, line)."""
    zero = F.lit(0).cast("long")
    head = header.select("sample", F.lit(0).alias("section"), zero.alias("allele_no"), zero.alias("map_no"), F.col("ord").cast("long").alias("ord"), "line")
    known = solutions.select("sample", *[k for k in keys if k != "sample"], F.col("allele_no").cast("long").alias("allele_no"), "line")
    own = known.select("sample", F.lit(1).alias("section"), "allele_no", zero.alias("map_no"), zero.alias("ord"), "line")
    body = lines.join(known.drop("line"), keys).select("sample", F.lit(1).alias("section"), "allele_no", F.col("map_no").cast("long").alias("map_no"), (F.col("ord") + 1).cast("long").alias("ord"), "line")
    return head.unionByName(own).unionByName(body)


def rank_lines(ranked: DataFrame, links: DataFrame, method: str = "Pearson") -> DataFrame:
    """sample, group_id, solution, place, ord, line: for each combination a line with its group, solution, name and correlation (N/A if undefined), a line of column names and its
    pairs (anchor_a, anchor_b, observed, expected) in order of their ids.

    ranked(sample, group_id, solution, combo, place, corr), links(sample, group_id, solution, combo, pair_id, anchor_a, anchor_b, observed, expected); combo is its name, as combination_names gives it."""
    keys = ["sample", "group_id", "solution"]
    title = F.concat(F.lit("#Group:"), "group_id", F.lit("\tSolution:"), "solution", F.lit("\t"), "combo", F.lit(f"\t{method}Corr="), F.coalesce(plain(F.col("corr")), F.lit("N/A")))
    head = ranked.select(*keys, "place", F.posexplode(F.array(title, F.lit("#anchor_a\tanchor_b\tuserLC\tsimuLC"))).alias("ord", "line")).withColumn("ord", F.col("ord").cast("long"))
    rows = links.join(ranked.select(*keys, "combo", "place"), [*keys, "combo"])
    order = F.row_number().over(Window.partitionBy(*keys, "place").orderBy("pair_id", "anchor_a", "anchor_b")) + 1
    body = rows.select(*keys, "place", order.cast("long").alias("ord"), F.concat_ws("\t", "anchor_a", "anchor_b", plain(F.col("observed")), plain(F.col("expected"))).alias("line"))
    return head.unionByName(body)


def write_pair_links(links: DataFrame, path: str) -> None:
    links.select(*[c for c in ("sample",) if c in links.columns], "anchor_a", "anchor_b", "links").write.csv(path, sep="\t")


def write_pair_matrix(matrix: DataFrame, path: str) -> None:
    """Nulls (the diagonal) as -; zeros as 0."""
    matrix.write.csv(path, sep="\t", header=True, nullValue="-")


def write_anchor_markers(markers: DataFrame, path: str) -> None:
    own = [c for c in ("sample",) if c in markers.columns]
    markers.select(*own, "anchor", "marker").distinct().sortWithinPartitions(*own, "anchor", "marker").write.csv(path, sep="\t")


#: The spans of a track's files, beside them.
TRACK_INDEX = "_spans"


def write_track(track: DataFrame, path: str, partitions: int = 8) -> None:
    """Parquet by refseg, sorted by start, so that partitions and row groups prune; wide references spread over several files. An index of the least start and greatest end of each file
    stands beside them, by which read_track chooses the files to read."""
    spread = track.repartitionByRange(partitions, "refseg", "st").sortWithinPartitions("refseg", "st")
    spread.write.partitionBy("refseg").parquet(path)
    written = track.sparkSession.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), "refseg", "st", "ed")
    written.groupBy("file", "refseg").agg(F.min("st").alias("st"), F.max("ed").alias("ed")).write.parquet(f"{path}/{TRACK_INDEX}")

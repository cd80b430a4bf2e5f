"""Annotation tracks: intervals with a name (gene, repeat type) and an id (transcript)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.operators.intervals import interval_join


def track_in_region(track: DataFrame, region: DataFrame) -> DataFrame:
    """The part of the track that lies in a region (refseg, st, ed), clipped to it."""
    hit = interval_join(track, region.select("refseg", "st", "ed"), ["refseg"])
    return hit.select(*[c for c in track.columns if c not in ("st", "ed")], F.greatest("st", "r_st").alias("st"), F.least("ed", "r_ed").alias("ed"))


def track_allowlist(track: DataFrame, names: list, column: str = "gene") -> DataFrame:
    """Only rows whose name is listed; an empty list keeps all."""
    return track.where(F.col(column).isin(list(names))) if names else track


def representative_transcript(track: DataFrame) -> DataFrame:
    """Of each gene the rows of one transcript: id 001, else 201, else the first in order."""
    one = track.groupBy("refseg", "gene").agg(F.min(F.struct(F.when(F.col("tid") == "001", 0).when(F.col("tid") == "201", 1).otherwise(2).alias("k"), "tid")).alias("best"))
    return track.join(one.select("refseg", "gene", F.col("best.tid").alias("tid")), ["refseg", "gene", "tid"], "left_semi")


def user_regions(specs: DataFrame) -> DataFrame:
    """refseg, gene, tid, st, ed from rows (refseg, spec) with spec ``NAME:a-b,c-d``; tid numbers the parts."""
    part = F.posexplode(F.split(F.element_at(F.split("spec", ":"), 2), ",")).alias("n", "part")
    rows = specs.select("refseg", F.element_at(F.split("spec", ":"), 1).alias("gene"), part)
    ends = [F.regexp_extract("part", r"^(\d+)-(\d+)$", g).try_cast("long") for g in (1, 2)]
    return rows.select("refseg", "gene", (F.col("n") + 1).cast("string").alias("tid"), ends[0].alias("st"), ends[1].alias("ed")).where("st <= ed")


def add_regions(track: DataFrame, specs: DataFrame, region: DataFrame) -> DataFrame:
    return track.unionByName(track_in_region(user_regions(specs).select(*track.columns), region))

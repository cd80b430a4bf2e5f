"""Mixing sources to target weights by cube-method balanced sampling.

Each document starts with the fractional number of copies that its source's target asks for. Whole copies are
fixed; the fractions walk through the null-space of the two balancing constraints (words, documents) until
at most a few of them are left. The walk runs in blocks: a block ends with no more than three fractions,
these go on to the next, coarser level, and the last level of each source lands its rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixloom.llm.common import empty_text, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE, MOST_COPIES = 1.5, 2.0
#: Fractions that one task balances at a time.
BLOCK_ROWS = 2048
#: A row a source; up to so many (some MB) the table of targets is broadcast, beyond it is joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Blocks of one level whose leftovers (three at most each) meet in one block of the next.
FAN_IN = 1024
EPS = 1e-9


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share=TOTAL_SHARE, most_copies=MOST_COPIES) -> DataFrame:
    """source, source_size, target: sources by code point (null last) weigh ``weights``, repeating, and share
    ``total_share`` of all sizes; a target stops at ``most_copies`` times its source's size and the excess is
    shared again by weight until none is above.

    That fixed point is min(cap, level * weight): sources sorted by cap / weight fill up one after another, so
    the level follows from running sums over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.select("*", weight.alias("weight"), (F.col("source_size") * most_copies).cast("double").alias("cap"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * total_share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.select("*", level.alias("level"))
    # the first source, in filling order, whose cap is above the level that the rest would share
    stop = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))).over(everything)
    first = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level").alias("l")))).over(everything)
    level = F.coalesce(first["l"], stop)
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))
    return per.select("source", "source_size", "source_docs", target.alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities through the null-space of (words, documents) until at most two are fractional, or
    three of which no move is left; the totals of p and of p * size stay as they are."""
    p = p.astype(float).copy()
    live: list[int] = []
    coins = rng.random(len(p) + 1)
    for n, i in enumerate(range(len(p))):
        if EPS < p[i] < 1 - EPS:
            live.append(i)
        else:
            p[i] = float(p[i] > 0.5)
        while len(live) >= 3:
            a, b, c = live[-3], live[-2], live[-1]
            u = np.array((size[b] - size[c], size[c] - size[a], size[a] - size[b]), dtype=float)
            if not u.any():
                u = np.array((1.0, -1.0, 0.0))
            x = np.array((p[a], p[b], p[c]))
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(u > 0, (1 - x) / u, np.where(u < 0, -x / u, np.inf)).min()
                down = np.where(u > 0, x / u, np.where(u < 0, (x - 1) / u, np.inf)).min()
            x = x + up * u if coins[n] * (up + down) < down else x - down * u
            del live[-3:]
            for i2, v in zip((a, b, c), x):
                if EPS < v < 1 - EPS:
                    p[i2] = v
                    live.append(i2)
                else:
                    p[i2] = float(v > 0.5)
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The rounding of the few remaining fractions that comes nearest to their words, then to their documents."""
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if not len(open_):
        return np.round(p)
    words, docs = (p[open_] * size[open_]).sum(), p[open_].sum()
    best = min(
        range(1 << len(open_)),
        key=lambda m: (abs(sum(size[i] for k, i in enumerate(open_) if m >> k & 1) - words), abs(bin(m).count("1") - docs), m),
    )
    out = np.round(p)
    for k, i in enumerate(open_):
        out[i] = float(best >> k & 1)
    return out


def _balance(last: bool, seed: int):
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mix", "doc_id", "size"], kind="stable", na_position="last")
        size = rows["size"].to_numpy(dtype=float)
        start = int(rows["mix"].iloc[0]) & 0x7FFFFFFF
        p = flight(rows["p"].to_numpy(), size, np.random.default_rng([seed, len(rows), start]))
        if last:
            open_ = (p > EPS) & (p < 1 - EPS)
            assert open_.sum() <= 3
            p = land(p, size)
        return rows.assign(p=p)

    return one


def mix_sources(
    documents: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, most_copies: float = MOST_COPIES,
    block_rows: int = BLOCK_ROWS, fan_in: int = FAN_IN, seed: int = 7,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of documents.

    size counts words; taken = copies * size. Rows are told apart by (doc_id, source, size), so rows that
    are equal in these are interchangeable and may get different copies; reruns on the same rows agree as
    multisets. A null source is a source of its own, the last; null or empty texts have size 0 and take
    nothing; extra columns are ignored; an empty table gives no rows. A hot source is only more blocks:
    rows are dealt by (source, block), never by source alone, until a level's leftovers fit one block.
    """
    sizes = documents.select("doc_id", "source", F.regexp_count(empty_text(), F.lit(WORD)).cast("long").alias("size"))
    sizes = stored(sizes, "sizes")
    targets = stored(source_targets(sizes, weights, total_share, most_copies), "targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    deal = F.when(F.col("size") > 0, F.col("rate")).otherwise(F.lit(0.0))
    rows = (
        sizes.join(targets, sizes["source"].eqNullSafe(targets["source"]))
        .drop(targets["source"])
        .select("*", rate.alias("rate"))
        .select(
            "doc_id", "source", "size", "source_size", "target", F.floor(deal).cast("long").alias("whole"),
            (deal - F.floor(deal)).alias("p"),
            F.xxhash64(F.lit(seed), "doc_id", "size").alias("mix"),
            F.greatest(F.lit(1), F.ceil(F.col("source_docs") / block_rows)).cast("long").alias("blocks"),
        )
    )
    schema = "doc_id long, source string, size long, source_size long, target double, whole long, p double, mix long, blocks long, block long"
    open_ = "p > 1e-9 and p < 1 - 1e-9"
    now = rows.select("*", F.pmod("mix", "blocks").alias("block"))
    settled = now.where(f"not ({open_})")
    now = stored(now.where(open_).groupBy("source", "block").applyInPandas(_balance(False, seed), schema), "mix")
    parts = [settled, now.where(f"not ({open_})")]
    most = now.agg(F.max("blocks")).first()[0] or 1
    while True:
        last = most <= fan_in
        nxt = now.where(open_).withColumn("block", F.floor(F.col("block") / fan_in))
        now = stored(nxt.groupBy("source", "block").applyInPandas(_balance(last, seed + 1), schema), "mix")
        if last:
            parts.append(now)
            break
        parts.append(now.where(f"not ({open_})"))
        most = -(-most // fan_in)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    copies = F.col("whole") + F.round("p").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))

"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors fall into ranges of length, each twice as long as the last. Within a range, scaled to its longest, largest inner product becomes
smallest distance by one more dimension (the square root of what a vector lacks of length one). Vectors are turned by a random rotation
and dealt to inverted lists around k-means centres of their range. Within each probed list the scan reads the rotated vectors in blocks of
columns: after each block a hypothesis test on the partial distances abandons the candidates that are too far with near certainty. What is
left is scored exactly on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixloom.llm.common import partition_keys, shuffle_width, split_by, stored

#: The index is fitted on at most so many vectors (the smallest hashed ids; they go to the driver); every vector is indexed.
FIT_ROWS = 20_000
#: Rows of a list that one cell holds, about; longer lists are more cells.
CELL_ROWS = 4096
#: Rows that a part (the cells that one task holds at a time) has, about.
PART_ROWS = 32_768
#: Lists that the sample's own centres make; beyond, each is divided by centres of what is left to the first ones.
COARSE = 1024
#: Columns that the scan reads between two tests.
COLUMNS = 16
#: Width of the test: a candidate at the threshold is abandoned with a chance that falls as exp(-EPS0 ** 2).
EPS0 = 2.4
#: Recall, on the fitted sample, from which no more lists are probed.
AIM = 0.985
SPREAD_SEED = 5


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * a @ b.T
    return np.maximum(d, 0)


def log_length(x: np.ndarray) -> np.ndarray:
    """log2 of the vectors' lengths, without squaring what would overflow."""
    top = np.abs(x).max(axis=1)
    rest = x / top[:, None]
    return np.log2(top) + 0.5 * np.log2(np.einsum("ij,ij->i", rest, rest))


def range_of(length: np.ndarray) -> np.ndarray:
    return np.floor(length).astype(np.int64)


def unit(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Vectors divided by 2 ** length, in two steps, as one could overflow."""
    half = np.exp2(-length / 2)[:, None]
    return x * half * half


def lengthen(x: np.ndarray) -> np.ndarray:
    """Vectors of length one at most with one more dimension, so that all have length one."""
    return np.hstack((x, np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", x, x)))[:, None]))


def kmeans(x: np.ndarray, lists: int, rounds: int = 8, seed: int = SPREAD_SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.permutation(len(x))[:lists])].copy()
    for _ in range(rounds):
        near = np.concatenate([squared(x[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.concatenate(([True], near[order][1:] != near[order][:-1])))
        total, count = np.add.reduceat(x[order], at, axis=0), np.diff(np.append(at, len(x)))
        centres[near[order][at]] = total / count[:, None]
    return centres


@dataclass(frozen=True)
class Lists:
    """The lists of one range: every pair of a coarse centre and a fine one, which is added to it."""

    longest: float  # log2
    coarse: np.ndarray
    fine: np.ndarray
    first: int  # number of its first list

    def __len__(self) -> int:
        return len(self.coarse) * len(self.fine)

    def home(self, turned: np.ndarray) -> np.ndarray:
        near = squared(turned, self.coarse).argmin(axis=1)
        inner = squared(turned - self.coarse[near], self.fine).argmin(axis=1) if len(self.fine) > 1 else 0
        return self.first + near * len(self.fine) + inner

    def far(self, queries: np.ndarray) -> np.ndarray:
        """Squared distances of queries to all centres."""
        d = squared(queries, self.coarse)
        if len(self.fine) == 1:
            return d
        inner = np.einsum("ij,ij->i", self.fine, self.fine) - 2 * queries @ self.fine.T
        both = 2 * self.coarse @ self.fine.T
        return (d[:, :, None] + inner[:, None, :] + both[None]).reshape(len(queries), -1)


@dataclass(frozen=True)
class Index:
    turn: np.ndarray  # rotation of the longer vectors, by columns
    ranges: dict[int, Lists]
    lists: int
    longest: float  # log2
    probes: int
    sample: np.ndarray  # original vectors over the longest's length
    sample_ids: np.ndarray

    def turned(self, x: np.ndarray, longest: float) -> np.ndarray:
        return (lengthen(unit(x, np.full(len(x), longest))) @ self.turn).astype(np.float32)

    def home(self, x: np.ndarray) -> np.ndarray:
        of = range_of(log_length(x)) if len(x) else np.zeros(0, dtype=np.int64)
        out = np.zeros(len(x), dtype=np.int64)
        for r in np.unique(of).tolist():
            at = np.flatnonzero(of == r)
            out[at] = self.ranges[r].home(self.turned(x[at], self.ranges[r].longest))
        return out

    def asked(self, x: np.ndarray) -> np.ndarray:
        """Rotated queries of length one."""
        u = unit(x, log_length(x))
        return (np.hstack((u, np.zeros((len(u), 1)))) @ self.turn).astype(np.float32)

    def promise(self, asked: np.ndarray) -> np.ndarray:
        """For queries (rows) and lists (columns) the inner product with the list's centre, over the longest's length."""
        parts = [np.exp2(r.longest - self.longest) * (1 - r.far(asked).astype(np.float64) / 2) for r in self.ranges.values()]
        return np.hstack(parts)


def fit_index(ids: np.ndarray, x: np.ndarray, ranges: dict[int, tuple[int, float]], k: int, aim: float = AIM) -> Index:
    """x: the fitted sample; ranges: rows and log2 of the longest of every range. The number of probed lists is the smallest that finds
    ``aim`` of the sample's own neighbours, lists taken in the order of their promise."""
    rng = np.random.default_rng(SPREAD_SEED)
    turn, _ = np.linalg.qr(rng.normal(size=(x.shape[1] + 1, x.shape[1] + 1)))
    longest = max(m for _, m in ranges.values())
    of = range_of(log_length(x))
    made, first = {}, 0
    for r, (rows, m) in sorted(ranges.items(), reverse=True):
        mine = x[of == r]
        turned = lengthen(unit(mine, np.full(len(mine), m))) @ turn
        want = 4 * rows**0.5
        lists = max(1, min(COARSE, int(want), len(mine) // 16))
        if len(mine):
            coarse = kmeans(turned, lists)
            rest = turned - coarse[np.concatenate([squared(turned[i : i + 4096], coarse).argmin(axis=1) for i in range(0, len(mine), 4096)])]
        else:
            coarse, rest = np.zeros((1, x.shape[1] + 1)), np.zeros((0, x.shape[1] + 1))
        inner = max(1, min(int(want / lists), len(mine) // 16)) if lists >= min(COARSE, len(mine) // 16) else 1
        fine = kmeans(rest, inner) if inner > 1 else np.zeros((1, x.shape[1] + 1))
        made[r] = Lists(m, coarse.astype(np.float32), fine.astype(np.float32), first)
        first += len(made[r])
    index = Index(turn, made, first, longest, first, unit(x, np.full(len(x), longest)), ids)
    picks = rng.permutation(len(x))[:256]
    scores = unit(x[picks], log_length(x[picks])) @ index.sample.T
    scores[np.arange(len(picks)), picks] = -np.inf
    nearest = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    home, need = index.home(x), []
    for i in range(0, len(picks), 32):
        rank = np.argsort(np.argsort(-index.promise(index.asked(x[picks[i : i + 32]])), axis=1, kind="stable"), axis=1)
        need.append(np.take_along_axis(rank, home[nearest[i : i + 32]], axis=1).reshape(-1))
    need = np.sort(np.concatenate(need))
    probes = int(need[min(len(need) - 1, int(np.ceil(aim * len(need))))]) + 1 if len(need) else first
    return Index(turn, made, first, longest, max(probes, min(first, 4)), index.sample, ids)


def least_score(x: np.ndarray, query_ids: np.ndarray, index: Index, k: int) -> np.ndarray:
    """For each query an inner product (of its direction, over the longest's length) that its k-th neighbour reaches: that within the
    fitted sample (minus infinity where that has no more than k others)."""
    out = np.full(len(x), -np.inf)
    if len(index.sample) > k + 1:
        u = unit(x, log_length(x))
        for i in range(0, len(x), 512):
            near = u[i : i + 512] @ index.sample.T
            near[query_ids[i : i + 512, None] == index.sample_ids[None, :]] = -np.inf
            out[i : i + 512] = -np.partition(-near, k - 1, axis=1)[:, k - 1]
    return out


def within(least: np.ndarray, gap: float) -> np.ndarray:
    """The squared distance, in a range whose longest is 2 ** gap of the longest of all, that goes with an inner product; -1 where none can reach it."""
    with np.errstate(over="ignore", invalid="ignore"):
        far = 2 - 2 * least * np.exp2(-gap)
    far = np.where(np.isnan(far), np.inf, far)
    return np.where(far < -1e-5, -1.0, np.maximum(far, 0) * 1.0001 + 2e-6).astype(np.float32)


def adaptive_scan(queries: np.ndarray, within: np.ndarray, cell: np.ndarray, columns: int = COLUMNS, eps0: float = EPS0):
    """(query row, candidate row) pairs that pass every test; queries and cell are rotated."""
    dims = cell.shape[1]
    first = min(columns, dims)
    partial = squared(queries[:, :first], cell[:, :first])
    scale = lambda d: d / dims * (1 + eps0 / np.sqrt(d)) ** 2 if d < dims else 1.0
    q, c = np.nonzero(partial <= (within * scale(first))[:, None])
    part = partial[q, c]
    for lo in range(first, dims, columns):
        hi = min(lo + columns, dims)
        gap = queries[q, lo:hi] - cell[c, lo:hi]
        part = part + np.einsum("ij,ij->i", gap, gap)
        keep = part <= within[q] * scale(hi)
        q, c, part = q[keep], c[keep], part[keep]
    return q, c


HITS = "query_id long, vec_id long, score double"


def _matrix(column) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id and vector (as doubles) of the rows that take part: no nulls, nothing non-finite, not zero, of the commonest length."""
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & (F.size(e) > 0)).where(~bad & F.exists(e, lambda x: x != 0))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), e.cast("array<double>").alias("v"))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


def best_of(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int):
    """The k best of each query, each vector once, ties to the smaller id."""
    order = np.lexsort((-score, vec, query))
    query, vec, score = query[order], vec[order], score[order]
    once = np.concatenate(([True], (query[1:] != query[:-1]) | (vec[1:] != vec[:-1]))) if len(query) else np.zeros(0, bool)
    query, vec, score = query[once], vec[once], score[once]
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    best = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[best], vec[best], score[best]


def nearest_neighbours(
    vectors: DataFrame, queries, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", fit_rows: int = FIT_ROWS, aim: float = AIM
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row the k others of largest inner product, ties to the smaller id.

    queries: a condition on vectors (column ``vec_id``) that says which rows ask. Vectors that are null, zero, of another
    length than the commonest, or that hold null or non-finite components take no part, nor do null ids; rows that
    share an id count as one candidate with the best of their scores. With fewer candidates all are returned; extra columns
    are ignored; an empty table gives no rows. Vectors may differ in length by any factor. Lists of any length are cut into cells; a
    task holds a part, some cells of bounded size in all, and queries stream past it, each sent once to a part.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)

    def lengths(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            length = log_length(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(range_of(length)), pa.array(length)], names=["range", "length"])

    found = rows.mapInArrow(lengths, "range long, length double").groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("m"))
    ranges = {r["range"]: (r["n"], r["m"] + 1e-9) for r in found.collect()}  # a row for each power of two that lengths can have
    if not ranges:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(fit_rows).dropDuplicates(["vec_id"]).collect()
    ids = np.array([r["vec_id"] for r in sample], dtype=np.int64)
    index = fit_index(ids, np.array([r["v"] for r in sample], dtype=np.float64), ranges, k, aim)
    shared = spark.sparkContext.broadcast(index)
    # components that come as float are sent as float; scores are computed in double either way
    kind_of = np.float32 if vectors.schema[embedding].dataType.simpleString() == "array<float>" else np.float64
    width = shuffle_width(spark)
    keys = np.array(partition_keys(spark, width), dtype=np.int64)

    def home(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.home(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0, np.int64))], names=["list"])

    total = sum(n for n, _ in ranges.values())
    cells = np.ones(index.lists, dtype=np.int64)
    for r in rows.mapInArrow(home, "list long").groupBy("list").count().collect():  # one row a list, about 4 * sqrt(rows) of them
        cells[r["list"]] = max(1, -(-r["count"] // CELL_ROWS))
    base = np.concatenate(([0], np.cumsum(cells)))
    parts = max(width, -(-total // PART_ROWS))
    list_of = np.repeat(np.arange(index.lists), cells)
    # lists near each other come to one part, so that a query asks few of them
    centres = np.vstack([(r.coarse[:, None] + r.fine[None]).reshape(len(r), -1) for r in index.ranges.values()]).astype(np.float64)
    some = kmeans(centres, max(1, min(parts, 256, len(centres) // 4)), rounds=4)
    group = np.concatenate([squared(centres[i : i + 4096], some).argmin(axis=1) for i in range(0, len(centres), 4096)])
    order = np.lexsort((list_of, group[list_of]))
    part_of = np.empty(len(list_of), dtype=np.int64)
    part_of[order] = np.arange(len(order)) * parts // len(order)
    longest_of = np.concatenate([np.full(len(r), r.longest) for r in index.ranges.values()])

    def packed(rows):
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "part", "kind", "ids", "vectors", "more"])

    def candidates(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            lists = shared.value.home(x)
            salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % cells[lists]
            cell = base[lists] + salt
            out = []
            for p, (i, v, c) in split_by(part_of[cell], ids, x.astype(kind_of), cell.astype(np.int32)):
                out.append((int(keys[p % width]), p, 0, i.tobytes(), v.tobytes(), c.tobytes()))
            yield packed(out)

    def asking(batches, probes, rank):
        index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                x, ids = _matrix(piece.column(1)), piece.column(0).to_numpy(zero_copy_only=False)
                least = least_score(x, ids, index, rank) if rank else np.full(len(x), -np.inf)
                hope = index.promise(index.asked(x))
                probed = np.argpartition(-hope, min(probes, index.lists) - 1, axis=1)[:, :probes].reshape(-1)
                row = np.repeat(np.arange(len(x)), min(probes, index.lists))
                rep = cells[probed]
                row, ends = np.repeat(row, rep), np.cumsum(rep)
                cell = np.repeat(base[probed], rep) + np.arange(ends[-1]) - np.repeat(ends - rep, rep)
                out = []
                for p, (r, c) in split_by(part_of[cell], row, cell.astype(np.int32)):
                    own, place = np.unique(r, return_inverse=True)
                    more = least[own].tobytes() + place.astype(np.int32).tobytes() + c.tobytes()
                    out.append((int(keys[p % width]), p, 1, ids[own].tobytes(), x[own].astype(kind_of).tobytes(), more))
                yield packed(out)

    def scan(batches):
        index = shared.value
        dims = len(index.turn) - 1
        now, held, loaded = -1, [], None
        for batch in batches:
            col = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "kind", "ids", "vectors", "more")]
            for part, kind, ids, data, more in zip(*col):
                if part != now:
                    now, held, loaded = part, [], None
                ids, x = np.frombuffer(ids, dtype=np.int64), np.frombuffer(data, dtype=kind_of).reshape(-1, dims)
                if kind == 0:
                    held.append((ids, x, np.frombuffer(more, dtype=np.int32)))
                    continue
                if not held:
                    continue
                if loaded is None:
                    cid, cx, cell = (np.concatenate([h[i] for h in held]) for i in range(3))
                    held = [(cid[:0], cx[:0], cell[:0])]
                    loaded = {}
                    for c, (i, v) in split_by(cell, cid, cx):
                        loaded[c] = i, v, index.turned(v.astype(np.float64), longest_of[list_of[c]])
                least, pairs = np.frombuffer(more[: 8 * len(ids)], dtype=np.float64), np.frombuffer(more[8 * len(ids) :], dtype=np.int32)
                row, cell = pairs.reshape(2, -1)
                x = x.astype(np.float64)
                asked = index.asked(x)
                got = []
                for c, (r,) in split_by(cell, row):
                    if c not in loaded:
                        continue
                    cid, cx, turned = loaded[c]
                    far = within(least[r], longest_of[list_of[c]] - index.longest)
                    r = r[far >= 0]
                    if not len(r):
                        continue
                    q, j = adaptive_scan(asked[r], far[far >= 0], turned)
                    q = r[q]
                    other = ids[q] != cid[j]
                    q, j = q[other], j[other]
                    for s in range(0, len(q), 65536):
                        a, b = q[s : s + 65536], j[s : s + 65536]
                        with np.errstate(over="ignore", invalid="ignore"):
                            got.append(best_of(a, cid[b], np.einsum("ij,ij->i", x[a], cx[b].astype(np.float64)), k))
                if got:
                    q, v, s = best_of(*(np.concatenate([g[i] for g in got]) for i in range(3)), k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])

    kinds = "key int, part int, kind int, ids binary, vectors binary, more binary"
    indexed = rows.mapInArrow(candidates, kinds)

    def hits(asked: DataFrame, probes: int, rank: int) -> DataFrame:
        both = indexed.unionByName(asked.mapInArrow(lambda batches: asking(batches, probes, rank), kinds))
        dealt = both.repartition(width, "key").sortWithinPartitions("part", "kind")
        return dealt.mapInArrow(scan, HITS).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    asked = rows.where(queries)
    # a threshold of rank 2k leaves some more than k to choose from in the probed lists
    found = stored(hits(asked, index.probes, 2 * k), "ann-hits")
    full = found.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    short = stored(asked.join(full, asked["vec_id"] == full["query_id"], "left_anti"), "ann-short")
    if short.count():  # those that found fewer ask all lists, without a threshold
        found = found.join(full, "query_id", "left_semi").unionByName(hits(short, index.lists, 0))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

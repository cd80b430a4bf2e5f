"""The best combinations of walks by correlation, without a row for each combination.

Expected links are sums over alleles, so a combination is a low half (the first alleles) and a high half. Sums of x, x^2 and xy of the halves add up, but for the
cross term of x^2, which is a matrix product of the halves' vectors; so are the numbers of pairs that neither half has. Halves are met in blocks, and a block whose bound lies under the
best found is passed over. Pieces of a solution's blocks are rows of their own, which Spark deals over the tasks. Solutions of few combinations are scored whole, many at a time:
those of a batch with as many walks of each allele share their arrays.
"""

from __future__ import annotations

import heapq
import itertools
import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.operators.ranking import rank_combinations

#: Half combinations on either side of a block, and combinations that a piece should have.
BLOCK, PIECE, MOST_PIECES = 1024, 1 << 26, 4096
#: Combinations times pairs up to which a solution is scored whole, and those of all solutions that are scored at a time.
FEW, TOGETHER = 1 << 15, 1 << 19
SOL = ["sample", "group_id", "solution"]
UNDEFINED = -2.0
HUNDREDTH = Decimal("0.01")


class Half:
    """All combinations of some alleles' walks; number i is read as digits, the first allele's the lowest."""

    def __init__(self, alleles: list[tuple[np.ndarray, np.ndarray]]):
        """alleles: for each the parts (walks x pairs) and which pairs a walk has."""
        self.alleles, self.size = alleles, int(np.prod([len(x) for x, _ in alleles], dtype=object)) if alleles else 1

    def block(self, lo: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
        """(x, absent) of the combinations from lo on, at most BLOCK."""
        n = np.arange(lo, min(lo + BLOCK, self.size))
        x, absent = np.zeros((len(n), pairs)), np.ones((len(n), pairs))
        for parts, has in self.alleles:
            digit, n = n % len(parts), n // len(parts)
            x += parts[digit]
            absent *= 1 - has[digit]
        return x, absent


class Best:
    """The k best of (correlation, smaller number)."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def least(self) -> float:
        return self.heap[0][0] if len(self.heap) == self.k else -3.0

    def offer(self, corr: np.ndarray, number: np.ndarray) -> None:
        if len(corr) > self.k:
            keep = np.lexsort((number, -corr))[: self.k]
            corr, number = corr[keep], number[keep]
        for r, n in zip(corr.tolist(), number.tolist()):
            entry = (r, -n)
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


def _box(x: np.ndarray, y: np.ndarray) -> tuple:
    """Of a block: the largest sum along the centred y, and the least and greatest of what is left in each pair."""
    c = x - x.mean(axis=1, keepdims=True)
    along = c @ y
    rest = c - np.outer(along, y)
    return along.max(), rest.min(axis=0), rest.max(axis=0)


def _bound(low: tuple, high: tuple) -> float:
    """No combination of the two blocks has a larger correlation, if all have all pairs."""
    along = low[0] + high[0]
    if along <= 0:
        return 0.0
    apart = np.maximum(0.0, np.maximum(low[1] + high[1], -(low[2] + high[2])))
    return along / np.sqrt(along * along + float(apart @ apart))


def _rounded(n, sx, sxx, sxy, sy, syy) -> np.ndarray:
    """Correlation of x and y by their sums over n pairs, nine digits; UNDEFINED where a side is constant."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    # whole hundredths: what is constant is zero to a few roundings of the sums
    flat = (vx <= 1e-12 * np.maximum(n * sxx, 1e-300)) | (vy <= 1e-12 * np.maximum(n * syy, 1e-300))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (n * sxy - sx * sy) / np.sqrt(vx * vy)
    return np.where(flat, UNDEFINED, np.round(r, 9))


def _correlations(a: tuple, b: tuple, y: np.ndarray) -> np.ndarray:
    """Correlation with y of every low combination with every high one, nine digits; UNDEFINED where a side is constant."""
    (xa, ga), (xb, gb) = a, b
    total = lambda u, v: u[:, None] + v[None, :]
    sx, sxy = total(xa.sum(1), xb.sum(1)), total(xa @ y, xb @ y)
    sxx = total((xa * xa).sum(1), (xb * xb).sum(1)) + 2 * (xa @ xb.T)
    if ga.any() and gb.any():
        n, sy, syy = len(y) - ga @ gb.T, y.sum() - (ga * y) @ gb.T, (y * y).sum() - (ga * y * y) @ gb.T
    else:
        n, sy, syy = float(len(y)), y.sum(), (y * y).sum()
    return _rounded(n, sx, sxx, sxy, sy, syy)


def best_of(alleles: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, piece: int = 0, pieces: int = 1) -> list[tuple[float, int]]:
    """(correlation, number) of the k best combinations among every pieces-th block of low halves."""
    if len(y) == 0:
        y, alleles = np.zeros(1), [(np.zeros((len(p), 1)), np.zeros((len(p), 1))) for p, _ in alleles]
    sizes = list(itertools.accumulate((len(p) for p, _ in alleles), lambda a, b: a * b))
    cut = min(range(len(alleles)), key=lambda i: max(sizes[i], sizes[-1] // sizes[i])) + 1
    low, high = Half(alleles[:cut]), Half(alleles[cut:])
    whole = all(has.all() for _, has in alleles)
    centred = y - y.mean()
    length = float(np.sqrt(centred @ centred))
    bounded = whole and length > 0
    unit = centred / length if bounded else None
    best = Best(k)
    highs = range(0, high.size, BLOCK)
    boxes = [_box(high.block(at, len(y))[0], unit) for at in highs] if bounded else []
    for at in range(piece * BLOCK, low.size, pieces * BLOCK):
        a = low.block(at, len(y))
        order = [(2.0, h) for h in range(len(highs))]
        if bounded:
            box = _box(a[0], unit)
            order = sorted(((_bound(box, b), h) for h, b in enumerate(boxes)), key=lambda t: (-t[0], t[1]))
        for bound, h in order:
            if bound + 2e-9 < best.least():
                break
            r = _correlations(a, high.block(highs[h], len(y)), y)
            i, j = np.nonzero(r >= best.least())
            best.offer(r[i, j], (at + i) + low.size * (highs[h] + j))
    return sorted(((r, -n) for r, n in best.heap), key=lambda t: (-t[0], t[1]))


def _hundredths(v: np.ndarray) -> np.ndarray:
    """v rounded as Spark's round(v, 2): the decimal that a number is printed as, halves away from zero."""
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.abs(v) * 100
        # from 1e15 on no number is printed with more than two decimals
        out = np.where(np.abs(v) < 1e15, np.copysign(np.floor(scaled + 0.5) / 100, v), v)
        close = np.flatnonzero((np.abs(v) < 1e15) & (np.abs(scaled - np.floor(scaled) - 0.5) <= 1e-6 + 1e-14 * scaled))
    for i in close.tolist():
        out[i] = float(Decimal(repr(float(v[i]))).quantize(HUNDREDTH, ROUND_HALF_UP))
    return out


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)])


def _within(starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the chosen owners hold, and the place in chosen of the owner of each; owner i holds those from starts[i] to starts[i + 1]."""
    counts = starts[chosen + 1] - starts[chosen]
    owner = np.repeat(np.arange(len(chosen)), counts)
    return np.arange(len(owner)) + (starts[chosen] - _starts(counts)[:-1])[owner], owner


def _places(have: tuple[np.ndarray, pa.Array], want: tuple[np.ndarray, pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of have, and for each of want from where to where in it those with the same solution and text lie; null meets nothing."""
    texts, n = pa.concat_arrays([have[1], want[1]]), len(have[1])
    null = texts.is_null().to_numpy(zero_copy_only=False)
    code = pc.fill_null(texts.dictionary_encode().indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    keys = np.concatenate([have[0], want[0]]) * (code.max(initial=0) + 1) + code
    keys[:n][null[:n]], keys[n:][null[n:]] = -1, -2
    order = np.argsort(keys[:n], kind="stable")
    return order, np.searchsorted(keys[order], keys[n:], side="left"), np.searchsorted(keys[order], keys[n:], side="right")


class Solutions:
    """A batch of solutions as flat arrays: walks lie by solution and allele, parts and observed pairs by solution."""

    def __init__(self, batch: pa.RecordBatch):
        """Columns walks (by allele), links, observed, piece and pieces."""
        numbers = lambda rows, c: pc.struct_field(rows, c).to_numpy(zero_copy_only=False)
        owner = lambda c: np.repeat(np.arange(batch.num_rows), _lengths(batch.column(c)))
        of, walks = owner("walks"), batch.column("walks").flatten()
        name, allele = (pc.struct_field(walks, c).dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in ("name", "allele"))
        # rows of one walk follow one another and are that walk
        other = np.ones(len(walks), bool)
        other[1:] = (of[1:] != of[:-1]) | (allele[1:] != allele[:-1])
        fresh = other.copy()
        fresh[1:] |= name[1:] != name[:-1]
        self.names = pc.struct_field(walks, "name").filter(pa.array(fresh))
        self.alleles = _starts(np.bincount(of[other], minlength=batch.num_rows))
        self.walks = np.bincount(np.cumsum(other)[fresh] - 1).astype(np.int64)
        self.walk_start = _starts(self.walks)
        seen, observed = owner("observed"), batch.column("observed").flatten()
        self.pair_start = _starts(_lengths(batch.column("observed")))
        self.pairs = np.diff(self.pair_start)
        self.y = numbers(observed, "observed")
        # a part is a link of a walk and a pair that its solution has; the others are left out
        solution, links = owner("links"), batch.column("links").flatten()
        order, at, to = _places((seen, pc.struct_field(observed, "pair_id")), (solution, pc.struct_field(links, "pair_id")))
        known = np.flatnonzero(at < to)
        pair = order[to[known] - 1] - self.pair_start[solution[known]]
        solution, links = solution[known], links.take(pa.array(known))
        order, at, to = _places((of, pc.struct_field(walks, "name")), (solution, pc.struct_field(links, "name")))
        place, link = _within(_starts(to - at), np.arange(len(at)))
        walk = order[place - _starts(to - at)[link] + at[link]]
        part = pc.multiply(pc.struct_field(links, "links").take(pa.array(link)), pc.struct_field(walks, "weight").take(pa.array(walk)))
        self.part = _hundredths(pc.fill_null(part, 0.0).to_numpy(zero_copy_only=False))
        self.part_walk, self.part_pair = (np.cumsum(fresh) - 1)[walk], pair[link]
        self.part_start = _starts(np.bincount(solution[link], minlength=batch.num_rows))
        # pieces of a solution that is scored whole: the first has it all
        self.piece, self.pieces = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("piece", "pieces"))

    def dense(self, chosen: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x, has, y) of the chosen solutions, which have as many walks: their parts and which pairs a walk has (solutions x walks x pairs), and what was observed."""
        first = self.walk_start[self.alleles[chosen]]
        shape = (len(chosen), int(self.walk_start[self.alleles[chosen[0] + 1]] - first[0]), pairs)
        x, has, y = np.zeros(shape), np.zeros(shape), np.zeros((len(chosen), pairs))
        part, owner = _within(self.part_start, chosen)
        at = owner, self.part_walk[part] - first[owner], self.part_pair[part]
        np.add.at(x, at, self.part[part])
        has[at] = 1
        pair, owner = _within(self.pair_start, chosen)
        y[owner, pair - self.pair_start[chosen][owner]] = self.y[pair]
        return x, has, y

    def together(self) -> list[tuple[tuple, np.ndarray, int]]:
        """(walks of each allele, solutions, pairs): solutions that are scored at once, and alone those of many combinations."""
        shapes = {}
        for i, (a, b) in enumerate(itertools.pairwise(self.alleles.tolist())):
            shapes.setdefault(self.walks[a:b].tobytes(), []).append(i)
        out = []
        for of in shapes.values():
            of = np.array(of)
            walks = tuple(self.walks[self.alleles[of[0]] : self.alleles[of[0] + 1]].tolist())
            of = of[np.argsort(self.pairs[of], kind="stable")]
            each = float(min(math.prod(walks), 1 << 62)) * np.maximum(self.pairs[of], 1)
            at = 0
            while at < len(of):
                to = at + 1
                if each[at] <= FEW:
                    # solutions lie by rising pairs, and the last one's pairs are made for all
                    fits = (each[at:] <= FEW) & (each[at:] * np.arange(1, len(of) - at + 1) <= TOGETHER)
                    to = at + max(1, int(np.argmin(fits)) if not fits.all() else len(fits))
                out.append((walks, of[at:to], max(1, int(self.pairs[of[to - 1]]))))
                at = to
        return out

    def best(self, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """(place in the batch, number, name, correlation) of the k best combinations of each solution."""
        found = [], [], [], []
        for walks, of, pairs in self.together():
            many = math.prod(walks)
            if many * pairs <= FEW:
                r = _scored(walks, *self.dense(of, pairs))
                number = np.argsort(-r, axis=1, kind="stable")[:, :k]
                r, row = np.take_along_axis(r, number, 1).ravel(), np.repeat(of, number.shape[1])
                kept = (self.piece[row] == 0) & ~np.isnan(r)
                r, row, number = r[kept], row[kept], number.ravel()[kept]
            else:
                x, has, y = (v[0] for v in self.dense(of, pairs))
                cuts = _starts(np.array(walks))
                alleles = [(x[a:b], has[a:b]) for a, b in itertools.pairwise(cuts.tolist())]
                met = best_of(alleles, y, k, int(self.piece[of[0]]), int(self.pieces[of[0]]))
                r, number = np.array([r for r, _ in met]), np.array([n for _, n in met], np.int64)
                row = np.repeat(of, len(met))
            texts, left = [], number
            for i, n in enumerate(walks):
                left, digit = np.divmod(left, n)
                texts.append(self.names.take(pa.array(self.walk_start[self.alleles[row] + i] + digit)))
            for held, new in zip(found, (row, number, pc.binary_join_element_wise(*texts, ","), r)):
                held.append(new)
        if not found[0]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0)
        row, number, texts, r = found
        return np.concatenate(row), np.concatenate(number), pa.concat_arrays(texts).cast(pa.string()), np.concatenate(r)


def _scored(walks: tuple, x: np.ndarray, has: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Correlations (solutions x combinations) as _correlations gives them, of solutions with as many walks of each allele; has 0 where a walk lacks a pair."""
    m, _, pairs = x.shape
    total, held, at = np.zeros((m, 1, pairs)), np.zeros((m, 1, pairs)), 0
    for n in walks:
        total = (x[:, at : at + n, None] + total[:, None]).reshape(m, -1, pairs)
        held = np.maximum(has[:, at : at + n, None], held[:, None]).reshape(m, -1, pairs)
        at += n
    y = y[:, :, None]
    n, sy, syy = held.sum(2), (held @ y)[:, :, 0], (held @ (y * y))[:, :, 0]
    return _rounded(n, total.sum(2), (total * total).sum(2), (total @ y)[:, :, 0], sy, syy)


def best_combinations(alleles: DataFrame, links: DataFrame, observed: DataFrame, k: int = 10) -> DataFrame:
    """sample, group_id, solution, combo, name, corr, place: the k combinations of each solution whose expected links correlate best (Pearson) with the observed ones, as
    rank_combinations places them among all; numbers and names are those of walk_combinations.

    alleles(.., allele, map_no, length, cn), links(.., allele, map_no, pair_id, links), observed(.., pair_id, observed), each with sample, group_id, solution. Pairs that nobody observed are left out; a pair counts for the
    combinations of which a walk has it. A solution's walks and pairs are one row; its combinations are never written out, and of a thousand million the tasks meet 32 000 halves with as many.
    """
    kinds = {f.name: f.dataType.simpleString() for f in alleles.schema.fields}
    named = lambda **c: F.named_struct(*[x for n, v in c.items() for x in (F.lit(n), v)])
    text = lambda c: F.col(c).cast("string").alias(c)
    name = lambda allele, map_no: F.concat(F.lit("AL"), allele, F.lit(".LM"), map_no)
    whole = " and ".join(f"{c} is not null" for c in SOL)
    walks = alleles.where(whole).select(*SOL, F.struct("allele", "map_no", (F.col("length") * F.col("cn")).alias("v")).alias("walk"))
    linked = links.where(whole).select(*SOL, F.struct(name(text("allele"), text("map_no")).alias("name"), text("pair_id"), F.col("links").cast("double").alias("links")).alias("link"))
    seen = observed.where(f"{whole} and observed is not null").select(*SOL, F.struct(text("pair_id"), F.col("observed").cast("double").alias("observed")).alias("seen"))
    # all that a solution has meets in one shuffle, without joins
    rows = walks.unionByName(linked, allowMissingColumns=True).unionByName(seen, allowMissingColumns=True)
    rows = rows.groupBy(*SOL).agg(F.array_sort(F.collect_list("walk")).alias("walks"), F.collect_list("link").alias("links"), F.collect_list("seen").alias("observed")).where(F.size("walks") > 0)
    sums = walks.select(F.sum("walk.v").alias("v")).schema["v"].dataType

    def add(s, w):
        same = (s["n"] > 0) & s["allele"].eqNullSafe(w["allele"])
        had = same & s["had"]
        more = F.when(had | w["map_no"].isNull(), s["total"]).otherwise(s["total"] + F.coalesce(w["v"], F.lit(0)))
        many = F.when(same, s["many"]).otherwise(s["many"] * F.greatest(s["n"], F.lit(1.0)))
        return named(allele=w["allele"], had=had | w["map_no"].isNotNull(), total=more.cast(sums), n=F.when(same, s["n"] + 1).otherwise(F.lit(1.0)), many=many)

    # walks lie by allele and map_no: the sum of each allele's first, and the product of their numbers
    none = named(allele=F.lit(None).cast(kinds["allele"]), had=F.lit(False), total=F.lit(0).cast(sums), n=F.lit(0.0), many=F.lit(1.0))
    rows = rows.withColumn("sums", F.aggregate("walks", none, add))
    rows = rows.withColumn("pieces", F.least(F.ceil(F.expr("sums.n * sums.many") / PIECE), F.lit(MOST_PIECES)).cast("int"))
    known = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    weighed = lambda w: named(allele=known(w["allele"]), name=name(known(w["allele"]), known(w["map_no"])), weight=F.try_divide(w["v"], F.col("sums.total")).cast("double"))
    rows = rows.select(*SOL, F.transform("walks", weighed).alias("walks"), "links", "observed", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))

    def search(batches):
        for batch in batches:
            # what a batch's solutions find is one batch again: a batch for each solution costs more than its search
            of, combos, names, corrs = Solutions(batch).best(k)
            if len(of):
                again = [batch.column(c).take(pa.array(of)) for c in SOL]
                corr = pa.array(corrs, pa.float64(), mask=corrs == UNDEFINED)
                yield pa.RecordBatch.from_arrays([*again, pa.array(combos, pa.int64()), names, corr], names=[*SOL, "combo", "name", "corr"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in SOL) + ", combo long, name string, corr double"
    found = rows.repartition(*SOL, "piece").mapInArrow(search, schema)
    return rank_combinations(found, SOL, best=k)

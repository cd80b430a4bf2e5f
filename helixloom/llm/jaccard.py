"""N-gram Jaccard join, size-aware, with heavy and light sets.

Documents are sets of word shingles; two link when their Jaccard similarity reaches a threshold. Light (small) sets enumerate
their subsets of the sizes that a linked pair must share. Heavy (large) sets go through inverted lists: a
set is cut by hash into blocks, more of them than a linked pair can differ in, so a linked pair has equal blocks; the list
of a block holds the sets that have it. The boundary is where enumerating costs more than scanning. Lists are
scanned from one pivot each, and what the pivots leave open is tested pair by pair, so that no link is lost.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm.common import (
    RollingHash,
    from_planes,
    join_to_one,
    mix64,
    partition_keys,
    planes,
    shuffle_width,
    slices,
    split_by,
    stored,
    text_chunks,
)
from helixloom.llm.components import connected_components

SHINGLE, NUM, DEN = 4, 85, 100
#: Blocks beyond the least that pigeonholes ask for: so many may be empty in both sets.
SLACK = 3
#: What scanning a list entry, with its share of tests, costs in units of one enumerated subset.
SCAN_COST = 8
#: Sets of one list that a row holds at a time; a longer list is several rows.
LIST_ROWS = 1 << 16
#: Open sets of one shingle that meet in one place; more are dealt to slices, and slices meet two by two.
SLICE = 512
#: Up to so many owners of candidate sets (two longs each) are broadcast; beyond, a shuffle joins them.
BROADCAST_OWNERS = 1_000_000
U = np.uint64
LIST_SALT, SUBSET_SALT, SET_SALT = U(0x51A3), U(0x7C21), U(0x1F35)


class Threshold:
    """Sizes and counts that follow from similarity >= num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges = [1]  # the first size of each class; linked sets are in one class or in neighbours
        while self.edges[-1] < 1 << 40:
            self.edges.append(self.edges[-1] * den // num + 1)
        self.starts = np.array(self.edges, dtype=np.int64)

    def overlap(self, a: int, b: int) -> int:
        """The least intersection of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def partners(self, n: int) -> range:
        return range(-(-self.num * n // self.den), n * self.den // self.num + 1)

    def blocks(self, k: int) -> int:
        """Blocks for pairs whose smaller set is in class k: more than such a pair can differ in."""
        a = self.edges[k + 1] - 1
        b = a * self.den // self.num
        return (self.den - self.num) * (a + b) // (self.den + self.num) + 1 + SLACK

    @lru_cache(maxsize=None)  # noqa: B019
    def subset_sizes(self, n: int) -> tuple[int, ...]:
        return tuple(sorted({self.overlap(n, m) for m in self.partners(n) if self.overlap(n, m) <= min(n, m)}))

    @lru_cache(maxsize=1)  # noqa: B019
    def boundary(self) -> int:
        """The largest size of a light set: enumerating its subsets costs no more than scanning its blocks."""
        n = 1
        while True:
            m = n + 1
            k = int(np.searchsorted(self.starts, m, side="right")) - 1
            scan = SCAN_COST * (self.blocks(k) + (self.blocks(k - 1) if k else 0))
            if sum(comb(m, c) for c in self.subset_sizes(m)) > scan:
                return n
            n = m


def shingle_sets(texts: list[bytes], roll: RollingHash, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: A-Z lower-cased, words are runs without ASCII white space."""
    out: list[np.ndarray] = []
    for first, last in text_chunks(texts):
        part = texts[first:last]
        data = np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        before = np.concatenate(([True], blank[:-1]))
        start, end = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
        word = roll.stretch(roll.sums(data), start, end)
        ends = np.cumsum([len(t) + 1 for t in part])
        upto = np.searchsorted(start, ends)
        with np.errstate(over="ignore"):
            n = max(0, len(word) - width + 1)
            gram = np.zeros(n, dtype=np.uint64)
            for i in range(width):
                gram += word[i : n + i] * U(2 * i * 0x9E3779B97F4A7C15 + 0xD6E8FEB86659FD93 & (1 << 64) - 1)
            gram = mix64(gram)
        a = 0
        for b in upto.tolist():
            if b - a >= width:
                out.append(np.unique(gram[a : b - width + 1]))
            elif b > a:
                with np.errstate(over="ignore"):
                    h = SET_SALT + U(b - a)
                    for w in word[a:b]:
                        h = mix64(np.array([h * U(31) + w]))[0]
                out.append(np.array([h], dtype=np.uint64))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            a = b
    return out


def set_id(members: np.ndarray) -> int:
    """64 bits that stand for a whole set."""
    with np.errstate(over="ignore"):
        one = mix64(members ^ SET_SALT).sum(dtype=np.uint64) + U(len(members))
        return int(mix64(np.array([one]))[0].astype(np.int64))


def parity_sketch(members: np.ndarray) -> bytes:
    """Bits that say whether an odd number of members falls there, two bits or more a member. Each member that only one of
    two sets has turns one bit, so sketches differ in no more places than the sets do."""
    bits = 1 << max(6, int(2 * len(members) - 1).bit_length())
    at = (members >> U(13) & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Places in which two sketches differ, the longer one folded to the shorter."""
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        half = len(a) // 2
        a = (int.from_bytes(a[:half], "big") ^ int.from_bytes(a[half:], "big")).to_bytes(half, "big")
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()


def signatures(sets: list[np.ndarray], level: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) of non-empty sets: subsets of light ones, blocks of those that can meet a heavy one."""
    limit = level.boundary()
    sig, own = [], []
    with np.errstate(over="ignore"):
        heavy = []
        for i, s in enumerate(sets):
            n = len(s)
            if n <= limit:
                mixed = mix64(s ^ SUBSET_SALT)
                for c in level.subset_sizes(n):
                    picked = np.array(list(combinations(range(n), c)), dtype=np.int64).reshape(-1, c)
                    sig.append(mix64(mixed[picked].sum(axis=1, dtype=np.uint64) + U(c) * SUBSET_SALT))
                    own.append(np.full(len(picked), i, dtype=np.int64))
            if level.partners(n)[-1] > limit:
                heavy.append(i)
        if heavy:
            sizes = np.array([len(sets[i]) for i in heavy], dtype=np.int64)
            every = np.concatenate([sets[i] for i in heavy])
            of = np.repeat(np.arange(len(heavy)), sizes)
            cls = np.searchsorted(level.starts, sizes, side="right") - 1
            weight, place = mix64(every ^ LIST_SALT), every >> U(7)
            for down in (0, 1):
                k = cls - down
                m = np.array([level.blocks(int(x)) if x >= 0 else 0 for x in k], dtype=np.int64)
                base = np.concatenate(([0], np.cumsum(m)))
                ok = (k >= 0)[of]
                spot = base[of[ok]] + (place[ok] % np.maximum(m, 1).astype(np.uint64)[of[ok]]).astype(np.int64)
                total = np.zeros(base[-1], dtype=np.uint64)
                np.add.at(total, spot, weight[ok])
                count = np.bincount(spot, minlength=base[-1])
                owner = np.repeat(np.arange(len(heavy)), m)
                j = np.arange(base[-1]) - base[owner]
                h = mix64(total + U(1) * (k[owner].astype(np.uint64) << U(40)) + j.astype(np.uint64) * U(0x9E3779B97F4A7C15))
                empty = count == 0
                bare = np.bincount(owner[empty], minlength=len(heavy)) > SLACK
                keep = ~empty | bare[owner]
                sig.append(h[keep])
                own.append(np.array(heavy)[owner[keep]])
    if not sig:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(sig), np.concatenate(own)


PACKED = "bucket int, sigs binary, sids binary, doc_ids binary, sizes binary, none binary, sketches array<binary>"
FOUND = "doc_id long, n long, sid long, th long, sketch binary, lid long, members array<long>"


def _spread(documents: DataFrame, keys: list[int], level: Threshold, shingle: int) -> DataFrame:
    """Packed rows by bucket: signatures with their sets, and the documents' own (doc_id, size, set, hash of the text)."""

    def run(batches):
        roll = RollingHash(1 << 21)
        bucket_of = np.array(keys, dtype=np.int64)
        width = U(len(keys))
        known: set[int] = set()  # sets whose signatures this task has sent
        for batch in slices(batches):
            doc_ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            texts = [(t or "").encode() for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            ths = batch.column(batch.schema.get_field_index("th")).to_numpy(zero_copy_only=False)
            for first, last in text_chunks(texts, 1 << 22):
                sets = shingle_sets(texts[first:last], roll, shingle)
                sids = np.array([set_id(s) if len(s) else 0 for s in sets], dtype=np.int64)
                fresh = []
                for i, s in enumerate(sids.tolist()):
                    if len(sets[i]) and s not in known:
                        known.add(s)
                        fresh.append(i)
                if len(known) > 2_000_000:
                    known.clear()
                sig, own = signatures([sets[i] for i in fresh], level)
                parts = {}
                owners = sids[np.array(fresh, dtype=np.int64)][own] if len(own) else np.zeros(0, dtype=np.int64)
                for b, (x, y) in split_by((sig % width).astype(np.int64), sig, owners):
                    parts[b] = [planes(x), planes(y), b"", b"", b"", []]
                ids = np.array([d if d is not None else 0 for d in doc_ids[first:last]], dtype=np.int64)
                none = np.array([d is None for d in doc_ids[first:last]], dtype=np.uint8)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                at = (mix64(sids.view(np.uint64)) % width).astype(np.int64)
                at = np.where(sizes == 0, np.arange(len(at)) % len(keys), at)
                sent = set(fresh)
                order = np.arange(len(sets))
                for b, (d, n, s, h, z, o) in split_by(at, ids, sizes, sids, ths[first:last], none, order):
                    p = parts.setdefault(b, [b"", b"", b"", b"", b"", []])
                    p[2], p[3], p[4] = planes(d), planes(n) + planes(s) + planes(h), z.tobytes()
                    p[5] = [parity_sketch(sets[i]) if i in sent else None for i in o.tolist()]
                rows = sorted(parts.items())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket_of[b]) for b, _ in rows], pa.int32())]
                    + [pa.array([p[k] for _, p in rows], pa.binary()) for k in range(5)]
                    + [pa.array([p[5] for _, p in rows], pa.list_(pa.binary()))],
                    names=["bucket", "sigs", "sids", "doc_ids", "sizes", "none", "sketches"],
                )

    return documents.mapInArrow(run, PACKED)


def _gather(packed: DataFrame, width: int) -> DataFrame:
    """From each bucket: the documents' rows, and each distinct list of two or more sets that share a signature."""

    def run(batches):
        sigs, sids = [], []
        for batch in batches:
            col = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("sigs", "sids", "doc_ids", "sizes", "none", "sketches")}
            docs, sketches = [], []
            for i in range(batch.num_rows):
                if col["sigs"][i]:
                    sigs.append(from_planes(col["sigs"][i], np.uint64))
                    sids.append(from_planes(col["sids"][i], np.int64))
                if col["doc_ids"][i]:
                    three, third = col["sizes"][i], len(col["sizes"][i]) // 3
                    sketches += col["sketches"][i]
                    numbers = [from_planes(three[k * third : (k + 1) * third], np.int64) for k in range(3)]
                    docs.append((from_planes(col["doc_ids"][i], np.int64), *numbers, np.frombuffer(col["none"][i], dtype=np.uint8)))
            if docs:
                d, n, s, h, z = (np.concatenate([x[k] for x in docs]) for k in range(5))
                nothing = pa.nulls(len(d), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, mask=z == 1), pa.array(n), pa.array(s, mask=n == 0), pa.array(h), pa.array(sketches, pa.binary()), nothing, pa.nulls(len(d), pa.list_(pa.int64()))],
                    names=["doc_id", "n", "sid", "th", "sketch", "lid", "members"],
                )
        if not sigs:
            return
        sig, sid = np.concatenate(sigs), np.concatenate(sids)
        order = np.lexsort((sid, sig))
        sig, sid = sig[order], sid[order]
        first = np.concatenate(([True], (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])))
        sig, sid = sig[first], sid[first]
        cut = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1], [True])))
        a, b = cut[:-1], cut[1:]
        many = b - a >= 2
        a, b = a[many], b[many]
        if not len(a):
            return
        with np.errstate(over="ignore"):
            running = np.concatenate(([U(0)], np.cumsum(mix64(sid.view(np.uint64) ^ LIST_SALT))))
            lid = mix64(running[b] - running[a] + (b - a).astype(np.uint64))
        _, once = np.unique(lid, return_index=True)
        for lo in range(0, len(once), 4096):
            part = once[lo : lo + 4096]
            cuts = [(i, c) for i in part.tolist() for c in range(int(a[i]), int(b[i]), LIST_ROWS)]
            members = pa.array([sid[c : min(c + LIST_ROWS, b[i])] for i, c in cuts], pa.list_(pa.int64()))
            nothing = pa.nulls(len(cuts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [nothing, nothing, nothing, nothing, pa.nulls(len(cuts), pa.binary()), pa.array(lid[[i for i, _ in cuts]].view(np.int64)), members],
                names=["doc_id", "n", "sid", "th", "sketch", "lid", "members"],
            )

    return packed.repartition(width, "bucket").mapInArrow(run, FOUND)


TESTED = "a long, b long, shared long, na long, nb long"


def _test(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Exact intersections of the pairs (a, b); the sets are taken from the texts again."""
    left = texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a"))

    def run(batches):
        roll = RollingHash(1 << 21)
        last, held = None, None
        for batch in slices(batches, 512):
            a, b, ta, tb = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            later = shingle_sets([t.encode() for t in tb], roll, shingle)
            rows = []
            for i in range(len(a)):
                if a[i] != last:
                    last, held = a[i], shingle_sets([ta[i].encode()], roll, shingle)[0]
                shared = len(np.intersect1d(held, later[i], assume_unique=True))
                rows.append((shared, len(held), len(later[i])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))],
                names=["a", "b", "shared", "na", "nb"],
            )

    return pairs.join(left, "b").join(right, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, TESTED)


def jaccard_groups(documents: DataFrame, shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, th, n, root for every row of documents: th is xxhash64 of its text, n the size of its set and root names the group that it hangs together with by
    links 100 * shared >= num / den * 100 * union; null without words. Rows are told apart by text, whatever their doc_id."""
    spark = documents.sparkSession
    width = shuffle_width(spark)
    level = Threshold(num, den)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    found = stored(_gather(_spread(docs, partition_keys(spark, width), level, shingle), width), "jaccard-lists")
    rows = found.where("lid is null").select("doc_id", "n", "sid", "th", "sketch")
    lists = found.where("lid is not null").select("lid", "members")
    nodes = _link(spark, docs, rows, lists, shingle, num, den)
    named = rows.join(nodes, rows["sid"] == nodes["node"], "left").select("doc_id", "th", "n", F.coalesce("component", "sid").alias("root"))
    return stored(named, "jaccard-named")


def jaccard_components(documents: DataFrame, shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of documents; links are 100 * shared >= num / den * 100 * union.

    Null and empty texts have no shingles and stay alone. A row with a null doc_id takes part in links; its
    component is named by the smallest id that is not null (null if there is none). Repeated rows stay and share
    a component; rows that share a doc_id but not the text are linked by their texts alone. Extra columns are
    ignored; an empty table gives no rows.

    Equal sets are one node (a 64-bit name), so copies cost nothing beyond their row. Lists are tested from their
    pivot, the member with the most equal blocks. Sets of a list that are then still in different components are open: their
    shingles are counted, and pairs that share one of their rarest shingles early enough are tested too.
    """
    named = jaccard_groups(documents, shingle, num, den)
    placed, alone = named.where("root is not null"), named.where("root is null")
    names = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    found = join_to_one(placed, names, ["root"], "rows", named.count()).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _near(pairs: DataFrame, owners: DataFrame, level: Threshold) -> DataFrame:
    """The pairs (a, b) whose sketches differ in no more places than a linked pair can."""
    left = owners.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    right = owners.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))

    def run(batches):
        for batch in batches:
            a, b, na, nb, ka, kb = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "na", "nb", "ka", "kb"))
            keep = [sketch_distance(x, y) <= m + n - 2 * level.overlap(m, n) for x, y, m, n in zip(ka, kb, na, nb)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, keep) if k], pa.int64()) for c in (a, b)], names=["a", "b"])

    # the near side of a hot pivot stays out of the shuffle by b: sketches are joined to the pivots last
    return pairs.join(left, "b").join(right, "a").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, owners: DataFrame, sids: DataFrame, repeated: bool, name: str) -> DataFrame:
    """(sid, text, n) of the named sets, once each, from the document that owns each: the numbered one of that text or, for a set
    that only rows with a null doc_id hold, one of theirs."""
    wanted = stored(owners.select("sid", "doc_id", "th", "n").join(sids.distinct(), "sid", "left_semi"), name + "-owners")
    few = wanted.count() <= BROADCAST_OWNERS
    numbered, other = wanted.where("doc_id is not null"), wanted.where("doc_id is null").drop("doc_id")
    found = docs.join(F.broadcast(numbered) if few else numbered, ["doc_id", "th"]).select("sid", "text", "n")
    if repeated:  # some rows stand twice
        found = found.dropDuplicates(["sid"])
    nameless = docs.where("doc_id is null").join(F.broadcast(other) if few else other, "th")
    nameless = nameless.groupBy("sid").agg(F.min("text").alias("text"), F.min("n").alias("n"))  # copies have no id to tell them apart
    return stored(found.unionByName(nameless), name)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid")))


def _link(spark: SparkSession, docs: DataFrame, rows: DataFrame, lists: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """(node, component) of all sets that have a link."""
    level = Threshold(num, den)
    spread = lists.select("lid", F.explode("members").alias("sid"))
    # the set with the most equal blocks is nearest to what its group has in common; it is the pivot of all its lists
    weight = spread.groupBy("sid").agg(F.count(F.lit(1)).alias("w"))
    members = spread.join(weight, "sid").select("lid", "sid", F.struct("w", "sid").alias("rank"))
    pivots = members.groupBy("lid").agg(F.max("rank").alias("top"), F.count(F.lit(1)).alias("n")).select("lid", F.col("top.sid").alias("pivot"), "n")
    entries = stored(spread, "jaccard-entries")
    members = stored(join_to_one(entries, stored(pivots, "jaccard-pivots"), ["lid"], "n", entries.count()).drop("n"), "jaccard-members")
    stars = stored(members.where("sid <> pivot").select(F.col("pivot").alias("a"), F.col("sid").alias("b")).distinct(), "jaccard-stars")
    owners = rows.join(_ends(stars).distinct(), "sid", "left_semi").groupBy("sid")
    head = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("head")
    owners = owners.agg(head, F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    owners = stored(owners.select("sid", "head.doc_id", "head.th", "n", "sketch"), "jaccard-owners")
    near = stored(_near(stars, owners, level), "jaccard-near")
    link = F.expr(f"{den} * shared >= {num} * (na + nb - shared)")
    repeated = not rows.where("doc_id is not null").groupBy("doc_id", "th").count().where("count > 1").isEmpty()
    texts = _texts(docs, owners, _ends(near), repeated, "jaccard-texts")
    links = stored(_test(near, texts, shingle).where(link).select("a", "b"), "jaccard-links")
    parts = connected_components(links, "a", "b")
    placed = members.join(parts, members["sid"] == parts["node"], "left").select("lid", "sid", F.coalesce("component", "sid").alias("part"))
    mixed = placed.groupBy("lid").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("lid")
    open_ = stored(placed.join(mixed, "lid", "left_semi").select("sid", "part").distinct().join(owners.select("sid", "n"), "sid"), "jaccard-open")
    texts = _texts(docs, owners, open_.select("sid"), repeated, "jaccard-open-texts")
    rest = _prefix_pairs(spark, open_, texts, shingle, num, den)
    seen = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = stored(_near(rest.join(seen, ["a", "b"], "left_anti"), owners, level), "jaccard-rest")
    more = stored(_test(rest, texts, shingle).where(link).select("a", "b"), "jaccard-more")
    return parts if more.isEmpty() else connected_components(links.unionByName(more), "a", "b")


def _prefix_pairs(spark: SparkSession, open_: DataFrame, texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """(a, b): pairs of open sets in different components that may still link, by their rarest common shingle.

    Shingles are put in order of their count over the open sets. The first common shingle of a linked pair stands so
    early in both sets that the least overlap still fits behind it; shingles of one set only are counted, not posted.
    Shingles are named by fewer bits here: that can add pairs to test, never lose one.
    """
    width = shuffle_width(spark)
    keys = partition_keys(spark, width)

    def post(batches):
        roll = RollingHash(1 << 21)
        for batch in slices(batches):
            sids, bodies = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("sid", "text"))
            bodies = [t.encode() for t in bodies]
            for first, last in text_chunks(bodies, 1 << 22):
                sets = shingle_sets(bodies[first:last], roll, shingle)
                token = np.concatenate(sets)
                owner = np.repeat(np.array(sids[first:last], dtype=np.int64), [len(x) for x in sets])
                rows = list(split_by((token % U(width)).astype(np.int64), (token >> U(32)).astype(np.uint32), owner))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in rows], pa.int32()), pa.array([keys[b] for b, _ in rows], pa.int32())]
                    + [pa.array([planes(c[k]) for _, c in rows], pa.binary()) for k in range(2)],
                    names=["no", "bucket", "tokens", "sids"],
                )

    def count(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for no, t, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                held.setdefault(no, []).append((from_planes(t, np.uint32), from_planes(s, np.int64)))
        for no, parts in held.items():
            token, sid = (np.concatenate([x[k] for x in parts]) for k in range(2))
            _, inverse, many = np.unique(token, return_inverse=True, return_counts=True)
            df = many[inverse]
            keep = df >= 2
            token, sid, df = token[keep], sid[keep], np.minimum(df[keep], 1 << 30).astype(np.uint32)
            order = np.argsort(sid, kind="stable")
            token, sid, df = token[order], sid[order], df[order]
            rows = list(split_by((mix64(sid.view(np.uint64)) % U(width)).astype(np.int64), sid, token, df))
            yield pa.RecordBatch.from_arrays(
                [pa.array([no] * len(rows), pa.int32()), pa.array([keys[b] for b, _ in rows], pa.int32())]
                + [pa.array([planes(c[k]) for _, c in rows], pa.binary()) for k in range(3)],
                names=["no", "bucket", "sids", "tokens", "dfs"],
            )

    def prefix(batches):
        parts = []
        sizes: dict[int, tuple[int, int]] = {}
        for batch in batches:
            no, sids, tokens, dfs, sid, n, part = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("no", "sids", "tokens", "dfs", "sid", "n", "part"))
            for k in range(batch.num_rows):
                if sid[k] is not None:
                    sizes[sid[k]] = (n[k], part[k])
                else:
                    t = from_planes(tokens[k], np.uint32).astype(np.int64) * width + no[k]
                    parts.append((from_planes(sids[k], np.int64), t, from_planes(dfs[k], np.uint32)))
        if not parts:
            return
        sid, token, df = (np.concatenate([x[k] for x in parts]) for k in range(3))
        order = np.lexsort((token, df, sid))
        sid, token = sid[order], token[order]
        at = np.flatnonzero(np.concatenate(([True], sid[1:] != sid[:-1], [True])))
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        n, part = (np.array([sizes[x][k] for x in sid[at[:-1]].tolist()], dtype=np.int64) for k in range(2))
        rank = n[owner] - (at[1:][owner] - np.arange(len(sid)))
        early = rank <= n[owner] - -(-num * n[owner] // den)
        cols = sid[early], token[early], rank[early], n[owner][early], part[owner][early]
        for lo in range(0, len(cols[0]), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 65536]) for c in cols], names=["sid", "token", "rank", "n", "part"])

    posted = texts.select("sid", "text").mapInArrow(post, "no int, bucket int, tokens binary, sids binary")
    counted = posted.repartition(width, "bucket").mapInArrow(count, "no int, bucket int, sids binary, tokens binary, dfs binary")

    def deal(batches):
        """Each open set goes to the task that gets its counts."""
        for batch in batches:
            sid = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.array(keys, dtype=np.int64)[(mix64(sid.view(np.uint64)) % U(width)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *batch.columns], names=["bucket", "sid", "n", "part"])

    known = open_.select("sid", "n", "part").mapInArrow(deal, "bucket int, sid long, n long, part long")
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("sids", "tokens", "dfs")]
    known = known.select(F.lit(None).cast("int").alias("no"), "bucket", *nothing, "sid", "n", "part")
    none = [F.lit(None).cast("long").alias(c) for c in ("sid", "n", "part")]
    both = counted.select("*", *none).unionByName(known)
    rare = stored(both.repartition(width, "bucket").mapInArrow(prefix, "sid long, token long, rank long, n long, part long"), "jaccard-prefixes")
    shared = rare.groupBy("token").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count(F.lit(1)).alias("posts")).where("p <> q").select("token", "posts")
    rare = join_to_one(rare, stored(shared, "jaccard-tokens"), ["token"], "posts", rare.count())
    # a frequent shingle's sets are dealt to slices; the slices x <= y of a token meet in a place of their own
    parts_of = F.ceil(F.col("posts") / SLICE).cast("int")
    rare = rare.select("*", parts_of.alias("of"), F.pmod(F.xxhash64("sid"), parts_of).cast("int").alias("slice"))
    low = rare.select("*", F.col("slice").alias("x"), F.explode(F.sequence("slice", F.col("of") - 1)).alias("y"))
    high = rare.select("*", F.explode(F.sequence(F.lit(0), "slice")).alias("x"), F.col("slice").alias("y"))
    x, y = low.alias("x"), high.alias("y")
    need = f"ceil({num} * (x.n + y.n) / {num + den})"
    pairs = x.join(y, F.expr("x.token = y.token and x.x = y.x and x.y = y.y")).where(
        f"(x.sid < y.sid or x.x < x.y) and x.part <> y.part and {den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n) "
        f"and x.rank <= x.n - {need} and y.rank <= y.n - {need}"
    )
    return pairs.select(F.expr("least(x.sid, y.sid)").alias("a"), F.expr("greatest(x.sid, y.sid)").alias("b")).distinct()

"""The prefix trie of conversations from vertical bitmaps.

Conversations in order of their ids are dealt to shards of about a thousand. A shard indexes (position, turn) to the bitset of its conversations that have
that turn there; depth first, a node's bitset is cut with the postings of the next position, which gives its children, its members by popcount and those
that end there. Nodes of all shards meet by the hash of their prefix, one row a shard and node, so a node that all conversations share is no hot group. What a
node says about its subtree is a sum over its members, so a second look at the bitsets gives it without walking the trie: each node is owned by its smallest member, a
conversation owns the end of its path, and of the bytes that a member holds from a node on those before its own part are the ones that sharing saves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixloom.llm.common import join_to_one, release, stored
from helixloom.llm.repair import CRC

#: Conversations and turns of a shard; a longer conversation is a shard by itself, written in parts of as many turns.
SHARD, SHARD_TURNS = 1024, 1 << 16
ROOT = bytes(16)
#: Conversations of a family that begin alike, and one more than the most turns that they share.
FAMILY, MOST_SHARED = 5, 9


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn_id, n_bytes: turns by number (null first; ties by role and text), known by 128 bits of SHA-256 over role and text. A null role or text is
    empty; rows without conv_id take no part; repeated rows are turns of their own."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    name = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), 1, 32))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), name.alias("turn_id"), F.octet_length("text").cast("long").alias("n_bytes"))


def shared_starts(turns: DataFrame) -> DataFrame:
    """numbered turns rebuilt: conversation c takes the first h = crc32(c) % 9 turns of c - c % 5 (the remainder is never negative), then its own after its first h. A row of pos 0 stands for each
    conversation, also one that has no turn left."""
    light = stored(turns, "turns")
    heads = light.where(f"pmod(conv_id, {FAMILY}) = 0 and pos < {MOST_SHARED}").groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.collect_list(F.struct("pos", "turn_id", "n_bytes")).alias("head"))
    many = light.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).alias("h")
    known = many.select("conv_id", "n", h, F.expr(f"try_subtract(conv_id, pmod(conv_id, {FAMILY}))").alias("base")).join(heads, "base", "left")
    known = stored(known.select("conv_id", "n", "h", F.filter(F.coalesce("head", F.expr("array()").cast("array<struct<pos:bigint,turn_id:binary,n_bytes:bigint>>")), lambda t: t["pos"] <= F.col("h")).alias("head")), "starts")
    start = known.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.turn_id", "t.n_bytes")
    shifts = known.select("conv_id", "n", "h", F.size("head").alias("shift"))
    own = join_to_one(light, shifts, ["conv_id"], "n", light.count()).where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("shift")).alias("pos"), "turn_id", "n_bytes")
    return start.unionByName(own).unionByName(_markers(known))


def _markers(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn_id"), F.lit(0).cast("long").alias("n_bytes"))


def child_hash(parent: bytes, turn: bytes) -> bytes:
    return hashlib.sha256(parent + turn).digest()[:16]


class Shard:
    """Conversations with their turns, and the nodes that they make."""

    def __init__(self):
        self.convs, self.turns, self.sizes, self.held = [], [], [], 0

    def add(self, conv: int, turns: list[bytes], sizes: list[int]) -> None:
        self.convs.append(conv)
        self.turns.append(turns)
        self.sizes.append(sizes)
        self.held += len(turns)

    def nodes(self):
        """(hash, parent, depth, bytes above, own bytes, members, ends): the bitsets have a bit for each conversation of the shard."""
        postings: dict[tuple[int, bytes], int] = {}
        ended: dict[int, int] = {}
        for i, turns in enumerate(self.turns):
            bit = 1 << i
            for d, t in enumerate(turns):
                postings[d, t] = postings.get((d, t), 0) | bit
            ended[len(turns)] = ended.get(len(turns), 0) | bit
        stack = [(ROOT, b"", 0, 0, 0, (1 << len(self.convs)) - 1)]
        while stack:
            name, parent, depth, above, size, members = stack.pop()
            ends = members & ended.get(depth, 0)
            yield name, parent, depth, above, size, members, ends
            rest = members & ~ends
            while rest:
                i = (rest & -rest).bit_length() - 1
                turn = self.turns[i][depth]
                child = members & postings[depth, turn]
                rest &= ~child
                stack.append((child_hash(name, turn), name, depth + 1, above + size, self.sizes[i][depth], child))


_LONG, _LONGS, _BITS = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary())
PACKED = "shard long, last boolean, convs array<long>, totals array<long>, hash binary, parent binary, depth array<long>, above array<long>, size array<long>, low array<long>, members array<binary>, ends array<binary>"
_PACKED = (_LONG, pa.bool_(), _LONGS, _LONGS, pa.binary(), pa.binary(), _LONGS, _LONGS, _LONGS, _LONGS, _BITS, _BITS)


def _bytes(bits: int) -> bytes:
    return bits.to_bytes((bits.bit_length() + 7) // 8, "little")


def _packed(convs: list[int], totals: list[int], nodes: list[tuple], last: bool = True) -> pa.RecordBatch:
    """One row; bitsets begin at their lowest member, so those of a single one are a byte."""
    low = [(n[5] & -n[5]).bit_length() - 1 for n in nodes]
    row = (
        convs[0], last, convs, totals if last else [], b"".join(n[0] for n in nodes), b"".join(n[1] or ROOT for n in nodes), [n[2] for n in nodes], [n[3] for n in nodes], [n[4] for n in nodes],
        low, [_bytes(n[5] >> x) for n, x in zip(nodes, low)], [_bytes(n[6] >> x) for n, x in zip(nodes, low)],
    )
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _PACKED)], names=[x.split()[0] for x in PACKED.split(", ")])


def _parts(batches):
    """(conv_id, turns, sizes, is the first part, is the last part) from rows sorted by conversation and position: longer conversations come in parts."""
    now, turns, sizes, first = None, [], [], True
    for batch in batches:
        conv, pos, turn, size = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "pos", "turn_id", "n_bytes"))
        for c, p, t, s in zip(conv, pos, turn, size):
            if c != now:
                if now is not None:
                    yield now, turns, sizes, first, True
                now, turns, sizes, first = c, [], [], True
            if p == 0:
                continue
            if len(turns) >= SHARD_TURNS:
                yield now, turns, sizes, first, False
                turns, sizes, first = [], [], False
            turns.append(t)
            sizes.append(s)
    if now is not None:
        yield now, turns, sizes, first, True


def _shards(batches):
    shard = Shard()

    def done():
        return _packed(shard.convs, [sum(s) for s in shard.sizes], list(shard.nodes()))

    long: tuple | None = None  # name, parent, depth, bytes above, own bytes of the last node of a long conversation
    for conv, turns, sizes, first, last in _parts(batches):
        if not (first and last):
            if first and shard.convs:
                yield done()
                shard = Shard()
            name, parent, depth, above, size = long or (ROOT, b"", 0, 0, 0)
            nodes = [(name, parent, depth, above, size, 1, 0)] if first else []
            for t, s in zip(turns, sizes):
                name, parent, depth, above, size = child_hash(name, t), name, depth + 1, above + size, s
                nodes.append((name, parent, depth, above, size, 1, 0))
            if last:
                nodes[-1] = (*nodes[-1][:6], 1)
            yield _packed([conv], [above + size], nodes, last)
            long = None if last else (name, parent, depth, above, size)
            continue
        shard.add(conv, turns, sizes)
        if len(shard.convs) >= SHARD or shard.held >= SHARD_TURNS:
            yield done()
            shard = Shard()
    if shard.convs:
        yield done()
    release()


NODES = "hash binary, parent binary, depth long, above long, size long, conv_id long, n_convs long, n_ends long"


def _rows(batch):
    names = [x.split()[0] for x in PACKED.split(", ")]
    for row in zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]):
        yield dict(zip(names, row))


def _names(packed: bytes) -> list[bytes]:
    return [packed[i : i + 16] for i in range(0, len(packed), 16)]


def _explode(batches):
    for batch in batches:
        for r in _rows(batch):
            popcount = lambda x: [int.from_bytes(b, "little").bit_count() for b in r[x]]  # noqa: B023, E731
            columns = (_names(r["hash"]), _names(r["parent"]), r["depth"], r["above"], r["size"], [r["convs"][x] for x in r["low"]], popcount("members"), popcount("ends"))
            kinds = (pa.binary(), pa.binary(), *[_LONG] * 6)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in NODES.split(", ")])


def _members(low: int, bits: bytes) -> np.ndarray:
    return low + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))


def _end_lists(batches):
    for batch in batches:
        for r in _rows(batch):
            convs = np.array(r["convs"], dtype=np.int64)
            found = [(h, r["shard"], convs[_members(x, e)].tolist()) for h, x, e in zip(_names(r["hash"]), r["low"], r["ends"]) if e]
            columns = list(zip(*found)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), _LONG, _LONGS))], names=["hash", "shard", "ids"])


def _hash_ends(batches):
    """Rows come sorted by node and shard, so that ids rise; each list is hashed as it passes."""

    def rows():
        now, sha = None, None
        for batch in batches:
            for name, ids in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("hash", "ids"))):
                text = ",".join(map(str, ids)).encode()
                if name == now:
                    sha.update(b"," + text)
                    continue
                if now is not None:
                    yield now, sha.hexdigest()
                now, sha = name, hashlib.sha256(text)
        if now is not None:
            yield now, sha.hexdigest()

    held = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.binary()), pa.array([h[1] for h in held], pa.string())], names=["hash", "ends_sha256"])

    for row in rows():
        held.append(row)
        if len(held) >= 10_000:
            yield batch()
            held = []
    if held:
        yield batch()


def _subtrees(batches):
    """hash, n_leaves, saved: what a shard's members add to their nodes. ``own`` holds for each conversation the bytes before the part that it owns, and whether a leaf is its own."""
    for batch in batches:
        for r, own in zip(_rows(batch), batch.column(batch.schema.get_field_index("own")).to_pylist()):
            before, leaf = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            for o in own:
                before[o["local"]], leaf[o["local"]] = o["before"], o["leaf"]
            out = []
            for name, above, low, bits in zip(_names(r["hash"]), r["above"], r["low"], r["members"]):
                if len(bits) == 1 and bits[0] == 1:
                    leaves, saved = int(leaf[low]), max(0, int(before[low]) - above)
                else:
                    i = _members(low, bits)
                    leaves, saved = int(leaf[i].sum()), int(np.maximum(before[i] - above, 0).sum())
                if leaves or saved:
                    out.append((name, leaves, saved))
            columns = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), _LONG, _LONG))], names=["hash", "n_leaves", "saved"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each distinct sequence of first turns, from the empty one (depth 0).

    turns: conv_id, pos, turn_id, n_bytes, as numbered_turns gives them; a row of pos 0 stands for a conversation that may have no turns. conv_id is a node's smallest member and
    parent_conv_id its parent's (root: null); n_leaves counts the childless nodes in its subtree, saved_tokens sums (n_convs - 1) * n_bytes of the last turn over the subtree;
    ends_sha256 is the hash of the ids that end at the node, rising and joined by commas. Members that begin alike share nodes whatever their number; without conversations there are no rows. A conversation of any length is read as
    a stream; the list of a node's ends is hashed as a stream, as SHA-256 can only be computed in order.
    """
    rows = turns.select("conv_id", "pos", "turn_id", "n_bytes").repartitionByRange("conv_id").sortWithinPartitions("conv_id", "pos")
    packed = stored(rows.mapInArrow(_shards, PACKED), "shards")
    merged = packed.mapInArrow(_explode, NODES).groupBy("hash", "parent", "depth", "above", "size")
    nodes = stored(merged.agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_ends").alias("n_ends")), "nodes")

    # each conversation's own part: the nodes of which it is the smallest member
    owners = nodes.groupBy("conv_id").agg(F.min("above").alias("before"), F.max(F.when(F.col("n_ends") == F.col("n_convs"), 1).otherwise(0)).alias("leaf"))
    # the bytes above a node are those before it, so the least of a conversation's nodes is where its own part begins
    convs = packed.where("last").select("shard", F.posexplode(F.arrays_zip("convs", "totals")).alias("local", "c")).select("shard", "local", F.col("c.convs").alias("conv_id"), F.col("c.totals").alias("total"))
    facts = F.struct("local", F.coalesce("before", "total").alias("before"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    own = convs.join(owners, "conv_id", "left").groupBy("shard").agg(F.collect_list(facts).alias("own"))
    parts = packed.groupBy("shard").agg(F.count(F.lit(1)).alias("parts"))
    total = packed.count()
    sums = join_to_one(packed, own.join(parts, "shard"), ["shard"], "parts", total).mapInArrow(_subtrees, "hash binary, n_leaves long, saved long")
    sums = sums.groupBy("hash").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))

    lists = packed.mapInArrow(_end_lists, "hash binary, shard long, ids array<long>").repartition("hash").sortWithinPartitions("hash", "shard")
    ends = lists.mapInArrow(_hash_ends, "hash binary, ends_sha256 string")

    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("hash")).agg(F.count(F.lit(1)).alias("n_children"))
    known = stored(nodes.join(children, "hash", "left").select(nodes["*"], F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children")), "nodes")
    parents = known.where("n_children > 0").select(F.col("hash").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("met"))
    below = join_to_one(known.where("depth > 0"), parents, ["parent"], "met", known.count()).drop("met")
    every = below.unionByName(known.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    every = every.join(sums, "hash", "left").join(ends, "hash", "left")
    return every.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


ORACLE = f"""
with own as (
  select conv_id, conv_id::varchar as key, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as ts
  from conversations where conv_id is not null group by conv_id),
cut as (select *, {CRC} % 9 as h, conv_id - ((conv_id % 5) + 5) % 5 as base from own),
built as (select c.conv_id, list_concat(coalesce(b.ts[1:c.h], []), c.ts[c.h + 1:]) as ts from cut c left join own b on b.conv_id = c.base),
paths as (
  select conv_id, d, len(ts) as n, coalesce(strlen(ts[d].t), 0) as bytes,
    sha256(coalesce(list_aggregate(list_transform(ts[1:d], lambda x: length(x.r)::varchar || ':' || x.r || length(x.t)::varchar || ':' || x.t), 'string_agg', ''), '')) || d as prefix
  from built, unnest(range(0, len(ts) + 1)) as u(d)),
linked as (select *, lag(prefix) over (partition by conv_id order by d) as parent from paths),
nodes as (
  select prefix, any_value(parent) as parent, d, any_value(bytes) as bytes, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '')) as ends_sha256
  from linked group by prefix, d),
children as (select parent, count(*) as n from nodes where parent is not null group by parent),
subtrees as (
  select p.prefix, sum((v.n_convs - 1) * v.bytes) as saved, count(*) filter (c.n is null) as leaves
  from nodes v join linked p on p.conv_id = v.conv_id and p.d <= v.d left join children c on c.parent = v.prefix group by p.prefix)
select n.conv_id, n.d::bigint as depth, p.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, coalesce(c.n, 0)::bigint as n_children, s.leaves::bigint as n_leaves,
  s.saved::bigint as saved_tokens, n.ends_sha256
from nodes n left join nodes p on p.prefix = n.parent left join children c on c.parent = n.prefix join subtrees s on s.prefix = n.prefix
"""

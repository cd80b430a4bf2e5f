"""Repairing the structure of conversations by a persistent audit DP.

The roles of a conversation must follow each other as in ``(s?(ua)+)?``. A dynamic program over the rows finds the cheapest edits; its cells do
not hold their edit strings but nodes of one shared tree of edit prefixes. A node knows its ancestors 1, 2, 4, .. rows back and a rolling hash of its whole prefix, so that
two equally cheap cells are compared by a search for their longest common prefix. Rows become one letter each, in blocks of bounded length that are
solved apart for every state at their start and then joined by the same program, so no task holds a long conversation's texts.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixloom.llm.common import release, slices, stored

#: Rows of a block that is solved by itself.
BLOCK = 4096
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: Roles so far: none, a system turn, ends with a user turn, ends with an assistant turn. The role that an edit writes follows from the state.
NONE, SYSTEM, USER, ASSISTANT = range(4)
WRITES = {NONE: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
AFTER = {"user": USER, "assistant": ASSISTANT}
#: What a kept role initial leads to.
KEPT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: A row's letter: its role initial (x: any other), a capital where it is truncated, d where it must go.
CODES = "suaxSUAXd"


def _row_steps(code: str) -> dict[int, list[tuple[int, int, str]]]:
    """For each state after a row the (state before, cost, edits) that lead there: insertions, then the row's own edit."""
    more = TRUNCATED_COST if code.isupper() else 0
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in range(4):
        state = before
        for inserts in range(3):
            ways = [(state, DELETE_COST, DELETE)]
            if code != "d":
                ways.append((AFTER[WRITES[state]], REROLE_COST + more, REROLE))
                if (state, code.lower()) in KEPT:
                    ways.append((KEPT[state, code.lower()], more, KEEP))
            for after, cost, edit in ways:
                found = (cost + inserts * INSERT_COST, INSERT * inserts + edit)
                best[before, after] = min(best.get((before, after), found), found)
            state = AFTER[WRITES[state]]
    return {q: [(p, *best[p, q]) for p in range(4) if (p, q) in best] for q in range(4)}


ROW_STEPS = {c: _row_steps(c) for c in CODES}
#: Insertions that end a conversation well, by state.
ENDINGS = {NONE: "", SYSTEM: INSERT * 2, USER: INSERT, ASSISTANT: ""}


class Audits:
    """Edit prefixes that share what they have in common. Node 0 is the empty one; each other node adds a piece to its parent.

    Pieces of a program's step are prefix-free, so two prefixes of as many steps differ at a letter of the first pieces that differ.
    """

    PRIME, BASE = (1 << 61) - 1, 1_000_003

    def __init__(self):
        self.pieces, self.up, self.hash, self.known = [""], [()], [0], {}

    def add(self, parent: int, piece: str) -> int:
        known = self.known.get(piece)
        if known is None:
            h = 0
            for c in piece:
                h = (h * self.BASE + ord(c)) % self.PRIME
            known = (h, pow(self.BASE, len(piece), self.PRIME))
            if len(piece) < 8:
                self.known[piece] = known
        node = len(self.pieces)
        self.pieces.append(piece)
        self.hash.append((self.hash[parent] * known[1] + known[0]) % self.PRIME)
        up = [parent]
        while len(self.up[up[-1]]) >= len(up):  # the 2^k-th ancestor has one 2^k above it
            up.append(self.up[up[-1]][len(up) - 1])
        self.up.append(tuple(up))
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two prefixes of as many steps are equal: by hash, then verified down to the node they share."""
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.pieces[a] != self.pieces[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def earlier(self, a: int, b: int) -> bool:
        """Whether a's string is the smaller one; both have as many steps."""
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[a]) and not self.same(self.up[a][k], self.up[b][k]):
                a, b = self.up[a][k], self.up[b][k]
        return self.pieces[a] < self.pieces[b]

    def advance(self, cells: dict[int, tuple[int, int]], steps: dict[int, list[tuple[int, int, str]]]) -> dict[int, tuple[int, int]]:
        """cells: state -> (cost, node). The cells one step on."""
        out = {}
        for q, ways in steps.items():
            best = None
            for p, cost, piece in ways:
                if p in cells:
                    c = cells[p][0] + cost
                    if best is None or c < best[0] or (c == best[0] and self.earlier(cells[p][1], best[1])):
                        best = (c, cells[p][1], piece)
            if best is not None:
                out[q] = (best[0], self.add(best[1], best[2]))
        return out

    def trail(self, node: int) -> list[str]:
        """The pieces from the first to the node's."""
        out = []
        while node:
            out.append(self.pieces[node])
            node = self.up[node][0]
        return out[::-1]


def solve_block(codes: str, starts) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, edits) of a block of rows for each given state before it."""
    out = []
    for start in starts:
        audits, cells = Audits(), {start: (0, 0)}
        for c in codes:
            cells = audits.advance(cells, ROW_STEPS[c])
        out += [(start, q, cost, "".join(audits.trail(node))) for q, (cost, node) in sorted(cells.items())]
    return out


def join_blocks(blocks) -> tuple[int, list[str]]:
    """The cost of a whole conversation and the edits of each block; blocks: (state before, state after, cost, edits) rows of each, in order."""
    audits, cells = Audits(), {NONE: (0, 0)}
    for rows in blocks:
        steps: dict[int, list[tuple[int, int, str]]] = {}
        for before, after, cost, edits in rows:
            steps.setdefault(after, []).append((before, cost, edits))
        cells = audits.advance(cells, steps)
    best = None
    for q, (cost, node) in cells.items():
        c = cost + INSERT_COST * len(ENDINGS[q])
        if best is None or c < best[0] or (c == best[0] and audits.earlier(node, best[1])):
            best = (c, node, q)
    pieces = audits.trail(best[1])
    pieces[-1] += ENDINGS[best[2]]
    return best[0], pieces


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, alive, place: conversations with faults planted by crc32(conv_id:turn) % 20; dropped rows stay, not alive, so that their
    conversation is known. Nulls count as one space; place orders rows of one turn (role, text, then the copy)."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = (F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20).alias("harm")
    rows = conversations.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), harm)
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("*", copies)
    return rows.select(
        "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("harm") != 0).alias("alive"),
        F.struct("role", "text", "copy").alias("place"),
    )


def _features(rows: DataFrame) -> DataFrame:
    """Rows with their place in the conversation, fault and letter."""
    own = Window.partitionBy("conv_id", "alive")
    order = own.orderBy("turn", "place")
    initial = F.substring("role", 1, 1)
    f = rows.select(
        "conv_id", "turn", "role", "text", "alive", (F.row_number().over(order) - 1).cast("long").alias("pos"), F.lag("turn").over(order).alias("turn_before"),
        F.concat(F.lag(initial).over(order), initial).alias("pair"),
    )
    seen = F.row_number().over(Window.partitionBy("conv_id", "alive", "role", "text").orderBy("pos")) > 1
    body = F.btrim("text", F.lit(BLANKS))
    fault = F.when(body == "", "blank").when(seen, "duplicate").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated")
    f = f.select("*", fault.alias("fault"))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    kept = lambda c: F.when(F.col("alive"), F.col(c)).alias(c)
    return f.select("conv_id", "alive", "pos", kept("turn"), kept("turn_before"), kept("pair"), kept("role"), kept("text"), kept("fault"), F.when(F.col("alive"), code).alias("code"))


def _totals(f: DataFrame) -> DataFrame:
    many = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    wide = lambda x: x.cast("decimal(38,0)")
    first = F.col("turn").isNotNull() & (F.col("turn_before").isNull() | (F.col("turn") != F.col("turn_before")))
    gaps = (wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(many(first))).try_cast("long")
    return f.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).alias("gaps"), *[many(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")],
        many(F.col("pair").isNotNull() & ~F.col("pair").isin("su", "ua", "au")).alias("illegal"),
    )


SOLVED = "conv_id long, block long, before int, after int, cost long, edits string"
EDITS = "conv_id long, block long, cost long, edits string"
REPAIRED = "conv_id long, cost long, audit string, repaired_sha256 string, n_repaired long"


def _columns(batch, *names):
    return zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names])


def _frames(rows, schema: str, most: int = 4096, most_bytes: int = 8 << 20):
    """Tuples as Arrow batches of bounded size."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    texts = [i for i, f in enumerate(fields) if f[1] == "string"]

    def batch(part):
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*part), fields)], names=[n for n, _ in fields])

    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(r[i] or "") for i in texts)
        if len(held) >= most or size >= most_bytes:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def _solve(batches):
    def rows():
        for batch in batches:
            for conv_id, block, codes in _columns(batch, "conv_id", "block", "codes"):
                for solved in solve_block(codes, range(4) if block else (NONE,)):
                    yield conv_id, block, *solved

    yield from _frames(rows(), SOLVED)


def _join(batches):
    """Rows come sorted by conversation and block."""

    def rows():
        now, blocks = None, []

        def done():
            cost, pieces = join_blocks(blocks)
            for block, edits in enumerate(pieces):
                yield now[0], block, cost, edits

        for batch in batches:
            for conv_id, block, *solved in _columns(batch, "conv_id", "block", "before", "after", "cost", "edits"):
                if now != (conv_id,):
                    if now is not None:
                        yield from done()
                    now, blocks = (conv_id,), []
                if block == len(blocks):
                    blocks.append([])
                blocks[block].append(tuple(solved))
        if now is not None:
            yield from done()

    yield from _frames(rows(), EDITS)


class Repair:
    """One conversation written out: turns come in order and are forgotten once hashed."""

    def __init__(self, conv_id):
        self.conv_id, self.cost, self.audit, self.state, self.sha, self.lines = conv_id, 0, [], NONE, hashlib.sha256(), 0
        self.edits = iter("")

    def write(self, role: str, text: str) -> None:
        if self.lines:
            self.sha.update(b"\n")
        self.sha.update(f"{role}:{text}".encode())
        self.lines += 1

    def made(self) -> None:
        role = WRITES[self.state]
        self.write(role, "")
        self.state = AFTER[role]

    def block(self, cost: int, edits: str) -> None:
        self.rest()
        self.cost, self.edits = cost, iter(edits)
        self.audit.append(edits)

    def turn(self, role: str, text: str) -> None:
        edit = next(self.edits)
        while edit == INSERT:
            self.made()
            edit = next(self.edits)
        if edit == KEEP:
            self.state = KEPT[self.state, role[:1]]
            self.write(role, text)
        elif edit == REROLE:
            new = WRITES[self.state]
            self.write(new, text)
            self.state = AFTER[new]

    def rest(self) -> None:
        for _ in self.edits:  # insertions behind the last turn
            self.made()

    def row(self) -> tuple:
        self.rest()
        return self.conv_id, self.cost, "".join(self.audit), self.sha.hexdigest(), self.lines


def _write(batches):
    """Rows come sorted by conversation and block, a block's edits before its turns."""

    def rows():
        now = None
        for batch in slices(batches):
            for conv_id, role, text, cost, edits in _columns(batch, "conv_id", "role", "text", "cost", "edits"):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        yield now.row()
                    now = Repair(conv_id)
                if edits is not None:
                    now.block(cost, edits)
                else:
                    now.turn(role, text)
        if now is not None:
            yield now.row()
        release()

    yield from _frames(rows(), REPAIRED)


def repair_conversations(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, n_repaired: one row for every conversation.

    rows: conv_id, turn, role, text and, where they are known, alive (false: the row only tells that its conversation exists) and place (the order of rows of one turn; without it role and
    text); other columns are ignored. A null role or text counts as one space. Turns go by number, nulls first; all ties stay. Rows with a null conv_id are one conversation of a null id.
    A row's fault is the first of blank, duplicate (its role and text stand earlier) and truncated. The audit holds the initials of the cheapest edits (Keep, Rerole, Delete, Insert), the least of equals; n_repaired
    counts the turns that it leaves, of whose ``role:text`` lines repaired_sha256 is the hash. Conversations without rows have zeros, an empty audit and the hash of nothing. An empty table gives no rows.
    A conversation of any length is solved in blocks of rows and hashed as a stream; only its audit, a letter or so a row, is held as a whole.
    """
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    have = {c.lower() for c in rows.columns}
    alive = F.coalesce("alive", F.lit(True)) if "alive" in have else F.lit(True)
    place = F.col("place") if "place" in have else F.struct(or_space("role"), or_space("text"))
    known = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", or_space("role"), or_space("text"), alive.alias("alive"), place.alias("place"))
    f = stored(_features(known), "turns")
    turns = f.where("alive").withColumn("block", F.expr(f"pos div {block}"))
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "")
    blocks = turns.groupBy("conv_id", "block").agg(letters.alias("codes"))
    solved = blocks.mapInArrow(_solve, SOLVED)
    edits = solved.repartition("conv_id").sortWithinPartitions("conv_id", "block", "before", "after").mapInArrow(_join, EDITS)
    none = lambda kind: F.lit(None).cast(kind)
    lines = turns.select("conv_id", "block", "pos", "role", "text", none("long").alias("cost"), none("string").alias("edits"))
    heads = edits.select("conv_id", "block", F.lit(-1).cast("long").alias("pos"), none("string").alias("role"), none("string").alias("text"), "cost", "edits")
    stream = lines.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "block", "pos")
    done = stream.mapInArrow(_write, REPAIRED).withColumnRenamed("conv_id", "own")
    totals = _totals(f)
    both = totals.join(done, totals["conv_id"].eqNullSafe(done["own"]), "left")
    return both.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.coalesce("cost", F.lit(0)).cast("long").alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"), F.coalesce("n_repaired", F.lit(0)).cast("long").alias("n_repaired"),
    )


CRC = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(key, ''), lambda x: ascii(x)::bigint)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))))"""

ORACLE = f"""
with keyed as (
  select conv_id, turn, coalesce(role, ' ') as role0, coalesce(text, ' ') as text0, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
harmed as (select *, {CRC} % 20 as harm from keyed),
damaged as (
  select conv_id, turn, role0, text0, copy, case when harm = 4 then 'user' else role0 end as role,
    case harm when 1 then '' when 2 then translate(text0, '.!?', '') else text0 end as text
  from harmed, unnest(case when harm = 3 then [0, 1] else [0] end) as u(copy) where harm <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role0, text0, copy) as pos from damaged),
judged as (
  select *, left(role, 1) as ini, lag(left(role, 1)) over (partition by conv_id order by pos) as before, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as body,
    row_number() over (partition by conv_id, role, text order by pos) > 1 as again
  from placed),
faults as (select *, case when body = '' then 'blank' when again then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from judged),
moves(p, pre, mid, said) as (values
  (0, '', 0, ''), (0, 'I', 2, chr(10) || 'user:'), (0, 'II', 3, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, '', 1, ''), (1, 'I', 2, chr(10) || 'user:'), (1, 'II', 3, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, '', 2, ''), (2, 'I', 3, chr(10) || 'assistant:'), (2, 'II', 2, chr(10) || 'assistant:' || chr(10) || 'user:'),
  (3, '', 3, ''), (3, 'I', 2, chr(10) || 'user:'), (3, 'II', 3, chr(10) || 'user:' || chr(10) || 'assistant:')),
edits(mid, edit, q, need, becomes, price) as (values
  (0, 'D', 0, '', '', 4), (1, 'D', 1, '', '', 4), (2, 'D', 2, '', '', 4), (3, 'D', 3, '', '', 4),
  (0, 'R', 2, '', 'user', 3), (1, 'R', 2, '', 'user', 3), (3, 'R', 2, '', 'user', 3), (2, 'R', 3, '', 'assistant', 3),
  (0, 'K', 1, 's', '', 0), (0, 'K', 2, 'u', '', 0), (1, 'K', 2, 'u', '', 0), (3, 'K', 2, 'u', '', 0), (2, 'K', 3, 'a', '', 0)),
ways as (select list({{'p': p, 'q': q, 'edit': edit, 'need': need, 'becomes': becomes, 'said': said, 'piece': pre || edit, 'price': price + 3 * len(pre)}}) as ways from moves join edits using (mid)),
lists as (
  select conv_id, list({{'ini': ini, 'role': role, 'text': text, 'fault': fault, 'v': null::struct(c bigint, a varchar, r varchar)[]}} order by pos) as rows,
    (max(turn) - min(turn) + 1 - count(distinct turn))::bigint as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before is not null and before || ini not in ('su', 'ua', 'au')) as illegal
  from faults group by conv_id),
solved as (
  select l.*, list_reduce(list_concat([{{'ini': '', 'role': '', 'text': '', 'fault': '', 'v': [{{'c': 0::bigint, 'a': '', 'r': ''}}, {{'c': 1000000000::bigint, 'a': '', 'r': ''}}, {{'c': 1000000000::bigint, 'a': '', 'r': ''}}, {{'c': 1000000000::bigint, 'a': '', 'r': ''}}]}}], rows),
    lambda x, y: {{'ini': '', 'role': '', 'text': '', 'fault': '', 'v': list_transform([0, 1, 2, 3], lambda q: list_min(list_transform(
      list_filter(ways, lambda t: t.q = q and (t.need = '' or t.need = y.ini) and (t.edit = 'D' or y.fault not in ('blank', 'duplicate'))),
      lambda t: {{'c': x.v[t.p + 1].c + t.price + case when t.edit <> 'D' and y.fault = 'truncated' then 3 else 0 end, 'a': x.v[t.p + 1].a || t.piece,
        'r': x.v[t.p + 1].r || t.said || case t.edit when 'D' then '' when 'K' then chr(10) || y.role || ':' || y.text else chr(10) || t.becomes || ':' || y.text end}})))}}).v as v
  from lists l, ways),
ended as (
  select *, list_min([v[1], v[4], {{'c': v[3].c + 3, 'a': v[3].a || 'I', 'r': v[3].r || chr(10) || 'assistant:'}}, {{'c': v[2].c + 6, 'a': v[2].a || 'II', 'r': v[2].r || chr(10) || 'user:' || chr(10) || 'assistant:'}}]) as best
  from solved)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(best.r[2:], '')) as repaired_sha256,
  coalesce(length(regexp_replace(best.a, 'D', '', 'g')), 0)::bigint as n_repaired
from (select distinct conv_id from conversations) c left join ended e on c.conv_id is not distinct from e.conv_id
"""

"""Chat formatting by cumulative-snapshot collapse (DataFrame functions only).

A chat log often holds the same conversation many times, each snapshot one turn longer. Rolling hashes of
the turn prefixes find the conversations that are a proper prefix of a longer one; an anti-join drops
these, copies of one conversation keep the smallest id, and only what is left is joined back to its turns and rendered. So the texts
of a log of cumulative snapshots move as often as turns are logged, and not again as whole conversations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixloom.llm.common import stored

TURN_OPEN, TURN_MIDDLE, TURN_CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _turn_hash(seed: int):
    parts = [F.lit(seed), F.col("pos")]
    for c in ("role", "text"):
        parts += [F.col(c).isNull(), F.coalesce(F.col(c), F.lit(""))]
    return F.xxhash64(*parts)


def _owned(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, own: two hashes that tell a row without conv_id from all others, null where there is one."""
    alone = [F.when(F.col("conv_id").isNull(), F.xxhash64(F.lit(seed), "turn", F.col("role").isNull(), "role", F.col("text").isNull(), "text")) for seed in (1, 2)]
    return conversations.select("conv_id", "turn", "role", "text", F.struct(*[h.alias(f"h{i}") for i, h in enumerate(alone)]).alias("own"))


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """One row for each distinct turn with ``pos`` (from 1), ``n`` turns in all, and the 128-bit hash of the
    prefix that ends with it. The hash is a running exclusive or of hashes that hold the position. A row without conv_id is a conversation
    of its own, which ``own`` tells apart."""
    turn = _owned(conversations)
    by = Window.partitionBy("conv_id", "own").orderBy("turn", "role", "text")
    ranked = turn.select("*", F.dense_rank().over(by).alias("pos"), F.row_number().over(by).alias("rn"))
    ranked = ranked.select("*", F.lag("pos").over(by).alias("before"))
    ranked = ranked.where("before is null or pos > before")
    upto = Window.partitionBy("conv_id", "own").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.select(
        "conv_id", "own", "pos", "role", "text",
        F.bit_xor(_turn_hash(1)).over(upto).alias("h1"),
        F.bit_xor(_turn_hash(2)).over(upto).alias("h2"),
        F.max("pos").over(Window.partitionBy("conv_id", "own")).alias("n"),
    )


def format_chats(
    conversations: DataFrame, turn_open: str = TURN_OPEN, turn_middle: str = TURN_MIDDLE, turn_close: str = TURN_CLOSE
) -> DataFrame:
    """conv_id, n_turns, copies, chat: the maximal conversations, rendered.

    Input columns conv_id, turn, role, text; others are ignored whatever their names. Turns are ordered by
    (turn, role, text), nulls first; a row repeated exactly counts once; ties in ``turn`` all stay. Rows
    whose conv_id is null are conversations of one turn each, with a null id (repeated exactly they count once). A null role or text differs from an empty
    one when conversations are compared and is rendered empty. Of equal conversations the smallest id
    stays (null last), with the number of copies. An empty table gives no rows.
    """
    turns = stored(turn_prefixes(conversations).select("conv_id", "own", "n", F.struct("pos", "h1", "h2").alias("key")), "chat-prefixes")
    prefixes = turns.where("key.pos < n").select("key").distinct()
    one = turns.where("key.pos = n").groupBy("key").agg(
        F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "own")).alias("kept"), F.count(F.lit(1)).alias("copies")
    )
    kept = stored(one.join(prefixes, "key", "left_anti").select("kept.conv_id", "kept.own", "copies"), "chat-kept")
    line = F.struct("turn", "role", "text")
    blank = lambda c: F.coalesce(c, F.lit(""))
    piece = lambda x: F.concat(F.lit(turn_open), blank(x["role"]), F.lit(turn_middle), blank(x["text"]), F.lit(turn_close))

    def rendered(key: str, rows: str) -> DataFrame:
        told = _owned(conversations).where(rows).join(kept.where(rows).select(key, "copies"), key)
        told = told.groupBy(key).agg(F.first("copies").alias("copies"), F.sort_array(F.collect_set(line)).alias("turns"))
        conv_id = F.col("conv_id") if key == "conv_id" else F.lit(None).cast(conversations.schema["conv_id"].dataType)
        return told.select(conv_id.alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), "copies", F.array_join(F.transform("turns", piece), "").alias("chat"))

    return rendered("conv_id", "conv_id is not null").unionByName(rendered("own", "conv_id is null"))


ORACLE = """
with turns as (select distinct conv_id, turn, role, text from conversations),
whole as (
  select conv_id, list({'role': role, 'text': text} order by turn nulls first, role nulls first, text nulls first) as ts
  from turns group by conv_id, case when conv_id is null then {'turn': turn, 'role': role, 'text': text} end),
one as (select min(conv_id) as conv_id, count(*) as copies, ts from whole group by ts),
prefixes as (select distinct ts[1:i] as ts from one, unnest(range(1, len(ts))) as u(i))
select o.conv_id, len(o.ts)::bigint as n_turns, o.copies::bigint as copies,
  list_aggregate(list_transform(o.ts, lambda t: '<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '')
    || '<|im_end|>' || chr(10)), 'string_agg', '') as chat
from one o anti join prefixes p on o.ts = p.ts
"""

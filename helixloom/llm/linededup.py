"""Line dedup by winnowing over line hashes (DataFrame functions only).

Each text is a row of lines. A run of lines is repeated if an equal run stands earlier and holds ``least_chars`` characters in all; it may have any number
of lines. Every such run is the union of the shortest stretches in it that hold as many characters, counted on from one of its lines or back from one: these
stretches are the windows, at most two for each line and each of at most ``least_chars`` lines that have characters. (Between two lines that are long enough alone, empty lines belong to a window of both.) The line with the smallest hash in a window (the last of equals) is its
fingerprint. Equal windows choose the same line, so a repeated window is guaranteed to meet its earlier copy at a fingerprint. Positions of equal fingerprints are joined, the match is
extended both ways to the ends of their windows, and what later windows cover is deleted, which follows a run on until its lines differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.llm.common import join_to_one, stored, unused

#: A repeated run is deleted if its lines have so many characters in all.
LEAST_CHARS = 40


def _windows(parts: Column, least_chars: int) -> Column:
    """Codes of the windows of parts, the lines with characters: place of the first among them * (least_chars + 2) + their number."""
    unit = least_chars + 2
    begin = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("lines"))

    def most(near: Column) -> Column:
        """How many of the lines near make a window; null if all of them have too few characters."""
        more = lambda acc, x: F.when(acc["chars"] >= least_chars, acc).otherwise(F.struct((acc["chars"] + x["n"]).alias("chars"), (acc["lines"] + 1).alias("lines")))
        return F.aggregate(near, begin, more, lambda acc: F.when(acc["chars"] >= least_chars, acc["lines"]))

    def on(x: Column, i: Column) -> Column:
        start = i.cast("long") * unit
        return F.when(x["n"] >= least_chars, start + 1).otherwise(start + most(F.slice(parts, i + 1, least_chars)))

    def back(x: Column, i: Column) -> Column:
        near = F.reverse(F.slice(parts, F.greatest(i - (least_chars - 2), F.lit(1)), F.least(i + 1, F.lit(least_chars))))
        many = F.when(x["n"] < least_chars, most(near))
        return (i.cast("long") - many + 1) * unit + many

    def pair(x: Column, i: Column) -> Column:
        y = F.get(parts, i + 1)
        return F.when((x["n"] >= least_chars) & (y["n"] >= least_chars) & (y["pos"] > x["pos"] + 1), i.cast("long") * unit + 2)

    return F.array_distinct(F.array_compact(F.concat(F.transform(parts, on), F.transform(parts, back), F.transform(parts, pair))))


def fingerprints(documents: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, text_hash, pos, h, g, before, behind, k1, k2: every window, at the line that is its minimum.

    h and g are two hashes of that line, before and behind say how many lines the window reaches from there, k1 and k2 hash its lines and the gaps between them.
    """
    line = lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), F.length(x).alias("n"))
    parts = F.filter(F.transform(F.split("text", "\n"), line), lambda x: x["n"] > 0)
    base = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), parts.alias("parts"))
    unit = least_chars + 2
    held = F.transform(_windows(F.col("parts"), least_chars), lambda w: F.slice("parts", (F.floor(w / unit) + 1).cast("int"), F.pmod(w, F.lit(unit)).cast("int")))

    def window(el: Column) -> Column:
        first, last = F.get(el, F.lit(0))["pos"], F.element_at(el, -1)["pos"]
        least = F.array_min(F.transform(el, lambda x: F.struct(x["h"].alias("h"), (-x["pos"]).alias("back"), x["g"].alias("g"))))
        return F.struct(
            least.alias("least"), first.alias("first"), last.alias("last"), F.xxhash64(F.transform(el, lambda x: F.struct(x["h"], x["pos"] - first))).alias("k1"),
            F.xxhash64(F.lit(1), F.transform(el, lambda x: x["g"])).alias("k2"),
        )

    out = base.select("doc_id", "text_hash", F.explode(F.transform(held, window)).alias("w")).select("doc_id", "text_hash", "w.*")
    pos = -F.col("least.back")
    return out.select("doc_id", "text_hash", pos.alias("pos"), "least.h", "least.g", (pos - F.col("first")).alias("before"), (F.col("last") - pos).alias("behind"), "k1", "k2")


def repeated_lines(documents: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, text_hash, drop: the sorted places (from 0) of the lines that lie in a repeated run.

    A run is repeated if an equal one stands earlier: in a smaller doc_id, or in the same one at a smaller place.
    """
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    spots = stored(fingerprints(docs, least_chars), "line-fingerprints")
    place = F.struct("doc_id", "pos")

    def repeats(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        """The rows whose keys stand at two places or more, and the first of these."""
        ones = rows.groupBy(*keys).agg(F.min(place).alias("first"), F.max(place).alias("z"), F.count(F.lit(1)).alias("n")).where("first < z").drop("z")
        return join_to_one(rows, stored(ones, name), keys, "n", rows.count()).drop("n")

    met = stored(repeats(spots, ["h", "g"], "line-shared").drop("first"), "line-positions")
    later = repeats(met, ["h", "g", "before", "behind", "k1", "k2"], "line-matches").where(place > F.col("first"))
    spans = later.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct((F.col("pos") - F.col("before")).alias("a"), (F.col("pos") + F.col("behind")).alias("b")))).alias("spans"))
    # in order of their starts the ends of windows never go back, so each adds what lies behind the end of the one before
    start = lambda s, i: F.greatest(s["a"], F.coalesce(F.get("spans", i - 1)["b"] + 1, F.lit(0)))
    added = F.transform("spans", lambda s, i: F.when(start(s, i) <= s["b"], F.sequence(start(s, i), s["b"])).otherwise(F.array().cast("array<int>")))
    return spans.select("doc_id", "text_hash", F.flatten(added).alias("drop"))


def _without(lines: Column, drop: Column) -> Column:
    """The lines whose places are not in the sorted array drop, joined again; linear in both."""
    starts = F.filter(drop, lambda x, i: (i == 0) | (F.get(drop, i - 1) < x - 1))
    ends = F.filter(drop, lambda x, i: (i == F.size(drop) - 1) | (F.get(drop, i + 1) > x + 1))
    kept_from = F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x + 1))
    kept_to = F.concat(starts, F.array(F.size(lines)))
    parts = F.zip_with(kept_from, kept_to, lambda a, b: F.slice(lines, a + 1, b - a))
    return F.array_join(F.flatten(parts), "\n")


def dedup_lines(documents: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The rows of documents with repeated runs of lines deleted from text, and n_lines, n_dropped beside them.

    The first place (smallest doc_id, then place) of every run of lines with ``least_chars`` characters stays. A run begins and ends with lines that have characters: empty lines in it
    must agree and go with it, those at its edges stay. Rows
    with a null doc_id or text stay as they are and are no source of repeats (n_lines 0 for null text); rows repeated exactly are one
    document and get equal texts; rows that share a doc_id but not the text are ordered by place alone. An n_chars column, where
    there is one, is set to the new length. Other columns stay whatever their names, but for own n_lines, n_dropped, which are
    replaced; a text of which all lines go becomes empty; an empty table stays empty.
    """
    names = [c for c in documents.columns if c not in ("n_lines", "n_dropped")]
    own, hash_, gone, body = unused([*names, "n_lines", "n_dropped"], "own_id", "own_hash", "gone", "body")
    d = documents.select(*[F.col(f"`{c}`") for c in names])
    drops = repeated_lines(d, least_chars).select(F.col("doc_id").alias(own), F.col("text_hash").alias(hash_), F.col("drop").alias(gone))
    joined = d.join(drops, (F.col("doc_id") == F.col(own)) & (F.xxhash64("text") == F.col(hash_)), "left")
    lines = F.split("text", "\n")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(_without(lines, F.col(gone)))
    dropped = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    out = joined.select(*[F.col(f"`{c}`") for c in names], n_lines.alias("n_lines"), dropped.alias("n_dropped"), text.alias(body))
    kept = [F.col(body).alias("text") if c == "text" else F.length(body).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names]
    return out.select(*kept, "n_lines", "n_dropped")


ORACLE = """
with lines as (
  select doc_id, u.pos as pos, u.line as line
  from (select distinct doc_id, text, string_split(text, chr(10)) as ls from documents where doc_id is not null and text is not null),
    lateral (select unnest(ls) as line, unnest(range(len(ls))) as pos) as u),
full_lines as (
  select *, sum(length(line)) over (partition by doc_id order by pos) as c1, c1 - length(line) as c0,
    repeat(chr(10), (pos - coalesce(lag(pos) over (partition by doc_id order by pos), 0))::int) as gap
  from lines where length(line) > 0),
ends as (
  select doc_id, pos as a, max(pos) over w as b, max(c1) over w - c0 as chars from full_lines
  window w as (partition by doc_id order by c0 range between current row and 39 following)
  union
  select doc_id, min(pos) over w, pos, c1 - min(c0) over w from full_lines
  window w as (partition by doc_id order by c1 range between 39 preceding and current row)
  union
  select doc_id, a, pos, 80 from (select *, lag(pos) over w as a, lag(length(line)) over w as n from full_lines window w as (partition by doc_id order by pos))
  where n >= 40 and length(line) >= 40 and pos > a + 1),
windows as (
  select e.doc_id, e.a, e.b, string_agg(case when l.pos = e.a then '' else l.gap end || l.line, '' order by l.pos) as run
  from (select distinct doc_id, a, b from ends where chars >= 40) e join full_lines l on l.doc_id = e.doc_id and l.pos between e.a and e.b group by e.doc_id, e.a, e.b),
ranked as (select *, row_number() over (partition by run order by doc_id, a) as rn from windows),
gone as (select distinct doc_id, unnest(range(a, b + 1)) as pos from ranked where rn > 1),
kept as (
  select l.doc_id, count(*) as n_lines, count(g.pos) as n_dropped, coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where g.pos is null), '') as text
  from lines l left join gone g on g.doc_id = l.doc_id and g.pos = l.pos group by l.doc_id)
select d.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_dropped, 0)::bigint as n_dropped, sha256(coalesce(k.text, '')) as kept_sha256
from documents d left join kept k on k.doc_id = d.doc_id
"""

"""Suffix-array dedup by prefix-free parsing, spread over Spark.

Parsing. A rolling hash over ``TRIGGER`` bytes sets triggers: of every string of ``LENGTH`` bytes its smallest trigger
hash (the leftmost of equals) cuts it, so equal strings are cut alike and each holds at least one cut. The texts
between cuts are the phrases. A string whose trigger text stands once in the corpus cannot repeat; only the rest goes on.

Order. The phrases around one trigger text are its dictionary: the bytes before the cut (phrase suffixes, read
backwards) and the bytes from it on (the parse that follows). Each side is sorted into a suffix array with the
lengths of common prefixes; a string with ``a`` bytes before the cut is then known by two classes, that of its left side at depth
``a`` and that of its right side at depth ``LENGTH - a``. Together they put the strings of the corpus in order, and of each
run of equal ones the earliest keeps its bytes.

A trigger text with very many cuts is not brought together: its strings are dealt out one by one, by their own hash, so that only
equal strings meet, at most one a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.llm.common import (
    RollingHash,
    from_planes,
    partition_keys,
    planes,
    shuffle_width,
    slices,
    split_by,
    text_chunks,
)

LENGTH, TRIGGER = 100, 40
#: Bytes of text that are parsed at a time; a longer text is parsed alone.
CHUNK = 1 << 20
#: A trigger text with so many cuts is hot. Sorting its sides would take about 2 KB a cut in one task.
HOT = 1 << 15
#: Set in a cut's number where its trigger text is hot.
HOT_BIT = np.uint32(1 << 31)


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each stretch of width values, by start."""
    out, span = key, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def parse(texts: list[bytes], roll: RollingHash, length: int = LENGTH, trigger: int = TRIGGER):
    """The cuts of a chunk of texts: arrays (text index, cut, first and last start of the strings it cuts, trigger hash), places
    relative to the joined bytes; and these bytes, the start of each text, and the running hash sums."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = np.concatenate(([0], ends[:-1])) if len(texts) else np.zeros(0, dtype=np.int64)
    sums = roll.sums(data)
    if len(data) < length:
        none = np.zeros(0, dtype=np.int64)
        return (none, none, none, none, np.zeros(0, dtype=np.uint64)), data, begins, sums
    h = roll.fixed(sums, trigger)
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    cut = (sliding_min(key, length - trigger + 1) & mask).astype(np.int64)
    starts = np.arange(len(cut))
    text = np.searchsorted(ends, starts, side="right")
    whole = starts + length <= ends[np.minimum(text, len(ends) - 1)]
    starts, cut, text = starts[whole], cut[whole], text[whole]
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return (none, none, none, none, np.zeros(0, dtype=np.uint64)), data, begins, sums
    new = np.concatenate(([True], (cut[1:] != cut[:-1]) | (text[1:] != text[:-1])))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(starts)) - 1
    return (text[at], cut[at], starts[at], starts[last], h[cut[at]]), data, begins, sums


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _cuts(texts: DataFrame, keys: list[int], length: int, trigger: int) -> DataFrame:
    """(bucket, grams, ths, ords): trigger hashes of every cut, packed by bucket, with the text's hash and the cut's number."""

    def run(batches):
        roll = RollingHash(CHUNK * 2)
        width = np.uint64(len(keys))
        known: set[int] = set()
        for batch in slices(batches):
            ths, bodies = [], []
            for th, t in zip(_column(batch, "th"), _column(batch, "text")):
                if th not in known and len(t) >= length // 4:
                    known.add(th)
                    ths.append(th)
                    bodies.append(t.encode())
            for first, last in text_chunks(bodies, CHUNK):
                (text, _, _, _, gram), *_ = parse(bodies[first:last], roll, length, trigger)
                if not len(text):
                    continue
                begin = np.concatenate(([0], np.flatnonzero(text[1:] != text[:-1]) + 1))
                ordinal = np.arange(len(text)) - np.repeat(begin, np.diff(np.append(begin, len(text))))
                own = np.array(ths[first:last], dtype=np.int64)[text]
                rows = list(split_by((gram % width).astype(np.int64), gram, own, ordinal.astype(np.uint32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[b] for b, _ in rows], pa.int32()), *(pa.array([planes(c[k]) for _, c in rows], pa.binary()) for k in range(3))],
                    names=["bucket", "grams", "ths", "ords"],
                )

    return texts.mapInArrow(run, "bucket int, grams binary, ths binary, ords binary")


def _shared_cuts(cuts: DataFrame, width: int, hot: int) -> DataFrame:
    """(th, ords): for each text the numbers of its cuts whose trigger text stands at least twice in the corpus, with HOT_BIT
    if it stands there hot times."""

    def run(batches):
        g, t, o = [], [], []
        for batch in batches:
            g += [from_planes(x, np.uint64) for x in _column(batch, "grams")]
            t += [from_planes(x, np.int64) for x in _column(batch, "ths")]
            o += [from_planes(x, np.uint32) for x in _column(batch, "ords")]
        if not g:
            return
        gram, th, ordinal = np.concatenate(g), np.concatenate(t), np.concatenate(o)
        del g, t, o
        # a text that several tasks have sent counts once
        order = np.lexsort((ordinal, th, gram))
        gram, th, ordinal = gram[order], th[order], ordinal[order]
        fresh = np.concatenate(([True], (gram[1:] != gram[:-1]) | (th[1:] != th[:-1]) | (ordinal[1:] != ordinal[:-1])))
        gram, th, ordinal = gram[fresh], th[fresh], ordinal[fresh]
        cut = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1], [True])))
        times = np.repeat(np.diff(cut), np.diff(cut))
        ordinal = np.where(times >= max(2, hot), ordinal | HOT_BIT, ordinal)
        th, ordinal = th[times >= 2], ordinal[times >= 2]
        order = np.argsort(th, kind="stable")
        th, ordinal = th[order], ordinal[order]
        at = np.flatnonzero(np.concatenate(([True], th[1:] != th[:-1], [True]))) if len(th) else np.zeros(1, dtype=np.int64)
        for lo in range(0, len(at) - 1, 8192):
            part = range(lo, min(lo + 8192, len(at) - 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(th[at[lo : part[-1] + 1]]), pa.array([ordinal[at[i] : at[i + 1]].tobytes() for i in part], pa.binary())], names=["th", "ords"]
            )

    return cuts.repartition(width, "bucket").mapInArrow(run, "th long, ords binary")


CONTEXT = "bucket int, meta binary, bytes binary, ths binary, starts binary, ends binary, strings binary"
#: A string of a hot trigger: its hash, the trigger's, text hash, doc_id, start, bytes before the cut.
STRING = (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.uint8)
SPANS = "th long, starts binary, ends binary"


def _earliest(strings: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The columns of STRING for the earliest of each run of equal strings, and for the others."""
    h, gram, th, doc, x, a = strings
    order = np.lexsort((th, x, doc, a, gram, h))
    h, gram, a = h[order], gram[order], a[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (gram[1:] != gram[:-1]) | (a[1:] != a[:-1])
    return [v[order[new]] for v in strings], [v[order[~new]] for v in strings]


def _runs(th: np.ndarray, x: np.ndarray, length: int):
    """(th, start, end) of strings that start at x; those that start side by side are one span."""
    order = np.lexsort((x, th))
    th, x = th[order], x[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (th[1:] != th[:-1]) | (x[1:] != x[:-1] + 1)
    at = np.flatnonzero(new)
    return th[at], x[at], x[np.append(at[1:], len(x))[: len(at)] - 1] + length


def _contexts(flagged: DataFrame, keys: list[int], length: int, trigger: int) -> DataFrame:
    """The bytes around every shared cut, packed by bucket; of those equal within a task the earliest only, the others
    are decided here: their spans are repeated. Of hot triggers each string goes by itself, likewise."""

    def run(batches):
        roll = RollingHash(CHUNK * 2)
        width = np.uint64(len(keys))
        held, single, buffers, base = [], [], [], 0
        for batch in slices(batches):
            ths, ids = _column(batch, "th"), _column(batch, "owner")
            bodies = [t.encode() for t in _column(batch, "text")]
            flags = [np.unique(np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in xs])) for xs in _column(batch, "ords")]
            for first, last in text_chunks(bodies, CHUNK):
                (text, cut, lo, hi, gram), data, begins, sums = parse(bodies[first:last], roll, length, trigger)
                if not len(text):
                    continue
                begin = np.searchsorted(text, np.arange(last - first))
                pick = np.concatenate([begin[i] + (flags[first + i] & ~HOT_BIT).astype(np.int64) for i in range(last - first)])
                hot = np.concatenate(flags[first:last]) >= HOT_BIT
                if hot.any():
                    t, c, l, g = (v[pick[hot]] for v in (text, cut, lo, gram))
                    n = hi[pick[hot]] - l + 1
                    of = np.repeat(np.arange(len(n)), n)
                    start = l[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]
                    t, before = t[of], (c[of] - start).astype(np.uint8)
                    own = (np.array(v[first:last], dtype=np.int64)[t] for v in (ths, ids))
                    # of equal ones in a chunk the earliest only is held, so that they take no memory
                    kept, others = _earliest([roll.stretch(sums, start, start + length), g[of], *own, start - begins[t], before])
                    single.append((kept, _runs(others[2], others[4], length)))
                pick = pick[~hot]
                text, cut, lo, hi, gram = text[pick], cut[pick], lo[pick], hi[pick], gram[pick]
                whole = roll.stretch(sums, lo, hi + length)
                with np.errstate(over="ignore"):
                    whole = whole + gram * np.uint64(3) + (cut - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                own_th = np.array(ths[first:last], dtype=np.int64)[text]
                own_id = np.array(ids[first:last], dtype=np.int64)[text]
                begins = begins[text]
                held.append((whole, gram, own_th, own_id, cut - begins, cut - lo, hi - lo + 1, lo + base))
                buffers.append(data)
                base += len(data)
        if not held:
            return
        whole, gram, th, doc, x, left, count, at = (np.concatenate([h[k] for h in held]) for k in range(8))
        data = np.concatenate(buffers)
        del held, buffers
        order = np.lexsort((th, x, doc))
        _, first = np.unique(whole[order], return_index=True)
        keep = np.zeros(len(order), dtype=bool)
        keep[order[first]] = True
        gone = ~keep
        out: dict[int, list] = {}
        start = x - left
        spans = [(th[gone], start[gone], (start + length - 1 + count)[gone])]
        if single:
            kept, others = _earliest([np.concatenate([k[i] for k, _ in single]) for i in range(len(STRING))])
            spans += [s for _, s in single] + [_runs(others[2], others[4], length)]
            for b, strings in split_by((kept[0] % width).astype(np.int64), *kept):
                out.setdefault(b, [None] * 6)[5] = b"".join(planes(v) for v in strings)
        gone_th, gone_start, gone_end = (np.concatenate([s[k] for s in spans]) for k in range(3))
        spread = (gone_th.view(np.uint64) % width).astype(np.int64)
        for b, (t, s, e) in split_by(spread, gone_th, gone_start.astype(np.int32), gone_end.astype(np.int32)):
            out.setdefault(b, [None] * 6)[2:5] = [planes(t), planes(s), planes(e)]
        g, t, d, xx, l, c, a = (v[keep] for v in (gram, th, doc, x, left, count, at))
        for b, (g, t, d, xx, l, c, a) in split_by((g % width).astype(np.int64), g, t, d, xx, l, c, a):
            size = length - 1 + c
            spot = np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            meta = planes(g) + planes(t) + planes(d) + planes(xx) + planes(l.astype(np.uint8)) + planes(c.astype(np.uint8))
            out.setdefault(b, [None] * 6)[:2] = [meta, data[spot].tobytes()]
        rows = sorted(out.items())
        for i in range(0, len(rows), 64):
            part = rows[i : i + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[b] for b, _ in part], pa.int32()), *(pa.array([r[k] for _, r in part], pa.binary()) for k in range(6))],
                names=["bucket", "meta", "bytes", "ths", "starts", "ends", "strings"],
            )

    return flagged.mapInArrow(run, CONTEXT)


def _side(gram: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int):
    """Suffix array of one side: the order of its byte strings within each trigger, and common lengths of neighbours."""
    spot = np.arange(width)[None, :]
    inside = spot < size[:, None]
    rows = np.zeros((len(gram), 8 + width), dtype=np.uint8)
    rows[:, :8] = gram.astype(">u8").view(np.uint8).reshape(-1, 8)
    rows[:, 8:] = np.where(inside, data[np.where(inside, start[:, None] + step * spot, 0)], 0)
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{8 + width}").reshape(-1), kind="stable")
    rows = rows[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), 8 + width) - 8
    return order, common


def repeated_spans(gram, th, doc, x, left, count, data, begin, length: int, trigger: int):
    """(th, start, end) of the strings in these contexts that stand earlier in another one. Contexts are sorted by (doc, x)."""
    most = length - trigger
    lo, lc = _side(gram, data, begin + left - 1, left, most, -1)
    ro, rc = _side(gram, data, begin + left, length - 1 + count - left, length, 1)
    n = len(gram)
    gone = np.zeros((n, most + 3), dtype=bool)  # by bytes before the cut, from 1; both ends stay False
    lclass, rclass = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for a in range(most + 1):
        here = np.flatnonzero((a <= left) & (a > left - count))
        if len(here) < 2:
            continue
        lclass[lo] = np.concatenate(([0], np.cumsum(lc < a)))
        rclass[ro] = np.concatenate(([0], np.cumsum(rc < length - a)))
        key = lclass[here] * n + rclass[here]
        _, first = np.unique(key, return_index=True)
        later = np.ones(len(here), dtype=bool)
        later[first] = False
        gone[here[later], a + 1] = True
    edge = np.diff(gone.astype(np.int8), axis=1)
    i, a0 = np.nonzero(edge == 1)  # runs of a from a0 to a1
    _, a1 = np.nonzero(edge == -1)
    a1 = a1 - 1
    return th[i], x[i] - a1, x[i] - a0 + length


def _unpacked(data: bytes, kinds: tuple) -> list[np.ndarray]:
    """The columns of these kinds whose planes stand in data one after the other."""
    sizes = [np.dtype(kind).itemsize for kind in kinds]
    n, at, out = len(data) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes):
        out.append(from_planes(data[at : at + size * n], kind))
        at += size * n
    return out


def _repeats(contexts: DataFrame, width: int, length: int, trigger: int) -> DataFrame:
    def run(batches):
        metas, bodies, single, done = [], [], [], []
        for batch in batches:
            col = {c: _column(batch, c) for c in ("meta", "bytes", "ths", "starts", "ends", "strings")}
            for i in range(batch.num_rows):
                if col["ths"][i]:
                    done.append((from_planes(col["ths"][i], np.int64), from_planes(col["starts"][i], np.int32), from_planes(col["ends"][i], np.int32)))
                if col["strings"][i]:
                    single.append(_unpacked(col["strings"][i], STRING))
                if col["meta"][i]:
                    metas.append(_unpacked(col["meta"][i], (np.uint64, np.int64, np.int64, np.int64, np.uint8, np.uint8)))
                    bodies.append(np.frombuffer(col["bytes"][i], dtype=np.uint8))
        if metas:
            gram, th, doc, x, left, count = (np.concatenate([m[k] for m in metas]) for k in range(6))
            left, count = left.astype(np.int64), count.astype(np.int64)
            data = np.concatenate(bodies)
            del metas, bodies
            size = length - 1 + count
            begin = np.concatenate(([0], np.cumsum(size)[:-1]))
            order = np.lexsort((th, x, doc))
            gram, th, doc, x, left, count, begin = (v[order] for v in (gram, th, doc, x, left, count, begin))
            # equal contexts, byte for byte: the earliest stays
            seen: dict = {}
            keep = np.ones(len(gram), dtype=bool)
            whole = data.tobytes()
            for i, (g, a, b, l) in enumerate(zip(gram.tolist(), begin.tolist(), (begin + length - 1 + count).tolist(), left.tolist())):
                k = (g, l, whole[a:b])
                if k in seen:
                    keep[i] = False
                else:
                    seen[k] = i
            del seen, whole
            gone = ~keep
            done.append((th[gone], (x - left)[gone], (x - left + length - 1 + count)[gone]))
            parts = [v[keep] for v in (gram, th, doc, x, left, count, begin)]
            _, inv, many = np.unique(parts[0], return_inverse=True, return_counts=True)
            several = (many >= 2)[inv]
            if several.any():
                gram, th, doc, x, left, count, begin = (v[several] for v in parts)
                done.append(repeated_spans(gram, th, doc, x, left, count, data, begin, length, trigger))
        if single:
            _, others = _earliest([np.concatenate([s[k] for s in single]) for k in range(len(STRING))])
            done.append(_runs(others[2], others[4], length))
        if not done:
            return
        th, start, end = (np.concatenate([d[k] for d in done]) for k in range(3))
        order = np.lexsort((start, th))
        th, start, end = th[order], start[order].astype(np.int32), end[order].astype(np.int32)
        at = np.flatnonzero(np.concatenate(([True], th[1:] != th[:-1], [True]))) if len(th) else np.zeros(1, dtype=np.int64)
        for lo in range(0, len(at) - 1, 8192):
            part = range(lo, min(lo + 8192, len(at) - 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(th[at[lo : part[-1] + 1]])] + [pa.array([v[at[i] : at[i + 1]].tobytes() for i in part], pa.binary()) for v in (start, end)],
                names=["th", "starts", "ends"],
            )

    return contexts.repartition(width, "bucket").mapInArrow(run, SPANS)


def merged(starts: list[bytes], ends: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that the spans cover."""
    s = np.concatenate([np.frombuffer(v, dtype=np.int32) for v in starts])
    e = np.concatenate([np.frombuffer(v, dtype=np.int32) for v in ends])
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1]


RESULT = "th long, owner long, n_bytes long, n_removed long, n_spans long, span_starts array<int>, span_ends array<int>, kept_sha256 string, full_sha256 string"


def _apply(owned: DataFrame) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            rows = []
            for th, owner, text, starts, ends in zip(*(_column(batch, c) for c in ("th", "owner", "text", "starts", "ends"))):
                data = text.encode()
                full = hashlib.sha256(data).hexdigest()
                if not starts:
                    rows.append((th, owner, len(data), 0, 0, [], [], full, full))
                    continue
                s, e = merged(starts, ends)
                kept = hashlib.sha256()
                at = 0
                for a, b in zip(s.tolist(), e.tolist()):
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                rows.append((th, owner, len(data), int((e - s).sum()), len(s), s.tolist(), e.tolist(), kept.hexdigest(), full))
            cols = list(zip(*rows)) if rows else [[]] * 9
            kinds = (pa.int64(),) * 5 + (pa.list_(pa.int32()),) * 2 + (pa.string(),) * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)],
                names=["th", "owner", "n_bytes", "n_removed", "n_spans", "span_starts", "span_ends", "kept_sha256", "full_sha256"],
            )

    return owned.mapInArrow(run, RESULT)


def dedup_substrings(documents: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, span_starts, span_ends, kept_sha256 for every row of documents.

    Removed is each UTF-8 byte covered by a string of ``length`` bytes that also starts earlier: in a smaller doc_id or
    in the same one at a smaller place; spans are the maximal runs. Null texts count as empty; rows with a
    null doc_id come after all others; those and others that share a doc_id go by place, then by the hash of their
    text; a row repeated exactly is the same document, not an earlier one. Texts are
    told apart by a 64-bit hash. Extra columns are ignored; an empty table gives no rows. A length of more than 255
    bytes beside the trigger raises a ValueError.

    A text that stands several times is worked on once, for its smallest doc_id; the copies lose everything.
    """
    if not trigger <= length <= trigger + 255:
        raise ValueError("length must be at least the trigger's, and at most 255 more")
    spark = documents.sparkSession
    width = shuffle_width(spark)
    keys = partition_keys(spark, width)
    last = F.lit(2**63 - 1)
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("id", F.coalesce("id", last).alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    # the partial aggregate leaves one copy of a text for each task, so a hot text is a few rows in the shuffle
    owned = docs.groupBy("th").agg(F.min("doc_id").alias("owner"), F.min("text").alias("text"))
    cuts = _cuts(docs.select("th", "text"), keys, length, trigger)
    flags = _shared_cuts(cuts, width, HOT).groupBy("th").agg(F.collect_list("ords").alias("ords"))
    contexts = _contexts(owned.join(flags.hint("shuffle_merge"), "th"), keys, length, trigger)
    spans = _repeats(contexts, width, length, trigger).groupBy("th").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    done = _apply(owned.join(spans.hint("shuffle_merge"), "th", "left").select("th", "owner", "text", "starts", "ends"))
    out = docs.select("id", "doc_id", "th").join(done, "th")
    copy = F.col("doc_id") > F.col("owner")
    all_gone = copy & (F.col("n_bytes") >= length)
    nothing = F.array().cast("array<int>")

    def one(mine, gone, kept):
        return F.when(all_gone, gone).when(copy, kept).otherwise(mine)

    return out.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        one(F.col("n_removed"), F.col("n_bytes"), F.lit(0)).alias("n_removed"),
        one(F.col("n_spans"), F.lit(1), F.lit(0)).cast("long").alias("n_spans"),
        one(F.col("span_starts"), F.array(F.lit(0)), nothing).alias("span_starts"),
        one(F.col("span_ends"), F.array(F.col("n_bytes").cast("int")), nothing).alias("span_ends"),
        one(F.col("kept_sha256"), F.sha2(F.lit("").cast("binary"), 256), F.col("full_sha256")).alias("kept_sha256"),
    )

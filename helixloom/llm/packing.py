"""Packing documents into training sequences by harmonic classes.

A length belongs to the class k = capacity // length: k such pieces fill a sequence. Documents are cut to lengths just below the
reciprocals capacity / k, so that any k pieces of class k fill a sequence almost whole. Each worker then closes bins of a class after
exactly k pieces, without knowing of any other piece. What its open bins hold at the end, less than one sequence a class, goes on to be
filled together with what 63 other workers left, level by level, until one level holds all.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.llm.common import new_folder, release, slices, stored
from helixloom.llm.wordcodec import WordCodec, word_codec

CAPACITY = 4096
#: A full bin holds at least this part of the capacity.
LEAST_FILL = 63 / 64
#: The token behind each document.
END = 2
#: Workers whose open bins one group of the next level fills.
FAN_IN = 64
#: Characters of a stretch of a longer text, and those that are encoded together.
STRETCH, BATCH_CHARS = 1 << 16, 8_000_000
#: Bytes of token ids that are gathered before a batch is handed on.
BATCH_BYTES = 8 << 20

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, worker long, no long"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
_NAMES = [x.split()[0] for x in PIECES.split(", ")]


def harmonic_cuts(length: int, capacity: int = CAPACITY, least_fill: float = LEAST_FILL) -> list[int]:
    """The lengths of a document's pieces in order: whole sequences, then the largest reciprocals of the capacity, until what is left fills a bin of its
    class well enough by itself."""
    cuts, rest = [capacity] * (length // capacity), length % capacity
    while rest:
        k = capacity // rest
        size = rest if k * rest >= least_fill * capacity else capacity // (k + 1)
        cuts.append(size)
        rest -= size
    return cuts


class Bins:
    """The open bins of a worker, one for each class."""

    def __init__(self, capacity: int, level: int, worker: int):
        self.capacity, self.open, self.next = capacity, {}, (level << 58) | (worker << 36)

    def add(self, piece: tuple) -> list[tuple]:
        """piece: (doc_id, start, length, ids, doc_tokens). The placed pieces of its bin, if it is full now."""
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        return self.place(self.open.pop(k)) if len(held) == k else []

    def place(self, pieces: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for p in pieces:
            out.append((*p, self.next, at, None, None))
            at += p[2]
        self.next += 1
        return out

    def left(self, worker: int) -> list[tuple]:
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        return [(*p, None, None, worker, no) for no, p in enumerate(rest)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_NAMES)


def _batches(rows):
    """Rows in batches of bounded bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[3]) + 100
        if size >= BATCH_BYTES:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)
    release()


def stretches(text: str, tool: WordCodec, most: int = STRETCH):
    """Parts of a text that are tokenized as they are within it: cut at blanks where the tokenizer removes these, else the whole text."""
    if len(text) <= most or not tool.piecewise or any(re.search(r"\s", t) for t in tool.added):
        yield text
        return
    at, blank = 0, re.compile("[ \t\n]")
    while at < len(text):
        found = blank.search(text, at + most)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def encoded(batches, tool: WordCodec):
    """(doc_id, ids) of every row of Arrow batches, many texts at a time."""
    owners, parts, chars = [], [], 0

    def done():
        ids = tool.encode_all(parts)
        first = 0
        for doc_id, n in owners:
            yield doc_id, ids[first] if n == 1 else np.concatenate(ids[first : first + n])
            first += n

    for batch in slices(batches):
        for doc_id, text in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("doc_id", "text"))):
            cut = list(stretches(text, tool))
            owners.append((doc_id, len(cut)))
            parts += cut
            chars += len(text)
            if chars >= BATCH_CHARS:
                yield from done()
                owners, parts, chars = [], [], 0
    yield from done()


def _pieces(doc_id, ids: np.ndarray, capacity: int, least_fill: float):
    start = 0
    for size in harmonic_cuts(len(ids), capacity, least_fill):
        yield doc_id, start, size, ids[start : start + size].tobytes(), len(ids)
        start += size


def _chop(pieces: list[tuple], capacity: int, bins: Bins):
    """Place the last pieces, cut where a sequence ends; the very last sequences are as long as powers of two."""
    left = sum(p[2] for p in pieces)
    room, held = 0, []
    for doc_id, start, length, ids, total in pieces:
        done = 0
        while done < length:
            if room == 0:
                yield from bins.place(held) if held else []
                held, room = [], capacity if left >= capacity else 1 << (left.bit_length() - 1)
                left -= room
            size = min(room, length - done)
            held.append((doc_id, start + done, size, ids[4 * done : 4 * (done + size)], total))
            done += size
            room -= size
    if held:
        yield from bins.place(held)


def _rows(batch):
    return zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("doc_id", "start", "length", "ids", "doc_tokens")])


def pack_documents(documents: DataFrame, spec: str, capacity: int = CAPACITY, least_fill: float = LEAST_FILL, end: int = END) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: the pieces of all documents and where they stand in sequences of at most ``capacity`` tokens.

    A document is the ids of its whole text (spec is the tokenizer's JSON) and the token ``end``; a null or empty text is that token alone. ids are little-endian
    unsigned 32-bit integers. Each row is a document of its own, also where doc_id is null or repeated; extra columns are ignored; an empty table gives no rows.
    Pieces in a sequence follow each other without gaps. Every sequence is filled to least_fill or more, but for the last few of all, whose length is a power of two.
    A worker holds less than one sequence of each class, under 2 * sqrt(capacity) classes, whatever the number of documents; only what is still open after
    the last level, as little, meets in one task.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(spec)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    last = np.array([end], dtype=np.int32)

    def fill(batches):
        worker = TaskContext.get().partitionId()
        bins = Bins(capacity, 0, worker)

        def rows():
            for doc_id, ids in encoded(batches, word_codec(shared.value)):
                for piece in _pieces(doc_id, np.concatenate([ids, last]).astype("<i4"), capacity, least_fill):
                    yield from bins.add(piece)
            yield from bins.left(worker)

        yield from _batches(rows())

    path = new_folder(spark, "pieces")
    docs.mapInArrow(fill, PIECES).write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(PIECES).parquet(path)
    placed, open_ = found.where("sequence_id is not null"), found.where("sequence_id is null")
    workers, level = (found.agg(F.max("worker")).first()[0] or 0) + 1, 0
    while workers > 1:
        level, workers = level + 1, -(-workers // FAN_IN)

        def refill(batches, level=level):
            """Pieces come sorted by group and class; what is open when the group changes is left."""
            bins, now = Bins(capacity, level, TaskContext.get().partitionId()), None

            def rows():
                nonlocal now
                number = 0
                for batch in batches:
                    for group, piece in zip(batch.column(batch.schema.get_field_index("group")).to_pylist(), _rows(batch)):
                        if group != now:
                            for r in bins.left(now) if now is not None else []:
                                yield (*r[:-1], number + r[-1])
                            number, now = number + capacity, group
                        yield from bins.add(piece)
                for r in bins.left(now) if now is not None else []:
                    yield (*r[:-1], number + r[-1])

            yield from _batches(rows())

        grouped = open_.withColumns({"group": F.expr(f"worker div {FAN_IN}"), "class": F.expr(f"{capacity} div length")})
        order = ["group", "class", "worker", "no"]
        met = stored(grouped.repartition("group", "class").sortWithinPartitions(*order).mapInArrow(refill, PIECES), "pieces")
        placed, open_ = placed.unionByName(met.where("sequence_id is not null")), met.where("sequence_id is null")

    def chop(batches):
        pieces = [p for batch in batches for p in _rows(batch)]
        yield from _batches(_chop(pieces, capacity, Bins(capacity, level + 1, 0)))

    rest = open_.withColumn("class", F.expr(f"{capacity} div length")).repartition(1).sortWithinPartitions("class", "worker", "no")
    return placed.unionByName(rest.mapInArrow(chop, PIECES)).drop("worker", "no")

"""Media columns: content-addressed payloads in tar shards.

Payloads are stored as 8-bit greyscale PNG members of tar shards, named by the digest of the payload; table
rows carry digest, shard, offset and length. Metadata columns come from header-only range reads, payloads
from range reads of one member; no shard is unpacked.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.llm.common import new_folder, shuffle_width, stored

#: Samples in a row of the image; payloads are padded to whole rows.
ROW = 576
PAD = b"\xff"
SHARD_BYTES = 64 << 20
#: Members whose data start within so many bytes of a shard are read by the same task.
READ_SPAN = 4 << 20
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8")
    return len(data), data + PAD * (-len(data) % ROW if data else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_encode(payload: bytes, level: int = 6) -> bytes:
    height = len(payload) // ROW
    rows = np.zeros((height, ROW + 1), dtype=np.uint8)  # the first byte of a row: no filter
    rows[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(height, ROW)
    head = struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> dict:
    """Width, height and bit depth from the first HEADER_BYTES bytes of a member."""
    if data[:8] != PNG_SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("no PNG header")
    width, height, depth = struct.unpack(">IIB", data[16:25])
    return {"width": width, "height": height, "bit_depth": depth}


def png_decode(data: bytes) -> bytes:
    head, at, packed = png_header(data), 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(head["height"], head["width"] + 1)
    return rows[:, 1:].tobytes()


def average_hash(payload: bytes) -> str:
    """64 bits, one for each sixty-fourth of the samples: whether its mean reaches the mean of all."""
    cells = np.frombuffer(payload, dtype=np.uint8).reshape(64, -1).sum(axis=1, dtype=np.int64)
    bits = cells * 64 >= cells.sum()
    return np.packbits(bits).tobytes().hex()


INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def write_shards(documents: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store every text of documents; returns doc_id, n_bytes, digest, shard, offset, length, one row for each row.

    A shard is closed before the rows that point at it are handed on, and its name belongs to one attempt of
    one task: a task that runs again writes new shards, and the index, written with Spark's commit, names
    only those of the attempt that won. Within a task equal payloads are stored once.
    """
    spark = documents.sparkSession
    folder = folder or new_folder(spark, "media")

    def run(batches):
        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        known: dict[bytes, tuple[str, int, int]] = {}
        out, tar, name, rows = None, None, "", []

        def flush():
            nonlocal out, tar, rows
            if tar is not None:
                tar.close()
                out.close()
            out = tar = None
            if rows:
                cols = list(zip(*rows))
                rows = []
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                names = ("doc_id", "n_bytes", "digest", "shard", "offset", "length")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=list(names))

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            texts = batch.column(batch.schema.get_field_index("text"))
            for doc_id, text in zip(ids, texts):
                n, payload = payload_of(text.as_py())
                digest = hashlib.sha256(payload).digest()
                place = known.get(digest)
                if place is None:
                    if tar is None:
                        name = f"part-{part:05d}-{uuid.uuid4().hex}.tar"
                        out = target.open_output_stream(f"{root}/{name}")
                        tar = tarfile.TarFile(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT)
                    data = png_encode(payload)
                    member = tarfile.TarInfo(f"{digest.hex()}.png")
                    member.size = len(data)
                    place = known[digest] = (name, tar.offset + tarfile.BLOCKSIZE, len(data))
                    tar.addfile(member, pa.BufferReader(data))
                rows.append((doc_id.as_py(), n, digest.hex(), f"{folder}/{place[0]}", place[1], place[2]))
                if tar is not None and tar.offset >= shard_bytes:
                    yield from flush()
        yield from flush()

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(source.mapInArrow(run, INDEX), "media-index")


class _Reader:
    """Range reads, with the last shard kept open."""

    def __init__(self):
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            source, path = fs.FileSystem.from_uri(shard)
            self.name, self.file = shard, source.open_input_file(path)
        return self.file.read_at(length, offset)


META = "width int, height int, bit_depth int"
READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(places: DataFrame, schema: str, one) -> DataFrame:
    width = shuffle_width(places.sparkSession)
    dealt = places.withColumn("span", F.floor(F.col("offset") / READ_SPAN)).repartition(width, "shard", "span")
    dealt = dealt.sortWithinPartitions("shard", "offset").drop("span")
    fields = dealt.select("*", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in schema.split(", ")]).schema
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches):
        reader = _Reader()
        for batch in batches:
            where = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length")]
            got = [one(reader, *w) for w in zip(*where)]
            more = [pa.array([g[k] for g in got], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    return dealt.mapInArrow(run, fields)


def read_headers(places: DataFrame) -> DataFrame:
    """width, height and bit_depth beside the columns of places (shard, offset, length), from HEADER_BYTES bytes of each."""

    def one(reader, shard, offset, length):
        return tuple(png_header(reader.read(shard, offset, min(length, HEADER_BYTES))).values())

    return _read(places, META, one)


def read_payloads(places: DataFrame) -> DataFrame:
    """Digests and features of what is stored, beside the columns of places; each member is read and unpacked once."""

    def one(reader, shard, offset, length):
        data = reader.read(shard, offset, length)
        payload = png_decode(data)
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]) & 0xFFFFFFFF, len(data),
            hashlib.sha256(data).hexdigest(), average_hash(payload),
        )

    return _read(places, READ, one)


def media_columns(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length, image metadata, digests and feature for every row of documents.

    Null texts count as empty, an empty text is one row of padding; repeated rows stay, and equal texts, wherever
    they were stored, are read at one place (the smallest) and so get equal values; extra columns are ignored; an
    empty table gives no rows.
    """
    index = write_shards(documents)
    place = F.min(F.struct("shard", "offset", "length")).alias("at")
    unique = index.groupBy("digest").agg(place).select("digest", "at.shard", "at.offset", "at.length")
    read = read_payloads(unique)
    fields = "digest", "shard", "offset", "length"
    read = stored(read, "media-read")
    heads = stored(read_headers(read.select(*fields)).select("digest", "width", "height", "bit_depth"), "media-heads")
    return index.select("doc_id", "n_bytes", "digest").join(read, "digest").join(heads, "digest")

"""BPE encoding and decoding with tree concatenation.

Short texts are encoded whole. A long text is cut in halves down to leaves, whatever stands at the cuts; the leaves are
encoded in parallel, and neighbours are joined up the tree: a window around each join is encoded again and
grows until it agrees exactly with both sides. The encoder keeps the pieces that it has met, as a piece
between the pre-tokenizer's cuts is encoded alike wherever it stands.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixloom.llm.common import release, shuffle_width, slices

#: Texts of more characters go through the tree; its leaves have no more.
LEAF = 1 << 16
#: Characters on either side of a join that are encoded again at first.
WINDOW = 64
#: Pieces that a worker keeps; then it starts anew, so its memory stays bounded.
KEPT_PIECES = 300_000
#: Characters encoded before a batch is handed on.
BATCH_CHARS = 2_000_000

#: The letters, numbers and blanks up to U+024F, where normal form C leaves text as it is.
PLAIN = re.compile("[^\x00-ɏ]")
PIECE = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zªµºÀ-ÖØ-öø-ɏ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼-¾]+"
)
#: The pattern of the pre-tokenizer for which PIECE stands on plain text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Codec:
    """Encodes and decodes as the tokenizers library does with add_special_tokens=False and skip_special_tokens=False."""

    def __init__(self, spec: str):
        self.whole = Tokenizer.from_str(spec)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.plain = Tokenizer.from_str(spec)  # special tokens' strings are ordinary text to this one
        self.plain.no_padding()
        self.plain.no_truncation()
        self.plain.encode_special_tokens = True
        parts = json.loads(spec)
        added = parts.get("added_tokens") or []
        self.simple_added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")") if added else None
        pre = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        norm = [n["type"] for n in (parts.get("normalizer") or {}).get("normalizers") or []]
        self.piecewise = (
            norm == ["NFC", "Replace", "Lowercase"] and len(pre) == 2 and pre[0].get("pattern") == {"Regex": SPLIT}
            and pre[0].get("behavior") == "Removed" and pre[0].get("invert") and pre[1].get("type") == "ByteLevel"
            and not pre[1].get("use_regex") and not parts.get("post_processor") and self.simple_added
        )
        self.joined = parts.get("decoder") is None
        size = self.whole.get_vocab_size(with_added_tokens=True)
        self.names = [self.whole.id_to_token(i) for i in range(size)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.count, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def _learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            done = self.plain.encode(part, is_pretokenized=True, add_special_tokens=False)
            count = np.bincount(np.array(done.word_ids, dtype=np.int64), minlength=len(part))
            n, ids = len(self.known), np.array(done.ids, dtype=np.int32)
            while n + len(part) > len(self.start):
                self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.flat[self.used : self.used + len(ids)] = ids
            self.count[n : n + len(part)] = count
            self.start[n : n + len(part)] = self.used + np.cumsum(count) - count
            self.used += len(ids)
            self.known.update((p, n + k) for k, p in enumerate(part))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if not self.piecewise or PLAIN.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.int32)
        if self.cut is not None and "<|" in text and self.cut.search(text):
            parts = [[self.added[x]] if x in self.added else self._pieces(x) for x in self.cut.split(text)]
            return np.concatenate([np.array(p, dtype=np.int32) for p in parts])
        return self._pieces(text)

    def _pieces(self, text: str) -> np.ndarray:
        words = PIECE.findall(text.lower())
        known = self.known
        at = [known.get(w, -1) for w in words]
        if -1 in at:
            if len(known) > KEPT_PIECES:
                self.forget()
                known = self.known
            self._learn(list(dict.fromkeys(w for w in words if w not in known)))
            at = [known[w] for w in words]
        at = np.array(at, dtype=np.int64)
        count = self.count[at]
        ends = np.cumsum(count)
        spot = np.repeat(self.start[at] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[spot]

    def decode(self, ids) -> str:
        if self.joined:
            names = self.names
            return " ".join([names[i] for i in ids])
        return self.whole.decode(list(ids), skip_special_tokens=False)

    def normal(self, text: str) -> str:
        if not PLAIN.search(text):
            return text.lower() if self.piecewise else self._normal(text)
        return self._normal(text)

    def _normal(self, text: str) -> str:
        return self.plain.normalizer.normalize_str(text) if self.plain.normalizer is not None else text

    def spans(self, text: str, at: int = 0) -> list[tuple[int, int, int]]:
        """(id, start, end) of every token of a stretch of ordinary, normalised text that begins at ``at``."""
        done = self.plain.encode(text, add_special_tokens=False)
        return [(i, a + at, b + at) for i, (a, b) in zip(done.ids, done.offsets)]

    def join(self, text: str, left: list, right: list, at: int, window: int = WINDOW) -> list:
        """The tokens of text from those of its parts before and after ``at``."""
        first = left[0][1] if left else at
        lstart, rend = [t[1] for t in left], [t[2] for t in right]
        while True:
            i = int(np.searchsorted(lstart, at - window, side="right")) - 1 if left else 0
            j = int(np.searchsorted(rend, at + window)) if right else 0
            i, j = max(i, 0), j
            whole_left, whole_right = i == 0, j >= len(right)
            a = 0 if whole_left else left[i][1]
            b = len(text) if whole_right else right[j][2]
            mid = self.spans(text[a:b], a)
            half_l, half_r = a + (at - a) // 2, b - (b - at) // 2
            good_l = whole_left or self._same([t for t in left[i:] if t[2] <= half_l], mid, False)
            good_r = whole_right or self._same([t for t in right[: j + 1] if t[1] >= half_r], mid, True)
            if good_l and good_r:
                return left[: 0 if whole_left else i] + mid + ([] if whole_right else right[j + 1 :])
            window *= 2
            assert window < 4 * (len(text) + abs(first) + WINDOW)

    @staticmethod
    def _same(side: list, mid: list, last: bool) -> bool:
        n = len(side)
        return n > 0 and (mid[-n:] if last else mid[:n]) == side


_CODECS: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    name = hashlib.sha256(spec.encode()).hexdigest()
    if name not in _CODECS:
        _CODECS[name] = Codec(spec)
    return _CODECS[name]


def leaves(text: str, tool: Codec, leaf: int = LEAF) -> list[tuple[int, int, str]]:
    """(segment, id or -1, text) in order: special tokens, and the leaves of the normalised text between them."""
    out = []
    parts = tool.cut.split(text) if tool.cut is not None else [text]

    def halves(segment: int, part: str) -> None:
        if len(part) <= leaf:
            out.append((segment, -1, part))
        else:
            halves(segment, part[: len(part) // 2])
            halves(segment, part[len(part) // 2 :])

    for segment, part in enumerate(parts):
        if part in tool.added:
            out.append((segment, tool.added[part], ""))
        elif part:
            halves(segment, tool.normal(part))
    return out


def join_leaves(parts: list[tuple[int, int, str, list]], tool: Codec) -> list[int]:
    """parts: (segment, id or -1, text, (id, start, end) of its tokens) in order."""
    ids: list[int] = []
    k = 0
    while k < len(parts):
        segment, special = parts[k][0], parts[k][1]
        if special >= 0:
            ids.append(special)
            k += 1
            continue
        run = []
        while k < len(parts) and parts[k][0] == segment:
            run.append((parts[k][2], parts[k][3]))
            k += 1
        while len(run) > 1:  # up the tree: neighbours in pairs
            up = []
            for x in range(0, len(run) - 1, 2):
                (lt, ls), (rt, rs) = run[x], run[x + 1]
                moved = [(i, a + len(lt), b + len(lt)) for i, a, b in rs]
                up.append((lt + rt, tool.join(lt + rt, ls, moved, len(lt))))
            run = up + run[len(run) - len(run) % 2 :]
        ids += [t[0] for t in run[0][1]]
    return ids


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


ENCODED = "doc_id long, ids array<int>, decoded string"
LEAVES = "doc_id long, text_hash long, ord int, segment int, special int, part string"
CODED = LEAVES + ", ids array<int>, starts array<int>, ends array<int>"


def encode_documents(documents: DataFrame, spec: str, leaf: int = LEAF, window: int = WINDOW) -> DataFrame:
    """doc_id, ids, decoded for every row of documents; spec is the tokenizer's JSON.

    Null texts count as empty and give no ids. Rows with a null doc_id are encoded like all others; repeated rows
    stay and get equal results; extra columns are ignored; an empty table gives no rows. No text is cut off: long ones
    go through the tree, and one group of its joins holds one document's leaves.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(spec)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def short(batches):
        tool = codec(shared.value)
        for batch in slices(batches):
            doc_ids, texts = _column(batch, "doc_id"), _column(batch, "text")
            rows, chars = [], 0
            for k, (d, t) in enumerate(zip(doc_ids, texts)):
                ids = tool.encode(t)
                rows.append((d, ids, tool.decode(ids.tolist())))
                chars += len(t)
                if chars >= BATCH_CHARS or k == len(texts) - 1:
                    ends = np.cumsum([0] + [len(r[1]) for r in rows]).astype(np.int32)
                    flat = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([r[2] for r in rows], pa.string())],
                        names=["doc_id", "ids", "decoded"],
                    )
                    rows, chars = [], 0
        tool.forget()
        release()

    def cut(batches):
        tool = codec(shared.value)
        for batch in batches:
            for d, h, t in zip(_column(batch, "doc_id"), _column(batch, "text_hash"), _column(batch, "text")):
                rows = [(d, h, o, s, i, p) for o, (s, i, p) in enumerate(leaves(t, tool, leaf))]
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "text_hash", "ord", "segment", "special", "part"])

    def code(batches):
        tool = codec(shared.value)
        for batch in batches:
            done = [tool.spans(p) if i < 0 else [] for i, p in zip(_column(batch, "special"), _column(batch, "part"))]
            more = [pa.array([[t[k] for t in d] for d in done], pa.list_(pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "ids", "starts", "ends"])

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        tool = codec(shared.value)
        copies = int((rows["ord"] == 0).sum())
        rows = rows.drop_duplicates("ord").sort_values("ord")
        parts = [
            (s, i, p, list(zip(x.tolist(), a.tolist(), b.tolist())))
            for s, i, p, x, a, b in zip(rows["segment"], rows["special"], rows["part"], rows["ids"], rows["starts"], rows["ends"])
        ]
        ids = join_leaves(parts, tool)
        one = rows["doc_id"].iloc[0]
        return pd.DataFrame({"doc_id": pd.array([one] * copies, dtype="Int64"), "ids": [ids] * copies, "decoded": [tool.decode(ids)] * copies})

    whole = docs.where(F.length("text") <= leaf).mapInArrow(short, ENCODED)
    long = docs.where(F.length("text") > leaf).select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(cut, LEAVES)
    coded = long.repartition(shuffle_width(spark), "doc_id", "text_hash", "ord").mapInArrow(code, CODED)
    return whole.unionByName(coded.groupBy("doc_id", "text_hash").applyInPandas(joined, ENCODED))

"""Toxicity by compression distance.

Two zstandard dictionaries of equal making are trained, one on toxic and one on ordinary text: by the same trainer, of the same size, from
those windows of such texts that a common base of ordinary prose does not pack. Behind each stands that base, so that the two differ only
in what is peculiar to one side. A window that packs shorter with the toxic dictionary than with the ordinary one speaks like toxic
text; the gains of a document's windows, set against calibrated thresholds, give its score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.llm.common import stored

#: The model is fitted on at most so many labelled rows, those whose hashed doc_id is smallest.
FIT_ROWS = 12_000
#: Windows of a text that are packed and compared; they overlap by the difference.
WINDOW, STEP = 64, 48
#: Of each fitting text so many windows, evenly spread over the whole text, are samples of the base.
BASE_SAMPLES = 32
#: Windows from which the two dictionaries are trained: bytes from the start of a word, and how many of a text at most (evenly spread).
PIECE, PIECES = 32, 1000
#: So many times more ordinary than toxic texts, at most, give such windows.
MORE_ORDINARY = 3
#: Bytes of the base, of the dictionaries that select windows, and of the two that score.
BASE_BYTES, SELECT_BYTES, DICT_BYTES = 112_640, 4096, 2048
#: Rounds in which each half of the texts keeps those windows that the other half's dictionaries tell apart, and by how many bytes.
ROUNDS, APART = 2, 3
#: Gains, in bytes, from which a window counts.
GAINS = (1, 2, 3, 4, 6, 8)


@dataclass(frozen=True)
class Model:
    base: bytes
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: tuple[float, ...] = ()
    window: int = WINDOW
    step: int = STEP


def windows(data: bytes, window: int = WINDOW, step: int = STEP) -> list[bytes]:
    """The whole text in windows that overlap by the difference of window and step."""
    return [data[i : i + window] for i in range(0, max(1, len(data) - (window - step)), step)]


def spread(items: list, most: int) -> list:
    """At most so many items, evenly from first to last."""
    return items if len(items) <= most else [items[i * len(items) // most] for i in range(most)]


def content(samples: list[bytes], size: int) -> bytes:
    """What the zstandard trainer makes of the samples, without the head that describes it; nothing if they cannot be trained on."""
    try:
        data = zstandard.train_dictionary(size, samples, k=16, d=8).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""
    end_of_head = np.array([1, 4, 8], dtype="<u4").tobytes()  # the trainer's repeat offsets stand last
    return data[data.find(end_of_head) + len(end_of_head) :] if end_of_head in data else data


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    """The tables are wide enough to hold every position of a dictionary; matches start at four bytes, as toxic stems are short."""
    how = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_GREEDY, min_match=4, window_log=18, hash_log=18, chain_log=17, search_log=4,
        write_content_size=False, write_dict_id=False, write_checksum=False,
    )
    return zstandard.ZstdCompressor(
        compression_params=how, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if data else None
    )


def compressors(model: Model) -> tuple:
    """With the ordinary dictionary, and with the toxic one."""
    return compressor(model.ordinary + model.base), compressor(model.toxic + model.base)


def hard_pieces(data: bytes, plain, base) -> list[bytes]:
    """The short windows, spread over the whole text, on which the base saves nothing. They begin with words, so that passages
    that several texts share give equal ones; a word is cut after PIECE bytes."""
    starts = [m.start() for m in re.finditer(rb"[^\s]{1,%d}" % PIECE, data)]
    found = (data[i : i + PIECE] for i in spread(starts, PIECES))
    return [w for w in found if len(base.compress(w)) >= len(plain.compress(w))]


def first_only(texts: list[list[bytes]]) -> list[list[bytes]]:
    """Each window only where it comes first: what is copied from text to text counts once."""
    seen: set[bytes] = set()
    return [[w for w in x if not (w in seen or seen.add(w))] for x in texts]


def features(text: str, model: Model, pair) -> list[float]:
    ordinary, toxic = pair
    parts = windows(text.lower().encode(), model.window, model.step)
    gain = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in parts], dtype=float)
    top = np.sort(gain)[-3:]
    n = len(parts)
    out = [float(top[-1]), float(top.mean()), float(gain.mean())]
    for g in GAINS:
        hit = float((gain >= g).sum())
        out += [math.log1p(hit), hit / n]
    out.append(math.log(n))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps on standardised features; returned on the raw scale, intercept last."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack(((x - mean) / sd, np.ones((len(x), 1))))
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + penalty * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    raw = w[:-1] / sd
    return (*raw.tolist(), float(w[-1] - (raw * mean).sum()))


def _joined(texts: list[list[bytes]]) -> list[bytes]:
    return [w for t in texts for w in t]


def dictionaries(base: bytes, ordinary: list[list[bytes]], toxic: list[list[bytes]], size: int = DICT_BYTES) -> tuple[bytes, bytes]:
    """The contents of the two dictionaries from the hard windows of each text.

    In each round either half of the texts keeps the windows that the dictionaries of the other half pack APART bytes shorter on
    their own side, so that a window counts only for what other texts of its side have too. Texts come in hashed order, so that those of ordinary kind
    that are more than MORE_ORDINARY to a toxic one are left out by chance, not by their ids.
    """
    ordinary, toxic = first_only(ordinary[: MORE_ORDINARY * len(toxic)]), first_only(toxic)
    for _ in range(ROUNDS):
        kept = [[], []]
        for half in (0, 1):
            packed = [compressor(content(_joined(x[1 - half :: 2]), SELECT_BYTES) + base) for x in (ordinary, toxic)]
            for k, texts in enumerate((ordinary, toxic)):
                mine, other = packed[k], packed[1 - k]
                kept[k].append([[w for w in x if len(other.compress(w)) - len(mine.compress(w)) >= APART] for x in texts[half::2]])
        ordinary, toxic = ([x for pair in zip_longest(*halves, fillvalue=[]) for x in pair] for halves in kept)
    return content(_joined(ordinary), size), content(_joined(toxic), size)


def held_out(doc_id):
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5) == 0


def _per_text(rows: DataFrame, kind: pa.DataType, spark_type: str, make) -> Iterator[tuple]:
    """(no, value) for every fitting text; values are made in tasks from whole texts, and bounded in size."""

    def run(batches):
        one = make()
        for batch in batches:
            no, text = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("no", "text"))
            yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array([one(t) for t in text], kind)], names=["no", "value"])

    return sorted((r["no"], r["value"]) for r in rows.select("no", "text").mapInArrow(run, f"no long, value {spark_type}").collect())


def fit_model(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """Fit on a bounded sample of labelled rows that are not held out: at most fit_rows, those with the smallest hashed ids, so that
    reruns agree. A document that is labelled both ways counts as toxic; of several texts of one id the smallest is taken.

    Two thirds of the rows train the dictionaries, from windows spread over whole texts; the rest calibrates on the features of whole
    texts. Texts are read in tasks; to the driver go windows and features, bounded by fit_rows. None without rows of both labels in both parts.
    """
    marks = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    pick = marks.orderBy(F.xxhash64(F.lit(11), F.col("doc_id")), "doc_id").limit(fit_rows)
    text = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    rows = text.join(F.broadcast(pick), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    place = F.xxhash64(F.lit(11), F.col("doc_id"))
    rows = stored(rows.select(F.col("doc_id").alias("no"), "toxic", "text", (F.pmod(place, F.lit(3)) == 0).alias("calibrates"), F.xxhash64(F.lit(12), F.col("doc_id")).alias("place")), "toxicity-fit")
    marked = {r["no"]: (r["toxic"], r["calibrates"], r["place"]) for r in rows.select("no", "toxic", "calibrates", "place").collect()}
    if len({m[:2] for m in marked.values()}) < 4:
        return None
    train = rows.where("not calibrates")

    def samples():
        return lambda t: spread(windows(t.lower().encode()), BASE_SAMPLES)

    base = content(_joined([w for _, w in _per_text(train.where("toxic = 0"), pa.list_(pa.binary()), "array<binary>", samples)]), BASE_BYTES)

    def pieces():
        plain, packed = compressor(b""), compressor(base)
        return lambda t: hard_pieces(t.lower().encode(), plain, packed)

    hard = sorted(_per_text(train, pa.list_(pa.binary()), "array<binary>", pieces), key=lambda x: (marked[x[0]][2], x[0]))
    ordinary, toxic = dictionaries(base, *([w for no, w in hard if marked[no][0] == k] for k in (0, 1)))
    model = Model(base, ordinary, toxic)

    def measures():
        pair = compressors(model)
        return lambda t: features(t, model, pair)

    found = _per_text(rows.where("calibrates"), pa.list_(pa.float64()), "array<double>", measures)
    x, y = np.array([v for _, v in found]), np.array([marked[no][0] for no, _ in found], dtype=float)
    return replace(model, weights=logistic(x, y))


def score_documents(documents: DataFrame, model: Model | None) -> DataFrame:
    """The rows of documents with score (0 to 1, higher: toxic likelier) and predicted (1 from a score of 0.5).

    Every whole text is scored, by its text alone; null counts as empty. Without a model (no labels, or one kind only)
    all scores are 0. Repeated rows get equal scores; extra columns stay, but for own score and predicted
    columns, which are replaced; an empty table stays empty.
    """
    documents = documents.drop("score", "predicted")
    if model is None:
        return documents.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    schema = documents.select("*", F.lit(0.0).alias("score")).schema

    def run(batches):
        pair = compressors(model)
        w = np.array(model.weights)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text")).to_pylist()
            x = np.array([[*features(t or "", model, pair), 1.0] for t in text]).reshape(len(text), -1)
            z = np.einsum("ij,j->i", x, w) if len(text) else np.zeros(0)
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    return documents.mapInArrow(run, schema).select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))

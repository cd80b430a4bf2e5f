"""An encoder for many texts: what stands between two blanks is encoded once and then looked up.

Gives the ids of ``bpe.Codec``. It holds for tokenizers that drop blanks and encode what stands between them by itself; others, and texts
outside the plain letters, go to the library's encoder.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from helixloom.llm.bpe import PIECE, PLAIN, Codec

#: Words that a worker keeps; then it starts anew, so its memory stays bounded (about 200 MB).
KEPT_WORDS = 1_000_000
#: Signs other than stops and commas (and the underscore, which counts as a letter here).
SIGN = re.compile(r"[^\w\s.,]")
BESIDE = ("_", "..", ".,", ",.", ",,")
#: Signs that Python takes for blanks and the tokenizer does not.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others in order from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + n for n, b in enumerate(rest)}


class Words(dict):
    """word -> its number; ids of word i are flat[start[i]:start[i + 1]]."""

    __slots__ = ("tokenize", "start", "flat", "letters")

    def __init__(self, tokenize):
        self.tokenize, self.start, self.flat, self.letters = tokenize, array("q", [0]), array("i"), _byte_letters()

    def __missing__(self, word: str) -> int:
        for piece in (word,) if word.isalpha() else PIECE.findall(word):
            if not piece.isascii():
                piece = piece.encode().decode("latin-1").translate(self.letters)
            self.flat.extend([t.id for t in self.tokenize(piece)])
        self.start.append(len(self.flat))
        self[word] = n = len(self)
        return n


class WordCodec(Codec):
    def forget(self) -> None:
        super().forget()
        self.words = Words(self.plain.model.tokenize)

    def _easy(self, text: str) -> bool:
        return self.piecewise and "<|" not in text and PLAIN.search(text) is None and not any(c in text for c in SEPARATORS)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text. Words are split and numbered by Arrow, so that each distinct one is looked up once."""
        if len(self.words) > KEPT_WORDS:
            self.forget()
        easy = [i for i, t in enumerate(texts) if self._easy(t)]
        out: list = [None] * len(texts)
        lows = []
        for i in easy:
            low = texts[i].lower()
            if SIGN.search(low) is None and not any(x in low for x in BESIDE):  # stops and commas are pieces of their own
                low = low.replace(".", " . ").replace(",", " , ")
            lows.append(low)
        lists = pc.utf8_split_whitespace(pa.array(lows, pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        words = self.words
        known = coded.dictionary.to_pylist()
        number = np.fromiter(map(words.__getitem__, known), np.int64, len(known))
        start, flat = np.array(words.start), np.array(words.flat, dtype=np.int32)
        at = number[coded.indices.to_numpy()]
        first = start[at]
        count = start[at + 1] - first
        ends = np.cumsum(count)
        ids = flat[np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.append(0, ends)[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        for k, i in enumerate(easy):
            out[i] = ids[bounds[k] : bounds[k + 1]]
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = self.encode(t)
        return out


_CODECS: dict[str, WordCodec] = {}


def word_codec(spec: str) -> WordCodec:
    name = hashlib.sha256(spec.encode()).hexdigest()
    if name not in _CODECS:
        _CODECS[name] = WordCodec(spec)
    return _CODECS[name]

"""Where the public tokenizer files lie; they are read from their package, never copied."""

from __future__ import annotations

from pathlib import Path


def tokenizer_spec(name: str = "word_bpe_49k.json", path: str | None = None) -> str:
    """The JSON of a tokenizer: from ``path``, or by name from the package of public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    return Path(path).read_text(encoding="utf-8")

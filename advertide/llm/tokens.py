"""Token ids of many texts."""

from __future__ import annotations

import json
import os
import re

import numpy as np

# Fixed values of byte-level BPE: how a text falls into pieces, and the bytes that are spelled as themselves.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
# Longer runs of blanks are beyond the faster encoder's pattern engine.
MOST_BLANKS = 10_000
_BLANKS = re.compile(rf"\s{{{MOST_BLANKS}}}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that spells each byte: printable bytes themselves, the others from 256 on."""
    letters = {chr(b): b for b in PLAIN}
    rest = (b for b in range(256) if b not in set(PLAIN))
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_ranks(described: dict) -> dict[bytes, int] | None:
    """Bytes and id of each token of a tokenizer file whose merges have rising ids; None for any other kind.

    Where ids rise with the merges, joining by the least id is joining by the first merge.
    """
    model, before = described["model"], described.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if model.get("type") != "BPE" or not plain or described.get("normalizer") or model.get("ignore_merges"):
        return None
    letters, vocabulary = byte_letters(), model["vocab"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    merged = [vocabulary["".join(pair)] for pair in pairs]
    bases = [vocabulary.get(c, -1) for c in letters]
    if merged != sorted(set(merged)) or min(bases) < 0 or len(vocabulary) != len(merged) + len(bases) or max(bases) > merged[0]:
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}


class Encoder:
    """Ids of whole texts as little-endian bytes, those the tokenizer file gives for each text at once.

    ``special_as_text``: a special token's own string inside a text is ordinary text.
    A byte-level vocabulary is read by the library that joins bytes fastest; other
    vocabularies, and texts with very long runs of blanks, by the file's own. Nothing
    is kept between texts, so memory follows the longest text.
    """

    def __init__(self, path: str, width: str = "<u4", special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.width = width
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        ranks, added = merge_ranks(described), described.get("added_tokens") or []
        self.fast = None
        if ranks and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            special = {} if special_as_text else {t["content"]: t["id"] for t in added}
            coder = tiktoken.Encoding(os.path.basename(path), pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)
            self.fast = lambda text: coder.encode(text, allowed_special="all") if special else coder.encode_ordinary(text)

    def _ids(self, text: str) -> list[int]:
        if self.fast is None or (len(text) >= MOST_BLANKS and _BLANKS.search(text)):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [np.array(self._ids(t), dtype=self.width).tobytes() if t else b"" for t in texts]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, width: str = "<u4", special_as_text: bool = False) -> Encoder:
    """One encoder a worker process."""
    key = (path, width, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]

"""Splitting texts into chunks that a byte-level BPE encodes separately, and bounded tables of what chunks encode to.

A chunk ends only where the tokenizer's own pattern also ends a match, and no match looks back, so a text's ids are its
chunks' ids one after another. Chunks repeat far more than texts do; each worker keeps what it has encoded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np


def _ranges(*ends: tuple[int, int]) -> str:
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ends)


# Unicode's White_Space, as the libraries' patterns take it; runs of code points in the Latin, Greek and
# Cyrillic blocks that are all letters; ASCII that is neither.
SPACE = _ranges((0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
LETTER = _ranges((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2C1), (0x370, 0x373), (0x388, 0x38A), (0x38E, 0x3A1), (0x3A3, 0x3F5), (0x3F7, 0x481), (0x48A, 0x52F))
OTHER = _ranges((0x21, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
CHUNK = re.compile(rf" ?[{LETTER}]++(?=[{OTHER}{SPACE}]|\Z)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")

chunks = CHUNK.findall


class ChunkTable(dict):
    """What `encode` gives for each chunk. At most `limit` chunks are kept, none of over `longest` characters; results don't depend on either."""

    def __init__(self, encode: Callable, limit: int = 500_000, longest: int = 48) -> None:
        super().__init__()
        self.encode, self.limit, self.longest = encode, limit, longest

    def __missing__(self, chunk: str):
        value = self.encode(chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = value
        return value


class Vocabulary:
    """A tokenizer file (.json: tokenizers; .model: sentencepiece) and what its library gives for whole texts, without added special tokens."""

    def __init__(self, path: str) -> None:
        self.chunked, self.special = False, ()
        if path.endswith(".model"):
            import sentencepiece

            lib = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size, self.whole = lib.get_piece_size(), lambda text: lib.encode([text], num_threads=1)[0]
            return
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        lib.no_truncation()
        lib.no_padding()
        self.size, self.whole = lib.get_vocab_size(), lambda text: lib.encode(text, add_special_tokens=False).ids
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.special = tuple(x["content"] for x in spec.get("added_tokens", ()))
        self.chunked = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for each worker and path."""
    return Vocabulary(path)


@lru_cache(maxsize=2)
def token_counter(path: str) -> Callable[[str], int]:
    """A function from a text to how many ids it has, chunks that came before being looked up."""
    v = vocabulary(path)
    whole = lambda text: len(v.whole(text))
    if not v.chunked:
        return whole
    known = ChunkTable(whole).__getitem__
    return lambda text: whole(text) if any(s in text for s in v.special) else sum(map(known, chunks(text)))


@lru_cache(maxsize=2)
def id_encoder(path: str) -> tuple[Callable[[str], bytes], str]:
    """A function from a text to its ids as little-endian bytes, and their numpy type. Texts with the tokenizer's special strings go whole to the library."""
    v = vocabulary(path)
    kind = "<u2" if v.size <= 1 << 16 else "<u4"
    whole = lambda text: np.array(v.whole(text), kind).tobytes()
    if not v.chunked:
        return whole, kind
    known = ChunkTable(whole, limit=1_000_000).__getitem__
    return (lambda text: whole(text) if any(s in text for s in v.special) else b"".join(map(known, chunks(text)))), kind

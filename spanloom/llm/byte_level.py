"""Ids of byte-level vocabularies, in task: the same vocabulary once as ranks, which is fast, and once as a file of the
tokenizers library, which has the last word where the two could differ."""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Callable
from pathlib import Path

import numpy as np

#: The library that reads ranks gives up on very long white space, which its pattern looks through again and again.
LONG_SPACE = re.compile(r"\s{2000}")
_open: dict[tuple[str, bool], ByteLevel] = {}


class ByteLevel:
    """A byte-level vocabulary file of the tokenizers library, and the ranks file of the same name beside it if there is one.

    ``special``: whether strings of special tokens inside a text become their ids (what the library does unasked), or
    are ordinary text.
    """

    def __init__(self, path: str, special: bool):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not special
        spec = json.loads(self.whole.to_str())
        self.specials = [t["content"] for t in spec["added_tokens"]] if special else []
        pre = spec["pre_tokenizer"] or {}
        plain = not spec["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        ranks = Path(path).with_suffix(".tiktoken")
        self.fast = self._ranks(ranks) if plain and ranks.exists() else None
        self.vocabulary = self.whole.get_vocab()

    @staticmethod
    def _ranks(file: Path):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.read_bytes().splitlines())}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or LONG_SPACE.search(text) or any(s in text for s in self.specials):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def spelt(self) -> list[bytes]:
        """The bytes of each id, by id; empty for ids that are no token."""
        from .wordpiece_cache import byte_letters

        byte_of = {letter: b for b, letter in byte_letters().items()}
        out = [b""] * (max(self.vocabulary.values()) + 1)
        for token, i in self.vocabulary.items():
            out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        return out


def byte_level(path: str, special: bool = True) -> ByteLevel:
    """This worker's vocabulary for a file."""
    if (path, special) not in _open:
        _open[path, special] = ByteLevel(path, special)
    return _open[path, special]


def packed(path: str) -> Callable[[str], bytes]:
    """Maps a text to its ids as little-endian unsigned 32-bit numbers."""
    ids = byte_level(path).ids
    return lambda text: array("I", ids(text)).tobytes() if text else b""


def lengths(spelt: list[bytes]) -> np.ndarray:
    return np.array([len(s) for s in spelt], np.int64)

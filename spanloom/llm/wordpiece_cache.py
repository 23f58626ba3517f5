"""Token ids of whole texts for vocabularies whose pre-tokenizer never joins what white space parts.

The ids of a text are then the ids of its parts, as the vocabulary splits it, one after the other; for texts with other
than PLAIN characters those of its chunks between white space. Both repeat, so each Python worker remembers the ids of short ones it has met (forgetting all when they take ``most_bytes``) and asks the
tokenizer for new ones only. Texts with strings of special tokens go to the tokenizer as they are, and so do all texts
of a vocabulary whose normalizer or pre-tokenizer are others than those below.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

import numpy as np
#: Characters that lower-case one by one and are composed already, and the white space that Python and the tokenizer see alike.
PLAIN = re.compile("[\\x20-\\x7e\\t\\n\\r\\xa1-\\u012f\\u0131-\\u017f]*")
#: The vocabulary's split, and the same for texts of PLAIN characters, with the letters and numbers among them.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _NUMBERS = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
PLAIN_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
#: What the vocabulary's file must say for chunks to stand alone.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": PARTS}, "behavior": "Removed", "invert": True}
LONGEST = 64  # characters of a chunk that is remembered
OVERHEAD = 170  # bytes that a remembered part takes besides its ids: an entry of the table, a short string, an object
_open: dict[str, Callable[[str], bytes]] = {}


def alone(spec: dict) -> bool:
    """Whether chunks between white space can be encoded one by one."""
    normalizer, splits = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return normalizer.get("normalizers") == NORMALIZERS and splits[0] == SPLIT and len(splits) == 2 and splits[1].get("type") == "ByteLevel" and spec["model"].get("end_of_word_suffix") == "</w>"


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies spell byte b as a letter: itself if printable, else the next free one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def ids_of(path: str, most_bytes: int = 80 << 20) -> Callable[[str], bytes]:
    """Maps a text to its ids as little-endian unsigned 32-bit numbers. One per vocabulary file and worker."""
    if path not in _open:
        _open[path] = _encoder(path, most_bytes)
    return _open[path]


def _encoder(path: str, most_bytes: int) -> Callable[[str], bytes]:
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    spec = json.loads(whole.to_str())
    specials = [t["content"] for t in spec["added_tokens"]]
    whole_ids = lambda t: np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    if not alone(spec):
        return whole_ids
    bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": []}))
    letters, model = byte_letters(), bare.model
    del spec
    known: dict[str, bytes] = {}
    size = 0

    def learned(part: str, plain: bool) -> bytes:
        nonlocal size
        if plain:
            spelt = part if part.isascii() else part.encode().decode("latin-1").translate(letters)
            ids = array("I", [t.id for t in model.tokenize(spelt)]).tobytes()
        else:
            ids = np.array(bare.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        if len(part) <= LONGEST:
            known[part] = ids
            size += len(ids) + OVERHEAD
        return ids

    def encode(text: str) -> bytes:
        nonlocal size
        if any(s in text for s in specials):
            return whole_ids(text)
        plain = PLAIN.fullmatch(text) is not None
        parts = PLAIN_PARTS.findall(text.lower()) if plain else whole.normalizer.normalize_str(text).split(" ")
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            if size > most_bytes:
                known.clear()
                size = 0
            get = known.get
            return b"".join([ids if (ids := get(x)) is not None else learned(x, plain) for x in parts])

    return encode

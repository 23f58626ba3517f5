"""Subword encoding and decoding with SentencePiece models, by a depth-first walk over shared prefixes.

Texts are cut into marked words (a run of word marks and what follows). The distinct words of a batch are sorted, which
lines up a trie; going through them in order visits it depth-first. Forward states of a word's prefixes stay on a stack,
and the next word starts from those of the prefix that it shares with the one before.

The forward state of a prefix depends on the kind of model. Unigram models: the best sum of piece scores that ends
there, and the last piece (Viterbi). Merge-ranked (BPE) models give other pieces than the best sum of scores would, so
their state is the last piece of the prefix's merges: piece p ends a prefix just if the pair (last piece of what
precedes p, p) is left alone by the merges. That gives the same pieces as merging the whole word.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterable
from functools import cached_property
from heapq import heapify, heappop, heappush
from operator import add

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import load, with_columns_from

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]*")
#: Bounds of what a Python worker remembers: pairs of pieces, bytes of words' ids, and characters of such a word.
PAIRS = 400_000
WORD_BYTES = 128 << 20
LONGEST = 64
SHORT = 24  # characters of a word whose pairs are looked through
OVERHEAD = 200  # bytes of a remembered word besides its ids
#: What the unknown id decodes to, as the library has it.
UNKNOWN_TEXT = " \u2047 "


class Vocabulary:
    """Pieces of one model. ``kind``: 'bpe' (a higher score merges first) or 'unigram' (scores are log-probabilities)."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], kind: str, bytes_from: int | None = None, unknown: int = 0, dummy_prefix: bool = True, silent: Iterable[int] = ()):
        self.scores, self.ids, self.kind, self.unknown, self.dummy_prefix = scores, ids, kind, unknown, dummy_prefix
        self.bytes_from = bytes_from  # the id of byte 0, where unknown characters fall back to bytes
        self.longest = max(map(len, scores), default=1)
        self.alone: dict[tuple[str, str], bool] = {}
        self.spelt = {i: p.replace(MARK, " ").encode("utf-8") for p, i in ids.items()}
        if bytes_from is not None:
            self.spelt |= {bytes_from + b: bytes([b]) for b in range(256)}
        self.spelt |= dict.fromkeys(silent, b"")  # control ids stand for no text
        self.spelt.setdefault(unknown, UNKNOWN_TEXT.encode())
        self.worst = min(scores.values(), default=0.0) - 10.0

    def merged(self, word: str) -> list[str]:
        """The pieces that merging adjacent symbols leaves, best score first, leftmost first among equals.

        Short words by looking through all pairs for each merge; others by a heap of pairs over a linked list, so n
        characters take n log n steps. An entry counts only while both its symbols are as they were: a symbol that is
        merged into the one before it has length 0.
        """
        if len(word) <= SHORT:
            parts, get = list(word), self.scores.get
            while len(parts) > 1:
                best, at = None, -1
                for k, pair in enumerate(map(add, parts, parts[1:])):
                    if (s := get(pair)) is not None and (best is None or s > best):
                        best, at = s, k
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return parts
        n, score = len(word), self.scores.get
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, k, 2) for k in range(n - 1) if (s := score(word[k : k + 2])) is not None]
        heapify(heap)
        while heap:
            _, k, long = heappop(heap)
            right = after[k]
            if not size[k] or right >= n or size[k] + size[right] != long:
                continue
            size[k], size[right] = long, 0
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
                both = long + size[after[k]]
                if both <= self.longest and (s := score(word[k : k + both])) is not None:
                    heappush(heap, (-s, k, both))
            left = before[k]
            if left >= 0:
                both = size[left] + long
                if both <= self.longest and (s := score(word[left : left + both])) is not None:
                    heappush(heap, (-s, left, both))
        out, k = [], 0
        while k < n:
            out.append(word[k : k + size[k]])
            k = after[k]
        return out

    @cached_property
    def run(self) -> int:
        """How many marks a piece of a long run of marks has, where all such pieces but the last ones are equal; else 0."""
        parts = self.merged(MARK * 256)
        return len(parts[0]) if set(parts) == {parts[0]} else 0

    def merged_run(self, word: str) -> list[str]:
        """``merged`` of a word that begins with a run of marks. Equal pairs merge from the left, so what stands at the
        run's end has no say in the pieces well before it: these need no heap."""
        marks = len(word) - len(word.lstrip(MARK))
        spare = (marks - 2 * self.run) // self.run if self.run and marks > 4 * self.run else 0
        return [MARK * self.run] * spare + self.merged(word[spare * self.run :])

    def stays(self, a: str, b: str) -> bool:
        """Whether merging the text of two adjacent pieces gives just these two."""
        if (a, b) not in self.alone:
            if len(self.alone) > PAIRS:
                self.alone.clear()
            self.alone[a, b] = self.merged(a + b) == [a, b]
        return self.alone[a, b]

    @cached_property
    def finder(self) -> ahocorasick.Automaton:
        """Finds all pieces in a word that merging their own characters gives: others never come out of a merge."""
        found = ahocorasick.Automaton()
        for p in self.scores:
            if self.merged(p) == [p]:
                found.add_word(p, p)
        found.make_automaton()
        return found

    def ids_of(self, parts: Iterable[str]) -> list[int]:
        """Ids of pieces; a character that is none becomes its bytes, or the unknown id."""
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes_from is None:
                out.append(self.unknown)
            else:
                out.extend(self.bytes_from + b for b in p.encode("utf-8", "surrogatepass"))
        return out


def forward(v: Vocabulary, words: list[str]) -> dict[str, list[str]]:
    """The pieces of each distinct word. Words are visited in sorted order; ``last[i]`` and ``best[i]`` are the states of
    the current word's prefix of i characters."""
    out: dict[str, list[str]] = {}
    last: list[str] = [""]
    best: list[float] = [0.0]
    before = ""
    unigram = v.kind == "unigram"
    find, kept = (None if unigram else v.finder.iter), v.alone.get
    for word in sorted(words):
        if not unigram and word.startswith(MARK * 2):  # equal scores of mark runs: ties are settled by place, not by prefix
            out[word] = v.merged_run(word)
            continue
        shared = 0
        for a, b in zip(before, word, strict=False):
            if a != b:
                break
            shared += 1
        del last[shared + 1 :], best[shared + 1 :]
        if unigram:
            for end in range(shared + 1, len(word) + 1):
                ends_here = [(best[at] + v.scores[p], p) for at in range(max(0, end - v.longest), end) if (p := word[at:end]) in v.scores]
                score, piece = max(ends_here, default=(best[end - 1] + v.worst, word[end - 1]), key=lambda x: x[0])
                last.append(piece)
                best.append(score)
        else:
            for at, piece in find(word, max(0, shared + 1 - v.longest)):
                if len(last) > at + 1:  # the state is known
                    continue
                while len(last) <= at:  # characters that are no piece stay alone
                    last.append(word[len(last) - 1])
                start = at + 1 - len(piece)
                if start == 0 or (v.stays(last[start], piece) if (alone := kept((last[start], piece))) is None else alone):
                    last.append(piece)
            while len(last) <= len(word):
                last.append(word[len(last) - 1])
        parts, at = [], len(word)
        while at:
            parts.append(last[at])
            at -= len(last[at])
        out[word] = parts[::-1]
        before = word
    return out


def marked(v: Vocabulary, text: str) -> list[str]:
    """The marked words of a text: spaces become marks, one more goes in front. An empty text has none."""
    if not text:
        return []
    return [w for w in WORD.findall((MARK if v.dummy_prefix else "") + text.replace(" ", MARK)) if w]


def encoder(v: Vocabulary, most_bytes: int = WORD_BYTES) -> Callable[[list[str]], list[bytes]]:
    """Encodes batches of texts to ids (little-endian 32-bit). Short words met before are remembered, all forgotten
    when they take ``most_bytes``."""
    known: dict[str, bytes] = {}
    size = 0

    def encode(texts: list[str]) -> list[bytes]:
        nonlocal size
        cut = [marked(v, t) for t in texts]
        if size > most_bytes:
            known.clear()
            size = 0
        new = {w for ws in cut for w in ws if w not in known}
        found = {word: np.array(v.ids_of(parts), "<i4").tobytes() for word, parts in forward(v, list(new)).items()}
        kept = {w: ids for w, ids in found.items() if len(w) <= LONGEST}
        known.update(kept)
        size += sum(map(len, kept.values())) + OVERHEAD * len(kept)
        if len(kept) == len(found):
            return [b"".join(map(known.__getitem__, ws)) for ws in cut]
        return [b"".join([known[w] if w in known else found[w] for w in ws]) for ws in cut]

    return encode


def decode(v: Vocabulary, ids: Iterable[int]) -> str:
    """The text of ids: bytes join into characters, marks become spaces, the one in front goes.

    Control ids stand for no text, the unknown id and numbers that are no id for UNKNOWN_TEXT, bytes that make no
    character (a sequence that was cut) for U+FFFD.
    """
    ids = list(ids)
    try:
        found = b"".join(map(v.spelt.__getitem__, ids))
    except KeyError:
        found = b"".join(v.spelt.get(i, UNKNOWN_TEXT.encode()) for i in ids)
    text = found.decode("utf-8", "replace")
    return text[1:] if v.dummy_prefix and text.startswith(" ") else text


_open: dict[str, Vocabulary] = {}
_encoders: dict[str, Callable] = {}


def vocabulary(path: str) -> Vocabulary:
    """The model in a SentencePiece file: kind, scores, byte pieces and the mark in front."""
    if path not in _open:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto.FromString(p.serialized_model_proto())
        kind = "bpe" if model.trainer_spec.model_type == proto.TrainerSpec.BPE else "unigram"
        ids, scores, silent = {}, {}, [i for i in range(p.vocab_size()) if p.is_control(i) or p.is_unused(i)]
        for i in range(p.vocab_size()):
            if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)):
                ids[p.id_to_piece(i)], scores[p.id_to_piece(i)] = i, p.get_score(i)
        first = p.piece_to_id("<0x00>")
        _open[path] = Vocabulary(scores, ids, kind, first if p.is_byte(first) else None, p.unk_id(), model.normalizer_spec.add_dummy_prefix, silent)
    return _open[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_here(file: str) -> Callable[[list[str]], list[bytes]]:
    """This worker's encoder for a model's file."""
    if file not in _encoders:
        _encoders[file] = encoder(vocabulary(file))
    return _encoders[file]


def encode_column(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """df with ``ids``, the little-endian 32-bit ids of the whole text. Null stays null, an empty text has none."""
    file = path or default_model()

    def make():
        encode = encode_here(file)

        def work(texts):
            it = iter(encode([t for t in texts if t is not None]))
            return [[None if t is None else next(it) for t in texts]]

        return work

    return with_columns_from(df, [text], T.StructType([T.StructField(ids, T.BinaryType())]), make)


def decode_column(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """df with ``text``, decoded from ids as encode_column writes them. Null stays null."""
    file = path or default_model()

    def make():
        v = vocabulary(file)
        return lambda values: [[None if x is None else decode(v, np.frombuffer(x, "<i4").tolist()) for x in values]]

    return with_columns_from(df, [ids], T.StructType([T.StructField(text, T.StringType())]), make)


CODED = (
    T.StructType().add("n_pieces", T.LongType()).add("ids_crc32", T.LongType()).add("decoded_chars", T.LongType()).add("decoded_sha256", T.StringType()).add("round_trip", T.BooleanType())
)


def round_trips(df: DataFrame, text: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """df with what encoding and decoding again give, ids and texts staying in the task: n_pieces, ids_crc32 (unsigned),
    decoded_chars, decoded_sha256 and round_trip (the decoded text is the text).

    A null text has 0 pieces, the others null, and counts as round trip; an empty one has 0 pieces and the digests of
    nothing. Columns with these names are replaced; ``keep`` names those that are wanted later.
    """
    file = path or default_model()

    def make():
        encode, v = encode_here(file), vocabulary(file)

        def one(t: str | None, ids: bytes) -> tuple:
            if t is None:
                return 0, None, None, None, True
            back = decode(v, np.frombuffer(ids, "<i4").tolist())
            return len(ids) // 4, zlib.crc32(ids), len(back), hashlib.sha256(back.encode()).hexdigest(), back == t

        def work(texts):
            it = iter(encode([t for t in texts if t is not None]))
            got = [one(t, b"" if t is None else next(it)) for t in texts]
            return [list(c) for c in zip(*got, strict=True)] if got else [[] for _ in CODED]

        return work

    return with_columns_from(df, [text], CODED, make, keep=keep)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_chars, decoded_sha256 (of the text decoded from the ids) and round_trip of all
    documents; null texts as in round_trips."""
    return round_trips(load(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])

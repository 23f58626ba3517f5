"""Chat formatting by token-level assembly.

Segments are encoded one by one and never meet as text: turn marks are reserved ids beside the vocabulary, spliced
between the segments' ids. Control strings that occur in content are escaped reversibly, so the formatted text reads
back too. The loss mask follows from the segments' lengths by prefix sums.

Template of a turn, after ``<s>`` and before ``</s>``:
system ``<<SYS>>text<</SYS>>``, user ``[INST]text[/INST]``, assistant ``text`` (under the loss mask), any other role
``<<ROLE>>role<</ROLE>>text``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.tables import reachable

from .common import load, slices

#: The control strings, in the order of their reserved ids, which begin at the vocabulary's size.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>")
_RESTS = "|".join(re.escape(c[1:]) for c in CONTROLS)
PLAIN = re.compile(rf"([<\[])(?=\\*(?:{_RESTS}))")
ESCAPED = re.compile(rf"([<\[])\\(?=\\*(?:{_RESTS}))")


def escape(text: str) -> str:
    """A backslash goes behind the first character of every control string, and of every one escaped already."""
    return PLAIN.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


class Codec:
    """A byte-level vocabulary plus reserved ids."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.first = max(ranks.values()) + 1
        self.words = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.reserved = {c: self.first + k for k, c in enumerate(CONTROLS)}

    def encode(self, text: str) -> list[int]:
        """Ids of a text, none of them reserved. Lone surrogates become U+FFFD."""
        return self.words.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self.words.decode(ids)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        import public_tokenizers

        _codecs[path] = Codec(path, public_tokenizers.PATTERN)
    return _codecs[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def segments(c: Codec, role: str | None, text: str | None) -> list[tuple[list[int], bool]]:
    """(ids, under the loss mask) of a turn's segments. Null role and text count as empty."""
    mark = lambda s: ([c.reserved[s]], False)
    said = c.encode(escape(text or ""))
    if role == "assistant":
        return [mark("<s>"), (said, True), mark("</s>")]
    if role == "user":
        return [mark("<s>"), mark("[INST]"), (said, False), mark("[/INST]"), mark("</s>")]
    if role == "system":
        return [mark("<s>"), mark("<<SYS>>"), (said, False), mark("<</SYS>>"), mark("</s>")]
    return [mark("<s>"), mark("<<ROLE>>"), (c.encode(escape(role or "")), False), mark("<</ROLE>>"), (said, False), mark("</s>")]


def assemble(parts: list[tuple[list[int], bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of segments: +1 where a learned segment begins, -1 where it ends, summed up."""
    sizes = np.array([len(ids) for ids, _ in parts], np.int64)
    ends = np.cumsum(sizes)
    learned = np.array([m for _, m in parts], bool)
    steps = np.zeros(int(ends[-1]) + 1 if len(parts) else 1, np.int8)
    np.add.at(steps, (ends - sizes)[learned], 1)
    np.subtract.at(steps, ends[learned], 1)
    ids = np.concatenate([np.array(i, np.int32) for i, _ in parts]) if parts else np.zeros(0, np.int32)
    return ids, np.cumsum(steps[:-1], dtype=np.int8)


def format_turns(rows: DataFrame, vocabulary: str | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, place (of the turn in its conversation, from 0), token_offset, ids, loss_mask: a row per turn.

    Turns stand in order of turn (null first), then role, then text (null as empty, by UTF-8 bytes), so repeated rows
    stay and ties are settled. Null conv_ids make one conversation, in one task like any other. Turns are encoded where
    they lie; only then rows of a conversation come together, with their texts for the order, and they pass through one
    after the other: offsets are running sums, no conversation is held whole.
    """
    path = vocabulary or default_vocabulary()
    reachable(rows.sparkSession)
    key = rows.schema[conv_id].dataType.simpleString()
    turns = rows.schema[turn].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches, 512):
            got = [assemble(segments(c, r, t)) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("conv_id", "turn", "role", "text")), pa.array([i for i, _ in got], pa.list_(pa.int32())), pa.array([m for _, m in got], pa.list_(pa.int8()))],
                names=["conv_id", "turn", "role", "text", "ids", "loss_mask"],
            )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, last, n, offset = False, None, 0, 0
        for b in slices(batches, 1024):
            places, offsets = [], []
            for conv, size in zip(b.column("conv_id").to_pylist(), b.column("ids").value_lengths().to_pylist(), strict=True):
                if not begun or conv != last:
                    begun, last, n, offset = True, conv, 0, 0
                places.append(n)
                offsets.append(offset)
                n, offset = n + 1, offset + size
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(places, pa.int64()), pa.array(offsets, pa.int64()), b.column("ids"), b.column("loss_mask")], names=["conv_id", "turn", "place", "token_offset", "ids", "loss_mask"])

    plain = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    encoded = plain.mapInArrow(encode, f"conv_id {key}, turn {turns}, role string, text string, ids array<int>, loss_mask array<tinyint>")
    together = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "ids", "loss_mask")
    return together.mapInArrow(place, f"conv_id {key}, turn {turns}, place bigint, token_offset bigint, ids array<int>, loss_mask array<tinyint>")


def read_turn(c: Codec, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
    """role, text, text under the mask, and characters of the formatted text of one turn."""
    names = {v: k for k, v in c.reserved.items()}
    cuts = np.flatnonzero(ids >= c.first).tolist()
    kinds = [names[i] for i in ids[cuts].tolist()]
    between = [c.decode(ids[a + 1 : b].tolist()) if b > a + 1 else "" for a, b in zip(cuts, cuts[1:], strict=False)]
    formatted = sum(map(len, kinds)) + sum(map(len, between))
    learned = unescape(c.decode(ids[mask.astype(bool)].tolist())) if mask.any() else ""
    role = {"[INST]": "user", "<<SYS>>": "system", "</s>": "assistant"}.get(kinds[1])
    if role is None:
        return unescape(between[1]), unescape(between[2]), learned, formatted
    return role, unescape(between[0] if role == "assistant" else between[1]), learned, formatted


def lists_of(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column without nulls, as views of its values."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def digests(turns: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Read back from formatted turns, in their order: a row per conversation with n_turns, turns_sha256, loss_chars,
    loss_sha256 and formatted_chars. The hashes run along, so a conversation may be of any length."""
    path = vocabulary or default_vocabulary()
    key = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        state, done = None, []

        def batch(rows):
            arrays = [pa.array([r[0] for r in rows]).cast(kind)] + [pa.array(list(x), k) for x, k in zip(zip(*(r[1:] for r in rows), strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        kind = None
        for b in slices(batches, 512):
            kind = b.schema.field("conv_id").type
            for conv, ids, mask in zip(b.column("conv_id").to_pylist(), lists_of(b.column("ids")), lists_of(b.column("loss_mask")), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, learned, formatted = read_turn(c, ids, mask)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += formatted
            if len(done) >= 256:
                yield batch(done)
                done = []
        if state is not None:
            done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))
            yield batch(done)

    return turns.select("conv_id", "ids", "loss_mask").mapInArrow(run, f"conv_id {key}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, formatted, and of conversation -1, whose texts are control strings."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(format_turns(rows.unionByName(own)))


OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*(?:s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|<ROLE>>|</ROLE>>))', '\1\\\2', 'g'))
           + CASE role WHEN 'assistant' THEN 7 WHEN 'user' THEN 20 WHEN 'system' THEN 22
             ELSE 24 + length(regexp_replace(role, '([<\[])(\\*(?:s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|<ROLE>>|</ROLE>>))', '\1\\\2', 'g')) END AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

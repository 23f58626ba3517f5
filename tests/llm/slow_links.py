"""Links of two tokenizers by comparing every pair of tokens' byte ranges within a text."""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import accumulate

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer


def slow_links(rows: list[tuple]) -> list[tuple]:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for (doc_id, text) rows."""
    from spanloom.llm.wordpiece_cache import byte_letters

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = {c: n for n, c in byte_letters().items()}
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for doc_id, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        cut_a, cut_b = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a], [b_bytes(i) for i in ids_b]
        if text and (b"".join(cut_a) != (" " + text).encode() or b"".join(cut_b) != (" " + text).encode()):
            ids_a, ids_b, cut_a, cut_b = [], [], [], []
        at_a, at_b = list(accumulate(map(len, cut_a))), list(accumulate(map(len, cut_b)))
        links, j = [], 0
        for i, end in enumerate(at_a):
            start = end - len(cut_a[i])
            while j < len(at_b) and at_b[j] <= start:
                j += 1
            k = j
            while k < len(at_b) and at_b[k] - len(cut_b[k]) < end:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        both = sorted(set(at_a) & set(at_b))
        groups, i, j = [], 0, 0
        for end in both:
            one, two = i, j
            while i < len(at_a) and at_a[i] <= end:
                i += 1
            while j < len(at_b) and at_b[j] <= end:
                j += 1
            groups.append(",".join(map(str, ids_a[one:i])) + "|" + ",".join(map(str, ids_b[two:j])))
        found.append((doc_id, len(ids_a), len(ids_b), len(both), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    count = Counter(x for f in found for x in f[4])
    most: Counter = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(d, na, nb, ng, len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), sha) for d, na, nb, ng, x, sha in found]


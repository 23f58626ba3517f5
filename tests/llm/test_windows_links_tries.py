from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import differencing, prefix_trie, token_links
from spanloom.llm.byte_level import byte_level

from .slow_links import slow_links
from .test_documents import ODD, SCHEMA

#: Texts that the tokenizers cut in odd ways, or that one of them doesn't give back.
TEXTS = ["", " ", "a", "<|endoftext|> <s></s> [INST]", "▁ a mark of its own", "tabs\tand\nlines\r\n\n\n", "日本語 und Käse 🙂é", "x" * 500, " " * 700 + "y", "I'll we've  don't\x1c\x85 ", "a b ﬁ Å"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([*ODD, *((100 + k, t, "en", "a", len(t)) for k, t in enumerate(TEXTS)), (None, None, None, None, None)], SCHEMA)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# byte-level ids


def test_ranks_give_the_library_s_ids(spark, small, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for special in (True, False):
        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = not special
        ours = byte_level(path, special)
        assert ours.fast is not None
        spelt = ours.spelt()
        texts = [t for _, t in texts_of(spark.read.parquet(f"{small}/documents.parquet")) + texts_of(odd) if t] + ["\n" * 30_000, "word" + " " * 5000 + "word"]
        for t in texts:
            assert ours.ids(t) == whole.encode(t, add_special_tokens=False).ids
            assert special and "<|" in t or b"".join(spelt[i] for i in ours.ids(t)) == t.encode()


# even windows


def loads(sizes, dealt):
    return [sum(sizes[i] for i in w) for w in dealt]


def test_differencing_deals_every_size_once():
    rng = random.Random(3)
    for _ in range(200):
        sizes, k = [rng.randint(1, 300) for _ in range(rng.randint(0, 40))], rng.randint(1, 9)
        dealt = differencing.differencing(sizes, k)
        assert len(dealt) == k and sorted(i for w in dealt for i in w) == list(range(len(sizes)))


def test_differencing_of_two_windows_is_the_classic_one():
    """With two windows the imbalance is what repeated differences of the two largest leave."""
    rng = random.Random(4)
    for _ in range(100):
        sizes = [rng.randint(1, 10**6) for _ in range(rng.randint(2, 30))]
        left = sorted(sizes)
        while len(left) > 1:
            left = sorted([*left[:-2], left[-1] - left[-2]])
        a, b = loads(sizes, differencing.differencing(sizes, 2))
        assert abs(a - b) == left[0]


def test_differencing_is_near_the_best():
    rng, worse = random.Random(5), []
    for _ in range(40):
        sizes, k = [rng.randint(1, 100) for _ in range(8)], 3
        best = min(max(sum(s for s, w in zip(sizes, to, strict=True) if w == x) for x in range(k)) for to in itertools.product(range(k), repeat=len(sizes)))
        worse.append(max(loads(sizes, differencing.differencing(sizes, k))) / best)
    assert max(worse) < 1.25 and np.mean(worse) < 1.06


def test_count_of_windows_rises():
    assert len(differencing.near_equal([6, 6, 6], 10)) == 3
    assert len(differencing.near_equal([5, 5, 5, 5], 10)) == 2
    assert differencing.near_equal([], 10) == [[]]
    with pytest.raises(ValueError):
        differencing.near_equal([11], 10)
    rng = random.Random(6)
    sizes = [rng.randint(1, 512) for _ in range(1500)]
    dealt = differencing.near_equal(sizes, 2048)
    assert max(loads(sizes, dealt)) <= 2048 and len(dealt) <= -(-sum(sizes) // 2048) + 2 and max(loads(sizes, dealt)) - min(loads(sizes, dealt)) < 40


def check_windows(rows, got, capacity, end=1):
    """Every id of every document lies in one piece; windows are full or powers of two, without gaps."""
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    ids_of = defaultdict(list)
    for doc_id, text in rows:
        ids = np.array([*(whole.encode(text or "", add_special_tokens=False).ids), end], "<u4")
        want[doc_id] += len(ids)
        ids_of[doc_id].append(ids)
    have, by_window = Counter(), defaultdict(list)
    for r in got:
        have[r.doc_id] += r.length
        assert r.length > 0
        assert any(r.doc_tokens == len(i) and zlib.crc32(i[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for i in ids_of[r.doc_id])
        by_window[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for pieces in by_window.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity and at & (at - 1) == 0
    once = {d for d, n in Counter(d for d, _ in rows).items() if n == 1}
    for d in once:
        spans = sorted((r.start, r.start + r.length) for r in got if r.doc_id == d)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1] == want[d]


def test_even_windows(spark, small):
    check_windows(texts_of(spark.read.parquet(f"{small}/documents.parquet")), differencing.op11_even_windows(spark, small).collect(), 2048)


@pytest.mark.parametrize(("capacity", "grain", "block"), [(2048, 512, 1 << 20), (64, 16, 500), (8, 8, 1), (1, 1, 100)])
def test_even_windows_of_odd_rows(spark, odd, capacity, grain, block):
    rows = odd.where("length(text) < 3000 OR text IS NULL") if capacity < 64 else odd
    got = differencing.pack_evenly(rows.withColumn("START", F.lit("x")).repartition(2), capacity=capacity, grain=grain, block=block).collect()
    check_windows(texts_of(rows), got, capacity)


def test_even_windows_of_no_rows(spark, odd):
    assert differencing.pack_evenly(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        differencing.pack_evenly(odd, capacity=1000)


# links of two tokenizers

LINKS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def as_rows(df):
    return Counter(tuple(r[c] for c in LINKS) for r in df.collect())


def test_links_equal_slow_links(spark, small):
    assert as_rows(token_links.op12_token_links(spark, small)) == Counter(slow_links(texts_of(spark.read.parquet(f"{small}/documents.parquet"))))


@pytest.mark.parametrize("postings", [token_links.POSTINGS, 10])
def test_links_of_odd_rows(spark, odd, postings):
    """With several chunks too, and with rows that recur so often that bitmaps are dense and planes many."""
    many = odd.where("length(text) < 3000 OR text IS NULL")
    many = many.unionByName(many.where("doc_id = 6").crossJoin(spark.range(700)).select("doc_id", F.repeat("text", F.expr("int(1 + id % 9)")).alias("text"), "lang", "source", "n_chars"))
    assert as_rows(token_links.align(many.withColumn("CHUNK", F.lit(1)).repartition(3), postings=postings)) == Counter(slow_links(texts_of(many)))


def test_links_of_no_rows(spark, odd):
    assert token_links.align(odd.limit(0)).count() == 0


def test_bitmaps_open_to_what_they_were_made_of():
    rng = np.random.default_rng(1)
    for documents, pairs in ((40, 300), (5000, 3), (65_536, 2), (1, 1)):
        keys = np.unique(rng.integers(0, pairs, 4000) << 16 | rng.integers(0, documents, 4000))
        times = rng.integers(1, 70, len(keys))
        back = Counter()
        for plane, names, starts, data, dense in token_links.planes(keys, times, documents):
            of, place = token_links.opened(data, starts, dense)
            for k, p in zip(names[of].tolist(), place.tolist(), strict=True):
                back[k << 16 | p] += 1 if plane == 0 else 1 << (plane - 1)
        assert back == dict(zip(keys.tolist(), times.tolist(), strict=True))


def test_pair_counts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    _, bitmaps = token_links.inverted(docs, token_links.default_a(), token_links.default_b(), postings=2000)
    got = token_links.pair_counts(bitmaps)
    assert got.agg(F.sum("n_links")).first()[0] == token_links.op12_token_links(spark, small).agg(F.sum("n_links")).first()[0]
    assert got.where("n_docs > n_links OR n_docs < 1").count() == 0 and got.where("best").select("b").distinct().count() == got.select("b").distinct().count()


# tries of conversations

TURNS = "conv_id long, turn int, role string, text string"


def slow_trie(rows):
    """Every node by its sequence of turns; subtrees by comparing sequences."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(t)] for c, t in by.items()}
    ways = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        ways[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members, ends = defaultdict(set), defaultdict(list)
    for c, way in sorted(ways.items()):
        ends[way].append(c)
        for d in range(len(way) + 1):
            members[way[:d]].add(c)
    out = []
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaf = lambda n: not any(len(x) == len(n) + 1 and x[:-1] == n for x in members)
        saved = sum((len(members[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below)
        kids = sum(len(x) == len(node) + 1 and x[:-1] == node for x in members)
        sha = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), kids, sum(map(leaf, below)), saved, sha))
    return Counter(out)


def trie_rows(df):
    return Counter(tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect())


def test_trie_of_odd_rows(spark):
    rng, rows = random.Random(8), [(None, 0, "user", "no conversation"), (3, None, None, None), (3, 1, "user", None), (-7, 2, None, "x"), (-7, 2, None, "x"), (-7, 2, "a", "b"), (11, 5, "bc", ""), (12, 5, "b", "c"), (400, 0, "user", "é" * 9000)]
    for c in [*range(20, 45), 90, 91, 93]:
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "perhaps"])) for t in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, TURNS)
    assert trie_rows(prefix_trie.prefix_trie(df.withColumn("DEPTH", F.lit(0)).withColumn("node", F.lit("x")))) == slow_trie(rows)
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["chain", "caterpillar", "star", "random"])
def test_subtree_totals(spark, shape):
    """In few rounds, however deep the tree."""
    rng, n = random.Random(9), 600
    parent = {"chain": lambda k: k - 1, "caterpillar": lambda k: k - 1 if k % 2 else max(0, k - 2), "star": lambda k: 0, "random": lambda k: rng.randrange(max(0, k - 4), k)}[shape]
    up = {k: parent(k) for k in range(1, n)}
    depth, total = {0: 0}, {k: k * 7 % 13 for k in range(n)}
    for k in range(1, n):
        depth[k] = depth[up[k]] + 1
    tree = spark.createDataFrame([(k, up.get(k), depth[k], total[k]) for k in range(n)], "node long, parent long, depth long, v long")
    for k in range(n - 1, 0, -1):
        total[up[k]] += total[k]
    got = prefix_trie.subtree_totals(tree, ["v"], most_rounds=20)
    assert {r.node: r.v for r in got.collect()} == total


def test_long_runs_of_ends(spark, monkeypatch):
    """Many conversations end at one node: their ids are hashed run after run."""
    rows = [(c, 0, "user", "the same") for c in range(0, 500)]
    way = prefix_trie.steps(*prefix_trie.rebuilt(spark.createDataFrame(rows, TURNS))).withColumn("run", F.expr("shiftleft(run, 8) + conv_id div 7"))
    ends = {r.ends_sha256 for r in prefix_trie.end_digests(way).collect()}
    starts = [c for c in range(500) if not (zlib.crc32(str(c).encode()) % 9 and c - c % 5 not in range(500))]
    assert hashlib.sha256(",".join(map(str, starts)).encode()).hexdigest() in ends

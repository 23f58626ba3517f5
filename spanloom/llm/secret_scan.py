"""Secret scans: fixed rules plus two character Markov models told apart by their log-likelihood ratio.

One model learns random strings, one ordinary identifiers, both from labelled samples; counts of character pairs are
aggregated in Spark, so the models' size depends on the alphabet only. A run of token characters that no rule covers is
reported as ``random`` where the ratio says so.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.sources.tables import reachable

from .common import let, load, with_columns_from

# The rules' patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs: the same matches as runs of any length, the short ones dropped
KINDS = ("assign", "access", "hex", "random")

LEAST_RUN = 20  # characters, unless the caller says otherwise; the shorter, the more words look random by their pairs
GROWTH = 6
SEPARATOR = re.compile(r"[/=_-]")
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SYMBOLS = len(LETTERS) + 2  # the edge of a string, and any other character
#: Of the log-likelihood ratio: nats a character, and in all.
LEAST_MEAN, LEAST_TOTAL = 0.9, 30.0

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The rules' matches: leftmost, not overlapping within a kind; those too short are dropped after matching."""
    found: list[Span] = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered(spans))


_CODES = np.full(0x110000, SYMBOLS - 1, np.uint8)
_CODES[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
_CODES[0] = SYMBOLS - 2  # parts strings


def codes(value: str) -> np.ndarray:
    """Symbol numbers of the characters, an edge symbol before and after."""
    edge = np.array([SYMBOLS - 2], np.uint8)
    return np.concatenate([edge, _CODES[np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)], edge])


class Markov:
    """ratio[a, b]: log-likelihood ratio, random over ordinary, of symbol b after symbol a. Runs and parts of fewer than
    ``least_run`` characters are never random."""

    def __init__(self, ratio: np.ndarray, least_run: int = LEAST_RUN):
        self.ratio, self.least_run = ratio, least_run
        self.candidate = re.compile(rf"[A-Za-z0-9+/_=-]{{{least_run},}}")

    def score(self, value: str) -> tuple[float, float]:
        """The ratio in all and a character."""
        c = codes(value)
        total = float(self.ratio[c[:-1], c[1:]].sum())
        return total, total / max(1, len(c) - 1)

    def is_random(self, value: str) -> bool:
        total, mean = self.score(value)
        return total >= LEAST_TOTAL and mean >= LEAST_MEAN

    def random_parts(self, value: str) -> list[tuple[int, int]]:
        """The random parts of a run of token characters: of its maximal parts (see maximal_parts; a key behind a path,
        say) each is grown to separators or ends less than GROWTH characters away, not into other parts, where it stays
        random; those that are random and long enough count. Time grows with the run's length."""
        c = codes(value)
        sums = np.concatenate([[0.0], np.cumsum(self.ratio[c[:-2], c[1:-1]])])  # without the step into the end
        above = sums - LEAST_MEAN * np.arange(len(sums))
        random_ = lambda a, b: sums[b] - sums[a] >= max(LEAST_TOTAL, LEAST_MEAN * (b - a))
        edges = sorted({0, len(value), *(x for m in SEPARATOR.finditer(value) for x in m.span())})
        out, parts = [], maximal_parts(above)
        for k, (start, end) in enumerate(parts):
            lowest = max(parts[k - 1][1] if k else 0, out[-1][1] if out else 0, start - GROWTH)
            highest = min(parts[k + 1][0] if k + 1 < len(parts) else len(value), end + GROWTH)
            left, right = edges[bisect_right(edges, start) - 1], edges[bisect_left(edges, end)]
            grown = left if left >= lowest else start, right if right <= highest else end
            if random_(*grown):
                start, end = grown
            if end - start >= self.least_run and random_(start, end):
                out.append((start, end))
        return out

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Random-looking runs, and parts of runs, outside the base spans. Both go by start, so one pass over each is
        enough; what a base span leaves of a run is a run of its own."""
        out, known, k = [], sorted((a, b) for _, a, b in base), 0
        reach = 0  # the end of the base spans so far
        for m in self.candidate.finditer(text):
            at = m.start()
            pieces = []
            while k < len(known) and known[k][0] < m.end():
                pieces.append((max(at, reach), known[k][0]))
                reach = max(reach, known[k][1])
                k += 1
            pieces.append((max(at, reach), m.end()))
            for a, b in pieces:
                if b - a >= self.least_run:
                    out += [("random", a + x, a + y) for x, y in self.random_parts(text[a:b])]
        return out


def maximal_parts(level: np.ndarray) -> list[tuple[int, int]]:
    """Of a walk with these levels the parts that rise most: the best one (the first and shortest of equals), and likewise
    in what is left on either side of it. By start, in one pass.

    Parts found so far stand on a stack. Each knows the last part before it that begins lower (``lower``): only that one
    can be joined to it, and is where it ends lower too.
    """
    up = np.flatnonzero(np.diff(level) > 0)
    if not len(up):
        return []
    cut = np.flatnonzero(np.diff(up) > 1) + 1
    values = level.tolist()
    stack: list[tuple[int, int, int]] = []  # start, end, lower
    for start, last in zip(up[np.append(0, cut)].tolist(), up[np.append(cut - 1, len(up) - 1)].tolist(), strict=True):
        end = last + 1
        at = len(stack) - 1
        while True:
            while at >= 0 and values[stack[at][0]] >= values[start]:
                at = stack[at][2]
            if at < 0 or values[stack[at][1]] >= values[end]:
                break
            start, before = stack[at][0], stack[at][2]
            del stack[at:]
            at = before
        stack.append((start, end, at))
    return [(a, b) for a, b, _ in stack]


def samples(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most_documents: int = 400, strings: int = 4000, seed: int = 11) -> DataFrame:
    """Labelled samples (value, label): label 1 random strings in usual alphabets, label 0 identifiers made of the
    corpus's own words (alone, snake_case, kebab-case, camelCase, paths).

    Bounds: words come from ``most_documents`` documents, the least by a hash of id and text; ``strings`` random strings.
    """
    spark = docs.sparkSession
    plain = docs.where(F.col(text).isNotNull()).select(F.xxhash64(doc_id, text).alias("h"), F.col(text).alias("text"))
    # only hashes are ranked; texts of the documents chosen are read after that
    last = plain.select("h").orderBy("h").limit(most_documents).agg(F.max("h")).first()[0]
    some = plain.where(F.col("h") <= F.lit(last)).limit(most_documents)
    words = F.filter(F.regexp_extract_all("text", F.lit(r"\p{Alpha}+"), F.lit(0)), lambda w: F.length(w) >= 2)
    triples = let(words, lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - 2, F.lit(3)), lambda k: F.slice(ws, k, 3)))
    lists = some.where(F.size(words) >= 3).select(F.explode(triples).alias("ws"))
    joined = [F.array_join("ws", "_"), F.array_join("ws", "-"), F.array_join("ws", "/"), F.array_join(F.transform("ws", F.initcap), ""), F.upper(F.array_join("ws", "_"))]
    ordinary = some.select(F.explode(words).alias("value")).union(lists.select(F.explode(F.array(*joined)).alias("value")))
    rng = random.Random(seed)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", LETTERS[:62], LETTERS[:64], "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", LETTERS]
    made = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(16, 64))), 1) for _ in range(strings)]
    return ordinary.select("value", F.lit(0).alias("label")).union(spark.createDataFrame(made, "value string, label int"))


def train(labelled: DataFrame, alpha: float = 0.5, least_run: int = LEAST_RUN) -> Markov:
    """Counts of symbol pairs by label (at most 2 * SYMBOLS**2 rows reach the driver); null values count for nothing.
    ``least_run``: see Markov."""
    reachable(labelled.sparkSession)

    def count(batches):
        import pyarrow as pa

        seen = {0: np.zeros((SYMBOLS, SYMBOLS), np.int64), 1: np.zeros((SYMBOLS, SYMBOLS), np.int64)}
        for b in batches:
            labels = b.column("label").to_numpy()
            for label, n in seen.items():
                c = codes("\0".join(b.column("value").filter(pa.array(labels == label)).to_pylist())).astype(np.int64)
                n += np.bincount(c[:-1] * SYMBOLS + c[1:], minlength=SYMBOLS**2).reshape(SYMBOLS, SYMBOLS)
        for label, n in seen.items():
            a, z = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(a), pa.int32()), pa.array(a, pa.int32()), pa.array(z, pa.int32()), pa.array(n[a, z], pa.int64())], names=["label", "a", "z", "n"])

    rows = labelled.dropna().where("label in (0, 1)").mapInArrow(count, "label int, a int, z int, n bigint").groupBy("label", "a", "z").agg(F.sum("n").alias("n")).collect()
    counts = np.full((2, SYMBOLS, SYMBOLS), alpha)
    for r in rows:
        counts[r["label"], r["a"], r["z"]] += r["n"]
    p = np.log(counts / counts.sum(axis=2, keepdims=True))
    return Markov(p[1] - p[0], least_run)


FOUND = T.StructType([T.StructField("secrets", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])


def scan(df: DataFrame, model: Markov, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with ``secrets``: kind, start and end (code points, end exclusive) of each span, by start, then kind.

    Null and empty texts have none. A column of that name is replaced; others, or those in ``keep``, pass through.
    """
    sent = df.sparkSession.sparkContext.broadcast((model.ratio, model.least_run))

    def make():
        m = Markov(*sent.value)

        def work(texts):
            out = []
            for t in texts:
                base = base_spans(t or "")
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in ordered(base + m.spans(t or "", base))])
            return [out]

        return work

    return with_columns_from(df, [text], FOUND, make, keep=keep)


def masked(df: DataFrame, model: Markov, text: str = "text", mark: str = "<secret>") -> DataFrame:
    """df with every secret in ``text`` replaced by ``mark``; spans that overlap or touch become one. Of an assignment
    only the value goes, the name stays. Null stays null."""
    sent = df.sparkSession.sparkContext.broadcast((model.ratio, model.least_run))
    kind = next(f for f in df.schema if f.name == text)

    def clean(m: Markov, t: str | None) -> str | None:
        if not t:
            return t
        base = base_spans(t)
        cut = [(ASSIGN.match(t, a).start(2) if k == "assign" else a, b) for k, a, b in base + m.spans(t, base)]
        out, at = [], 0
        for a, b in sorted(cut):
            if a > at or not out:
                out += [t[at:a], mark]
            at = max(at, b)
        return "".join(out) + t[at:] if out else t

    def make():
        m = Markov(*sent.value)
        return lambda texts: [[clean(m, t) for t in texts]]

    return with_columns_from(df, [text], T.StructType([T.StructField(text, kind.dataType)]), make)


def digest(kinds: tuple[str, ...]):
    """kind:start:end of the spans of these kinds, comma-joined."""
    chosen = F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and all spans of every document."""
    docs = load(spark, sf_dir, "documents")
    found = scan(docs.select("doc_id", "text"), train(samples(docs)), keep=["doc_id"])
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(digest(KINDS[:3]).cast("binary"), 256).alias("base_sha256"), digest(KINDS).alias("spans"))


def mask_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are masked in the texts, n_chars follows; no document goes.

    Null texts stay null, and so does their n_chars; empty ones stay empty. Rows that recur stay, each masked alike. The
    models are trained on the stage's own documents; without any, random strings alone train them, and no row needs them.
    """
    out = masked(docs, train(samples(docs)))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)

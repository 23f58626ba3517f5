"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of all labelled rows in Spark (per-task partial counts, then one aggregation by language and
bucket); what reaches the driver is at most ``2**BUCKET_BITS`` counts a language, whatever the input. The
log-probability matrix is broadcast, and each batch of texts is scored as one sparse matrix in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.sources.tables import reachable

from .common import Scratch, free_name, load, slices, with_columns_from

BUCKET_BITS = 15
ORDERS = (1, 2, 3)
UNDETERMINED = "und"


def buckets(text: str) -> np.ndarray:
    """The hashed n-grams of the whole lower-cased text, n in ORDERS; a space stands at each end."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    h, out = np.zeros(len(points), np.uint32), []
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            break
        h = h[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out)


class Model:
    """langs: sorted labels; weights: float32 matrix of log-probabilities, a row per bucket, a column per label."""

    def __init__(self, langs: list[str], weights: np.ndarray, prior: np.ndarray):
        self.langs, self.weights, self.prior = langs, weights, prior

    def totals(self, texts: list[str]) -> np.ndarray:
        """Log-probability of every label (a column) for every text (a row).

        The texts' n-grams are a sparse matrix in compressed rows: bucket numbers, and where each text's begin. Its
        product with the weights is taken for some texts at a time, of a long one for some n-grams at a time, so memory
        is bounded; how texts are batched has no part in their sums.
        """
        out = np.tile(self.prior, (len(texts), 1))
        step = max(1 << 10, (1 << 21) // max(1, len(self.langs)))
        row, held, starts, size = 0, [], [], 0

        def add(upto: int) -> None:
            if held:
                out[row:upto] += np.add.reduceat(self.weights[np.concatenate(held)], starts, axis=0, dtype=np.float64)

        for k, text in enumerate(texts):
            found = buckets(text)
            if size + len(found) > step:
                add(k)
                row, held, starts, size = k, [], [], 0
            while len(found) > step:
                out[k] += self.weights[found[:step]].sum(axis=0, dtype=np.float64)
                found = found[step:]
            starts.append(size)
            held.append(found)
            size += len(found)
        add(len(texts))
        return out

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Label and posterior probability of each text; ties go to the label that sorts first."""
        out = [(UNDETERMINED, 0.0)] * len(texts)
        at = [k for k, t in enumerate(texts) if t is not None and self.langs and any(map(str.isalpha, t))]
        if at:
            totals = self.totals([texts[k] for k in at])
            best = totals.argmax(axis=1)
            score = 1 / np.exp(totals - totals[np.arange(len(at)), best][:, None]).sum(axis=1)
            for k, b, s in zip(at, best.tolist(), score.tolist(), strict=True):
                out[k] = (self.langs[b], s)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", alpha: float = 0.5, most_held: int = 64) -> Model:
    """Counts over all rows with text and label. Any number of labels: the matrix has 128 kB for each; a task holds the
    counts of ``most_held`` labels before it passes them on, and the driver fetches those of as many at a time."""
    reachable(labelled.sparkSession)
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).dropna()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for label, counts in seen.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * (len(at) + 1), pa.string()), pa.array([-1, *at.tolist()], pa.int32()), pa.array([docs[label], *counts[at].tolist()], pa.int64())],
                    names=["lang", "bucket", "n"],
                )

        for b in slices(batches):
            for label, value in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if label not in seen:
                    if len(seen) >= most_held:
                        yield from passed()
                        seen.clear(), docs.clear()
                    seen[label] = np.zeros(1 << BUCKET_BITS, np.int64)
                docs[label] = docs.get(label, 0) + 1
                found = buckets(value)
                for at in range(0, len(found), 1 << 20):
                    seen[label] += np.bincount(found[at : at + (1 << 20)], minlength=1 << BUCKET_BITS)
        yield from passed()

    with Scratch() as hold:
        found = hold(rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
        seen = {r["lang"]: r["n"] for r in found.where("bucket < 0").collect()}
        langs = sorted(seen)
        weights, prior = np.zeros((1 << BUCKET_BITS, len(langs)), np.float32), np.array([seen[x] for x in langs], float)
        place = {x: i for i, x in enumerate(langs)}
        for first in range(0, len(langs), most_held):
            some = langs[first : first + most_held]
            got = found.where(F.col("lang").isin(some) & (F.col("bucket") >= 0)).toArrow()
            counts = np.full((1 << BUCKET_BITS, len(some)), alpha)
            at = pc.index_in(got.column("lang"), pa.array(some)).to_numpy()
            counts[got.column("bucket").to_numpy(), at] += got.column("n").to_numpy()
            weights[:, place[some[0]] : place[some[-1]] + 1] = np.log(counts / counts.sum(axis=0))
    return Model(langs, weights, np.log(prior / max(1.0, prior.sum())))


def identify(df: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """df with ``lang_pred`` (a learned label, or ``und``: text null, without letters, or nothing learned) and ``score``
    (posterior probability, 0 for ``und``). Columns with these names are replaced, others (or those in ``keep``) pass
    through."""
    sent = df.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.prior))

    def make():
        m = Model(*sent.value)

        def work(texts):
            got = m.predict_all(texts)
            return [[g[0] for g in got], [g[1] for g in got]]

        return work

    fields = T.StructType([T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return with_columns_from(df, [text], fields, make, keep=keep)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text is 2 modulo 4; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all documents, learned from those not held out."""
    docs = load(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Pipeline stage: documents whose language can't be told (no letters, null, or a posterior under ``least``) go."""
    lang, score = free_name(docs, "__lang_pred"), free_name(docs, "__score")
    got = identify(docs, train(docs.where(~held_out())), lang_pred=lang, score=score)
    return got.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= F.lit(float(least)))).select(*docs.columns)

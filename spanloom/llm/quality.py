"""Line-first quality rules, in DataFrame functions only.

Every line of a text is judged by punctuation, navigation and boilerplate rules. Lines that fail are removed; a document
that loses too much of its words' characters with them is rejected. All of it is work within one row, so documents never
meet in a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, let, load

# Fixed values.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules; shares are of a line's words unless said otherwise."""

    symbols_per_word: float = 0.3  # punctuation: characters of SYMBOLS, and runs of ! or ?
    shouted: float = 0.7  # punctuation: capital letters among letters, in lines of least_words or more
    unpunctuated_words: int = 60  # punctuation: a line of so many words needs one of . , ; : ! ?
    separators: float = 0.2  # navigation: words that are only a separator
    least_words: int = 4
    boilerplate: str = (
        r"(?i)(all rights reserved|licen[sc]ed under|released under the|terms of (use|service)|privacy policy|cookie policy|use cookies|"
        r"enable javascript|lorem ipsum|spdx-license-identifier|creative commons|gnu general public license|copyright (\(c\)|©))"
    )
    boilerplate_words: int = 30  # longer lines are prose that mentions such a phrase
    most_lost: float = 0.5  # of the document's word characters


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def n_repeat_words(words: Column, size: int = WINDOW) -> Column:
    """How many words stand in a window of ``size`` words that occurs twice or more in the array.

    Windows are compared by a 64-bit hash of their words' hashes. Where all differ, that is all. Else they are sorted by
    hash and place: equal windows are neighbours, and the places of those with an equal neighbour, sorted again, cover
    min(size, distance to the next) words each.
    """

    def windows(hs: Column) -> Column:
        whole = F.transform(hs, lambda h, i: F.xxhash64(h, *[F.get(hs, i + k) for k in range(1, size)]))
        return F.slice(whole, F.lit(1), F.size(hs) - (size - 1))

    def repeated(s: Column) -> Column:
        equal = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
        found = F.transform(s, lambda x, k: F.when(equal(k, k - 1) | equal(k, k + 1), x["i"]))
        return F.sort_array(F.filter(found, lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        gap = lambda x, k: F.least(F.coalesce(F.get(at, k + 1) - x, F.lit(size)), F.lit(size))
        return F.aggregate(F.transform(at, gap), F.lit(0).cast("long"), lambda a, x: a + x)

    def counted(hs: Column) -> Column:
        placed = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(let(let(placed, repeated), covered))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < size, F.lit(0).cast("long")).otherwise(let(let(hashes, windows), counted))


def line_verdict(line: Column, rules: Rules) -> Column:
    """struct(text, chars, fails, boilerplate) of a line. fails: a punctuation or navigation rule; chars: its words'
    characters. Lines without words never fail: they part paragraphs."""

    def judge(x: Column) -> Column:
        n = F.size(x["w"])
        marks = n_symbols(x["t"]) + F.size(F.split(x["t"], r"[!?]{2,}")) - 1
        letters = F.length(F.regexp_replace(x["t"], r"[^\p{L}]+", ""))
        capitals = F.length(F.regexp_replace(x["t"], r"[^\p{Lu}]+", ""))
        separators = F.size(F.filter(x["w"], lambda w: w.isin("|", "»", "›", "•", "·", "/", ">", "<", "::", "→", "-", "–")))
        punctuation = (
            (marks > rules.symbols_per_word * n)
            | ((n >= rules.least_words) & (capitals > rules.shouted * letters))
            | ((n >= rules.unpunctuated_words) & ~x["t"].rlike(r"[.,;:!?]"))
        )
        navigation = (separators >= 2) & (separators > rules.separators * n)
        boilerplate = (n > 0) & (n <= rules.boilerplate_words) & x["t"].rlike(rules.boilerplate)
        chars = F.aggregate(x["w"], F.lit(0), lambda a, w: a + F.length(w))
        return F.struct(x["t"].alias("text"), chars.alias("chars"), ((n > 0) & (punctuation | navigation)).alias("fails"), boilerplate.alias("boilerplate"))

    return let(F.struct(line.alias("t"), words_of(line).alias("w")), judge)


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, "")).cast("long")


def judged(df: DataFrame, text: str = "text", rules: Rules | None = None, prefix: str = "") -> DataFrame:
    """df with the base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), base_failed, clean_text
    (the text without the lines that fail a rule of any kind), lost_chars (word characters of these lines) and kept.

    A null text counts as empty, fails the base and stays null in clean_text. ``prefix`` goes before these names; columns
    that have them are replaced, all others stay.
    """
    rules = rules or Rules()
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(whole, "\n")
    worded = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(words_of(F.col(text)), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), n_repeat_words(ws).alias("n_repeat_words")))

    def weigh(ls: Column) -> Column:
        gone = lambda x: x["fails"] | x["boilerplate"]
        lost = F.aggregate(ls, F.lit(0).cast("long"), lambda a, x: a + F.when(gone(x), x["chars"]).otherwise(0))
        left = F.filter(ls, lambda x: ~gone(x))
        return F.struct(lost.alias("lost"), F.array_join(F.transform(left, lambda x: x["text"]), "\n").alias("clean"), F.exists(left, lambda x: x["chars"] > 0).alias("some"))

    words, judged_lines = free_name(df, "__words"), free_name(df, "__lines")
    name = lambda c: prefix + c
    out = df.withColumns({words: counts, judged_lines: let(F.transform(lines, lambda x: line_verdict(x, rules)), weigh)})
    n_words, n_repeats, lost, chars = (F.col(words)["n_words"], F.col(words)["n_repeat_words"], F.col(judged_lines)["lost"], word_chars(whole))
    failed = (n_words < 10) | (100 * n_repeats > 20 * n_words)
    kept = ~failed & F.col(judged_lines)["some"] & (lost <= rules.most_lost * chars)
    clean = F.when(F.col(text).isNotNull(), F.col(judged_lines)["clean"])
    out = out.withColumns(
        {
            name("n_words"): n_words,
            name("word_chars"): chars,
            name("n_symbols"): n_symbols(whole).cast("long"),
            name("n_dup_lines"): let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            name("n_repeat_words"): n_repeats,
            name("clean_text"): clean,
            name("lost_chars"): lost,
            name("base_failed"): failed,
            name("kept"): kept,
        }
    )
    return out.drop(words, judged_lines)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and lost_chars of every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go; of the others the failing lines go, and n_chars follows.

    Null, empty and wordless texts fail the base rules and go. Each row is judged by itself, so rows that recur stay or go
    together; ids and other columns may be null. A table without rows gives none.
    """
    prefix = "__judged_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    kept = judged(docs, prefix=prefix).where(F.col(f"{prefix}kept"))
    return kept.withColumn("text", F.col(f"{prefix}clean_text")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)

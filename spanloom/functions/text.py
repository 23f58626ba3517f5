"""Text functions as column expressions; Arrow functions only where Spark has none (Unicode normal forms)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = "aeiouy"
#: Long forms of contracted endings.
ENDINGS = (("n't", " not"), ("'re", " are"), ("'ve", " have"), ("'ll", " will"), ("'m", " am"), ("in'", "ing"))


def basic(text: Column) -> Column:
    """Lower case, hyphens to spaces, only a-z, 0-9, apostrophes and spaces stay; trimmed, inner spaces as they are."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "-", " "), "[^a-z0-9' ]+", ""))


def slug(text: Column, fallback: Column) -> Column:
    """Lower case, other characters than a-z and 0-9 to single hyphens, none at the ends; ``fallback`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), fallback)


def title(text: Column, stopwords: list[str] | None = None) -> Column:
    """Lower case, punctuation to spaces, single spaces; without stopwords if some are given."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    if stopwords:
        words = F.filter(words, lambda w: ~w.isin(*stopwords))
    return F.array_join(words, " ")


def clean_title(text: Column, patterns: list[str], suffixes: list[str]) -> Column:
    """Removes patterns (in order), then suffixes (any case), then outer spaces."""
    for p in patterns:
        text = F.regexp_replace(text, f"(?i){p}", "")
    for s in suffixes:
        text = F.regexp_replace(text, rf"(?i)\Q{s}\E\s*$", "")
    return F.trim(text)


def strip_leading(text: Column, prefix: Column) -> Column:
    """Removes ``prefix`` (any case) and the separators after it from the start."""
    hit = F.lower(text).startswith(F.lower(prefix)) & (F.length(prefix) > 0)
    return F.when(hit, F.regexp_replace(F.substr(text, F.length(prefix) + 1), r"^[\s\-:–]+", "")).otherwise(text)


def line(text: Column) -> Column:
    """Without bracketed parts; only a-z, 0-9, apostrophes and single spaces stay."""
    bare = F.regexp_replace(F.lower(text), r"\[[^\]]*\]|\([^)]*\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9']+", " "), " +", " "))


def word(text: Column) -> Column:
    """Lower case, without punctuation at the ends."""
    return F.regexp_replace(F.lower(text), r"^[\p{Punct}\s]+|[\p{Punct}\s]+$", "")


def skeleton(text: Column) -> Column:
    """Without vowels."""
    return F.translate(text, VOWELS, "")


def hyphen_parts(text: Column) -> Column:
    """The parts between hyphens, if more than one; else the word alone."""
    parts = F.filter(F.split(text, "-"), lambda p: p != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array(text))


def expand_contractions(text: Column) -> Column:
    """Long forms of contracted word endings, in the order of ENDINGS."""
    for short, long in ENDINGS:
        text = F.regexp_replace(text, rf"(?<=\p{{L}}){short}\b" if not short.endswith("'") else rf"(?<=\p{{L}}){short}(?=\s|$)", long)
    return text


def lexical_tokens(text: Column, apostrophes: bool = True) -> Column:
    """Letters (and apostrophes) of each white-space token; empty ones go."""
    keep = r"[^a-z']" if apostrophes else r"[^a-z]"
    return F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, keep, "")), lambda w: w != "")


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Distinct tokens that two arrays share over the smaller distinct count; 0 if one is empty."""
    n = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / F.when(n > 0, n)).otherwise(0.0)


def hit_ratio(tokens: Column, bag: Column, least: int = 2) -> Column:
    """Share of the tokens with ``least`` characters or more that are in the bag; 0 without any."""
    t = F.filter(tokens, lambda w: F.length(w) >= least)
    return F.when(F.size(t) > 0, F.size(F.filter(t, lambda w: F.array_contains(bag, w))) / F.when(F.size(t) > 0, F.size(t))).otherwise(0.0)


def is_subphrase(needle: Column, haystack: Column) -> Column:
    """Whether one token array stands in another without a gap; an empty one never does."""
    inside = F.contains(F.concat(F.lit(" "), F.array_join(haystack, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(needle, " "), F.lit(" ")))
    return (F.size(needle) > 0) & inside


def split_long(text: Column, most: int = 45) -> Column:
    """One or two lines: texts longer than ``most`` are cut in the middle of their words."""
    words = F.split(F.trim(text), r"\s+")
    half = F.floor(F.size(words) / 2).cast("int")
    two = F.array(F.array_join(F.slice(words, F.lit(1), half), " "), F.array_join(F.slice(words, half + 1, F.size(words) - half), " "))
    return F.when((F.length(F.trim(text)) > most) & (F.size(words) > 1), two).otherwise(F.array(F.trim(text)))


def prefix_splits(text: Column) -> Column:
    """All (head, tail) splits of a text between words, shortest head first."""
    words = F.split(F.trim(text), r"\s+")
    cut = lambda k: F.struct(F.array_join(F.slice(words, F.lit(1), k), " ").alias("head"), F.array_join(F.slice(words, k + 1, F.size(words) - k), " ").alias("tail"))
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), cut)).otherwise(F.array().cast("array<struct<head:string,tail:string>>"))


#: Signs of lines without words.
SYMBOLS = "♪🎵🎶♫♬-–—=_.·•"
#: Parts of lines that advertise, in any case.
PROMOTION = (r"https?://", r"www\.", r"@\w", r"\bmp3\b", r"\bsms\b", r"\bdownload\b", r"\bsubscribe\b", r"\bmember\b", r"\bring( ?)?tone\b", r"\bmobile\b", r"\bphone\b", r"\btext\b")
#: Fixed value: telephone numbers and short codes.
TELEPHONE = r"\+?[0-9][0-9\s\-().]{4,}[0-9]"
#: Fixed value: one word, a colon and capitalised words.
CREDIT = r"^([\p{L}\p{N}_]+)\s*:\s*([A-Z][a-z]+(\s+[A-Z][a-z]+)*)\s*$"


def is_symbols_only(text: Column) -> Column:
    """Blank, or white space and SYMBOLS only. Null counts as blank."""
    return F.coalesce(text, F.lit("")).rlike(f"^[\\s{SYMBOLS.replace('-', chr(92) + '-')}]*$")


def has_credit(text: Column, most: int = 15) -> Column:
    """``Word: Proper Name`` with a first word of at most ``most`` characters."""
    line = F.trim(text)
    return line.rlike(CREDIT) & (F.length(F.regexp_extract(line, CREDIT, 1)) <= most)


def is_promo(text: Column) -> Column:
    """Holds a web address, an @ before a word, one of the words of PROMOTION, or a telephone number."""
    low = F.lower(text)
    return low.rlike("|".join(PROMOTION)) | low.rlike(TELEPHONE)


def _each(texts: pa.Array, one: Callable[[str], str]) -> pa.Array:
    """one(text) of each text that is not null; few texts at a time are Python strings, the others stay in Arrow."""
    made = [pa.array([None if t is None else one(t) for t in texts.slice(at, 256).to_pylist()], pa.string()) for at in range(0, len(texts), 256)]
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def canonical(text: pa.Array) -> pa.Array:
    """NFKC, typographic quotes and dashes to plain ones, single spaces."""
    table = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."})
    return _each(text, lambda t: " ".join(unicodedata.normalize("NFKC", t).translate(table).split()))


def syllables(text: Column) -> Column:
    """The runs of a-z of a text, lower case, cut so that each part ends with a vowel; what follows the last one is a part."""
    consonant = "[a-z&&[^" + VOWELS + "]]"
    return F.regexp_extract_all(F.lower(text), F.lit(f"{consonant}*[{VOWELS}]|{consonant}+"), F.lit(0))


@F.arrow_udf(T.StringType())
def matching(text: pa.Array) -> pa.Array:
    """Lower case, accents off, other characters than letters, digits and spaces off, single spaces."""

    def one(t: str) -> str:
        bare = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
        return " ".join("".join(c if c.isalnum() or c.isspace() else " " for c in bare).split())

    return _each(text, one)

"""Lines of text with singers, titles and timed words, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a name that stand for several singers.
DUET = ("&", " and ", " feat ", " feat.", " with ", " x ")
#: What video titles end in, and separators of artist and title in order of precedence.
SUFFIXES = ("Official Music Video", "Official Video", "Official Audio", "Lyric Video", "Lyrics", "HD", "4K", "MV", "(Official)")
TITLE_SEPARATORS = (" - ", " – ", " — ", " | ")


def any_unknown_singer(line: Column, known: list[str]) -> Column:
    """Whether some part of a line (between / and ,) is no known singer's name: lines of names only are none."""
    names = F.array(*[F.lit(x.lower()) for x in known]) if known else F.array().cast("array<string>")
    parts = F.transform(F.split(F.lower(line), "[/,]"), F.trim)
    return F.size(F.array_except(parts, names)) > 0


def singer_id(name: Column, singers: list[str]) -> Column:
    """unknown (no name, or no singers), both (a duet's name), or singerN of the first singer whose name begins the name or
    is begun by it; singer1 if none does."""
    low = F.trim(F.lower(name))
    out = F.when(F.coalesce(name, F.lit("")) == "", "unknown")
    for part in DUET:
        out = out.when(F.contains(low, F.lit(part)), "both")
    for k, s in enumerate(singers, 1):
        out = out.when(F.startswith(low, F.lit(s.lower())) | F.startswith(F.lit(s.lower()), low), f"singer{k}")
    return out.otherwise("singer1" if singers else "unknown")


def replaced(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """text with each pattern's matches replaced by its word and what the pattern's one group (a suffix) matched."""
    for pattern, word in patterns:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(f"{word}$1"))
    return text


def window_tokens(words: Column, normalise) -> Column:
    """(token, start) of timed words (text, start): each token of a word's normalised text, with the word's start. Words
    without a start or without tokens have none. ``normalise`` maps a Column to a Column."""
    timed = F.filter(words, lambda w: w["start"].isNotNull() & w["text"].isNotNull())
    tokens = lambda w: F.filter(F.split(normalise(w["text"]), r"\s+"), lambda t: t != "")
    return F.flatten(F.transform(timed, lambda w: F.transform(tokens(w), lambda t: F.struct(t.alias("token"), w["start"].alias("start")))))


#: Fixed value: bracketed notes of a title, with the white space around them.
NOTES = r"(?i)\s*[(\[](?:remaster(?:ed)?|remix|live|acoustic|demo|edit|version|ver\.?|feat\.?\s+[^)\]]+|ft\.?\s+[^)\]]+|with\s+[^)\]]+|\d{4}(?:\s+remaster)?|single|album|ep|radio|extended|original|bonus\s+track|deluxe|explicit|clean)[)\]]\s*"


def scaled(seconds: Column, tempo: float) -> Column:
    """A time at another tempo."""
    return seconds if tempo == 1.0 else seconds / tempo


def title_parts(title: Column) -> Column:
    """struct(artist, title) of a video's title: endings and bracketed notes off, then parted at the first separator kind
    that occurs. Without one the artist is null."""
    text = title
    for suffix in SUFFIXES:
        text = F.regexp_replace(text, F.lit(rf"(?i)\s*[(\[]?\s*\Q{suffix}\E\s*[)\]]?\s*$"), F.lit(""))
    text = F.trim(F.regexp_replace(F.regexp_replace(text, F.lit(NOTES), F.lit(" ")), F.lit(r"\s+"), F.lit(" ")))
    pair = lambda a, b: F.struct(a.alias("artist"), b.alias("title"))
    out = None
    for sep in TITLE_SEPARATORS:
        at = F.locate(sep, text)
        cut = pair(F.trim(F.substring(text, F.lit(1), at - 1)), F.trim(F.substring(text, at + len(sep), F.length(text))))
        out = F.when(at > 0, cut) if out is None else out.when(at > 0, cut)
    return out.otherwise(pair(F.lit(None).cast("string"), text))
